"""Run configuration and its command-line options."""

from __future__ import annotations

import argparse
from dataclasses import dataclass, field, fields


@dataclass(frozen=True)
class Config:
    """Options that change how a suffix array is computed; none changes the result."""

    modulus: int = field(default=39, metadata={"help": "modulus X of the difference cover"})
    seed: int = field(default=0, metadata={"help": "seed of generated data and dealt chunks"})
    textsize: int = field(default=0, metadata={"help": "use only so many bytes of the input (0: all)"})
    base_case: int = field(default=10_000, metadata={"help": "texts up to this length are sorted on the driver"})
    discarding_threshold: float = field(default=0.7, metadata={"help": "recurse on reduced ranks up to this share of kept ones"})
    partitions: int = field(default=0, metadata={"help": "range partitions of sorts (0: spark.sql.shuffle.partitions)"})
    chunk: int = field(default=1 << 16, metadata={"help": "symbols in a chunk of text"})
    tie_group: int = field(default=10_000, metadata={"help": "larger groups of equal keys are ordered by counting, over many tasks"})
    buckets_samples: tuple[int, ...] = field(default=(), metadata={"help": "at each level, sort the samples in that many ranges one after the other"})
    buckets_merging: tuple[int, ...] = field(default=(), metadata={"help": "the same for all suffixes"})
    min_imbalance: float = field(default=0.25, metadata={"help": "rebalance when the smallest partition is at most this share of the mean"})
    check: bool = field(default=False, metadata={"help": "verify the suffix array"})

    def buckets_at(self, phase: str, level: int) -> int:
        """Ranges at a level of recursion; 1 beyond the levels given."""
        given = {"samples": self.buckets_samples, "merging": self.buckets_merging}[phase]
        return given[level] if level < len(given) else 1


#: Options of other engines of this kind that Spark decides itself; accepted by the command line without effect.
SPARK_DECIDES = (
    "num-samples-splitters buckets-phase3 samples-buckets-phase3 avg-chunks-pe pack-extra-words atomic-sorter ams-levels "
    "splitter-sampling splitter-sorting string-sorter memory-seq-string-sorter lcp-compression-threshold inital-prefix-length"
).split()
SPARK_DECIDES_FLAGS = (
    "use-random-sampling-splitters balance-blocks-space-efficient-sort use-randomized-chunks use-char-packing-samples use-char-packing-merging rearrange-buckets-balanced "
    "use-robust-tie-break use-compressed-buckets use-string-sort use-string-sort-tie-breaking-phase1 use-string-sort-tie-breaking-phase4 use-loser-tree "
    "use-rquick-for-splitters use-binary-search-for-splitters use-lcp-compression use-prefix-doubling"
).split()


def add_options(parser: argparse.ArgumentParser) -> argparse.ArgumentParser:
    for f in fields(Config):
        name, text = f"--{f.name.replace('_', '-')}", f.metadata["help"]
        if isinstance(f.default, tuple):
            also = {"buckets_samples": "--buckets-sample-phase", "buckets_merging": "--buckets-merging-phase"}[f.name]
            parser.add_argument(name, also, dest=f.name, type=lambda v: tuple(int(x) for x in v.split(",") if x), default=(), help=f"{text}, as 16,16; 1 by default")
        elif isinstance(f.default, bool):
            parser.add_argument(name, action="store_true", help=text)
        else:
            parser.add_argument(name, type=type(f.default), default=f.default, help=f"{text}; {f.default} by default")
    for name in SPARK_DECIDES:
        parser.add_argument(f"--{name}", help=argparse.SUPPRESS)
    for name in SPARK_DECIDES_FLAGS:
        parser.add_argument(f"--{name}", action="store_true", help=argparse.SUPPRESS)
    return parser


def parse_config(args: list[str], extras: bool = True) -> Config:
    """Configuration from arguments; unknown ones are ignored unless ``extras`` is false."""
    parser = add_options(argparse.ArgumentParser(add_help=False))
    found = parser.parse_known_args(args)[0] if extras else parser.parse_args(args)
    return Config(**{f.name: getattr(found, f.name) for f in fields(Config)})
