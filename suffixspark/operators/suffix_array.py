"""Suffix arrays by the difference-cover method, as DataFrames.

1. Positions whose residue modulo X is in the cover are the sample; their X-symbol keys get dense ranks.
2. Unless all ranks differ, the ranks in the order (residue, position) are a shorter text, whose suffix array
   is found the same way; ranks that are unique, as their predecessors are, can be left out of it.
3. All positions are sorted by X-1 symbols. Where those tie, two suffixes compare by the sample ranks at the least
   distance at which both have one; the distance depends on their residues only.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..config import Config
from ..functions import stats
from ..functions.cover import Cover
from ..sources import text as texts
from ..sources.shared import materialise
from ..sources.text import Text
from .ranks import neighbour, ranked


def small_suffix_array(symbols: np.ndarray) -> np.ndarray:
    """Suffix array on one node, by doubling."""
    n, h = len(symbols), 1
    if n == 0:
        return np.zeros(0, np.int64)
    rank = np.unique(symbols, return_inverse=True)[1].astype(np.int64) + 1
    while True:
        after = np.zeros(n, np.int64)
        after[: max(0, n - h)] = rank[h:]
        order = np.lexsort((after, rank))
        change = (np.diff(rank[order]) != 0) | (np.diff(after[order]) != 0)
        rank = np.empty(n, np.int64)
        rank[order] = np.concatenate([[1], 1 + np.cumsum(change)])
        if rank[order[-1]] == n or h >= n:
            return order
        h *= 2


def suffixes_per_group(df: DataFrame, group: str, text: str) -> DataFrame:
    """(group, idx, pos): suffix arrays of many short texts, by code point; a null or empty text has no rows.

    Quadratic in a text's length, so for short ones.
    """
    own = df.where(F.length(text) > 0).select(group, text)
    each = own.select(group, F.explode(F.transform(F.sequence(F.lit(0), F.length(text) - 1), lambda p: F.struct(p.cast("long").alias("pos"), F.substring(text, p + 1, F.length(text)).alias("s")))).alias("x"))
    idx = F.row_number().over(Window.partitionBy(group).orderBy("x.s")).cast("long") - 1
    return each.select(group, idx.alias("idx"), F.col("x.pos").alias("pos"))


def suffix_arrays(df: DataFrame, group: str, text: str) -> DataFrame:
    """(group, idx, pos): the suffix array of each row's whole text, by code point; null and empty texts have no rows.

    A text is sorted in the task that holds it, in O(n log^2 n); for one text beyond that, see ``suffix_array``.
    """
    kind = df.schema[group].dataType.simpleString()

    def run(batches):
        for batch in batches:
            for key, own in zip(batch.column(0), batch.column(1), strict=True):
                order = small_suffix_array(np.frombuffer(own.as_py().encode("utf-32-le"), np.uint32))
                for a in range(0, len(order), 1 << 16):
                    part = order[a : a + (1 << 16)]
                    yield pa.RecordBatch.from_arrays([pa.array([key.as_py()] * len(part), batch.schema.field(0).type), pa.array(np.arange(a, a + len(part))), pa.array(part.astype(np.int64))], [group, "idx", "pos"])

    return df.where(F.length(text) > 0).select(group, text).mapInArrow(run, f"{group} {kind}, idx long, pos long")


def sample_positions(text: Text, cover: Cover) -> DataFrame:
    """(pos, key): the sample's positions with X symbols from each; an empty key at the end where the cover needs it."""
    inside = F.array(*[F.lit(r) for r in cover.residues])
    at = F.filter(F.sequence(F.lit(0), F.col("len") - 1), lambda i: F.array_contains(inside, F.pmod(F.col("start") + i, F.lit(cover.modulus)).cast("int")))
    out = text.chunks.select(F.explode(F.transform(at, lambda i: F.struct((F.col("start") + i).alias("pos"), text.key(i, cover.modulus).alias("key")))).alias("s")).select("s.*")
    if cover.needs_dummy(text.n):
        out = out.unionByName(text.chunks.sparkSession.createDataFrame([(text.n, bytearray())], "pos long, key binary"))
    return out


def reduced_index(cover: Cover, n: int, pos: Column) -> Column:
    """Place of a sample position in the order (residue, position)."""
    starts = cover.starts(n)
    first = F.element_at(F.create_map(*[F.lit(v).cast("int") for r in cover.residues for v in (r, starts[r])]), F.pmod(pos, F.lit(cover.modulus)).cast("int"))
    return (first + F.floor(pos / cover.modulus)).cast("long")


def position_of(cover: Cover, n: int, reduced: Column) -> Column:
    """The way back from such a place to the position."""
    starts = cover.starts(n)
    out = F.lit(None)
    for r in cover.residues:
        out = F.when(reduced >= starts[r], (reduced - starts[r]) * cover.modulus + r).otherwise(out)
    return out.cast("long")


def slot(cover: Cover, pos: Column) -> Column:
    """Number, among all samples by position, of the first one at or after a position."""
    before = F.array(*[F.lit(b) for b in cover.before])
    return (F.floor(pos / cover.modulus) * len(cover.residues) + F.get(before, F.pmod(pos, F.lit(cover.modulus)).cast("int"))).cast("long")


def with_kept(rows: DataFrame) -> DataFrame:
    """Rows (i, uniq, ...) with kept: not (unique after a unique one); the first is kept."""
    return neighbour(rows, "i", "uniq", -1, "prev").withColumn("kept", ~(F.col("uniq") & F.coalesce("prev", F.lit(False)))).drop("prev")


def _from_index(order: DataFrame, n: int, top: int, config: Config, level: int) -> DataFrame:
    """(i, rank from 1): inverse suffix array of the text of ``rank``s, up to ``top``, by ``i``."""
    text = texts.from_symbols(order.select(F.col("i").alias("pos"), F.col("rank").alias("chr")), n, config.chunk, config.modulus, top)
    return suffix_array(text, config, level + 1).select(F.col("pos").alias("i"), (F.col("idx") + 1).alias("rank"))


def sample_ranks(text: Text, cover: Cover, config: Config, level: int = 0) -> DataFrame:
    """(pos, rank): distinct ranks, from 1, of the sample's suffixes, the end's empty one included."""
    with stats.phase("sort_samples", level):
        named = ranked(sample_positions(text, cover), ["key"], ["pos"], ["pos"], partitions=config.partitions, buckets=config.buckets_at("samples", level))
    stats.count("samples", level, named.n)
    if named.names == named.n:
        return named.rows.select("pos", "rank")
    with stats.phase("reduce", level):
        rows = materialise(with_kept(named.rows.select("pos", "rank", "uniq", reduced_index(cover, text.n, F.col("pos")).alias("i"))))
        kept = rows.where("kept").count()
    stats.count("kept", level, kept)
    if kept > config.discarding_threshold * named.n:
        with stats.phase("recursion", level):
            new = _from_index(rows.select("i", "rank"), named.n, named.names, config, level)
            return materialise(rows.select("pos", "i").join(new, "i").select("pos", "rank"))
    with stats.phase("recursion", level):
        short = ranked(rows.where("kept"), ["i"], ["i", "rank"], partitions=config.partitions).rows.select("i", "rank", F.col("idx").alias("j"))
        new = _from_index(short.select(F.col("j").alias("i"), "rank"), kept, named.names, config, level).select(F.col("i").alias("j"), F.col("rank").alias("rank2"))
        new = short.select("i", "j").join(new, "j").select("i", "rank2")
    with stats.phase("sort_ranks", level):
        second = F.when(F.col("uniq"), F.lit(0)).otherwise(F.col("rank2"))
        both = rows.join(new, "i", "left").select("pos", "rank", second.cast("long").alias("rank2"))
        return ranked(both, ["rank", "rank2"], ["pos"], partitions=config.partitions).rows.select("pos", (F.col("idx") + 1).alias("rank"))


def _blocks(ranks: DataFrame, cover: Cover) -> DataFrame:
    """(q, ranks): the sample ranks of positions qX..qX+X-1 in order, 0 where there is no sample."""
    slot = F.pmod("pos", F.lit(cover.modulus)).cast("int")
    got = ranks.groupBy(F.floor(F.col("pos") / cover.modulus).cast("long").alias("q")).agg(F.map_from_entries(F.collect_list(F.struct(slot.alias("r"), "rank"))).alias("m"))
    return got.select("q", F.array(*[F.coalesce(F.element_at("m", F.lit(r)), F.lit(0)) for r in cover.residues]).alias("ranks"))


def next_ranks(rows: DataFrame, ranks: DataFrame, cover: Cover) -> DataFrame:
    """Rows with ``pos``, plus res (its residue) and next: the ranks of the first |cover| samples from it on."""
    blocks = materialise(_blocks(ranks, cover))
    rows = rows.withColumn("res", F.pmod("pos", F.lit(cover.modulus)).cast("int")).withColumn("q", F.floor(F.col("pos") / cover.modulus).cast("long"))
    both = rows.join(blocks, "q", "left").join(blocks.select((F.col("q") - 1).alias("q"), F.col("ranks").alias("more")), "q", "left")
    none = F.array(*[F.lit(0).cast("long")] * len(cover.residues))
    skip = F.element_at(F.array(*[F.lit(b) for b in cover.before]), F.col("res") + 1)
    every = F.concat(F.coalesce("ranks", none), F.coalesce("more", none))
    return both.withColumn("next", F.slice(every, skip + 1, len(cover.residues))).drop("q", "ranks", "more")


def _order_ties(tied: DataFrame, cover: Cover, config: Config) -> DataFrame:
    """(pos, idx) for rows (pos, res, next, first) of groups of equal keys, each with its first place."""
    x = cover.modulus
    turn = F.array(*[F.lit(t) for t in cover.turn])
    rank_of = lambda own, other: F.get(own.next, F.element_at(turn, own.res * x + other.res + 1))

    def compare(a: Column, b: Column) -> Column:
        p, q = rank_of(a, b), rank_of(b, a)
        return F.when(p < q, -1).when(p > q, 1).otherwise(0)

    # A hot group is counted before its rows meet: partial counts, then a join that AQE may split.
    sizes = materialise(tied.groupBy("first").agg(F.count("*").alias("m")))
    small = tied.join(sizes.where(F.col("m") <= config.tie_group), "first").groupBy("first").agg(F.collect_list(F.struct("pos", "res", "next")).alias("g"))
    small = small.select("first", F.posexplode(F.array_sort("g", compare)).alias("o", "s")).select(F.col("s.pos").alias("pos"), (F.col("first") + F.col("o")).alias("idx"))
    if sizes.where(F.col("m") > config.tie_group).isEmpty():
        return small
    # A large group: against each other residue, a suffix comes after those with a smaller rank at their common distance.
    large = tied.join(sizes.where(F.col("m") > config.tie_group), "first").withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(x - 1))))
    large = large.withColumn("at", F.get("next", F.element_at(turn, F.col("res") * x + F.col("other") + 1))).withColumn("lo", F.least("res", "other")).withColumn("hi", F.greatest("res", "other"))
    w = Window.partitionBy("first", "lo", "hi").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    own = (F.col("lo") == F.col("hi")).cast("int")
    # In a pair of residues, rows of the other one count; in a residue with itself all rows do.
    low, high = F.sum((F.col("res") == F.col("lo")).cast("long")).over(w), F.sum((F.col("res") == F.col("hi")).cast("long")).over(w)
    smaller = F.coalesce(F.when(own == 1, low).when(F.col("res") == F.col("lo"), high).otherwise(low), F.lit(0))
    large = large.withColumn("smaller", smaller).groupBy("pos", "first").agg(F.sum("smaller").alias("o")).select("pos", (F.col("first") + F.col("o")).alias("idx"))
    return small.unionByName(large)


def suffix_array(text: Text, config: Config = Config(), level: int = 0) -> DataFrame:
    """(idx, pos): the suffix array of a text, 0-based. A text whose halo is under the modulus is refused."""
    spark, cover = text.chunks.sparkSession, Cover.of(config.modulus)
    if text.halo < cover.modulus:
        raise ValueError(f"the halo has {text.halo} symbols, the modulus is {cover.modulus}")
    stats.count("text", level, text.n)
    if text.n <= max(config.base_case, 2 * cover.modulus):
        return _on_driver(spark, text)
    ranks = sample_ranks(text, cover, config, level)
    with stats.phase("merge", level):
        return merge_suffixes(text, ranks, cover, config, level)


def _on_driver(spark: SparkSession, text: Text) -> DataFrame:
    """Base case: base_case symbols at most go to the driver."""
    own = text.chunks.select("start", F.substring("body", F.lit(1), F.col("len") * text.width).alias("body")).orderBy("start").collect()
    raw = np.frombuffer(b"".join(bytes(r["body"]) for r in own), np.uint8).reshape(-1, text.width)
    symbols = np.zeros(len(raw), np.int64)
    for k in range(text.width):
        symbols = symbols * 256 + raw[:, k]
    order = small_suffix_array(symbols)
    return spark.createDataFrame([(i, int(p)) for i, p in enumerate(order)], "idx long, pos long")


def merge_suffixes(text: Text, ranks: DataFrame, cover: Cover, config: Config, level: int = 0) -> DataFrame:
    """(idx, pos) from the text and the ranks (pos, rank) of its sample.

    Keys are cut from the chunks in the stage that deals them out, and only numbers are written. Equal keys are dealt
    by position, so one giant group of them is many tasks' work.
    """
    keys = text.chunks.select(F.explode(F.transform(F.sequence(F.lit(0), F.col("len") - 1), lambda i: F.struct((F.col("start") + i).alias("pos"), text.key(i, cover.modulus - 1).alias("key")))).alias("s")).select("s.*")
    done = ranked(keys, ["key"], ["pos"], ["pos"], partitions=config.partitions, buckets=config.buckets_at("merging", level))
    single = done.rows.where("uniq").select(F.col("first").alias("idx"), "pos")
    if done.names == done.n:
        return single
    ties = _order_ties(materialise(next_ranks(done.rows.where("not uniq").select("pos", "first"), ranks, cover)), cover, config)
    return materialise(single.unionByName(ties.select("idx", "pos")))


def suffix_array_of_symbols(rows: DataFrame, config: Config = Config()) -> DataFrame:
    """(idx, pos) of a text of integers from 1, given as (pos, chr). Its alphabet is compressed first: keys are
    as many bytes a symbol as the number of different ones needs."""
    named = ranked(rows, ["chr"], ["pos", "chr"], ["pos"], partitions=config.partitions)
    codes = named.rows.select("pos", F.col("rank").alias("chr"))
    return suffix_array(texts.from_symbols(codes, named.n, config.chunk, Cover.of(config.modulus).modulus, named.names), config)


def suffix_array_by_doubling(rows: DataFrame, partitions: int = 0) -> DataFrame:
    """(idx, pos) of (pos, chr) by prefix doubling; another way to the same result, for cross-checks."""
    done, h = ranked(rows, ["chr"], ["pos"], ["pos"], partitions=partitions), 1
    while done.names < done.n:
        pairs = neighbour(done.rows.select("pos", "rank"), "pos", "rank", h, "after").withColumn("after", F.coalesce("after", F.lit(0)))
        done, h = ranked(pairs, ["rank", "after"], ["pos"], ["pos"], partitions=partitions), 2 * h
    ranks = done.rows
    return ranks.select((F.col("rank") - 1).alias("idx"), "pos")


def inverse(sa: DataFrame) -> DataFrame:
    """(pos, rank from 1)."""
    return sa.select("pos", (F.col("idx") + 1).alias("rank"))
