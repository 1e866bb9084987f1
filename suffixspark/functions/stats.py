"""Imbalance and size statistics."""

from __future__ import annotations

import resource
import time
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def sizes(df: DataFrame, part: str) -> DataFrame:
    return df.groupBy(part).agg(F.count("*").alias("size"))


def imbalance(per_part: DataFrame, size: str = "size") -> DataFrame:
    """(min_size, max_size, avg_size, max_imbalance: max / avg - 1, min_imbalance: min / avg, 1 if all are empty)."""
    low, high, mean = F.min(size), F.max(size), F.avg(size)
    return per_part.agg(low.alias("min_size"), high.alias("max_size"), mean.alias("avg_size"), F.when(mean > 0, high / mean - 1).otherwise(0.0).alias("max_imbalance"), F.when(mean > 0, low / mean).otherwise(1.0).alias("min_imbalance"))


def bucket_imbalance(per_bucket: DataFrame, buckets: int, size: str = "size") -> DataFrame:
    """(bucket_imbalance): the largest bucket by the size expected of ``buckets`` equal ones, less 1."""
    return per_bucket.agg((F.max(size) / (F.sum(size) / F.lit(buckets)) - 1).alias("bucket_imbalance"))


def summary(df: DataFrame, value: str) -> DataFrame:
    return df.agg(F.min(value).alias("min_value"), F.max(value).alias("max_value"), F.avg(value).alias("avg_value"), F.sum(value).alias("sum_value"))


def peak_memory_kb() -> int:
    """Largest resident set of the driver's Python, in kB."""
    return resource.getrusage(resource.RUSAGE_SELF).ru_maxrss


@dataclass
class Statistics:
    """Seconds and sizes of a run by phase and recursion level, and the largest resident set after each phase."""

    times: dict[tuple[str, int], float] = field(default_factory=dict)
    counts: dict[tuple[str, int], int] = field(default_factory=dict)
    memory: list[tuple[str, int, int]] = field(default_factory=list)

    def lines(self, prefix: str = "root") -> list[str]:
        """As a log: ``root.phase_level=seconds`` and ``[count_level=size]``."""
        return [f"{prefix}.{p}_{level}={v:.6f}" for (p, level), v in self.times.items()] + [f"[{c}_{level}={v}]" for (c, level), v in self.counts.items()]

    def records(self) -> list[tuple[str, int, float]]:
        """(phase, level, seconds)."""
        return [(p, level, v) for (p, level), v in self.times.items()]

    def peak_kb(self) -> int:
        return max((kb for *_, kb in self.memory), default=0)


#: Of the run that is going on in this driver.
current = Statistics()


def restart() -> Statistics:
    global current
    current = Statistics()
    return current


@contextmanager
def phase(name: str, level: int) -> Iterator[None]:
    """Adds the time of its body, the phases of deeper levels in it included."""
    begun = time.perf_counter()
    try:
        yield
    finally:
        current.times[name, level] = current.times.get((name, level), 0.0) + time.perf_counter() - begun
        current.memory.append((name, level, peak_memory_kb()))


def count(name: str, level: int, value: int) -> None:
    current.counts[name, level] = value


def blow_up(peak_kb: int, text_bytes: int) -> float:
    """Memory by size of the text."""
    return peak_kb * 1024 / max(1, text_bytes)


def session_flags(spark) -> dict[str, str]:
    """What a run depends on: version, master, and the settings of SQL and executors."""
    names = ("spark.sql.shuffle.partitions", "spark.sql.adaptive.enabled", "spark.executor.memory", "spark.executor.cores", "spark.driver.memory", "spark.checkpoint.dir")
    return {"version": spark.version, "master": spark.sparkContext.master, **{n: str(spark.conf.get(n, None)) for n in names}}
