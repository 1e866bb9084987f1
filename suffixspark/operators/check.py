"""Verifiers. Each returns one row (ok boolean)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.strings import lcp
from .ranks import neighbour


def check_suffix_array(sa: DataFrame, chars: DataFrame) -> DataFrame:
    """Whether (idx, pos) is the suffix array of (pos, chr): as many rows, a permutation both ways, and
    (character, rank of the next suffix) strictly increasing; the end has rank -1, below all.

    Joins on position; no global order is made.
    """
    n = chars.agg(F.count("*").alias("n"))
    shape = sa.agg(F.count("*").alias("rows"), F.count_distinct("idx").alias("di"), F.count_distinct("pos").alias("dp"), F.min("idx").alias("i0"), F.max("idx").alias("i1"), F.min("pos").alias("p0"), F.max("pos").alias("p1"))
    good = (F.col("rows") == F.col("n")) & (F.col("di") == F.col("n")) & (F.col("dp") == F.col("n"))
    good &= (F.col("n") == 0) | ((F.col("i0") == 0) & (F.col("p0") == 0) & (F.col("i1") == F.col("n") - 1) & (F.col("p1") == F.col("n") - 1))
    shape = shape.crossJoin(n).select(good.alias("shape"))  # one row by one row
    keyed = neighbour(sa.join(chars, "pos"), "pos", "idx", 1, "follow").select("idx", F.struct("chr", F.coalesce("follow", F.lit(-1)).alias("follow")).alias("key"))
    order = neighbour(keyed, "idx", "key", 1, "after").agg(F.coalesce(F.bool_and(F.coalesce(F.col("key") < F.col("after"), F.lit(True))), F.lit(True)).alias("ordered"))
    return shape.crossJoin(order).select((F.col("shape") & F.col("ordered")).alias("ok"))


def check_sorted(df: DataFrame, index: str, value: str) -> DataFrame:
    """Whether values don't decrease along a 0-based index."""
    return neighbour(df.select(index, value), index, value, 1, "after").agg(F.coalesce(F.bool_and(F.coalesce(F.col(value) <= F.col("after"), F.lit(True))), F.lit(True)).alias("ok"))


def check_same(a: DataFrame, b: DataFrame, index: str, value: str) -> DataFrame:
    """Whether both have the same (index, value) rows."""
    both = a.select(index, F.col(value).alias("x"), F.lit(True).alias("l")).join(b.select(index, F.col(value).alias("y"), F.lit(True).alias("r")), index, "full")
    return both.agg(F.coalesce(F.bool_and(F.col("l").isNotNull() & F.col("r").isNotNull() & F.col("x").eqNullSafe(F.col("y"))), F.lit(True)).alias("ok"))


def check_same_multiset(a: DataFrame, b: DataFrame) -> DataFrame:
    """Whether both have the same rows, counted."""
    missing = a.exceptAll(b).limit(1).unionAll(b.exceptAll(a).limit(1))
    return missing.agg((F.count("*") == 0).alias("ok"))


def check_lcps(df: DataFrame, index: str, key: str, value: str, strict: bool = True) -> DataFrame:
    """Whether ``value`` is the longest common prefix with the key before (0 for the first), or a bound below it."""
    both = neighbour(df.select(index, key, value), index, key, -1, "before")
    true = F.coalesce(lcp(F.col("before"), F.col(key)), F.lit(0))
    return both.agg(F.coalesce(F.bool_and(F.col(value) == true if strict else F.col(value) <= true), F.lit(True)).alias("ok"))
