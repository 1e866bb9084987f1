"""String columns: common prefixes, comparison, distinguishing prefixes, and what front coding would save."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def lcp(a: Column, b: Column) -> Column:
    """Length of the longest common prefix of two strings or binaries; null if either is null."""
    most = F.least(F.length(a), F.length(b))
    # From the largest power of two that a length can have down, a step is taken if the parts that it would add are equal.
    steps = F.array(*[F.lit(1 << k) for k in range(30, -1, -1)])

    def step(at: Column, size: Column) -> Column:
        return F.when((most - at >= size) & (F.substring(a, at + 1, size) == F.substring(b, at + 1, size)), at + size).otherwise(at)

    return F.when(a.isNull() | b.isNull(), F.lit(None).cast("int")).otherwise(F.aggregate(steps, F.lit(0), step))


def lcp_scan(a: Column, b: Column) -> Column:
    """The same by a look at each position: the first at which they differ."""
    most = F.least(F.length(a), F.length(b))
    differs = F.filter(F.sequence(F.lit(1), F.greatest(most, F.lit(1))), lambda k: F.substring(a, k, F.lit(1)) != F.substring(b, k, F.lit(1)))
    return F.when(a.isNull() | b.isNull(), F.lit(None).cast("int")).when(most == 0, 0).otherwise(F.coalesce(F.array_min(differs) - 1, most))


def compare_from(a: Column, b: Column, known: Column) -> Column:
    """struct(order, lcp) of two strings whose first ``known`` characters are equal; only what follows is compared."""
    rest = lambda x: F.substring(x, known + 1, F.length(x))
    return F.struct(compare(rest(a), rest(b)).alias("order"), (known + lcp(rest(a), rest(b))).alias("lcp"))


def compare(a: Column, b: Column) -> Column:
    """-1, 0 or 1; a proper prefix is smaller."""
    return F.when(a < b, -1).when(a > b, 1).otherwise(0)


def first_at_least(values: list, key: Column) -> Column:
    """How many of the sorted ``values`` are below the key, by a look at each: the place of the first one at or above it."""
    return F.size(F.filter(F.array(*[F.lit(v) for v in values]), lambda v: v < key)) if values else F.lit(0)


def bisected(values: list, key: Column) -> Column:
    """The same by halving the range."""
    if not values:
        return F.lit(0)
    own, start = F.array(*[F.lit(v) for v in values]), F.struct(F.lit(0).alias("low"), F.lit(len(values)).alias("high"))

    def halve(s: Column, _: Column) -> Column:
        mid = F.floor((s.low + s.high) / 2).cast("int")
        below, open_ = F.get(own, mid) < key, s.low < s.high
        return F.struct(F.when(open_ & below, mid + 1).otherwise(s.low).alias("low"), F.when(open_ & ~below, mid).otherwise(s.high).alias("high"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(len(values).bit_length())), start, halve, lambda s: s.low)


def distinguishing_prefix(df: DataFrame, id_: str, text: str, initial: int = 4) -> DataFrame:
    """(id, prefix): for each string the smallest ``initial`` * 2^k up to its length whose prefix no other string has, else
    its length. Hashes stand for prefixes; a collision only makes a result longer. A string is its own prefix up
    to its length, so it makes longer strings' prefixes repeat. Each round keeps only the undecided. Ids are distinct.
    """
    from ..sources.shared import materialise

    own = df.where(F.col(text).isNotNull()).select(F.col(id_).alias("id"), F.col(text).alias("s"))
    left, out, size = None, None, initial
    while True:
        # The text stays where it is: a round reads it, and writes the undecided ones' ids, lengths and hashes.
        now = own if left is None else own.join(left, own.id.eqNullSafe(left.was), "left_semi")
        now = now.select("id", F.length("s").alias("length"), F.xxhash64(F.substring("s", 1, size)).alias("h"), F.xxhash64(F.lit(1), F.substring("s", 1, size)).alias("h2"))
        now = materialise(now)
        short = now.where(F.col("length") < size).select("id", F.col("length").alias("prefix"))
        # Strings that share a longer prefix share this one, so only those that repeat can matter to each other later.
        long = now.where(F.col("length") >= size)
        once = long.groupBy("h", "h2").agg(F.count("*").alias("c")).where("c = 1").select("h", "h2")
        found = short.unionByName(long.join(once, ["h", "h2"], "left_semi").select("id", F.lit(size).alias("prefix")))
        out = found if out is None else out.unionByName(found)
        left = materialise(long.join(once, ["h", "h2"], "left_anti").select(F.col("id").alias("was")))
        if left.isEmpty():
            return out
        size *= 2


def front_coding(df: DataFrame, index: str, text: str) -> DataFrame:
    """(strings, total_len, total_lcp, sent): what sending sorted strings without common prefixes saves: the lengths less
    the common prefixes, and one number a string. ``index`` numbers them from 0 in their order."""
    from ..operators.ranks import neighbour

    both = neighbour(df.select(index, text), index, text, -1, "before").withColumn("l", F.coalesce(lcp(F.col("before"), F.col(text)), F.lit(0)))
    sums = both.agg(F.count("*").alias("strings"), F.sum(F.length(text)).alias("total_len"), F.sum("l").cast("long").alias("total_lcp"))
    return sums.withColumn("sent", F.col("total_len") - F.col("total_lcp") + F.col("strings"))
