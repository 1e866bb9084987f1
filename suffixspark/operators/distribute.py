"""Order-preserving redistribution: target partitions, bucket-major order, chunks, splitters and bucket numbers."""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ranks import row_index


def even_target(index: Column, n: int, parts: int) -> Column:
    """Part of a 0-based index: max(1, n div parts) rows each, the last part takes the rest."""
    return F.least(F.lit(parts - 1), F.floor(index / max(1, n // parts))).cast("int")


def even(df: DataFrame, index: str, parts: int, n: int | None = None) -> DataFrame:
    """Rows with their ``target`` part."""
    return df.withColumn("target", even_target(F.col(index), df.count() if n is None else n, parts))


def custom(df: DataFrame, index: str, sizes: list[int]) -> DataFrame:
    """Rows with the ``target`` part that gives the parts these sizes, in order."""
    ends = list(accumulate(sizes))
    target = F.lit(len(sizes) - 1)
    for part in range(len(sizes) - 2, -1, -1):
        target = F.when(F.col(index) < ends[part], F.lit(part)).otherwise(target)
    return df.withColumn("target", target.cast("int"))


def needs_rebalance(min_imbalance: float, threshold: float) -> bool:
    return min_imbalance <= threshold


def rebalance(df: DataFrame, index: str, parts: int, threshold: float, part: str = "part") -> tuple[DataFrame, bool]:
    """Rows of parts 0..parts-1 with their ``target`` part, and whether they move: if the smallest part has at most
    ``threshold`` of the mean, all are dealt evenly in the order of ``index``; else each stays."""
    sizes = {r[part]: r["count"] for r in df.groupBy(part).count().collect()}
    n = sum(sizes.values())
    moves = n > 0 and needs_rebalance(min(sizes.get(p, 0) for p in range(parts)) * parts / n, threshold)
    return (even(df, index, parts, n) if moves else df.withColumn("target", F.col(part).cast("int"))), moves


def rebalance_small(df: DataFrame, index: str, parts: int, part: str = "part") -> tuple[DataFrame, bool]:
    """The same if some part has as many rows as there are parts, or fewer."""
    sizes = {r[part]: r["count"] for r in df.groupBy(part).count().collect()}
    moves = min(sizes.get(p, 0) for p in range(parts)) <= parts
    return (even(df, index, parts, sum(sizes.values())) if moves else df.withColumn("target", F.col(part).cast("int"))), moves


def bucket_major(df: DataFrame, bucket: str, index: str, parts: int) -> DataFrame:
    """Rows numbered (``idx``) by (bucket, index), with targets that differ by one row at most, the first ones larger."""
    rows = row_index(df, [bucket, index], "idx")
    n = df.count()
    small, more = divmod(n, parts)
    edge = more * (small + 1)
    late = F.lit(more) + F.floor((F.col("idx") - edge) / max(1, small))
    return rows.withColumn("target", F.when(F.col("idx") < edge, F.floor(F.col("idx") / (small + 1))).otherwise(late).cast("int"))


def bucket_parts(sizes: list[int], parts: int) -> list[int]:
    """Parts for each bucket: the same number each; those left over go to the largest buckets, one each."""
    if len(sizes) > parts:
        raise ValueError("more buckets than parts")
    each, more = divmod(parts, len(sizes))
    largest = set(sorted(range(len(sizes)), key=lambda b: (-sizes[b], b))[:more])
    return [each + (b in largest) for b in range(len(sizes))]


def bucket_groups(df: DataFrame, bucket: str, index: str, parts: int) -> DataFrame:
    """Rows numbered (``idx``) by (bucket, index), with targets: each bucket has parts of its own, and fills them evenly."""
    rows = row_index(df, [bucket, index], "idx")
    sizes = {r[bucket]: r["count"] for r in df.groupBy(bucket).count().collect()}
    names = sorted(sizes)
    shares = bucket_parts([sizes[b] for b in names], parts)
    ends, firsts = list(accumulate(sizes[b] for b in names)), [0, *accumulate(shares)]
    target = F.lit(None)
    for k in range(len(names) - 1, -1, -1):
        own = even_target(F.col("idx") - (ends[k] - sizes[names[k]]), sizes[names[k]], shares[k]) + firsts[k]
        target = F.when(F.col("idx") < ends[k], own).otherwise(target)
    return rows.withColumn("target", target.cast("int"))


def by_buckets(df: DataFrame, bucket: str, index: str, parts: int, balanced: bool = True) -> DataFrame:
    """Bucket-major order over equal parts, or with parts of its own for each bucket."""
    return (bucket_major if balanced else bucket_groups)(df, bucket, index, parts)


def place(df: DataFrame, target: str, parts: int) -> DataFrame:
    """Deal the rows out by target part; a shuffle."""
    return df.repartition(parts, target)


def chunk_rows(n: int, chunk: int, spark) -> DataFrame:
    """(chunk_id, start, size) of a sequence of n."""
    return spark.range(-(-n // chunk)).select(F.col("id").alias("chunk_id"), (F.col("id") * chunk).alias("start"), F.least(F.lit(chunk), F.lit(n) - F.col("id") * chunk).cast("int").alias("size"))


def chunk_targets(chunks: DataFrame, parts: int, seed: int = 0) -> DataFrame:
    """Chunks with a random, repeatable ``target`` part."""
    return chunks.withColumn("target", (digits(F.col("chunk_id"), seed) % parts).cast("int"))


def send_counts(chunks: DataFrame) -> DataFrame:
    return chunks.groupBy("target").agg(F.sum("size").alias("n"))


def uniform_splitters(df: DataFrame, key: str, buckets: int) -> list:
    """Every (n / buckets)-th key in order: buckets - 1 of them."""
    rows = row_index(df.select(key), [key], "i")
    n = df.count()
    at = [n * b // buckets for b in range(1, buckets)]
    return [r[key] for r in rows.where(F.col("i").isin(at)).orderBy("i").collect()]


def digits(value: Column, seed: int) -> Column:
    """A repeatable random number below 2^28 for each value and seed, from a digest of both as text."""
    return F.conv(F.substring(F.md5(F.concat_ws("_", F.lit(str(seed)), value.cast("string")).cast("binary")), 1, 7), 16, 10).cast("long")


def random_splitters(df: DataFrame, key: str, buckets: int, samples: int, seed: int = 0) -> list:
    """Splitters from a repeatable random sample of ``samples`` keys, those of the smallest digests, which goes to the
    driver; equal keys are drawn together, and the smallest ones stand for them."""
    random = digits(F.hex(key) if dict(df.dtypes)[key] == "binary" else F.col(key), seed)
    found = sorted(r[key] for r in df.select(key, random.alias("_r")).where(F.col(key).isNotNull()).orderBy("_r", key).limit(samples).collect())
    return [found[len(found) * b // buckets] for b in range(1, buckets)] if found else []


def splitters(df: DataFrame, key: str, buckets: int, random: bool = False, samples: int = 1000, seed: int = 0) -> list:
    """buckets - 1 splitters, uniform or of a random sample."""
    return random_splitters(df, key, buckets, samples, seed) if random else uniform_splitters(df, key, buckets)


def record_splitters(df: DataFrame, order: list[str], buckets: int, samples: int, seed: int = 0) -> list[tuple]:
    """The same for records that compare by several columns, one after the other."""
    random = digits(F.concat_ws("_", *[F.col(c).cast("string") for c in order]), seed)
    found = sorted(tuple(r[c] for c in order) for r in df.select(*order, random.alias("_r")).orderBy("_r", *order).limit(samples).collect())
    return [found[len(found) * b // buckets] for b in range(1, buckets)] if found else []


def bucket_of_record(order: list[str], cuts: list[tuple]) -> Column:
    """Number of record splitters at or below the row."""
    row, total = F.struct(*order), F.lit(0)
    for c in cuts:
        total = total + F.when(F.struct(*[F.lit(v).alias(n) for n, v in zip(order, c, strict=True)]) <= row, 1).otherwise(0)
    return total


def bucket_of(key: Column, splitters: list) -> Column:
    """Number of splitters at or below the key."""
    return F.size(F.filter(F.array(*[F.lit(s) for s in splitters]), lambda s: s <= key)) if splitters else F.lit(0)


def interval_sizes(df: DataFrame, key: str, splitters: list) -> DataFrame:
    """(bucket, size)."""
    return df.groupBy(bucket_of(F.col(key), splitters).alias("bucket")).agg(F.count("*").alias("size"))


def merge_sorted(frames: list[DataFrame], order: list[str]) -> DataFrame:
    """One sorted sequence of several: a union in one range exchange."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return row_index(out, order, "idx")


def with_ties(df: DataFrame, key: str) -> DataFrame:
    """Rows with ``m``, the number of rows of their key; a join with counts, so no task holds a key's rows."""
    counts = df.groupBy(F.col(key).alias("_key")).agg(F.count("*").alias("m"))
    return df.join(counts, F.col(key).eqNullSafe(F.col("_key"))).drop("_key")
