"""Texts as tables of overlapping chunks.

A text is a DataFrame (start long, len int, body binary): ``len`` symbols from position ``start``, of a fixed number of
bytes each, followed in ``body`` by the next symbols of the text (the halo), as far as there are any. Symbols
are big-endian, so bytes order as symbols do, and a proper prefix comes first.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import materialise


LEAST_CHUNK = 1024


@dataclass(frozen=True)
class Text:
    """Chunks of n symbols of ``width`` bytes; ``chunk`` symbols each, ``halo`` more in the body."""

    chunks: DataFrame
    n: int
    width: int
    chunk: int
    halo: int

    def key(self, offset: Column, length: int) -> Column:
        """``length`` symbols from an offset in the chunk; fewer at the end of the text."""
        return F.substring(F.col("body"), (offset * self.width + 1).cast("int"), F.lit(length * self.width))


def _pieces(rows: DataFrame, chunk: int, halo: int, width: int) -> DataFrame:
    """(start, len, body) from pieces (at, size in symbols, piece binary) that tile the text."""
    first = F.greatest(F.lit(0), F.floor((F.col("at") - halo) / chunk)).cast("long")
    last = F.floor((F.col("at") + F.col("size") - 1) / chunk).cast("long")
    parts = rows.where("size > 0").select("at", "size", "piece", F.explode(F.sequence(first, last)).alias("k"))
    skip = F.greatest(F.lit(0), F.col("k") * chunk - F.col("at")).cast("int")
    end = F.least(F.col("size").cast("long"), F.col("k") * chunk + chunk + halo - F.col("at")).cast("int")
    cut = F.substring(F.col("piece"), skip * width + 1, (end - skip) * width)
    parts = parts.where(end > skip).select("k", F.struct((F.col("at") + skip).alias("at"), F.hex(cut).alias("hex")).alias("p"))
    body = F.unhex(F.array_join(F.transform(F.array_sort(F.collect_list("p")), lambda p: p.hex), ""))
    whole = parts.groupBy("k").agg(body.alias("body"))
    # A chunk that only begins after its own first symbols doesn't exist: pieces tile the text.
    return whole.select((F.col("k") * chunk).alias("start"), F.least(F.lit(chunk), (F.length("body") / width).cast("int")).alias("len"), "body")


def _finish(pieces: DataFrame, n: int, width: int, chunk: int, halo: int) -> Text:
    """Chunks are at most ``chunk`` long, and short enough to give every partition several: keys are many times the text."""
    tasks = int(pieces.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    chunk = max(min(chunk, LEAST_CHUNK), min(chunk, -(-n // (4 * tasks))))
    chunks = materialise(_pieces(pieces, chunk, halo, width))
    # A small text's files would be read by one task.
    return Text(chunks.repartition(tasks, "start"), n, width, chunk, halo)


def from_bytes(spark: SparkSession, data: bytes, chunk: int, halo: int) -> Text:
    """A text of bytes held by the driver."""
    rows = [(i, min(chunk, len(data) - i), bytearray(data[i : i + chunk])) for i in range(0, len(data), chunk)]
    return _finish(spark.createDataFrame(rows, "at long, size int, piece binary"), len(data), 1, chunk, halo)


def from_rows(df: DataFrame, order: str, text: str, separator: bytes, chunk: int, halo: int) -> Text:
    """The UTF-8 texts of a table in the order of a column, joined by a separator."""
    from ..operators.ranks import ranked

    size = F.length("b") + len(separator)
    rows = df.where(F.col(text).isNotNull()).select(F.col(order).alias("o"), F.col(text).cast("binary").alias("b")).withColumn("s", size)
    done = ranked(rows, ["o"], ["b"], add="s")
    # All rows but the first have the separator before them.
    later = F.col("idx") > 0
    pieces = done.rows.select(F.when(later, F.col("before") - len(separator)).otherwise(F.lit(0)).cast("long").alias("at"), F.when(later, F.concat(F.lit(separator), F.col("b"))).otherwise(F.col("b")).alias("piece"))
    n = max(0, done.total - len(separator))
    return _finish(pieces.withColumn("size", F.length("piece")), n, 1, chunk, halo)


def from_symbols(rows: DataFrame, n: int, chunk: int, halo: int, top: int | None = None) -> Text:
    """A text of non-negative integers, ``top`` the largest, from (pos, chr)."""
    if top is None:
        top = rows.agg(F.max("chr")).first()[0] or 0
    width = max(1, -(-int(top).bit_length() // 8))
    body = F.unhex(F.lpad(F.hex(F.col("chr").cast("long")), 2 * width, "0"))
    # Symbols are gathered chunk by chunk first, so that the pieces to join are long ones.
    own = rows.select((F.floor(F.col("pos") / chunk)).cast("long").alias("k"), F.struct("pos", F.hex(body).alias("h")).alias("p"))
    pieces = own.groupBy("k").agg(F.array_sort(F.collect_list("p")).alias("ps")).select((F.col("k") * chunk).alias("at"), F.size("ps").alias("size"), F.unhex(F.array_join(F.transform("ps", lambda p: p.h), "")).alias("piece"))
    return _finish(pieces, n, width, chunk, halo)


def read_bytes(spark: SparkSession, path: str, chunk: int, halo: int, textsize: int = 0) -> Text:
    """The bytes of a file, or of a folder's files in the order of their paths; with ``textsize`` the first so many."""
    files = spark.read.format("binaryFile").load(path).select("path", "length").orderBy("path").collect()
    if not files:
        raise FileNotFoundError(path)
    total, at, plan = textsize or sum(f["length"] for f in files), 0, []
    for f in files:
        if (size := min(f["length"], total - at)) > 0:
            plan.append((f["path"], at, size))
            at += size
    spans = spark.createDataFrame(plan, "path string, base long, take long")
    content = spark.read.format("binaryFile").load(path).select("path", "content")
    rows = content.join(spans, "path").select("base", F.explode(F.transform(F.sequence(F.lit(0), F.floor((F.col("take") - 1) / chunk).cast("int")), lambda i: F.struct((i * chunk).cast("long").alias("o"), F.substring("content", (i * chunk + 1).cast("int"), F.least(F.lit(chunk), F.col("take") - i * chunk).cast("int")).alias("piece")))).alias("s"))
    return _finish(rows.select((F.col("base") + F.col("s.o")).alias("at"), F.length("s.piece").alias("size"), F.col("s.piece").alias("piece")), at, 1, chunk, halo)


def exists(spark: SparkSession, path: str) -> bool:
    """Whether the path is there, in any file system that Spark reads."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return bool(target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target))


def random_symbols(spark: SparkSession, n: int, sigma: int, seed: int) -> DataFrame:
    """(pos, chr): independent uniform symbols of 1..sigma, the same for the same seed."""
    from ..operators.distribute import digits

    return spark.range(n).select(F.col("id").alias("pos"), (digits(F.col("id"), seed) % sigma + 1).cast("long").alias("chr"))


def characters(text: Text) -> DataFrame:
    """(pos, chr): each symbol as a number."""
    width = text.width
    each = F.transform(F.sequence(F.lit(0), F.col("len") - 1), lambda i: F.struct((F.col("start") + i).alias("pos"), F.conv(F.hex(F.substring("body", i * width + 1, F.lit(width))), 16, 10).cast("long").alias("chr")))
    return text.chunks.select(F.explode(each).alias("c")).select("c.*")
