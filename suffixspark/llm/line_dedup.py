"""Line deduplication against levelled sorted runs of line hashes.

The state is a set of runs: tables of (h1, h2, owner), bucketed and sorted by the 128-bit hash of a line's key, where owner
is the smallest doc_id that holds the line. Documents come in batches of ascending doc_id. A batch's distinct keys
are dealt into the same buckets once and merge-anti-join the runs as they lie on disk: a run is neither
exchanged nor sorted again. The keys that no run knows become a new run at level 0. When a level has
``fanout`` runs they are merged into one run of the next level. So each hash is rewritten once a level, and a
lookup reads few runs.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import register
from .common import materialise, shared_dir, with_keys

MIN_CHARS, BATCHES, FANOUT = 10, 4, 3
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_FIRST = -(2**63)


def line_key(line: Column) -> Column:
    """The line without white space (9-13, 32) at both ends, A-Z lower-cased."""
    return F.translate(F.btrim(line, F.lit(" \t\n\x0b\x0c\r")), _UPPER, _LOWER)


class LineRuns:
    """Levelled runs in the shared folder; each is a written table, so losing an executor loses nothing. ``release``
    deletes their files."""

    def __init__(self, spark: SparkSession, fanout: int = FANOUT):
        self.spark, self.fanout = spark, fanout
        self.buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.levels: list[list[str]] = []

    def runs(self) -> list[DataFrame]:
        """A hash is in one run only."""
        return [self.spark.table(name) for level in self.levels for name in level]

    def table(self, rows: DataFrame) -> str:
        """Write rows bucketed and sorted by hash, a file a bucket; the table's name."""
        name = f"line_run_{uuid.uuid4().hex}"
        path = register(self.spark, f"{shared_dir(self.spark)}/{name}")
        with _sorted_buckets(self.spark):
            dealt = rows.repartition(self.buckets, "h1", "h2")
            dealt.write.format("parquet").bucketBy(self.buckets, "h1", "h2").sortBy("h1", "h2").option("path", path).saveAsTable(name)
        return name

    def known(self, keys: DataFrame) -> DataFrame:
        """keys (h1, h2, ...), a row for each hash, with ``known``: its owner in the runs, null if it is in none."""
        for k, run in enumerate(self.runs()):
            keys = keys.join(run.withColumnRenamed("owner", f"known{k}"), ["h1", "h2"], "left")
        found = [c for c in keys.columns if c.startswith("known")]
        return keys.withColumn("known", F.coalesce(*found) if found else F.lit(None).cast("long")).drop(*found)

    def add(self, owners: DataFrame) -> None:
        """Add hashes (h1, h2, owner) that no run knows; then compact full levels."""
        level, name = 0, self.table(owners)
        while True:
            while len(self.levels) <= level:
                self.levels.append([])
            self.levels[level].append(name)
            if len(self.levels[level]) < self.fanout:
                return
            full, self.levels[level] = self.levels[level], []
            merged = self.spark.table(full[0])
            for other in full[1:]:
                merged = merged.unionByName(self.spark.table(other))
            level, name = level + 1, self.table(merged)


@contextmanager
def _sorted_buckets(spark: SparkSession) -> Iterator[None]:
    """Scans of bucketed tables say that they are sorted, for plans that are made in here."""
    name = "spark.sql.legacy.bucketedTableScan.outputOrdering"
    before = spark.conf.get(name)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def _batch(docs: DataFrame, runs: LineRuns, min_chars: int) -> DataFrame:
    hashes = F.struct(F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), "key").alias("h2"))
    text = F.coalesce("row.text", F.lit(""))
    lines = docs.select("doc_id", "body_hash", "owner", F.posexplode(F.split(text, "\n")).alias("i", "line")).withColumn("key", line_key(F.col("line")))
    # Written, as both the keys and the drops read them, and splitting the text is the dear part; they are a few numbers a line.
    lines = materialise(lines.where(F.char_length("key") >= min_chars).select("doc_id", "body_hash", "owner", "i", hashes.alias("h")).select("doc_id", "body_hash", "owner", "i", "h.*"))
    keys = lines.groupBy("h1", "h2").agg(F.min("owner").alias("owner"), F.max("owner").alias("last"), F.count("*").alias("n"))
    keys = runs.spark.table(runs.table(runs.known(keys)))
    runs.add(keys.where("known is null").select("h1", "h2", "owner"))
    # A key repeats if an earlier batch has it or two documents of this one do; hot ones are dealt out by salt.
    again = materialise(keys.where("known is not null or owner <> last").select("h1", "h2", "n", F.coalesce("known", "owner").alias("first")))
    drops = with_keys(lines, again, ("h1", "h2"), "n", ("doc_id", "i")).where("first <> owner").groupBy(F.col("doc_id").alias("d"), F.col("body_hash").alias("b")).agg(F.collect_set("i").alias("drops"))
    both = docs.join(drops, docs.doc_id.eqNullSafe(drops.d) & (docs.body_hash == drops.b), "left").drop("d", "b")
    # The split text is a column of its own: inside the lambda it would be split anew for each line.
    both = both.withColumn("lines", F.split(text, "\n"))
    kept = F.array_join(F.transform(F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.col("drops")), lambda i: F.get("lines", i)), "\n")
    none = F.col("drops").isNull()
    return both.select("row", F.size("lines").cast("long").alias("n_lines"), F.when(none, 0).otherwise(F.size("drops")).cast("long").alias("n_dropped"), F.when(none, text).otherwise(kept).alias("kept"))


def dedup_lines(docs: DataFrame, min_chars: int = MIN_CHARS, batches: int = BATCHES, runs: LineRuns | None = None) -> DataFrame:
    """``docs`` (doc_id, text, any other columns) with n_lines, n_dropped and kept (the text that stays).

    Lines whose key has at least ``min_chars`` code points and is in at least two documents stay only in the document
    of the smallest doc_id holding it (all its occurrences there). Null or empty text is one empty line; an empty
    table gives no rows. Rows of one doc_id are one document; a null doc_id is a document too, smaller than all
    others. Other columns stay, whatever their names, but for n_lines, n_dropped and kept, which are replaced. Batches are
    ranges of doc_id, so the smallest doc_id of a line is always met first.
    """
    spark = docs.sparkSession
    runs = runs or LineRuns(spark)
    bounds = sorted({int(b) for b in docs.where("doc_id is not null").stat.approxQuantile("doc_id", [k / batches for k in range(1, batches)], 0.01)}) if batches > 1 else []
    names = [c for c in docs.columns if c.lower() not in ("n_lines", "n_dropped", "kept")]
    out = None
    for low, high in zip([None, *bounds], [*bounds, None], strict=True):
        part = docs
        # The conditions are on doc_id itself, so that they reach the scan.
        if low is not None:
            part = part.where(F.col("doc_id") > low)
        if high is not None:
            part = part.where((F.col("doc_id") <= high) | (F.col("doc_id").isNull() if low is None else F.lit(False)))
        part = part.select(F.struct(*(F.col(f"`{c}`") for c in names)).alias("row"))
        own = part.select("row", F.col("row.doc_id").alias("doc_id"), F.coalesce("row.doc_id", F.lit(_FIRST)).alias("owner"), F.xxhash64(F.coalesce("row.text", F.lit(""))).alias("body_hash"))
        done = _batch(own, runs, min_chars)
        out = done if out is None else out.unionByName(done)
    return out.select(*(F.col(f"row.`{c}`").alias(c) for c in names), "n_lines", "n_dropped", "kept")
