"""A training corpus from documents: quality, line dedup, near dedup, mixing, packing.

Each stage takes (spark, docs, sf_dir), where docs is all that the one before kept, with the columns of documents, and
returns those columns again; the last returns the pieces of packed sequences. Further columns of docs go through, whatever
their names.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from suffixspark.llm import line_dedup, minhash, mixing, packing, quality_fm
from suffixspark.llm.common import materialise, table, whole_text


COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def with_any_columns(stage: Stage) -> Stage:
    """The stage with further columns renamed while it runs, so that none meets a name of its own."""

    @wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        more = [c for c in docs.columns if c not in COLUMNS]
        apart = {c: f"further_column_{i}" for i, c in enumerate(more)}
        out = stage(spark, docs.toDF(*(apart.get(c, c) for c in docs.columns)), sf_dir)
        back = {v: k for k, v in apart.items()}
        return out.toDF(*(back.get(c, c) for c in out.columns))

    return run


@with_any_columns
def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on the labels outside its held-out fold, doesn't reject."""
    model = quality_fm.train(docs.select("doc_id", "text"), table(spark, sf_dir, "labels", "doc_id", "quality"))
    return quality_fm.score(docs, model).where("predicted = 1").select(*docs.columns)


@with_any_columns
def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the lines that an earlier document has; a text that loses none stays as it is, null included."""
    out = line_dedup.dedup_lines(docs).withColumn("text", F.when(F.col("n_dropped") > 0, F.col("kept")).otherwise(F.col("text")))
    return out.withColumn("n_chars", F.when(F.col("n_dropped") > 0, F.char_length("kept").cast("long")).otherwise(F.col("n_chars"))).select(*docs.columns)


@with_any_columns
def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: the one with the smallest doc_id, once."""
    names = docs.columns
    kept = materialise(minhash.near_duplicates(docs.select("doc_id", "text")).where("kept").select(F.col("doc_id").alias("_d"), F.col("body_hash").alias("_h")))
    own = docs.withColumn("_hash", F.xxhash64(whole_text()))
    out = own.join(kept, own.doc_id.eqNullSafe(kept._d) & (own._hash == kept._h), "left_semi")
    if not kept.groupBy("_d", "_h").count().where("count > 1").isEmpty():
        out = out.dropDuplicates(["doc_id", "_hash"])
    return out.select(*names)


@with_any_columns
def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    return mixing.mix(docs)


@with_any_columns
def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 1024 tokens."""
    return packing.pack_documents(docs)


STAGES = [("quality", keep_quality), ("line_dedup", drop_lines), ("near_dedup", drop_near_copies), ("mixing", mix_sources), ("packing", pack_sequences)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = materialise(docs)
    return docs
