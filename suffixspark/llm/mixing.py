"""Mixing sources to target weights by pivotal dependent rounding.

Each document of a source has the same expected number of copies (its source's target by its source's size). The
whole part is taken as it is; the fraction is a copy probability. Two fractional documents are paired and words of
probability mass move from one to the other, at random and fairly, until one of them becomes integral; so the
mass of a source, in words, never changes. Each bucket of documents ends with one fractional document a source at
most; those residuals pair up again in a tree over buckets. The last one of a source keeps its share: it takes
that many of its words.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.ranks import row_index
from .common import materialise, whole_text

WEIGHTS, SHARE, CAP, SEED, BUCKET_ROWS, FAN_IN, NODE_SOURCES = (5.0, 2.0, 1.0), 1.5, 2.0, 20, 100_000, 16, 10_000
#: Copies of one row that are numbered at a time.
_COPIES = 1 << 16
_WORDS = r"[^\x20\x09-\x0D]+"
_SPACED_WORDS = r"[\x20\x09-\x0D]*" + _WORDS


def n_words(column: str = "text"):
    """Words of a text, 0 for null."""
    return F.coalesce(F.regexp_count(F.col(column), F.lit(_WORDS)), F.lit(0)).cast("long")


def source_targets(rows: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """(source, source_id, source_size, target, rate) of rows (source, size), a row for each source.

    Sources by code point, null last, weigh ``weights``, repeated. Each has its weight times one level, but ``cap``
    times its size at most; the level rises until the targets sum up to ``share`` of all sizes. A round of that is one
    aggregate over the sources, and caps those that the level has reached; any number of sources will do.
    """
    per = rows.groupBy("source").agg(F.coalesce(F.sum("size"), F.lit(0)).alias("source_size")).withColumn("last", F.col("source").isNull())
    per = materialise(row_index(per, ["last", "source"], "source_id").drop("last").withColumn("w", F.get(F.array(*map(F.lit, weights)), (F.col("source_id") % len(weights)).cast("int"))))
    top = cap * F.col("source_size")
    total, open_ = per.agg(F.coalesce(F.sum("source_size"), F.lit(0)), F.coalesce(F.sum(F.when(F.col("source_size") > 0, F.col("w"))), F.lit(0.0))).first()
    level, capped = share * total / open_ if open_ else 0.0, 0
    while open_:
        full = F.col("w") * level >= top
        row = per.where("source_size > 0").agg(F.sum(F.when(full, top)).alias("fixed"), F.sum(F.when(~full, F.col("w"))).alias("open"), F.count(F.when(full, 1)).alias("capped")).first()
        if row["capped"] == capped or not row["open"]:
            break
        level, capped = (share * total - row["fixed"]) / row["open"], row["capped"]
    target = F.when(F.col("source_size") > 0, F.least(F.col("w") * level, top)).otherwise(F.lit(0.0))
    return per.withColumn("target", target).withColumn("rate", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))).drop("w")


def pivot(size: list[int], p: list[float], rng: np.random.Generator) -> tuple[list[float], int | None]:
    """Round the probabilities p of documents of the given sizes, in order; also the index still fractional."""
    out, carry = list(p), None
    coins = rng.random(len(out)).tolist()
    for i, coin in enumerate(coins):
        if not 0 < out[i] < 1:
            continue
        if carry is None:
            carry = i
            continue
        s, t = size[carry], size[i]
        to_carry = min((1 - out[carry]) * s, out[i] * t)
        to_i = min(out[carry] * s, (1 - out[i]) * t)
        moved = to_carry if coin * (to_carry + to_i) < to_i else -to_i
        out[carry] += moved / s
        out[i] -= moved / t
        for k in (carry, i):
            if out[k] < 1e-9:
                out[k] = 0.0
            elif out[k] > 1 - 1e-9:
                out[k] = 1.0
        left = [k for k in (carry, i) if 0 < out[k] < 1]
        carry = left[0] if left else None
        if len(left) == 2:  # rounding in floating point left both open
            out[i] = float(round(out[i]))
    return out, carry


def _level(level: int):
    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["source_id", "rid", "copy", "size"], kind="stable").reset_index(drop=True)
        rows["node"] = rows["node"] // FAN_IN if level else rows["node"]
        for source, own in rows.groupby("source_id", sort=True):
            rng = np.random.Generator(np.random.PCG64([SEED, level, int(key[0]), int(source)]))
            p, carry = pivot(own["size"].tolist(), own["p"].tolist(), rng)
            rows.loc[own.index, "p"] = p
        return rows

    return run


def copies(docs: DataFrame) -> DataFrame:
    """doc_id, body_hash, source, size, source_size, target, taken for each row of ``docs`` (doc_id, text, source).

    Null text has size 0 and takes 0, a null source is a source of its own (the last); repeated rows are rounded each
    on its own; other columns are ignored; an empty table gives no rows. Reruns agree: order and random numbers
    come from hashes of doc_id and text, and equal rows are counted first and then dealt out by number. Any number of sources.
    """
    rows = materialise(docs.select("doc_id", "source", n_words().alias("size"), F.xxhash64(whole_text()).alias("body_hash")))
    goals = materialise(source_targets(rows).withColumnRenamed("source", "s"))
    n, sources = rows.count(), goals.count()
    buckets = max(1, -(-n // BUCKET_ROWS))
    units = rows.groupBy("doc_id", "body_hash", "source", "size").agg(F.count("*").alias("m"))
    units = units.join(goals, units.source.eqNullSafe(goals.s)).drop("s")
    part = F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("m") - 1) / _COPIES)))
    one = F.explode(F.sequence(F.col("part") * _COPIES, F.least(F.col("m"), (F.col("part") + 1) * _COPIES) - 1))
    units = units.withColumn("part", part).withColumn("copy", one)
    whole = F.when(F.abs(F.col("rate") - F.round("rate")) < 1e-12, F.round("rate")).otherwise(F.floor("rate"))
    units = units.withColumn("whole", whole.cast("int")).withColumn("p", F.when(F.col("size") > 0, F.greatest(F.lit(0.0), F.col("rate") - F.col("whole"))).otherwise(F.lit(0.0)))
    units = units.withColumn("rid", F.xxhash64("doc_id", "body_hash")).withColumn("node", F.pmod(F.xxhash64("rid", "copy"), F.lit(buckets)).cast("long"))
    columns = ["doc_id", "body_hash", "source", "size", "source_size", "target", "whole", "source_id", "rid", "copy", "node", "p"]
    schema = units.select(*columns).schema
    done = materialise(units.select(*columns).groupBy("node").applyInPandas(_level(0), schema))
    settled, open_, level = [done.where("p = 0 or p = 1")], done.where("p > 0 and p < 1"), 1
    # Above the buckets a node has a row for each source and branch, so it is split by source.
    split = F.pmod("source_id", F.lit(-(-max(1, sources) // NODE_SOURCES)))
    while buckets > 1:
        step = materialise(open_.groupBy((F.col("node") / FAN_IN).cast("long"), split).applyInPandas(_level(level), schema))
        settled.append(step.where("p = 0 or p = 1"))
        open_, level, buckets = step.where("p > 0 and p < 1"), level + 1, -(-buckets // FAN_IN)
    out = open_
    for part in settled:
        out = out.unionByName(part)
    return out.select("doc_id", "body_hash", "source", "size", "source_size", "target", (F.col("whole") * F.col("size") + F.round(F.col("p") * F.col("size"))).cast("long").alias("taken"))


def mix(docs: DataFrame) -> DataFrame:
    """The mixed documents, with the columns of ``docs``, whatever their names: each as often as it is taken, a share cut after its
    last word, with the white space before that as it is.

    Rows equal in doc_id, text and source are taken together. n_chars, where there is one, follows a cut text.
    """
    names = docs.columns
    taken = copies(docs).groupBy("doc_id", "body_hash", "source").agg(F.sum("taken").alias("taken"), F.max("size").alias("size")).where("taken > 0")
    taken = taken.select(F.col("doc_id").alias("d"), F.col("body_hash").alias("b"), F.col("source").alias("s"), "taken", "size")
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in names)).alias("row")).withColumn("hash", F.xxhash64(F.coalesce("row.text", F.lit(""))))
    own = rows.withColumn("doc", F.col("row.doc_id")).withColumn("src", F.col("row.source")).dropDuplicates(["doc", "hash", "src"])
    both = own.join(taken, own.doc.eqNullSafe(taken.d) & (own.hash == taken.b) & own.src.eqNullSafe(taken.s))
    full, rest = F.floor(F.col("taken") / F.col("size")).cast("int"), (F.col("taken") % F.col("size")).cast("int")
    each = F.concat(F.array_repeat(F.lit(True), full), F.when(rest > 0, F.array(F.lit(False))).otherwise(F.array().cast("array<boolean>")))
    out = both.select("row", rest.alias("rest"), F.explode(each).alias("whole"))
    part = F.array_join(F.slice(F.regexp_extract_all(F.col("row.text"), F.lit(_SPACED_WORDS), F.lit(0)), 1, F.col("rest")), "")
    out = out.withColumn("body", F.when(F.col("whole"), F.col("row.text")).otherwise(part))
    fresh = {"text": F.col("body"), "n_chars": F.when(F.col("whole"), F.col("row.n_chars")).otherwise(F.char_length("body").cast("long")) if "n_chars" in names else None}
    return out.select(*((fresh[c] if c in fresh else F.col(f"row.`{c}`")).alias(c) for c in names))
