"""Shared helpers: reading tables, shared scratch tables, Arrow text buffers."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import materialise, shared_dir  # noqa: F401

#: Bytes of text that a vectorised kernel takes at a time.
CHUNK = 1 << 20
#: Keys with over one of HEAVY rows are dealt out by salt.
HEAVY = 4096


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """Columns of one input table, through Spark's own reader."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet").select(*columns)


def whole_text(column: str = "text"):
    """The text, empty for null."""
    return F.coalesce(F.col(column), F.lit(""))


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets (int64, from 0) and bytes of a string or binary array without nulls."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type):
        kind = np.int64
    else:
        kind = np.int32
    _, offsets, data = column.buffers()
    if not len(column):
        return np.zeros(1, np.int64), np.zeros(0, np.uint8)
    ends = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return ends - ends[0], data[ends[0] : ends[-1]]


def chunks(offsets: np.ndarray, size: int = CHUNK) -> Iterator[tuple[int, int]]:
    """Ranges of rows with up to ``size`` bytes, one row at least."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + size, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def as_int64(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64) if x.dtype == np.uint64 else x.astype(np.int64), pa.int64())


def with_keys(rows: DataFrame, keys: DataFrame, on: tuple[str, ...], weight: str, salt: tuple[str, ...] = ("doc_id", "start")) -> DataFrame:
    """Inner join of rows with keys: written, one row for each key, ``weight`` its number of rows.

    A key with over 1/HEAVY of all weight has its rows dealt, by hash of ``salt``, to as many salts as keep each under that
    share. There are under HEAVY such keys, whatever the input, so they are broadcast; and at most 2 * HEAVY salts.
    """
    share = (keys.agg(F.sum(weight)).first()[0] or 0) / HEAVY
    heavy = keys.where(F.col(weight) > share).where(F.col(weight) > HEAVY).select(*on, F.ceil(F.col(weight) / max(share, 1)).cast("int").alias("_salts"))
    dealt = rows.join(F.broadcast(heavy), [*on], "left").withColumn("_salt", F.coalesce(F.pmod(F.xxhash64(*salt), F.col("_salts")).cast("int"), F.lit(0))).drop("_salts")
    each = keys.join(F.broadcast(heavy), [*on], "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), F.coalesce("_salts", F.lit(1)) - 1))).drop("_salts")
    return dealt.join(each, [*on, "_salt"]).drop("_salt")
