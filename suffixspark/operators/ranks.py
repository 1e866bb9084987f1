"""Ranks, row numbers, prefix sums and neighbours over globally ordered rows, without a single-task window.

Rows are range-partitioned and sorted once. The stage that sorts them numbers them too, and writes the numbers
without the keys. What a partition starts and ends with goes to the driver, a row for each partition, to shift
the numbers; so equal keys may lie in several partitions, and one giant group of them is sorted by many tasks.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, IntegerType, LongType, StructField, StructType

from ..sources.shared import materialise

PART, EDGE = "_part", "_edge"
_NUMBERS = ("idx", "first", "rank", "uniq", "before")


@dataclass(frozen=True)
class Ranked:
    """Numbered rows: the kept columns, then idx (row number from 0), first (that of its key's first row), rank (of its key,
    from 1, without gaps), uniq (no other row has its key) and before (the sum over all rows before it)."""

    rows: DataFrame
    n: int
    names: int
    total: int


def _same(column: pa.Array) -> np.ndarray:
    """For each value but the first, whether it equals the one before; nulls and NaNs equal themselves."""
    if pa.types.is_struct(column.type):
        return np.logical_and.reduce([_same(c) for c in column.flatten()])
    a, b = column[:-1], column[1:]
    same = pc.or_(pc.fill_null(pc.equal(a, b), False), pc.and_(a.is_null(), b.is_null()))
    if pa.types.is_floating(column.type):
        same = pc.or_(same, pc.fill_null(pc.and_(pc.is_nan(a), pc.is_nan(b)), False))
    return same.to_numpy(zero_copy_only=False)


def _number(key: list[str], keep: list[str], add: str | None, schema: pa.Schema):
    """Sorted rows of a partition, numbered, and at last one row that says what the partition starts and ends with."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        rows = names = first = total = 0
        low = high = held = None

        def out(kept: list[pa.Array], numbers: list[np.ndarray], uniq: np.ndarray) -> pa.RecordBatch:
            idx, start, rank, before = numbers
            m = len(idx)
            columns = [*kept, pa.array(np.full(m, part, np.int32)), pa.array(idx), pa.array(start), pa.array(rank), pa.array(uniq), pa.array(before), pa.nulls(m, schema.field(EDGE).type)]
            return pa.RecordBatch.from_arrays([c if c.type == f.type else c.cast(f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            keys = [batch.column(k) for k in key]
            with_last = keys if high is None else [pa.concat_arrays([h, k]) for h, k in zip(high, keys, strict=True)]
            new = ~np.logical_and.reduce([_same(c) for c in with_last])
            if high is None:
                new, low = np.concatenate([[True], new]), [k.slice(0, 1) for k in keys]
            high = [k.slice(n - 1, 1) for k in keys]
            idx = rows + np.arange(n)
            start = np.where(new, idx, -1)
            start[0] = max(start[0], first)
            start, rank = np.maximum.accumulate(start), names + np.cumsum(new)
            values = pc.fill_null(batch.column(add), 0).to_numpy(zero_copy_only=False).astype(np.int64) if add else np.zeros(n, np.int64)
            before = total + np.cumsum(values) - values
            rows, first, names, total = rows + n, int(start[-1]), int(rank[-1]), total + int(values.sum())
            kept, numbers = [batch.column(c) for c in keep], [idx, start, rank, before]
            # The last row waits for the next one, which tells whether its key goes on.
            if held:
                yield out(held[0], held[1], np.array([held[2] and new[0]]))
            if n > 1:
                yield out([c.slice(0, n - 1) for c in kept], [x[:-1] for x in numbers], new[:-1] & new[1:])
            held = [c.slice(n - 1, 1) for c in kept], [x[-1:] for x in numbers], bool(new[-1])
        if held:
            yield out(held[0], held[1], np.array([held[2]]))
            kind = schema.field(EDGE).type
            ends = [pa.StructArray.from_arrays([c.cast(f.type) for c, f in zip(x, kind.field(i).type, strict=True)], fields=list(kind.field(i).type)) for i, x in enumerate((low, high))]
            edge = pa.StructArray.from_arrays([*ends, *(pa.array([v], pa.int64()) for v in (rows, names, total, first))], fields=list(kind))
            yield pa.RecordBatch.from_arrays([*(pa.nulls(1, f.type) for f in list(schema)[: len(keep)]), pa.array([part], pa.int32()), *(pa.nulls(1, schema.field(c).type) for c in _NUMBERS), edge], schema=schema)

    return run


def ranked(df: DataFrame, key: list[str], keep: list[str], then: tuple[str, ...] | list[str] = (), add: str | None = None, partitions: int = 0, buckets: int = 1) -> Ranked:
    """Rows in the order of ``key`` and, within it, of ``then``, numbered; ``add`` is summed up. One shuffle, one sort, and one
    write of the kept columns and the numbers; with ``buckets``, one after the other for that many ranges of the first key, so
    that only a bucket's rows are shuffled and sorted at a time, with their keys."""
    if buckets > 1:
        return _by_buckets(df, key, keep, then, add, partitions, buckets)
    from pyspark.sql.pandas.types import to_arrow_schema

    spark = df.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    fields = [StructField(f"_c{i}", f.dataType) for i, f in enumerate(df.select(*keep).schema)]
    keys = StructType([StructField(f"k{i}", f.dataType) for i, f in enumerate(df.select(*key).schema)])
    numbers = [StructField(c, BooleanType() if c == "uniq" else LongType()) for c in _NUMBERS]
    edge = StructType([StructField("low", keys), StructField("high", keys), *(StructField(c, LongType()) for c in ("rows", "names", "total", "tail"))])
    schema = StructType([*fields, StructField(PART, IntegerType()), *numbers, StructField(EDGE, edge)])
    schema = StructType.fromJson(json.loads(schema.json().replace('"nullable":false', '"nullable":true')))
    needed = dict.fromkeys([*key, *then, *keep, *([add] if add else [])])
    dealt = df.select(*needed).repartitionByRange(n, *key, *then).sortWithinPartitions(*key, *then)
    done = materialise(dealt.mapInArrow(_number(key, keep, add, to_arrow_schema(schema)), schema))
    ends = {r[PART]: r[EDGE] for r in done.where(F.col(EDGE).isNotNull()).select(PART, EDGE).collect()}
    size = max(ends, default=-1) + 1
    rows, names, total, tops, head = ([0] * size for _ in range(5))
    joins, goes_on = [False] * size, [False] * size
    at = name = summed = group = 0
    last = None
    for p in sorted(ends):
        e = ends[p]
        if last is not None and (ends[last]["high"] == e["low"] or repr(ends[last]["high"]) == repr(e["low"])):
            joins[p] = goes_on[last] = True
            name -= 1
        else:
            group = at
        rows[p], names[p], total[p], tops[p], head[p] = at, name, summed, e["names"], group
        if e["names"] > 1:
            group = at + e["tail"]
        at, name, summed, last = at + e["rows"], name + e["names"], summed + e["total"], p
    of = lambda values, kind="long": F.get(F.array(*[F.lit(v).cast(kind) for v in values]), F.col(PART))
    own = done.where(F.col(EDGE).isNull())
    kept = [F.col(f.name).alias(c) for f, c in zip(fields, keep, strict=True)]
    if ends:
        in_head, in_tail = F.col("rank") == 1, F.col("rank") == of(tops)
        uniq = F.col("uniq") & ~(in_head & of(joins, "boolean")) & ~(in_tail & of(goes_on, "boolean"))
        start = F.when(in_head, of(head)).otherwise(of(rows) + F.col("first"))
        values = {"idx": of(rows) + F.col("idx"), "first": start, "rank": of(names) + F.col("rank"), "uniq": uniq, "before": of(total) + F.col("before")}
    else:
        values = {c: F.col(c) for c in _NUMBERS}
    own = own.select(*kept, *(v.alias(c) for c, v in values.items() if c not in keep))
    return Ranked(own, at, name, summed)


def _by_buckets(df: DataFrame, key: list[str], keep: list[str], then: list[str], add: str | None, partitions: int, buckets: int) -> Ranked:
    from .distribute import random_splitters

    cuts = sorted({c if not isinstance(c, bytearray) else bytes(c): None for c in random_splitters(df, key[0], buckets, 64 * buckets) if c is not None})
    own, out, n, names, total = F.col(key[0]), None, 0, 0, 0
    for low, high in zip([None, *cuts], [*cuts, None], strict=True):
        inside = F.lit(True) if high is None else (own < F.lit(high)) | (own.isNull() if low is None else F.lit(False))
        inside = inside & (F.lit(True) if low is None else own >= F.lit(low))
        part = ranked(df.where(inside), key, keep, then, add, partitions)
        base = {"idx": n, "first": n, "rank": names, "before": total}
        rows = part.rows.select(*((F.col(c) + F.lit(base[c]).cast("long")).alias(c) if c in base and c not in keep else F.col(c) for c in part.rows.columns))
        out = rows if out is None else out.unionByName(rows)
        n, names, total = n + part.n, names + part.names, total + part.total
    return Ranked(out, n, names, total)


def dense_rank(df: DataFrame, key: str, partitions: int = 0) -> tuple[DataFrame, int]:
    """(df with rank from 1 and uniq: no other row has its key, number of distinct keys)."""
    # Equal keys are dealt out by a hash of the row.
    kept = [c for c in df.columns if c not in ("rank", "uniq")]
    done = ranked(df.withColumn("_tie", F.xxhash64(*kept)), [key], kept, ["_tie"], partitions=partitions)
    return done.rows.select(*kept, "rank", "uniq"), done.names


def row_index(df: DataFrame, order: list[str], name: str = "idx", partitions: int = 0) -> DataFrame:
    """Global 0-based row number by ``order``; rows equal in it are numbered in no particular order."""
    kept = [c for c in df.columns if c != name]
    return ranked(df, order, kept, partitions=partitions).rows.select(*kept, F.col("idx").alias(name))


def prefix_sum(df: DataFrame, order: str, value: str, name: str, inclusive: bool = False, partitions: int = 0) -> DataFrame:
    """Running sum of ``value`` in the order of a column, exclusive unless said otherwise."""
    kept = [c for c in df.columns if c != name]
    rows = ranked(df, [order], list(dict.fromkeys([*kept, value])), add=value, partitions=partitions).rows
    own = F.coalesce(F.col(value), F.lit(0)) if inclusive else F.lit(0)
    return rows.select(*kept, (F.col("before") + own).cast("long").alias(name))


def neighbour(df: DataFrame, index: str, value: str, by: int, name: str) -> DataFrame:
    """The value ``by`` rows further (before, if negative) in a 0-based index, null where there is none: a join, so it
    crosses partitions and needs no order of rows."""
    other = df.select((F.col(index) - by).alias("_at"), F.col(value).alias(name))
    return df.join(other, F.col(index) == F.col("_at"), "left").drop("_at")

