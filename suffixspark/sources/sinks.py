"""Suffix arrays as files, logs and their summaries."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

WORD = 5


def write_parquet(sa: DataFrame, path: str) -> None:
    """(idx, pos), range-partitioned and sorted by idx."""
    sa.repartitionByRange("idx").sortWithinPartitions("idx").write.mode("overwrite").parquet(path)


def packed_blocks(sa: DataFrame, block: int = 1 << 16) -> DataFrame:
    """(first long, body binary): positions in the order of idx as 5-byte little-endian numbers, ``block`` to a row."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bodies = []
            for own in batch.column("own").to_pylist():
                words = np.array([x["pos"] for x in own], "<u8").view(np.uint8).reshape(-1, 8)
                bodies.append(words[:, :WORD].tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("first"), pa.array(bodies, pa.binary())], ["first", "body"])

    rows = sa.groupBy((F.floor(F.col("idx") / block) * block).cast("long").alias("first")).agg(F.array_sort(F.collect_list(F.struct("idx", "pos"))).alias("own"))
    return rows.mapInArrow(pack, "first long, body binary")


def write_uint40(sa: DataFrame, path: str) -> None:
    """One file of 5-byte little-endian positions, as long as it has to be; blocks stream through the driver in order."""
    spark = sa.sparkSession
    blocks = packed_blocks(sa).orderBy("first")
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = target.getFileSystem(spark._jsc.hadoopConfiguration()).create(target, True)
    try:
        for row in blocks.toLocalIterator():
            out.write(row["body"])
    finally:
        out.close()


def read_uint40(spark: SparkSession, path: str) -> DataFrame:
    """(idx, pos) of such a file, through Spark's fixed-length records."""
    content = spark.read.format("binaryFile").load(path).select("content", "length")
    step = 1 << 16
    blocks = content.select(F.explode(F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor((F.col("length") / WORD - 1) / step)).cast("int")), lambda i: F.struct((i * step).cast("long").alias("first"), F.substring("content", i * (step * WORD) + 1, F.lit(step * WORD)).alias("body")))).alias("b")).select("b.*")

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, body in zip(batch.column("first").to_pylist(), batch.column("body").to_pylist(), strict=True):
                raw = np.frombuffer(body, np.uint8).reshape(-1, WORD)
                wide = np.zeros((len(raw), 8), np.uint8)
                wide[:, :WORD] = raw
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(first, first + len(raw))), pa.array(wide.view("<i8").ravel())], ["idx", "pos"])

    return blocks.mapInArrow(unpack, "idx long, pos long")


def write_json(objects: list[dict], path: str) -> None:
    """A JSON list of run records."""
    with open(path, "w") as out:
        json.dump(objects, out, indent=1)


_VALUE = re.compile(r"\S*=\S*")


def parse_log(lines: list[str]) -> dict[str, str]:
    """name=value pairs, brackets left out, of a run's log; a name ends at the first =, and the last of a name counts."""
    found = (m.translate({91: None, 93: None}).partition("=") for line in lines for m in _VALUE.findall(line))
    return {name: value for name, _, value in found}


def parse_log_rows(log: DataFrame, line: str) -> DataFrame:
    """(name, value) of all pairs in a column of log lines."""
    pairs = log.select(F.explode(F.regexp_extract_all(line, F.lit(r"\S*=\S*"), F.lit(0))).alias("p")).select(F.translate("p", "[]", "").alias("p"))
    return pairs.selectExpr("substring(p, 1, instr(p, '=') - 1) AS name", "substring(p, instr(p, '=') + 1) AS value")


def recursive_times(records: DataFrame, keep: tuple[str, ...] = ("total_time", "phase_03_recursion")) -> DataFrame:
    """(phase, time) of (phase, level, time): summed over levels, but level 0 only for phases that hold the others."""
    first = F.when(F.col("phase").isin(*keep), F.sum(F.when(F.col("level") == 0, F.col("time")).otherwise(0.0))).otherwise(F.sum("time"))
    return records.groupBy("phase").agg(first.alias("time"))
