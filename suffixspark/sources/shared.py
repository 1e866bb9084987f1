"""Tables in the folder that the driver and all executors share."""

from __future__ import annotations

import tempfile
import uuid
from weakref import WeakKeyDictionary

from pyspark.sql import DataFrame, SparkSession

#: Tables of each session that are still there.
_written: WeakKeyDictionary[SparkSession, list[str]] = WeakKeyDictionary()


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; where that is unset, one in the warehouse, or a temporary one on a local master."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or getattr(spark, "_suffixspark_shared", None)
    if not folder:
        local = spark.sparkContext.master.startswith("local")
        folder = spark._suffixspark_shared = tempfile.mkdtemp(prefix="suffixspark-") if local else f"{spark.conf.get('spark.sql.warehouse.dir')}/suffixspark-{uuid.uuid4().hex}"
    return folder


def register(spark: SparkSession, path: str) -> str:
    """Notes a folder that ``release`` deletes."""
    _written.setdefault(spark, []).append(path)
    return path


def materialise(df: DataFrame) -> DataFrame:
    """Write to a new table in the shared folder and read it back: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/t-{uuid.uuid4().hex}"
    df.write.parquet(path)
    register(spark, path)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> int:
    """Delete all tables that this session has written so far; returns how many. Results read from them must be saved."""
    paths = _written.pop(spark, [])
    for path in paths:
        target = spark._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
    return len(paths)
