"""Intermediate tables in the shared folder that the session names in spark.checkpoint.dir."""

from __future__ import annotations

import gc
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def folder(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir. Where that is unset, one process (as in tests) takes a temporary one."""
    top = spark.conf.get("spark.checkpoint.dir", None)
    if not top:
        found = spark.sparkContext._jsc.sc().getCheckpointDir()
        if not found.isDefined():
            if not re.match(r"local(\[|$)", spark.sparkContext.master):
                raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
            spark.sparkContext.setCheckpointDir(tempfile.mkdtemp())
            found = spark.sparkContext._jsc.sc().getCheckpointDir()
        top = found.get()
    return f"{top}/tables/{uuid.uuid4().hex}"


def written(df: DataFrame, **options: str) -> DataFrame:
    """df, written as a table and read again: its lineage ends here and lost executors cost no recomputation."""
    path = folder(df.sparkSession)
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def numbered(df: DataFrame, row: str) -> DataFrame:
    """df with a number for each row, written once: whatever is made of it later sees the same numbers, although another
    run of df may give its rows in another order or cut them otherwise."""
    return written(df.withColumn(row, F.monotonically_increasing_id()), compression="zstd")


def quoted(name: str) -> str:
    """A column's name for Spark's functions, which read dots and backticks."""
    return f"`{name.replace('`', '``')}`"


def unused(df: DataFrame, name: str) -> str:
    """The name, with underscores behind it until no column has it."""
    while name.lower() in (c.lower() for c in df.columns):
        name += "_"
    return name


def release(spark: SparkSession) -> None:
    """Lets Spark's cleaner delete the shuffle files of finished steps now: it learns of them by garbage collection."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def map_in_arrow(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: T.StructType | str) -> DataFrame:
    """df.mapInArrow(run, schema) for columns of any name, which Spark's own looks up by their names."""
    names = df.columns

    def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return run(b.rename_columns(names) for b in batches)

    return df.toDF(*[f"c{i}" for i in range(len(names))]).mapInArrow(named, schema)
