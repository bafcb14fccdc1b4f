"""pandas, dicts, Arrow tables, NumPy arrays and Spark DataFrames as DataFrames with a dense position."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import BAD_RANK, bad_dtype, bad_input
from .types import vector_array, widen  # noqa: F401

POSITION = "__row_id"


def arrow_table(data: object) -> pa.Table:
    if isinstance(data, pd.DataFrame):
        return pa.Table.from_pandas(data)
    if isinstance(data, dict):
        return pa.table(data)
    if isinstance(data, pa.Table):
        return data
    raise bad_input(type(data).__name__)


def _numbered(spark: SparkSession, table: pa.Table, first: int) -> DataFrame:
    ids = pa.array(np.arange(first, first + table.num_rows), pa.int64())
    return spark.createDataFrame(table.append_column(POSITION, ids))


def table_rows(spark: SparkSession, data: object, first: int) -> tuple[DataFrame, dict[str, str], int | None]:
    """The rows with their positions from `first`, the columns' original types, and the row count if known."""
    if isinstance(data, DataFrame):
        return data, dict(data.dtypes), None
    table = arrow_table(data)
    return _numbered(spark, widen(table), first), {f.name: str(f.type) for f in table.schema}, table.num_rows


def vector_rows(spark: SparkSession, name: str, array: np.ndarray, first: int) -> tuple[DataFrame, list[int], str]:
    column, shape, dtype = vector_array(array)
    return _numbered(spark, pa.table({name: column}), first), shape, dtype


def staged(df: DataFrame) -> DataFrame:
    """df with its partition and place there, to be written before dense positions are given."""
    return df.withColumn("__place", F.monotonically_increasing_id())


def dense(written: DataFrame, first: int) -> tuple[DataFrame, int]:
    """Positions from `first` in the order of __place, and the row count. One small row for each partition
    that wrote rows gives the offsets; no row changes its task."""
    part = F.shiftright("__place", 33)
    counts = written.groupBy(part.alias("__part")).agg(F.count("*").alias("n")).toArrow()
    order = np.argsort(counts.column("__part").to_numpy())
    n = counts.column("n").to_numpy()[order]
    offsets = pa.table({"__part": counts.column("__part").to_numpy()[order], "__offset": first + np.cumsum(n) - n})
    spark = written.sparkSession
    if not len(n):
        return written.withColumn(POSITION, F.lit(0).cast("long")).drop("__place"), 0
    # Gaps inside a partition can't occur: monotonically_increasing_id counts its rows from 0.
    joined = written.withColumn("__part", part).join(F.broadcast(spark.createDataFrame(offsets)), "__part")
    place = F.col("__place").bitwiseAND((1 << 33) - 1)
    return joined.withColumn(POSITION, F.col("__offset") + place).drop("__place", "__part", "__offset"), int(n.sum())


def array_shape(df: DataFrame, column: str) -> list[int]:
    """The dimensions below the rows of an array column whose arrays all have the same; raises otherwise."""
    kind, depth = df.schema[column].dataType, 0
    while isinstance(kind, T.ArrayType):
        kind, depth = kind.elementType, depth + 1
    if depth not in (1, 2):
        raise ValueError(BAD_RANK)
    outer = [F.size(column)] if depth == 1 else [F.size(column), F.array_max(F.transform(column, F.size))]
    inner = outer if depth == 1 else [outer[0], F.array_min(F.transform(column, F.size))]
    found = df.agg(*[F.min(x).alias(f"low{i}") for i, x in enumerate(inner)], *[F.max(x).alias(f"high{i}") for i, x in enumerate(outer)], F.max(F.col(column).isNull().cast("int")).alias("none")).first()
    if found["none"] or any(found[f"low{i}"] != found[f"high{i}"] for i in range(depth)):
        raise ValueError(f"The arrays of '{column}' differ in size")
    return [found[f"low{i}"] for i in range(depth)]


#: Names of Spark's element types as NumPy's.
DTYPES = {"float": "float32", "double": "float64", "tinyint": "int8", "smallint": "int16", "int": "int32", "bigint": "int64", "boolean": "bool"}


def array_dtype(df: DataFrame, column: str) -> str:
    kind = df.schema[column].dataType
    while isinstance(kind, T.ArrayType):
        kind = kind.elementType
    if (name := kind.simpleString()) not in DTYPES:
        raise bad_dtype(name)
    return DTYPES[name]
