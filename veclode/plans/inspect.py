"""What Spark made of a DataFrame, for tests and tuning."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame


def physical(df: DataFrame) -> str:
    """The physical plan's text."""
    return df._jdf.queryExecution().executedPlan().toString()


def read_columns(df: DataFrame) -> list[list[str]]:
    """The columns that each Parquet scan reads."""
    return [re.findall(r"(\w+):", s) for s in re.findall(r"ReadSchema: struct<(.*?)>(?:\n|$)", physical(df))]


def pushed_filters(df: DataFrame) -> list[str]:
    """The predicates that each Parquet scan got."""
    return re.findall(r"PushedFilters: \[(.*?)\]", physical(df))
