"""Vector distances as column expressions over array columns.

l2 is the squared Euclidean distance and cosine is 1 - a.b / (|a| |b|) (0 for two zero vectors, 1 for one):
smaller is nearer. ip is the dot product: larger is nearer. Arrays of different lengths, and nulls inside
one, give null; nulls and NaN rank last.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import bad_metric

METRICS = ("l2", "ip", "cosine")
#: Other names of the metrics.
ALIASES = {"Euclidean": "l2", "L2": "l2", "InnerProduct": "ip", "IP": "ip", "Cosine": "cosine", "COSINE": "cosine", "Cos": "cosine"}


def canonical(metric: str) -> str:
    name = ALIASES.get(metric, metric)
    if name not in METRICS:
        raise bad_metric(metric)
    return name


def _fold(a: Column, b: Column, f) -> Column:
    return F.aggregate(F.zip_with(a, b, f), F.lit(0.0), lambda total, x: total + x)


def l2_squared(a: Column, b: Column) -> Column:
    return _fold(a, b, lambda x, y: (x - y) * (x - y))


def inner_product(a: Column, b: Column) -> Column:
    return _fold(a, b, lambda x, y: x * y)


def cosine_distance(a: Column, b: Column) -> Column:
    aa, bb = inner_product(a, a), inner_product(b, b)
    norms = F.sqrt(aa * bb)
    return F.when((aa == 0) & (bb == 0), 0.0).when((aa == 0) | (bb == 0), 1.0).otherwise(1 - inner_product(a, b) / F.when(norms != 0, norms))


def distance(metric: str, a: Column, b: Column) -> Column:
    """The metric's value for two array<double> columns."""
    return {"l2": l2_squared, "ip": inner_product, "cosine": cosine_distance}[canonical(metric)](a, b)


def order(metric: str, value: Column) -> Column:
    """What to sort by, ascending, for best first; null and NaN become null."""
    clean = F.when(~F.isnan(value), value)
    return -clean if canonical(metric) == "ip" else clean
