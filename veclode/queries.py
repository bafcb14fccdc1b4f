"""The registered queries of the library's own operators and their SQL.

All go through Dataset: a table is written as a dataset, in the order of its key, and read, searched or changed there.
"""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import errors
from .dataset import Dataset
from .sources.types import VECTOR_DTYPES


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _scratch(spark: SparkSession) -> str:
    """A fresh path in the shared folder of the cluster; a temporary one where none is set and one process runs all."""
    top = spark.conf.get("spark.checkpoint.dir", None)
    if not top:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
        top = tempfile.mkdtemp()
    return f"{top}/datasets/{uuid.uuid4().hex}"


def _written(spark: SparkSession, df: DataFrame, vdata: dict | None = None) -> Dataset:
    data = Dataset(_scratch(spark), spark)
    data.write(df, vdata)
    return data


def _orders(spark: SparkSession, sf_dir: str) -> Dataset:
    return _written(spark, _table(spark, sf_dir, "orders").orderBy("o_orderkey"))


def _embeddings(spark: SparkSession, sf_dir: str) -> Dataset:
    """vec_id and label as the table, embedding as its vector."""
    return _written(spark, _table(spark, sf_dir, "embeddings").orderBy("vec_id"), {"embedding": "embedding"})


# Vector search: every embedding whose id is divisible by 20, against all of them.


def _queries(spark: SparkSession, sf_dir: str, value=lambda v: v) -> DataFrame:
    chosen = _table(spark, sf_dir, "embeddings").where("vec_id % 20 = 0")
    return chosen.select(F.col("vec_id").alias("query_id"), value(F.col("embedding")).cast("array<double>").alias("q"))


def _rounded(found: DataFrame) -> DataFrame:
    return found.withColumn("distance", F.round("distance", 6))


def _knn(metric: str, k: int = 10, kernel: str = "arrow") -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: _rounded(_embeddings(spark, sf_dir).search_vector("embedding", _queries(spark, sf_dir), k, metric, kernel))


def knn_cast_int(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Integer vectors, which the search converts."""
    scaled = lambda c: F.transform(c, lambda x: F.floor(x.cast("double") * 100).cast("int"))
    rows = _table(spark, sf_dir, "embeddings").orderBy("vec_id").select("vec_id", scaled("embedding").alias("embedding"))
    return _written(spark, rows, {"embedding": "embedding"}).search_vector("embedding", _queries(spark, sf_dir, scaled), 10, "l2")


def knn_sub_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A 3-D vector of eight parts of eight numbers; queries of eight numbers find parts."""
    part = lambda c, i: F.slice(c, i * 8 + 1, F.lit(8))
    rows = _table(spark, sf_dir, "embeddings").orderBy("vec_id").select("vec_id", F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: part(F.col("embedding"), i)).alias("parts"))
    return _rounded(_written(spark, rows, {"parts": "parts"}).search_vector("parts", _queries(spark, sf_dir, lambda v: part(v, F.lit(0))), 5, "l2"))


def knn_flattened(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same 3-D vector; queries of 64 numbers find rows."""
    rows = _table(spark, sf_dir, "embeddings").orderBy("vec_id").select("vec_id", F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.slice("embedding", i * 8 + 1, F.lit(8))).alias("parts"))
    return _rounded(_written(spark, rows, {"parts": "parts"}).search_vector("parts", _queries(spark, sf_dir), 5, "ip"))


def knn_with_attributes(spark: SparkSession, sf_dir: str) -> DataFrame:
    data = _embeddings(spark, sf_dir)
    best = _rounded(data.search_vector("embedding", _queries(spark, sf_dir), 10, "cosine"))
    labels = data.read(["vec_id", "label"]).tdata.select(F.col("vec_id").alias("row_id"), "label")  # ids are the positions
    return best.join(labels, "row_id").select("query_id", "rank", "row_id", "label", "distance")


def knn_dtypes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A small matrix of zeros and ones in each element type, and one of float16 with a NaN, which counts as 0."""
    data, out = Dataset(_scratch(spark), spark), None
    plain = np.array([[i & 1, i >> 1 & 1, i >> 2 & 1] for i in range(8)])
    data.write(vdata={t: plain.astype(t) for t in VECTOR_DTYPES} | {"nan": np.where(plain == 1, plain, np.nan).astype("float16")})
    for name in data.list_vectors():
        found = data.search_vector(name, np.array([[1.0, 0, 0], [1, 1, 1]]), 3).withColumn("name", F.lit(name))
        out = found if out is None else out.unionByName(found)
    return out


def knn_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The result matrices of NumPy queries on a small vector."""
    data = Dataset(_scratch(spark), spark)
    data.write(vdata={"v": np.arange(20.0).reshape(10, 2)})
    indices, distances = data.search_arrays("v", np.array([[3.0, 3.0], [17.0, 20.0]]), 4, "L2")
    rows = [(q, r, int(indices[q, r]), float(distances[q, r])) for q in range(2) for r in range(4)]
    return spark.createDataFrame(rows, "query long, place long, row long, distance double")


# Scans, rows by position, views.


def _read(table: str, key: str, columns=None) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: _written(spark, _table(spark, sf_dir, table).orderBy(key)).read(columns).tdata


def _key(key) -> Callable[[SparkSession, str], DataFrame]:
    """The table part of data[key]."""
    return lambda spark, sf_dir: _orders(spark, sf_dir)[key][0]


def column_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _orders(spark, sf_dir)["o_totalprice"]


def columns_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _orders(spark, sf_dir)[["o_orderdate", "o_orderkey"]]


def read_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _orders(spark, sf_dir).read_rows(np.array([15, 0, 5, 5]))


def row_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The vector part of a list of positions."""
    return _embeddings(spark, sf_dir)[[9, 2, 2]][1]["embedding"]


def vector_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _embeddings(spark, sf_dir).read("embedding").vdata


def empty_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a dataset of vectors only has as its table, and the position of its vector's rows."""
    data = Dataset(_scratch(spark), spark)
    data.write(vdata={"v": np.eye(3)})
    return spark.createDataFrame([(data.read().tdata is None, *data.shape, data.get_vec_shape("v")[0])], "none boolean, n_rows long, n_columns long, n_vectors long")


def views(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What read() returns for selections of a table (a, b) and one or two vectors."""

    def shown(x) -> str:
        if isinstance(x, tuple):
            return "(" + ", ".join(map(shown, x)) + ")"
        if isinstance(x, dict):
            return "{" + ", ".join(f"{k}: {shown(v)}" for k, v in x.items()) + "}"
        return "none" if x is None else "+".join(x.columns)

    rows = []
    for name, vectors in (("one", ["e"]), ("two", ["e", "f"])):
        data = Dataset(_scratch(spark), spark)
        data.write({"a": [1, 2], "b": ["x", "y"]}, {v: np.eye(2) for v in vectors})
        for columns in (None, "a", ["b", "a"], ["e"], ["e", "b"], vectors):
            view = data.read(columns)
            rows.append((f"{name} {columns}", "+".join(view.columns_list), shown(view.tdata), shown(view.vdata), shown(view.all_entries)))
    return spark.createDataFrame(rows, "selection string, columns string, tdata string, vdata string, entries string").distinct()


# Writes.


def append_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders written as a dataset in two halves, and read."""
    orders = _table(spark, sf_dir, "orders")
    data = _written(spark, orders.where("o_orderkey % 2 = 0"))
    data.append(orders.where("o_orderkey % 2 = 1"))
    return data.read().tdata


def append_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings appended in two parts, table and vector together; both by position."""
    rows = _table(spark, sf_dir, "embeddings").orderBy("vec_id")
    data = _written(spark, rows.where("vec_id % 3 > 0"), {"embedding": "embedding"})
    data.append(rows.where("vec_id % 3 = 0"), {"embedding": "embedding"})
    return data.read("embedding").vdata


def replaced_vector(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A vector written again under its name, and one added."""
    data = Dataset(_scratch(spark), spark)
    data.write({"a": [1, 2, 3]}, {"e": np.zeros((3, 2)), "f": np.ones((3, 1), "int8")})
    data.write(vdata={"e": np.arange(6.0).reshape(3, 2), "g": np.arange(3).reshape(3, 1)})
    found = data.read().vdata
    out = [found[n].select(F.lit(n).alias("name"), "row_id", F.col(n).cast("array<double>").cast("string").alias("value")) for n in data.list_vectors()]
    return out[0].unionByName(out[1]).unionByName(out[2])


def ingest_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One table as a dict, a pandas frame, an Arrow table and a Spark frame, and appended to itself."""
    columns = {"id": list(range(50)), "name": [f"name_{i}" for i in range(50)], "half": [i / 2 for i in range(50)]}
    forms, out = {"dict": columns, "pandas": pd.DataFrame(columns), "arrow": pa.table(columns)}, None
    forms["spark"] = spark.createDataFrame(forms["pandas"])
    for form, table in forms.items():
        data = _written(spark, table)
        data.append(table)
        found = data.read().tdata.withColumn("form", F.lit(form))
        out = found if out is None else out.unionByName(found)
    return out


def ingest_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Types that Spark lacks, widened without loss."""
    table = pa.table({
        "u8": pa.array([0, 255, None], pa.uint8()), "u16": pa.array([0, 65535, None], pa.uint16()), "u32": pa.array([0, 2**32 - 1, None], pa.uint32()),
        "u64": pa.array([0, 2**64 - 1, None], pa.uint64()), "f16": pa.array(np.array([0.5, 65504, 1], "float16")), "list": pa.array([[1, 2], [], None], pa.list_(pa.int8())),
    })
    found = _written(spark, table).read().tdata
    return found.select(*[F.col(c).cast("double" if c == "f16" else "string").alias(c) for c in found.columns])


def ingest_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """NumPy matrices of all element types, read back."""
    data, plain, out = Dataset(_scratch(spark), spark), np.arange(24).reshape(6, 4) % 5 % 2, None
    data.write({"a": list(range(6))}, {t: np.asfortranarray(plain.astype(t)) for t in VECTOR_DTYPES})
    for name, found in data.read().vdata.items():
        kind = "array<int>" if name == "bool" else "array<double>"
        found = found.select(F.lit(name).alias("name"), "row_id", F.col(name).cast(kind).cast("array<int>").cast("string").alias("value"))
        out = found if out is None else out.unionByName(found)
    return out


def roundtrip_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _written(spark, _table(spark, sf_dir, "events")).read().tdata


# Catalog and errors.


def shape(spark: SparkSession, sf_dir: str) -> DataFrame:
    data = _orders(spark, sf_dir)
    return spark.createDataFrame([(*data.shape, len(data))], "n_rows long, n_columns long, length long")


def vec_shape(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame([tuple(_embeddings(spark, sf_dir).get_vec_shape("embedding"))], "n long, dim long")


def list_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    data = _embeddings(spark, sf_dir)
    rows = [(name, x["kind"], x["dtype"], name in data.list_vectors()) for name, x in data.list_columns().items()]
    return spark.createDataFrame(rows, "name string, kind string, dtype string, listed boolean")


def error_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    data = _written(spark, {"a": [1, 2]}, {"e": np.eye(2)})
    cases: dict[str, Callable] = {
        "missing": lambda: Dataset(_scratch(spark), spark).read(),
        "column": lambda: data.read("x"),
        "columns": lambda: data.read(("a",)),
        "key": lambda: data[1.5],
        "vector": lambda: data.get_vec_shape("x"),
        "bounds": lambda: data[5],
        "negative": lambda: data[-1],
        "no rows": lambda: data.read_rows([]),
        "nothing": lambda: data.write(),
        "no dict": lambda: data.write(vdata=[1]),
        "no array": lambda: data.write(vdata={"e": [1]}),
        "rank": lambda: data.write(vdata={"e": np.zeros(2)}),
        "dtype": lambda: data.write(vdata={"e": np.zeros((2, 2), complex)}),
        "rows": lambda: data.write(vdata={"e": np.eye(3)}),
        "schema": lambda: data.append({"b": [1]}),
        "count": lambda: data.append(vdata={}),
        "name": lambda: data.append(vdata={"x": np.eye(2)}),
        "rows appended": lambda: data.append({"a": [3]}, {"e": np.ones((5, 2))}),
        "input": lambda: data.write([1]),
        "empty": lambda: data.write({"a": []}),
        "metric": lambda: data.search_vector("e", np.eye(2), metric="x"),
        "top_k": lambda: data.search_vector("e", np.eye(2), 0),
    }
    rows = []
    for case, run in cases.items():
        try:
            run()
            rows.append((case, "none", ""))
        except (ValueError, IndexError, FileNotFoundError) as e:
            rows.append((case, type(e).__name__, str(e)))
    return spark.createDataFrame([*rows, ("rows left", str(len(data)), "")], "case string, kind string, message string")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "knn_l2": _knn("l2"),
    "knn_ip": _knn("ip"),
    "knn_cosine": _knn("cosine"),
    "knn_l2_expressions": _knn("l2", kernel="expressions"),
    "knn_ip_expressions": _knn("ip", kernel="expressions"),
    "knn_cosine_expressions": _knn("cosine", kernel="expressions"),
    "knn_alias": _knn("Euclidean", k=4),
    "knn_single": _knn("ip", k=1),
    "knn_k_exceeds_n": _knn("l2", k=1_000_000),
    "knn_cast_int": knn_cast_int,
    "knn_sub_vectors": knn_sub_vectors,
    "knn_flattened": knn_flattened,
    "knn_with_attributes": knn_with_attributes,
    "knn_dtypes": knn_dtypes,
    "knn_arrays": knn_arrays,
    "scan_full": _read("orders", "o_orderkey"),
    "project_one": _read("orders", "o_orderkey", "o_totalprice"),
    "project_many": _read("lineitem", "l_orderkey", ["l_shipdate", "l_orderkey", "l_tax"]),
    "column_key": column_key,
    "columns_key": columns_key,
    "row_at": _key(7),
    "rows_at": _key([15, 0, 5, 5]),
    "rows_at_many": _key(list(range(1500)) + [3, 4]),
    "read_rows": read_rows,
    "rows_slice": _key(slice(10, 100, 7)),
    "rows_slice_back": _key(slice(100, 10, -7)),
    "row_vectors": row_vectors,
    "vector_read": vector_read,
    "empty_table": empty_table,
    "views": views,
    "append_union": append_union,
    "append_vectors": append_vectors,
    "replaced_vector": replaced_vector,
    "ingest_forms": ingest_forms,
    "ingest_types": ingest_types,
    "ingest_vectors": ingest_vectors,
    "roundtrip_types": roundtrip_types,
    "dataset_rows": _key(slice(100, 200, 3)),
    "shape": shape,
    "vec_shape": vec_shape,
    "list_columns": list_columns,
    "error_messages": error_messages,
}


def _value(metric: str) -> str:
    pair = "list_sum(list_transform(list_zip(b.v, q.v), lambda p: (p[1] - p[2]) * (p[1] - p[2])))"
    return {"l2": pair, "ip": "list_inner_product(b.v, q.v)", "cosine": "list_cosine_distance(b.v, q.v)"}[metric]


_VECTORS = "b AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS row_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings)"


def _knn_sql(metric: str, k: int = 10, more: str = "") -> str:
    direction = "DESC" if metric == "ip" else "ASC"
    return f"""
WITH {_VECTORS},
d AS (SELECT q.vec_id AS query_id, b.row_id, b.label, {_value(metric)} AS distance FROM b, b q WHERE q.vec_id % 20 = 0),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY distance {direction}, row_id) AS INTEGER) AS rank FROM d)
SELECT query_id, rank, row_id, {more} round(distance, 6) AS distance FROM r WHERE rank <= {k}"""


def _values(columns: str, rows: list[tuple]) -> str:
    quoted = lambda x: "'" + x.replace("'", "''") + "'" if isinstance(x, str) else str(x)
    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(quoted, r)) + ')' for r in rows)}) AS t({columns})"


_VIEWS = [
    ("one None", "a+b+e", "a+b", "row_id+e", "(a+b, {e: row_id+e})"), ("one a", "a", "a", "none", "a"), ("one ['b', 'a']", "b+a", "b+a", "none", "b+a"),
    ("one ['e']", "e", "none", "row_id+e", "{e: row_id+e}"), ("one ['e', 'b']", "e+b", "b", "row_id+e", "(b, {e: row_id+e})"),
    ("two None", "a+b+e+f", "a+b", "{e: row_id+e, f: row_id+f}", "(a+b, {e: row_id+e, f: row_id+f})"), ("two a", "a", "a", "none", "a"), ("two ['b', 'a']", "b+a", "b+a", "none", "b+a"),
    ("two ['e']", "e", "none", "row_id+e", "{e: row_id+e}"), ("two ['e', 'b']", "e+b", "b", "row_id+e", "(b, {e: row_id+e})"),
    ("two ['e', 'f']", "e+f", "none", "{e: row_id+e, f: row_id+f}", "{e: row_id+e, f: row_id+f}"),
]
_ERRORS = [
    ("missing", "FileNotFoundError", errors.MISSING), ("column", "ValueError", "Column 'x' not found"), ("columns", "ValueError", errors.BAD_COLUMNS), ("key", "ValueError", "Unsupported key: 1.5"),
    ("vector", "ValueError", "Vector 'x' not found"), ("bounds", "IndexError", "Row index 5 out of bounds for 2 rows"), ("negative", "IndexError", "Row index -1 out of bounds for 2 rows"),
    ("no rows", "ValueError", errors.NO_INDICES), ("nothing", "ValueError", errors.NOTHING), ("no dict", "ValueError", errors.NOT_DICT), ("no array", "ValueError", errors.NOT_ARRAY),
    ("rank", "ValueError", errors.BAD_RANK), ("dtype", "ValueError", "Unsupported dtype: <c16"), ("rows", "ValueError", "First dimension must match number of rows: 3 and 2"),
    ("schema", "ValueError", errors.SCHEMA), ("count", "ValueError", errors.VECTOR_COUNT), ("name", "ValueError", "Vector 'e' not found in input data"),
    ("rows appended", "ValueError", "First dimension must match number of rows: 7 and 3"), ("input", "ValueError", "Unsupported input type: list"), ("empty", "ValueError", errors.EMPTY),
    ("metric", "ValueError", "Unsupported metric: x"), ("top_k", "ValueError", "top_k must be positive"), ("rows left", "2", ""),
]
_BITS = "b AS (SELECT i AS row_id, CAST([i & 1, i >> 1 & 1, i >> 2 & 1] AS DOUBLE[]) AS v FROM range(8) t(i)), q AS (SELECT * FROM (VALUES (0, CAST([1, 0, 0] AS DOUBLE[])), (1, CAST([1, 1, 1] AS DOUBLE[]))) AS t(query_id, v))"

SQL: dict[str, str] = {
    "knn_l2": _knn_sql("l2"),
    "knn_ip": _knn_sql("ip"),
    "knn_cosine": _knn_sql("cosine"),
    "knn_l2_expressions": _knn_sql("l2"),
    "knn_ip_expressions": _knn_sql("ip"),
    "knn_cosine_expressions": _knn_sql("cosine"),
    "knn_alias": _knn_sql("l2", 4),
    "knn_single": _knn_sql("ip", 1),
    "knn_k_exceeds_n": _knn_sql("l2", 1_000_000),
    "knn_cast_int": f"""
WITH b AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS row_id, list_transform(CAST(embedding AS DOUBLE[]), lambda x: floor(x * 100)) AS v FROM embeddings),
d AS (SELECT q.vec_id AS query_id, b.row_id, {_value("l2")} AS distance FROM b, b q WHERE q.vec_id % 20 = 0),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY distance, row_id) AS INTEGER) AS rank FROM d)
SELECT query_id, rank, row_id, distance FROM r WHERE rank <= 10""",
    "knn_sub_vectors": f"""
WITH {_VECTORS}, s AS (SELECT vec_id, row_id, i AS sub_id, v[i * 8 + 1 : i * 8 + 8] AS v FROM b, range(8) t(i)),
d AS (SELECT q.vec_id AS query_id, b.row_id, CAST(b.sub_id AS INTEGER) AS sub_id, {_value("l2")} AS distance FROM s b, s q WHERE q.vec_id % 20 = 0 AND q.sub_id = 0),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY distance, row_id, sub_id) AS INTEGER) AS rank FROM d)
SELECT query_id, rank, row_id, sub_id, round(distance, 6) AS distance FROM r WHERE rank <= 5""",
    "knn_flattened": _knn_sql("ip", 5),
    "knn_with_attributes": _knn_sql("cosine", more="label,"),
    "knn_dtypes": f"""
WITH {_BITS}, d AS (SELECT query_id, row_id, {_value("l2")} AS distance FROM b, q),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY distance, row_id) AS INTEGER) AS rank FROM d)
SELECT CAST(query_id AS BIGINT) AS query_id, rank, row_id, distance, name FROM r, (SELECT unnest({[*VECTOR_DTYPES, "nan"]}) AS name) WHERE rank <= 3""",
    "knn_arrays": """
WITH d AS (SELECT q, i, pow(2 * i - x, 2) + pow(2 * i + 1 - y, 2) AS distance FROM range(10) t(i), (VALUES (0, 3, 3), (1, 17, 20)) AS p(q, x, y)),
r AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY distance, i) - 1 AS place FROM d)
SELECT CAST(q AS BIGINT) AS query, place, i AS row, distance FROM r WHERE place < 4""",
    "scan_full": "SELECT * FROM orders",
    "project_one": "SELECT o_totalprice FROM orders",
    "project_many": "SELECT l_shipdate, l_orderkey, l_tax FROM lineitem",
    "column_key": "SELECT o_totalprice FROM orders",
    "columns_key": "SELECT o_orderdate, o_orderkey FROM orders",
    "row_at": "SELECT * FROM orders WHERE o_orderkey = 7",
    "rows_at": "SELECT * FROM orders WHERE o_orderkey IN (0, 5, 15)",
    "rows_at_many": "SELECT * FROM orders WHERE o_orderkey < 1500",
    "read_rows": "SELECT * FROM orders WHERE o_orderkey IN (0, 5, 15)",
    "rows_slice": "SELECT * FROM orders WHERE o_orderkey >= 10 AND o_orderkey < 100 AND (o_orderkey - 10) % 7 = 0",
    "rows_slice_back": "SELECT * FROM orders WHERE o_orderkey <= 100 AND o_orderkey > 10 AND (100 - o_orderkey) % 7 = 0",
    "row_vectors": "SELECT vec_id AS row_id, embedding FROM embeddings WHERE vec_id IN (2, 9)",
    "vector_read": "SELECT row_number() OVER (ORDER BY vec_id) - 1 AS row_id, embedding FROM embeddings",
    "empty_table": "SELECT true AS none, CAST(3 AS BIGINT) AS n_rows, CAST(0 AS BIGINT) AS n_columns, CAST(3 AS BIGINT) AS n_vectors",
    "views": _values("selection, columns, tdata, vdata, entries", _VIEWS),
    "append_union": "SELECT * FROM orders",
    "append_vectors": "SELECT row_number() OVER (ORDER BY vec_id % 3 = 0, vec_id) - 1 AS row_id, embedding FROM embeddings",
    "replaced_vector": "SELECT name, CAST(row_id AS BIGINT) AS row_id, value FROM (" + _values("name, row_id, value", [("e", i, f"[{2 * i}.0, {2 * i + 1}.0]") for i in range(3)] + [("f", i, "[1.0]") for i in range(3)] + [("g", i, f"[{i}.0]") for i in range(3)]) + ")",
    "ingest_forms": "SELECT i AS id, 'name_' || i AS name, i / 2 AS half, form FROM range(50) t(i), range(2), (SELECT unnest(['dict', 'pandas', 'arrow', 'spark']) AS form)",
    "ingest_types": "SELECT u8, u16, u32, u64, CAST(f16 AS DOUBLE) AS f16, list FROM (" + _values("u8, u16, u32, u64, f16, list", [("0", "0", "0", "0", "0.5", "[1, 2]"), ("255", "65535", str(2**32 - 1), str(2**64 - 1), "65504", "[]")]) + " UNION ALL SELECT NULL, NULL, NULL, NULL, '1', NULL)",
    "ingest_vectors": f"""
SELECT name, row_id, '[' || array_to_string(list_transform(range(4), lambda c: (row_id * 4 + c) % 5 % 2), ', ') || ']' AS value
FROM range(6) t(row_id), (SELECT unnest({list(VECTOR_DTYPES)}) AS name)""",
    "roundtrip_types": "SELECT * FROM events",
    "dataset_rows": "SELECT * FROM orders WHERE o_orderkey >= 100 AND o_orderkey < 200 AND (o_orderkey - 100) % 3 = 0",
    "shape": "SELECT count(*) AS n_rows, CAST(6 AS BIGINT) AS n_columns, count(*) AS length FROM orders",
    "vec_shape": "SELECT count(*) AS n, CAST(max(len(embedding)) AS BIGINT) AS dim FROM embeddings",
    "list_columns": _values("name, kind, dtype, listed", [("vec_id", "table", "bigint", False), ("label", "table", "int", False), ("embedding", "vector", "float32", True)]),
    "error_messages": _values('"case", kind, message', _ERRORS),
}
