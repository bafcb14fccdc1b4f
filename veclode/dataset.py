"""A dataset: one table and any number of dense vector columns that share its row positions."""

from __future__ import annotations

import numbers

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import errors
from .functions import metrics
from .operators import rows as by_position
from .operators import search
from .sources import ingest
from .sources.ingest import POSITION
from .sources.manifest import Manifest, Store, Vector
from .view import View

_OPTIONS = {"compression": "zstd", "parquet.compression.codec.zstd.level": "1"}


class Dataset:
    """Handle of a dataset; opening one reads nothing.

    write and append stage Parquet files in new directories and then replace the manifest, so readers see
    all of a change or none of it and a rejected write loses nothing. Files of superseded versions stay for those
    who still read them until vacuum().

    Vectors come as NumPy arrays or, with a Spark DataFrame, as the name of one of its array columns (of arrays of
    one size, or arrays of such arrays), which then is the vector and no column of the table.
    """

    def __init__(self, path: str, spark: SparkSession | None = None):
        self.path = path
        self.spark = spark or SparkSession.getActiveSession() or SparkSession.builder.getOrCreate()
        self._store = Store(self.spark, path)

    # Catalog

    def _manifest(self) -> Manifest:
        if not self._store.exists():
            raise FileNotFoundError(errors.MISSING)
        return self._store.load()

    def _schema(self, manifest: Manifest) -> T.StructType:
        import json

        return T.StructType.fromJson(json.loads(manifest.schema)) if manifest.schema else T.StructType([])

    @property
    def shape(self) -> tuple[int, int]:
        """Rows and table columns; vectors don't count."""
        if not self._store.exists():
            return 0, 0
        manifest = self._store.load()
        return manifest.rows, len(self._schema(manifest))

    def __len__(self) -> int:
        return self.shape[0]

    def list_vectors(self) -> list[str]:
        return [v.name for v in self._manifest().vectors]

    def get_vec_shape(self, name: str) -> list[int]:
        manifest = self._manifest()
        if not manifest.vectors:
            raise ValueError(errors.NO_VECTORS)
        if not (found := manifest.vector(name)):
            raise errors.no_vector(name)
        return list(found.shape)

    def list_columns(self) -> dict[str, dict[str, str]]:
        """name -> {dtype, kind: "table" or "vector"}, the table's columns first."""
        manifest = self._manifest()
        table = {f.name: {"dtype": manifest.dtypes.get(f.name, f.dataType.simpleString()), "kind": "table"} for f in self._schema(manifest)}
        return table | {v.name: {"dtype": v.dtype, "kind": "vector"} for v in manifest.vectors}

    # Scans

    def _table(self, manifest: Manifest, position: bool = False) -> DataFrame:
        schema = self._schema(manifest)
        if not manifest.parts:
            df = self.spark.createDataFrame([], T.StructType([*schema.fields, T.StructField(POSITION, T.LongType())]))
        else:
            df = self.spark.read.schema(T.StructType([*schema.fields, T.StructField(POSITION, T.LongType())])).parquet(*self._store.full(manifest.parts))
        return df if position else df.drop(POSITION)

    def _vector(self, vector: Vector) -> DataFrame:
        return self.spark.read.parquet(*self._store.full(vector.parts))

    def read(self, columns: str | list[str] | None = None, load_mmap_vec: bool = True) -> View:
        """A lazy selection of table columns and vectors. load_mmap_vec is accepted and changes nothing."""
        manifest = self._manifest()
        table, vectors = self._schema(manifest).names, [v.name for v in manifest.vectors]
        if columns is None:
            names = [*table, *vectors]
        elif isinstance(columns, str):
            names = [columns]
        elif isinstance(columns, list) and all(isinstance(c, str) for c in columns):
            names = columns
        else:
            raise ValueError(errors.BAD_COLUMNS)
        for name in names:
            if name not in table and name not in vectors:
                raise errors.no_column(name)
        frames = {n: (lambda n=n: self._vector(manifest.vector(n)).select(F.col(POSITION).alias("row_id"), n)) for n in names if n in vectors and n not in table}
        return View(lambda c: self._table(manifest).select(*[f"`{x}`" for x in c]), frames, list(names), [n for n in names if n in table], columns is not None)

    def read_rows(self, row_indices) -> DataFrame:
        """The table rows at the distinct positions, in ascending order."""
        manifest = self._manifest()
        wanted = by_position.positions(row_indices, manifest.rows)
        return by_position.at(self._table(manifest, True), wanted, POSITION).drop(POSITION)

    def __getitem__(self, key):
        """file["c"], file[["a", "b"]]: columns. file[i], file[a:b:c], file[[i, j]]: (table rows, {vector: rows})."""
        if isinstance(key, np.ndarray):
            key = key.tolist()
        if isinstance(key, str):
            return self.read([key]).all_entries
        if isinstance(key, list) and key and all(isinstance(k, str) for k in key):
            return self.read(key).all_entries
        manifest = self._manifest()
        if isinstance(key, slice):
            start, stop, step = key.indices(manifest.rows)
            pick = lambda df: by_position.between(df, start, stop, step, POSITION)
        elif isinstance(key, numbers.Integral) and not isinstance(key, bool) or isinstance(key, list) and all(isinstance(k, numbers.Integral) and not isinstance(k, bool) for k in key):
            wanted = by_position.positions(key if isinstance(key, list) else [key], manifest.rows)
            pick = lambda df: by_position.at(df, wanted, POSITION)
        else:
            raise ValueError(f"Unsupported key: {key!r}")
        vectors = {v.name: pick(self._vector(v)).select(F.col(POSITION).alias("row_id"), v.name) for v in manifest.vectors}
        return pick(self._table(manifest, True)).drop(POSITION), vectors

    # Search

    def search_vector(self, emb_name: str, queries, top_k: int = 10, metric: str = "l2", kernel: str = "arrow") -> DataFrame:
        """query_id, rank, row_id (and sub_id for a 3-D vector whose sub-vectors are searched), distance.

        queries: a 2-D array, or a DataFrame of query_id and q array<double>. Values are compared as float32."""
        metric = metrics.canonical(metric)
        manifest = self._manifest()
        if not manifest.vectors:
            raise ValueError(errors.NO_VECTORS)
        if not (vector := manifest.vector(emb_name)):
            raise errors.no_vector(emb_name)
        if not isinstance(queries, DataFrame):
            queries = search.query_table(self.spark, queries)
        found = queries.agg(F.min(F.size("q")), F.max(F.size("q"))).first()
        by, value = ["row_id"], F.col(emb_name)
        base = self._vector(vector).select(F.col(POSITION).alias("row_id"), emb_name)
        if len(vector.shape) == 3 and found[1] == vector.shape[2]:
            base, by = base.select("row_id", F.posexplode(emb_name).alias("sub_id", emb_name)), ["row_id", "sub_id"]
            dim = vector.shape[2]
        elif len(vector.shape) == 3:
            value, dim = F.flatten(value), vector.shape[1] * vector.shape[2]
        else:
            dim = vector.shape[1]
        if found[0] is not None and (found[0] != dim or found[1] != dim):
            raise ValueError(f"Queries have {found[1]} dimensions, the vector has {dim}")
        single = value.cast("array<float>")
        if vector.dtype == "float16":
            single = F.transform(single, lambda x: F.when(F.isnan(x), F.lit(0.0).cast("float")).otherwise(x))
        return search.knn(base.select(*by, single.cast("array<double>").alias("v")), queries, top_k, metric, by, kernel)

    def search_arrays(self, emb_name: str, queries, top_k: int = 10, metric: str = "l2") -> tuple[np.ndarray, np.ndarray]:
        """(indices int32, distances float32), each of shape (queries, min(top_k, rows)), best first."""
        found = self.search_vector(emb_name, queries, top_k, metric).orderBy("query_id", "rank").select("query_id", "row_id", "distance").toPandas()
        n = found["query_id"].nunique()
        return found["row_id"].to_numpy("int32").reshape(n, -1), found["distance"].to_numpy("float32").reshape(n, -1)

    # Changes

    def _put_table(self, data, first: int, vdata: dict, expect: T.StructType | None = None) -> tuple[T.StructType, dict[str, str], str, int, list[Vector]]:
        """Writes the table's part, and the parts of the vectors that are columns of data."""
        df, dtypes, n = ingest.table_rows(self.spark, data, first)
        named = {name: c for name, c in vdata.items() if isinstance(c, str)}
        for c in named.values():
            if n is not None or c not in df.columns:
                raise errors.no_column(c)
        schema = T.StructType([f for f in df.schema.fields if f.name != POSITION and f.name not in named.values()])
        dtypes = {c: t for c, t in dtypes.items() if c in schema.names}
        if n is None and POSITION in df.columns:
            raise ValueError(f"{POSITION} is a reserved column name")
        if expect is not None and [(f.name, f.dataType) for f in schema] != [(f.name, f.dataType) for f in expect]:
            raise ValueError(errors.SCHEMA)
        if n == 0:
            raise ValueError(errors.EMPTY)
        part, vectors = self._store.new_part("table"), []
        target = self._store.full([part])[0]
        if n is not None:
            df.write.options(**_OPTIONS).parquet(target)
            return schema, dtypes, part, n, vectors
        stage = self._store.new_part("staged")
        ingest.staged(df).write.parquet(self._store.full([stage])[0])
        try:
            df, n = ingest.dense(self.spark.read.parquet(self._store.full([stage])[0]), first)
            if not n:
                raise ValueError(errors.EMPTY)
            for name, c in named.items():
                vectors.append(Vector(name, [n, *ingest.array_shape(df, c)], ingest.array_dtype(df, c), [self._store.new_part("vectors")]))
                df.select(F.col(c).alias(name), POSITION).write.options(**_OPTIONS).parquet(self._store.full(vectors[-1].parts)[0])
            df.select(*[f"`{f.name}`" for f in schema], POSITION).write.options(**_OPTIONS).parquet(target)
        finally:
            self._store.drop([stage])
        return schema, dtypes, part, n, vectors

    def _put_vector(self, name: str, array, first: int) -> Vector:
        df, shape, dtype = ingest.vector_rows(self.spark, name, array, first)
        part = self._store.new_part("vectors")
        df.write.options(**_OPTIONS).parquet(self._store.full([part])[0])
        return Vector(name, shape, dtype, [part])

    @staticmethod
    def _check_rows(found: dict[str, int], rows: int) -> None:
        for n in found.values():
            if rows and n != rows:
                raise ValueError(f"First dimension must match number of rows: {n} and {rows}")

    def write(self, tdata=None, vdata: dict | None = None) -> None:
        """Replaces the dataset by a table (and its vectors), or adds or replaces vectors of the present one."""
        if tdata is None and vdata is None:
            raise ValueError(errors.NOTHING)
        if vdata is not None and not isinstance(vdata, dict):
            raise ValueError(errors.NOT_DICT)
        vdata = vdata or {}
        old = self._store.load() if self._store.exists() else Manifest()
        if tdata is not None and not isinstance(tdata, DataFrame):
            tdata = ingest.arrow_table(tdata)
            rows = tdata.num_rows
        else:
            rows = None if tdata is not None else old.rows
        arrays = {name: array for name, array in vdata.items() if not (isinstance(array, str) and isinstance(tdata, DataFrame))}
        sizes = {name: ingest.vector_array(array)[1][0] for name, array in arrays.items()}  # before anything is written
        self._check_rows(sizes, rows or 0)
        if tdata is not None:
            schema, dtypes, part, n, vectors = self._put_table(tdata, 0, vdata)
            new = Manifest(n, schema.json(), dtypes, [part], vectors)
        else:
            new = Manifest(old.rows, old.schema, old.dtypes, old.parts, list(old.vectors), old.streams)
        self._check_rows(sizes, new.rows)
        for name, array in arrays.items():
            vector = self._put_vector(name, array, 0)
            new.vectors = [vector if v.name == name else v for v in new.vectors] if new.vector(name) else [*new.vectors, vector]
            new.rows = new.rows or array.shape[0]
        new.vectors.sort(key=lambda v: list(vdata).index(v.name) if tdata is not None else 0)
        self._store.save(new)

    def append(self, tdata=None, vdata: dict | None = None, once: tuple[str, int] | None = None) -> None:
        """Adds rows; the schema, and for vectors the names, dtypes and trailing dimensions, must be the same. With vectors
        in it, an append has to end with as many of each as the table has rows; a table's rows may come first, alone.
        once: a stream and its batch number; a batch that is not later than the stream's last one changes nothing."""
        if tdata is None and vdata is None:
            raise ValueError(errors.NOTHING)
        if not self._store.exists():
            if once is None:
                return self.write(tdata, vdata)
            self._store.save(Manifest())
        old = self._store.load()
        if once is not None and old.streams.get(once[0], -1) >= once[1]:
            return
        new = Manifest(old.rows, old.schema, old.dtypes, list(old.parts), list(old.vectors), old.streams | ({once[0]: once[1]} if once else {}))
        arrays, named = {}, {}
        if vdata is not None:
            if not isinstance(vdata, dict):
                raise ValueError(errors.NOT_DICT)
            if len(vdata) != len(old.vectors):
                raise ValueError(errors.VECTOR_COUNT)
            for v in old.vectors:
                if v.name not in vdata:
                    raise ValueError(f"Vector '{v.name}' not found in input data")
                if isinstance(vdata[v.name], str) and isinstance(tdata, DataFrame):
                    named[v.name] = vdata[v.name]
                    continue
                _, shape, dtype = ingest.vector_array(vdata[v.name])
                self._same_kind(v, shape, dtype)
                arrays[v.name] = vdata[v.name]
        if tdata is not None and not isinstance(tdata, DataFrame):
            tdata = ingest.arrow_table(tdata)
        added = tdata.num_rows if tdata is not None and not isinstance(tdata, DataFrame) else 0 if tdata is None else None
        total = {v.name: v.shape[0] + arrays[v.name].shape[0] for v in old.vectors if v.name in arrays}
        if old.parts and added is not None:
            self._check_rows(total, old.rows + added)
        fresh: list[Vector] = []
        if tdata is not None:
            schema, dtypes, part, n, fresh = self._put_table(tdata, old.rows, named, self._schema(old) if old.parts else None)
            if not old.parts:
                new.schema, new.dtypes = schema.json(), dtypes
            new.parts.append(part)
            new.rows += n
            self._check_rows(total, new.rows)
            for v in fresh:
                self._same_kind(old.vector(v.name), v.shape, v.dtype)
                self._check_rows({v.name: old.vector(v.name).shape[0] + v.shape[0]}, new.rows)
        if vdata is not None:
            more = {v.name: v for v in fresh} | {name: self._put_vector(name, a, old.vector(name).shape[0]) for name, a in arrays.items()}
            new.vectors = [Vector(v.name, [v.shape[0] + more[v.name].shape[0], *v.shape[1:]], v.dtype, [*v.parts, *more[v.name].parts]) for v in old.vectors]
            if not new.parts:
                new.rows = new.vectors[0].shape[0]
        self._store.save(new)

    @staticmethod
    def _same_kind(v: Vector, shape: list[int], dtype: str) -> None:
        if dtype != v.dtype:
            raise ValueError(f"Data type mismatch for '{v.name}': {dtype} and {v.dtype}")
        if shape[1:] != v.shape[1:]:
            raise ValueError(f"Shape mismatch for '{v.name}': {shape[1:]} and {v.shape[1:]}")

    def vacuum(self) -> None:
        """Deletes the files of superseded versions and of rejected writes. No one may be writing, or reading those."""
        manifest = self._manifest()
        kept = {*manifest.parts, *(p for v in manifest.vectors for p in v.parts)}
        self._store.drop([p for p in self._store.listed() if p not in kept])
