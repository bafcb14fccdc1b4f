"""Exact top-k vector search: a stated set of queries against all rows, in blocks of queries.

A task holds its best rows for each query of a block. A matrix product of a share of its rows and of the queries, with a
bound on its rounding, says which pairs can still be among the best; only their distances are then computed, each as the
sum over the row's own products in order, as the expressions of functions.metrics do. Shares are of TILE pairs, so memory
grows neither with the rows nor with the queries. The final top-k is a window that Spark limits before its shuffle, so
at most tasks * queries * k rows move. Ties go to the smaller row id. The kernel "expressions" computes the distances of
the rows found, and their ranks, by built-in functions.

Where about all rows are wanted, no pair is shuffled: the base is read once more for each group of queries (a Cartesian
product of chunks), and a task holds that group's distances and ranks them itself. Disk then grows with the rows alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import metrics

#: A block of queries sent to all tasks holds at most so many numbers (8 MB).
BLOCK_VALUES = 1 << 20
#: A task holds its best rows if queries * k is at most this; blocks are cut to it, down to LEAST_QUERIES.
HELD_ROWS, LEAST_QUERIES = 1 << 19, 256
#: Pairs of rows and queries in one matrix, and numbers of the vectors whose distances are computed at once.
TILE, EXACT_VALUES = 1 << 19, 1 << 20
#: Where about all rows are wanted: distances held by a task, and numbers of a chunk of vectors.
ALL_VALUES, CHUNK_VALUES = 1 << 24, 1 << 12


def query_table(spark: SparkSession, queries: np.ndarray) -> DataFrame:
    """query_id (the position) and q array<double> of a 2-D array of queries, rounded to float32."""
    queries = np.asarray(queries, "float32")
    if queries.ndim != 2:
        raise ValueError("queries must be 2-D")
    flat = pa.ListArray.from_arrays(pa.array(np.arange(len(queries) + 1) * queries.shape[1], pa.int32()), pa.array(queries.astype("float64").ravel()))
    return spark.createDataFrame(pa.table({"query_id": pa.array(np.arange(len(queries)), pa.int64()), "q": flat}))


def _blocks(queries: DataFrame, k: int) -> list[DataFrame]:
    n, dim = queries.agg(F.count("*"), F.max(F.size("q"))).first()
    most = max(1, BLOCK_VALUES // max(dim or 1, 1))
    if HELD_ROWS // k >= LEAST_QUERIES:
        most = min(most, HELD_ROWS // k)
    blocks = max(1, -(-n // most))
    return [queries.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == i) for i in range(blocks)] if blocks > 1 else [queries]


def _best(found: DataFrame, k: int, by: list[str]) -> DataFrame:
    window = Window.partitionBy("query_id").orderBy(F.col("__order").asc_nulls_last(), *by)
    return found.withColumn("rank", F.row_number().over(window)).where(F.col("rank") <= k).select("query_id", "rank", *by, "distance")


def knn_expressions(base: DataFrame, queries: DataFrame, k: int, metric: str, by: list[str]) -> DataFrame:
    """base: the columns `by` and v array<double>; queries: query_id, q array<double>."""
    found = knn_arrow(base, queries, k, metric, by).select(F.col("query_id").alias("__query"), *[F.col(c).alias(f"__{c}") for c in by]).distinct()
    same = F.lit(True)
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"__{c}"))
    pairs = base.join(found, same).join(queries, F.col("query_id") == F.col("__query")).withColumn("distance", metrics.distance(metric, F.col("v"), F.col("q")))
    return _best(pairs.select("query_id", *by, "distance", metrics.order(metric, F.col("distance")).alias("__order")), k, by)


def _exact(v: np.ndarray, q: np.ndarray, metric: str) -> np.ndarray:
    """The metric of each row of v and the same row of q, added up in order, as metrics.distance does."""
    total = lambda x: np.cumsum(x, axis=1)[:, -1] + 0.0 if x.shape[1] else np.zeros(len(x))
    with np.errstate(all="ignore"):
        if metric == "l2":
            return total((v - q) * (v - q))
        dot = total(v * q)
        if metric == "ip":
            return dot
        vv, qq = total(v * v), total(q * q)
        norm = np.sqrt(vv * qq)
        return np.where((vv == 0) & (qq == 0), 0.0, np.where(norm == 0, 1.0, 1 - dot / np.where(norm == 0, 1, norm)))


def _factors(x: np.ndarray, metric: str, query: bool) -> tuple[np.ndarray, np.ndarray]:
    """Vectors whose dot products are a row's order for a query as the metric has it, and the vectors' squared norms. Zero
    vectors, which cosine sets apart, have a dimension of their own; squares that may not multiply are NaN."""
    square = (x * x).sum(axis=1, keepdims=True)
    one = np.ones_like(square)
    if metric == "l2":
        return np.hstack([-2 * x, one, square] if query else [x, square, one]), square[:, 0]
    if metric == "ip":
        return -x if query else x, square[:, 0]
    zero = square == 0
    x = np.where(zero | (square > 1e-150) & (square < 1e150), x / np.sqrt(np.where(zero, 1, square)), np.nan)
    return np.hstack([-x, -1.0 * zero, one] if query else [x, zero, one]), one[:, 0]


def _pairs(v: np.ndarray, q: np.ndarray, limit: np.ndarray, k: int, metric: str, share: int = 1 << 11) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Row, query and metric of every pair that can be among the best k: in shares, and read with the limits of then. A
    query without a limit gets that of the first share with k rows. Beyond v and q, what is held is one share's."""
    size = max(1, EXACT_VALUES // max(v.shape[1], 1))
    products, far = np.empty(TILE), np.empty(TILE, bool)
    for i in range(0, len(v), share):
        with np.errstate(all="ignore"):
            a, aa = _factors(v[i : i + share], metric, False)
        unbounded = ~np.isfinite(aa)
        widest, step = aa[~unbounded].max(initial=0), max(1, TILE // len(a))
        for j in range(0, len(q), step):
            at = slice(j, j + step)
            with np.errstate(all="ignore"):
                b, bb = _factors(q[at], metric, True)
                pairs = len(a) * len(b)
                near = np.matmul(a, b.T, out=products[:pairs].reshape(len(a), len(b)))
                near[unbounded] = np.nan
                # Far above the rounding of sums of so many terms, in the product and in the exact value.
                slack = (v.shape[1] + 8) * 1e-15 * (widest + bb if metric == "l2" else np.sqrt(widest * bb))
                if k <= len(near) and np.isinf(limit[at]).any():
                    limit[at] = np.fmin(limit[at], np.partition(near, k - 1, axis=0)[k - 1] + slack)
                np.greater(near, limit[at] + slack, out=far[:pairs].reshape(near.shape))
                row, column = np.divmod(np.flatnonzero(~far[:pairs]), len(b))  # NaN too
            for c in range(0, len(row), size):
                r, d = row[c : c + size] + i, column[c : c + size] + j
                yield r, d, _exact(v[r], q[d], metric)


def _matrix(lists: pa.ListArray, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Which lists have dim numbers and no null, and those as a matrix."""
    length = lists.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False)
    flat = lists.flatten()
    values = flat.fill_null(0).to_numpy(zero_copy_only=False)
    start = np.cumsum(np.maximum(length, 0)) - np.maximum(length, 0)
    good = length == dim
    if flat.null_count:
        nulls = np.concatenate([[0], np.cumsum(flat.is_null().to_numpy(zero_copy_only=False))])
        good &= nulls[start + np.maximum(length, 0)] == nulls[start]
    if good.all():
        return good, values.reshape(-1, dim)
    return good, values[start[good][:, None] + np.arange(dim)] if good.any() else np.zeros((0, dim))


class _Best:
    """The best k rows of one task for each query so far: columns query (index), by, distance and __order."""

    def __init__(self, queries: int, k: int, by: list[str]):
        self.k, self.limit, self.held, self.rows = k, np.full(queries, np.inf), [], 0
        self.sort = [("query", "ascending"), ("__order", "ascending"), *((c, "ascending") for c in by)]
        self.most = 2 * queries * k + (1 << 16)

    def add(self, table: pa.Table) -> None:
        self.held.append(table)
        self.rows += table.num_rows
        if self.rows > self.most:
            self.held = [self.taken()]
            self.rows = self.held[0].num_rows

    def taken(self) -> pa.Table:
        table = pa.concat_tables(self.held).sort_by(self.sort)  # empty orders last
        query = table.column("query").to_numpy()
        place = np.arange(len(query)) - np.searchsorted(query, query)
        table, query, place = table.filter(pa.array(place < self.k)), query[place < self.k], place[place < self.k]
        full = place == self.k - 1
        self.limit[query[full]] = table.column("__order").fill_null(np.inf).to_numpy()[full]
        return table


def _all(v: np.ndarray, q: np.ndarray, metric: str) -> np.ndarray:
    """_exact of each query (row) and each vector (column), added up in the same order."""
    total, v = np.zeros((len(q), len(v))), np.ascontiguousarray(v.T)
    with np.errstate(all="ignore"):
        for x, y in zip(v, np.ascontiguousarray(q.T)[:, :, None]):
            part = x - y if metric == "l2" else x * y
            total += part * part if metric == "l2" else part
        if metric != "cosine":
            return total
        vv, qq = (np.cumsum(x * x, axis=0)[-1] for x in (v, q.T))
        norm = np.sqrt(vv * qq[:, None])
        return np.where((vv == 0) & (qq == 0)[:, None], 0.0, np.where(norm == 0, 1.0, 1 - total / np.where(norm == 0, 1, norm)))


def _packed(batches: Iterator[pa.RecordBatch], keys: list[str], vector: str, dim: int, rows: int) -> Iterator[pa.RecordBatch]:
    """Rows in chunks: the lists of their keys and their vectors' bytes, NaN for those of another length or with nulls."""
    for batch in batches:
        get = lambda c: batch.column(batch.schema.get_field_index(c))
        good, some = _matrix(get(vector), dim)
        v = np.full((batch.num_rows, dim), np.nan)
        v[good] = some
        cuts = np.append(np.arange(0, batch.num_rows, rows), batch.num_rows)
        lists = [pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), get(c)) for c in keys]
        yield pa.RecordBatch.from_arrays([*lists, pa.array([v[i : i + rows].tobytes() for i in cuts[:-1]], pa.binary())], names=[*keys, vector])


def _ranked(batches: Iterator[pa.RecordBatch], n: int, dim: int, k: int, metric: str, by: list[str]) -> Iterator[pa.RecordBatch]:
    """The best k rows of each query. batches: each group of queries with all chunks of the n rows, one after another."""
    group, at = None, n
    for batch in batches:
        get = lambda c: batch.column(batch.schema.get_field_index(c))
        for i, g in enumerate(get("__group").to_pylist()):
            if at == n:
                group, at, new, keys = g, 0, [], []
                ids, q = get("query_id")[i].as_py(), np.frombuffer(get("q")[i].as_py()).reshape(-1, dim)
                held = np.empty((len(ids), n))
            elif g != group:
                raise RuntimeError("a group of queries has not met all rows")
            new.append(np.frombuffer(get("v")[i].as_py()).reshape(-1, dim))
            keys.append([get(c)[i].values for c in by])
            done = sum(map(len, new))
            if done * len(ids) >= CHUNK_VALUES * 8 or at + done == n:
                held[:, at : at + done] = _all(np.concatenate(new), q, metric)
                at, new = at + done, []
            if at == n:
                table = pa.table([pa.concat_arrays(x) for x in zip(*keys)], names=by)
                order = pc.sort_indices(table, sort_keys=[(c, "ascending") for c in by])
                table = table.take(order)
                for name, row in zip(ids, held):
                    row = row[order.to_numpy()]
                    best = np.argsort(-row if metric == "ip" else row, kind="stable")[:k]  # NaN last
                    for j in range(0, len(best), 1 << 16):
                        part = best[j : j + (1 << 16)]
                        found = [c.combine_chunks() for c in table.take(pa.array(part)).columns]
                        rank = pa.array(np.arange(j + 1, j + 1 + len(part)), pa.int32())
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(part), name)), rank, *found, pa.array(row[part], mask=np.isnan(row[part]))], names=["query_id", "rank", *by, "distance"])


def _knn_of_all(base: DataFrame, queries: DataFrame, k: int, metric: str, by: list[str], n: int) -> DataFrame | None:
    """As knn_arrow, without a shuffle of pairs. A task holds at most ALL_VALUES distances, or one query's."""
    count, dim = queries.agg(F.count("*"), F.max(F.size("q"))).first()
    if not count or not dim:
        return None
    kind = lambda df, c: f"{c} array<{df.schema[c].dataType.simpleString()}>"
    tasks = min(count, 2 * base.sparkSession.sparkContext.defaultParallelism)
    wide = max(1, min(ALL_VALUES // n, -(-count // tasks)))
    asked = queries.repartition(tasks).mapInArrow(lambda it: _packed(it, ["query_id"], "q", dim, wide), f"{kind(queries, 'query_id')}, q binary")
    chunks = base.select(*by, "v").mapInArrow(lambda it: _packed(it, by, "v", dim, max(1, CHUNK_VALUES // dim)), ", ".join(kind(base, c) for c in by) + ", v binary")
    # One partition on the right: a task reads all chunks, and beyond 4,096 of them holds them in memory that spills.
    met = asked.withColumn("__group", F.monotonically_increasing_id()).crossJoin(chunks.coalesce(1).hint("shuffle_replicate_nl"))
    schema = f"query_id long, rank int, {', '.join(f'{c} {base.schema[c].dataType.simpleString()}' for c in by)}, distance double"
    return met.mapInArrow(lambda it: _ranked(it, n, dim, k, metric, by), schema)


def knn_arrow(base: DataFrame, queries: DataFrame, k: int, metric: str, by: list[str]) -> DataFrame:
    """As knn_expressions, in numpy; vectors of another length than the queries' rank last, as nulls. A task holds its
    best rows, at most queries * k and a batch, and passes them on once."""
    spark, out = base.sparkSession, None
    if HELD_ROWS // k < LEAST_QUERIES and 0 < (n := base.count()) <= 4 * k and (every := _knn_of_all(base, queries, k, metric, by, n)) is not None:
        return every
    schema = "query_id long, " + ", ".join(f"{c} {base.schema[c].dataType.simpleString()}" for c in by) + ", distance double, __order double"
    for block in _blocks(queries, k):
        table = block.toArrow()  # at most BLOCK_VALUES numbers
        ids = table.column("query_id").to_numpy()
        sent = spark.sparkContext.broadcast((ids, np.array(table.column("q").to_pylist(), float).reshape(len(ids), -1 if len(ids) else 0)))

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            ids, q = sent.value
            named = lambda t: t.set_column(0, "query_id", pa.array(ids[t.column("query").to_numpy()])).to_batches(max_chunksize=1 << 16)
            best = _Best(len(q), k, by)
            held = len(ids) * k <= HELD_ROWS

            def pairs(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
                good, v = _matrix(batch.column(batch.schema.get_field_index("v")), q.shape[1])
                at, bad = np.flatnonzero(good), np.flatnonzero(~good)
                for row, column, value in _pairs(v, q, best.limit, k, metric):
                    yield at[row], column, value
                for i in range(0, len(bad), 1 << 10):
                    open_ = np.flatnonzero(np.isinf(best.limit)) if len(bad) else bad
                    for j in range(0, len(open_), TILE >> 10):
                        row, column = (x.ravel() for x in np.meshgrid(bad[i : i + (1 << 10)], open_[j : j + (TILE >> 10)]))
                        yield row, column, np.full(len(row), np.nan)

            for batch in batches if len(ids) else ():
                for row, column, value in pairs(batch):
                    order = np.where(np.isnan(value), np.inf, -value if metric == "ip" else value)
                    on = np.flatnonzero(order <= best.limit[column])  # with all ties
                    row, column, order, d = row[on], column[on], order[on], value[on]
                    empty = np.isnan(d)
                    keep = [batch.column(batch.schema.get_field_index(c)).take(pa.array(row)) for c in by]
                    found = pa.table([pa.array(column), *keep, pa.array(d, mask=empty), pa.array(order, mask=empty)], names=["query", *by, "distance", "__order"])
                    if held:
                        best.add(found)
                    else:  # so many are wanted that holding them saves nothing
                        yield from named(found)
            if best.held:
                yield from named(best.taken())

        found = _best(base.select(*by, "v").mapInArrow(run, schema), k, by)
        out = found if out is None else out.unionByName(found)
    return out


def knn(base: DataFrame, queries: DataFrame, k: int = 10, metric: str = "l2", by: list[str] | None = None, kernel: str = "arrow") -> DataFrame:
    """query_id, rank (from 1), the columns `by` of base and distance: the k best rows of base for each query."""
    if k <= 0:
        raise ValueError("top_k must be positive")
    metric = metrics.canonical(metric)
    run = {"arrow": knn_arrow, "expressions": knn_expressions}[kernel]
    return run(base, queries, k, metric, by or ["row_id"])
