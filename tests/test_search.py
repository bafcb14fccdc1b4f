import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from veclode import Dataset
from veclode.functions.metrics import ALIASES
from veclode.operators import search
from veclode.plans.inspect import physical, pushed_filters, read_columns


def brute(base, queries, k, metric):
    b, q = base.astype("float32").astype(float), queries.astype("float32").astype(float)
    dots = q @ b.T
    if metric == "ip":
        value, key = dots, -dots
    elif metric == "l2":
        value = key = ((q[:, None] - b[None]) ** 2).sum(-1)
    else:
        n = np.sqrt((q**2).sum(1)[:, None] * (b**2).sum(1)[None])
        value = key = np.where(n == 0, np.where(((q**2).sum(1)[:, None] == 0) & ((b**2).sum(1)[None] == 0), 0.0, 1.0), 1 - dots / np.where(n == 0, 1, n))
    order = np.argsort(np.round(key, 9), axis=1, kind="stable")[:, :k]
    return order, np.take_along_axis(value, order, 1)


@pytest.mark.parametrize("kernel", ["arrow", "expressions"])
@pytest.mark.parametrize("metric", ["l2", "ip", "cosine"])
def test_against_numpy(spark, tmp_path, kernel, metric):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(300, 8)) * rng.uniform(0.1, 5, size=(300, 1))
    base[7] = 0
    base[50] = base[51] = base[52]
    d = Dataset(str(tmp_path / "d"), spark)
    d.write(vdata={"v": base})
    queries = np.concatenate([rng.normal(size=(3, 8)), base[50:51], np.zeros((1, 8))])
    got = d.search_vector("v", queries, 6, metric, kernel).orderBy("query_id", "rank").collect()
    ids, values = brute(base, queries, 6, metric)
    assert [r.row_id for r in got] == ids.ravel().tolist()
    assert np.allclose([r.distance for r in got], values.ravel(), atol=1e-9)
    indices, distances = d.search_arrays("v", queries, 6, metric)
    assert indices.dtype == np.int32 and distances.dtype == np.float32 and np.array_equal(indices, ids)


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.lists(st.integers(-3, 3), min_size=2, max_size=2), min_size=1, max_size=12), st.integers(1, 15))
def test_kernels_agree_on_ties(spark, points, k):
    base = spark.createDataFrame([(i, [float(x) for x in p]) for i, p in enumerate(points)], "row_id long, v array<double>")
    queries = search.query_table(spark, np.array([[0, 1], [2, -2]]))
    runs = [sorted(map(tuple, search.knn(base, queries, k, "l2", kernel=kernel).collect())) for kernel in ("arrow", "expressions")]
    assert runs[0] == runs[1] and len(runs[0]) == 2 * min(k, len(points))


@pytest.mark.parametrize("kernel", ["arrow", "expressions"])
@pytest.mark.parametrize("metric", ["l2", "ip", "cosine"])
def test_unusable_vectors_rank_last(spark, kernel, metric):
    base = spark.createDataFrame([(0, None), (1, [1.0]), (2, [float("nan"), 1.0]), (3, [1.0, 1.0]), (4, [0.5, None])], "row_id long, v array<double>")
    got = search.knn(base, search.query_table(spark, np.array([[1.0, 2.0]])), 5, metric, kernel=kernel).orderBy("rank").collect()
    assert [r.row_id for r in got] == [3, 0, 1, 2, 4]


def test_aliases(spark, tmp_path):
    d = Dataset(str(tmp_path / "d"), spark)
    d.write(vdata={"v": np.eye(3)})
    for alias, name in ALIASES.items():
        a, b = (d.search_vector("v", np.eye(3)[:1], 2, m).orderBy("rank").collect() for m in (alias, name))
        assert a == b


def test_half_precision_nan_counts_as_zero(spark, tmp_path):
    d = Dataset(str(tmp_path / "d"), spark)
    d.write(vdata={"v": np.array([[np.nan, 1], [5, 5]], "float16")})
    assert d.search_vector("v", np.array([[0, 1.0]]), 1).first().distance == 0.0


def test_query_blocks(spark, monkeypatch):
    rng = np.random.default_rng(0)
    base = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(rng.normal(size=(40, 4)))], "row_id long, v array<double>")
    queries = search.query_table(spark, rng.normal(size=(9, 4)))
    whole = sorted(map(tuple, search.knn(base, queries, 3, "l2").collect()))
    monkeypatch.setattr(search, "BLOCK_VALUES", 8)
    assert sorted(map(tuple, search.knn(base, queries, 3, "l2").collect())) == whole


def test_plans(spark, sf, tmp_path):
    import __spark_entry__ as entry

    for name in ("knn_l2", "knn_cosine_expressions"):
        df = entry.queries()[name](spark, sf)
        df.collect()
        assert "WindowGroupLimit" in physical(df) and ["embedding", "__row_id"] in read_columns(df)
    df = entry.queries()["rows_slice"](spark, sf)
    assert any("GreaterThanOrEqual(__row_id,10)" in f for f in pushed_filters(df))
    assert read_columns(entry.queries()["project_one"](spark, sf)) == [["o_totalprice"]]
    d = Dataset(str(tmp_path / "d"), spark)
    d.write({"a": [1, 2], "b": [3, 4]})
    assert read_columns(d["b"]) == [["b"]]


def test_many_queries_give_the_same_values(spark):
    """Two hundred queries, near base rows of large norms: what each gets depends on no other query."""
    rng = np.random.default_rng(5)
    base = 1e4 + rng.normal(scale=0.01, size=(500, 64)).astype("float32")
    df = spark.createDataFrame([(i, [float(y) for y in x]) for i, x in enumerate(base)], "row_id long, v array<double>")
    every = search.query_table(spark, base[:200])
    for metric in ("l2", "ip", "cosine"):
        got = sorted(map(tuple, search.knn(df, every, 3, metric).collect()))
        alone = sorted(map(tuple, search.knn(df, every.where("query_id < 2"), 3, metric).collect()))
        assert got[: len(alone)] == alone
        plain = sorted(map(tuple, search.knn(df, every, 3, metric, kernel="expressions").collect()))
        assert np.allclose([r[3] for r in got], [r[3] for r in plain], rtol=1e-12)
    assert all(r.distance == 0 and r.row_id == r.query_id for r in search.knn(df, every, 1, "l2").collect())


def test_a_search_holds_no_matrix_of_all_queries():
    """What is computed at once is bounded however many queries there are, and few distances are computed at all."""
    rng = np.random.default_rng(2)
    v, q = rng.normal(size=(4096, 8)), rng.normal(size=(3000, 8))
    for metric in ("l2", "ip", "cosine"):
        most, n = 0, 0
        for row, column, value in search._pairs(v, q, np.full(len(q), np.inf), 3, metric):
            most, n = max(most, len(row)), n + len(row)
            assert value.shape == row.shape == column.shape
        assert most * 8 <= search.EXACT_VALUES and len(q) * 3 <= n <= len(q) * 4 * 3 + 100


@pytest.mark.parametrize("metric", ["l2", "ip", "cosine"])
def test_a_share_of_a_search_holds_the_same_for_any_number_of_queries(metric):
    import tracemalloc

    rng = np.random.default_rng(4)
    v, peaks = rng.normal(size=(4096, 64)), []
    for n in (2000, 16000):
        q = rng.normal(size=(n, 64))
        limit = np.full(n, np.inf)
        tracemalloc.start()
        for row, _, _ in search._pairs(v, q, limit, 3, metric):
            assert len(row)
        peaks.append(tracemalloc.get_traced_memory()[1])
        tracemalloc.stop()
    assert peaks[1] < peaks[0] + (1 << 21)  # 16,000 queries alone are 8 MB


@pytest.mark.parametrize("metric", ["l2", "ip"])
def test_an_unusable_row_leaves_the_others_bounds(metric):
    rng = np.random.default_rng(6)
    v, q = rng.normal(size=(2000, 8)), rng.normal(size=(50, 8))
    v[5, 0], v[9, 1] = np.nan, np.inf
    seen = {(r, c): x for row, column, value in search._pairs(v, q, np.full(50, np.inf), 4, metric) for r, c, x in zip(row.tolist(), column.tolist(), value)}
    assert len(seen) <= 50 * (4 + 2)
    exact = ((v[:, None] - q[None]) ** 2).sum(-1) if metric == "l2" else -(v @ q.T)
    exact[[5, 9]] = np.inf
    for c in range(50):
        assert all((r, c) in seen for r in np.argsort(exact[:, c])[:4].tolist())
    assert all((5, c) in seen for c in range(50))


def test_a_search_for_more_rows_than_there_are_passes_on_all_pairs_in_parts():
    import tracemalloc

    rng = np.random.default_rng(7)
    v, peaks = rng.normal(size=(64, 64)), []
    for n in (9000, 27000):  # both more than a share's
        q, found = rng.normal(size=(n, 64)), 0
        tracemalloc.start()
        for row, _, _ in search._pairs(v, q, np.full(n, np.inf), 1_000_000, "l2"):
            found += len(row)
        peaks.append(tracemalloc.get_traced_memory()[1])
        tracemalloc.stop()
        assert found == 64 * n
    assert peaks[1] < peaks[0] + (1 << 21)


@pytest.mark.parametrize("metric", ["l2", "ip", "cosine"])
def test_a_search_for_about_all_rows_shuffles_no_pairs(spark, monkeypatch, metric):
    rng = np.random.default_rng(3)
    v = rng.integers(-2, 3, (700, 5)).astype("float32")  # many ties, zero vectors too
    rows = [(i, x.tolist()) for i, x in enumerate(v)] + [(700, None), (701, [1.0]), (702, [1.0, None, 1.0, 1.0, 1.0]), (703, [float("nan")] * 5)]
    base = spark.createDataFrame(rows, "row_id long, v array<double>").repartition(3)
    queries = search.query_table(spark, v[::20])
    got = search.knn(base, queries, 3000, metric)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" in plan and "Window" not in plan
    got = [tuple(r) for r in got.orderBy("query_id", "rank").collect()]
    monkeypatch.setattr(search, "_knn_of_all", lambda *a: None)
    assert len(got) == 35 * 704 and got == [tuple(r) for r in search.knn(base, queries, 3000, metric).orderBy("query_id", "rank").collect()]
