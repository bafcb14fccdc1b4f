import datetime
import decimal
import os

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest

from veclode import Dataset
from veclode.sources.types import VECTOR_DTYPES


@pytest.fixture
def path(tmp_path):
    return str(tmp_path / "data")


def make(path, spark, rows=12, **vectors):
    d = Dataset(path, spark)
    d.write({"a": list(range(rows)), "b": [f"n{i}" for i in range(rows)]}, vectors or None)
    return d


def vec(n, m, seed=0, dtype="float32"):
    return np.random.default_rng(seed).normal(size=(n, m)).astype(dtype)


def rows(df):
    return [tuple(r) for r in df.collect()]


@pytest.mark.parametrize("form", ["pandas", "dict", "arrow", "spark"])
def test_round_trip_of_each_input(spark, path, form):
    data = {"x": [1, 2, None], "s": ["a", None, "c"], "l": [[1.0, 2.0], [], None]}
    table = pa.table({"x": pa.array(data["x"], pa.int64()), "s": data["s"], "l": data["l"]})
    given = {"pandas": pd.DataFrame(data), "dict": data, "arrow": table, "spark": spark.createDataFrame(table)}[form]
    d = Dataset(path, spark)
    d.write(given)
    assert d.shape == (3, 3) and len(d) == 3
    got = sorted(rows(d.read(["s", "l"]).tdata), key=str)
    assert ("a", [1.0, 2.0]) in got and ("c", None) in got


def test_widened_types(spark, path):
    table = pa.table(
        {
            "u8": pa.array([255], pa.uint8()), "u16": pa.array([65535], pa.uint16()), "u32": pa.array([2**32 - 1], pa.uint32()),
            "u64": pa.array([2**64 - 1], pa.uint64()), "f16": pa.array([np.float16(1.5)], pa.float16()), "d64": pa.array([datetime.date(2020, 1, 2)], pa.date64()),
            "lu": pa.array([[1, None]], pa.list_(pa.uint32())), "ts": pa.array([datetime.datetime(2020, 1, 1)], pa.timestamp("us")),
            "dec": pa.array([decimal.Decimal("1.20")], pa.decimal128(5, 2)), "st": pa.array([{"p": 1}], pa.struct([("p", pa.uint8())])), "bin": pa.array([b"\0x"], pa.binary()), "ok": [True],
        }
    )
    d = Dataset(path, spark)
    d.write(table)
    r = d.read().tdata.first()
    assert (r.u8, r.u16, r.u32, int(r.u64), r.f16, r.d64, r.lu) == (255, 65535, 2**32 - 1, 2**64 - 1, 1.5, datetime.date(2020, 1, 2), [1, None])
    assert r.dec == decimal.Decimal("1.20") and r.st.p == 1 and bytes(r.bin) == b"\0x" and r.ok
    assert d.list_columns()["u64"] == {"dtype": "uint64", "kind": "table"}


@pytest.mark.parametrize("dtype", VECTOR_DTYPES)
def test_vector_dtypes(spark, path, dtype):
    array = (np.arange(12).reshape(3, 4) % 2 if dtype == "bool" else np.arange(12).reshape(3, 4)).astype(dtype)
    d = make(path, spark, 3, v=array)
    got = [r.v for r in d.read("v").vdata.orderBy("row_id").collect()]
    assert np.array_equal(np.array(got, float), array.astype(float))
    assert d.get_vec_shape("v") == [3, 4] and d.list_columns()["v"] == {"dtype": dtype, "kind": "vector"}
    assert d.search_vector("v", array[1:2].astype(float), 1).first().row_id in (1, 0 if dtype == "bool" else 1)


def test_strided_and_3d(spark, path):
    base = vec(4, 5)
    d = make(path, spark, 5, t=base.T, c=np.arange(30).reshape(5, 2, 3).astype("float32"))
    assert np.allclose([r.t for r in d.read("t").vdata.orderBy("row_id").collect()], base.T)
    near = d.search_vector("c", np.array([[3, 4, 5.0]]), 1).first()
    assert (near.row_id, near.sub_id, near.distance) == (0, 1, 0.0)
    assert d.search_vector("c", np.arange(6, 12)[None], 1).first().row_id == 1
    with pytest.raises(ValueError):
        d.search_vector("c", np.ones((1, 4)))


def test_views(spark, path):
    d = make(path, spark, 4, e=vec(4, 2), f=vec(4, 3))
    view = d.read()
    assert view.columns_list == ["a", "b", "e", "f"] and set(view.vdata) == {"e", "f"} and view.tdata.columns == ["a", "b"]
    assert isinstance(view.all_entries, tuple) and view.tdata is view.tdata
    assert d.read("e").vdata.columns == ["row_id", "e"] and list(d.read("e").all_entries) == ["e"] and d.read("e").tdata is None
    assert d["b"].columns == ["b"] and d[["b", "a"]].columns == ["b", "a"] and list(d["e"]) == ["e"]
    both = d.read(["f", "a"]).all_entries
    assert both[0].columns == ["a"] and list(both[1]) == ["f"]
    plain = make(path + "2", spark)
    assert plain.read().all_entries[1] is None and plain.read().vdata is None


def test_positions(spark, path):
    d = make(path, spark, 20, e=vec(20, 2))
    assert rows(d.read_rows([5, 3, 5]).select("a")) == [(3,), (5,)]
    table, vectors = d[[7, 2, 2]]
    assert rows(table.select("a")) == [(2,), (7,)] and [r.row_id for r in vectors["e"].collect()] == [2, 7]
    assert rows(d[4][0].select("a")) == [(4,)]
    assert rows(d[np.array([1, 0])][0].select("a")) == [(0,), (1,)]
    for s in (slice(2, 9, 3), slice(None, None, None), slice(-3, None), slice(50, 60), slice(9, 2, -2), slice(None, None, -1)):
        assert [r.a for r in d[s][0].collect()] == list(range(20))[s]
    assert make(path + "n", spark)[1][1] == {}
    for bad in (-1, 20, [0, 20]):
        with pytest.raises(IndexError, match="out of bounds"):
            d[bad]
    with pytest.raises(ValueError, match="row_indices cannot be empty"):
        d.read_rows([])
    for bad in ((1, 2), [1, "a"], 1.5, None, True):
        with pytest.raises(ValueError):
            d[bad]


def test_long_position_lists_join(spark, path):
    d = Dataset(path, spark)
    d.write(spark.range(5000).repartition(3))
    ids = [r.id for r in d.read_rows(range(0, 5000, 2)).collect()]
    assert len(ids) == len(set(ids)) == 2500


def test_append(spark, path):
    d = make(path, spark, 4, e=vec(4, 2), f=vec(4, 3))
    d.append({"a": [4, 5], "b": ["x", None]}, {"e": vec(2, 2, 1), "f": vec(2, 3, 1)})
    d.append({"a": [6], "b": ["z"]}, {"e": vec(1, 2, 2), "f": vec(1, 3, 2)})
    assert d.shape == (7, 2) and d.get_vec_shape("f") == [7, 3]
    table, vectors = d[[6, 5]]
    assert rows(table) == [(5, None), (6, "z")]
    assert np.allclose([r.f for r in vectors["f"].collect()], np.concatenate([vec(2, 3, 1)[1:], vec(1, 3, 2)]))
    fresh = Dataset(path + "2", spark)
    fresh.append({"a": [1]})  # a missing dataset is written
    assert len(fresh) == 1
    for bad, what in (({"a": ["s"]}, "Schema"), ({"c": [1]}, "Schema")):
        with pytest.raises(ValueError, match=what):
            fresh.append(bad)
    for bad in ({"e": vec(1, 2)}, {"e": vec(1, 2), "g": vec(1, 3)}, {"e": vec(1, 2), "f": vec(1, 3, dtype="float64")}, {"e": vec(1, 3), "f": vec(1, 3)}):
        with pytest.raises(ValueError):
            d.append(vdata=bad)
    assert d.shape == (7, 2)


def test_overwrite_and_vectors_alone(spark, path):
    d = make(path, spark, 4, e=vec(4, 2))
    d.write(vdata={"e": vec(4, 5), "g": vec(4, 1)})  # replaces and adds
    assert d.list_vectors() == ["e", "g"] and d.get_vec_shape("e") == [4, 5]
    d.write({"a": [1]})
    assert d.shape == (1, 1) and d.list_vectors() == []
    only = Dataset(path + "v", spark)
    only.write(vdata={"e": vec(3, 2)})
    assert only.shape == (3, 0) and only.read().tdata is None and only.read("e").vdata.count() == 3


def test_errors_lose_nothing(spark, path):
    d = make(path, spark, 4)
    for args, what in (
        ((None, None), "Both tdata and vdata"), (([1],), "Unsupported input type: list"), (({"a": []},), "Empty table"), ((None, [1]), "vdata must be a dictionary"),
        ((None, {"e": [1]}), "Input must be a numpy array"), ((None, {"e": np.array([["a"]])}), "Unsupported dtype"), ((None, {"e": np.ones(4)}), "2D or 3D"), ((None, {"e": np.ones((5, 2))}), "First dimension"),
        ((spark.range(0),), "Empty table"),
    ):
        with pytest.raises(ValueError, match=what):
            d.write(*args)
    assert d.shape == (4, 2)
    with pytest.raises(ValueError, match="Both"):
        d.append()
    with pytest.raises(FileNotFoundError, match="File does not exist"):
        Dataset(path + "none", spark).read()
    assert Dataset(path + "none", spark).shape == (0, 0)
    for bad in (("a", "b"), 3, [1]):
        with pytest.raises(ValueError, match="columns must be"):
            d.read(bad)
    with pytest.raises(ValueError, match="Column 'zz' not found"):
        d.read("zz")
    with pytest.raises(ValueError, match="No vector data"):
        d.get_vec_shape("e")
    d.write(vdata={"e": vec(4, 2)})
    with pytest.raises(ValueError, match="Vector 'x' not found"):
        d.search_vector("x", np.ones((1, 2)))
    for bad in ({"metric": "hamming"}, {"top_k": 0}, {"top_k": -1}):
        with pytest.raises(ValueError):
            d.search_vector("e", np.ones((1, 2)), **bad)
    with pytest.raises(ValueError):
        d.search_vector("e", np.ones(2))


def test_corrupt_manifest(spark, path):
    d = make(path, spark, 2)
    os.remove(f"{path}/.manifest.json.crc")
    with open(f"{path}/manifest.json", "w") as f:
        f.write('{"format": 9}')
    with pytest.raises(ValueError, match="Invalid manifest"):
        d.read()


def test_stream_appends(spark, path, tmp_path):
    from veclode.streaming.append import append_stream

    source = str(tmp_path / "in")
    spark.range(5).write.parquet(source)
    stream = spark.readStream.schema("id long").parquet(source)
    q = append_stream(stream, path, str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(r.id for r in Dataset(path, spark).read().tdata.collect()) == [0, 1, 2, 3, 4]


def test_old_versions_stay_until_vacuum(spark, path):
    d = Dataset(path, spark)
    d.write({"a": [1, 2]}, {"e": np.eye(2)})
    old = d.read()
    table, vector = old.tdata, old.vdata
    d.write({"a": [7]})
    assert [r.a for r in table.orderBy("a").collect()] == [1, 2] and vector.count() == 2
    d.vacuum()
    assert [r.a for r in d.read().tdata.collect()] == [7] and len(d._store.listed()) == 1


def test_appended_vectors_match_the_rows(spark, path):
    d = Dataset(path, spark)
    d.write({"a": [1, 2]}, {"e": np.eye(2)})
    for table, vectors in (({"a": [3]}, 5), (None, 1), (spark.createDataFrame([(3,)], "a long"), 2)):
        with pytest.raises(ValueError, match="First dimension"):
            d.append(table, {"e": np.ones((vectors, 2))})
    assert d.shape == (2, 1) and d.read("e").vdata.count() == 2
    d.append({"a": [3]})
    d.append(vdata={"e": np.ones((1, 2))})
    assert d.shape == (3, 1) and d.get_vec_shape("e") == [3, 2]


def test_vectors_from_columns(spark, path):
    rows = spark.createDataFrame([(i, [float(i), 1.0], "x") for i in range(5)], "k long, v array<float>, s string").orderBy("k")
    d = Dataset(path, spark)
    d.write(rows, {"e": "v"})
    d.append(rows, {"e": "v"})
    assert d.shape == (10, 2) and d.get_vec_shape("e") == [10, 2] and d.list_columns()["e"]["dtype"] == "float32"
    assert [(r.row_id, r.e) for r in d.read("e").vdata.orderBy("row_id").collect()] == [(i, [float(i % 5), 1.0]) for i in range(10)]
    ragged = spark.createDataFrame([(1, [1.0]), (2, [1.0, 2.0])], "k long, v array<double>")
    with pytest.raises(ValueError, match="differ in size"):
        Dataset(path + "2", spark).write(ragged, {"e": "v"})
    with pytest.raises(ValueError, match="not found"):
        d.write(rows, {"e": "none"})


def test_a_batch_delivered_again_changes_nothing(spark, path):
    d = Dataset(path, spark)
    for number in (0, 1, 1, 0):
        d.append({"a": [number]}, once=("s", number))
    d.append({"a": [9]}, once=("t", 0))
    assert sorted(r.a for r in d.read().tdata.collect()) == [0, 1, 9]
