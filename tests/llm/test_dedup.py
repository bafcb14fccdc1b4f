import hashlib
import os
import random
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from veclode.llm import lines, queries, suffixes
from veclode.plans import inspect


def canonical(df):
    df = df[sorted(df.columns)]
    return sorted(map(repr, df.itertuples(index=False, name=None)))


@pytest.mark.parametrize("name", ["op2_substring_dedup", "op3_line_dedup"])
def test_lines_against_sql(spark, sf, name):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    got, want = queries.QUERIES[name](spark, sf).toPandas(), con.sql(queries.SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns) and canonical(got) == canonical(want)


def brute_lines(docs, least):
    """Lines in runs of at least `least` words that also occur earlier."""
    parts = [(i, (t or "").split("\n")) for i, t in docs]
    gone = [set() for _ in docs]
    for d, (_, own) in enumerate(parts):
        for e in range(d + 1):
            other = parts[e][1]
            for i in range(len(own)):
                for j in range(len(other)):
                    if e == d and j >= i:
                        continue
                    n = 0
                    while i + n < len(own) and j + n < len(other) and own[i + n] == other[j + n]:
                        n += 1
                    if n and sum(len(x.split()) for x in own[i : i + n]) >= least:
                        gone[d].update(range(i, i + n))
    return {i: "\n".join(x for k, x in enumerate(own) if k not in gone[d]) if gone[d] else "\n".join(own) for d, (i, own) in enumerate(parts)}


def test_line_runs_against_brute_force(spark):
    rng = random.Random(3)
    pool = [" ".join(f"w{rng.randrange(99)}" for _ in range(n)) for n in (0, 1, 1, 2, 3, 4, 7, 12)]
    docs = [(i, "\n".join(rng.choice(pool) for _ in range(rng.randint(0, 12)))) for i in range(40)]
    got = {r.doc_id: r.text for r in lines.line_dedup(spark.createDataFrame(docs, "doc_id long, text string"), min_words=8).collect()}
    assert got == brute_lines(docs, 8)


def test_line_rows(spark):
    long = "one two three four five six seven eight"
    rows = [(1, f"{long}\nx", "p"), (2, f"a\n{long}", "q"), (2, f"a\n{long}", "q"), (None, long, "n"), (3, None, None), (4, "", ""), (5, "\n" * 3000 + long, "l")]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_removed string")
    for dedup in (lines.substring_dedup, lines.line_dedup):
        out = sorted((tuple(r) for r in dedup(df, min_words=8).select("doc_id", "text", "n_units", "n_removed").collect()), key=str)
        assert out == sorted([(1, "x", 2, 1), (2, "a", 2, 1), (2, "a", 2, 1), (None, long, 1, 0), (3, None, 1, 0), (4, "", 1, 0), (5, "\n" * 2999, 3001, 1)], key=str)
        assert dedup(df.where("false")).collect() == []
    spans = lines.substring_dedup(df, min_words=8).where("doc_id = 2").first().removed_spans
    assert [tuple(s) for s in spans] == [(2, len(long))]


def test_line_runs_of_repeated_rows_and_null_ids(spark):
    """Runs of several lines: rows that repeat, rows without an id, texts that share an id."""
    run = "\n".join(f"a{i} b c" for i in range(16))
    pairs = [f"{w} one two three\n{w} four five six" for w in "pq"]
    mixed = pairs[0].split("\n")[0] + "\n" + pairs[1].split("\n")[1]
    rows = [(1, run)] * 30 + [(2, f"x\n{run}")] * 30 + [(None, pairs[0]), (None, pairs[1]), (7, pairs[0]), (8, pairs[1]), (9, mixed), (None, f"{run}\ny"), (10, None)]
    out = lines.line_dedup(spark.createDataFrame(rows, "doc_id long, text string"), min_words=8)
    want = [(1, "")] * 30 + [(2, "x")] * 30 + [(None, pairs[0]), (None, pairs[1]), (7, ""), (8, ""), (9, mixed), (None, f"{run}\ny"), (10, None)]
    assert sorted(map(str, ((r.doc_id, r.text) for r in out.collect()))) == sorted(map(str, want))
    twice = [(None, f"{pairs[0]}\nz\n{pairs[0]}")]
    assert [r.text for r in lines.line_dedup(spark.createDataFrame(twice, "doc_id long, text string"), min_words=8).collect()] == [f"{pairs[0]}\nz"]


def test_line_runs_of_many_levels_in_small_plans(spark):
    """Each level is written: the last plan has one join, the rows' own, however long the runs are."""
    text = "\n".join(f"w{i}" for i in range(20))
    out = lines.line_dedup(spark.createDataFrame([(1, text), (2, text + "\nend"), (3, "w5\nw6")], "doc_id long, text string"))
    assert inspect.physical(out).split("Initial Plan")[0].count("Join") == 1
    assert {r.doc_id: (r.n_removed, r.text) for r in out.collect()} == {1: (0, text), 2: (20, "end"), 3: (0, "w5\nw6")}


def test_paragraphs_and_normal_form(spark):
    df = spark.createDataFrame([(1, "A b  c d e.\n\nfirst"), (2, "x\n\n a B c\td E. \n\ny")], "doc_id long, text string")
    out = {r.doc_id: r.text for r in lines.substring_dedup(df, unit="paragraph").collect()}
    assert out == {1: "A b  c d e.\n\nfirst", 2: "x\n\ny"}


def brute_bytes(texts, length):
    raw = [(t or "").encode() for t in texts]
    count = Counter(x[i : i + length] for x in raw for i in range(len(x) - length + 1))
    out = []
    for x in raw:
        gone = np.zeros(len(x) + 1, int)
        for i in range(len(x) - length + 1):
            if count[x[i : i + length]] > 1:
                gone[i] += 1
                gone[min(i + length, len(x))] -= 1
        cover = np.cumsum(gone)[:-1] > 0
        spans = int(np.count_nonzero(np.diff(np.concatenate([[0], cover.astype(int)])) == 1))
        out.append((len(x), int(cover.sum()), spans, bytes(np.frombuffer(x, np.uint8)[~cover])))
    return out


def run_suffixes(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: (r.n_bytes, r.n_removed, len(r.removed), bytes(r.kept)) for r in suffixes.suffix_dedup(df).collect()}
    return [got[i] for i in range(len(texts))]


def test_suffixes_against_brute_force(spark):
    rng = random.Random(2)
    some = lambda n: "".join(rng.choice("abcdefghijk é日") for _ in range(n))
    common = [some(n) for n in (150, 199, 200, 201, 260, 700)]
    texts = []
    for _ in range(60):
        text = some(rng.randint(0, 400))
        for _ in range(rng.randint(0, 3)):
            part = rng.choice(common)
            a = rng.randint(0, 40)
            text += part[a : len(part) - rng.randint(0, 40)] + some(rng.randint(0, 60))
        texts.append(text)
    texts += [texts[3], texts[3], "z" * 199, "z" * 199, "y" * 200, "y" * 201, "x" * 1000, "ab" * 300, ("ab" * 300)[1:], None, "", some(90) * 5]
    assert run_suffixes(spark, texts) == brute_bytes(texts, 200)


def test_suffixes_across_many_buckets(spark, monkeypatch):
    """A passage with a hundred different surroundings, in buckets of a few suffixes each."""
    rng = random.Random(4)
    some = lambda n: "".join(rng.choice("abcdefgh") for _ in range(n))
    passage = some(230)
    texts = [some(rng.randint(0, 150)) + passage + some(rng.randint(0, 150)) for _ in range(100)]
    plain = suffixes.repeated_bytes
    monkeypatch.setattr(suffixes, "repeated_bytes", lambda rows, length: plain(rows, length, bucket_bytes=3000))
    assert run_suffixes(spark, texts) == brute_bytes(texts, 200)


def test_suffix_query_and_rows(spark, sf):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    want = {i: b for (i, _), b in zip(docs, brute_bytes([t for _, t in docs], 200))}
    got = queries.op1_suffix_array_dedup(spark, sf).collect()
    assert len(got) == len(docs)
    assert all((r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == (*want[r.doc_id][:3], hashlib.sha256(want[r.doc_id][3]).hexdigest()) for r in got)
    df = spark.createDataFrame([(1, "q" * 50 + str(list(range(99))), "k"), (1, "q" * 50 + str(list(range(99))), "k"), (None, None, "k")], "doc_id long, text string, kept string")
    assert sorted((r.n_removed, len(r.kept)) for r in suffixes.suffix_dedup(df).collect()) == [(0, 0), (len("q" * 50 + str(list(range(99)))), 0), (len("q" * 50 + str(list(range(99)))), 0)]
    assert suffixes.suffix_dedup(df.where("false")).collect() == []


def test_columns_of_any_name(spark, sf):
    """Names with dots, backticks and leading underscores pass through every operator that keeps columns."""
    import public_tokenizers

    from veclode.llm import audio, bpe, decontaminate, toxicity

    df = spark.createDataFrame([(1, "a b c d e f", 7, 8, 9, 10)] * 2, ["doc_id", "text", "a.b", "__id", "c`d", "units"])
    items = spark.createDataFrame([(1, "x y z w")], "item_id long, text string")
    runs = [
        lambda d: lines.substring_dedup(d), lambda d: lines.line_dedup(d, min_words=3), lambda d: decontaminate.decontaminate(d, items), lambda d: audio.decode_media(audio.encode_media(d)),
        lambda d: bpe.round_trip(d, public_tokenizers.path("byte_bpe_50k.json")), lambda d: toxicity.score(d, toxicity.Model(np.zeros(0, np.uint64), np.zeros(0), None, None, 0.5)), lambda d: toxicity.with_features(d, np.zeros(0, np.uint64), np.zeros(0)),
    ]
    for run in runs:
        assert {tuple(r[c] for c in ("a.b", "__id", "c`d", "units")) for r in run(df).collect()} == {(7, 8, 9, 10)}


@pytest.mark.parametrize("cut", ["parallelize", "repartition", "join", "union"])
def test_suffixes_of_any_input(spark, sf, tmp_path, cut):
    """Inputs whose rows come in another order or other partitions each time they are read, with more columns."""
    docs = spark.read.parquet(f"{sf}/documents.parquet").where("doc_id < 60").select("doc_id", "text", F.lit("x").alias("a.b"), F.lit(1).alias("__row"), F.repeat(F.lit("wide"), F.lit(50)).alias("row"))
    if cut == "parallelize":
        docs = spark.createDataFrame(spark.sparkContext.parallelize(docs.collect(), 7), docs.schema)
    elif cut == "repartition":
        docs = docs.repartition(5, "row").repartition(3)
    elif cut == "join":
        docs = docs.join(spark.range(60).withColumnRenamed("id", "doc_id"), "doc_id")
    else:
        docs = docs.where("doc_id % 2 = 0").unionByName(docs.where("doc_id % 2 = 1"))
    texts = sorted((r.doc_id, r.text) for r in docs.select("doc_id", "text").collect())
    want = {i: b for (i, _), b in zip(texts, brute_bytes([t for _, t in texts], 200))}
    out = suffixes.suffix_dedup(docs)
    assert out.columns == ["doc_id", "a.b", "__row", "row", "kept", "n_bytes", "n_removed", "removed"]
    got = out.collect()
    assert {r.doc_id: (r.n_bytes, r.n_removed, len(r.removed), bytes(r.kept)) for r in got} == want and len(got) == len(want)
    assert {(r["a.b"], r["__row"], r["row"]) for r in got} == {("x", 1, "wide" * 50)}


def test_suffixes_of_colliding_strings(spark):
    """Two strings that a polynomial modulo 2^64 takes for one, as passages, lines, words and copies."""
    one = "".join("ab"[bin(i).count("1") % 2] for i in range(1024))
    two = one.translate(str.maketrans("ab", "ba"))
    texts = [one, two, "x" + two]
    assert run_suffixes(spark, texts) == brute_bytes(texts, 200)
    rows = spark.createDataFrame([(1, f"{one} a b c d e f g h"), (2, f"{two} a b c d e f g h")], "doc_id long, text string")
    for dedup in (lines.line_dedup, lines.substring_dedup):
        assert [r.n_removed for r in dedup(rows, min_words=5).collect()] == [0, 0]


def test_sorted_prefixes():
    rng = random.Random(1)
    raw = [bytes(rng.choice(b"ab") for _ in range(rng.randint(0, 20))) for _ in range(200)] + [b"ab" * 12] * 3
    parts = np.zeros((len(raw), 24), np.uint8)
    for i, x in enumerate(raw):
        parts[i, : len(x)] = list(x)
    order, shared = suffixes.sorted_prefixes(parts, np.array([len(x) for x in raw]))
    assert [raw[i] for i in order] == sorted(raw)
    assert shared.tolist() == [0] + [len(os.path.commonprefix([raw[i], raw[j]])) for i, j in zip(order, order[1:])]


def test_multikey_order():
    rng = np.random.default_rng(0)
    for n in (0, 1, 2, 500):
        keys = [rng.integers(0, 6, n).astype(np.uint64) for _ in range(3)]
        order = suffixes.multikey_order(keys)
        rows = list(zip(*(k[order].tolist() for k in keys)))
        assert rows == sorted(zip(*(k.tolist() for k in keys))) and sorted(order.tolist()) == list(range(n))
