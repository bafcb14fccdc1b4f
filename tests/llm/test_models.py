import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from veclode.llm import bytesops as B
from veclode.llm import decontaminate, mixing, queries, toxicity

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


# Toxicity


def test_toxicity_on_held_out_rows(spark):
    """Toxic documents of the held-out fold of sf0.1 are caught; clean ones stay."""
    sf = "/root/testdata/sf0.1"
    got = {r.doc_id: r for r in queries.op10_toxicity(spark, sf).collect()}
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    assert set(got) == set(docs)
    for i, r in got.items():
        assert r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5)
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    held = [i for i in labels if i in got and got[i].held_out]
    y, s = np.array([labels[i] for i in held]), np.array([got[i].score for i in held])
    assert (s[y == 0] >= 0.5).mean() <= 0.02 and (s[y == 1] >= 0.5).mean() >= 0.85
    wins = (s[y == 1][:, None] > s[y == 0][None]).mean() + (s[y == 1][:, None] == s[y == 0][None]).mean() / 2
    assert wins > 0.95
    texts = {}
    for i, t in docs.items():
        assert texts.setdefault(t, got[i].score) == got[i].score


def test_toxicity_without_usable_labels(spark):
    docs = spark.createDataFrame([(1, "you idiot", 9.0), (2, None, 9.0), (2, "", 9.0), (None, "x" * 100_000, 9.0)], "doc_id long, text string, score double")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    out = toxicity.score(docs, toxicity.fit(docs, none))
    assert out.columns == ["doc_id", "text", "score", "predicted"] and {(r.score, r.predicted) for r in out.collect()} == {(0.0, 0)} and out.count() == 4
    one = spark.createDataFrame([(1, 1), (1, None), (None, 0), (77, 0)], "doc_id long, toxic int")
    assert {r.score for r in toxicity.score(docs, toxicity.fit(docs, one)).collect()} == {1.0}
    assert toxicity.score(docs.where("false"), toxicity.fit(docs, one)).collect() == []


def test_features():
    raw = ["YOU total IDIOT!! 1d1ot", "calm words here", "", "Èonai idiot"]
    at = np.cumsum([0, *(len(x.encode()) for x in raw)])
    data = np.frombuffer("".join(raw).encode(), np.uint8)
    word = B.span_hash(B.prefix(np.frombuffer(b"idiot", np.uint8)), np.array([0]), np.array([5]))
    x = {n: c for n, c in zip(toxicity.FEATURES, toxicity.features(data, at, word, np.array([3.0])).T)}
    assert x["hits"].tolist() == [1, 0, 0, 1] and x["address"][0] > 0 and x["address"][3] == 0 and x["disguised"].tolist()[1:] == [0, 0, 0] and x["disguised"][0] > 0
    assert x["shouted"][0] > 0 and x["exclamations"][0] == 2 / len(raw[0]) and x["words"][2] == 0


def test_features_of_a_lexicon_of_unit_hashes():
    """As test_features, whose lexicon goes by the rolling hash that fit no longer uses."""
    raw = ["YOU total IDIOT!! 1d1ot", "calm words here", "", "Èonai idiot"]
    at = np.cumsum([0, *(len(x.encode()) for x in raw)])
    data = np.frombuffer("".join(raw).encode(), np.uint8)
    word = B.unit_hash(np.frombuffer(b"idiot", np.uint8), np.array([0]), np.array([5]))
    x = {n: c for n, c in zip(toxicity.FEATURES, toxicity.features(data, at, word, np.array([3.0])).T)}
    assert x["hits"].tolist() == [1, 0, 0, 1] and x["address"][0] > 0 and x["address"][3] == 0 and x["disguised"].tolist()[1:] == [0, 0, 0] and x["disguised"][0] > 0


# Decontamination


def slow_score(item, text):
    best, row = 0, [0] * (len(text) + 1)
    for w in item:
        new = [0]
        for j, v in enumerate(text):
            new.append(max(0, row[j] + (2 if v == w else -1), row[j + 1] - 1, new[j] - 1))
        best, row = max(best, *new), new
    return best


def test_alignment_against_plain_dynamic_programming():
    rng = np.random.default_rng(1)
    for _ in range(200):
        a, b = (rng.integers(0, 5, rng.integers(1, 15)).astype(np.uint64) for _ in range(2))
        score, end = decontaminate.align(a, b)
        assert score == slow_score(a.tolist(), b.tolist()) and (not score or slow_score(a.tolist(), b[:end].tolist()) == score)


def test_decontamination_against_brute_force(spark, sf):
    words = lambda t: re.findall(r"[0-9a-z\x80-\U0010ffff]+", (t or "").lower())
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()][:120]
    rng = np.random.default_rng(0)
    for k, (_, t) in enumerate(items[:12]):  # edited copies: every eighth word replaced, dropped or doubled
        w = t.split()
        for p in range(int(rng.integers(3, 8)), len(w), 8):
            w[p] = ["", "edited", f"{w[p]} {w[p]}"][k % 3]
        docs.append((10_000 + k, "some words before this " + " ".join(w).upper().lower() + " and after"))
    got = {(r.doc_id, r.m.item_id): r.m for r in decontaminate.decontaminate(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).select("doc_id", F.explode("matches").alias("m")).collect()}
    want = set()
    for d, t in docs:
        tw, grams = words(t), set(words(t))
        for i, it in items:
            iw = words(it)
            if len(iw) >= 3 and 2 * sum(w in grams for w in iw) >= len(iw) and slow_score(iw, tw) >= len(iw):
                want.add((d, i))
    assert set(got) == want and {d for d, _ in want} >= set(range(10_000, 10_012))
    assert all(0.5 <= m.score <= 1 and m.length > 0 for m in got.values())


def test_decontamination_rows(spark):
    items = spark.createDataFrame([(1, "alpha beta gamma delta epsilon"), (1, "alpha beta gamma delta epsilon"), (None, "one two three four"), (3, None), (4, ""), (5, "two words")], "item_id long, text string")
    docs = spark.createDataFrame([(1, "x Alpha, beta. GAMMA delta (epsilon) y", "m"), (1, "one two three four", "m"), (2, None, "m"), (None, "two words", "m"), (6, "alpha beta gamma " * 20000, "m")], "doc_id long, text string, matches string")
    out = decontaminate.decontaminate(docs, items)
    got = {r.text and r.text[:9]: [(m.item_id, m.score, m.start, m.length) for m in r.matches] for r in out.collect()}
    assert got["x Alpha, "] == [(1, 1.0, 1, 5)] * 2 and got["one two t"] == [(None, 1.0, 0, 4)] and got[None] == [] and got["two words"] == [] and len(got["alpha bet"]) == 2
    assert decontaminate.decontaminate(docs.where("false"), items).collect() == []
    assert [r.matches for r in decontaminate.decontaminate(docs, items.where("false")).collect()] == [[]] * 5
    small = decontaminate.decontaminate(docs, items, most_seeds=20)  # several blocks
    assert sorted(str(sorted(map(str, r.matches))) for r in small.collect()) == sorted(str(sorted(map(str, r.matches))) for r in out.collect())


def test_edited_copies_are_found_however_many(spark):
    """Every fifth word replaced, in a thousand documents: fewer than half of the item's trigrams are left in each."""
    item = [f"word{i}" for i in range(40)]
    copies = [(d, " ".join(["before", *(f"other{d}" if i % 5 == 4 else w for i, w in enumerate(item)), "after"])) for d in range(1000)]
    clean = [(1000 + d, f"here word0 word1 word2 and then text {d} of its own") for d in range(50)]
    out = decontaminate.decontaminate(spark.createDataFrame(copies + clean, "doc_id long, text string"), spark.createDataFrame([(1, " ".join(item))], "item_id long, text string"))
    got = {r.doc_id: [(m.item_id, m.score, m.start) for m in r.matches] for r in out.collect()}
    assert all(got[d] == [(1, 57 / 80, 1)] for d in range(1000)) and all(got[1000 + d] == [] for d in range(50))


# Language-model scoring


def tokens(text):
    return [*re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER)), "\n"]


def test_recall_of_edited_copies(spark, sf):
    """Of edited copies that reach the score at all, at least nine in ten are found; figures for each kind of edit."""
    rng = np.random.default_rng(1)
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    edits = {
        "every third word replaced": lambda x: [w if i % 3 else f"zz{i}" for i, w in enumerate(x)],
        "every fifth word replaced": lambda x: [w if i % 5 else f"zz{i}" for i, w in enumerate(x)],
        "a word inserted after every third": lambda x: [z for i, w in enumerate(x) for z in ((w, f"qq{i}") if i % 3 == 2 else (w,))],
        "neighbours exchanged": lambda x: [x[i + 1] if i % 5 == 0 and i + 1 < len(x) else x[i - 1] if i % 5 == 1 else w for i, w in enumerate(x)],
        "six tenths of it": lambda x: x[: -(-len(x) * 6 // 10)],
        "a third of the words replaced at random": lambda x: [w if rng.random() > 0.3 else f"zz{i}" for i, w in enumerate(x)],
    }
    for kind, edit in edits.items():
        docs = [(i, "lead words " + " ".join(edit(t.split())) + " tail") for i, t in items]
        reach = {i for (i, t), (_, d) in zip(items, docs) if slow_score(re.findall(r"\w+", t.lower()), re.findall(r"\w+", d.lower())) >= len(re.findall(r"\w+", t))}
        out = decontaminate.decontaminate(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
        found = {r.doc_id for r in out.collect() if r.doc_id in {m.item_id for m in r.matches}}
        assert len(found & reach) >= 0.9 * len(reach), kind


def test_decontamination_query(spark, sf):
    """op5 against plain alignment of every document with every item."""
    words = lambda t: re.findall(r"[0-9a-z\x80-\U0010ffff]+", (t or "").lower())
    items = {r.item_id: words(r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()}
    docs = {r.doc_id: words(r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    want = {(i, k): slow_score(x, own) for i, own in docs.items() for k, x in items.items() if 2 * sum(w in own for w in x) >= len(x)}
    want = {(i, k): best / (2 * len(items[k])) for (i, k), best in want.items() if best >= len(items[k])}
    got: dict = {}
    for r in queries.op5_benchmark_decontamination(spark, sf).collect():
        got[r.doc_id, r.item_id] = max(got.get((r.doc_id, r.item_id), 0), r.score)
    assert got == want and want


def test_base_score_against_brute_force(spark, sf):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    counts = Counter(w for i, t in docs.items() if zlib.crc32(str(i).encode()) % 7 != 2 for w in tokens(t))
    n, v = sum(counts.values()), len(counts)
    got = queries.op7_lm_scoring(spark, sf).collect()
    assert len(got) == len(docs)
    for r in got:
        own = tokens(docs[r.doc_id])
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 7 == 2)
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(own), sum(w in counts for w in own), n)
        assert math.isclose(r.base_score, sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in own), rel_tol=1e-9)
        assert r.score < 0


def test_bits_form_a_code():
    code = mixing.huffman(np.random.default_rng(0).integers(0, 1000, 256))
    assert math.isclose(sum(2.0 ** -code.length), 1.0)
    words = [b"", b"a", b"ab", b"abc" * 50]
    at = np.cumsum([0, *map(len, words)])
    slots, bit, word = mixing.events(np.frombuffer(b"".join(words), np.uint8), at, np.zeros(4, int), code)
    assert np.bincount(word).tolist() == [int(code.length[list(w + b" ")].sum()) for w in words]
    assert (slots >= mixing.OFFSET[:-1, None]).all() and (slots < mixing.OFFSET[1:, None]).all()


def test_word_probabilities_sum_to_one():
    """Over all words of two letters or less from an alphabet of three, nearly all mass of a model that saw only such words."""
    rng = np.random.default_rng(0)
    model = mixing.Model(mixing.huffman(np.bincount([97, 98, 99, 32], minlength=256) * 1000), np.zeros((2, mixing.SLOTS), np.float32), np.full((mixing.GATES, mixing.INPUTS), 0.3), np.zeros((2, mixing.GATES, mixing.MAP)))
    model.counts[:] = rng.integers(0, 50, model.counts.shape)
    words = [bytes(x) for n in range(1) for x in [b""]] + [bytes([b]) for b in range(256) if b != 32] + [bytes([a, b]) for a in range(256) for b in range(256) if 32 not in (a, b)]
    total = 0.0
    for i in range(0, len(words), 4000):
        part = words[i : i + 4000]
        at = np.cumsum([0, *map(len, part)])
        p = mixing.log10_probability(np.frombuffer(b"".join(part), np.uint8), at, np.zeros(len(part), int), model)
        total += (10.0**p).sum()
    assert 0 < total < 1


def slow_mixer(word: bytes, cls: int, m: mixing.Model, left_out: bool) -> float:
    """log10 probability of a word after a class, bit by bit."""
    at = np.array([0, len(word)])
    slots, bit, _ = mixing.events(np.frombuffer(word, np.uint8), at, np.array([cls]), m.code)
    total = 0.0
    for k, y in enumerate(bit.tolist()):
        seen = [[max(float(m.counts[v][slots[i, k]]) - (left_out and v == y), 0.0) for i in range(len(mixing.BITS))] for v in (0, 1)]
        x = [math.log((one + 0.4) / (zero + 0.4)) for zero, one in zip(*seen)] + [0.3]
        of_word, of_bytes = (min(int(seen[0][i] + seen[1][i]), 299) for i in (4, 2))
        gate = 4 * sum(of_word >= e for e in (1, 2, 4, 16, 256)) + sum(of_bytes >= e for e in (1, 4, 32))
        logit = min(max(sum(a * b for a, b in zip(x, m.weights[gate])), -12), 12)
        slot = min(max(round(logit * 2) + mixing.MAP // 2, 0), mixing.MAP - 1)
        p = 1 / (1 + math.exp(-logit))
        zero, one = m.map[0][gate][slot], m.map[1][gate][slot]
        p = min(max((p + (one + 20 * p) / (zero + one + 20)) / 2, 1e-6), 1 - 1e-6)
        total += math.log10(p if y else 1 - p)
    return total


def test_mixing_against_a_slow_mixer():
    rng = np.random.default_rng(2)
    model = mixing.Model(mixing.huffman(rng.integers(0, 1000, 256)), rng.integers(0, 40, (2, mixing.SLOTS)).astype(np.float32), rng.uniform(0, 0.4, (mixing.GATES, mixing.INPUTS)), rng.integers(0, 50, (2, mixing.GATES, mixing.MAP)).astype(float))
    words = [b"", b"the", b"words", b"a" * 30]
    at, cls, train = np.cumsum([0, *map(len, words)]), np.array([0, 3, 7, 1]), np.array([1, 2, 0, 1])
    both = mixing.log10_probability(np.frombuffer(b"".join(words), np.uint8), at, cls, model, train)
    for i, w in enumerate(words):
        for left_out in (0, 1):
            assert math.isclose(both[left_out][i], slow_mixer(w, int(cls[i]), model, bool(left_out and train[i])), rel_tol=1e-4)


def test_scores_are_probabilities_of_token_sequences(spark):
    """Over all texts of at most two tokens from the training words, the mass stays below one, lines that repeat included."""
    words = ["aa", "ab", "ba", "bb", "aa ab ba bb"]
    train = [i for i in range(400) if zlib.crc32(str(i).encode()) % 7 != 2]
    held = [i for i in range(10**6, 10**6 + 2000) if zlib.crc32(str(i).encode()) % 7 == 2]
    rng = np.random.default_rng(3)
    docs = [(i, "\n".join(rng.choice(words, 3))) for i in train]
    tests = ["", *words[:4], *[f"{a} {b}" for a in words[:4] for b in words[:4]], words[4], *[f"{words[4]} {a}" for a in words[:4]], *[f"{a}\n{words[4]}" for a in words[:4]]]
    df = spark.createDataFrame(docs + list(zip(held, tests)), "doc_id long, text string")
    total = sum(10**r.score for r in mixing.score(df).collect() if r.held_out)
    assert 0.01 < total < 1


def test_scores_are_sums_of_the_mixers_bits(spark, monkeypatch):
    """Known words and copied lines too are scored by the mixed bits alone, and a text's rare tokens meet theirs in a join."""
    models, fit = [], mixing.fit
    monkeypatch.setattr(mixing, "fit", lambda *x: models.append(fit(*x)) or models[-1])
    rng = np.random.default_rng(4)
    docs = {i: "\n".join(" ".join(rng.choice(["one", "two", "three", "Four"], 5)) for _ in range(3)) + f"\nthe same line in all\nrare{i}" for i in range(60)}
    df = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    for frequent in (1 << 20, 3):
        for r in mixing.score(df, frequent=frequent).collect():
            raw = docs[r.doc_id].encode()
            low, start, length, cls, _ = mixing.tokens(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))
            want = sum(slow_mixer(low[a : a + n].tobytes(), int(c), models[-1], not r.held_out) for a, n, c in zip(start, length, cls))
            assert math.isclose(r.score, want, rel_tol=1e-4)


def test_scoring_learns_and_edge_rows(spark):
    rng = np.random.default_rng(0)
    vocabulary = ["".join(rng.choice(list("abcd"), 2)) + "ing" for _ in range(12)]
    fold = lambda i: zlib.crc32(str(i).encode()) % 7 == 2
    other = next(i for i in range(2000, 2100) if fold(i) == fold(1000))
    docs = [(i, " ".join(rng.choice(vocabulary, 40)), "s") for i in range(300)] + [(1000, None, "s"), (other, "", "s"), (None, "abing", "s"), (1002, "new" * 5000, "s"), (1003, "same words in one line", "s"), (1003, "same words in one line", "s")]
    df = spark.createDataFrame(docs, "doc_id long, text string, score string")
    got = mixing.score(df).collect()
    assert len(got) == len(docs)
    rows = {r.doc_id: r for r in got}
    held = [r for r in got if r.held_out and (r.doc_id or 0) < 1000]
    assert sum(r.score for r in held) > 1.3 * sum(r.n_tokens for r in held) * math.log10(1 / 20)
    assert rows[1000].n_tokens == rows[other].n_tokens == 1 and rows[1000].score == rows[other].score and rows[other].bits_per_byte is None
    assert not rows[None].held_out and rows[1002].n_tokens == 2
    assert len({(r.n_tokens, round(r.score, 9)) for r in got if r.doc_id == 1003}) == 1
    assert mixing.score(df.where("false")).collect() == []


@pytest.mark.parametrize("n", [0, 1, 5])
def test_words_never_cross_texts(n):
    texts = ["ab", "", "c d", " e", "F\n"][:n]
    at = np.cumsum([0, *map(len, texts)])
    low, start, end, first = B.words(np.frombuffer("".join(texts).encode(), np.uint8), at)
    found = [bytes(low[a:b]).decode() for a, b in zip(start, end)]
    assert found == [w for t in texts for w in t.lower().split()] and np.diff(first).tolist() == [len(t.split()) for t in texts]
