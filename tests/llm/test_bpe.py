import hashlib
import random

import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from veclode.llm import bpe, queries

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def check(library, texts):
    a = bpe.automaton(PATH)
    ids, at = a.encode(texts)
    assert [ids[i:j].tolist() for i, j in zip(at, at[1:])] == [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    assert bpe._texts(*a.decode(ids, at)).to_pylist() == texts


def test_fixed_texts(library):
    check(library, ["", "a", " ", "  a", "a  b\n\n c \n", "don't we'll 'stop ''s 's's x", "<|endoftext|>", "x<|endoftext|>y <|endoftext|><|endoftext|> 's", "a" * 5000, " x\x1c\x1dy\x85z\xa0\n\t 12３ Ⅷ é́ 日本語 🙂🙂 'LL\r\n  ", "\n", " \n x", "I'VE i'vevery 're're"])
    check(library, [])


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(st.characters(exclude_categories=["Cs"]), max_size=40), max_size=5))
def test_any_text(library, texts):
    check(library, texts)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text("ab's TlrevdĠ\n\t 1é<|>endoftext", max_size=60), min_size=1, max_size=8))
def test_awkward_text(library, texts):
    check(library, texts)


def test_long_and_colliding_words(library):
    """Long words without a split, and two words that a polynomial modulo 2^64 takes for one."""
    import time

    doubling = "".join("ab"[bin(i).count("1") % 2] for i in range(1024))
    rng = random.Random(1)
    check(library, [doubling, doubling.translate(str.maketrans("ab", "ba"))])
    for word in ("-" * 20_000, "a" * 20_000, "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(100_000)), "日本語" * 5_000):
        began = time.perf_counter()
        check(library, [word])
        assert time.perf_counter() - began < 10


def test_arcs_are_those_of_the_library(library):
    """The compiled table and the walk back agree with each other, and an arc is there just if the library reads both tokens so."""
    import numpy as np

    a = bpe.automaton(PATH)
    core = np.flatnonzero(a.core >= 0)
    rng = np.random.default_rng(0)
    s, t = rng.choice(core, 20_000), rng.choice(core, 20_000)
    assert np.array_equal(a.follow[a.core[s], a.core[t]], a.walked(s, t)) and 0 < a.walked(s, t).mean() < 1
    letters = [i for i in range(50257) if (x := library.id_to_token(i)) and x.isascii() and x.isalpha()]
    s, t = rng.choice(letters, 3_000), rng.choice(letters, 3_000)
    want = [library.encode(library.id_to_token(x) + library.id_to_token(y), add_special_tokens=False).ids == [x, y] for x, y in zip(s.tolist(), t.tolist())]
    assert a.arcs(s, t).tolist() == want


def test_decoding_any_ids(library):
    a = bpe.automaton(PATH)
    rng = random.Random(0)
    import numpy as np

    lists = [[rng.randrange(50257) for _ in range(rng.randint(0, 20))] for _ in range(200)]
    at = np.cumsum([0, *map(len, lists)])
    assert bpe._texts(*a.decode(np.array(sum(lists, [])), at)).to_pylist() == [library.decode(x, skip_special_tokens=False) for x in lists]
    assert bpe._texts(*a.decode(np.array([5, -1, 10**6]), np.array([0, 3]))).to_pylist() == [library.decode([5])]


def test_rows(spark):
    df = spark.createDataFrame([(1, None, [0]), (2, "", [1]), (3, "x y", None), (3, "x y", None)], "doc_id long, text string, IDS array<int>")
    out = bpe.round_trip(df, PATH)
    assert out.columns == ["doc_id", "text", "ids", "decoded"]
    assert [(r.doc_id, r.ids, r.decoded) for r in out.collect()] == [(1, [], ""), (2, [], ""), (3, [87, 331], "x y"), (3, [87, 331], "x y")]
    assert [r.decoded for r in bpe.decode(bpe.encode(df, PATH), PATH).collect()] == ["", "", "x y", "x y"]
    assert bpe.round_trip(df.where("false"), PATH).collect() == []


def test_query(spark, sf, library):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    got = queries.op6_bpe_round_trip(spark, sf).collect()
    assert len(got) == len(texts)
    for r in got:
        ids = library.encode(texts[r.doc_id], add_special_tokens=False).ids
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), sha(",".join(map(str, ids))), sha(texts[r.doc_id]))
