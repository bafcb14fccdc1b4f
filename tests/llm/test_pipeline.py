import hashlib
import re

import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from veclode.llm import queries, toxicity

from .test_dedup import brute_lines
from .test_models import slow_score
from .test_neardup import brute as brute_groups


def test_pipeline_against_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    model = queries.toxicity_model(spark, sf, docs)
    toxic = {r.doc_id for r in toxicity.score(docs, model).where("predicted = 1").select("doc_id").collect()}
    left = sorted((r.doc_id, r.text) for r in docs.select("doc_id", "text").collect() if r.doc_id not in toxic)
    cut = brute_lines(left, 20)
    left = [(i, cut[i]) for i, t in left if cut[i] == t or cut[i].strip()]
    kept = {i for i, _, _, own in brute_groups(left, 5) if own}
    left = [(i, t) for i, t in left if i in kept]
    words = lambda t: re.findall(r"[0-9a-z\x80-\U0010ffff]+", t.lower())
    items = [words(r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]

    def leaks(text):
        own = words(text)
        seen = set(own)
        return any(2 * sum(w in seen for w in x) >= len(x) and slow_score(x, own) >= len(x) for x in items)

    left = [(i, t) for i, t in left if not leaks(t)]
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    want = {i: (library.encode(t, add_special_tokens=False).ids, sha(t)) for i, t in left}
    got = corpus_pipeline.run(spark, sf).collect()
    assert {r.doc_id: (r.ids, r.text_sha256) for r in got} == want and len(got) == len(want)
    assert all(r.n_tokens == len(r.ids) and r.decoded_sha256 == r.text_sha256 for r in got)
    assert 0 < len(want) < docs.count()


@pytest.mark.parametrize("k", range(4))
def test_stages_keep_the_columns(spark, sf, k):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    odd = spark.createDataFrame([(10**6, None, None, None, None), (10**6 + 1, "", "en", "s", 0)], docs.schema)
    name, stage = corpus_pipeline.STAGES[k]
    out = stage(spark, docs.where("doc_id < 40").unionByName(odd), sf)
    assert out.columns == docs.columns and [f.dataType for f in out.schema] == [f.dataType for f in docs.schema]
    assert {10**6, 10**6 + 1} <= {r.doc_id for r in out.collect()}
    assert stage(spark, docs.where("false"), sf).collect() == []


def test_near_duplicates_of_shared_and_null_ids(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    same = " ".join(map(str, range(50)))
    rows = [(None, same), (3, same), (3, same), (3, "else entirely"), (8, "p q r s t u"), (8, "p q r s t u"), (9, ""), (9, ""), (None, "p q r s t u v w x y z"), (None, "p q r s t u v w x y z")]
    out = corpus_pipeline.drop_near_duplicates(spark, spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], docs.schema), sf)
    want = [(None, same), (3, "else entirely"), (8, "p q r s t u"), (9, ""), (9, ""), (None, "p q r s t u v w x y z")]
    assert sorted(map(str, ((r.doc_id, r.text) for r in out.collect()))) == sorted(map(str, want))
