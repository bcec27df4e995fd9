import hashlib

import numpy as np
from tokenizers import Tokenizer

import corpus_pipeline as P
from sketchloom.llm.queries import tokenizer_path
from sketchloom.llm.shared import written


def test_stages(spark, small):
    docs, before = small, small.count()
    for name, stage in P.STAGES[:-1]:
        docs = written(stage(spark, docs, "/root/testdata/sf0.001"), f"test-{name}")
        assert docs.columns == small.columns
        if name != "source_mix":
            assert docs.count() <= before
            before = docs.count()
    library = Tokenizer.from_file(tokenizer_path())
    texts = [(r.doc_id, r.text) for r in docs.collect()]
    got = sorted((r.doc_id, r.n_tokens, r.ids, r.decoded_sha256) for r in P.STAGES[-1][1](spark, docs, "").collect())
    want = []
    for i, t in texts:
        ids = library.encode(t, add_special_tokens=False).ids
        want.append((i, len(ids), ids, hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    assert got == sorted(want)


def test_odd_rows_and_empty(spark, odd_docs, no_docs):
    for docs in (odd_docs, no_docs):
        for name, stage in P.STAGES:
            docs = written(stage(spark, docs, ""), f"test-odd-{name}")
        assert docs.columns == ["doc_id", "n_tokens", "ids", "decoded_sha256"]


def test_run(spark):
    rows = P.run(spark, "/root/testdata/sf0.001").collect()
    assert rows and all(r.n_tokens == len(r.ids) for r in rows)
    assert np.unique([r.doc_id for r in rows]).size <= 200


def test_dedup_keeps_other_texts_of_an_id(spark):
    words = [f"w{i}" for i in range(300)]
    a, near, b = " ".join(words), " ".join([*words[:299], "other"]), " ".join(f"v{i}" for i in range(300))
    schema = "doc_id long, text string"
    docs = spark.createDataFrame([(7, a), (9, a), (7, b), (None, a)], schema)
    want = sorted([(9, a), (7, b), (None, a)], key=str)
    assert sorted(map(tuple, P.exact_copies(spark, docs, "").collect()), key=str) == want
    docs = spark.createDataFrame([(7, a), (5, near), (7, b), (None, a)], schema)
    want = sorted([(5, near), (7, b), (None, a)], key=str)
    assert sorted(map(tuple, P.near_copies(spark, docs, "").collect()), key=str) == want
