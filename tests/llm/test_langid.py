import re
import zlib

import numpy as np

from sketchloom.llm import langid as L
from sketchloom.llm.queries import queries


def test_gradients_match_differences():
    model = L.ByteGru.fresh(["a", "b", "c"])
    rng = np.random.default_rng(0)
    x, y = rng.integers(0, 256, (6, 5)).astype(np.uint8), rng.integers(0, 3, 6)
    model.p = {k: v.astype(np.float64) for k, v in model.p.items()}

    def loss():
        probs = model.forward(x)[0]
        return -np.log(probs[:, np.arange(6), y]).mean()

    grads = model.gradients(x, y)
    for name, values in model.p.items():
        places = np.argwhere(np.abs(grads[name]) > 1e-4)[:4]
        for at in map(tuple, places):
            keep, eps = values[at], 1e-3
            values[at] = keep + eps
            up = loss()
            values[at] = keep - eps
            down = loss()
            values[at] = keep
            assert abs((up - down) / (2 * eps) - grads[name][at]) < 1e-3 + 0.02 * abs(grads[name][at])


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    found = L.identify(docs, L.fit_languages(docs)).join(docs.select("doc_id", "lang"), "doc_id").toPandas()
    held = found[found.held_out]
    assert len(held) > 150
    assert (held.lang == held.lang_pred).mean() > 0.97
    assert found.score.between(0, 1).all()


def many_languages(spark):
    """Fifteen invented languages, each with letters of its own, from 4,000 documents down to a few."""
    rng = np.random.default_rng(7)
    rows, ident = [], 0
    for k in range(15):
        letters = list("abcdefghijklmnopqrstuvwxyz"[k : k + 4]) + [chr(0x430 + 2 * k), chr(0x431 + 2 * k)]
        words = ["".join(rng.choice(letters, rng.integers(3, 9))) for _ in range(60)]
        for _ in range(max(12, 4000 >> k)):
            rows.append((ident, " ".join(rng.choice(words, 12)), f"l{k:02d}", "x"))
            ident += 1
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, _id string")


def test_fifteen_languages_of_unequal_size(spark, monkeypatch):
    docs = many_languages(spark)
    picked = L.training_ids(docs, "doc_id", "lang").withColumnRenamed("_id", "i")
    found = docs.join(picked, docs["doc_id"] == picked["i"]).groupBy("lang").count().collect()
    assert len(found) == 15 and max(r["count"] for r in found) == L.DOCS_PER_LANG and sum(r["count"] for r in found) <= L.MAX_DOCS
    rows = L.identify(docs, L.fit_languages(docs)).join(docs.select("doc_id", "lang"), "doc_id").toPandas()
    held = rows[rows.held_out]
    right = (held.lang == held.lang_pred).groupby(held.lang).mean()
    assert len(right) == 15 and right.mean() > 0.9
    monkeypatch.setattr(L, "MAX_DOCS", 20)
    picked = L.training_ids(docs, "doc_id", "lang").withColumnRenamed("_id", "i")
    found = docs.join(picked, docs["doc_id"] == picked["i"]).groupBy("lang").count().collect()
    assert len(found) == 15 and sum(r["count"] for r in found) == 20


def test_registered_query_equals_one_text_at_a_time(spark, small):
    model = L.fit_languages(small)
    got = {r.doc_id: r for r in queries()["op3_language_id"](spark, "/root/testdata/sf0.001").collect()}
    rows = small.collect()
    assert len(got) == len(rows)
    for r in rows:
        # Every position of every word by the network, one word after the other, without slices or shared words.
        total, n = np.zeros(len(model.labels)), 0
        for word in re.findall(rb"[^\x20\x09-\x0D]+", (r.text or "").encode()):
            word = bytes(c + 32 if 65 <= c <= 90 else c for c in word)
            if not any(c >= 128 or chr(c).isalpha() for c in word):
                continue
            for i in range(0, len(word), L.LONGEST):
                probs = model.forward(np.frombuffer(word[i : i + L.LONGEST], np.uint8)[None], keep=False)[0][:, 0]
                total, n = total + probs.sum(axis=0), n + len(probs)
        want = model.labels[total.argmax()] if n and any(c.isalpha() for c in r.text) else "und"
        assert got[r.doc_id].lang_pred == want
        assert abs(got[r.doc_id].score - (total.max() / n if want != "und" else 0)) < 1e-4
        assert got[r.doc_id].held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2)


def test_reading_in_slices_changes_nothing(small):
    import pyarrow as pa

    model = L.ByteGru.fresh(["a", "b"])
    texts = [r.text for r in small.limit(20).collect()]
    names, scores = L.predict(model, pa.array(texts))
    for t, n, s in zip(texts, names, scores):
        one, own = L.predict(model, pa.array([t]))
        assert one == [n] and abs(own[0] - s) < 1e-5


def test_odd_rows(odd_docs):
    rows = L.identify(odd_docs, L.fit_languages(odd_docs)).collect()
    assert len(rows) == odd_docs.count()
    by_id = {r.doc_id: r for r in rows}
    assert all(by_id[i].lang_pred == "und" and by_id[i].score == 0 for i in (1, 2, 9, 10, None) if i is not None)
    assert {r.lang_pred for r in rows} <= {"en", "fr", "und"}
    assert not any(r.held_out for r in rows if r.doc_id is None)
    kept = L.keep_identified(odd_docs, L.fit_languages(odd_docs))
    assert kept.columns == odd_docs.columns and kept.count() == 11


def test_nothing_to_learn_from(no_docs, odd_docs):
    model = L.fit_languages(no_docs)
    assert L.identify(no_docs, model).count() == 0
    assert {r.lang_pred for r in L.identify(odd_docs, model).collect()} == {"und"}
    assert L.keep_identified(odd_docs, model).count() == 0
