import math
import re
import zlib

import numpy as np
import pyarrow as pa

from sketchloom.llm import toxicity as T
from sketchloom.llm.queries import queries


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_automaton_equals_edit_distance():
    rng = np.random.default_rng(3)
    terms = {"idiot": 5.0, "scum": 4.0, "worthless": 6.0, "abba": 2.0, "disgusting": 3.0}
    automaton = T.TermAutomaton(terms, {})
    words = ["".join(rng.choice(list("abdiosctuwrlhegn"), rng.integers(1, 12))) for _ in range(300)]
    for t in terms:
        for _ in range(60):
            w = list(t)
            for _ in range(rng.integers(0, 4)):
                at, kind = rng.integers(0, len(w) + 1), rng.integers(0, 3)
                w[at : at + (kind != 0)] = [] if kind == 1 else [str(rng.choice(list("abdiostuwrl")))]
            words.append("".join(w))
    for w in words:
        want = 0.0
        for t, weight in terms.items():
            n, d = (len(t) >= T.ONE_EDIT) + (len(t) >= T.TWO_EDITS), distance(w, t)
            if d <= n:
                want = max(want, weight * T.EDIT_SHARE**d)
        if w in terms:
            want = terms[w]
        assert abs(automaton.weight(w) - want) < 1e-9, w


def test_prefix_terms_and_ordinary_words():
    automaton = T.TermAutomaton({"trash": 5.0}, {"réeux": 2.0}, frozenset({"crash"}))
    assert automaton.weight("réeuxtion") == 2.0 and automaton.weight("réeu") == 0
    assert automaton.weight("crash") == 0 and automaton.weight("thrash") > 0


def test_misspelled_stems_of_prefix_terms():
    rng = np.random.default_rng(5)
    terms = {"achlich": 3.0, "réeux": 2.0, "boco": 4.0}
    automaton = T.TermAutomaton({}, terms)
    assert automaton.weight("aclicher") > 0 and automaton.weight("reeuxment") > 0 and automaton.weight("bxcoment") == 0
    for t in [*terms, "sonst"]:
        for _ in range(100):
            w = list(t + "er"[: rng.integers(0, 3)])
            for _ in range(rng.integers(0, 3)):
                at, kind = rng.integers(0, len(w) + 1), rng.integers(0, 3)
                w[at : at + (kind != 0)] = [] if kind == 1 else [str(rng.choice(list("achlirébo")))]
            w, want = "".join(w), 0.0
            for term, weight in terms.items():
                n, d = int(len(term) >= T.ONE_EDIT), min(distance(w[:i], term) for i in range(len(w) + 1))
                if d <= n and len(w) >= len(term) or w.startswith(term):
                    want = max(want, weight * T.EDIT_SHARE**d)
            assert abs(automaton.weight(w) - want) < 1e-9, w
    guarded = T.TermAutomaton({}, terms, frozenset(), frozenset({"sachlich"}))
    assert guarded.weight("sachlicher") == 0 and guarded.weight("aclicher") > 0


def test_words_beside_a_prefix_are_learned(spark):
    toxic = [(f"fine words achlich{end} here", 1) for end in ("er", "ig", "ung") for _ in range(14)]
    clean = [(f"fine words sachlich{end} here", 0) for end in ("er", "ig") for _ in range(60)]
    rows = spark.createDataFrame(toxic + clean, "text string, toxic int")
    words, prefixes = T.learn_lexicon(rows)
    assert "achlich" in prefixes and {"achlicher", "achlichig", "achlichung"} <= set(words)
    automaton = T.TermAutomaton(words, prefixes, *T.ordinary_words(rows, T.TermAutomaton(words, prefixes)))
    assert automaton.weight("aclicer") > 0 and automaton.weight("ahlichkeit") > 0
    assert automaton.weight("sachlicher") == automaton.weight("sachlichkeit") == 0


def test_quotation_and_neighbours():
    automaton = T.TermAutomaton({"moron": 4.0}, {})
    texts = ["you moron", 'they said "you moron" to me', "you moron moron", "fine words", None, ""]
    total = T.evidence(automaton, pa.array(texts))["evidence"]
    assert total[0] == 4.0
    assert total[1] == 4.0 * T.QUOTED_SHARE
    assert total[2] > 2 * total[0]
    assert total[3] == total[4] == total[5] == 0


def test_held_out(spark):
    base = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{base}/{t}.parquet") for t in ("documents", "labels"))
    automaton, beta = T.fit_toxicity(docs, labels)
    assert {"idiot", "trash"} <= set(automaton.words)
    found = T.score_toxicity(docs, automaton, beta).join(labels, "doc_id").toPandas()
    held = found[found.held_out]
    toxic, hit = held.toxic == 1, held.predicted == 1
    assert (toxic & hit).sum() / hit.sum() > 0.95
    assert (toxic & hit).sum() / toxic.sum() > 0.85
    rank = held.score.rank()
    auc = (rank[toxic].sum() - toxic.sum() * (toxic.sum() + 1) / 2) / (toxic.sum() * (~toxic).sum())
    assert auc > 0.95
    assert found.score.between(0, 1).all()
    assert ((found.score >= 0.7) == (found.predicted == 1)).all()


def slow_evidence(automaton, text):
    """Hits word by word: weight, hits within CONTEXT words, and whether quotation marks surround the hit."""
    words = [(m.start(), m.end()) for m in re.finditer(r"[^\x20\x09-\x0D]+", text or "")]
    weights = [automaton.weight(text[a:b].lower().strip(T.EDGES)) for a, b in words]
    marks = [i for i, c in enumerate(text or "") if c in '"«»“”„']
    hits = []
    for i, weight in enumerate(weights):
        if not weight:
            continue
        near = sum(1 for j, v in enumerate(weights) if v and j != i and abs(i - j) <= T.CONTEXT)
        a, b = words[i]
        before, inside = sum(m < a for m in marks), sum(a <= m < b for m in marks)
        after = sum(a <= m < words[min(i + T.CONTEXT, len(words) - 1)][1] for m in marks)
        odd = before % 2 == 1
        quoted = (odd and after > 0) or (a in marks and not odd and after > 1) or inside > 1
        hits.append(weight * (1 + min(near, 4) / 4) * (T.QUOTED_SHARE if quoted else 1))
    total = sum(hits)
    return [total, total - max(hits, default=0), 100 * total / max(len(words), 1)]


def test_registered_query_equals_word_by_word(spark):
    base = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{base}/{t}.parquet") for t in ("documents", "labels"))
    automaton, beta = T.fit_toxicity(docs, labels)
    got = {r.doc_id: r for r in queries()["op5_toxicity"](spark, base).collect()}
    rows = docs.collect()
    assert len(got) == len(rows)
    some = 0
    for r in rows:
        found = slow_evidence(automaton, r.text)
        some += found[0] > 0
        x = beta[0] + sum(b * math.log1p(v) for b, v in zip(beta[1:], found))
        score = 1 / (1 + math.exp(-x))
        assert abs(got[r.doc_id].score - score) < 1e-9 and got[r.doc_id].predicted == int(score >= 0.7)
        assert got[r.doc_id].held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1)
    assert some > 20


def test_clashing_names(spark):
    docs = spark.createDataFrame([(1, "a b", 5, 1, 2, 3), (2, None, 5, 1, 2, 3)], "doc_id long, text string, _toxic int, _id int, toxic int, id int")
    labels = spark.createDataFrame([(1, 1, "x"), (2, 0, "y")], "doc_id long, toxic int, text string")
    assert T.score_toxicity(docs, *T.fit_toxicity(docs, labels)).count() == 2


def test_odd_rows(odd_docs, no_docs, spark):
    labels = spark.createDataFrame([(3, 1), (4, 0), (None, 1), (5, None), (7, 0), (7, 1)], "doc_id long, toxic int")
    automaton, beta = T.fit_toxicity(odd_docs, labels)
    rows = T.score_toxicity(odd_docs, automaton, beta).collect()
    assert len(rows) == odd_docs.count()
    assert all(0 <= r.score <= 1 for r in rows)
    none = spark.createDataFrame([], "doc_id long, toxic int")
    automaton, beta = T.fit_toxicity(no_docs, none)
    assert T.score_toxicity(no_docs, automaton, beta).count() == 0
    assert T.score_toxicity(odd_docs, automaton, beta).count() == odd_docs.count()
