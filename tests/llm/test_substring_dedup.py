import re
from collections import Counter

import pytest

from sketchloom.llm import substring_dedup as S

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(texts):
    words = [WORD.findall(t or "") for t in texts]
    seen = Counter(tuple(w[i : i + 35]) for w in words for i in range(len(w) - 34))
    out = []
    for w in words:
        gone = [False] * len(w)
        for i in range(len(w) - 34):
            if seen[tuple(w[i : i + 35])] > 1:
                gone[i : i + 35] = [True] * 35
        out.append((len(w), sum(gone), " ".join(x for x, g in zip(w, gone) if not g)))
    return out


def check(df):
    rows = df.collect()
    want = sorted(((r.doc_id, *b) for r, b in zip(rows, brute([r.text for r in rows]))), key=str)
    got = sorted(((r.doc_id, r.n_words, r.n_removed, r.kept) for r in S.remove_repeated(df).collect()), key=str)
    assert got == want


def planted():
    p = " ".join(f"p{i}" for i in range(60))
    texts = [
        p, f"x y {p} z", "it " * 200, "a b " * 50, " ".join([f"q{i}" for i in range(40)] * 2), None, "", " ".join(f"r{i}" for i in range(34)),
        "n " + " ".join(f"r{i}" for i in range(35)), " ".join(f"r{i}" for i in range(35)), "\t".join(f"s{i}" for i in range(36)), "  \n ".join(f"s{i}" for i in range(36)),
    ]
    return texts + [" ".join(f"u{i}_{j}" for j in range(20 + i)) + f" {p} " + " ".join(f"v{i}_{j}" for j in range(40)) for i in range(12)]


@pytest.mark.parametrize("large", [2000, 3, 0])
def test_planted(spark, monkeypatch, large):
    monkeypatch.setattr(S, "LARGE_GROUP", large)
    check(spark.createDataFrame(list(enumerate(planted())), "doc_id long, text string"))


def test_tables(small, odd_docs, no_docs):
    check(small)
    check(odd_docs)
    assert S.remove_repeated(no_docs).count() == 0


def test_gathering_in_parts(small, monkeypatch):
    monkeypatch.setattr(S, "GATHER", 5)
    check(small)


def test_automaton_counts():
    a = S.Automaton()
    first, second = list(range(50)), [99, *range(5, 45), 98]
    a.insert(first, 1)
    a.insert(second, 1)
    a.close()
    assert a.repeated(first) == list(range(5, 11))
    assert a.repeated(second) == list(range(1, 7))
    b = S.Automaton()
    b.insert(first, 2)
    b.close()
    assert b.repeated(first) == list(range(16))
