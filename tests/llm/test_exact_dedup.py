import hashlib
from collections import defaultdict

from pyspark.sql import functions as F

from sketchloom.llm import shared
from sketchloom.llm.exact_dedup import drop_exact_copies, exact_dedup


def brute(rows):
    ids, sizes = defaultdict(list), defaultdict(int)
    for i, t in rows:
        sizes[t or ""] += 1
        if i is not None:
            ids[t or ""].append(i)
    out = []
    for i, t in rows:
        t = t or ""
        keep = (max(ids[t]) if ids[t] else None) if sizes[t] > 1 else i
        out.append((i, keep, sizes[t], i == keep, hashlib.sha256(t.encode()).hexdigest()))
    return sorted(out, key=str)


def run(df):
    got = exact_dedup(df, carry={"sha": F.sha2(F.coalesce("text", F.lit("")), 256)})
    return sorted(map(tuple, got.select("doc_id", "keep_id", "group_size", "kept", "sha").collect()), key=str)


def pairs(df):
    return [(r.doc_id, r.text) for r in df.collect()]


def test_odd_rows(odd_docs):
    assert run(odd_docs) == brute(pairs(odd_docs))


def test_small_table(small):
    assert run(small) == brute(pairs(small))


def test_full_bitmap_loses_nothing(spark, small, monkeypatch):
    monkeypatch.setattr(shared.bitmap_of, "__defaults__", (1,))
    monkeypatch.setattr(shared.with_bitmap_test, "__defaults__", (1,))
    assert run(small) == brute(pairs(small))


def test_empty(no_docs):
    assert run(no_docs) == []
    assert drop_exact_copies(no_docs).columns == no_docs.columns


def test_drop_keeps_columns_and_one_of_each(odd_docs):
    left = drop_exact_copies(odd_docs)
    assert left.columns == odd_docs.columns
    rows = left.collect()
    assert {r.doc_id for r in rows} == {2, 3, 4, 6, 8, 9, 10, 11, 12, 13, None}
    assert sum(r.doc_id is None for r in rows) == 2


def test_no_python_in_plan(small):
    plan = exact_dedup(small)._jdf.queryExecution().toString()
    assert not any(word in plan for word in ("Python", "Pandas", "Arrow"))
