import re
import subprocess
import sys

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from sketchloom.llm import hamming_index as H
from sketchloom.llm import simhash
from sketchloom.llm.near_dedup import drop_near_copies, simhash_groups
from sketchloom.llm.queries import queries
from sketchloom.llm.simhash import fingerprints, xxh64_spans

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def slow_print(text):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    grams = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow_groups(rows):
    prints = [(i, slow_print(t)) for i, t in rows]
    nodes = sorted({p for _, p in prints})
    up = {p: p for p in nodes}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for n, a in enumerate(nodes):
        for b in nodes[n + 1 :]:
            if (a ^ b).bit_count() <= 3:
                up[find(a)] = find(b)
    least = {}
    for i, p in prints:
        if i is not None:
            least[find(p)] = min(i, least.get(find(p), i))
    return sorted(((i, p, least.get(find(p))) for i, p in prints), key=str)


@given(st.binary(max_size=200), st.integers(0, 2**64 - 1))
@settings(max_examples=60, deadline=None)
def test_hash_equals_library(data, seed):
    buf = np.frombuffer(data, np.uint8)
    got = xxh64_spans(buf, np.array([0]), np.array([len(data)]), seed)[0]
    assert int(got) == xxhash.xxh64_intdigest(data, seed)


@given(st.lists(st.one_of(st.none(), st.text(max_size=60)), max_size=8))
@settings(max_examples=60, deadline=None)
def test_fingerprints(texts):
    assert [int(f) for f in fingerprints(pa.array(texts, pa.string()))] == [slow_print(t) for t in texts]


@given(st.text(alphabet="aB é\t\n", min_size=1, max_size=150), st.integers(1, 12))
@settings(max_examples=150, deadline=None)
def test_long_texts_are_read_in_parts(text, size):
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(simhash, "SLICE_BYTES", size)
        patch.setattr(simhash, "UNPACKED", 5)
        assert int(fingerprints(pa.array([text]))[0]) == slow_print(text)


MEASURE = """
import resource
import pyarrow as pa
from sketchloom.llm.queries import queries
from sketchloom.llm.simhash import fingerprints
column = pa.array(["some words that repeat, " * 4_200_000])
before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
assert len(fingerprints(column)) == 1
print(resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before)
"""


def test_memory_for_a_text_of_100_mb():
    done = subprocess.run([sys.executable, "-c", MEASURE], capture_output=True, text=True, check=True, timeout=600)
    assert int(done.stdout.split()[-1]) < 700_000


def test_registered_query(spark, small):
    want = slow_groups([(r.doc_id, r.text) for r in small.collect()])
    rows = queries()["op2_simhash_near_dedup"](spark, "/root/testdata/sf0.001").collect()
    assert sorted(((r.doc_id, r.fingerprint, r.component_id) for r in rows), key=str) == sorted(((i, f"{p:016x}", c) for i, p, c in want), key=str)


def gray_order(fps):
    r = fps.copy()
    for k in (1, 2, 4, 8, 16, 32):
        r ^= r >> np.uint64(k)
    return fps[np.argsort(r)]


def clustered(seed, clusters, each):
    rng, out = np.random.default_rng(seed), set()
    for base in rng.integers(0, 1 << 64, clusters, dtype=np.uint64):
        for _ in range(each):
            x = int(base)
            for k in rng.integers(0, 64, rng.integers(0, 6)):
                x ^= 1 << int(k)
            out.add(x)
    return np.array(sorted(out), np.uint64)


def test_tree_finds_every_link():
    fps = gray_order(clustered(1, 12, 80))
    got = {tuple(sorted(p)) for a, b in H.GrayTree(fps, np.array([0, len(fps)])).links() for p in zip(a.tolist(), b.tolist())}
    want = {(i, i + 1 + int(j)) for i in range(len(fps)) for j in np.flatnonzero(np.bitwise_count(fps[i + 1 :] ^ fps[i]) <= 3)}
    assert got == want


def test_links_survive_splitting_of_buckets(spark, monkeypatch):
    rng = np.random.default_rng(2)
    fps = [(int(x) & ~0xFFFF) | 0x1234 for x in rng.integers(0, 1 << 64, 60, dtype=np.uint64)]
    fps += [f ^ (1 << int(a)) ^ (1 << int(b)) for f, a, b in zip(fps[:20], rng.integers(0, 16, 20), rng.integers(16, 64, 20))]
    arr = np.array(sorted(set(fps)), np.uint64)
    names = arr.view(np.int64).tolist()
    rows = [(i, f) for i, f in enumerate(names)] + [(1000 + i, names[0]) for i in range(50)]
    df = spark.createDataFrame(rows, "doc_id long, fp long")
    up = list(range(len(names)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(names)):
        for j in np.flatnonzero(np.bitwise_count(arr ^ arr[i]) <= 3):
            up[find(i)] = find(int(j))
    least = {}
    for d, f in rows:
        r = find(names.index(f))
        least[r] = min(d, least.get(r, d))
    want = {d: least[find(names.index(f))] for d, f in rows}
    assert len(set(want.values())) < len(names)
    for size in (4096, 16):
        monkeypatch.setattr(H, "BUCKET", size)
        assert {r.doc_id: r.component_id for r in H.near_groups(df).collect()} == want


def test_chain_components(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 200), (300, 200)], "a long, b long")
    got = {r.node: r.root for r in H.components(edges).collect()}
    assert got == {**{i: 0 for i in range(61)}, 100: 100, 200: 100, 300: 100}


def test_odd_rows(odd_docs):
    got = sorted(((r.doc_id, r.fp % 2**64, r.component_id) for r in simhash_groups(odd_docs).collect()), key=str)
    assert got == slow_groups([(r.doc_id, r.text) for r in odd_docs.collect()])


def test_small_table_and_drop(small):
    want = slow_groups([(r.doc_id, r.text) for r in small.collect()])
    got = sorted(((r.doc_id, r.fp % 2**64, r.component_id) for r in simhash_groups(small).collect()), key=str)
    assert got == want
    left = drop_near_copies(small)
    assert left.columns == small.columns
    assert sorted(r.doc_id for r in left.collect()) == sorted({c for _, _, c in want})


def test_empty(no_docs):
    assert simhash_groups(no_docs).count() == 0
    assert drop_near_copies(no_docs).count() == 0
