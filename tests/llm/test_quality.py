import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from sketchloom.llm import quality as Q

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def slow(text):
    text = text or ""
    w = WORD.findall(text)
    tri = Counter(zip(w, w[1:], w[2:]))
    marked = set()
    for i in range(len(w) - 2):
        if tri[w[i], w[i + 1], w[i + 2]] > 1:
            marked |= {i, i + 1, i + 2}
    seen, dups = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dups += line in seen
            seen.add(line)
    return [len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), dups, len(marked)]


@given(st.lists(st.one_of(st.none(), st.text(alphabet="ab é#|\n\t\r🙂", max_size=60), st.text(max_size=30)), max_size=8))
@settings(max_examples=150, deadline=None)
def test_features(texts):
    got = Q.features(pa.array(texts, pa.string()))
    assert [[int(got[f][i]) for f in Q.FEATURES] for i in range(len(texts))] == [slow(t) for t in texts]


def test_binomial_bounds():
    def tail(x, n, p):
        return sum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(x + 1))

    for x, n in ((0, 20), (3, 50), (10, 11)):
        assert abs(tail(x, n, Q.binomial_upper(x, n, 0.01)) - 0.01) < 1e-6
        low = Q.binomial_lower(x, n, 0.01)
        assert low == 0 if x == 0 else abs((1 - tail(x - 1, n, low)) - 0.01) < 1e-6
    assert Q.binomial_upper(5, 5, 0.1) == 1 and Q.binomial_upper(0, 0, 0.1) == 1


def test_choice_needs_proof():
    n = 3000
    good = np.arange(n) < n // 2
    value = {r: np.zeros(n) for r in Q.RULES}
    value["symbols_per_word"] = np.where(good, 0.0, 1.0)
    strata = np.zeros(n, int)
    assert Q.choose_cutoffs(value, strata, good) == {(0, "symbols_per_word"): 0.8}
    few = np.r_[0:50, n - 50 : n]
    assert Q.choose_cutoffs({k: v[few] for k, v in value.items()}, strata[few], good[few]) == {}
    value["symbols_per_word"] = np.ones(n)
    assert Q.choose_cutoffs(value, strata, good) == {}


def test_false_rejections_stay_below_the_limit(spark):
    base = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{base}/{t}.parquet") for t in ("documents", "labels"))
    found = Q.quality_verdicts(docs, labels).join(labels, "doc_id").filter("not base_failed").toPandas()
    good = found[found.quality == 1]
    assert (~good.kept).mean() <= Q.ALPHA
    assert (~found[found.quality == 0].kept).mean() > 0.2


def test_odd_rows(odd_docs, no_docs, spark):
    labels = spark.createDataFrame([(3, 1), (None, 0), (4, None), (7, 1), (7, 0)], "doc_id long, quality int")
    rows = Q.quality_verdicts(odd_docs, labels).collect()
    assert len(rows) == odd_docs.count()
    want = sorted((str(r.doc_id), *slow(r.text)) for r in odd_docs.collect())
    assert sorted((str(r.doc_id), *(r[f] for f in Q.FEATURES)) for r in rows) == want
    for r in rows:
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
        assert not (r.kept and r.base_failed)
    assert Q.quality_verdicts(no_docs, labels).count() == 0
    assert Q.quality_verdicts(odd_docs, labels.limit(0)).count() == odd_docs.count()


def slow_upper(x, n, delta):
    """Bisection on the sum of all terms."""
    if n == 0 or x >= n:
        return 1.0
    low, high = x / n, 1.0
    for _ in range(45):
        p = (low + high) / 2
        tail = sum(math.exp(math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log1p(-p)) for i in range(x + 1))
        low, high = (p, high) if tail > delta else (low, p)
    return high


def slow_verdicts(docs, labels):
    """(doc_id, features, base_failed, kept) of each document, by plain Python over every labelled text."""
    worst = {}
    for i, q in labels:
        if i is not None and q is not None:
            worst[i] = min(q, worst.get(i, q))
    rows, trials = [], {}
    for i, text in docs:
        n, chars, symbols, dups, repeat = f = slow(text)
        failed = n < 50 or 100 * repeat > 50 * n
        value = dict(symbols_per_word=symbols / max(n, 1), symbols_per_char=symbols / max(chars, 1), repeat_share=repeat / max(n, 1),
                     dup_lines_per_word=dups / max(n, 1), chars_per_word=chars / max(n, 1))
        s = sum(n >= b for b in Q.STRATA)
        rows.append((i, f, failed, s, value))
        if i in worst and not failed:
            trials[text] = (s, value, min(worst[i] == 1, trials.get(text, (0, 0, True))[2]))
    limit, delta, chosen = Q.ALPHA / 5, Q.DELTA / (2 * 5 * 30), {}
    for s in range(5):
        for rule in Q.RULES:
            good = [v[rule] for k, v, g in trials.values() if k == s and g]
            bad = [v[rule] for k, v, g in trials.values() if k == s and not g]
            options = []
            for cutoff in Q.RULES[rule]:
                x, y = sum(v > cutoff for v in good), sum(v > cutoff for v in bad)
                if good and bad and slow_upper(x, len(good), delta) <= limit and 1 - slow_upper(len(bad) - y, len(bad), delta) >= Q.LEAST_GAIN:
                    options.append((y, cutoff))
            if options:
                chosen[s, rule] = max(options)[1]
    return [(i, *f, failed, not failed and all(v[r] <= chosen.get((s, r), math.inf) for r in Q.RULES)) for i, f, failed, s, v in rows], chosen


def test_registered_query(spark, tmp_path):
    from sketchloom.llm.queries import queries

    rng = np.random.default_rng(3)
    docs = []
    for i in range(4000):
        n = int(rng.integers(45, 99)) if i % 2 else int(rng.integers(100, 130))
        words = [f"w{x}" for x in rng.integers(0, 100_000, n)]
        if i % 5 == 0:
            words = [w + "#" * int(rng.integers(1, 3)) if rng.random() < 0.6 else w for w in words]
        docs.append((i, " ".join(words), 0 if i % 5 == 0 and i % 875 else 1))
    # Half of the stratum of 100 words and more are copies of one text, which are one trial.
    docs = [(i, docs[1201][1] if i % 4 == 2 and q else t, q) for i, t, q in docs]
    spark.createDataFrame([(i, t) for i, t, _ in docs], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, q) for i, _, q in docs], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    rows = queries()["op10_quality_rules"](spark, str(tmp_path)).collect()
    got = sorted((r.doc_id, *(r[f] for f in Q.FEATURES), r.base_failed, r.kept) for r in rows)
    want, chosen = slow_verdicts([d[:2] for d in docs], [(i, q) for i, _, q in docs])
    assert got == sorted(want)
    assert chosen and sum(not r.kept and not r.base_failed for r in rows) > 50


def test_copies_prove_nothing(spark):
    text, bad = " ".join(f"w{i}" for i in range(60)), " ".join(f"#{i}" for i in range(60))
    docs = spark.createDataFrame([(i, text if i < 2000 else bad) for i in range(2500)], "doc_id long, text string")
    labels = docs.selectExpr("doc_id", "int(doc_id < 2000) AS quality")
    assert Q.quality_verdicts(docs, labels).filter("not kept").count() == 0


def test_bounds_of_many_trials():
    for x, n in ((40, 5000), (9_000, 1_000_000), (9_900_000, 10**9)):
        up = Q.binomial_upper(x, n, 1e-4)
        # The normal approximation is close at these sizes.
        assert abs((up - x / n) / math.sqrt(up * (1 - up) / n) - 3.719) < 0.3
