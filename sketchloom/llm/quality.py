"""Quality rules whose cutoffs are chosen under a bound on false rejections."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sketchloom.llm.shared import mapped, text_key, written
from sketchloom.llm.wordspan import Words, mixed, slices, span_hashes

FEATURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True

MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
#: Largest share of good documents that all rules together may reject in a stratum, and the chance that
#: any bound of the whole choice is wrong.
ALPHA, DELTA = 0.05, 0.05
#: A rule is worth using in a stratum only if it provably rejects this share of its bad documents.
LEAST_GAIN = 0.1
# The candidate cutoffs of each rule, strictest first, fixed before any label is seen. A
# document is rejected where its value is above the cutoff.
RULES = {
    "symbols_per_word": [0.05, 0.1, 0.2, 0.3, 0.5, 0.8],
    "symbols_per_char": [0.01, 0.02, 0.05, 0.1, 0.2, 0.3],
    "repeat_share": [0.02, 0.05, 0.1, 0.2, 0.3, 0.4],
    "dup_lines_per_word": [0.005, 0.01, 0.02, 0.05, 0.1, 0.2],
    "chars_per_word": [6.0, 7.0, 8.0, 10.0, 12.0, 16.0],
}
#: Upper bounds of the word counts that make a stratum.
STRATA = [100, 200, 400, 800]


def features(column: pa.Array) -> dict[str, np.ndarray]:
    """FEATURES of each text."""
    w = Words(column)
    lead = w.word_bytes & ((w.buf & 0xC0) != 0x80)
    # Lines: cut at each \n and at each end of a text.
    cut = np.flatnonzero(w.buf == 10)
    cut_doc = np.searchsorted(w.offsets, cut, "right") - 1
    starts = np.concatenate([w.offsets[:-1], cut + 1])
    ends = np.concatenate([cut, w.offsets[1:]])
    doc = np.concatenate([np.arange(w.n_texts), cut_doc])
    # Sorting by text, then place, pairs the k-th start with the k-th end.
    starts = starts[np.lexsort((starts, doc))]
    ends = ends[np.lexsort((ends, np.concatenate([cut_doc, np.arange(w.n_texts)])))]
    doc = np.sort(doc, kind="stable")
    some = np.concatenate([[0], np.cumsum(w.word_bytes, dtype=np.int64)])
    with_word = some[ends] > some[starts]
    starts, ends, doc = starts[with_word], ends[with_word], doc[with_word]
    dup_lines = np.zeros(w.n_texts, np.int64)
    if len(starts):
        key = mixed(span_hashes(w.buf, starts, ends) + doc.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        order = np.argsort(key)
        again = np.concatenate([[False], key[order][1:] == key[order][:-1]])
        dup_lines = np.bincount(doc[order][again], minlength=w.n_texts)

    repeat = np.zeros(w.n_texts, np.int64)
    hashes, at = w.windows(w.hashes(), 3)
    if len(hashes):
        key = mixed(hashes + w.doc[at].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        order = np.argsort(key)
        same = key[order][1:] == key[order][:-1]
        twice = np.concatenate([[False], same]) | np.concatenate([same, [False]])
        marked = np.zeros(len(w.starts), bool)
        hit = at[order][twice]
        for k in range(3):
            marked[hit + k] = True
        repeat = np.bincount(w.doc[marked], minlength=w.n_texts)
    return {
        "n_words": w.counts,
        "word_chars": w.per_text(lead),
        "n_symbols": w.per_text(_SYMBOL[w.buf]),
        "n_dup_lines": dup_lines,
        "n_repeat_words": repeat,
    }


def with_features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text_key (a hash of the text) and FEATURES of each row of ``docs``."""

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                got = features(part.column("text"))
                cols = [part.column("doc_id"), part.column("text_key"), *(pa.array(got[f].astype(np.int64)) for f in FEATURES)]
                yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "text_key", *FEATURES])

    text = F.col(text_col).cast("string")
    src = docs.select(F.col(id_col).alias("doc_id"), text_key(text).alias("text_key"), text.alias("text"))
    kind = src.schema["doc_id"].dataType.simpleString()
    return mapped(src, measure, f"doc_id {kind}, text_key long, " + ", ".join(f"{f} long" for f in FEATURES))


def base_failed():
    n, r = F.col("n_words"), F.col("n_repeat_words")
    return (n < MIN_WORDS) | (100 * r > MAX_REPEAT_PERCENT * n)


def rule_values() -> dict:
    n = F.greatest(F.col("n_words"), F.lit(1))
    return {
        "symbols_per_word": F.col("n_symbols") / n,
        "symbols_per_char": F.col("n_symbols") / F.greatest(F.col("word_chars"), F.lit(1)),
        "repeat_share": F.col("n_repeat_words") / n,
        "dup_lines_per_word": F.col("n_dup_lines") / n,
        "chars_per_word": F.col("word_chars") / n,
    }


def stratum():
    out = F.lit(len(STRATA))
    for i in reversed(range(len(STRATA))):
        out = F.when(F.col("n_words") < STRATA[i], i).otherwise(out)
    return out


def _log_tail(n: int, p: float, x: int) -> float:
    """Logarithm of the chance of x or fewer of n, for x / n below p.

    Terms more than 12 square roots of n * p below x are left out: together they are less than exp(-72).
    """
    top = math.lgamma(n + 1) - math.lgamma(x + 1) - math.lgamma(n - x + 1) + x * math.log(p) + (n - x) * math.log1p(-p)
    i = np.arange(x, max(0, x - math.ceil(12 * math.sqrt(n * p))), -1, dtype=float)
    falls = np.cumsum(np.log(i) - np.log(n - i + 1) + (math.log1p(-p) - math.log(p)))
    return top + math.log1p(float(np.exp(falls).sum()))


def binomial_upper(x: int, n: int, delta: float) -> float:
    """Clopper-Pearson: the largest share for which x or fewer of n still have probability ``delta``."""
    if n == 0 or x >= n:
        return 1.0
    low, high = x / n, 1.0
    for _ in range(60):
        p = (low + high) / 2
        if p >= 1.0 or p <= low:
            break
        if _log_tail(n, p, x) > math.log(delta):
            low = p
        else:
            high = p
    return high


def binomial_lower(x: int, n: int, delta: float) -> float:
    """The smallest share for which x or more of n still have probability ``delta``."""
    return 1.0 - binomial_upper(n - x, n, delta) if n else 0.0


@dataclass
class Rejected:
    """Of the good, or of the bad, labelled texts of a stratum: how many, and how many each (rule, cutoff) rejects."""

    n: int = 0
    by: dict[tuple[str, float], int] = field(default_factory=dict)


def cutoffs_of(counts: dict[tuple[int, bool], Rejected]) -> dict[tuple[int, str], float]:
    """The cutoff of each rule in each stratum, from counts by (stratum, good); no entry where no cutoff will do.

    A cutoff is admissible if the exact binomial upper bound of its share of rejected good documents is at
    most ALPHA divided by the number of rules, and if the exact lower bound of its share of rejected bad
    documents is at least LEAST_GAIN. All bounds of the choice (rules x cutoffs x strata, two each) hold together
    with probability 1 - DELTA (Bonferroni), so choosing among them after looking is allowed: that which
    rejects most bad documents is taken, and of equal ones the mildest.
    """
    limit = ALPHA / len(RULES)
    delta = DELTA / (2 * (len(STRATA) + 1) * sum(len(c) for c in RULES.values()))
    chosen = {}
    for s in range(len(STRATA) + 1):
        fine, poor = counts.get((s, True), Rejected()), counts.get((s, False), Rejected())
        for rule, cutoffs in RULES.items():
            most = 0
            for cutoff in reversed(cutoffs):
                x, y = fine.by.get((rule, cutoff), 0), poor.by.get((rule, cutoff), 0)
                if y <= most or x > limit * fine.n or binomial_upper(x, fine.n, delta) > limit:
                    continue
                if binomial_lower(y, poor.n, delta) >= LEAST_GAIN:
                    most, chosen[s, rule] = y, cutoff
    return chosen


def choose_cutoffs(
    values: dict[str, np.ndarray], strata: np.ndarray, good: np.ndarray
) -> dict[tuple[int, str], float]:
    """``cutoffs_of`` labelled texts that are at hand as arrays."""
    counts = {}
    for s in np.unique(strata).tolist():
        for kind in (True, False):
            own = (strata == s) & (good == kind)
            by = {(r, c): int((values[r][own] > c).sum()) for r, cutoffs in RULES.items() for c in cutoffs}
            counts[s, kind] = Rejected(int(own.sum()), by)
    return cutoffs_of(counts)


def rejection_counts(measured: DataFrame, labels: DataFrame) -> dict[tuple[int, bool], Rejected]:
    """Counts over all labelled texts that pass the base rules; ``measured`` is the result of ``with_features``.

    Copies of a text are one trial, good only if all their labels are, so that trials stay independent however often a
    text is copied. What comes to the driver is a count for each stratum, label and cutoff.
    """
    judged = labels.filter("quality is not null and doc_id is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    judged = judged.select(F.col("doc_id").alias("_id"), (F.col("quality") == 1).alias("good"))
    found = measured.filter(~base_failed()).join(judged, measured["doc_id"] == F.col("_id"))
    trials = found.groupBy("text_key", *FEATURES).agg(F.min("good").alias("good"))
    trials = trials.select("good", stratum().alias("stratum"), *[v.alias(k) for k, v in rule_values().items()])
    pairs = [(r, c) for r, cutoffs in RULES.items() for c in cutoffs]
    over = [F.count_if(F.col(r) > c).alias(f"over_{i}") for i, (r, c) in enumerate(pairs)]
    rows = trials.groupBy("stratum", "good").agg(F.count(F.lit(1)).alias("n"), *over).collect()
    return {(r["stratum"], r["good"]): Rejected(r["n"], {p: r[f"over_{i}"] for i, p in enumerate(pairs)}) for r in rows}


def quality_verdicts(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of ``docs``: doc_id, FEATURES, base_failed and kept.

    Words are runs of characters other than ASCII white space; n_repeat_words counts words in 3-word windows
    that occur twice or more in the text. A document is kept if it has MIN_WORDS words, at most
    MAX_REPEAT_PERCENT of them repeated, and no learned rule of its stratum (a range of word counts) rejects it.
    Where too few different good texts are labelled to prove a bound, a stratum has no learned rule.

    Every text is read once, whole, however long, and its features are written to the shared folder; cutoffs are
    chosen from the features of all labelled documents. A null text has no words, so it fails the base rules; a label
    without id or verdict is not used; of several labels of a document the worst counts. Repeated rows are judged each;
    other columns are ignored, whatever their names; empty tables give no rows.
    """
    measured = written(with_features(docs, id_col, text_col), "quality-features")
    chosen = cutoffs_of(rejection_counts(measured, labels))
    values, reject = rule_values(), F.lit(False)
    for (s, rule), cutoff in sorted(chosen.items()):
        reject = reject | ((stratum() == s) & (values[rule] > cutoff))
    out = measured.drop("text_key").withColumn("base_failed", base_failed())
    return out.withColumn("kept", ~F.col("base_failed") & ~reject)
