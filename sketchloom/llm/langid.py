"""Language identification by a bidirectional gated recurrent network over bytes, trained here in numpy."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sketchloom.llm.shared import mapped
from sketchloom.llm.wordspan import Words, mixed, slices, span_hashes

#: The bounded sample for training: labelled documents of each language at most, and of all. With more than MAX_DOCS /
#: DOCS_PER_LANG languages each gets fewer, down to one document for each of the MAX_DOCS most frequent languages.
DOCS_PER_LANG, MAX_DOCS = 400, 4000
#: Different (language, piece) pairs that the driver trains on at most; the whole sampled texts are read.
PIECES = 1 << 18
HIDDEN, STEPS, BATCH, RATE, SEED = 12, 700, 512, 0.01, 5
#: Longest sequence; a longer word is cut into sequences of this length.
LONGEST = 32
#: Sequences that are run through the network at once.
CHUNK = 2048
UNKNOWN = "und"

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_LETTER = np.array([b >= 128 or chr(b).isalpha() for b in range(256)])
_ASCII_LETTER = _LETTER & (np.arange(256) < 128)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-x))


def step(x: np.ndarray, h: np.ndarray, u: np.ndarray) -> tuple[np.ndarray, tuple]:
    """One step of a gated recurrent unit: ``x`` holds the input's share of the update, reset and candidate."""
    k = h.shape[1]
    a = h @ u
    gates = _sigmoid(x[:, : 2 * k] + a[:, : 2 * k])
    z, r, s = gates[:, :k], gates[:, k:], a[:, 2 * k :]
    c = np.tanh(x[:, 2 * k :] + r * s)
    return z * h + (1 - z) * c, (h, z, r, s, c)


def step_back(dh: np.ndarray, kept: tuple, u: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Gradients for the input's share, the state before, and ``u``."""
    h, z, r, s, c = kept
    dz = dh * (h - c) * z * (1 - z)
    dc = dh * (1 - z) * (1 - c * c)
    dr = dc * s * r * (1 - r)
    da = np.concatenate([dz, dr, dc * r], axis=1)
    return np.concatenate([dz, dr, dc], axis=1), dh * z + da @ u.T, h.T @ da


@dataclass
class ByteGru:
    """Parameters by name, and the labels. tables: input share of each byte, one for each direction."""

    labels: list[str]
    p: dict[str, np.ndarray] = field(default_factory=dict)

    @classmethod
    def fresh(cls, labels: list[str], seed: int = SEED) -> ByteGru:
        rng, n = np.random.default_rng(seed), len(labels)
        shapes = {"table_f": (256, 3 * HIDDEN), "table_b": (256, 3 * HIDDEN), "u_f": (HIDDEN, 3 * HIDDEN), "u_b": (HIDDEN, 3 * HIDDEN)}
        p = {k: rng.normal(0, 0.3, s).astype(np.float32) for k, s in shapes.items()}
        p["out"] = rng.normal(0, 0.3, (2 * HIDDEN, n)).astype(np.float32)
        p["bias"] = np.zeros(n, np.float32)
        return cls(labels, p)

    def forward(self, x: np.ndarray, keep: bool = True) -> tuple[np.ndarray, list, list, np.ndarray]:
        """Label probabilities of every position of sequences of equal length (positions x sequences x labels).

        With ``keep``, also what backpropagation needs of each step.
        """
        t, n = x.shape[1], len(x)
        hs = np.empty((t, n, 2 * HIDDEN), np.float32)
        h = np.zeros((n, HIDDEN), np.float32)
        kept_f, kept_b = [], []
        for i in range(t):
            h, kept = step(self.p["table_f"][x[:, i]], h, self.p["u_f"])
            hs[i, :, :HIDDEN] = h
            if keep:
                kept_f.append(kept)
        h = np.zeros((n, HIDDEN), np.float32)
        for i in reversed(range(t)):
            h, kept = step(self.p["table_b"][x[:, i]], h, self.p["u_b"])
            hs[i, :, HIDDEN:] = h
            if keep:
                kept_b.append(kept)
        logits = hs @ self.p["out"] + self.p["bias"]
        e = np.exp(logits - logits.max(axis=2, keepdims=True))
        return e / e.sum(axis=2, keepdims=True), kept_f, kept_b[::-1], hs

    def gradients(self, x: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        """Gradients of the mean cross-entropy over all positions, by backpropagation through time."""
        probs, kept_f, kept_b, hs = self.forward(x)
        t, n = x.shape[1], len(x)
        d = probs
        d[:, np.arange(n), y] -= 1
        d /= t * n
        g = {k: np.zeros_like(v) for k, v in self.p.items()}
        g["out"] = np.einsum("tnh,tnl->hl", hs, d)
        g["bias"] = d.sum(axis=(0, 1))
        dhs = d @ self.p["out"].T
        for side, kept, order, part in (
            ("f", kept_f, reversed(range(t)), slice(0, HIDDEN)),
            ("b", kept_b, range(t), slice(HIDDEN, 2 * HIDDEN)),
        ):
            carry = np.zeros((n, HIDDEN), np.float32)
            for i in order:
                dx, carry, du = step_back(dhs[i, :, part] + carry, kept[i], self.p[f"u_{side}"])
                g[f"u_{side}"] += du
                np.add.at(g[f"table_{side}"], x[:, i], dx)
        return g

    def position_sums(self, x: np.ndarray) -> np.ndarray:
        """Sum over positions of the label probabilities of each sequence."""
        parts = [self.forward(x[i : i + CHUNK], keep=False)[0].sum(axis=0) for i in range(0, len(x), CHUNK)]
        return np.concatenate(parts) if parts else np.zeros((0, len(self.labels)), np.float32)


def train(pieces: list[bytes], labels: list[str], counts: list[int]) -> ByteGru:
    """Fit a network to pieces with a label and a number of occurrences each, languages drawn equally often."""
    names = sorted(set(labels))
    model, rng = ByteGru.fresh(names), np.random.default_rng(SEED)
    where = {n: i for i, n in enumerate(names)}
    y = np.array([where[v] for v in labels])
    size = np.array([min(len(p), LONGEST) for p in pieces])
    weight = np.array(counts, float)
    weight /= np.bincount(y, weights=weight, minlength=len(names))[y]
    lengths = np.unique(size)
    groups = {}
    for n in lengths:
        rows = np.flatnonzero(size == n)
        x = np.frombuffer(b"".join(pieces[i][:LONGEST] for i in rows), np.uint8).reshape(len(rows), n)
        groups[n] = (x, y[rows], weight[rows] / weight[rows].sum())
    share = np.array([weight[size == n].sum() * n for n in lengths])
    share /= share.sum()
    m = {k: np.zeros_like(v) for k, v in model.p.items()}
    v = {k: np.zeros_like(w) for k, w in model.p.items()}
    for it in range(1, STEPS + 1):
        x, yy, w = groups[lengths[rng.choice(len(lengths), p=share)]]
        rows = rng.choice(len(x), BATCH, p=w)
        grads = model.gradients(x[rows], yy[rows])
        rate = RATE * min(1.0, 2.0 * (1 - it / (STEPS + 1)))
        for k, g in grads.items():
            m[k] = 0.9 * m[k] + 0.1 * g
            v[k] = 0.999 * v[k] + 0.001 * g * g
            step_size = rate * (m[k] / (1 - 0.9**it)) / (np.sqrt(v[k] / (1 - 0.999**it)) + 1e-8)
            model.p[k] = (model.p[k] - step_size).astype(np.float32)
    return model


def _letter_words(column: pa.Array) -> tuple[Words, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Small ASCII letters, and the sequences: words with a letter, long ones cut. Returns words, bytes, starts, ends, texts."""
    w = Words(column)
    buf = _LOWER[w.buf]
    sums = np.concatenate([[0], np.cumsum(_LETTER[buf], dtype=np.int64)])
    some = sums[w.ends] > sums[w.starts]
    starts, ends, doc = w.starts[some], w.ends[some], w.doc[some]
    n = -(-(ends - starts) // LONGEST)
    if len(n) and n.max() > 1:
        at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        ends, doc = np.repeat(ends, n), np.repeat(doc, n)
        starts = np.repeat(starts, n) + at * LONGEST
        ends = np.minimum(ends, starts + LONGEST)
    return w, buf, starts, ends, doc


def predict(model: ByteGru, column: pa.Array) -> tuple[list[str], np.ndarray]:
    """Label and score of each text: the mean of its positions' probabilities."""
    w, buf, starts, ends, doc = _letter_words(column)
    n_labels = len(model.labels)
    if not n_labels:
        return [UNKNOWN] * w.n_texts, np.zeros(w.n_texts)
    pooled = np.zeros((w.n_texts, n_labels))
    if len(starts):
        _, first, which = np.unique(span_hashes(buf, starts, ends), return_index=True, return_inverse=True)
        s, size = starts[first], (ends - starts)[first]
        sums = np.zeros((len(first), n_labels), np.float32)
        order = np.argsort(size, kind="stable")
        for n in np.unique(size):
            rows = order[np.searchsorted(size[order], n) : np.searchsorted(size[order], n, "right")]
            sums[rows] = model.position_sums(buf[s[rows][:, None] + np.arange(n)])
        for k in range(n_labels):
            pooled[:, k] = np.bincount(doc, weights=sums[which, k], minlength=w.n_texts)
    total = pooled.sum(axis=1)
    lettered = _lettered(w, column) & (total > 0)
    probs = pooled / np.where(total > 0, total, 1)[:, None]
    best = probs.argmax(axis=1)
    names = [model.labels[b] if ok else UNKNOWN for b, ok in zip(best, lettered)]
    return names, np.where(lettered, np.minimum(probs.max(axis=1, initial=0.0), 1.0), 0.0)


def _lettered(w: Words, column: pa.Array) -> np.ndarray:
    """Whether a text has a letter of any script."""
    plain = w.per_text(_ASCII_LETTER[w.buf]) > 0
    for i in np.flatnonzero(~plain & (w.per_text(w.buf >= 128) > 0)):
        plain[i] = any(c.isalpha() for c in column[int(i)].as_py() or "")
    return plain


def fold(id_col: Column, n: int) -> Column:
    """crc32 of the id as text, modulo n; null for a null id."""
    return F.crc32(id_col.cast("string").cast("binary")) % n


def training_ids(docs: DataFrame, id_col: str, lang_col: str) -> DataFrame:
    """(_id) of the bounded sample: at most MAX_DOCS ids, taken by their rank within their language.

    Ranks follow a hash of the id. A first count of each language gives the share of hashes among which its
    sample is sure to lie, so that few rows of a language, however large, meet in the task that ranks them.
    """
    fit = docs.select(F.col(id_col).alias("_id"), F.col(lang_col).cast("string").alias("_lang"))
    fit = fit.filter((fold(F.col("_id"), 4) != 2) & F.col("_lang").isNotNull())
    counts = fit.groupBy(F.col("_lang").alias("_name")).agg(F.count(F.lit(1)).alias("_n"))
    counts = F.broadcast(counts.orderBy(F.desc("_n"), "_name").limit(MAX_DOCS))
    place = F.shiftrightunsigned(F.xxhash64("_id"), 11) / F.lit(float(1 << 53))
    fit = fit.withColumn("_place", place).join(counts, F.col("_lang") == F.col("_name"))
    fit = fit.filter(F.col("_place") * F.col("_n") <= 2 * DOCS_PER_LANG + 100).select("_id", "_lang", "_place").distinct()
    rank = F.row_number().over(Window.partitionBy("_lang").orderBy("_place", "_id"))
    fit = fit.withColumn("_rank", rank).filter(F.col("_rank") <= DOCS_PER_LANG)
    return fit.orderBy("_rank", "_place", "_id").limit(MAX_DOCS).select("_id")


def training_pieces(docs: DataFrame, id_col: str, text_col: str, lang_col: str) -> DataFrame:
    """(lang, piece, n) of the sampled documents: every piece of their whole texts, with its number of occurrences."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                _, buf, starts, ends, doc = _letter_words(part.column("text"))
                names, code = np.unique(np.array(part.column("lang").to_pylist(), object).astype(str), return_inverse=True)
                key = mixed(span_hashes(buf, starts, ends) + code[doc].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
                _, first, n = np.unique(key, return_index=True, return_counts=True)
                data = buf.tobytes()
                pieces = [data[s:e] for s, e in zip(starts[first].tolist(), ends[first].tolist())]
                lang = names[code[doc[first]]].tolist()
                cols = [pa.array(lang, pa.string()), pa.array(pieces, pa.binary()), pa.array(n.astype(np.int64))]
                yield pa.RecordBatch.from_arrays(cols, names=["lang", "piece", "n"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"))
    rows = rows.filter("lang is not null").join(F.broadcast(training_ids(docs, id_col, lang_col)), F.col("id") == F.col("_id"), "left_semi")
    found = mapped(rows.select("text", "lang"), cut, "lang string, piece binary, n long").groupBy("lang", "piece").agg(F.sum("n").alias("n"))
    return found.orderBy(F.xxhash64("piece", "lang"), "piece", "lang").limit(PIECES)


def fit_languages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> ByteGru:
    """Train on a bounded sample of the labelled rows of ``docs`` whose fold (crc32 of the id modulo 4) is not 2.

    Rows without id or language are not used; with none left the network knows no language. Several rows of an
    id are all read. Columns other than the three named ones are ignored.
    """
    rows = training_pieces(docs, id_col, text_col, lang_col).orderBy("lang", "piece", "n").toPandas()
    if rows.empty:
        return ByteGru([], ByteGru.fresh([]).p)
    return train([bytes(p) for p in rows["piece"]], rows["lang"].tolist(), rows["n"].tolist())


def identify(docs: DataFrame, model: ByteGru, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of ``docs``: doc_id, held_out, lang_pred and score.

    Every word with a letter is read by the network in both directions, every position of it gets a
    probability for each language, and their mean over the whole text decides; a word that occurs many times
    is read once in a slice of texts. lang_pred is ``und`` with score 0 for a null text, one without letters, or
    if nothing was learned. held_out is false for a null id. Repeated rows are each judged alike, a text longer
    than a slice alone; an empty table gives no rows. Other columns are ignored, whatever their names.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", 1 << 20):
                names, scores = predict(model, part.column("text"))
                cols = [part.column("doc_id"), pa.array(names, pa.string()), pa.array(scores, pa.float64())]
                yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "lang_pred", "score"])

    src = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    kind = src.schema["doc_id"].dataType.simpleString()
    found = mapped(src, run, f"doc_id {kind}, lang_pred string, score double")
    held = F.coalesce(fold(F.col("doc_id"), 4) == 2, F.lit(False))
    return found.select("doc_id", held.alias("held_out"), "lang_pred", "score")


#: Documents with a lower score are rejected: the network sees no language in them.
LEAST_SCORE = 0.3


def keep_identified(docs: DataFrame, model: ByteGru, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose language is identified with LEAST_SCORE or more; all columns kept, no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text_col, 1 << 20):
                names, scores = predict(model, part.column(text_col))
                keep = (np.array(names, object) != UNKNOWN) & (scores >= LEAST_SCORE)
                yield part.filter(pa.array(keep.astype(bool)))

    return mapped(docs, run, docs.schema)
