"""SimHash fingerprints of word shingles, for many texts at once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sketchloom.llm.shared import mapped
from sketchloom.llm.wordspan import SPACE, Words, slices

SHINGLE_WORDS = 3
SEED = 42
# The five primes of XXH64.
P1, P2, P3, P4, P5 = (
    np.uint64(p)
    for p in (11400714785074694791, 14029467366897019727, 1609587929392839161, 9650029242287828579, 2870177450012600261)
)
#: Longer shingles are hashed one by one.
VECTOR_BYTES = 64
#: Bytes of text that are taken at once; a longer text is taken alone, and in parts if it has more than twice so many.
SLICE_BYTES = 1 << 20
#: Hashes that are spread into bits at once.
UNPACKED = 1 << 16

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def _rotl(x: np.ndarray, r: int) -> np.ndarray:
    return (x << np.uint64(r)) | (x >> np.uint64(64 - r))


def _round(acc: np.ndarray, lane: np.ndarray) -> np.ndarray:
    return _rotl(acc + lane * P2, 31) * P1


def _xxh64_same_length(data: np.ndarray, at: np.ndarray, n: int, seed: np.uint64) -> np.ndarray:
    """XXH64 of the n bytes from each place ``at``; ``data`` has 8 bytes of padding."""
    wide = np.ndarray(len(data) - 7, "<u8", data, strides=(1,))
    with np.errstate(over="ignore"):
        k = 0
        if n >= 32:
            acc = [np.full(len(at), s, np.uint64) for s in (seed + P1 + P2, seed + P2, seed, seed - P1)]
            while k + 32 <= n:
                acc = [_round(a, wide[at + (k + 8 * i)]) for i, a in enumerate(acc)]
                k += 32
            h = _rotl(acc[0], 1) + _rotl(acc[1], 7) + _rotl(acc[2], 12) + _rotl(acc[3], 18)
            for a in acc:
                h = (h ^ _round(np.zeros_like(a), a)) * P1 + P4
        else:
            h = np.full(len(at), seed + P5, np.uint64)
        h = h + np.uint64(n)
        while k + 8 <= n:
            lane = wide[at + k]
            h = _rotl(h ^ (_rotl(lane * P2, 31) * P1), 27) * P1 + P4
            k += 8
        if k + 4 <= n:
            h = _rotl(h ^ ((wide[at + k] & np.uint64(0xFFFFFFFF)) * P1), 23) * P2 + P3
            k += 4
        while k < n:
            h = _rotl(h ^ (data[at + k].astype(np.uint64) * P5), 11) * P1
            k += 1
        h = (h ^ (h >> np.uint64(33))) * P2
        h = (h ^ (h >> np.uint64(29))) * P3
    return h ^ (h >> np.uint64(32))


def xxh64_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = SEED) -> np.ndarray:
    """XXH64 of each byte range of ``data``."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    out = np.zeros(len(starts), np.uint64)
    sizes = np.minimum(ends - starts, VECTOR_BYTES + 1).astype(np.uint8)
    order = np.argsort(sizes, kind="stable")
    bounds = np.searchsorted(sizes[order], np.arange(VECTOR_BYTES + 3))
    for n in range(VECTOR_BYTES + 1):
        if bounds[n + 1] > bounds[n]:
            rows = order[bounds[n] : bounds[n + 1]]
            out[rows] = _xxh64_same_length(padded, starts[rows], n, np.uint64(seed))
    for i in order[bounds[VECTOR_BYTES + 1] :]:
        out[i] = xxhash.xxh64_intdigest(data[starts[i] : ends[i]].tobytes(), seed)
    return out


def _bit_sums(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """For each text: how many of its shingles' hashes have each bit, and the number of shingles."""
    w = Words(column)
    sums, counts = np.zeros((w.n_texts, 64), np.int64), np.zeros(w.n_texts, np.int64)
    n = len(w.starts)
    if not n:
        return sums, counts
    sizes = w.ends - w.starts
    begins = np.concatenate([[0], np.cumsum(sizes + 1)])[:-1]
    data = np.full(int(sizes.sum()) + n, 0x20, np.uint8)
    data[np.arange(int(sizes.sum())) + np.repeat(np.arange(n), sizes)] = _LOWER[w.buf.compress(w.word_bytes)]
    # The last word of the shingle that begins at each word; a short text is one shingle.
    last = np.minimum(np.arange(n) + SHINGLE_WORDS - 1, w.first[w.doc + 1] - 1)
    whole = (last - np.arange(n) == SHINGLE_WORDS - 1) | (np.arange(n) == w.first[w.doc])
    at, last = np.flatnonzero(whole), last[whole]
    hashes = xxh64_spans(data, begins[at], begins[last] + sizes[last])
    doc = w.doc[at]
    for low in range(0, len(doc), UNPACKED):
        part = doc[low : low + UNPACKED]
        bits = np.unpackbits(hashes[low : low + UNPACKED].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        texts, firsts = np.unique(part, return_index=True)
        sums[texts] += np.add.reduceat(bits, firsts, axis=0, dtype=np.int32)
        counts[texts] += np.diff(np.append(firsts, len(part)))
    return sums, counts


def _long_bit_sums(text: memoryview) -> tuple[np.ndarray, np.ndarray]:
    """The same for one long text, some bytes at a time; the words that begin a shingle of the next part are carried over."""
    sums, counts = np.zeros((1, 64), np.int64), np.zeros(1, np.int64)
    raw, carried, low, seen = np.frombuffer(text, np.uint8), b"", 0, False
    while low < len(raw):
        high = min(low + SLICE_BYTES, len(raw))
        while high < len(raw) and not SPACE[raw[high - 1]]:
            step = np.flatnonzero(SPACE[raw[high : high + SLICE_BYTES]])
            high = high + int(step[0]) + 1 if len(step) else min(high + SLICE_BYTES, len(raw))
        part = carried + b" " + raw[low:high].tobytes()
        words = Words(pa.array([part], pa.large_binary()).cast(pa.large_string()))
        low = high
        if len(words.starts) < SHINGLE_WORDS and (low < len(raw) or seen):
            carried = part
            continue
        more, n = _bit_sums(pa.array([part], pa.large_binary()).cast(pa.large_string()))
        sums, counts, seen = sums + more, counts + n, True
        if len(words.starts) >= SHINGLE_WORDS:
            carried = part[int(words.starts[1 - SHINGLE_WORDS]) :]
    return sums, counts


def fingerprints(column: pa.Array) -> np.ndarray:
    """The 64-bit SimHash of each text: bit b is set if over half of its shingles' hashes have it."""
    column = pc.fill_null(column, "").cast(pa.large_string())
    sizes = pc.binary_length(column).to_numpy(zero_copy_only=False) if len(column) else np.zeros(0, np.int64)
    if len(sizes) == 1 and sizes[0] > 2 * SLICE_BYTES:
        sums, counts = _long_bit_sums(memoryview(column[0].as_buffer()))
    else:
        sums, counts = _bit_sums(column)
    major = (2 * sums > counts[:, None]).astype(np.uint8)
    return np.packbits(major, axis=1, bitorder="little").view("<u8").ravel()


def with_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", key: Column | None = None) -> DataFrame:
    """(doc_id, fp) of each row, and its ``key`` (a long) if one is wanted; fp is the fingerprint as a signed long.

    It is 0 for a null text or one without words. Very long texts are read in parts. Other columns are ignored.
    """

    keyed = key is not None
    names = ["doc_id", "fp", *(["key"] if keyed else [])]

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", SLICE_BYTES):
                fp = fingerprints(part.column("text")).view(np.int64)
                cols = [part.column("doc_id"), pa.array(fp), *([part.column("key")] if keyed else [])]
                yield pa.RecordBatch.from_arrays(cols, names=names)

    src = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"), *([key.alias("key")] if keyed else []))
    kind = src.schema["doc_id"].dataType.simpleString()
    return mapped(src, measure, f"doc_id {kind}, fp long" + (", key long" if keyed else ""))
