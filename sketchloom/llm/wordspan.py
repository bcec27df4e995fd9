"""Words of many texts at once: numpy over the bytes of an Arrow string column.

Texts stay UTF-8 bytes. The word separators are ASCII, so a byte of a longer character is never one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that are taken at once; a longer text is taken alone.
SLICE_BYTES = 1 << 19
#: Bytes that one polynomial block covers.
BLOCK = 1 << 20

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True


def _draw(n: int, seed: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(0, 1 << 64, n, dtype=np.uint64)


#: A random value for each byte, and odd bases with their inverses modulo 2**64.
_BYTE = _draw(256, 11)
_BASE, _WBASE = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F


class _Powers:
    """Powers of an odd base and of its inverse, as far as they were needed."""

    def __init__(self, base: int):
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self.up = self.down = np.ones(1, np.uint64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            n = max(n, 2 * len(self.up))
            self.up, self.down = (
                np.concatenate([np.ones(1, np.uint64), np.multiply.accumulate(np.full(n - 1, b, np.uint64))])
                for b in (self.base, self.inverse)
            )
        return self.up[:n], self.down[:n]


_byte_powers, _word_powers, _other_powers = _Powers(_BASE), _Powers(_WBASE), _Powers(0x9FB21C651E98DF25)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def _prefix(values: np.ndarray, powers: _Powers) -> tuple[np.ndarray, np.ndarray]:
    up, down = powers.get(len(values) + 1)
    sums = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * up[: len(values)], out=sums[1:])
    return sums, down


def span_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each byte range; ranges are disjoint and in order."""
    out = np.zeros(len(starts), np.uint64)
    done = 0
    while done < len(starts):
        low = int(starts[done])
        upto = max(int(np.searchsorted(ends, low + BLOCK, "right")), done)
        if upto == done:  # one range longer than a block
            high, total, at = int(ends[done]), 0, 0
            for b in range(low, high, BLOCK):
                part = buf[b : min(b + BLOCK, high)]
                up, _ = _byte_powers.get(len(part) + 1)
                piece = int((_BYTE[part] * up[: len(part)]).sum(dtype=np.uint64))
                total, at = (total + piece * pow(_BASE, at, 1 << 64)) % (1 << 64), at + len(part)
            out[done], done = total, done + 1
            continue
        sums, down = _prefix(_BYTE[buf[low : int(ends[upto - 1])]], _byte_powers)
        s, e = starts[done:upto] - low, ends[done:upto] - low
        out[done:upto] = (sums[e] - sums[s]) * down[s]
        done = upto
    return mixed(out + (ends - starts).astype(np.uint64))


class Words:
    """The words of some texts: byte ranges ``starts``, ``ends`` in ``buf`` and the text ``doc`` of each."""

    def __init__(self, column: pa.Array):
        if column.null_count:
            column = pc.fill_null(column, "")
        if not pa.types.is_large_string(column.type):
            column = column.cast(pa.large_string())
        _, offsets, data = column.buffers()
        at = np.frombuffer(offsets, np.int64, len(column) + 1, column.offset * 8)
        raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
        self.buf = raw[at[0] : at[-1]]
        self.offsets = at - at[0]
        self.n_texts = len(column)
        word = ~SPACE[self.buf]
        self.word_bytes = word
        if len(self.buf):
            first = np.empty(len(word), bool)
            first[0], first[1:] = True, ~word[:-1]
            inner = self.offsets[:-1][self.offsets[:-1] < len(word)]
            first[inner] = True
            last = np.empty(len(word), bool)
            last[-1], last[:-1] = True, ~word[1:]
            ends = self.offsets[1:][self.offsets[1:] > 0]
            last[ends - 1] = True
            self.starts = np.flatnonzero(word & first)
            self.ends = np.flatnonzero(word & last) + 1
        else:
            self.starts = self.ends = np.zeros(0, np.int64)
        self.doc = np.searchsorted(self.offsets, self.starts, "right") - 1
        self.counts = np.bincount(self.doc, minlength=self.n_texts)
        #: Index of the first word of each text, and the end.
        self.first = np.concatenate([[0], np.cumsum(self.counts)])

    def hashes(self) -> np.ndarray:
        return span_hashes(self.buf, self.starts, self.ends)

    def per_text(self, flags: np.ndarray) -> np.ndarray:
        """Sum of a value for each byte over each text."""
        sums = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
        return sums[self.offsets[1:]] - sums[self.offsets[:-1]]

    def windows(self, hashes: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Hash of each run of ``size`` consecutive words that lies in one text, and the index of its first word."""
        n = len(hashes) - size + 1
        if n <= 0:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        at = np.flatnonzero(self.doc[:n] == self.doc[size - 1 :])
        sums, down = _prefix(hashes, _word_powers)
        return mixed((sums[at + size] - sums[at]) * down[at]), at


def slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Parts of a batch whose texts together have at most ``limit`` bytes, or one row."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    begin = total = 0
    for i, n in enumerate(sizes):
        if i > begin and total + n > limit:
            yield batch.slice(begin, i - begin)
            begin, total = i, 0
        total += n
    if begin < batch.num_rows:
        yield batch.slice(begin)
