"""Wavelet matrix of token ids: one compressed file for a shard, with access, counting and occurrence lookup.

File layout, little-endian: MAGIC, then the header (counts), the documents (flag, id, number of tokens), the
number of zeros of each bit-plane, the directory of blocks (set bits before the block in its plane, byte
offset of its end), and the blocks, each compressed by itself. Planes go from the highest bit down; after each,
tokens are parted stably by their bit, zeros first.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import zstandard

MAGIC = b"WVMATRX1"
#: Bits in a block, the unit of compression and of the rank directory.
BLOCK_BITS = 1 << 16
#: Tokens that are parted at once.
PART = 1 << 15
_HEADER = np.dtype([("tokens", "<u8"), ("docs", "<u8"), ("planes", "<u4"), ("block", "<u4")])
_DOC = np.dtype([("known", "u1"), ("id", "<i8"), ("tokens", "<u8")])
_ENTRY = np.dtype([("ones", "<u8"), ("end", "<u8")])


def _parted(level: np.ndarray, bit: np.ndarray, zeros: int) -> np.ndarray:
    """Stably, those without the bit first; by parts, since the indexes of a part fit the cache."""
    out, low, high = np.empty_like(level), 0, zeros
    for at in range(0, len(level), PART):
        part, flags = level[at : at + PART], bit[at : at + PART]
        clear, ones = np.flatnonzero(~flags), np.flatnonzero(flags)
        out[low : low + len(clear)], out[high : high + len(ones)] = part[clear], part[ones]
        low, high = low + len(clear), high + len(ones)
    return out


def _unparted(level: np.ndarray, bit: np.ndarray, zeros: int) -> np.ndarray:
    """What ``_parted`` was given."""
    out, low, high = np.empty_like(level), 0, zeros
    for at in range(0, len(level), PART):
        part, flags = out[at : at + PART], bit[at : at + PART]
        clear, ones = np.flatnonzero(~flags), np.flatnonzero(flags)
        part[clear], part[ones] = level[low : low + len(clear)], level[high : high + len(ones)]
        low, high = low + len(clear), high + len(ones)
    return out


def encode_file(ids: np.ndarray, doc_ids: np.ndarray, known: np.ndarray, counts: np.ndarray) -> bytes:
    """The file of the tokens ``ids`` of documents with ``counts`` tokens each; ``known`` is false for a null id."""
    planes = max(1, int(ids.max()).bit_length()) if len(ids) else 1
    level = ids.astype(np.uint16 if planes <= 16 else np.uint32)
    zeros, entries, blocks, end = [], [], [], 0
    squeeze = zstandard.ZstdCompressor(level=1)
    for p in reversed(range(planes)):
        bit = (level & level.dtype.type(1 << p)).astype(bool)
        packed = np.packbits(bit, bitorder="little")
        ones = 0
        for at in range(0, len(packed), BLOCK_BITS // 8):
            raw = packed[at : at + BLOCK_BITS // 8]
            blocks.append(squeeze.compress(raw.tobytes()))
            end += len(blocks[-1])
            entries.append((ones, end))
            ones += int(np.bitwise_count(raw).sum(dtype=np.int64))
        zeros.append(len(level) - ones)
        level = _parted(level, bit, zeros[-1])
    docs = np.empty(len(counts), _DOC)
    docs["known"], docs["id"], docs["tokens"] = known, doc_ids, counts
    head = np.array([(len(ids), len(counts), planes, BLOCK_BITS)], _HEADER)
    parts = [MAGIC, head.tobytes(), docs.tobytes(), np.array(zeros, "<u8").tobytes(), np.array(entries, _ENTRY).tobytes()]
    return b"".join([*parts, *blocks])


class TokenFile:
    """A file made by ``encode_file``."""

    def __init__(self, data: bytes):
        if data[: len(MAGIC)] != MAGIC:
            raise ValueError("not a wavelet matrix file")
        at = len(MAGIC)

        def take(kind: np.dtype, n: int) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(data, kind, n, at)
            at += out.nbytes
            return out

        head = take(_HEADER, 1)[0]
        self.n, self.planes, self.block = int(head["tokens"]), int(head["planes"]), int(head["block"])
        self.docs = take(_DOC, int(head["docs"]))
        self.zeros = take(np.dtype("<u8"), self.planes).astype(np.int64)
        self.per_plane = -(-self.n // self.block)
        self.entries = take(_ENTRY, self.per_plane * self.planes)
        self.base, self.data = at, data
        self.raw_block = lru_cache(maxsize=256)(self._raw_block)

    def _raw_block(self, i: int) -> np.ndarray:
        begin = int(self.entries["end"][i - 1]) if i else 0
        packed = self.data[self.base + begin : self.base + int(self.entries["end"][i])]
        return np.frombuffer(zstandard.ZstdDecompressor().decompress(packed), np.uint8)

    def _bits(self, plane: int) -> np.ndarray:
        blocks = [self._raw_block(plane * self.per_plane + i) for i in range(self.per_plane)]
        return np.unpackbits(np.concatenate(blocks), bitorder="little")[: self.n].view(bool)

    def ids(self) -> np.ndarray:
        """All tokens in order: the parting of each plane undone, from the lowest bit up."""
        out = np.zeros(self.n, np.uint16 if self.planes <= 16 else np.uint32)
        for plane in reversed(range(self.planes) if self.n else []):
            bit, z = self._bits(plane), int(self.zeros[plane])
            out[z:] |= out.dtype.type(1 << (self.planes - 1 - plane))
            out = _unparted(out, bit, z)
        return out

    def _rank1(self, plane: int, i: int) -> int:
        """Set bits among the first i of a plane."""
        if i >= self.n:
            return self.n - int(self.zeros[plane])
        b, bit = divmod(i, self.block)
        raw = self.raw_block(plane * self.per_plane + b)
        ones = int(self.entries["ones"][plane * self.per_plane + b]) + int(np.bitwise_count(raw[: bit // 8]).sum(dtype=np.int64))
        return ones + (int(raw[bit // 8]) & ((1 << bit % 8) - 1)).bit_count()

    def _bit(self, plane: int, i: int) -> int:
        b, bit = divmod(i, self.block)
        return int(self.raw_block(plane * self.per_plane + b)[bit // 8]) >> bit % 8 & 1

    def access(self, i: int) -> int:
        """The token at place i."""
        value = 0
        for p in range(self.planes):
            bit, ones = self._bit(p, i), self._rank1(p, i)
            value = value << 1 | bit
            i = int(self.zeros[p]) + ones if bit else i - ones
        return value

    def _range(self, token: int, upto: int) -> tuple[int, int]:
        """Where the occurrences of a token among the first ``upto`` stand after the last plane."""
        a, b = 0, upto
        if token >> self.planes:
            return 0, 0
        for p in range(self.planes):
            ra, rb = self._rank1(p, a), self._rank1(p, b)
            z = int(self.zeros[p])
            a, b = (z + ra, z + rb) if token >> (self.planes - 1 - p) & 1 else (a - ra, b - rb)
        return a, b

    def count(self, token: int, upto: int | None = None) -> int:
        """How often a token occurs among the first ``upto`` (all if None)."""
        a, b = self._range(token, self.n if upto is None else min(upto, self.n))
        return b - a

    def _select(self, plane: int, bit: int, k: int) -> int:
        """The place of the k-th (from 0) bit of this value in a plane."""
        row = slice(plane * self.per_plane, (plane + 1) * self.per_plane)
        before = self.entries["ones"][row].astype(np.int64)
        if not bit:
            before = np.arange(self.per_plane) * self.block - before
        b = int(np.searchsorted(before, k, "right")) - 1
        flags = np.unpackbits(self.raw_block(plane * self.per_plane + b), bitorder="little")
        return b * self.block + int(np.flatnonzero(flags == bit)[k - int(before[b])])

    def occurrence(self, token: int, k: int) -> int:
        """The place of the k-th (from 0) occurrence of a token."""
        a, b = self._range(token, self.n)
        if not 0 <= k < b - a:
            raise IndexError(k)
        at = a + k
        for p in reversed(range(self.planes)):
            bit = token >> (self.planes - 1 - p) & 1
            at = self._select(p, bit, at - int(self.zeros[p]) if bit else at)
        return at
