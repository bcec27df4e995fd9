"""BPE encoding and decoding by tree concatenation: texts and long pieces in halves, leaves by the tokenizers library."""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator
from contextlib import contextmanager
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer
from tokenizers.models import BPE
from tokenizers.pre_tokenizers import WhitespaceSplit

from sketchloom.llm.shared import mapped
from sketchloom.llm.wordspan import SPACE, Words, slices, span_hashes

#: A word of so many bytes or more is split into halves, quarters and so on down to pieces below it.
LONG_BYTES = 2048
#: A text of so many bytes or more is cut into halves, quarters and so on down to leaves below it.
LEAF_BYTES = 2048
#: Tokens on each side of a join in the first window inside a piece, and words on each side in that between leaves.
WINDOW, WINDOW_WORDS = 8, 1
#: Pieces that each of the two generations of a worker's memory holds at most, but for those of one slice; unless the
#: encoder is given a bound of its own.
MEMORY_PIECES = 1 << 17
#: Places of the table that finds frequent pieces by their hash, a power of two, and ids that its pieces may have in all.
TABLE_BITS, TABLE_IDS = 18, 1 << 21
#: Pieces that are handed to the library at once.
AT_ONCE = 4096
#: Bytes of text that are taken at once.
SLICE_BYTES = 1 << 19
# The pre-tokenizer's pattern for which words may be taken apart, and the marks that are.
LETTER_RUNS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
MARKS = b".,!?;:*$%#&"
#: How a piece is encoded.
LETTERS, OTHER, LONG = range(3)
#: Byte-level symbols: a byte that is no printable Latin-1 character stands for the next free one from 256 on.
_PRINTABLE = [*range(33, 127), *range(161, 173), *range(174, 256)]
BYTE_SYMBOLS = {b: 256 + i for i, b in enumerate(b for b in range(256) if b not in _PRINTABLE) if b != 32}

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_LOWER_LATIN = np.arange(256, dtype=np.uint8)
_LOWER_LATIN[[b for b in range(0x80, 0x9F) if b != 0x97]] += 32
#: The symbols of those bytes that stand in small letters of Latin-1, by Latin-1 character.
_LETTER_SYMBOLS = {chr(b): chr(BYTE_SYMBOLS[b]) for b in (0xC3, *range(0x80, 0xC0)) if b in BYTE_SYMBOLS}
_SMALL = np.isin(np.arange(256), list(range(97, 123)))
#: Second bytes of the small letters of Latin-1.
_SMALL_LATIN = np.isin(np.arange(256), [b for b in range(0x9F, 0xC0) if b != 0xB7])
_MARK = np.isin(np.arange(256), list(MARKS))
_ALNUM = np.array([chr(b).isascii() and chr(b).isalnum() for b in range(256)])


@contextmanager
def _threads(setting: str) -> Iterator[None]:
    """Whether the library encodes a batch in several threads; it reads this variable at each call."""
    name = "TOKENIZERS_PARALLELISM"
    before = os.environ.get(name)
    os.environ[name] = setting
    try:
        yield
    finally:
        if before is None:
            del os.environ[name]
        else:
            os.environ[name] = before


def _merges(model: dict) -> list[tuple[str, ...]]:
    return [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]


def _laid_out(at: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Indexes at, at + 1, ... of n values for each entry, one entry after the other."""
    upto = np.cumsum(n)
    return np.repeat(at - (upto - n), n) + np.arange(int(upto[-1]) if len(n) else 0)


def _cuts(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bounds of the leaves of all texts, and the depth of each text's tree (it has 2**depth leaves, some maybe empty).

    A cut stands before a character, mostly inside a word; one inside a run of LONG_BYTES or more without ASCII
    white space moves to the run's end, since such words have a tree of their own.
    """
    size = np.diff(offsets)
    depth = np.zeros(len(size), np.int64)
    while (deeper := (size >> depth) >= LEAF_BYTES).any():
        depth[deeper] += 1
    leaves = 1 << depth
    text = np.repeat(np.arange(len(size)), leaves - 1)
    place = _laid_out(np.ones(len(size), np.int64), leaves - 1)
    cuts, end = offsets[text] + size[text] * place // leaves[text], offsets[text + 1]
    if len(cuts):
        for _ in range(3):
            inner = cuts < end
            cuts[inner] += (buf[cuts[inner]] & 0xC0) == 0x80
        spaces = np.flatnonzero(SPACE[buf])
        at = np.searchsorted(spaces, cuts)
        after = np.minimum(np.append(spaces, len(buf))[at], end)
        before = np.maximum(np.insert(spaces, 0, -1)[at], offsets[text] - 1)
        cuts = np.where(after - before > LONG_BYTES, after, cuts)
    return np.sort(np.concatenate([offsets, cuts])), depth


def _owners(starts: np.ndarray, ends: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Which of the disjoint ranges hold one of the places ``at`` (sorted)."""
    return np.searchsorted(at, starts) < np.searchsorted(at, ends) if len(at) else np.zeros(len(starts), bool)


class _Table:
    """Ids of pieces by the hash of a piece, one piece for each place; a later piece takes the place of an earlier one."""

    def __init__(self, dtype: np.dtype):
        self.dtype = dtype
        self.clear()

    def clear(self) -> None:
        self.hashes = np.zeros(1 << TABLE_BITS, np.uint64)
        self.hashes[0] = (1 << 64) - 1  # an empty place has a hash that belongs elsewhere
        self.at, self.n = np.zeros(1 << TABLE_BITS, np.int64), np.zeros(1 << TABLE_BITS, np.int32)
        self.ids, self.used = np.zeros(1 << 16, self.dtype), 0

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Whether each piece is there, and where in ``ids`` its ids begin, and their number."""
        place = (hashes >> np.uint64(64 - TABLE_BITS)).astype(np.int64)
        return self.hashes[place] == hashes, self.at[place], self.n[place].astype(np.int64)

    def add(self, hashes: np.ndarray, ids: np.ndarray, n: np.ndarray, kept: int) -> np.ndarray:
        """Where in ``ids`` the ids of more pieces begin, which come one after the other; the first ``kept`` pieces stay."""
        if self.used + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids[: self.used], np.zeros(max(len(ids), self.used), self.dtype)])
        self.ids[self.used : self.used + len(ids)] = ids
        at = np.cumsum(n) - n + self.used
        self.used += int(n[:kept].sum())
        place, rows = np.unique((hashes[:kept] >> np.uint64(64 - TABLE_BITS)).astype(np.int64), return_index=True)
        self.hashes[place], self.at[place], self.n[place] = hashes[rows], at[rows], n[rows]
        return at


class WordEncoder:
    """Token ids of whole texts, equal to the library's ``encode(text, add_special_tokens=False).ids``.

    The tokenizer's pre-tokenizer drops white space and no normalizer joins characters across it, so a text's
    ids are those of its words (separated by ASCII white space), one after the other. Each distinct word is
    encoded once while it is remembered; the memory holds a bounded number of pieces in two generations, and before
    it a table finds most pieces by their hash alone.
    A tokenizer that keeps white space is refused.
    """

    # Texts in which white space must leave no trace.
    PROBES = ("a b", " a", "a ", "ab  cd", "a\nb", "\t1", "a \r\n . b")

    def __init__(self, path: str, memory: int | None = None):
        self.path, self.memory = path, memory
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        model = spec["model"]
        for probe in self.PROBES:
            apart = [i for word in probe.split() for i in self.tokenizer.encode(word, add_special_tokens=False).ids]
            if self.tokenizer.encode(probe, add_special_tokens=False).ids != apart:
                raise ValueError(f"the tokenizer does not drop white space: {path}")
        self.suffix = model.get("end_of_word_suffix") or ""
        # Pieces that end a word, without normalizer; many may be joined by spaces, which no symbol is.
        self.ending = Tokenizer(BPE(vocab=model["vocab"], merges=_merges(model), cache_capacity=0, end_of_word_suffix=self.suffix))
        self.ending.pre_tokenizer = WhitespaceSplit()
        self._inner: Tokenizer | None = None
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.added_pattern = re.compile("|".join(re.escape(t) for t in sorted(self.added, key=len, reverse=True)) or r"(?!)")
        size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.tokens = [self.tokenizer.id_to_token(i) or "" for i in range(size)]
        self.ends_piece = np.array([bool(self.suffix) and t.endswith(self.suffix) for t in self.tokens])
        self.dtype = np.dtype("<u2") if size <= 1 << 16 else np.dtype("<u4")
        self.young: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}
        self.table = _Table(self.dtype)
        #: Joins of leaves so far, and windows that had to grow.
        self.joins = self.grown = 0
        # What _pieces may assume: lower case and Unicode composition, letters apart from other characters.
        steps = [n["type"] for n in (spec["normalizer"] or {}).get("normalizers", [])]
        cut = [p["type"] for p in (spec["pre_tokenizer"] or {}).get("pretokenizers", [])]
        self.plain = (
            steps == ["NFC", "Replace", "Lowercase"]
            and cut == ["Split", "ByteLevel"]
            and spec["pre_tokenizer"]["pretokenizers"][0]["pattern"].get("Regex") == LETTER_RUNS
            and all(t.startswith("<|") for t in self.added)
        )

    @property
    def inner(self) -> Tokenizer:
        """For parts inside a word: the same merges, but their last symbol does not end it. Made when first needed."""
        if self._inner is None:
            with open(self.path, encoding="utf-8") as f:
                model = json.load(f)["model"]
            self._inner = Tokenizer(BPE(vocab=model["vocab"], merges=_merges(model), cache_capacity=0))
        return self._inner

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts one after the other, and the number of ids of each text."""
        words = Words(column)
        ids, n = self.encode_words(words)
        return ids, np.bincount(words.doc, weights=n, minlength=words.n_texts).astype(np.int64)

    def encode_words(self, words: Words) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all words one after the other, and the number of ids of each word."""
        with _threads("false"):  # tasks are parallel already; threads for single words cost more than they save
            buf, starts, ends, word = self._pieces(words)
            if not len(starts):
                return np.zeros(0, self.dtype), np.zeros(0, np.int64)
            if self.table.used > TABLE_IDS:
                self.table.clear()
            hashes = span_hashes(buf, starts, ends)
            found, at, n = self.table.find(hashes)
            rest = np.flatnonzero(~found)
            if len(rest):
                own, first, which, times = np.unique(hashes[rest], return_index=True, return_inverse=True, return_counts=True)
                # The table is for pieces that come again; those come first.
                order = np.argsort(times == 1, kind="stable")
                which = np.argsort(order)[which]
                first = rest[first[order]]
                packed = self._packed(buf, starts[first], ends[first])
                sizes = np.fromiter(map(len, packed), np.int64, len(packed)) // self.dtype.itemsize
                frequent = int((times > 1).sum())
                at[rest] = self.table.add(own[order], np.frombuffer(b"".join(packed), self.dtype), sizes, frequent)[which]
                n[rest] = sizes[which]
        ids = self.table.ids.take(_laid_out(at, n))
        return ids, np.bincount(word, weights=n, minlength=len(words.starts)).astype(np.int64)

    def encode_by_tree(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """What ``encode`` returns, by tree concatenation of the halves of each text.

        A text of LEAF_BYTES or more is cut into halves, quarters and so on, wherever that is. All leaves are
        encoded at once, as if each were a text, and neighbours are joined level by level. At a join, a window of words
        on both sides is encoded again as it stands in the text, pre-tokenization included. If its first word
        has the place and the ids that the left side gave it, and its last word those of the right side, the window
        replaces what the sides had there, since words do not depend on each other; else it grows on the side that
        disagrees. A window that has reached the end of a side agrees with it.
        """
        texts = pc.fill_null(column, "").cast(pa.large_string())
        _, offsets, data = texts.buffers()
        offsets = np.frombuffer(offsets, np.int64, len(texts) + 1, texts.offset * 8)
        buf = (np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8))[offsets[0] : offsets[-1]]
        offsets = offsets - offsets[0]
        bounds, depth = _cuts(buf, offsets)
        tree = _Spans(self, buf, bounds)
        first = np.cumsum(1 << depth) - (1 << depth)
        for level in range(int(depth.max(initial=0))):
            n = np.where(depth > level, (1 << depth) >> (level + 1), 0)
            middle = np.repeat(first, n) + (_laid_out(np.zeros(len(n), np.int64), n) << (level + 1)) + (1 << level)
            tree.join(bounds[middle - (1 << level)], bounds[middle], bounds[middle + (1 << level)])
        text = np.searchsorted(offsets, tree.starts, "right") - 1
        ids = tree.ids.take(_laid_out(tree.at, tree.n))
        return ids, np.bincount(text, weights=tree.n, minlength=len(texts)).astype(np.int64)

    def _pieces(self, w: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Bytes, and starts, ends and words of pieces whose ids, one after the other, are those of the texts.

        Pieces are words. Where the tokenizer is known to allow it, marks after a last letter or digit are a
        piece of their own, and the letters of a word wholly in ASCII and the letters of Latin-1 are written
        small, so that fewer pieces differ. Words with "<" might hold a special token and stay as they are.
        """
        buf, starts, ends = w.buf, w.starts, w.ends
        word = np.arange(len(starts))
        if not self.plain or not len(starts):
            return buf, starts, ends, word

        # Letters of Latin-1 are C3 and a second byte in UTF-8; all its letters are composed already.
        high = np.flatnonzero(buf >= 128)
        second = high[1:][(buf[high[1:] - 1] == 0xC3)] if len(high) else high
        at = second[(buf[second] != 0x97) & (buf[second] != 0xB7)]
        latin = np.zeros(len(buf), bool)
        latin[at] = True
        special = _owners(starts, ends, np.flatnonzero(buf == ord("<")))
        as_is = special | _owners(starts, ends, high[(buf[high] != 0xC3) & ~latin[high]])
        small = _LOWER[buf]
        small[at] = _LOWER_LATIN[buf[at]]
        kept = _laid_out(starts[as_is], (ends - starts)[as_is])
        small[kept] = buf[kept]
        core = ends.copy()
        rows = np.arange(len(starts))
        for _ in range(4):
            rows = rows[_MARK[buf[core[rows] - 1]]]
            core[rows] -= 1
            rows = rows[core[rows] > starts[rows]]
        if len(rows):  # longer runs of marks
            last = np.maximum.accumulate(np.where(_MARK[buf], np.int64(-1), np.arange(len(buf))))
            core[rows] = np.maximum(last[core[rows] - 1] + 1, starts[rows])
        letter = _ALNUM[buf[core - 1]] | (latin[core - 1] & ~as_is)
        two = (core > starts) & (core < ends) & letter & ~special
        at = np.arange(len(starts)) + np.cumsum(two) - two
        n = len(starts) + int(two.sum())
        out_starts, out_ends = np.empty(n, np.int64), np.empty(n, np.int64)
        out_starts[at], out_ends[at] = starts, np.where(two, core, ends)
        out_starts[at[two] + 1], out_ends[at[two] + 1] = core[two], ends[two]
        return small, out_starts, out_ends, np.repeat(word, 1 + two)

    def _packed(self, buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> list[bytes]:
        """The ids of distinct pieces, each packed as ``dtype``."""
        raw = buf.tobytes()
        pieces = [raw[s:e] for s, e in zip(starts.tolist(), ends.tolist())]
        if len(self.young) + len(pieces) > (self.memory or MEMORY_PIECES):
            self.old, self.young = self.young, {}
        found = list(map(self.young.get, pieces))
        unseen = [i for i, v in enumerate(found) if v is None]
        missing = []
        for i in unseen:
            v = self.old.get(pieces[i])
            if v is None:
                missing.append(i)
            else:
                found[i] = self.young[pieces[i]] = v
        missing = np.array(missing, np.int64)
        kind = self._kinds(buf, starts[missing], ends[missing])
        for k in (LETTERS, OTHER):
            rows = missing[kind == k].tolist()
            own = [pieces[i] for i in rows]
            values = self._letters(own) if k == LETTERS else self._others(own)
            self.young.update(zip(own, values))
            for i, v in zip(rows, values):
                found[i] = v
        for i in missing[kind == LONG].tolist():
            text = pieces[i].decode("utf-8", "replace")
            found[i] = self.young[pieces[i]] = np.array(self.encode_long(text), self.dtype).tobytes()
        return found

    def _kinds(self, buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """How each piece is encoded: small letters may skip the normalizer and the pre-tokenizer."""
        kind = np.where(ends - starts >= LONG_BYTES, LONG, OTHER)
        if self.plain and self.suffix and len(starts):
            size = ends - starts
            at = _laid_out(starts, size)
            letter = _SMALL[buf[at]] | (buf[at] == 0xC3) | ((buf[np.maximum(at - 1, 0)] == 0xC3) & _SMALL_LATIN[buf[at]])
            sums = np.concatenate([[0], np.cumsum(letter)])
            upto = np.cumsum(size)
            kind[(sums[upto] - sums[upto - size] == size) & (kind != LONG)] = LETTERS
        return kind

    def _split(self, ids: np.ndarray, counts: np.ndarray) -> list[bytes]:
        flat = ids.astype(self.dtype).tobytes()
        ends = (np.cumsum(counts) * self.dtype.itemsize).tolist()
        return [flat[a:b] for a, b in zip([0, *ends], ends)]

    def _letters(self, pieces: list[bytes]) -> list[bytes]:
        """Ids of pieces of small letters: joined by spaces, they cost one call; a token with the suffix ends each."""
        out: list[bytes] = []
        for at in range(0, len(pieces), AT_ONCE):
            text = b" ".join(pieces[at : at + AT_ONCE]).decode("latin-1")
            for char, symbol in _LETTER_SYMBOLS.items():
                text = text.replace(char, symbol)
            ids = np.array(self.ending.encode_batch_fast([text], add_special_tokens=False)[0].ids, self.dtype)
            out += self._split(ids, np.diff(np.flatnonzero(self.ends_piece[ids]), prepend=-1))
        return out

    def _others(self, pieces: list[bytes]) -> list[bytes]:
        """Ids of any pieces. Some at a time: the library's results take far more memory than their ids."""
        out: list[bytes] = []
        for at in range(0, len(pieces), AT_ONCE):
            texts = [p.decode("utf-8", "replace") for p in pieces[at : at + AT_ONCE]]
            ids = [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
            counts = np.fromiter(map(len, ids), np.int64, len(ids))
            out += self._split(np.fromiter(chain.from_iterable(ids), self.dtype, int(counts.sum())), counts)
        return out

    def encode_long(self, text: str) -> list[int]:
        """Ids of a text whose pieces may be very long."""
        out: list[int] = []
        at = 0
        for m in self.added_pattern.finditer(text):
            out += self._encode_plain(text[at : m.start()])
            out.append(self.added[m.group()])
            at = m.end()
        return out + self._encode_plain(text[at:])

    def _encode_plain(self, text: str) -> list[int]:
        norm = self.tokenizer.normalizer.normalize_str(text) if self.tokenizer.normalizer else text
        pieces = self.tokenizer.pre_tokenizer.pre_tokenize_str(norm) if self.tokenizer.pre_tokenizer else [(norm, None)]
        out: list[int] = []
        for piece, _ in pieces:
            out += self.encode_tree(piece)
        return out

    def encode_tree(self, piece: str) -> list[int]:
        """Ids of one piece by tree concatenation.

        The leaves are encoded in parallel, then neighbours are joined level by level. At a join, a window of
        tokens on either side is encoded again. If it begins with the left side's token at that place and ends
        with the right side's, every pair of neighbours in the joined sequence also stands in one that BPE
        made, and a sequence whose neighbours are all such is what BPE makes of the whole; else the window grows.
        """
        n = max(1, -(-len(piece) // LONG_BYTES))
        cuts = [len(piece) * i // n for i in range(n + 1)]
        leaves = [piece[a:b] for a, b in zip(cuts, cuts[1:])]
        with _threads("true"):
            parts = [e.ids for e in self.inner.encode_batch(leaves[:-1], add_special_tokens=False)]
        parts.append(self.ending.encode(leaves[-1], add_special_tokens=False).ids)
        while len(parts) > 1:
            pairs = range(0, len(parts) - 1, 2)
            joined = [self._join(parts[i], parts[i + 1], i + 2 == len(parts)) for i in pairs]
            parts = joined + ([parts[-1]] if len(parts) % 2 else [])
        return parts[0]

    def _join(self, left: list[int], right: list[int], last: bool) -> list[int]:
        i = j = WINDOW
        while True:
            i, j = min(i, len(left)), min(j, len(right))
            ends = last and j == len(right)
            symbols = "".join(self.tokens[t] for t in left[len(left) - i :] + right[:j])
            if ends and self.suffix:
                symbols = symbols[: -len(self.suffix)]
            new = (self.ending if ends else self.inner).encode(symbols, add_special_tokens=False).ids
            left_agrees = i == len(left) or new[0] == left[-i]
            right_agrees = j == len(right) or new[-1] == right[j - 1]
            if left_agrees and right_agrees:
                return left[: len(left) - i] + new + right[j:]
            i, j = i if left_agrees else 2 * i, j if right_agrees else 2 * j

    def decode(self, ids: np.ndarray) -> str:
        """What the library's ``decode(ids, skip_special_tokens=False)`` returns."""
        if self.tokenizer.decoder is not None:
            return self.tokenizer.decode(ids.tolist(), skip_special_tokens=False)
        tokens = self.tokens
        return " ".join([tokens[i] for i in ids.tolist()])


class _Spans:
    """The words of the leaves of some texts, with their ids; joins turn them into the words of the texts.

    Leaves are encoded some at a time, so what is held of a very long text are its words' places and ids.
    """

    def __init__(self, enc: WordEncoder, buf: np.ndarray, bounds: np.ndarray):
        self.enc, self.buf = enc, buf
        parts, low = [], 0
        while low < len(bounds) - 1:
            high = max(low + 1, int(np.searchsorted(bounds, bounds[low] + SLICE_BYTES, "right")) - 1)
            high = min(high, len(bounds) - 1)
            parts.append(self._encoded(bounds[low:high], np.diff(bounds[low : high + 1]))[:4])
            low = high
        parts = parts or [self._encoded(bounds[:0], bounds[:0])[:4]]
        self.starts, self.ends, self.n, self.ids = (np.concatenate(x) for x in zip(*parts))
        self.at = np.cumsum(self.n) - self.n

    def _encoded(self, place: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, ...]:
        """Starts, ends, numbers of ids, ids and ranges of the words in parts of the bytes, each taken as a text."""
        offsets = np.concatenate([[0], np.cumsum(size)])
        together = len(place) > 0 and bool((place[1:] == place[:-1] + size[:-1]).all())
        held = self.buf[place[0] : place[-1] + size[-1]] if together else self.buf[_laid_out(place, size)]
        column = pa.LargeStringArray.from_buffers(len(place), pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(held)))
        words = Words(column)
        ids, n = self.enc.encode_words(words)
        moved = (place - offsets[:-1])[words.doc]
        return words.starts + moved, words.ends + moved, n, ids, words.first

    def join(self, low: np.ndarray, cut: np.ndarray, high: np.ndarray) -> None:
        """Join the words in [low, cut) with those in [cut, high), for many joins that do not touch each other."""
        first, middle, last = (np.searchsorted(self.starts, x) for x in (low, cut, high))
        some = (first < middle) & (middle < last)
        first, middle, last = first[some], middle[some], last[some]
        self.enc.joins += len(middle)
        left = right = np.full(len(middle), WINDOW_WORDS)
        alive = np.ones(len(self.starts), bool)
        while len(middle):
            a, b = np.maximum(middle - left, first), np.minimum(middle + right, last)
            starts, ends, n, ids, upto = self._encoded(self.starts[a], self.ends[b - 1] - self.starts[a])
            at = np.cumsum(n) - n

            def agrees(old: np.ndarray, new: np.ndarray) -> np.ndarray:
                same = (self.starts[old] == starts[new]) & (self.ends[old] == ends[new]) & (self.n[old] == n[new])
                rows = np.flatnonzero(same)
                differ = self.ids[_laid_out(self.at[old[rows]], n[new[rows]])] != ids[_laid_out(at[new[rows]], n[new[rows]])]
                same[np.repeat(rows, n[new[rows]])[differ]] = False
                return same

            left_agrees = (a == first) | agrees(a, upto[:-1])
            right_agrees = (b == last) | agrees(b - 1, upto[1:] - 1)
            done = left_agrees & right_agrees
            words = np.diff(upto)
            new = _laid_out(upto[:-1][done], words[done])
            old = _laid_out(a[done], words[done])
            self.starts[old], self.ends[old], self.n[old] = starts[new], ends[new], n[new]
            self.at[old] = at[new] + len(self.ids)
            alive[_laid_out((a + words)[done], (b - a - words)[done])] = False
            if done.any():
                self.ids = np.concatenate([self.ids, ids])
            left, right = np.where(left_agrees, left, 2 * left)[~done], np.where(right_agrees, right, 2 * right)[~done]
            first, middle, last = first[~done], middle[~done], last[~done]
            self.enc.grown += len(middle)
        if not alive.all():
            self.starts, self.ends, self.n, self.at = (x[alive] for x in (self.starts, self.ends, self.n, self.at))


_encoders: dict[tuple[str, int | None], WordEncoder] = {}


def encoder(path: str, memory: int | None = None) -> WordEncoder:
    """The encoder for a tokenizer file, kept for as long as the worker lives."""
    if (path, memory) not in _encoders:
        _encoders[path, memory] = WordEncoder(path, memory)
    return _encoders[path, memory]


def bpe_round_trip(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of ``docs``: doc_id, ids (array of int) and decoded, the text that the ids stand for.

    Texts are encoded by tree concatenation (``encode_by_tree``): halves of a text, down to leaves below LEAF_BYTES,
    are encoded together, and windows that grow round each join are encoded again until both sides agree. ids are
    exactly those of the tokenizers library for the whole text, special tokens not added, without truncation or
    padding; strings of special tokens in a text become those tokens. decoded is the library's decoding of all ids.
    A null or empty text has no ids and decodes to the empty string. Rows are mapped one by one in slices of
    SLICE_BYTES, a longer text alone, its leaves some at a time: no shuffle; repeated rows are encoded each, an empty
    table gives no rows. Other columns play no part, whatever their names.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for batch in batches:
            for part in slices(batch, "text", SLICE_BYTES):
                ids, counts = enc.encode_by_tree(part.column("text"))
                ends = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(ids.astype(np.int32)))
                decoded = pa.array([enc.decode(ids[a:b]) for a, b in zip(ends, ends[1:])], pa.string())
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), lists, decoded], names=["doc_id", "ids", "decoded"])

    src = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    kind = src.schema["doc_id"].dataType.simpleString()
    return mapped(src, run, f"doc_id {kind}, ids array<int>, decoded string")
