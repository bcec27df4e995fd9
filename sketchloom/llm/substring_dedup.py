"""Removing word passages that occur more than once, by suffix automata of the corpus's repeated parts."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sketchloom.llm.shared import bitmap_of, mapped, with_bitmap_test, written
from sketchloom.llm.wordspan import Words, _other_powers, _prefix, _word_powers, mixed, slices

#: Words of a window; a passage is removed where windows of this length repeat.
WINDOW = 35
#: Words of the grams whose smallest hash names a window's group.
GRAM = 10
#: A group with more different segments than this is dealt out by single windows.
LARGE_GROUP = 2000
#: Segments, and bytes of their words, that a task gathers before it passes on the different ones.
GATHER, GATHER_BYTES = 100_000, 32 << 20
#: Bits of the filter for each repeated group, and its 64-bit words at least and at most (32 MB).
BITS_PER_KEY, MIN_FILTER, MAX_FILTER = 8, 1 << 14, 1 << 22


def sliding_min(x: np.ndarray, n: int) -> np.ndarray:
    """Smallest of each n consecutive values."""
    size, out = 1, x
    while 2 * size <= n:
        out = np.minimum(out[:-size], out[size:])
        size *= 2
    k = len(x) - n + 1
    return np.minimum(out[:k], out[n - size : n - size + k])


@dataclass
class Segments:
    """Runs of consecutive windows of a text that fall into the same group.

    A window's group is the smallest hash of its grams, so equal windows, wherever they are, are in the same
    group; neighbours mostly share one, so a run of windows travels as one segment.
    """

    key: np.ndarray  # group
    content: np.ndarray  # hash of all words of the segment
    windows: np.ndarray  # number of windows
    first: np.ndarray  # index of the first word among all words of the slice
    weight: np.ndarray  # how often the group's gram occurs in the segment
    words: np.ndarray  # hash of every word of the slice
    doc: np.ndarray  # text of each segment
    place: np.ndarray  # index of the first word in its text

    @classmethod
    def of(cls, column: pa.Array) -> Segments:
        w = Words(column)
        hashes = w.hashes()
        n = len(hashes) - WINDOW + 1
        at = np.flatnonzero(w.doc[:n] == w.doc[WINDOW - 1 :]) if n > 0 else np.zeros(0, np.int64)
        if not len(at):
            none = np.zeros(0, np.int64)
            return cls(none.astype(np.uint64), none.astype(np.uint64), none, none, none, hashes, none, none)
        sums, down = _prefix(hashes, _word_powers)
        grams = mixed((sums[GRAM:] - sums[:-GRAM]) * down[: len(sums) - GRAM])
        least = sliding_min(grams, WINDOW - GRAM + 1)[at]
        new = np.ones(len(at), bool)
        new[1:] = (least[1:] != least[:-1]) | (at[1:] != at[:-1] + 1)
        runs = np.flatnonzero(new)
        windows = np.diff(np.append(runs, len(at)))
        first, key = at[runs], least[runs]
        content = mixed((sums[first + windows + WINDOW - 1] - sums[first]) * down[first])
        spread = windows + WINDOW - GRAM
        begin = np.cumsum(spread) - spread
        same = grams[np.repeat(first - begin, spread) + np.arange(int(spread.sum()))] == np.repeat(key, spread)
        weight = np.add.reduceat(same.astype(np.int64), begin)
        doc = w.doc[first]
        return cls(key, content, windows, first, weight, hashes, doc, first - w.first[doc])

    def window_hashes(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For single windows of some segments: two independent hashes, and index of the first word."""
        n = self.windows[rows]
        at = np.repeat(self.first[rows] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        both = []
        for powers in (_word_powers, _other_powers):
            sums, down = _prefix(self.words, powers)
            both.append(mixed((sums[at + WINDOW] - sums[at]) * down[at]))
        return both[0], both[1], at


def _spark_hash(x: np.ndarray) -> np.ndarray:
    """Spark's xxhash64 of a long, with its default seed: what ``bitmap_of`` files a key under."""
    p1, p2, p3, p4, p5 = (
        np.uint64(p)
        for p in (11400714785074694791, 14029467366897019727, 1609587929392839161, 9650029242287828579, 2870177450012600261)
    )

    def rot(v: np.ndarray, r: int) -> np.ndarray:
        return (v << np.uint64(r)) | (v >> np.uint64(64 - r))

    with np.errstate(over="ignore"):
        h = np.full(len(x), np.uint64(42) + p5 + np.uint64(8), np.uint64)
        h = rot(h ^ (rot(x.view(np.uint64) * p2, 31) * p1), 27) * p1 + p4
        h = (h ^ (h >> np.uint64(33))) * p2
        h = (h ^ (h >> np.uint64(29))) * p3
    return h ^ (h >> np.uint64(32))


class KeyFilter:
    """A broadcast bitmap of groups; it may pass a group that is not in it, never the other way."""

    def __init__(self, keys: DataFrame):
        n = keys.count()
        self.size = MIN_FILTER
        while self.size * 64 < BITS_PER_KEY * n and self.size < MAX_FILTER:
            self.size *= 2
        bits = np.zeros(self.size, np.uint64)
        for part in bitmap_of(keys, F.col("key"), self.size).toArrow().to_batches() if n else []:
            bits[part.column("bm_word").to_numpy()] = part.column("bm_mask").to_numpy().view(np.uint64)
        self.bits = keys.sparkSession.sparkContext.broadcast(bits)

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        h = _spark_hash(keys).view(np.int64) % (self.size * 64)
        return (self.bits.value[h // 64] >> (h % 64).astype(np.uint64)) & np.uint64(1) != 0


def _source(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return docs.select(F.col(id_col).alias("doc_id"), text.alias("text")).withColumn("text_hash", F.xxhash64("text"))


def repeated_groups(docs: DataFrame) -> DataFrame:
    """(key, n): groups that hold two windows or more which could be equal."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                s = Segments.of(part.column("text"))
                key, which = np.unique(s.key, return_inverse=True)
                n = np.bincount(which, weights=s.weight, minlength=len(key)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(n)], names=["key", "n"])

    return mapped(docs.select("text"), run, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).filter("n > 1")


def large_groups(docs: DataFrame, groups: DataFrame) -> DataFrame:
    """(key): groups of more than LARGE_GROUP different segments, found among those with so many occurrences."""
    often = KeyFilter(groups.filter(F.col("n") > LARGE_GROUP).select("key"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                s = Segments.of(part.column("text"))
                hit = often(s.key)
                pair = np.unique(np.stack([s.key[hit], s.content[hit]], axis=1), axis=0).view(np.int64)
                cols = [pa.array(np.ascontiguousarray(pair[:, i])) for i in (0, 1)]
                yield pa.RecordBatch.from_arrays(cols, names=["key", "content"])

    found = mapped(docs.select("text"), run, "key long, content long").distinct()
    return found.groupBy("key").count().filter(F.col("count") > LARGE_GROUP).select("key")


class Automaton:
    """Generalized suffix automaton of word sequences, each with a number of copies."""

    def __init__(self) -> None:
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length, self.copies = [-1], [0], [0]

    def _add(self, length: int, after: dict[int, int], link: int) -> int:
        self.next.append(after)
        self.link.append(link)
        self.length.append(length)
        self.copies.append(0)
        return len(self.next) - 1

    def _clone(self, p: int, word: int, q: int) -> int:
        c = self._add(self.length[p] + 1, dict(self.next[q]), self.link[q])
        self.link[q] = c
        while p >= 0 and self.next[p].get(word) == q:
            self.next[p][word] = c
            p = self.link[p]
        return c

    def insert(self, words: list[int], copies: int) -> None:
        last = 0
        for word in words:
            q = self.next[last].get(word)
            if q is not None:
                last = q if self.length[q] == self.length[last] + 1 else self._clone(last, word, q)
            else:
                cur, p = self._add(self.length[last] + 1, {}, 0), last
                while p >= 0 and word not in self.next[p]:
                    self.next[p][word] = cur
                    p = self.link[p]
                if p >= 0:
                    q = self.next[p][word]
                    self.link[cur] = q if self.length[q] == self.length[p] + 1 else self._clone(p, word, q)
                last = cur
            self.copies[last] += copies

    def close(self) -> None:
        """Let each state count its occurrences: those of the longer ones that end with it are its own."""
        for v in sorted(range(1, len(self.next)), key=self.length.__getitem__, reverse=True):
            self.copies[self.link[v]] += self.copies[v]

    def repeated(self, words: list[int]) -> list[int]:
        """Starts of the windows of a sequence that occur twice or more, by its matching statistics."""
        out, v, n = [], 0, 0
        for i, word in enumerate(words):
            while v and word not in self.next[v]:
                v = self.link[v]
                n = self.length[v]
            if word in self.next[v]:
                v, n = self.next[v][word], n + 1
            while self.length[self.link[v]] >= WINDOW:  # only the last WINDOW words matter
                v = self.link[v]
            n = min(n, self.length[v])
            if n >= WINDOW and self.copies[v] > 1:
                out.append(i - WINDOW + 1)
        return out


def ranges(starts: list[int]) -> list[dict[str, int]]:
    out: list[dict[str, int]] = []
    for s in starts:
        if out and out[-1]["until"] == s:
            out[-1]["until"] = s + 1
        else:
            out.append({"from": s, "until": s + 1})
    return out


def judge(group: dict[int, tuple[int, bytes]]) -> Iterator[tuple[int, list[dict[str, int]]]]:
    """For the segments of a group, content -> (copies, words): the ranges of windows that repeat."""
    texts = {c: np.frombuffer(p, np.int64).tolist() for c, (_, p) in group.items()}
    automaton = Automaton()
    for c, words in texts.items():
        automaton.insert(words, group[c][0])
    automaton.close()
    for c, words in texts.items():
        found = ranges(automaton.repeated(words))
        if found:
            yield c, found


RANGES = "array<struct<from:int,until:int>>"


def repeated_ranges(docs: DataFrame, filters: tuple[KeyFilter, KeyFilter]) -> DataFrame:
    """(key, content, ranges): for each different segment with repeated windows, which of them repeat.

    Segments are dealt by group; each task builds the automaton of one group after the other, of its
    different segments with their numbers of copies, and streams them against it.
    """
    repeated, large = filters

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, int], list] = {}
        size = 0

        def out() -> pa.RecordBatch:
            nonlocal size
            size = 0
            rows = [(k, c, n, p) for (k, c), (n, p) in held.items()]
            held.clear()
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary())
            cols = [pa.array(x, t) for x, t in zip(zip(*rows), kinds)] if rows else [pa.array([], t) for t in kinds]
            return pa.RecordBatch.from_arrays(cols, names=["key", "content", "n", "words"])

        for batch in batches:
            for part in slices(batch, "text"):
                s = Segments.of(part.column("text"))
                hit = repeated(s.key)
                big = hit & large(s.key)
                rows = np.flatnonzero(hit & ~big)
                keys, contents, first = s.key[rows], s.content[rows], s.first[rows]
                ends = first + s.windows[rows] + WINDOW - 1
                if big.any():
                    hashes, others, at = s.window_hashes(np.flatnonzero(big))
                    keys, contents = np.concatenate([keys, hashes]), np.concatenate([contents, others])
                    first, ends = np.concatenate([first, at]), np.concatenate([ends, at + WINDOW])
                words = s.words
                for k, c, a, b in zip(keys.view(np.int64).tolist(), contents.view(np.int64).tolist(), first.tolist(), ends.tolist()):
                    seen = held.get((k, c))
                    if seen is None:
                        held[k, c] = [1, words[a:b].tobytes()]
                        size += 8 * (b - a)
                    else:
                        seen[0] += 1
                if len(held) > GATHER or size > GATHER_BYTES:
                    yield out()
        yield out()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, group, done = None, {}, []

        def out() -> pa.RecordBatch:
            kinds = (pa.int64(), pa.int64(), pa.list_(pa.struct([("from", pa.int32()), ("until", pa.int32())])))
            cols = [pa.array([d[i] for d in done], t) for i, t in enumerate(kinds)]
            done.clear()
            return pa.RecordBatch.from_arrays(cols, names=["key", "content", "ranges"])

        for batch in batches:
            columns = (batch.column(c).to_pylist() for c in ("key", "content", "n", "words"))
            for key, content, n, words in zip(*columns):
                if key != now:
                    done.extend((now, c, r) for c, r in judge(group)) if group else None
                    now, group = key, {}
                copies = group[content][0] if content in group else 0
                group[content] = (copies + n, words)
            if done:
                yield out()
        done.extend((now, c, r) for c, r in judge(group)) if group else None
        yield out()

    found = mapped(docs.select("text"), gather, "key long, content long, n long, words binary")
    dealt = found.repartition("key").sortWithinPartitions("key")
    return mapped(dealt, run, f"key long, content long, ranges {RANGES}")


def occurrences(docs: DataFrame, filters: tuple[KeyFilter, KeyFilter]) -> DataFrame:
    """(doc_id, text_hash, key, content, place) of every segment, or window of a large group, that may repeat."""
    repeated, large = filters

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                s = Segments.of(part.column("text"))
                hit = repeated(s.key)
                big = hit & large(s.key)
                rows = np.flatnonzero(hit & ~big)
                key, content, doc, place = s.key[rows], s.content[rows], s.doc[rows], s.place[rows]
                if big.any():
                    rows = np.flatnonzero(big)
                    hashes, others, at = s.window_hashes(rows)
                    key, content = np.concatenate([key, hashes]), np.concatenate([content, others])
                    doc = np.concatenate([doc, np.repeat(s.doc[rows], s.windows[rows])])
                    place = np.concatenate([place, at - np.repeat(s.first[rows] - s.place[rows], s.windows[rows])])
                take = pa.array(doc)
                cols = [part.column("doc_id").take(take), part.column("text_hash").take(take)]
                cols += [pa.array(key.view(np.int64)), pa.array(content.view(np.int64)), pa.array(place.astype(np.int32))]
                yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "text_hash", "key", "content", "place"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return mapped(docs, run, f"doc_id {kind}, text_hash long, key long, content long, place int")


def removed_spans(docs: DataFrame) -> DataFrame:
    """(doc_id, text_hash, spans): word ranges to remove from each document that has any."""
    groups = written(repeated_groups(docs), "substring-groups")
    filters = (KeyFilter(groups), KeyFilter(large_groups(docs, groups)))
    found = repeated_ranges(docs, filters).withColumnsRenamed({"key": "r_key", "content": "r_content"})
    seen = occurrences(docs, filters)
    hits = seen.join(found, (seen["key"] == found["r_key"]) & (seen["content"] == found["r_content"]))
    spans = F.transform("ranges", lambda r: F.struct((F.col("place") + r["from"]).alias("from"), (F.col("place") + r["until"] + WINDOW - 1).alias("until")))
    per_doc = hits.select("doc_id", "text_hash", spans.alias("spans")).groupBy("doc_id", "text_hash")
    return written(per_doc.agg(F.flatten(F.collect_list("spans")).alias("spans")), "substring-spans")


def remove_repeated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of ``docs``: doc_id, n_words, n_removed and kept, the words that stay joined by spaces.

    A word goes if a window of WINDOW consecutive words that covers it occurs again, in any document or
    elsewhere in its own; all occurrences go, and windows are judged on the input. Words are runs of
    characters other than ASCII white space, compared unchanged: a word by a 64-bit hash, what is equal beyond words by
    two, that of its group and that of its content.

    Windows are grouped by the smallest hash of their grams. Only groups that could hold two equal windows are
    looked at further, known to the tasks by a bitmap of bounded size. Their different segments, each with
    its number of copies, are dealt by group, and the suffix automaton of a group tells which windows repeat. A
    group with too many different segments is dealt out by single windows instead. Verdicts go back to
    documents by joins that adaptive execution can split; texts are shuffled only where something is removed.

    A null text has no words; a text of fewer than WINDOW words keeps all. Repeated rows, the same doc_id and
    text again, are occurrences of each other. A text longer than a slice is taken alone. An empty table gives no
    rows. Other columns are ignored, whatever their names.
    """
    src = _source(docs, id_col, text_col)
    spans = removed_spans(src)
    row = F.xxhash64("doc_id", "text_hash")
    tested = with_bitmap_test(src, bitmap_of(spans, row), F.xxhash64("doc_id", "text_hash"), "_hit")
    kind = spans.schema["spans"].dataType
    clean = tested.filter("not _hit").select("doc_id", "text", F.array().cast(kind).alias("spans"))
    other = spans.select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash"), "spans")
    some = tested.filter("_hit").join(other, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("text_hash") == F.col("_hash")), "left")
    some = some.select("doc_id", "text", F.coalesce("spans", F.array().cast(kind)).alias("spans"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                w = Words(part.column("text"))
                gone = np.zeros(len(w.starts) + 1, np.int32)
                lists = part.column("spans")
                flat = lists.flatten()
                doc = np.repeat(np.arange(part.num_rows), lists.value_lengths().to_numpy())
                np.add.at(gone, w.first[doc] + flat.field("from").to_numpy(), 1)
                np.add.at(gone, w.first[doc] + flat.field("until").to_numpy(), -1)
                stays = np.cumsum(gone[:-1]) == 0
                raw, kept = w.buf.tobytes(), []
                starts, ends = w.starts.tolist(), w.ends.tolist()
                for d in range(part.num_rows):
                    here = range(w.first[d], w.first[d + 1])
                    kept.append(b" ".join([raw[starts[i] : ends[i]] for i in here if stays[i]]))
                n_kept = np.bincount(w.doc[stays], minlength=w.n_texts)
                cols = [part.column("doc_id"), pa.array(w.counts.astype(np.int64)), pa.array((w.counts - n_kept).astype(np.int64))]
                cols.append(pa.array(kept, pa.binary()).cast(pa.string()))
                yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "n_words", "n_removed", "kept"])

    ident = src.schema["doc_id"].dataType.simpleString()
    return mapped(clean.unionByName(some), run, f"doc_id {ident}, n_words long, n_removed long, kept string")
