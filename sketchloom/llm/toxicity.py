"""Toxicity by a learned lexicon: Levenshtein automata over its trie, and scores of context windows."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sketchloom.llm.langid import fold
from sketchloom.llm.shared import mapped, written
from sketchloom.llm.wordspan import Words, slices, span_hashes

#: Labelled documents that are read at most, the first in the order of a hash of the id.
TRAIN_DOCS = 20_000
#: Size of the classifier: terms of the lexicon at most (the best by G2, further ones are left out), and candidates
#: that the driver looks at to choose them; ordinary words at most are twice as many as candidates.
TERMS, CANDIDATES = 300, 3000
#: Lengths of prefixes that may be terms; a prefix term stands for all words that begin with it.
PREFIXES = range(4, 9)
#: Least likelihood ratio statistic and odds ratio of a term: chance alone does not reach this in millions of terms.
LEAST_G2, LEAST_ODDS = 26.0, 5.0
#: Edits that a word of a term's length may have: none below the first length, one from it, two from the second.
ONE_EDIT, TWO_EDITS = 5, 9
#: Share of the weight that is left at each edit, and inside quotation marks.
EDIT_SHARE, QUOTED_SHARE = 0.6, 0.25
#: Words on either side of a hit that are its context.
CONTEXT = 6
#: States that the automaton remembers before it starts anew.
STATES = 60_000
THRESHOLD = 0.7

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Characters that may surround a word.
EDGES = ".,;:!?\"'()[]{}<>|*$%#&_~`-«»“”‘’„…"


class TermAutomaton:
    """All Levenshtein automata of a lexicon at once, run over its trie.

    A state is the set of trie nodes that a word's first letters can have reached, each with the fewest edits
    used. States are made when they are first met and remembered, so a letter of a word usually costs
    one lookup, and a word that no term is near to ends after a few letters.
    """

    def __init__(self, words: dict[str, float], prefixes: dict[str, float], ordinary: frozenset[str] = frozenset(), beginnings: frozenset[str] = frozenset()):
        #: A word below a prefix term counts as the better of the two.
        self.words = {w: max([weight, *(v for p, v in prefixes.items() if w.startswith(p))]) for w, weight in words.items()}
        #: Words that are near to a term but are words of their own, and such beginnings near to a prefix term.
        self.prefixes, self.ordinary, self.beginnings = prefixes, ordinary, beginnings
        self.children: list[dict[str, int]] = [{}]
        self.word_of: list[float] = [0.0]
        self.prefix_of: list[float] = [0.0]
        self.allowed: list[int] = [0]
        #: Edits of a term that ends at the node, and letters before it: the same for a word and a prefix.
        self.edits: list[int] = [0]
        self.depth: list[int] = [0]
        for terms, weights in ((self.words, self.word_of), (prefixes, self.prefix_of)):
            for term, weight in sorted(terms.items()):
                n = (len(term) >= ONE_EDIT) + (len(term) >= TWO_EDITS)
                self.allowed[0] = max(self.allowed[0], n)
                node = 0
                for c in term:
                    if c not in self.children[node]:
                        self.children[node][c] = len(self.children)
                        self.children.append({})
                        for values in (self.word_of, self.prefix_of, self.allowed, self.edits):
                            values.append(0)
                        self.depth.append(self.depth[node] + 1)
                    node = self.children[node][c]
                    self.allowed[node] = max(self.allowed[node], n)
                weights[node] = max(weights[node], weight)
                self.edits[node] = n
        self._restart()

    def _restart(self) -> None:
        self.ids: dict[frozenset, int] = {frozenset(): 0}
        self.sets: list[frozenset] = [frozenset()]
        self.next: list[dict[str, int]] = [{}]
        self.value: list[float] = [0.0]
        #: Prefix terms that are reached: letters and weight of each.
        self.heads: list[list[tuple[int, float]]] = [[]]
        self.start = self._state(self._closed({0: 0}))

    def _closed(self, nodes: dict[int, int]) -> dict[int, int]:
        """With the nodes reached by letters that the word leaves out."""
        todo = list(nodes)
        while todo:
            node = todo.pop()
            used = nodes[node] + 1
            for child in self.children[node].values():
                if used <= self.allowed[child] and used < nodes.get(child, 99):
                    nodes[child] = used
                    todo.append(child)
        return nodes

    def _state(self, nodes: dict[int, int]) -> int:
        key = frozenset(nodes.items())
        if key not in self.ids:
            self.ids[key] = len(self.sets)
            self.sets.append(key)
            self.next.append({})
            best, heads = 0.0, []
            for node, used in nodes.items():
                if self.word_of[node] and used <= self.edits[node]:
                    best = max(best, self.word_of[node] * EDIT_SHARE**used)
                if self.prefix_of[node] and used <= self.edits[node]:
                    heads.append((self.depth[node], self.prefix_of[node] * EDIT_SHARE**used))
            self.value.append(best)
            self.heads.append(heads)
        return self.ids[key]

    def _step(self, state: int, c: str) -> int:
        after: dict[int, int] = {}
        for node, used in self.sets[state]:
            hit = self.children[node].get(c)
            if hit is not None and used < after.get(hit, 99):
                after[hit] = used
            if used < self.allowed[node]:
                if used + 1 < after.get(node, 99):
                    after[node] = used + 1
                for child in self.children[node].values():
                    if used + 1 <= self.allowed[child] and used + 1 < after.get(child, 99):
                        after[child] = used + 1
        found = self._state(self._closed(after))
        self.next[state][c] = found
        return found

    def _reached(self, word: str) -> tuple[float, float, list[tuple[int, float]]]:
        """Weights of the best prefix term that the word begins with and of the best term that the whole word is near to,
        and of each prefix term that a beginning is near to, with the length of the beginning.

        Prefix terms come from longer words, so a word shorter than the term is none of them.
        """
        if len(self.sets) > STATES:
            self._restart()
        state, node, best = self.start, 0, 0.0
        near: list[tuple[int, float]] = []
        for i, c in enumerate(word, 1):
            if node >= 0:
                node = self.children[node].get(c, -1)
                if node >= 0 and self.prefix_of[node] > best:
                    best = self.prefix_of[node]
            after = self.next[state].get(c)
            state = self._step(state, c) if after is None else after
            if self.heads[state]:
                near += [(i, weight) for length, weight in self.heads[state] if length <= len(word)]
            if not state and node < 0:
                break
        return best, self.value[state], near

    def weight(self, word: str) -> float:
        """The weight of the best term that the word is, begins with, or is or begins within its edits of; else 0."""
        if word in self.words:
            return self.words[word]
        best, whole, near = self._reached(word)
        if (whole or near) and word not in self.ordinary:
            best = max([best, whole, *(weight for i, weight in near if word[:i] not in self.beginnings)])
        return best

    def misspelled(self, word: str) -> bool:
        """Whether the word is none of the terms and begins with none, but counts as one for its few edits."""
        if word in self.words or any(word.startswith(p) for p in self.prefixes):
            return False
        return self.weight(word) > 0

    def near_beginnings(self, word: str) -> list[str]:
        """Beginnings of the word that are near to a prefix term."""
        return [word[:i] for i in sorted({i for i, _ in self._reached(word)[2]})]


def _bare(words: list[bytes]) -> list[str]:
    return [w.decode("utf-8", "replace").lower().strip(EDGES) for w in words]


def evidence(automaton: TermAutomaton, column: pa.Array) -> dict[str, np.ndarray]:
    """For each text: weight of its hits in all, without the largest, and for each hundred words.

    A hit counts more with other hits in its context window (up to twice as much), and QUOTED_SHARE of that
    where the window shows it inside quotation marks: an odd number of marks before it in the text, and one
    more within the window after it.
    """
    w = Words(column)
    n_texts = w.n_texts
    total, largest = np.zeros(n_texts), np.zeros(n_texts)
    if len(w.starts):
        buf = _LOWER[w.buf]
        _, first, which = np.unique(span_hashes(buf, w.starts, w.ends), return_index=True, return_inverse=True)
        raw = buf.tobytes()
        words = _bare([raw[s:e] for s, e in zip(w.starts[first].tolist(), w.ends[first].tolist())])
        weights = np.fromiter(map(automaton.weight, words), float, len(words))[which]
        at = np.flatnonzero(weights)
        if len(at):
            doc = w.doc[at]
            place = at + doc * np.int64(4 * CONTEXT)  # texts are far apart
            near = np.searchsorted(place, place + CONTEXT, "right") - np.searchsorted(place, place - CONTEXT) - 1
            mark = _quote_marks(w.buf)
            marks = np.concatenate([[0], np.cumsum(mark, dtype=np.int64)])
            before = marks[w.starts[at]] - marks[w.offsets[doc]]
            inside = marks[w.ends[at]] - marks[w.starts[at]]
            last = np.minimum(at + CONTEXT, w.first[doc + 1] - 1)
            after = marks[w.ends[last]] - marks[w.starts[at]]
            lead = mark[w.starts[at]]
            quoted = ((before % 2 == 1) & (after > 0)) | (lead & (before % 2 == 0) & (after > 1)) | (inside > 1)
            value = weights[at] * (1 + np.minimum(near, 4) / 4) * np.where(quoted, QUOTED_SHARE, 1.0)
            total = np.bincount(doc, weights=value, minlength=n_texts)
            np.maximum.at(largest, doc, value)
    return {"evidence": total, "others": np.maximum(total - largest, 0), "density": 100 * total / np.maximum(w.counts, 1)}


def _quote_marks(buf: np.ndarray) -> np.ndarray:
    """First bytes of quotation marks: the straight one, angle ones and curly double ones."""
    mark = buf == 0x22
    if len(buf) > 2:
        two = (buf[:-1] == 0xC2) & ((buf[1:] == 0xAB) | (buf[1:] == 0xBB))
        mark[:-1] |= two
        three = (buf[:-2] == 0xE2) & (buf[1:-1] == 0x80) & ((buf[2:] == 0x9C) | (buf[2:] == 0x9D) | (buf[2:] == 0x9E))
        mark[:-2] |= three
    return mark


EVIDENCE = ["evidence", "others", "density"]


def inputs(found: dict[str, np.ndarray]) -> np.ndarray:
    columns = [np.log1p(np.asarray(found[k], float)) for k in EVIDENCE]
    return np.stack([np.ones(len(columns[0])), *columns], axis=1)


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.05) -> np.ndarray:
    """Newton's method; weights of evidence may not be negative."""
    beta = np.zeros(x.shape[1])
    prior = np.full(x.shape[1], ridge)
    prior[0] = 1e-4
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        grad = x.T @ (y - p) - prior * beta
        hess = (x * (p * (1 - p))[:, None]).T @ x + np.diag(prior)
        move = np.linalg.solve(hess, grad)
        beta = beta + np.clip(move, -2, 2)
        beta[1:] = np.maximum(beta[1:], 0.0)
        if np.abs(move).max() < 1e-8:
            break
    return beta


def labelled_rows(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(text, toxic) of at most TRAIN_DOCS labelled documents whose fold (crc32 of the id modulo 3) is not 1."""
    fit = labels.filter("toxic is not null and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    fit = fit.filter(fold(F.col("doc_id"), 3) != 1).orderBy(F.xxhash64("doc_id"), "doc_id").limit(TRAIN_DOCS)
    fit = F.broadcast(fit.select(F.col("doc_id").alias("_id"), F.col("toxic").cast("int").alias("toxic")))
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.join(fit, F.col("id") == F.col("_id")).select("text", "toxic")


def candidate_terms(rows: DataFrame) -> DataFrame:
    """(term, prefix, t, n): in how many toxic and other labelled documents a word or prefix occurs."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                terms, prefix, toxic = [], [], []
                for text, label in zip(part.column("text").to_pylist(), part.column("toxic").to_pylist()):
                    words = set(_bare((text or "").encode().split()))
                    words.discard("")
                    heads = {w[:n] for w in words for n in PREFIXES if len(w) > n}
                    terms += [*words, *heads]
                    prefix += [False] * len(words) + [True] * len(heads)
                    toxic += [label] * (len(words) + len(heads))
                cols = [pa.array(terms, pa.string()), pa.array(prefix, pa.bool_()), pa.array(toxic, pa.int32())]
                yield pa.RecordBatch.from_arrays(cols, names=["term", "prefix", "toxic"])

    found = mapped(rows, cut, "term string, prefix boolean, toxic int")
    return found.groupBy("term", "prefix").agg(
        F.sum(F.when(F.col("toxic") == 1, 1).otherwise(0)).alias("t"), F.sum(F.when(F.col("toxic") == 1, 0).otherwise(1)).alias("n")
    )


def learn_lexicon(rows: DataFrame) -> tuple[dict[str, float], dict[str, float]]:
    """Words and prefixes with a weight each.

    Terms are ranked by the likelihood ratio statistic G2 of their document counts. Of prefixes that begin alike
    (one a prefix of the other) only the best is kept. Whole words beside a prefix are kept as well, beyond TERMS: they
    may be longer than the prefix, and be misspelled in more letters. The weight grows with the log odds ratio.
    """
    toxic, other = rows.agg(F.sum(F.when(F.col("toxic") == 1, 1).otherwise(0)), F.sum(F.when(F.col("toxic") == 1, 0).otherwise(1))).first()
    toxic, other = toxic or 0, other or 0
    if not toxic or not other:
        return {}, {}
    all_docs = float(toxic + other)

    def part(seen, expected):
        return F.when(seen > 0, seen * F.log(seen / expected)).otherwise(0.0)

    seen = F.col("t") + F.col("n")
    g2 = 2 * (
        part(F.col("t"), seen * (toxic / all_docs))
        + part(F.col("n"), seen * (other / all_docs))
        + part(toxic - F.col("t"), (all_docs - seen) * (toxic / all_docs))
        + part(other - F.col("n"), (all_docs - seen) * (other / all_docs))
    )
    odds = ((F.col("t") + 0.5) / (toxic - F.col("t") + 0.5)) / ((F.col("n") + 0.5) / (other - F.col("n") + 0.5))
    ranked = candidate_terms(rows).filter("t >= 3").withColumns({"g2": g2, "odds": odds})
    ranked = ranked.filter((F.col("g2") >= LEAST_G2) & (F.col("odds") >= LEAST_ODDS))
    # Of a word and a prefix with the same evidence the word is taken: it may be misspelled.
    best = ranked.orderBy(F.desc("g2"), "prefix", F.desc(F.length("term")), "term").limit(CANDIDATES).collect()
    words: dict[str, float] = {}
    prefixes: dict[str, float] = {}
    beside: dict[str, float] = {}
    for r in best:
        if any(r.term.startswith(p) or p.startswith(r.term) for p in prefixes):
            if not r.prefix:
                beside[r.term] = math.log(r.odds)
            continue
        if len(words) + len(prefixes) == TERMS or (r.prefix and any(w.startswith(r.term) for w in words)):
            continue
        (prefixes if r.prefix else words)[r.term] = math.log(r.odds)
    return words | beside, prefixes


def ordinary_words(rows: DataFrame, automaton: TermAutomaton) -> tuple[frozenset[str], frozenset[str]]:
    """Words, and beginnings of words, that only edits make a term of, and that labelled documents do not show to be toxic."""

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, list[tuple[str, bool]]] = {}
        for batch in batches:
            for part in slices(batch, "text"):
                words, begins, toxic = [], [], []
                for text, label in zip(part.column("text").to_pylist(), part.column("toxic").to_pylist()):
                    found: set[tuple[str, bool]] = set()
                    for word in set(_bare((text or "").encode().split())):
                        if word not in known:
                            odd = automaton.misspelled(word)
                            known[word] = [(word, False), *((b, True) for b in automaton.near_beginnings(word))] if odd else []
                        found.update(known[word])
                    for word, begin in found:
                        words.append(word)
                        begins.append(begin)
                        toxic.append(label)
                cols = [pa.array(words, pa.string()), pa.array(begins, pa.bool_()), pa.array(toxic, pa.int32())]
                yield pa.RecordBatch.from_arrays(cols, names=["word", "begins", "toxic"])

    found = mapped(rows, near, "word string, begins boolean, toxic int").groupBy("word", "begins")
    found = found.agg(F.sum(F.when(F.col("toxic") == 1, 0).otherwise(1)).alias("n"), F.count(F.lit(1)).alias("docs"))
    best = found.filter("n > 0 and 2 * n >= docs").orderBy(F.desc("n"), "word", "begins").limit(2 * CANDIDATES).collect()
    return frozenset(r.word for r in best if not r.begins), frozenset(r.word for r in best if r.begins)


def fit_toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[TermAutomaton, np.ndarray]:
    """The automaton of the learned lexicon, and the weights that turn evidence into a probability.

    The sample of labelled rows is written once and read for each step. Labels without id or value are not used, of
    several of a document the highest counts; with none left, or an empty table, nothing is learned and every
    text gets the same low score. Columns other than the named ones are ignored.
    """
    rows = written(labelled_rows(docs, labels, id_col, text_col), "toxicity-sample")
    words, prefixes = learn_lexicon(rows)
    automaton = TermAutomaton(words, prefixes, *ordinary_words(rows, TermAutomaton(words, prefixes)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                got = evidence(automaton, part.column("text"))
                cols = [*(pa.array(got[k], pa.float64()) for k in EVIDENCE), part.column("toxic")]
                yield pa.RecordBatch.from_arrays(cols, names=[*EVIDENCE, "toxic"])

    seen = mapped(rows, run, ", ".join(f"{k} double" for k in EVIDENCE) + ", toxic int").toPandas()
    seen = seen.sort_values([*EVIDENCE, "toxic"])
    if seen.empty:
        return automaton, np.array([-3.0, 0.0, 0.0, 0.0])
    return automaton, fit_logistic(inputs(seen), (seen["toxic"] == 1).to_numpy(float))


def score_toxicity(docs: DataFrame, automaton: TermAutomaton, beta: np.ndarray, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of ``docs``: doc_id, held_out, score, predicted, evidence and density.

    Whole texts are read; a word is looked up once in a slice of texts. A null or empty text has no
    evidence and gets the score of such texts. held_out is false for a null id. Repeated rows are scored alike, a
    text longer than a slice alone; an empty table gives no rows. Other columns are ignored, whatever their names.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", 1 << 20):
                got = evidence(automaton, part.column("text"))
                score = 1 / (1 + np.exp(-np.clip(inputs(got) @ beta, -30, 30)))
                cols = [part.column("doc_id"), *(pa.array(x, pa.float64()) for x in (score, got["evidence"], got["density"]))]
                yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "score", "evidence", "density"])

    src = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    kind = src.schema["doc_id"].dataType.simpleString()
    found = mapped(src, run, f"doc_id {kind}, score double, evidence double, density double")
    held = F.coalesce(fold(F.col("doc_id"), 3) == 1, F.lit(False))
    predicted = F.when(F.col("score") >= THRESHOLD, 1).otherwise(0)
    return found.select("doc_id", held.alias("held_out"), "score", predicted.alias("predicted"), "evidence", "density")
