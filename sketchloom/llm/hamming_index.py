"""Linking 64-bit fingerprints within a Hamming distance by a Gray-order hierarchical index."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from sketchloom.llm.shared import drop_written, mapped, written

MAX_BITS = 3
#: Children of a node of the index.
FAN_OUT = 8
#: A bucket with more fingerprints is split on further bits.
BUCKET = 1 << 15
#: Node pairs that are expanded at once.
FRONTIER = 1 << 15
#: Rounds of star contraction: the number of nodes on a path shrinks by a constant factor in each.
MAX_ROUNDS = 60


def block_widths(width: int) -> list[int]:
    """Widths of MAX_BITS + 1 blocks of ``width`` bits: two values within MAX_BITS agree on one block."""
    n = MAX_BITS + 1
    return [(width + n - 1 - i) // n for i in range(n)]


def gray_rank(fp: Column) -> Column:
    """The position of a 64-bit value in Gray code order, shifted to sort as a signed long."""
    for k in (1, 2, 4, 8, 16, 32):
        fp = fp.bitwiseXOR(F.shiftrightunsigned(fp, k))
    return fp.bitwiseXOR(F.lit(-(1 << 63)).cast("long"))


def buckets(fps: DataFrame) -> DataFrame:
    """(key, fp) such that any two fingerprints within MAX_BITS share a key.

    A key stands for equal bits in one of MAX_BITS + 1 blocks. A key with more than BUCKET fingerprints is
    replaced by keys that fix a block of the bits it leaves open as well, and so on: each level leaves fewer
    open bits, and once 2**open bits is at most BUCKET nothing is left to split. So no link is lost and
    no bucket is larger than BUCKET, but for the rare keys whose hashes collide.
    """
    done, width = [], 64
    cand = fps.select("fp", F.col("fp").alias("open"), F.lit(0).cast("long").alias("key"))
    while True:
        options, low = [], 0
        for i, w in enumerate(block_widths(width)):
            value = F.shiftrightunsigned("open", low).bitwiseAND(F.lit((1 << w) - 1).cast("long"))
            above = F.shiftleft(F.shiftrightunsigned("open", low + w), low) if low + w < 64 else F.lit(0).cast("long")
            rest = above.bitwiseOR(F.col("open").bitwiseAND(F.lit((1 << low) - 1).cast("long")))
            options.append(F.struct(F.xxhash64("key", F.lit(i), value).alias("key"), rest.alias("open")))
            low += w
        cand = cand.select("fp", F.explode(F.array(*options)).alias("x")).select("fp", "x.key", "x.open")
        width -= min(block_widths(width))
        large = cand.groupBy("key").count().filter(F.col("count") > BUCKET).select(F.col("key").alias("large_key"))
        if 2**width <= BUCKET or not large.head(1):
            done.append(cand)
            break
        large = written(large, "simhash-large-keys")
        done.append(cand.join(large, cand["key"] == large["large_key"], "left_anti"))
        cand = cand.join(large, cand["key"] == large["large_key"], "left_semi")
    out = done[0].select("key", "fp")
    for more in done[1:]:
        out = out.unionByName(more.select("key", "fp"))
    return out


class GrayTree:
    """The index over fingerprints in (key, Gray rank) order; ``runs`` are the first rows of each key, and the end.

    Each node keeps the bits that all fingerprints under it share, as a mask and a pattern. A child repeats
    the shared bits of its parent, so that only bits beyond the parent's are compared on the way down.
    """

    def __init__(self, fps: np.ndarray, runs: np.ndarray):
        self.masks, self.patterns = [np.full(len(fps), ~np.uint64(0))], [fps]
        self.firsts: list[np.ndarray] = []  # first child of each node of the next level, and the end
        while len(runs) - 1 < len(self.masks[-1]):
            sizes = np.diff(runs)
            groups = -(-sizes // FAN_OUT)
            upper = np.concatenate([[0], np.cumsum(groups)])
            first = np.repeat(runs[:-1], groups) + FAN_OUT * (np.arange(upper[-1]) - np.repeat(upper[:-1], groups))
            masks, patterns = self.masks[-1], self.patterns[-1]
            one = patterns[first]
            spread = patterns ^ np.repeat(one, np.diff(np.append(first, len(patterns))))
            mask = np.bitwise_and.reduceat(masks, first) & ~np.bitwise_or.reduceat(spread & masks, first)
            self.masks.append(mask)
            self.patterns.append(one & mask)
            self.firsts.append(np.append(first, len(patterns)))
            runs = upper

    def links(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs of rows within MAX_BITS of each other under the same key, in parts."""
        top = np.arange(len(self.masks[-1]))
        zero = np.zeros(len(top), np.uint64)
        stack = [(len(self.masks) - 1, top, top, zero.astype(np.uint8), zero)]
        while stack:
            level, a, b, differ, known = stack.pop()
            if len(a) > FRONTIER:
                for i in range(0, len(a), FRONTIER):
                    s = slice(i, i + FRONTIER)
                    stack.append((level, a[s], b[s], differ[s], known[s]))
                continue
            shared = self.masks[level][a] & self.masks[level][b]
            fresh = (self.patterns[level][a] ^ self.patterns[level][b]) & shared & ~known
            differ = differ + np.bitwise_count(fresh)
            near = differ <= MAX_BITS
            a, b, differ, known = a[near], b[near], differ[near], shared[near]
            if not len(a):
                continue
            if not level:
                yield a[a != b], b[a != b]
                continue
            first = self.firsts[level - 1]
            na, nb = first[a + 1] - first[a], first[b + 1] - first[b]
            pair = np.repeat(np.arange(len(a)), na * nb)
            at = np.arange(len(pair)) - np.repeat(np.cumsum(na * nb) - na * nb, na * nb)
            ca, cb = first[a][pair] + at // nb[pair], first[b][pair] + at % nb[pair]
            half = ca <= cb  # a node paired with itself meets each pair of its children once
            stack.append((level - 1, ca[half], cb[half], differ[pair][half], known[pair][half]))


def roots_of(n: int, parts: Iterator[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """The smallest row that each of ``n`` rows is connected to."""
    up = np.arange(n)

    def find(x: np.ndarray) -> np.ndarray:
        r = up[x]
        while (up[r] != r).any():
            r = up[r]
        return r

    for a, b in parts:
        while True:
            ra, rb = find(a), find(b)
            apart = ra != rb
            if not apart.any():
                break
            low, high = np.minimum(ra, rb)[apart], np.maximum(ra, rb)[apart]
            np.minimum.at(up, high, low)
            a, b = a[apart], b[apart]
        up = find(np.arange(n))
    return up


def forest(table: pa.Table) -> pa.RecordBatch:
    """Edges (a, b) that connect what links connect under each key: at most one for each fingerprint."""
    keys = table.column("key").to_numpy()
    fps = table.column("fp").to_numpy().astype(np.int64).view(np.uint64)
    runs = np.append(np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])), len(keys))
    sizes = np.diff(runs)
    many = np.repeat(sizes > 1, sizes)  # a fingerprint alone under its key has no link
    fps, sizes = fps[many], sizes[sizes > 1]
    if not len(fps):
        return pa.RecordBatch.from_arrays([pa.array([], pa.int64())] * 2, names=["a", "b"])
    up = roots_of(len(fps), GrayTree(fps, np.concatenate([[0], np.cumsum(sizes)])).links())
    child = up != np.arange(len(fps))
    a, b = (pa.array(x.view(np.int64)) for x in (fps[child], fps[up[child]]))
    return pa.RecordBatch.from_arrays([a, b], names=["a", "b"])


def _forests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: pa.Table | None = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        table = table if held is None else pa.concat_tables([held, table])
        keys = table.column("key").to_numpy()
        if not len(keys):
            continue
        # The last key may go on in the next batch.
        whole = int(np.searchsorted(keys != keys[-1], False)) if keys[0] == keys[-1] else int(np.flatnonzero(keys != keys[-1])[-1]) + 1
        held = table.slice(whole)
        if whole:
            yield forest(table.slice(0, whole))
    if held is not None and held.num_rows:
        yield forest(held)


def link_forest(fps: DataFrame) -> DataFrame:
    """Edges (a, b) between distinct fingerprints with the same connected parts as all links within MAX_BITS."""
    keyed = buckets(fps).repartition("key").sortWithinPartitions("key", gray_rank(F.col("fp")))
    return mapped(keyed, _forests, "a long, b long").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node that each node of the edges (a, b) is connected to; roots included.

    Alternates the two star operations of Kiveris et al. (Connected Components in MapReduce and Beyond). Each
    is a minimum for each node, with map-side combining, and a join back that adaptive execution can split
    where one node has many edges.
    """
    def digest(found: DataFrame) -> Row:
        return found.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()

    edges = written(edges.select(F.least("a", "b").alias("v"), F.greatest("a", "b").alias("u")).filter("u <> v").distinct(), "cc-edges")
    before = digest(edges)
    for _ in range(MAX_ROUNDS):
        both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m")).withColumnRenamed("u", "n")
        large = both.filter("v > u").join(low, F.col("u") == F.col("n")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.filter("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m")).withColumnRenamed("u", "n")
        small = large.join(low, F.col("u") == F.col("n"))
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select(F.col("n").alias("u"), F.col("m").alias("v")))
        after = written(small.filter("u <> v").distinct(), "cc-edges")
        drop_written(edges)
        now, edges = digest(after), after
        if now == before:
            break
        before = now
    else:
        raise RuntimeError("the components did not settle")
    stars = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return stars.unionByName(stars.select(F.col("root").alias("node"), "root").distinct())


def near_groups(prints: DataFrame) -> DataFrame:
    """(doc_id, fp, component_id) for each row of (doc_id, fp); a further ``key`` of the rows is kept.

    Rows with equal fingerprints are one node, so a group of copies costs one node however large it is; a
    link joins nodes that differ in at most MAX_BITS bits. component_id is the smallest doc_id reachable, null
    doc_ids apart. Empty input gives no rows; repeated rows stay.
    """
    nodes = written(prints.groupBy("fp").agg(F.min("doc_id").alias("rep")), "simhash-nodes")
    linked = written(components(link_forest(nodes.select("fp"))), "simhash-components")
    labelled = nodes.join(linked, nodes["fp"] == linked["node"], "left").select("fp", "rep", F.coalesce("root", "fp").alias("label"))
    least = labelled.groupBy("label").agg(F.min("rep").alias("component_id"))
    found = labelled.join(least, "label").select(F.col("fp").alias("node_fp"), "component_id")
    return prints.join(found, prints["fp"] == found["node_fp"]).select(*prints.columns, "component_id")
