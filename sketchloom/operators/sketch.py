"""Sketch builders: small samples of column pairs that agree on which keys they keep."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sketchloom.functions.aggregates import aggregate, handler
from sketchloom.functions.hashing import hash_int_tuple, murmur3, unit_hash
from sketchloom.session import tuned

#: Sketch type to default budget: a number of keys or rows, or for GKMV a threshold.
TYPES = {"KMV": 256.0, "GKMV": 0.1, "TUPSK": 256.0, "PRISK": 256.0, "INDSK": 256.0}


@dataclass(frozen=True)
class SketchSpec:
    """What kind of sketch, how large, and what becomes of values that share a key."""

    type: str = "KMV"
    budget: float | None = None
    aggregate: str = "FIRST"
    seed: int = 1237

    def __post_init__(self) -> None:
        if self.type not in TYPES:
            raise ValueError(f"unknown sketch type: {self.type}")
        handler(self.aggregate)
        if self.type == "GKMV" and not 0 <= self.size <= 1:
            raise ValueError("the threshold must lie in [0, 1]")

    @property
    def size(self) -> float:
        return TYPES[self.type] if self.budget is None else float(self.budget)

    @property
    def k(self) -> int:
        return int(self.size)

    @property
    def unique_keys(self) -> bool:
        return self.aggregate != "NONE"

    def output_type(self, value_type: str) -> str:
        return handler(self.aggregate).output_type(value_type)


def chance(*cols: Column | str, seed: int) -> Column:
    """A seeded uniform number in [0, 1) from columns; the same wherever and whenever the row is processed."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), *cols), 11).cast("double") / F.lit(float(1 << 53))


def hashed(pairs: DataFrame, key_is_hash: bool = False) -> DataFrame:
    """(pair_id, ord, h, v) from rows (pair_id, ord, k, v)."""
    h = F.col("k").cast("int") if key_is_hash else murmur3(F.col("k"))
    return pairs.select("pair_id", "ord", h.alias("h"), "v")


def _smallest(df: DataFrame, k: int, *order: Column | str) -> DataFrame:
    """The k first rows of each pair, and whether there were more (``cut``); ranks are cut before the shuffle."""
    rank = F.row_number().over(Window.partitionBy("pair_id").orderBy(*order))
    kept = df.withColumn("rn", rank).filter(F.col("rn") <= k + 1)
    cut = F.max("rn").over(Window.partitionBy("pair_id")) > k
    return kept.withColumn("cut", cut).filter(F.col("rn") <= k).drop("rn")


def build_sketch(pairs: DataFrame, spec: SketchSpec, key_is_hash: bool = False) -> DataFrame:
    """Sketches of all pairs at once: rows (pair_id, h, u, v, n, cut).

    h is the key's hash, u its rank (the smallest are kept), v the value, n the number of rows of the key, and
    cut whether anything was left out. Keys are aggregated, with map-side combining, before they are ranked,
    and ranks are cut on the map side, so only a sketch's worth of keys from each task is shuffled by pair.
    """
    tuned(pairs.sparkSession)
    rows = hashed(pairs, key_is_hash)
    build = {"KMV": _kmv, "GKMV": _gkmv, "TUPSK": _tupsk, "PRISK": _prisk, "INDSK": _indsk}[spec.type]
    return build(rows, spec).select("pair_id", "h", "u", "v", "n", "cut")


def _by_key(rows: DataFrame, spec: SketchSpec) -> DataFrame:
    value = aggregate(spec.aggregate) if spec.unique_keys else F.lit(None).cast("double")
    return rows.groupBy("pair_id", "h").agg(value.alias("v"), F.count(F.lit(1)).alias("n")).withColumn("u", unit_hash(F.col("h")))


def _proportional(rows: DataFrame, keys: DataFrame, spec: SketchSpec) -> DataFrame:
    """For kept keys, min(k, max(1, floor(n / all rows * k))) rows each, drawn by a seeded order."""
    total = rows.groupBy("pair_id").agg(F.count(F.lit(1)).alias("seen"))
    quota = F.least(F.lit(spec.k), F.greatest(F.lit(1), F.floor(F.col("n") / F.col("seen") * spec.k)))
    wanted = keys.drop("v").join(total, "pair_id").withColumn("quota", quota)
    line = Window.partitionBy("pair_id", "h").orderBy(chance("ord", "h", seed=spec.seed), "ord")
    drawn = rows.join(wanted, ["pair_id", "h"]).withColumn("rn", F.row_number().over(line))
    return drawn.filter(F.col("rn") <= F.col("quota"))


def _kmv(rows: DataFrame, spec: SketchSpec) -> DataFrame:
    keys = _smallest(_by_key(rows, spec), spec.k, "u", "h")
    return keys if spec.unique_keys else _proportional(rows, keys, spec)


def _gkmv(rows: DataFrame, spec: SketchSpec) -> DataFrame:
    kept = rows.filter(unit_hash(F.col("h")) <= spec.size)
    if spec.unique_keys:
        return _by_key(kept, spec).withColumn("cut", F.lit(True))
    n = F.count(F.lit(1)).over(Window.partitionBy("pair_id", "h"))
    kept = kept.withColumns({"n": n, "u": unit_hash(F.col("h")), "cut": F.lit(True)})
    return kept.filter(chance("ord", "h", seed=spec.seed) <= spec.size)


def _tupsk(rows: DataFrame, spec: SketchSpec) -> DataFrame:
    if spec.unique_keys:
        keys = _by_key(rows, spec).withColumn("u", unit_hash(hash_int_tuple(F.col("h"), F.lit(1))))
        return _smallest(keys, spec.k, "u", "h")
    # The j-th row of a key, in row order, has a rank of its own.
    key = Window.partitionBy("pair_id", "h")
    tuples = rows.withColumns({"j": F.row_number().over(key.orderBy("ord")), "n": F.count(F.lit(1)).over(key)})
    tuples = tuples.withColumn("u", unit_hash(hash_int_tuple(F.col("h"), F.col("j"))))
    return _smallest(tuples, spec.k, "u", "h", "j")


def _prisk(rows: DataFrame, spec: SketchSpec) -> DataFrame:
    keys = _by_key(rows, spec).withColumn("u", F.col("u") / F.col("n"))
    keys = _smallest(keys, spec.k, "u", "h")
    return keys if spec.unique_keys else _proportional(rows, keys, spec)


def _indsk(rows: DataFrame, spec: SketchSpec) -> DataFrame:
    """Keys are kept by the smallest random rank of their rows, and only rows up to the last kept rank count."""
    ranked = rows.withColumn("r", chance("pair_id", "ord", "h", seed=spec.seed))
    keys = _smallest(ranked.groupBy("pair_id", "h").agg(F.min("r").alias("u")), spec.k, "u", "h")
    last = F.max("u").over(Window.partitionBy("pair_id"))
    kept = ranked.join(keys.withColumn("last", last), ["pair_id", "h"]).filter("r <= last")
    if not spec.unique_keys:
        return kept.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("pair_id", "h")))
    value = aggregate(spec.aggregate)
    return kept.groupBy("pair_id", "h", "u", "cut").agg(value.alias("v"), F.count(F.lit(1)).alias("n"))


def sketch_meta(sketch: DataFrame, spec: SketchSpec) -> DataFrame:
    """(pair_id, size, kth, seen_rows, distinct_ub, distinct_be) of each sketch.

    kth is 1 for a KMV that never left anything out, else the largest rank. distinct_ub is (size - 1) / kth,
    distinct_be size / kth.
    """
    size, largest = F.count_distinct("h"), F.max("u")
    kth = largest if spec.type == "GKMV" else F.when(F.max("cut"), largest).otherwise(F.lit(1.0))
    out = sketch.groupBy("pair_id").agg(size.alias("size"), kth.alias("kth"), F.sum("n").alias("seen_rows"))
    return out.withColumns({"distinct_ub": (F.col("size") - 1) / F.col("kth"), "distinct_be": F.col("size") / F.col("kth")})


def with_order(sketch: DataFrame, pairs: DataFrame, spec: SketchSpec) -> DataFrame:
    """The sketch with the order number of each key's value, ``at``, for a later merge of FIRST or LAST."""
    if spec.aggregate not in ("FIRST", "LAST"):
        return sketch
    edge = F.max("ord") if spec.aggregate == "LAST" else F.min("ord")
    at = hashed(pairs).groupBy("pair_id", "h").agg(edge.cast("long").alias("at"))
    return sketch.join(at, ["pair_id", "h"])


def merge_sketches(a: DataFrame, b: DataFrame, spec: SketchSpec) -> DataFrame:
    """The sketch of two disjoint sets of rows from theirs, for types and aggregates that allow it.

    Rows carry v and n; MEAN is merged by weight. FIRST and LAST go by the column ``at``, the order number of the
    value's row, if the sketches have it (see ``with_order``), else ``a`` comes before ``b``. A key that either side
    left out cannot come back, so its rank limit is kept: only keys below both sides' last ranks are complete.
    """
    if spec.type not in ("KMV", "GKMV"):
        raise NotImplementedError(f"{spec.type} needs all rows at once")
    ordered = "at" in a.columns and "at" in b.columns
    by = F.col("at") if ordered else F.col("side")
    merge = {
        "MAX": F.max("v"), "MIN": F.min("v"), "SUM": F.sum("v"), "COUNT": F.sum("v"),
        "MEAN": F.sum(F.col("v") * F.col("n")) / F.sum("n"), "FIRST": F.min_by("v", by), "LAST": F.max_by("v", by),
    }
    if spec.aggregate not in merge:
        raise NotImplementedError(f"{spec.aggregate} cannot be merged")
    both = a.withColumn("side", F.lit(0)).unionByName(b.withColumn("side", F.lit(1)))
    limit = F.min(F.when(F.col("cut"), F.col("last"))).over(Window.partitionBy("pair_id"))
    both = both.withColumn("last", F.max("u").over(Window.partitionBy("pair_id", "side"))).withColumn("limit", limit)
    both = both.filter(F.col("limit").isNull() | (F.col("u") <= F.col("limit")))
    at = [(F.max("at") if spec.aggregate == "LAST" else F.min("at")).alias("at")] if ordered else []
    keys = both.groupBy("pair_id", "h", "u").agg(merge[spec.aggregate].alias("v"), F.sum("n").alias("n"), F.max(F.col("limit").isNotNull()).alias("was_cut"), *at)
    if spec.type == "GKMV":
        return keys.withColumn("cut", F.lit(True)).drop("was_cut")
    kept = _smallest(keys, spec.k, "u", "h")
    return kept.withColumn("cut", F.col("cut") | F.max("was_cut").over(Window.partitionBy("pair_id"))).drop("was_cut")
