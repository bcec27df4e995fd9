"""Joins of column pairs and of sketches."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sketchloom.functions.aggregates import aggregate, aggregate_many, handler
from sketchloom.operators.setops import quotient


def join_sketches(x: DataFrame, y: DataFrame, pairs: DataFrame | None = None) -> DataFrame:
    """(x_id, y_id, h, xv, yv): all pairs of sketches joined on key hashes in one equi-join, m:n within a key.

    ``pairs`` (x_id, y_id) restricts which sketches meet. Without it those of ``x`` meet all of ``y``.
    """
    left = x.select(F.col("pair_id").alias("x_id"), "h", F.col("v").alias("xv"))
    right = y.select(F.col("pair_id").alias("y_id"), "h", F.col("v").alias("yv"))
    if pairs is None:
        return left.join(right, "h").select("x_id", "y_id", "h", "xv", "yv")
    return left.join(pairs, "x_id").join(right, ["y_id", "h"]).select("x_id", "y_id", "h", "xv", "yv")


def aggregate_pair(pairs: DataFrame, functions: list[str]) -> DataFrame:
    """(pair_id, k, one column for each function): one row for each distinct key."""
    return pairs.groupBy("pair_id", "k").agg(*aggregate_many(functions))


def full_join(a: DataFrame, b: DataFrame, function: str) -> DataFrame:
    """(k, xv, yv): both sides aggregated by the same function before the join on the key itself."""
    left = a.groupBy("k").agg(aggregate(function).alias("xv"))
    right = b.groupBy("k").agg(aggregate(function).alias("yv"))
    return left.join(right, "k")


def left_join(a: DataFrame, b: DataFrame, function: str) -> DataFrame:
    """(k, ord, xv, yv): every row of ``a`` with a match, against ``b`` aggregated by key; rows without are dropped."""
    right = b.groupBy("k").agg(aggregate(function).alias("yv"))
    return a.select("k", "ord", F.col("v").alias("xv")).join(right, "k")


def left_join_stats(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row: how many rows of ``a`` have no, one, or more matches in ``b``."""
    counts = b.groupBy("k").agg(F.count(F.lit(1)).alias("n"))
    # Rows of a are counted by key first, so a heavy key costs one row in the join.
    keys = a.groupBy("k").agg(F.count(F.lit(1)).alias("rows"))
    joined = keys.join(counts, "k", "left")

    def total(test):
        return F.coalesce(F.sum(F.when(test, F.col("rows"))), F.lit(0)).cast("long")

    return joined.agg(
        total(F.col("n").isNull()).alias("join_1to0"), total(F.col("n") == 1).alias("join_1to1"), total(F.col("n") > 1).alias("join_1ton")
    )


def overlap(pairs: DataFrame, ids: DataFrame) -> DataFrame:
    """(x_id, y_id, x_keys, y_keys, intersection, union, jaccard, containment) of distinct keys, for wanted pairs.

    A column without keys has 0 of them; a share of nothing is NaN.
    """
    keys = pairs.select("pair_id", "k").distinct()
    sizes = keys.groupBy("pair_id").agg(F.count(F.lit(1)).alias("keys"))
    left = keys.withColumnRenamed("pair_id", "x_id").join(ids, "x_id")
    both = left.join(keys.withColumnRenamed("pair_id", "y_id"), ["y_id", "k"])
    both = both.groupBy("x_id", "y_id").agg(F.count(F.lit(1)).alias("common"))
    x, y = (sizes.select(F.col("pair_id").alias(f"{s}_id"), F.col("keys").alias(f"{s}_keys")) for s in "xy")
    out = ids.join(x, "x_id", "left").join(y, "y_id", "left").join(both, ["x_id", "y_id"], "left")
    out = out.withColumns({c: F.coalesce(c, F.lit(0)).cast("long") for c in ("x_keys", "y_keys")})
    out = out.withColumn("intersection", F.coalesce("common", F.lit(0)).cast("long"))
    out = out.withColumn("union", F.col("x_keys") + F.col("y_keys") - F.col("intersection")).drop("common")
    shares = {"jaccard": quotient(F.col("intersection"), F.col("union")), "containment": quotient(F.col("intersection"), F.col("x_keys"))}
    return out.withColumns(shares)


def combinations(catalog: DataFrame, within_dataset: bool = False, limit: int | None = None, seed: int = 0) -> DataFrame:
    """(x_id, y_id) of all two-element sets of pair ids.

    Within each dataset this is an equi-join on the dataset. Over all, at most ``limit`` ids (drawn by a seeded
    hash) are paired: the result has their square, so the limit is what bounds it. Both sides are dealt into
    blocks and a block meets each other one once, so no pair comparison is done by a nested loop over a side.
    """
    ids = catalog.select("dataset_id", "pair_id").distinct()
    if within_dataset:
        left, right = (ids.select("dataset_id", F.col("pair_id").alias(n)) for n in ("x_id", "y_id"))
        return left.join(right, "dataset_id").filter("x_id < y_id").select("x_id", "y_id")
    if limit is not None:
        ids = ids.orderBy(F.xxhash64("pair_id", F.lit(seed)), "pair_id").limit(limit)
    blocks = max(1, math.isqrt(max(1, ids.count()) // 64))
    dealt = ids.select("pair_id", F.pmod(F.xxhash64("pair_id"), F.lit(blocks)).alias("block"))
    others = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    left = dealt.select(F.col("pair_id").alias("x_id"), F.col("block").alias("bx"), others.alias("by"))
    right = dealt.select(F.col("pair_id").alias("y_id"), F.col("block").alias("by"), others.alias("bx"))
    return left.join(right, ["bx", "by"]).filter("x_id < y_id").select("x_id", "y_id")


def type_matches(function: str, value_type: str) -> bool:
    """Whether a function accepts values of a type; used by the information jobs to choose functions."""
    return value_type in handler(function).accepts


def task_part(ids: DataFrame, total: int, task: int) -> DataFrame:
    """The share of one of several independent runs: rows dealt by a stable hash."""
    return ids.filter(F.pmod(F.xxhash64(*ids.columns), F.lit(total)) == task)

