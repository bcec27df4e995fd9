"""Cardinality, union, intersection, Jaccard and containment of key sets, from sketches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sketchloom.operators.sketch import SketchSpec, sketch_meta


def _require(spec: SketchSpec) -> None:
    if spec.type not in ("KMV", "GKMV"):
        raise NotImplementedError(f"{spec.type} sketches have no set operations")


def cardinality(sketch: DataFrame, spec: SketchSpec, known: dict[str, int] | None = None) -> DataFrame:
    """(pair_id, cardinality): a known number where there is one, else (size - 1) / kth."""
    meta = sketch_meta(sketch, spec).select("pair_id", F.col("distinct_ub").alias("cardinality"))
    if not known:
        return meta
    given = sketch.sparkSession.createDataFrame([(i, float(n)) for i, n in known.items()], "pair_id string, known double")
    return meta.join(given, "pair_id", "left").select("pair_id", F.coalesce("known", "cardinality").alias("cardinality"))


def quotient(top: Column, bottom: Column) -> Column:
    """top / bottom as doubles divide: NaN for 0 / 0 and for a null, infinite for others by 0."""
    top, nan = top.cast("double"), F.lit(float("nan"))
    by_zero = F.when(top > 0, F.lit(float("inf"))).when(top < 0, F.lit(float("-inf"))).otherwise(nan)
    value = F.when(F.isnan(top), nan).when(bottom == 0, by_zero).otherwise(top / F.when(bottom != 0, bottom))
    return F.coalesce(value, nan)


def _keys(sketch: DataFrame) -> DataFrame:
    return sketch.select("pair_id", "h", "u").distinct()


def _sizes(keys: DataFrame, side: str) -> DataFrame:
    return keys.groupBy("pair_id").agg(F.count(F.lit(1)).alias(f"{side}_size"), F.max("u").alias(f"{side}_last")).withColumnRenamed("pair_id", f"{side}_id")


def _with_sizes(ids: DataFrame, x: DataFrame, y: DataFrame, name: str) -> DataFrame:
    """Wanted pairs with the sizes and last ranks of both sides; a side without keys has size 0."""
    out = ids.join(x, "x_id", "left").join(y, "y_id", "left")
    return out.withColumns({f"{s}_{name}": F.coalesce(f"{s}_{name}", F.lit(0)) for s in "xy"})


def set_estimates(x: DataFrame, y: DataFrame, spec: SketchSpec, ids: DataFrame, known: dict[str, int] | None = None) -> DataFrame:
    """(x_id, y_id, union, jaccard, intersection, containment) for wanted pairs of sketches.

    KMV: k is the smaller size, kth the k-th smallest rank of the union; the union is (k - 1) / kth, Jaccard the
    common keys / k, and the intersection their product. GKMV: k is the size of the union, kth the larger of the
    last ranks. Containment is the intersection / the cardinality of x, which may be ``known``.

    Quotients are those of doubles: NaN for 0 / 0, infinite for others by 0. Every wanted pair has a row; what
    cannot be estimated, as a side has no keys, is NaN.
    """
    _require(spec)
    kx, ky = _keys(x), _keys(y)
    wanted = _with_sizes(ids, _sizes(kx, "x"), _sizes(ky, "y"), "size")
    left = wanted.join(kx.withColumnRenamed("pair_id", "x_id"), "x_id").withColumn("in_x", F.lit(1)).withColumn("in_y", F.lit(0))
    right = wanted.join(ky.withColumnRenamed("pair_id", "y_id"), "y_id").withColumn("in_x", F.lit(0)).withColumn("in_y", F.lit(1))
    base = ["x_id", "y_id", "x_size", "y_size", "x_last", "y_last"]
    keys = left.unionByName(right).groupBy(*base, "h", "u").agg((F.sum("in_x") + F.sum("in_y") == 2).alias("common"))
    if spec.type == "KMV":
        keys = keys.filter("x_size > 0 and y_size > 0")
    k = F.least("x_size", "y_size")
    if spec.type == "KMV":
        rank = F.row_number().over(Window.partitionBy("x_id", "y_id").orderBy("u", "h"))
        keys = keys.withColumn("rn", rank)
        kth, size = F.max(F.when(F.col("rn") <= k, F.col("u"))), F.max(k)
    else:
        kth, size = F.max(F.greatest("x_last", "y_last")), F.count(F.lit(1))
    found = keys.groupBy("x_id", "y_id").agg(kth.alias("kth"), size.alias("k"), F.sum(F.col("common").cast("int")).alias("common"))
    found = ids.join(found, ["x_id", "y_id"], "left")
    found = found.withColumns({"union": quotient(F.col("k") - 1, F.col("kth")), "jaccard": quotient(F.col("common"), F.col("k"))})
    found = found.withColumn("intersection", F.col("jaccard") * F.col("union"))
    cards = cardinality(x, spec, known).withColumnRenamed("pair_id", "x_id")
    found = found.join(cards, "x_id", "left").withColumn("containment", quotient(F.col("intersection"), F.col("cardinality")))
    return found.select("x_id", "y_id", "union", "jaccard", "intersection", "containment")


def stored_set_estimates(x: DataFrame, y: DataFrame, ids: DataFrame) -> DataFrame:
    """The same from stored sketches of any type, which keep rows and ranks only.

    k is the smaller number of rows, repeats included; only common keys up to the k-th rank of the union count;
    cardinality is (rows - 1) / last rank, and containment is kept within [0, 1]. Quotients, and pairs with a side
    without rows, are as for ``set_estimates``; a containment that is not a number stays so.
    """

    def sizes(sketch: DataFrame, side: str) -> DataFrame:
        out = sketch.groupBy("pair_id").agg(F.count(F.lit(1)).alias(f"{side}_rows"), F.max("u").alias(f"{side}_last"))
        return out.withColumnRenamed("pair_id", f"{side}_id")

    wanted = _with_sizes(ids, sizes(x, "x"), sizes(y, "y"), "rows")
    base = ["x_id", "y_id", "x_rows", "y_rows", "x_last", "y_last"]
    left = wanted.join(_keys(x).withColumnRenamed("pair_id", "x_id"), "x_id").select(*base, "h", "u", F.lit(1).alias("sides"))
    right = wanted.join(_keys(y).withColumnRenamed("pair_id", "y_id"), "y_id").select(*base, "h", "u", F.lit(2).alias("sides"))
    keys = left.unionByName(right).groupBy(*base, "h", "u").agg(F.sum("sides").alias("sides"))
    rank = F.row_number().over(Window.partitionBy("x_id", "y_id").orderBy("u", "h"))
    keys = keys.withColumns({"rn": rank, "k": F.least("x_rows", "y_rows")})
    within = F.col("rn") <= F.col("k")
    found = keys.groupBy(*base, "k").agg(
        F.max(F.when(within, F.col("u"))).alias("kth"), F.sum((within & (F.col("sides") == 3)).cast("int")).alias("common")
    )
    found = wanted.join(found.drop("x_rows", "y_rows", "x_last", "y_last"), ["x_id", "y_id"], "left")
    both = (F.col("x_rows") > 0) & (F.col("y_rows") > 0)
    found = found.withColumns({"union": quotient(F.col("k") - 1, F.when(both, F.col("kth"))), "jaccard": quotient(F.col("common"), F.when(both, F.col("k")))})
    found = found.withColumn("intersection", F.col("jaccard") * F.col("union"))
    found = found.withColumn("cardinality", quotient(F.col("x_rows") - 1, F.col("x_last")))
    raw = quotient(F.col("intersection"), F.col("cardinality"))
    inside = F.when(F.isnan(raw), raw).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), raw)))
    return found.select("x_id", "y_id", "cardinality", "union", "jaccard", "intersection", inside.alias("containment"))


def hash_collisions(keys: DataFrame, hashes: DataFrame) -> DataFrame:
    """One row: distinct keys, distinct hashes, collisions and their share, from (k) and (k, h) rows."""
    by_hash = hashes.groupBy("h").agg(F.count_distinct("k").alias("keys"))
    total = by_hash.agg(F.sum("keys").alias("n_keys"), F.count(F.lit(1)).alias("n_hashes"), F.sum(F.col("keys") - 1).alias("collisions"))
    return total.withColumn("share", F.col("collisions") / F.col("n_keys"))
