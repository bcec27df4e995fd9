"""Whole evaluation jobs: estimates from sketches against exact joins, for many pairs of columns at once."""

from __future__ import annotations

import time
from collections.abc import Callable
from functools import reduce
from itertools import product

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sketchloom.functions.aggregates import CATEGORICAL, NUMERICAL, handler
from sketchloom.functions import kernels as kernels_module
from sketchloom.functions.hashing import murmur3
from sketchloom.functions.stats import kurtosis_columns
from sketchloom.operators.correlation import estimate, grouped_many, information, mi_mle, spearman
from sketchloom.operators.joins import join_sketches, left_join
from sketchloom.operators.setops import hash_collisions, set_estimates
from sketchloom.operators.sketch import SketchSpec, build_sketch
from sketchloom.plans.evaluation import MIN_ROWS, exact_truth
from sketchloom.plans.params import sketch_name

#: Sketch sizes of the budget comparison.
BUDGETS = (128, 256, 512, 1024)
PAIR = ["x_id", "y_id"]
#: Estimators of the statistics job; a sample is sketch-sized, so all run in one pass over it.
SAMPLE_KERNELS = {
    "pearson": kernels_module.pearson, "spearman": kernels_module.spearman, "rin": kernels_module.rin,
    "qn": kernels_module.qn_correlation, "pm1": lambda x, y: kernels_module.pm1_bootstrap(x, y)["mean"],
}


def correlation_stats(pairs: DataFrame, ids: DataFrame, specs: list[SketchSpec]) -> DataFrame:
    """For each pair and sketch: set estimates, correlations and moments of the sample, exact values, and errors.

    Every column is sketched once for each parameter, and all pairs are joined in one shuffle. Pairs whose exact
    overlap is below MIN_ROWS keys are left out.
    """
    # Truth, sketches and samples are read several times each, and are small: kept in memory or on disk.
    exact = {}
    for function in {s.aggregate for s in specs}:
        exact[function] = exact_truth(pairs, ids, function).filter(F.col("intersection") >= MIN_ROWS).persist()
    parts = []
    for spec in specs:
        truth = exact[spec.aggregate]
        wanted = truth.select(*PAIR)
        sketch = build_sketch(pairs, spec).persist()
        joined = join_sketches(sketch, sketch, wanted).persist()
        moments = joined.groupBy(*PAIR).agg(
            F.count(F.lit(1)).alias("sample"), F.min("xv").alias("x_min"), F.max("xv").alias("x_max"), F.min("yv").alias("y_min"),
            F.max("yv").alias("y_max"), F.var_samp("xv").alias("x_var"), F.var_samp("yv").alias("y_var"),
            kurtosis_columns("xv")["big_g2"].alias("x_kurtosis"), kurtosis_columns("yv")["big_g2"].alias("y_kurtosis"),
        )
        out = truth.join(moments, PAIR, "left")
        if spec.type in ("KMV", "GKMV"):
            sets = set_estimates(sketch, sketch, spec, wanted)
            out = out.join(sets.select(*PAIR, *[F.col(c).alias(f"{c}_est") for c in ("union", "jaccard", "intersection", "containment")]), PAIR, "left")
        else:
            out = out.withColumns({f"{c}_est": F.lit(None).cast("double") for c in ("union", "jaccard", "intersection", "containment")})
        kernels = {f"{n}_est": k for n, k in SAMPLE_KERNELS.items()}
        out = out.join(grouped_many(joined, kernels), PAIR, "left")
        out = out.withColumn("pearson_delta", F.col("pearson") - F.col("pearson_est"))
        parts.append(out.withColumns({"parameters": F.lit(sketch_name(spec)), "aggregate": F.lit(spec.aggregate)}))
    result = parts[0]
    for p in parts[1:]:
        result = result.unionByName(p)
    return result


def information_stats(pairs: DataFrame, ids: DataFrame, spec: SketchSpec, x_type: str, y_type: str, function: str) -> DataFrame:
    """For each pair: mutual information, entropies and normalized forms of the left join and (``_est``) of the sketch join, and a rank-correlation bound.

    The left side keeps its rows, the right is aggregated by ``function``, which must accept its type. Numerical
    columns have the entropies of MUTUAL_INFORMATION_DIFF_ENT_MIXED. Class counts are null unless both are categorical.
    """
    if y_type not in handler(function).accepts:
        raise ValueError(f"{function} does not accept {y_type}")
    out_type = handler(function).output_type(y_type)
    left = pairs.select(F.col("pair_id").alias("x_id"), "k", F.col("v").alias("xv")).join(ids, "x_id")
    # A function is given columns of the type that it accepts only.
    rights = pairs.join(ids.select(F.col("y_id").alias("pair_id")).distinct(), "pair_id", "left_semi")
    right = rights.groupBy("pair_id", "k").agg(handler(function).build(F.col("v"), F.col("ord")).alias("yv")).withColumnRenamed("pair_id", "y_id")
    full = left.join(right, ["y_id", "k"])
    # Only wanted columns are hashed.
    lefts = pairs.join(ids.select(F.col("x_id").alias("pair_id")).distinct(), "pair_id", "left_semi")
    x_sketch = build_sketch(lefts, SketchSpec(spec.type, spec.budget, "NONE" if spec.type == "TUPSK" else "FIRST"))
    y_sketch = build_sketch(rights, SketchSpec(spec.type, spec.budget, function))
    sample = join_sketches(x_sketch, y_sketch, ids)
    estimator = "MUTUAL_INFORMATION_DIFF_ENT_MIXED"
    exact = information(full, estimator, x_type, out_type).withColumnRenamed("n", "rows")
    approx = information(sample, estimator, x_type, out_type).withColumnRenamed("n", "sample")
    approx = approx.withColumnsRenamed({c: f"{c}_est" for c in approx.columns if c not in (*PAIR, "sample")})
    ranks = spearman(sample).select(*PAIR, F.col("value").alias("spearman_est"))
    out = exact.join(approx, PAIR, "left").join(ranks, PAIR, "left")
    rho = F.col("spearman_est")
    bound = F.when(F.abs(rho) < 1, -0.5 * (1 - 0.122 * F.pow(rho, 2.0) + 0.053 * F.pow(rho, 12.0)) * F.log(1 - rho * rho))
    return out.withColumns({"mi_bound": bound, "function": F.lit(function), "parameters": F.lit(sketch_name(spec))})


def information_report(pairs: DataFrame, ids: DataFrame, specs: list[SketchSpec]) -> DataFrame:
    """The information job of all wanted pairs and sketches, whatever their types; a pair is left out where the
    sketch's function does not accept its right column.
    """
    parts = []
    for spec in specs:
        for x_type, y_type in product((NUMERICAL, CATEGORICAL), sorted(handler(spec.aggregate).accepts)):
            part = information_stats(pairs, typed_pairs(pairs, ids, x_type, y_type), spec, x_type, y_type, spec.aggregate)
            parts.append(part.withColumns({"x_type": F.lit(x_type), "y_type": F.lit(y_type)}))
    return reduce(DataFrame.unionByName, parts)


def timed(spark: SparkSession, steps: dict[str, Callable[[], DataFrame]], repeats: int = 1) -> DataFrame:
    """(step, run, ns, rows): wall time of running each step to the end, for performance reports."""
    rows = []
    for name, make in steps.items():
        for run in range(repeats):
            began = time.perf_counter_ns()
            n = make().count()
            rows.append((name, run, time.perf_counter_ns() - began, n))
    return spark.createDataFrame(rows, "step string, run int, ns long, rows long")


def correlation_performance(pairs: DataFrame, ids: DataFrame, spec: SketchSpec, repeats: int = 1) -> DataFrame:
    """Times of sketch building, sketch join, estimators on the sample, and the exact join."""
    sketch = build_sketch(pairs, spec)
    steps: dict[str, Callable[[], DataFrame]] = {
        "build": lambda: sketch,
        "join": lambda: join_sketches(sketch, sketch, ids),
        "full_join": lambda: exact_truth(pairs, ids, spec.aggregate),
    }
    for name in ("PEARSONS", "SPEARMANS", "RIN", "ROBUST_QN"):
        steps[name.lower()] = lambda name=name: estimate(join_sketches(sketch, sketch, ids), name)
    return timed(pairs.sparkSession, steps, repeats)


def performance_report(pairs: DataFrame, ids: DataFrame, specs: list[SketchSpec]) -> DataFrame:
    """Times of each sketch, with its parameters and function."""
    parts = [correlation_performance(pairs, ids, s).withColumns({"parameters": F.lit(sketch_name(s)), "aggregate": F.lit(s.aggregate)}) for s in specs]
    return reduce(DataFrame.unionByName, parts)


def information_performance(pairs: DataFrame, ids: DataFrame, spec: SketchSpec, x_type: str, y_type: str, function: str) -> DataFrame:
    """Times of the information job as a whole and of its exact join alone."""

    def exact() -> DataFrame:
        x = pairs.join(ids.select(F.col("x_id").alias("pair_id")).distinct(), "pair_id")
        y = pairs.join(ids.select(F.col("y_id").alias("pair_id")).distinct(), "pair_id")
        return left_join(x, y, function)

    return timed(pairs.sparkSession, {"full_join": exact, "job": lambda: information_stats(pairs, ids, spec, x_type, y_type, function)})


def information_scalability(spark: SparkSession, sizes: tuple[int, ...] = (5_000, 10_000, 20_000), samples: int = 10, trials: int = 64, seed: int = 0) -> DataFrame:
    """(rows, sample, mi, exact, ns) of the discrete estimator on multinomial samples of growing size."""
    from sketchloom.sources.synthetic import multinomial, multinomial_mi

    truth, rows = multinomial_mi(trials, 0.3, 0.5), []
    for size in sizes:
        for i in range(samples):
            data = multinomial(spark, trials, 0.3, 0.5, size, seed=seed + i).select(F.lit("x").alias("x_id"), F.lit("y").alias("y_id"), F.col("X").alias("xv"), F.col("Y").alias("yv"))
            began = time.perf_counter_ns()
            value = mi_mle(data).first()["mi"]
            rows.append((size, i, float(value), truth, time.perf_counter_ns() - began))
    return spark.createDataFrame(rows, "rows int, sample int, mi double, exact double, ns long")


def budget_equivalence(keys: DataFrame, budgets: tuple[int, ...] = BUDGETS) -> DataFrame:
    """(k, n_columns, n_keys, budget, tau): the threshold at which all columns keep as much as with size k each."""
    totals = keys.groupBy("dataset_id", "key_name").agg(F.count_distinct("k").alias("n"))
    totals = totals.agg(F.count(F.lit(1)).alias("n_columns"), F.sum("n").alias("n_keys"))
    sizes = F.explode(F.array(*[F.lit(b) for b in budgets])).alias("k")
    out = totals.select(sizes, "n_columns", "n_keys").withColumn("budget", F.col("k").cast("long") * F.col("n_columns"))
    return out.withColumn("tau", F.col("budget") / F.col("n_keys"))


def collision_report(keys: DataFrame) -> DataFrame:
    """Hash collisions among the keys of all columns."""
    distinct = keys.select("k").distinct()
    return hash_collisions(distinct, distinct.select("k", murmur3(F.col("k")).alias("h")))


def run_estimators(pairs: DataFrame, ids: DataFrame, spec: SketchSpec, estimators: list[str]) -> DataFrame:
    """(x_id, y_id, estimator, value, n) of several estimators over one sketch join."""
    sketch = build_sketch(pairs, spec)
    joined = join_sketches(sketch, sketch, ids)
    parts = [estimate(joined, e).withColumn("estimator", F.lit(e)) for e in estimators]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.select(*PAIR, "estimator", "value", "n")


def typed_pairs(pairs: DataFrame, ids: DataFrame, x_type: str, y_type: str) -> DataFrame:
    """The wanted pairs whose columns have these types."""
    kinds = pairs.select("pair_id", "value_type").distinct()
    for side, kind in zip(PAIR, (x_type, y_type)):
        ids = ids.join(kinds.filter(F.col("value_type") == kind).select(F.col("pair_id").alias(side)), side)
    return ids.select(*PAIR)


def numeric_pairs(pairs: DataFrame, ids: DataFrame) -> DataFrame:
    """The wanted pairs both of whose columns are numerical."""
    return typed_pairs(pairs, ids, NUMERICAL, NUMERICAL)
