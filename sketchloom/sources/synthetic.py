"""Synthetic column pairs with known correlation or mutual information."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

KEY_DISTRIBUTIONS = ("UNIQUE", "UNIFORM", "ZIPF_1", "ZIPF_1_5", "SAME_AS_X")
TRIALS = (16, 64, 256, 512, 1024)


def zipf_key(u: Column, n: int, exponent: float) -> Column:
    """A key in 1..n with probability falling like key ** -exponent, from a uniform number (continuous inverse)."""
    if exponent == 1.0:
        return F.least(F.lit(n), F.floor(F.exp(u * math.log(n + 1)))).cast("long")
    p = 1 - exponent
    return F.least(F.lit(n), F.floor(F.pow(u * ((n + 1) ** p - 1) + 1, F.lit(1 / p)))).cast("long")


def _key(kind: str, rows: int, x: Column, seed: int) -> Column:
    if kind not in KEY_DISTRIBUTIONS:
        raise ValueError(f"unknown key distribution: {kind}")
    u = F.rand(seed + 2)
    return {
        "UNIQUE": F.col("id"),
        "UNIFORM": F.floor(u * rows).cast("long"),
        "ZIPF_1": zipf_key(u, rows, 1.0),
        "ZIPF_1_5": zipf_key(u, rows, 1.5),
        "SAME_AS_X": x.cast("long"),
    }[kind].cast("string")


def bivariate_normal(spark: SparkSession, rho: float, rows: int = 10_000, keys: str = "UNIFORM", form: str = "NUMERICAL", seed: int = 0) -> DataFrame:
    """(K, X, Y) with correlation rho; DISCRETE rounds both to whole numbers, MIXED only X."""
    base = spark.range(rows).withColumns({"X": F.randn(seed), "E": F.randn(seed + 1)})
    base = base.withColumn("Y", rho * F.col("X") + math.sqrt(1 - rho * rho) * F.col("E"))
    x = F.round("X") if form in ("DISCRETE", "MIXED") else F.col("X")
    y = F.round("Y") if form == "DISCRETE" else F.col("Y")
    return base.select(_key(keys, rows, F.round("X"), seed).alias("K"), x.alias("X"), y.alias("Y"))


def normal_mi(rho: float) -> float:
    """Mutual information of a bivariate normal (nats)."""
    return -0.5 * math.log(1 - rho * rho)


def discrete_uniform(spark: SparkSession, m: int, rows: int = 10_000, keys: str = "UNIQUE", seed: int = 0) -> DataFrame:
    """(K, X, Y): X uniform on 0..m-1 and Y = X + U(0, 2)."""
    base = spark.range(rows).withColumn("X", F.floor(F.rand(seed) * m).cast("double"))
    base = base.withColumn("Y", F.col("X") + F.rand(seed + 1) * 2)
    return base.select(_key(keys, rows, F.col("X"), seed).alias("K"), "X", "Y")


def discrete_uniform_mi(m: int) -> float:
    return math.log(m) - (m - 1) * math.log(2) / m


def multinomial(spark: SparkSession, n: int, p: float, q: float, rows: int = 10_000, keys: str = "UNIQUE", seed: int = 0) -> DataFrame:
    """(K, X, Y): counts of the first two of three classes in n trials, by conditional binomials."""

    def draw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            xs, ys = [], []
            for i in pdf["id"]:  # each row has a stream of its own, so the result does not depend on partitions
                rng = np.random.default_rng([seed, int(i)])
                x = rng.binomial(n, p)
                xs.append(float(x))
                ys.append(float(rng.binomial(n - x, min(1.0, q / (1 - p)))))
            yield pd.DataFrame({"id": pdf["id"], "X": xs, "Y": ys})

    base = spark.range(rows).mapInPandas(draw, "id long, X double, Y double")
    return base.select(_key(keys, rows, F.col("X"), seed).alias("K"), "X", "Y")


def multinomial_correlation(p: float, q: float) -> float:
    return -math.sqrt(p * q / ((1 - p) * (1 - q)))


def multinomial_mi(n: int, p: float, q: float) -> float:
    """Exact mutual information of the first two counts: H(X) + H(Y) - H(X, Y)."""

    def log_choose(a: int, b: int) -> float:
        return math.lgamma(a + 1) - math.lgamma(b + 1) - math.lgamma(a - b + 1)

    def binomial_entropy(r: float) -> float:
        logs = [log_choose(n, i) + i * math.log(r) + (n - i) * math.log1p(-r) for i in range(n + 1)]
        return -sum(math.exp(v) * v for v in logs)

    rest, joint = 1 - p - q, 0.0
    for i in range(n + 1):
        j = np.arange(n - i + 1)
        lg = np.array([math.lgamma(v + 1) for v in range(n - i + 1)])
        logs = math.lgamma(n + 1) - math.lgamma(i + 1) - lg - lg[::-1] + i * math.log(p) + j * math.log(q) + (n - i - j) * math.log(rest)
        joint -= float((np.exp(logs) * logs).sum())
    return binomial_entropy(p) + binomial_entropy(q) - joint


def correlated_corpus(spark: SparkSession, queries: int, correlated: int, uncorrelated: int, rows: int = 10_000, seed: int = 0) -> DataFrame:
    """(table, role, K, V): for each query, candidates with a drawn correlation and containment, and independent ones.

    A candidate joins the query on a share of its keys drawn from U(0.1, 1); its other rows have keys of their own.
    Correlations are drawn from U(0.25, 1) with either sign; independent candidates have 0.
    """
    per_query = 1 + correlated + uncorrelated
    tables = spark.range(queries * per_query).select(
        F.col("id").alias("t"), F.floor(F.col("id") / per_query).alias("q"), F.pmod("id", F.lit(per_query)).alias("c")
    )

    def draw(name: str, *parts: Column) -> Column:
        return F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.lit(name), *parts), 11).cast("double") / float(1 << 53)

    sign = F.when(draw("sign", F.col("t")) < 0.5, -1.0).otherwise(1.0)
    rho = F.when(F.col("c").between(1, correlated), sign * (0.25 + 0.75 * draw("rho", F.col("t")))).otherwise(0.0)
    tables = tables.withColumns({"rho": rho, "share": 0.1 + 0.9 * draw("share", F.col("t"))})
    cells = tables.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(rows - 1))))

    def gauss(name: str, *parts: Column) -> Column:
        u1, u2 = 1 - draw(f"{name}1", *parts), draw(f"{name}2", *parts)
        return F.sqrt(-2 * F.log(u1)) * F.cos(2 * math.pi * u2)

    own = gauss("query", F.col("q"), F.col("i"))
    noise = gauss("noise", F.col("t"), F.col("i"))
    value = F.when(F.col("c") == 0, own).otherwise(F.col("rho") * own + F.sqrt(1 - F.col("rho") * F.col("rho")) * noise)
    shared = (F.col("c") == 0) | (F.col("i") < F.col("share") * rows)
    key = F.when(shared, F.concat_ws("-", F.lit("k"), "q", "i")).otherwise(F.concat_ws("-", F.lit("own"), "t", "i"))
    role = F.when(F.col("c") == 0, "query").when(F.col("c") <= correlated, "correlated").otherwise("independent")
    return cells.select(F.concat_ws("_", F.lit("table"), "q", "c").alias("table"), role.alias("role"), key.alias("K"), value.alias("V"))
