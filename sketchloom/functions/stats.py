"""Vector statistics as column expressions and DataFrame functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def covariance(x: str, y: str) -> Column:
    return F.covar_samp(x, y)


def mean(x: str) -> Column:
    return F.avg(x)


def median(x: str) -> Column:
    return F.median(x)


def extent(x: str) -> Column:
    """Struct (low, high); infinities the wrong way round for no rows."""
    low, high = F.coalesce(F.min(x), F.lit(float("inf"))), F.coalesce(F.max(x), F.lit(float("-inf")))
    return F.struct(low.alias("low"), high.alias("high"))


def std(x: str) -> Column:
    """Population standard deviation, 0 for no rows."""
    return F.coalesce(F.stddev_pop(x), F.lit(0.0))


def variance(x: str) -> Column:
    """Unbiased variance, 0 for no rows."""
    return F.coalesce(F.var_samp(x), F.lit(0.0))


def mean_product(x: str, y: str) -> Column:
    return F.avg(F.col(x) * F.col(y))


def total(x: str) -> Column:
    return F.sum(x)


def unitized(x: str, over: list[str], low: Column | None = None, high: Column | None = None) -> Column:
    """(x - low) / (high - low), the extent of the group by default; NaN where it is empty."""
    whole = Window.partitionBy(*over)
    low = F.min(x).over(whole) if low is None else low
    high = F.max(x).over(whole) if high is None else high
    width = high - low
    return F.when(width != 0, (F.col(x) - low) / F.when(width != 0, width)).otherwise(F.lit(float("nan")))


def standardized(x: str, over: list[str]) -> Column:
    """z-scores by the population deviation; NaN for a constant group."""
    whole = Window.partitionBy(*over)
    s = F.stddev_pop(x).over(whole)
    return F.when(s > 0, (F.col(x) - F.avg(x).over(whole)) / F.when(s > 0, s)).otherwise(F.lit(float("nan")))


def ranked(x: str, over: list[str], method: str = "average") -> Column:
    """Rank from 1 within groups; ties share the average, the largest or the smallest rank."""
    low = F.rank().over(Window.partitionBy(*over).orderBy(x))
    ties = F.count(F.lit(1)).over(Window.partitionBy(*over, x))
    return {"min": low.cast("double"), "max": (low + ties - 1).cast("double"), "average": low + (ties - 1) / 2.0}[method]


def binned(x: str, bins: Column | int, low: Column, high: Column) -> Column:
    """Equal-width bin number, rounded to the nearest of ``bins`` marks; a constant column is bin 0."""
    width = high - low
    return F.coalesce(F.floor((F.col(x) - low) / F.when(width > 0, width) * (bins - 1) + 0.5), F.lit(0)).cast("int")


def auto_bins(x: str) -> Column:
    """max(2, int(ln(distinct values))), as an aggregate."""
    return F.greatest(F.lit(2), F.floor(F.log(F.count_distinct(x).cast("double")))).cast("int")


def probabilities(x: str, over: list[str]) -> Column:
    """Share of the group's total."""
    whole = F.sum(x).over(Window.partitionBy(*over))
    return F.col(x) / F.when(whole != 0, whole)


def with_noise(x: str, seed: int = 0, scale: float = 1e-20) -> Column:
    """x plus seeded Gaussian noise of a tiny share of the column's mean."""
    return F.col(x) + F.randn(seed) * F.avg(x).over(Window.partitionBy(F.lit(1))) * scale


def kurtosis_columns(x: str) -> dict[str, Column]:
    """Aggregates: population excess g2, unbiased G2 (NaN below 4 rows), corrected k5."""
    n, nan = F.count(x).cast("double"), F.lit(float("nan"))
    some = F.var_pop(x) > 0
    g2 = F.when(some, F.kurtosis(x)).otherwise(nan)
    big = F.when(n > 3, (n - 1) / F.when(n > 3, (n - 2) * (n - 3)) * ((n + 1) * g2 + 6)).otherwise(nan)
    k5 = F.when(n > 3, (n + 1) / F.when(n > 3, n - 1) * big * (1 + 5 * big / F.when(n > 3, n))).otherwise(nan)
    return {"g2": g2, "big_g2": big, "k5": k5}


def percentile_interval(df: DataFrame, x: str, by: list[str], alpha: float) -> DataFrame:
    """(by, lower, upper, mean): order statistics at ceil(alpha / 2 n) and ceil((1 - alpha / 2) n)."""
    n = F.count(F.lit(1)).over(Window.partitionBy(*by))
    rows = df.withColumns({"rn": F.row_number().over(Window.partitionBy(*by).orderBy(x)), "n": n})

    def at(share: float) -> Column:
        return F.max(F.when(F.col("rn") == F.greatest(F.lit(1), F.ceil(F.lit(share) * F.col("n"))), F.col(x)))

    return rows.groupBy(*by).agg(at(alpha / 2).alias("lower"), at(1 - alpha / 2).alias("upper"), F.avg(x).alias("mean"))


def weighted_high_median(df: DataFrame, x: str, weight: str, by: list[str]) -> DataFrame:
    """(by, value): the smallest value such that it and the smaller ones have more than half of the group's weight.

    Weights are added up by value first, so ties and repeated rows cost one row each.
    """
    values = df.groupBy(*by, x).agg(F.sum(weight).alias("_weight"))
    line = Window.partitionBy(*by).orderBy(x)
    sums = values.withColumns({"_upto": F.sum("_weight").over(line), "_all": F.sum("_weight").over(Window.partitionBy(*by))})
    return sums.filter(2 * F.col("_upto") > F.col("_all")).groupBy(*by).agg(F.min(x).alias("value"))


def fisher_interval(r: Column, n: Column, confidence: float = 0.95) -> Column:
    """Struct (lower, upper) of a correlation; NaN below 4 rows."""
    from sketchloom.functions.special import normal_quantile

    nan, limit = F.lit(float("nan")), 1 - 1e-15
    z = F.atanh(F.greatest(F.lit(-limit), F.least(F.lit(limit), r)))
    width = F.lit(normal_quantile(0.5 + confidence / 2)) / F.sqrt(F.when(n > 3, n - 3))
    ok = n > 3
    return F.struct(F.when(ok, F.tanh(z - width)).otherwise(nan).alias("lower"), F.when(ok, F.tanh(z + width)).otherwise(nan).alias("upper"))


def uniform(n: int, spark, seed: int, low: float = 0.0, high: float = 1.0) -> DataFrame:
    """(id, v): n seeded uniform numbers."""
    return spark.range(n).select("id", (F.rand(seed) * (high - low) + low).alias("v"))


def normal(n: int, spark, seed: int) -> DataFrame:
    return spark.range(n).select("id", F.randn(seed).alias("v"))


def exponential(n: int, spark, seed: int, rate: float = 1.0) -> DataFrame:
    return spark.range(n).select("id", (-F.log(1 - F.rand(seed)) / rate).alias("v"))


def rademacher(n: int, spark, seed: int) -> DataFrame:
    return spark.range(n).select("id", F.when(F.rand(seed) < 0.5, -1.0).otherwise(1.0).alias("v"))
