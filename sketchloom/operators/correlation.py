"""Correlation and information estimators over joined samples (x_id, y_id, xv, yv)."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sketchloom.functions import kernels as K
from sketchloom.functions.aggregates import CATEGORICAL, NUMERICAL

GROUP = ["x_id", "y_id"]


def _guarded(top: Column, bottom: Column, ok: Column) -> Column:
    return F.when(ok, top / F.when(ok, bottom)).otherwise(F.lit(float("nan")))


def pearson_expr(x: str = "xv", y: str = "yv") -> Column:
    """Pearson from centred moments, NaN where a side is constant (never an arithmetic error)."""
    n = F.count(F.lit(1))
    sxx, syy, sxy = F.var_pop(x) * n, F.var_pop(y) * n, F.covar_pop(x, y) * n
    return _guarded(sxy, F.sqrt(sxx * syy), (sxx > 1e-25) & (syy > 1e-25))


def average_rank(value: str, over: list[str]) -> Column:
    """Rank from 1 within groups; ties share the average."""
    line = Window.partitionBy(*over).orderBy(value)
    ties = F.count(F.lit(1)).over(Window.partitionBy(*over, value))
    return F.rank().over(line) + (ties - 1) / 2.0


def pearson(joined: DataFrame, by: list[str] = GROUP) -> DataFrame:
    return joined.groupBy(*by).agg(pearson_expr().alias("value"), F.count(F.lit(1)).alias("n"))


def spearman(joined: DataFrame, by: list[str] = GROUP) -> DataFrame:
    ranked = joined.select(*by, average_rank("xv", by).alias("xv"), average_rank("yv", by).alias("yv"))
    return pearson(ranked, by)


def qcr(joined: DataFrame, by: list[str] = GROUP) -> DataFrame:
    """Points in the first and third quadrant about the means, less those in the others, / all points."""
    whole = Window.partitionBy(*by)
    centred = joined.withColumns({"dx": F.col("xv") - F.avg("xv").over(whole), "dy": F.col("yv") - F.avg("yv").over(whole)})
    return centred.groupBy(*by).agg((F.sum(F.signum("dx") * F.signum("dy")) / F.count(F.lit(1))).alias("value"), F.count(F.lit(1)).alias("n"))


def xicor(joined: DataFrame, by: list[str] = GROUP, seed: int = 0) -> DataFrame:
    """Chatterjee's xi of y on x; equal x in a seeded hash order."""
    order = Window.partitionBy(*by).orderBy("xv", F.xxhash64(F.lit(seed), "xv", "yv"), "yv")
    up = F.cume_dist().over(Window.partitionBy(*by).orderBy("yv"))
    down = F.cume_dist().over(Window.partitionBy(*by).orderBy(F.desc("yv")))
    ranked = joined.withColumns({"fr": up, "g": down}).withColumn("step", F.abs(F.col("fr") - F.lag("fr").over(order)))
    n, spread = F.count(F.lit(1)), F.avg(F.col("g") * (1 - F.col("g")))
    # Under this guard a constant y divides nothing.
    value = F.when(spread > 0, 1 - F.coalesce(F.sum("step"), F.lit(0.0)) / (2 * n) / F.when(spread > 0, spread)).otherwise(F.lit(float("nan")))
    return ranked.groupBy(*by).agg(value.alias("value"), n.alias("n"))


def contingency(joined: DataFrame, by: list[str] = GROUP) -> DataFrame:
    """Joint counts of (int) values with their marginal counts and the total."""
    cells = joined.groupBy(*by, F.col("xv").cast("int").alias("x"), F.col("yv").cast("int").alias("y")).agg(F.count(F.lit(1)).alias("c"))
    total = {"cx": ["x"], "cy": ["y"], "n": []}
    return cells.withColumns({name: F.sum("c").over(Window.partitionBy(*by, *keys)) for name, keys in total.items()})


def mi_mle(joined: DataFrame, by: list[str] = GROUP) -> DataFrame:
    """Plug-in mutual information, entropies, numbers of classes and normalized forms (nats)."""
    cells = contingency(joined, by)
    p, px, py = (F.col(c) / F.col("n") for c in ("c", "cx", "cy"))
    out = cells.groupBy(*by).agg(
        F.sum(p * F.log(p / (px * py))).alias("mi"),
        (-F.sum(p * F.log(px))).alias("ex"),
        (-F.sum(p * F.log(py))).alias("ey"),
        F.count_distinct("x").alias("nx"),
        F.count_distinct("y").alias("ny"),
        F.sum("c").alias("n"),
    )

    def per(bottom: Column) -> Column:
        return _guarded(F.col("mi"), bottom, bottom > 1e-12)

    return out.withColumns(
        {
            "nmi_sqrt": per(F.sqrt(F.col("ex") * F.col("ey"))), "nmi_max": per(F.greatest("ex", "ey")), "nmi_min": per(F.least("ex", "ey")),
            "info_gain_x": per(F.col("ex")), "info_gain_y": per(F.col("ey")),
        }
    )


def binned(joined: DataFrame, by: list[str] = GROUP) -> DataFrame:
    """Both values in equal-width bins: max(2, int(ln(distinct values))) of them; a constant is bin 0."""
    sizes = joined.groupBy(*by).agg(*[f(c).alias(f"{name}_{c}") for c in ("xv", "yv") for name, f in (("n", F.count_distinct), ("lo", F.min), ("hi", F.max))])

    def one(c: str) -> Column:
        bins = F.greatest(F.lit(2), F.floor(F.log(F.col(f"n_{c}").cast("double"))))
        width = F.col(f"hi_{c}") - F.col(f"lo_{c}")
        at = (F.col(c) - F.col(f"lo_{c}")) / F.when(width > 0, width) * (bins - 1) + 0.5
        return F.coalesce(F.floor(at), F.lit(0)).cast("double")

    return joined.join(sizes, by).select(*by, one("xv").alias("xv"), one("yv").alias("yv"))


def entropy(values: DataFrame, by: list[str], value: str) -> DataFrame:
    """Plug-in entropy of a column in each group (nats)."""
    counts = values.groupBy(*by, value).agg(F.count(F.lit(1)).alias("c"))
    p = F.col("c") / F.sum("c").over(Window.partitionBy(*by))
    return counts.withColumn("p", p).groupBy(*by).agg((-F.sum(F.col("p") * F.log("p"))).alias("entropy"), F.sum("c").alias("n"))


# Estimators that need a whole sample at once run in one grouped pandas function; samples are sketch-sized.


def grouped(joined: DataFrame, kernel: Callable[[np.ndarray, np.ndarray], float], by: list[str] = GROUP) -> DataFrame:
    """(by, value, n) of a numpy kernel over each group, whose rows are put in a fixed order first."""
    schema = ", ".join(f"{c} {joined.schema[c].dataType.simpleString()}" for c in by) + ", value double, n long"

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["xv", "yv"], kind="stable")
        row = {c: pdf[c].iloc[0] for c in by}
        return pd.DataFrame([{**row, "value": kernel(pdf["xv"].to_numpy(float), pdf["yv"].to_numpy(float)), "n": len(pdf)}])

    return joined.select(*by, "xv", "yv").groupBy(*by).applyInPandas(run, schema)


def grouped_many(joined: DataFrame, kernels: dict[str, Callable[[np.ndarray, np.ndarray], float]], by: list[str] = GROUP) -> DataFrame:
    """(by, one column for each kernel): several kernels in one pass over each group."""
    schema = ", ".join(f"{c} {joined.schema[c].dataType.simpleString()}" for c in by) + "".join(f", {n} double" for n in kernels)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["xv", "yv"], kind="stable")
        x, y = pdf["xv"].to_numpy(float), pdf["yv"].to_numpy(float)
        return pd.DataFrame([{**{c: pdf[c].iloc[0] for c in by}, **{n: k(x, y) for n, k in kernels.items()}}])

    return joined.select(*by, "xv", "yv").groupBy(*by).applyInPandas(run, schema)


def _diff_ent(x: np.ndarray, y: np.ndarray) -> float:
    return K.mixed_ksg(x, y)


KERNELS: dict[str, Callable[[np.ndarray, np.ndarray], float]] = {
    "RIN": K.rin,
    "ROBUST_QN": K.qn_correlation,
    "PM1_BOOTSTRAP": lambda x, y: K.pm1_bootstrap(x, y)["mean"],
    "PM1_SIMPLE": lambda x, y: K.pm1_bootstrap(x, y, early_stop=False)["mean"],
    "KENDALL": K.kendall,
    "KENDALL_MI": lambda x, y: K.kendall_to_mi(K.kendall(x, y)),
    "PCV": K.pcv_correlation,
    "MIXED_KSG": _diff_ent,
    "ROSS_XY": lambda x, y: K.ross_mi(x, y),
    "ROSS_YX": lambda x, y: K.ross_mi(y, x),
}
RELATIONAL: dict[str, Callable[..., DataFrame]] = {
    "PEARSONS": pearson,
    "SPEARMANS": spearman,
    "QCR": qcr,
    "XICOR": xicor,
    "MI_MLE": lambda j, by=GROUP: mi_mle(j, by).select(*by, F.col("mi").alias("value"), "n"),
    "MI_BINNED": lambda j, by=GROUP: mi_mle(binned(j, by), by).select(*by, F.col("mi").alias("value"), "n"),
    "NMI_SQRT": lambda j, by=GROUP: mi_mle(j, by).select(*by, F.col("nmi_sqrt").alias("value"), "n"),
    "NMI_MAX": lambda j, by=GROUP: mi_mle(j, by).select(*by, F.col("nmi_max").alias("value"), "n"),
    "NMI_MIN": lambda j, by=GROUP: mi_mle(j, by).select(*by, F.col("nmi_min").alias("value"), "n"),
}

_N, _C = NUMERICAL, CATEGORICAL
#: Estimator to the form it takes for the types of x and y; a combination that is missing is not supported.
ESTIMATORS: dict[str, dict[tuple[str, str], str]] = {
    **{name: {(_N, _N): name} for name in ("PEARSONS", "SPEARMANS", "RIN", "ROBUST_QN", "PM1_BOOTSTRAP", "QCR", "XICOR", "NMI_SQRT", "NMI_MAX", "NMI_MIN")},
    "MUTUAL_INFORMATION_BINNING": {(_C, _C): "MI_MLE", (_N, _N): "MI_BINNED"},
    "MUTUAL_INFORMATION_DIFF_ENT": {(_C, _C): "MI_MLE", (_C, _N): "ROSS_XY", (_N, _C): "ROSS_YX", (_N, _N): "MIXED_KSG"},
    "MUTUAL_INFORMATION_DIFF_ENT_MIXED": {(_C, _C): "MI_MLE", (_C, _N): "ROSS_XY", (_N, _C): "ROSS_YX", (_N, _N): "MIXED_KSG"},
}


#: Entropy of a numerical side that goes with each estimator; a categorical side has its plug-in entropy.
ENTROPIES: dict[str, Callable[[np.ndarray], float]] = {
    "MUTUAL_INFORMATION_DIFF_ENT": K.kl_entropy,
    "MUTUAL_INFORMATION_DIFF_ENT_MIXED": K.kl_entropy_mixed,
}


def information(joined: DataFrame, estimator: str, x_type: str, y_type: str, by: list[str] = GROUP) -> DataFrame:
    """(by, mi, n, ex, ey, nx, ny, nmi_sqrt, nmi_max, nmi_min) by one of ENTROPIES; class counts are null unless both are categorical.

    Differential entropies may be negative or -inf, and normalized forms are plain quotients of them; NaN where
    the divisor is 0 or the root of a negative number.
    """
    columns = ["mi", "n", "ex", "ey", "nx", "ny", "nmi_sqrt", "nmi_max", "nmi_min"]
    if (x_type, y_type) == (CATEGORICAL, CATEGORICAL):
        return mi_mle(joined, by).select(*by, *columns)
    mi, numeric = KERNELS[ESTIMATORS[estimator][x_type, y_type]], ENTROPIES[estimator]
    hx, hy = (K.entropy if t == CATEGORICAL else numeric for t in (x_type, y_type))
    kernels = {"mi": mi, "n": lambda x, _: float(len(x)), "ex": lambda x, _: hx(x), "ey": lambda _, y: hy(y)}
    out = grouped_many(joined, kernels, by).withColumn("n", F.col("n").cast("long"))

    def per(bottom: Column) -> Column:
        return _guarded(F.col("mi"), bottom, F.abs(bottom) > 1e-12)

    product = F.col("ex") * F.col("ey")
    forms = {"nmi_sqrt": per(F.sqrt(F.greatest(product, F.lit(0.0)))), "nmi_max": per(F.greatest("ex", "ey")), "nmi_min": per(F.least("ex", "ey"))}
    return out.withColumns({**{c: F.lit(None).cast("long") for c in ("nx", "ny")}, **forms}).select(*by, *columns)


def register_estimator(name: str, kernel: Callable[[np.ndarray, np.ndarray], float], types: list[tuple[str, str]]) -> None:
    """Add an estimator of one's own over two arrays, for some combinations of types."""
    KERNELS[name] = kernel
    ESTIMATORS[name] = {t: name for t in types}


def estimate(joined: DataFrame, estimator: str, x_type: str = NUMERICAL, y_type: str = NUMERICAL, by: list[str] = GROUP) -> DataFrame:
    """(by, value, n) by an estimator, in the form that the types of the two columns ask for."""
    if estimator not in ESTIMATORS:
        raise ValueError(f"unknown estimator: {estimator}")
    form = ESTIMATORS[estimator].get((x_type, y_type))
    if form is None:
        raise NotImplementedError(f"{estimator} of {x_type} and {y_type}")
    return RELATIONAL[form](joined, by=by) if form in RELATIONAL else grouped(joined, KERNELS[form], by)
