"""Ranking metrics and the exact truth they are measured against."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sketchloom.functions.aggregates import aggregate
from sketchloom.operators.correlation import pearson
from sketchloom.operators.joins import overlap
from sketchloom.operators.setops import quotient

#: Cut-offs of the query scores.
DEPTHS = (None, 5, 10, 50)
#: Exact joins with fewer rows have no correlation.
MIN_ROWS = 3


def _relevance() -> Column:
    return F.when(F.isnan("rel"), 0.0).otherwise(F.coalesce("rel", F.lit(0.0)))


def ndcg(ranking: DataFrame, truth: DataFrame, k: int | None = None) -> DataFrame:
    """(qid, dcg, ideal, ndcg) of rankings (qid, id, rank) against relevances (qid, id, rel), missing and NaN being 0."""

    def discounted(rows: DataFrame, name: str) -> DataFrame:
        kept = rows if k is None else rows.filter(F.col("rank") <= k)
        gain = F.sum(F.col("rel") / F.log2(F.col("rank") + 1.0))
        return kept.groupBy("qid").agg(gain.alias(name))

    known = truth.select("qid", "id", _relevance().alias("rel"))
    seen = ranking.join(known, ["qid", "id"], "left").select("qid", "rank", F.coalesce("rel", F.lit(0.0)).alias("rel"))
    best = known.withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("rel"), "id")))
    out = discounted(best, "ideal").join(discounted(seen, "dcg"), "qid", "left").withColumn("dcg", F.coalesce("dcg", F.lit(0.0)))
    value = F.when(F.col("ideal") > 0, F.col("dcg") / F.when(F.col("ideal") > 0, F.col("ideal"))).otherwise(F.lit(float("nan")))
    return out.select("qid", "dcg", "ideal", value.alias("ndcg"))


def recall(ranking: DataFrame, truth: DataFrame, threshold: float) -> DataFrame:
    """(qid, found, relevant, recall): share of the items with relevance of the threshold or more that are ranked.

    A query of the ranking or the truth for which nothing is relevant has recall NaN.
    """
    good = truth.filter((F.col("rel") >= threshold) & ~F.isnan("rel")).select("qid", "id")
    ranked = ranking.select("qid", "id").distinct().withColumn("hit", F.lit(1))
    out = good.join(ranked, ["qid", "id"], "left").groupBy("qid").agg(F.count("hit").alias("found"), F.count(F.lit(1)).alias("relevant"))
    asked = ranking.select("qid").union(truth.select("qid")).distinct()
    out = asked.join(out, "qid", "left").withColumns({c: F.coalesce(c, F.lit(0)) for c in ("found", "relevant")})
    return out.withColumn("recall", quotient(F.col("found"), F.col("relevant")))


def query_scores(hits: DataFrame) -> DataFrame:
    """For each query, means over its hits (qid, rank, corr, containment) at several depths.

    The mean containment, and means of |r| * j, and of the harmonic, arithmetic and geometric mean of |r| and j.
    """
    r, j = F.abs(F.when(F.isnan("corr"), 0.0).otherwise(F.col("corr"))), F.col("containment")
    both = r + j
    values = {
        "product": r * j, "harmonic": F.coalesce(2 * r * j / F.when(both > 0, both), F.lit(0.0)),
        "arithmetic": both / 2, "geometric": F.sqrt(r * j),
    }
    rows = hits.select("qid", "rank", j.alias("jc"), *[v.alias(n) for n, v in values.items()])
    aggs = [F.avg("jc").alias("avg_jc"), F.count(F.lit(1)).alias("hits")]
    for depth in DEPTHS:
        for name in values:
            value = F.col(name) if depth is None else F.when(F.col("rank") <= depth, F.col(name))
            aggs.append(F.avg(value).alias(f"{name}_{depth or 'all'}"))
    return rows.groupBy("qid").agg(*aggs)


def exact_truth(pairs: DataFrame, ids: DataFrame, function: str) -> DataFrame:
    """(x_id, y_id, n, pearson, overlap columns) of full joins, for wanted pairs of columns.

    Each column is aggregated by key once, however many pairs it is in. Joins of fewer than MIN_ROWS rows have NaN.
    """
    keyed = pairs.groupBy("pair_id", "k").agg(aggregate(function).alias("v"))
    left = keyed.select(F.col("pair_id").alias("x_id"), "k", F.col("v").alias("xv")).join(ids, "x_id")
    right = keyed.select(F.col("pair_id").alias("y_id"), "k", F.col("v").alias("yv"))
    corr = pearson(left.join(right, ["y_id", "k"])).withColumnRenamed("value", "pearson")
    out = overlap(pairs, ids).join(corr, ["x_id", "y_id"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    value = F.when(F.col("n") >= MIN_ROWS, F.col("pearson")).otherwise(F.lit(float("nan")))
    return out.withColumn("pearson", value)
