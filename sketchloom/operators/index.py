"""The sketch index: postings of key hashes, top-k search by overlap, and re-ranking of hits."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sketchloom.functions.hashing import hash_int_tuple
from sketchloom.operators.correlation import pearson
from sketchloom.operators.joins import join_sketches
from sketchloom.operators.setops import stored_set_estimates

KINDS = ("STD", "QCR", "QCRI")
SORTS = ("KEY", "CSK", "BAL", "GRD", "GR2", "GR3")
#: A query table is broadcast only up to so many terms; beyond, terms and postings meet in an ordinary join.
BROADCAST_TERMS = 200_000


def qcr_keys(sketch: DataFrame, flip: bool = False) -> DataFrame:
    """(pair_id, term): hash of the key's hash and the sign of the standardized value; a constant sketch has sign 0."""
    whole = Window.partitionBy("pair_id")
    std = F.stddev_pop("v").over(whole)
    sign = F.when(std > 0, F.signum(F.col("v") - F.avg("v").over(whole))).otherwise(0).cast("int")
    return sketch.select("pair_id", "h", (-sign if flip else sign).alias("s")).select(
        "pair_id", hash_int_tuple(F.col("h"), F.col("s")).alias("term")
    )


def postings(sketch: DataFrame, kind: str) -> DataFrame:
    """(field, term, pair_id) of an index: h key hashes, c signed keys, f signed keys of the negated value."""
    if kind not in KINDS:
        raise ValueError(f"unknown index: {kind}")

    def field(name: str, terms: DataFrame) -> DataFrame:
        return terms.select(F.lit(name).alias("field"), "term", "pair_id").distinct()

    if kind == "STD":
        return field("h", sketch.select("pair_id", F.col("h").alias("term")))
    out = field("c", qcr_keys(sketch))
    return out if kind == "QCR" else out.unionByName(field("f", qcr_keys(sketch, flip=True)))


def _query_terms(query: DataFrame, kind: str) -> DataFrame:
    """(qid, way, field, term): what a query asks for; the better of its ways counts."""

    def way(name: str, field: str, terms: DataFrame) -> DataFrame:
        return terms.select(F.col("pair_id").alias("qid"), F.lit(name).alias("way"), F.lit(field).alias("field"), "term")

    if kind == "STD":
        return way("pos", "h", query.select("pair_id", F.col("h").alias("term"))).distinct()
    positive = qcr_keys(query)
    if kind == "QCR":
        return way("pos", "c", positive).unionByName(way("neg", "c", qcr_keys(query, flip=True))).distinct()
    return way("pos", "c", positive).unionByName(way("neg", "f", positive)).distinct()


def search(index: DataFrame, query: DataFrame, kind: str = "QCR", top_k: int = 100, order: DataFrame | None = None) -> DataFrame:
    """(qid, id, score, rank): for every query sketch, the top_k indexed pairs by number of matching terms.

    Many queries run as one join of their terms with the postings, broadcast while they are few. ``order``
    (pair_id, seq) says in which order pairs entered the index and breaks ties; without it the id does. No query
    is a hit of any query, if they are in the index.
    """
    terms = _query_terms(query, kind)
    if terms.limit(BROADCAST_TERMS + 1).count() <= BROADCAST_TERMS:
        terms = F.broadcast(terms)
    hits = index.join(terms, ["field", "term"]).join(query.select("pair_id").distinct(), "pair_id", "left_anti")
    ways = hits.groupBy("qid", F.col("pair_id").alias("id"), "way").agg(F.count(F.lit(1)).alias("n"))
    scores = ways.groupBy("qid", "id").agg(F.max("n").alias("score"))
    tie = F.col("id")
    if order is not None:
        scores = scores.join(order.select(F.col("pair_id").alias("id"), "seq"), "id")
        tie = F.col("seq")
    rank = F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("score"), tie))
    return scores.withColumn("rank", rank).filter(F.col("rank") <= top_k).select("qid", "id", "score", "rank")


def rebuild(hits: DataFrame, sketches: DataFrame) -> DataFrame:
    """The stored sketch rows of the hits."""
    return sketches.join(hits.select(F.col("id").alias("pair_id")).distinct(), "pair_id", "left_semi")


def hit_details(hits: DataFrame, queries: DataFrame, sketches: DataFrame) -> DataFrame:
    """Hits with Pearson correlation of the joined sketches (0 if undefined) and joinability (stored containment)."""
    ids = hits.select(F.col("qid").alias("x_id"), F.col("id").alias("y_id"))
    found = rebuild(hits, sketches)
    joined = join_sketches(queries, found, ids)
    corr = pearson(joined).select(F.col("x_id").alias("qid"), F.col("y_id").alias("id"), F.col("value").alias("corr"))
    contained = stored_set_estimates(queries, found, ids).select(F.col("x_id").alias("qid"), F.col("y_id").alias("id"), F.col("containment").alias("joinability"))
    out = hits.join(corr, ["qid", "id"], "left").join(contained, ["qid", "id"], "left")
    value = F.when(F.isnan("corr"), F.lit(0.0)).otherwise(F.coalesce("corr", F.lit(0.0)))
    return out.withColumns({"corr": value, "joinability": F.coalesce("joinability", F.lit(0.0))})


def _between_hits(hits: DataFrame, sketches: DataFrame) -> DataFrame:
    """(qid, x_id, y_id, value): absolute correlation of the hits of a query with each other."""
    left, right = (hits.select("qid", F.col("id").alias(n)) for n in ("x_id", "y_id"))
    ids = left.join(right, "qid").filter("x_id < y_id")
    found = rebuild(hits, sketches)
    corr = pearson(join_sketches(found, found, ids.select("x_id", "y_id").distinct()))
    value = F.abs(F.when(F.isnan("value"), 0.0).otherwise(F.col("value")))
    return ids.join(corr.select("x_id", "y_id", value.alias("value")), ["x_id", "y_id"])


def greedy_order(corr: np.ndarray, join: np.ndarray, between: np.ndarray, kind: str) -> tuple[list[int], list[float]]:
    """Order of hits by repeatedly taking that with the best (|corr| - max |corr with those taken|) * joinability.

    GRD uses the difference as it is, for all hits. GR2 floors it at 0.01 and takes 25 so, the others follow in
    their order, and scores are ranks. GR3 floors it and takes all; its result is sorted by the scores.
    """
    n = len(corr)
    taken, scores = [], []
    closest = np.zeros(n)
    left = list(range(n))
    limit = min(25, n) if kind == "GR2" else n
    while len(taken) < limit:
        gain = np.abs(corr) - closest
        if kind != "GRD":
            gain = np.maximum(gain, 0.01)
        gain = gain * join
        best = max(left, key=lambda i: (gain[i], -i))
        left.remove(best)
        taken.append(best)
        scores.append(float(gain[best]))
        closest = np.maximum(closest, between[best])
    if kind == "GR2":
        taken += left
        scores = [float(n - i) for i in range(n)]
    if kind == "GR3":
        order = sorted(range(n), key=lambda i: -scores[i])
        taken, scores = [taken[i] for i in order], [scores[i] for i in order]
    return taken, scores


@dataclass(frozen=True)
class Reranker:
    """Either an expression to sort by, descending, or the name of a greedy order."""

    score: Callable[[], Column] | None = None
    greedy: str | None = None


RERANKERS: dict[str, Reranker] = {
    "KEY": Reranker(lambda: F.col("score").cast("double")),
    "CSK": Reranker(lambda: F.abs("corr")),
    "BAL": Reranker(lambda: F.abs("corr") * F.col("joinability")),
    "GRD": Reranker(greedy="GRD"),
    "GR2": Reranker(greedy="GR2"),
    "GR3": Reranker(greedy="GR3"),
}


def rerank(hits: DataFrame, sort: str, sketches: DataFrame | None = None) -> DataFrame:
    """Hits in a new order: adds rerank_score and new_rank. Equal scores keep the order of retrieval.

    Expects the columns of ``hit_details``. Greedy orders need the sketches, to compare a query's hits with each
    other; the loop over its at most top-k hits runs in one grouped pandas function for each query.
    """
    if sort not in RERANKERS:
        raise ValueError(f"unknown order: {sort}")
    how = RERANKERS[sort]
    if how.score is not None:
        out = hits.withColumn("rerank_score", how.score())
        rank = F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("rerank_score"), "rank"))
        return out.withColumn("new_rank", rank)
    kind = how.greedy
    pairs = _between_hits(hits, sketches).groupBy("qid").agg(F.collect_list(F.struct("x_id", "y_id", "value")).alias("pairs"))
    rows = hits.join(pairs, "qid", "left")
    schema = "qid string, id string, score long, rank int, corr double, joinability double, rerank_score double, new_rank int"

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("rank").reset_index(drop=True)
        at = {v: i for i, v in enumerate(pdf["id"])}
        between = np.zeros((len(pdf), len(pdf)))
        found = pdf["pairs"].iloc[0]
        for p in found if found is not None else []:
            i, j = at[p["x_id"]], at[p["y_id"]]
            between[i, j] = between[j, i] = p["value"]
        order, scores = greedy_order(pdf["corr"].to_numpy(), pdf["joinability"].to_numpy(), between, kind)
        out = pdf.iloc[order].drop(columns=["pairs"])
        return out.assign(rerank_score=scores, new_rank=np.arange(1, len(out) + 1, dtype=np.int32))

    columns = ["qid", "id", F.col("score").cast("long"), F.col("rank").cast("int"), "corr", "joinability", "pairs"]
    return rows.select(*columns).groupBy("qid").applyInPandas(run, schema)


# Storage: an index is three Parquet tables below a folder.


def save_index(path: str, sketches: DataFrame, kind: str) -> None:
    """Write a new index: its sketches, its postings dealt by term, and its kind."""
    spark = sketches.sparkSession
    sketches.write.mode("overwrite").parquet(f"{path}/sketches")
    stored = spark.read.parquet(f"{path}/sketches")
    postings(stored, kind).repartition("field", "term").sortWithinPartitions("field", "term").write.mode("overwrite").parquet(f"{path}/postings")
    spark.createDataFrame([(kind,)], "kind string").coalesce(1).write.mode("overwrite").json(f"{path}/meta")


def load_index(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, str]:
    """(sketches, postings, kind) of a stored index; reading again after an update shows the update."""
    kind = spark.read.schema("kind string").json(f"{path}/meta").first()["kind"]
    return spark.read.parquet(f"{path}/sketches"), spark.read.parquet(f"{path}/postings"), kind


def upsert(sketches: DataFrame, new: DataFrame) -> DataFrame:
    """Sketch rows with those of ``new`` in place of older ones of the same pairs."""
    old = sketches.join(new.select("pair_id").distinct(), "pair_id", "left_anti")
    return old.unionByName(new)


def update_index(spark: SparkSession, path: str, new: DataFrame) -> str:
    """Upsert sketches into a stored index, as a new generation beside the old one; returns its folder."""
    sketches, _, kind = load_index(spark, path)
    base, _, number = path.rpartition("-g")
    target = f"{base}-g{int(number) + 1}" if base and number.isdigit() else f"{path}-g1"
    save_index(target, upsert(sketches, new), kind)
    return target
