"""Queries of stored tables, streams, and columns for which estimates break down, with their DuckDB counterparts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sketchloom.catalog import register
from sketchloom.functions import kernels as K
from sketchloom.functions import stats
from sketchloom.operators import correlation as C
from sketchloom.operators import index as I
from sketchloom.operators import setops as S
from sketchloom.operators.sketch import SketchSpec, build_sketch
from sketchloom.plans import queries as Q
from sketchloom.session import scratch
from sketchloom.sources import store, tables
from sketchloom.streaming.merge import SketchStream

# Tables read by path, and stores written and read again.

register("parquet_scan", lambda s, d: tables.scan(s, f"{d}/part.parquet").select("p_partkey", "p_name", "p_size"), "SELECT p_partkey, p_name, p_size FROM part")


def _csv(s: SparkSession, d: str) -> DataFrame:
    path = f"{scratch(s, 'csv')}/supplier.csv"
    Q.table(s, d, "supplier").select("s_suppkey", "s_name", "s_acctbal").write.option("header", "true").csv(path)
    found = tables.scan(s, path)
    return found.select(F.col("s_suppkey").cast("long").alias("s_suppkey"), "s_name", F.col("s_acctbal").cast("double").alias("s_acctbal"))


register("csv_scan", _csv, "SELECT s_suppkey::BIGINT AS s_suppkey, s_name, s_acctbal::DOUBLE AS s_acctbal FROM supplier")


def _store(s: SparkSession, d: str) -> DataFrame:
    path = scratch(s, "store")
    store.write_store(tables.column_pairs(Q.table(s, d, "customer"), "customer", order="c_custkey"), path)
    return store.read_store(s, path, "customer/c_mktsegment:c_acctbal").select("pair_id", "ord", "k", "v")


register(
    "store_round_trip", _store,
    "SELECT 'customer/c_mktsegment:c_acctbal' AS pair_id, c_custkey AS ord, c_mktsegment AS k, c_acctbal::DOUBLE AS v FROM customer",
)


def _sample(s: SparkSession, d: str) -> DataFrame:
    path = scratch(s, "sample")
    ids = Q.table(s, d, "part").select(F.col("p_partkey").cast("string").alias("pair_id"))
    store.write_sample(store.sample_queries(ids, 0, "^1"), ids.count(), path)
    total, found = store.read_sample(s, path)
    return s.createDataFrame([(total, i) for i in found], "total long, pair_id string")


register("sample_round_trip", _sample, "SELECT (SELECT count(*) FROM part) AS total, p_partkey::VARCHAR AS pair_id FROM part WHERE p_partkey::VARCHAR LIKE '1%'")


def _stored_index(s: SparkSession, d: str) -> DataFrame:
    """Search in an index that was stored with half of its columns and then given the others."""
    path, spec = scratch(s, "index"), SketchSpec("KMV", 256, "MEAN")
    half = len(Q.INDEXED) // 2
    I.save_index(path, build_sketch(Q.pairs(s, d, *Q.INDEXED[: half + 1]), spec), "STD")
    path = I.update_index(s, path, build_sketch(Q.pairs(s, d, *Q.INDEXED[half:]), spec))
    _, posts, kind = I.load_index(s, path)
    return I.search(posts, build_sketch(Q.pairs(s, d, "customer"), spec), kind, 8)


register("stored_index_search", _stored_index, f"WITH {Q._STD} SELECT * FROM top")


# Sketches kept up to date.


def _stream(aggregate: str):
    def run(s: SparkSession, d: str) -> DataFrame:
        """Three batches, the latest rows first, each given to a new object on the same path."""
        path, spec, rows = scratch(s, "stream"), SketchSpec("KMV", 128, aggregate), Q.pairs(s, d, "orders", "events")
        for batch in range(3):
            SketchStream(s, path, spec).add(rows.filter(F.pmod("ord", F.lit(3)) == 2 - batch), batch)
        return Q.rounded(SketchStream(s, path, spec).table(), 4).withColumn("h", F.col("h").cast("long"))

    return run


for _agg in ("FIRST", "LAST", "MEAN"):
    register(f"stream_{_agg.lower()}", _stream(_agg), Q._sketch_sql(Q.kmv_sql(_agg, 128, "orders", "events")))


# Columns with one key, and sketches without any.

_EDGE = [("one", "customer"), ("customer", "one"), ("one", "one"), ("orders", "customer")]
_EDGE_SQL = "w(x_id, y_id) AS (VALUES " + ", ".join(f"('{a}', '{b}')" for a, b in _EDGE) + ")"
_NAN = "'NaN'::DOUBLE"


def _edge(spec: SketchSpec, estimates, **more):
    def run(s: SparkSession, d: str) -> DataFrame:
        sk = build_sketch(Q.pairs(s, d, "one", "customer", "orders"), spec)
        args = [spec] if estimates is S.set_estimates else []
        return Q.rounded(estimates(sk, sk, *args, Q.id_pairs(s, *_EDGE), **more), 4)

    return run


def _estimates_sql(card: str) -> str:
    return (
        f"SELECT x_id, y_id, {Q._r('(k - 1) / kth', chr(34) + 'union' + chr(34), 4)}, {Q._r('i / k', 'jaccard', 4)}, {Q._r('i / k * (k - 1) / kth', 'intersection', 4)}, "
        f"{Q._r(f'i / k * (k - 1) / kth / ({card})', 'containment', 4)} FROM e"
    )


_KMV_EDGE = f"""WITH {Q.kmv_sql('FIRST', 256, 'one', 'customer', 'orders')}, {_EDGE_SQL}, sz AS (SELECT pair_id, count(*) AS c, CASE WHEN bool_or(cut) THEN max(u) ELSE 1.0 END AS kth1 FROM sk GROUP BY pair_id),
    al AS (SELECT x_id, y_id, h, u, count(*) AS c, x_id = y_id AS same FROM w JOIN sk ON pair_id = x_id OR pair_id = y_id GROUP BY ALL),
    kc AS (SELECT x_id, y_id, least(a.c, b.c) AS k, (a.c - 1) / a.kth1 AS card FROM w JOIN sz a ON a.pair_id = x_id JOIN sz b ON b.pair_id = y_id),
    rk AS (SELECT *, row_number() OVER (PARTITION BY x_id, y_id ORDER BY u, h) AS rn FROM al),
    e AS (SELECT x_id, y_id, any_value(k) AS k, any_value(card) AS card, max(CASE WHEN rn <= k THEN u END) AS kth, count(*) FILTER (c = 2 OR same) AS i FROM rk JOIN kc USING (x_id, y_id) GROUP BY x_id, y_id)
    """
register("setops_one_key", _edge(SketchSpec("KMV", 256), S.set_estimates), _KMV_EDGE + _estimates_sql("card"))
register(
    "setops_known_cardinality", _edge(SketchSpec("KMV", 256), S.set_estimates, known={"customer": 4000, "one": 1}),
    _KMV_EDGE + _estimates_sql("CASE x_id WHEN 'customer' THEN 4000 WHEN 'one' THEN 1 ELSE card END"),
)


def _no_keys(s: SparkSession, d: str) -> DataFrame:
    """Threshold sketches so sparse that none has a key."""
    spec = SketchSpec("GKMV", 0.0)
    sk = build_sketch(Q.pairs(s, d, "one", "customer", "orders"), spec)
    return S.set_estimates(sk, sk, spec, Q.id_pairs(s, *_EDGE))


register("setops_no_keys", _no_keys, f'WITH {_EDGE_SQL} SELECT x_id, y_id, {_NAN} AS "union", {_NAN} AS jaccard, {_NAN} AS intersection, {_NAN} AS containment FROM w')


# Statistics.

register(
    "weighted_high_median", lambda s, d: stats.weighted_high_median(Q.table(s, d, "lineitem"), "l_extendedprice", "l_quantity", ["l_returnflag"]),
    "WITH v AS (SELECT l_returnflag, l_extendedprice AS x, sum(l_quantity) AS w FROM lineitem GROUP BY ALL), c AS (SELECT *, sum(w) OVER (PARTITION BY l_returnflag ORDER BY x) AS upto, sum(w) OVER (PARTITION BY l_returnflag) AS total FROM v) "
    "SELECT l_returnflag, min(x) AS value FROM c WHERE 2 * upto > total GROUP BY l_returnflag",
)


def _variance(s: SparkSession, d: str) -> DataFrame:
    rows = Q._joined(s, d)
    ends = {"lower": lambda x, _: K.variance_interval(x, 0.9)[0], "upper": lambda x, _: K.variance_interval(x, 0.9)[1]}
    return Q.rounded(C.grouped_many(rows, ends).withColumns({c: F.log(F.col(c)) for c in ends}), 5)


register(
    "variance_interval", _variance,
    f"""WITH {Q._JOINED}, b AS (SELECT x_id, y_id, count(*)::DOUBLE AS n, kurtosis_pop(xv) AS g2, var_samp(xv) AS s2 FROM jn GROUP BY x_id, y_id), c AS (SELECT *, (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * g2 + 6) AS g FROM b),
    k AS (SELECT *, (n + 1) / (n - 1) * g * (1 + 5 * g / n) + 2 * n / (n - 1) AS q FROM c), v AS (SELECT *, q / n * (1 + n * q / 2) AS spread FROM k)
    SELECT x_id, y_id, {Q._r('ln(s2) - 0.12566134685507416 * spread + q / (2 * n)', 'lower', 5)}, {Q._r('ln(s2) + 0.12566134685507416 * spread + q / (2 * n)', 'upper', 5)} FROM v""",
)
