"""Queries over the test tables, one or more for each operator, with their DuckDB counterparts.

Numbers that depend on the order of floating-point sums are rounded on both sides.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sketchloom.catalog import register
from sketchloom.functions import stats
from sketchloom.functions.hashing import hash_int_tuple, hash_int_tuple_sql, minwise, minwise_coefficients, murmur3, murmur3_sql, unit_hash, unit_hash_sql
from sketchloom.operators import correlation as C
from sketchloom.operators import index as I
from sketchloom.operators import joins as J
from sketchloom.operators import setops as S
from sketchloom.operators.sketch import SketchSpec, build_sketch, chance, merge_sketches, sketch_meta
from sketchloom.plans import evaluation as E
from sketchloom.plans import jobs
from sketchloom.session import scratch, tuned
from sketchloom.sources import synthetic, tables

# Column pairs of the test tables: id -> (table, key, value, order), in SQL that both engines read.
PAIRS = {
    "orders": ("orders", "o_custkey", "o_totalprice", "o_orderkey"),
    "orders_prio": ("orders", "o_orderpriority", "o_totalprice", "o_orderkey"),
    "customer": ("customer", "c_custkey", "c_acctbal", "c_custkey"),
    "segment": ("customer", "c_mktsegment", "c_acctbal", "c_custkey"),
    "part": ("part", "p_partkey", "p_retailprice", "p_partkey"),
    "part_size": ("part", "p_partkey", "p_size", "p_partkey"),
    "events": ("events", "user_id", "value", "event_id"),
    "price": ("lineitem", "l_partkey", "l_extendedprice", "l_orderkey"),
    "quantity": ("lineitem", "l_partkey", "l_quantity", "l_orderkey"),
    "supplier": ("lineitem", "l_suppkey", "l_extendedprice", "l_orderkey"),
    "discount": ("lineitem", "l_suppkey", "l_discount", "l_orderkey"),
    "chars": ("documents", "doc_id", "n_chars", "doc_id"),
    "quality": ("labels", "doc_id", "quality", "doc_id"),
    "one": ("nation", "'all'", "n_nationkey", "n_nationkey"),
}
INDEXED = ["orders", "part", "part_size", "events", "price", "quantity", "supplier", "discount", "chars", "quality"]


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return tuned(spark).read.parquet(f"{sf}/{name}.parquet")


def pairs(spark: SparkSession, sf: str, *ids: str) -> DataFrame:
    out = None
    for i in ids:
        name, key, value, order = PAIRS[i]
        one = tables.pair_of(table(spark, sf, name), i, F.expr(key), F.col(value), F.col(order))
        out = one if out is None else out.unionByName(one)
    return out


def id_pairs(spark: SparkSession, *ids: tuple[str, str]) -> DataFrame:
    return spark.createDataFrame(list(ids), "x_id string, y_id string")


# SQL fragments.


def pairs_sql(*ids: str) -> str:
    parts = []
    for i in ids:
        name, key, value, order = PAIRS[i]
        parts.append(f"SELECT '{i}' AS pair_id, {order}::BIGINT AS ord, coalesce({key}::VARCHAR, '') AS k, {value}::DOUBLE AS v FROM {name} WHERE {value} IS NOT NULL")
    return " UNION ALL ".join(parts)


AGG_SQL = {
    "FIRST": "arg_min(v, ord)", "LAST": "arg_max(v, ord)", "MAX": "max(v)", "MIN": "min(v)", "SUM": "sum(v)", "MEAN": "avg(v)",
    "COUNT": "count(*)::DOUBLE",
}


def rows_sql(*ids: str) -> str:
    """CTEs ending in ``hrows`` (pair_id, ord, k, h, v)."""
    return (
        f"prows AS ({pairs_sql(*ids)}), khash AS (SELECT k, {murmur3_sql('k')} AS h FROM (SELECT DISTINCT k FROM prows)), "
        "hrows AS (SELECT pair_id, ord, k, h, v FROM prows JOIN khash USING (k))"
    )


def kmv_sql(agg: str, k: int, *ids: str, name: str = "sk") -> str:
    return (
        f"{rows_sql(*ids)}, byk AS (SELECT pair_id, h, {AGG_SQL[agg]} AS v, count(*) AS n, any_value({unit_hash_sql('h')}) AS u FROM hrows GROUP BY pair_id, h), "
        f"ranked AS (SELECT *, row_number() OVER (PARTITION BY pair_id ORDER BY u, h) AS rn, count(*) OVER (PARTITION BY pair_id) AS m FROM byk), "
        f"{name} AS (SELECT pair_id, h, u, v, n, m > {k} AS cut FROM ranked WHERE rn <= {k})"
    )


def gkmv_sql(agg: str, tau: float, *ids: str) -> str:
    return (
        f"{rows_sql(*ids)}, byk AS (SELECT pair_id, h, {AGG_SQL[agg]} AS v, count(*) AS n, any_value({unit_hash_sql('h')}) AS u FROM hrows GROUP BY pair_id, h), "
        f"sk AS (SELECT pair_id, h, u, v, n, true AS cut FROM byk WHERE u <= {tau})"
    )


def joined_sql(x: str, y: str) -> str:
    return f"jn AS (SELECT a.pair_id AS x_id, b.pair_id AS y_id, a.h, a.v AS xv, b.v AS yv FROM sk a JOIN sk b USING (h) WHERE a.pair_id = '{x}' AND b.pair_id = '{y}')"


def pearson_sql(x: str = "xv", y: str = "yv") -> str:
    sxx, syy, sxy = f"var_pop({x}) * count(*)", f"var_pop({y}) * count(*)", f"covar_pop({x}, {y}) * count(*)"
    return f"CASE WHEN {sxx} > 1e-25 AND {syy} > 1e-25 THEN ({sxy}) / sqrt(({sxx}) * ({syy})) ELSE 'NaN'::DOUBLE END"


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded after a tiny shift, which keeps exact halves off the edge between two results."""
    shift = F.lit(_shift(digits))
    return df.select(*[(F.round(F.col(c) + shift, digits) + F.lit(0.0)).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def _shift(digits: int) -> float:
    return 0.033 * 10.0**-digits


def _r(expr: str, name: str, digits: int = 6) -> str:
    return f"round(({expr})::DOUBLE + {_shift(digits)!r}::DOUBLE, {digits}) + 0.0 AS {name}"


# Hashing.

register(
    "hash_keys",
    lambda s, d: table(s, d, "customer").select("c_name", murmur3(F.col("c_name")).alias("h")).select("c_name", F.col("h").cast("long").alias("h"), unit_hash(F.col("h")).alias("u")),
    f"SELECT c_name, h, {unit_hash_sql('h')} AS u FROM (SELECT c_name, {murmur3_sql('c_name')} AS h FROM customer)",
)
register(
    "hash_int_tuple",
    lambda s, d: table(s, d, "part").select("p_partkey", hash_int_tuple(F.col("p_partkey").cast("int"), F.col("p_size")).cast("long").alias("h")),
    f"SELECT p_partkey, {hash_int_tuple_sql('p_partkey', 'p_size')} AS h FROM part",
)
register(
    "hash_minwise",
    lambda s, d: table(s, d, "part").groupBy("p_brand").agg(F.sort_array(F.collect_set(F.col("p_size"))).alias("x"))
    .select("p_brand", F.posexplode(minwise(F.col("x"), 8)).alias("f", "m"))
    .select("p_brand", F.col("f").cast("long").alias("f"), "m.min_hash", F.col("m.position").cast("long").alias("position")),
    "WITH x AS (SELECT p_brand, list_sort(list(DISTINCT p_size)) AS x FROM part GROUP BY 1), e AS (SELECT p_brand, unnest(x) AS v, unnest(range(0, len(x))) AS position FROM x), "
    "c(f, c) AS (VALUES " + ", ".join(f"({i}::BIGINT, {c}::HUGEINT)" for i, c in enumerate(minwise_coefficients(8))) + "), "
    "m AS (SELECT p_brand, f, ((v * c + c) % 2147483587)::BIGINT AS min_hash, position FROM e CROSS JOIN c) "
    "SELECT * FROM m QUALIFY row_number() OVER (PARTITION BY p_brand, f ORDER BY min_hash, position) = 1",
)


def _collisions(s: SparkSession, d: str) -> DataFrame:
    keys = None
    for t in ("customer", "part", "orders", "events"):
        one = tables.key_sets(table(s, d, t), t)
        keys = one if keys is None else keys.unionByName(one)
    return jobs.collision_report(keys)


def _keys_sql() -> str:
    columns = {"customer": ["c_name", "c_mktsegment"], "part": ["p_name", "p_brand", "p_type"], "orders": ["o_orderstatus", "o_orderpriority"], "events": ["event_type", "props"]}
    return " UNION ALL ".join(f"SELECT DISTINCT '{t}' AS dataset_id, '{c}' AS key_name, coalesce({c}, '') AS k FROM {t}" for t, cs in columns.items() for c in cs)


register(
    "hash_collisions", _collisions,
    f"""WITH ks AS (SELECT DISTINCT k FROM ({_keys_sql()})), hk AS (SELECT k, {murmur3_sql('k')} AS h FROM ks),
    g AS (SELECT h, count(*) AS c FROM hk GROUP BY h)
    SELECT sum(c)::BIGINT AS n_keys, count(*) AS n_hashes, sum(c - 1)::BIGINT AS collisions, sum(c - 1)::DOUBLE / sum(c)::DOUBLE AS share FROM g""",
)


# Sources.


def _customer_pairs(s: SparkSession, d: str) -> DataFrame:
    return tables.column_pairs(table(s, d, "customer"), "customer", order="c_custkey")


def _customer_pairs_sql() -> str:
    keys, values = ["c_name", "c_mktsegment"], [("c_name", "CATEGORICAL"), ("c_mktsegment", "CATEGORICAL"), ("c_custkey", "NUMERICAL"), ("c_nationkey", "NUMERICAL"), ("c_acctbal", "NUMERICAL")]
    parts = []
    for n, (k, (c, t)) in enumerate((k, v) for k in keys for v in values):
        value = f"(SELECT hv FROM hs WHERE hs.x = {c})" if t == "CATEGORICAL" else f"{c}"
        parts.append(f"SELECT {n} AS pair_no, 'customer/{k}:{c}' AS pair_id, 'customer' AS dataset_id, '{k}' AS key_name, '{c}' AS column_name, '{t}' AS value_type, c_custkey AS ord, {k} AS k, {value}::DOUBLE AS v FROM customer")
    return f"WITH hs AS (SELECT x, {murmur3_sql('x')} AS hv FROM (SELECT DISTINCT c_name AS x FROM customer UNION SELECT DISTINCT c_mktsegment FROM customer)) SELECT * FROM ({' UNION ALL '.join(parts)})"


register("column_pairs", _customer_pairs, _customer_pairs_sql())
register(
    "column_pairs_enumeration",
    lambda s, d: _customer_pairs(s, d).groupBy("pair_no", "pair_id", "key_name", "column_name", "value_type").agg(F.count(F.lit(1)).alias("n")),
    f"SELECT pair_no, pair_id, key_name, column_name, value_type, count(*) AS n FROM ({_customer_pairs_sql()}) GROUP BY ALL",
)
register(
    "key_cardinality",
    lambda s, d: tables.key_sets(table(s, d, "part"), "part").groupBy("dataset_id", "key_name").agg(F.count(F.lit(1)).alias("n")),
    " UNION ALL ".join(f"SELECT 'part' AS dataset_id, '{c}' AS key_name, count(DISTINCT {c}) AS n FROM part" for c in ("p_name", "p_brand", "p_type")),
)
register(
    "find_tables", lambda s, d: tables.find_tables(s, d, relative=True).filter("path not like '%/%'"),
)
register(
    "query_sample",
    lambda s, d: _sample(s, d),
)


def _sample(s: SparkSession, d: str) -> DataFrame:
    from sketchloom.sources.store import sample_queries

    return sample_queries(_customer_pairs(s, d).select("pair_id").distinct(), 4)


# Sketches.


def _sketch(kind: str, budget: float, agg: str, *ids: str):
    def run(s: SparkSession, d: str) -> DataFrame:
        return rounded(build_sketch(pairs(s, d, *ids), SketchSpec(kind, budget, agg)), 4).withColumn("h", F.col("h").cast("long"))

    return run


def _sketch_sql(ctes: str) -> str:
    return f"WITH {ctes} SELECT pair_id, h, {_r('u', 'u', 4)}, {_r('v', 'v', 4)}, n, cut FROM sk"


for _agg in AGG_SQL:
    register(f"kmv_{_agg.lower()}", _sketch("KMV", 128, _agg, "orders", "customer"), _sketch_sql(kmv_sql(_agg, 128, "orders", "customer")))
register("kmv_1024", _sketch("KMV", 1024, "MEAN", "price", "part"), _sketch_sql(kmv_sql("MEAN", 1024, "price", "part")))
register("gkmv_mean", _sketch("GKMV", 0.1, "MEAN", "orders", "events"), _sketch_sql(gkmv_sql("MEAN", 0.1, "orders", "events")))
register("gkmv_sum", _sketch("GKMV", 0.3, "SUM", "price", "quantity"), _sketch_sql(gkmv_sql("SUM", 0.3, "price", "quantity")))


def _mode(s: SparkSession, d: str) -> DataFrame:
    rows = table(s, d, "events").select(F.lit("types").alias("pair_id"), F.col("event_id").alias("ord"), F.col("user_id").cast("string").alias("k"), murmur3(F.col("event_type")).cast("double").alias("v"))
    return build_sketch(rows, SketchSpec("KMV", 128, "MOST_FREQUENT")).select("pair_id", F.col("h").cast("long").alias("h"), "v", "n")


register(
    "kmv_mode", _mode,
    f"""WITH et AS (SELECT x, {murmur3_sql('x')}::DOUBLE AS v FROM (SELECT DISTINCT event_type AS x FROM events)),
    r AS (SELECT user_id::VARCHAR AS k, v FROM events JOIN et ON event_type = x), kh AS (SELECT k, {murmur3_sql('k')} AS h FROM (SELECT DISTINCT k FROM r)),
    c AS (SELECT h, v, count(*) AS c FROM r JOIN kh USING (k) GROUP BY h, v), m AS (SELECT h, v, c, row_number() OVER (PARTITION BY h ORDER BY c DESC, v) AS rn, sum(c) OVER (PARTITION BY h) AS n FROM c),
    t AS (SELECT h, v, n, {unit_hash_sql('h')} AS u FROM m WHERE rn = 1)
    SELECT 'types' AS pair_id, h, v, n::BIGINT AS n FROM t ORDER BY u, h LIMIT 128""",
)
_TUP = f"{unit_hash_sql('th')}"
register(
    "tupsk_mean", _sketch("TUPSK", 128, "MEAN", "orders"),
    _sketch_sql(
        f"{rows_sql('orders')}, byk AS (SELECT pair_id, h, avg(v) AS v, count(*) AS n FROM hrows GROUP BY pair_id, h), t1 AS (SELECT *, {hash_int_tuple_sql('h', '1')} AS th FROM byk), "
        f"t2 AS (SELECT *, {_TUP} AS u FROM t1), t3 AS (SELECT *, row_number() OVER (PARTITION BY pair_id ORDER BY u, h) AS rn, count(*) OVER (PARTITION BY pair_id) AS m FROM t2), "
        "sk AS (SELECT pair_id, h, u, v, n, m > 128 AS cut FROM t3 WHERE rn <= 128)"
    ),
)
register(
    "tupsk_none", _sketch("TUPSK", 128, "NONE", "events"),
    _sketch_sql(
        f"{rows_sql('events')}, t0 AS (SELECT *, row_number() OVER (PARTITION BY pair_id, h ORDER BY ord) AS j, count(*) OVER (PARTITION BY pair_id, h) AS n FROM hrows), "
        f"t1 AS (SELECT *, {hash_int_tuple_sql('h', 'j')} AS th FROM t0), t2 AS (SELECT *, {_TUP} AS u FROM t1), "
        "t3 AS (SELECT *, row_number() OVER (PARTITION BY pair_id ORDER BY u, h, j) AS rn, count(*) OVER (PARTITION BY pair_id) AS m FROM t2), "
        "sk AS (SELECT pair_id, h, u, v, n, m > 128 AS cut FROM t3 WHERE rn <= 128)"
    ),
)
register(
    "prisk_sum", _sketch("PRISK", 128, "SUM", "orders"),
    _sketch_sql(
        f"{rows_sql('orders')}, byk AS (SELECT pair_id, h, sum(v) AS v, count(*) AS n FROM hrows GROUP BY pair_id, h), t1 AS (SELECT *, {unit_hash_sql('h')} / n AS u FROM byk), "
        "t2 AS (SELECT *, row_number() OVER (PARTITION BY pair_id ORDER BY u, h) AS rn, count(*) OVER (PARTITION BY pair_id) AS m FROM t1), "
        "sk AS (SELECT pair_id, h, u, v, n, m > 128 AS cut FROM t2 WHERE rn <= 128)"
    ),
)
for _kind, _budget in (("KMV", 128), ("GKMV", 0.2), ("PRISK", 128), ("INDSK", 128)):
    register(f"{_kind.lower()}_none", _sketch(_kind, _budget, "NONE", "events"))
register("indsk_mean", _sketch("INDSK", 128, "MEAN", "orders"))


def _merged(s: SparkSession, d: str) -> DataFrame:
    """A sketch merged from those of two halves; it equals the sketch of all rows."""
    rows, spec = pairs(s, d, "orders", "events"), SketchSpec("KMV", 128, "SUM")
    halves = [build_sketch(rows.filter(F.pmod("ord", F.lit(2)) == i), spec) for i in (0, 1)]
    return rounded(merge_sketches(*halves, spec), 4).select("pair_id", F.col("h").cast("long").alias("h"), "u", "v", "n", "cut")


register("kmv_merged", _merged, _sketch_sql(kmv_sql("SUM", 128, "orders", "events")))
register(
    "kmv_distinct",
    lambda s, d: rounded(sketch_meta(build_sketch(pairs(s, d, "orders", "customer", "part", "segment"), SketchSpec("KMV", 256)), SketchSpec("KMV", 256)), 4),
    f"""WITH {kmv_sql('FIRST', 256, 'orders', 'customer', 'part', 'segment')},
    m AS (SELECT pair_id, count(*) AS size, CASE WHEN bool_or(cut) THEN max(u) ELSE 1.0 END AS kth, sum(n)::BIGINT AS seen_rows FROM sk GROUP BY pair_id)
    SELECT pair_id, size, {_r('kth', 'kth', 4)}, seen_rows, {_r('(size - 1) / kth', 'distinct_ub', 4)}, {_r('size / kth', 'distinct_be', 4)} FROM m""",
)


# Set estimates.

_X, _Y = "orders", "customer"


def _set_ops(spec: SketchSpec):
    def run(s: SparkSession, d: str) -> DataFrame:
        sk = build_sketch(pairs(s, d, _X, _Y, "part"), spec)
        return rounded(S.set_estimates(sk, sk, spec, id_pairs(s, (_X, _Y), (_X, "part"), (_Y, "part"))), 4)

    return run


_WANTED = "w(x_id, y_id) AS (VALUES ('orders', 'customer'), ('orders', 'part'), ('customer', 'part'))"
register(
    "kmv_setops", _set_ops(SketchSpec("KMV", 256)),
    f"""WITH {kmv_sql('FIRST', 256, _X, _Y, 'part')}, {_WANTED}, sz AS (SELECT pair_id, count(*) AS c, CASE WHEN bool_or(cut) THEN max(u) ELSE 1.0 END AS kth1 FROM sk GROUP BY pair_id),
    al AS (SELECT x_id, y_id, h, u, count(*) AS c FROM w JOIN sk ON pair_id = x_id OR pair_id = y_id GROUP BY ALL),
    k AS (SELECT x_id, y_id, least(a.c, b.c) AS k, (a.c - 1) / a.kth1 AS card FROM w JOIN sz a ON a.pair_id = x_id JOIN sz b ON b.pair_id = y_id),
    rk AS (SELECT *, row_number() OVER (PARTITION BY x_id, y_id ORDER BY u, h) AS rn FROM al),
    e AS (SELECT x_id, y_id, any_value(k) AS k, any_value(card) AS card, max(CASE WHEN rn <= k THEN u END) AS kth, count(*) FILTER (c = 2) AS i FROM rk JOIN k USING (x_id, y_id) GROUP BY x_id, y_id)
    SELECT x_id, y_id, {_r('(k - 1) / kth', '"union"', 4)}, {_r('i / k', 'jaccard', 4)}, {_r('i / k * (k - 1) / kth', 'intersection', 4)}, {_r('i / k * (k - 1) / kth / card', 'containment', 4)} FROM e""",
)
register(
    "gkmv_setops", _set_ops(SketchSpec("GKMV", 0.2)),
    f"""WITH {gkmv_sql('FIRST', 0.2, _X, _Y, 'part')}, {_WANTED}, sz AS (SELECT pair_id, count(*) AS c, max(u) AS last FROM sk GROUP BY pair_id),
    al AS (SELECT x_id, y_id, h, u, count(*) AS c FROM w JOIN sk ON pair_id = x_id OR pair_id = y_id GROUP BY ALL),
    e AS (SELECT x_id, y_id, count(*) AS k, count(*) FILTER (al.c = 2) AS i, any_value(greatest(a.last, b.last)) AS kth, any_value((a.c - 1) / a.last) AS card
          FROM al JOIN sz a ON a.pair_id = x_id JOIN sz b ON b.pair_id = y_id GROUP BY x_id, y_id)
    SELECT x_id, y_id, {_r('(k - 1) / kth', '"union"', 4)}, {_r('i / k', 'jaccard', 4)}, {_r('i / k * (k - 1) / kth', 'intersection', 4)}, {_r('i / k * (k - 1) / kth / card', 'containment', 4)} FROM e""",
)


def _stored_sets(s: SparkSession, d: str) -> DataFrame:
    sk = build_sketch(pairs(s, d, _X, _Y, "part"), SketchSpec("KMV", 256))
    return rounded(S.stored_set_estimates(sk, sk, id_pairs(s, (_X, _Y), (_X, "part"), (_Y, "part"))), 4)


register(
    "stored_setops", _stored_sets,
    f"""WITH {kmv_sql('FIRST', 256, _X, _Y, 'part')}, {_WANTED}, sz AS (SELECT pair_id, count(*) AS c, max(u) AS last FROM sk GROUP BY pair_id),
    al AS (SELECT x_id, y_id, h, u, count(*) AS c FROM w JOIN sk ON pair_id = x_id OR pair_id = y_id GROUP BY ALL),
    k AS (SELECT x_id, y_id, least(a.c, b.c) AS k, (a.c - 1) / a.last AS card FROM w JOIN sz a ON a.pair_id = x_id JOIN sz b ON b.pair_id = y_id),
    rk AS (SELECT *, row_number() OVER (PARTITION BY x_id, y_id ORDER BY u, h) AS rn FROM al),
    e AS (SELECT x_id, y_id, any_value(k) AS k, any_value(card) AS card, max(CASE WHEN rn <= k THEN u END) AS kth, count(*) FILTER (c = 2 AND rn <= k) AS i FROM rk JOIN k USING (x_id, y_id) GROUP BY x_id, y_id)
    SELECT x_id, y_id, {_r('card', 'cardinality', 4)}, {_r('(k - 1) / kth', '"union"', 4)}, {_r('i / k', 'jaccard', 4)}, {_r('i / k * (k - 1) / kth', 'intersection', 4)},
           {_r('least(1.0, greatest(0.0, i / k * (k - 1) / kth / card))', 'containment', 4)} FROM e""",
)


# Joins.


def _joined(s: SparkSession, d: str, x: str = _X, y: str = _Y, agg: str = "MEAN", k: int = 256) -> DataFrame:
    sk = build_sketch(pairs(s, d, x, y), SketchSpec("KMV", k, agg))
    return J.join_sketches(sk, sk, id_pairs(s, (x, y)))


_JOINED = f"{kmv_sql('MEAN', 256, _X, _Y)}, {joined_sql(_X, _Y)}"
register("sketch_join", lambda s, d: rounded(_joined(s, d), 4).withColumn("h", F.col("h").cast("long")), f"WITH {_JOINED} SELECT x_id, y_id, h, {_r('xv', 'xv', 4)}, {_r('yv', 'yv', 4)} FROM jn")


def _flagship(s: SparkSession, d: str) -> DataFrame:
    return rounded(C.pearson(_joined(s, d)), 8)


register("kmv_flagship", _flagship, f"WITH {_JOINED} SELECT x_id, y_id, {_r(pearson_sql(), 'value', 8)}, count(*) AS n FROM jn GROUP BY x_id, y_id")
register(
    "join_aggregate",
    lambda s, d: rounded(J.full_join(pairs(s, d, "orders"), pairs(s, d, "customer"), "SUM"), 3),
    f"WITH a AS (SELECT k, sum(v) AS xv FROM ({pairs_sql('orders')}) GROUP BY k), b AS (SELECT k, sum(v) AS yv FROM ({pairs_sql('customer')}) GROUP BY k) SELECT k, {_r('xv', 'xv', 3)}, {_r('yv', 'yv', 3)} FROM a JOIN b USING (k)",
)
register(
    "aggregate_pair",
    lambda s, d: rounded(J.aggregate_pair(pairs(s, d, "orders"), ["FIRST", "LAST", "MAX", "MIN", "SUM", "MEAN", "COUNT"]), 3),
    "SELECT pair_id, k, " + ", ".join(_r(e, n.lower(), 3) for n, e in AGG_SQL.items()) + f" FROM ({pairs_sql('orders')}) GROUP BY pair_id, k",
)
register(
    "left_join",
    lambda s, d: rounded(J.left_join(pairs(s, d, "events"), pairs(s, d, "orders"), "MEAN"), 3),
    f"WITH b AS (SELECT k, avg(v) AS yv FROM ({pairs_sql('orders')}) GROUP BY k) SELECT k, ord, {_r('v', 'xv', 3)}, {_r('yv', 'yv', 3)} FROM ({pairs_sql('events')}) JOIN b USING (k)",
)
register(
    "left_join_stats",
    lambda s, d: J.left_join_stats(pairs(s, d, "orders"), pairs(s, d, "events")),
    f"WITH b AS (SELECT k, count(*) AS n FROM ({pairs_sql('events')}) GROUP BY k) SELECT count(*) FILTER (n IS NULL) AS join_1to0, count(*) FILTER (n = 1) AS join_1to1, count(*) FILTER (n > 1) AS join_1ton FROM ({pairs_sql('orders')}) LEFT JOIN b USING (k)",
)
_IDS = [("orders", "customer"), ("price", "part"), ("events", "customer"), ("segment", "orders_prio")]
_ALL = ["orders", "customer", "price", "part", "events", "segment", "orders_prio"]
_IDS_SQL = "w(x_id, y_id) AS (VALUES " + ", ".join(f"('{a}', '{b}')" for a, b in _IDS) + ")"
_OVERLAP_SQL = (
    f"pr AS ({pairs_sql(*_ALL)}), kd AS (SELECT DISTINCT pair_id, k FROM pr), sz AS (SELECT pair_id, count(*) AS c FROM kd GROUP BY pair_id), {_IDS_SQL}, "
    "ov AS (SELECT x_id, y_id, (SELECT c FROM sz WHERE pair_id = x_id) AS x_keys, (SELECT c FROM sz WHERE pair_id = y_id) AS y_keys, "
    "(SELECT count(*) FROM kd a JOIN kd b USING (k) WHERE a.pair_id = x_id AND b.pair_id = y_id) AS i FROM w)"
)
_OVERLAP_COLUMNS = f"x_keys, y_keys, i AS intersection, x_keys + y_keys - i AS \"union\", {_r('i / (x_keys + y_keys - i)', 'jaccard')}, {_r('i / x_keys', 'containment')}"
register("exact_overlap", lambda s, d: rounded(J.overlap(pairs(s, d, *_ALL), id_pairs(s, *_IDS))), f"WITH {_OVERLAP_SQL} SELECT x_id, y_id, {_OVERLAP_COLUMNS} FROM ov")
register(
    "exact_truth",
    lambda s, d: rounded(E.exact_truth(pairs(s, d, *_ALL), id_pairs(s, *_IDS), "MEAN").withColumn("n", F.col("n").cast("long"))),
    f"""WITH {_OVERLAP_SQL}, ag AS (SELECT pair_id, k, avg(v) AS v FROM pr GROUP BY pair_id, k),
    pc AS (SELECT x_id, y_id, count(*) AS n, {pearson_sql('a.v', 'b.v')} AS p FROM w JOIN ag a ON a.pair_id = x_id JOIN ag b ON b.pair_id = y_id AND a.k = b.k GROUP BY x_id, y_id)
    SELECT x_id, y_id, {_OVERLAP_COLUMNS}, coalesce(n, 0) AS n, {_r("CASE WHEN n >= 3 THEN p ELSE 'NaN'::DOUBLE END", 'pearson')} FROM ov LEFT JOIN pc USING (x_id, y_id)""",
)


def _catalog_ids(s: SparkSession, d: str) -> DataFrame:
    rows = [(t, f"{t}/{c}") for t, cs in _CATALOG.items() for c in cs]
    return s.createDataFrame(rows, "dataset_id string, pair_id string")


_CATALOG = {"customer": ["a", "b", "c"], "orders": ["a", "b"], "part": ["a", "b", "c", "d"]}
_CATALOG_SQL = "cat(dataset_id, pair_id) AS (VALUES " + ", ".join(f"('{t}', '{t}/{c}')" for t, cs in _CATALOG.items() for c in cs) + ")"
register("pair_combinations", lambda s, d: J.combinations(_catalog_ids(s, d)), f"WITH {_CATALOG_SQL} SELECT a.pair_id AS x_id, b.pair_id AS y_id FROM cat a JOIN cat b ON a.pair_id < b.pair_id")
register(
    "pair_combinations_within", lambda s, d: J.combinations(_catalog_ids(s, d), within_dataset=True),
    f"WITH {_CATALOG_SQL} SELECT a.pair_id AS x_id, b.pair_id AS y_id FROM cat a JOIN cat b USING (dataset_id) WHERE a.pair_id < b.pair_id",
)


def _budget(s: SparkSession, d: str) -> DataFrame:
    keys = tables.key_sets(table(s, d, "customer"), "customer").unionByName(tables.key_sets(table(s, d, "part"), "part"))
    return rounded(jobs.budget_equivalence(keys), 8)


register(
    "budget_equivalence", _budget,
    "WITH c AS (SELECT count(DISTINCT c_name) AS n FROM customer UNION ALL SELECT count(DISTINCT c_mktsegment) FROM customer UNION ALL SELECT count(DISTINCT p_name) FROM part UNION ALL SELECT count(DISTINCT p_brand) FROM part UNION ALL SELECT count(DISTINCT p_type) FROM part), "
    f"t AS (SELECT count(*) AS n_columns, sum(n)::BIGINT AS n_keys FROM c) SELECT k::INTEGER AS k, n_columns, n_keys, (k * n_columns)::BIGINT AS budget, {_r('k * n_columns / n_keys', 'tau', 8)} FROM t, (VALUES (128), (256), (512), (1024)) AS b(k)",
)


# Estimators over sketch joins.

_E = f"WITH {_JOINED}, "


def _avg_rank(c: str) -> str:
    return f"rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2.0"


register("sketch_spearman", lambda s, d: rounded(C.spearman(_joined(s, d))), f"{_E} r AS (SELECT x_id, y_id, {_avg_rank('xv')} AS xr, {_avg_rank('yv')} AS yr FROM jn) SELECT x_id, y_id, {_r(pearson_sql('xr', 'yr'), 'value')}, count(*) AS n FROM r GROUP BY x_id, y_id")
register(
    "sketch_qcr", lambda s, d: rounded(C.qcr(_joined(s, d))),
    f"{_E} m AS (SELECT *, xv - avg(xv) OVER () AS dx, yv - avg(yv) OVER () AS dy FROM jn) SELECT x_id, y_id, {_r('sum(sign(dx) * sign(dy)) / count(*)', 'value')}, count(*) AS n FROM m GROUP BY x_id, y_id",
)
register(
    "sketch_xicor", lambda s, d: rounded(C.xicor(_joined(s, d))),
    f"""{_E} r AS (SELECT *, cume_dist() OVER (ORDER BY yv) AS fr, cume_dist() OVER (ORDER BY yv DESC) AS g FROM jn), l AS (SELECT *, abs(fr - lag(fr) OVER (ORDER BY xv)) AS st FROM r)
    SELECT x_id, y_id, {_r('1 - sum(st) / (2 * count(*)) / avg(g * (1 - g))', 'value')}, count(*) AS n FROM l GROUP BY x_id, y_id""",
)
register(
    "sketch_kurtosis",
    lambda s, d: rounded(_joined(s, d).groupBy("x_id", "y_id").agg(*[e.alias(n) for n, e in stats.kurtosis_columns("xv").items()]), 5),
    f"""{_E} b AS (SELECT x_id, y_id, count(*)::DOUBLE AS n, kurtosis_pop(xv) AS g2 FROM jn GROUP BY x_id, y_id), c AS (SELECT *, (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * g2 + 6) AS g FROM b)
    SELECT x_id, y_id, {_r('g2', 'g2', 5)}, {_r('g', 'big_g2', 5)}, {_r('(n + 1) / (n - 1) * g * (1 + 5 * g / n)', 'k5', 5)} FROM c""",
)
register(
    "full_join_pearson",
    lambda s, d: rounded(C.pearson(J.full_join(pairs(s, d, "price"), pairs(s, d, "part"), "MEAN").withColumns({"x_id": F.lit("price"), "y_id": F.lit("part")}))),
    f"WITH a AS (SELECT k, avg(v) AS xv FROM ({pairs_sql('price')}) GROUP BY k), b AS (SELECT k, avg(v) AS yv FROM ({pairs_sql('part')}) GROUP BY k) SELECT 'price' AS x_id, 'part' AS y_id, {_r(pearson_sql(), 'value')}, count(*) AS n FROM a JOIN b USING (k)",
)


# Information.


def _discrete(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "lineitem").select(F.lit("flag").alias("x_id"), F.lit("quantity").alias("y_id"), F.when(F.col("l_returnflag") == "A", 1.0).when(F.col("l_returnflag") == "N", 2.0).otherwise(3.0).alias("xv"), (F.floor(F.col("l_quantity") / 10)).cast("double").alias("yv"))


_DISCRETE = "dr AS (SELECT CASE l_returnflag WHEN 'A' THEN 1 WHEN 'N' THEN 2 ELSE 3 END AS x, floor(l_quantity / 10)::INTEGER AS y FROM lineitem)"
_MI = (
    "ce AS (SELECT x, y, count(*) AS c FROM dr GROUP BY x, y), m AS (SELECT *, sum(c) OVER (PARTITION BY x) AS cx, sum(c) OVER (PARTITION BY y) AS cy, sum(c) OVER () AS n FROM ce), "
    "q AS (SELECT sum(c / n * ln((c / n) / ((cx / n) * (cy / n)))) AS mi, -sum(c / n * ln(cx / n)) AS ex, -sum(c / n * ln(cy / n)) AS ey, count(DISTINCT x) AS nx, count(DISTINCT y) AS ny, sum(c)::BIGINT AS n FROM m)"
)
_NMI = f"{_r('mi / sqrt(ex * ey)', 'nmi_sqrt', 7)}, {_r('mi / greatest(ex, ey)', 'nmi_max', 7)}, {_r('mi / least(ex, ey)', 'nmi_min', 7)}, {_r('mi / ex', 'info_gain_x', 7)}, {_r('mi / ey', 'info_gain_y', 7)}"
register(
    "mi_mle", lambda s, d: rounded(C.mi_mle(_discrete(s, d)), 7),
    f"WITH {_DISCRETE}, {_MI} SELECT 'flag' AS x_id, 'quantity' AS y_id, {_r('mi', 'mi', 7)}, {_r('ex', 'ex', 7)}, {_r('ey', 'ey', 7)}, nx, ny, n, {_NMI} FROM q",
)


def _numbers(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "lineitem").select(F.lit("quantity").alias("x_id"), F.lit("price").alias("y_id"), F.col("l_quantity").alias("xv"), F.col("l_extendedprice").alias("yv"))


def _bin_sql(c: str, name: str) -> str:
    return f"floor(({c} - lo_{name}) / (hi_{name} - lo_{name}) * (greatest(2, floor(ln(n_{name}))) - 1) + 0.5)::INTEGER AS {name}"


register(
    "mi_binned", lambda s, d: rounded(C.mi_mle(C.binned(_numbers(s, d))).select("x_id", "y_id", "mi", "ex", "ey", "nx", "ny", "n"), 7),
    f"""WITH st AS (SELECT count(DISTINCT l_quantity) AS n_x, min(l_quantity) AS lo_x, max(l_quantity) AS hi_x, count(DISTINCT l_extendedprice) AS n_y, min(l_extendedprice) AS lo_y, max(l_extendedprice) AS hi_y FROM lineitem),
    dr AS (SELECT {_bin_sql('l_quantity', 'x')}, {_bin_sql('l_extendedprice', 'y')} FROM lineitem, st), {_MI}
    SELECT 'quantity' AS x_id, 'price' AS y_id, {_r('mi', 'mi', 7)}, {_r('ex', 'ex', 7)}, {_r('ey', 'ey', 7)}, nx, ny, n FROM q""",
)
register(
    "entropy", lambda s, d: rounded(C.entropy(table(s, d, "events"), ["event_type"], "user_id"), 7),
    f"WITH c AS (SELECT event_type, user_id, count(*) AS c FROM events GROUP BY ALL), p AS (SELECT event_type, c, c / sum(c) OVER (PARTITION BY event_type) AS p FROM c) SELECT event_type, {_r('-sum(p * ln(p))', 'entropy', 7)}, sum(c)::BIGINT AS n FROM p GROUP BY event_type",
)
register(
    "kendall", lambda s, d: rounded(C.grouped(_joined(s, d), C.KERNELS["KENDALL"])),
    f"""{_E} pr AS (SELECT sign(a.xv - b.xv) * sign(a.yv - b.yv) AS s, a.xv = b.xv AS tx, a.yv = b.yv AS ty FROM jn a JOIN jn b ON a.h < b.h), n AS (SELECT count(*) AS n FROM jn)
    SELECT '{_X}' AS x_id, '{_Y}' AS y_id, {_r('sum(s) / sqrt((count(*) - count(*) FILTER (tx)) * (count(*) - count(*) FILTER (ty)))', 'value')}, (SELECT n FROM n) AS n FROM pr""",
)
_TAU = "sum(s) / sqrt((count(*) - count(*) FILTER (tx)) * (count(*) - count(*) FILTER (ty)))"
register(
    "sketch_kendall_mi", lambda s, d: rounded(C.grouped(_joined(s, d), C.KERNELS["KENDALL_MI"])),
    f"""{_E} pr AS (SELECT sign(a.xv - b.xv) * sign(a.yv - b.yv) AS s, a.xv = b.xv AS tx, a.yv = b.yv AS ty FROM jn a JOIN jn b ON a.h < b.h), t AS (SELECT {_TAU} AS t FROM pr)
    SELECT '{_X}' AS x_id, '{_Y}' AS y_id, {_r('t * ln(sqrt((1 + t) / (1 - t))) + ln(sqrt(1 - t * t))', 'value')}, (SELECT count(*) FROM jn) AS n FROM t""",
)


def _concordant(s: SparkSession, d: str) -> DataFrame:
    """Estimators on two columns that are one and the same: ranks agree throughout, and the information is undefined (null)."""
    rows = table(s, d, "part").select(F.lit("a").alias("x_id"), F.lit("b").alias("y_id"), F.col("p_partkey").cast("double").alias("xv"), F.col("p_partkey").cast("double").alias("yv"))
    found = C.grouped(rows, C.KERNELS["KENDALL"]).withColumnRenamed("value", "tau")
    more = C.grouped(rows, C.KERNELS["KENDALL_MI"]).select("x_id", "y_id", F.col("value").alias("mi"))
    return rounded(found.join(more, ["x_id", "y_id"]))


register("kendall_concordant", _concordant, "SELECT 'a' AS x_id, 'b' AS y_id, 1.0::DOUBLE AS tau, NULL::DOUBLE AS mi, count(*) AS n FROM part")
register(
    "sketch_pcv", lambda s, d: rounded(C.grouped(_joined(s, d), C.KERNELS["PCV"])),
    f"WITH {_JOINED} SELECT x_id, y_id, {_r(pearson_sql(), 'value')}, count(*) AS n FROM jn GROUP BY x_id, y_id",
)
for _name in ("RIN", "ROBUST_QN", "PM1_BOOTSTRAP", "PM1_SIMPLE", "MIXED_KSG"):
    register(f"sketch_{_name.lower()}", lambda s, d, n=_name: C.grouped(_joined(s, d), C.KERNELS[n]))
register("sketch_ross", lambda s, d: C.grouped(_joined(s, d).withColumn("xv", F.floor(F.col("xv") / 20000).cast("double")), C.KERNELS["ROSS_XY"]))


def _kl(s: SparkSession, d: str) -> DataFrame:
    from sketchloom.functions.kernels import kl_entropy, kl_entropy_mixed

    rows = _joined(s, d)
    plain = C.grouped(rows, lambda x, _: kl_entropy(x)).withColumn("form", F.lit("plain"))
    return rounded(plain.unionByName(C.grouped(rows, lambda x, _: kl_entropy_mixed(x)).withColumn("form", F.lit("mixed"))))


_DIGAMMA = "(list_sum(list_transform(range(1, {m}), lambda i: 1.0 / i)) - 0.57721566490153286)"
register(
    "kl_entropy", _kl,
    f"""{_E} gaps AS (SELECT a.h, abs(a.xv - b.xv) AS d, row_number() OVER (PARTITION BY a.h ORDER BY abs(a.xv - b.xv)) AS rn FROM jn a JOIN jn b ON a.h <> b.h),
    p AS (SELECT h, max(d) FILTER (rn = 3) AS third, min(d) FILTER (d > 0) AS apart, count(*) FILTER (d = 0) + 1 AS same FROM gaps GROUP BY h), n AS (SELECT count(*) AS n FROM jn),
    e AS (SELECT 'plain' AS form, avg(ln(third)) - {_DIGAMMA.format(m=3)} AS e FROM p
          UNION ALL SELECT 'mixed', avg(CASE WHEN same > 3 THEN ln(apart) - {_DIGAMMA.format(m='same')} ELSE ln(third) - {_DIGAMMA.format(m=3)} END) FROM p)
    SELECT '{_X}' AS x_id, '{_Y}' AS y_id, {_r(_DIGAMMA.format(m='n') + ' + ln(2) + e', 'value')}, n, form FROM e, n""",
)


# Vector statistics.

register(
    "stats_moments",
    lambda s, d: rounded(
        table(s, d, "lineitem").groupBy("l_returnflag").agg(
            stats.covariance("l_quantity", "l_extendedprice").alias("cov"), stats.mean("l_quantity").alias("mean"), stats.median("l_quantity").alias("median"),
            stats.extent("l_quantity")["low"].alias("low"), stats.extent("l_quantity")["high"].alias("high"), stats.std("l_quantity").alias("std"),
            stats.variance("l_quantity").alias("var"), stats.mean_product("l_quantity", "l_discount").alias("dotn"), stats.total("l_quantity").alias("total"),
        ), 4,
    ),
    f"""SELECT l_returnflag, {_r('covar_samp(l_quantity, l_extendedprice)', 'cov', 4)}, {_r('avg(l_quantity)', 'mean', 4)}, {_r('median(l_quantity)', 'median', 4)}, {_r('min(l_quantity)', 'low', 4)}, {_r('max(l_quantity)', 'high', 4)},
    {_r('stddev_pop(l_quantity)', 'std', 4)}, {_r('var_samp(l_quantity)', 'var', 4)}, {_r('avg(l_quantity * l_discount)', 'dotn', 4)}, {_r('sum(l_quantity)', 'total', 4)} FROM lineitem GROUP BY l_returnflag""",
)


def _scaled(s: SparkSession, d: str) -> DataFrame:
    base = table(s, d, "part")
    rows = base.select(
        "p_partkey", stats.unitized("p_retailprice", ["p_brand"]).alias("unit"), stats.standardized("p_retailprice", ["p_brand"]).alias("z"),
        stats.ranked("p_size", ["p_brand"]).alias("rank_avg"), stats.ranked("p_size", ["p_brand"], "min").alias("rank_min"), stats.ranked("p_size", ["p_brand"], "max").alias("rank_max"),
        stats.probabilities("p_retailprice", ["p_brand"]).alias("p"), stats.binned("p_retailprice", 10, F.lit(900.0), F.lit(2000.0)).alias("bin"),
    )
    return rounded(rows, 5)


_PB = "OVER (PARTITION BY p_brand)"
register(
    "stats_scaled", _scaled,
    f"""SELECT p_partkey, {_r(f'(p_retailprice - min(p_retailprice) {_PB}) / (max(p_retailprice) {_PB} - min(p_retailprice) {_PB})', 'unit', 5)}, {_r(f'(p_retailprice - avg(p_retailprice) {_PB}) / stddev_pop(p_retailprice) {_PB}', 'z', 5)},
    {_r('rank() OVER (PARTITION BY p_brand ORDER BY p_size) + (count(*) OVER (PARTITION BY p_brand, p_size) - 1) / 2.0', 'rank_avg', 5)}, (rank() OVER (PARTITION BY p_brand ORDER BY p_size))::DOUBLE AS rank_min,
    (rank() OVER (PARTITION BY p_brand ORDER BY p_size) + count(*) OVER (PARTITION BY p_brand, p_size) - 1)::DOUBLE AS rank_max, {_r(f'p_retailprice / sum(p_retailprice) {_PB}', 'p', 5)}, floor((p_retailprice - 900.0) / 1100.0 * 9 + 0.5)::INTEGER AS bin FROM part""",
)
register(
    "percentile_interval", lambda s, d: rounded(stats.percentile_interval(table(s, d, "orders"), "o_totalprice", ["o_orderpriority"], 0.1), 4),
    f"""WITH r AS (SELECT o_orderpriority, o_totalprice AS v, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice) AS rn, count(*) OVER (PARTITION BY o_orderpriority) AS n FROM orders)
    SELECT o_orderpriority, {_r('max(CASE WHEN rn = greatest(1, ceil(0.05::DOUBLE * n)) THEN v END)', 'lower', 4)}, {_r('max(CASE WHEN rn = greatest(1, ceil(0.95::DOUBLE * n)) THEN v END)', 'upper', 4)}, {_r('avg(v)', 'mean', 4)} FROM r GROUP BY o_orderpriority""",
)


def _fisher(s: SparkSession, d: str) -> DataFrame:
    found = C.pearson(_joined(s, d))
    ci = stats.fisher_interval(F.col("value"), F.col("n"))
    return rounded(found.select("x_id", "y_id", ci["lower"].alias("lower"), ci["upper"].alias("upper")))


register(
    "fisher_interval", _fisher,
    f"{_E} p AS (SELECT x_id, y_id, {pearson_sql()} AS r, count(*) AS n FROM jn GROUP BY x_id, y_id) SELECT x_id, y_id, {_r('tanh(atanh(r) - 1.959963984540054 / sqrt(n - 3))', 'lower')}, {_r('tanh(atanh(r) + 1.959963984540054 / sqrt(n - 3))', 'upper')} FROM p",
)


# Search.


def _index(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    spec = SketchSpec("KMV", 256, "MEAN")
    return build_sketch(pairs(s, d, *INDEXED), spec), build_sketch(pairs(s, d, "customer"), spec)


def _search(kind: str):
    def run(s: SparkSession, d: str) -> DataFrame:
        indexed, query = _index(s, d)
        return I.search(I.postings(indexed, kind), query, kind, 8)

    return run


_SK = kmv_sql("MEAN", 256, *INDEXED, "customer")
_TOP = "SELECT 'customer' AS qid, id, score, row_number() OVER (ORDER BY score DESC, id)::INTEGER AS rank FROM sc QUALIFY rank <= 8"
_STD = f"{_SK}, sc AS (SELECT a.pair_id AS id, count(*) AS score FROM sk a JOIN sk q USING (h) WHERE q.pair_id = 'customer' AND a.pair_id <> 'customer' GROUP BY 1), top AS ({_TOP})"
register("std_index_search", _search("STD"), f"WITH {_STD} SELECT * FROM top")
_SIGN = "CASE WHEN stddev_pop(v) OVER (PARTITION BY pair_id) > 0 THEN sign(v - avg(v) OVER (PARTITION BY pair_id)) ELSE 0 END"
_QCR = (
    f"{_SK}, sg AS (SELECT pair_id, h, ({_SIGN})::INTEGER AS s FROM sk), pos AS (SELECT DISTINCT pair_id, {hash_int_tuple_sql('h', 's')} AS t FROM sg), "
    f"neg AS (SELECT DISTINCT pair_id, {hash_int_tuple_sql('h', '-s')} AS t FROM sg), "
    "wy AS (SELECT p.pair_id AS id, 'p' AS way, count(*) AS n FROM pos p JOIN pos q USING (t) WHERE q.pair_id = 'customer' AND p.pair_id <> 'customer' GROUP BY 1 "
    "UNION ALL SELECT p.pair_id, 'n', count(*) FROM {left} p JOIN {right} q USING (t) WHERE q.pair_id = 'customer' AND p.pair_id <> 'customer' GROUP BY 1), "
    f"sc AS (SELECT id, max(n) AS score FROM wy GROUP BY id), top AS ({_TOP})"
)
register("qcr_index_search", _search("QCR"), f"WITH {_QCR.format(left='pos', right='neg')} SELECT * FROM top")
register("qcri_index_search", _search("QCRI"), f"WITH {_QCR.format(left='neg', right='pos')} SELECT * FROM top")


def _stored(s: SparkSession, df: DataFrame) -> DataFrame:
    path = scratch(s, "stored")
    df.write.parquet(path)
    return s.read.schema(df.schema).parquet(path)


def _reranked(sort: str):
    def run(s: SparkSession, d: str) -> DataFrame:
        # Sketches and hits are read several times, so they are stored first.
        indexed, query = (_stored(s, df) for df in _index(s, d))
        hits = _stored(s, I.search(I.postings(indexed, "STD"), query, "STD", 8))
        return rounded(I.rerank(I.hit_details(hits, query, indexed), sort, indexed))

    return run


_DETAILS = (
    f"{_STD}, cr AS (SELECT a.pair_id AS id, {pearson_sql('q.v', 'a.v')} AS r FROM sk a JOIN sk q USING (h) JOIN top ON top.id = a.pair_id WHERE q.pair_id = 'customer' GROUP BY 1), "
    "sz AS (SELECT pair_id, count(*) AS c, max(u) AS last FROM sk GROUP BY pair_id), "
    "al AS (SELECT id, h, u, count(*) AS c FROM top JOIN sk ON pair_id = id OR pair_id = 'customer' GROUP BY ALL), "
    "kk AS (SELECT id, least(a.c, q.c) AS k, (q.c - 1) / q.last AS card FROM top JOIN sz a ON a.pair_id = id, sz q WHERE q.pair_id = 'customer'), "
    "rk AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY u, h) AS rn FROM al), "
    "jo AS (SELECT id, least(1.0, greatest(0.0, count(*) FILTER (c = 2 AND rn <= k) / any_value(k) * (any_value(k) - 1) / max(CASE WHEN rn <= k THEN u END) / any_value(card))) AS j FROM rk JOIN kk USING (id) GROUP BY id), "
    "de AS (SELECT qid, id, score, rank, CASE WHEN isnan(r) OR r IS NULL THEN 0.0 ELSE r END AS corr, coalesce(j, 0.0) AS joinability FROM top LEFT JOIN cr USING (id) LEFT JOIN jo USING (id))"
)
for _sort, _expr in (("KEY", "score::DOUBLE"), ("CSK", "abs(corr)"), ("BAL", "abs(corr) * joinability")):
    register(
        f"rerank_{_sort.lower()}", _reranked(_sort),
        f"WITH {_DETAILS} SELECT qid, id, score, rank, {_r('corr', 'corr')}, {_r('joinability', 'joinability')}, {_r(_expr, 'rerank_score')}, row_number() OVER (ORDER BY {_expr} DESC, rank)::INTEGER AS new_rank FROM de",
    )


def _greedy_sql(floor: str, score: str, order: str) -> str:
    return f"""WITH RECURSIVE {_DETAILS},
    br AS (SELECT a.pair_id AS a, b.pair_id AS b, {pearson_sql('a.v', 'b.v')} AS r FROM sk a JOIN sk b USING (h) WHERE a.pair_id <> b.pair_id AND a.pair_id IN (SELECT id FROM top) AND b.pair_id IN (SELECT id FROM top) GROUP BY 1, 2),
    bt AS (SELECT a, b, CASE WHEN isnan(r) THEN 0.0 ELSE abs(r) END AS v FROM br),
    gr AS (SELECT 0 AS step, NULL::VARCHAR AS id, 0.0::DOUBLE AS gain, []::VARCHAR[] AS taken UNION ALL
        SELECT step + 1, id, gain, list_append(taken, id) FROM (SELECT *, row_number() OVER (ORDER BY gain DESC, rank) AS rn FROM (
            SELECT gr.step, gr.taken, de.id, any_value(de.rank) AS rank, greatest({floor}, any_value(abs(de.corr)) - coalesce(max(bt.v), 0.0)) * any_value(de.joinability) AS gain
            FROM gr CROSS JOIN de LEFT JOIN bt ON bt.a = de.id AND list_contains(gr.taken, bt.b)
            WHERE NOT list_contains(gr.taken, de.id) GROUP BY gr.step, gr.taken, de.id)) WHERE rn = 1)
    SELECT qid, id, score, rank, {_r('corr', 'corr')}, {_r('joinability', 'joinability')}, {_r(score, 'rerank_score')}, (row_number() OVER (ORDER BY {order}))::INTEGER AS new_rank FROM gr JOIN de USING (id)"""


for _sort, _parts in (
    ("GRD", ("'-inf'::DOUBLE", "gain", "step")), ("GR2", ("0.01", "(SELECT count(*) FROM de) - step + 1", "step")), ("GR3", ("0.01", "gain", "gain DESC, step")),
):
    register(f"rerank_{_sort.lower()}", _reranked(_sort), _greedy_sql(*_parts))


# Evaluation.


def _ranking(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Parts of each brand ranked by price, with their size as relevance, missing for those of a price of 1,000 or less."""
    part = table(s, d, "part")
    line = F.row_number().over(E.Window.partitionBy("p_brand").orderBy(F.desc("p_retailprice"), "p_partkey"))
    ranking = part.select(F.col("p_brand").alias("qid"), F.col("p_partkey").cast("string").alias("id"), line.alias("rank"))
    rel = F.when(F.col("p_retailprice") > 1000, F.col("p_size").cast("double"))
    truth = part.select(F.col("p_brand").alias("qid"), F.col("p_partkey").cast("string").alias("id"), rel.alias("rel"))
    return ranking, truth


_RANKING = "rk AS (SELECT p_brand AS qid, p_partkey::VARCHAR AS id, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) AS rank FROM part), tr AS (SELECT p_brand AS qid, p_partkey::VARCHAR AS id, CASE WHEN p_retailprice > 1000 THEN p_size::DOUBLE END AS rel FROM part)"
register(
    "ndcg", lambda s, d: rounded(E.ndcg(*_ranking(s, d), 20)),
    f"""WITH {_RANKING}, a AS (SELECT qid, sum(coalesce(rel, 0) / log2(rank + 1)) AS dcg FROM rk LEFT JOIN tr USING (qid, id) WHERE rank <= 20 GROUP BY qid),
    b AS (SELECT qid, coalesce(rel, 0) AS rel, row_number() OVER (PARTITION BY qid ORDER BY coalesce(rel, 0) DESC, id) AS rn FROM tr), i AS (SELECT qid, sum(rel / log2(rn + 1)) AS ideal FROM b WHERE rn <= 20 GROUP BY qid)
    SELECT qid, {_r('dcg', 'dcg')}, {_r('ideal', 'ideal')}, {_r('dcg / ideal', 'ndcg')} FROM a JOIN i USING (qid)""",
)
register(
    "recall", lambda s, d: rounded(E.recall(_ranking(s, d)[0].filter("rank <= 40"), _ranking(s, d)[1], 49.0)),
    f"WITH {_RANKING}, g AS (SELECT t.qid, r.id IS NOT NULL AND rel >= 49 AS hit, coalesce(rel >= 49, false) AS good FROM tr t LEFT JOIN rk r ON t.qid = r.qid AND t.id = r.id AND r.rank <= 40), c AS (SELECT qid, count(*) FILTER (hit) AS found, count(*) FILTER (good) AS relevant FROM g GROUP BY qid) "
    f"SELECT qid, found, relevant, {_r('CASE WHEN relevant > 0 THEN found / relevant ELSE NULL END', 'recall')} FROM c".replace("ELSE NULL", "ELSE 'NaN'::DOUBLE"),
)


def _scores(s: SparkSession, d: str) -> DataFrame:
    part = table(s, d, "part")
    line = F.row_number().over(E.Window.partitionBy("p_brand").orderBy("p_partkey"))
    hits = part.select(F.col("p_brand").alias("qid"), line.alias("rank"), (F.col("p_size") / 50.0 * F.when(F.col("p_partkey") % 2 == 0, 1).otherwise(-1)).alias("corr"), (F.col("p_size") / 60.0).alias("containment"))
    return rounded(E.query_scores(hits))


_SCORE_PARTS = {"product": "r * j", "harmonic": "coalesce(2 * r * j / CASE WHEN r + j > 0 THEN r + j END, 0.0)", "arithmetic": "(r + j) / 2", "geometric": "sqrt(r * j)"}
register(
    "query_scores", _scores,
    "WITH h AS (SELECT p_brand AS qid, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS rank, p_size / 50.0::DOUBLE AS r, p_size / 60.0::DOUBLE AS j FROM part) SELECT qid, "
    + f"{_r('avg(j)', 'avg_jc')}, count(*) AS hits, "
    + ", ".join(_r(f"avg({e})" if depth is None else f"avg(CASE WHEN rank <= {depth} THEN {e} END)", f"{n}_{depth or 'all'}") for depth in E.DEPTHS for n, e in _SCORE_PARTS.items())
    + " FROM h GROUP BY qid",
)


# Jobs, sources of synthetic data, and storage.

register("corr_stats_job", lambda s, d: jobs.correlation_stats(pairs(s, d, *_ALL), id_pairs(s, *_IDS), [SketchSpec("KMV", 256, "MEAN"), SketchSpec("GKMV", 0.2, "MEAN"), SketchSpec("TUPSK", 256, "MEAN")]))
register("mi_job", lambda s, d: jobs.information_stats(pairs(s, d, "events", "customer", "orders"), id_pairs(s, ("customer", "orders")), SketchSpec("KMV", 256), "NUMERICAL", "NUMERICAL", "MEAN"))
register("estimators_job", lambda s, d: jobs.run_estimators(pairs(s, d, _X, _Y), id_pairs(s, (_X, _Y)), SketchSpec("KMV", 256, "MEAN"), ["PEARSONS", "SPEARMANS", "QCR", "XICOR", "RIN"]))
register("performance_job", lambda s, d: jobs.correlation_performance(pairs(s, d, _X, _Y), id_pairs(s, (_X, _Y)), SketchSpec("KMV", 256, "MEAN")).select("step", "run", "rows"))
register("synthetic_normal", lambda s, d: synthetic.bivariate_normal(s, 0.7, 2000, "ZIPF_1"))
register("synthetic_uniform", lambda s, d: synthetic.discrete_uniform(s, 20, 2000))
register("synthetic_multinomial", lambda s, d: synthetic.multinomial(s, 64, 0.3, 0.5, 2000))
register("synthetic_corpus", lambda s, d: synthetic.correlated_corpus(s, 2, 3, 3, 500))
register("seeded_sample", lambda s, d: table(s, d, "orders").filter(chance("o_orderkey", seed=3) <= 0.1).select("o_orderkey"))
