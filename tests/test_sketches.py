"""Sketch builders, joins, set estimates, search and evaluation on small tables."""

import json
import math

import pytest
from pyspark.sql import functions as F

from sketchloom.functions.aggregates import aggregate, handler, parse_aggregations
from sketchloom.operators import correlation as C
from sketchloom.operators import index as I
from sketchloom.operators import joins as J
from sketchloom.operators import setops as S
from sketchloom.operators.sketch import SketchSpec, build_sketch, merge_sketches, sketch_meta
from sketchloom.plans import evaluation as E
from sketchloom.plans.params import parse_index, parse_sketches
from sketchloom.sources import store, synthetic, tables
from sketchloom.streaming.merge import SketchStream


def column(spark, pair_id, keys, values):
    rows = [(pair_id, i, str(k), float(v)) for i, (k, v) in enumerate(zip(keys, values))]
    return spark.createDataFrame(rows, "pair_id string, ord long, k string, v double")


def ids(spark, *pairs):
    return spark.createDataFrame(list(pairs), "x_id string, y_id string")


def test_aggregates(spark):
    df = column(spark, "p", "aaaa", [0, 1, 1, 2])
    got = df.agg(*[aggregate(n).alias(n) for n in ("FIRST", "LAST", "MIN", "MAX", "SUM", "MEAN", "COUNT")]).first()
    assert tuple(got) == (0, 2, 0, 2, 4, 1, 4)
    assert column(spark, "p", "aaaaaa", [1, 2, 2, 2, 3, 3]).agg(aggregate("MOST_FREQUENT")).first()[0] == 2
    assert parse_aggregations("") == ["FIRST"] and parse_aggregations("sum, mean") == ["SUM", "MEAN"]
    assert handler("COUNT").output_type("CATEGORICAL") == "NUMERICAL"
    with pytest.raises(ValueError):
        parse_aggregations("median")


def test_sketch_correlation_of_aggregates(spark):
    x = column(spark, "x", "aabbcd", [-20, 21, 1, 1, 3, 4])
    for agg, values in (("SUM", [1, 2, 3, 4]), ("MEAN", [0.5, 1, 3, 4]), ("COUNT", [2, 2, 1, 1])):
        sx, sy = build_sketch(x, SketchSpec("KMV", 256, agg)), build_sketch(column(spark, "y", "abcd", values), SketchSpec("KMV", 256))
        found = C.pearson(J.join_sketches(sx, sy)).first()
        assert found.n == 4 and abs(found.value - 1) < 1e-9


def test_partial_overlap(spark):
    sx = build_sketch(column(spark, "x", "abcdf", [1, 2, 3, 4, 5]), SketchSpec("KMV", 5))
    sy = build_sketch(column(spark, "y", "!abcde", [0, 2, 3, 4, 5, 6]), SketchSpec("KMV", 5))
    found = C.pearson(J.join_sketches(sx, sy)).first()
    assert found.n == 3 and abs(found.value - 1) < 1e-9


def hashes(spark, pair_id, keys):
    return column(spark, pair_id, keys, keys)


def test_set_estimates(spark):
    a, b, c = [1, 2, 3, 4, 5], [1, 2, 3, 8, 9], [6, 7, 8, 9, 0]
    spec = SketchSpec("KMV", 4)
    all_rows = hashes(spark, "a", a).unionByName(hashes(spark, "b", b)).unionByName(hashes(spark, "c", c)).unionByName(hashes(spark, "a2", a))
    sk = build_sketch(all_rows, spec, key_is_hash=True)
    got = {r.y_id: r for r in S.set_estimates(sk, sk, spec, ids(spark, ("a", "a2"), ("a", "b"), ("a", "c"))).collect()}
    for y, (i, u, j) in {"a2": (5, 5, 1), "b": (3, 7, 0.428), "c": (0, 10, 0)}.items():
        assert abs(got[y].intersection - i) <= 1 and abs(got[y].union - u) <= 1 and abs(got[y].jaccard - j) <= 0.1
    with pytest.raises(NotImplementedError):
        S.set_estimates(sk, sk, SketchSpec("PRISK", 4), ids(spark, ("a", "b")))


def test_distinct_estimate(spark):
    rows = hashes(spark, "n", list(range(1, 1001)))
    spec = SketchSpec("KMV", 10)
    assert 1 - sketch_meta(build_sketch(rows, spec, True), spec).first().distinct_be / 1000 < 0.15


def test_repeated_keys(spark):
    keys = [6] + [1] * 7 + [2, 3, 4, 5]
    rows = hashes(spark, "p", keys)
    for kind in ("TUPSK", "PRISK"):
        got = {r.h: r.v for r in build_sketch(rows, SketchSpec(kind, 6, "SUM"), True).collect()}
        assert got[1] == 7.0
    tuples = build_sketch(rows, SketchSpec("TUPSK", 6, "NONE"), True).collect()
    assert len(tuples) == 6 and sum(r.h == 1 for r in tuples) > 1
    kept = build_sketch(hashes(spark, "q", [1] * 7 + [2, 3, 4, 5, 6, 7]), SketchSpec("KMV", 4, "NONE"), True).collect()
    per_key = {h: sum(r.h == h for r in kept) for h in {r.h for r in kept}}
    assert per_key.get(1, 2) == 2 and all(n == 1 for h, n in per_key.items() if h != 1)


def test_sketch_does_not_depend_on_partitions(spark):
    rows = column(spark, "p", [f"k{i % 300}" for i in range(900)], range(900))
    for spec in (SketchSpec("KMV", 64), SketchSpec("INDSK", 64, "SUM"), SketchSpec("TUPSK", 64, "NONE"), SketchSpec("KMV", 64, "NONE")):
        first, second = (sorted(map(str, build_sketch(df, spec).collect())) for df in (rows.coalesce(1), rows.repartition(7)))
        assert first == second


def test_merge_and_stream(spark, tmp_path):
    spec = SketchSpec("KMV", 32, "SUM")
    rows = column(spark, "p", [f"k{i % 100}" for i in range(400)], range(400))
    whole = {(r.h, r.v, r.n) for r in build_sketch(rows, spec).collect()}
    halves = [build_sketch(rows.filter(F.col("ord") % 2 == i), spec) for i in (0, 1)]
    assert {(r.h, r.v, r.n) for r in merge_sketches(*halves, spec).collect()} == whole
    rows.repartition(4).write.parquet(str(tmp_path / "in"))
    sink = SketchStream(spark, str(tmp_path / "sketch"), spec)
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    query = sink.start(stream, str(tmp_path / "checkpoint"))
    query.processAllAvailable()
    query.stop()
    assert sink.version >= 1 and {(r.h, r.v, r.n) for r in sink.table().collect()} == whole
    sink.add(rows, 0)
    assert {(r.h, r.v, r.n) for r in sink.table().collect()} == whole
    with pytest.raises(NotImplementedError):
        SketchStream(spark, "x", SketchSpec("TUPSK", 4))


@pytest.mark.parametrize("aggregate", ["FIRST", "LAST", "SUM"])
def test_stream_goes_on_after_a_restart(spark, tmp_path, aggregate):
    spec, path = SketchSpec("KMV", 32, aggregate), str(tmp_path / "sketch")
    rows = column(spark, "p", [f"k{i * 7 % 100}" for i in range(400)], range(400))
    whole = {(r.h, r.v, r.n) for r in build_sketch(rows, spec).collect()}
    for batch in range(4):  # late rows come first
        part = rows.filter((F.col("ord") % 4) == 3 - batch)
        SketchStream(spark, path, spec).add(part, batch)
        SketchStream(spark, path, spec).add(part, batch)
    sink = SketchStream(spark, path, spec)
    assert sink.version == 3 and {(r.h, r.v, r.n) for r in sink.table().collect()} == whole
    assert sorted(p.name for p in (tmp_path / "sketch").iterdir()) == ["v2", "v3"]


def test_pairs_without_estimates_stay(spark):
    one, some, x = column(spark, "one", "a", [1]), column(spark, "some", "abcdef", range(6)), column(spark, "x", [], [])
    ids = spark.createDataFrame([(a, b) for a in ("one", "some", "none") for b in ("one", "some", "none")], "x_id string, y_id string")
    rows = one.unionByName(some).unionByName(x)
    for spec in (SketchSpec("KMV", 4), SketchSpec("GKMV", 0.9), SketchSpec("GKMV", 1e-9)):
        sk = build_sketch(rows, spec)
        for found in (S.set_estimates(sk, sk, spec, ids), S.stored_set_estimates(sk, sk, ids)):
            got = {(r.x_id, r.y_id): r for r in found.collect()}
            assert len(got) == 9
            assert math.isnan(got["none", "none"].containment) and math.isnan(got["none", "some"].containment)
    found = {(r.x_id, r.y_id): r for r in J.overlap(rows, ids).collect()}
    assert len(found) == 9 and found["none", "some"].y_keys == 6 and math.isnan(found["none", "none"].jaccard)
    known = {r.x_id: r.containment for r in S.set_estimates(sk, sk, spec, ids, {"some": 12}).collect() if r.y_id == "some"}
    assert len(known) == 3


def test_known_cardinality_is_used(spark):
    rows = column(spark, "a", [f"k{i}" for i in range(50)], range(50)).unionByName(column(spark, "b", [f"k{i}" for i in range(25)], range(25)))
    spec, ids = SketchSpec("KMV", 100), spark.createDataFrame([("a", "b")], "x_id string, y_id string")
    sk = build_sketch(rows, spec)
    plain, known = S.set_estimates(sk, sk, spec, ids).first(), S.set_estimates(sk, sk, spec, ids, {"a": 98}).first()
    assert plain.intersection == known.intersection and known.containment == plain.containment / 2


def test_full_join(spark):
    a = column(spark, "A", "abcde", [1, 2, 3, 4, 5])
    b = column(spark, "B", "abcd", [1, 2, 3, 4])
    c = column(spark, "C", "abczx", [0, 0, 3, 4, 5])
    d = column(spark, "D", "abcz", [-1, -2, -3, 4])
    for (x, y), want in {(a, b): 1, (b, c): 0.8660254, (b, d): -1}.items():
        joined = J.full_join(x, y, "MEAN").withColumns({"x_id": F.lit("x"), "y_id": F.lit("y")})
        assert abs(C.pearson(joined).first().value - want) < 1e-6


def test_search_order(spark):
    q = column(spark, "q", "abcdefgh", range(1, 9))
    data = {"c0": ("abcdefg", [1, 2, 3, 4, 4, 4, 4]), "c1": ("abcdefg", [6, 3, 3, 4, 5, 6, 7]), "c2": ("abcde", [3, 3, 3, 4, 5.6]), "c3": ("abcde", [1.1, 2.5, 2, 2.7, 3]),
            "c4": ("abcde", [1.5, 1.5, 1, 1, 2]), "c5": ("abcde", [5, 4.1, 3.1, 2, 1]), "c6": ("abcde", [1] * 5)}
    rows = None
    for name, (k, v) in data.items():
        one = column(spark, name, k, v)
        rows = one if rows is None else rows.unionByName(one)
    spec = SketchSpec("KMV", 256)
    sk, qs = build_sketch(rows, spec), build_sketch(q, spec)
    order = spark.createDataFrame([(n, i) for i, n in enumerate(data)], "pair_id string, seq int")
    for kind in ("QCR", "QCRI"):
        hits = I.search(I.postings(sk, kind), qs, kind, 6, order)
        assert [r.id for r in hits.orderBy("rank").collect()] == ["c0", "c1", "c2", "c5", "c3", "c4"]
    std = I.search(I.postings(sk, "STD"), qs, "STD", 3, order)
    assert [r.id for r in std.orderBy("rank").collect()] == ["c0", "c1", "c2"]
    hits = I.hit_details(I.search(I.postings(sk, "QCR"), qs, "QCR", 6, order), qs, sk)
    for sort in I.SORTS:
        out = I.rerank(hits, sort, sk).orderBy("new_rank").collect()
        assert len(out) == 6 and [r.new_rank for r in out] == list(range(1, 7))


def test_index_storage(spark, tmp_path):
    spec = SketchSpec("KMV", 16)
    sk = build_sketch(column(spark, "p", "abc", [1, 2, 3]).unionByName(column(spark, "r", "abd", [1, 2, 3])), spec)
    path = str(tmp_path / "index")
    I.save_index(path, sk, "QCR")
    new = I.update_index(spark, path, build_sketch(column(spark, "p", "xyzw", [1, 2, 3, 4]), spec))
    sketches, posts, kind = I.load_index(spark, new)
    assert kind == "QCR" and sketches.filter("pair_id = 'p'").count() == 4 and sketches.filter("pair_id = 'r'").count() == 3
    assert posts.count() == 7


def test_ranking_metrics(spark):
    rel = {1: 10.0, 2: 0.0, 3: 0.0, 4: 1.0, 5: 5.0}
    truth = spark.createDataFrame([("q", str(i), v) for i, v in rel.items()], "qid string, id string, rel double")
    ranking = spark.createDataFrame([("q", str(i), r) for r, i in enumerate([5, 4, 3, 2, 1], 1)], "qid string, id string, rank int")
    got = E.ndcg(ranking, truth).first()
    assert abs(got.dcg - 9.49) < 0.01 and abs(got.ndcg - 0.69) < 0.01
    truth = spark.createDataFrame([("q", str(i), v) for i, v in enumerate([0.2, 0.1, 0.4, 0.9, 0.01, 1.0], 1)], "qid string, id string, rel double")
    first = spark.createDataFrame([("q", str(i), i) for i in (1, 2, 3)], "qid string, id string, rank int")
    assert E.recall(first, truth, 0.2).first().recall == 0.5


def test_params():
    assert [s.type for s in parse_sketches("KMV:128,GKMV:0.1")] == ["KMV", "GKMV"]
    assert str(parse_index("QCR:CSK:10:KMV:256")[0]) == "QCR:CSK:10:KMV:256"
    for bad in ("KMV", "XX:1"):
        with pytest.raises(ValueError):
            parse_sketches(bad)
    with pytest.raises(ValueError):
        parse_index("QCR:CSK:10:TUPSK:256")
    with pytest.raises(ValueError):
        SketchSpec("GKMV", 2)


def test_tables_and_store(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "t.csv").write_text("char,int,str,double\na,1,asdf,1.1\nb,2,qwer,2.2\nc,-,zxcv,3.3\n")
    found = [r.path for r in tables.find_tables(spark, str(tmp_path / "in"), relative=True).collect()]
    assert found == ["t.csv"]
    df = tables.scan(spark, str(tmp_path / "in" / "t.csv"))
    names = [(p["key_name"], p["column_name"]) for p in tables.pair_catalog(df, "t")]
    assert names == [(k, c) for k in ("char", "str") for c in ("char", "str", "int", "double")]
    pairs = tables.column_pairs(df, "t")
    assert pairs.filter("column_name = 'int'").count() == 4
    assert tables.column_pairs(df, "t", min_rows=9).count() == 0
    with pytest.raises(ValueError):
        tables.scan(spark, "x.txt")
    path = str(tmp_path / "store")
    store.write_store(pairs, path)
    assert store.read_store(spark, path, "t/char:double").count() == 3
    with pytest.raises(KeyError):
        store.read_store(spark, path, "t/none:x")
    sample = store.sample_queries(store.read_catalog(spark, path), 3)
    store.write_sample(sample, 8, str(tmp_path / "sample"))
    total, listed = store.read_sample(spark, str(tmp_path / "sample"))
    assert total == 8 and len(listed) == 3


def test_synthetic(spark):
    df = synthetic.bivariate_normal(spark, 0.8, 4000)
    assert abs(df.stat.corr("X", "Y") - 0.8) < 0.05
    m = synthetic.multinomial(spark, 64, 0.3, 0.5, 3000)
    assert abs(m.stat.corr("X", "Y") - synthetic.multinomial_correlation(0.3, 0.5)) < 0.05
    joined = m.select(F.lit("x").alias("x_id"), F.lit("y").alias("y_id"), F.col("X").alias("xv"), F.col("Y").alias("yv"))
    assert abs(C.mi_mle(joined).first().mi - synthetic.multinomial_mi(64, 0.3, 0.5)) < 0.15
    assert synthetic.correlated_corpus(spark, 1, 2, 2, 50).count() == 250


def test_estimator_dispatch(spark):
    joined = spark.createDataFrame([("x", "y", float(i), float(i % 3)) for i in range(30)], "x_id string, y_id string, xv double, yv double")
    with pytest.raises(NotImplementedError):
        C.estimate(joined, "PEARSONS", "CATEGORICAL", "NUMERICAL")
    with pytest.raises(ValueError):
        C.estimate(joined, "NOPE")
    C.register_estimator("MEAN_GAP", lambda x, y: float((x - y).mean()), [("NUMERICAL", "NUMERICAL")])
    assert C.estimate(joined, "MEAN_GAP").first().value == 13.5


def test_entry_without_training_data_package():
    import subprocess
    import sys
    from pathlib import Path

    code = (
        "import sys, importlib.util as u; real = u.find_spec\n"
        "u.find_spec = lambda n, *a: None if n in ('sketchloom.llm', 'corpus_pipeline') else real(n, *a)\n"
        "import __spark_entry__ as e, json\nprint(json.dumps([len(e.queries()), any(k.startswith('op') for k in e.queries()), 'sketchloom.llm' in sys.modules]))"
    )
    out = subprocess.run([sys.executable, "-c", code], cwd=Path(__file__).resolve().parent.parent, capture_output=True, text=True, check=True)
    n, ops, loaded = json.loads(out.stdout.strip().splitlines()[-1])
    assert n > 80 and not ops and not loaded
