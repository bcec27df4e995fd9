import pytest

from sketchloom.plans.cli import main


def test_store_index_and_query(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for name, sign in (("a", 1), ("b", -1)):
        lines = "".join(f"k{i},{sign * i + (i % 3)}\n" for i in range(30))
        (tmp_path / "in" / f"{name}.csv").write_text("key,value\n" + lines)
    folder = lambda n: str(tmp_path / n)
    main(["create-store", "--input", folder("in"), "--output", folder("store")], spark)
    main(["pairwise", "--input", folder("store"), "--output", folder("stats"), "--sketches", "KMV:16", "--aggregates", "MEAN"], spark)
    stats = spark.read.option("header", "true").csv(folder("stats")).collect()
    assert len(stats) == 1 and float(stats[0].pearson) < -0.9
    main(["budget", "--input", folder("store")], spark)
    main(["collisions", "--input", folder("store")], spark)
    main(["build-index", "--input", folder("in"), "--output", folder("index")], spark)
    query = ["query-index", "--index", folder("index"), "--table", f"{folder('in')}/a.csv", "--columns", "key:value", "--sort", "CSK", "--output", folder("hits")]
    main(query, spark)
    hits = spark.read.option("header", "true").csv(folder("hits")).collect()
    assert {h.hit for h in hits} == {"a.csv/key:value", "b.csv/key:value"}
    with pytest.raises(SystemExit):
        main(["nothing"], spark)


def test_pairwise_runs_all_types_and_sketches(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for name, sign in (("a", 1), ("b", -1)):
        lines = "".join(f"k{i},c{i % 3},{sign * i * 1e9}\n" for i in range(30))
        (tmp_path / "in" / f"{name}.csv").write_text("key,kind,value\n" + lines)
    folder = lambda n: str(tmp_path / n)
    main(["create-store", "--input", folder("in"), "--output", folder("store")], spark)
    job = ["pairwise", "--input", folder("store"), "--sketches", "KMV:16,TUPSK:8"]
    main([*job, "--job", "MI", "--aggregates", "MEAN,MOST_FREQUENT", "--output", folder("mi")], spark)
    found = {(r.parameters, r.function, r.x_type, r.y_type) for r in spark.read.option("header", "true").csv(folder("mi")).collect()}
    kinds, sketches = ("NUMERICAL", "CATEGORICAL"), ("KMV:16", "TUPSK:8")
    accepted = (("MEAN", "NUMERICAL"), ("MOST_FREQUENT", "CATEGORICAL"))
    assert found == {(s, f, x, y) for s in sketches for f, y in accepted for x in kinds}
    main([*job, "--job", "CORR_PERF", "--aggregates", "MEAN,MAX", "--output", folder("perf")], spark)
    perf = spark.read.option("header", "true").csv(folder("perf")).collect()
    assert {(r.parameters, r["aggregate"]) for r in perf} == {(s, f) for s in sketches for f in ("MEAN", "MAX")}
