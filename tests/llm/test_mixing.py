import re
from collections import defaultdict

from pyspark.sql import functions as F

from sketchloom.llm import mixing
from sketchloom.llm.mixing import MAX_EPOCHS, RANGES, mix, mix_plan
from sketchloom.llm.queries import queries

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def slow_targets(sizes, weights=(1, 2, 3)):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    total, capped = sum(sizes.values()), {}
    while True:
        free = [s for s in order if s not in capped]
        left = total - sum(capped.values())
        share = {s: left * weight[s] / sum(weight[f] for f in free) for s in free}
        over = [s for s in free if share[s] > MAX_EPOCHS * sizes[s]]
        if not over:
            return {**capped, **share}
        for s in over:
            capped[s] = MAX_EPOCHS * sizes[s]


def slow_taken(rows, targets, sizes):
    """Queue all copies of each source and take them in order of finish time until the budget is full."""
    copies = []
    for source in targets:
        own = sorted((r for r in rows if r.source == source), key=lambda r: ((r.place >> 40) % RANGES, r.place, r.doc_id))
        queued = 0
        for epoch in range(MAX_EPOCHS):
            for r in own:
                queued += r.size
                if r.size and targets[source]:
                    copies.append((queued / targets[source], r.place, r.doc_id, epoch, r.size))
    taken, used, budget = defaultdict(int), 0, sum(sizes.values())
    for _, place, doc, _, size in sorted(copies):
        used += size
        if used > budget:
            break
        taken[place, doc] += size
    return taken


def compare(df):
    sized = df.select("doc_id", "source", F.coalesce(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long").alias("size"))
    rows = sized.withColumn("place", F.xxhash64(F.lit(17), "doc_id", "source", "size")).collect()
    sizes = defaultdict(int)
    for r in rows:
        sizes[r.source] += r.size
    targets = slow_targets(sizes)
    want = slow_taken(rows, targets, sizes)
    got = mix_plan(df).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r.source_size == sizes[r.source]
        assert abs(r.target - targets[r.source]) < 1e-6 * max(1, targets[r.source])
        assert r.taken <= MAX_EPOCHS * r.size
    assert sorted(r.taken for r in got) == sorted(want[r.place, r.doc_id] for r in rows)
    by_source = defaultdict(int)
    for r in got:
        by_source[r.source] += r.taken
    return by_source, targets, got


def test_small_table(small):
    compare(small)


def test_near_targets(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    by_source, targets, got = compare(docs)
    most = max(r.size for r in got)
    assert all(abs(by_source[s] - t) <= most for s, t in targets.items())


def test_small_sources_stop_at_three_times(spark):
    rows = [(i, "w " * 100, "big") for i in range(50)] + [(100, "w " * 3, "tiny"), (101, "w", None)]
    by_source, targets, _ = compare(spark.createDataFrame(rows, "doc_id long, text string, source string"))
    assert targets["tiny"] == 9 and by_source["tiny"] == 9 and targets[None] == 3


def test_odd_rows_and_reruns(odd_docs, no_docs):
    first = sorted(map(tuple, mix_plan(odd_docs).collect()), key=str)
    assert first == sorted(map(tuple, mix_plan(odd_docs.repartition(7)).collect()), key=str)
    assert mix_plan(no_docs).count() == 0
    mixed = mix(odd_docs)
    assert mixed.columns == odd_docs.columns
    assert mix(no_docs).count() == 0


def test_mix_repeats_rows(small):
    plan = {r.doc_id: r.copies for r in mix_plan(small).collect() if r.copies}
    got = {r.doc_id: r["count"] for r in mix(small).groupBy("doc_id").count().collect()}
    assert got == plan


def test_both_ways_to_take_rows_agree(spark, small, odd_docs, monkeypatch):
    rows = [(i % 40, f"w{i % 3} " * (i % 7), ["a", "b", None][i % 3]) for i in range(300)]
    repeated = spark.createDataFrame(rows, "doc_id long, text string, source string")
    for docs in (small, odd_docs, repeated):
        plan = mix_plan(docs).filter("copies > 0").groupBy("doc_id", "source", "text_hash").agg(F.max("copies").alias("n"))
        most = {(r.doc_id, r.source, r.text_hash): r.n for r in plan.collect()}
        keyed = docs.select("doc_id", "source", F.xxhash64("text").alias("text_hash")).collect()
        want = sorted((str(r) for r in keyed for _ in range(most.get(tuple(r), 0))))
        for bound in (10_000, 0):
            monkeypatch.setattr(mixing, "BROADCAST_SOURCES", bound)
            got = mix(docs).select("doc_id", "source", F.xxhash64("text").alias("text_hash")).collect()
            assert sorted(map(str, got)) == want


def test_registered_query(spark, small):
    by_source, targets, want = compare(small)
    got = queries()["op4_mix_sources"](spark, "/root/testdata/sf0.001").collect()
    assert got[0].asDict().keys() == {"doc_id", "size", "source_size", "target", "taken"}
    # ``compare`` holds these rows of the plan against the slow queue.
    assert sorted(map(tuple, got)) == sorted((r.doc_id, r.size, r.source_size, r.target, r.taken) for r in want)
