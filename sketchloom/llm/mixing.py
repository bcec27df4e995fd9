"""Mixing sources to target weights by weighted fair queueing, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sketchloom.llm.shared import written

WORD = r"[^\x20\x09-\x0D]+"
#: A document is taken at most so many times.
MAX_EPOCHS = 3
#: Ranges of the shuffle order in each source; running sums need one range in one task, never a whole source.
RANGES = 4096
#: Sources of which ``mix`` broadcasts the places where they are cut; with more, rows meet their copies in a join.
BROADCAST_SOURCES = 10_000
#: Ranges of virtual finish time among which the cut is looked for: of each unit up to 2, and of each doubling beyond.
TIME_RANGES, LATE_RANGES = 65536, 1024


def word_count(text):
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def shuffle_place(doc_id, source, size, seed):
    """Place of a document in the shuffled order of its source, and the range of that order that it is in."""
    place = F.xxhash64(F.lit(seed), doc_id, source, size)
    return place, F.pmod(F.shiftright(place, 40), F.lit(RANGES)).cast("int")


def mix_plan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
             weights: tuple[int, ...] = (1, 2, 3), seed: int = 17) -> DataFrame:
    """One row for each row of ``docs``: doc_id, text_hash, source, size, source_size, target, copies, taken, part, place.

    Sources in code point order, null last, weigh ``weights`` in turn and share all words: a source's target
    is its weighted share, at most MAX_EPOCHS times its size, with what is above shared out again by weight.

    Each source is a queue of its documents in a seeded shuffled order, passed over at most MAX_EPOCHS times.
    A copy's virtual finish time is the number of words queued in its source up to its end, divided by the
    target. Copies of all sources are ordered by finish time and taken while their words fit in the budget, the
    sum of all sizes. Because a finish time grows evenly from 0 to 1 in each source, equal ranges of time
    are ranges of that order with about equally many rows.

    No source lies in one task: running sums are taken within RANGES ranges of the shuffle order, whose
    totals are summed first. The order depends on seed, id and text size only, so reruns agree. A null text
    has size 0; rows of size 0 are never taken. A null source is a source. Rows repeated with the same id
    are separate documents of the mix, equal places going by id and a hash of the text. Texts are counted whole, however long. An empty table
    gives no rows. Other columns are ignored, whatever their names.
    """
    sized = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).cast("string").alias("source"),
                        word_count(F.col(text_col)).alias("size"), F.xxhash64(F.col(text_col)).alias("text_hash"))
    place, part = shuffle_place(F.col("doc_id"), F.col("source"), F.col("size"), seed)
    sized = written(sized.withColumns({"place": place, "part": part}), "mix-sizes")
    targets = source_targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), weights)
    targets = written(targets, "mix-targets")

    parts = sized.groupBy("source", "part").agg(F.sum("size").alias("words"))
    before = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = parts.select(F.col("source").alias("o_source"), F.col("part").alias("o_part"),
                           F.coalesce(F.sum("words").over(before), F.lit(0)).alias("offset"))
    within = Window.partitionBy("source", "part").orderBy("place", "doc_id", "text_hash").rowsBetween(Window.unboundedPreceding, 0)
    queued = sized.withColumn("run", F.sum("size").over(within))
    queued = queued.join(offsets, queued["source"].eqNullSafe(offsets["o_source"]) & (queued["part"] == offsets["o_part"]))
    queued = queued.withColumn("queued", F.col("offset") + F.col("run")).drop("o_source", "o_part", "offset", "run")
    t = targets.select(F.col("source").alias("t_source"), "source_size", "target")
    queued = written(queued.join(t, queued["source"].eqNullSafe(t["t_source"])).drop("t_source"), "mix-queued")

    epochs = F.sequence(F.lit(0), F.lit(MAX_EPOCHS - 1))
    copies = queued.filter("size > 0 and target > 0").withColumn("epoch", F.explode(epochs))
    copies = copies.withColumn("finish", finish_time(F.col("epoch")))
    late = 2 * TIME_RANGES + F.floor((F.log2(F.greatest(F.col("finish"), F.lit(2.0))) - 1) * LATE_RANGES)
    slot = F.when(F.col("finish") < 2, F.floor(F.col("finish") * TIME_RANGES)).otherwise(late)
    copies = copies.withColumn("slot", slot.cast("long"))
    budget = targets.agg(F.coalesce(F.sum("source_size"), F.lit(0))).first()[0]
    # Sources fill up evenly until 1, so the cut is near 1; later times are few wide slots, so that a source much
    # larger than its target adds no more than a bounded number of them.
    slots = copies.groupBy("slot").agg(F.sum("size").alias("words"))
    order = Window.orderBy("slot").rowsBetween(Window.unboundedPreceding, 0)
    filled = slots.withColumn("upto", F.sum("words").over(order)).filter(F.col("upto") > budget)
    cut = filled.agg(F.min(F.struct("slot", (F.col("upto") - F.col("words")).alias("base"))).alias("cut")).first()[0]

    taken = []
    if cut is not None:
        line = Window.orderBy("finish", "place", "doc_id", "epoch").rowsBetween(Window.unboundedPreceding, 0)
        edge = copies.filter(F.col("slot") == cut["slot"]).withColumn("upto", F.sum("size").over(line) + cut["base"])
        out = edge.filter(F.col("upto") > budget).agg(F.min(F.struct("finish", "place", "doc_id", "epoch"))).first()[0]
        kinds = dict(edge.dtypes)
        limit = F.struct(*[F.lit(out[k]).cast(kinds[k]).alias(k) for k in ("finish", "place", "doc_id", "epoch")])
        for e in range(MAX_EPOCHS):
            own = F.struct(finish_time(F.lit(e)).alias("finish"), "place", "doc_id", F.lit(e).alias("epoch"))
            taken.append(F.when((F.col("target") > 0) & (own < limit), 1).otherwise(0))
    else:
        taken = [F.when(F.col("target") > 0, 1).otherwise(0)] * MAX_EPOCHS
    result = queued.withColumn("copies", sum(taken[1:], taken[0]).cast("int"))
    return result.select("doc_id", "text_hash", "source", "size", "source_size", "target",
                         F.when(F.col("size") > 0, F.col("copies")).otherwise(0).alias("copies"),
                         F.when(F.col("size") > 0, F.col("copies") * F.col("size")).otherwise(0).cast("long").alias("taken"), "part", "place")


def finish_time(epoch):
    return (epoch * F.col("source_size") + F.col("queued")).cast("double") / F.col("target")


def source_targets(sizes: DataFrame, weights: tuple[int, ...]) -> DataFrame:
    """(source, source_size, weight, target) from (source, source_size).

    The fair level is the words for each unit of weight once every source that reaches MAX_EPOCHS times its
    size is set aside. Sources are tried in the order in which they would reach it.
    """
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    pick = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.pmod(rank - 1, F.lit(len(weights))) + 1).cast("int"))
    s = sizes.withColumn("weight", pick.cast("long")).withColumn("cap", F.col("source_size") * MAX_EPOCHS)
    fill = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    upto = fill.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(F.lit(1))
    s = s.withColumns({
        "left_words": F.sum("source_size").over(whole) - F.coalesce(F.sum("cap").over(upto), F.lit(0)),
        "left_weight": F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(upto), F.lit(0)),
        "at": F.row_number().over(fill),
    })
    # A source stays below its cap if, all before it being at theirs, the level does not reach its own.
    below = F.when(F.col("cap") * F.col("left_weight") >= F.col("weight") * F.col("left_words"), F.col("at"))
    s = s.withColumn("first_below", F.min(below).over(whole))
    level = F.struct("at", "left_words", "left_weight")
    s = s.withColumn("level", F.min(F.when(F.col("at") == F.col("first_below"), level)).over(whole))
    share = (F.col("weight") * F.col("level.left_words")).cast("double") / F.col("level.left_weight")
    capped = F.col("first_below").isNull() | (F.col("at") < F.col("first_below"))
    return s.select("source", "source_size", "weight",
                    F.when(capped, F.col("cap").cast("double")).otherwise(share).alias("target"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = 17) -> DataFrame:
    """The rows of ``docs`` that the mix takes, each as often as it is taken, with the columns of ``docs``.

    In each pass over a source the documents taken are those up to some place of its order, so a few places for
    each source tell every row how often it is taken, and no text is shuffled. With more than BROADCAST_SOURCES
    sources rows meet their copies by id, source and text instead. Of repeated rows with all these equal,
    each is taken as often as the one that is taken most. Rows of size 0 go, so do all of an empty table.
    """
    plan = mix_plan(docs, id_col, text_col, source_col, seed=seed).filter("copies > 0")
    at = F.struct("part", "place", "doc_id", "text_hash")
    cuts = plan.groupBy("source").agg(*[F.max(F.when(F.col("copies") > e, at)).alias(f"__sl_cut{e}") for e in range(MAX_EPOCHS)])
    cuts = written(cuts.withColumnRenamed("source", "__sl_source"), "mix-cuts")
    source, text_hash = F.col(source_col).cast("string"), F.xxhash64(F.col(text_col))
    if cuts.limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES:
        joined = docs.join(F.broadcast(cuts), source.eqNullSafe(F.col("__sl_source")))

        def key(size):
            place, part = shuffle_place(F.col(id_col), source, size, seed)
            return F.struct(part.alias("part"), place.alias("place"), F.col(id_col).alias("doc_id"), text_hash.alias("text_hash"))

        def times(keyed):
            upto = [F.coalesce((keyed["key"] <= F.col(f"__sl_cut{e}")).cast("int"), F.lit(0)) for e in range(MAX_EPOCHS)]
            return F.when(keyed["size"] > 0, sum(upto[1:], upto[0])).otherwise(0)

        # Lambda variables, so that words are counted once for each row and not once for each use of the count.
        keyed = F.transform(F.array(word_count(F.col(text_col))), lambda n: F.struct(n.alias("size"), key(n).alias("key")))
        copies = F.transform(keyed, times)[0]
    else:
        plan = plan.groupBy("doc_id", "source", "text_hash").agg(F.max("copies").alias("__sl_copies"))
        plan = plan.withColumnsRenamed({"doc_id": "__sl_id", "source": "__sl_source", "text_hash": "__sl_hash"})
        same = F.col(id_col).eqNullSafe(F.col("__sl_id")) & source.eqNullSafe(F.col("__sl_source")) & (text_hash == F.col("__sl_hash"))
        joined, copies = docs.join(plan, same), F.col("__sl_copies")
    return joined.select("*", F.explode(F.array_repeat(F.lit(1), copies)).alias("__sl_copy")).select(*docs.columns)
