"""Secret scan with corpus-wide ownership frequency, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sketchloom.llm.shared import bitmap_of, with_bitmap_test, written

# The kinds of secrets, in the order in which equal starts are listed: (kind, pattern, group of the
# value, least length of that value). The first three are the base kinds. The last one alone is no secret: it is
# where a value may stand bare, without the name or form that the other kinds need.
KINDS = [
    ("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    ("access", r"(AKIA[A-Z0-9]{16,})", 1, 20),
    ("hex", r"([0-9a-f]{24,})", 1, 24),
    ("github", r"(gh[pousr]_[A-Za-z0-9]{36,})", 1, 40),
    ("slack", r"(xox[abprs]-[A-Za-z0-9-]{10,})", 1, 15),
    ("jwt", r"(eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]+)", 1, 25),
    ("private_key", r"(-----BEGIN [A-Z0-9 ]*PRIVATE KEY-----)", 1, 30),
    ("bare", r"([A-Za-z0-9+/_-][A-Za-z0-9+/_.-]{14,}[A-Za-z0-9+/_-]=*)", 1, 16),
]
BASE_KINDS, BARE = 3, 7
#: What does not count where a value begins or ends.
EDGES = r"^[.=]+|\.+$"
#: A value seen with at least so many owners is a widely copied example.
EXAMPLE_OWNERS = 3
#: A value looks live from this length and number of different characters on.
LIVE_LENGTH, LIVE_CHARS = 16, 8
#: Matches whose offsets are summed together; keeps running sums linear for texts with very many matches.
CHUNK = 256


def running_starts(gaps: Column, lengths: Column) -> Column:
    """Start of each match from the length of the gap before it and its own length (arrays of equal size)."""
    steps = F.zip_with(gaps, lengths, lambda g, m: F.struct(g.alias("g"), m.alias("m")))

    def of_steps(s: Column) -> Column:
        def total(part):
            return F.aggregate(part, F.lit(0), lambda acc, x: acc + x["g"] + x["m"])

        n = F.size(s)
        heads = F.sequence(F.lit(0), F.floor((n - 1) / CHUNK).cast("int"))
        chunks = F.transform(heads, lambda c: F.slice(s, c * CHUNK + 1, F.lit(CHUNK)))
        sums = F.transform(chunks, total)

        def within(chunk, c):
            first = F.aggregate(F.slice(sums, F.lit(1), c), F.lit(0), lambda a, x: a + x)
            state = F.struct(first.alias("at"), F.array().cast("array<int>").alias("out"))
            return F.aggregate(
                chunk,
                state,
                lambda a, x: F.struct(
                    (a["at"] + x["g"] + x["m"]).alias("at"), F.array_append(a["out"], a["at"] + x["g"]).alias("out")
                ),
                lambda a: a["out"],
            )

        return F.flatten(F.transform(chunks, within))

    return of_steps(steps)


def spans_of(text: Column, order: int) -> Column:
    """Array of (start, kind_order, end, value) of one kind; empty where the text has none."""
    _, pattern, group, least = KINDS[order]
    if order == BARE:  # a run that is too short is not tried again from its other characters
        pattern = r"(?<![A-Za-z0-9+/_-])" + pattern
    empty = F.array().cast("array<struct<start:int,kind_order:int,end:int,value:string>>")
    regex = F.lit(pattern)
    matches = F.regexp_extract_all(text, regex, F.lit(0))
    values = F.regexp_extract_all(text, regex, F.lit(group))
    gaps = F.transform(F.split(text, pattern, -1), F.length)
    lengths = F.transform(matches, F.length)
    starts = running_starts(F.slice(gaps, F.lit(1), F.size(lengths)), lengths)
    found = F.transform(
        F.arrays_zip(starts.alias("s"), lengths.alias("n"), values.alias("v")),
        lambda x: F.struct(
            x["s"].alias("start"),
            F.lit(order).alias("kind_order"),
            (x["s"] + x["n"]).alias("end"),
            x["v"].alias("value"),
        ),
    )
    kept = F.filter(found, lambda x: looks_live(x["value"]) if order == BARE else F.length(x["value"]) >= least)
    return F.when(text.rlike(pattern), kept).otherwise(empty)


def looks_live(value: Column) -> Column:
    """Whether a value looks generated: by its length and its number of different characters."""
    return (F.length(value) >= LIVE_LENGTH) & (F.size(F.array_distinct(F.split(value, ""))) >= LIVE_CHARS)


def secret_scan(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    repo_col: str = "source",
    owner_col: str = "source",
) -> DataFrame:
    """One row for each row of ``docs``: doc_id and spans, an array in order of start and kind.

    A span has start, kind_order, end (code points, end exclusive), value_sha256 (of the value without EDGES),
    n_repos, n_owners and a verdict: ``example`` if the value occurs with EXAMPLE_OWNERS owners or more anywhere
    in the corpus, else ``live`` if it looks generated, else ``weak``. Spans of all kinds but BARE stay whatever
    the verdict. A value judged live is owner-specific, so its other occurrences are secrets too: a run of value
    characters that equals it and touches no other span becomes a span of kind BARE. Bare occurrences count
    towards the owners of a value, but alone they make no value a candidate.

    Texts are scanned once, into a narrow table of spans. Bare runs that a bitmap of the looked-for values rules
    out go first. Candidate hashes are then reduced to distinct (value, repository, owner) before they are counted
    by value, so a key pasted into every document costs one row for each owner; spans and counts meet in a
    join that adaptive execution may split, and rows without spans take no part in it.

    A null text counts as empty; a null repository or owner is one of its own. Whole texts are read, however
    long; columns of ``docs`` other than the four named ones are ignored. Repeated rows are reported each. An
    empty table gives no rows.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    spans = F.flatten(F.array(*[spans_of(F.col("_text"), k) for k in range(len(KINDS))]))
    scanned = docs.select(
        F.col(id_col).alias("doc_id"),
        F.coalesce(F.col(repo_col).cast("string"), F.lit("\0")).alias("repo"),
        F.coalesce(F.col(owner_col).cast("string"), F.lit("\0")).alias("owner"),
        text.alias("_text"),
    ).select("doc_id", "repo", "owner", spans.alias("spans"))
    hashed = F.transform(
        F.col("spans"),
        lambda x: F.struct(
            x["start"].alias("start"),
            x["kind_order"].alias("kind_order"),
            x["end"].alias("end"),
            F.sha2(F.regexp_replace(x["value"], EDGES, ""), 256).alias("value_sha256"),
            looks_live(x["value"]).alias("looks_live"),
        ),
    )
    scanned = scanned.withColumns({"spans": hashed, "row": F.monotonically_increasing_id()})
    scanned = written(scanned, "secret-spans")

    cands = scanned.filter(F.size("spans") > 0).select("row", "repo", "owner", F.explode("spans").alias("x"))
    cands = cands.select("row", "repo", "owner", "x.*")
    named = cands.filter(F.col("kind_order") < BARE)
    wanted = bitmap_of(named.filter("looks_live"), F.col("value_sha256"))
    bare = with_bitmap_test(cands.filter(F.col("kind_order") == BARE), wanted, F.col("value_sha256"), "_hit")
    cands = named.unionByName(bare.filter("_hit").drop("_hit"))
    owned = cands.groupBy("value_sha256", "repo", "owner").agg(F.max(F.col("kind_order") < BARE).alias("named"))
    # Keyed by the value's first byte too, so that the join below brings its own exchange, which AQE may split.
    counts = owned.groupBy("value_sha256", F.left("value_sha256", F.lit(2)).alias("head")).agg(
        F.count_distinct("repo").alias("n_repos"), F.count_distinct("owner").alias("n_owners"), F.max("named").alias("named")
    )
    judged = cands.join(counts.filter("named").drop("head", "named"), "value_sha256")
    verdict = (
        F.when(F.col("n_owners") >= EXAMPLE_OWNERS, "example").when(F.col("looks_live"), "live").otherwise("weak")
    )
    judged = judged.withColumn("verdict", verdict).filter((F.col("kind_order") < BARE) | (F.col("verdict") == "live"))
    line = Window.partitionBy("row").orderBy("start", "kind_order")
    other = F.col("kind_order") < BARE
    reach = F.max(F.when(other, F.col("end"))).over(line.rowsBetween(Window.unboundedPreceding, -1))
    ahead = F.min(F.when(other, F.col("start"))).over(line.rowsBetween(1, Window.unboundedFollowing))
    judged = judged.withColumns({"_reach": reach, "_ahead": ahead})
    apart = (F.coalesce("_reach", F.lit(0)) <= F.col("start")) & (F.coalesce("_ahead", F.col("end")) >= F.col("end"))
    span = F.struct("start", "kind_order", "end", "value_sha256", "n_repos", "n_owners", "verdict")
    per_row = judged.filter(other | apart).groupBy(F.col("row").alias("_row")).agg(F.array_sort(F.collect_list(span)).alias("found"))
    none = F.array().cast(per_row.schema["found"].dataType)
    some = scanned.filter(F.size("spans") > 0).select("row", "doc_id").join(per_row, F.col("row") == F.col("_row"), "left")
    some = some.select("doc_id", F.coalesce("found", none).alias("spans"))
    without = scanned.filter(F.size("spans") == 0).select("doc_id", none.alias("spans"))
    return some.unionByName(without)


def listed(spans: Column) -> Column:
    """Spans as kind:start:end, comma-joined."""
    names = F.array(*[F.lit(k[0]) for k in KINDS])
    part = F.transform(
        spans,
        lambda x: F.concat_ws(":", F.element_at(names, x["kind_order"] + 1), x["start"].cast("string"), x["end"].cast("string")),
    )
    return F.array_join(part, ",")
