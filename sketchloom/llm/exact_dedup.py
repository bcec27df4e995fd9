"""Exact duplicate removal by progressive refinement, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sketchloom.llm.shared import bitmap_of, text_key, with_bitmap_test, without_rows

#: Characters that the second level hashes.
PREFIX_CHARS = 128


def exact_dedup(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: dict[str, Column] | None = None
) -> DataFrame:
    """One row for each row of ``docs``: doc_id, keep_id, group_size, kept, and the ``carry`` expressions.

    Three levels: byte length, then a hash of the first characters, then SHA-256 of the whole text. Each
    level looks only at the groups that the level before left with more than one row; what survives is
    passed on as a bitmap of fixed size, so no level shuffles a text, and the last hashes only texts that
    share length and prefix with another. Groups are counted with map-side partial aggregation, so a text
    that a third of all rows share arrives as one row from each task. Rows and groups then meet in a join
    whose large partitions adaptive execution can split.

    Of equal texts the row with the largest doc_id stays. A null text counts as empty; texts differ unless
    identical without any change. Rows with equal text and equal doc_id are one document and get the same
    answer; a null doc_id stays only if no row of the group has one. An empty table gives no rows. Other
    columns of ``docs`` are ignored.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    src = docs.select(
        F.col(id_col).alias("doc_id"), text.alias("_text"), *[c.alias(n) for n, c in (carry or {}).items()]
    )
    length, prefix = F.octet_length("_text"), F.xxhash64(F.left(F.col("_text"), F.lit(PREFIX_CHARS)))

    lengths = src.groupBy(length.alias("len")).count().filter("count > 1")
    by_length = bitmap_of(lengths, F.col("len"))
    narrowed = with_bitmap_test(src.select("_text", length.alias("len")), by_length, F.col("len"), "hit").filter("hit")
    prefixes = narrowed.groupBy("len", prefix.alias("prefix")).count().filter("count > 1")
    pair = F.xxhash64("len", "prefix")
    by_prefix = bitmap_of(prefixes, pair)

    rows = with_bitmap_test(
        src.withColumns({"len": length, "prefix": prefix}), by_prefix, F.xxhash64("len", "prefix"), "hit"
    )
    rows = rows.withColumn("full", F.when(F.col("hit"), F.sha2(F.col("_text"), 256)))
    rows = rows.select("doc_id", "len", "full", *(carry or {}))
    groups = (
        rows.filter(F.col("full").isNotNull())
        .groupBy("full", "len")
        .agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
        .filter("group_size > 1")
        .select(F.col("full").alias("g_full"), "keep_id", "group_size")
    )
    # A row that no level paired with another gets a key of its own: it spreads evenly and meets no group.
    key = F.coalesce(F.col("full"), F.concat(F.lit("-"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    joined = rows.withColumn("full", key).join(groups, F.col("full") == F.col("g_full"), "left")
    alone = F.col("group_size").isNull()
    keep = F.when(alone, F.col("doc_id")).otherwise(F.col("keep_id"))
    return joined.select(
        "doc_id",
        keep.alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        F.col("doc_id").eqNullSafe(keep).alias("kept"),
        *(carry or {}),
    )


def drop_exact_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the rows whose text another row with a larger doc_id has too, all columns kept.

    Rows without id stay. A repeated row with the id that stays remains as it is, and so do other texts of an id.
    """
    gone = exact_dedup(docs, id_col, text_col, {"_key": text_key(F.col(text_col))}).filter("not kept").select("doc_id", "_key")
    return without_rows(docs, id_col, text_col, gone)
