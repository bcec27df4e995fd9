"""The documents pipeline: language, exact copies, near copies, source mix, tokens.

Each stage takes (spark, docs, sf_dir), works on what the stage before it kept, and returns a DataFrame. ``run``
writes the result of each stage as Parquet in the shared folder, reads it again for the next, and deletes it once
the next is written. An empty table passes all stages and gives no rows. All stages but the last keep all columns,
whatever their names; texts are read whole, however long.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sketchloom.llm.bpe import bpe_round_trip
from sketchloom.llm.exact_dedup import drop_exact_copies
from sketchloom.llm.langid import fit_languages, keep_identified
from sketchloom.llm.mixing import mix
from sketchloom.llm.near_dedup import drop_near_copies
from sketchloom.llm.queries import tokenizer_path
from sketchloom.llm.shared import drop_written, read_table, written


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is identified (operator 3); those without letters or any likely language go.

    So do null and empty texts. Repeated rows are judged alike. Rows without id or language are judged but not
    learned from; if there is nothing to learn from, no language is known and all documents go.
    """
    return keep_identified(docs, fit_languages(docs))


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each text (operator 1): that with the largest id.

    A null text counts as empty. Rows without id stay, as do repeated rows of the id that stays.
    """
    return drop_exact_copies(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (operator 2): that with the smallest id.

    Null and empty texts have fingerprint 0. Rows without id stay, as do repeated rows of the id that stays.
    """
    return drop_near_copies(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them (operator 4), copies as repeated rows.

    A null source is one of its own. Texts without words, null ones included, weigh nothing. Of equal finish
    times, the order of a hash decides.
    """
    return mix(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, and the digest of the text that they decode to (operator 7).

    A null or empty text has no ids; repeated rows, such as copies that the mix took, are encoded each.
    """
    coded = bpe_round_trip(docs, tokenizer_path())
    n_tokens = F.size("ids").cast("long").alias("n_tokens")
    return coded.select("doc_id", n_tokens, "ids", F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language", language),
    ("exact_copies", exact_copies),
    ("near_copies", near_copies),
    ("source_mix", source_mix),
    ("tokens", tokens),
]

#: Training a network, fingerprint components and BPE are beyond SQL; tests compare with brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table."""
    docs, before = read_table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
        if before is not None:
            drop_written(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"pipeline": run}


def oracle_sql() -> dict[str, str]:
    return {}
