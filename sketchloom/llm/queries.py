"""Queries that apply the operators to the documents table, one for each operator, and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sketchloom.llm.bpe import bpe_round_trip
from sketchloom.llm.exact_dedup import exact_dedup
from sketchloom.llm.langid import fit_languages, identify
from sketchloom.llm.mixing import mix_plan
from sketchloom.llm.near_dedup import simhash_groups
from sketchloom.llm.quality import quality_verdicts
from sketchloom.llm.secrets import BARE, BASE_KINDS, EDGES, EXAMPLE_OWNERS, KINDS, LIVE_CHARS, LIVE_LENGTH, listed, secret_scan
from sketchloom.llm.shared import read_table
from sketchloom.llm.substring_dedup import remove_repeated
from sketchloom.llm.token_files import new_folder, read_token_files, write_token_files
from sketchloom.llm.toxicity import fit_toxicity, score_toxicity


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    digest = F.sha2(F.coalesce(F.col("text"), F.lit("")), 256)
    return exact_dedup(docs, carry={"text_sha256": digest})


OP1_SQL = """
SELECT doc_id, max(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256
FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents)
"""

def op2_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = simhash_groups(read_table(spark, sf_dir, "documents"))
    digits = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return groups.select("doc_id", digits.alias("fingerprint"), "component_id")


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return identify(docs, fit_languages(docs))


def op4_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = mix_plan(read_table(spark, sf_dir, "documents"))
    return plan.select("doc_id", "size", "source_size", "target", "taken")


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    automaton, beta = fit_toxicity(docs, read_table(spark, sf_dir, "labels"))
    return score_toxicity(docs, automaton, beta)


def tokenizer_path() -> str:
    import public_tokenizers

    return str(public_tokenizers.path("word_bpe_49k.json"))


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return read_token_files(write_token_files(docs, new_folder(spark), tokenizer_path()))


def op7_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = bpe_round_trip(read_table(spark, sf_dir, "documents"), tokenizer_path())
    return coded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = remove_repeated(read_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


OP8_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (SELECT rid, i, array_to_string(w[i:i + 34], ' ') AS t FROM (SELECT rid, w, unnest(range(1, len(w) - 33)) AS i FROM d)),
again AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY t) AS n FROM win) WHERE n > 1),
gone AS (SELECT DISTINCT rid, unnest(range(i, i + 35)) AS p FROM again),
word AS (SELECT rid, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS p FROM d),
kept AS (SELECT rid, count(*) AS n, string_agg(x, ' ' ORDER BY p) AS t FROM word ANTI JOIN gone USING (rid, p) GROUP BY rid)
SELECT doc_id, len(w) AS n_words, len(w) - coalesce(kept.n, 0) AS n_removed, sha256(coalesce(kept.t, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (rid)
"""


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan(read_table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda x: x["kind_order"] < BASE_KINDS)

    def number(test):
        return F.size(F.filter("spans", test)).cast("long")

    return found.select(
        "doc_id",
        number(lambda x: x["kind_order"] == 0).alias("n_assign"),
        number(lambda x: x["kind_order"] == 1).alias("n_access"),
        number(lambda x: x["kind_order"] == 2).alias("n_hex"),
        F.sha2(listed(base), 256).alias("base_sha256"),
        listed(F.col("spans")).alias("spans"),
        number(lambda x: x["verdict"] == "example").alias("n_example"),
        number(lambda x: x["verdict"] == "live").alias("n_live"),
    )


def _op9_sql() -> str:
    parts = []
    for order, (_, pattern, group, least) in enumerate(KINDS):
        p = pattern.replace("'", "''")
        parts.append(f"""
        SELECT rid, doc_id, source, {order} AS o, unnest(range(1, len(m) + 1)) AS i, m, v, g, {least} AS least
        FROM (SELECT rid, doc_id, source, regexp_extract_all(t, '{p}') AS m, regexp_extract_all(t, '{p}', {group}) AS v,
                     string_split_regex(t, '{p}') AS g FROM d)""")
    names = "[" + ", ".join(f"'{k[0]}'" for k in KINDS) + "]"
    return f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, source, coalesce(text, '') AS t FROM documents),
raw AS ({" UNION ALL ".join(parts)}),
every AS (SELECT rid, source, o, regexp_replace(v[i], '{EDGES}', '', 'g') AS value, length(m[i]) AS n,
                 coalesce(list_sum([length(x) FOR x IN g[1:i]]), 0) + coalesce(list_sum([length(x) FOR x IN m[1:i - 1]]), 0) AS s,
                 length(v[i]) >= {LIVE_LENGTH} AND len(list_distinct(string_split(v[i], ''))) >= {LIVE_CHARS} AS looks_live
          FROM raw WHERE length(v[i]) >= least),
pos AS (SELECT * FROM every WHERE o < {BARE}
        UNION ALL SELECT * FROM every WHERE o = {BARE} AND looks_live AND value IN (SELECT value FROM every WHERE o < {BARE} AND looks_live)),
freq AS (SELECT value, count(DISTINCT coalesce(source, chr(1))) AS owners FROM pos GROUP BY value),
span AS (SELECT rid, o, s, {names}[o + 1] || ':' || s || ':' || (s + n) AS line, owners, looks_live
         FROM pos AS p JOIN freq USING (value)
         WHERE o < {BARE} OR (owners < {EXAMPLE_OWNERS} AND NOT EXISTS (
             SELECT 1 FROM pos AS q WHERE q.rid = p.rid AND q.o < {BARE} AND q.s < p.s + p.n AND p.s < q.s + q.n))),
agg AS (SELECT rid, count(*) FILTER (o = 0) AS n_assign, count(*) FILTER (o = 1) AS n_access, count(*) FILTER (o = 2) AS n_hex,
               string_agg(line, ',' ORDER BY s, o) FILTER (o < 3) AS base, string_agg(line, ',' ORDER BY s, o) AS spans,
               count(*) FILTER (owners >= {EXAMPLE_OWNERS}) AS n_example, count(*) FILTER (owners < {EXAMPLE_OWNERS} AND looks_live) AS n_live
        FROM span GROUP BY rid)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(n_example, 0) AS n_example,
       coalesce(n_live, 0) AS n_live
FROM d LEFT JOIN agg USING (rid)
"""


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_verdicts(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_exact_dedup": op1_exact_dedup,
    "op2_simhash_near_dedup": op2_simhash_near_dedup,
    "op3_language_id": op3_language_id,
    "op4_mix_sources": op4_mix_sources,
    "op5_toxicity": op5_toxicity,
    "op6_token_files": op6_token_files,
    "op7_bpe_round_trip": op7_bpe_round_trip,
    "op8_substring_dedup": op8_substring_dedup,
    "op9_secret_scan": op9_secret_scan,
    "op10_quality_rules": op10_quality_rules,
}
_ORACLES: dict[str, str] = {"op1_exact_dedup": OP1_SQL, "op8_substring_dedup": OP8_SQL, "op9_secret_scan": _op9_sql()}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_ORACLES)
