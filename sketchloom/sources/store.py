"""The column store, samples of queries, and report sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sketchloom.sources.tables import PAIR_COLUMNS

CATALOG = ["dataset_id", "pair_id", "pair_no", "key_name", "column_name", "value_type"]


def write_store(pairs: DataFrame, path: str) -> None:
    """Write column pairs, partitioned by dataset, with their catalog beside them; then read the catalog back."""
    spark = pairs.sparkSession
    pairs.select(*PAIR_COLUMNS).write.mode("overwrite").partitionBy("dataset_id").parquet(f"{path}/pairs")
    stored = spark.read.parquet(f"{path}/pairs")
    stored.groupBy(*CATALOG).agg(F.count(F.lit(1)).alias("rows")).coalesce(1).write.mode("overwrite").parquet(f"{path}/catalog")
    if stored.limit(1).count() and not read_catalog(spark, path).limit(1).count():
        raise OSError(f"the store at {path} cannot be read again")


def read_catalog(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/catalog")


def read_store(spark: SparkSession, path: str, pair_id: str | None = None) -> DataFrame:
    """All column pairs of a store, or one; the dataset of one prunes the scan to its partition."""
    pairs = spark.read.parquet(f"{path}/pairs")
    if pair_id is None:
        return pairs
    found = read_catalog(spark, path).filter(F.col("pair_id") == pair_id).select("dataset_id").first()
    if found is None:
        raise KeyError(pair_id)
    return pairs.filter((F.col("dataset_id") == found[0]) & (F.col("pair_id") == pair_id))


def sample_queries(catalog: DataFrame, n: int, pattern: str | None = None, seed: int = 0) -> DataFrame:
    """Pair ids to use as queries: those matching a pattern, or n in the order of a seeded hash (a uniform sample)."""
    ids = catalog.select("pair_id").distinct()
    if pattern is not None:
        return ids.filter(F.col("pair_id").rlike(pattern))
    return ids.orderBy(F.xxhash64("pair_id", F.lit(seed)), "pair_id").limit(n)


def write_sample(sample: DataFrame, total: int, path: str) -> None:
    """A text file: the number of all columns, then the sampled ids, one a line."""
    spark = sample.sparkSession
    head = spark.createDataFrame([(0, str(total))], "part int, value string")
    rows = head.unionByName(sample.select(F.lit(1).alias("part"), F.col("pair_id").alias("value")))
    rows.coalesce(1).sortWithinPartitions("part", "value").select("value").write.mode("overwrite").text(path)


def read_sample(spark: SparkSession, path: str) -> tuple[int, list[str]]:
    """The number of all columns and the sampled ids; the file is one, and its lines keep their order."""
    lines = [r.value for r in spark.read.text(path).coalesce(1).collect()]
    return int(lines[0]), lines[1:]


def write_csv(df: DataFrame, path: str, digits: dict[str, int] | None = None) -> None:
    """Rows as CSV with a header; some columns with a fixed number of decimals."""
    out = df.withColumns({c: F.format_string(f"%.{n}f", F.col(c).cast("double")) for c, n in (digits or {}).items()})
    out.write.mode("overwrite").option("header", "true").csv(path)


def write_hits(hits: DataFrame, path: str) -> None:
    """Search results as CSV: hit, corr, containment, score, rerank_score."""
    columns = [F.col("id").alias("hit"), "corr", F.col("joinability").alias("containment"), "score", "rerank_score"]
    write_csv(hits.select(*columns), path, {"corr": 6, "containment": 6, "rerank_score": 6})
