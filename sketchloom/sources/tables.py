"""Finding and scanning tables, and their column pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sketchloom.functions.aggregates import CATEGORICAL, NUMERICAL
from sketchloom.functions.hashing import murmur3

NUMBER_TYPES = (T.IntegerType, T.LongType, T.FloatType, T.DoubleType)
PAIR_COLUMNS = ["pair_no", "pair_id", "dataset_id", "key_name", "column_name", "value_type", "ord", "k", "v"]


def find_tables(spark: SparkSession, base: str, relative: bool = False) -> DataFrame:
    """(path) of every .csv and .parquet file below a folder of any file system Spark reads; contents are not read."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.{csv,parquet}")
    files = reader.load(base).select("path")
    if not relative:
        return files
    root = base.rstrip("/") + "/"
    return files.select(F.substring_index("path", root, -1).alias("path"))


def scan(spark: SparkSession, path: str, **options: str) -> DataFrame:
    """Read a table by its extension; CSV with header, inferred types and ``-`` for a missing value."""
    if path.endswith(".csv"):
        settings = {"header": "true", "inferSchema": "true", "nullValue": "-", "maxCharsPerColumn": "10000", "maxColumns": "1000000"}
        return spark.read.options(**{**settings, **options}).csv(path)
    if path.endswith(".parquet"):
        return spark.read.options(**options).parquet(path)
    raise ValueError(f"neither .csv nor .parquet: {path}")


def key_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, T.StringType)]


def value_columns(df: DataFrame, types: frozenset[str] = frozenset({NUMERICAL, CATEGORICAL})) -> list[tuple[str, str]]:
    """(column, type): strings first, if wanted, then numbers, each in table order."""
    out = [(f.name, CATEGORICAL) for f in df.schema if isinstance(f.dataType, T.StringType) and CATEGORICAL in types]
    out += [(f.name, NUMERICAL) for f in df.schema if isinstance(f.dataType, NUMBER_TYPES) and NUMERICAL in types]
    return out


def pair_catalog(df: DataFrame, dataset_id: str, types: frozenset[str] = frozenset({NUMERICAL, CATEGORICAL})) -> list[dict]:
    """Every (key column, value column) of a table in order, a key paired with itself included."""
    combos = [(k, c, t) for k in key_columns(df) for c, t in value_columns(df, types)]
    return [
        {"pair_no": i, "pair_id": f"{dataset_id}/{k}:{c}", "dataset_id": dataset_id, "key_name": k, "column_name": c, "value_type": t}
        for i, (k, c, t) in enumerate(combos)
    ]


def column_pairs(df: DataFrame, dataset_id: str, types: frozenset[str] = frozenset({NUMERICAL, CATEGORICAL}),
                 order: str | None = None, min_rows: int = 0) -> DataFrame:
    """All column pairs of a table as rows (PAIR_COLUMNS), made in one pass over it.

    Rows with a missing value are dropped, a missing key is the empty string, numbers become doubles and strings
    their hash. ``order`` names a column that orders rows (for FIRST, LAST and tuple samples); without one the
    order of the scan is used. A table with fewer rows than ``min_rows`` has no pairs.
    """
    catalog = pair_catalog(df, dataset_id, types)
    if min_rows and df.limit(min_rows).count() < min_rows:
        catalog = []
    position = F.col(order).cast("long") if order else F.monotonically_increasing_id()
    hashed = {c: f"__h{i}" for i, (c, t) in enumerate(value_columns(df, types)) if t == CATEGORICAL}
    rows = df.withColumns({"__ord": position, **{h: murmur3(F.col(c)).cast("double") for c, h in hashed.items()}})
    structs = [
        F.struct(
            F.lit(p["pair_no"]).alias("pair_no"),
            *[F.lit(p[f]).alias(f) for f in ("pair_id", "dataset_id", "key_name", "column_name", "value_type")],
            F.col("__ord").alias("ord"),
            F.coalesce(F.col(p["key_name"]), F.lit("")).alias("k"),
            F.col(hashed.get(p["column_name"], p["column_name"])).cast("double").alias("v"),
        )
        for p in catalog
    ]
    if not structs:
        kinds = "pair_no int, pair_id string, dataset_id string, key_name string, column_name string, value_type string, ord long, k string, v double"
        return df.sparkSession.createDataFrame([], kinds)
    return rows.select(F.inline(F.array(*structs))).filter("v is not null")


def pair_of(df: DataFrame, pair_id: str, key, value, order) -> DataFrame:
    """One column pair (pair_id, ord, k, v) from expressions; ids may be cast to string to serve as keys."""
    return df.select(
        F.lit(pair_id).alias("pair_id"), order.cast("long").alias("ord"),
        F.coalesce(key.cast("string"), F.lit("")).alias("k"), value.cast("double").alias("v"),
    ).filter("v is not null")


def key_sets(df: DataFrame, dataset_id: str) -> DataFrame:
    """(dataset_id, key_name, k): the distinct values of every string column, made in one pass and one shuffle."""
    structs = [F.struct(F.lit(dataset_id).alias("dataset_id"), F.lit(c).alias("key_name"), F.coalesce(F.col(c), F.lit("")).alias("k")) for c in key_columns(df)]
    if not structs:
        return df.sparkSession.createDataFrame([], "dataset_id string, key_name string, k string")
    return df.select(F.inline(F.array(*structs))).distinct()
