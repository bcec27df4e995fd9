"""Shared-folder tables, input access and bounded bitmap filters used by the training-data operators."""

from __future__ import annotations

import ctypes
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: 64-bit words of a bitmap filter: 2**17 words are 8.4 million bits and about 2 MB once broadcast.
BITMAP_WORDS = 1 << 17
#: Bytes of an Arrow batch, but for single rows above.
BATCH_BYTES = 2 << 20
#: Temporary folders by application, for sessions within one process.
_local_dirs: dict[str, str] = {}


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Where it is unset, a new temporary one if all of Spark runs in one process, as in tests; else an error, since
    the machines of a cluster would each write to a folder of their own.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        master = spark.conf.get("spark.master", "")
        if master != "local" and not master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = _local_dirs.setdefault(spark.sparkContext.applicationId, "") or tempfile.mkdtemp(prefix="sketchloom-")
        _local_dirs[spark.sparkContext.applicationId] = root
    return f"{root.rstrip('/')}/sketchloom"


def mapped(df: DataFrame, fn, schema) -> DataFrame:
    """``df.mapInArrow`` with batches bounded by bytes, so that rows with very long texts do not pile up.

    Spark counts only rows by default. A bound that the session already has is kept. After each task the worker
    gives the memory that it has freed back to the system, since workers live on through later stages.
    """

    def run(batches):
        try:
            yield from fn(batches)
        finally:
            give_back()

    conf, key = df.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    if not conf.get(key, None):
        conf.set(key, str(BATCH_BYTES))
    return df.mapInArrow(run, schema)


def give_back() -> None:
    """Return freed memory of Arrow and, where the C library can, of the process to the system."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def written(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back.

    This cuts the lineage, so a costly column is computed once, and a lost executor costs nothing that was
    written. The files stay until ``drop_written`` or whoever cleans the shared folder removes them: a result
    is computed when its caller asks for it, so what it reads cannot go before.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_written(df: DataFrame) -> None:
    """Delete the files of a table made by ``written`` once nothing reads it any more."""
    spark = df.sparkSession
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(conf).delete(path, True)


def bitmap_of(keys: DataFrame, key: Column, words: int = BITMAP_WORDS) -> DataFrame:
    """A one-hash Bloom bitmap of ``key`` as rows (bm_word, bm_mask).

    It has at most ``words`` rows whatever the number of keys, so it may be broadcast. A full bitmap lets
    every row pass: it then saves no work but never loses a row.
    """
    at = F.pmod(F.xxhash64(key), F.lit(words * 64))
    return (
        keys.select(F.floor(at / 64).cast("long").alias("bm_word"), (at % 64).cast("int").alias("bm_bit"))
        .groupBy("bm_word")
        .agg(F.expr("bit_or(shiftleft(1L, bm_bit))").alias("bm_mask"))
    )


def with_bitmap_test(df: DataFrame, bitmap: DataFrame, key: Column, name: str, words: int = BITMAP_WORDS) -> DataFrame:
    """Add boolean ``name``: false only if ``key`` is surely not in ``bitmap``."""
    at = F.pmod(F.xxhash64(key), F.lit(words * 64))
    probe = df.withColumns({"__sl_at": F.floor(at / 64).cast("long"), "__sl_pos": (at % 64).cast("int")})
    known = bitmap.select(F.col("bm_word").alias("__sl_word"), F.col("bm_mask").alias("__sl_mask"))
    joined = probe.join(F.broadcast(known), F.col("__sl_at") == F.col("__sl_word"), "left")
    hit = F.coalesce(F.getbit(F.col("__sl_mask"), F.col("__sl_pos")) == 1, F.lit(False))
    return joined.withColumn(name, hit).drop("__sl_at", "__sl_pos", "__sl_word", "__sl_mask")


def text_key(text: Column) -> Column:
    """A hash that tells apart the texts of one id; a null text counts as empty."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


def without_rows(docs: DataFrame, id_col: str, text_col: str, gone: DataFrame) -> DataFrame:
    """``docs`` without the rows whose id and ``text_key`` are a row of ``gone``; all columns kept, null ids too.

    Rows that a bitmap of the ids rules out pass at once; only the few others are shuffled to meet the ids.
    """
    gone = gone.toDF("__sl_gone", "__sl_key").filter("__sl_gone is not null")
    tested = with_bitmap_test(docs, bitmap_of(gone, F.col("__sl_gone")), F.col(id_col), "__sl_hit")
    same = (F.col(id_col) == F.col("__sl_gone")) & (text_key(F.col(text_col)) == F.col("__sl_key"))
    maybe = tested.filter("__sl_hit").join(gone, same, "left_anti")
    return tested.filter("not __sl_hit").unionByName(maybe).select(*docs.columns)
