"""Keeping sketches up to date from a stream of rows."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from sketchloom.operators.sketch import SketchSpec, build_sketch, merge_sketches, with_order

COLUMNS = ["pair_id", "h", "u", "v", "n", "cut"]


class SketchStream:
    """Sketches of a stream of column pairs (pair_id, ord, k, v), kept as a Parquet table.

    Each micro-batch is sketched and merged into the newest version; the merged table becomes the next version,
    named by the batch, so a batch that fails half way leaves the last one whole. The newest whole version is found
    in the folder, so a new object on the same path goes on where an earlier one ended, and a batch that is
    delivered again is recognized by its number and skipped. The version before the newest stays for readers that
    have it open; older ones are deleted. FIRST and LAST go by ``ord``, whatever batch a row comes in. Only types
    and aggregates that merge are accepted.
    """

    def __init__(self, spark: SparkSession, path: str, spec: SketchSpec):
        if spec.type not in ("KMV", "GKMV"):
            raise NotImplementedError(f"{spec.type} cannot be kept up to date")
        self.spark, self.path, self.spec = spark, path, spec

    def _folder(self):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def _versions(self) -> list[int]:
        """Numbers of the whole versions in the folder, in order."""
        store, path = self._folder()
        if not store.exists(path):
            return []
        found = [(s.getPath(), re.fullmatch(r"v(\d+)", s.getPath().getName())) for s in store.listStatus(path)]
        done = self.spark._jvm.org.apache.hadoop.fs.Path
        return sorted(int(m[1]) for p, m in found if m and store.exists(done(p, "_SUCCESS")))

    @property
    def version(self) -> int:
        """The number of the newest batch that is in the table; -1 before the first."""
        return max(self._versions(), default=-1)

    def _stored(self, version: int) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/v{version}")

    def table(self) -> DataFrame:
        """The newest version."""
        version = self.version
        if version < 0:
            return self.spark.createDataFrame([], "pair_id string, h int, u double, v double, n long, cut boolean")
        return self._stored(version).select(*COLUMNS)

    def add(self, rows: DataFrame, batch: int) -> None:
        versions = self._versions()
        newest = max(versions, default=-1)
        if batch <= newest:
            return
        merged = with_order(build_sketch(rows, self.spec), rows, self.spec)
        if newest >= 0:
            merged = merge_sketches(self._stored(newest), merged, self.spec)
        merged.select(*COLUMNS, *[F.col("at")] * ("at" in merged.columns)).write.mode("overwrite").parquet(f"{self.path}/v{batch}")
        store, path = self._folder()
        for old in versions[:-1]:
            store.delete(self.spark._jvm.org.apache.hadoop.fs.Path(path, f"v{old}"), True)

    def start(self, stream: DataFrame, checkpoint: str, **options: str) -> StreamingQuery:
        """Feed a streaming DataFrame of column pairs into the sketches."""
        writer = stream.writeStream.option("checkpointLocation", checkpoint).options(**options)
        return writer.foreachBatch(lambda rows, batch: self.add(rows, batch)).start()
