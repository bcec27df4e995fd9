"""Token files of a corpus in id order, written and read by the executors."""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sketchloom.llm.bpe import encoder
from sketchloom.llm.shared import mapped, shared_dir, written
from sketchloom.llm.wavelet import TokenFile, encode_file
from sketchloom.llm.wordspan import slices

#: A file is closed at the first end of a document after so many tokens.
FILE_TOKENS = 1 << 22
END_ID = 1
#: Bytes of text that are encoded at once, and pieces that each generation of the encoder's memory holds.
SLICE_BYTES, MEMORY_PIECES = 2 << 20, 1 << 18
MANIFEST = "part long, seq long, path string, n_docs long, n_tokens long"


def write_token_files(docs: DataFrame, folder: str, tokenizer: str, id_col: str = "doc_id", text_col: str = "text",
                      end_id: int = END_ID) -> DataFrame:
    """Write the token ids of ``docs``, in ascending order of id, as wavelet matrix files below ``folder``.

    Returns the manifest, a written table with one row for each file: part, seq (the order of files), path,
    n_docs, n_tokens. Each document's ids are followed by ``end_id``. One shuffle deals texts to ranges of ids;
    a task encodes its range and writes a file whenever FILE_TOKENS are at hand, so memory is bounded by a
    file, or by a longer single document. A file is written under a name of its own and then renamed, so a
    task that runs again, or twice, leaves the same files. ``folder`` must be one that driver and executors share.

    A null id comes first; rows with equal ids are ordered by text; a null or empty text has the end id alone.
    An empty table gives no file.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer, MEMORY_PIECES)
        part, seq, held, held_tokens = TaskContext.get().partitionId(), 0, [], 0

        for batch in batches:
            for piece in slices(batch, "text", SLICE_BYTES):
                ids, counts = enc.encode(piece.column("text"))
                ids = np.insert(ids, np.cumsum(counts), end_id)
                column = piece.column("doc_id")
                known = column.is_valid().to_numpy(zero_copy_only=False)
                held.append((ids, column.fill_null(0).to_numpy(), known, counts + 1))
                held_tokens += len(ids)
                if held_tokens >= FILE_TOKENS:
                    yield _closed(folder, part, seq, held)
                    seq, held, held_tokens = seq + 1, [], 0
        if held:
            yield _closed(folder, part, seq, held)

    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    ordered = src.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    return written(mapped(ordered, run, MANIFEST), "token-manifest")


def _closed(folder: str, part: int, seq: int, held: list) -> pa.RecordBatch:
    ids, doc_ids, known, counts = (np.concatenate(x) for x in zip(*held))
    path = f"{folder}/part-{part:06d}-{seq:06d}.wvm"
    store, name = fs.FileSystem.from_uri(path)
    store.create_dir(name.rpartition("/")[0], recursive=True)
    temporary = f"{name}.{uuid.uuid4().hex}"
    with store.open_output_stream(temporary) as out:
        out.write(encode_file(ids, doc_ids, known, counts))
    store.move(temporary, name)
    row = [part, seq, path, len(counts), len(ids)]
    return pa.RecordBatch.from_arrays([pa.array([x]) for x in row], names=["part", "seq", "path", "n_docs", "n_tokens"])


def read_token_files(manifest: DataFrame) -> DataFrame:
    """One row for each document of the files: doc_id, start, n_tokens and ids_crc32, all taken from the files.

    start is the number of tokens of all documents before it; ids_crc32 is the CRC-32 of its ids as
    little-endian unsigned 32-bit integers. Files are read whole by the executors, each by one task.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, start in zip(batch.column("path").to_pylist(), batch.column("start").to_pylist()):
                store, name = fs.FileSystem.from_uri(path)
                with store.open_input_stream(name) as f:
                    file = TokenFile(f.read())
                ids = file.ids().astype("<u4")
                counts = file.docs["tokens"].astype(np.int64)
                ends = np.cumsum(counts)
                sums = [zlib.crc32(ids[a:b]) for a, b in zip((ends - counts).tolist(), ends.tolist())]
                doc = pa.array(file.docs["id"], mask=file.docs["known"] == 0)
                cols = [doc, pa.array(start + ends - counts), pa.array(counts), pa.array(sums, pa.int64())]
                yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "start", "n_tokens", "ids_crc32"])

    # One row for each file: a running sum over files, not over documents.
    before = Window.orderBy("part", "seq").rowsBetween(Window.unboundedPreceding, -1)
    placed = manifest.withColumn("start", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))
    files = max(1, manifest.count())
    spread = placed.select("path", "start").repartition(files)
    return mapped(spread, run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def new_folder(spark) -> str:
    return f"{shared_dir(spark)}/tokens-{uuid.uuid4().hex}"
