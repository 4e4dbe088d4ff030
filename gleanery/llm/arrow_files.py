"""Token ids in Arrow files of fixed-size lists.

Documents in ascending doc_id order are one long run of ids. Every range of doc_ids becomes one Arrow IPC file whose
record batches hold fixed-size lists: ``ids`` (as narrow as the vocabulary allows) and ``mask`` (one bit for each id,
unset where the last sequence is filled up). All sequences have the same length, so sequence i of a memory-mapped
file is found by arithmetic and read without a copy. A second small file lists the documents of the first.

Files are written by the tasks to a shared folder, under a name of their own, then moved into place: a task that
runs twice writes the same bytes to the same name.

Defined cases: a null or empty text is the end id alone; an empty table makes no files and gives no rows; repeated
rows are written once for each repetition, those of equal doc_id in the order of a hash of their text; a null doc_id
comes first; extra columns are ignored.
"""

from __future__ import annotations

import io
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import held_to_small_batches, staged, staged_path
from .tokens import encoder

FILE_SCHEMA = "shard long, path string, n_docs long, n_ids long"
DOC_SCHEMA = "doc_id long, start long, n_tokens long, ids_crc32 long"
INDEX = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64())])


def opened(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a URI or plain path, and the path there."""
    return fs.FileSystem.from_uri(path) if ":" in path else (fs.LocalFileSystem(), path)


class SequenceWriter:
    """Streams ids into record batches of ``rows`` sequences of ``length``; holds one batch at a time."""

    def __init__(self, sink: pa.NativeFile, dtype: np.dtype, length: int, rows: int):
        self.length, self.rows = length, rows
        self.schema = pa.schema([("ids", pa.list_(pa.from_numpy_dtype(dtype), length)), ("mask", pa.list_(pa.bool_(), length))])
        self.out = pa.ipc.new_file(sink, self.schema)
        self.buffer = np.zeros(rows * length, dtype)
        self.used = self.total = 0

    def add(self, ids: np.ndarray) -> None:
        self.total += len(ids)
        while len(ids):
            n = min(len(ids), len(self.buffer) - self.used)
            self.buffer[self.used : self.used + n] = ids[:n]
            self.used += n
            ids = ids[n:]
            if self.used == len(self.buffer):
                self.flush()

    def flush(self) -> None:
        if self.used:
            n = -(-self.used // self.length) * self.length
            self.buffer[self.used : n] = 0
            mask = pa.array(np.arange(n) < self.used)
            columns = [pa.FixedSizeListArray.from_arrays(x, self.length) for x in (pa.array(self.buffer[:n]), mask)]
            self.out.write_batch(pa.record_batch(columns, schema=self.schema))
            self.used = 0

    def close(self) -> None:
        self.flush()
        self.out.close()


class SequenceReader:
    """Random access to one file. ``batch_rows`` sequences lie in every record batch but the last."""

    def __init__(self, path: str):
        store, at = opened(path)
        # a local file is mapped; other stores are read through their random-access file
        self.source = pa.memory_map(at) if isinstance(store, fs.LocalFileSystem) else store.open_input_file(at)
        self.file = pa.ipc.open_file(self.source)
        self.length = self.file.schema.field("ids").type.list_size
        self.batch_rows = self.file.get_batch(0).num_rows if self.file.num_record_batches else 0
        self._held: tuple[int, np.ndarray] = (-1, np.zeros(0))

    def sequence(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids (a view of the file) and mask of the i-th sequence."""
        row = self.file.get_batch(i // self.batch_rows).slice(i % self.batch_rows, 1)
        return row.column(0).flatten().to_numpy(), row.column(1).flatten().to_numpy(zero_copy_only=False)

    def run(self, start: int, n: int) -> Iterator[np.ndarray]:
        """The ids from ``start`` on, ``n`` of them, in views of one record batch each."""
        span = self.batch_rows * self.length
        while n:
            k = start // span
            if self._held[0] != k:
                self._held = (k, self.file.get_batch(k).column(0).flatten().to_numpy())
            part = self._held[1][start - k * span :][:n]
            yield part
            start += len(part)
            n -= len(part)


def write_token_files(docs: DataFrame, folder: str, tokenizer_path: str, end_id: int, length: int = 2048, rows: int = 64) -> DataFrame:
    """Writes the files and returns a row for each: shard, path, n_docs, n_ids. The rows are staged, so files are
    complete when this returns."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, context, writer, index = encoder(tokenizer_path), TaskContext.get(), None, []
        store, base = opened(folder)
        shard = context.partitionId()
        final, draft = f"{base}/part-{shard:07d}", f"{base}/.draft-{shard:07d}-{context.taskAttemptId()}"
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if writer is None:
                    store.create_dir(base, recursive=True)
                    sink = store.open_output_stream(f"{draft}.ids")
                    writer = SequenceWriter(sink, enc.dtype, length, rows)
                before = writer.total
                writer.add(enc.ids(text.as_py()))
                writer.add(np.array([end_id], enc.dtype))
                index.append((doc_id, before, writer.total - before))
        if writer is None:
            return
        writer.close()
        sink.close()
        listed = pa.record_batch([pa.array(c, pa.int64()) for c in zip(*index, strict=True)], schema=INDEX)
        held = io.BytesIO()
        with pa.ipc.new_file(held, INDEX) as out:
            out.write_batch(listed)
        with store.open_output_stream(f"{draft}.docs") as out:
            out.write(held.getvalue())
        for kind in ("docs", "ids"):
            store.move(f"{draft}.{kind}", f"{final}.{kind}.arrow")
        where = f"{folder}/part-{shard:07d}"
        yield pa.record_batch([pa.array([x]) for x in (shard, where, len(index), writer.total)], ["shard", "path", "n_docs", "n_ids"])

    picked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    order = ["doc_id", F.xxhash64("text")]
    return staged(picked.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(write, FILE_SCHEMA), "token-files")


def read_token_files(files: DataFrame) -> DataFrame:
    """A row for each document of the files, read from them: doc_id, start among all ids, n_tokens, ids_crc32."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, before in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                store, at = opened(f"{path}.docs.arrow")
                with store.open_input_file(at) as source:
                    index = pa.ipc.open_file(source).read_all()
                reader = SequenceReader(f"{path}.ids.arrow")
                sums = []
                for start, n in zip(index["start"].to_pylist(), index["n_tokens"].to_pylist(), strict=True):
                    crc = 0
                    for part in reader.run(start, n):
                        crc = zlib.crc32(part.astype("<u4").tobytes(), crc)
                    sums.append(crc)
                starts = index["start"].to_numpy() + before
                yield pa.record_batch([index["doc_id"].combine_chunks(), pa.array(starts), index["n_tokens"].combine_chunks(), pa.array(sums, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    # a row for each file, not for each document, meets here
    before = F.coalesce(F.sum("n_ids").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = files.select("path", before.alias("before"))
    tasks = max(files.sparkSession.sparkContext.defaultParallelism, int(files.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return placed.repartition(tasks, "path").mapInArrow(read, DOC_SCHEMA)


def token_file_round_trip(spark: SparkSession, docs: DataFrame, tokenizer_path: str, end_id: int = 1) -> DataFrame:
    """Writes all documents and reads the files back."""
    held_to_small_batches(spark)
    return read_token_files(write_token_files(docs, staged_path(spark, "ids"), tokenizer_path, end_id))
