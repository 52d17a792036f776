"""Token ids as Arrow stream files of equal-length sequences with masks.

A file holds record batches of two fixed-size-list columns, ``ids`` (the
smallest unsigned type that holds the vocabulary) and ``mask`` (bool, false on
the padding of a file's last sequence), so sequence i of a memory-mapped file
is a slice of one buffer: no copy, no decoding. Beside it, ``*.docs.arrow``
says where each document starts. Documents are dealt by ranges of doc_id, a
file for each range, and only one manifest row per file is needed for the
place of a file's first id in the whole.

Defined results: a null or empty text is its end id alone; null doc_ids come
first; repeated doc_ids follow one another in the order of their texts; an
empty table gives no files and no rows; a text of any length is encoded whole;
extra columns are ignored. A file
counts only if its task's manifest row was committed, so a task that runs
again leaves at most a file that nobody reads.
"""

from __future__ import annotations

import uuid
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from edgeloom.llm.encoding import default_tokenizer, encoder
from edgeloom.llm.workers import lean_batches, tidy
from edgeloom.plans.durable import fresh_path, written
from edgeloom.plans.ranking import running_offsets

LENGTH = 2048
SEQUENCES_PER_BATCH = 64


def qualified(spark: SparkSession, path: str) -> str:
    """The folder with its file system's scheme, as pyarrow wants it."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    uri = str(fs.makeQualified(p).toUri().toString())
    return uri.replace("file:/", "file:///", 1) if uri.startswith("file:/") and not uri.startswith("file://") else uri


class SequenceWriter:
    """Cuts a run of ids into sequences and writes them batch by batch."""

    def __init__(self, fs, path: str, length: int, kind: pa.DataType):
        self.length, self.kind = length, kind
        self.schema = pa.schema([("ids", pa.list_(kind, length)), ("mask", pa.list_(pa.bool_(), length))])
        self.sink = fs.open_output_stream(path)
        self.writer = pa.ipc.new_file(self.sink, self.schema)
        self.held: list[np.ndarray] = []
        self.n_held = 0

    def add(self, ids: np.ndarray) -> None:
        self.held.append(ids)
        self.n_held += len(ids)
        if self.n_held >= self.length * SEQUENCES_PER_BATCH:
            self._flush(last=False)

    def _flush(self, last: bool) -> None:
        flat = np.concatenate(self.held) if self.held else np.zeros(0, np.uint32)
        step = self.length * SEQUENCES_PER_BATCH
        full = len(flat) if last else len(flat) // step * step
        for at in range(0, full, step):
            part = flat[at : min(at + step, full)]
            n = -(-len(part) // self.length) * self.length
            ids = np.zeros(n, self.kind.to_pandas_dtype())
            ids[: len(part)] = part
            mask = pa.array(np.arange(n) < len(part))
            self.writer.write_batch(pa.record_batch([pa.FixedSizeListArray.from_arrays(pa.array(ids), self.length), pa.FixedSizeListArray.from_arrays(mask, self.length)], schema=self.schema))
        rest = flat[full:]
        self.held, self.n_held = ([rest], len(rest)) if len(rest) else ([], 0)

    def close(self) -> None:
        self._flush(last=True)
        self.writer.close()
        self.sink.close()


def write_token_files(docs: DataFrame, tokenizer: str | None = None, end_id: int = 2, length: int = LENGTH) -> DataFrame:
    """Writes the files into the shared folder; a manifest row per file, in doc_id order.

    Columns: part, path, n_docs, n_tokens, first_token (ids in earlier files).
    """
    spark = docs.sparkSession
    lean_batches(spark)
    name = tokenizer or default_tokenizer()
    root = qualified(spark, fresh_path(spark, "tokens"))

    def save(batches):
        fs, folder = pyarrow.fs.FileSystem.from_uri(root)
        fs.create_dir(folder, recursive=True)
        enc = encoder(name)
        kind = pa.uint16() if max(enc.tokenizer.get_vocab_size(), end_id + 1) <= 1 << 16 else pa.uint32()
        part = TaskContext.get().partitionId()
        stem = f"{folder}/part-{part:06d}-{uuid.uuid4().hex}"
        out, index, at = None, None, 0
        for batch in batches:
            if out is None:
                out = SequenceWriter(fs, f"{stem}.arrow", length, kind)
                schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64())])
                sink = fs.open_output_stream(f"{stem}.docs.arrow")
                index, n_docs = pa.ipc.new_file(sink, schema), 0
            starts, sizes = [], []
            for text in batch["text"].to_pylist():
                ids = np.append(enc.ids(text), np.uint32(end_id))
                out.add(ids)
                starts.append(at)
                sizes.append(len(ids))
                at += len(ids)
            index.write_batch(pa.record_batch([batch["doc_id"].cast(pa.int64()), pa.array(starts, pa.int64()), pa.array(sizes, pa.int64())], schema=schema))
            n_docs += batch.num_rows
        if out is not None:
            out.close()
            index.close()
            sink.close()
            tidy()
            yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "path": [stem.rpartition("/")[2]], "n_docs": pa.array([n_docs], pa.int64()), "n_tokens": pa.array([at], pa.int64())})

    ordered = docs.select("doc_id", "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    files = written(ordered.mapInArrow(save, "part int, path string, n_docs long, n_tokens long"), "manifest")
    return running_offsets(files, [], "part", "n_tokens", "first_token").withColumn("root", F.lit(root))


def open_sequences(root: str, stem: str) -> tuple[pa.ipc.RecordBatchFileReader, pa.ipc.RecordBatchFileReader]:
    """Readers of a file's sequences and of its documents; local files are mapped, not read."""
    fs, folder = pyarrow.fs.FileSystem.from_uri(root)

    def reader(name: str):
        path = f"{folder}/{name}"
        local = isinstance(fs, pyarrow.fs.LocalFileSystem)
        return pa.ipc.open_file(pa.memory_map(path) if local else fs.open_input_file(path))

    return reader(f"{stem}.arrow"), reader(f"{stem}.docs.arrow")


class TokenRun:
    """Ids at any place of a file, by the batch and the slice that hold them."""

    def __init__(self, reader):
        self.reader, self.kept = reader, {}
        self.length = reader.schema.field("ids").type.list_size

    def _batch(self, i: int) -> np.ndarray:
        if i not in self.kept:
            if len(self.kept) > 2:
                self.kept.clear()
            batch = self.reader.get_batch(i)
            ids = batch.column(0).flatten().to_numpy()
            real = len(ids)
            if i == self.reader.num_record_batches - 1:
                real = int(np.count_nonzero(batch.column(1).flatten().to_numpy(zero_copy_only=False)))
            self.kept[i] = ids[:real]
        return self.kept[i]

    def slice(self, start: int, n: int) -> np.ndarray:
        step, out = self.length * SEQUENCES_PER_BATCH, []
        while n > 0:
            got = self._batch(start // step)[start % step : start % step + n]
            if not len(got):
                raise EOFError("ids beyond the end of a file")
            out.append(got)
            start, n = start + len(got), n - len(got)
        return out[0] if len(out) == 1 else np.concatenate(out) if out else np.zeros(0, np.uint16)


def read_documents(manifest: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32, read back from the files."""

    def load(batches):
        for batch in batches:
            for row in batch.to_pylist():
                sequences, docs = open_sequences(row["root"], row["path"])
                run = TokenRun(sequences)
                for i in range(docs.num_record_batches):
                    part = docs.get_batch(i)
                    crc = [zlib.crc32(run.slice(s, n).astype("<u4").tobytes()) for s, n in zip(part["start"].to_pylist(), part["n_tokens"].to_pylist(), strict=True)]
                    start = part["start"].to_numpy() + row["first_token"]
                    yield pa.RecordBatch.from_arrays([part["doc_id"], pa.array(start), part["n_tokens"], pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])
        tidy()

    spread = manifest.select("part", "root", "path", "first_token").repartition(max(1, manifest.count()), "part")
    return spread.mapInArrow(load, "doc_id long, start long, n_tokens long, ids_crc32 long")


def query(spark, sf_dir: str) -> DataFrame:
    return read_documents(write_token_files(spark.read.parquet(f"{sf_dir}/documents.parquet")))
