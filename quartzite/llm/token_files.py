"""Token ids as Arrow stream files of fixed-size-list batches: every row is one sequence of the same length with its
masks, and all batches but the last have the same number of rows. So every batch has the same size in the file, and a
reader maps the file and takes sequence k at an offset that follows from k, without an index, parsing or copying."""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quartzite.llm.common import fresh, partitions, row_groups, small_batches, written
from quartzite.llm.library_tokens import library_encoder

#: Tokens of a sequence, and sequences of a batch.
SEQUENCE, BATCH = 1024, 512
#: Bytes of text and documents of a shard, at most about: what a task reads back at a time.
SHARD_BYTES, SHARD_DOCS = 64 << 20, 1_000_000


def sequence_schema(kind: pa.DataType, length: int) -> pa.Schema:
    """ids; mask: is it a token, not padding; ends: is it the end id of a document."""
    return pa.schema([("ids", pa.list_(kind, length)), ("mask", pa.list_(pa.bool_(), length)), ("ends", pa.list_(pa.bool_(), length))])


class SequenceWriter:
    """Packs documents one after the other into sequences; only the last sequence of a file is padded."""

    def __init__(self, sink, kind: np.dtype, length: int):
        self.kind, self.length = kind, length
        self.schema = sequence_schema(pa.from_numpy_dtype(kind), length)
        self.out = pa.ipc.new_stream(sink, self.schema)
        self.ids: list[np.ndarray] = []
        self.ends: list[int] = []
        self.held = 0

    def add(self, ids: np.ndarray) -> None:
        self.ids.append(ids)
        self.held += len(ids)
        self.ends.append(self.held - 1)
        if self.held >= self.length * BATCH:
            self._write(self.held // (self.length * BATCH) * self.length * BATCH)

    def _write(self, n: int) -> None:
        flat = np.concatenate(self.ids) if self.ids else np.zeros(0, self.kind)
        size = -(-n // self.length) * self.length
        ids, ends = np.zeros(size, self.kind), np.zeros(size, bool)
        ids[:n] = flat[:n]
        at = np.array(self.ends, np.int64)
        ends[at[at < n]] = True
        for k in range(0, size, self.length * BATCH):
            part = slice(k, min(size, k + self.length * BATCH))
            real = np.arange(part.start, part.stop) < n
            cols = [pa.FixedSizeListArray.from_arrays(pa.array(x), self.length) for x in (ids[part], real, ends[part])]
            self.out.write_batch(pa.RecordBatch.from_arrays(cols, schema=self.schema))
        self.ids, self.ends, self.held = [flat[n:]], (at[at >= n] - n).tolist(), self.held - n

    def close(self) -> None:
        if self.held:
            self._write(self.held)
        self.out.close()


def write_token_files(docs: DataFrame, vocabulary: str, folder: str | None = None, end_id: int = 1, length: int = SEQUENCE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Writes the tokens of all documents in ascending id order; returns the manifest (shard, path, docs_path, n_docs, n_tokens, id_type).

    Documents are dealt by range of id, so shard k holds smaller ids than shard k + 1 (repeated ids stay together, by
    text). Each text is encoded whole, a null one as empty, and end_id is appended. A task that runs again writes new
    files; the manifest, written once all tasks are done, names the files that count, so files of lost tasks are never
    read. No documents give an empty manifest.
    """
    spark = docs.sparkSession
    small_batches(spark)
    folder = folder or fresh(spark, "token-files")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, shard = library_encoder(vocabulary), TaskContext.get().partitionId()
        fs, base = pa.fs.FileSystem.from_uri(folder)
        fs.create_dir(base, recursive=True)
        name = f"{shard:06d}-{uuid.uuid4().hex}"
        end = np.array([end_id], enc.kind)
        n_docs = n_tokens = 0
        out = ids_out = None
        for part, texts in row_groups(batches, text_col):
            if out is None:
                sink, ids_sink = fs.open_output_stream(f"{base}/{name}.arrows"), fs.open_output_stream(f"{base}/{name}.docs.arrows")
                out, ids_out = SequenceWriter(sink, enc.kind, length), pa.ipc.new_stream(ids_sink, pa.schema([("doc_id", part.schema.field(id_col).type)]))
            ids_out.write_batch(pa.RecordBatch.from_arrays([part.column(id_col)], ["doc_id"]))
            for packed in enc.encode_texts(texts):
                ids = np.concatenate([np.frombuffer(packed, enc.kind), end])
                out.add(ids)
                n_tokens += len(ids)
            n_docs += len(texts)
        if out is not None:
            for x in (out, sink, ids_out, ids_sink):
                x.close()
            yield pa.RecordBatch.from_pydict({"shard": [shard], "path": [f"{folder}/{name}.arrows"], "docs_path": [f"{folder}/{name}.docs.arrows"], "n_docs": [n_docs], "n_tokens": [n_tokens]}, pa.schema([("shard", pa.int32()), ("path", pa.string()), ("docs_path", pa.string()), ("n_docs", pa.int64()), ("n_tokens", pa.int64())]))

    size = docs.agg(F.sum(F.octet_length(text_col)), F.count(F.lit(1))).first()
    shards = max(partitions(spark), -(-(size[0] or 0) // SHARD_BYTES), -(-size[1] // SHARD_DOCS))
    dealt = docs.select(id_col, text_col).repartitionByRange(shards, id_col).sortWithinPartitions(id_col, text_col)
    made = dealt.mapInArrow(run, "shard int, path string, docs_path string, n_docs bigint, n_tokens bigint")
    return written(made.withColumn("id_type", F.lit(docs.schema[id_col].dataType.simpleString())), "token-manifest")


class SequenceFile:
    """Random access to the sequences of one file. A local file is mapped, so that nothing is copied; of others the batch
    that holds a sequence is read by its range."""

    def __init__(self, path: str):
        fs, at = pa.fs.FileSystem.from_uri(path)
        self.source = pa.memory_map(at) if isinstance(fs, pa.fs.LocalFileSystem) else fs.open_input_file(at)
        self.schema = pa.ipc.read_schema(self.source)
        self.length = self.schema.field("ids").type.list_size
        self.begin, self.held = self.source.tell(), (-1, None)
        body = self.source.size() - self.begin - 8  # eight bytes end the stream
        self.rows = self.step = self.size = 0
        if body > 0:
            first = self._at(self.begin)
            self.rows, self.step = first.num_rows, self.source.tell() - self.begin
            full, rest = divmod(body, self.step)
            self.size = full * self.rows + (self._at(self.begin + full * self.step).num_rows if rest else 0)

    def _at(self, offset: int) -> pa.RecordBatch:
        self.source.seek(offset)
        return pa.ipc.read_record_batch(pa.ipc.read_message(self.source), self.schema)

    def __len__(self) -> int:
        return self.size

    def sequence(self, k: int) -> tuple[np.ndarray, pa.BooleanArray, pa.BooleanArray]:
        """ids, mask and ends of sequence k: views of the file (masks as Arrow arrays, as they are bits)."""
        if not 0 <= k < self.size:
            raise IndexError(k)
        batch, row = divmod(k, self.rows)
        if self.held[0] != batch:
            self.held = batch, self._at(self.begin + batch * self.step)
        ids, mask, ends = (self.held[1].column(c).values.slice(row * self.length, self.length) for c in ("ids", "mask", "ends"))
        return ids.to_numpy(zero_copy_only=True), mask, ends

    def close(self) -> None:
        self.held = (-1, None)
        self.source.close()


def sequences(path: str) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """The batches of one file: views of ids, mask and ends, one row for each sequence."""
    fs, at = pa.fs.FileSystem.from_uri(path)
    with fs.open_input_file(at) as source, pa.ipc.open_stream(source) as reader:
        for batch in reader:
            n = reader.schema.field("ids").type.list_size
            yield tuple(batch.column(c).flatten().to_numpy(zero_copy_only=False).reshape(-1, n) for c in ("ids", "mask", "ends"))


def read_token_files(manifest: DataFrame) -> DataFrame:
    """One row for each document of the files: doc_id, start (ids of all documents before it), n_tokens, ids_crc32, shard."""
    shards, kind = max(1, manifest.count()), manifest.select("id_type").first()
    id_type = kind["id_type"] if kind else "bigint"
    before = F.coalesce(F.sum("n_tokens").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in (r for b in batches for r in b.to_pylist()):
            fs, at = pa.fs.FileSystem.from_uri(row["docs_path"])
            with fs.open_input_file(at) as source, pa.ipc.open_stream(source) as reader:
                names = pa.Table.from_batches([*reader], reader.schema).column("doc_id").combine_chunks()
            sums, sizes, crc, size = [], [], 0, 0
            for ids, mask, ends in sequences(row["path"]):
                flat, last = ids[mask].astype("<u4"), np.flatnonzero(ends[mask])
                at = 0
                for e in (last + 1).tolist():
                    sums.append(zlib.crc32(flat[at:e], crc))
                    sizes.append(size + e - at)
                    at, crc, size = e, 0, 0
                crc, size = zlib.crc32(flat[at:], crc), size + len(flat) - at
            n = np.array(sizes, np.int64)
            start = row["before"] + np.concatenate([[0], np.cumsum(n)[:-1]]).astype(np.int64)
            for k in range(0, len(n), 10_000):
                p = slice(k, k + 10_000)
                yield pa.RecordBatch.from_arrays([names[p], pa.array(start[p]), pa.array(n[p]), pa.array(sums[p], pa.int64()), pa.array([row["shard"]] * len(n[p]), pa.int32())], ["doc_id", "start", "n_tokens", "ids_crc32", "shard"])

    return manifest.withColumn("before", before).repartition(shards).mapInArrow(run, f"doc_id {id_type}, start bigint, n_tokens bigint, ids_crc32 bigint, shard int")
