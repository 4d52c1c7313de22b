"""Token counts of documents from flat token files that have no index: only an end-of-document id stands between them.

Files are scanned in blocks of a fixed size. In a block the separators are found by one vectorised comparison; a
document that runs over a block's edge is stitched by a prefix scan over the blocks of its file: the running count of
separators gives a document's number in its file, the running maximum of separator positions where it began.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quartzite.llm.common import fresh, row_groups, small_batches, written
from quartzite.llm.library_tokens import library_encoder

#: Tokens of a block of the scan.
BLOCK = 1 << 20


def write_flat_files(docs: DataFrame, vocabulary: str, folder: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame, int]:
    """Writes each partition's tokens as one flat file, the separator (the first free id) after each document.

    Returns (files: path, n_tokens), (order: path, number, the document's id) and the separator. Null texts are empty.
    """
    spark = docs.sparkSession
    small_batches(spark)
    folder = folder or fresh(spark, "flat-tokens")
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = library_encoder(vocabulary)
        fs, base = pa.fs.FileSystem.from_uri(folder)
        fs.create_dir(base, recursive=True)
        name, out, number = uuid.uuid4().hex, None, 0
        end = np.array([enc.size], enc.kind).tobytes()
        for part, texts in row_groups(batches, text_col):
            out = out or fs.open_output_stream(f"{base}/{name}.tokens")
            for packed in enc.encode_texts(texts):
                out.write(packed + end)
            n = len(texts)
            yield pa.RecordBatch.from_arrays([pa.array([f"{folder}/{name}.tokens"] * n), pa.array(np.arange(number, number + n)), part.column(id_col)], ["path", "number", id_col])
            number += n
        if out:
            out.close()

    order = written(docs.select(id_col, text_col).mapInArrow(run, f"path string, number bigint, `{id_col}` {kind}"), "flat-order")
    width = library_encoder(vocabulary).kind.itemsize

    def sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            paths = batch.column("path").to_pylist()
            found = [fs.get_file_info(at).size // width for fs, at in map(pa.fs.FileSystem.from_uri, paths)]
            yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(found, pa.int64())], ["path", "n_tokens"])

    files = order.select("path").distinct().mapInArrow(sizes, "path string, n_tokens bigint")
    return files, order, library_encoder(vocabulary).size


def scan_counts(files: DataFrame, separator: int, dtype: str = "<u2", block: int = BLOCK) -> DataFrame:
    """(path, number, n_tokens): the tokens of each document of flat files, its separator not counted.

    files has path and n_tokens (the file's ids, separators included). What follows a file's last separator is an
    unfinished document and isn't counted. A file may hold no separator, or several side by side (empty documents).
    """
    width = np.dtype(dtype).itemsize

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in (r for b in batches for r in b.to_pylist()):
            fs, at = pa.fs.FileSystem.from_uri(row["path"])
            with fs.open_input_file(at) as source:
                ids = np.frombuffer(source.read_at(block * width, row["block"] * block * width), dtype)
            ends = np.flatnonzero(ids == separator) + row["block"] * block
            yield pa.RecordBatch.from_arrays([pa.array([row["path"]]), pa.array([row["block"]], pa.int64()), pa.array([ends], pa.list_(pa.int64()))], ["path", "block", "ends"])

    blocks = files.where("n_tokens > 0").select("path", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("n_tokens") - 1) / block).cast("bigint"))).alias("block"))
    found = blocks.repartition(F.col("path"), F.col("block")).mapInArrow(run, "path string, block bigint, ends array<bigint>")
    earlier = Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    scanned = found.select("path", "ends", F.coalesce(F.sum(F.size("ends")).over(earlier), F.lit(0)).alias("base"), F.coalesce(F.max(F.array_max("ends")).over(earlier), F.lit(-1)).alias("since"))
    began = F.concat(F.array("since"), F.col("ends"))
    each = scanned.select("path", "base", F.posexplode(F.zip_with("ends", F.slice(began, 1, F.size("ends")), lambda e, b: e - b - 1)).alias("k", "n_tokens"))
    return each.select("path", (F.col("base") + F.col("k")).alias("number"), "n_tokens")


def token_counts(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens) for each document: tokenised whole into flat files, then counted by the separator scan alone.

    Null and empty texts count 0; repeated rows and ids each have a row; other columns are ignored.
    """
    files, order, separator = write_flat_files(docs, vocabulary, None, id_col, text_col)
    counts = scan_counts(files, separator, library_encoder(vocabulary).kind.str)
    # both sides have a row for each document: dealt by file and number at any size, never broadcast
    return order.join(counts.hint("merge"), ["path", "number"]).select(id_col, "n_tokens")
