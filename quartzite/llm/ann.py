"""Nearest neighbours by inner product with additive quantisation.

A vector's direction is written as a sum of one codeword from each of several full-dimensional codebooks; codebooks are
learned on residuals and refitted together on a bounded sample, then as many more on what those leave; every vector is
encoded by a beam search over all of them.
The index keeps the code and one stored norm that scales the sum back to the vector. A query's table of products with
all codewords scores an entry by as many look-ups as there are codebooks; the best entries are reranked by the exact
product of the original vectors.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
import pyarrow.parquet
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quartzite.llm.common import partitions, written

#: The fit: sampled vectors, codebooks of at most 256 words that are refitted together, further ones, rounds of refitting, width of the beam.
SAMPLE, BOOKS, MORE, WORDS, ROUNDS, BEAM = 8_000, 16, 16, 256, 1, 4
#: Entries that a query reranks, and the numbers of queries and entries scored at a time.
RERANK, QUERIES, ENTRIES = 512, 256, 8_192


class AdditiveQuantiser:
    def __init__(self, sample: np.ndarray, books: int = BOOKS, words: int = WORDS, rounds: int = ROUNDS, beam: int = BEAM, seed: int = 1, more: int = MORE):
        rng = np.random.default_rng(seed)
        self.beam = beam
        words = max(1, min(words, len(sample) // 4 or 1))
        left, found = sample.copy(), []
        for _ in range(books):
            found.append(self._means(left, words, rng))
            left = left - found[-1][self._nearest(left, found[-1])]
        self.books = np.stack(found).astype(np.float32)
        for _ in range(rounds):  # codes by beam search, then all codewords together by least squares
            codes = self.encode(sample)
            n = books * words
            at = codes + np.arange(books) * words
            gram, right = np.zeros(n * n), np.zeros((n, sample.shape[1]))
            for a in range(books):
                np.add.at(right, at[:, a], sample)
                for b in range(books):
                    key, count = np.unique(at[:, a] * n + at[:, b], return_counts=True)
                    gram[key] += count
            gram = gram.reshape(n, n)
            solved = np.linalg.solve(gram + 1e-2 * np.eye(n), right + 1e-2 * self.books.reshape(n, -1))
            self.books = solved.reshape(self.books.shape).astype(np.float32)
        left, found = sample - self.sums(self.encode(sample)), [self.books]
        for _ in range(more):
            found.append(self._means(left, words, rng)[None].astype(np.float32))
            left = left - found[-1][0][self._nearest(left, found[-1][0])]
        self.books = np.concatenate(found)

    @staticmethod
    def _nearest(x: np.ndarray, words: np.ndarray) -> np.ndarray:
        return (x @ words.T - 0.5 * (words**2).sum(1)).argmax(1)

    def _means(self, x: np.ndarray, words: int, rng: np.random.Generator, steps: int = 6) -> np.ndarray:
        centre = x[rng.choice(len(x), words, replace=False)].copy()
        for _ in range(steps):
            near = self._nearest(x, centre)
            count = np.bincount(near, minlength=words)
            total = np.zeros_like(centre)
            np.add.at(total, near, x)
            centre = np.where(count[:, None] > 0, total / np.maximum(count, 1)[:, None], x[rng.integers(0, len(x), words)])
        return centre

    def encode(self, x: np.ndarray, step: int = 512) -> np.ndarray:
        """Codes by beam search: after each codebook the BEAM sums nearest to the vector go on. Each vector alone decides its code."""
        books, words, _ = self.books.shape
        own = (self.books**2).sum(2)
        out = np.empty((len(x), books), np.uint8)
        for k in range(0, len(x), step):
            left = x[k : k + step, None, :]  # what the sums so far leave of each vector
            n = len(left)
            codes, size = np.zeros((n, 1, 0), np.uint8), (left**2).sum(2)
            for m in range(books):
                total = (size[:, :, None] + own[m] - 2 * (left @ self.books[m].T)).reshape(n, -1)
                width = min(self.beam, total.shape[1])
                pick = np.argpartition(total, width - 1, axis=1)[:, :width]
                size = np.take_along_axis(total, pick, 1)
                word = pick % words
                left = np.take_along_axis(left, (pick // words)[:, :, None], 1) - self.books[m][word]
                codes = np.concatenate([np.take_along_axis(codes, (pick // words)[:, :, None], 1), word[:, :, None].astype(np.uint8)], 2)
            out[k : k + step] = codes[np.arange(n), size.argmin(1)]
        return out

    def sums(self, codes: np.ndarray) -> np.ndarray:
        return sum(self.books[m][codes[:, m]] for m in range(len(self.books)))


def _matrix(col: pa.ListArray, kind: type = np.float64) -> np.ndarray:
    flat = col.flatten().to_numpy(zero_copy_only=False).astype(kind)
    return flat.reshape(len(col), -1) if len(col) else np.zeros((0, 0), kind)


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, v): vectors without null, NaN or infinite components, and not zero."""
    odd = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    found = vectors.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{vector_col}`").alias("v")).where("id is not null and v is not null")
    return found.where(~odd & F.exists("v", lambda x: x != 0))


def dimension(found: DataFrame) -> int:
    """The commonest size of v, of equals the smallest; 0 without any."""
    size = found.groupBy(F.size("v").alias("s")).count().orderBy(F.desc("count"), "s").first()
    return size["s"] if size else 0


def build_index(vectors: DataFrame, sample: int = SAMPLE, **options) -> tuple[DataFrame, AdditiveQuantiser | None]:
    """Encodes every row of (id, v): (id, code, norm) as a table in the shared folder, and the quantiser fitted on a sample."""
    dice = F.xxhash64(F.col("id"), F.lit(3))
    rows = vectors.select("id", "v").orderBy(dice, "id").limit(sample).select("v").toArrow().column("v").combine_chunks()
    x = _matrix(rows, np.float32)
    model = AdditiveQuantiser(x / np.linalg.norm(x, axis=1, keepdims=True), **options) if len(x) else None
    sent = vectors.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows or sent.value is None:
                continue
            x = _matrix(batch.column("v"))
            size = np.linalg.norm(x, axis=1)
            unit = (x / size[:, None]).astype(np.float32)
            codes = sent.value.encode(unit)
            made = sent.value.sums(codes)
            norm = size * (unit * made).sum(1) / np.maximum((made * made).sum(1), 1e-12)
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(norm, pa.float32())], ["id", "code", "norm"])

    spread = vectors.select("id", "v").repartition(partitions(vectors.sparkSession))
    return written(spread.mapInArrow(run, "id bigint, code binary, norm float"), "ann-index"), model


def candidates(queries: DataFrame, index: DataFrame, model: AdditiveQuantiser | None, rerank: int = RERANK) -> DataFrame:
    """(query, id) for the `rerank` entries of the index of the largest looked-up score, for each row of queries (id, v).

    Queries are dealt out in blocks; each block reads the index's files once, some entries at a time, and keeps its best.
    Equal scores at the edge go to what stands first in the index.
    """
    spark = queries.sparkSession
    files = index.inputFiles()
    sent = spark.sparkContext.broadcast((model, files))  # codebooks, and names of files

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, files = sent.value
        rows = [b for b in batches if b.num_rows]
        if model is None or not rows:
            return
        held = pa.Table.from_batches(rows)
        ids, q = held.column("id").to_numpy(), _matrix(held.column("v").combine_chunks(), np.float32)
        for k in range(0, len(ids), QUERIES):
            part = q[k : k + QUERIES]
            look = np.einsum("qd,mwd->mqw", part, model.books)
            best, names = np.full((len(part), 0), 0, np.float32), np.zeros((len(part), 0), np.int64)
            for path in files:
                fs, at = pa.fs.FileSystem.from_uri(path)
                with fs.open_input_file(at) as source:
                    for batch in pa.parquet.ParquetFile(source).iter_batches(ENTRIES):
                        codes = np.frombuffer(b"".join(batch.column("code").to_pylist()), np.uint8).reshape(batch.num_rows, -1)
                        score = look[0][:, codes[:, 0]]
                        for m in range(1, codes.shape[1]):
                            score += look[m][:, codes[:, m]]
                        score *= batch.column("norm").to_numpy()
                        best = np.concatenate([best, score], 1)
                        names = np.concatenate([names, np.broadcast_to(batch.column("id").to_numpy(), score.shape)], 1)
                        if best.shape[1] > rerank:
                            pick = np.argpartition(-best, rerank - 1, axis=1)[:, :rerank]
                            best, names = np.take_along_axis(best, pick, 1), np.take_along_axis(names, pick, 1)
            n = names.shape[1]
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids[k : k + QUERIES], n)), pa.array(names.ravel())], ["query", "id"])

    blocks = max(1, -(-queries.count() // (2 * QUERIES)))
    return queries.select("id", "v").repartition(blocks).mapInArrow(run, "query bigint, id bigint")


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 20, rerank: int = RERANK, id_col: str = "vec_id", vector_col: str = "embedding", **options) -> DataFrame:
    """query_id, rank, id, score: the k vectors of the largest inner product with each query, its own row left out.

    queries is a part of the rows of vectors. Vectors that are null, zero, of another dimension than most of vectors or
    hold null or non-finite components take no part, as queries or otherwise. Equal vectors are one entry of the index, which
    stands for the k + 1 smallest of their ids (no more of them can be among the k nearest), so that many copies crowd
    nothing out. score is the product of the original vectors in double precision; ties go to the smaller id.
    """
    every = usable(vectors, id_col, vector_col)
    size = dimension(every)
    rows = written(every.where(F.size("v") == size).select(F.col("id").cast("bigint").alias("id"), "v").withColumn("copy", F.row_number().over(Window.partitionBy("v").orderBy("id"))).where(F.col("copy") <= k + 1), "vectors")
    first = rows.where("copy = 1").select("id", "v")
    members = rows.join(first.select(F.col("id").alias("entry"), "v"), "v").select("entry", "id", "v")
    index, model = build_index(first, **options)
    asked = usable(queries, id_col, vector_col).where(F.size("v") == size).select(F.col("id").cast("bigint").alias("id"), "v")
    found = candidates(asked, index, model, rerank)
    product = F.aggregate(F.zip_with("v", "w", lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda a, x: a + x)
    scored = found.withColumnRenamed("id", "entry").join(members, "entry").where("id <> query")
    scored = scored.join(asked.select(F.col("id").alias("query"), F.col("v").alias("w")), "query").select("query", "id", product.alias("score"))
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "id"))
    return scored.withColumn("rank", rank).where(F.col("rank") <= k).select(F.col("query").alias("query_id"), "rank", F.col("id").alias(id_col), "score")
