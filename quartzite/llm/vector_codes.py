"""Compression of vectors to short codes: a vector is cut into parts, and each part is written as its codebook's nearest entry.

All arithmetic is on whole numbers, floor(scale * x), so codes don't hang on the order of additions. Codebooks begin as
the parts of the vectors of the smallest ids; each round assigns every part of every vector and replaces entries by
floored means. The driver holds codebooks only: parts x entries rows, however many vectors there are.

The nearest entry is found by Orchard's search: each entry has the list of all others by distance; a part stands at an
entry, walks along that entry's list, jumps to the list of the first entry that is nearer, doesn't look at an entry twice,
and stops where the list is further from the entry than twice the part is: what lies beyond can't be nearer, nor as near.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quartzite.llm.common import begin_task, give_back, written

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
#: Components are less than this, so that squared distances of parts of up to 512 components are whole longs.
LARGEST = 1 << 16
#: Vectors that a task holds as numbers at a time, and entries of a list that are looked at in a step.
ROWS, STEP = 4_096, 8


def _squares(d: np.ndarray) -> np.ndarray:
    return np.einsum("...j,...j->...", d, d)


class Orchard:
    """The entries of one codebook (rows of whole numbers) with their lists; `looked` counts the distances that were worked out."""

    def __init__(self, entries: np.ndarray):
        self.entries, n, self.looked = entries, len(entries), 0
        between = np.stack([_squares(entries - e) for e in entries]) if n else np.zeros((0, 0), np.int64)
        self.near = np.argsort(between, axis=1, kind="stable")
        self.gap = np.take_along_axis(between, self.near, 1)
        # beyond a list's end nothing is near
        self.near = np.concatenate([self.near, np.zeros((n, STEP), np.int64)], 1)
        self.gap = np.concatenate([self.gap, np.full((n, STEP), np.iinfo(np.int64).max)], 1)
        self.first = int(between.sum(1).argmin()) if n else 0

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each row of x the nearest entry, of equally near ones the lowest, and its squared distance."""
        m, n = len(x), len(self.entries)
        at = np.full(m, self.first)
        best = _squares(x - self.entries[self.first])
        place, seen = np.zeros(m, np.int64), np.zeros((m, n), bool)
        seen[:, self.first] = True
        self.looked += m
        walking = np.arange(m)
        while len(walking):
            steps = place[walking, None] + np.arange(STEP)
            entry, gap = self.near[at[walking, None], steps], self.gap[at[walking, None], steps]
            # squared: further from the entry than twice the part's distance
            inside = gap <= 4 * best[walking, None]
            row, col = np.nonzero(inside & ~seen[walking[:, None], entry])
            who, which = walking[row], entry[row, col]
            seen[who, which] = True
            self.looked += len(who)
            distance = np.full(entry.shape, np.iinfo(np.int64).max)
            distance[row, col] = _squares(x[who] - self.entries[which])
            low = distance.min(1)
            lowest = np.where(distance == low[:, None], entry, n).min(1)
            nearer = (low < best[walking]) | ((low == best[walking]) & (lowest < at[walking]))
            at[walking[nearer]], best[walking[nearer]] = lowest[nearer], low[nearer]
            place[walking] = np.where(nearer, 0, place[walking] + STEP)
            walking = walking[nearer | inside[:, -1]]
        return at, best


class Codebooks:
    """Codebooks of all parts: entries[part, entry, position]."""

    def __init__(self, entries: np.ndarray, scale: int = SCALE):
        self.entries, self.scale = entries, scale
        self.dimension = entries.shape[0] * entries.shape[2]

    def whole(self, column: pa.Array) -> np.ndarray:
        """A column of vectors as whole numbers, with zeros up to the codebooks' dimension."""
        x = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)
        x = np.floor(self.scale * x).astype(np.int64)
        return np.concatenate([x, np.zeros((len(x), self.dimension - x.shape[1]), np.int64)], 1)

    def searches(self) -> list[Orchard]:
        return [Orchard(e) for e in self.entries]

    def assign(self, x: np.ndarray, searches: list[Orchard]) -> tuple[np.ndarray, np.ndarray]:
        """The entry of each part of each row of x, and the squared distances."""
        found = [s.nearest(u) for s, u in zip(searches, np.split(x, len(self.entries), axis=1), strict=True)]
        return np.stack([f[0] for f in found], 1), np.stack([f[1] for f in found], 1)

    def decode(self, code: str) -> list[float]:
        """The vector that a code of two hex digits for each part stands for: the middles of the entries' cells."""
        at = bytes.fromhex(code)
        return [float((v + 0.5) / self.scale) for part, e in zip(self.entries, at, strict=True) for v in part[e]]

    def sha256(self) -> str:
        return hashlib.sha256(",".join(map(str, self.entries.ravel().tolist())).encode()).hexdigest()


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for k in range(0, batch.num_rows, ROWS):
            yield batch.slice(k, ROWS)


def usable(vectors: DataFrame) -> DataFrame:
    """Rows (vec_id, embedding, label) whose vector isn't null and has neither null nor non-finite components, nor such as whole numbers of this size can't hold.

    Empty vectors, and those of another dimension than the smallest id's, don't take part either.
    """
    fine = vectors.select("vec_id", "embedding", "label").where(F.col("embedding").isNotNull() & (F.size("embedding") > 0) & F.forall("embedding", lambda x: F.coalesce(F.abs(x) < LARGEST, F.lit(False)) & ~F.isnan(x)))
    first = fine.select(F.struct(F.col("vec_id").isNull(), "vec_id", "embedding").alias("r")).agg(F.min("r").getField("embedding").alias("v")).first().v
    return fine.where(F.size("embedding") == len(first)) if first is not None else fine.limit(0)


def fit(kept: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> Codebooks | None:
    """Codebooks after `rounds` rounds over all rows of kept, what usable() gives; None without rows. Fewer rows than entries make fewer entries."""
    if entries > 256:
        raise ValueError("a code has a byte for each part")
    head = [r.embedding for r in kept.select("vec_id", "embedding").orderBy(F.col("vec_id").asc_nulls_last(), "embedding").limit(entries).collect()]
    if not head:
        return None
    width = -(-len(head[0]) // parts)
    x = np.zeros((len(head), parts * width), np.int64)
    x[:, : len(head[0])] = np.floor(scale * np.array(head, np.float64).reshape(len(head), -1))
    books = Codebooks(x.reshape(len(head), parts, width).swapaxes(0, 1).copy(), scale)
    for _ in range(rounds):
        found = kept.select("embedding").mapInArrow(_sums(books), "part int, entry int, n bigint, sums array<bigint>").groupBy("part", "entry")
        means = books.entries.copy()
        for r in found.agg(F.sum("n").alias("n"), F.array(*(F.sum(F.element_at("sums", i + 1)) for i in range(width))).alias("sums")).collect():
            means[r.part, r.entry] = [s // r.n for s in r.sums]
        books = Codebooks(means, scale)
    return books


def _sums(books: Codebooks):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin_task()
        searches, (parts, n, width) = books.searches(), books.entries.shape
        count, total = np.zeros((parts, n), np.int64), np.zeros((parts, n, width), np.int64)
        for batch in _slices(batches):
            x = books.whole(batch.column("embedding"))
            at, _ = books.assign(x, searches)
            for p, u in enumerate(np.split(x, parts, axis=1)):
                count[p] += np.bincount(at[:, p], minlength=n)
                np.add.at(total[p], at[:, p], u)
        part, entry = np.nonzero(count)
        sums = pa.ListArray.from_arrays(pa.array(np.arange(len(part) + 1) * width, pa.int32()), pa.array(total[part, entry].ravel()))
        yield pa.RecordBatch.from_arrays([pa.array(part.astype(np.int32)), pa.array(entry.astype(np.int32)), pa.array(count[part, entry]), sums], ["part", "entry", "n", "sums"])
        give_back()

    return run


def encode(kept: DataFrame, books: Codebooks) -> DataFrame:
    """Rows (vec_id, label, code, error) for what usable() gives: two hex digits for each part, and the sum of squared distances."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin_task()
        searches = books.searches()
        for batch in _slices(batches):
            at, distance = books.assign(books.whole(batch.column("embedding")), searches)
            codes = [row.tobytes().hex() for row in at.astype(np.uint8)]
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), pa.array(codes, pa.string()), pa.array(distance.sum(1))], ["vec_id", "label", "code", "error"])
        give_back()

    return kept.select("vec_id", "label", "embedding").mapInArrow(run, f"vec_id bigint, label {kept.schema['label'].dataType.simpleString()}, code string, error bigint")


def vector_codes(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> DataFrame:
    """For each usable vector its code and error, its label's error (null labels are one), and the digest of the codebooks.

    Null vectors, null and non-finite components: the row goes. Repeated rows are rows of their own; of equal ids the
    smaller vector comes first. A null id comes last. A dimension that the parts don't divide is filled up with zeros.
    Columns besides vec_id, embedding and label are ignored. No usable vector, no rows.
    """
    spark = vectors.sparkSession
    kept = usable(vectors)
    books = fit(kept, parts, entries, rounds, scale)
    if books is None:
        return spark.createDataFrame([], "vec_id bigint, code string, error bigint, label_error bigint, codebooks_sha256 string")
    codes = written(encode(kept, books), "codes")
    by_label = codes.groupBy(F.col("label").alias("_label")).agg(F.sum("error").alias("label_error"))
    return codes.join(by_label, F.col("label").eqNullSafe(F.col("_label"))).select("vec_id", "code", "error", "label_error", F.lit(books.sha256()).alias("codebooks_sha256"))


def _sql(rounds: int = ROUNDS) -> str:
    steps = []
    for k in range(rounds + 1):
        steps.append(f"""assigned{k} AS (SELECT x.vec_id, x.label, x.p, any_value(x.u) AS u, min({{'d': list_sum([(a.x - a.y) * (a.x - a.y) FOR a IN list_transform(range(1, len(x.u) + 1), lambda i: {{'x': x.u[i], 'y': b.u[i]}})]), 'e': b.e}}) AS best
            FROM pieces x JOIN book{k} b ON x.p = b.p GROUP BY x.vec_id, x.label, x.p)""")
        if k < rounds:
            steps.append(f"""sums{k} AS (SELECT p, best.e AS e, i, sum(u[i]) AS s, count(*) AS n FROM assigned{k}, range(1, 65) AS r(i) WHERE i <= len(u) GROUP BY p, best.e, i),
            means{k} AS (SELECT p, e, list(CAST(floor(CAST(s AS DOUBLE) / n) AS BIGINT) ORDER BY i) AS u FROM sums{k} GROUP BY p, e),
            book{k + 1} AS (SELECT b.p, b.e, coalesce(m.u, b.u) AS u FROM book{k} b LEFT JOIN means{k} m ON b.p = m.p AND b.e = m.e)""")
    return f"""
WITH kept AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
pieces AS (SELECT vec_id, label, p, v[p * (len(v) // {PARTS}) + 1 : (p + 1) * (len(v) // {PARTS})] AS u FROM kept, range({PARTS}) AS r(p)),
book0 AS (SELECT p, row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS e, u FROM pieces QUALIFY row_number() OVER (PARTITION BY p ORDER BY vec_id) <= {ENTRIES}),
{", ".join(steps)},
codes AS (SELECT vec_id, label, string_agg(printf('%02x', best.e), '' ORDER BY p) AS code, CAST(sum(best.d) AS BIGINT) AS error FROM assigned{rounds} GROUP BY vec_id, label)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
    (SELECT sha256(string_agg(array_to_string(u, ','), ',' ORDER BY p, e)) FROM book{rounds}) AS codebooks_sha256 FROM codes
"""


ORACLE_SQL = _sql()
