"""Benchmark decontamination: an FM-index for each training shard, searched backward for every benchmark phrase.

A shard is what a task reads of the documents, up to SHARD symbols at a time. Its text is the sequence of word numbers
(a word's number in the benchmark vocabulary); stretches without a run of known words as long as the shortest phrase
can't hold a phrase and are cut out. Ranks in the Burrows-Wheeler transform come from a wavelet tree; every STEP-th
text position is kept, and other rows walk to the next kept one. All phrases, and then all their occurrences, go through
each step together.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quartzite.llm.common import row_groups, sha256, small_batches

WINDOW = 10
SHARD = 2_000_000
STEP = 8
#: Bytes of benchmark text sent to the tasks at once; a larger benchmark goes over the documents in several passes.
BLOCK_BYTES = 64 << 20
#: On UTF-8 bytes with A-Z lowered: digits, a-z and all that is not ASCII.
_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")


def word_list(text: str | None) -> list[bytes]:
    return _WORD.findall(text.encode("utf-8", "surrogatepass").lower()) if text else []


class WaveletTree:
    """Rank and access over a sequence of small numbers, level by level from the highest bit."""

    def __init__(self, seq: np.ndarray, sigma: int):
        self.bits = max(1, int(sigma - 1).bit_length())
        self.ones: list[np.ndarray] = []
        self.zeros: list[int] = []
        for level in range(self.bits - 1, -1, -1):
            bit = (seq >> level) & 1
            self.ones.append(np.concatenate([[0], np.cumsum(bit)]).astype(np.int32))
            self.zeros.append(len(seq) - int(self.ones[-1][-1]))
            seq = np.concatenate([seq[bit == 0], seq[bit == 1]])

    def rank(self, c: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How many of c stand before position at."""
        begin, end = np.zeros_like(at), at
        for k, level in enumerate(range(self.bits - 1, -1, -1)):
            one = (c >> level) & 1 == 1
            for_ones, ones_end, ones_begin = self.zeros[k], self.ones[k][end], self.ones[k][begin]
            end, begin = np.where(one, for_ones + ones_end, end - ones_end), np.where(one, for_ones + ones_begin, begin - ones_begin)
        return end - begin

    def access(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbol at each position, and how many of it stand before."""
        c, begin = np.zeros_like(at), np.zeros_like(at)
        for k in range(self.bits):
            ones = self.ones[k]
            one = ones[at + 1] > ones[at]
            c = c * 2 + one
            at, begin = np.where(one, self.zeros[k] + ones[at], at - ones[at]), np.where(one, self.zeros[k] + ones[begin], begin - ones[begin])
        return c, at - begin


def suffix_array(seq: np.ndarray) -> np.ndarray:
    """By prefix doubling; the last symbol must be smaller than all others and occur once."""
    n, step = len(seq), 1
    rank = np.unique(seq, return_inverse=True)[1].astype(np.int64)
    while True:
        key = rank * (n + 1)
        key[:-step] += rank[step:] + 1
        order = np.argsort(key, kind="stable")
        new = np.concatenate([[0], np.cumsum(key[order][1:] != key[order][:-1])])
        rank = np.empty(n, np.int64)
        rank[order] = new
        if new[-1] == n - 1:
            return order
        step *= 2


class FmIndex:
    """Counts and places of phrases in one sequence of symbols from 1 up (0 is added as its end)."""

    def __init__(self, seq: np.ndarray, sigma: int, step: int = STEP):
        seq = np.concatenate([seq, [0]]).astype(np.int64)
        order = suffix_array(seq)
        self.tree = WaveletTree(seq[order - 1], sigma)
        self.first = np.concatenate([[0], np.cumsum(np.bincount(seq, minlength=sigma))])
        self.kept = order % step == 0
        self.nth, self.place = np.concatenate([[0], np.cumsum(self.kept)]), order[self.kept]
        self.size = len(seq)

    def search(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The range of suffixes that begin with each phrase; phrases are rows of one length."""
        low, high = np.zeros(len(phrases), np.int64), np.full(len(phrases), self.size)
        for k in range(phrases.shape[1] - 1, -1, -1):
            c = phrases[:, k]
            low, high = self.first[c] + self.tree.rank(c, low), self.first[c] + self.tree.rank(c, high)
        return low, np.maximum(low, high)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """The text position of each row, by steps to the next row whose position is kept."""
        out, steps, live = np.empty(len(rows), np.int64), 0, np.arange(len(rows))
        while len(live):
            done = self.kept[rows]
            out[live[done]] = self.place[self.nth[rows[done]]] + steps
            live, rows, steps = live[~done], rows[~done], steps + 1
            c, before = self.tree.access(rows)
            rows = self.first[c] + before
        return out


class Phrases:
    """The windows of benchmark items: distinct phrases by length, and the items of each."""

    def __init__(self, items: list[tuple[str | None, str | None]], window: int):
        cut = [(i, w) for i, w in ((i, word_list(t)) for i, t in items) if w]
        self.number = {w: k + 2 for k, w in enumerate(sorted({x for _, w in cut for x in w}))}  # 0 ends the text, 1 divides
        of: dict[tuple[int, ...], set[str | None]] = {}
        for i, w in cut:
            ids = [self.number[x] for x in w]
            n = min(window, len(ids))
            for k in range(len(ids) - n + 1):
                of.setdefault(tuple(ids[k : k + n]), set()).add(i)
        self.sigma = len(self.number) + 2
        self.rows: dict[int, np.ndarray] = {}
        self.items: dict[int, list[list[str]]] = {}
        for n in sorted({len(p) for p in of}):
            chosen = sorted(p for p in of if len(p) == n)
            self.rows[n], self.items[n] = np.array(chosen, np.int64), [sorted(of[p] - {None}) for p in chosen]
        self.shortest = min(self.rows, default=0)

    def runs(self, words: list[bytes]) -> list[tuple[int, np.ndarray]]:
        """Stretches of known words long enough for some phrase: where each begins, and its numbers."""
        if not self.rows or len(words) < self.shortest:
            return []
        ids = np.fromiter(map(self.number.get, words, repeat(0)), np.int64, len(words))
        edge = np.flatnonzero(np.diff(np.concatenate([[0], ids > 0, [0]]).astype(np.int8)))
        return [(b, ids[b:e]) for b, e in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True) if e - b >= self.shortest]

    def hits(self, docs: list[list[tuple[int, np.ndarray]]]) -> list[tuple[list[tuple[int, int]], set[str]]]:
        """For each document of a shard: its merged word spans [begin, end) and the items that occur."""
        out: list[tuple[list[tuple[int, int]], set[str]]] = [([], set()) for _ in docs]
        parts = [(d, b, ids) for d, runs in enumerate(docs) for b, ids in runs]
        if not parts:
            return out
        size = np.array([len(ids) + 1 for _, _, ids in parts])
        begin = np.concatenate([[0], np.cumsum(size)])
        seq = np.ones(begin[-1], np.int64)
        for at, (_, _, ids) in zip(begin, parts, strict=False):
            seq[at : at + len(ids)] = ids
        index = FmIndex(seq, self.sigma)
        cover = np.zeros(len(seq) + 1, np.int64)
        for n, rows in self.rows.items():
            low, high = index.search(rows)
            count = high - low
            found = np.flatnonzero(count)
            phrase = np.repeat(found, count[found])
            row = np.arange(len(phrase)) - np.repeat(np.cumsum(count[found]) - count[found], count[found]) + low[phrase]
            place = index.locate(row)
            np.add.at(cover, place, 1)
            np.add.at(cover, place + n, -1)
            part = np.searchsorted(begin, place, side="right") - 1
            doc = np.array([d for d, _, _ in parts])[part]
            for code in np.unique(doc * len(rows) + phrase).tolist():
                out[code // len(rows)][1].update(self.items[n][code % len(rows)])
        edge = np.flatnonzero(np.diff(np.concatenate([[0], np.cumsum(cover) > 0, [0]]).astype(np.int8)))
        for b, e in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True):
            p = int(np.searchsorted(begin, b, side="right")) - 1
            d, at, _ = parts[p]
            out[d][0].append((at + b - int(begin[p]), at + e - int(begin[p])))
        return out


def contamination(docs: DataFrame, items: DataFrame, window: int = WINDOW, text_col: str = "text", item_id: str = "item_id", item_text: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """docs with n_words, hit_spans (word positions [begin, end) covered by benchmark windows, merged) and hit_items.

    A window is `window` consecutive words of an item; an item of fewer words is one window, one without words none.
    Words are runs of digits, letters and all that is not ASCII, with A-Z lowered. Null and empty texts have no words and
    no spans; hit_items are distinct item ids as strings, sorted; an
    item without an id makes spans, but no entry there. Columns of docs with the new names are replaced. The
    benchmark goes to the tasks in blocks of block_bytes, one pass over the documents for each block; no shuffle.
    """
    spark = docs.sparkSession
    small_batches(spark)
    chosen = items.select(F.col(item_id).cast("string").alias("i"), F.col(item_text).alias("t"))
    total = chosen.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    blocks = max(1, -(-total // block_bytes))
    new = ("n_words", "hit_spans", "hit_items")
    out = docs.select(*(c for c in docs.columns if c not in new))
    kept = out.columns
    base = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in out.schema.fields)
    schema = f"{base}, n_words bigint, hit_spans array<struct<begin:int,end:int>>, hit_items array<string>"
    spans_type = pa.list_(pa.struct([("begin", pa.int32()), ("end", pa.int32())]))
    for k in range(blocks):
        part = chosen.where(F.pmod(F.xxhash64("i", "t"), F.lit(blocks)) == k) if blocks > 1 else chosen
        sent = spark.sparkContext.broadcast([(r["i"], r["t"]) for r in part.collect()])  # block_bytes at most

        def run(batches: Iterator[pa.RecordBatch], sent=sent, first=k == 0) -> Iterator[pa.RecordBatch]:
            phrases = Phrases(sent.value, window)

            def ready(held: list) -> Iterator[pa.RecordBatch]:
                found = iter(phrases.hits([runs for _, _, each in held for runs in each]))
                for rows, sizes, each in held:
                    old = [([], set())] * len(each) if first else [([(s["begin"], s["end"]) for s in a], set(b)) for a, b in zip(rows.column("hit_spans").to_pylist(), rows.column("hit_items").to_pylist(), strict=True)]
                    got = [(merge(a + x), sorted(b | y)) for (a, b), (x, y) in zip(old, (next(found) for _ in each), strict=True)]
                    cols = [pa.array(sizes, pa.int64()), pa.array([[{"begin": b, "end": e} for b, e in s] for s, _ in got], spans_type), pa.array([i for _, i in got], pa.list_(pa.string()))]
                    yield pa.RecordBatch.from_arrays([*(rows.column(c) for c in kept), *cols], [*kept, *new])

            held, symbols, texts_held = [], 0, 0
            for rows, texts in row_groups(batches, text_col):
                sizes, each = [], []
                for t in texts:
                    words = word_list(t)
                    sizes.append(len(words))
                    each.append(phrases.runs(words))
                held.append((rows, sizes, each))
                symbols += sum(len(ids) + 1 for runs in each for _, ids in runs)
                texts_held += rows.nbytes
                if symbols >= SHARD or texts_held >= 64 << 20:
                    yield from ready(held)
                    held, symbols, texts_held = [], 0, 0
            if held:
                yield from ready(held)

        out = out.mapInArrow(run, schema)
    return out


def merge(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for b, e in sorted(spans):
        if out and b <= out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((b, e))
    return out


def without_hits(found: DataFrame, text_col: str = "text") -> DataFrame:
    """The documents of contamination() with each span cut out of the text, from its first word's first letter to its last word's last."""
    base = found.drop("n_words", "hit_spans", "hit_items")
    columns = base.columns
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in base.schema.fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in row_groups(batches, text_col):
            out = []
            for t, spans in zip(texts, part.column("hit_spans").to_pylist(), strict=True):
                if t and spans:
                    raw = t.encode("utf-8", "surrogatepass")
                    places = [m.span() for m in _WORD.finditer(raw.lower())]
                    at, kept = 0, []
                    for s in spans:
                        kept.append(raw[at : places[s["begin"]][0]])
                        at = places[s["end"] - 1][1]
                    t = b"".join([*kept, raw[at:]]).decode("utf-8", "surrogatepass")
                out.append(t)
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string()) if c == text_col else part.column(c) for c in columns], columns)

    return found.mapInArrow(run, schema)


def report(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Per document: the id, n_words, n_hit, n_items, items_sha256 (of the comma-joined sorted item ids) and contaminated."""
    hit = F.aggregate("hit_spans", F.lit(0).cast("bigint"), lambda a, s: a + s["end"] - s["begin"])
    return found.select(id_col, "n_words", hit.alias("n_hit"), F.size("hit_items").cast("bigint").alias("n_items"), F.sha2(F.concat_ws(",", "hit_items"), 256).alias("items_sha256"), (F.size("hit_spans") > 0).alias("contaminated"))


ORACLE_SQL = """
WITH dw AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
iw AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark),
il AS (SELECT item_id, w, least(10, len(w)) AS n FROM iw WHERE len(w) > 0),
win AS (SELECT DISTINCT item_id, n, array_to_string(w[i : i + n - 1], ' ') AS p FROM (SELECT item_id, w, n, unnest(generate_series(1, len(w) - n + 1)) AS i FROM il)),
lens AS (SELECT DISTINCT n FROM win),
dp AS (SELECT doc_id, n, i, array_to_string(w[i : i + n - 1], ' ') AS p FROM (SELECT doc_id, w, n, unnest(generate_series(1, len(w) - n + 1)) AS i FROM dw, lens WHERE len(w) >= n)),
occ AS (SELECT dp.doc_id, dp.i, dp.n, win.item_id FROM dp JOIN win ON dp.n = win.n AND dp.p = win.p),
hit AS (SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT doc_id, unnest(generate_series(i, i + n - 1)) AS k FROM occ) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS j FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM occ) GROUP BY doc_id)
SELECT dw.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(j, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN hit USING (doc_id) LEFT JOIN its USING (doc_id)
"""
