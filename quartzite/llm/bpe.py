"""BPE encoding and decoding by speculation: a greedy longest match proposes a word's tokens, a vectorised check tests
every adjacent pair, and only the words that fail are merged exactly.

Why the check is enough: a sequence of tokens is what the merges make of its bytes if each token is what the merges
make of its own bytes, and no merge reaches over a boundary between two neighbours. At the time of a merge of rank r,
the left token is, at its right edge, the deepest piece of its right spine that merges of a lower rank have made, and
so for the right token's left edge. So a boundary breaks exactly if some piece a of the right spine and some piece b of
the left spine have a merge (a, b) of a rank before the merge that makes a part of its parent (equal ranks go to the
leftmost, so the left token's own merge wins) and not after the one that makes b part of its parent.
"""

from __future__ import annotations

import heapq
import json
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from quartzite.llm.common import row_groups, sha256, small_batches, stage_state
from quartzite.llm.words import byte_letters, words

#: Words kept with their tokens in a Python worker; when full, the store starts anew.
KNOWN_WORDS = 150_000
#: Longer words (bytes) go to the exact merge at once.
LONGEST = 48
_NEVER = np.int64(1) << 40
_BASE = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xD6E8FEB86659FD93)
_END = np.uint64(0xA5A5A5A55A5A5A5B)


class SpeculativeBpe:
    """Encoder and decoder for a vocabulary file with word ends (`</w>`) over byte letters."""

    def __init__(self, path: str):
        spec = json.load(open(path, encoding="utf-8"))
        model = spec["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.suffix: str = model["end_of_word_suffix"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.cut = re.compile("|".join(map(re.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        self.size = max([*self.vocab.values(), *self.special.values()]) + 1
        self.text = [""] * self.size
        for s, i in [*self.vocab.items(), *self.special.items()]:
            self.text[i] = s
        letters = byte_letters()
        self.inner = np.array([self.vocab[c] for c in letters], np.int64)
        self.last = np.array([self.vocab[c + self.suffix] for c in letters], np.int64)
        pairs = [(self.vocab[a], self.vocab[b], self.vocab[a + b]) for a, b in (m if isinstance(m, list) else m.split(" ") for m in model["merges"])]
        self.merge = {(a, b): (rank, made) for rank, (a, b, made) in reversed([*enumerate(pairs)])}
        self._tables(np.array(pairs, np.int64).reshape(-1, 3), letters)
        self.ids: dict[str, bytes] = {}
        self.shown: dict[str, str] = {}

    def _tables(self, pairs: np.ndarray, letters: list[str]) -> None:
        n = self.size
        code = pairs[:, 0] * n + pairs[:, 1]
        first = np.unique(code, return_index=True)
        self.pair_code, self.pair_rank = first[0], first[1].astype(np.int64)
        left, right, rank = np.full(n, -1), np.full(n, -1), np.full(n, -1)
        made = np.bincount(pairs[:, 2], minlength=n)
        left[pairs[:, 2]], right[pairs[:, 2]], rank[pairs[:, 2]] = pairs[:, 0], pairs[:, 1], np.arange(len(pairs))
        self.right_spine, self.right_until = self._spine(right, rank)
        self.left_spine, self.left_until = self._spine(left, rank)
        # a token may be proposed if the merges make it of its own bytes, and so of its parts
        sound, joined = made <= 1, np.flatnonzero(rank >= 0)
        ok = ~self.conflicts(left[joined], right[joined], rank[joined])
        sound[joined] &= ok
        while True:
            parts = sound[joined] & sound[left[joined]] & sound[right[joined]]
            if (parts == sound[joined]).all():
                break
            sound[joined] = parts
        byte_of = {c: b for b, c in enumerate(letters)}
        rows = []
        for s, i in self.vocab.items():
            ends = s.endswith(self.suffix) and len(s) > len(self.suffix)
            body = s.removesuffix(self.suffix) if ends else s
            if body and sound[i] and all(c in byte_of for c in body) and len(body) <= LONGEST:
                rows.append((i, bytes(byte_of[c] for c in body), ends))
        self.longest = max(len(b) for _, b, _ in rows)
        power = [np.uint64(1)]
        with np.errstate(over="ignore"):
            for _ in range(LONGEST + 1):
                power.append(power[-1] * _BASE)
            self.power = np.array(power, np.uint64)
            keys = np.zeros(len(rows), np.uint64)
            for k, (_, b, ends) in enumerate(rows):
                h = np.uint64(0)
                for x in b:
                    h = h * _BASE + np.uint64(x + 1)
                keys[k] = h * _MIX ^ (_END if ends else np.uint64(0))
        order = np.argsort(keys)
        self.key, self.key_id = keys[order], np.array([r[0] for r in rows], np.int64)[order]
        # the first place of each key prefix in the sorted keys, so that a look-up is one step or two
        self.shift = np.uint64(44)
        self.place = np.searchsorted(self.key >> self.shift, np.arange((1 << 20) + 1, dtype=np.uint64))
        self.reach = int(np.diff(self.place).max())

    def _spine(self, part: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each token: itself, its outer part, that one's outer part ...; and the rank at which each goes into its parent."""
        at, until, ids, ends = np.arange(self.size), np.full(self.size, _NEVER), [], []
        while (at >= 0).any():
            ids.append(at)
            ends.append(until)
            until = np.where(at >= 0, rank[at], -1)
            at = np.where(at >= 0, part[at], -1)
        return np.stack(ids, 1), np.stack(ends, 1)

    def _rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        code = a * self.size + b
        at = np.minimum(np.searchsorted(self.pair_code, code), len(self.pair_code) - 1)
        return np.where(self.pair_code[at] == code, self.pair_rank[at], _NEVER)

    def conflicts(self, a: np.ndarray, b: np.ndarray, before: np.ndarray | None = None) -> np.ndarray:
        """For each pair of neighbours: does a merge (of a rank under `before`) reach over their boundary?"""
        bad = np.zeros(len(a), bool)
        rights, lefts = self.right_spine[a], self.left_spine[b]
        for i in range(rights.shape[1]):
            rows = np.flatnonzero(rights[:, i] >= 0)
            if not len(rows):
                break
            for j in range(lefts.shape[1]):
                rows = rows[lefts[rows, j] >= 0]
                if not len(rows):
                    break
                rank = self._rank(rights[rows, i], lefts[rows, j])
                hit = (rank < self.right_until[a[rows], i]) & (rank <= self.left_until[b[rows], j]) & (rank < _NEVER)
                if before is not None:
                    hit &= rank < before[rows]
                bad[rows[hit]] = True
        return bad

    def merged(self, word: bytes) -> list[int]:
        """The exact merge of one word: the merge of the lowest rank first, of equals the leftmost."""
        ids = [*self.inner[np.frombuffer(word[:-1], np.uint8)].tolist(), int(self.last[word[-1]])]
        after, before = [*range(1, len(ids)), -1], [*range(-1, len(ids) - 1)]
        heap = [(m[0], i, ids[i], ids[i + 1]) for i in range(len(ids) - 1) if (m := self.merge.get((ids[i], ids[i + 1])))]
        heapq.heapify(heap)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = after[i]
            if ids[i] != a or j < 0 or ids[j] != b:
                continue
            ids[i], ids[j] = self.merge[a, b][1], -1
            after[i] = k = after[j]
            if k >= 0:
                before[k] = i
                if m := self.merge.get((ids[i], ids[k])):
                    heapq.heappush(heap, (m[0], i, ids[i], ids[k]))
            if (h := before[i]) >= 0 and (m := self.merge.get((ids[h], ids[i]))):
                heapq.heappush(heap, (m[0], h, ids[h], ids[i]))
        return [x for x in ids if x >= 0]

    def proposed(self, batch: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The greedy longest match of words of LONGEST bytes at most: ids padded by -1, and which words were covered."""
        size = np.array([len(w) for w in batch])
        width = int(size.max())
        flat = np.frombuffer(b"".join(w.ljust(width, b"\0") for w in batch), np.uint8).reshape(len(batch), width).astype(np.uint64)
        with np.errstate(over="ignore"):
            prefix = np.zeros((len(batch), width + 1), np.uint64)
            for k in range(width):
                prefix[:, k + 1] = prefix[:, k] * _BASE + flat[:, k] + np.uint64(1)
            out, at, covered = [], np.zeros(len(batch), np.int64), np.ones(len(batch), bool)
            live = np.arange(len(batch))
            while len(live):
                pick, step = np.full(len(batch), -1), np.zeros(len(batch), np.int64)
                todo = live
                for n in range(min(self.longest, width), 0, -1):
                    rows = todo[at[todo] + n <= size[todo]]
                    if not len(rows):
                        continue
                    begin, end = at[rows], at[rows] + n
                    key = (prefix[rows, end] - prefix[rows, begin] * self.power[n]) * _MIX ^ np.where(end == size[rows], _END, np.uint64(0))
                    place = self.place[(key >> self.shift).astype(np.int64)]
                    found = np.full(len(rows), -1)
                    for d in range(self.reach):
                        spot = np.minimum(place + d, len(self.key) - 1)
                        same = self.key[spot] == key
                        found[same] = self.key_id[spot[same]]
                    hit = found >= 0
                    pick[rows[hit]], step[rows[hit]] = found[hit], n
                    todo = todo[pick[todo] < 0]
                    if not len(todo):
                        break
                covered[todo] = False
                out.append(pick)
                at += step
                live = live[(pick[live] >= 0) & (at[live] < size[live])]
        return np.stack(out, 1), covered

    def encode_words(self, batch: list[bytes]) -> list[list[int]]:
        """The tokens of words, each at least one byte."""
        out: list[list[int] | None] = [None] * len(batch)
        order = sorted((i for i, w in enumerate(batch) if len(w) <= LONGEST), key=lambda i: len(batch[i]))
        for k in range(0, len(order), 8192):
            part = order[k : k + 8192]
            ids, covered = self.proposed([batch[i] for i in part])
            rows, cols = np.nonzero(ids[:, 1:] >= 0)
            pair, of = np.unique(ids[rows, cols] * self.size + ids[rows, cols + 1], return_inverse=True)
            bad = self.conflicts(pair // self.size, pair % self.size)[of]
            covered[rows[bad]] = False
            count = (ids >= 0).sum(1)
            for i, row, n, good in zip(part, ids.tolist(), count.tolist(), covered.tolist(), strict=True):
                if good:
                    out[i] = row[:n]
        return [self.merged(w) if x is None else x for w, x in zip(batch, out, strict=True)]

    def learn(self, new: Iterable[str]) -> None:
        """Stores the tokens of words that aren't known yet."""
        new = [*new]
        for w, ids in zip(new, self.encode_words([w.encode("utf-8", "surrogatepass") for w in new]), strict=True):
            self.ids[w] = np.array(ids, "<u4").tobytes()
            self.shown[w] = " ".join([self.text[i] for i in ids])

    def pieces(self, text: str | None) -> list[str]:
        """Words and special tokens of a text, in order; a special token keeps its angle brackets and its bar, which no word has together."""
        if not text:
            return []
        if self.cut is None or not self.cut.search(text):
            return words(text)
        out, at = [], 0
        for m in self.cut.finditer(text):
            out += [*words(text[at : m.start()]), m[0]]
            at = m.end()
        return out + words(text[at:])

    def encode_texts(self, texts: list[str | None]) -> list[tuple[bytes, str]]:
        """For each text: its ids as little-endian 32-bit numbers, and the decoded text."""
        if len(self.ids) > KNOWN_WORDS:
            self.ids.clear()
            self.shown.clear()
        for s, i in self.special.items():
            self.ids[s], self.shown[s] = np.array([i], "<u4").tobytes(), s
        cut = [self.pieces(t) for t in texts]
        new = set().union(*cut).difference(self.ids)
        if new:
            self.learn(new)
        return [(b"".join(map(self.ids.__getitem__, c)), " ".join(map(self.shown.__getitem__, c))) for c in cut]

    def encode(self, text: str | None) -> list[int]:
        return np.frombuffer(self.encode_texts([text])[0][0], "<u4").tolist()

    def decode(self, ids: Iterable[int]) -> str:
        """The tokens with one space between, as the vocabulary names no decoder; unknown ids are left out."""
        return " ".join(self.text[i] for i in ids if 0 <= i < self.size and self.text[i])


def encoder(path: str) -> SpeculativeBpe:
    """One encoder for each Python worker and stage, with the words it knows."""
    return stage_state(("encoder", path), lambda: SpeculativeBpe(path))


def encode_decode(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", arrays: bool = False) -> DataFrame:
    """One row for each document: its id, n_tokens, ids_sha256 and decoded_sha256; with arrays also ids and decoded.

    Texts are encoded whole. A null or empty text has no tokens (digests of nothing). Repeated rows give repeated rows.
    Other columns are ignored. vocabulary: the path of the vocabulary file, the same on all executors.
    """
    small_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string" + ", ids array<int>, decoded string" * arrays

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(vocabulary)
        for part, texts in row_groups(batches, text_col):
            done = bpe.encode_texts(texts)
            cols = [part.column(id_col), pa.array([len(i) // 4 for i, _ in done], pa.int64()), pa.array([sha256(i) for i, _ in done], pa.string()), pa.array([sha256(d.encode("utf-8", "surrogatepass")) for _, d in done], pa.string())]
            if arrays:
                cols += [pa.array([np.frombuffer(i, "<u4").tolist() for i, _ in done], pa.list_(pa.int32())), pa.array([d for _, d in done], pa.string())]
            yield pa.RecordBatch.from_arrays(cols, [id_col, "n_tokens", "ids_sha256", "decoded_sha256", *["ids", "decoded"] * arrays])

    return docs.select(id_col, text_col).mapInArrow(run, schema)
