"""Suffix-array dedup: removes every byte that lies in a WINDOW-byte string which a document of a smaller id has too.

A suffix array of the whole corpus by column-wise construction would take as many rounds as the longest document has
bytes, each over all suffixes so far. So the corpus is first cut by content into a collection of short strings, and the
collections are small and independent:

1. Of the anchors (24 bytes each) in a window, the one with the smallest hash stands for it. Equal windows have the
   same anchor. Neighbouring windows with one anchor make a string of at most 64 windows. A document shares a window
   only if it shares an anchor, so each chunk of documents sends its distinct anchors, and gets back those of them that
   occur in a second document.
2. The distinct strings of such anchors, with the smallest and largest id of their documents in the chunk, go to the
   anchor's bucket. There the strings whose anchor has more than one string make a collection; its Burrows-Wheeler
   transform and common prefixes, built column by column, put equal windows side by side whatever string they are in,
   and each window gets the smallest id. (A string that is its anchor's only one has its windows to itself: its own
   smallest id is theirs.)
3. Each chunk gets the ids back for its strings and cuts its documents.

A chunk sends an anchor or a string once, however often its documents have it, so a passage that a third of all
documents hold costs each bucket one row for each chunk. Chunks are hash buckets of the id, of about CHUNK bytes; the
documents are dealt to them once and that exchange serves all three steps. A chunk sends a row to each bucket that it has
something for: as many as there are buckets, and never more than it has anchors. Strings are told apart, and found again,
by 64-bit hashes among those of one chunk only; in a bucket they are compared byte by byte.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quartzite.llm.collection_bwt import smallest_owner
from quartzite.llm.common import begin_task, give_back, partitions, sha256, shared_dir

WINDOW, ANCHOR, RUN = 50, 24, 64
#: Bytes of text in a chunk, about; and of what is hashed at a time.
CHUNK, PART = 10_000_000, 500_000
#: Bits of an anchor's hash that are told within its bucket (a clash only makes more strings candidates), and strings of a collection, about.
TOLD, COLLECTION = 36, 4_096
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_NONE = np.iinfo(np.int64).max


def _mixed(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(29))
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    return h


def _anchors(raw: bytes) -> np.ndarray:
    """The hash of the ANCHOR bytes from each place on."""
    with np.errstate(over="ignore"):
        one, power, size = np.frombuffer(raw, np.uint8).astype(np.uint64) + np.uint64(1), _BASE, 1
        h = one
        for bit in bin(ANCHOR)[3:]:  # hashes of twice the length, and of one byte more, up to the anchor's
            h, power, size = h[:-size] * power + h[size:], power * power, size * 2
            if bit == "1":
                h, power, size = h[:-1] * _BASE + one[size:], power * _BASE, size + 1
        return _mixed(h)


def comparable(strings: list[bytes], anchor: np.ndarray, window: int) -> np.ndarray:
    """Which strings may share a window with another of the same anchor.

    Equal windows agree in the anchor and in the window - ANCHOR bytes beside it, so in half of those on its left or on
    its right. A string that shares neither half with another, at none of the places where it holds its anchor, has its
    windows to itself.
    """
    raw = b"".join(strings)
    size = np.array([len(s) for s in strings], np.int64)
    begin = np.concatenate([[0], np.cumsum(size)])
    half = (window - ANCHOR) // 2
    if len(raw) < ANCHOR or half < 1:
        return np.ones(len(strings), bool)
    h = _anchors(raw)
    of = np.repeat(np.arange(len(strings)), size)[: len(h)]
    at = np.flatnonzero((h == anchor[of]) & (np.arange(len(h)) + ANCHOR <= begin[of + 1]))
    keep = np.bincount(of[at], minlength=len(strings)) == 0
    who, hashes = of[at], PrefixHash(raw)
    for ok, start in ((at - half >= begin[who], at - half), (at + ANCHOR + half <= begin[who + 1], at + ANCHOR)):
        with np.errstate(over="ignore"):
            key = hashes.of(start[ok], np.full(int(ok.sum()), half)) ^ (anchor[who[ok]] * _BASE)
        # of a key's places the strings ascend, so those of two strings are side by side somewhere
        order = np.argsort(key, kind="stable")
        key, string = key[order], who[ok][order]
        edge = np.flatnonzero(np.diff(key, prepend=~key[:1]) != 0)
        end = np.append(edge[1:], len(key))[: len(edge)]
        keep[string[np.repeat(string[edge] != string[end - 1], end - edge)]] = True
    return keep


def runs_of(raw: bytes, begin: np.ndarray, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of windows with one anchor in documents laid end to end (begin: where each begins, and the end of all).

    Gives of each run its first window's place, its number of windows (RUN at most), and its anchor's hash.
    """
    n = len(raw)
    none = np.zeros(0, np.int64)
    if n < window:
        return none, none, none.astype(np.uint64)
    h = _anchors(raw)
    width, step = window - ANCHOR + 1, 1
    while step * 2 <= width:
        h = np.minimum(h[:-step], h[step:])
        step *= 2
    if width > step:
        h = np.minimum(h[: len(h) - (width - step)], h[width - step :])
    edge = np.ones(len(h), bool)
    np.not_equal(h[1:], h[:-1], out=edge[1:])
    valid = np.zeros(len(h) + 1, np.int8)  # windows that don't cross a document's end
    long = np.diff(begin) >= window
    np.add.at(valid, begin[:-1][long], 1)
    np.add.at(valid, begin[1:][long] - window + 1, -1)
    valid = np.cumsum(valid[:-1], dtype=np.int8).astype(bool)
    edge[1:] |= valid[1:] != valid[:-1]
    edge[begin[:-1][begin[:-1] < len(h)]] = True
    at = np.flatnonzero(edge)
    count = np.diff(np.append(at, len(h)))
    ok = valid[at]
    at, count = at[ok], count[ok]
    if len(count) and count.max() > RUN:
        parts = -(-count // RUN)
        k = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
        at, count = np.repeat(at, parts) + k * RUN, np.minimum(np.repeat(count, parts) - k * RUN, RUN)
    return at, count, h[at]


_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _tables(n: int) -> list[np.ndarray]:
    """Powers of the base and of its inverse, up to n; kept for the next part, up to a few of them."""
    if len(_powers[0]) <= n:
        size = n if n > 8 * PART else max(n, 2 * PART)
        with np.errstate(over="ignore"):
            made = [np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(size, b)])) for b in (_BASE, _INVERSE)]
        if size > 8 * PART:
            return made
        _powers[:] = made
    return _powers


class PrefixHash:
    """Hashes of any stretches of some bytes."""

    def __init__(self, raw: bytes):
        n = len(raw)
        with np.errstate(over="ignore"):
            self.up, down = _tables(n)
            self.sum = np.concatenate([[np.uint64(0)], np.cumsum((np.frombuffer(raw, np.uint8).astype(np.uint64) + np.uint64(1)) * down[:n])])

    def of(self, at: np.ndarray, size: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return _mixed((self.sum[at + size] - self.sum[at]) * self.up[at] ^ size.astype(np.uint64) * np.uint64(0x9FB21C651E98DF25))


def _parts(docs: pa.Table) -> Iterator[tuple[int, list[bytes], np.ndarray, bytes, np.ndarray]]:
    """Documents of a chunk, PART bytes at a time: number of the first, texts, ids, all bytes, where each begins."""
    begin_task()
    text, ids = docs.column("raw"), docs.column("id")
    held, size, first = [], 0, 0
    for k in range(docs.num_rows):
        raw = text[k].as_py() or b""
        held.append(raw)
        size += len(raw)
        if size >= PART or k == docs.num_rows - 1:
            own = np.array([_NONE if x is None else x for x in ids.slice(first, len(held)).to_pylist()], np.int64)
            yield first, held, own, b"".join(held), np.concatenate([[0], np.cumsum([len(x) for x in held])]).astype(np.int64)
            held, size, first = [], 0, k + 1


def _packed(array: np.ndarray) -> bytes:
    """Numbers as bytes, compressed with all lowest bytes together, then all second ones and so on."""
    data = array.view(np.uint8).reshape(len(array), array.itemsize).T.tobytes() if len(array) else b""
    return len(data).to_bytes(8, "little") + pa.compress(data, codec="zstd", asbytes=True)


def _unpacked(data: bytes, kind: type) -> np.ndarray:
    size = int.from_bytes(data[:8], "little")
    raw = pa.decompress(data[8:], size, codec="zstd", asbytes=True)
    width = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(width, size // width).T).view(kind).ravel()


def _each(found: np.ndarray, buckets: int) -> Iterator[tuple[int, np.ndarray]]:
    """Each bucket that has hashes, and which."""
    bucket = (found % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    edge = np.concatenate([[0], np.cumsum(np.bincount(bucket, minlength=buckets))])
    for b in np.flatnonzero(np.diff(edge)).tolist():
        yield b, order[edge[b] : edge[b + 1]]


def _in(sorted_: np.ndarray, x: np.ndarray) -> np.ndarray:
    if not len(sorted_):
        return np.zeros(len(x), bool)
    return sorted_[np.minimum(np.searchsorted(sorted_, x), len(sorted_) - 1)] == x


def _dealt(docs: DataFrame, id_col: str, text_col: str, chunks: int) -> DataFrame:
    """docs in chunks: chunk, id, raw (the text's UTF-8 bytes), and row with all columns but the text."""
    rest = [c for c in docs.columns if c != text_col]
    return docs.select(
        F.pmod(F.xxhash64(F.col(f"`{id_col}`"), F.lit(17)), F.lit(chunks)).cast("int").alias("chunk"),
        F.col(f"`{id_col}`").cast("bigint").alias("id"),
        F.col(f"`{text_col}`").cast("binary").alias("raw"),
        F.struct(*(F.col(f"`{c}`") for c in rest)).alias("row"),
    ).repartition(partitions(docs.sparkSession), "chunk")


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, cut: bool = False, chunk_bytes: int = CHUNK) -> DataFrame:
    """What of each document lies in `window`-byte strings that also start in a document with a smaller id.

    Without cut: the id, n_bytes, n_removed, n_spans (maximal runs of removed bytes), kept_sha256 of what is left. With
    cut: docs with the text cut, where a character goes only if all its bytes do; a null text stays null. Texts are
    UTF-8 bytes, whole; a null one is empty. Nothing is removed from texts shorter than the window, nor between rows of
    one id. A null id counts as larger than all. Ids are whole numbers. Other columns don't matter, whatever their names.
    """
    spark = docs.sparkSession
    total = docs.agg(F.sum(F.octet_length(F.col(f"`{text_col}`")))).first()[0] or 0
    chunks = buckets = max(partitions(spark), -(-total // chunk_bytes))
    dealt = _dealt(docs, id_col, text_col, chunks)
    folder, mask = shared_dir(spark), np.uint64((1 << TOLD) - 1)

    def anchors(table: pa.Table) -> pa.Table:
        """The distinct anchors of a chunk, by bucket; those that two of its documents have, apart."""
        found, owner = [], []
        for _, _, ids, raw, begin in _parts(table):
            at, _, a = runs_of(raw, begin, window)
            own = ids[np.searchsorted(begin, at, side="right") - 1]
            found.append(a)
            owner.append(own)
        a, own = np.concatenate(found), np.concatenate(owner)
        order = np.lexsort((own, a))
        a, own = a[order], own[order]
        twice = np.unique(a[1:][(a[1:] == a[:-1]) & (own[1:] != own[:-1])])
        a = np.unique(a)
        twice = _in(twice, a)
        told = [(b, np.unique(a[o][~twice[o]] // np.uint64(buckets) & mask), np.unique(a[o][twice[o]] // np.uint64(buckets) & mask)) for b, o in _each(a, buckets)]
        rows = [(b, table.column("chunk")[0].as_py(), *(_packed(np.diff(x, prepend=np.uint64(0))) for x in (once, two))) for b, once, two in told]
        return pa.table({k: pa.array([r[i] for r in rows], t) for i, (k, t) in enumerate((("bucket", pa.int32()), ("chunk", pa.int32()), ("once", pa.binary()), ("twice", pa.binary())))})

    def answered(table: pa.Table) -> pa.Table:
        """Which anchors of a bucket occur in two documents: told to each chunk that has them."""
        once, twice = ([np.cumsum(_unpacked(x, np.uint64), dtype=np.uint64) for x in table.column(c).to_pylist()] for c in ("once", "twice"))
        a = np.sort(np.concatenate(once))
        known = np.unique(np.concatenate([a[1:][a[1:] == a[:-1]], *twice]))
        # an anchor that one chunk has in two documents is repeated for a chunk that has it once
        out = [np.unique(np.concatenate([x[_in(known, x)], y])) for x, y in zip(once, twice, strict=True)]
        return pa.table({"chunk": table.column("chunk"), "bucket": table.column("bucket"), "repeated": pa.array([_packed(np.diff(x, prepend=np.uint64(0))) for x in out], pa.binary())})

    def strings(docs: pa.Table, told: pa.Table) -> pa.Table:
        """The distinct strings of a chunk's repeated anchors, by bucket."""
        rows = []
        if docs.num_rows and told.num_rows:
            known = np.unique(np.concatenate([(np.uint64(b) << np.uint64(TOLD)) | np.cumsum(_unpacked(x, np.uint64), dtype=np.uint64) for b, x in zip(told.column("bucket").to_pylist(), told.column("repeated").to_pylist(), strict=True)]))
            keys, hashes, low, high, texts = [], [], [], [], []
            for _, _, ids, raw, begin in _parts(docs):
                at, count, a = runs_of(raw, begin, window)
                take = _in(known, (a % np.uint64(buckets) << np.uint64(TOLD)) | (a // np.uint64(buckets) & mask))
                at, count, a = at[take], count[take], a[take]
                own = ids[np.searchsorted(begin, at, side="right") - 1]
                key, first, group = np.unique(PrefixHash(raw).of(at, count + window - 1), return_index=True, return_inverse=True)
                lo, hi = np.full(len(key), _NONE), np.full(len(key), np.iinfo(np.int64).min)
                np.minimum.at(lo, group, own)
                np.maximum.at(hi, group, own)
                keys.append(key)
                hashes.append(a[first])
                low.append(lo)
                high.append(hi)
                texts += [raw[b : e + window - 1] for b, e in zip(at[first].tolist(), (at + count)[first].tolist(), strict=True)]
            key, first, group = np.unique(np.concatenate(keys), return_index=True, return_inverse=True)
            lo, hi = np.full(len(key), _NONE), np.full(len(key), np.iinfo(np.int64).min)
            np.minimum.at(lo, group, np.concatenate(low))
            np.maximum.at(hi, group, np.concatenate(high))
            a, texts = np.concatenate(hashes)[first], [texts[i] for i in first.tolist()]
            size = np.array([len(t) for t in texts], np.uint8)
            chunk = docs.column("chunk")[0].as_py()
            rows = [(b, chunk, *map(_packed, (a[o], size[o], lo[o], hi[o])), _packed(np.frombuffer(b"".join([texts[i] for i in o.tolist()]), np.uint8))) for b, o in _each(a, buckets)]
        kinds = (("bucket", pa.int32()), ("chunk", pa.int32()), ("anchors", pa.binary()), ("sizes", pa.binary()), ("low", pa.binary()), ("high", pa.binary()), ("texts", pa.binary()))
        return pa.table({k: pa.array([r[i] for r in rows], t) for i, (k, t) in enumerate(kinds)})

    def owners(table: pa.Table) -> pa.Table:
        """The smallest id of each window of a bucket's strings: told to each chunk, for the strings of which it has to cut something."""
        rows = [[_unpacked(x, t) for x, t in zip(r, (np.uint64, np.uint8, np.int64, np.int64), strict=True)] for r in zip(*(table.column(c).to_pylist() for c in ("anchors", "sizes", "low", "high")), strict=True)]
        number: dict[bytes, int] = {}
        of = []
        for (_, size, _, _), all_ in zip(rows, table.column("texts").to_pylist(), strict=True):
            edge, all_ = np.concatenate([[0], np.cumsum(size, dtype=np.int64)]).tolist(), _unpacked(all_, np.uint8).tobytes()
            of.append(np.array([number.setdefault(all_[b:e], len(number)) for b, e in zip(edge[:-1], edge[1:], strict=True)], np.int64))
        every, names = [*number], np.concatenate(of)
        low, anchor = np.full(len(every), _NONE), np.zeros(len(every), np.uint64)
        np.minimum.at(low, names, np.concatenate([r[2] for r in rows]))
        anchor[names] = np.concatenate([r[0] for r in rows])
        _, group, count = np.unique(anchor, return_inverse=True, return_counts=True)
        mixed = np.flatnonzero(count[group] > 1)
        mixed = mixed[comparable([every[i] for i in mixed.tolist()], anchor[mixed], window)]
        mixed = mixed[np.argsort(group[mixed], kind="stable")]
        # anchors share no window, so that a collection may end after any anchor
        ends = np.append(np.flatnonzero(np.diff(group[mixed])) + 1, len(mixed)) if len(mixed) else np.zeros(0, np.int64)
        found: dict[int, np.ndarray] = {}
        at = 0
        for end in ends.tolist():
            if end - at >= COLLECTION or end == len(mixed):
                part = mixed[at:end]
                ids = smallest_owner([every[i] for i in part.tolist()], low[part], window, folder)
                found.update((i, ids(k)) for k, i in enumerate(part.tolist()))
                at = end
        # of each string, stretches of windows that have one smallest id
        begin, end, owner, held = [], [], [], np.zeros(len(every) + 1, np.int64)
        for i, text in enumerate(every):
            if i not in found:
                begin.append(np.zeros(1, np.int64))
                end.append(np.array([len(text) - window + 1]))
                owner.append(low[i : i + 1])
            else:
                ids = found[i]
                edge = np.flatnonzero(np.concatenate([[True], ids[1:] != ids[:-1]]))
                begin.append(edge)
                end.append(np.append(edge[1:], len(ids)))
                owner.append(ids[edge])
            held[i + 1] = len(begin[-1])
        first = np.cumsum(held)
        begin, end, owner = np.concatenate(begin), np.concatenate(end), np.concatenate(owner)
        keys = _keys(every)
        out = []
        for (_, _, _, high), k in zip(rows, of, strict=True):
            n = first[k + 1] - first[k]
            each = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first[k], n)
            cut = owner[each] < np.repeat(high, n)
            out.append([*map(_packed, (np.repeat(keys[k], n)[cut], begin[each][cut].astype(np.uint8), end[each][cut].astype(np.uint8), owner[each][cut]))])
        return pa.table({"chunk": table.column("chunk"), **{c: pa.array([r[i] for r in out], pa.binary()) for i, c in enumerate(("keys", "begin", "end", "owner"))}})

    def applied(docs: pa.Table, told: pa.Table) -> pa.Table:
        if told.num_rows:
            key, begin, end, owner = (np.concatenate([_unpacked(x, t) for x in told.column(c).to_pylist()]) for c, t in (("keys", np.uint64), ("begin", np.uint8), ("end", np.uint8), ("owner", np.int64)))
        else:
            key, begin, end, owner = (np.zeros(0, t) for t in (np.uint64, np.uint8, np.uint8, np.int64))
        order = np.argsort(key, kind="stable")
        key, begin, end, owner = key[order], begin[order].astype(np.int64), end[order].astype(np.int64), owner[order]
        out = []
        for _, texts, ids, raw, edge in _parts(docs):
            at, count, _ = runs_of(raw, edge, window)
            name = PrefixHash(raw).of(at, count + window - 1) if len(at) else np.zeros(0, np.uint64)
            low, high = np.searchsorted(key, name), np.searchsorted(key, name, side="right")
            n = high - low
            run = np.repeat(np.arange(len(at)), n)
            each = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(low, n)
            doc = np.searchsorted(edge, at[run], side="right") - 1
            cut_ = owner[each] < ids[doc]
            cover = np.zeros(len(raw) + 1, np.int32)
            np.add.at(cover, (at[run] + begin[each])[cut_], 1)
            np.add.at(cover, (at[run] + end[each] + window - 1)[cut_], -1)
            gone = np.cumsum(cover[:-1]) > 0
            for k, text in enumerate(texts):
                mine = gone[edge[k] : edge[k + 1]]
                out.append(_spans(mine) if mine.any() else [])
        raws = docs.column("raw").to_pylist()
        if cut:
            kept = [r if r is None else _cut(r, s) for r, s in zip(raws, out, strict=True)]
            row = docs.column("row").combine_chunks()
            cols = {c: row.field(c) for c in rest} | {text_col: pa.array([None if r is None else r.decode("utf-8", "replace") for r in kept], pa.string())}
            return pa.table({c: cols[c] for c in names})
        kept = [_without(r or b"", s) for r, s in zip(raws, out, strict=True)]
        return pa.table({
            id_col: docs.column("row").combine_chunks().field(id_col),
            "n_bytes": pa.array([len(r or b"") for r in raws], pa.int64()),
            "n_removed": pa.array([sum(e - b for b, e in s) for s in out], pa.int64()),
            "n_spans": pa.array([len(s) for s in out], pa.int64()),
            "kept_sha256": pa.array([sha256(k) for k in kept], pa.string()),
        })

    def lean(step):
        """step, after which a worker gives its memory back; what is grouped alone takes one table, what is cogrouped two."""
        if step in (strings, applied):
            return lambda left, right: (step(left, right), give_back())[0]
        return lambda table: (step(table), give_back())[0]

    names = docs.columns
    rest = [c for c in names if c != text_col]
    sent = dealt.groupBy("chunk").applyInArrow(lean(anchors), "bucket int, chunk int, once binary, twice binary")
    told = sent.groupBy("bucket").applyInArrow(lean(answered), "chunk int, bucket int, repeated binary")
    held = dealt.groupBy("chunk").cogroup(told.groupBy("chunk")).applyInArrow(lean(strings), "bucket int, chunk int, anchors binary, sizes binary, low binary, high binary, texts binary")
    owned = held.groupBy("bucket").applyInArrow(lean(owners), "chunk int, keys binary, begin binary, end binary, owner binary")
    if cut:
        schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    else:
        schema = f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string"
    return dealt.groupBy("chunk").cogroup(owned.groupBy("chunk")).applyInArrow(lean(applied), schema)


def _keys(strings: list[bytes]) -> np.ndarray:
    """PrefixHash of whole strings, some at a time."""
    out = []
    for k in range(0, len(strings), 5_000):
        part = strings[k : k + 5_000]
        size = np.array([len(s) for s in part], np.int64)
        out.append(PrefixHash(b"".join(part)).of(np.concatenate([[0], np.cumsum(size)[:-1]]), size))
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def _spans(gone: np.ndarray) -> list[tuple[int, int]]:
    edge = np.flatnonzero(np.diff(np.concatenate([[0], gone, [0]]).astype(np.int8)))
    return [*zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True)]


def _without(raw: bytes, spans: list[tuple[int, int]]) -> bytes:
    at, kept = 0, []
    for b, e in spans:
        kept.append(raw[at:b])
        at = e
    return b"".join([*kept, raw[at:]]) if spans else raw


def _cut(raw: bytes, spans: list[tuple[int, int]]) -> bytes:
    """raw without the characters that lie wholly in spans."""
    whole = []
    for b, e in spans:
        while b < e and raw[b] & 0xC0 == 0x80:
            b += 1
        while e > b and e < len(raw) and raw[e] & 0xC0 == 0x80:
            e -= 1
        if b < e:
            whole.append((b, e))
    return _without(raw, whole)


ORACLE_SQL = """
WITH h AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
w AS (SELECT doc_id, i, substr(x, 2 * i - 1, 100) AS s FROM (SELECT doc_id, x, unnest(generate_series(1, len(x) // 2 - 49)) AS i FROM h WHERE len(x) >= 100)),
m AS (SELECT s, min(doc_id) AS least FROM w GROUP BY s),
r AS (SELECT doc_id, i, CASE WHEN i <= lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 50 THEN 0 ELSE 1 END AS fresh FROM w JOIN m USING (s) WHERE least < doc_id),
p AS (SELECT doc_id, min(i) AS b, max(i) + 50 AS e FROM (SELECT doc_id, i, sum(fresh) OVER (PARTITION BY doc_id ORDER BY i) AS k FROM r) GROUP BY doc_id, k),
q AS (SELECT doc_id, b, e, coalesce(lag(e) OVER (PARTITION BY doc_id ORDER BY b), 1) AS since FROM p),
g AS (SELECT doc_id, sum(e - b) AS gone, count(*) AS spans, max(e) AS last, string_agg(substr(x, 2 * since - 1, 2 * (b - since)), '' ORDER BY b) AS kept FROM q JOIN h USING (doc_id) GROUP BY doc_id)
SELECT doc_id, CAST(len(x) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(gone, 0) AS BIGINT) AS n_removed, CAST(coalesce(spans, 0) AS BIGINT) AS n_spans,
  sha256(unhex(CASE WHEN gone IS NULL THEN x ELSE kept || substr(x, 2 * last - 1) END)) AS kept_sha256
FROM h LEFT JOIN g USING (doc_id)
"""
