"""N-gram Jaccard join with prefix filters under several global token orders.

A document's set is its distinct word shingles. Under any one order of all shingles, two sets with |A and B| >= t |A or B|
share at least l of their first |A| - ceil(t |A|) + l shingles, and, of the set whose prefix ends first in the order, no
more of its prefix may be missing in the other's than the similarity leaves room for. Each order gives such a filter. A
pair of documents is a candidate if it passes every one of them, and only candidates are verified by the whole sets.

Orders are: shingles that very many documents have last, all else by a hash that each order has its own. Under the first
order all shingles of more than GROUP documents are last: the most frequent ones as a list that every task has, the others
by a bit at their hash, which every task has too. A shingle that merely shares its bit with one of them is last as well: any
order will do, if it is the same for all documents. Documents with
equal sets are one class from the start. Pairs are rows only where at most GROUP documents have a shingle: there they
are counted under the first order, and what passes is held against the prefixes of the others. A shingle of more documents makes no pairs at all: each
of its documents is tied to one of them, a row for a document. Documents that candidates and ties join to each other are
a unit. A unit's texts meet once, in one task, which holds the filters of all orders against each other, verifies what
passes and is not linked yet, and gives back the links of a spanning forest only.

A unit that is too large for a task is dealt out in blocks, with some of its documents, LEADERS or so, in all of them.
What that leaves apart from the unit's largest component is then compared, block by block, with all of it. Pairs within
one component add nothing, so no link between components is lost, and no step has a row for each pair of a large group.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quartzite.llm.common import components, discard, give_back, row_groups, small_batches, written

#: Largest group of documents with one shingle of which pairs are rows.
GROUP = 32
#: A shingle that more than GROUP and more than one in COMMON documents have goes to the end of every order; so there are at
#: most COMMON times a mean prefix's length of them, about ten megabytes at any size of the corpus. (From COMMON times GROUP
#: documents on others of more than GROUP documents are left; those go to the first order's end by bits.) They are counted in
#: prefixes STRETCH times as long, as what goes to the end makes room for others; where there are such others more goes, and
#: it is DEEP times. What isn't counted ties documents to each other.
COMMON, STRETCH, DEEP = 20_000, 1.25, 2
#: Bits for each shingle that goes last by its bit, and the most bits there are (16 megabytes); with fewer for each, more of the
#: rare shingles go last.
BITS, MOST_BITS = 8, 1 << 27
#: Orders, the first one included.
ORDERS = 3
#: Documents and shingles of a block of a unit, at most about; documents that all blocks of a unit have.
BLOCK_DOCS, BLOCK_SHINGLES, LEADERS = 2_000, 1_000_000, 64
_K = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)]
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: Words of more bytes are digested one by one.
_LONG = 64


def _mix(h: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
        h = (h ^ (h >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
        return h ^ (h >> np.uint64(33))


def _words(raw: bytes, first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Two independent 64-bit hashes (rows) of each word: eight bytes at a time are put in and mixed."""
    eight = np.ndarray((len(raw) + 1,), "<u8", raw + b"\0" * 8, strides=(1,))
    out = np.stack([_mix(size.astype(np.uint64) * k + k) for k in _K[:2]])
    live = np.flatnonzero(size <= _LONG)
    for at in range(0, _LONG, 8):
        live = live[size[live] > at]
        if not len(live):
            break
        left = np.minimum(size[live] - at, 8).astype(np.uint64)
        part = eight[first[live] + at] & (np.uint64(2**64 - 1) >> (np.uint64(64) - left * np.uint64(8)))
        with np.errstate(over="ignore"):
            out[0, live] = _mix((out[0, live] ^ part) * _K[2])
            out[1, live] = _mix((out[1, live] + part) * _K[3] ^ part)
    for k in np.flatnonzero(size > _LONG).tolist():
        out[:, k] = np.frombuffer(hashlib.blake2b(raw[first[k] : first[k] + size[k]], digest_size=16).digest(), np.uint64)
    return out


def shingle_sets(texts: list[str | None], size: int = 3) -> tuple[list[np.ndarray], np.ndarray]:
    """For each text, the sorted 64-bit hashes of its distinct shingles of `size` words; and its set's 128 bits, in a row.

    Words are what stands between ASCII white space, with A-Z lowered. A text of fewer words has one shingle of all of
    them; one without words has none. The second half of the 128 bits comes from hashes that the first knows nothing of.
    """
    raws = [(t or "").encode("utf-8", "surrogatepass").lower() for t in texts]
    begin = np.concatenate([[0], np.cumsum([len(r) + 1 for r in raws])])
    raw = b"\n".join([*raws, b""])
    space = _SPACE[np.frombuffer(raw, np.uint8)]
    edge = np.flatnonzero(np.diff(np.concatenate([[True], space]).astype(np.int8)))
    first, last = edge[::2], edge[1::2]
    word = _words(raw, first, last - first)
    at = np.searchsorted(first, begin)
    count = np.diff(at)
    with np.errstate(over="ignore"):
        h = np.zeros((2, max(0, word.shape[1] - size + 1)), np.uint64)
        for k in range(size if h.shape[1] else 0):
            h = _mix(h * _K[k % 4] + word[:, k : word.shape[1] - size + 1 + k])
    sets, prints = [], np.zeros((len(raws), 2), np.uint64)
    for i, (b, n) in enumerate(zip(at[:-1].tolist(), count.tolist(), strict=True)):
        if n >= size:
            s, where = np.unique(h[0, b : b + n - size + 1], return_index=True)
            more = h[1, b : b + n - size + 1][where]
        elif n:
            with np.errstate(over="ignore"):
                x = np.array([n, n], np.uint64)
                for k in range(n):
                    x = _mix(x * _K[3] + word[:, b + k])
            s, more = x[:1], x[1:]
        else:
            s = more = np.zeros(0, np.uint64)
        sets.append(s)
        prints[i] = _mix(s).sum(dtype=np.uint64), _mix(more).sum(dtype=np.uint64)
    return sets, prints


def shared_least(n: int) -> int:
    """How many shingles prefixes must share: a few in a hundred, in short texts up to eight. Grows with n."""
    return max(n // 32, min(8, -(-n // 4)))


def _shared_least(n: Column) -> Column:
    return F.greatest(F.floor(n / 32), F.least(F.lit(8), F.ceil(n / 4)))


def ranks(tokens: np.ndarray, common: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    """Whether tokens stand in the last part of an order, and their place in their part."""
    late = common[np.minimum(np.searchsorted(common, tokens), len(common) - 1)] == tokens if len(common) else np.zeros(len(tokens), bool)
    with np.errstate(over="ignore"):
        return late, _mix(tokens + np.uint64(order) * _K[0]) if order else tokens


def prefix(tokens: np.ndarray, common: np.ndarray, order: int, percent: int, stretch: float = 1, more: np.ndarray | None = None) -> tuple[np.ndarray, bool, int]:
    """The prefix of a set under an order, with what has its bit in `more` in the last part too; part and place of its last token, as numbers that sort alike."""
    n = len(tokens)
    length = min(n, int(stretch * (n - -(-percent * n // 100) + shared_least(n))))
    if not length:
        return tokens[:0], False, 0
    late, rank = ranks(tokens, common, order)
    if more is not None:
        at = tokens & np.uint64(64 * len(more) - 1)
        late = late | ((more[at >> np.uint64(6)] >> (at & np.uint64(63))) & np.uint64(1)).astype(bool)
    chosen = np.lexsort((rank, late))[:length]
    end = chosen[-1]
    return tokens[chosen], bool(late[end]), int((rank[end : end + 1] ^ np.uint64(1 << 63)).view(np.int64)[0])


def _signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def _columns(orders: list[int]) -> list[str]:
    """What is known of a document's prefix under each order: its tokens, and part and place of the last."""
    return [f"{c}{o}" for o in orders for c in ("tokens", "late", "last")]


def _prefixes(docs: DataFrame, common: np.ndarray, percent: int, size: int, orders: list[int], keep_text: bool = False, more: np.ndarray | None = None) -> DataFrame:
    """id, n, the set's 128 bits f1 and f2, and the prefixes under some orders; the text too if it is to be kept. more: as in prefix(), under all of these orders."""
    sent = docs.sparkSession.sparkContext.broadcast((common, more))
    names, kinds = _columns(orders), [pa.list_(pa.int64()), pa.bool_(), pa.int64()] * len(orders)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in row_groups(batches, "text"):
            sets, prints = shingle_sets(texts, size)
            columns: list[list] = [[] for _ in names]
            for s in sets:
                found = [x for o in orders for x in prefix(s, sent.value[0], o, percent, more=sent.value[1])]
                for column, x in zip(columns, found, strict=True):
                    column.append(_signed(x) if isinstance(x, np.ndarray) else x)
            f = [pa.array(np.ascontiguousarray(_signed(prints)[:, k])) for k in range(2)]
            kept = [part.column("text")] if keep_text else []
            yield pa.RecordBatch.from_arrays([part.column("id"), pa.array([len(s) for s in sets], pa.int64()), *f, *map(pa.array, columns, kinds), *kept], ["id", "n", "f1", "f2", *names, *["text"] * keep_text])

    each = "".join(f", tokens{o} array<bigint>, late{o} boolean, last{o} bigint" for o in orders)
    return docs.mapInArrow(run, f"id bigint, n bigint, f1 bigint, f2 bigint{each}" + ", text string" * keep_text)


def _limit(docs: DataFrame) -> int:
    """Documents of a shingle beyond which it is in the list that every task has."""
    return max(GROUP, docs.count() // COMMON)


def _counts(docs: DataFrame, percent: int, size: int, stretch: float = STRETCH) -> DataFrame:
    """The shingles that more than GROUP documents have in their (longer) prefixes: t, and in how many, c."""
    nothing = np.zeros(0, np.uint64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, texts in row_groups(batches, "text"):
            chosen = [_signed(prefix(s, nothing, 0, percent, stretch)[0]) for s in shingle_sets(texts, size)[0]]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(chosen))], ["t"])

    return docs.select("text").mapInArrow(run, "t bigint").groupBy("t").agg(F.count(F.lit(1)).alias("c")).where(F.col("c") > GROUP)


def _common(docs: DataFrame, percent: int, size: int, counts: DataFrame | None = None) -> np.ndarray:
    """The shingles that go to the end of every order, sorted."""
    found = (_counts(docs, percent, size) if counts is None else counts).where(F.col("c") > _limit(docs))
    return np.sort(found.select("t").toArrow().column("t").to_numpy().astype(np.int64).view(np.uint64))


def _bits(tokens: DataFrame) -> np.ndarray:
    """Words of 64 bits, a power of two of them, where each t has set the bit that its last digits number."""
    n = min(MOST_BITS, 1 << max(6, (BITS * tokens.count() - 1).bit_length()))
    word = F.shiftright(F.col("t").bitwiseAND(n - 1), 6)
    found = tokens.groupBy(word.alias("word")).agg(F.expr("bit_or(shiftleft(1L, CAST(t & 63 AS INT)))").alias("bits")).toArrow()
    out = np.zeros(n // 64, np.uint64)
    out[found.column("word").to_numpy()] = found.column("bits").to_numpy().astype(np.int64).view(np.uint64)
    return out


def _other(*columns: str) -> list[Column]:
    """Columns for the other side of a pair, with a y before."""
    return [F.col(c).alias(f"y{c}") for c in columns]


def _needed(percent: int, p: str, late: str, last: str) -> Column:
    """How many prefix shingles two documents must share at least.

    Of the two, let the one whose prefix ends first in the order have n shingles, p of them in its prefix. Those of the p
    that the other's prefix lacks the other lacks altogether. So p - shared of the n aren't common, and what is common
    must reach the share of both sizes that the similarity asks for.
    """
    first = F.struct(late, last) <= F.struct(f"y{late}", f"y{last}")
    common = F.ceil(percent * (F.col("n") + F.col("yn")) / (100 + percent))
    return F.greatest(_shared_least(F.least("n", "yn")), common - F.when(first, F.col("n") - F.col(p)).otherwise(F.col("yn") - F.col(f"y{p}")))


def _sizes_fit(percent: int) -> Column:
    """Whether two different sets of n and yn shingles can be similar enough at all."""
    alike = F.when(F.col("n") == F.col("yn"), 100 * (F.col("n") - 1) >= percent * (F.col("n") + 1))
    return alike.otherwise(100 * F.least("n", "yn") >= percent * F.greatest("n", "yn"))


class _Side:
    """Sets of documents as ragged arrays of token numbers: doc k has tokens[edge[k] : edge[k + 1]]."""

    def __init__(self, lists: list[np.ndarray]):
        self.size = np.array([len(x) for x in lists], np.int64)
        self.edge = np.concatenate([[0], np.cumsum(self.size)])
        self.tokens = np.concatenate(lists)

    def of(self, k: int) -> np.ndarray:
        return self.tokens[self.edge[k] : self.edge[k + 1]]

    def shared(self, mark: np.ndarray, docs: np.ndarray) -> np.ndarray:
        """How many marked tokens each of docs has; no doc is empty."""
        if len(docs) == len(self.size):
            return np.add.reduceat(mark[self.tokens], self.edge[:-1])
        size = self.size[docs]
        start = np.concatenate([[0], np.cumsum(size)[:-1]])
        return np.add.reduceat(mark[self.tokens[np.repeat(self.edge[docs] - start, size) + np.arange(size.sum())]], start)


def forest(sets: list[np.ndarray], common: np.ndarray, percent: int, asked: np.ndarray, root: np.ndarray) -> list[tuple[int, int]]:
    """Links that join the documents of a block as far as similar pairs do that have one of `asked` in them.

    sets: sorted, none empty. root: documents of one number are joined already. Pairs that are joined aren't compared;
    others must pass the filters of all orders before their whole sets are.
    """
    names, codes = np.unique(np.concatenate(sets), return_inverse=True)
    whole = _Side(np.split(codes, np.cumsum([len(s) for s in sets])[:-1]))
    n, root = whole.size, root.copy()
    least = np.maximum(n // 32, np.minimum(8, -(-n // 4)))
    length = np.minimum(n, n - -(-percent * n // 100) + least)
    sides, ends = [], []
    for o in range(ORDERS):
        late, rank = ranks(names, common, o)
        place = np.empty(len(names), np.int64)
        place[np.lexsort((rank, late))] = np.arange(len(names))
        begins = [np.sort(place[whole.of(k)])[: length[k]] for k in range(len(n))]
        sides.append(_Side(begins))
        ends.append(np.array([b[-1] for b in begins]))
    mark, found = np.zeros(len(names), np.int32), []
    is_asked = np.zeros(len(n), bool)
    is_asked[asked] = True
    for a in asked.tolist():
        alike = 100 * np.minimum(n, n[a]) >= percent * np.maximum(n, n[a])
        docs = np.flatnonzero(alike & (root != root[a]) & ~(is_asked & (np.arange(len(n)) <= a)))
        for side, end in zip(sides, ends, strict=True):
            if not len(docs):
                break
            mark[side.of(a)] = 1
            both = side.shared(mark, docs)
            mark[side.of(a)] = 0
            room = np.where(end[docs] <= end[a], n[docs] - length[docs], n[a] - length[a])
            needed = np.maximum(np.minimum(least[docs], least[a]), -(-percent * (n[docs] + n[a]) // (100 + percent)) - room)
            docs = docs[both >= needed]
        if len(docs):
            mark[whole.of(a)] = 1
            both = whole.shared(mark, docs)
            mark[whole.of(a)] = 0
            for b in docs[100 * both >= percent * (n[a] + n[docs] - both)].tolist():
                if root[a] != root[b]:
                    found.append((a, b))
                    root[root == root[b]] = root[a]
    return found


def _forests(places: DataFrame, docs: DataFrame, common: np.ndarray, percent: int, size: int) -> DataFrame:
    """Links (a, b) within the blocks of places: unit, block, id, n, asked, root (see forest())."""
    cells = max(1, (places.agg(F.sum("n")).first()[0] or 0) // BLOCK_SHINGLES)
    placed = places.withColumn("cell", F.pmod(F.xxhash64("unit", "block"), F.lit(cells)).cast("int"))
    sent = docs.sparkSession.sparkContext.broadcast(common)

    def run(rows: pa.Table) -> pa.Table:
        held: dict[tuple, list] = defaultdict(list)
        for batch in rows.to_batches():
            for part, texts in row_groups(iter([batch]), "text"):
                plain = [part.column(c).to_pylist() for c in ("unit", "block", "id", "asked", "root")]
                for unit, block, i, asked, root, s in zip(*plain, shingle_sets(texts, size)[0], strict=True):
                    if len(s):
                        held[unit, block].append((i, asked, root, s))
        found = []
        for members in held.values():
            if len(members) > 1:
                i, asked, root, sets = zip(*members, strict=True)
                links = forest(list(sets), sent.value, percent, np.flatnonzero(asked), np.unique(root, return_inverse=True)[1])
                found += [(i[a], i[b]) for a, b in links if i[a] != i[b]]
        held.clear()
        give_back()
        return pa.table({"a": pa.array([a for a, _ in found], pa.int64()), "b": pa.array([b for _, b in found], pa.int64())})

    return written(docs.join(placed, "id").groupBy("cell").applyInArrow(run, "a bigint, b bigint"), "links")


def _candidates(classes: DataFrame, docs: DataFrame, common: np.ndarray, percent: int, size: int) -> tuple[DataFrame, DataFrame]:
    """Pairs (a, b) of documents that may be similar and ties between those that have a shingle of a large group; and their texts."""
    tokens = classes.select("id", F.explode("tokens0").alias("t"))
    twice = tokens.groupBy("t").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("t")
    shared = written(tokens.join(twice, "t"), "shared")
    # a document goes on if others have enough of its prefix
    plain = ["n", "p", "late0", "last0"]
    marks = classes.select("id", "n", F.size("tokens0").alias("p"), "late0", "last0").join(shared.groupBy("id").agg(F.count(F.lit(1)).alias("s")), "id")
    marks = marks.where(F.col("s") >= _shared_least(F.ceil(F.col("n") * percent / 100))).select("id", *plain)
    known = written(shared.join(marks, "id"), "rows")
    discard(shared)
    groups = known.groupBy("t").agg(F.count(F.lit(1)).alias("c"), F.min("id").alias("least")).where("c > 1")
    rows = written(known.join(groups, "t"), "grouped")
    discard(known)
    # a pair that shares a shingle of a large group is in one unit by ties; any other shares enough in small groups
    few = rows.where(F.col("c") <= GROUP).select("t", "id", *plain)
    pairs = few.join(few.select("t", *_other("id", *plain)), "t").where((F.col("id") < F.col("yid")) & _sizes_fit(percent))
    pairs = pairs.groupBy("id", "yid").agg(F.count(F.lit(1)).alias("c"), F.min(_needed(percent, "p", "late0", "last0")).alias("needed"))
    pairs = written(pairs.where(F.col("c") >= F.col("needed")).select("id", "yid"), "pairs")
    ties = rows.where((F.col("c") > GROUP) & (F.col("id") > F.col("least"))).select(F.col("least").alias("a"), F.col("id").alias("b")).distinct()
    ties = written(ties, "ties")
    # the filters of the other orders; rows of one id may be of several sets, of which any will do
    ids = pairs.select("id").unionByName(pairs.select(F.col("yid").alias("id"))).unionByName(ties.select(F.col("a").alias("id"))).unionByName(ties.select(F.col("b").alias("id")))
    # the ids grow with the corpus: texts and ids are dealt by id at every size
    texts = docs.join(ids.distinct().hint("merge"), "id")
    texts = written(_prefixes(texts, common, percent, size, [*range(1, ORDERS)], True).where("n > 0"), "texts")
    other = ["n", *_columns([*range(1, ORDERS)])]
    both = pairs.join(texts.select("id", *other), "id").join(texts.select(*_other("id", *other)), "yid").where(_sizes_fit(percent))
    for o in range(1, ORDERS):
        both = both.withColumn(f"p{o}", F.size(f"tokens{o}")).withColumn(f"yp{o}", F.size(f"ytokens{o}"))
        both = both.where(F.size(F.array_intersect(f"tokens{o}", f"ytokens{o}")) >= _needed(percent, f"p{o}", f"late{o}", f"last{o}"))
    return written(both.select(F.col("id").alias("a"), F.col("yid").alias("b")).unionByName(ties).distinct(), "candidates"), texts.select("id", "text")


def _links(classes: DataFrame, docs: DataFrame, common: np.ndarray, percent: int, size: int, block_docs: int) -> DataFrame:
    """Links (a, b) between documents of different sets that join what is similar."""
    candidates, docs = _candidates(classes, docs, common, percent, size)
    units = components(candidates).select("id", F.col("component").alias("unit"))
    members = written(units.join(classes.groupBy("id").agg(F.max("n").alias("n")), "id"), "members")
    blocks = lambda n, docs: F.ceil(F.greatest(F.sum(n) / BLOCK_SHINGLES, F.sum(docs) / block_docs)).cast("int")
    sizes = members.groupBy("unit").agg(blocks(F.col("n"), F.lit(1)).alias("k"), F.count(F.lit(1)).alias("c"))
    members = written(members.join(sizes, "unit"), "blocks")
    one = F.array(F.pmod(F.xxhash64("id"), F.col("k")).cast("int"))
    leads = (F.col("k") > 1) & (F.pmod(F.xxhash64("id", F.lit(1)), F.ceil(F.col("c") / LEADERS)) == 0)
    places = members.select("unit", "id", "n", F.explode(F.when(leads, F.sequence(F.lit(0), F.col("k") - 1)).otherwise(one)).alias("block"), F.lit(True).alias("asked"), F.col("id").alias("root"))
    links = _forests(written(places, "places"), docs, common, percent, size)
    large = members.where("k > 1")
    if large.isEmpty():
        return links
    # of the units in several blocks: what is apart from the largest component is compared with all
    large = written(large.join(components(links), "id", "left").select("unit", "id", "n", "k", F.coalesce("component", "id").alias("root")), "large")
    main = large.groupBy("unit", "root").agg(F.count(F.lit(1)).alias("c")).groupBy("unit").agg(F.max(F.struct("c", "root"))["root"].alias("main"))
    large = large.join(main, "unit").withColumn("asked", F.col("root") != F.col("main"))
    apart = large.groupBy("unit").agg(blocks(F.when(F.col("asked"), F.col("n")).otherwise(0), F.col("asked").cast("int")).alias("j")).where("j > 0")
    large = written(large.join(apart, "unit"), "apart")
    mine = lambda k, salt: F.pmod(F.xxhash64("id", F.lit(salt)), F.col(k)).cast("int")
    every = large.select("unit", "id", "n", "root", F.lit(False).alias("asked"), mine("k", 0).alias("x"), F.explode(F.sequence(F.lit(0), F.col("j") - 1)).alias("y"))
    those = large.where("asked").select("unit", "id", "n", "root", "asked", F.explode(F.sequence(F.lit(0), F.col("k") - 1)).alias("x"), mine("j", 2).alias("y"))
    places = every.unionByName(those).groupBy("unit", F.struct("x", "y").alias("block"), "id", "n", "root").agg(F.max("asked").alias("asked"))
    places = places.withColumn("block", F.col("block.x").cast("bigint") * (1 << 31) + F.col("block.y"))
    return links.unionByName(_forests(written(places, "places"), docs, common, percent, size))


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 90, size: int = 3, block_docs: int = BLOCK_DOCS) -> DataFrame:
    """One row for each row of docs: the id, n_shingles (its set's size) and component_id.

    Two documents link if 100 |A and B| >= percent |A or B| of their sets of `size`-word shingles (64-bit hashes; sets
    are held to be equal by 128 bits). component_id is the smallest id that links reach, its own included. Null and empty
    texts and texts without words have an empty set and link with nothing. Rows of one id are one document as to links,
    each row with its own size. A null id stays by itself with a null component. Ids are whole numbers. Other columns
    don't matter. block_docs: documents of one comparison inside a task.
    """
    spark = docs.sparkSession
    small_batches(spark)
    docs = docs.select(F.col(f"`{id_col}`").cast("bigint").alias("id"), F.col(f"`{text_col}`").alias("text"))
    known = docs.where("id is not null")
    limit = _limit(known)
    counts = _counts(known, percent, size, DEEP if limit > GROUP else STRETCH)
    if limit > GROUP:
        counts = written(counts, "counts")
    common = _common(known, percent, size, counts)
    more = _bits(counts.where(F.col("c") <= limit)) if limit > GROUP else None
    every = written(_prefixes(docs, common, percent, size, [0], more=more), "prefixes")
    if limit > GROUP:
        discard(counts)

    # classes of equal sets; of each, its smallest id goes on
    same = ["n", "f1", "f2"]
    classes = every.where("n > 0 and id is not null").groupBy(*same).agg(F.min("id").alias("id"), F.first(F.struct(*_columns([0]))).alias("x")).select("id", *same, "x.*")
    classes = written(classes, "classes")
    ids = written(every.select("id", *same), "ids")
    discard(every)
    links = _links(classes, known, common, percent, size, block_docs)
    ids = ids.join(classes.select(*same, F.col("id").alias("rep")), same, "left").select("id", "n", F.when(F.col("id").isNotNull(), F.col("rep")).alias("rep"))
    # a class's smallest id stands for it; rows of one id may be in several classes, which then belong together
    more = ids.where("rep is not null").groupBy("id").agg(F.min("rep").alias("low"), F.max("rep").alias("high")).where("low <> high")
    if not more.isEmpty():
        links = links.unionByName(ids.where("rep is not null").select(F.col("id").alias("a"), F.col("rep").alias("b")))
    part = components(links).withColumnRenamed("id", "rep")
    out = ids.join(part, "rep", "left").select("id", "n", F.coalesce("component", "rep", "id").alias("component_id"))
    return out.select(F.col("id").cast(docs.schema["id"].dataType).alias(id_col), F.col("n").alias("n_shingles"), "component_id")


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 90, size: int = 3) -> DataFrame:
    """docs without the documents whose component has a smaller id; null ids stay."""
    found = jaccard_components(docs, id_col, text_col, percent, size)
    gone = written(found.where(F.col("component_id") < F.col(id_col)).select(id_col).distinct(), "gone")
    return docs.join(gone, id_col, "left_anti").select(*docs.columns)


ORACLE_SQL = """
WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, h FROM (
  SELECT doc_id, unnest(CASE WHEN len(w) >= 3 THEN list_transform(generate_series(1, len(w) - 2), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])
    WHEN len(w) > 0 THEN [array_to_string(w, ' ') || ' ' || len(w)] ELSE [] END) AS h FROM w)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM s a JOIN s b ON a.h = b.h AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * i >= 90 * (x.n + y.n - i)),
e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
r(d, c) AS (SELECT doc_id, doc_id FROM documents UNION SELECT e.b, r.c FROM r JOIN e ON e.a = r.d)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, c.c AS component_id
FROM documents d LEFT JOIN n USING (doc_id) JOIN (SELECT d, min(c) AS c FROM r GROUP BY d) c ON c.d = d.doc_id
"""
