"""The trie of conversations by their turns, from vertical bitmaps.

Conversations are dealt in ascending id into shards of a bounded number of turns. In a shard every (position, turn) has
the bitset of the conversations that have this turn there. A node is a bitset too: from the root, which has all bits,
children are the intersections of their parent's bitset with the postings of the next position, depth first; the count
of its bits is a node's members, the lowest bit its smallest one, and those that end at its depth are its end list.

Shards' nodes meet by a digest of their turns. What sums over subtrees is worked out in the shards once more: each node
counts in the shard that has its smallest member only, and whatever lies below a node in a shard has that node above it
in the same shard; so a node's sum is that of its shards' sums, in as many rounds for deep conversations as for short ones.
Texts stay where they are: a turn travels as a digest, its words as a number.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quartzite.llm.common import begin_task, give_back, partitions, sha256, written

#: Conversations whose first turns come from the first of each BLOCK ids: crc32 of the id, modulo SHARED, of them.
BLOCK, SHARED = 20, 4
#: Turns of a shard (a block of ids is never cut), of a range that a task reads, and rows of an Arrow batch.
SHARD, RANGE, ROWS = 4_096, 262_144, 8_192
ROOT = bytes(16)

_NODES = "shard bigint, key binary, parent binary, depth bigint, words bigint, n bigint, low bigint, ends string"
_SUMS = "key binary, n_leaves bigint, saved_tokens bigint, conv_id bigint, depth bigint, parent_conv_id bigint, n_convs bigint, n_children bigint"


def hashed_turns(conversations: DataFrame) -> DataFrame:
    """Rows (block, conv_id, turn, digest, words): what the trie needs to know of a turn. Null roles and texts are empty; rows without a conv_id are no conversation's."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    return conversations.where("conv_id is not null").select(
        (F.col("conv_id") - F.col("conv_id") % BLOCK).alias("block"), F.col("conv_id").cast("bigint").alias("conv_id"), "turn",
        F.unhex(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256)).alias("digest"), F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("bigint").alias("words"),
    )


class VerticalIndex:
    """One shard: conversations in ascending order of ids, and for each position and turn the bitset of those that have it there."""

    def __init__(self, conversations: list[tuple[int, list[tuple[bytes, int]]]]):
        self.ids = [c for c, _ in conversations]
        self.turns = [t for _, t in conversations]
        self.postings: dict[tuple[int, bytes], int] = {}
        self.ends: dict[int, int] = {}
        for k, turns in enumerate(self.turns):
            bit = 1 << k
            for at in enumerate(t for t, _ in turns):
                self.postings[at] = self.postings.get(at, 0) | bit
            self.ends[len(turns)] = self.ends.get(len(turns), 0) | bit

    def members(self, bits: int) -> list[int]:
        return [self.ids[k] for k, b in enumerate(reversed(f"{bits:b}")) if b == "1"]

    def nodes(self) -> Iterator[tuple]:
        """(key, parent's key, depth, words of the last turn, members, smallest member, those that end here), depth first."""
        stack = [((1 << len(self.ids)) - 1, 0, ROOT, None, 0)]
        while stack:
            bits, depth, key, parent, words = stack.pop()
            ended = bits & self.ends.get(depth, 0)
            lowest = (bits & -bits).bit_length() - 1
            yield key, parent, depth, words, bits.bit_count(), self.ids[lowest], self.members(ended) if ended else []
            left = bits & ~ended
            while left:
                turn, n = self.turns[(left & -left).bit_length() - 1][depth]
                child = left & self.postings[depth, turn]
                left &= ~child
                stack.append((child, depth + 1, hashlib.sha256(key + turn).digest()[:16], key, n))


def _grafted(block: int, conversations: list[tuple[int, list]], shared: int) -> Iterator[tuple[int, list]]:
    """The conversations of a block of ids, their first turns being those of the block's first id."""
    top = next((turns for c, turns in conversations if c == block), [])
    for c, turns in conversations:
        h = zlib.crc32(str(c).encode()) % shared if shared else 0
        yield c, top[:h] + turns[h:]


def _shards(batches: Iterator[pa.RecordBatch], shared: int, size: int) -> Iterator[tuple[int, list]]:
    """(number, conversations) of shards, from rows sorted by block, id and turn."""
    first, block, shard, own, n = None, None, [], [], 0
    for batch in batches:
        for b, c, turn, words in zip(*(batch.column(x).to_pylist() for x in ("block", "conv_id", "digest", "words")), strict=True):
            if b != block:
                shard += _grafted(block, own, shared)
                if n >= size:
                    yield first, shard
                    first, shard, n = None, [], 0
                first, block, own = b if first is None else first, b, []
            if not own or own[-1][0] != c:
                own.append((c, []))
            own[-1][1].append((turn, words))
            n += 1
    shard += _grafted(block, own, shared)
    if shard:
        yield first, shard


def shard_nodes(turns: DataFrame, shared: int = SHARED, size: int = SHARD) -> DataFrame:
    """Each shard's trie, a row for each node: its key and parent's, depth, words of the last turn, members, smallest member, and the ids that end there, joined by commas."""
    tasks = max(partitions(turns.sparkSession), -(-turns.count() // RANGE))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin_task()
        schema = pa.schema([("shard", pa.int64()), ("key", pa.binary()), ("parent", pa.binary()), *((x, pa.int64()) for x in ("depth", "words", "n", "low")), ("ends", pa.string())])
        rows = []
        for shard, conversations in _shards(batches, shared, size):
            for *node, ends in VerticalIndex(conversations).nodes():
                rows.append((shard, *node, ",".join(map(str, ends)) or None))
                if len(rows) >= ROWS:
                    yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
                    rows = []
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
        give_back()

    return turns.repartitionByRange(tasks, "block").sortWithinPartitions("block", "conv_id", F.col("turn").asc_nulls_first(), "digest").mapInArrow(run, _NODES)


def _subtrees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums over subtrees within shards, from rows sorted by shard and descending depth; a shard's own nodes with their facts."""
    begin_task()
    names = ("shard", "key", "parent", "depth", "words", "conv_id", "n_convs", "n_children", "owner")
    schema = pa.schema([("key", pa.binary()), *((x, pa.int64()) for x in ("n_leaves", "saved_tokens", "conv_id", "depth", "parent_conv_id", "n_convs", "n_children"))])

    def summed(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
        sums = {r[1]: [0, 0, r[5]] for r in rows}
        out = []
        for shard, key, parent, depth, words, conv_id, n_convs, n_children, owner in rows:
            own = sums[key]
            if owner == shard:
                own[0] += not n_children
                own[1] += (n_convs - 1) * words
            above = sums.get(parent)
            if above:
                above[0] += own[0]
                above[1] += own[1]
            out.append((key, own[0], own[1], *((conv_id, depth, above and above[2], n_convs, n_children) if owner == shard else (None,) * 5)))
        for k in range(0, len(out), ROWS):
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*out[k : k + ROWS], strict=True), schema, strict=True)], schema=schema)

    rows = []
    for batch in batches:
        for r in zip(*(batch.column(x).to_pylist() for x in names), strict=True):
            if rows and r[0] != rows[-1][0]:
                yield from summed(rows)
                rows = []
            rows.append(r)
    yield from summed(rows)
    give_back()


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, SHA-256 of its shards' end lists one after the other), from rows sorted by key and shard; a list is never held whole."""
    begin_task()
    key, state, done = None, None, []

    def flushed() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([k for k, _ in done], pa.binary()), pa.array([d for _, d in done], pa.string())], ["key", "ends_sha256"])

    for batch in batches:
        for k, ends in zip(batch.column("key").to_pylist(), batch.column("ends").to_pylist(), strict=True):
            if k != key:
                if state:
                    done.append((key, state.hexdigest()))
                key, state = k, hashlib.sha256()
            else:
                state.update(b",")
            state.update(ends.encode())
        if len(done) >= ROWS:
            yield flushed()
            done = []
    if state:
        done.append((key, state.hexdigest()))
    yield flushed()
    give_back()


def conversation_trie(conversations: DataFrame, shared: int = SHARED, size: int = SHARD) -> DataFrame:
    """A row for each distinct sequence of first turns: conv_id (its smallest member; with depth it names the node), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    Turns are ordered by turn, null first, equal ones by the digest of role and text. Repeated rows are turns of their
    own. A conversation has its block's first turns in place of its own; with shared=0 conversations stay as they are.
    Without a conv_id a row belongs to nothing; columns besides the four are ignored. Without conversations there are no
    rows, not even a root. A conversation's turns are held in one task, as digests.
    """
    nodes = written(shard_nodes(hashed_turns(conversations), shared, size), "trie")
    total = nodes.groupBy("key").agg(F.sum("n").alias("n_convs"), F.min("low").alias("conv_id"), F.min("shard").alias("owner"), F.max("parent").alias("_parent"))
    children = total.where("_parent is not null").groupBy(F.col("_parent").alias("key")).agg(F.count(F.lit(1)).alias("n_children"))
    facts = total.drop("_parent").join(children, "key", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)))
    told = nodes.select("shard", "key", "parent", "depth", "words").join(facts, "key")
    sums = told.repartition("shard").sortWithinPartitions("shard", F.desc("depth")).mapInArrow(_subtrees, _SUMS)
    ends = nodes.where("ends is not null").select("key", "shard", "ends").repartition("key").sortWithinPartitions("key", "shard").mapInArrow(_digests, "key binary, ends_sha256 string")
    every = sums.unionByName(ends, allowMissingColumns=True)
    facts = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children")
    out = every.groupBy("key").agg(*(F.max(c).alias(c) for c in facts), F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("saved_tokens"), F.max("ends_sha256").alias("ends_sha256"))
    return out.select(*facts, "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(sha256(b""))).alias("ends_sha256"))


_CRC = "xor(list_reduce([4294967295] || list_transform(range(1, len(s) + 1), lambda k: ascii(s[k])), lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)), 4294967295)"
ORACLE_SQL = rf"""
WITH turns AS (SELECT conv_id, turn, sha256(concat(length(coalesce(role, '')), ':', coalesce(role, ''), coalesce(text, ''))) AS sha, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS words FROM conversations WHERE conv_id IS NOT NULL),
t AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, sha) AS i, sha, words FROM turns),
c AS (SELECT conv_id, n, conv_id - conv_id % {BLOCK} AS top, {_CRC} % {SHARED} AS h FROM (SELECT conv_id, count(*) AS n, CAST(conv_id AS VARCHAR) AS s FROM t GROUP BY conv_id)),
r AS (SELECT c.conv_id, t.i AS d, t.sha, t.words FROM c JOIN t ON t.conv_id = c.top AND t.i <= c.h
    UNION ALL SELECT c.conv_id, t.i - c.h + least(c.h, coalesce(b.n, 0)), t.sha, t.words FROM c JOIN t ON t.conv_id = c.conv_id AND t.i > c.h LEFT JOIN c b ON b.conv_id = c.top),
paths AS (SELECT conv_id, d, words, string_agg(sha, '/') OVER (PARTITION BY conv_id ORDER BY d) AS path, d = max(d) OVER (PARTITION BY conv_id) AS last FROM r
    UNION ALL SELECT conv_id, 0, 0, '', conv_id NOT IN (SELECT conv_id FROM r) FROM c),
nodes AS (SELECT path, d AS depth, any_value(words) AS words, count(*) AS n_convs, min(conv_id) AS conv_id, sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (WHERE last), '')) AS ends_sha256,
    CASE WHEN d > 1 THEN left(path, 65 * (d - 1) - 1) WHEN d = 1 THEN '' END AS above FROM paths GROUP BY path, d),
counted AS (SELECT n.*, (SELECT count(*) FROM nodes m WHERE m.above = n.path AND m.depth = n.depth + 1) AS n_children FROM nodes n),
below AS (SELECT CASE WHEN k > 0 THEN left(path, 65 * k - 1) ELSE '' END AS top, k AS top_depth, CASE WHEN n_children = 0 THEN 1 ELSE 0 END AS leaf, (n_convs - 1) * words AS saved FROM (SELECT *, unnest(range(0, depth + 1)) AS k FROM counted))
SELECT n.conv_id, n.depth, p.conv_id AS parent_conv_id, n.n_convs, n.n_children, CAST(b.n_leaves AS BIGINT) AS n_leaves, CAST(b.saved_tokens AS BIGINT) AS saved_tokens, n.ends_sha256
FROM counted n LEFT JOIN nodes p ON p.path = n.above AND p.depth = n.depth - 1
JOIN (SELECT top, top_depth, sum(leaf) AS n_leaves, sum(saved) AS saved_tokens FROM below GROUP BY top, top_depth) b ON b.top = n.path AND b.top_depth = n.depth
"""
