import hashlib
import random
import re
import zlib

from pyspark.sql import functions as F

from quartzite.llm import prefix_trie as pt

SCHEMA = "conv_id long, turn long, role string, text string"


def digest(role, text):
    return hashlib.sha256(f"{len(role)}:{role}{text}".encode()).hexdigest()


def plain(rows, shared=4):
    """The contract with a dict of prefixes."""
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            own.setdefault(c, []).append((turn is not None, turn or 0, digest(role or "", text or ""), role or "", text or ""))
    own = {c: [(r, t) for *_, r, t in sorted(v)] for c, v in own.items()}
    built = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % shared if shared else 0
        top = c - (c % 20 if c >= 0 else -(-c % 20))
        built[c] = own.get(top, [])[:h] + turns[h:]
    members = {}
    for c, turns in built.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
    out = {p: [min(m), len(p), min(members[p[:-1]]) if p else None, len(m), 0, 0, 0] for p, m in members.items()}
    for p in out:
        if p:
            out[p[:-1]][4] += 1
    for p in out:
        saved = (out[p][3] - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", p[-1][1])) if p else 0
        for d in range(len(p) + 1):
            out[p[:d]][5] += out[p][4] == 0
            out[p[:d]][6] += saved
    for p, m in members.items():
        out[p].append(hashlib.sha256(",".join(str(c) for c in sorted(m) if len(built[c]) == len(p)).encode()).hexdigest())
    return sorted(map(tuple, out.values()), key=str)


def got(df):
    return sorted((tuple(r[c] for c in ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")) for r in df.collect()), key=str)


def table():
    rng = random.Random(2)
    say = ["yes", "no", "  a b\tc ", "", None, "é ü x"]
    rows = [(c, t if rng.random() > 0.1 else None, rng.choice(["user", "assistant", None]), rng.choice(say)) for c in range(-45, 400) if c % 7 for t in range(rng.randint(1, 5))]
    rows += [(c, t, "user", f"copy {t}") for c in range(1000, 1100) for t in range(6)]  # one conversation many times
    rows += [(2000, t, "user", "one two") for t in range(300)] + [(2001, t, "user", "one two") for t in range(290)]
    rows += rows[:60] + [(None, 1, "user", "nobody's"), (3007, 0, "user", "cut away"), (3019, 0, "user", "cut away")]  # repeats; turns that nothing replaces
    rng.shuffle(rows)
    return rows


def test_against_prefixes_whatever_the_shards(spark):
    rows = table()
    df = spark.createDataFrame(rows, SCHEMA).withColumns({"depth": F.lit(1), "key": F.lit("x"), "block": F.lit(7)}).repartition(6)
    want = plain(rows)
    for size in (1, 50, pt.SHARD):
        assert got(pt.conversation_trie(df, size=size)) == want
    assert got(pt.conversation_trie(df, shared=0, size=90)) == plain(rows, 0)


def test_nothing_is_nothing_and_turnless_conversations_end_at_the_root(spark):
    assert pt.conversation_trie(spark.createDataFrame([], SCHEMA)).collect() == []
    assert pt.conversation_trie(spark.createDataFrame([(None, 1, "a", "b")], SCHEMA)).collect() == []
    c = next(c for c in range(1, 20) if zlib.crc32(str(c).encode()) % 4)
    (root,) = got(pt.conversation_trie(spark.createDataFrame([(c, 1, "a", "b")], SCHEMA)))
    assert root == (c, 0, None, 1, 0, 1, 0, hashlib.sha256(str(c).encode()).hexdigest())


def test_a_hot_conversation_is_a_row_for_each_shard(spark):
    rows = [(c, t, "user", f"turn {t}") for c in range(2000) for t in range(3)]
    nodes = pt.shard_nodes(pt.hashed_turns(spark.createDataFrame(rows, SCHEMA)), size=600)
    deep = nodes.where("depth = 3").groupBy("key").agg(F.count(F.lit(1)).alias("rows"), F.sum("n").alias("n")).collect()
    assert [(r.n) for r in deep] == [2000] and deep[0].rows <= 2000 * 3 // 600 + pt.partitions(spark)


def test_bitsets_against_sets():
    rng = random.Random(4)
    talks = [(c, [(bytes([rng.randint(0, 2)]), 1) for _ in range(rng.randint(0, 4))]) for c in range(200)]
    for _, parent, depth, _, n, low, ends in pt.VerticalIndex(talks).nodes():
        assert n >= len(ends) and low <= min(ends, default=low)
        assert all(len(dict(talks)[c]) == depth for c in ends) and (parent is None) == (depth == 0)
