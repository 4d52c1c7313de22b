import random

from quartzite.llm import jaccard as J
from quartzite.llm.common import components


def shingles(text):
    raw = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\r\x0b\x0c":
        raw = raw.replace(c, " ")
    w = [x for x in raw.split(" ") if x]
    return {tuple(w[k : k + 3]) for k in range(len(w) - 2)} if len(w) > 2 else {(len(w), *w)} if w else set()


def brute(docs, percent=90):
    sets, up = [(i, shingles(t)) for i, t in docs], {i: i for i, _ in docs}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, x in sets:
        for b, y in sets:
            if a < b and x and y and 100 * len(x & y) >= percent * len(x | y):
                a_, b_ = sorted((root(a), root(b)))
                up[b_] = a_
    return sorted((i, len(s), root(i)) for i, s in sets)


def corpus(groups, rng):
    word = lambda: f"w{rng.randrange(3000)}"
    passage = [word() for _ in range(40)]
    docs = []
    for size in groups:
        base = [word() for _ in range(rng.randint(30, 150))]
        for _ in range(size):
            t = [*base]
            for _ in range(rng.randint(0, 3)):
                t[rng.randrange(len(t))] = word()
            docs.append(" ".join(t))
    docs += [" ".join([word() for _ in range(20)] + passage + [word() for _ in range(rng.randint(5, 90))]) for _ in range(60)]
    docs += ["", None, "one", "ONE", "one two", "two one", "one two three", "\tone two  three\n", "É é", " "] + docs[:7]
    docs = [*enumerate(docs)]
    rng.shuffle(docs)
    return docs


def test_components_against_brute_force(spark):
    for seed, groups in ((1, [2, 3, 8, 5]), (2, [60, 45, 3])):  # small groups, and groups larger than GROUP
        docs = corpus(groups, random.Random(seed))
        df = spark.createDataFrame([(i, t, 9, 9) for i, t in docs], "doc_id long, text string, id int, component int")
        assert sorted(map(tuple, J.jaccard_components(df).collect())) == brute(docs)


def test_nulls_repeats_and_no_rows(spark):
    df = spark.createDataFrame([(None, "a b c d"), (5, "a b c d"), (5, "x y z"), (6, "x y z"), (7, None)], "doc_id long, text string")
    got = {(r.doc_id, r.n_shingles, r.component_id) for r in J.jaccard_components(df).collect()}
    assert got == {(None, 2, None), (5, 2, 5), (5, 1, 5), (6, 1, 5), (7, 0, 7)}
    assert J.jaccard_components(df.limit(0)).count() == 0
    assert sorted(r.doc_id or 0 for r in J.one_of_each(df).collect()) == [0, 5, 5, 7]


def test_prefix_filters_lose_no_pair():
    import numpy as np

    rng = np.random.default_rng(0)
    for _ in range(300):
        n = int(rng.integers(1, 200))
        x = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64))
        drop = int(len(x) * 0.1 / 1.9)
        y = np.unique(np.concatenate([x[drop:], rng.integers(0, 1 << 63, drop // 2, dtype=np.uint64)]))
        if 100 * len(np.intersect1d(x, y)) < 90 * len(np.union1d(x, y)):
            continue
        common = np.sort(rng.choice(x, len(x) // 3, replace=False))
        for order in range(J.ORDERS):
            both = np.intersect1d(J.prefix(x, common, order, 90)[0], J.prefix(y, common, order, 90)[0])
            assert len(both) >= J.shared_least(min(len(x), len(y)))
        assert J.forest([x, y], common, 90, np.arange(2), np.arange(2)) or np.array_equal(x, y)


def family(rng, n):
    """Near copies of one text, of which few pairs are similar enough: each has edits of its own."""
    base = [f"b{rng.randrange(10**6)}" for _ in range(150)]
    docs = []
    for i in range(n):
        t = [*base]
        for _ in range(rng.choice([1, 2, 3, 4, 6])):
            t[rng.randrange(len(t))] = f"e{rng.randrange(10**6)}"
        docs.append((i, " ".join(t)))
    return docs


def test_blocks_of_large_units_against_brute_force(spark):
    docs = family(random.Random(4), 300)
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    expected = brute(docs)
    assert len({c for _, _, c in expected}) > 10
    for block in (2_000, 25):
        assert sorted(map(tuple, J.jaccard_components(df, block_docs=block).collect())) == expected


def test_a_large_group_makes_no_row_for_each_pair(spark):
    import numpy as np

    docs = spark.createDataFrame(family(random.Random(5), 400), "id long, text string")
    J.small_batches(spark)
    common = J._common(docs, 90, 3)
    for last in (common, np.zeros(0, np.uint64)):
        classes = J._prefixes(docs, last, 90, 3, [0]).cache()
        assert J._candidates(classes, docs, last, 90, 3)[0].count() <= 400 * 40
        classes.unpersist()


def test_words_that_polynomial_hashes_confuse(spark):
    word, other = "a", "b"
    for _ in range(11):
        word, other = word + other, other + word
    docs = [(1, word), (2, other), (3, f"{word} x y"), (4, f"{other} x y"), (5, word)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert sorted(map(tuple, J.jaccard_components(df).collect())) == brute(docs)


def test_words_have_hashes_of_their_bytes():
    rng, words = random.Random(6), set()
    for n in [*range(1, 80), 200, 5000] * 3:
        words.add(bytes(rng.choices(b"ab\xc3\xa9", k=n)).decode("utf-8", "ignore") or "a")
    one, _ = J.shingle_sets([w for w in sorted(words)], 1)
    assert len({int(x[0]) for x in one}) == len(words)
    text = " ".join(sorted(words))
    together, _ = J.shingle_sets(["x " + text, text + "\t"], 1)
    assert {int(x[0]) for x in one} == {*map(int, together[1])} and len(together[0]) == len(words) + 1


def test_long_chains_are_one_component(spark):
    links = spark.range(500).selectExpr("id as a", "id + 1 as b")
    assert components(links).where("component = 0").count() == 501
    assert components(links.limit(0)).count() == 0


def stocked(rng, n):
    """Documents of own words and stock phrases that about a hundred documents have each; a few near copies among them."""
    phrases = [[f"p{k}w{i}" for i in range(6)] for k in range(n // 8)]
    docs = []
    for i in range(n):
        text = []
        for _ in range(12):
            text += [*(f"w{rng.randrange(10**7)}" for _ in range(4)), *phrases[rng.randrange(len(phrases))]]
        docs.append((i, " ".join(text)))
    for k in range(20):
        words = docs[k * 7][1].split()
        words[rng.randrange(len(words))] = "changed"
        docs.append((n + k, " ".join(words)))
    return docs


def test_phrases_of_many_documents_make_no_large_unit(spark, monkeypatch):
    """As from the number of documents on where the list that tasks have can't hold all shingles of large groups."""
    shipped, true = [], J._forests
    monkeypatch.setattr(J, "_forests", lambda places, *rest: (shipped.append(places.count()), true(places, *rest))[1])
    for n in (1_000, 3_000):
        monkeypatch.setattr(J, "COMMON", n // 160)
        shipped.clear()
        docs = stocked(random.Random(n), n)
        df = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
        got = {r.doc_id: r.component_id for r in J.jaccard_components(df).collect()}
        assert got == {i: (i if i < n else (i - n) * 7) for i, _ in docs}
        assert sum(shipped) <= 0.2 * n, shipped


def test_the_order_of_joined_shingles_against_brute_force(spark, monkeypatch):
    docs = family(random.Random(4), 300)
    monkeypatch.setattr(J, "COMMON", 1)  # nothing is in the list
    df = spark.createDataFrame([*docs, (None, "a b c d")], "doc_id long, text string").repartition(4)
    got = sorted(tuple(r) for r in J.jaccard_components(df).where("doc_id is not null").collect())
    assert got == brute(docs)


def test_a_list_that_cannot_hold_all_costs_no_more_tables(spark, monkeypatch):
    """Prefixes are written once at any size, and nothing has the texts dealt out for them."""
    docs, rows, true = stocked(random.Random(2), 1_000), {}, J.written

    def written(df, name):
        rows[name] = rows.get(name, 0) + (out := true(df, name)).count()
        return out

    monkeypatch.setattr(J, "written", written)
    monkeypatch.setattr(J, "COMMON", 6)
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    assert J.jaccard_components(df).where("component_id <> doc_id").count() == 20
    assert rows["prefixes"] == len(docs)


def test_shingles_that_share_bits_lose_no_pair(spark, monkeypatch):
    import numpy as np

    docs = corpus([60, 45, 3], random.Random(7))
    monkeypatch.setattr(J, "COMMON", 1)
    df = spark.createDataFrame(docs, "doc_id long, text string")
    for most in (64, 256):  # all rare shingles are last as well, or many
        monkeypatch.setattr(J, "MOST_BITS", most)
        assert sorted(map(tuple, J.jaccard_components(df).collect())) == brute(docs)
    tokens = np.array([0, 63, 64, (1 << 64) - 1, 5 << 40], np.uint64)
    monkeypatch.setattr(J, "MOST_BITS", 1 << 27)
    bits = J._bits(spark.createDataFrame([(int(t),) for t in tokens[1:].view(np.int64)], "t long"))
    # 32 bits would do for four shingles: there are 64, of which 0 and 63 are set
    assert bits.tolist() == [(1 << 63) | 1]


def test_shingles_that_move_up_are_counted(spark, monkeypatch):
    """Documents of which nearly half are phrases of a hundred documents: what follows those in their prefixes are such phrases too."""
    rng, n, shipped, true = random.Random(3), 1_000, [], J._forests
    phrases = [[f"p{k}w{i}" for i in range(8)] for k in range(n * 3 // 10)]
    docs = [(i, " ".join(w for _ in range(30) for w in [*(f"w{rng.randrange(10**7)}" for _ in range(5)), *phrases[rng.randrange(len(phrases))]])) for i in range(n)]
    monkeypatch.setattr(J, "_forests", lambda places, *rest: (shipped.append(places.count()), true(places, *rest))[1])
    monkeypatch.setattr(J, "COMMON", n // 160)
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    assert J.jaccard_components(df).where("component_id <> doc_id").count() == 0
    assert sum(shipped) <= 0.05 * n, shipped
