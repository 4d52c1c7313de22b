import random

import numpy as np

from quartzite.llm import decontaminate as D


def brute(text, items, window=10):
    words = D.word_list(text)
    hit, found = [False] * len(words), set()
    for i, t in items:
        w = D.word_list(t)
        n = min(window, len(w))
        wins = {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if n else set()
        for k in range(len(words) - n + 1 if n else 0):
            if tuple(words[k : k + n]) in wins:
                hit[k : k + n] = [True] * n
                found.add(str(i))
    return len(words), sum(hit), sorted(found)


def test_index_finds_what_a_scan_finds():
    rng = np.random.default_rng(3)
    for _ in range(60):
        seq = rng.integers(1, 5, rng.integers(1, 200))
        index = D.FmIndex(seq, 6, step=3)
        for n in (1, 2, 3):
            phrases = rng.integers(2, 6, (20, n))
            low, high = index.search(phrases)
            for p, a, b in zip(phrases, low, high, strict=True):
                at = sorted(k for k in range(len(seq) - n + 1) if (seq[k : k + n] == p).all())
                assert b - a == len(at) and sorted(index.locate(np.arange(a, b)).tolist()) == at


def test_wavelet_tree_ranks():
    seq = np.random.default_rng(1).integers(0, 11, 300)
    tree = D.WaveletTree(seq, 11)
    at = np.arange(301)
    for c in range(11):
        assert (tree.rank(np.full(301, c), at) == np.concatenate([[0], np.cumsum(seq == c)])).all()
    c, before = tree.access(np.arange(300))
    assert (c == seq).all() and all(b == (seq[:k] == x).sum() for k, (x, b) in enumerate(zip(c, before, strict=True)))


def test_documents_against_brute_force(spark):
    rng = random.Random(4)
    words = [f"w{k}" for k in range(12)] + ["É", "Straße"]
    items = [(k, " ".join(rng.choices(words, k=rng.choice([1, 3, 9, 10, 11, 30])))) for k in range(8)] + [(8, None), (9, ""), (10, "!!! ---")]
    texts = [" ".join(rng.choices(words, k=rng.randint(0, 60))) for _ in range(60)] + [items[k][1].upper() + "! " + "zz" for k in range(8)] + [None, "", "..."]
    df = spark.createDataFrame([(i, t, 7, "x") for i, t in enumerate(texts)], "doc_id long, text string, n_words int, hit_items string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    for block in (1 << 20, 40):  # one pass, and several
        found = D.contamination(df, bench, block_bytes=block).select("*")
        for r in found.collect():
            n, hit, ids = brute(texts[r.doc_id], items)
            assert (r.n_words, sum(s.end - s.begin for s in r.hit_spans), r.hit_items) == (n, hit, ids)
    rows = {r.doc_id: r for r in D.report(found).collect()}
    assert rows[60].contaminated and not rows[len(texts) - 1].contaminated
    assert D.report(D.contamination(df.limit(0), bench)).count() == 0
    assert D.report(D.contamination(df, bench.limit(0))).where("contaminated").count() == 0


def test_cut_spans(spark):
    item = "one two three four five six seven eight nine ten"
    df = spark.createDataFrame([(1, f"Before, {item.upper()}! After É", "en"), (2, "clean", "en"), (3, None, "en")], "doc_id long, text string, lang string")
    out = {r.doc_id: r.text for r in D.without_hits(D.contamination(df, spark.createDataFrame([(1, item)], "item_id long, text string"))).collect()}
    assert out == {1: "Before, ! After É", 2: "clean", 3: None}


def test_items_without_an_id_make_spans(spark):
    df = spark.createDataFrame([(1, "x a b c y d e"), (2, "nothing here")], "doc_id long, text string")
    bench = spark.createDataFrame([(None, "a b c"), (None, "f"), (5, "d e"), (None, "d e")], "item_id long, text string")
    for block in (1 << 20, 3):
        got = {r.doc_id: ([tuple(s) for s in r.hit_spans], r.hit_items) for r in D.contamination(df, bench, block_bytes=block).collect()}
        assert got == {1: ([(1, 4), (5, 7)], ["5"]), 2: ([], [])}
