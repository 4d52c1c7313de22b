import random

import corpus_pipeline as P
from quartzite.llm.queries import oracle_sql, queries

SF = "/root/testdata/sf0.001"


def test_stages_keep_columns_and_pass_on_what_they_decide(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    extra = docs.limit(1).selectExpr("cast(900001 as bigint) as doc_id", "'12 34 !!' as text", "lang", "source", "n_chars").unionByName(docs.limit(1).selectExpr("cast(900002 as bigint) as doc_id", "text", "lang", "source", "n_chars"))
    now, ids = docs.unionByName(extra), set()
    for name, stage in P.STAGES[:-1]:
        now = P.written(stage(spark, now, SF), name)
        assert now.columns == docs.columns
        ids = {r.doc_id for r in now.select("doc_id").collect()}
        if name == "language":
            assert 900001 not in ids and 900002 in ids and len(ids) >= docs.count()
    assert 900002 not in ids
    last = P.STAGES[-1][1](spark, now, SF)
    assert {r.doc_id for r in last.collect()} == ids
    assert [n for n, _ in P.STAGES] == ["language", "near_duplicates", "repeated_passages", "benchmark", "tokens"]


def test_every_operator_has_a_query():
    names = queries()
    assert [sum(n.startswith(f"op{k}_") for n in names) for k in range(1, 11)] == [1] * 10 and set(oracle_sql()) <= set(names)


def near_copies():
    """Texts of invented words, and copies with edits at even distances, with one stretch changed or with words added; no word is shared else."""
    rng, docs = random.Random(11), []
    word = lambda: f"w{rng.randrange(10**9)}"
    for _ in range(12):
        base = [word() for _ in range(rng.randint(80, 200))]
        n = len(base)
        spread, stretch = [*base], [*base]
        for k in range(2 * n // 100):
            spread[(k + 1) * n // (2 * n // 100 + 1)] = word()
        at, size = rng.randrange(n // 2), n * rng.randint(3, 15) // 100
        stretch[at : at + size] = [word() for _ in range(size)]
        added = base + [word() for _ in range(n * rng.randint(8, 35) // 100)]
        docs += [" ".join(t) for t in (base, spread, stretch, added)]
    docs += ["", None, "one", "one two three four", "ONE two three  four", docs[0]]
    return [*enumerate(docs)]


def links(docs):
    """Pairs of near copies, with how alike their five-word and three-word shingles are."""
    def shingles(text, n):
        w = (text or "").lower().split()
        return {tuple(w[k : k + n]) for k in range(max(1, len(w) - n + 1))} if w else set()

    alike = lambda x, y: len(x & y) / len(x | y) if x and y else 0
    five, three = ({i: shingles(t, n) for i, t in docs} for n in (5, 3))
    every = [(a, b, alike(five[a], five[b]), alike(three[a], three[b])) for a, _ in docs for b, _ in docs if a < b]
    return [x for x in every if x[2] >= 0.8]


def test_near_duplicates_whole_rows_against_brute_force(spark):
    docs = near_copies()
    found, up = links(docs), {i: i for i, _ in docs}
    assert sum(0.8 <= five < 0.9 and three < 0.9 for _, _, five, three in found) >= 8
    for _ in docs:
        for a, b, _, _ in found:
            up[a] = up[b] = min(up[a], up[b])
    rows = [(i, t, "en", f"s{i}", len(t or "")) for i, t in docs]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = P.keep_one_of_each(spark, df, SF).collect()
    assert sorted(map(tuple, got), key=lambda r: r[0]) == [r for r in rows if up[r[0]] == r[0]]


def stage(name):
    return dict(P.STAGES)[name]


def frame(spark, docs):
    rows = [(i, t, "en", f"s{i}", len(t or ""), 7, "c") for i, t in docs]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, chunk int, raw string")


def test_languages_against_plain_predictions(spark):
    from quartzite.llm import language as L

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = L.fit(docs.where(~L.held_out()))
    grams, kept = L.Grams(model.alphabet), set()
    for r in docs.collect():
        langs, scores = model.predict([r.text], grams)  # one text at a time, on the driver
        if langs[0] != "und" and scores[0] > 0:
            kept.add(r.doc_id)
    assert {r.doc_id for r in stage("language")(spark, docs, SF).collect()} == kept and kept


def test_repeated_passages_whole_rows_against_brute_force(spark):
    from tests.llm.test_substrings import made

    docs = [(i, t) for i, t in made() if i < 170]
    first, expected = {}, []
    for i, t in docs:
        b = (t or "").encode()
        for k in range(len(b) - 49):
            first[b[k : k + 50]] = min(i, first.get(b[k : k + 50], i))
    for i, t in docs:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for k in range(len(b) - 49):
            if first[b[k : k + 50]] < i:
                gone[k : k + 50] = b"\1" * 50
        at, out = 0, []
        for c in t or "":
            n = len(c.encode())
            if not all(gone[at : at + n]):
                out.append(c)
            at += n
        text = None if t is None else "".join(out)
        expected.append((i, text, "en", f"s{i}", len(text or "")))
    got = sorted(map(tuple, stage("repeated_passages")(spark, frame(spark, docs), SF).collect()))
    assert got == sorted(expected) and any(a[1] != b[1] for a, b in zip(sorted(docs), sorted(expected), strict=True))


def test_benchmark_passages_whole_rows_against_brute_force(spark):
    import re

    word, rng = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+"), random.Random(3)
    items = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    windows = set()
    for t in items:
        w = ["".join(c.lower() if "A" <= c <= "Z" else c for c in x) for x in word.findall(t or "")]
        n = min(10, len(w))
        windows |= {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if n else set()
    docs, expected = [(0, None), (1, ""), (2, "Nothing of it, here.")], []
    for i in range(3, 60):
        t = rng.choice(items) or ""
        spots = [m.start() for m in word.finditer(t)] or [0]
        a = rng.choice(spots)
        docs.append((i, f"Before it, é {i}: " + t[a : a + rng.randint(10, 400)].upper() + rng.choice(["! After.", "", " and so on"])))
    for i, t in docs:
        found = [*word.finditer(t or "")]
        w = ["".join(c.lower() if "A" <= c <= "Z" else c for c in m[0]) for m in found]
        hit = [False] * len(w)
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                if tuple(w[k : k + n]) in windows:
                    hit[k : k + n] = [True] * n
        out, at, k = [], 0, 0
        while k < len(w):
            e = k
            while e < len(w) and hit[e]:
                e += 1
            if e > k:
                out.append(t[at : found[k].start()])
                at = found[e - 1].end()
            k = max(e, k + 1)
        text = None if t is None else "".join(out) + t[at:]
        expected.append((i, text, "en", f"s{i}", len(text or "")))
    assert sorted(map(tuple, stage("benchmark")(spark, frame(spark, docs), SF).collect())) == expected
    assert sum(a[1] != b[1] for a, b in zip(docs, expected, strict=True)) > 10


def test_tokens_against_the_library(spark):
    import hashlib

    import numpy as np
    from tokenizers import Tokenizer

    from quartzite.llm.queries import vocabulary

    library, docs = Tokenizer.from_file(vocabulary()), [(0, None), (1, ""), (2, "Some text, and more."), (2, "Some text, and more."), (3, "né \u0558 x" * 50)]
    expected = []
    for i, t in docs:
        ids = library.encode(t or "", add_special_tokens=False).ids
        expected.append((i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    assert sorted(map(tuple, stage("tokens")(spark, frame(spark, docs), SF).collect())) == sorted(expected)


def test_stages_on_no_rows(spark):
    none = frame(spark, near_copies()).limit(0)
    for name, f in P.STAGES[:-1]:
        got = f(spark, none, SF)
        assert got.columns == list(P.COLUMNS) and got.count() == 0, name
    assert stage("tokens")(spark, none, SF).count() == 0
