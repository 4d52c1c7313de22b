import hashlib
import random
import re

import numpy as np

from quartzite.llm import substrings as S
from quartzite.llm.collection_bwt import build, smallest_owner


def common(a, b):
    n = 0
    for x, y in zip(a, b, strict=False):
        if x != y:
            break
        n += 1
    return n


def test_construction_in_memory_and_in_files(tmp_path):
    rng = random.Random(3)
    for _ in range(80):
        strings = [bytes(rng.choices(rng.choice([b"ab", b"\0a", b"abcdxyz"]), k=rng.randint(0, 20))) for _ in range(rng.randint(1, 12))]
        block = rng.choice([1, 3, 7, 4_000_000])
        column = build(strings, 255, str(tmp_path), block)
        parts = [b for b, _ in column.read()]
        bwt, lcp, name = (np.concatenate([p[k] for p in parts]) for k in range(3))
        column.drop()
        whole = name < 0
        name = np.where(whole, -1 - name, name)
        suffix = [strings[n // 256][len(strings[n // 256]) - n % 256 :] for n in name.tolist()]
        assert suffix == sorted(suffix) and len(set(name.tolist())) == sum(len(s) + 1 for s in strings)
        assert lcp.tolist() == [0] + [common(a, b) for a, b in zip(suffix, suffix[1:], strict=False)]
        for n, c, w in zip(name.tolist(), bwt.tolist(), whole.tolist(), strict=True):
            s, k = strings[n // 256], n % 256
            assert w == (k == len(s)) and (w or s[len(s) - k - 1] == c)
        window, owner = rng.randint(1, 5), np.array([rng.randint(0, 5) for _ in strings])
        found = smallest_owner(strings, owner, window, str(tmp_path), block)
        low = {}
        for s, o in zip(strings, owner, strict=True):
            for k in range(len(s) - window + 1):
                low[s[k : k + window]] = min(o, low.get(s[k : k + window], 99))
        for k, s in enumerate(strings):
            assert found(k).tolist() == [low[s[i : i + window]] for i in range(len(s) - window + 1)]
    assert not [*tmp_path.iterdir()]


def brute(docs):
    first = {}
    for i, t in docs:
        b = (t or "").encode()
        for k in range(len(b) - 49):
            first[b[k : k + 50]] = min(i, first.get(b[k : k + 50], i))
    out = []
    for i, t in docs:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for k in range(len(b) - 49):
            if first[b[k : k + 50]] < i:
                gone[k : k + 50] = b"\1" * 50
        kept = bytes(c for c, g in zip(b, gone, strict=True) if not g)
        out.append((i, len(b), sum(gone), len(re.findall(b"\x01+", bytes(gone))), hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def made():
    rng = random.Random(5)
    word = lambda: "".join(rng.choices("abcdeéü", k=rng.randint(1, 7)))
    passages = [" ".join(word() for _ in range(rng.randint(8, 30))) for _ in range(6)]
    docs = []
    for i in range(150):
        parts = [" ".join(word() for _ in range(rng.randint(0, 12))) for _ in range(3)]
        for _ in range(rng.randint(0, 3)):
            p = rng.choice(passages)
            a = rng.randint(0, len(p) // 2)
            parts.insert(rng.randint(0, 3), p[a : a + rng.randint(30, 150)])
        docs.append((i, " ".join(parts)))
    docs += [(150 + k, docs[k][1]) for k in range(10)]  # exact copies
    for k in range(10):  # near copies
        t = [*docs[k][1]] or ["x"]
        t[rng.randrange(len(t))] = "Z"
        docs.append((160 + k, "".join(t)))
    docs += [(170, None), (171, ""), (172, "x" * 49), (173, "x" * 50), (174, "-" * 3000), (175, "-" * 400 + "+" + "-" * 60), (176, "ab" * 700), (177, "ab" * 40), (178, docs[0][1]), (178, docs[0][1] + " more")]
    rng.shuffle(docs)
    return docs


def test_whole_texts_against_brute_force(spark):
    docs = made()
    df = spark.createDataFrame([(i, t, 1, "c") for i, t in docs], "doc_id long, text string, chunk int, raw string")
    for size in (S.CHUNK, 2_000):
        assert sorted(map(tuple, S.repeated_spans(df, chunk_bytes=size).collect())) == brute(docs)
    assert S.repeated_spans(df.limit(0)).count() == 0


def test_cut_keeps_columns_and_whole_characters(spark):
    long = "é" * 60
    df = spark.createDataFrame([(1, "en", "a" + long, 3), (2, "de", "b" + long + "ü", 4), (None, "fr", "c" + long, 5), (4, None, None, 6)], "doc_id long, lang string, text string, n int")
    out = {r.doc_id: r for r in S.repeated_spans(df, cut=True).collect()}
    assert out[1].text == "a" + long and out[2].text == "bü" and out[None].text == "c" and out[4].text is None
    assert (out[2].lang, out[2].n) == ("de", 4) and S.repeated_spans(df, cut=True).columns == df.columns


def test_pruning_never_drops_a_shared_window():
    rng = random.Random(2)
    for _ in range(60):
        base, docs = "".join(rng.choices("abc d", k=300)).encode(), []
        for _ in range(5):
            x = bytearray(base)
            for _ in range(rng.randint(0, 12)):
                x[rng.randrange(len(x))] = rng.choice(b"abxyz")
            docs.append(bytes(x[rng.randint(0, 50) :]))
        begin = np.concatenate([[0], np.cumsum([len(x) for x in docs])])
        raw = b"".join(docs)
        strings = {raw[a : a + n + 49]: h for a, n, h in zip(*(x.tolist() for x in S.runs_of(raw, begin)), strict=True)}
        keep, of = S.comparable([*strings], np.array([*strings.values()], np.uint64), 50), {}
        for k, s in enumerate(strings):
            for i in range(len(s) - 49):
                of.setdefault(s[i : i + 50], set()).add(k)
        assert all(keep[k] for who in of.values() if len(who) > 1 for k in who)


def repeated_lines():
    """Pairs of documents that hold a line a different number of times after the same text."""
    rng = random.Random(7)
    some = lambda n: "".join(rng.choices("abcdefghij klmnop", k=n))
    docs = []
    for k in range(60):
        same, line = some(rng.randint(10, 60)), some(rng.randint(3, 26))
        docs += [(2 * k + j, some(rng.randint(0, 40)) + same + line * rng.randint(1, 6) + some(rng.randint(0, 40))) for j in range(2)]
    return docs


def test_repeated_lines_against_brute_force(spark):
    docs = repeated_lines()
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert sorted(map(tuple, S.repeated_spans(df).collect())) == brute(docs)


def test_pruning_of_repeated_lines():
    docs = repeated_lines()
    for k in range(0, len(docs), 2):
        texts = [t.encode() for _, t in docs[k : k + 2]]
        begin = np.concatenate([[0], np.cumsum([len(x) for x in texts])])
        raw = b"".join(texts)
        strings = {raw[a : a + n + 49]: h for a, n, h in zip(*(x.tolist() for x in S.runs_of(raw, begin)), strict=True)}
        keep, of = S.comparable([*strings], np.array([*strings.values()], np.uint64), 50), {}
        for j, s in enumerate(strings):
            for i in range(len(s) - 49):
                of.setdefault(s[i : i + 50], set()).add(j)
        assert all(keep[j] for who in of.values() if len(who) > 1 for j in who)
