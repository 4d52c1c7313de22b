import hashlib
import math

import numpy as np

from quartzite.llm import vector_codes as vc


def plain(rows, parts=4, entries=256, rounds=4, scale=1024):
    """The contract in loops: rows of (vec_id, vector, label)."""
    kept = sorted(((i, [math.floor(scale * x) for x in v], label) for i, v, label in rows), key=lambda r: r[0])
    width = len(kept[0][1]) // parts
    cut = lambda v, p: v[p * width : (p + 1) * width]
    books = [[cut(v, p) for _, v, _ in kept[:entries]] for p in range(parts)]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    best = lambda u, p: min((far(u, e), k) for k, e in enumerate(books[p]))
    for _ in range(rounds):
        held = [[[] for _ in books[0]] for _ in range(parts)]
        for _, v, _ in kept:
            for p in range(parts):
                held[p][best(cut(v, p), p)[1]].append(cut(v, p))
        books = [[[sum(x) // len(us) for x in zip(*us, strict=True)] if us else e for us, e in zip(held[p], books[p], strict=True)] for p in range(parts)]
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    out = [(i, [best(cut(v, p), p) for p in range(parts)], label) for i, v, label in kept]
    out = [(i, "".join(f"{k:02x}" for _, k in found), sum(d for d, _ in found), label) for i, found, label in out]
    of = {}
    for _, _, error, label in out:
        of[label] = of.get(label, 0) + error
    return sorted((i, code, error, of[label], digest) for i, code, error, label in out)


def frame(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")


def got(df):
    return sorted((r.vec_id, r.code, r.error, r.label_error, r.codebooks_sha256) for r in df.collect())


def test_against_loops_with_ties_copies_and_unusable_vectors(spark):
    rng = np.random.default_rng(3)
    x = np.round(rng.normal(size=(700, 8)) * 4) / 4  # on a grid: equal distances and equal entries
    x[100:400] = x[50]
    rows = [(i, v.tolist(), int(i % 5) if i % 7 else None) for i, v in enumerate(x)]
    bad = [(-1, None, 1), (-2, [math.nan] * 8, 1), (-3, [None] + [1.0] * 7, 1), (-4, [math.inf] * 8, 2), (-5, [], 2), (9000, [1.0], 2), (9001, [1e30] * 8, 2)]
    df = frame(spark, rows + bad).withColumns({"code": vc.F.lit("x"), "_label": vc.F.lit(1)})
    assert got(vc.vector_codes(df.repartition(5))) == plain(rows)


def test_fewer_rows_than_entries_repeats_and_a_dimension_that_is_filled_up(spark):
    rows = [(1, [0.5, 0.25, -1.0, 2.0, 3.0], None), (1, [0.5, 0.25, -1.0, 2.0, 3.0], None), (3, [-0.5, 0.0, 0.1, 0.0, 0.7], 4)]
    filled = [(i, [*v, 0.0, 0.0, 0.0], label) for i, v, label in rows]
    assert got(vc.vector_codes(frame(spark, rows))) == plain(filled)
    assert vc.vector_codes(frame(spark, [])).collect() == []
    assert vc.vector_codes(frame(spark, [(1, None, 1)])).columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]


def test_search_finds_the_nearest_of_the_lowest_index_and_looks_at_a_part_of_the_entries():
    rng = np.random.default_rng(5)
    centres = rng.integers(-2000, 2000, (40, 3))
    entries = (centres[rng.integers(0, 40, 256)] + rng.integers(-60, 60, (256, 3))).astype(np.int64)
    entries[200] = entries[7]
    x = (centres[rng.integers(0, 40, 3000)] + rng.integers(-60, 60, (3000, 3))).astype(np.int64)
    x[:300] = entries[rng.integers(0, 256, 300)]
    search = vc.Orchard(entries)
    at, best = search.nearest(x)
    exact = ((x[:, None] - entries) ** 2).sum(2)
    assert (at == exact.argmin(1)).all() and (best == exact.min(1)).all()
    assert search.looked < 0.5 * exact.size


def test_codes_decode_to_vectors_near_the_originals(spark):
    rng = np.random.default_rng(6)
    df = frame(spark, [(i, v.tolist(), 0) for i, v in enumerate(rng.normal(size=(500, 16)) * 0.2)])
    kept = vc.usable(df)
    books = vc.fit(kept)
    for r in vc.encode(kept, books).join(df.select("vec_id", "embedding"), "vec_id").limit(50).collect():
        error = sum((a - b) ** 2 for a, b in zip(books.decode(r.code), r.embedding, strict=True)) * vc.SCALE**2
        assert abs(error - r.error) <= 16 + 4 * math.sqrt(16 * (r.error + 1))
