import numpy as np

from quartzite.llm import ann


def table(spark, n=1500, d=16):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(n, d)).astype(np.float32)
    x[100:400] = x[50]  # many copies
    rows = [(i, v.tolist(), 3) for i, v in enumerate(x)]
    rows += [(n, None, 3), (n + 1, [0.0] * d, 3), (n + 2, [float("nan")] + [1.0] * (d - 1), 3), (n + 3, [None] + [1.0] * (d - 1), 3), (n + 4, [float("inf")] * d, 3), (n + 5, [1.0], 3), (n + 6, [], 3)]
    return x, spark.createDataFrame(rows, "vec_id long, embedding array<float>, rank int")


def test_recall_ties_and_unusable_vectors(spark):
    x, df = table(spark)
    got = ann.nearest(df, df.where("vec_id % 20 = 0"), rerank=400, books=4, words=64).collect()
    found = {}
    for r in sorted(got, key=lambda r: (r.query_id, r["rank"])):
        found.setdefault(r.query_id, []).append((r.vec_id, r.score))
    assert set(found) == {*range(0, 1500, 20)} and all(len(v) == 20 for v in found.values())
    hits = 0
    for q, rows in found.items():
        exact = x.astype(float) @ x[q].astype(float)
        best = [i for i in np.lexsort((np.arange(len(x)), -exact)) if i != q][:20]
        hits += len({i for i, _ in rows} & {*best})
        assert all(abs(exact[i] - s) < 1e-9 for i, s in rows)
        assert rows == sorted(rows, key=lambda r: (-r[1], r[0]))
    assert hits / (20 * len(found)) > 0.9
    assert [i for i, _ in found[100]][:2] == [50, 101]  # copies, by id, without the query itself


def test_recall_with_production_parameters(spark):
    """Vectors without clusters, and thousands that lie close together: more than are reranked."""
    rng = np.random.default_rng(4)
    x = rng.normal(size=(9_000, 32))
    x[4_000:] = x[0] + 0.15 * rng.normal(size=(5_000, 32))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    found = {}
    for r in ann.nearest(df, df.where("vec_id % 300 = 0")).collect():
        found.setdefault(r.query_id, set()).add(r.vec_id)
    hits = 0
    for q, got in found.items():
        exact = x @ x[q]
        exact[q] = -np.inf
        hits += len(got & {*np.argsort(-exact)[:20].tolist()})
    assert len(found) == 30 and hits / (20 * 30) > 0.95


def test_few_and_no_rows(spark):
    _, df = table(spark, 500)
    few = df.where("vec_id < 5")
    assert ann.nearest(few, few.where("vec_id = 0")).count() == 4
    assert ann.nearest(df.limit(0), df.limit(0)).count() == 0


def test_the_tables_dimension_counts_not_that_of_the_queries(spark):
    rows = [(i, [float(i), 1.0]) for i in range(1, 40)] + [(40, [1.0]), (60, [2.0]), (80, [3.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = ann.nearest(df, df.where("vec_id % 20 = 0"), k=3).collect()
    assert sorted((r.query_id, r["rank"], r.vec_id) for r in got) == [(20, 1, 39), (20, 2, 38), (20, 3, 37)]


def test_code_of_a_vector_hangs_on_it_alone():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(600, 8)).astype(np.float32)
    model = ann.AdditiveQuantiser(x, books=3, words=32, beam=4, more=0)
    finer = ann.AdditiveQuantiser(x, books=3, words=32, beam=4, more=3)
    assert ((x - finer.sums(finer.encode(x))) ** 2).sum() < 0.5 * ((x - model.sums(model.encode(x))) ** 2).sum()
    codes = model.encode(x)
    assert ((x - model.sums(codes)) ** 2).sum() < 0.5 * (x**2).sum()
    assert (model.encode(x[:7]) == codes[:7]).mean() > 0.9
