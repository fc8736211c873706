import numpy as np
import pytest
from pyspark.sql import functions as F

from lumaveil.llm import neighbours as N


def rows_of(n, seed=3):
    rng = np.random.RandomState(seed)
    centres = rng.normal(size=(40, 16))
    x = np.concatenate([centres[rng.randint(0, 40, n - n // 3)] + 0.3 * rng.normal(size=(n - n // 3, 16)), np.tile(centres[:1], (n // 3, 1))])
    return [(i, [float(np.float32(v)) for v in r], 1) for i, r in enumerate(x)]


def brute(rows, queries, k=5):
    ids = np.array([r[0] for r in rows])
    x = np.array([r[1] for r in rows])
    n = np.sqrt((x * x).sum(1))
    out = {}
    for q in queries:
        i = int(np.flatnonzero(ids == q)[0])
        s = (x * x[i]).sum(1) / (n * n[i])
        order = [j for j in np.lexsort((ids, -s)) if ids[j] != q][:k]
        out[q] = [(int(ids[j]), float(s[j])) for j in order]
    return out


@pytest.mark.parametrize("block", [150, 4000])
def test_recall_and_exact_scores(spark, block):
    rows = rows_of(3000)
    extra = [(9000, None, 1), (9050, [0.0] * 16, 1), (9100, [float("nan")] * 16, 1), (9150, [None] * 16, 1), (None, [1.0] * 16, 1)]
    df = spark.createDataFrame(rows + extra + rows[:3], "vec_id long, embedding array<float>, part int")
    got = {}
    for r in N.search(df, F.col("vec_id") % 50 == 0, sample=1500, block=block).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    want = brute(rows, [r[0] for r in rows if r[0] % 50 == 0])
    assert got.keys() == want.keys()
    hits = 0
    for q, near in want.items():
        assert [g[0] for g in got[q]] == [1, 2, 3, 4, 5] and q not in {g[1] for g in got[q]}
        assert all(a[2] > b[2] or (a[2] == b[2] and a[1] < b[1]) for a, b in zip(got[q], got[q][1:]))
        hits += len({g[1] for g in got[q]} & {i for i, _ in near})
        scores = dict(brute(rows, [q], len(rows))[q])
        assert all(abs(scores[v] - s) < 1e-12 for _, v, s in got[q])
    assert hits >= 0.9 * 5 * len(want)


def test_few_and_none(spark):
    rows = [(0, [1.0, 0.0], 1), (1, [1.0, 1.0], 1), (50, [0.0, 1.0], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, rank int")
    got = sorted((r.query_id, r["rank"], r.vec_id) for r in N.op2(df).collect())
    assert got == [(0, 1, 1), (0, 2, 50), (50, 1, 1), (50, 2, 0)]
    assert N.op2(df.limit(0)).collect() == []
    assert N.op2(df.where("vec_id = 1")).collect() == []


def test_parts_are_balanced():
    x = np.array([r[1] for r in rows_of(1200)])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    part = N.balanced_parts(x, N.neighbour_graph(x, 10), 6)
    assert np.bincount(part).max() <= 1.1 * 1200 / 6 + 1


def test_repeated_ids_with_other_vectors(spark):
    rows = [(1, [1.0, 0.1]), (1, [0.0, 1.0]), (50, [1.0, 0.0]), (50, [0.5, 0.5]), (2, [-1.0, 0.0]), (2, [-1.0, 0.0])]
    got = []
    for order, n in ((1, 1), (-1, 4)):
        df = spark.createDataFrame(rows[::order], "vec_id long, embedding array<double>").repartition(n)
        got.append([tuple(r) for r in N.op2(df).orderBy("rank").collect()])
    assert got[0] == got[1] and [(r[0], r[2]) for r in got[0]] == [(50, 1), (50, 1), (50, 2)]
