import numpy as np
import pytest

from lumaveil.llm import cover as C


def brute(rows):
    good = [(i, np.array(v, float)) for i, v in rows if i is not None and v is not None and len(v) and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    x = np.array([v for _, v in good])
    n = np.sqrt((x * x).sum(1))
    near = np.array([[(a * b).sum() / (m * k) for b, k in zip(x, n)] for a, m in zip(x, n)]) >= 0.95
    np.fill_diagonal(near, False)
    part = list(range(len(x)))
    for _ in range(len(x)):
        new = [min([part[i], *(part[j] for j in np.flatnonzero(near[i]))]) for i in range(len(x))]
        if new == part:
            break
        part = new
    least = {}
    for p, (i, _) in zip(part, good):
        least[p] = min(i, least.get(p, i))
    out = [(i, int(near[k].sum()), least[part[k]], i == least[part[k]]) for k, (i, _) in enumerate(good)]
    ok = lambda i, v: i is not None and v is not None and len(v) and all(x is not None and np.isfinite(x) for x in v) and any(v)
    out += [(i, 0, i, i is not None) for i, v in rows if not ok(i, v)]
    return sorted(out, key=str)


def vectors(seed=2):
    rng = np.random.RandomState(seed)
    out = []
    for _ in range(4):
        base = rng.normal(size=12)
        for spread in (0.02, 0.08, 0.15):
            out += [base + spread * rng.normal(size=12) * np.linalg.norm(base) / 3 for _ in range(18)]
    out += [rng.normal(size=12) for _ in range(60)]
    a = np.zeros(12)
    a[0] = 1
    b = np.zeros(12)
    b[0], b[1] = 0.95, np.sqrt(1 - 0.95**2)
    out += [a, b, 3 * a] + [out[0]] * 9
    return [(1000 - i, [float(np.float32(x)) for x in v]) for i, v in enumerate(out)]


@pytest.mark.parametrize("block", [40 * 12, 3000 * 12])
def test_against_brute_force(spark, monkeypatch, block):
    rows = vectors() + [(2000, None), (2001, [0.0] * 12), (2002, [float("nan")] + [1.0] * 11), (2003, [None] + [1.0] * 11), (2004, [float("inf")] * 12), (None, [1.0] * 12), (2005, [])]
    rows += [rows[3]]
    df = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<float>, w int")
    monkeypatch.setattr(C, "CHUNK", 64)
    monkeypatch.setattr(C, "PAIRS", 100)
    got = C.near_duplicates(df, block=block).collect()
    assert sorted(map(tuple, got), key=str) == brute(rows)


def test_tree_covers():
    x = C.unit(np.array([v for _, v in vectors()]))
    t = C.Tree(x)
    assert sorted(t.order) == list(range(len(x)))

    def walk(nodes, above):
        for k in nodes:
            d = np.sqrt(((x[t.points(k)] - x[t.centre[k]]) ** 2).sum(1))
            assert t.centre[k] in t.points(k) and d.max() <= t.radius[k] + 1e-12 <= above + 1e-6
            kids = t.children[t.below[k] : t.below[k] + t.many[k]]
            if len(kids):
                assert sorted(i for m in kids for i in t.points(m)) == sorted(t.points(k))
                level = next(r for r in C.RADII if max(t.radius[kids]) <= r / 1 + 1e-9 or r == C.RADII[-1])
                walk(kids, max(level, max(t.radius[kids])))

    walk(t.roots, C.RADII[0])
    own = C.net(x, 0.5)
    centres = np.unique(own)
    apart = np.sqrt(((x[centres][:, None] - x[centres][None]) ** 2).sum(2))[np.triu_indices(len(centres), 1)]
    assert (own[centres] == centres).all() and apart.min() > 0.5


def test_tight_group_takes_few_steps():
    rng = np.random.RandomState(1)
    base = rng.normal(size=64)
    x = base + 0.001 * rng.normal(size=(2000, 64))
    found = C.Links(x, np.ones(2000, np.int64), 0.95)
    t = C.Tree(C.unit(x))
    found.traverse(t, t, 0, 0)
    assert (found.count == 1999).all() and len(set(found.part)) == 1 and found.opened < 100


def test_empty_table(spark):
    assert C.op6(spark.createDataFrame([], "vec_id long, embedding array<float>")).collect() == []


def test_a_wide_group_in_one_block():
    """All pairs of a group whose members are further apart than the nets below its top, in bounded memory."""
    rng = np.random.RandomState(3)
    base = rng.normal(size=64)
    x = base / np.linalg.norm(base) + 0.1 / 8 * rng.normal(size=(1500, 64))
    t = C.Tree(C.unit(x))
    for threshold in (0.95, 0.985, 0.99):
        found = C.Links(x, np.ones(len(x), np.int64), threshold)
        found.traverse(t, t, 0, 0)
        n = np.sqrt((x * x).sum(1))
        near = (x @ x.T) / n[:, None] / n[None] >= threshold
        np.fill_diagonal(near, False)
        assert (found.count == near.sum(1)).all()
