import math
import random
import re
from collections import defaultdict

import pytest

from lumaveil.llm import mixing as M


def brute_targets(sizes):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    left, open_, out = 1.5 * sum(sizes.values()), set(names), {}
    while open_:
        level = left / sum(weight[s] for s in open_)
        over = {s for s in open_ if level * weight[s] > 2 * sizes[s] + 1e-9}
        if not over:
            return out | {s: level * weight[s] for s in open_}
        for s in over:
            out[s] = 2.0 * sizes[s]
            left -= out[s]
        open_ -= over
    return out


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(4)
    out = []
    for i in range(900):
        source = rng.choice(["hot"] * 8 + ["a", "B", "é", "z", "", None, "q", "r"])
        n = 4000 if i % 250 == 0 else rng.randint(0, 200)
        out.append((i, rng.choice([" ", "\n", "  "]).join(["w"] * n) if n or i % 2 else None, source, 7))
    out += [(5000, "same words here", "a", 1)] * 40 + [(None, "x y", "B", 1), (6000, "", "void", 1), (6001, None, "void", 0)]
    return out


def test_against_brute_force(spark, rows):
    got = M.op7(spark.createDataFrame(rows, "doc_id long, text string, source string, size int")).collect()
    size = lambda t: len(re.findall("[^ \t-\r]+", t or ""))
    sizes = defaultdict(int)
    for _, t, s, _ in rows:
        sizes[s] += size(t)
    want = brute_targets(sizes)
    of = {d: (size(t), s) for d, t, s, _ in rows}
    assert sorted(map(str, (r.doc_id for r in got))) == sorted(str(r[0]) for r in rows)
    total = defaultdict(int)
    for r in got:
        n, s = of[r.doc_id]
        assert r["size"] == n and r.source_size == sizes[s] and abs(r.target - want[s]) < 1e-6 * max(1, want[s])
        assert 0 <= r.taken <= 2 * n
        total[s] += r.taken
    for s in sizes:
        assert abs(total[s] - want[s]) <= 25, s
    assert sorted(got, key=str) == sorted(M.op7(spark.createDataFrame(rows[::-1], "doc_id long, text string, source string, size int")).collect(), key=str)


def test_mix_keeps_columns(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, rate int")
    out = M.mix(df)
    assert out.columns == df.columns
    counts = defaultdict(int)
    for r in out.collect():
        counts[r.doc_id] += 1
    assert max(v for k, v in counts.items() if k != 5000) <= 2


def test_one_source_and_none(spark):
    got = M.op7(spark.createDataFrame([(1, "a b", None), (2, "c d", None)], "doc_id long, text string, source string")).collect()
    assert {r.target for r in got} == {6.0} and sum(r.taken for r in got) in (5, 6, 7)
    assert M.op7(spark.createDataFrame([], "doc_id long, text string, source string")).collect() == []


def test_multipliers_against_bisection(spark, rows):
    """The rates are those of the dual's optimum, found for each source by halving; words of a source meet its target."""
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, size int")
    got = M.taken(docs).select("_row.source", "size", "target", "rate", "whole", "taken").collect()
    by = defaultdict(list)
    for r in got:
        by[r.source].append(r)
    tilted = 0
    for rs in by.values():
        n, target = [r["size"] for r in rs], rs[0].target
        mass = lambda l: sum(k * (2.0 if l * k >= math.log(2) else math.exp(l * k)) for k in n)  # noqa: E731, B023
        if not sum(n):
            continue
        low, high = -20.0, 1.0
        for _ in range(200):
            mid = (low + high) / 2
            low, high = (mid, high) if mass(mid) < target else (low, mid)
        for r in rs:
            want = 2.0 if high * r["size"] >= math.log(2) else math.exp(high * r["size"])
            assert abs(r.rate - want) < 1e-4, (r, want)
            assert r["size"] == 0 or r["size"] * math.floor(r.rate) <= r.taken <= r["size"] * math.ceil(r.rate)
            tilted += 0.01 < r.rate < 1.99 and abs(r.rate - 1) > 0.01
    assert tilted > 200 and len({r.rate for r in got}) > 50


def test_targets_against_sql(spark, rows):
    import duckdb

    t = M.targets(spark.createDataFrame([(f"s{i:02d}", i * i % 17 * 10) for i in range(40)] + [(None, 50)], "source string, source_size long"))
    got = {r.source: r.target for r in t.collect()}
    want = brute_targets({f"s{i:02d}": i * i % 17 * 10 for i in range(40)} | {None: 50})
    assert got.keys() == want.keys() and all(abs(got[s] - want[s]) < 1e-6 for s in got)
    ranks = M.ranked(spark.createDataFrame([("b",), ("B",), (None,), ("é",), ("",)], "source string"))
    assert [r.source for r in ranks.orderBy("rank").collect()] == [r[0] for r in duckdb.sql("select * from (values ('b'), ('B'), (null), ('é'), ('')) t(s) order by s nulls last").fetchall()]


def test_target_rounds_to_the_whole_source(spark):
    rows = [(i, "w " * 10, "a") for i in range(10)] + [(10, "w", "a")] + [(20 + i, "w " * 10, "b") for i in range(10)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {r.doc_id: r for r in M.op7(df).collect()}
    assert got[20].target == 99.5 and all(got[20 + i].taken == 10 for i in range(10))
    assert sum(r.taken for r in got.values()) == 302
    assert sum(r.source == "b" for r in M.mix(df).collect()) == 10


def test_a_source_far_below_its_size(spark):
    """Weights 3, 1 and 2 leave little to a large source of one very long text and many short ones."""
    rows = [(i, "w " * 5, "b") for i in range(400)] + [(400, "w " * 20000, "b")] + [(500 + i, "w " * 900, s) for i in range(9) for s in "ac"]
    got = M.taken(spark.createDataFrame(rows, "doc_id long, text string, source string")).where("_row.source = 'b'").collect()
    target = got[0].target
    assert abs(sum(r["size"] * r.rate for r in got) - target) < 1e-6 * target and abs(sum(r.taken for r in got) - target) <= 5
