import random

import numpy as np
import pytest
import xxhash

from lumaveil.llm import simhash as S


def brute_print(text):
    words = "".join(c.lower() if c.isascii() else c for c in text or "").encode().split()
    if not words:
        return 0
    sh = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [b" ".join(words)]
    h = [xxhash.xxh64_intdigest(x, 42) for x in sh]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(rows, radius=2):
    fps = sorted({brute_print(t) for _, t in rows})
    parent = {f: f for f in fps}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(fps):
        for b in fps[:i]:
            if (a ^ b).bit_count() <= radius:
                parent[root(a)] = root(b)
    least = {}
    for d, t in rows:
        r = root(brute_print(t))
        if d is not None:
            least[r] = min(d, least.get(r, d))
    return sorted(((d, f"{brute_print(t):016x}", least.get(root(brute_print(t)))) for d, t in rows), key=str)


def test_cover_meets_every_pair():
    masks = S.cover(2)
    assert len(masks) == 7
    for i in range(64):
        for j in range(64):
            assert any(not (m >> i & 1) and not (m >> j & 1) for m in masks)


def test_against_brute_force(spark):
    rng = random.Random(5)
    vocab = [f"w{i}" for i in range(60)] + ["Ünï", "ABC"]
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "one"), (4, "one"), (5, "one two"), (None, "x y z"), (6, "a b c\x0bd")]
    base = [" ".join(rng.choices(vocab, k=rng.choice([5, 60, 400]))) for _ in range(20)]
    for i in range(120):
        words = rng.choice(base).split()
        for _ in range(rng.randint(0, 2)):
            words[rng.randrange(len(words))] = rng.choice(vocab)
        rows.append((10 + i, " ".join(words)))
    rows.append((500, " ".join(rng.choices(vocab, k=40_000))))
    df = spark.createDataFrame([(d, t, "x") for d, t in rows], "doc_id long, text string, fp string")
    got = sorted(((r.doc_id, r.fingerprint, r.component_id) for r in S.op10(df).collect()), key=str)
    assert got == brute_components(rows)


def test_empty_table(spark):
    assert S.op10(spark.createDataFrame([], "doc_id long, text string")).collect() == []


@pytest.mark.parametrize("bucket", [1, 2, 2048])
def test_hot_bucket(spark, bucket):
    rng = random.Random(1)
    base = rng.getrandbits(64)
    fps = list({base ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 4))) for _ in range(300)} | {rng.getrandbits(64) for _ in range(100)})
    df = spark.createDataFrame([(S._signed(f),) for f in fps], "fp long")
    links = S.near_links(df, 2, bucket).collect()
    assert all(((r.a ^ r.b) & (1 << 64) - 1).bit_count() <= 2 for r in links)

    def parts(pairs):
        p = {f: f for f in fps}

        def root(x):
            while p[x] != x:
                x = p[x]
            return x

        for a, b in pairs:
            p[root(a)] = root(b)
        out = {}
        for f in fps:
            out.setdefault(root(f), set()).add(f)
        return sorted(map(sorted, out.values()))

    m = (1 << 64) - 1
    want = parts([(a, b) for a in fps for b in fps if (a ^ b).bit_count() <= 2])
    assert parts([(r.a & m, r.b & m) for r in links]) == want
    big = np.array([S._signed(f) for f in fps], np.int64)
    assert parts([(a & m, b & m) for a, b in S.near_in(big, 2)]) == want


def test_keep_first(spark):
    text = " ".join(f"w{i}" for i in range(300))
    rows = [(5, text, "a"), (3, text, "b"), (3, text, "b"), (9, text.replace("w150 ", "zz "), "c"), (7, "quite another text of some length here", None), (None, text, "d")]
    df = spark.createDataFrame(rows, "doc_id long, text string, fp string")
    out = S.keep_first(df)
    assert out.columns == df.columns
    assert sorted((r.doc_id for r in out.collect()), key=str) == [3, 7, None]
    rows = [(1, text, "a"), (1, "alpha beta gamma delta epsilon zeta", "b"), (2, "alpha beta gamma delta epsilon zeta", "c"), (2, "one more of another kind altogether", "d")]
    for order in (1, -1):
        out = S.keep_first(spark.createDataFrame(rows[::order], "doc_id long, text string, fp string"))
        assert sorted(r.fp for r in out.collect()) == ["a", "b", "d"]
