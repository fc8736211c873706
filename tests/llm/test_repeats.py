import hashlib
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lumaveil.llm import repeats, substring, suffix_dedup, windows
from lumaveil.llm import suffixes
from lumaveil.llm.suffixes import suffix_array, suffix_arrays

LAST = 1 << 63


@given(st.lists(st.integers(0, 3), max_size=60))
@settings(max_examples=500, deadline=None)
def test_suffix_array(text):
    assert suffix_array(text) == sorted(range(len(text)), key=lambda i: text[i:])


@given(st.lists(st.lists(st.integers(0, 3), max_size=40), max_size=12), st.sampled_from([1, 3, 1 << 14]))
@settings(max_examples=400, deadline=None)
def test_suffix_arrays_side_by_side(strings, few):
    bounds = np.concatenate([[0], np.cumsum([len(s) for s in strings])]).astype(np.int64)
    was, suffixes.FEW = suffixes.FEW, few
    try:
        got = suffix_arrays(np.array([x for s in strings for x in s], np.int64), bounds)
    finally:
        suffixes.FEW = was
    for a, b, s in zip(bounds, bounds[1:], strings):
        assert (got[a:b] - a).tolist() == sorted(range(len(s)), key=lambda i: s[i:])


@given(st.binary(max_size=80), st.integers(1, 12), st.data())
@settings(max_examples=200, deadline=None)
def test_segments_hold_each_window_once(raw, width, data):
    k = data.draw(st.integers(1, width))
    cut = data.draw(st.integers(0, len(raw)))
    u = windows.BYTE_VALUES[np.frombuffer(raw, np.uint8)]
    doc, first, n, h, s, sums = windows.segments(u, np.array([0, cut, len(raw)]), width, k)
    got = [p for f, m in zip(first, n) for p in range(f, f + m)]
    want = [p for a, b in ((0, cut), (cut, len(raw))) for p in range(a, b - width + 1)]
    assert got == want
    anchors = {}
    for f, m, x in zip(first, n, h):
        for p in range(f, f + m):
            anchors.setdefault(raw[p : p + width], set()).add(int(x))
    assert all(len(v) == 1 for v in anchors.values())


def passages(rng, rows, piece, join):
    shared = [piece(rng.randint(20, 60)) for _ in range(6)]
    out = []
    for i in range(rows):
        parts = []
        for _ in range(rng.randint(0, 5)):
            parts += piece(rng.randint(0, 30)) if rng.random() < 0.5 else rng.choice(shared)[rng.randint(0, 10) :]
        out.append([i, join(parts)])
    return out


def brute_words(rows, width=13):
    first = {}
    texts = [(d, (t or "").encode().split()) for d, t in rows]
    for d, w in texts:
        for p in range(len(w) - width + 1):
            k = tuple(w[p : p + width])
            first[k] = min(first.get(k, LAST), LAST if d is None else d)
    out = []
    for d, w in texts:
        gone = set()
        for p in range(len(w) - width + 1):
            if d is not None and first[tuple(w[p : p + width])] < d:
                gone.update(range(p, p + width))
        kept = b" ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((d, len(w), len(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def brute_bytes(rows, width=100):
    texts = [(d, (t or "").encode()) for d, t in rows]

    def places(some):
        first = {}
        for d, b in some:
            for p in range(len(b) - width + 1):
                k = b[p : p + width]
                first[k] = min(first.get(k, (LAST, 0)), (d or 0, p))
        return first

    every = places([x for x in texts if x[0] is not None])
    out = []
    for d, b in texts:
        first = places([(d, b)]) if d is None else every
        gone = np.zeros(len(b) + 1, bool)
        for p in range(len(b) - width + 1):
            if first[b[p : p + width]] < (d or 0, p):
                gone[p : p + width] = True
        spans = int(np.count_nonzero(gone[:-1] & ~np.concatenate([[False], gone[:-2]]))) if len(b) else 0
        out.append((d, len(b), int(gone.sum()), spans, hashlib.sha256(bytes(x for x, g in zip(b, gone) if not g)).hexdigest()))
    return sorted(out, key=str)


def corpus(seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abé") for _ in range(rng.randint(1, 6)))
    rows = passages(rng, 120, lambda n: [word() for _ in range(n)], lambda w: rng.choice([" ", "\n"]).join(w))
    hot = " ".join(word() for _ in range(80))
    rows += [[200 + i, hot] for i in range(40)] + [[300 + i, word() + " " + hot + " " + word()] for i in range(40)]
    rows += [[400, "x " * 300], [401, "x " * 200], [402, "ab" * 400], [403, "ab" * 300 + "c"]]
    rows += [[None, hot + " " + hot], [(1 << 63) - 1, hot + " no"], [-5, "x " * 90], [None, hot], [None, None], [500, None], [501, ""], [7, rows[7][1]], [7, hot + " end"], [502, "b"]]
    rng.shuffle(rows)
    return [tuple(r) for r in rows]


@pytest.mark.parametrize("hot, batch", [(5_000, 1 << 21), (3, 1 << 21), (5_000, 1500), (3, 1500)])
def test_against_brute_force(spark, monkeypatch, hot, batch):
    rows = corpus(hot)
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, start int").repartition(5)
    monkeypatch.setattr(repeats, "BATCH", batch)
    got = substring._results(df, repeats.BUCKET, hot, True).collect()
    assert sorted(map(tuple, got), key=str) == brute_words(rows)
    got = suffix_dedup._results(df, repeats.BUCKET, hot, True).collect()
    assert sorted(map(tuple, got), key=str) == brute_bytes(rows)


def test_nothing_is_removed_but_by_the_method(spark):
    """With the method's findings taken away, hashes alone remove nothing."""
    df = spark.createDataFrame([r for r in corpus(1) if r[0] is not None], "doc_id long, text string").repartition(5)
    for units in (substring.UNITS, suffix_dedup.UNITS):
        none = lambda contents, counts, of, doc, at: (np.zeros(0, np.int64),) * 3
        local = lambda block, units: np.zeros(max(0, len(block.exact) - units.width + 1), bool)
        assert all(not r.ranges for r in repeats.find(df, units, local, none).collect())


def thue_morse(n):
    return "".join("ab"[i.bit_count() % 2] for i in range(n))


def test_words_that_weak_sums_confuse(spark):
    one = thue_morse(1024)
    other = one.translate(str.maketrans("ab", "ba"))
    tail = " ".join(f"w{i}" for i in range(12))
    rows = [(1, f"{one} {tail}"), (2, f"{other} {tail}"), (3, f"{one} {tail}"), (4, one * 2), (5, other * 2)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert sorted(map(tuple, substring.op5(df).collect()), key=str) == brute_words(rows)
    assert {r.doc_id: r.n_removed for r in substring.op5(df).collect()} == {1: 0, 2: 0, 3: 13, 4: 0, 5: 0}
    assert sorted(map(tuple, suffix_dedup.op8(df).collect()), key=str) == brute_bytes(rows)


def test_long_text_in_parts(spark, monkeypatch):
    monkeypatch.setattr(repeats, "BATCH", 700)
    rng = random.Random(3)
    rows = [(1, " ".join(rng.choice(["aa", "b", "cde"]) for _ in range(3000))), (2, "q " * 10), (3, "r " * 2000)]
    rows.append((4, rows[0][1][500:4000]))
    rows.append((5, "z" * 5000))
    for u in (substring.UNITS, suffix_dedup.UNITS):
        blocks = list(repeats.blocks_of(((d, t.encode()) for d, t in rows), u))
        assert max(len(b.exact) for b in blocks) < 4000
        seen = sorted((int(b.docs[d]), int(f - b.bounds[d] + b.bases[d]) + j) for b in blocks for d, f, n in zip(b.d, b.first, b.n) for j in range(n))
        sizes = [(d, len(t.encode().split()) if u.words else len(t)) for d, t in rows]
        assert seen == [(d, p) for d, n in sizes for p in range(n - u.width + 1)]
    df = spark.createDataFrame([*rows, (None, rows[0][1] * 2)], "doc_id long, text string")
    rows.append((None, rows[0][1] * 2))
    assert sorted(map(tuple, substring.op5(df).collect()), key=str) == brute_words(rows)
    assert sorted(map(tuple, suffix_dedup.op8(df).collect()), key=str) == brute_bytes(rows)


def test_many_rows_without_an_id(spark):
    import time

    text = " ".join(f"w{i}" for i in range(60))
    df = spark.createDataFrame([(None, f"{text} {i}") for i in range(4000)], "doc_id long, text string")
    began = time.time()
    assert all(r.n_removed == 0 and r.doc_id is None for r in substring.op5(df).collect())
    assert all(r.n_removed == 0 for r in suffix_dedup.op8(df).collect())
    assert time.time() - began < 120


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert substring.op5(df).collect() == [] and suffix_dedup.op8(df).collect() == []


def test_table_cut_anew_between_jobs(spark, tmp_path, monkeypatch):
    """A copy that the first job meets in its original's batch is found though later jobs see them in different batches."""
    import os

    import pandas as pd
    from pyspark import TaskContext

    flag, text = str(tmp_path / "apart"), " ".join(f"w{i}" for i in range(400))

    def rows(frames):
        for _ in frames:
            pass
        here = TaskContext.get().partitionId()
        docs = [here + 1] if os.path.exists(flag) else [1, 2] if here == 0 else []
        if docs:
            yield pd.DataFrame({"doc_id": docs, "text": [text] * len(docs)})

    write = repeats.written

    def written(df):
        out = write(df)
        open(flag, "w").close()
        return out

    monkeypatch.setattr(repeats, "written", written)
    for m, local, method in ((substring, substring.parse_block, substring.parse), (suffix_dedup, suffix_dedup.in_block, suffix_dedup.decide)):
        units = m.UNITS
        if os.path.exists(flag):
            os.remove(flag)
        docs = spark.range(0, 2, 1, 2).mapInPandas(rows, "doc_id long, text string")
        found = {r.doc: r.ranges for r in repeats.find(docs, units, local, method).collect()}
        assert not found[1] and sum(r.stop - r.start for r in found[2]) >= 400
