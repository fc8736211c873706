import random
import zlib

import numpy as np
import pytest

from lumaveil.llm import toxicity as X


def brute_phi(word):
    """Subsequences of three classes with a start mark, by all triples."""
    s = [63, *(int(X.CLASSES[ord(c) & 0xFFF]) for c in word)]
    out = {}
    for i in range(len(s)):
        for j in range(i + 1, len(s)):
            for k in range(j + 1, len(s)):
                if k - i < X.SPAN:
                    u = s[i] << 12 | s[j] << 6 | s[k]
                    out[u] = out.get(u, 0) + X.DECAY ** (k - i + 1)
    return out


def test_features_and_table_equal_all_triples():
    words = ["idiot", "a", "ab", "éñ.x", "x" * X.WIDE]
    got = X.features(words)
    for w, row in zip(words, got):
        want = brute_phi(w)
        assert row.keys() == want.keys()
        assert all(abs(row[u] * X.SIZES[len(w) + 1] - v) < 1e-9 for u, v in want.items())
    beta = np.random.RandomState(1).normal(size=1 << 18)
    beta[[u for u in range(1 << 18) if u & 63 == 0]] = 0
    m = X.table_margins(words, beta)
    assert np.allclose(m, [sum(beta[u] * v for u, v in row.items()) for row in got])
    k = X.kernel(got, got)
    assert np.linalg.eigvalsh(k).min() > -1e-9


def test_pieces():
    assert "idiot" in X.pieces("you I d i o T !") and "idiot" in X.pieces("i.d.i.o.t")
    long = "a" * 30 + "idiot" + "b" * 30
    assert any("idiot" in p for p in X.pieces(long)) and all(len(p) <= X.WIDE for p in X.pieces(long))
    assert X.pieces("") == [] and X.pieces(" \n") == []


@pytest.fixture(scope="module")
def tables(spark):
    rng = random.Random(7)
    syll = ["ba", "ko", "ri", "men", "tu", "la", "so", "ne", "vi", "dor"]
    word = lambda: "".join(rng.choices(syll, k=rng.randint(1, 4)))
    bad = ["idiot", "scumbag", "worthless", "grxul"]
    docs, labels = [], []
    for i in range(700):
        words = [word() for _ in range(rng.randint(3, 120))]
        toxic = i % 4 == 0
        if toxic:
            for _ in range(rng.randint(1, 4)):
                words.insert(rng.randrange(len(words) + 1), rng.choice(bad) + rng.choice(["", "", "s", "!"]))
        docs.append((i, " ".join(words), 1.0))
        if i < 600:
            labels.append((i, int(toxic)))
    docs += [(1000, None, 0.0), (1001, "", 0.0), (None, "idiot", 0.0), (1002, "la so i.d.i.o.t", 0.0), (1003, "la so i d i o t tu", 0.0), (1004, "so idioot ne", 0.0), (1005, "so ri " * 40_000 + "scumbag", 0.0), (1006, "la la", 0.0), (1006, "la la", 0.0)]
    labels += [(5, None), (None, 1)]
    return spark.createDataFrame(docs, "doc_id long, text string, score double"), spark.createDataFrame(labels, "doc_id long, toxic int")


def test_held_out_accuracy(tables):
    rows = X.op3(*tables).collect()
    assert len(rows) == 709
    ours = [r for r in rows if r.doc_id is not None and r.doc_id < 700]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in ours)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
    held = [r for r in ours if r.held_out]
    assert sum(r.predicted == (r.doc_id % 4 == 0) for r in held) >= 0.97 * len(held)
    odd = {r.doc_id: r.predicted for r in rows if r.doc_id is None or r.doc_id >= 1000}
    assert odd == {None: 1, 1000: 0, 1001: 0, 1002: 1, 1003: 1, 1004: 1, 1005: 1, 1006: 0}


def test_reject_keeps_columns(tables):
    docs, labels = tables
    out = X.reject(docs, labels)
    assert out.columns == docs.columns
    ids = [r.doc_id for r in out.collect()]
    assert 1005 not in ids and ids.count(1006) == 2 and 1000 in ids


def test_without_labels(tables):
    docs, labels = tables
    assert {r.score for r in X.op3(docs, labels.where("toxic = 0")).collect()} == {0.0}
    assert X.op3(docs.limit(0), labels).collect() == []


def test_equal_texts_with_both_labels_and_odd_texts(spark):
    """Reruns agree where equal texts are labelled differently; null, empty and very long texts get a score."""
    rows = [(i, ("you are a damnfool really " if i % 2 else "what a fine morning it is ") + f"w{i % 7} w{i % 11}", "x") for i in range(300)]
    rows += [(1000, None, None), (1001, "", "x"), (1002, "fine morning " * 20000 + "damnfool", "x"), (None, "a", "x")]
    labels = [(i, i % 2) for i in range(300)] + [(0, 1), (1, 0), (None, 1), (5, None)]
    got = []
    for order in (1, -1):
        docs = spark.createDataFrame(rows[::order], "doc_id long, text string, toxicity string").repartition(3)
        marks = spark.createDataFrame(labels[::order], "doc_id long, toxic int")
        got.append(sorted(((r.doc_id, r.score, r.predicted) for r in X.op3(docs, marks).collect()), key=str))
    assert got[0] == got[1] and len(got[0]) == len(rows) and all(0 <= s <= 1 for _, s, _ in got[0])
