import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from lumaveil.llm import packing as P

PATH = public_tokenizers.path("word_bpe_49k.json")


def test_words_equal_the_tokenizer():
    plain = Tokenizer.from_file(PATH)
    rng = random.Random(3)
    texts = ["", " ", "it's WE'LL x'd 12 3½ ²", "Ünï ΣΑΣ e\u0301te\u0301 \u212b", "<|endoftext|> a", "a\x00b \x1c c", "中文 テスト 😀😀!!", "a\u00a0b\u2003c\u0085d", "İstanbul ß ﬁ", "x" * 5000]
    texts += ["".join(rng.choice("abcdeéß'.,!1 \n\tÑñ") for _ in range(rng.randint(1, 300))) for _ in range(300)]
    got = P.tokenizer(PATH).encode(texts)
    assert [np.frombuffer(g, "<u4").tolist() for g in got] == [plain.encode(t, add_special_tokens=False).ids for t in texts]


@given(st.lists(st.integers(1, 64), max_size=60))
@settings(max_examples=200, deadline=None)
def test_windows_hold_each_once(lengths):
    windows = P.fill_windows(lengths, 64)
    assert sorted(i for w in windows for i in w) == list(range(len(lengths)))
    assert all(sum(lengths[i] for i in w) <= 64 for w in windows)


@given(st.dictionaries(st.integers(1, 20), st.integers(1, 3), max_size=6), st.integers(0, 40))
@settings(max_examples=200, deadline=None)
def test_fill_is_the_best(counts, room):
    sums = {0}
    for n, c in counts.items():
        sums = {s + n * k for s in sums for k in range(c + 1)}
    taken = P.best_fill(counts, sorted(counts, reverse=True), room)
    assert all(k <= counts[n] for n, k in taken.items())
    assert sum(n * k for n, k in taken.items()) == max(s for s in sums if s <= room)


def whole(rows, texts, capacity):
    """Every id in one piece; sequences without gaps; the share of padding."""
    plain = Tokenizer.from_file(PATH)
    ids = {d: plain.encode(t or "", add_special_tokens=False).ids + [1] for d, t in texts.items()}
    pieces, seqs = defaultdict(list), defaultdict(list)
    for r in rows:
        part = ids[r.doc_id][r.start : r.start + r.length]
        assert r.length == len(part) and r.ids_crc32 == zlib.crc32(np.array(part, "<u4").tobytes()) and r.doc_tokens == len(ids[r.doc_id])
        pieces[r.doc_id].append((r.start, r.length))
        seqs[r.sequence_id].append((r.offset, r.length))
    for d in ids:
        at = 0
        for s, n in sorted(pieces[d]):
            assert s == at and n > 0
            at += n
        assert at == len(ids[d])
    padding = 0
    for s in seqs.values():
        at = 0
        for o, n in sorted(s):
            assert o == at
            at += n
        assert at <= capacity
        padding += 0 if at & (at - 1) == 0 else capacity - at
    return padding / sum(map(len, ids.values()))


def test_round_trip(spark):
    rng = random.Random(2)
    texts = {i: " ".join(rng.choice(["alpha", "beta", "Straße", "x9"]) for _ in range(rng.choice([1, 30, 500, 3000]))) for i in range(200)}
    texts |= {900: None, 901: "", 902: "long " * 30_000}
    df = spark.createDataFrame([(d, t, 5) for d, t in texts.items()], "doc_id long, text string, start int")
    assert whole(P.op1(df).collect(), texts, 2048) < 0.002
    again = P.pack(df, PATH, 2048)
    assert sorted(P.op1(df).collect()) == sorted(again.drop("ids").collect())
    assert all(len(r.ids) == r.length for r in again.collect())


def test_small_pool():
    rng = random.Random(1)
    p = P.Packer(64, 0, pool=10)
    total = 0
    for d in range(300):
        n = rng.choice([1, 40, 40, 63, 200])
        total += n
        p.add(d, np.arange(n, dtype="<u4").tobytes())
    p.finish()
    assert sum(r[2] for r in p.rows) == total and not p.pool


def test_repeats_nulls_and_empty(spark):
    df = spark.createDataFrame([(1, "a b"), (1, "a b"), (None, "c")], "doc_id long, text string")
    assert sum(r.length for r in P.op1(df).collect()) == 8
    assert P.op1(df.where("false")).collect() == []


def test_ids_of_all_of_unicode():
    """Texts drawn from all planes, and each tested character in several places, get the tokenizer's own ids."""
    import random

    import public_tokenizers
    from tokenizers import Tokenizer

    from lumaveil.llm import packing as P

    path = public_tokenizers.path("word_bpe_49k.json")
    own, plain = P.WordBpe(path), Tokenizer.from_file(path)
    rng = random.Random(7)
    any_char = lambda: chr(rng.choice([rng.randrange(1, 0x250), rng.randrange(0x250, 0xD800), rng.randrange(0xE000, 0x11000), rng.randrange(0x10000, 0x110000)]))
    texts = ["".join(any_char() if rng.random() < 0.5 else rng.choice("aB1 '.,s\n") for _ in range(rng.randint(1, 20))) for _ in range(4000)]
    texts += ["'\u0558", "a\u209f", "x\u1ac5y", "e\u0301", "\u1100\u1161", "\ufb01", "\u03a3\u03a3"]
    for a, b in own.TESTED:
        step = max(1, (b - a) // 400)
        texts += [f.format(chr(c)) for c in range(a, b + 1, step) for f in ("{0}", "a{0}", "'{0}1", "{0}{0} b")]
    got = own.encode(texts)
    want = [np.array(e.ids, "<u4").tobytes() for e in plain.encode_batch(texts, add_special_tokens=False)]
    assert [t for t, x, y in zip(texts, got, want) if x != y] == []
