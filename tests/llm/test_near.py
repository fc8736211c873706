import random
from itertools import combinations

from lumaveil.llm import near, simhash


def jaccard(a, b, width=5):
    x, y = (set(near.shingles(t, width).tolist()) for t in (a, b))
    return len(x & y) / len(x | y)


def variants(rng, n=40):
    """Pairs of texts at Jaccard 0.8 to 0.95."""
    out = []
    while len(out) < n:
        words = [f"w{rng.randrange(5000)}" for _ in range(rng.randint(80, 300))]
        other = list(words)
        for at in rng.sample(range(len(words)), max(1, len(words) // rng.choice([50, 60, 100]))):
            other[at] = "changed"
        pair = (" ".join(words), " ".join(other))
        if 0.8 <= jaccard(*pair) <= 0.95:
            out.append(pair)
    return out


def test_copies_far_apart_in_bits(spark):
    pairs = variants(random.Random(5))
    far = [p for p in pairs if (simhash.fingerprint(p[0], 5) ^ simhash.fingerprint(p[1], 5)).bit_count() > 5]
    assert len(far) >= 10
    rows = [(2 * i + k, t) for i, p in enumerate(far) for k, t in enumerate(p)]
    got = {r.doc_id for r in near.keep_first(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == set(range(0, 2 * len(far), 2))


def test_not_below_the_similarity(spark):
    words = [f"w{i}" for i in range(100)]
    less = " ".join(w if i % 25 else "x" for i, w in enumerate(words))
    assert jaccard(" ".join(words), less) < 0.8
    rows = [(1, " ".join(words)), (2, less), (3, None), (4, " "), (5, "one"), (6, "One"), (None, "one"), (1, " ".join(words))]
    got = near.keep_first(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id for r in got), key=str) == [1, 2, 3, 5, None]


def test_links_and_blocks(spark):
    rng = random.Random(2)
    words = [f"w{i}" for i in range(200)]
    texts = []
    for i in range(60):
        own = list(words)
        for at in rng.sample(range(200), 4):
            own[at] = f"c{i}"
        texts.append(" ".join(own))
    names, sets = list(range(60)), [near.shingles(t, 5) for t in texts]

    def parts(links):
        root = list(range(60))
        for a, b in links:
            ra, rb = root[a], root[b]
            root = [ra if x == rb else x for x in root]
        return {frozenset(i for i in range(60) if root[i] == r) for r in root}

    want = parts([(a, b) for a, b in combinations(range(60), 2) if jaccard(texts[a], texts[b]) >= 0.8])
    assert parts(near.links_in(names, sets)) == want
    ids = {near.name_of(s): i for i, s in enumerate(sets)}
    docs = spark.createDataFrame(list(enumerate(texts)), "doc long, text string")
    classes = spark.createDataFrame([(near.name_of(s), near.keys(s), i) for i, s in enumerate(sets)], "name long, keys array<long>, doc long")
    for block in (3, 512):
        assert parts([(ids[r.a], ids[r.b]) for r in near.near_links(docs, classes, 5, 0.8, block).collect()]) == want


def test_texts_within_the_radius_share_a_table():
    rng = random.Random(8)
    for _ in range(300):
        fp = rng.getrandbits(64)
        other = fp
        for bit in rng.sample(range(64), rng.randint(0, near.RADIUS)):
            other ^= 1 << bit
        assert set(near.cover_keys(fp)) & set(near.cover_keys(other))
