"""SimHash near-dedup for a stage that needs near copies at a Jaccard similarity of AT_LEAST, not at a few bits.

Documents meet under the keys of operator 10: the covering tables of RADIUS bits over SimHash fingerprints of their
shingles, so that every pair within RADIUS bits meets. At a similarity of 0.8 a pair differs in about 10 of 64 bits,
for which a cover would take 2,047 tables; so they also meet under BANDS MinHash keys, each of ROWS minima of the set.
A pair at Jaccard s shares one of those with probability 1 - (1 - s^ROWS)^BANDS, 0.99997 at 0.8; that is the only place
where a pair can be missed. What meets is compared by its whole sets, and only pairs at AT_LEAST and more are linked.

Equal sets are one class and compared once. Keys under which the same classes meet are one bucket. A bucket of over
BLOCK classes is dealt to blocks, each pair of which is one group, so that no task holds a large bucket.

Defined cases: a null text is the empty text; texts without words are copies of one another; fewer words than a shingle
give one shingle of them all; rows with a null doc_id stay and link nothing; rows that share a doc_id but not a text are
compared like others; of repeated rows of a document kept the one whose JSON is least stays; very long texts are whole
sets; an empty table gives no rows; other columns are kept.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, small_batches, text_of, written
from .simhash import cover, fingerprint_of, shingle_hashes

AT_LEAST = 0.8
BANDS, ROWS = 26, 5
RADIUS = 2
#: Classes of a bucket compared in one task; shingles whose minima are taken at once.
BLOCK, CHUNK = 512, 2048

_RANDOM = np.random.default_rng(42)
_TURN = _RANDOM.integers(0, 1 << 64, (BANDS * ROWS, 1), np.uint64)
_TIMES = _RANDOM.integers(0, 1 << 64, (BANDS * ROWS, 1), np.uint64) | np.uint64(1)


def shingles(text: str, width: int) -> np.ndarray:
    """The set of a text's shingles, as hashes in order."""
    return np.unique(shingle_hashes(text, width))


def name_of(s: np.ndarray) -> int:
    """What equal sets share, signed."""
    return int(np.array(xxhash.xxh3_64_intdigest(s.tobytes()), np.uint64).view(np.int64))


COVER = cover(RADIUS)


def cover_keys(fp: int) -> list[int]:
    """A key for each covering table, signed."""
    return np.array([xxhash.xxh3_64_intdigest((fp & kept).to_bytes(8, "little"), BANDS + i) for i, kept in enumerate(COVER)], np.uint64).view(np.int64).tolist()


def keys(s: np.ndarray) -> list[int]:
    """A key for each band, signed; none for the empty set."""
    if not len(s):
        return []
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(s), CHUNK):
        np.minimum(least, ((s[at : at + CHUNK] ^ _TURN) * _TIMES).min(axis=1), out=least)
    bands = least.reshape(BANDS, ROWS)
    return np.array([xxhash.xxh3_64_intdigest(b.tobytes(), i) for i, b in enumerate(bands)], np.uint64).view(np.int64).tolist()


def links_in(names: list[int], sets: list[np.ndarray], at_least: float = AT_LEAST) -> list[tuple[int, int]]:
    """Links that join what is connected by pairs at `at_least` or more: at most len(names) - 1."""
    sizes = np.array([len(s) for s in sets], np.int64)
    owner, every = np.repeat(np.arange(len(sets)), sizes), np.concatenate(sets)
    order = np.argsort(every, kind="stable")
    every, owner = every[order], owner[order]
    left = np.ones(len(sets), bool)
    links = []
    for first in range(len(sets)):
        if not left[first]:
            continue
        left[first] = False
        todo = [first]
        while todo and left.any():
            a = todo.pop()
            low, high = np.searchsorted(every, sets[a]), np.searchsorted(every, sets[a], "right")
            hits = np.repeat(low - np.cumsum(high - low) + (high - low), high - low) + np.arange((high - low).sum())
            both = np.bincount(owner[hits], minlength=len(sets))
            near = np.flatnonzero(left & (both >= at_least * (sizes + sizes[a] - both) - 1e-9))
            left[near] = False
            links += [(names[a], names[b]) for b in near.tolist()]
            todo += near.tolist()
    return links


def near_links(texts: DataFrame, classes: DataFrame, width: int, at_least: float, block: int = BLOCK) -> DataFrame:
    """Links (a, b) between classes (name, keys, doc: one that has it) that join all pairs at `at_least` or more."""
    met = classes.select("name", F.explode("keys").alias("key")).groupBy("key").agg(F.collect_set("name").alias("names"))
    met = written(met.where(F.size("names") > 1).select(F.array_sort("names").alias("names")).distinct())
    met = met.withColumn("bucket", F.xxhash64("names")).withColumn("blocks", F.ceil(F.size("names") / block).cast("int"))
    met = met.select("bucket", "blocks", F.explode("names").alias("name")).withColumn("own", F.pmod(F.hash("name"), F.col("blocks")))
    met = met.select("bucket", "name", "own", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    met = met.select("bucket", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "name")

    def sets_of(frames):
        for f in frames:
            s = [shingles(t, width) for t in f["text"]]
            yield pd.DataFrame({"name": [name_of(x) for x in s], "hashes": [x.tobytes() for x in s]})

    wanted = met.select("name").distinct()
    docs = texts.join(classes.join(wanted, "name", "left_semi").select("doc").distinct(), "doc", "left_semi")
    sets = written(docs.select("text").mapInPandas(sets_of, "name long, hashes binary").dropDuplicates(["name"]))

    def compared(frame: pd.DataFrame) -> pd.DataFrame:
        found = links_in(frame["name"].tolist(), [np.frombuffer(h, np.uint64) for h in frame["hashes"]], at_least)
        return pd.DataFrame(found, columns=["a", "b"]).astype("int64")

    return met.join(sets, "name").groupBy("bucket", "i", "j").applyInPandas(compared, "a long, b long").distinct()


def keep_first(docs: DataFrame, width: int = 5, at_least: float = AT_LEAST) -> DataFrame:
    """docs with one document of each group of near copies, that of the smallest doc_id."""
    small_batches(docs.sparkSession)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc"), text_of().alias("text")).where("doc is not null")

    def signed(frames):
        for f in frames:
            hashes = [shingle_hashes(t, width) for t in f["text"]]
            s = [np.unique(h) for h in hashes]
            found = [keys(x) + cover_keys(fingerprint_of(h)) for x, h in zip(s, hashes)]
            yield pd.DataFrame({"doc": f["doc"], "own": f["own"], "name": [name_of(x) for x in s], "keys": found})

    rows = written(texts.withColumn("own", F.xxhash64("text")).mapInPandas(signed, "doc long, own long, name long, keys array<long>"))
    classes = rows.groupBy("name").agg(F.min("doc").alias("doc"), F.min("keys").alias("keys"))
    parts = components(near_links(texts, classes, width, at_least))
    named = rows.groupBy("name").agg(F.min(F.struct("doc", "own")).alias("least")).join(parts.withColumnRenamed("node", "name"), "name", "left")
    first = named.groupBy(F.coalesce("component", "name")).agg(F.min("least").alias("least"))
    kept = written(first.select("least.doc", "least.own"))  # a document's id and its text, as an id may have several
    counts = rows.join(kept, ["doc", "own"], "left_semi").groupBy("doc", "own").agg(F.count("*").alias("n"))
    several = written(counts.where("n > 1").select("doc", "own"))
    whole = docs.select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("doc"), F.xxhash64(text_of()).alias("own"))
    once = whole.join(kept, ["doc", "own"], "left_semi").join(several, ["doc", "own"], "left_anti").select("row")
    once = once.unionAll(whole.where("doc is null").select("row"))
    if not several.isEmpty():
        same = whole.join(several, ["doc", "own"], "left_semi").groupBy("doc", "own").agg(F.min_by("row", F.to_json("row")).alias("row"))
        once = once.unionAll(same.select("row"))
    return once.select("row.*")
