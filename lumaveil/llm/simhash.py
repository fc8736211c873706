"""SimHash near-duplicates by covering locality-sensitive hashing.

A document's fingerprint has bit b set if over half of its word-shingle hashes have it set. Bit i gets the
code 1 + i mod (2^(r+1) - 1), a non-zero vector of r+1 components over GF(2), and the table of a non-zero
vector v keeps bit i if <code(i), v> = 1. For any r bits some v is orthogonal to all their codes, so a pair that
differs in at most r bits agrees on all that this table keeps: every such pair meets, whatever the data.

Only distinct fingerprints are compared. A bucket gives links that join its connected parts (never all pairs).
A bucket of over BUCKET fingerprints is dealt again by r+1 segments of the bits that its table drops: at a distance
of at most r some segment agrees, and what shares that many bits is few; there, at r <= 2, a fingerprint's neighbours
are looked up by turning bits over.

Defined cases: a null text is the empty text; no words give fingerprint zero, linked like any other; fewer words
than a shingle give one shingle of them all; rows with a null doc_id are kept and count in no minimum; repeated
rows come back as often as they came in; very long texts are read whole; other columns are ignored; an empty table gives
no rows.
"""

from __future__ import annotations

from itertools import repeat

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import components, small_batches, text_of, written

SEED = 42
#: Fingerprints compared by blocks in one task; larger buckets are dealt again.
BUCKET = 2048


def _lanes() -> np.ndarray:
    """For each byte, its 8 bits as the 8 byte lanes of a 64-bit word."""
    bits = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little")
    return np.ascontiguousarray(bits).view(np.uint64).ravel()


LANES = _lanes()


def shingle_hashes(text: str, width: int) -> np.ndarray:
    words = text.encode("utf-8", "surrogatepass").lower().split()  # on bytes: A-Z, and ASCII white space
    if not words:
        return np.zeros(0, np.uint64)
    if len(words) <= width:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), SEED)], np.uint64)
    joined = b" ".join(words)
    ends = (np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1).tolist()
    starts = [0, *[x + 1 for x in ends[: -width]]]
    n = len(words) - width + 1
    pieces = [joined[a:b] for a, b in zip(starts, ends[width - 1 :])]
    return np.fromiter(map(xxhash.xxh64_intdigest, pieces, repeat(SEED, n)), np.uint64, n)


def fingerprint(text: str, width: int = 3) -> int:
    """Unsigned 64-bit fingerprint of one text."""
    return fingerprint_of(shingle_hashes(text or "", width))


def fingerprint_of(h: np.ndarray) -> int:
    """Unsigned 64-bit fingerprint of shingle hashes, repeats included."""
    if not len(h):
        return 0
    octets = h.astype("<u8", copy=False).view(np.uint8).reshape(-1, 8)
    counts = np.zeros(64, np.int64)
    for at in range(0, len(octets), 255 * 64):
        part = LANES[octets[at : at + 255 * 64]]
        sums = np.add.reduceat(part, np.arange(0, len(part), 255), axis=0)  # lanes hold up to 255
        counts += sums.view(np.uint8).reshape(len(sums), 64).sum(axis=0, dtype=np.int64)
    bits = (2 * counts > len(h)).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view("<u8")[0])


def fingerprint_udf(width: int):
    @F.pandas_udf(T.LongType())
    def fingerprints(texts: pd.Series) -> pd.Series:
        return pd.Series(np.array([fingerprint(t, width) for t in texts], np.uint64).view(np.int64))

    return fingerprints


def cover(radius: int) -> list[int]:
    """The bits kept by each table, as unsigned masks."""
    codes = [1 + i % (2 ** (radius + 1) - 1) for i in range(64)]
    return [sum(1 << i for i, c in enumerate(codes) if (c & v).bit_count() % 2) for v in range(1, 2 ** (radius + 1))]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def _segments(mask: int, parts: int) -> list[int]:
    free = [i for i in range(64) if not mask >> i & 1]
    return [sum(1 << i for i in free[k::parts]) for k in range(parts)]


def near_in(fps: np.ndarray, radius: int, free: int | None = None) -> list[tuple[int, int]]:
    """Links that join what is connected at distance <= radius within a bucket: at most len(fps) - 1."""
    fps = np.unique(fps)
    n = len(fps)
    u = fps.view(np.uint64)
    flips = None
    if n > BUCKET and free is not None and radius <= 2:
        bits = [np.uint64(1 << i) for i in range(64) if free >> i & 1]
        flips = [a | b for a in [np.uint64(0), *bits] for b in bits if radius == 2 or not a]
        flips = np.unique(np.array(flips, np.uint64))
        order = np.argsort(u)
        ranked = u[order]
    left = np.ones(n, bool)
    links = []
    for first in range(n):
        if not left[first]:
            continue
        left[first] = False
        todo = [first]
        while todo:
            a = todo.pop()
            if flips is None:
                near = np.flatnonzero(left & (np.bitwise_count(u ^ u[a]) <= radius))
            else:
                wanted = flips ^ u[a]
                at = np.minimum(np.searchsorted(ranked, wanted), n - 1)
                near = order[at[ranked[at] == wanted]]
                near = near[left[near]]
            left[near] = False
            links += [(int(fps[a]), int(fps[b])) for b in near]
            todo += near.tolist()
    return links


LINKS = T.ArrayType(T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType())]))


def links_udf(radius: int, tables: list[int]):
    @F.pandas_udf(LINKS)
    def links(kept: pd.Series, fps: pd.Series) -> pd.Series:
        out = []
        for k, x in zip(kept, fps):
            free = ~k & (1 << 64) - 1
            out.append([{"a": a, "b": b} for a, b in near_in(np.asarray(x, np.int64), radius, free)])
        return pd.Series(out)

    return links


def near_links(classes: DataFrame, radius: int, bucket: int = BUCKET) -> DataFrame:
    """Links (a, b) between distinct fingerprints (column fp) that join all within the radius."""
    masks = cover(radius)
    parts = radius + 1
    keyed = classes.select(
        "fp",
        F.explode(F.array(*[F.struct(F.lit(_signed(m)).alias("kept"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("key")) for m in masks])).alias("t"),
    ).select("t.kept", "t.key", "fp")
    sizes = keyed.groupBy("kept", "key").agg(F.count("*").alias("n")).where("n > 1")
    met = written(keyed.join(sizes, ["kept", "key"]))
    small = met.where(F.col("n") <= bucket).groupBy("kept", "key").agg(F.collect_list("fp").alias("fps")).select("kept", "fps")
    # over-full buckets: some segment of the dropped bits agrees as well
    again = F.lit(None).cast("array<struct<kept:bigint,key:bigint>>")
    for m in masks:
        wider = [m | s for s in _segments(m, parts)]
        again = F.when(
            F.col("kept") == F.lit(_signed(m)),
            F.array(*[F.struct(F.lit(_signed(w)).alias("kept"), F.col("fp").bitwiseAND(F.lit(_signed(w))).alias("key")) for w in wider]),
        ).otherwise(again)
    large = (
        met.where(F.col("n") > bucket)
        .select("fp", F.explode(again).alias("t"))
        .groupBy("t.kept", "t.key")
        .agg(F.collect_set("fp").alias("fps"))
        .where(F.size("fps") > 1)
        .select("kept", "fps")
    )
    links = links_udf(radius, masks)
    return small.unionAll(large).select(F.explode(links("kept", "fps")).alias("l")).select("l.a", "l.b").distinct()


def grouped(docs: DataFrame, width: int, radius: int) -> tuple[DataFrame, DataFrame]:
    """(doc_id, fp) of every row, and (fp, component) of every fingerprint; component is a fingerprint of the group."""
    small_batches(docs.sparkSession)
    prints = written(docs.select(F.col("doc_id").cast("long").alias("doc_id"), fingerprint_udf(width)(text_of()).alias("fp")))
    classes = written(prints.select("fp").distinct())
    parts = components(near_links(classes, radius))
    return prints, classes.join(parts.withColumnRenamed("node", "fp"), "fp", "left").select("fp", F.coalesce("component", "fp").alias("component"))


def near_duplicates(docs: DataFrame, width: int = 3, radius: int = 2) -> DataFrame:
    """(doc_id, fp, component_id) for every row of docs: links at Hamming distance <= radius."""
    prints, parts = grouped(docs, width, radius)
    named = prints.groupBy("fp").agg(F.min("doc_id").alias("least")).join(parts, "fp")
    first = named.groupBy("component").agg(F.min("least").alias("component_id"))
    of = named.join(first, "component").select("fp", "component_id")
    return prints.join(of, "fp", "left").select("doc_id", "fp", "component_id")


def keep_first(docs: DataFrame, width: int = 5, radius: int = 5) -> DataFrame:
    """docs with one document of each group, that of the smallest doc_id; of repeated rows with it that of the least JSON.

    Links at `radius` bits mean an estimated cosine of shingle sets of cos(pi radius / 64) or more. Rows that share a
    doc_id but not a fingerprint are documents of their own; rows with a null doc_id stay.
    """
    prints, parts = grouped(docs, width, radius)
    known = prints.where("doc_id is not null").groupBy("fp").agg(F.min("doc_id").alias("doc_id")).join(parts, "fp")
    kept = written(known.groupBy("component").agg(F.min(F.struct("doc_id", "fp")).alias("k")).select("k.doc_id", "k.fp"))
    rows = docs.select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("doc_id"), fingerprint_udf(width)(text_of()).alias("fp"))
    several = written(prints.join(kept, ["doc_id", "fp"], "left_semi").groupBy("doc_id", "fp").agg(F.count("*").alias("n")).where("n > 1").select("doc_id", "fp"))
    once = rows.join(kept, ["doc_id", "fp"], "left_semi").join(several, ["doc_id", "fp"], "left_anti").select("row").unionAll(rows.where("doc_id is null").select("row"))
    if not several.isEmpty():
        once = once.unionAll(rows.join(several, ["doc_id", "fp"], "left_semi").groupBy("doc_id", "fp").agg(F.min_by("row", F.to_json("row")).alias("row")).select("row"))
    return once.select("row.*")


def op10(docs: DataFrame) -> DataFrame:
    return near_duplicates(docs, 3, 2).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
