"""The distributed search for repeated windows that substring and suffix-array dedup share.

1. Every task reads its documents in batches, which are blocks of the operator's own method: it decides there at once
   which windows start in an earlier document of the block. What is decided goes to its document as ranges.
2. The segments of windows left (see windows.py) meet by anchor in buckets of bounded size. Only an anchor that several
   batches hold can have windows in common; hashes route, and drop nothing but segments whose anchor is in one batch.
3. Of each content of a shared anchor the first occurrence's text is fetched (others with 128 equal bits of hash have the
   same); texts and all occurrences meet by anchor, and the method decides on them again. The occurrences of an anchor with over HOT contents meet by window instead,
   so that no group holds more than one window's occurrences.
4. Each document gets the ranges found, checks their hashes, and the operator makes its result of them.

An occurrence's order is (doc_id, start); `same` tells whether an earlier start in the same document counts. Rows that
share a doc_id are one document with several texts. Rows with a null doc_id are in no order with others: each is a block
of its own.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import windows
from .common import small_batches, text_of, written

#: Bytes of text in a block, and bytes of text for each bucket.
BATCH, BUCKET = 1 << 20, 1 << 21
#: Contents of one anchor up to which they meet by anchor.
HOT = 5_000
#: Words whose hashes a worker remembers.
REMEMBERED = 1 << 17

ENTRY = [("h", "<u8"), ("s", "<u8"), ("doc", "<i8"), ("at", "<i8"), ("n", "<i4")]
RANGES = "doc long, start long, stop long, s long"


class Numbers(dict):
    """Numbers for words, in order of their first use: equal numbers are equal bytes."""

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n

    def hashes(self) -> np.ndarray:
        return np.fromiter(map(xxhash.xxh3_64_intdigest, self), np.uint64, len(self))


class Hashes(dict):
    """Hashes of words."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


HASHES = Hashes()


def words_by_parts(raw: bytes, most: int = BATCH) -> Iterator[list[bytes]]:
    """The words of a text, a long one cut at white space into parts of about `most` bytes."""
    at = 0
    while len(raw) - at > 2 * most:
        m = windows.BLANK.search(raw, at + most)
        if not m:
            break
        yield raw[at : m.start()].split()
        at = m.start()
    yield raw[at:].split()


class Units:
    """Bytes, or words, of a text, and what a window of them is."""

    def __init__(self, words: bool, width: int, k: int, same: bool):
        self.words, self.width, self.k, self.same = words, width, k, same

    def values(self, raw: bytes) -> np.ndarray:
        """Hashes of the units."""
        if self.words:
            return np.concatenate([np.fromiter(map(HASHES.__getitem__, w), np.uint64, len(w)) for w in words_by_parts(raw)])
        return windows.BYTE_VALUES[np.frombuffer(raw, np.uint8)]

    def exact(self, raw: bytes, numbers: Numbers) -> np.ndarray:
        """Numbers that are equal where units are."""
        if self.words:
            return np.concatenate([np.fromiter(map(numbers.__getitem__, w), np.int64, len(w)) for w in words_by_parts(raw)])
        return np.frombuffer(raw, np.uint8)

    def hashed(self, exact: np.ndarray, numbers: Numbers) -> np.ndarray:
        return numbers.hashes()[exact] if self.words else windows.BYTE_VALUES[exact]


class Block:
    """Documents of a batch in order of their ids: units put end to end. A long text is several of its documents."""

    def __init__(self, docs: list[int], bases: list[int], parts: list[np.ndarray], numbers: Numbers, units: Units):
        self.docs, self.bases = np.array(docs, np.int64), np.array(bases, np.int64)
        self.bounds = np.concatenate([[0], np.cumsum([len(p) for p in parts])])
        self.exact = np.concatenate(parts)
        self.values = units.hashed(self.exact, numbers)
        self.of = np.repeat(np.arange(len(parts), dtype=np.int32), np.diff(self.bounds))
        # segments: document, first window, windows, hash of anchor, hash of content
        self.d, self.first, self.n, self.h, self.s, self.sums = windows.segments(self.values, self.bounds, units.width, units.k)


#: Which windows (by their first units) of a block start earlier as well.
Local = Callable[[Block, Units], np.ndarray]
#: (contents as bytes, their windows; occurrences' content, document and start) -> occurrence, from window, to window.
Method = Callable[[list[bytes], np.ndarray, np.ndarray, np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray, np.ndarray]]


def blocks_of(rows: Iterator[tuple[int, bytes]], units: Units) -> Iterator[Block]:
    held, size = [], 0

    def cut(rows):
        rows.sort(key=lambda r: r[0])
        numbers = Numbers()
        docs, bases, parts, n = [], [], [], 0
        for doc, raw in rows:
            u = units.exact(raw, numbers)
            for base in range(0, max(1, len(u) - units.width + 1), BATCH):
                docs.append(doc)
                bases.append(base)
                parts.append(u[base : base + BATCH + units.width - 1])
                n += len(parts[-1])
                if n > BATCH:
                    yield Block(docs, bases, parts, numbers, units)
                    docs, bases, parts, n = [], [], [], 0
        if docs:
            yield Block(docs, bases, parts, numbers, units)

    for doc, raw in rows:
        held.append((doc, raw))
        size += len(raw)
        if size > BATCH:
            yield from cut(held)
            held, size = [], 0
    if held:
        yield from cut(held)


def runs(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first, end) of the stretches where the mask holds."""
    edge = np.flatnonzero(np.diff(np.concatenate([[False], mask, [False]]).astype(np.int8)))
    return edge[0::2], edge[1::2]


def scan(texts: DataFrame, units: Units, local: Local, buckets: int) -> DataFrame:
    """(bucket, entries, decided): segments by anchor, and the ranges that their block has decided, dealt by document.

    Both come from one pass, as another would see other blocks where the table is cut or ordered anew.
    """

    def dealt(e: np.ndarray, key: np.ndarray, name: str) -> pd.DataFrame:
        b = (key % np.uint64(buckets)).astype(np.int32)
        order = np.argsort(b, kind="stable")
        e, b = e[order], b[order]
        cuts = np.flatnonzero(np.diff(b)) + 1
        out = {"bucket": b[np.concatenate([[0], cuts])], "entries": None, "decided": None}
        return pd.DataFrame(out | {name: [packed(x) for x in np.split(e, cuts)]})

    def run(frames):
        rows = ((doc, text.encode("utf-8", "surrogatepass")) for f in frames for doc, text in zip(f["doc"].tolist(), f["text"]))
        for block in blocks_of(rows, units):
            gone = local(block, units)
            a, b = runs(gone)
            if len(a):
                e = np.empty(len(a), ENTRY)
                d = block.of[a]
                e["h"], e["s"], e["doc"], e["n"] = 0, block.sums.of(a, b + units.width - 1), block.docs[d], b - a
                e["at"] = a - block.bounds[d] + block.bases[d]
                yield dealt(e, e["doc"].view(np.uint64), "decided")
            many = np.concatenate([[0], np.cumsum(gone)])
            left = np.flatnonzero(many[np.minimum(block.first + block.n, len(gone))] - many[np.minimum(block.first, len(gone))] < block.n)
            if len(left):
                e, d = np.empty(len(left), ENTRY), block.d[left]
                e["h"], e["s"], e["doc"], e["n"] = block.h[left], block.s[left], block.docs[d], block.n[left]
                e["at"] = block.first[left] - block.bounds[d] + block.bases[d]
                yield dealt(e, e["h"], "entries")

    return texts.mapInPandas(run, "bucket int, entries binary, decided binary")


def packed(e: np.ndarray) -> bytes:
    """Column by column: what is alike lies together, for the shuffle's compression."""
    return b"".join(np.ascontiguousarray(e[n]).tobytes() for n, _ in ENTRY)


def unpacked(blobs) -> np.ndarray:
    one = sum(np.dtype(t).itemsize for _, t in ENTRY)
    sizes = [len(b) // one for b in blobs]
    out = np.empty(sum(sizes), ENTRY)
    at = 0
    for blob, n in zip(blobs, sizes):
        offset = 0
        for name, t in ENTRY:
            out[name][at : at + n] = np.frombuffer(blob, t, n, offset)
            offset += n * np.dtype(t).itemsize
        at += n
    return out


def ranges(e: np.ndarray, width: int, **more) -> pd.DataFrame:
    return pd.DataFrame({"doc": e["doc"], "start": e["at"], "stop": e["at"] + e["n"] + width - 1, "s": e["s"].view(np.int64)} | more)


def meet(scanned: DataFrame, units: Units, hot: int) -> DataFrame:
    """RANGES, h, kind and held. Kind 0: decided; 1: a content whose text is wanted; 2: wanted by window; 3: held has a
    bucket's occurrences (the bucket is in h)."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        blobs = frame["entries"].dropna().tolist()
        e, done = unpacked(blobs), unpacked(frame["decided"].dropna().tolist())
        one = sum(np.dtype(t).itemsize for _, t in ENTRY)
        batch = np.repeat(np.arange(len(blobs)), [len(b) // one for b in blobs])
        order = np.lexsort((e["at"], e["doc"], e["s"], e["h"]))
        e, batch = e[order], batch[order]
        new = np.append(True, e["h"][1:] != e["h"][:-1])[: len(e)]
        heads = np.flatnonzero(new)
        number = np.cumsum(new) - 1
        if len(e):
            shared = np.minimum.reduceat(batch, heads) != np.maximum.reduceat(batch, heads)
            e, new, number = (x[shared[number]] for x in (e, new, number))
        first = new | np.append(True, e["s"][1:] != e["s"][:-1])[: len(e)]
        over = (np.bincount(number[first], minlength=len(heads)) > hot)[number] if len(e) else np.zeros(0, bool)
        out = [ranges(done, units.width, h=0, kind=0, held=None)]
        if len(e):
            wanted, windowed, rest = first & ~over, over, ~over
            out += [ranges(e[m], units.width, h=e["h"][m].view(np.int64), kind=k, held=None) for m, k in ((wanted, 1), (windowed, 2))]
            if rest.any():
                out.append(pd.DataFrame({"doc": [None], "start": None, "stop": None, "s": None, "h": [int(frame["bucket"].iloc[0])], "kind": 3, "held": [packed(e[rest])]}))
        out = [o.astype({"doc": "Int64", "start": "Int64", "stop": "Int64", "s": "Int64", "h": "int64", "kind": "int32", "held": "object"}) for o in out if len(o)]
        return pd.concat(out) if out else pd.DataFrame({"doc": [], "start": [], "stop": [], "s": [], "h": [], "kind": [], "held": []})

    return scanned.groupBy("bucket").applyInPandas(run, RANGES + ", h long, kind int, held binary")


def checked(u: np.ndarray, start: np.ndarray, stop: np.ndarray, s: np.ndarray) -> np.ndarray:
    """Which ranges of a text's unit hashes have the hash that they are said to have."""
    ok = stop <= len(u)
    if ok.any():
        ok[ok] = windows.Sums(u).of(start[ok], stop[ok]) == s[ok].view(np.uint64)
    return ok


@F.pandas_udf(T.BinaryType())
def squeezed(texts: pd.Series) -> pd.Series:
    return pd.Series([zstandard.ZstdCompressor(level=1).compress(t.encode("utf-8", "surrogatepass")) for t in texts])


def loose(blob: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(blob)


def details(texts: DataFrame, told: DataFrame, units: Units, buckets: int) -> DataFrame:
    """(bucket, h, s, doc, at, n, own, content) of the contents wanted; content holds the units' bytes, words by spaces.

    own is 1 where a window is wanted, which is an occurrence of its own.
    """
    wanted = told.where("kind in (1, 2)").groupBy("doc").agg(F.collect_list(F.struct("start", "stop", "s", "h", "kind")).alias("wanted"))
    rows = texts.select("doc", squeezed("text").alias("text")).join(wanted, "doc")
    columns = ["bucket", "h", "s", "doc", "at", "n", "own", "content"]

    def run(frames):
        for frame in frames:
            out = []
            for doc, blob, wanted in zip(frame["doc"].tolist(), frame["text"], frame["wanted"]):
                raw = loose(blob)
                start, stop, s, h, kind = (np.array([r[c] for r in wanted], np.int64) for c in ("start", "stop", "s", "h", "kind"))
                u = units.values(raw)
                ok = checked(u, start, stop, s)
                words = raw.split() if units.words else None
                sums = windows.Sums(u) if (kind == 2).any() else None
                part = (lambda a, b: b" ".join(words[a:b])) if units.words else (lambda a, b: raw[a:b])  # noqa: B023
                bucket = (h.view(np.uint64) % np.uint64(buckets)).astype(np.int64)
                for i in np.flatnonzero(ok):
                    a, b = int(start[i]), int(stop[i])
                    if kind[i] == 1:
                        out.append((bucket[i], h[i], s[i], doc, a, b - a - units.width + 1, 0, part(a, b)))
                    else:
                        at = np.arange(a, b - units.width + 1)
                        for p, v in zip(at.tolist(), (sums.of(at, at + units.width) % np.uint64(buckets)).tolist()):
                            out.append((v, h[i], 0, doc, p, 1, 1, part(p, p + units.width)))
            if out:
                yield pd.DataFrame(out, columns=columns)

    return rows.mapInPandas(run, "bucket int, h long, s long, doc long, at long, n int, own int, content binary")


def compared(rows: DataFrame, occurrences: DataFrame, units: Units, method: Method) -> DataFrame:
    """RANGES that the method finds in the contents of each bucket."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        held = unpacked(frame["held"].dropna().tolist())
        texts = frame[frame["content"].notna()]
        number: dict[bytes, int] = {}
        whole: dict[tuple[int, int], int] = {}
        counts, of, doc, at = [], [], [], []
        for h, s, d, a, n, own, content in zip(*(texts[c].tolist() for c in ("h", "s", "doc", "at", "n", "own", "content"))):
            c = number.setdefault(content, len(number))
            if c == len(counts):
                counts.append(n)
            if own:
                of.append(c)
                doc.append(d)
                at.append(a)
            else:
                whole.setdefault((h, s), c)
        known = [whole.get(x, -1) for x in zip(held["h"].view(np.int64).tolist(), held["s"].view(np.int64).tolist())]
        of = np.concatenate([np.array(known, np.int64), np.array(of, np.int64)])
        doc, at = np.concatenate([held["doc"], np.array(doc, np.int64)]), np.concatenate([held["at"], np.array(at, np.int64)])
        some = np.flatnonzero(of >= 0)
        some = some[np.lexsort((at[some], doc[some]))]
        of, doc, at = of[some], doc[some], at[some]
        if not len(of):
            return pd.DataFrame({"doc": [], "start": [], "stop": [], "s": []}).astype("int64")
        contents, counts = list(number), np.array(counts, np.int64)
        i, a, b = method(contents, counts, of, doc, at)
        bounds = np.concatenate([[0], np.cumsum(counts + units.width - 1)])
        values = np.concatenate([units.values(c) for c in contents])
        s = windows.Sums(values).of(bounds[of[i]] + a, bounds[of[i]] + b + units.width - 1)
        return pd.DataFrame({"doc": doc[i], "start": at[i] + a, "stop": at[i] + b + units.width - 1, "s": s.view(np.int64)})

    # no nulls among the numbers: pandas would make them floats
    kinds = {"bucket": "int", "h": "long", "s": "long", "doc": "long", "at": "long", "n": "int", "own": "int"}
    full = lambda df: df.select(*[F.col(c) if c in df.columns else F.lit(0).cast(t).alias(c) for c, t in kinds.items()], *[F.col(c) if c in df.columns else F.lit(None).cast("binary").alias(c) for c in ("content", "held")])
    both = full(rows).unionAll(full(occurrences))
    return both.groupBy("bucket").applyInPandas(run, RANGES)


def find(docs: DataFrame, units: Units, local: Local, method: Method, bucket_bytes: int = BUCKET, hot: int = HOT) -> DataFrame:
    """doc_id, text (compressed UTF-8) and ranges: an array of struct(start, stop, s) of repeated units, as found."""
    small_batches(docs.sparkSession)
    every = docs.select(F.col("doc_id").cast("long").alias("doc"), text_of().alias("text"))
    texts = every.where("doc is not null")
    total = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = int(min((1 << 31) - 1, max(8, total // bucket_bytes)))
    told = written(meet(scan(texts, units, local, buckets), units, hot))
    occurrences = told.where("kind = 3").select(F.col("h").cast("int").alias("bucket"), "held")
    more = written(compared(details(texts, told, units, buckets), occurrences, units, method))
    known = told.where("kind = 0").select("doc", "start", "stop", "s").unionAll(more)
    known = known.groupBy("doc").agg(F.collect_list(F.struct("start", "stop", "s")).alias("ranges"))
    out = texts.select("doc", squeezed("text").alias("text")).join(known, "doc", "left")
    return out.unionAll(every.where("doc is null").select("doc", squeezed("text"), F.lit(None).cast(out.schema["ranges"].dataType)))


def own_repeats(raw: bytes, units: Units, method: Method) -> tuple[np.ndarray, np.ndarray]:
    """(start, stop) of units that a text without an id repeats of itself, by the method on its segments."""
    number: dict[bytes, int] = {}
    counts, of, at = [], [], []
    blocks = list(blocks_of(iter([(0, raw)]), units))
    h, times = np.unique(np.concatenate([b.h for b in blocks]), return_counts=True)
    for b in blocks:
        for i in np.flatnonzero(np.isin(b.h, h[times > 1])).tolist():
            a, d = int(b.first[i]), b.d[i]
            c = number.setdefault(b.exact[a : a + int(b.n[i]) + units.width - 1].tobytes(), len(number))
            if c == len(counts):
                counts.append(int(b.n[i]))
            of.append(c)
            at.append(a - int(b.bounds[d]) + int(b.bases[d]))
    if not of:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    at = np.array(at, np.int64)
    i, a, b = method(list(number), np.array(counts, np.int64), np.array(of, np.int64), np.zeros(len(of), np.int64), at)
    return at[i] + a, at[i] + b + units.width - 1


def covered(doc: int | None, raw: bytes, found, units: Units, method: Method) -> np.ndarray:
    """Which of the text's units lie in a range found for it, or, for a text without an id, in one that it repeats."""
    if doc is None:
        size = sum(map(len, words_by_parts(raw))) if units.words else len(raw)
        start, stop = own_repeats(raw, units, method) if units.same else (np.zeros(0, np.int64),) * 2
    elif found is None or not len(found):
        return np.zeros(sum(map(len, words_by_parts(raw))) if units.words else len(raw), bool)
    else:
        u = units.values(raw)
        size = len(u)
        start, stop, s = (np.array([r[n] for r in found], np.int64) for n in ("start", "stop", "s"))
        ok = checked(u, start, stop, s)
        start, stop = start[ok], stop[ok]
    out = np.zeros(size + 1, np.int64)
    np.add.at(out, start, 1)
    np.add.at(out, stop, -1)
    return np.cumsum(out)[:-1] > 0
