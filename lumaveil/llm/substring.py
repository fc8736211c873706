"""Substring dedup by relative Lempel-Ziv parsing, over windows of 13 words.

Documents are parsed greedily against reference blocks: an index of a block's windows gives where a factor can start,
the factor is the longest run of words that agrees from there, and the next factor is looked for from its last
width - 1 words on, so that windows across factor boundaries are checked too. Factors of at least a window's words whose
reference is of a smaller doc_id are duplicate spans. The blocks that a document is parsed against are its own batch and,
for what other batches may hold as well, the passages that meet its own there (see repeats.py); words are compared by
their bytes.

Defined cases: a null text has no words; fewer words than a window are never removed; repeats within a document
count for nothing; rows that share a doc_id do not remove each other's words; a null doc_id is neither smaller nor larger
than another, so that such rows lose nothing and remove nothing; repeated rows come back as often as they came; very long
texts are parsed in parts that overlap by a window; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from . import repeats, windows

WIDTH = 13
UNITS = repeats.Units(words=True, width=WIDTH, k=9, same=False)


def agreeing(exact: np.ndarray, p: int, q: int, most: int) -> int:
    """How many units agree from p and from q on, up to `most`."""
    at, step = 0, 64
    while at < most:
        to = min(most, at + step)
        differ = exact[p + at : p + to] != exact[q + at : q + to]
        if differ.any():
            return at + int(differ.argmax())
        at, step = to, step * 4
    return most


def parse_block(block: repeats.Block, units: repeats.Units) -> np.ndarray:
    """Windows of a block, by their first words, that lie in a factor from an earlier document of the block."""
    width, exact = units.width, block.exact
    n = len(exact) - width + 1
    gone = np.zeros(max(0, n), bool)
    if n <= 0:
        return gone
    at = np.flatnonzero(block.of[:n] == block.of[width - 1 :])
    key = block.sums.of(at, at + width)
    order = np.argsort(key, kind="stable")
    new = np.append(True, key[order][1:] != key[order][:-1])[: len(at)]
    index = np.empty(len(at), np.int64)  # where each window occurs first
    index[order] = at[order][new][np.cumsum(new) - 1]
    docs = block.docs[block.of]
    some = docs[index] < docs[at]
    at, index = at[some], index[some]
    ends = block.bounds[1:][block.of]
    i = 0
    while i < len(at):
        p, q = int(at[i]), int(index[i])
        length = agreeing(exact, p, q, int(min(ends[p] - p, ends[q] - q)))
        if length < width:  # two windows of one hash
            i += 1
            continue
        to = p + length - width + 1
        gone[p:to] = True
        i = int(np.searchsorted(at, to))
    return gone


def parse(contents: list[bytes], counts: np.ndarray, of: np.ndarray, doc: np.ndarray, at: np.ndarray, width: int = WIDTH):
    """(occurrence, from window, to window) of the factors of occurrences, which come in order of document and start."""
    numbers = repeats.Numbers()
    exact = np.concatenate([UNITS.exact(c, numbers) for c in contents])
    bounds = np.concatenate([[0], np.cumsum(counts + width - 1)]).tolist()
    sums = windows.Sums(UNITS.hashed(exact, numbers))
    places = np.concatenate([np.arange(b, b + n) for b, n in zip(bounds, counts.tolist())])
    keys = dict(zip(places.tolist(), sums.of(places, places + width).tolist()))
    sizes = counts.tolist()
    index: dict[int, tuple[int, int, int]] = {}  # a window's hash: where it occurs first, the end of that, its document
    out: list[tuple[int, int, int]] = []
    for i, (c, d) in enumerate(zip(of.tolist(), doc.tolist())):
        base, n = bounds[c], sizes[c]
        end, p = base + n + width - 1, base
        while p < base + n:
            seen = index.get(keys[p])
            if seen is None:
                index[keys[p]] = (p, end, d)
                p += 1
                continue
            q, stop, owner = seen
            if owner >= d:
                p += 1
                continue
            # the factor: the longest run that agrees from here
            length = end - p if p == q else agreeing(exact, p, q, min(end - p, stop - q))
            if length < width:  # two windows of one hash
                p += 1
                continue
            to = p + length - width + 1
            out.append((i, p - base, to - base))
            p = to
    found = np.array(out, np.int64).reshape(-1, 3)
    return found[:, 0], found[:, 1], found[:, 2]


def remove(docs: DataFrame, bucket_bytes: int = repeats.BUCKET, hot: int = repeats.HOT) -> DataFrame:
    """doc_id, n_words, n_removed and kept (the words left, joined by a space)."""
    return _results(docs, bucket_bytes, hot, False)


def _results(docs: DataFrame, bucket_bytes: int, hot: int, digest: bool) -> DataFrame:
    found = repeats.find(docs, UNITS, parse_block, parse, bucket_bytes, hot)

    def run(frames):
        for frame in frames:
            out = []
            for doc, blob, ranges in zip(frame["doc"], frame["text"], frame["ranges"]):
                raw = repeats.loose(blob)
                gone = repeats.covered(None if pd.isna(doc) else int(doc), raw, ranges, UNITS, parse)
                words = raw.split()
                kept = b" ".join(words[i] for i in np.flatnonzero(~gone)) if gone.any() else b" ".join(words)
                out.append((len(words), int(gone.sum()), hashlib.sha256(kept).hexdigest() if digest else kept.decode("utf-8", "replace")))
            yield pd.DataFrame(out, columns=["n_words", "n_removed", name]).assign(doc_id=frame["doc"].to_numpy())[["doc_id", "n_words", "n_removed", name]]

    name = "kept_sha256" if digest else "kept"
    return found.mapInPandas(run, f"doc_id long, n_words long, n_removed long, {name} string")


def op5(docs: DataFrame) -> DataFrame:
    return _results(docs, repeats.BUCKET, repeats.HOT, True)
