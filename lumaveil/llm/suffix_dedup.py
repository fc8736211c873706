"""Suffix-array dedup: bytes covered by a 100-byte string that also starts earlier are removed.

Where passages meet (see repeats.py), in a batch of documents and then by anchor over all batches, the distinct ones that
hold an anchor are put end to end, with one letter for the anchor that all their windows hold. A suffix array of each
such string is made by grouping suffixes by Lyndon prefixes (see suffixes.py), and neighbours in it that agree on 100
bytes form a class. A class's earliest place is taken over all occurrences of its passages; all others start a repeated
string.

Defined cases: a null text is empty; matches never cross documents; fewer than 100 bytes are never removed; rows that
share a doc_id are one document with several texts; a null doc_id is neither smaller nor larger than another, so that
such a row loses only what it repeats of itself; repeated rows come back as often as they came; very long texts are cut
into parts that overlap by a window; the bytes left may not be whole characters (the text is then decoded with
replacement marks); other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from . import repeats, windows
from .suffixes import suffix_arrays

WIDTH = 100
UNITS = repeats.Units(words=False, width=WIDTH, k=50, same=True)
ANCHOR, END = 256, -1
#: Windows compared, and bytes searched for anchors, at once.
ROWS, JOINED = 1 << 16, 1 << 22


def anchors(contents: list[bytes], width: int, k: int) -> np.ndarray:
    """Where each content's anchor starts: the k-gram of smallest hash in its first window, the leftmost such."""
    sizes = np.array([len(c) for c in contents], np.int64)
    out = []
    for part in np.split(np.arange(len(contents)), np.flatnonzero(np.diff(np.cumsum(sizes) // JOINED)) + 1):
        joined = np.frombuffer(b"".join(contents[i] for i in part), np.uint8)
        gram = windows.Sums(windows.BYTE_VALUES[joined]).grams(k)
        low = np.append((gram & ~windows.PLACE) | np.arange(len(gram), dtype=np.uint64), np.uint64(0xFFFFFFFFFFFFFFFF))
        first = np.concatenate([[0], np.cumsum(sizes[part])[:-1]])
        ends = np.stack([first, np.minimum(first + width - k + 1, len(low) - 1)], 1).ravel()
        out.append((np.minimum.reduceat(low, ends)[::2] & windows.PLACE).astype(np.int64) - first)
    return np.concatenate(out)


def classes(contents: list[bytes], counts: np.ndarray, width: int = WIDTH, k: int = 50) -> np.ndarray:
    """For the windows of all contents, one content after the other: numbers that are equal where windows are."""
    sizes = np.array([len(c) for c in contents], np.int64)
    data = np.frombuffer(b"".join(contents), np.uint8)
    at = anchors(contents, width, k)
    labels: dict[bytes, int] = {}
    label = np.array([labels.setdefault(c[a : a + k], len(labels)) for c, a in zip(contents, at.tolist())], np.int64)
    order = np.argsort(label, kind="stable")
    # contents of one anchor end to end; one letter stands for the anchor
    lengths = (sizes - k + 2)[order]
    first = np.concatenate([[0], np.cumsum(lengths)])
    own = np.repeat(order, lengths)
    j = np.arange(first[-1]) - np.repeat(first[:-1], lengths)
    begin = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    letters = data[np.minimum(begin[own] + j + np.where(j > at[own], k - 1, 0), len(data) - 1)].astype(np.int64)
    letters[j == at[own]] = ANCHOR
    letters[first[1:] - 1] = END
    heads = np.flatnonzero(np.append(True, np.diff(label[order]) != 0))
    bounds = np.append(first[heads], first[-1])
    sorted_ = suffix_arrays(letters, bounds)
    starts_window = j < counts[own]
    x = sorted_[starts_window[sorted_]]
    string = np.repeat(np.arange(len(heads)), np.diff(bounds))
    span = width - k + 1
    rows = np.lib.stride_tricks.sliding_window_view(np.append(letters, np.full(span, END)).astype(np.int16), span)
    alike = string[x[1:]] == string[x[:-1]]
    for a in range(0, len(alike), ROWS):
        near = a + np.flatnonzero(alike[a : a + ROWS])
        alike[near] = (rows[x[near + 1]] == rows[x[near]]).all(axis=1)
    out = np.empty(int(counts.sum()), np.int64)
    offset = np.concatenate([[0], np.cumsum(counts)[:-1]])
    out[offset[own[x]] + j[x]] = np.cumsum(np.append(True, ~alike)[: len(x)])
    return out


def decide(contents: list[bytes], counts: np.ndarray, of: np.ndarray, doc: np.ndarray, at: np.ndarray, width: int = WIDTH, k: int = 50):
    """(occurrence, from window, to window) of the windows of occurrences that start earlier as well."""
    cls = classes(contents, counts, width, k)
    order = np.lexsort((at, doc, of))
    lead = order[np.append(True, of[order][1:] != of[order][:-1])]  # each content's first occurrence, by content
    here = of[lead]
    offset = np.concatenate([[0], np.cumsum(counts)])
    window = np.concatenate([np.arange(offset[c], offset[c + 1]) for c in here.tolist()])
    d, p = np.repeat(doc[lead], counts[here]), np.repeat(at[lead] - offset[here], counts[here]) + window
    by = np.lexsort((p, d, cls[window]))
    c = cls[window][by]
    new = np.append(True, c[1:] != c[:-1])
    earliest = by[new][np.cumsum(new) - 1]
    later = np.zeros(len(window), bool)
    later[by] = (d[by] > d[earliest]) | (p[by] > p[earliest])
    # of a content's first occurrence what starts earlier in another content; of all others everything
    bounds = np.concatenate([[0], np.cumsum(counts[here])])
    begins, closes = np.zeros(len(later), bool), np.zeros(len(later), bool)
    begins[bounds[:-1]] = closes[bounds[1:] - 1] = True
    starts = np.flatnonzero(later & (begins | ~np.append(False, later[:-1])))
    ends = np.flatnonzero(later & (closes | ~np.append(later[1:], False))) + 1
    own = np.searchsorted(bounds, starts, side="right") - 1
    first = np.empty(len(contents), np.int64)
    first[here] = lead
    rest = np.flatnonzero((doc != doc[first[of]]) | (at != at[first[of]]))
    i = np.concatenate([lead[own], rest])
    return i, np.concatenate([starts - bounds[own], np.zeros(len(rest), np.int64)]), np.concatenate([ends - bounds[own], counts[of[rest]]])


def in_block(block: repeats.Block, units: repeats.Units) -> np.ndarray:
    """Windows of a block, by their first bytes, that start earlier in it as well."""
    gone = np.zeros(max(0, len(block.exact) - units.width + 1), bool)
    h, inverse, times = np.unique(block.h, return_inverse=True, return_counts=True)
    some = np.flatnonzero(times[inverse] > 1)
    if not len(some):
        return gone
    raw, first, n = block.exact.tobytes(), block.first[some], block.n[some]
    number: dict[bytes, int] = {}
    of = np.array([number.setdefault(raw[a:b], len(number)) for a, b in zip(first.tolist(), (first + n + units.width - 1).tolist())], np.int64)
    counts = np.zeros(len(number), np.int64)
    counts[of] = n
    d = block.d[some]
    i, a, b = decide(list(number), counts, of, block.docs[d], first - block.bounds[d] + block.bases[d], units.width, units.k)
    marks = np.zeros(len(gone) + 1, np.int64)
    np.add.at(marks, first[i] + a, 1)
    np.add.at(marks, first[i] + b, -1)
    return np.cumsum(marks)[:-1] > 0


def _results(docs: DataFrame, bucket_bytes: int, hot: int, digest: bool) -> DataFrame:
    found = repeats.find(docs, UNITS, in_block, decide, bucket_bytes, hot)
    name = "kept_sha256" if digest else "kept"

    def run(frames):
        for frame in frames:
            out = []
            for doc, blob, ranges in zip(frame["doc"], frame["text"], frame["ranges"]):
                raw = repeats.loose(blob)
                gone = repeats.covered(None if pd.isna(doc) else int(doc), raw, ranges, UNITS, decide)
                spans = len(repeats.runs(gone)[0])
                kept = np.frombuffer(raw, np.uint8)[~gone].tobytes() if spans else raw
                out.append((len(raw), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest() if digest else kept.decode("utf-8", "replace")))
            columns = ["n_bytes", "n_removed", "n_spans", name]
            yield pd.DataFrame(out, columns=columns).assign(doc_id=frame["doc"].to_numpy())[["doc_id", *columns]]

    return found.mapInPandas(run, f"doc_id long, n_bytes long, n_removed long, n_spans long, {name} string")


def remove(docs: DataFrame, bucket_bytes: int = repeats.BUCKET, hot: int = repeats.HOT) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept (the text left)."""
    return _results(docs, bucket_bytes, hot, False)


def op8(docs: DataFrame) -> DataFrame:
    return _results(docs, repeats.BUCKET, repeats.HOT, True)
