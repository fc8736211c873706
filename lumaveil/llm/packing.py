"""Packing: tokenized documents into windows of a fixed capacity by minimum bin slack.

Each task tokenizes its documents and cuts from each whole windows of `capacity` ids; what remains goes to a pool.
A pool of POOL remainders is packed: the longest remainder opens a window, and a bitset dynamic programme over the
multiset of remaining lengths (a bit for each reachable sum, lengths taken in binary-split counts) finds the sum
closest to the room left; walking the stored bitsets back gives how many of each length to take. Windows that stay
below FULL go back to the pool. At the end of a task the windows with room left are joined and cut at the capacity;
the very last one is cut at powers of two, which need no padding. There is no shuffle; memory is bounded by POOL.

Tokens come from a published word-level BPE vocabulary. Its merges run in a byte-pair engine on the words that a
bounded cache lacks: the end-of-word mark is the byte 0, which is merged first. Texts with a byte 0, another control
separator or the vocabulary's special strings go through the reference tokenizer itself.

Defined cases: a null text is the empty text; an empty text is the one closing id; repeated rows are packed as often
as they come; a null doc_id stays null; other columns are ignored; an empty table gives no rows. sequence_id is
unique in a result and the same in reruns over the same files.
"""

from __future__ import annotations

import json
import os
import re
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches, text_of

CAPACITY = 2048
END_ID = 1
#: Remainders packed together; at 4 bytes an id this holds 16 MB at most.
POOL = 2048
#: Share of a window that has to be filled for it to leave the pool.
FULL = 0.998
#: Words whose ids a worker remembers; longer words are never remembered.
CACHE_WORDS, CACHE_CHARS = 500_000, 40

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


class WordBpe:
    """ids of texts as little-endian unsigned 32-bit words, equal to the tokenizer file's own."""

    #: Pre-tokens of the vocabulary (a fixed value of the tokenizer file).
    PIECES = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
    #: Texts with other characters than these, which are tested one by one and in rows against the tokenizer, go to it whole:
    #: what is a letter, and how characters are composed, depends on the Unicode version of each library.
    TESTED = (
        (0x01, 0x1B), (0x20, 0x7F), (0xA1, 0x24F), (0x370, 0x52F), (0x2010, 0x2027), (0x2030, 0x205E), (0x20A0, 0x20BF), (0x3041, 0x3096), (0x30A1, 0x30FA),
        (0x4E00, 0x9FA5), (0xAC00, 0xD7A3),
    )
    ODD = re.compile("[^" + "".join(f"\\u{a:04x}-\\u{b:04x}" for a, b in TESTED) + "]|<\\|")

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import regex
        import tiktoken
        from tokenizers import Tokenizer

        self.plain = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        vocab, suffix = model["vocab"], model["end_of_word_suffix"]
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        others = [b for b in range(256) if b not in set(printable)]
        shown = {b: chr(b) for b in printable} | {b: chr(256 + n) for n, b in enumerate(others)}
        byte_of = {c: b for b, c in shown.items()}

        def raw(token: str) -> bytes:
            ends = token.endswith(suffix)
            return bytes(byte_of[c] for c in (token[: -len(suffix)] if ends else token)) + b"\0" * ends

        ranks = {bytes([b]): b for b in range(256)} | {bytes([b, 0]): 256 + b for b in range(256)}
        merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        ranks |= {raw(a + b): 512 + n for n, (a, b) in enumerate(merges)}
        ids = [vocab[shown[b]] for b in range(256)] + [vocab[shown[b] + suffix] for b in range(256)] + [vocab[a + b] for a, b in merges]
        self.ids = np.array(ids, "<u4")
        self.engine = tiktoken.Encoding("words", pat_str=r"[^\x00\n]+\x00|\n", mergeable_ranks=ranks, special_tokens={})
        self.pieces = regex.compile(self.PIECES)
        self.known: dict[str, bytes] = {}

    def _words(self, words: list[str]) -> dict[str, bytes]:
        forms = []
        for w in words:
            if not w.isascii():
                w = unicodedata.normalize("NFC", w)
            forms.append("".join(c.lower() for c in w) if "\u03a3" in w else w.lower())
        marked = self.pieces.sub("\\g<0>\0", "\n".join(forms))
        found = np.array(self.engine.encode_ordinary(marked), np.int64)
        cuts = np.flatnonzero(found == 10)
        raw = self.ids[found].tobytes()
        starts = [0, *((cuts + 1) * 4).tolist()]
        ends = [*(cuts * 4).tolist(), len(raw)]
        return {w: raw[a:b] for w, a, b in zip(words, starts, ends)}

    def encode(self, texts: list[str]) -> list[bytes]:
        split = [None if self.ODD.search(t) else t.split() for t in texts]
        lacking = {w for words in split if words for w in words}.difference(self.known)
        if len(self.known) > CACHE_WORDS:
            self.known.clear()
            lacking = {w for words in split if words for w in words}
        new = self._words(sorted(lacking)) if lacking else {}
        self.known.update(new)
        get = self.known.__getitem__
        out = [
            b"".join(map(get, words)) if words is not None else np.array(self.plain.encode(t, add_special_tokens=False).ids, "<u4").tobytes()
            for t, words in zip(texts, split)
        ]
        for w in new:
            if len(w) > CACHE_CHARS:
                del self.known[w]
        return out


_LOADED: dict[str, WordBpe] = {}


def tokenizer(path: str) -> WordBpe:
    if path not in _LOADED:
        _LOADED[path] = WordBpe(path)
    return _LOADED[path]


def best_fill(counts: dict[int, int], lengths: list[int], room: int) -> dict[int, int]:
    """How many of each length sum closest to room from below; lengths descend."""
    bits, layers, goal, within = 1, [], 1 << room, (1 << room + 1) - 1
    for size in lengths:
        if size > room:
            continue
        left, k = counts[size], 1
        while left and size * k <= room:
            k = min(k, left)
            layers.append((size, k, bits))
            bits |= bits << size * k & within
            left -= k
            k *= 2
        if bits & goal:
            break
    at, taken = bits.bit_length() - 1, {}
    for size, k, before in reversed(layers):
        if not before >> at & 1:
            taken[size] = taken.get(size, 0) + k
            at -= size * k
    return taken


def fill_windows(lengths: list[int], capacity: int) -> list[list[int]]:
    """Windows of indices into lengths (each 1 to capacity), by minimum bin slack."""
    of: dict[int, list[int]] = {}
    for i, n in enumerate(lengths):
        of.setdefault(n, []).append(i)
    sizes = sorted(of, reverse=True)
    counts = {n: len(x) for n, x in of.items()}
    out = []
    while sizes:
        first = sizes[0]
        counts[first] -= 1
        taken = best_fill(counts, sizes, capacity - first) if capacity > first else {}
        counts[first] += 1
        taken[first] = taken.get(first, 0) + 1
        window = []
        for n, k in taken.items():
            window += [of[n].pop() for _ in range(k)]
            counts[n] -= k
        out.append(window)
        if any(not counts[n] for n in taken):
            sizes = [n for n in sizes if counts[n]]
    return out


class Packer:
    """Windows of one task. Pieces are (doc_id, start, ids, doc_tokens)."""

    def __init__(self, capacity: int, first: int, pool: int = POOL):
        self.capacity, self.next, self.most = capacity, first, pool
        self.pool: list[tuple] = []
        self.rows: list[tuple] = []

    def _emit(self, pieces: list[tuple]) -> None:
        at = 0
        for doc, start, ids, total in pieces:
            n = len(ids) // 4
            self.rows.append((doc, start, n, zlib.crc32(ids), total, self.next, at, ids))
            at += n
        self.next += 1

    def add(self, doc, ids: bytes) -> None:
        total, whole = len(ids) // 4, self.capacity * 4
        for at in range(0, len(ids) - whole + 1, whole):
            self._emit([(doc, at // 4, ids[at : at + whole], total)])
        if rest := len(ids) % whole:
            self.pool.append((doc, total - rest // 4, ids[-rest:], total))
            if len(self.pool) >= self.most:
                self._pack(FULL)

    def _pack(self, full: float) -> None:
        kept = []
        windows = fill_windows([len(p[2]) // 4 for p in self.pool], self.capacity)
        for n, window in enumerate(windows):
            pieces = [self.pool[i] for i in window]
            if sum(len(p[2]) for p in pieces) >= 4 * full * self.capacity:
                self._emit(pieces)
            else:
                kept += pieces
        self.pool = kept
        if len(kept) > self.most // 2 and full < 1:  # what is left fits badly: cut it
            self._cut(False)

    def _cut(self, last: bool) -> None:
        """Join the pool's remainders and cut them at the capacity."""
        window, room = [], self.capacity * 4
        for doc, start, ids, total in self.pool:
            while ids:
                part, ids = ids[:room], ids[room:]
                window.append((doc, start, part, total))
                start += len(part) // 4
                room -= len(part)
                if not room:
                    self._emit(window)
                    window, room = [], self.capacity * 4
        self.pool = window
        if last and window:
            self.pool = []
            sizes = [1 << b for b in range(self.capacity.bit_length()) if (self.capacity - room // 4) >> b & 1]
            for size in reversed(sizes):
                part, need = [], size * 4
                while need:
                    doc, start, ids, total = window[0]
                    part.append((doc, start, ids[:need], total))
                    window[0] = (doc, start + len(part[-1][2]) // 4, ids[need:], total)
                    need -= len(part[-1][2])
                    if not window[0][2]:
                        window.pop(0)
                self._emit(part)

    def finish(self) -> None:
        if self.pool:
            self._pack(1.0)
            self._cut(True)

    def take(self, with_ids: bool) -> pd.DataFrame:
        names = [x.split()[0] for x in SCHEMA.split(", ")]
        out = pd.DataFrame(self.rows, columns=[*names, "ids"]).astype({n: "int64" for n in names[1:]})
        out["doc_id"] = out["doc_id"].astype("Int64")
        self.rows = []
        if with_ids:
            out["ids"] = [np.frombuffer(x, "<u4").astype("int32") for x in out["ids"]]
            return out
        return out[names]


def pack(docs: DataFrame, path: str, capacity: int = CAPACITY, with_ids: bool = True) -> DataFrame:
    """Pieces of all documents: SCHEMA, and ids array<int> if asked for. path: the tokenizer's file."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words = tokenizer(path)
        task = TaskContext.get()
        packer = Packer(capacity, (task.partitionId() if task else 0) << 36)
        close = np.array([END_ID], "<u4").tobytes()
        for batch in batches:
            for doc, ids in zip(batch["doc_id"], words.encode(batch["text"].tolist())):
                packer.add(None if pd.isna(doc) else int(doc), ids + close)
            if packer.rows:
                yield packer.take(with_ids)
        packer.finish()
        if packer.rows:
            yield packer.take(with_ids)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    return rows.mapInPandas(run, SCHEMA + ", ids array<int>" * with_ids)


def op1(docs: DataFrame) -> DataFrame:
    import public_tokenizers

    return pack(docs, public_tokenizers.path("word_bpe_49k.json"), CAPACITY, with_ids=False)
