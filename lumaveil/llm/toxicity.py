"""Toxicity: a subsequence string-kernel support vector machine with Nystroem landmarks.

Two words are alike if they share subsequences of three characters that lie within SPAN characters, each occurrence
weighing DECAY to its span; so a letter put in, a dot between letters or another ending leaves most of the likeness.
K(s, t) = sum over u of phi_u(s) phi_u(t) / (g(s) g(t)), g a function of the length.

Fitting sees labels alone of documents outside the held-out fold, of which it takes at most FIT_TOXIC toxic and
FIT_CLEAN clean ones, by a hash of doc_id (the only sample; all else covers every row). Labels hold for documents, so
the words that make them toxic are found first (multiple instances): from words that clean documents lack, those that
explain the toxic documents not explained yet, one by one. These and clean words, in two rounds with the clean words
that the first round scores highest, train a squared-hinge machine on the Nystroem features K_lm^(-1/2) k(., l) of the
landmarks l. Its decision is a sum of kernels, and so a table over subsequences, with which a word is scored in a few
array look-ups. Letters set apart by white space are read as a word
too, and so is a word without the marks in it. A logistic curve over the highest margins
among a document's words, fitted on the sample, gives the score.

Defined cases: a null text is the empty text, with the lowest margin; long words are scored by overlapping pieces;
null labels are left out, of several labels of a document the highest holds; with no toxic or no clean label at all
every score is 0; null doc_ids are never held out nor fitted on; repeated rows come back as often as they came; other
columns are ignored by the query and kept by `reject`; an empty table gives no rows.
"""

from __future__ import annotations

import re
from heapq import nlargest

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import small_batches, text_of, written

FIT_TOXIC, FIT_CLEAN = 2500, 7500
#: Words looked at when toxic documents are explained, clean words trained on in each round, landmarks.
CANDIDATES, CLEAN_WORDS, LANDMARKS = 3000, 4000, 160
DECAY, SPAN = 0.75, 6
#: Characters of a word scored at once.
WIDE = 24
GAPS = [(a, b) for a in range(1, SPAN) for b in range(1, SPAN) if a + b < SPAN]
APART = re.compile(r"(?<!\S)\S(?:\s+\S){2,}(?!\S)")
MARKS = re.compile(r"[\W_]+")
LOWEST = -10.0
#: Words of a document whose margins its score looks at.
TOP = 4


#: Characters that stand in for letters.
STAND_IN = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s"}


def _classes() -> np.ndarray:
    """Character classes by code point modulo 2^12; 0 is none, 62 any mark, 63 a word's start, a to z keep one each."""
    out = np.array([27 + (i * 2654435761 >> 7) % 35 if chr(i).isalnum() else 62 for i in range(1 << 12)], np.uint8)
    out[97:123] = np.arange(1, 27)
    for c, letter in STAND_IN.items():
        out[ord(c)] = out[ord(letter)]
    return out


CLASSES = _classes()
#: For each length, the share of occurrences that the kernel is divided by.
SIZES = np.sqrt(np.array([1e-9] + [sum(max(0, n - a - b) * DECAY ** (2 * (a + b + 1)) for a, b in GAPS) + 1e-9 for n in range(1, WIDE + 2)]))


def codes(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Classes of the characters of words of at most WIDE characters, a start before them; lengths."""
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    flat = CLASSES[np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), "<u4") & 0xFFF]
    out = np.zeros((len(words), WIDE + 1), np.uint8)
    out[:, 0] = 63
    rows = np.repeat(np.arange(len(words)), sizes)
    cols = np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    out[rows, cols + 1] = flat
    return out, sizes + 1


def occurrences(c: np.ndarray):
    """(subsequence ids, weight) for each pair of gaps; ids of an occurrence beyond the word's end hold a 0 class."""
    wide = c.astype(np.int32)
    for a, b in GAPS:
        n = c.shape[1] - a - b
        if n > 0:
            last = wide[:, a + b :]
            ids = (wide[:, :n] << 12) | (wide[:, a : a + n] << 6) | last
            yield np.where(last > 0, ids, 0), DECAY ** (a + b + 1)


def table_margins(words: list[str], beta: np.ndarray) -> np.ndarray:
    c, sizes = codes(words)
    c = c[:, : int(sizes.max(initial=1))]
    total = np.zeros(len(words))
    for ids, weight in occurrences(c):
        total += weight * beta[ids].sum(axis=1)
    return total / SIZES[sizes]


def features(words: list[str]) -> list[dict[int, float]]:
    """phi of each word, divided by g."""
    c, sizes = codes(words)
    out: list[dict[int, float]] = [{} for _ in words]
    for ids, weight in occurrences(c):
        for row, found in zip(out, ids.tolist()):
            for u in found:
                if u:
                    row[u] = row.get(u, 0.0) + weight
    return [{u: v / g for u, v in row.items()} for row, g in zip(out, SIZES[sizes])]


def kernel(a: list[dict[int, float]], b: list[dict[int, float]]) -> np.ndarray:
    used = {u: i for i, u in enumerate(sorted({u for row in b for u in row}))}
    dense = np.zeros((len(used), len(b)))
    for j, row in enumerate(b):
        for u, v in row.items():
            dense[used[u], j] = v
    out = np.zeros((len(a), len(b)))
    for i, row in enumerate(a):
        at = [(used[u], v) for u, v in row.items() if u in used]
        if at:
            k, v = zip(*at)
            out[i] = np.asarray(v) @ dense[list(k)]
    return out


def train(x: np.ndarray, y: np.ndarray, weight: np.ndarray, cost: float = 20.0, steps: int = 30) -> tuple[np.ndarray, float]:
    """Squared-hinge linear machine by Newton's method; y is -1 or 1."""
    z = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(z.shape[1])
    ridge = np.eye(len(w))
    ridge[-1, -1] = 1e-6
    before = None
    for _ in range(steps):
        inside = y * (z @ w) < 1
        if before is not None and (inside == before).all():
            break
        before = inside
        zi, ci = z[inside], cost * weight[inside]
        w = np.linalg.solve(ridge + zi.T @ (zi * ci[:, None]), zi.T @ (ci * y[inside]))
    return w[:-1], float(w[-1])


def machine(toxic: list[str], weights: list[float], clean: list[str]) -> np.ndarray:
    """The table over subsequences of a machine trained on words; its last entry is the offset."""
    kept = toxic[: LANDMARKS * 3 // 4]
    landmarks = kept + clean[:: max(1, len(clean) // max(1, LANDMARKS - len(kept)))][: LANDMARKS - len(kept)]
    own, other = features(landmarks), features(toxic + clean)
    k = kernel(own, own)
    values, vectors = np.linalg.eigh(k)
    live = values > 1e-8 * max(values.max(initial=0.0), 1e-12)
    root = vectors[:, live] / np.sqrt(values[live])
    x = kernel(other, own) @ root
    y = np.array([1.0] * len(toxic) + [-1.0] * len(clean))
    up = np.asarray(weights, float) / np.mean(weights)
    weight = np.concatenate([up / len(toxic), np.full(len(clean), 1 / len(clean))]) * len(y) / 2
    w, offset = train(x, y, weight)
    alpha = root @ w
    beta = np.zeros((1 << 18) + 1)
    for a, row in zip(alpha, own):
        for u, v in row.items():
            beta[u] += a * v
    beta[-1] = offset
    return beta


def pieces(text: str) -> list[str]:
    """The distinct words of a text, in lower case: those over WIDE characters by overlapping parts."""
    text = text.lower()
    words = set(text.split())
    words.update("".join(m.group().split()) for m in APART.finditer(text))
    words.update([MARKS.sub("", w) for w in words if not w.isalnum()])
    words.discard("")
    long = [w for w in words if len(w) > WIDE]
    if long:
        words.difference_update(long)
        for w in long:
            words.update(w[i : i + WIDE] for i in range(0, len(w) - WIDE // 2, WIDE // 2))
    return list(words)


def margins(texts: list[str], beta: np.ndarray) -> np.ndarray:
    """The TOP highest margins among the words of each text, in descending order."""
    split = [pieces(t) for t in texts]
    words = list({w for s in split for w in s})
    table, found = beta[:-1].astype(np.float32), {}
    for at in range(0, len(words), 20_000):
        part = sorted(words[at : at + 20_000], key=len)
        for k in range(0, len(part), 2_000):  # words of about one length
            found.update(zip(part[k : k + 2_000], table_margins(part[k : k + 2_000], table).tolist()))
    get = found.__getitem__
    out = np.full((len(texts), TOP), LOWEST)
    for row, s in zip(out, split):
        top = nlargest(TOP, map(get, s))
        row[: len(top)] = top
        row[: len(top)] += beta[-1]
    return out


def margin_udf(beta: np.ndarray):
    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def margin(texts: pd.Series) -> pd.Series:
        return pd.Series(margins(texts.tolist(), beta).tolist())

    return margin


@F.pandas_udf(T.ArrayType(T.StringType()))
def pieces_udf(texts: pd.Series) -> pd.Series:
    return pd.Series([list(pieces(t)) for t in texts])


def held_out() -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))


def explain(rows: list, docs: int, clean_share: float) -> tuple[list[str], list[float]]:
    """Words that explain toxic documents, the one that explains most first. rows: (word, toxic documents, n clean)."""
    worth: dict[int, float] = {}
    for r in rows:
        for d in r.ids:
            worth[d] = 1.0
    left = {r.word: r for r in rows}
    chosen, gains = [], []
    floor = max(1.5, 0.002 * docs)
    while left and len(chosen) < 600:
        value = {w: sum(worth[d] for d in r.ids) - 2 * r.n_clean / clean_share for w, r in left.items()}
        word = max(value, key=lambda w: (value[w], w))
        if value[word] < floor:
            break
        chosen.append(word)
        gains.append(value[word])
        for d in left.pop(word).ids:
            worth[d] *= 0.6
        left = {w: r for w, r in left.items() if value[w] >= floor}
    return chosen, gains


def curve(m: np.ndarray) -> np.ndarray:
    """What the logistic curve sees of the highest margins: each within -1.5 and 1.5, and a constant."""
    return np.hstack([np.clip(m, -1.5, 1.5), np.ones((len(m), 1))])


def logistic(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Weights, none below 0 but the constant's, by damped Newton steps with a weak prior."""
    prior = np.zeros(x.shape[1])
    live = np.ones(len(prior), bool)
    for _ in range(len(prior)):
        w = prior.copy()
        z = x[:, live]
        for _ in range(100):
            p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            grad = z.T @ (p - y) + 1e-1 * w[live]
            step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + 1e-1 * np.eye(live.sum()), grad)
            w[live] -= step / max(1.0, np.abs(step).max())
            if np.abs(step).max() < 1e-9:
                break
        if (w[:-1] >= 0).all():
            break
        live[:-1] &= w[:-1] > 0
    return w


def fit(docs: DataFrame, labels: DataFrame) -> tuple[np.ndarray, np.ndarray] | None:
    """The table and the weights of the logistic curve; None without labels of both kinds. What comes to the driver is bounded."""
    small_batches(docs.sparkSession)
    marks = labels.where("doc_id is not null and toxic is not null").where(~held_out()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").alias("toxic"))
    order = F.xxhash64("doc_id"), F.col("doc_id")
    sample = marks.where("toxic = 1").orderBy(*order).limit(FIT_TOXIC).unionAll(marks.where("toxic = 0").orderBy(*order).limit(FIT_CLEAN))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text")).join(F.broadcast(sample), "doc_id")
    # equal texts are one, toxic if any of them is
    texts = written(texts.groupBy("text").agg(F.min("doc_id").alias("doc_id"), F.max("toxic").alias("toxic")))
    split = pieces_udf
    words = written(texts.select("doc_id", "toxic", F.explode(split("text")).alias("word")).groupBy("word").agg(
        F.count_if(F.col("toxic") == 1).alias("n_toxic"), F.count_if(F.col("toxic") == 0).alias("n_clean")))
    kinds = {r.toxic: r.n for r in texts.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    if not kinds.get(1) or not kinds.get(0):
        return None
    share = kinds[0] / kinds[1]
    often = max(2, round(0.003 * kinds[1]))
    odd = words.where((F.col("n_toxic") >= often) & (F.col("n_toxic") * share > 6 * F.col("n_clean")))
    odd = written(odd.orderBy(F.desc("n_toxic"), "word").limit(CANDIDATES))
    where = texts.where("toxic = 1").select("doc_id", F.explode(split("text")).alias("word"))
    rows = where.join(F.broadcast(odd), "word").groupBy("word").agg(F.collect_list("doc_id").alias("ids"), F.first("n_clean").alias("n_clean"))
    toxic, gains = explain(sorted(rows.collect(), key=lambda r: r.word), kinds[1], share)
    clean = words.where("n_clean > 0").select("word")
    some = [r.word for r in clean.orderBy(F.xxhash64("word"), "word").limit(CLEAN_WORDS).collect()]
    some = [w for w in some if w not in set(toxic)]
    if not toxic or not some:
        return None
    beta = machine(toxic, gains, some)
    hard = clean.withColumn("m", margin_udf(beta)("word")[0]).orderBy(F.desc("m"), "word").limit(CLEAN_WORDS // 4)
    some += [r.word for r in hard.collect() if r.word not in set(toxic)]
    beta = machine(toxic, gains, sorted(set(some)))
    found = texts.select("doc_id", F.col("toxic").cast("double").alias("y"), margin_udf(beta)("text").alias("m")).orderBy("doc_id").collect()
    return beta, logistic(curve(np.array([r.m for r in found])), np.array([r.y for r in found]))


def scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs with score and predicted put after them, as columns of a struct `toxicity`."""
    small_batches(docs.sparkSession)
    model = fit(docs, labels)
    if model is None:
        score = F.lit(0.0)
    else:
        beta, weights = model
        top = F.col("_m")
        line = sum((F.greatest(F.lit(-1.5), F.least(F.lit(1.5), top[i])) * float(w) for i, w in enumerate(weights[:-1])), F.lit(float(weights[-1])))
        score = 1 / (1 + F.exp(-line))
        docs = docs.withColumn("_m", margin_udf(beta)(text_of()))
    out = docs.withColumn("toxicity", F.struct(score.alias("score")))
    return out.withColumn("toxicity", F.struct("toxicity.score", (F.col("toxicity.score") >= 0.5).cast("int").alias("predicted"))).drop("_m")


def reject(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs without those predicted toxic, with the columns that they came with."""
    return scores(docs.select(F.struct("*").alias("row"), "doc_id", "text"), labels).where("toxicity.predicted = 0").select("row.*")


def op3(docs: DataFrame, labels: DataFrame) -> DataFrame:
    out = scores(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), labels)
    return out.select("doc_id", held_out().alias("held_out"), F.col("toxicity.score").alias("score"), F.col("toxicity.predicted").alias("predicted"))
