"""Approximate nearest neighbours by learned partitions.

On a sample of SAMPLE to MOST_SAMPLE vectors, as the rows grow, the exact neighbour graph is made and cut into balanced parts: halving along
principal directions, then moves of vertices to the part of most of their neighbours, as far as the balance allows. A
small network with one hidden layer learns to tell, from a vector, in which parts its neighbours are. It puts every row
into its most probable part (the index), and sends a query to its several most probable parts, whose vectors are all
reranked by exact cosine. How many parts a query looks into is set on the sample, as the fewest that find TARGET of the
true neighbours there; parts are added for a query while they hold fewer than LEAST vectors.

The index holds every row. Parts are searched in blocks of about BLOCK candidates by BLOCK queries, so that a large part
(near copies lie together) is many tasks; each block gives the best k of each query, which are merged.

Defined cases: vectors that are null, zero or hold null or non-finite components take no part, nor do rows without a
vec_id; rows that repeat a query's vec_id are not its candidates, and a repeated query is one query, of the least of its
vectors; candidate rows that repeat vec_id and vector count once, and others that repeat a vec_id are candidates of their
own; very wide vectors make larger blocks; shorter vectors count as padded with zeros; other columns are ignored; an empty table
gives no rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import rows_in_batch, written
from .vectors import blocks, matrix, norms, unblock, valid

#: Sampled vectors, at least and, a hundredth of the rows, at most.
SAMPLE, MOST_SAMPLE, ROWS_PER_SAMPLED = 6000, 24_000, 100
#: Sampled vectors for each part, neighbours in the graph.
PER_PART, GRAPH = 250, 10
TARGET, LEAST, BLOCK = 0.97, 64, 4000


def neighbour_graph(x: np.ndarray, k: int) -> np.ndarray:
    out = np.empty((len(x), k), np.int64)
    for at in range(0, len(x), 500):
        near = x[at : at + 500] @ x.T
        near[np.arange(len(near)), np.arange(at, at + len(near))] = -2
        out[at : at + 500] = np.argsort(-near, axis=1, kind="stable")[:, :k]
    return out


def balanced_parts(x: np.ndarray, graph: np.ndarray, parts: int, rounds: int = 12, slack: float = 1.1) -> np.ndarray:
    part = np.zeros(len(x), np.int64)

    def halve(points: np.ndarray, first: int, count: int) -> None:
        if count == 1:
            part[points] = first
            return
        own = x[points] - x[points].mean(axis=0)
        direction = np.linalg.eigh(own.T @ own)[1][:, -1]
        left = count // 2
        order = points[np.argsort(own @ direction, kind="stable")]
        cut = len(points) * left // count
        halve(order[:cut], first, left)
        halve(order[cut:], first + left, count - left)

    halve(np.arange(len(x)), 0, parts)
    both = np.concatenate([np.stack([np.repeat(np.arange(len(x)), graph.shape[1]), graph.ravel()], 1), np.stack([graph.ravel(), np.repeat(np.arange(len(x)), graph.shape[1])], 1)])
    most = int(slack * len(x) / parts) + 1
    for _ in range(rounds):
        votes = np.zeros((len(x), parts))
        np.add.at(votes, (both[:, 0], part[both[:, 1]]), 1)
        best = votes.argmax(axis=1)
        gain = votes[np.arange(len(x)), best] - votes[np.arange(len(x)), part]
        sizes = np.bincount(part, minlength=parts)
        moved = 0
        for i in np.argsort(-gain, kind="stable"):
            if gain[i] <= 0:
                break
            if sizes[best[i]] < most:
                sizes[part[i]] -= 1
                sizes[best[i]] += 1
                part[i] = best[i]
                moved += 1
        if not moved:
            break
    return part


class Router:
    """Probabilities of parts for unit vectors."""

    def __init__(self, x: np.ndarray, wanted: np.ndarray, hidden: int = 96, epochs: int = 30, seed: int = 7):
        rng = np.random.RandomState(seed)
        d, p = x.shape[1], wanted.shape[1]
        self.w = [rng.normal(size=(d, hidden)) * np.sqrt(2 / d), np.zeros(hidden), rng.normal(size=(hidden, p)) / np.sqrt(hidden), np.zeros(p)]
        x = x * np.sqrt(d)
        first, second = [np.zeros_like(w) for w in self.w], [np.zeros_like(w) for w in self.w]
        step = 0
        for epoch in range(epochs):
            for at in np.array_split(rng.permutation(len(x)), max(1, len(x) // 128)):
                h = np.maximum(0, x[at] @ self.w[0] + self.w[1])
                g = (self._soft(h @ self.w[2] + self.w[3]) - wanted[at]) / len(at)
                back = (g @ self.w[2].T) * (h > 0)
                step += 1
                for i, grad in enumerate((x[at].T @ back, back.sum(0), h.T @ g, g.sum(0))):
                    first[i] += 0.1 * (grad - first[i])
                    second[i] += 0.001 * (grad**2 - second[i])
                    rate = 0.003 * (1 - epoch / epochs)
                    self.w[i] -= rate * (first[i] / (1 - 0.9**step)) / (np.sqrt(second[i] / (1 - 0.999**step)) + 1e-8)

    @staticmethod
    def _soft(z: np.ndarray) -> np.ndarray:
        e = np.exp(z - z.max(axis=1, keepdims=True))
        return e / e.sum(axis=1, keepdims=True)

    def __call__(self, unit: np.ndarray) -> np.ndarray:
        x = unit * np.sqrt(unit.shape[1])
        return self._soft(np.maximum(0, x @ self.w[0] + self.w[1]) @ self.w[2] + self.w[3])


def fit(x: np.ndarray, k: int) -> tuple[Router, int]:
    """The router and how many parts a query looks into, from a sample of unit vectors."""
    parts = int(max(1, len(x) // PER_PART))
    graph = neighbour_graph(x, min(GRAPH, max(1, len(x) - 1))) if len(x) > 1 else np.zeros((len(x), 1), np.int64)
    part = balanced_parts(x, graph, parts)
    wanted = np.zeros((len(x), parts))
    np.add.at(wanted, (np.repeat(np.arange(len(x)), graph.shape[1]), part[graph].ravel()), 1.0)
    wanted[np.arange(len(x)), part] += 1
    router = Router(x, wanted / wanted.sum(axis=1, keepdims=True), epochs=30 if parts > 1 else 1)
    p = router(x)
    index = p.argmax(axis=1)
    place = np.argsort(np.argsort(-p, axis=1, kind="stable"), axis=1, kind="stable")
    depth = place[np.arange(len(x))[:, None], index[graph[:, :k]]]
    found = [(depth < m).mean() for m in range(1, parts + 1)]
    return router, next((m for m, f in enumerate(found, 1) if f >= TARGET), parts)


def best(query_ids: np.ndarray, q: np.ndarray, ids: np.ndarray, x: np.ndarray, k: int) -> pd.DataFrame:
    """The k nearest of x for each query, by exact cosine, ties to the smaller id."""
    out, nx = [], norms(x)
    for at in range(0, len(q), 256):
        part = q[at : at + 256]
        near = (part @ x.T) / nx
        near[query_ids[at : at + 256, None] == ids[None, :]] = -np.inf
        cut = np.partition(near, -min(k, near.shape[1]), axis=1)[:, -min(k, near.shape[1])]
        for i, (row, low) in enumerate(zip(near, cut)):
            some = np.flatnonzero((row >= low - 1e-9 * max(1.0, abs(low))) & np.isfinite(row)) if np.isfinite(low) else np.flatnonzero(np.isfinite(row))
            score = (x[some] * part[i]).sum(axis=1) / (nx[some] * norms(part[i : i + 1]))
            top = np.lexsort((ids[some], -score))[:k]
            out.append(pd.DataFrame({"query_id": query_ids[at + i], "vec_id": ids[some][top], "score": score[top]}))
    return pd.concat(out) if out else pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype({"query_id": "int64", "vec_id": "int64"})


def search(table: DataFrame, is_query: Column, k: int = 5, sample: int = SAMPLE, block: int = BLOCK) -> DataFrame:
    """query_id, rank (from 1), vec_id, score of the k nearest found of each query."""
    spark = table.sparkSession
    schema = "query_id long, vec_id long, score double"
    rows = written(valid(table).dropDuplicates(["vec_id", "v"]))
    size = rows.agg(F.max(F.size("v")).alias("width"), F.count("*").alias("rows")).first()
    width, sample = size.width, min(max(sample, MOST_SAMPLE), max(sample, size.rows // ROWS_PER_SAMPLED))
    if not width:
        return spark.createDataFrame([], schema).select("query_id", F.lit(0).alias("rank"), "vec_id", "score")
    some = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).collect()
    x = matrix([r.v for r in some], width)
    router, probes = fit(x / norms(x)[:, None], k)
    weights = router.w
    parts = weights[3].shape[0]

    def likely(vectors: list) -> np.ndarray:
        x = matrix(vectors, width)
        return router(x / norms(x)[:, None])

    def index(frames):
        for f in frames:
            yield f.assign(part=likely(f["v"].tolist()).argmax(axis=1).astype("int32"))

    held = written(rows.mapInPandas(index, "vec_id long, v array<double>, part int"))
    counts = {r.part: r["count"] for r in held.groupBy("part").count().collect()}

    def route(frames):
        for f in frames:
            order = np.argsort(-likely(f["v"].tolist()), axis=1, kind="stable")
            at, to = [], []
            for i, parts in enumerate(order.tolist()):
                n = total = 0
                for p in parts:
                    if n >= probes and total >= LEAST:
                        break
                    if counts.get(p, 0):
                        n, total = n + 1, total + counts[p]
                        at.append(i)
                        to.append(p)
            yield f.iloc[at].assign(part=np.array(to, "int32"))

    questions = rows.where(is_query).groupBy("vec_id").agg(F.min("v").alias("v"))
    asked = written(questions.mapInPandas(route, "vec_id long, v array<double>, part int"))
    asks = {r.part: r["count"] for r in asked.groupBy("part").count().collect()}
    if not asks:
        return spark.createDataFrame([], schema).select("query_id", F.lit(0).alias("rank"), "vec_id", "score")
    of = lambda n: F.element_at(F.array(*[F.lit(max(1, -(-n.get(p, 0) // block))) for p in range(parts)]), F.col("part") + 1)
    cut = lambda df, n, name: df.withColumn(name, F.pmod(F.xxhash64("vec_id"), of(n)).cast("int")).withColumn("zero", F.lit(0).cast("long"))
    pack = lambda df, name, tag: blocks(df, ["part", name], "zero", width).drop("extra").withColumnsRenamed({"ids": f"ids{tag}", "x": f"x{tag}"})
    candidates = written(pack(cut(held, counts, "c"), "c", 1))
    questions = written(pack(cut(asked, asks, "q"), "q", 2))
    one = candidates.withColumn("q", F.explode(F.sequence(F.lit(0), of(asks) - 1)))
    two = questions.withColumn("c", F.explode(F.sequence(F.lit(0), of(counts) - 1)))
    met = one.join(two, ["part", "c", "q"])

    def run(frames):
        for f in frames:
            for r in f.itertuples():
                ids, _, x = unblock(r.ids1, b"", r.x1, width)
                query_ids, _, q = unblock(r.ids2, b"", r.x2, width)
                yield best(query_ids, q, ids, x, k)

    with rows_in_batch(spark, 8):
        found = written(met.select("ids1", "x1", "ids2", "x2").mapInPandas(run, schema))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op2(table: DataFrame) -> DataFrame:
    return search(table, F.col("vec_id") % 50 == 0)
