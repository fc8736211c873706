"""Embedding near-dedup: exact threshold pairs by dual traversal of cover trees.

On the unit sphere a cosine of at least c is a distance of at most t = sqrt(2 - 2c). Equal vectors are one point with
a weight. A bounded sample gives pivots, the tree's top; points go to the nearest pivot and, by content, to blocks of a
bounded size. Each block gets a cover tree once: nested nets of centres with halving radii, every point below a centre
within the radius. Pairs of blocks whose pivots' balls are further apart than t are left out; the others are traversed:
of all pairs of nodes at hand, those whose centres are further apart than t and both covering radii are dropped, those
within t less both radii are taken whole (without looking at their points), the others opened; at the points the cosine
decides. Pairs of centres are compared many at once. Whole node pairs add their weights to the counts and join their
points, so a tight group costs few steps however large.

Links come out of a pair of blocks as a spanning star of each connected part, never as all pairs.

Defined cases: vectors that are null, zero or hold null or non-finite components link with nothing, as do rows
without a vec_id (their component is null); repeated rows are vectors of their own; a cosine of exactly the threshold
links; shorter vectors count as padded with zeros; very wide vectors make blocks of fewer rows; other columns are
ignored; an empty table gives no rows.
"""

from __future__ import annotations

import pickle

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, rows_in_batch, written
from .vectors import cosines, is_valid, matrix, norms, valid

THRESHOLD = 0.95
#: Numbers in a block's matrix: vectors times width.
BLOCK = 1 << 19
#: Sampled vectors for pivots, and pivots at most.
SAMPLE, PIVOTS = 4000, 256
RADII = (0.5, 0.25, 0.125, 0.0625)
SLACK = 1e-9
#: Centres compared at once with others, and pairs of nodes looked at together.
CHUNK, PAIRS = 1024, 1 << 16


def net(x: np.ndarray, radius: float) -> np.ndarray:
    """For each point its centre (a point): each next point that no centre before it has within the radius is one."""
    own = np.full(len(x), -1)
    left = np.arange(len(x))
    own_square = (x * x).sum(axis=1)
    while len(left):
        some = left[:CHUNK]
        near = own_square[some][:, None] + own_square[left][None, :] - 2 * (x[some] @ x[left].T) <= radius * radius
        for i, c in enumerate(some.tolist()):
            if own[c] < 0:
                mine = left[near[i]]
                own[mine[own[mine] < 0]] = c
                own[c] = c
        left = left[own[left] < 0]
    return own


class Tree:
    """Nested nets over unit vectors. Of node i: order[first[i]:last[i]] are its points, centre[i] one of them, radius[i] the
    distance of the furthest, below[i]:below[i] + many[i] its children's places in `children`."""

    def __init__(self, x: np.ndarray, radii=RADII):
        self.order = np.empty(len(x), np.int32)
        nodes: list[tuple[int, int, int, float, list[int]]] = []
        done = 0

        def add(points: np.ndarray, centre: int, level: int) -> int:
            nonlocal done
            if len(points) == 1:
                self.order[done] = points[0]
                done += 1
                nodes.append((done - 1, done, centre, 0.0, []))
                return len(nodes) - 1
            start, kids = done, []
            while level < len(radii):
                own = points[net(x[points], radii[level])]
                level += 1
                if (own != own[0]).any():
                    by = np.argsort(own, kind="stable")
                    cuts = np.flatnonzero(np.diff(own[by])) + 1
                    kids = [add(points[part], int(own[part[0]]), level) for part in np.split(by, cuts)]
                    break
            if not kids:
                self.order[done : done + len(points)] = points
                done += len(points)
            radius = float(np.sqrt(((x[points] - x[centre]) ** 2).sum(axis=1).max()))
            nodes.append((start, done, centre, radius, kids))
            return len(nodes) - 1

        own = net(x, radii[0])
        by = np.argsort(own, kind="stable")
        self.roots = np.array([add(part, int(own[part[0]]), 1) for part in np.split(by, np.flatnonzero(np.diff(own[by])) + 1)], np.int32)
        self.first, self.last, self.centre = (np.array([n[k] for n in nodes], np.int32) for k in range(3))
        self.radius = np.array([n[3] for n in nodes])
        self.many = np.array([len(n[4]) for n in nodes], np.int32)
        self.below = np.concatenate([[0], np.cumsum(self.many)[:-1]]).astype(np.int32)
        self.children = np.array([k for n in nodes for k in n[4]], np.int32)

    def points(self, i: int) -> np.ndarray:
        return self.order[self.first[i] : self.last[i]]


class Links:
    """Counts and connected parts of the points of one or two trees, by dual traversal."""

    def __init__(self, x: np.ndarray, weight: np.ndarray, threshold: float):
        self.x, self.weight, self.threshold = x, weight, threshold
        self.norm = norms(x)
        self.unit = x / self.norm[:, None]
        self.reach = float(np.sqrt(max(0.0, 2 - 2 * threshold)))
        self.count = np.zeros(len(x), np.int64)
        self.part = np.arange(len(x))
        self.opened = self.dropped = self.whole = 0

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        """The parts of a[i] and b[i] become one, for all i."""
        root = np.arange(len(self.part))
        one, two = self.part[a], self.part[b]
        while len(one):
            low = np.minimum(one, two)
            np.minimum.at(root, one, low)
            np.minimum.at(root, two, low)
            while (root[root] != root).any():
                root = root[root]
            one, two = root[one], root[two]
            some = one != two
            one, two = one[some], two[some]
        self.part = root[self.part]

    def linked(self, a: np.ndarray, b: np.ndarray) -> None:
        """a[i] and b[i] are linked, for all i."""
        np.add.at(self.count, a, self.weight[b])
        np.add.at(self.count, b, self.weight[a])
        self.join(a, b)

    def decide(self, a: np.ndarray, b: np.ndarray) -> None:
        """The cosine decides for the points a[i] and b[i]."""
        near = (self.unit[a] * self.unit[b]).sum(axis=1)
        yes = near >= self.threshold
        close = np.flatnonzero(np.abs(near - self.threshold) < SLACK)
        yes[close] = cosines(self.x[a[close]], self.x[b[close]]) >= self.threshold
        self.linked(a[yes], b[yes])

    def compare(self, a: np.ndarray, b: np.ndarray, same: bool) -> None:
        """All pairs of points of two leaves, or of one."""
        for k in range(0, len(a), CHUNK):
            near = self.unit[a[k : k + CHUNK]] @ self.unit[b].T >= self.threshold - SLACK
            i, j = np.nonzero(near)
            i += k
            if same:
                i, j = i[i < j], j[i < j]
            self.decide(a[i], b[j])

    def take(self, a: np.ndarray, b: np.ndarray) -> None:
        self.count[a] += self.weight[b].sum()
        self.count[b] += self.weight[a].sum()
        both = np.concatenate([a, b])
        self.join(both[:-1], both[1:])

    def take_one(self, a: np.ndarray) -> None:
        self.count[a] += self.weight[a].sum() - self.weight[a]
        self.join(a[:-1], a[1:])

    def cross(self, s: Tree, t: Tree, at_s: int, at_t: int, ones: np.ndarray, twos: np.ndarray, same: bool):
        """Pairs of the nodes `ones` of s and `twos` of t that are not too far apart (if same, each once), by products of
        matrices in single precision, with room for its errors."""
        for wide_one in (False, True):  # nodes of one point, and others
            one = ones[(s.radius[ones] > 0) == wide_one]
            u = self.unit[s.centre[one] + at_s].astype(np.float32)
            for wide_two in (False, True):
                two = twos[(t.radius[twos] > 0) == wide_two]
                if not len(one) or not len(two):
                    continue
                v = self.unit[t.centre[two] + at_t].astype(np.float32).T
                reach = min(2.0, self.reach + s.radius[one].max() + t.radius[two].max())
                for k in range(0, len(one), CHUNK):
                    i, j = np.nonzero(u[k : k + CHUNK] @ v >= 1 - reach * reach / 2 - 1e-5)
                    a, b = one[i + k], two[j]
                    keep = a <= b if same else slice(None)
                    self.dropped += len(u[k : k + CHUNK]) * len(two) - len(a)
                    yield a[keep], b[keep]

    def traverse(self, s: Tree, t: Tree, at_s: int, at_t: int) -> None:
        """Links between the points of s and t, whose points here start at at_s and at_t; s may be t.

        Of the pairs at hand at most PAIRS are looked at together; the last opened come first.
        """
        same = s is t
        for first in self.cross(s, t, at_s, at_t, s.roots, t.roots, same):
            todo = [first]
            while todo:
                a, b = todo.pop()
                if len(a) > PAIRS:
                    todo.append((a[PAIRS:], b[PAIRS:]))
                    a, b = a[:PAIRS], b[:PAIRS]
                if len(a):
                    todo += self.step(s, t, at_s, at_t, same, a, b)

    def step(self, s: Tree, t: Tree, at_s: int, at_t: int, same: bool, a: np.ndarray, b: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """Drops, takes or decides pairs of nodes (a[i], b[i]); gives the pairs that the others open to."""
        c, d = s.centre[a] + at_s, t.centre[b] + at_t
        r1, r2 = s.radius[a], t.radius[b]
        own = (a == b) if same else np.zeros(len(a), bool)
        far = np.sqrt(((self.unit[c] - self.unit[d]) ** 2).sum(axis=1))
        points = (s.last[a] - s.first[a] == 1) & (t.last[b] - t.first[b] == 1)
        near = (far - r1 - r2 <= self.reach + 1e-7) & ~(own & points)
        whole = near & (np.where(own, 2 * r1, far + r1 + r2) <= self.reach - 1e-7)
        self.dropped += int((~near).sum())
        self.whole += int(whole.sum())
        self.linked(c[whole & points], d[whole & points])
        for i in np.flatnonzero(whole & ~points):
            if own[i]:
                self.take_one(s.points(a[i]) + at_s)
            else:
                self.take(s.points(a[i]) + at_s, t.points(b[i]) + at_t)
        rest = near & ~whole
        self.decide(c[rest & points], d[rest & points])
        leaves = rest & ~points & (s.many[a] == 0) & (t.many[b] == 0)
        for i in np.flatnonzero(leaves):
            self.compare(s.points(a[i]) + at_s, t.points(b[i]) + at_t, bool(own[i]))
        opened = rest & ~points & ~leaves
        self.opened += int(opened.sum())
        out = []
        first = opened & ~own & (s.many[a] > 0) & ((r1 >= r2) | (t.many[b] == 0))
        second = opened & ~own & ~first
        for some, tree, node, other in ((first, s, a, b), (second, t, b, a)):
            n = tree.many[node[some]].astype(np.int64)
            kids = tree.children[np.repeat(tree.below[node[some]] - np.cumsum(n) + n, n) + np.arange(n.sum())]
            rest_of = np.repeat(other[some], n)
            x, y = (kids, rest_of) if tree is s and some is first else (rest_of, kids)
            out.append((np.minimum(x, y), np.maximum(x, y)) if same else (x, y))
        for i in a[opened & own].tolist():
            kids = s.children[s.below[i] : s.below[i] + s.many[i]]
            out += list(self.cross(s, s, at_s, at_s, kids, kids, True))
        return out


def unit(x: np.ndarray) -> np.ndarray:
    return x / norms(x)[:, None]


def pivots_of(x: np.ndarray, most: int = PIVOTS) -> np.ndarray:
    """Unit vectors far from each other: each next one is the sampled vector furthest from those before."""
    x = unit(x)
    chosen = [0]
    d = ((x - x[0]) ** 2).sum(axis=1)
    while len(chosen) < min(most, len(x)) and d.max() > 0.25:
        chosen.append(int(d.argmax()))
        d = np.minimum(d, ((x - x[chosen[-1]]) ** 2).sum(axis=1))
    return x[chosen]


def links(points: DataFrame, threshold: float = THRESHOLD, block: int = BLOCK) -> DataFrame:
    """(id, other, n): a link in a spanning star (n 0), or n links of id (other null); points: vec_id, w, v."""
    spark = points.sparkSession
    size = points.agg(F.max(F.size("v")).alias("width"), F.count("*").alias("rows")).first()
    width = size.width
    schema = "id long, other long, n long"
    if not width:
        return spark.createDataFrame([], schema)
    block = max(1, block // width)
    sample = points.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).collect()
    pivots = pivots_of(matrix([r.v for r in sample], width), max(1, min(PIVOTS, size.rows // block)))

    def place(frames):
        for f in frames:
            x = unit(matrix(f["v"].tolist(), width))
            d = ((x * x).sum(axis=1)[:, None] + 1 - 2 * x @ pivots.T).clip(0)
            yield f.assign(cell=d.argmin(axis=1).astype("int32"), far=np.sqrt(d.min(axis=1)))

    placed = written(points.mapInPandas(place, "vec_id long, w long, v array<double>, cell int, far double"))
    sizes = {r.cell: (r["count"], r.far) for r in placed.groupBy("cell").agg(F.count("*").alias("count"), F.max("far").alias("far")).collect()}
    cells = sorted(sizes)
    parts = {c: -(-sizes[c][0] // block) for c in cells}
    first = dict(zip(cells, np.cumsum([0, *[parts[c] for c in cells]]).tolist()))
    total = sum(parts.values())
    of = lambda values: F.element_at(F.array(*[F.lit(values.get(c, 0)) for c in range(len(pivots))]), F.col("cell") + 1)
    number = (of(first) + F.pmod(F.xxhash64("v"), of(parts))).cast("int")

    def pack(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["vec_id", "w"])
        x = matrix(frame["v"].tolist(), width)
        small = x.astype(np.float32)
        held = small if (small == x).all() else x  # vectors that came in single precision stay so
        return pd.DataFrame({"block": [frame["block"].iloc[0]], "held": [pickle.dumps((frame["vec_id"].to_numpy(np.int64), frame["w"].to_numpy(np.int64), held, Tree(unit(x))), protocol=5)]})

    packed = written(placed.withColumn("block", number).groupBy("block").applyInPandas(pack, "block int, held binary"))
    # pairs of cells whose balls are within reach, at most PIVOTS^2, and of their blocks
    far = np.sqrt(((pivots[cells][:, None] - pivots[cells][None]) ** 2).sum(axis=2))
    radius = np.array([sizes[c][1] for c in cells])
    near = far - radius[:, None] - radius[None] <= np.sqrt(max(0.0, 2 - 2 * threshold)) + 1e-6
    meets = spark.createDataFrame([(int(first[cells[i]]), int(parts[cells[i]]), int(first[cells[j]]), int(parts[cells[j]])) for i, j in zip(*np.nonzero(near))], "a long, n long, b long, m long")
    pairs = meets.select(F.explode(F.sequence(F.col("a"), F.col("a") + F.col("n") - 1).cast("array<int>")).alias("i"), "b", "m")
    pairs = pairs.select("i", F.explode(F.sequence(F.col("b"), F.col("b") + F.col("m") - 1).cast("array<int>")).alias("j"))
    # around the circle of blocks, each meets those up to half way on: each pair once, each block as often
    k = F.pmod(F.col("j") - F.col("i"), F.lit(total))
    pairs = pairs.where((k * 2 < total) | ((k * 2 == total) & (F.col("i") < F.col("j"))))
    met = pairs.join(packed.select(F.col("block").alias("i"), F.col("held").alias("one")), "i").join(packed.select(F.col("block").alias("j"), F.col("held").alias("two")), "j")

    def run(frames):
        for f in frames:
            for r in f.itertuples():
                ids, w, x, t = pickle.loads(r.one)
                if r.i == r.j:
                    found = Links(x.astype(np.float64), w, threshold)
                    found.traverse(t, t, 0, 0)
                else:
                    ids2, w2, x2, t2 = pickle.loads(r.two)
                    found = Links(np.concatenate([x, x2]).astype(np.float64), np.concatenate([w, w2]), threshold)
                    found.traverse(t, t2, 0, len(ids))
                    ids = np.concatenate([ids, ids2])
                some = np.flatnonzero(found.count)
                yield pd.DataFrame({"id": ids[some], "other": pd.array([None] * len(some), "Int64"), "n": found.count[some]})
                some = np.flatnonzero(found.part != np.arange(len(ids)))
                yield pd.DataFrame({"id": ids[some], "other": pd.array(ids[found.part[some]], "Int64"), "n": 0})

    with rows_in_batch(spark, 8):
        return written(met.mapInPandas(run, schema))


def near_duplicates(table: DataFrame, threshold: float = THRESHOLD, block: int = BLOCK) -> DataFrame:
    """vec_id, n_links, component_id and kept for every row."""
    rows = table.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"))
    good = valid(table)
    content = [F.xxhash64("v").alias("k1"), F.xxhash64(F.reverse("v"), F.lit(1)).alias("k2")]
    classes = written(good.select("vec_id", "v", *content).groupBy("k1", "k2").agg(F.min("vec_id").alias("rep"), F.count("*").alias("w"), F.first("v").alias("v")))
    found = links(classes.select(F.col("rep").alias("vec_id"), "w", "v"), threshold, block)
    parts = components(found.where("other is not null").select(F.col("id").alias("a"), F.col("other").alias("b")))
    counts = found.where("other is null").groupBy("id").agg(F.sum("n").alias("n"))
    reps = classes.select("k1", "k2", "rep", "w").join(counts.withColumnRenamed("id", "rep"), "rep", "left")
    reps = reps.join(parts.withColumnRenamed("node", "rep"), "rep", "left")
    reps = reps.select("k1", "k2", (F.coalesce("n", F.lit(0)) + F.col("w") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    known = good.select("vec_id", *content).join(reps, ["k1", "k2"]).select("vec_id", "n_links", "component_id")
    other = rows.where(F.col("vec_id").isNull() | ~is_valid(F.col("v"))).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    out = known.unionByName(other)
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


def op6(table: DataFrame) -> DataFrame:
    return near_duplicates(table)
