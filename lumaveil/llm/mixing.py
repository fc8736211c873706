"""Mixing sources to target weights by entropy balancing, in DataFrame operations only.

The weights w of a source's documents minimise the entropy sum w log w - w relative to one copy of each, subject to
sum n w = T (n: a document's words, T: its source's target) and w <= MOST. The dual has one multiplier l a source, and
its solution tilts documents by their words: w = min(MOST, exp(l n)). Each Newton step
l <- l - (sum n w - T) / (sum n^2 w over documents below the bound) takes its two sums over all documents; a bracket of
signs keeps steps that overshoot inside. Documents of one source and size have one weight, so the sums run over
(source, size, count), which are counted before any shuffle; a hot source is many rows of it.

Weights become copies by sequential Poisson rounding: all documents get the whole part, and the fraction left of w
takes one more copy in order of u / fraction (u: a uniform hash of the document's content) until the target is met. The
place where the target is met is found without ordering a source in one task: by sums by a prefix of the order, then by
a longer prefix within the one that holds the place. The documents that share the longer prefix, about a millionth of a
source, are taken in part, alike.

Defined cases: a null text has size 0; sources go by code point with null last as a source of its own; a source
without words has target 0 and its documents are taken 0 times; documents without words have weight 1; rows with a null
doc_id are mixed like others; repeated rows count as often as they come; other columns are kept by `mix` and ignored by
the query; an empty table gives no rows. Reruns agree, as the order depends on content alone.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import dropped, written

WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST = 2
#: Newton steps at most, and those in one job; a job whose sources have all settled is the last.
NEWTON_STEPS, STEPS_IN_JOB = 80, 4
#: Bits of the order in each of its two prefixes.
PREFIX = 10
#: Sources up to which their table is broadcast; it has under 100 bytes a row.
FEW_SOURCES = 10_000
BY = ["_name", "_null"]


def size_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text.cast("string"), F.lit("[^\\x20\\x09-\\x0D]+")), F.lit(0)).cast("long")


def _near(few: DataFrame, rows: int) -> DataFrame:
    """Broadcast where the size is known to be small; else Spark joins by shuffle and splits hot sources."""
    return F.broadcast(few) if rows <= FEW_SOURCES else few


def ranked(sizes: DataFrame) -> DataFrame:
    """Adds rank, from 0, by code point with null last: ranges of sources are counted, then numbered side by side."""
    ranges = max(2, int(sizes.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    dealt = written(sizes.repartitionByRange(ranges, F.col("source").asc_nulls_last()).withColumn("_range", F.spark_partition_id()))
    before = F.sum("_n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1))  # one row a range
    firsts = dealt.groupBy("_range").agg(F.count("*").alias("_n")).select("_range", F.coalesce(before, F.lit(0)).alias("_first"))
    own = F.row_number().over(Window.partitionBy("_range").orderBy(F.col("source").asc_nulls_last()))
    return dealt.join(firsts, "_range").withColumn("rank", F.col("_first") + own - 1).drop("_range", "_first")


def targets(sizes: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """(source, source_size, target) and other columns of sizes; each target at most `most` times the size.

    The targets are level * weight, or the most where that is less. The level rises in rounds: each shares what the
    sources at their most leave among the others, and ends when no other reaches its most; a round is one sum.
    """
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    t = written(ranked(sizes).withColumn("weight", weight).withColumn("full_at", F.col("source_size") * float(most) / F.col("weight")))
    level, full = -1.0, 0
    while True:
        is_full = F.col("full_at") <= F.lit(level)
        r = t.agg(
            F.sum("source_size").alias("all"),
            F.coalesce(F.sum(F.when(is_full, F.col("source_size"))), F.lit(0)).alias("held"),
            F.sum(F.when(~is_full, F.col("weight"))).alias("open"),
            F.count_if(is_full).alias("full"),
        ).first()
        if r["open"] is None or level >= 0 and r["full"] == full:
            break
        full, level = r["full"], (r["all"] * share - r["held"] * float(most)) / r["open"]
    target = F.when(F.col("full_at") <= F.lit(level), F.col("source_size") * float(most)).otherwise(F.lit(level) * F.col("weight"))
    return t.withColumn("target", target).drop("rank", "weight", "full_at")


def weight_of(l: Column, n: Column, most: float = MOST) -> Column:
    return F.when(l * n >= math.log(most), F.lit(float(most))).otherwise(F.exp(l * n))


def multipliers(hist: DataFrame, sources: DataFrame, rows: int, most: float = MOST, steps: int = NEWTON_STEPS) -> DataFrame:
    """sources (_name, _null, source_size, target, least: its smallest size) with l, from hist (_name, _null, size, count)."""
    ratio, least = F.try_divide("target", "source_size"), F.col("least")
    # at `high` all documents are at the bound, at `low` none is above target / source_size
    top = F.lit(math.log(most) * (1 + 1e-12)) / least
    full = F.col("target") >= F.col("source_size") * float(most)
    state = sources.withColumns({"low": F.when(ratio < 1, F.log(ratio) / least).otherwise(0.0), "high": F.when(ratio > 1, top).otherwise(0.0)})
    state = state.withColumn("l", F.when((F.col("source_size") > 0) & full, top).otherwise(0.0))
    state = written(state.withColumn("done", (F.col("source_size") == 0) | full | (F.col("target") == F.col("source_size"))))
    for at in range(0, steps, STEPS_IN_JOB):
        if state.where("not done").isEmpty():
            break
        last = state
        for _ in range(STEPS_IN_JOB):
            state = newton_step(hist, state, rows, most)
        state = written(state)
        dropped(last)
    return state.drop("low", "high", "done")


def newton_step(hist: DataFrame, state: DataFrame, rows: int, most: float) -> DataFrame:
    n, l, low, high = F.col("size"), F.col("l"), F.col("low"), F.col("high")
    w = weight_of(l, n, most)
    own = [c for c in state.columns if c not in BY]
    s = hist.join(_near(state, rows), BY).groupBy(*BY).agg(
        (F.sum(n * w * F.col("count")) - F.first("target")).alias("_off"), F.sum(F.when(w < most, n * n * w * F.col("count")).otherwise(0.0)).alias("_slope"),
        *[F.first(c).alias(c) for c in own],
    )
    s = s.withColumns({"low": F.when(F.col("_off") < 0, l).otherwise(low), "high": F.when(F.col("_off") > 0, l).otherwise(high)})
    newton = l - F.try_divide("_off", "_slope")
    # out of the bracket: its middle, by magnitude
    middle = F.when(low > 0, F.sqrt(low * high)).when(high < 0, -F.sqrt(low * high)).otherwise(F.when(low == 0, high).otherwise(low) / 16)
    settled = F.col("done") | (F.abs("_off") <= F.col("target") * 1e-9) | (high - low <= F.abs(low + high) * 1e-15)
    moved = F.when((F.col("_slope") > 0) & (newton > low) & (newton < high), newton).otherwise(middle)
    return s.select(*BY, *[c for c in own if c not in ("l", "done")], F.when(settled, l).otherwise(moved).alias("l"), settled.alias("done"))


def taken(docs: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """_row (a struct of the document's columns), size, source_size, target, rate (w), whole (copies) and taken (words)."""
    rows = docs.select(F.struct("*").alias("_row"))
    doc_id, text, source = (F.col(f"_row.{c}") for c in ("doc_id", "text", "source"))
    name, null = F.coalesce(source.cast("string"), F.lit("")), source.isNull()
    uniform = (F.shiftrightunsigned(F.xxhash64(doc_id, text, name, null), 12) + 0.5) / float(1 << 52)
    rows = rows.withColumns({"_name": name, "_null": null, "size": size_of(text), "_u": uniform})
    slim = written(rows.select(*BY, "size", "_u"))
    hist = written(slim.groupBy(*BY, "size").agg(F.count("*").alias("count")))
    sizes = hist.groupBy(*BY).agg(F.sum(F.col("size") * F.col("count")).alias("source_size"), F.min(F.when(F.col("size") > 0, F.col("size"))).alias("least"))
    sources = targets(sizes.withColumn("source", F.when(~F.col("_null"), F.col("_name"))), weights, share, most).drop("source")
    sources = written(sources)
    n = sources.count()
    solved = multipliers(hist, sources, n, most)

    rate = weight_of(F.col("l"), F.col("size"), most)
    whole, part = F.floor(rate), rate - F.floor(rate)
    odds = F.try_divide(F.col("_u"), part)
    order = F.when(part > 0, F.least(F.floor(odds / (1 + odds) * (1 << 2 * PREFIX)), F.lit((1 << 2 * PREFIX) - 1)).cast("long"))
    # what the whole copies leave of the target, and whether all the others together do not reach it
    rest = hist.join(_near(solved.select(*BY, "l"), n), BY).groupBy(*BY).agg(F.sum(whole * F.col("size") * F.col("count")).alias("_held"), F.sum(F.when(part > 0, F.col("size") * F.col("count")).otherwise(0)).alias("_open"))
    few = solved.join(_near(rest, n), BY).withColumn("_more", F.greatest(F.round("target").cast("long") - F.col("_held"), F.lit(0).cast("long")))
    few = written(few.withColumn("_every", F.col("_more") >= F.col("_open")).drop("least", "_held", "_open"))
    placed = slim.join(_near(few.select(*BY, "l"), n), BY).withColumn("_at", order).where("_at is not null").select(*BY, "size", "_at")

    def place(parts: DataFrame, at: str, more: DataFrame) -> DataFrame:
        """The part of each source in which its extra words end, its size, and how many of them it gives."""
        until = F.sum("_n").over(Window.partitionBy(*BY).orderBy(at))
        ends = parts.withColumn("_until", until).join(_near(more, n), BY)
        ends = ends.where((F.col("_until") > F.col("_more")) & (F.col("_until") - F.col("_n") <= F.col("_more")))
        return written(ends.select(*BY, at, F.col("_n").alias("_size"), (F.col("_more") - F.col("_until") + F.col("_n")).alias("_more")))

    by_prefix = placed.groupBy(*BY, F.shiftright("_at", PREFIX).alias("_p")).agg(F.sum("size").alias("_n"))
    first = place(by_prefix, "_p", few.where("not _every").select(*BY, "_more"))
    inside = placed.join(_near(first.select(*BY, "_p"), n), BY).where(F.shiftright("_at", PREFIX) == F.col("_p"))
    second = place(inside.groupBy(*BY, F.col("_at").alias("_q")).agg(F.sum("size").alias("_n")), "_q", first.select(*BY, "_more"))
    ended = written(few.drop("_more").join(second, BY, "left"))
    rows = rows.join(_near(ended, n), BY).withColumns({"rate": rate, "whole": whole, "_at": order})
    shared = F.round(F.try_divide(F.col("size") * F.col("_more"), F.col("_size"))).cast("long")
    extra = F.when(F.col("_at").isNull(), 0).when(F.col("_every") | (F.col("_at") < F.col("_q")), F.col("size")).when(F.col("_at") == F.col("_q"), shared).otherwise(0)
    return rows.select("_row", "size", "source_size", "target", "rate", "whole", (F.col("whole") * F.col("size") + extra).cast("long").alias("taken"))


def mix(docs: DataFrame, **how) -> DataFrame:
    """docs with each row as often as its rate's rounding says; a part of half a document or more counts as one."""
    t = taken(docs, **how)
    copies = F.when(F.col("size") > 0, F.round(F.try_divide("taken", "size"))).otherwise(F.col("whole")).cast("int")
    return t.withColumn("_copies", copies).where("_copies > 0").select("_row", F.explode(F.sequence(F.lit(1), "_copies"))).select("_row.*")


def op7(docs: DataFrame) -> DataFrame:
    t = taken(docs.select("doc_id", "text", "source"))
    return t.select(F.col("_row.doc_id").cast("long").alias("doc_id"), "size", "source_size", "target", "taken")
