"""Counters, histograms, quantiles and rates over request logs and events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Upper bounds of buckets in seconds.
REQUEST_BUCKETS = (0.001, 0.0025, 0.005, 0.01, 0.025, 0.05, 0.1, 0.25, 0.5, 1.0, 2.5, 5.0)
MODEL_BUCKETS = (0.05, 0.1, 0.25, 0.5, 1.0, 2.5, 5.0, 10.0, 30.0, 60.0)


def counters(df: DataFrame, *labels: str) -> DataFrame:
    return df.groupBy(*labels).agg(F.count("*").alias("n"))


def histogram(df: DataFrame, value: str, bounds: tuple[float, ...], *labels: str) -> DataFrame:
    """(labels, le, n): rows at or below each bound, cumulative; le is infinite in the last."""
    sums = [F.count_if(F.col(value) <= b).alias(f"b{i}") for i, b in enumerate(bounds)]
    wide = df.groupBy(*labels).agg(*sums, F.count(value).alias("all"))
    pairs = [F.struct(F.lit(float(b)).alias("le"), F.col(f"b{i}").alias("n")) for i, b in enumerate(bounds)]
    pairs.append(F.struct(F.lit(float("inf")).alias("le"), F.col("all").alias("n")))
    return wide.select(*labels, F.inline(F.array(*pairs)))


def quantile_of_buckets(df: DataFrame, q: float, *labels: str) -> DataFrame:
    """Quantiles by linear interpolation inside the bucket that holds them; df: (labels, le, n) as of histogram."""
    by = Window.partitionBy(*labels).orderBy("le")
    t = df.withColumn("low", F.coalesce(F.lag("le").over(by), F.lit(0.0))).withColumn("under", F.coalesce(F.lag("n").over(by), F.lit(0)))
    t = t.withColumn("rank", F.max("n").over(Window.partitionBy(*labels)) * q).where((F.col("n") >= F.col("rank")) & (F.col("n") > F.col("under")))
    first = t.groupBy(*labels).agg(F.min_by(F.struct("le", "low", "n", "under", "rank"), "le").alias("b"))
    inside = F.col("b.low") + (F.col("b.le") - F.col("b.low")) * (F.col("b.rank") - F.col("b.under")) / (F.col("b.n") - F.col("b.under"))
    return first.select(*labels, F.when(F.col("b.le") == float("inf"), F.col("b.low")).otherwise(inside).alias("quantile"))


def nearest_rank(df: DataFrame, value: str, quantiles: dict[str, float], *labels: str) -> DataFrame:
    return df.groupBy(*labels).agg(*[F.expr(f"percentile_disc({q}) within group (order by `{value}`)").alias(name) for name, q in quantiles.items()])


def rate(df: DataFrame, ts: str, width: str, seconds: int, *labels: str) -> DataFrame:
    w = df.groupBy(F.window(ts, width).alias("w"), *labels).agg(F.count("*").alias("n"))
    return w.select(F.col("w.start").alias("start"), *labels, "n", (F.col("n") / seconds).alias("per_second"))


def in_flight(df: DataFrame, start: str, end: str, *by: str) -> DataFrame:
    """(by, ts, n): how many intervals are open after each start or end, for each value of `by`."""
    ends = df.select(*by, F.explode(F.array(F.struct(F.col(start).alias("ts"), F.lit(1).alias("d")), F.struct(F.col(end).alias("ts"), F.lit(-1).alias("d")))).alias("e")).select(*by, "e.ts", "e.d")
    steps = ends.groupBy(*by, "ts").agg(F.sum("d").alias("d"))
    return steps.select(*by, "ts", F.sum("d").over(Window.partitionBy(*by).orderBy("ts")).alias("n"))


def percent(n: Column, total: Column) -> Column:
    return F.when(total == 0, 0.0).otherwise(n / total * 100)


def exposition(df: DataFrame, name: str, kind: str, value: str, *labels: str) -> DataFrame:
    """(line): samples in the text format of metric scrapers, one a row, after their type; labels in the order given."""
    escaped = lambda c: F.regexp_replace(F.regexp_replace(F.regexp_replace(F.col(c).cast("string"), r"\\", r"\\\\"), '"', r'\\"'), "\n", r"\\n")
    pairs = F.concat_ws(",", *[F.concat(F.lit(f'{c}="'), escaped(c), F.lit('"')) for c in labels])
    line = F.concat(F.lit(name), F.lit("{") if labels else F.lit(""), pairs, F.lit("}") if labels else F.lit(""), F.lit(" "), F.col(value).cast("string"))
    head = df.sparkSession.range(1).select(F.lit(f"# TYPE {name} {kind}").alias("line"))
    return head.unionAll(df.select(line.alias("line")))


def load_report(log: DataFrame, seconds: float) -> DataFrame:
    """(section, name, value) of a request log (route, status, ms): totals, codes ascending, and latencies of good requests."""
    total = log.agg(F.count("*").alias("n"), F.count_if(F.col("status") == 200).alias("ok"), F.count_if(F.col("status") == 429).alias("busy")).first()
    spark = log.sparkSession
    rows = [("load", "requests", float(total.n)), ("load", "achieved_rps", total.n / seconds), ("load", "successful_rps", total.ok / seconds), ("load", "busy_percent", total.busy / total.n * 100 if total.n else 0.0)]
    codes = log.groupBy("status").agg(F.count("*").cast("double").alias("value")).select(F.lit("codes").alias("section"), F.col("status").cast("string").alias("name"), "value")
    wanted = {"p50": 0.5, "p90": 0.9, "p95": 0.95, "p99": 0.99, "max": 1.0}
    ranks = nearest_rank(log.where("status = 200"), "ms", wanted, "route")
    latencies = ranks.select(F.concat(F.lit("latency "), "route").alias("section"), F.inline(F.array(*[F.struct(F.lit(n).alias("name"), F.col(n).cast("double").alias("value")) for n in wanted])))
    return spark.createDataFrame(rows, "section string, name string, value double").unionByName(codes).unionByName(latencies)


def report_text(report: DataFrame) -> str:
    """The report as Markdown, a table for each section; codes are numbers in order. It has a few dozen rows."""
    rows = report.collect()
    out = []
    for section in sorted({r.section for r in rows}, key=lambda s: (s != "load", s != "codes", s)):
        mine = [r for r in rows if r.section == section]
        mine.sort(key=lambda r: (int(r.name) if section == "codes" else 0))
        out += [f"## {section}", "", "| name | value |", "|-|-|", *(f"| {r.name} | {r.value:g} |" for r in mine), ""]
    return "\n".join(out)
