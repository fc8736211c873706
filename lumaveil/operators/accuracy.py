"""Precision, recall and F1 of found spans against labelled ones."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def score(found: DataFrame, expected: DataFrame, key: str = "id", share: float = 0.8, strict: bool = True) -> DataFrame:
    """(category, tp, fp, fn, precision, recall, f1) and a TOTAL row. Both inputs: (key, start, end, category).

    A found span matches the expected one of its category that it overlaps most, if the overlap is `share` of both
    (strict) or of either. The first match of an expected span is a true positive, others count for nothing.
    """
    f = found.select(key, "category", F.col("start").alias("fs"), F.col("end").alias("fe")).distinct()
    x = expected.select(key, "category", F.col("start").alias("xs"), F.col("end").alias("xe")).distinct()
    overlap = F.least("fe", "xe") - F.greatest("fs", "xs")
    both, either = F.least, F.greatest
    part = (both if strict else either)(overlap / (F.col("fe") - F.col("fs")), overlap / (F.col("xe") - F.col("xs")))
    met = f.join(x, [key, "category"]).where((F.col("fs") < F.col("xe")) & (F.col("xs") < F.col("fe")))
    best = met.withColumn("part", part).withColumn("n", F.row_number().over(Window.partitionBy(key, "category", "fs", "fe").orderBy(F.desc("part"), "xs", "xe"))).where("n = 1")
    good = best.where(F.col("part") >= share)
    tp = good.select(key, "category", "xs", "xe").distinct().groupBy("category").agg(F.count("*").alias("tp"))
    fp = f.join(good.select(key, "category", "fs", "fe"), [key, "category", "fs", "fe"], "left_anti").groupBy("category").agg(F.count("*").alias("fp"))
    fn = x.join(good.select(key, "category", "xs", "xe"), [key, "category", "xs", "xe"], "left_anti").groupBy("category").agg(F.count("*").alias("fn"))
    rows = tp.join(fp, "category", "full").join(fn, "category", "full").na.fill(0)
    rows = rows.rollup("category").agg(*[F.sum(c).alias(c) for c in ("tp", "fp", "fn")]).withColumn("category", F.coalesce("category", F.lit("TOTAL")))
    ratio = lambda a, b: F.when(a + b == 0, 0.0).otherwise(a / (a + b))
    rows = rows.withColumn("precision", ratio(F.col("tp"), F.col("fp"))).withColumn("recall", ratio(F.col("tp"), F.col("fn")))
    f1 = F.when(F.col("precision") + F.col("recall") == 0, 0.0).otherwise(2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall")))
    return rows.withColumn("f1", f1)
