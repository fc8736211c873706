"""Readers and writers with explicit schemas, and validated policies."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.lexicon import CATEGORIES
from ..operators.masking import STRATEGIES

LABELLED = "id string, text string, spans array<struct<start:int,end:int,value:string,category:string>>"
LOAD = "id string, text string"
PROCESS = "payload string, payload_id string"
SYSTEM = "id string, enabled boolean, api_key string, categories array<string>, strategy string, unmask boolean, allow_strategy_override boolean, combo_rules array<struct<category:string,requires_any:array<string>>>"


def labelled(spark: SparkSession, path: str) -> DataFrame:
    """Labelled texts; a span given by value gets the offsets of its only occurrence, another makes the read fail."""
    df = spark.read.schema(LABELLED).option("mode", "FAILFAST").json(path).where("text is not null")
    return df.withColumn("spans", place_values(F.col("spans"), F.col("text")))


def place_values(spans: Column, text: Column) -> Column:
    def place(s: Column) -> Column:
        at = F.position(s["value"], text)
        rest = F.substring(text, at + 1, F.char_length(text))
        once = (at > 0) & ~F.contains(rest, s["value"])
        named = F.struct((at - 1).alias("start"), (at - 1 + F.char_length(s["value"])).alias("end"), s["value"].alias("value"), s["category"].alias("category"))
        wrong = F.raise_error(F.concat(F.lit("value does not occur exactly once: "), s["value"])).cast("struct<start:int,end:int,value:string,category:string>")
        return F.when(s["value"].isNull(), s).when(once, named).otherwise(wrong)

    return F.transform(spans, lambda s: place(F.struct(s["start"].alias("start"), s["end"].alias("end"), s["value"].alias("value"), s["category"].alias("category"))))


def requests(lines: DataFrame, column: str = "value") -> DataFrame:
    """payload, payload_id and status from JSON lines: 400 for what is no JSON, has trailing data or lacks a field."""
    body = F.from_json(column, PROCESS + ", _corrupt_record string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"})
    out = lines.withColumn("_b", body).select(*lines.columns, "_b.*")
    bad = F.col("_corrupt_record").isNotNull() | F.col("payload").isNull() | (F.coalesce("payload_id", F.lit("")) == "")
    return out.withColumn("status", F.when(bad, 400).otherwise(200)).drop("_corrupt_record")


def write_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("errorifexists").json(path)


def systems(spark: SparkSession, items: list[dict]) -> DataFrame:
    """The systems table of a configuration; raises on missing ids, repeats, unknown strategies or categories."""
    seen = set()
    for s in items:
        if not s.get("id") or s["id"] in seen:
            raise ValueError(f"system id missing or repeated: {s.get('id')!r}")
        seen.add(s["id"])
        if s.get("strategy", "partial") not in STRATEGIES:
            raise ValueError(f"{s['id']}: unknown strategy {s['strategy']!r}")
        named = [*s.get("categories", []), *(c for r in s.get("combo_rules", []) for c in (r["category"], *r["requires_any"]))]
        if unknown := set(named) - set(CATEGORIES):
            raise ValueError(f"{s['id']}: unknown categories {sorted(unknown)}")
    default = {"enabled": True, "api_key": None, "categories": [], "strategy": "partial", "unmask": True, "allow_strategy_override": False, "combo_rules": []}
    names = [f.split(" ")[0] for f in SYSTEM.split(", ")]
    return spark.createDataFrame([tuple((default | s).get(n) for n in names) for s in items], SYSTEM)


def combo_rules(path: str) -> list[dict]:
    """Combo rules (category, requires_any) from a JSON file, with known categories."""
    with open(path, encoding="utf-8") as f:
        items = json.load(f)
    for r in items:
        if unknown := {r["category"], *r["requires_any"]} - set(CATEGORIES):
            raise ValueError(f"unknown categories {sorted(unknown)}")
    return [{"category": r["category"], "requires_any": list(r["requires_any"])} for r in items]


def dictionary(spark: SparkSession, path: str) -> DataFrame:
    """(word) of a word list: a word a line, in lower case, without blank lines, comments (#) and repeats."""
    lines = spark.read.text(path).select(F.lower(F.trim("value")).alias("word"))
    return lines.where("word <> '' and not startswith(word, '#')").distinct()


def loads(spark: SparkSession, path: str) -> DataFrame:
    """(id, text) of a load corpus in JSON lines; lines without a text are left out."""
    return spark.read.schema(LOAD).json(path).where("text is not null")


CHUNK = "choices array<struct<delta:struct<content:string>,finish_reason:string>>, usage struct<total_tokens:bigint>"


def sse(lines: DataFrame, key: str, order: str, value: str = "value") -> DataFrame:
    """(key, answer, done, total_tokens): the deltas of server-sent events in order; done if [DONE] or a finish reason came."""
    data = lines.where(F.col(value).startswith("data:")).withColumn("_d", F.trim(F.substring(F.col(value), F.lit(6), F.char_length(value))))
    data = data.withColumn("_c", F.from_json("_d", CHUNK))
    choice = F.try_element_at("_c.choices", F.lit(1))
    item = F.struct(F.col(order).alias("o"), F.coalesce(choice["delta"]["content"], F.lit("")).alias("t"))
    done = (F.col("_d") == "[DONE]") | choice["finish_reason"].isNotNull()
    return data.groupBy(key).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(item)), lambda x: x["t"]), "").alias("answer"),
        F.max(F.coalesce(done, F.lit(False))).alias("done"),
        F.max_by("_c.usage.total_tokens", F.when(F.col("_c.usage").isNotNull(), F.col(order))).alias("total_tokens"),
    )
