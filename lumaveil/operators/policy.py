"""Policies of consumers: which categories are masked, who may call what, with which strategy."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .masking import STRATEGIES


def keep_categories(spans: Column, categories: Column, combos: Column | None = None) -> Column:
    """Spans of the wanted categories (none named: all). combos: array<struct<category,requires_any>>; the first rule of a
    category lets it through only beside one of the others, whether those are wanted or not."""
    present = F.array_distinct(F.transform(spans, lambda s: s["category"]))
    wanted = lambda s: (F.size(categories) <= 0) | F.array_contains(categories, s["category"])
    if combos is None:
        return F.filter(spans, wanted)
    rule = lambda s: F.try_element_at(F.filter(combos, lambda r: r["category"] == s["category"]), F.lit(1))
    return F.filter(spans, lambda s: wanted(s) & F.coalesce(F.arrays_overlap(rule(s)["requires_any"], present), F.lit(True)))


def auth_status(route: Column, system: Column, enabled: Column, key_named: Column, key: Column, given: Column) -> Column:
    """200, 401 or 403. system is null where none matches; key_named: an api key is configured; key: its value."""
    process = route == "process"
    return (
        F.when(system.isNull() | ~F.coalesce(enabled, F.lit(False)), 403)
        .when(~key_named, F.when(process, 200).otherwise(401))
        .when(F.coalesce(key, F.lit("")) == "", 401)
        .when(process & given.isNull(), 200)
        .when(F.sha2(F.coalesce(given, F.lit("")), 256) == F.sha2(key, 256), 200)
        .otherwise(401)
    )


def strategy_of(own: Column, asked: Column, may_override: Column) -> Column:
    """struct<status,strategy>: the asked strategy where that is allowed and known."""
    none = F.coalesce(asked, F.lit("")) == ""
    status = F.when(none, 200).when(~may_override, 403).when(~asked.isin(*STRATEGIES), 400).otherwise(200)
    known = F.when(own.isin(*STRATEGIES), own).otherwise(F.lit("partial"))
    return F.struct(status.alias("status"), F.when(status == 200, F.when(none, known).otherwise(asked)).alias("strategy"))


def request_status(payload: Column, name: Column) -> Column:
    """400 without a payload or id, or with an id of over 256 bytes; an empty payload is one."""
    return F.when(payload.isNull() | name.isNull() | (name == "") | (F.octet_length(name) > 256), 400).otherwise(200)
