"""Detection as a DataFrame operator: text -> array of resolved spans.

The rules and grammars need the words around a match, so they run in one Arrow function that sees each text once and
resolves overlaps as it goes; small tables are spread over the cores before it. resolve and tell_dates are the same steps as native expressions, for spans from elsewhere
(such as columns.find_spans). A prefilter keeps texts with nothing to find (only lower-case ASCII without a digit, an @
or "citizen") out of Python.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.lexicon import CATEGORIES, DIVISION_WORDS, ISSUE_WORDS, OTHER_PAPERS, OTHER_PAPERS_WHOLE, BIRTH_WORDS
from . import addresses, people, phrases, places, rules
from .rules import Span, Text, left_word

SPAN = T.StructType(
    [T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("category", T.StringType()),
     T.StructField("detector", T.StringType()), T.StructField("confidence", T.DoubleType())]
)
SPANS = T.ArrayType(SPAN)
#: Words of a text looked at together, and what neighbouring parts share, in characters.
PART, OVERLAP, WHOLE = 32 << 10, 4 << 10, 40 << 10


class Registry:
    """Detectors in their order: name, the categories they can give, and a function of a Text."""

    def __init__(self) -> None:
        self.detectors: list[tuple[str, frozenset[str], Callable[[Text], list[Span]]]] = []

    def add(self, name: str, categories: set[str], find: Callable[[Text], list[Span]]) -> "Registry":
        if unknown := set(categories) - set(CATEGORIES):
            raise ValueError(f"unknown categories: {sorted(unknown)}")
        self.detectors.append((name, frozenset(categories), find))
        return self

    def enabled(self, categories: list[str]) -> "Registry":
        out = Registry()
        out.detectors = [d for d in self.detectors if not categories or d[1] & set(categories)]
        return out

    def __call__(self, text: str) -> list[Span]:
        t = Text(text)
        return [s for _, _, find in self.detectors for s in find(t)]


def default() -> Registry:
    r = Registry().add("regex", {x.category for x in rules.RULES} | {"birth_date"}, rules.detect)
    r.add("datewords", {"date", "birth_date"}, phrases.russian(phrases.dates_in_words)).add("names", {"full_name"}, people.names)
    r.add("cardholder", {"card_holder"}, phrases.holders).add("address", {"address"}, phrases.russian(addresses.addresses))
    r.add("birthplace", {"birth_place"}, phrases.russian(places.birth_places)).add("citizenship", {"citizenship"}, places.citizenships)
    return r.add("issuer", {"passport_issuer"}, phrases.russian(places.issuers))


def parts(text: str) -> list[tuple[int, str]]:
    """(offset, part): long texts in parts that end at white space and share OVERLAP characters on each side."""
    if len(text) <= WHOLE:
        return [(0, text)]

    def at_space(i: int) -> int:
        j = max(text.rfind(" ", max(0, i - OVERLAP), i), text.rfind("\n", max(0, i - OVERLAP), i))
        return j + 1 if j >= 0 else i

    cuts = [0]
    while len(text) - cuts[-1] > WHOLE:
        cuts.append(at_space(cuts[-1] + PART))
    cuts.append(len(text))
    return [(a := max(0, at_space(max(0, x - OVERLAP)) if x else 0), text[a : min(len(text), y + OVERLAP)]) for x, y in zip(cuts, cuts[1:])]


def raw_spans(text: str, registry: Registry) -> list[Span]:
    seen = {}
    for offset, part in parts(text):
        for a, b, *rest in registry(part):
            seen.setdefault((a + offset, b + offset, rest[0], rest[1]), rest[2])
    return [(a, b, c, d, f) for (a, b, c, d), f in seen.items()]


def resolved(spans: list[Span], text: str) -> list[Span]:
    """resolve of one text's spans."""
    size = lambda s: len(text[s[0] : s[1]].encode())
    kept: list[Span] = []
    for s in sorted(spans, key=lambda s: (s[0], -s[1], -s[4], ORDER.index(s[3]) if s[3] in ORDER else -1)):
        if not kept or s[0] >= kept[-1][1]:
            kept.append(s)
        elif s[4] > kept[-1][4] or s[4] == kept[-1][4] and size(s) > size(kept[-1]):
            kept[-1] = s
    return kept


def dates_told(spans: list[Span], text: str) -> list[Span]:
    """tell_dates of one text's spans."""
    if not any(s[2] in ("date", "birth_date") for s in spans):
        return spans
    t = Text(text)
    issuer_ends = [(s[0], s[1]) for s in spans if s[2] == "passport_issuer"]

    def distance(window: str, words) -> int | None:
        return min((len(window) - window.rfind(w) for w in words if w in window), default=None)

    def category(s: Span) -> str:
        a, b, own = s[0], s[1], s[2]
        if own not in ("date", "birth_date"):
            return own
        window = t.before(a, 160)
        other = any(w in window for w in OTHER_PAPERS) or left_word(t, a, 160, OTHER_PAPERS_WHOLE, date_gap=True) is not None
        passed, birth = distance(window, ISSUE_WORDS), distance(window, BIRTH_WORDS)
        issue = passed is not None or any(w in t.after(b, 40) for w in DIVISION_WORDS)
        if issue and not other and not (birth is not None and (passed is None or birth < passed)):
            return "passport_date"
        if own == "date":
            line = text[text.rfind("\n", 0, a) + 1 : text.find("\n", b) if "\n" in text[b:] else len(text)]
            if "\t" in line and "дата рождения" in t.before(a, 200):
                return "birth_date"
            if any(a >= x and a - y <= 3 for x, y in issuer_ends):
                return "passport_date"
        return own

    return [(s[0], s[1], category(s), s[3], s[4]) for s in spans]


def spans_of(text: str, registry: Registry) -> list[Span]:
    return dates_told(resolved(raw_spans(text, registry), text), text)


def detect_udf(registry: Registry | None = None):
    registry = registry or default()
    names = [f.name for f in SPAN]

    @F.pandas_udf(SPANS)
    def detect(texts: pd.Series) -> pd.Series:
        return pd.Series([None if t is None else [dict(zip(names, s)) for s in spans_of(t, registry)] for t in texts])

    return detect.asNondeterministic()  # so that its result is a column, not copied into expressions above


def may_hold(text: Column) -> Column:
    """Whether any detector could find something: a digit, an @, a capital, any letter beyond ASCII, or citizen(ship).

    Rules need a digit or an @, holders a capital, Latin names a keyword, the other grammars Cyrillic; texts left out hold
    none of these.
    """
    return text.rlike(r"[0-9@A-Z]|[^\x00-\x7F]|citizen|name|client")


ORDER = ("regex", "datewords", "names", "cardholder", "address", "birthplace", "citizenship", "issuer")


def resolve(spans: Column, text: Column | None = None) -> Column:
    """No two spans overlap: in order of start (longest first), one that overlaps the last kept one replaces it if it is
    surer, or as sure and longer. A span beaten by one that is itself beaten later does not come back."""
    size = (lambda s: F.octet_length(F.substring(text, s["start"] + 1, s["end"] - s["start"]))) if text is not None else (lambda s: s["end"] - s["start"])
    rank = lambda s: F.coalesce(F.array_position(F.array(*[F.lit(d) for d in ORDER]), s["detector"]), F.lit(0)).cast("int")
    keyed = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("a"), (-s["end"]).alias("b"), (-s["confidence"]).alias("c"), rank(s).alias("d"), size(s).alias("n"), s.alias("span"))))

    def step(kept: Column, s: Column) -> Column:
        last = F.element_at(kept, -1)
        clear = (F.size(kept) == 0) | (s["span"]["start"] >= last["span"]["end"])
        wins = (s["span"]["confidence"] > last["span"]["confidence"]) | ((s["span"]["confidence"] == last["span"]["confidence"]) & (s["n"] > last["n"]))
        return F.when(clear, F.concat(kept, F.array(s))).when(wins, F.concat(F.slice(kept, F.lit(1), F.size(kept) - 1), F.array(s))).otherwise(kept)

    empty = F.slice(keyed, F.lit(1), F.lit(0))
    return F.transform(F.aggregate(keyed, empty, step), lambda s: s["span"])


def _has(window: Column, words) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | F.contains(window, F.lit(w))
    return out


def _distance(window: Column, words) -> Column:
    """Characters from the start of the last occurrence of any word to the window's end; null without one."""
    each = [F.when(F.contains(window, F.lit(w)), F.char_length(F.substring_index(window, w, -1)) + len(w)) for w in words]
    return F.least(*each)


def tell_dates(spans: Column, text: Column) -> Column:
    """Dates near words of issue become passport dates, those below a table's birth header birth dates."""
    low = F.lower(text)
    before = lambda s, n: F.substring(low, F.greatest(F.lit(1), s["start"] + 1 - n), F.least(s["start"], F.lit(n)))
    after = lambda s, n: F.substring(low, s["end"] + 1, F.lit(n))

    def category(s: Column) -> Column:
        window = before(s, 160)
        other = _has(window, OTHER_PAPERS) | window.rlike("(?<![a-zа-яё])(?:" + "|".join(OTHER_PAPERS_WHOLE) + ")(?![a-zа-яё])")
        issue = _has(window, ISSUE_WORDS) | _has(after(s, 40), DIVISION_WORDS)
        birth, passed = _distance(window, BIRTH_WORDS), _distance(window, ISSUE_WORDS)
        nearer = F.coalesce(birth < passed, birth.isNotNull())
        line = F.concat(F.substring_index(F.substring(text, F.lit(1), s["start"]), "\n", -1), F.substring_index(F.substring(text, s["start"] + 1, F.lit(2147483647)), "\n", 1))
        table = F.contains(line, F.lit("\t")) & F.contains(before(s, 200), F.lit("дата рождения"))
        follows = F.exists(spans, lambda j: (j["category"] == "passport_issuer") & (s["start"] >= j["start"]) & (s["start"] - j["end"] <= 3))
        plain = s["category"] == "date"
        return (
            F.when(~s["category"].isin("date", "birth_date"), s["category"])
            .when(~other & issue & ~nearer, F.lit("passport_date"))
            .when(plain & table, F.lit("birth_date"))
            .when(plain & follows, F.lit("passport_date"))
            .otherwise(s["category"])
        )

    return F.transform(spans, lambda s: F.struct(s["start"], s["end"], category(s).alias("category"), s["detector"], s["confidence"]))


def spread(df: DataFrame) -> DataFrame:
    """df in as many partitions as there are cores, if it is a plain scan in fewer: a small file has one row group."""
    spark = df.sparkSession
    plan = df._jdf.queryExecution().sparkPlan().toString()
    if any(x in plan for x in ("Join", "Aggregate", "Window", "Sort", "Exchange", "Union", "Stream", "InPandas")):
        return df
    cores = spark.sparkContext.defaultParallelism
    return df.repartition(cores) if df._jdf.queryExecution().toRdd().getNumPartitions() < 2 * cores else df


def detect(df: DataFrame, text: str = "text", registry: Registry | None = None) -> DataFrame:
    """df with spans: array<struct<start,end,category,detector,confidence>>, resolved; null for a null text."""
    df = df if df.isStreaming else spread(df)
    t = F.col(text)
    found = F.when(may_hold(t), detect_udf(registry)(F.when(may_hold(t), t)))
    return df.withColumn("spans", F.when(t.isNotNull(), F.coalesce(found, F.array().cast(SPANS))))


def counts(df: DataFrame, key: str) -> DataFrame:
    """(key, category, n): spans by category."""
    return df.select(key, F.explode("spans.category").alias("category")).groupBy(key, "category").agg(F.count("*").alias("n"))


def register(spark: SparkSession) -> None:
    """SQL functions: detect_pii(text) as an array of spans, mask_text(text, strategy), and detect_pii_rows(text) as a table
    function."""
    from .masking import put_masks

    registry = default()
    spark.udf.register("detect_pii", detect_udf(registry))
    names = [f.name for f in SPAN]

    @F.pandas_udf("string")
    def mask_text(texts: pd.Series, strategies: pd.Series) -> pd.Series:
        return pd.Series([None if t is None else put_masks(t, [dict(zip(names, s)) for s in spans_of(t, registry)], k)[0] for t, k in zip(texts, strategies)])

    spark.udf.register("mask_text", mask_text)

    @F.udtf(returnType="start int, end int, category string, detector string, confidence double")
    class DetectPii:
        def eval(self, text: str):
            yield from spans_of(text, registry) if text is not None else []

    spark.udtf.register("detect_pii_rows", DetectPii)
