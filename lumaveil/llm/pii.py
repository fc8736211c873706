"""Personal data in texts: patterns propose spans, checksums confirm them, words nearby adjust the score.

Base kinds (leftmost, not overlapping within a kind, no retries): email, ip (each part at most 255), card (13 to 19
digits that pass Luhn) and phone (international, 9 to 15 digits). They always stay. The method adds: iban (mod 97),
ssn (area, group and serial that can be issued), phone_local (area code in brackets or groups of 3-3-4), secret
(a long token assigned to a key's name). An added span is kept at a score of KEEP or more and never overlaps a base one.

Each span's score starts from its kind's prior, rises for a passed checksum, and moves with words within NEAR
characters before or AFTER behind it: words that name the kind raise it, words that name another number lower it.

Each pattern runs in time linear in the text: addresses are looked for around the `@` signs, dotted numbers are read
as maximal runs and cut into fours.

Defined cases: a null text is the empty text; no spans give zero counts and the hash of the empty string; positions
are code points, ends exclusive; repeated rows come back as often as they came; null doc_ids stay; other columns are
ignored by the query and kept by `redact`; an empty table gives no rows.
"""

from __future__ import annotations

import re
from bisect import bisect_left

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import small_batches, text_of

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "iban", "ssn", "phone_local", "secret")
KEEP = 0.5
NEAR, AFTER = 40, 20

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
DIGIT = re.compile(r"[0-9]")
DOTTED = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++)+")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
SSN = re.compile(r"(?<![0-9-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9-])")
PHONE_LOCAL = re.compile(r"(?<![0-9+(.-])(?:\([0-9]{3}\) ?|[0-9]{3}[-. ])[0-9]{3}[-. ][0-9]{4}(?![0-9.-]?[0-9])")
SECRET = re.compile(r"(?i:token|secret|passw(?:or)?d|api[_-]?key|access[_-]?key)[\"']?\s{0,3}[:=]\s{0,3}[\"']?([A-Za-z0-9+/_.-]{16,}+)")
SECRET_HINT = re.compile(r"(?i)token|secret|passw|key")

#: Prior score, score for a passed check, words that speak for the kind and against it.
PRIOR = {"email": (0.9, 0.0), "ip": (0.6, 0.1), "card": (0.4, 0.4), "phone": (0.7, 0.1), "iban": (0.2, 0.7), "ssn": (0.35, 0.1), "phone_local": (0.45, 0.0), "secret": (0.8, 0.0)}
FOR = {
    "email": ("mail", "contact", "write"),
    "ip": ("ip", "host", "server", "address", "login"),
    "card": ("card", "visa", "mastercard", "amex", "credit", "debit", "payment"),
    "phone": ("phone", "tel", "call", "mobile", "cell", "fax", "dial"),
    "iban": ("iban", "account", "bank", "transfer", "konto"),
    "ssn": ("ssn", "social", "security", "taxpayer"),
    "phone_local": ("phone", "tel", "call", "mobile", "cell", "fax", "dial", "contact"),
    "secret": ("secret", "private", "credential"),
}
AGAINST = ("order", "invoice", "version", "release", "build", "isbn", "serial", "tracking", "sku", "part")
WORD = re.compile(r"[a-z]+")


def luhn(digits: str) -> bool:
    """13 to 19 digits whose Luhn sum is a multiple of ten."""
    if not 13 <= len(digits) <= 19:
        return False
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def mod97(iban: str) -> bool:
    s = iban.replace(" ", "")
    return 15 <= len(s) <= 34 and int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def emails(text: str) -> list[tuple[int, int]]:
    out, end, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in LOCAL:
            start -= 1
        if start < at and (m := EMAIL.match(text, start)):
            out.append(m.span())
            end = m.end()
        else:
            end = max(end, at)
        at = text.find("@", max(at + 1, end))
    return out


def ips(text: str) -> list[tuple[int, int]]:
    out = []
    for m in DOTTED.finditer(text):
        parts = m.group().split(".")
        at = m.start()
        for k in range(0, len(parts) - 3, 4):
            four = parts[k : k + 4]
            end = at + sum(map(len, four)) + 3
            if all(len(p.lstrip("0")) <= 3 and int(p[-3:]) <= 255 for p in four):
                out.append((at, end))
            at = end + 1
    return out


def score(kind: str, text: str, start: int, end: int, checked: bool = True) -> float:
    prior, bonus = PRIOR[kind]
    near = set(WORD.findall(text[max(0, start - NEAR) : start].lower())) | set(WORD.findall(text[end : end + AFTER].lower()))
    value = prior + bonus * checked + 0.2 * any(w in near for w in FOR[kind]) - 0.2 * any(w in near for w in AGAINST)
    return round(min(1.0, max(0.0, value)), 4)


def base_spans(text: str) -> list[tuple[str, int, int]]:
    out = [("email", a, b) for a, b in emails(text)]
    if DIGIT.search(text):
        out += [("ip", a, b) for a, b in ips(text)]
        out += [("card", *m.span()) for m in CARD.finditer(text) if luhn(_digits(m.group()))]
        if "+" in text:
            out += [("phone", *m.span()) for m in PHONE.finditer(text) if 9 <= len(_digits(m.group())) <= 15]
    return out


def added_spans(text: str, base: list[tuple[str, int, int]]) -> list[tuple[str, int, int, float]]:
    if not DIGIT.search(text):
        return []
    found = [("iban", *m.span()) for m in IBAN.finditer(text) if mod97(m.group())]
    found += [("ssn", *m.span()) for m in SSN.finditer(text)]
    found += [("phone_local", *m.span()) for m in PHONE_LOCAL.finditer(text)]
    if SECRET_HINT.search(text):
        found += [("secret", *m.span(1)) for m in SECRET.finditer(text) if DIGIT.search(m.group(1))]
    taken = sorted((a, b) for _, a, b in base)
    reach, top = [], 0
    for _, b in taken:
        top = max(top, b)
        reach.append(top)
    out = []
    for kind, a, b in found:
        k = bisect_left(taken, (b, -1))  # those that start before b
        if k and reach[k - 1] > a:
            continue
        if (s := score(kind, text, a, b)) >= KEEP:
            out.append((kind, a, b, s))
    return out


def spans(text: str) -> list[tuple[str, int, int, float]]:
    """(kind, start, end, score) of one text, by kind as listed, then start."""
    base = base_spans(text)
    return [(k, a, b, score(k, text, a, b)) for k, a, b in base] + added_spans(text, base)


SPANS = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("score", T.DoubleType())]))


@F.pandas_udf(SPANS)
def spans_udf(texts: pd.Series) -> pd.Series:
    names = ("kind", "start", "end", "score")
    return pd.Series([[dict(zip(names, s)) for s in spans(t)] for t in texts])


def find(docs: DataFrame) -> DataFrame:
    """docs' doc_id and text with pii, an array of spans with scores."""
    small_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text")).withColumn("pii", spans_udf("text"))


def mask(text: str) -> str:
    """Spans replaced by their kind in brackets; of overlapping ones the first, then the longest, gives the name."""
    out, at = [], 0
    for start, _, end, kind in sorted((a, -b, b, k) for k, a, b, _ in spans(text)):
        if start >= at:
            out += [text[at:start], f"[{kind.upper()}]"]
        at = max(at, end)
    return "".join([*out, text[at:]]) if out else text


@F.pandas_udf(T.StringType())
def mask_udf(texts: pd.Series) -> pd.Series:
    return pd.Series([None if t is None else mask(t) for t in texts], dtype=object)


def redact(docs: DataFrame) -> DataFrame:
    """docs with personal data in the text replaced; n_chars, where there is one, follows."""
    small_batches(docs.sparkSession)
    out = docs.withColumn("text", mask_udf(F.col("text").cast("string")))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.char_length("text")).cast(docs.schema["n_chars"].dataType))
    return out


def _joined(pii: Column) -> Column:
    return F.array_join(F.transform(pii, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def op4(docs: DataFrame) -> DataFrame:
    pii = F.col("pii")
    of = lambda kind: F.filter(pii, lambda s: s["kind"] == kind)
    counts = [F.size(of(k)).cast("long").alias(f"n_{k}") for k in BASE]
    base = F.filter(pii, lambda s: s["kind"].isin(*BASE))
    return find(docs).select("doc_id", *counts, F.sha2(_joined(base), 256).alias("base_sha256"), _joined(pii).alias("spans"))
