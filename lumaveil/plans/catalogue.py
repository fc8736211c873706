"""Queries over the test tables, one for each operator, beside independent SQL where SQL can express them."""

from __future__ import annotations

import hashlib
import hmac
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.dictionaries import GIVEN_NAMES, SURNAMES, TOWNS
from ..functions import columns as C
from ..operators import accuracy, detect, masking, metrics, policy
from ..sources import files, records
from ..sources.shared import shared_folder
from . import process

EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"
ID_KEY = b"an id key for tests only"
SEAL_KEY = bytes(range(32))

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def gold(names: str, rows: list[tuple]) -> str:
    """SQL with literal rows."""
    show = lambda v: "NULL" if v is None else str(v).lower() if isinstance(v, bool) else str(v) if isinstance(v, (int, float)) else "'" + str(v).replace("'", "''") + "'"
    return f"select * from (values {', '.join('(' + ', '.join(map(show, r)) + ')' for r in rows)}) as t({names})"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def literal(spark: SparkSession, texts: list[str]) -> DataFrame:
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "n int, text string")


# --- scans and scalar kernels


@query("select lang, count(*) as n, sum(n_chars)::bigint as chars, max(n_chars) as longest from documents group by lang")
def scan_documents_stats(spark, sf):
    return table(spark, sf, "documents").groupBy("lang").agg(F.count("*").alias("n"), F.sum("n_chars").alias("chars"), F.max("n_chars").alias("longest"))


@query("select doc_id, case when length(text) = 0 then 0 else length(text) // 3 + 1 end::bigint as tokens from documents")
def token_estimate(spark, sf):
    return table(spark, sf, "documents").select("doc_id", C.estimate_tokens(F.col("text")).alias("tokens"))


@query("select doc_id, sha256(text) as hash from documents")
def sha256_hash(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.sha2("text", 256).alias("hash"))


@query("select doc_id, strlen(lower(text)) = strlen(text) as same from documents")
def lower_guard(spark, sf):
    return table(spark, sf, "documents").select("doc_id", (F.octet_length(F.lower("text")) == F.octet_length("text")).alias("same"))


SPANS_SQL = """
with m as (select doc_id, regexp_extract_all(text, '{p}') as v, string_split_regex(text, '{p}') as s from documents),
e as (select doc_id, v, s, unnest(range(1, len(v) + 1)) as i from m where len(v) > 0)
select doc_id, (list_sum(list_transform(s[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(v[1:i-1], lambda x: length(x))), 0))::int as "start", v[i] as value from e
"""


@query(SPANS_SQL.format(p=EMAIL.replace("'", "''")))
def find_spans_native(spark, sf):
    d = table(spark, sf, "documents").withColumn("s", F.explode(C.find_spans(F.col("text"), EMAIL, "email", 0.95)))
    return d.select("doc_id", F.col("s.start").alias("start"), F.col("s.value").alias("value"))


ANY_EMAIL = r"[\p{L}\p{N}._%+-]+@[\p{L}\p{N}.-]+\.\p{L}{2,}"


@query(SPANS_SQL.format(p=ANY_EMAIL))
def detect_email(spark, sf):
    """What the detectors find in whole documents, of the category email."""
    d = detect.detect(table(spark, sf, "documents")).withColumn("s", F.explode("spans")).where("s.category = 'email'")
    return d.select("doc_id", F.col("s.start").alias("start"), F.substring("text", F.col("s.start") + 1, F.col("s.end") - F.col("s.start")).alias("value"))


@query("""with k as (select c_custkey, (['info', 'support', 'noreply', 'ivan', 'infos'])[c_custkey % 5 + 1] as l, (['alfabank.ru', 'example.ru'])[c_custkey % 2 + 1] as d from customer)
select c_custkey, l || '@' || d as value from k where not (d = 'alfabank.ru' and l in ('info', 'support', 'noreply'))""")
def detect_email_service_filter(spark, sf):
    k = F.col("c_custkey")
    own = F.element_at(F.array(*[F.lit(x) for x in ("info", "support", "noreply", "ivan", "infos")]), (k % 5 + 1).cast("int"))
    domain = F.element_at(F.array(F.lit("alfabank.ru"), F.lit("example.ru")), (k % 2 + 1).cast("int"))
    d = detect.detect(table(spark, sf, "customer").select("c_custkey", F.concat(F.lit("адрес "), own, F.lit("@"), domain, F.lit(", да")).alias("text")))
    d = d.select("c_custkey", "text", F.explode("spans").alias("s"))
    return d.select("c_custkey", F.substring("text", F.col("s.start") + 1, F.col("s.end") - F.col("s.start")).alias("value"))


LUHN_SQL = "(list_sum(list_transform(range(1, length({d}) + 1), lambda i: case when (length({d}) - i) % 2 = 1 then (case when substr({d}, i, 1)::int * 2 > 9 then substr({d}, i, 1)::int * 2 - 9 else substr({d}, i, 1)::int * 2 end) else substr({d}, i, 1)::int end)) % 10 = 0)"


@query(f"""with e as (select doc_id, unnest(regexp_extract_all(text, '(?:[0-9][ -]?){{13,19}}')) as raw from documents),
d as (select doc_id, regexp_replace(raw, '[^0-9]', '', 'g') as d from e)
select doc_id, d as digits, {LUHN_SQL.format(d='d')} as valid from d where length(d) between 13 and 19""")
def detect_card_luhn(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", F.explode(F.regexp_extract_all("text", F.lit("((?:[0-9][ -]?){13,19})"))).alias("raw"))
    d = d.withColumn("digits", C.digits(F.col("raw"))).where(F.char_length("digits").between(13, 19))
    return d.select("doc_id", "digits", C.luhn(F.col("digits")).alias("valid"))


@query("select doc_id, len(regexp_extract_all(text, '[0-9]+'))::int as n from documents")
def detect_digit_runs_standalone(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.regexp_count("text", F.lit("[0-9]+")).alias("n"))


# --- validators over numbers made from keys


def _key(n: int, times: int = 7919) -> Column:
    return F.lpad((F.col("c_custkey") * times).cast("string"), n, "4")


def _key_sql(n: int, times: int = 7919) -> str:
    return f"lpad((c_custkey * {times})::varchar, {n}, '4')"


def _sum_sql(d: str, weights) -> str:
    return " + ".join(f"{w} * substr({d}, {i + 1}, 1)::int" for i, w in enumerate(weights))


@query(f"with k as (select c_custkey, {_key_sql(16)} as d from customer) select c_custkey, {LUHN_SQL.format(d='d')} as ok from k")
def validate_luhn(spark, sf):
    return table(spark, sf, "customer").select("c_custkey", C.luhn(_key(16)).alias("ok"))


@query(f"with k as (select c_custkey, {_key_sql(10)} as d from customer) select c_custkey, ({_sum_sql('d', C.INN_10)}) % 11 % 10 = substr(d, 10, 1)::int as ok from k")
def validate_inn10(spark, sf):
    return table(spark, sf, "customer").select("c_custkey", C.inn(_key(10)).alias("ok"))


@query(
    f"with k as (select c_custkey, {_key_sql(12)} as d from customer) select c_custkey, ({_sum_sql('d', C.INN_12[0])}) % 11 % 10 = substr(d, 11, 1)::int "
    f"and ({_sum_sql('d', C.INN_12[1])}) % 11 % 10 = substr(d, 12, 1)::int as ok from k"
)
def validate_inn12(spark, sf):
    return table(spark, sf, "customer").select("c_custkey", C.inn(_key(12)).alias("ok"))


@query(
    f"with k as (select c_custkey, {_key_sql(11)} as d from customer), t as (select *, {_sum_sql('d', range(9, 0, -1))} as s from k) "
    "select c_custkey, (case when s < 100 then s when s in (100, 101) then 0 when s % 101 = 100 then 0 else s % 101 end) = substr(d, 10, 2)::int as ok from t"
)
def validate_snils(spark, sf):
    return table(spark, sf, "customer").select("c_custkey", C.snils(_key(11)).alias("ok"))


@query("with k as (select c_custkey, lpad((c_custkey % 3)::varchar, 4, '0') || lpad((c_custkey % 5)::varchar, 6, '0') as d from customer) select c_custkey, d[1:4] <> '0000' and d[5:10] <> '000000' as ok from k")
def validate_passport(spark, sf):
    d = F.concat(F.lpad((F.col("c_custkey") % 3).cast("string"), 4, "0"), F.lpad((F.col("c_custkey") % 5).cast("string"), 6, "0"))
    return table(spark, sf, "customer").select("c_custkey", C.passport(d).alias("ok"))


@query(
    "with k as (select c_custkey, (6 + c_custkey % 4)::varchar || lpad(((c_custkey % 30) + 790)::varchar, 3, '0') || '1234567' as d from customer) "
    "select c_custkey, d[1:1] in ('7', '8') and d[1:4] <> '8800' as ok, d[2:4] <> '800' as ok10 from k"
)
def validate_phone(spark, sf):
    d = F.concat((F.col("c_custkey") % 4 + 6).cast("string"), F.lpad((F.col("c_custkey") % 30 + 790).cast("string"), 3, "0"), F.lit("1234567"))
    return table(spark, sf, "customer").select("c_custkey", C.phone(d).alias("ok"), C.phone10(F.substring(d, 2, 10)).alias("ok10"))


_DATE_PARTS = "(c_custkey % 33) as a, (c_custkey % 14) as b, (1890 + c_custkey % 220) as y"


@query(
    f"with k as (select c_custkey, {_DATE_PARTS} from customer) select c_custkey, (y between 1900 and 2100) and "
    "(try_cast(y || '-' || lpad(b::varchar, 2, '0') || '-' || lpad(a::varchar, 2, '0') as date) is not null or try_cast(y || '-' || lpad(a::varchar, 2, '0') || '-' || lpad(b::varchar, 2, '0') as date) is not null) as ok from k"
)
def validate_date(spark, sf):
    d = F.concat_ws(".", (F.col("c_custkey") % 33).cast("string"), (F.col("c_custkey") % 14).cast("string"), (F.col("c_custkey") % 220 + 1890).cast("string"))
    return table(spark, sf, "customer").select("c_custkey", C.numeric_date(d).alias("ok"))


@query(
    "with k as (select c_custkey, (c_custkey % 33) as a, (c_custkey % 14) as b, (c_custkey % 100) as y from customer), d as (select *, "
    "lambda_date(1900 + y, b, a) or lambda_date(1900 + y, a, b) or lambda_date(1900 + a, b, y) as ok from k) select c_custkey, ok from d".replace(
        "lambda_date(1900 + y, b, a)", "try_cast((1900 + y) || '-' || lpad(b::varchar, 2, '0') || '-' || lpad(a::varchar, 2, '0') as date) is not null"
    ).replace(
        "lambda_date(1900 + y, a, b)", "try_cast((1900 + y) || '-' || lpad(a::varchar, 2, '0') || '-' || lpad(b::varchar, 2, '0') as date) is not null"
    ).replace("lambda_date(1900 + a, b, y)", "(y < 32 and try_cast((1900 + a) || '-' || lpad(b::varchar, 2, '0') || '-' || lpad(y::varchar, 2, '0') as date) is not null)")
)
def validate_short_year(spark, sf):
    d = F.concat_ws("/", (F.col("c_custkey") % 33).cast("string"), (F.col("c_custkey") % 14).cast("string"), (F.col("c_custkey") % 100).cast("string"))
    return table(spark, sf, "customer").select("c_custkey", C.short_date(d).alias("ok"))


# --- detection over texts made from tables: SQL says where the value stands


def _derived(name: str, prefix: str, value: Callable[[], Column], value_sql: str, category: str, suffix: str = " спасибо") -> None:
    """A query that detects `category` in prefix || value || suffix for each customer."""

    def run(spark, sf):
        d = table(spark, sf, "customer").select("c_custkey", F.concat(F.lit(prefix), value(), F.lit(suffix)).alias("text"))
        d = detect.detect(d).select("c_custkey", "text", F.explode("spans").alias("s")).where(F.col("s.category") == category)
        return d.select("c_custkey", F.col("s.start").alias("start"), F.substring("text", F.col("s.start") + 1, F.col("s.end") - F.col("s.start")).alias("value"))

    QUERIES[name] = run
    ORACLE_SQL[name] = f"""select c_custkey, length('{prefix}')::int as "start", {value_sql} as value from customer"""


def _digits(n: int, times: int) -> tuple[Callable[[], Column], str]:
    return lambda: F.lpad((F.col("c_custkey") * times % 10**n).cast("string"), n, "1"), f"lpad((c_custkey * {times} % {10**n})::varchar, {n}, '1')"


_seven, _seven_sql = _digits(7, 7919)
_six, _six_sql = _digits(6, 104729)
_three, _three_sql = _digits(3, 31)
_derived("phone_ru_derived", "Клиент оставил телефон ", lambda: F.concat(F.lit("+7 (916) "), F.substring(_seven(), 1, 3), F.lit("-"), F.substring(_seven(), 4, 2), F.lit("-"), F.substring(_seven(), 6, 2)),
         f"'+7 (916) ' || {_seven_sql}[1:3] || '-' || {_seven_sql}[4:5] || '-' || {_seven_sql}[6:7]", "phone")
_derived("phone_e164_derived", "Call me at ", lambda: F.concat(F.lit("+49 151 "), _seven()), f"'+49 151 ' || {_seven_sql}", "phone", " thanks")
_derived("passport_derived", "Паспорт ", lambda: F.concat(F.lit("4509 "), _six()), f"'4509 ' || {_six_sql}", "passport")
_derived("division_code_derived", "код подразделения ", lambda: F.concat(_three(), F.lit("-"), F.substring(_six(), 1, 3)), f"{_three_sql} || '-' || {_six_sql}[1:3]", "division_code")
_derived("driver_license_derived", "водительское удостоверение ", lambda: F.concat(F.lit("77 12 "), _six()), f"'77 12 ' || {_six_sql}", "driver_license")
_derived("foreign_passport_derived", "загранпаспорт ", lambda: F.concat(F.lit("71 "), _seven()), f"'71 ' || {_seven_sql}", "foreign_passport")
_derived("id_document_derived", "военный билет ", lambda: F.concat(F.lit("АБ "), _seven()), f"'АБ ' || {_seven_sql}", "id_document")
_derived("cvv_pin_context", "CVV ", _three, _three_sql, "cvv", ", спасибо")
_derived("date_forms_derived", "родился ", lambda: F.concat(F.lpad((F.col("c_custkey") % 28 + 1).cast("string"), 2, "0"), F.lit(".05."), (F.col("c_custkey") % 60 + 1940).cast("string")),
         "lpad((c_custkey % 28 + 1)::varchar, 2, '0') || '.05.' || (c_custkey % 60 + 1940)::varchar", "birth_date")


def _gold_spans(name: str, texts: list[str], expected: list[tuple[int, str, str]], category: str | None = None) -> None:
    def run(spark, sf):
        d = detect.detect(literal(spark, texts)).select("n", "text", F.explode("spans").alias("s"))
        d = d if category is None else d.where(F.col("s.category") == category)
        return d.select("n", F.col("s.category").alias("category"), F.substring("text", F.col("s.start") + 1, F.col("s.end") - F.col("s.start")).alias("value"))

    QUERIES[name] = run
    ORACLE_SQL[name] = gold("n, category, value", expected)


_gold_spans("names_gold", ["Клиент Иванов Иван Иванович пришёл", "Иван Петров написал", "Петров И. О. подписал"],
            [(0, "full_name", "Иванов Иван Иванович"), (1, "full_name", "Иван Петров"), (2, "full_name", "Петров И. О.")], "full_name")
_gold_spans("address_gold", ["Адрес: ул. Ленина, д. 5, кв. 12", "Прописан: г. Казань, ул. Мира, д. 7"], [(0, "address", "ул. Ленина, д. 5, кв. 12"), (1, "address", "г. Казань, ул. Мира, д. 7")], "address")
# every entry of the word lists
_gold_spans("names_dictionary", [f"Клиент {n.title()} пришёл" for n in GIVEN_NAMES] + [f"Вчера Анна {n.title()} пришла" for n in SURNAMES],
            [(i, "full_name", n.title()) for i, n in enumerate(GIVEN_NAMES)] + [(i, "full_name", f"Анна {n.title()}") for i, n in enumerate(SURNAMES, len(GIVEN_NAMES))], "full_name")
_gold_spans("address_dictionary", [f"Адрес: {n.title()}, ул. Ленина, д. 5" for n in TOWNS], [(i, "address", f"{n.title()}, ул. Ленина, д. 5") for i, n in enumerate(TOWNS)], "address")
_gold_spans("birthplace_gold", ["место рождения: г. Казань", "уроженец г. Москва"], [(0, "birth_place", "г. Казань"), (1, "birth_place", "г. Москва")], "birth_place")
_gold_spans("citizenship_gold", ["гражданство РФ", "He has Russia citizenship", "гражданство?\nРоссия"], [(0, "citizenship", "РФ"), (1, "citizenship", "Russia"), (2, "citizenship", "Россия")], "citizenship")
_gold_spans("issuer_gold", ["паспорт выдан ОУФМС России по городу, код"], [(0, "passport_issuer", "ОУФМС России по городу")], "passport_issuer")
_gold_spans("cardholder_gold", ["держатель карты IVAN PETROV", "VISA GOLD 4111 1111 1111 1111"], [(0, "card_holder", "IVAN PETROV")], "card_holder")
_gold_spans("dateword_gold", ["Родился двенадцатого мая тысяча девятьсот девяностого года"], [(0, "birth_date", "двенадцатого мая тысяча девятьсот девяностого года")])
_gold_spans("date_reclassify", ["род. 12 окт 1969", '{"birth": "1995-02-17"}', '{"doc_issue": "15-03-2015"}', "issue date 04.28.2011", "DOB was 12.31.1975", "ВУ 77 12 345678. Выдано 14.06.2018"],
            [(0, "birth_date", "12 окт 1969"), (1, "birth_date", "1995-02-17"), (2, "passport_date", "15-03-2015"), (3, "passport_date", "04.28.2011"), (4, "birth_date", "12.31.1975"), (5, "date", "14.06.2018"), (5, "driver_license", "77 12 345678")])

_SPAN_DDL = "n int, spans array<struct<start:int,end:int,category:string,detector:string,confidence:double>>"


def _resolved(spark, cases):
    df = spark.createDataFrame([(n, [(a, b, "x", "regex", c) for a, b, c in s]) for n, s in enumerate(cases)], _SPAN_DDL)
    return df.select("n", F.explode(detect.resolve(F.col("spans"))).alias("s")).select("n", F.col("s.start").alias("start"), F.col("s.end").alias("end"))


@query(gold('n, "start", "end"', [(0, 0, 9), (1, 3, 9), (1, 9, 12), (2, 0, 4), (2, 4, 6)]))
def resolve_overlaps(spark, sf):
    return _resolved(spark, [[(0, 5, 0.9), (0, 5, 0.9), (0, 9, 0.9)], [(3, 9, 0.9), (9, 12, 0.5), (0, 4, 0.8)], [(4, 6, 0.1), (0, 4, 0.2)]])


@query(gold('n, "start", "end"', [(0, 9, 20)]))
def resolve_chain_quirk(spark, sf):
    return _resolved(spark, [[(0, 10, 0.9), (5, 12, 0.8), (9, 20, 0.95)]])


# --- policies


def _made_spans(spark, sf):
    span = lambda a, c: F.struct(F.lit(a).alias("start"), F.lit(a + 3).alias("end"), F.lit(c).alias("category"))
    k = F.col("c_custkey")
    spans = F.filter(F.array(F.when(k % 2 == 0, span(0, "email")), F.when(k % 3 == 0, span(5, "pin")), F.when(k % 5 == 0, span(10, "card_number"))), lambda s: s.isNotNull())
    return table(spark, sf, "customer").select("c_custkey", spans.alias("spans"))


@query("select c_custkey, (case when c_custkey % 2 = 0 then 1 else 0 end + case when c_custkey % 3 = 0 then 1 else 0 end)::int as n from customer")
def category_filter(spark, sf):
    return _made_spans(spark, sf).select("c_custkey", F.size(policy.keep_categories(F.col("spans"), F.array(F.lit("email"), F.lit("pin")))).alias("n"))


@query("select c_custkey, (c_custkey % 3 = 0 and c_custkey % 5 = 0) as pin_kept from customer")
def combo_rules(spark, sf):
    combos = F.array(F.struct(F.lit("pin").alias("category"), F.array(F.lit("card_number")).alias("requires_any")))
    kept = policy.keep_categories(F.col("spans"), F.array(F.lit("pin")), combos)
    return _made_spans(spark, sf).select("c_custkey", F.exists(kept, lambda s: s["category"] == "pin").alias("pin_kept"))


_AUTH = [("process", "a", True, False, None, None), ("mask", "a", True, False, None, None), ("mask", "b", True, True, "k", "k"), ("mask", "b", True, True, "k", "x"), ("mask", "b", True, True, "", "x"), ("mask", "c", False, True, "k", "k"), ("mask", None, None, False, None, "k")]


@query(gold("n, status", list(enumerate([200, 401, 200, 401, 401, 403, 403]))))
def auth_matrix(spark, sf):
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(_AUTH)], "n int, route string, system string, enabled boolean, named boolean, key string, given string")
    return df.select("n", policy.auth_status(*[F.col(c) for c in ("route", "system", "enabled", "named", "key", "given")]).alias("status"))


@query("select c_custkey, case when c_custkey % 4 = 0 then 200 when c_custkey % 2 = 1 then 403 when c_custkey % 4 = 2 and c_custkey % 6 = 0 then 400 else 200 end as status from customer")
def strategy_override(spark, sf):
    k = F.col("c_custkey")
    asked = F.when(k % 4 == 0, F.lit("")).when(k % 6 == 0, F.lit("nope")).otherwise(F.lit("token"))
    return table(spark, sf, "customer").select("c_custkey", policy.strategy_of(F.lit("full"), asked, k % 2 == 0)["status"].alias("status"))


# --- masks


@query("select c_custkey, regexp_replace(c_name, '[A-Za-z0-9]', '*', 'g') as masked from customer")
def mask_full(spark, sf):
    return table(spark, sf, "customer").select("c_custkey", masking.mask_full(F.col("c_name")).alias("masked"))


@query(f"with k as (select c_custkey, {_key_sql(16)} as d from customer) select c_custkey, d[1:2] || '************' || d[15:16] as masked from k")
def mask_partial_digits(spark, sf):
    return table(spark, sf, "customer").select("c_custkey", masking.mask_partial(_key(16), F.lit("card_number")).alias("masked"))


@query("select n_nationkey, upper(n_name[1:1]) || '. ' || upper(n_name[1:1]) || '.' as masked from nation")
def mask_partial_initials(spark, sf):
    n = F.regexp_replace("n_name", "[^A-Za-z]", "")
    return table(spark, sf, "nation").select("n_nationkey", masking.mask_partial(F.concat_ws(" ", n, n), F.lit("full_name")).alias("masked"))


@query("select o_orderkey, '****-**-**' as masked from orders")
def mask_partial_date(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", masking.mask_partial(F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit("date")).alias("masked"))


@query("select c_custkey, 'u' || repeat('*', length(c_custkey::varchar)) || '@mail.ru' as masked from customer")
def mask_partial_email(spark, sf):
    return table(spark, sf, "customer").select("c_custkey", masking.mask_partial(F.concat(F.lit("u"), F.col("c_custkey"), F.lit("@mail.ru")), F.lit("email")).alias("masked"))


@query("select c_custkey, 'ул. Л*****, д. ' || repeat('*', length(c_custkey::varchar)) as masked from customer")
def mask_partial_words(spark, sf):
    return table(spark, sf, "customer").select("c_custkey", masking.mask_partial(F.concat(F.lit("ул. Ленина, д. "), F.col("c_custkey")), F.lit("address")).alias("masked"))


@query("select o_custkey, 'a [EMAIL_1] b [EMAIL_2] c [EMAIL_1]' as masked from orders")
def mask_token(spark, sf):
    k = F.col("o_custkey").cast("string")
    d = table(spark, sf, "orders").select("o_custkey", F.concat(F.lit("a x"), k, F.lit("@m.ru b y"), k, F.lit("@m.ru c x"), k, F.lit("@m.ru")).alias("text"))
    return masking.apply(detect.detect(d), "token").select("o_custkey", "masked")


_SYNTHETIC = (
    ("card_number", "4111 1111 1111 1111", "9999 9999 9999 9999"), ("card_number", "4111-1111-1111-111", "9999-9999-9999-999"), ("inn", "500100732259", "999999999999"),
    ("inn", "7707 083 893", "9999 999 999"), ("snils", "112-233-445 95", "999-999-999 99"), ("phone", "+7 (916) 123-45-67", "+9 (999) 999-99-99"),
    ("passport", "4509 123456", "9999 999999"), ("foreign_passport", "71 1234567", "99 9999999"), ("division_code", "770-001", "999-999"),
    ("driver_license", "77 АВ 123456", "99 АВ 999999"), ("cvv", "123", "999"), ("pin", "1234", "9999"), ("birth_date", "05.12.1985", "99.99.9999"), ("date", "1985-12-05", "9999-99-99"),
    ("id_document", "АБ 1234567", "АБ 9999999"), ("phone", "+49 151 2345678", "+99 999 9999999"),
)


@query(f"""select c_custkey, v[1] as category, v[3] as layout, true as valid, true as other from
(select c_custkey, ([{', '.join(str(list(x)) for x in _SYNTHETIC)}])[c_custkey % {len(_SYNTHETIC)} + 1] as v from customer)""")
def mask_synthetic_valid(spark, sf):
    """A made value has the layout of the old one, passes its category's check and is another, for every kind of number."""
    rows = F.array(*[F.struct(*[F.lit(x).alias(n) for n, x in zip("cvl", r)]) for r in _SYNTHETIC])
    k = F.col("c_custkey")
    d = table(spark, sf, "customer").withColumn("r", F.element_at(rows, (k % len(_SYNTHETIC) + 1).cast("int")))
    d = d.select("c_custkey", "r", F.concat(F.lit("№ "), k.cast("string"), F.lit(": "), "r.v").alias("text"), (F.char_length(k.cast("string")) + 4).alias("at"))
    d = d.withColumn("spans", F.array(F.struct(F.col("at").alias("start"), (F.col("at") + F.char_length("r.v")).alias("end"), F.col("r.c").alias("category"))))
    d = masking.apply(d, "synthetic").withColumn("new", F.substring("masked", F.col("at") + 1, F.char_length("masked")))
    c, new = F.col("r.c"), F.col("new")
    valid = (
        F.when(c == "card_number", C.luhn(new)).when(c == "inn", C.inn(new)).when(c == "snils", C.snils(new)).when(c == "phone", C.phone_e164(new))
        .when(c == "passport", C.passport(new)).when(c.isin("birth_date", "date"), C.numeric_date(new)).otherwise(True)
    )
    return d.select("c_custkey", c.alias("category"), F.regexp_replace(new, "[0-9]", "9").alias("layout"), valid.alias("valid"), (new != F.col("r.v")).alias("other"))


# --- offsets, restoring, counts


@query(f"select doc_id, text as restored, 0 as misses, len(regexp_extract_all(text, '{ANY_EMAIL}'))::int as n_email from documents")
def restore_roundtrip(spark, sf):
    """Masked documents restored, and how many e-mails were masked in them meanwhile."""
    d = masking.apply(detect.detect(table(spark, sf, "documents")), "token").withColumn("b", masking.restore_udf("masked", "replacements"))
    n = F.size(F.filter("replacements", lambda r: (r["c"] == "email") & r["m"].startswith("[EMAIL_")))
    return d.select("doc_id", F.col("b.restored").alias("restored"), F.col("b.misses").alias("misses"), n.alias("n_email"))


@query("""with k as (select c_custkey, c_custkey::varchar as k from customer), e as (select c_custkey, k, unnest([1, 2, 3]) as i from k)
select c_custkey, i, (case i when 1 then 2 when 2 then 14 else 26 end)::int as s, (case i when 1 then 11 when 2 then 23 else 35 end)::int as e,
case i when 2 then '[EMAIL_2]' else '[EMAIL_1]' end as m, case i when 2 then 'y' else 'x' end || k || '@m.ru' as o from e""")
def apply_offsets(spark, sf):
    """Where each mask stands in the masked text, and the original it stands for."""
    k = F.col("c_custkey").cast("string")
    d = table(spark, sf, "customer").select("c_custkey", F.concat(F.lit("a x"), k, F.lit("@m.ru b y"), k, F.lit("@m.ru c x"), k, F.lit("@m.ru")).alias("text"))
    d = masking.apply(detect.detect(d), "token").select("c_custkey", F.posexplode("replacements").alias("i", "r"))
    return d.select("c_custkey", (F.col("i") + 1).alias("i"), "r.s", "r.e", "r.m", "r.o")


@query("select doc_id, regexp_replace(text, '" + ANY_EMAIL + "', '', 'g') = text as untouched from documents where not regexp_matches(text, '[0-9]')")
def documents_without_digits(spark, sf):
    """A document without digits is masked only where it has an e-mail, as far as these texts go."""
    d = masking.apply(detect.detect(table(spark, sf, "documents").where("not rlike(text, '[0-9]')")), "full")
    return d.select("doc_id", (F.col("masked") == F.col("text")).alias("untouched"))


@query(gold("n, restored, misses", [(0, "A is your number, thanks.", 1), (1, "Call A or A again.", 0), (2, "Call A please.", 1), (3, "P belongs to N.", 0)]))
def restore_edited(spark, sf):
    r = lambda o, m, s, e: ("x", o, m, s, e)
    rows = [
        (0, "[PHONE_1] is your number, thanks.", [r("A", "[PHONE_1]", 0, 9)] * 2), (1, "Call [PHONE_1] or [PHONE_1] again.", [r("A", "[PHONE_1]", 0, 9)] * 2),
        (2, "Call [PHONE_1] please.", [r("A", "[PHONE_1]", 0, 9), r("B", "[EMAIL_1]", 20, 29)]), (3, "[PHONE_1] belongs to [NAME_1].", [r("N", "[NAME_1]", 0, 8), r("P", "[PHONE_1]", 20, 29)]),
    ]
    df = spark.createDataFrame(rows, "n int, masked string, r array<struct<c:string,o:string,m:string,s:int,e:int>>").withColumn("b", masking.restore_udf("masked", "r"))
    return df.select("n", F.col("b.restored").alias("restored"), F.col("b.misses").alias("misses"))


@query(f"select doc_id, 'email' as category, len(regexp_extract_all(text, '{ANY_EMAIL}'))::bigint as n from documents where len(regexp_extract_all(text, '{ANY_EMAIL}')) > 0")
def found_counts(spark, sf):
    return detect.counts(detect.detect(table(spark, sf, "documents")), "doc_id").where("category = 'email'")


@query(f"with c as (select lang, source, len(regexp_extract_all(text, '{EMAIL}')) as n from documents) select lang, source, sum(n)::bigint as n from c group by rollup (lang, source)")
def found_rollup(spark, sf):
    d = table(spark, sf, "documents").select("lang", "source", F.regexp_count("text", F.lit(EMAIL)).alias("n"))
    return d.rollup("lang", "source").agg(F.sum("n").alias("n"))


@query(f"with c as (select source, sum(len(regexp_extract_all(text, '{EMAIL}')))::bigint as n from documents group by source) select source, n from c order by n desc, source limit 5")
def top_categories(spark, sf):
    d = table(spark, sf, "documents").groupBy("source").agg(F.sum(F.regexp_count("text", F.lit(EMAIL))).alias("n"))
    return d.orderBy(F.desc("n"), "source").limit(5)


# --- conversations


@query(
    "with t as (select conv_id, turn, length(coalesce(text, '')) + 1 as n from conversations) select conv_id, turn, coalesce(sum(n) over (partition by conv_id order by turn rows between unbounded preceding and 1 preceding), 0)::bigint as at from t"
)
def conversation_mask_offsets(spark, sf):
    t = table(spark, sf, "conversations").withColumn("n", F.char_length(F.coalesce("text", F.lit(""))) + 1)
    return t.select("conv_id", "turn", F.coalesce(F.sum("n").over(process._before()), F.lit(0)).cast("long").alias("at"))


@query("select conv_id, arg_max(text, turn) as text from conversations where role = 'user' group by conv_id")
def conversation_last_user(spark, sf):
    return process.last_user(table(spark, sf, "conversations"))


@query("with c as (select conv_id, count(*) as n from conversations group by conv_id) select conv_id, 1 as numbers, n::int as n_masks, false as bad_role from c")
def conversation_shared_token(spark, sf):
    t = table(spark, sf, "conversations").select("conv_id", "turn", "role", F.concat(F.lit("x"), F.col("conv_id"), F.lit("@m.ru")).alias("text"))
    d = process.mask_conversations(t)
    return d.select("conv_id", F.size(F.array_distinct(F.transform("replacements", lambda r: r["m"]))).alias("numbers"), F.size("replacements").alias("n_masks"), "bad_role")


# --- store and flows


def _now() -> Column:
    return F.lit("2024-01-01 00:00:00").cast("timestamp")


def _seal_key() -> Column:
    return F.lit(SEAL_KEY)


_IDS = ["", "a", "order-1", "ид", "x" * 300]


@query(gold("n, id_hash", [(i, hmac.new(ID_KEY, s.encode(), hashlib.sha256).hexdigest()[:16]) for i, s in enumerate(_IDS)]))
def hmac_id(spark, sf):
    return literal(spark, _IDS).select("n", C.hashed_id(ID_KEY, F.col("text")).alias("id_hash"))


@query("select doc_id, sha256(text) as opened, false as readable, (12 + strlen(text) + 16)::int as size from documents")
def encrypt_roundtrip(spark, sf):
    """The hash of what the key opens, whether another key opens it or the text shows in it, and its size."""
    d = table(spark, sf, "documents").withColumn("c", F.aes_encrypt(F.col("text").cast("binary"), _seal_key(), F.lit("GCM")))
    opened = F.try_aes_decrypt("c", _seal_key(), F.lit("GCM")).cast("string")
    other = F.try_aes_decrypt("c", F.lit(bytes(32)), F.lit("GCM")).isNotNull()
    return d.select("doc_id", F.sha2(opened, 256).alias("opened"), (other | F.contains(F.col("c"), F.left("text", F.lit(20)).cast("binary"))).alias("readable"), F.octet_length("c").alias("size"))


@query("with r as (select o_custkey, o_orderkey, row_number() over (partition by o_custkey order by o_orderkey) as n from orders) select o_custkey as id, o_orderkey as seq from r where n = 1 and o_custkey % 7 <> 0")
def save_new_first_wins(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_custkey").cast("string").alias("id_hash"), F.col("o_orderkey").alias("seq"))
    held = o.select("id_hash").distinct().where("id_hash % 7 = 0").withColumn("expires_at", F.lit(None).cast("timestamp"))
    won, _ = records.save_new(held, o, _now(), "seq")
    return won.select(F.col("id_hash").cast("long").alias("id"), "seq")


@query("select c_custkey from customer where c_custkey % 3 = 0 or c_custkey % 3 = 2")
def ttl_expiry(spark, sf):
    k = F.col("c_custkey")
    at = F.when(k % 3 == 0, F.lit(None)).when(k % 3 == 1, F.lit("2023-12-31 23:59:59")).otherwise(F.lit("2024-01-01 00:00:01")).cast("timestamp")
    return records.live(table(spark, sf, "customer").select("c_custkey", at.alias("expires_at")), _now()).select("c_custkey")


@query(
    "select c_custkey, case when c_custkey % 5 = 0 then 'stored' when c_custkey % 5 = 1 then 'conflict' when c_custkey % 5 = 2 then 'idempotent' when c_custkey % 5 = 3 then 'looks_like_unmask' else 'overwrite' end as outcome from customer"
)
def ownership_matrix(spark, sf):
    k = F.col("c_custkey") % 5
    text = F.col("c_name")
    return table(spark, sf, "customer").select("c_custkey", process.mask_outcome(F.when(k == 2, F.sha2(text, 256)).when(k > 0, F.lit("other")), F.when(k == 3, text).otherwise(F.lit("m")), k != 1, text).alias("outcome"))


_SYSTEMS = [{"id": "default", "strategy": "token"}, {"id": "other", "strategy": "full"}, {"id": "off", "enabled": False}]
_REQUESTS = [
    (1, "тел +7 (916) 123-45-67", "id1", "default"), (2, "тел +7 (916) 123-45-67", "id1", "default"), (3, "ответ: [PHONE_1]!", "id1", "default"), (4, "почта a@b.ru", "id1", "other"),
    (5, "совсем другое", "id1", "default"), (6, None, "id2", "default"), (7, "a@b.ru", "id2", "off"), (8, "", "id3", "default"),
]


@query(gold("seq, status, outcome, result", [
    (1, 200, "masked", "тел [PHONE_1]"), (2, 200, "echo", "тел [PHONE_1]"), (3, 200, "restored", "ответ: +7 (916) 123-45-67!"), (4, 200, "foreign", "почта *@*.**"),
    (5, 200, "fresh", "совсем другое"), (6, 400, None, None), (7, 403, None, None), (8, 200, "masked", ""),
]))
def process_state_machine(spark, sf):
    requests = spark.createDataFrame(_REQUESTS, "seq long, payload string, payload_id string, system string")
    store = spark.createDataFrame([], "id_hash string, sealed binary, expires_at timestamp")
    answers, _ = process.process(requests, files.systems(spark, _SYSTEMS), store, _seal_key(), ID_KEY, _now())
    return answers.select(F.col("seq").cast("int").alias("seq"), "status", "outcome", "result")


@query("""select conv_id, string_agg(text, '' order by turn) as answer, true as done from conversations group by conv_id""")
def sse_assemble(spark, sf):
    t = table(spark, sf, "conversations")
    chunk = F.concat(F.lit("data: "), F.to_json(F.struct(F.array(F.struct(F.struct(F.col("text").alias("content")).alias("delta"))).alias("choices"))))
    lines = t.select("conv_id", "turn", chunk.alias("value"))
    ends = t.groupBy("conv_id").agg((F.max("turn") + 1).alias("turn")).withColumn("value", F.lit("data: [DONE]"))
    noise = t.select("conv_id", "turn", F.lit(": ping").alias("value"))
    return files.sse(lines.unionByName(ends).unionByName(noise), "conv_id", "turn").select("conv_id", "answer", "done")


# --- metrics


@query("select event_type, count(*) as n from events group by event_type")
def metrics_counters(spark, sf):
    return metrics.counters(table(spark, sf, "events"), "event_type")


_BOUNDS = (1.0, 5.0, 10.0, 50.0, 100.0)


@query("select event_type, b.le, count(*) filter (where value <= b.le)::bigint as n from events, (values (1.0::double), (5.0), (10.0), (50.0), (100.0), ('inf'::double)) as b(le) group by event_type, b.le")
def metrics_histogram(spark, sf):
    return metrics.histogram(table(spark, sf, "events"), "value", _BOUNDS, "event_type")


@query("select event_type, quantile_disc(value, 0.5) as p50, quantile_disc(value, 0.95) as p95 from events group by event_type")
def metrics_quantiles(spark, sf):
    return metrics.nearest_rank(table(spark, sf, "events"), "value", {"p50": 0.5, "p95": 0.95}, "event_type")


@query("select date_trunc('minute', ts) as \"start\", event_type, count(*) as n, count(*) / 60.0::double as per_second from events group by all")
def metrics_rate_1m(spark, sf):
    return metrics.rate(table(spark, sf, "events"), "ts", "1 minute", 60, "event_type")


@query(
    "with e as (select user_id, ts, 1 as d from events union all select user_id, ts + interval 90 seconds, -1 from events), s as (select user_id, ts, sum(d) as d from e group by all) "
    "select user_id, ts, (sum(d) over (partition by user_id order by ts))::bigint as n from s"
)
def inflight_gauge(spark, sf):
    e = table(spark, sf, "events").withColumn("until", F.col("ts") + F.expr("interval 90 seconds"))
    return metrics.in_flight(e, "ts", "until", "user_id")


@query(
    "with k as (select count(*) filter (where c_custkey % 4 = 0) as missed, count(*) filter (where c_custkey % 4 <> 0) as hit, count(*) filter (where c_custkey % 5 = 0) as extra from customer), "
    "s as (select hit as tp, extra as fp, missed as fn from k), r as (select *, tp / (tp + fp)::double as p, tp / (tp + fn)::double as r from s) "
    "select c.category, tp, fp, fn, round(p, 9) as precision, round(r, 9) as recall, round(2 * p * r / (p + r), 9) as f1 from r, (values ('phone'), ('TOTAL')) as c(category)"
)
def accuracy_prf(spark, sf):
    c = table(spark, sf, "customer")
    expected = c.select(F.col("c_custkey").alias("id"), F.lit("phone").alias("category"), F.lit(10).alias("start"), F.lit(20).alias("end"))
    hit = expected.where("id % 4 <> 0").withColumn("end", F.lit(21))
    extra = expected.where("id % 5 = 0").withColumn("start", F.lit(50)).withColumn("end", F.lit(60))
    s = accuracy.score(hit.unionByName(extra), expected)
    return s.select("category", "tp", "fp", "fn", *[F.round(x, 9).alias(x) for x in ("precision", "recall", "f1")])


@query("""with n as (select n_nationkey, 'Клиент Иванов Иван Иванович, тел +7 (916) 123-45-' || lpad(n_nationkey::varchar, 2, '0') || '. Обычный текст без данных. ' as unit, unnest(range(420)) as i from nation)
select n_nationkey, (i * length(unit) + 7)::int as "start", 'full_name' as category, 'Иванов Иван Иванович' as value from n
union all select n_nationkey, (i * length(unit) + 33)::int, 'phone', substr(unit, 34, 18) from n""")
def chunked_equals_whole(spark, sf):
    """Every span of texts that are long enough to be read in parts."""
    unit = F.concat(F.lit("Клиент Иванов Иван Иванович, тел +7 (916) 123-45-"), F.lpad(F.col("n_nationkey").cast("string"), 2, "0"), F.lit(". Обычный текст без данных. "))
    d = detect.detect(table(spark, sf, "nation").select("n_nationkey", F.repeat(unit, 420).alias("text"))).select("n_nationkey", "text", F.explode("spans").alias("s"))
    return d.select("n_nationkey", F.col("s.start").alias("start"), F.col("s.category").alias("category"), F.substring("text", F.col("s.start") + 1, F.col("s.end") - F.col("s.start")).alias("value"))


# --- the record store and the mask and unmask flows, over records made from customers


def _records(spark, sf, owner: str = "one"):
    """A store with a record for each customer but every third; the masked text names the customer."""
    k = F.col("c_custkey").cast("string")
    c = table(spark, sf, "customer").where("c_custkey % 3 <> 0")
    r = F.array(F.struct(F.lit("email").alias("c"), F.concat(F.lit("u"), k, F.lit("@m.ru")).alias("o"), F.lit("[EMAIL_1]").alias("m"), F.lit(5).alias("s"), F.lit(14).alias("e")))
    record = F.struct(r.alias("replacements"), F.lit("token").alias("strategy"), _now().alias("created_at"), F.lit("mail [EMAIL_1]").alias("masked"),
                      F.sha2(F.concat(F.lit("mail u"), k, F.lit("@m.ru")), 256).alias("hash"), F.lit(owner).alias("system"))
    return records.rows(c.withColumn("id", k), "id", record, _seal_key(), ID_KEY, 60, _now())


@query("""select c_custkey, case c_custkey % 3 when 0 then 'stored' when 1 then 'idempotent' else 'looks_like_unmask' end as outcome,
case c_custkey % 3 when 0 then 'mail [EMAIL_1]' when 1 then 'mail [EMAIL_1]' end as result, case c_custkey % 3 when 2 then null else 1 end as n_email from customer""")
def mask_flow(spark, sf):
    """Masking by id over a store: new ids, repeated texts, and texts that are the stored mask."""
    k = F.col("c_custkey").cast("string")
    text = F.when(F.col("c_custkey") % 3 == 2, F.lit("mail [EMAIL_1]")).otherwise(F.concat(F.lit("mail u"), k, F.lit("@m.ru")))
    none = F.array().cast("array<string>"), F.array().cast("array<struct<category:string,requires_any:array<string>>>")
    ask = table(spark, sf, "customer").select(text.alias("text"), k.alias("id"), F.lit("one").alias("system"), none[0].alias("categories"), none[1].alias("combo_rules"), F.lit("token").alias("strategy"))
    answers, _ = process.mask(ask, _records(spark, sf), _seal_key(), ID_KEY, _now())
    return answers.select(F.col("id").cast("long").alias("c_custkey"), "outcome", "result", F.try_element_at("found", F.lit("email")).alias("n_email"))


@query("""select c_custkey, case when c_custkey % 3 = 0 or c_custkey % 5 = 0 then 404 else 200 end as status,
case when c_custkey % 3 = 0 or c_custkey % 5 = 0 then null else 'reply to u' || c_custkey || '@m.ru today' end as restored,
case when c_custkey % 3 = 0 or c_custkey % 5 = 0 then null else 0 end as misses from customer""")
def unmask_flow(spark, sf):
    """Restoring by id: own records, ids without one, and another system's."""
    c = F.col("c_custkey")
    ask = table(spark, sf, "customer").select(c.cast("string").alias("id"), F.lit("reply to [EMAIL_1] today").alias("text"), F.when(c % 5 == 0, F.lit("two")).otherwise(F.lit("one")).alias("system"))
    got = process.unmask(ask, _records(spark, sf), _seal_key(), ID_KEY, _now())
    return got.select(F.col("id").cast("long").alias("c_custkey"), "status", "restored", "misses")


@query("""select o_custkey as id, max(o_orderkey) as seq, count(*) over () as n from orders where o_custkey % 4 <> 0 group by o_custkey""")
def save_last_wins_and_delete(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_custkey").cast("string").alias("id_hash"), F.col("o_orderkey").alias("seq"))
    store = records.save(o.groupBy("id_hash").agg(F.min("seq").alias("seq")), o, "seq")
    left = records.delete(store, o.where("id_hash % 4 = 0"))
    return left.select(F.col("id_hash").cast("long").alias("id"), "seq", F.lit(left.count()).alias("n"))


@query("select c_custkey, 'mail [EMAIL_1]' as masked, 'u' || c_custkey || '@m.ru' as original, 1 as n_email from customer where c_custkey % 3 <> 0")
def load_records(spark, sf):
    k = F.col("c_custkey")
    ids = table(spark, sf, "customer").select(k, C.hashed_id(ID_KEY, k.cast("string")).alias("id_hash"))
    got = records.load(_records(spark, sf), _seal_key(), _now()).join(ids, "id_hash")
    return got.select("c_custkey", "record.masked", F.col("record.replacements")[0]["o"].alias("original"), process.counts_from_record(F.col("record"))["email"].alias("n_email"))


@query()
def streaming_process_parity(spark, sf):
    """The streaming flow over one micro-batch of requests made from nations, two for each id."""
    from ..streaming import process as stream

    made = table(spark, sf, "nation")
    k = F.col("n_nationkey").cast("string")
    one = made.select((F.col("n_nationkey") * 2).cast("long").alias("seq"), F.concat(F.lit("mail u"), k, F.lit("@m.ru")).alias("payload"), k.alias("payload_id"))
    two = made.select((F.col("n_nationkey") * 2 + 1).cast("long").alias("seq"), F.lit("answer to [EMAIL_1]").alias("payload"), k.alias("payload_id"))
    folder = f"{shared_folder(spark)}/{hashlib.sha256(sf.encode()).hexdigest()[:8]}-{uuid.uuid4().hex}"
    none = made.select((F.col("n_nationkey") * 2 + 1000).cast("long").alias("seq"), F.lit(None).cast("string").alias("payload"), k.alias("payload_id"))
    foreign = made.select((F.col("n_nationkey") * 2 + 2000).cast("long").alias("seq"), F.lit("answer to [EMAIL_1]").alias("payload"), k.alias("payload_id"))
    rows = one.unionByName(two).unionByName(none).withColumn("system", F.lit("default")).unionByName(foreign.withColumn("system", F.lit("other"))).withColumn("unmask", F.lit(True))
    rows.write.mode("overwrite").parquet(f"{folder}/in")
    answers = stream.process(spark.readStream.schema(rows.schema).parquet(f"{folder}/in"), ID_KEY, _seal_key())
    run = answers.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/ck").trigger(availableNow=True).start()
    run.awaitTermination(120)
    run.stop()
    return spark.read.parquet(f"{folder}/out").select("seq", "status", "outcome", "result", "misses")


ORACLE_SQL["streaming_process_parity"] = """
select (n_nationkey * 2)::bigint as seq, 200 as status, 'masked' as outcome, 'mail [EMAIL_1]' as result, null::int as misses from nation
union all select (n_nationkey * 2 + 1)::bigint, 200, 'restored', 'answer to u' || n_nationkey || '@m.ru', 0 from nation
union all select (n_nationkey * 2 + 1000)::bigint, 400, null, null, null from nation
union all select (n_nationkey * 2 + 2000)::bigint, 200, 'foreign', 'answer to [EMAIL_1]', null from nation"""


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data found in all documents, masked, with counts."""
    d = masking.apply(detect.detect(table(spark, sf_dir, "documents")), "full")
    return d.select("doc_id", "masked", F.size("replacements").alias("n_found"))
