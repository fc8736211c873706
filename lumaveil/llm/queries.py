"""The queries opN_<name>, each over the whole of its table, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import cover, html, mixing, neighbours, packing, pii, simhash, substring, suffix_dedup, toxicity
from .common import table


def _on(name: str, op: Callable[[DataFrame], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: op(table(spark, sf_dir, name))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_packing": _on("documents", packing.op1),
    "op2_neighbours": _on("embeddings", neighbours.op2),
    "op3_toxicity": lambda spark, sf_dir: toxicity.op3(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")),
    "op4_pii": _on("documents", pii.op4),
    "op5_substring": _on("documents", substring.op5),
    "op6_cover": _on("embeddings", cover.op6),
    "op7_mixing": _on("documents", mixing.op7),
    "op8_suffix": _on("documents", suffix_dedup.op8),
    "op9_html": _on("pages", html.op9),
    "op10_simhash": _on("documents", simhash.op10),
}

#: The others are learned, approximate, or stand on hashes that DuckDB lacks; they are tested against brute force.
ORACLE_SQL: dict[str, str] = {
    "op5_substring": r"""
with d as (select doc_id, coalesce(text, '') as t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w, row_number() over () as r from documents),
k as (select r, doc_id, w, unnest(range(1, greatest(len(w) - 11, 1))) as p from d),
g as (select r, p, doc_id > min(doc_id) over (partition by w[p:p + 12]) as gone from k),
x as (select distinct r, unnest(range(p, p + 13)) as i from g where gone),
a as (select r, list(i) as gone from x group by r)
select d.doc_id, len(w)::bigint as n_words, coalesce(len(a.gone), 0)::bigint as n_removed,
sha256(array_to_string(list_filter(w, lambda v, i: not list_contains(coalesce(a.gone, []::bigint[]), i)), ' ')) as kept_sha256 from d left join a using (r)""",
    "op6_cover": """
with recursive v as (select vec_id, embedding::double[] as e from embeddings where vec_id is not null and embedding is not null and len(embedding) > 0 and list_bool_and(list_transform(embedding, lambda x: x is not null and isfinite(x)))),
n as (select vec_id, e, sqrt(list_sum(list_transform(e, lambda x: x * x))) as norm from v where list_sum(list_transform(e, lambda x: x * x)) > 0),
l as (select a.vec_id as a, b.vec_id as b from n a, n b where a.vec_id <> b.vec_id and list_dot_product(a.e, b.e) / (a.norm * b.norm) >= 0.95),
c(a, b) as (select vec_id, vec_id from n union select c.a, l.b from c join l on c.b = l.a)
select e.vec_id, (select count(*) from l where l.a = e.vec_id)::bigint as n_links, coalesce((select min(b) from c where c.a = e.vec_id), e.vec_id) as component_id,
e.vec_id = coalesce((select min(b) from c where c.a = e.vec_id), e.vec_id) as kept from embeddings e""",
    "op8_suffix": r"""
with d as (select doc_id, row_number() over () as r, hex(encode(coalesce(text, ''))) as h from documents),
k as (select r, doc_id, unnest(range(1, greatest(length(h) // 2 - 98, 1))) as p, h from d),
w as (select r, doc_id, p, substr(h, 2 * p - 1, 200) as s from k),
g as (select r, p, row(doc_id, p) > min(row(doc_id, p)) over (partition by s) as gone from w),
x as (select r, p, p - row_number() over (partition by r order by p) as run from g where gone),
y as (select r, min(p) as a, max(p) + 100 as b from x group by r, run),
z as (select *, max(b) over (partition by r order by a rows between unbounded preceding and 1 preceding) as reach from y),
u as (select *, sum(case when reach is null or a > reach then 1 else 0 end) over (partition by r order by a) as span from z),
t as (select r, span, min(a) as a, max(b) as b from u group by r, span),
o as (select r, count(*) as n_spans, sum(b - a) as gone, list(struct_pack(a := a, b := b) order by a) as spans from t group by r)
select d.doc_id, (length(h) // 2)::bigint as n_bytes, coalesce(gone, 0)::bigint as n_removed, coalesce(n_spans, 0)::bigint as n_spans,
sha256(unhex(case when spans is null then h else substr(h, 1, 2 * (spans[1].a - 1)) || array_to_string(list_transform(range(1, len(spans) + 1), lambda i: substr(h, 2 * spans[i].b - 1, 2 * (coalesce(spans[i + 1].a, length(h) // 2 + 1) - spans[i].b))), '') end)) as kept_sha256
from d left join o using (r)""",
}
