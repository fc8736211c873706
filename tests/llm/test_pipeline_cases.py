"""What each stage of the pipeline does with nulls, empty and very long texts, ties, repeated rows and columns of clashing names."""

import corpus_pipeline as C
import pytest

DDL = "doc_id long, text string, lang string, source string, n_chars long, row string, own long, _name string, size long, doc long"
LONG = " ".join(f"w{i % 977}x{i % 31}" for i in range(30_000))
ROWS = [
    (1, "alpha beta gamma delta epsilon zeta eta theta", "en", "a", 1, "r", 1, "n", 2, 3),
    (1, "something else altogether, of the same number", "en", "a", 1, "r", 1, "n", 2, 3),
    (2, "alpha beta gamma delta epsilon zeta eta theta", "en", "b", 1, "r", 1, "n", 2, 3),
    (2, "alpha beta gamma delta epsilon zeta eta theta", "en", "b", 1, "r", 1, "n", 2, 3),
    (3, None, None, None, None, None, None, None, None, None),
    (4, "", "en", "a", 0, "r", 1, "n", 2, 3),
    (5, "", "en", "a", 0, "r", 1, "n", 2, 3),
    (None, "a text without a number, to be kept", "en", None, 1, "r", 1, "n", 2, 3),
    (None, "a text without a number, to be kept", "en", None, 1, "r", 1, "n", 2, 3),
    (6, LONG, "en", "c", 1, "r", 1, "n", 2, 3),
    (7, LONG + " tail", "en", "c", 1, "r", 1, "n", 2, 3),
    (8, "mail me at someone@example.com or +49 151 23456789", "en", "c", 1, "r", 1, "n", 2, 3),
]
STAGE = dict(C.STAGES)
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, DDL).repartition(3)


def kept(df):
    return sorted(((r.doc_id, None if r.text is None else r.text[:60]) for r in df.collect()), key=str)


def test_toxicity_keeps_clean_rows(spark, docs):
    out = STAGE["toxicity"](spark, docs, SF)
    assert out.columns == docs.columns and kept(out) == kept(docs)


def test_near_dedup_loses_no_text(spark, docs):
    got = STAGE["near_dedup"](spark, docs, SF)
    assert got.columns == docs.columns
    want = [(1, ROWS[0][1]), (1, ROWS[1][1]), (3, None), (6, LONG[:60]), (8, ROWS[11][1]), (None, ROWS[7][1]), (None, ROWS[8][1])]
    assert kept(got) == sorted(want, key=str)  # of empty texts that of the null text's document, the smallest
    assert kept(STAGE["near_dedup"](spark, docs.repartition(5), SF)) == kept(got)


def test_personal_data_is_masked_and_nothing_else(spark, docs):
    got = STAGE["pii"](spark, docs, SF)
    assert got.columns == docs.columns
    texts = {(r.doc_id, r.text) for r in got.collect()}
    assert {(d, t) for d, t, *_ in ROWS if d != 8 and t is not None} <= texts
    masked = next(t for d, t in texts if d == 8)
    assert "someone@example.com" not in masked and "23456789" not in masked and masked.startswith("mail me at ")


def test_mixing_copies_whole_rows(spark, docs):
    got = STAGE["mixing"](spark, docs, SF)
    assert got.columns == docs.columns and set(kept(got)) <= set(kept(docs))
    assert kept(STAGE["mixing"](spark, docs.repartition(7), SF)) == kept(got)
    assert max(sum(r.doc_id == d for r in got.collect()) for d in (6, 7, 8)) <= 2


def test_packing_takes_every_id(spark, docs):
    got = STAGE["packing"](spark, docs, SF).collect()
    assert sum(r.length for r in got if r.doc_id == 4) == 1 and sum(r.length for r in got if r.doc_id == 3) == 1
    assert sum(r.length for r in got if r.doc_id == 6) == next(r.doc_tokens for r in got if r.doc_id == 6)
    assert sum(r.length for r in got if r.doc_id is None) == 2 * next(r.doc_tokens for r in got if r.doc_id is None)


def test_each_stage_on_no_rows(spark, docs):
    for name, stage in C.STAGES:
        assert stage(spark, docs.limit(0), SF).collect() == [], name
