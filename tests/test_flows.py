import pytest
from pyspark.sql import functions as F

from lumaveil.plans import catalogue as K
from lumaveil.plans import process
from lumaveil.sources import files, records


def now():
    return F.lit("2024-01-01 00:00:00").cast("timestamp")


def key():
    return F.lit(bytes(range(32)))


def test_records_round_trip_and_expire(spark):
    df = spark.createDataFrame([("a", [("phone", "+7", "[P]", 0, 3)], "token", "m", "h", "sys")], "id string, r array<struct<c:string,o:string,m:string,s:int,e:int>>, strategy string, masked string, hash string, system string")
    record = F.struct(F.col("r").alias("replacements"), "strategy", now().alias("created_at"), "masked", "hash", "system")
    store = records.rows(df, "id", record, key(), b"k", 60, now())
    got = records.load(store, key(), now()).first()
    assert got.record.replacements[0].o == "+7" and got.record.system == "sys" and len(got.id_hash) == 16
    assert records.load(store, key(), F.lit("2024-01-01 00:01:00").cast("timestamp")).count() == 0
    assert records.load(store, F.lit(bytes(32)), now()).count() == 0
    again = records.save(store, records.rows(df.withColumn("masked", F.lit("n")), "id", record, key(), b"k", 0, now()).withColumn("seq", F.lit(1)), "seq")
    assert records.load(again, key(), now()).first().record.masked == "n"
    assert records.delete(again, again).count() == 0


def test_records_of_earlier_batches(spark):
    systems = files.systems(spark, [{"id": "default", "strategy": "token"}, {"id": "other"}])
    empty = spark.createDataFrame([], "id_hash string, sealed binary, expires_at timestamp")
    ddl = "seq long, payload string, payload_id string, system string"
    one = spark.createDataFrame([(1, "мой email a@b.ru", "x", "default")], ddl)
    answers, new = process.process(one, systems, empty, key(), b"k", now())
    store = spark.createDataFrame(new.collect(), new.schema)
    assert answers.first().result == "мой email [EMAIL_1]"
    two = spark.createDataFrame([(2, "вот [EMAIL_1]", "x", "default"), (3, "вот [EMAIL_1]", "x", "other")], ddl)
    answers, new = process.process(two, systems, store, key(), b"k", now())
    assert {r.seq: (r.outcome, r.result) for r in answers.collect()} == {2: ("restored", "вот a@b.ru"), 3: ("foreign", "вот [EMAIL_1]")}
    assert new.count() == 0
    log = process.request_log(answers, two, b"k")
    assert "payload" not in log.columns and all(len(r.payload_id) == 16 for r in log.collect())


def test_configuration_is_checked(spark):
    for bad in ([{"id": ""}], [{"id": "a"}, {"id": "a"}], [{"id": "a", "strategy": "x"}], [{"id": "a", "categories": ["x"]}], [{"id": "a", "combo_rules": [{"category": "pin", "requires_any": ["x"]}]}]):
        with pytest.raises(ValueError):
            files.systems(spark, bad)


def test_labelled_values_get_places(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"id":"1","text":"мой a@b.ru тут","spans":[{"value":"a@b.ru","category":"email"}]}\n\n{"id":"2","text":"x x","spans":[]}\n')
    rows = files.labelled(spark, str(tmp_path)).orderBy("id").collect()
    assert [(s.start, s.end) for s in rows[0].spans] == [(4, 10)]
    (tmp_path / "a.jsonl").write_text('{"id":"1","text":"x x","spans":[{"value":"x","category":"email"}]}\n')
    with pytest.raises(Exception, match="exactly once"):
        files.labelled(spark, str(tmp_path)).collect()


def test_requests_are_checked(spark):
    lines = spark.createDataFrame([('{"payload":"a","payload_id":"1"}',), ('{"payload":"","payload_id":"1"}',), ('{"payload_id":"1"}',), ("nope",), ('{"payload":"a"}',)], "value string")
    assert [r.status for r in files.requests(lines).collect()] == [200, 200, 400, 400, 400]


SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["detect_email", "process_state_machine", "metrics_histogram", "accuracy_prf", "streaming_process_parity", "conversation_shared_token"])
def test_queries_equal_their_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for t in ("nation", "customer", "orders", "events", "documents", "conversations"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    df = K.QUERIES[name](spark, SF)
    got, want = df.toPandas(), con.execute(K.ORACLE_SQL[name]).df()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    show = lambda d: sorted(str([None if v != v else float(v) if isinstance(v, (int, float)) else v for v in r]) for r in d[columns].astype(object).where(d[columns].notna(), None).itertuples(index=False))
    assert show(got) == show(want)


def test_entry_and_catalogue(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


def test_mask_and_unmask_by_id(spark):
    ddl = "text string, id string, system string, categories array<string>, combo_rules array<struct<category:string,requires_any:array<string>>>, strategy string"
    ask = lambda *rows: spark.createDataFrame([(t, i, s, [], [], "token") for t, i, s in rows], ddl)
    empty = spark.createDataFrame([], "id_hash string, sealed binary, expires_at timestamp")
    answers, new = process.mask(ask(("почта a@b.ru и c@d.ru", "x", "one"), ("тел +7 (916) 123-45-67", "y", "one")), empty, key(), b"k", now())
    got = {r.id: r for r in answers.collect()}
    assert got["x"].outcome == "stored" and got["x"].result == "почта [EMAIL_1] и [EMAIL_2]" and got["x"].found == {"email": 2}
    store = spark.createDataFrame(new.collect(), new.schema)
    answers, changed = process.mask(ask(("почта a@b.ru и c@d.ru", "x", "one"), ("другой e@f.ru", "y", "one")), store, key(), b"k", now())
    got = {r.id: r for r in answers.collect()}
    assert (got["x"].outcome, got["x"].result, got["x"].found) == ("idempotent", "почта [EMAIL_1] и [EMAIL_2]", {"email": 2})
    assert got["y"].outcome == "overwrite" and changed.count() == 1
    answers, changed = process.mask(ask(("почта", "x", "two"), ("тел [PHONE_1]", "y", "one")), store, key(), b"k", now())
    got = {r.id: (r.outcome, r.status, r.result) for r in answers.collect()}
    assert got == {"x": ("conflict", 409, None), "y": ("looks_like_unmask", 409, None)} and changed.count() == 0
    back = spark.createDataFrame([("x", "ответ [EMAIL_2]!", "one"), ("x", "ответ [EMAIL_2]!", "two"), ("z", "t", "one")], "id string, text string, system string")
    got = [tuple(r) for r in process.unmask(back, store, key(), b"k", now()).orderBy("id", "system").collect()]
    assert got == [("x", "one", 200, "ответ c@d.ru!", 1), ("x", "two", 404, None, None), ("z", "one", 404, None, None)]


class Held:
    """What the streaming flow asks of its state."""

    def __init__(self, now):
        self.now, self.value, self.timeout, self.hasTimedOut = now, None, None, False

    exists = property(lambda self: self.value is not None)
    get = property(lambda self: self.value)

    def getCurrentProcessingTimeMs(self):
        return self.now

    def update(self, value):
        self.value = value

    def remove(self):
        self.value = None

    def setTimeoutDuration(self, ms):
        self.timeout = ms


def test_streaming_records_expire_when_written(spark):
    import pandas as pd

    from lumaveil.streaming.process import _flow

    frame = lambda seq, h, system="one": pd.DataFrame({"seq": [seq], "system": [system], "hash": [h], "sealed": [h.encode()], "asked": [b"a"]})
    state = Held(1_000)
    run = lambda f: next(_flow(("k",), iter([f]), state, 10)).iloc[0]
    assert run(frame(1, "h")).first and state.timeout == 10_000
    state.now = 9_000
    again = run(frame(2, "h"))
    assert not again["first"] and again.same and state.timeout == 2_000  # reading does not prolong
    state.now = 11_000
    assert run(frame(3, "g", "two"))["first"]
    state.hasTimedOut = True
    assert list(_flow(("k",), iter([]), state, 10)) == [] and state.value is None


def test_last_write_wins_beyond_the_range_of_doubles(spark):
    store = spark.createDataFrame([("a", 0, "old")], "id_hash string, seq long, v string")
    rows = [("a", (1 << 53) + 1, "late"), ("a", 1 << 53, "early"), ("b", 1, "b")]
    for order in (rows, rows[::-1]):
        new = spark.createDataFrame(order, "id_hash string, seq long, v string")
        assert {r.id_hash: r.v for r in records.save(store, new, "seq").collect()} == {"a": "late", "b": "b"}


def test_ids_under_long_keys_and_spans_after_control_characters(spark):
    import hashlib
    import hmac

    from lumaveil.functions import columns as C

    one = spark.createDataFrame([("a\u0001\u0002 x@y.ru",), ("",), (None,)], "t string")
    for k in (b"k" * 64, b"k" * 65, b"k" * 100):
        assert one.select(C.hashed_id(k, F.lit("id")).alias("h")).first().h == hmac.new(k, b"id", hashlib.sha256).hexdigest()[:16]
    got = [r.s for r in one.select(C.find_spans(F.col("t"), r"[a-z]+@[a-z.]+", "email").alias("s")).collect()]
    assert [(s.start, s.end, s.value) for s in got[0]] == [(4, 10, "x@y.ru")] and got[1] == [] and got[2] is None
    latin = one.select(C.transliterated(F.lit("Щукин Юрий Ёж, объявлен Xyz")).alias("t")).first().t
    assert latin == "Schukin Yuriy Ezh, obyavlen Xyz"


def test_keys_from_the_environment(monkeypatch):
    import base64

    monkeypatch.setenv("A_KEY", bytes(range(32)).hex())
    assert records.key_from_env("A_KEY") == bytes(range(32))
    monkeypatch.setenv("A_KEY", base64.b64encode(bytes(range(32))).decode())
    assert records.key_from_env("A_KEY") == bytes(range(32))
    monkeypatch.delenv("A_KEY")
    assert len(records.key_from_env("A_KEY")) == 32
    monkeypatch.setenv("A_KEY", "short")
    with pytest.raises(ValueError):
        records.key_from_env("A_KEY")


def test_rules_masks_and_combinations_from_configurations(tmp_path, spark):
    from lumaveil.operators import detect, masking, metrics, rules

    own = rules.from_config([{"name": "badge", "category": "id_document", "pattern": r"\b\d{4}-[A-Z]{2}\b", "context": ["Badge"], "required": True, "reclassify": [["pin", ["secret"], []]]}])
    found = rules.detect(rules.Text("badge 1234-AB" + " x" * 30 + " 5555-CD" + " y" * 30 + " secret badge 7777-EF"), own)
    assert [(s[0], s[2]) for s in found] == [(6, "id_document"), (155, "pin")]
    for bad in ({"category": "nope"}, {"category": "pin", "pattern": "("}, {"category": "pin", "pattern": "a", "validator": "no"}, {"category": "pin", "pattern": "a", "colour": 1}):
        with pytest.raises(ValueError):
            rules.from_config([{"name": "x", **bad}])
    config = masking.partial_rules({"defaults": {"keep_head": 1}, "categories": {"inn": {"keep_tail": 0}, "phone": {"mode": "words"}}})
    assert masking.partial_of("500100732259", "inn", config) == "5***********" and config["phone"][0] == "words"
    with pytest.raises(ValueError):
        masking.partial_rules({"categories": {"inn": {"mode": "upside down"}}})
    (tmp_path / "combos.json").write_text('[{"category": "pin", "requires_any": ["card_number"]}]')
    assert files.combo_rules(str(tmp_path / "combos.json")) == [{"category": "pin", "requires_any": ["card_number"]}]
    (tmp_path / "words.txt").write_text("Москва\n\n# towns\nказань \nМОСКВА\n")
    assert sorted(r.word for r in files.dictionary(spark, str(tmp_path / "words.txt")).collect()) == ["казань", "москва"]
    masking.strategy("brackets", lambda value, category, number: f"<{category}>")
    assert masking.put_masks("pin 1234", [{"start": 4, "end": 8, "category": "pin"}], "brackets")[0] == "pin <pin>"
    del masking.MASKS["brackets"]
    detect.register(spark)
    assert spark.sql("select mask_text('почта a@b.ru', 'token') as m").first().m == "почта [EMAIL_1]"
    df = spark.createDataFrame([('a"b', 3)], "l string, n int")
    assert [r.line for r in metrics.exposition(df, "hits", "counter", "n", "l").collect()] == ["# TYPE hits counter", 'hits{l="a\\"b"} 3']
    log = spark.createDataFrame([("mask", 200, 5.0), ("mask", 200, 7.0), ("mask", 429, 1.0)], "route string, status int, ms double")
    text = metrics.report_text(metrics.load_report(log, 2.0))
    assert "| requests | 3 |" in text and text.index("| 200 | 2 |") < text.index("| 429 | 1 |") and "| max | 7 |" in text
