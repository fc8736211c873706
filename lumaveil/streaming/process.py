"""The mask-or-restore flow as a stream: keyed state with a time to live, the first write of an id wins.

The state of an id holds its owner, the hash of the first text and its sealed record, and nothing in the clear. What a
record restores is opened behind the state, natively. A record expires when it was written for `ttl` seconds, however
often it is read meanwhile.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions.columns import hashed_id
from ..operators import detect, masking, policy
from ..sources import records

MET = "seq long, id_hash string, own boolean, first boolean, same boolean, sealed binary, asked binary"
STATE = "system string, hash string, sealed binary, expires_at long"


def _flow(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState, ttl: int) -> Iterator[pd.DataFrame]:
    now = state.getCurrentProcessingTimeMs() if ttl > 0 else 0
    if state.hasTimedOut:
        state.remove()
        return
    held = state.get if state.exists else None
    if held is not None and ttl > 0 and held[3] <= now:
        held = None
    out = []
    for r in pd.concat(list(frames)).sort_values("seq").itertuples():
        first = held is None
        if first:
            held = (r.system, r.hash, r.sealed, now + ttl * 1000)
        out.append((r.seq, key[0], held[0] == r.system, first, held[1] == r.hash, held[2], r.asked))
    state.update(held)
    if ttl > 0:
        state.setTimeoutDuration(max(1, held[3] - now))
    yield pd.DataFrame(out, columns=["seq", "id_hash", "own", "first", "same", "sealed", "asked"])


def process(stream: DataFrame, id_key: bytes, key: Column, strategy: str = "token", ttl: int = 0) -> DataFrame:
    """(seq, id_hash, status, outcome, result, misses) of a stream of (seq, payload, payload_id, system, unmask).

    Requests without a payload or an id are answered 400 and never reach the state.
    """
    rows = stream.withColumn("status", policy.request_status(F.col("payload"), F.col("payload_id")))
    good = masking.apply(detect.detect(rows.where("status = 200"), "payload"), strategy, "payload").withColumn("id_hash", hashed_id(id_key, F.col("payload_id")))
    record = F.struct("replacements", F.lit(strategy).alias("strategy"), F.current_timestamp().alias("created_at"), F.col("masked"), F.sha2("payload", 256).alias("hash"), "system")
    # what a request needs behind the state travels with it, sealed like its record
    asked = F.struct(F.col("payload"), F.col("masked"), F.col("unmask"))
    sealed = F.struct(records.seal(record, key).alias("record"), F.aes_encrypt(F.to_json(asked).cast("binary"), key, F.lit("GCM")).alias("asked"))
    good = good.select("id_hash", "seq", "system", F.sha2("payload", 256).alias("hash"), sealed.alias("s"))
    good = good.select("id_hash", "seq", "system", "hash", F.col("s.record").alias("sealed"), F.col("s.asked").alias("asked"))
    timeout = GroupStateTimeout.ProcessingTimeTimeout if ttl > 0 else GroupStateTimeout.NoTimeout
    met = good.groupBy("id_hash").applyInPandasWithState(lambda k, f, s: _flow(k, f, s, ttl), MET, STATE, "append", timeout)
    r = met.withColumn("record", records.unseal(F.col("sealed"), key))
    r = r.withColumn("a", F.from_json(F.aes_decrypt("asked", key, F.lit("GCM")).cast("string"), "payload string, masked string, unmask boolean"))
    r = r.withColumn("_r", masking.restore_udf("a.payload", "record.replacements"))
    outcome = (
        F.when(F.col("first"), "masked").when(~F.col("own"), "foreign").when(F.col("same"), "echo")
        .when(~F.coalesce("a.unmask", F.lit(False)) | (F.col("_r.misses") >= F.size("record.replacements")), "fresh").otherwise("restored")
    )
    r = r.withColumn("outcome", outcome)
    result = F.when(F.col("outcome") == "echo", F.col("record.masked")).when(F.col("outcome") == "restored", F.col("_r.restored")).otherwise(F.col("a.masked"))
    answers = r.select("seq", "id_hash", F.lit(200).alias("status"), "outcome", result.alias("result"), F.when(F.col("outcome") == "restored", F.col("_r.misses")).alias("misses"))
    none = lambda t: F.lit(None).cast(t)
    bad = rows.where("status <> 200").select("seq", none("string").alias("id_hash"), "status", none("string").alias("outcome"), none("string").alias("result"), none("int").alias("misses"))
    return answers.unionByName(bad)


def rates(events: DataFrame, ts: str, late: str, width: str, *labels: str, slide: str | None = None) -> DataFrame:
    """Counts by time window of a stream (tumbling, or sliding every `slide`), later data dropped after `late`."""
    w = F.window(ts, width, slide) if slide else F.window(ts, width)
    return events.withWatermark(ts, late).groupBy(w.alias("w"), *labels).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), *labels, "n")


def sessions(events: DataFrame, ts: str, late: str, gap: str, *labels: str) -> DataFrame:
    """Counts by session of a stream: stretches of events less than `gap` apart."""
    w = F.session_window(ts, gap)
    return events.withWatermark(ts, late).groupBy(w.alias("w"), *labels).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *labels, "n")
