"""The request flows: mask or restore by id, mask, unmask, and whole conversations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import estimate_tokens, hashed_id
from ..operators import detect, masking, policy
from ..sources import records
from ..sources.shared import written

#: Systems up to which their table is broadcast; a row has policies only.
FEW_SYSTEMS = 10_000


def masked_by_policy(df: DataFrame, text: str = "text") -> DataFrame:
    """df (with categories, combo_rules and strategy columns) with masked, replacements and found."""
    out = detect.detect(df, text)
    strategy = F.coalesce("strategy", F.lit("partial"))
    out = out.withColumn("_d", masking.put_allowed_masks_udf(text, "spans", strategy, "categories", "combo_rules"))
    return out.select(*[c for c in out.columns if c not in ("_d", "spans")], "_d.*")


def process(requests: DataFrame, systems: DataFrame, store: DataFrame, key: Column, id_key: bytes, now: Column, ttl: int = 3600, default_system: str = "default") -> tuple[DataFrame, DataFrame]:
    """(responses, new records) of a batch of (seq, payload, payload_id, system).

    The first request of an id without a live record masks and stores; others of the batch see its record. By record:
    foreign -> foreign (masked afresh, not stored); same text -> echo; restoring not allowed -> fresh; else restored,
    or fresh if no replacement found its place.
    """
    r = requests.withColumn("status", policy.request_status(F.col("payload"), F.col("payload_id")))
    s = systems.select(F.col("id").alias("system"), "enabled", "categories", "combo_rules", "strategy", "unmask")
    r = r.join(F.broadcast(s) if systems.count() <= FEW_SYSTEMS else s, "system", "left")
    r = r.withColumn("status", F.when(F.col("status") != 200, F.col("status")).when(~F.coalesce("enabled", F.lit(False)), 403).otherwise(200))
    good = r.where("status = 200").withColumn("id_hash", hashed_id(id_key, F.col("payload_id"))).withColumn("hash", F.sha2("payload", 256))
    # detection runs once; an id with many requests is one key of an aggregate and of joins that split it
    masked = written(masked_by_policy(good, "payload")).join(records.load(store, key, now).withColumnRenamed("record", "held"), "id_hash", "left")
    own_record = F.struct("replacements", "strategy", now.alias("created_at"), F.col("masked"), "hash", "system")
    firsts = masked.where("held is null").groupBy("id_hash").agg(F.min_by(F.struct("seq", own_record.alias("record")), "seq").alias("_first"))
    met = masked.join(firsts, "id_hash", "left")
    met = met.withColumn("first", F.col("_first.seq")).withColumn("record", F.coalesce("held", "_first.record"))
    won = firsts.select("id_hash", F.col("_first.record").alias("record"))
    own = owned(F.col("record"), F.col("system"), default_system)
    met = met.withColumn("_r", masking.restore_udf("payload", "record.replacements"))
    outcome = (
        F.when(F.col("first") == F.col("seq"), "masked")
        .when(~own, "foreign")
        .when(F.col("record.hash") == F.col("hash"), "echo")
        .when(~F.coalesce("unmask", F.lit(False)), "fresh")
        .when(F.col("_r.misses") >= F.size("record.replacements"), "fresh")
        .otherwise("restored")
    )
    met = met.withColumn("outcome", outcome)
    result = F.when(F.col("outcome") == "echo", F.col("record.masked")).when(F.col("outcome") == "restored", F.col("_r.restored")).otherwise(F.col("masked"))
    answers = met.select("seq", "payload_id", "system", "status", "outcome", result.alias("result"), F.when(F.col("outcome") == "restored", F.col("_r.misses")).alias("misses"), "found")
    bad = r.where("status <> 200").select("seq", "payload_id", "system", "status", F.lit(None).cast("string").alias("outcome"), F.lit(None).cast("string").alias("result"), F.lit(None).cast("int").alias("misses"), F.lit(None).cast("int").alias("found"))
    expires = F.when(F.lit(ttl) > 0, now + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(ttl)))
    new = won.select("id_hash", records.seal(F.col("record"), key).alias("sealed"), expires.alias("expires_at"))
    return answers.unionByName(bad), new


def mask_outcome(store_hash: Column, store_masked: Column, owned: Column, text: Column) -> Column:
    """What masking under an id with a record does: idempotent, looks_like_unmask, conflict, overwrite; stored without one."""
    return (
        F.when(store_hash.isNull(), "stored").when(~owned, "conflict").when(store_hash == F.sha2(text, 256), "idempotent")
        .when(store_masked == text, "looks_like_unmask").otherwise("overwrite")
    )


def counts_from_record(record: Column) -> Column:
    """map<category, count> of a record's replacements."""
    each = F.transform(record["replacements"], lambda r: r["c"])
    return F.map_from_entries(F.transform(F.array_distinct(each), lambda c: F.struct(c, F.size(F.filter(each, lambda x: x == c)))))


def owned(record: Column, system: Column, default_system: str) -> Column:
    """Whether the system owns the record; one without an owner is the default system's."""
    owner = F.coalesce(record["system"], F.lit(""))
    return F.when(owner == "", system == default_system).otherwise(owner == system)


def mask(requests: DataFrame, store: DataFrame, key: Column, id_key: bytes, now: Column, ttl: int = 3600, default_system: str = "default") -> tuple[DataFrame, DataFrame]:
    """(responses, records to save) of masking (text, id, system, categories, combo_rules, strategy), one request an id.

    outcome and status: stored 200, overwrite 200 (an own record with other text is replaced), idempotent 200 (the stored
    mask comes back), conflict 409 (the record is another system's), looks_like_unmask 409 (the text is the stored mask).
    """
    r = requests.withColumn("id_hash", hashed_id(id_key, F.col("id"))).join(records.load(store, key, now).withColumnRenamed("record", "held"), "id_hash", "left")
    outcome = mask_outcome(F.col("held.hash"), F.col("held.masked"), owned(F.col("held"), F.col("system"), default_system), F.col("text"))
    met = written(masked_by_policy(r.withColumn("outcome", outcome)))
    done = F.col("outcome").isin("stored", "overwrite")
    result = F.when(done, F.col("masked")).when(F.col("outcome") == "idempotent", F.col("held.masked"))
    found = F.when(done, counts_from_record(F.col("_d"))).when(F.col("outcome") == "idempotent", counts_from_record(F.col("held")))
    met = met.withColumn("_d", F.struct("replacements"))
    answers = met.select("id", "system", "outcome", F.when(F.col("outcome").isin("conflict", "looks_like_unmask"), 409).otherwise(200).alias("status"), result.alias("result"), found.alias("found"))
    record = F.struct("replacements", F.coalesce("strategy", F.lit("partial")).alias("strategy"), now.alias("created_at"), F.col("masked"), F.sha2("text", 256).alias("hash"), "system")
    expires = F.when(F.lit(ttl) > 0, now + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(ttl)))
    return answers, met.where(done).select("id_hash", records.seal(record, key).alias("sealed"), expires.alias("expires_at"))


def unmask(requests: DataFrame, store: DataFrame, key: Column, id_key: bytes, now: Column, default_system: str = "default") -> DataFrame:
    """(id, system, status, restored, misses) of unmasking (id, text, system): 404 without a live record of the system's
    own, and for another system's record too, so that nobody learns of it."""
    r = requests.withColumn("id_hash", hashed_id(id_key, F.col("id"))).join(records.load(store, key, now), "id_hash", "left")
    mine = F.col("record").isNotNull() & F.coalesce(owned(F.col("record"), F.col("system"), default_system), F.lit(False))
    r = r.withColumn("_m", mine).withColumn("_r", masking.restore_udf(F.when(F.col("_m"), F.col("text")), "record.replacements"))
    return r.select("id", "system", F.when(F.col("_m"), 200).otherwise(404).alias("status"), F.when(F.col("_m"), F.col("_r.restored")).alias("restored"), F.when(F.col("_m"), F.col("_r.misses")).alias("misses"))


def request_log(answers: DataFrame, requests: DataFrame, id_key: bytes, route: str = "process") -> DataFrame:
    """One row a request, without a text or an id: counts, and the id's hash."""
    sizes = requests.select("seq", F.char_length("payload").alias("text_len"), estimate_tokens(F.col("payload")).alias("tokens"))
    return answers.join(sizes, "seq", "left").select("seq", F.lit(route).alias("route"), "system", "status", hashed_id(id_key, F.col("payload_id")).alias("payload_id"), "text_len", "tokens", "found", "misses")


ROLES = ("system", "user", "assistant", "tool")


def mask_conversations(turns: DataFrame, strategy: str = "token") -> DataFrame:
    """conv_id, masked (array of turns' texts), replacements over the joined text, bad_role.

    The turns of a conversation are masked as one text, turn after turn with a line end, so that a value has one mask in
    all of them and offsets are those of the joined masked text.
    """
    ordered = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", F.coalesce("text", F.lit("")).alias("text")))).alias("turns"))
    bad = F.exists("turns", lambda x: ~F.coalesce(x["role"].isin(*ROLES), F.lit(False)))
    found = detect.detect(turns.select("conv_id", "turn", F.coalesce("text", F.lit("")).alias("text")))
    before = F.coalesce(F.sum(F.char_length("text") + 1).over(_before()), F.lit(0)).cast("int")
    shifted = found.withColumn("_b", before).withColumn("spans", F.transform("spans", lambda s: F.struct((s["start"] + F.col("_b")).alias("start"), (s["end"] + F.col("_b")).alias("end"), s["category"], s["detector"], s["confidence"])))
    spans = shifted.groupBy("conv_id").agg(F.flatten(F.array_sort(F.collect_list("spans"))).alias("spans"))
    whole = ordered.select("conv_id", bad.alias("bad_role"), F.array_join(F.transform("turns", lambda x: x["text"]), "\n").alias("joined"), F.size("turns").alias("n_turns")).join(spans, "conv_id")
    return masking.apply(whole, strategy, "joined").select("conv_id", "bad_role", "n_turns", "masked", "replacements")


def _before():
    return Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)


def last_user(turns: DataFrame) -> DataFrame:
    return turns.where("role = 'user'").groupBy("conv_id").agg(F.max_by("text", "turn").alias("text"))
