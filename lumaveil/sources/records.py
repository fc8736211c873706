"""The record store: encrypted replacements under a hashed id, with an owner and an expiry."""

from __future__ import annotations

import base64
import binascii
import os
import secrets

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import hashed_id
from ..operators.masking import REPLACEMENT

RECORD = T.StructType(
    [T.StructField("replacements", T.ArrayType(REPLACEMENT)), T.StructField("strategy", T.StringType()), T.StructField("created_at", T.TimestampType()),
     T.StructField("masked", T.StringType()), T.StructField("hash", T.StringType()), T.StructField("system", T.StringType())]
)


def key_from_env(name: str) -> bytes:
    """32 bytes in hex or base64 from an environment variable; a random key where it is not set."""
    raw = os.environ.get(name, "")
    if not raw:
        return secrets.token_bytes(32)
    for read in (binascii.unhexlify, lambda x: base64.b64decode(x, validate=True)):
        try:
            key = read(raw)
        except (binascii.Error, ValueError):
            continue
        if len(key) == 32:
            return key
    raise ValueError(f"{name} is no key of 32 bytes in hex or base64")


def seal(record: Column, key: Column) -> Column:
    """AES-GCM of the record's JSON: nonce, ciphertext and tag in one binary. The key is a column, so that it is no literal of a plan."""
    return F.aes_encrypt(F.to_json(record).cast("binary"), key, F.lit("GCM"))


def unseal(sealed: Column, key: Column) -> Column:
    return F.from_json(F.try_aes_decrypt(sealed, key, F.lit("GCM")).cast("string"), RECORD)


def rows(df: DataFrame, name: str, record: Column, key: Column, id_key: bytes, ttl_seconds: int, now: Column) -> DataFrame:
    """(id_hash, sealed, expires_at) to store; a ttl of 0 or less never expires."""
    expires = F.when(F.lit(ttl_seconds) > 0, now + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(ttl_seconds)))
    return df.select(hashed_id(id_key, F.col(name)).alias("id_hash"), seal(record, key).alias("sealed"), expires.alias("expires_at"))


def live(store: DataFrame, now: Column) -> DataFrame:
    return store.where(F.col("expires_at").isNull() | (F.col("expires_at") > now))


def load(store: DataFrame, key: Column, now: Column) -> DataFrame:
    """(id_hash, record) of what has not expired and can be read."""
    return live(store, now).select("id_hash", unseal(F.col("sealed"), key).alias("record")).where("record is not null")


def first_per(df: DataFrame, by: str, *order: str | Column) -> DataFrame:
    """The first row of each key in an order that leaves no ties: first write wins. Combines before the shuffle."""
    rows = df.withColumn("_o", F.struct(*[F.col(o) if isinstance(o, str) else o for o in order])).withColumn("_r", F.struct(*df.columns))
    return rows.groupBy(by).agg(F.min_by("_r", "_o").alias("_r")).select("_r.*")


def save_new(store: DataFrame, new: DataFrame, now: Column, *order: str) -> tuple[DataFrame, DataFrame]:
    """(what the store gains, what lost): one row for each id without a live record. new: id_hash and more."""
    fresh = new.join(live(store, now).select("id_hash").distinct(), "id_hash", "left_anti")
    won = first_per(fresh, "id_hash", *order)
    lost = new.withColumn("_n", F.row_number().over(Window.partitionBy("id_hash").orderBy(*order)))
    lost = lost.join(live(store, now).select("id_hash", F.lit(True).alias("_had")).distinct(), "id_hash", "left")
    return won, lost.where((F.col("_n") > 1) | F.col("_had")).drop("_n", "_had")


def save(store: DataFrame, new: DataFrame, *order: str) -> DataFrame:
    """The store after an upsert in which the last write of an id wins."""
    rows = new.withColumn("_o", F.struct(*order)).withColumn("_r", F.struct(*new.columns))
    back = rows.groupBy("id_hash").agg(F.max_by("_r", "_o").alias("_r")).select("_r.*")
    return store.join(back.select("id_hash"), "id_hash", "left_anti").unionByName(back.select(*store.columns))


def delete(store: DataFrame, ids: DataFrame) -> DataFrame:
    return store.join(ids.select("id_hash"), "id_hash", "left_anti")
