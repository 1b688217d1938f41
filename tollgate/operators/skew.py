"""Joins of a large, possibly skewed table with a key table of one row per key.

A key table whose measured bytes are few is broadcast. A larger one is joined by shuffle. Keys of more than ``HOT_ROWS`` rows,
which one aggregate finds, are then joined on (key, salt): their rows are spread over as many tasks as there are salts and only
their lines of the key table are repeated. The adaptive planner cannot do this by itself when the key side comes straight out
of an aggregate.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tollgate.session import pinned

BROADCAST_BYTES = 32 << 20
ROW_BYTES, FIELD_BYTES = 32, 16  # of a broadcast row and of each field, without what varies
HOT_ROWS = 1_000_000
MOST_HOT = 4_096  # keys that are salted; every other key has less than one in so many of all rows
SALTS = 32


def row_bytes(df: DataFrame) -> Column:
    """About the bytes that a row takes in a broadcast table."""
    fixed = ROW_BYTES + FIELD_BYTES * len(df.columns)
    varying = [F.coalesce(F.octet_length(F.col(f"`{f.name}`").cast("string")), F.lit(0)) for f in df.schema.fields
               if isinstance(f.dataType, (T.StringType, T.BinaryType, T.ArrayType, T.MapType, T.StructType))]
    return reduce(Column.__add__, varying, F.lit(fixed)).cast("long")


def join_keys(df: DataFrame, keys: DataFrame, key: str, how: str = "left", limit: int = BROADCAST_BYTES,
              salts: int = SALTS, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Join ``df`` with ``keys`` (unique on ``key``) by ``left``, ``inner``, ``left_semi`` or ``left_anti``."""
    kept = df.columns if how in ("left_semi", "left_anti") else df.columns + [c for c in keys.columns if c != key]
    if (keys.agg(F.sum(row_bytes(keys))).first()[0] or 0) <= limit:
        return df.join(F.broadcast(keys), key, how).select(*kept)
    # Hot keys are known by a hash, so their list is small whatever the keys; one more key of an equal hash does no harm.
    hot = pinned(df.groupBy(F.xxhash64(key).alias("__hash")).count().where(F.col("count") > hot_rows)
                 .orderBy(F.desc("count"), "__hash").limit(MOST_HOT).select("__hash", F.lit(True).alias("__hot")))
    if hot.isEmpty():
        return df.join(keys, key, how).select(*kept)
    # The salt of a row follows from its content, so a re-run of a lost task places it the same way.
    salt = F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in df.columns]), F.lit(salts)).cast("int")

    def marked(rows: DataFrame) -> DataFrame:
        return rows.withColumn("__hash", F.xxhash64(key)).join(F.broadcast(hot), "__hash", "left")

    salted = marked(df).withColumn("__salt", F.when(F.col("__hot"), salt).otherwise(0))
    spread = marked(keys).withColumn("__salt", F.explode(
        F.when(F.col("__hot"), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0))))).drop("__hash", "__hot")
    return salted.join(spread, [key, "__salt"], how).select(*kept)
