"""Transaction-shaped views over the given tables.

They stand in for the raw card-transaction feed: same columns, keys, nulls and labels, derived row
by row so that they grow with the tables.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tollgate.functions.keys import account_key, is_degraded
from tollgate.functions.scalars import day_of

# Fixed values of the stand-in: the first second, and the scaled splits and folds of a 30-day feed.
EPOCH = "timestamp_ntz'2024-01-01 00:00:00'"
SPLIT_EDGES = (18, 21, 24)
FOLD_STARTS = (18, 21, 24, 27)
FOLD_DAYS = 3
PRE_PERIOD = (18, 24)
REPLAY_FROM = 24


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per event with typed ids, relative time, amount, label, key parts and a score."""
    k = F.get_json_object("props", "$.k").cast("int")
    u = F.conv(F.substring(F.md5(F.concat(F.lit("score:"), F.col("event_id").cast("string"))), 1, 8),
               16, 10).cast("double") / F.lit(float(2 ** 32))
    base = table(spark, sf_dir, "events").select(
        F.col("event_id").alias("transaction_id"),
        F.expr(f"timestampdiff(SECOND, {EPOCH}, ts)").alias("transaction_dt"),
        F.col("value").cast("decimal(18,3)").alias("transaction_amt"),
        F.when(F.col("event_type") == "error", 1).otherwise(0).alias("is_fraud"),
        F.col("event_type").alias("product_cd"),
        F.col("user_id"), k.alias("k"), u.alias("u"))
    day = base.withColumn("txn_day", day_of())
    user = F.col("user_id")
    return day.select(
        "transaction_id", "transaction_dt", "txn_day", "transaction_amt", "is_fraud", "product_cd", "k",
        F.when(F.col("k") % 25 != 0, user).alias("card1"),
        F.when(F.col("k") % 10 != 0, (user % 7).cast("double")).alias("addr1"),
        F.when(F.col("k") % 9 != 0,
               (F.col("txn_day") - user % 5).cast("double")
               + F.when(F.col("k") == 33, 0.5).otherwise(0.0)).alias("d1"),
        F.round(F.col("u") * F.col("u") * (0.5 + 0.5 * F.col("is_fraud")), 4).alias("score"))


def keyed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Transactions with the standard account key, computed in the row (no self join)."""
    account, tier = account_key()
    return transactions(spark, sf_dir).withColumns(
        {"account_id": account, "account_key_tier": tier, "is_degraded_key": is_degraded(tier)})


def identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The optional side table: at most one row per transaction."""
    return table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("transaction_id"), F.col("c_mktsegment").alias("device_type"),
        F.col("c_acctbal").alias("id_01"))


def dated_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as account streams whose rows share whole days, to exercise time ties."""
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("transaction_id"),
        F.col("o_custkey").cast("string").alias("account_id"),
        F.expr("timestampdiff(DAY, timestamp_ntz'1970-01-01 00:00:00', o_orderdate) * 86400")
        .alias("transaction_dt"),
        F.col("o_totalprice").cast("decimal(18,3)").alias("transaction_amt"))
