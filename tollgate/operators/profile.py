"""Account dimension and descriptive profiles of the fact table."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tollgate.functions.scalars import mean_of, ratio_or_null, size_bucket

# Base rate of the label and the two alarm levels.
BASE_RATE = 0.034990
NULL_ALARM_PCT = 50.0
DRIFT_ALARM_PCT = 30.0


def account_dimension(fact: DataFrame) -> DataFrame:
    """One row per account over its whole history, the current row included."""
    n = F.count("*")
    return fact.groupBy("account_id").agg(
        F.any_value("account_key_tier").alias("account_key_tier"),
        F.bool_or("is_degraded_key").alias("is_degraded_key"),
        F.min("txn_day").alias("first_seen_day"), F.max("txn_day").alias("last_seen_day"),
        (F.max("txn_day") - F.min("txn_day")).alias("active_day_span"),
        n.alias("txn_count"), F.sum("transaction_amt").alias("total_amount"),
        mean_of(F.sum("transaction_amt"), n).alias("mean_amount"),
        F.sum("is_fraud").alias("fraud_count"), mean_of(F.sum("is_fraud"), n).alias("fraud_rate"))


def table_counts(tables: Mapping[str, DataFrame]) -> DataFrame:
    parts = [df.agg(F.count("*").alias("n_rows")).select(F.lit(name).alias("model"), "n_rows")
             for name, df in tables.items()]
    return reduce(DataFrame.unionByName, parts)


def account_size_stats(dim: DataFrame) -> DataFrame:
    """Exact spread of rows per account. The percentile state holds distinct sizes only."""
    n = F.col("txn_count")
    return dim.agg(
        F.count("*").alias("distinct_accounts"), F.min(n).alias("min_txns"),
        F.percentile(n, F.lit(0.5)).alias("median_txns"), mean_of(F.sum(n), F.count("*")).alias("mean_txns"),
        F.percentile(n, F.lit(0.95)).alias("p95_txns"), F.max(n).alias("max_txns"))


def row_weighted_size(fact: DataFrame, dim: DataFrame) -> DataFrame:
    """Size of the account a typical row sits in.

    Rows collapse to one weight per account before they meet the dimension, so a huge account is one
    row of the join.
    """
    weights = fact.groupBy("account_id").agg(F.count("*").alias("w"))
    joined = weights.join(dim.select("account_id", "txn_count"), "account_id")
    n, w = F.col("txn_count"), F.col("w")
    return joined.agg(
        F.percentile(n, F.lit(0.5), w).alias("txn_weighted_median"),
        mean_of(F.sum(n * w), F.sum(w)).alias("txn_weighted_mean"),
        (100.0 * ratio_or_null(F.sum(F.when(n > 1, w).otherwise(0)), F.sum(w))).alias("pct_txns_in_multi"))


def account_size_histogram(dim: DataFrame) -> DataFrame:
    """Accounts and rows per size bucket, in bucket order."""
    h = dim.groupBy(size_bucket("txn_count").alias("bucket")).agg(
        F.count("*").alias("accounts"), F.sum("txn_count").alias("transactions"),
        F.min("txn_count").alias("__first"))
    whole = Window.partitionBy()  # five rows
    pct = {f"pct_{c}": 100.0 * ratio_or_null(F.col(c), F.sum(c).over(whole))
           for c in ("accounts", "transactions")}
    return h.withColumns(pct).orderBy("__first").drop("__first")


def tier_share(fact: DataFrame, tier: str = "account_key_tier") -> DataFrame:
    counts = fact.groupBy(tier).agg(F.count("*").alias("n_rows"))
    whole = Window.partitionBy()  # one row per tier
    return counts.withColumn("pct", 100.0 * ratio_or_null(F.col("n_rows"), F.sum("n_rows").over(whole)))


def null_profile(df: DataFrame, columns: Sequence[str], alarm_pct: float = NULL_ALARM_PCT) -> DataFrame:
    """Null share per column in one pass, as one row per column."""
    wide = df.agg(*[(100.0 * ratio_or_null(F.count_if(F.col(c).isNull()), F.count("*"))).alias(c)
                    for c in columns])
    long = wide.unpivot([], list(columns), "feature", "null_pct")
    return long.withColumn("over_limit", F.col("null_pct") > alarm_pct)


def block_profile(df: DataFrame, blocks: Mapping[str, Sequence[str]]) -> DataFrame:
    """Per named block: number of columns and the null share of its first column."""
    firsts = {name: cols[0] for name, cols in blocks.items()}
    wide = df.agg(*[(100.0 * ratio_or_null(F.count_if(F.col(c).isNull()), F.count("*"))).alias(name)
                    for name, c in firsts.items()])
    sizes = F.create_map(*[x for name, cols in blocks.items() for x in (F.lit(name), F.lit(len(cols)))])
    return wide.unpivot([], list(blocks), "block", "example_null_pct").withColumn(
        "columns", sizes[F.col("block")])


def coverage(fact: DataFrame, flag: str = "has_identity", label: str = "is_fraud") -> DataFrame:
    n = F.count("*")
    return fact.agg(
        (100.0 * ratio_or_null(F.count_if(flag), n)).alias("flag_pct"), F.count_if(flag).alias("flag_rows"),
        mean_of(F.sum(label), n).alias("fraud_rate"), F.sum(label).alias("fraud_rows"), n.alias("total_rows"))


def split_profile(df: DataFrame, split: Column, base_rate: float = BASE_RATE,
                  alarm_pct: float = DRIFT_ALARM_PCT) -> DataFrame:
    """Rows, positives and deviation from the base rate per split."""
    out = df.groupBy(split.alias("split")).agg(
        F.count("*").alias("n_rows"), F.sum("is_fraud").alias("fraud"),
        mean_of(F.sum("is_fraud"), F.count("*")).alias("fraud_rate"))
    dev = (F.col("fraud_rate") - base_rate) / base_rate * 100
    return out.withColumn("dev_pct", dev).withColumn("drifted", F.abs("dev_pct") > alarm_pct)


def level_counts(df: DataFrame, column: str) -> DataFrame:
    """Frequency of each non-null level."""
    return df.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("level")).agg(
        F.count("*").alias("n"))


def sampled_sequences(fact: DataFrame, dim: DataFrame, min_rows: int = 5, accounts: int = 3,
                      columns: Sequence[str] = ()) -> DataFrame:
    """All rows of a few accounts picked by a stable hash, in time order: a reading sample."""
    picked = (dim.where(F.col("txn_count") >= min_rows).select("account_id")
              .orderBy(F.md5("account_id"), "account_id").limit(accounts))
    rows = fact.join(picked, "account_id", "left_semi")
    return rows.select("account_id", "transaction_dt", "transaction_id", *columns).orderBy(
        "account_id", "transaction_dt", "transaction_id")
