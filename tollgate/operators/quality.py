"""Data-quality assertions. A check returns the offending rows; no row means it passed."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tollgate.operators.velocity import velocity_by_slots


def duplicates(df: DataFrame, key: str) -> DataFrame:
    return df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("n")).where("n > 1")


def nulls(df: DataFrame, column: str) -> DataFrame:
    return df.where(F.col(column).isNull())


def unexpected_values(df: DataFrame, column: str, allowed: Sequence) -> DataFrame:
    """Values outside the list with their counts; null passes."""
    value = F.col(column)
    return (df.where(value.isNotNull() & ~value.isin(list(allowed)))
            .groupBy(value.alias("value")).agg(F.count("*").alias("n")))


def wrong_row_count(df: DataFrame, expected: int) -> DataFrame:
    return df.agg(F.lit(expected).cast("long").alias("expected_rows"), F.count("*").alias("actual_rows")).where(
        "expected_rows <> actual_rows")


def leaking_first_rows(fact: DataFrame) -> DataFrame:
    """First row of each account with any look-back value: the frame let the present in.

    The rank filter is applied before the exchange as well, so a huge account sends one row per task.
    """
    order = Window.partitionBy("account_id").orderBy("transaction_dt", "transaction_id")
    first = fact.withColumn("rn", F.row_number().over(order)).where("rn = 1")
    counts = ["prior_txn_count", "txn_count_1h", "txn_count_24h", "txn_count_7d"]
    bad: Column = F.col("prior_amt_sum").isNotNull()
    for c in counts:
        bad = bad | (F.col(c) != 0)
    return first.where(bad).select("transaction_id", *counts, "prior_amt_sum", "rn")


def window_mismatches(fact: DataFrame) -> DataFrame:
    """Rows whose look-back features differ from an independent recomputation, or that only one side has.

    Uses differences of running totals over time slots instead of a range frame, for every account.
    """
    checked = ["prior_txn_count", "prior_amt_sum", "txn_count_1h", "txn_count_24h", "txn_count_7d",
               "prev_transaction_dt"]
    again = velocity_by_slots(fact.select("transaction_id", "account_id", "transaction_dt", "transaction_amt"))
    other = again.select("transaction_id", *[F.col(c).alias(f"expected_{c}") for c in checked])
    differs: Column = F.lit(False)
    for c in checked:
        differs = differs | ~F.col(c).eqNullSafe(F.col(f"expected_{c}"))
    mine = fact.select("transaction_id", *checked).withColumn("__here", F.lit(True))
    both = mine.join(other.withColumn("__there", F.lit(True)), "transaction_id", "full")
    alone = F.col("__here").isNull() | F.col("__there").isNull()
    return both.where(alone | differs).drop("__here", "__there")


def reconcile(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Ids missing on either side, counted."""
    def missing(a: DataFrame, b: DataFrame, direction: str) -> DataFrame:
        return a.select(key).join(b.select(key), key, "left_anti").agg(F.count("*").alias("n")).select(
            F.lit(direction).alias("direction"), "n")
    return missing(left, right, "left_only").unionByName(missing(right, left, "right_only"))


def out_of_tolerance(measured: DataFrame, expected: Mapping[str, tuple[float, float]]) -> DataFrame:
    """Measures of a one-row frame that miss ``(target, tolerance)``; a null measure misses too."""
    rows = F.array(*[F.struct(F.lit(name).alias("measure"), F.col(name).cast("double").alias("actual"),
                              F.lit(float(target)).alias("expected"), F.lit(float(tol)).alias("tolerance"))
                     for name, (target, tol) in expected.items()])
    long = measured.select(F.explode(rows).alias("r")).select("r.*")
    return long.where(F.col("actual").isNull() | (F.abs(F.col("actual") - F.col("expected")) >= F.col("tolerance")))
