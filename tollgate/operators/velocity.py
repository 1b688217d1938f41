"""Strictly prior behavioural features per account.

A row sees only rows of its account with a strictly smaller timestamp, so rows sharing its second
are left out together with the row itself. A row without a time sees none and is seen by none; rows
without a key are one account. Two plans give the same columns:

* ``_by_window``: one range-framed window per account, a single exchange and sort.
* ``_by_slots``: for accounts too large for one task. Rows collapse to one tick per second, ticks
  are split into time slots, and every count becomes a difference of two running totals. No group
  holds more than the seconds of one slot, however many rows the account has.

``velocity`` measures account sizes and sends only the large ones down the second plan.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tollgate.functions.scalars import mean_of, ratio_or_null
from tollgate.operators.skew import join_keys
from tollgate.session import pinned

# Look-back horizons in seconds.
HORIZONS = {"1h": 3_600, "24h": 86_400, "7d": 604_800}
HOT_ROWS = 20_000
SLOT_SECONDS = 3_600


def feature_names(horizons: Mapping[str, int] = HORIZONS) -> list[str]:
    return ["prior_txn_count", "prior_amt_sum", "prior_amt_mean",
            *[f"txn_count_{name}" for name in horizons],
            "prev_transaction_dt", "amt_to_prior_mean_ratio", "seconds_since_prev_txn"]


def exact(df: DataFrame, amt: str) -> Column:
    """Floating amounts as decimals, so that a sum does not depend on the order of its rows."""
    kind = df.schema[amt].dataType
    return F.col(amt).cast("decimal(28,9)") if isinstance(kind, (T.DoubleType, T.FloatType)) else F.col(amt)


def _by_window(df: DataFrame, key: str, ts: str, amt: str, horizons: Mapping[str, int]) -> DataFrame:
    w = Window.partitionBy(key).orderBy(ts)
    prior = w.rangeBetween(Window.unboundedPreceding, -1)
    timed = F.col(ts).isNotNull()
    cols = {
        "prior_txn_count": F.when(timed, F.count(ts).over(prior)).otherwise(0),
        "prior_amt_sum": F.when(timed, F.sum(F.when(timed, exact(df, amt))).over(prior)).cast(_prior_sum_type(df, amt)),
        "prev_transaction_dt": F.when(timed, F.max(ts).over(prior)),
    }
    cols.update({f"txn_count_{name}": F.when(timed, F.count(ts).over(w.rangeBetween(-width, -1))).otherwise(0)
                 for name, width in horizons.items()})
    return df.withColumns(cols)


def _by_slots(df: DataFrame, key: str, ts: str, amt: str, horizons: Mapping[str, int],
              slot_seconds: int) -> DataFrame:
    # A null key is an account like any other, under a name that joins; rows without a time take no part.
    given, key, named = df, "__account", F.coalesce(F.concat(F.lit("="), F.col(key).cast("string")), F.lit(""))
    df = df.withColumn(key, named)
    ticks = df.where(F.col(ts).isNotNull()).groupBy(key, F.col(ts).alias("__src")).agg(
        F.count("*").alias("__n"), F.sum(exact(df, amt)).alias("__s"))
    # A tick itself, plus one empty probe at the start of each look-back horizon.
    nothing = F.lit(None).cast(ticks.schema["__s"].dataType)
    marks = [F.struct(F.lit(0).alias("w"), F.col("__src").alias("at"), F.col("__n").alias("n"),
                      F.col("__s").alias("s"), F.col("__src").alias("seen"))]
    marks += [F.struct(F.lit(width).alias("w"), (F.col("__src") - width).alias("at"),
                       F.lit(0).cast("long").alias("n"), nothing.alias("s"),
                       F.lit(None).cast("long").alias("seen"))
              for width in horizons.values()]
    spread = (ticks.select(key, "__src", F.explode(F.array(*marks)).alias("m"))
              .select(key, "__src", "m.*")
              .withColumn("slot", F.floor(F.col("at") / slot_seconds)))

    per_slot = spread.groupBy(key, "slot").agg(
        F.sum("n").alias("n"), F.sum("s").alias("s"), F.max("seen").alias("seen"))
    earlier = Window.partitionBy(key).orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_slot.select(key, "slot", F.sum("n").over(earlier).alias("__on"),
                              F.sum("s").over(earlier).alias("__os"),
                              F.max("seen").over(earlier).alias("__oseen"))

    local = Window.partitionBy(key, "slot").orderBy("at").rangeBetween(Window.unboundedPreceding, -1)
    placed = spread.withColumns({"__ln": F.sum("n").over(local), "__ls": F.sum("s").over(local),
                                 "__lseen": F.max("seen").over(local)}).join(offsets, [key, "slot"])
    count = F.coalesce("__ln", F.lit(0)) + F.coalesce("__on", F.lit(0))
    zero = F.lit(0).cast(ticks.schema["__s"].dataType)
    total = F.when(F.coalesce("__ls", "__os").isNotNull(),
                   F.coalesce("__ls", zero) + F.coalesce("__os", zero))
    seen = F.coalesce("__lseen", "__oseen")
    here = F.col("w") == 0
    back = placed.groupBy(key, "__src").agg(
        F.max(F.when(here, count)).alias("prior_txn_count"),
        F.max(F.when(here, total)).alias("prior_amt_sum"),
        F.max(F.when(here, seen)).alias("prev_transaction_dt"),
        *[F.max(F.when(F.col("w") == width, count)).alias(f"__from_{name}")
          for name, width in horizons.items()])
    wide = back.select(
        key, F.col("__src").alias(ts), "prior_txn_count",
        F.col("prior_amt_sum").cast(_prior_sum_type(df, amt)).alias("prior_amt_sum"),
        "prev_transaction_dt",
        *[(F.col("prior_txn_count") - F.col(f"__from_{name}")).alias(f"txn_count_{name}")
          for name in horizons])
    counts = ["prior_txn_count", *[f"txn_count_{name}" for name in horizons]]
    return df.join(wide, [key, ts], "left").select(*given.columns, *[
        F.coalesce(c, F.lit(0)).alias(c) if c in counts else c for c in wide.columns if c not in (key, ts)])


def _prior_sum_type(df: DataFrame, amt: str):
    return df.select(F.sum(amt).alias("s")).schema["s"].dataType


def velocity(df: DataFrame, key: str = "account_id", ts: str = "transaction_dt",
             amt: str = "transaction_amt", horizons: Mapping[str, int] = HORIZONS,
             hot_rows: int = HOT_ROWS, slot_seconds: int = SLOT_SECONDS) -> DataFrame:
    """Add the prior count, sum, mean, previous time, look-back counts, ratio and gap columns."""
    large = df.where(F.col(key).isNotNull()).groupBy(key).count().where(F.col("count") > hot_rows).select(key)
    if large.isEmpty():
        out = _by_window(df, key, ts, amt, horizons)
    else:
        large = pinned(large)
        out = _by_window(join_keys(df, large, key, "left_anti"), key, ts, amt, horizons).unionByName(
            _by_slots(join_keys(df, large, key, "left_semi"), key, ts, amt, horizons, slot_seconds))
    return with_derived(out, ts, amt).select(*df.columns, *feature_names(horizons))


def velocity_by_slots(df: DataFrame, key: str = "account_id", ts: str = "transaction_dt",
                      amt: str = "transaction_amt", horizons: Mapping[str, int] = HORIZONS,
                      slot_seconds: int = SLOT_SECONDS) -> DataFrame:
    """The slot plan for every account: the independent recomputation used as a check."""
    out = with_derived(_by_slots(df, key, ts, amt, horizons, slot_seconds), ts, amt)
    return out.select(*df.columns, *feature_names(horizons))


def with_derived(df: DataFrame, ts: str, amt: str) -> DataFrame:
    mean = F.when(F.col("prior_txn_count") > 0, mean_of(F.col("prior_amt_sum"), F.col("prior_txn_count")))
    return df.withColumn("prior_amt_mean", mean).withColumns({
        "amt_to_prior_mean_ratio": ratio_or_null(F.col(amt), F.col("prior_amt_mean")),
        "seconds_since_prev_txn": F.col(ts) - F.col("prev_transaction_dt"),
    })
