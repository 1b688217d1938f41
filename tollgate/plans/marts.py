"""The fact table: keys, look-back features, identity, and its day-by-day maintenance."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tollgate.functions.keys import account_key, is_degraded
from tollgate.functions.scalars import (DAY_OFFSETS, hour_of, log_amount, rebased_offsets, weekday_of)
from tollgate.operators.skew import join_keys
from tollgate.operators.velocity import HORIZONS, exact, velocity, with_derived
from tollgate.session import pinned
from tollgate.sources.tables import packed, read_if_there, write_parquet

DAY_SECONDS = 86_400
KeyFunction = Callable[[], tuple[Column, Column]]


def with_key(txn: DataFrame, key: KeyFunction = account_key) -> DataFrame:
    """Account id and tier as row expressions: the 1:1 join to a key table is not needed."""
    account, tier = key()
    return txn.withColumns({"account_id": account, "account_key_tier": tier, "is_degraded_key": is_degraded(tier)})


def with_identity(txn: DataFrame, identity: DataFrame | None) -> DataFrame:
    """Optional 1:0..1 side table; ``has_identity`` tells a match from a row of nulls."""
    if identity is None:
        return txn.withColumn("has_identity", F.lit(False))
    extra = [c for c in identity.columns if c != "transaction_id"]
    side = identity.select("transaction_id", F.lit(True).alias("__matched"), *extra)
    joined = txn.join(side, "transaction_id", "left")
    return joined.select(*txn.columns, F.col("__matched").isNotNull().alias("has_identity"), *extra)


def build_fact(txn: DataFrame, identity: DataFrame | None = None, key: KeyFunction = account_key,
               horizons: Mapping[str, int] = HORIZONS) -> DataFrame:
    """One row per transaction with every feature block, passthrough columns included.

    One exchange on the account carries all look-back frames; each later block is one projection.
    """
    return with_blocks(velocity(with_key(txn, key), horizons=horizons), identity)


def with_blocks(looked_back: DataFrame, identity: DataFrame | None = None) -> DataFrame:
    """The blocks of a fact row that need no other row, and the side table."""
    derived = {"log_amount": log_amount(), "txn_hour": hour_of(), "txn_dow": weekday_of()}
    derived.update(rebased_offsets([c for c in DAY_OFFSETS if c in looked_back.columns]))
    return with_identity(looked_back.withColumns(derived), identity)


def tail_days(horizons: Mapping[str, int] = HORIZONS) -> int:
    """Whole days before a new day that a look-back horizon can reach."""
    return -(-max(horizons.values()) // DAY_SECONDS)


def history_sums(rows: DataFrame) -> DataFrame:
    """Count, sum and last time per account of keyed rows: what a later row needs of rows beyond every horizon."""
    return rows.where(F.col("transaction_dt").isNotNull()).groupBy("account_id").agg(
        F.count("*").alias("base_count"), F.sum(exact(rows, "transaction_amt")).alias("base_sum"),
        F.max("transaction_dt").alias("base_last"))


def day_marks(txn: DataFrame, through: int) -> DataFrame:
    """Rows and a sum of row hashes per day up to ``through``: tells whether late rows changed a day."""
    row = F.xxhash64("transaction_id", "transaction_dt", "transaction_amt").cast("decimal(38,0)")
    return txn.where(F.col("txn_day") <= through).groupBy("txn_day").agg(
        F.count("*").alias("n"), F.sum(row).cast("string").alias("mark"))


def account_state(txn: DataFrame, through: int, path: str, key: KeyFunction = account_key) -> DataFrame:
    """`history_sums` of all days up to ``through``, carried on from the state table of an earlier load.

    The table has two slots, the newer and the older state; a state is valid if the days it covers still have
    the rows it has seen. Only the days after it are read. Without a valid state all days are summed up.
    """
    spark = txn.sparkSession
    # One row per loaded day.
    marks = {r["txn_day"]: (r["n"], r["mark"]) for r in day_marks(txn, through).collect()}
    slots = {}
    for slot in (0, 1):
        days = read_if_there(spark, f"{path}/days-{slot}")
        if days is not None:
            rows = days.collect()  # one per day, and one without a day for the state itself
            slots[slot] = (rows[0]["through"], {r["txn_day"]: (r["n"], r["mark"]) for r in rows if r["txn_day"] is not None})
    valid = [(end, slot) for slot, (end, seen) in slots.items()
             if end <= through and seen == {d: m for d, m in marks.items() if d <= end}
             # A load that ended between the two writes leaves sums that go through another day.
             and spark.read.parquet(f"{path}/accounts-{slot}").agg(F.max("through").alias("d")).first()["d"] in (end, None)]
    keyed = with_key(txn, key)
    if valid:
        end, slot = max(valid)
        stored = spark.read.parquet(f"{path}/accounts-{slot}").drop("through")
        if end == through:
            return stored
        newer = history_sums(keyed.where(F.col("txn_day").between(end + 1, through)))
        state = stored.unionByName(newer).groupBy("account_id").agg(
            F.sum("base_count").alias("base_count"), F.sum("base_sum").cast(stored.schema["base_sum"].dataType).alias("base_sum"),
            F.max("base_last").alias("base_last"))
        target = 1 - slot
    else:
        state = history_sums(keyed.where(F.col("txn_day") <= through))
        target = min(slots, key=lambda x: slots[x][0]) if len(slots) == 2 else len(slots)
    write_parquet(state.withColumn("through", F.lit(through).cast("bigint")), f"{path}/accounts-{target}")
    own = spark.range(1).select(F.lit(None).cast("bigint").alias("txn_day"), F.lit(None).cast("bigint").alias("n"), F.lit(None).cast("string").alias("mark"))
    days = day_marks(txn, through).unionByName(own).withColumn("through", F.lit(through).cast("bigint"))
    write_parquet(days.coalesce(1), f"{path}/days-{target}")
    return spark.read.parquet(f"{path}/accounts-{target}").drop("through")


def rebuilt_rows(txn: DataFrame, after_day: int, identity: DataFrame | None = None, key: KeyFunction = account_key,
                 state_path: str | None = None, horizons: Mapping[str, int] = HORIZONS) -> DataFrame:
    """Fact rows of days after ``after_day``, with features over the full history.

    The window reads the new days and the days that a horizon can reach, of the accounts that have new rows. All
    that lies before comes as one row per account from the state table.
    """
    keyed = with_key(txn, key)
    bound = after_day - tail_days(horizons)
    touched = pinned(keyed.where(F.col("txn_day") > after_day).select("account_id").distinct())
    recent = join_keys(keyed.where(F.col("txn_day") > bound), touched, "account_id", "left_semi")
    looked_back = velocity(recent, horizons=horizons).where(F.col("txn_day") > after_day)
    state = account_state(txn, bound, state_path, key) if state_path else history_sums(keyed.where(F.col("txn_day") <= bound))
    # A null key is an account, too.
    named = F.coalesce(F.concat(F.lit("="), F.col("account_id").cast("string")), F.lit(""))
    joined = join_keys(looked_back.withColumn("__account", named), state.withColumn("__account", named).drop("account_id"), "__account")
    timed = F.col("transaction_dt").isNotNull()
    recent_sum = F.col("prior_amt_sum").cast(state.schema["base_sum"].dataType)
    total = F.when(timed, F.coalesce(recent_sum + F.col("base_sum"), recent_sum, F.col("base_sum")))
    whole = joined.withColumns({
        "prior_txn_count": F.col("prior_txn_count") + F.when(timed, F.coalesce("base_count", F.lit(0))).otherwise(0),
        "prior_amt_sum": total.cast(looked_back.schema["prior_amt_sum"].dataType),
        "prev_transaction_dt": F.coalesce("prev_transaction_dt", F.when(timed, F.col("base_last")))})
    rows = with_derived(whole, "transaction_dt", "transaction_amt").select(*looked_back.columns)
    return with_blocks(rows, identity)


def loaded_through(spark, path: str) -> int:
    """Latest day in the fact table, -1 before the first load."""
    stored = read_if_there(spark, path)
    day = stored.agg(F.max("txn_day").alias("d")).first()["d"] if stored is not None else None
    return -1 if day is None else int(day)


def load_new_days(txn: DataFrame, path: str, identity: DataFrame | None = None, key: KeyFunction = account_key,
                  reprocess_from: int | None = None) -> int:
    """Append the days the fact table does not have yet; returns the day it was loaded through.

    Rows without a day take no part. A late row of a loaded day is not picked up unless ``reprocess_from`` reopens that day. Each
    day is one partition and is replaced as a whole, so a re-run or a retry changes nothing. A new
    row whose id is already stored under an older day replaces the stored row.
    """
    spark = txn.sparkSession
    through = loaded_through(spark, path)
    start = through if reprocess_from is None else min(through, reprocess_from - 1)
    new = txn.where(F.col("txn_day") > start)
    newest = new.agg(F.max("txn_day").alias("d")).first()["d"]
    if newest is None:
        return through
    if through < 0:
        write_parquet(build_fact(txn.where(F.col("txn_day").isNotNull()), identity, key), path, ["txn_day"])
        return int(newest)
    batch = rebuilt_rows(txn, start, identity, key, f"{path.rstrip('/')}_state")
    stored = spark.read.parquet(path)
    # Partition order of columns: the day comes last when read back.
    moved = stored.where(F.col("txn_day") <= start).join(
        new.select("transaction_id"), "transaction_id", "left_semi").select("txn_day").distinct()
    days = [r["txn_day"] for r in moved.collect()]  # at most one entry per loaded day
    if days:
        kept = stored.where(F.col("txn_day").isin(days) & (F.col("txn_day") <= start)).join(
            new.select("transaction_id"), "transaction_id", "left_anti")
        batch = pinned(batch.unionByName(kept, allowMissingColumns=True))
    (packed(batch, ["txn_day"]).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .option("compression", "snappy").partitionBy("txn_day").parquet(path))
    return max(int(newest), through)


def read_fact(spark, path: str, columns: Sequence[str] | None = None) -> DataFrame:
    """The fact table with schema evolution: columns added by later days are null in earlier ones."""
    df = spark.read.option("mergeSchema", True).parquet(path)
    return df.select(*columns) if columns else df
