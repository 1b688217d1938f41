"""All quality checks of a mart in two passes: one that writes it anyway, and one grouped aggregate.

Row checks are conditions on one row. They are counted by ``DataFrame.observe`` while the mart is written, so they read nothing.
Key checks compare rows of one key: keys that occur twice, keys without a partner, a first row that must satisfy a condition. All of
them share one aggregate over (check, key) of the written mart, combined before its exchange, so a key with a third of all rows
sends one line per task. Offending rows are read back only for a check that failed.

The counts are taken in the tasks that write files, which are counted once even if they are repeated. A condition that is null for a
row does not offend; an empty mart passes every row and key check and fails a count other than 0. Check names must differ.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F


@dataclass(frozen=True)
class RowCheck:
    """Rows for which ``offends`` is true."""

    name: str
    offends: Column


@dataclass(frozen=True)
class KeyCheck:
    """Keys with more than ``most`` rows (None: any number), or whose first row by ``order`` offends. Null keys are left out."""

    name: str
    key: Column
    most: int | None = 1
    order: Sequence[Column] = ()
    offends: Column | None = None


@dataclass(frozen=True)
class CountCheck:
    """A number of rows other than ``expected``; the difference is the number of offenders."""

    name: str
    expected: int


Check = RowCheck | KeyCheck | CountCheck


def not_null(column: str) -> RowCheck:
    return RowCheck(f"not_null:{column}", F.col(column).isNull())


def accepted(column: str, allowed: Sequence) -> RowCheck:
    return RowCheck(f"accepted:{column}", ~F.col(column).isin(list(allowed)))


def unique(column: str) -> KeyCheck:
    return KeyCheck(f"unique:{column}", F.col(column))


def _lines(mart: DataFrame, checks: Sequence[KeyCheck]) -> DataFrame:
    """(check, key, bad) of every row and key check; ``bad`` leads with the order, so that its minimum is that of the first row."""
    orders = max(len(c.order) for c in checks)
    lines = []
    for i, c in enumerate(checks):
        place = [o.cast("long") for o in c.order] + [F.lit(None).cast("long")] * (orders - len(c.order))
        offends = F.coalesce(c.offends, F.lit(False)) if c.offends is not None else F.lit(False)
        lines.append(F.struct(F.lit(i).alias("check"), c.key.cast("string").alias("key"),
                              F.struct(*[p.alias(f"o{j}") for j, p in enumerate(place)], offends.alias("bad")).alias("first")))
    return mart.select(F.explode(F.array(*lines)).alias("line")).select("line.*").where("key is not null")


def broken_keys(mart: DataFrame, checks: Sequence[KeyCheck]) -> DataFrame:
    """check (its position) and key of every key that breaks a check; one aggregate for all checks."""
    most = F.create_map(*[x for i, c in enumerate(checks) for x in (F.lit(i), F.lit(c.most).cast("long"))])
    sums = _lines(mart, checks).groupBy("check", "key").agg(F.count(F.lit(1)).alias("n"), F.min("first").alias("first"))
    return sums.where(F.coalesce(F.col("n") > most[F.col("check")], F.lit(False)) | F.col("first.bad")).select("check", "key")


def audited_write(df: DataFrame, path: str, checks: Sequence[Check], partition_by: Sequence[str] = ()) -> dict[str, int]:
    """Write ``df`` as Parquet and return the number of offenders of every check, in the given order."""
    if len({c.name for c in checks}) < len(checks):
        raise ValueError("check names must differ")
    rows = [c for c in checks if isinstance(c, RowCheck)]
    keys = [c for c in checks if isinstance(c, KeyCheck)]
    seen = Observation()
    counted = df.observe(seen, F.count(F.lit(1)).alias("rows"), *[
        F.count(F.when(c.offends, 1)).alias(f"c{i}") for i, c in enumerate(rows)])
    writer = counted.write.mode("overwrite")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
    found = seen.get
    offenders = {c.name: int(found[f"c{i}"]) for i, c in enumerate(rows)}
    if keys:
        back = df.sparkSession.read.schema(df.schema).parquet(path)
        sums = dict(broken_keys(back, keys).groupBy("check").count().collect())  # one line per check
        offenders.update({c.name: int(sums.get(i, 0)) for i, c in enumerate(keys)})
    offenders.update({c.name: abs(int(found["rows"]) - c.expected) for c in checks if isinstance(c, CountCheck)})
    return {c.name: offenders[c.name] for c in checks}


def offending_rows(mart: DataFrame, check: RowCheck | KeyCheck) -> DataFrame:
    """The rows, or keys, that break one check; for checks whose count is not 0."""
    if isinstance(check, RowCheck):
        return mart.where(check.offends)
    return broken_keys(mart, [check]).select("key")


def fact_checks(expected_rows: int, tiers: Sequence[str]) -> list[Check]:
    """The checks of the fact table with its look-back features."""
    c = F.col
    leaks = (c("prior_amt_sum").isNotNull() | (c("prior_txn_count") != 0) | (c("txn_count_1h") != 0)
             | (c("txn_count_24h") != 0) | (c("txn_count_7d") != 0))
    return [
        unique("transaction_id"),
        *[not_null(x) for x in ("transaction_id", "transaction_dt", "transaction_amt", "account_id", "is_fraud", "txn_day")],
        accepted("is_fraud", [0, 1]), accepted("account_key_tier", tiers),
        CountCheck("row_count", expected_rows),
        KeyCheck("no_leakage", c("account_id"), None, [c("transaction_dt"), c("transaction_id")], leaks),
        RowCheck("day_of_time", c("txn_day") != F.floor(c("transaction_dt") / 86400)),
        RowCheck("windows_nest", (c("txn_count_1h") > c("txn_count_24h")) | (c("txn_count_24h") > c("txn_count_7d"))
                 | (c("txn_count_7d") > c("prior_txn_count"))),
        RowCheck("past_only", c("prev_transaction_dt") >= c("transaction_dt")),
        RowCheck("sum_with_count", c("prior_amt_sum").isNull() != (c("prior_txn_count") == 0)),
        RowCheck("degraded_is_not_full", c("is_degraded_key") == (c("account_key_tier") == tiers[0])),
        RowCheck("positive_amount", c("transaction_amt") <= 0),
    ]
