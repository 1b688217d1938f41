"""Small scalar expressions shared by the feature, profile and evaluation jobs."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

SECONDS_PER_DAY = 86_400

# The production time split and the columns that never reach a model.
SPLIT_DAYS = (110, 130, 150)
SPLIT_NAMES = ("train", "early_stop", "calibration", "test")
NEVER_FEATURES = ("transaction_id", "account_id", "txn_day", "transaction_dt", "is_fraud",
                  "prev_transaction_dt")
# Day-offset counters that can be re-based on the transaction day; the ninth is a fraction of a day.
DAY_OFFSETS = tuple(f"d{i}" for i in range(1, 16) if i != 9)


def day_of(seconds: str = "transaction_dt") -> Column:
    return F.expr(f"{seconds} div {SECONDS_PER_DAY}")


def hour_of(seconds: str = "transaction_dt") -> Column:
    """Hour within the relative day."""
    return F.expr(f"cast(({seconds} % {SECONDS_PER_DAY}) div 3600 as int)")


def weekday_of(day: str = "txn_day") -> Column:
    """Position in a seven-day cycle; which one is Monday is not known."""
    return (F.col(day) % 7).cast("int")


def log_amount(amount: str = "transaction_amt") -> Column:
    return F.log1p(F.col(amount).cast("double"))


def ratio_or_null(top: Column, bottom: Column) -> Column:
    """Division that is null for a null or zero denominator."""
    return F.try_divide(top.cast("double"), bottom.cast("double"))


def size_bucket(count: str) -> Column:
    n = F.col(count)
    return (F.when(n == 1, "1").when(n.between(2, 4), "2-4").when(n.between(5, 9), "5-9")
            .when(n.between(10, 49), "10-49").otherwise("50+"))


def time_split(day: str = "txn_day", edges: Sequence[int] = SPLIT_DAYS,
               names: Sequence[str] = SPLIT_NAMES) -> Column:
    """Disjoint half-open windows: below the first edge, between edges, from the last edge on."""
    d = F.col(day)
    out = F.when(d < edges[0], names[0])
    for edge, name in zip(edges[1:], names[1:-1]):
        out = out.when(d < edge, name)
    return out.otherwise(names[-1])


def rebased_offsets(columns: Sequence[str] = DAY_OFFSETS, day: str = "txn_day",
                    suffix: str = "_norm") -> Mapping[str, Column]:
    """``txn_day - d_i`` per counter. An empty suffix replaces the counter instead of adding one."""
    return {f"{c}{suffix}": F.col(day) - F.col(c).try_cast("double") for c in columns}


def zero_filled(columns: Sequence[str], indicator: str, witness: str) -> Mapping[str, Column]:
    """Zero-fill ``columns`` and keep, in ``indicator``, whether ``witness`` was there before."""
    out = {indicator: F.col(witness).isNotNull().cast("int")}
    out.update({c: F.coalesce(F.col(c), F.lit(0)) for c in columns})
    return out


def feature_columns(columns: Sequence[str], drop_pattern: str | None = None) -> list[str]:
    """Model inputs of a schema: everything but ids, clocks and the label."""
    import re
    banned = set(NEVER_FEATURES)
    kept = [c for c in columns if c not in banned]
    if drop_pattern:
        kept = [c for c in kept if not re.fullmatch(drop_pattern, c)]
    return kept


def leaked_columns(features: Sequence[str]) -> list[str]:
    """Identifier or clock columns that slipped into a feature list; must be empty."""
    return sorted(set(features) & set(NEVER_FEATURES))


def mean_of(total: Column, count: Column) -> Column:
    """Mean from an exact sum and a count, so that engines agree on the last digit."""
    return F.try_divide(total.cast("double"), count.cast("double"))


def sample_variance(count: Column, total: Column, squares: Column) -> Column:
    """Sample variance from (usually exact decimal) power sums; null below two rows."""
    n, s, q = count.cast("double"), total.cast("double"), squares.cast("double")
    return F.when(n > 1, F.greatest(q - s * s / n, F.lit(0.0)) / (n - 1))
