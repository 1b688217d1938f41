"""Feature encoders fitted on a subset of rows. Lookups are broadcast only at a checked size."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tollgate.operators.ordering import exact_quantiles, global_rank
from tollgate.operators.profile import level_counts
from tollgate.operators.skew import join_keys
from tollgate.session import pinned

# Level limits of count encoding and of one-hot columns.
MIN_COUNTED_LEVELS = 20
MAX_ONE_HOT_LEVELS = 30


def category_codes(df: DataFrame, column: str, out: str | None = None) -> DataFrame:
    """Integer code of each level in sort order from 1; missing is 0. Fitted on all rows."""
    out = out or f"{column}_code"
    levels = df.where(F.col(column).isNotNull()).select(F.col(column).alias("__level")).distinct()
    codes = pinned(global_rank(levels, [F.col("__level")], out).select(F.col("__level").alias(column), out))
    joined = join_keys(df, codes, column)
    return joined.withColumn(out, F.coalesce(out, F.lit(0)).cast("int"))


def has_levels(df: DataFrame, column: str, at_least: int) -> bool:
    """True when ``column`` has that many non-null levels; stops counting there."""
    return df.where(F.col(column).isNotNull()).select(column).distinct().limit(at_least).count() >= at_least


def count_encode(df: DataFrame, columns: Sequence[str], fit: Column, min_levels: int = MIN_COUNTED_LEVELS,
                 suffix: str = "_cnt") -> DataFrame:
    """Frequency of a row's level among the fitted rows, for columns with enough levels there.

    A level not seen while fitting, or a null, has no count.
    """
    past = df.where(fit)
    for c in columns:
        if has_levels(past, c, min_levels):
            df = join_keys(df, level_counts(past, c).select(F.col("level").alias(c), F.col("n").alias(f"{c}{suffix}")), c)
    return df


def one_hot(df: DataFrame, column: str, fit: Column | None = None, max_levels: int = MAX_ONE_HOT_LEVELS,
            keep: bool = False) -> tuple[DataFrame, list[str]]:
    """0/1 column per fitted level, one for levels met later and one for null.

    A column with too many fitted levels is counted instead. Without ``fit`` all rows are fitted, so no level comes later.
    """
    fitted = df if fit is None else df.where(fit)
    if has_levels(fitted, column, max_levels + 1):
        counts = level_counts(fitted, column).select(F.col("level").alias(column), F.col("n").alias(f"{column}_cnt"))
        out = join_keys(df, counts, column)
        return (out if keep else out.drop(column)), [f"{column}_cnt"]
    levels = sorted(r[0] for r in fitted.where(F.col(column).isNotNull()).select(F.col(column).cast("string"))
                    .distinct().collect())  # at most max_levels, as just checked
    cols: dict[str, Column] = {f"{column}_{v}": F.coalesce((F.col(column).cast("string") == v).cast("double"), F.lit(0.0))
                               for v in levels}
    if fit is not None:
        later = F.col(column).isNotNull() & ~F.col(column).cast("string").isin(levels)
        cols[f"{column}_other"] = later.cast("double")
    cols[f"{column}_null"] = F.col(column).isNull().cast("double")
    out = df.withColumns(cols)
    return (out if keep else out.drop(column)), list(cols)


def medians(df: DataFrame, columns: Sequence[str], fit: Column) -> dict[str, float | None]:
    """Exact medians of many columns in one ordered pass over (column, value) cells."""
    past = df.where(fit).select(*[F.col(c).try_cast("double").alias(c) for c in columns])
    long = past.unpivot([], list(columns), "feature", "value")
    found = {r["feature"]: r["quantile"] for r in exact_quantiles(long, "value", [0.5], ["feature"]).collect()}
    return {c: found.get(c) for c in columns}


def median_impute(df: DataFrame, columns: Sequence[str], fit: Column) -> DataFrame:
    fills = medians(df, columns, fit)
    return df.withColumns({c: F.coalesce(F.col(c).try_cast("double"), F.lit(fills[c]).cast("double")) for c in columns})


def standardise(df: DataFrame, columns: Sequence[str], fit: Column | None = None, population: bool = False,
                out: Mapping[str, str] | None = None) -> DataFrame:
    """Centre and scale by fitted mean and deviation; a constant column is only centred, nulls go to 0."""
    sd = F.stddev_pop if population else F.stddev_samp
    fitted = df if fit is None else df.where(fit)
    stats = fitted.agg(*[F.avg(F.col(c).cast("double")).alias(f"m_{i}") for i, c in enumerate(columns)],
                       *[sd(F.col(c).cast("double")).alias(f"s_{i}") for i, c in enumerate(columns)]).first()
    out = out or {}
    cols = {}
    for i, c in enumerate(columns):
        mean, scale = stats[f"m_{i}"], stats[f"s_{i}"] or 1.0
        cols[out.get(c, c)] = F.coalesce((F.col(c).cast("double") - F.lit(mean)) / F.lit(scale), F.lit(0.0))
    return df.withColumns(cols)
