"""Design numbers of an account-level experiment: clustering, power, covariate value, and the per-row cost rule."""

from __future__ import annotations

from collections.abc import Sequence
from statistics import NormalDist

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tollgate.functions.costs import DEFAULT_COSTS, CostModel
from tollgate.functions.scalars import mean_of, sample_variance

# Two-sided five percent and eighty percent power.
ALPHA, POWER = 0.05, 0.80


def clustering(rows: DataFrame, value: str, cluster: str = "account_id") -> DataFrame:
    """Intra-cluster correlation (one-way analysis of variance) and design effect of a row-level value.

    Rows collapse to count, sum and sum of squares per cluster; those to one row.
    """
    v = F.col(value).cast("decimal(18,6)")
    per = rows.groupBy(cluster).agg(F.count("*").alias("n"), F.sum(v).cast("double").alias("s"),
                                    F.sum(v * v).cast("double").alias("q"))
    n = F.col("n")
    t = per.agg(F.count("*").alias("k"), F.sum("n").alias("rows"), F.sum(n * n).cast("double").alias("nn"),
                F.sum("s").alias("s"), F.sum("q").alias("q"), F.sum(F.col("s") * F.col("s") / n).alias("b"))
    k, m = F.col("k").cast("double"), F.col("rows").cast("double")
    between = F.try_divide(F.col("b") - F.col("s") * F.col("s") / m, k - 1)
    within = F.try_divide(F.col("q") - F.col("b"), m - k)
    size = F.try_divide(m - F.col("nn") / m, k - 1)
    icc = F.try_divide(between - within, between + (size - 1) * within)
    return t.select(F.col("k").alias("clusters"), F.col("rows"), (m / k).alias("mean_size"), icc.alias("icc"),
                    (1 + (m / k - 1) * icc).alias("design_effect"))


def detectable_effect(accounts: DataFrame, value: str = "y_champ", alpha: float = ALPHA, power: float = POWER) -> DataFrame:
    """Error of the arm difference under an even split and the smallest effect found with the wanted power."""
    v = F.col(value).cast("decimal(18,6)")
    factor = NormalDist().inv_cdf(1 - alpha / 2) + NormalDist().inv_cdf(power)
    t = accounts.agg(F.count("*").alias("n"), F.sum(v).alias("s"), F.sum(v * v).alias("q"))
    t = t.select("n", F.sqrt(sample_variance(F.col("n"), F.col("s"), F.col("q"))).alias("sd"))
    se = 2 * F.col("sd") / F.sqrt("n")
    return t.select("n", "sd", se.alias("se"), (factor * se).alias("mde"), (factor * se * F.col("n")).alias("mde_total"))


def covariate_value(accounts: DataFrame, covariates: Sequence[str], value: str = "y_champ") -> DataFrame:
    """Correlation of each covariate with the outcome and the variance share it removes."""
    cells = F.array(*[F.struct(F.lit(c).alias("covariate"), F.col(c).cast("double").alias("x")) for c in covariates])
    long = accounts.select(F.col(value).cast("double").alias("y"), F.explode(cells).alias("c")).select("y", "c.*")
    out = long.groupBy("covariate").agg(F.corr("x", "y").alias("correlation"))
    r = F.col("correlation")
    return out.withColumns({"variance_reduction": r * r, "mde_factor": F.sqrt(1 - r * r)})


def explained_share(df: DataFrame, target: str, covariates: Sequence[str]) -> float:
    """R-squared of a linear fit, from one aggregate of cross products around the column means."""
    names = [*covariates, target]
    means = df.agg(*[F.avg(F.col(c).cast("double")).alias(f"m{i}") for i, c in enumerate(names)]).first()
    centred = [F.col(c).cast("double") - F.lit(means[f"m{i}"]) for i, c in enumerate(names)]
    k = len(names)
    sums = df.agg(*[F.sum(centred[i] * centred[j]).alias(f"c{i}_{j}") for i in range(k) for j in range(i, k)]).first()
    m = np.array([[sums[f"c{min(i, j)}_{max(i, j)}"] for j in range(k)] for i in range(k)])
    xy = m[:-1, -1]
    return float(xy @ np.linalg.pinv(m[:-1, :-1]) @ xy / m[-1, -1]) if m[-1, -1] > 0 else 0.0


def expected_cost_decline(score: str = "score", amount: str = "transaction_amt", costs: CostModel = DEFAULT_COSTS) -> Column:
    """Decline a row when that is the cheaper choice at its own score and amount."""
    p, amt = F.col(score).cast("double"), F.col(amount).cast("double")
    approve = p * (amt + float(costs.chargeback_fee))
    decline = (1 - p) * (amt * float(costs.margin_rate) + float(costs.false_decline)) + float(costs.review)
    return decline < approve


def rule_against_threshold(rows: DataFrame, threshold_cost: str, rule_cost: str) -> DataFrame:
    a, b = F.sum(rule_cost), F.sum(threshold_cost)
    return rows.agg(a.alias("rule_cost"), b.alias("threshold_cost"), (a - b).alias("difference"), F.count("*").alias("n"),
                    mean_of(a, F.count("*")).alias("rule_cost_per_row"))
