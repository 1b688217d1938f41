"""Analysis of a two-arm policy experiment on an account frame.

Each estimate is one or two aggregates. Currency stays in decimals until the last step, so sums do
not depend on the order tasks finish in.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tollgate.functions.costs import decision_cost
from tollgate.functions.hashing import arm_of
from tollgate.functions.scalars import mean_of, ratio_or_null, sample_variance, zero_filled
from tollgate.operators.ordering import equal_count_bin, exact_quantiles, global_rank

# Fixed values of the registered analysis.
SALT = "stage2-v1"
CHAMPION_THRESHOLD, CHALLENGER_THRESHOLD = 0.5, 0.1160
GUARDRAIL_CEILING = 0.080
Z_TWO_SIDED, Z_ONE_SIDED = 1.96, 1.645
SRM_HALT_P = 0.001
RISK_CUTOFFS = (0.0, 0.005, 0.01, 0.02, 0.03, 0.05, 0.08, 0.12, 0.20, 1.01)
COVARIATES = ("pre_value", "pre_n", "pre_fraud", "pre_mean_amt", "has_pre_period")


@F.pandas_udf(T.DoubleType())
def upper_tail(z: pd.Series) -> pd.Series:
    """P(N(0,1) > z). Only ever applied to result rows."""
    return z.map(lambda v: None if v is None or math.isnan(v) else 0.5 * math.erfc(v / math.sqrt(2.0)))


def with_policies(rows: DataFrame, score: str = "score", champion: float = CHAMPION_THRESHOLD,
                  challenger: float = CHALLENGER_THRESHOLD) -> DataFrame:
    """Decision and cost of each row under both policies."""
    label, amt = F.col("is_fraud"), F.col("transaction_amt")
    champ, chal = F.col(score) >= F.lit(champion), F.col(score) >= F.lit(challenger)
    return rows.withColumns({"dec_champ": champ, "dec_chal": chal,
                             "c_champ": decision_cost(champ, label, amt),
                             "c_chal": decision_cost(chal, label, amt)})


def account_frame(rows: DataFrame, history: DataFrame, salt: str = SALT, score: str = "score") -> DataFrame:
    """One row per account of the replay: both potential costs, the arm, and pre-period covariates.

    ``rows`` are the replayed rows with both policies priced, ``history`` the pre-period rows.
    """
    n = F.count("*")
    acc = rows.groupBy("account_id").agg(
        n.alias("n_txn"), F.sum("transaction_amt").alias("tot_amt"),
        mean_of(F.sum("transaction_amt"), n).alias("mean_amt"),
        mean_of(F.sum(F.col(score).cast("decimal(18,12)")), n).alias("risk"),
        F.sum("c_champ").cast("decimal(18,6)").alias("y_champ"),
        F.sum("c_chal").cast("decimal(18,6)").alias("y_chal"), F.sum("is_fraud").alias("fraud"))
    pre = history.groupBy("account_id").agg(
        F.sum("transaction_amt").cast("double").alias("pre_value"), n.alias("pre_n"),
        F.sum("is_fraud").alias("pre_fraud"), mean_of(F.sum("transaction_amt"), n).alias("pre_mean_amt"))
    joined = acc.join(pre, "account_id", "left")
    joined = joined.withColumns(zero_filled(
        ["pre_value", "pre_n", "pre_fraud", "pre_mean_amt"], "has_pre_period", "pre_n"))
    return joined.withColumn("arm", arm_of("account_id", salt)).withColumns({
        "y": F.when(F.col("arm") == "challenger", F.col("y_chal")).otherwise(F.col("y_champ")),
        "tau": (F.col("y_chal") - F.col("y_champ")).cast("decimal(18,6)")})


def sample_ratio(accounts: DataFrame) -> DataFrame:
    """Counts per arm and the one-degree chi-square against an even split."""
    n, a = F.count("*"), F.count_if(F.col("arm") == "challenger")
    half = F.col("n") / 2
    return accounts.agg(n.alias("n"), a.alias("n_challenger")).select(
        "n", "n_challenger", (F.col("n") - F.col("n_challenger")).alias("n_champion"),
        F.try_divide((F.col("n_challenger") - half) * (F.col("n_challenger") - half) * 2, half).alias("chi2"))


def sample_ratio_verdict(accounts: DataFrame) -> DataFrame:
    ratio = sample_ratio(accounts).withColumn("p_value", 2 * upper_tail(F.sqrt("chi2")))
    return ratio.withColumn("verdict", F.when(F.col("p_value") >= SRM_HALT_P, "PASS").otherwise("HALT"))


def welch(df: DataFrame, value: str = "y", group: Sequence[str] = (), arm: str = "arm",
          treated: str = "challenger") -> DataFrame:
    """Difference of arm means with the unequal-variance standard error and normal interval."""
    v = F.col(value).cast("decimal(18,6)")
    is_a = F.col(arm) == treated
    sums = []
    for tag, cond in (("a", is_a), ("b", ~is_a)):
        sums += [F.count_if(cond).alias(f"n_{tag}"), F.sum(F.when(cond, v)).alias(f"s_{tag}"),
                 F.sum(F.when(cond, v * v)).alias(f"q_{tag}")]
    t = df.groupBy(*group).agg(*sums)
    mean = {x: mean_of(F.col(f"s_{x}"), F.col(f"n_{x}")) for x in "ab"}
    var = {x: sample_variance(F.col(f"n_{x}"), F.col(f"s_{x}"), F.col(f"q_{x}")) for x in "ab"}
    t = t.withColumns({"mean_a": mean["a"], "mean_b": mean["b"], "diff": mean["a"] - mean["b"],
                       "se": F.sqrt(var["a"] / F.col("n_a") + var["b"] / F.col("n_b"))})
    return t.select(*group, "n_a", "n_b", "mean_a", "mean_b", "diff", "se",
                    (F.col("diff") - Z_TWO_SIDED * F.col("se")).alias("ci_low"),
                    (F.col("diff") + Z_TWO_SIDED * F.col("se")).alias("ci_high"))


def clustered_ratio(clusters: DataFrame, num: str, den: str, group: Sequence[str] = ()) -> DataFrame:
    """Ratio of sums with its delta-method error; rows are clusters.

    The squared residuals come from second moments, so one aggregate is enough.
    """
    a, b = F.col(num), F.col(den)
    t = clusters.groupBy(*group).agg(
        F.count("*").alias("clusters"), F.sum(a).cast("double").alias("sa"), F.sum(b).cast("double").alias("sb"),
        F.sum(a * a).cast("double").alias("saa"), F.sum(a * b).cast("double").alias("sab"),
        F.sum(b * b).cast("double").alias("sbb"))
    t = t.withColumn("ratio", F.try_divide(F.col("sa"), F.col("sb")))
    r, m = F.col("ratio"), F.col("clusters").cast("double")
    resid = F.greatest(F.col("saa") - 2 * r * F.col("sab") + r * r * F.col("sbb"), F.lit(0.0))
    return t.withColumn("se", F.when(m > 1, F.sqrt(resid * m / (m - 1)) / F.col("sb"))).select(
        *group, "clusters", "ratio", "se")


def declined_good_rows(rows: DataFrame) -> DataFrame:
    """Per arm and account: good rows and those its own policy declined."""
    own = F.when(F.col("arm") == "challenger", F.col("dec_chal")).otherwise(F.col("dec_champ"))
    return rows.where(F.col("is_fraud") == 0).groupBy("arm", "account_id").agg(
        F.count_if(own).alias("d"), F.count("*").alias("n"))


def guardrail(rows: DataFrame, ceiling: float = GUARDRAIL_CEILING) -> DataFrame:
    """False-decline rate by arm with a one-sided upper bound against the ceiling."""
    t = clustered_ratio(declined_good_rows(rows), "d", "n", ["arm"])
    bound = F.col("ratio") + Z_ONE_SIDED * F.col("se")
    return t.withColumns({"upper_bound": bound, "z": F.try_divide(F.col("ratio") - ceiling, F.col("se")),
                          "below_ceiling": bound < ceiling})


def arm_metrics(rows: DataFrame) -> DataFrame:
    """Secondary metrics; each arm is judged by its own policy."""
    chal = F.col("arm") == "challenger"
    dec = F.when(chal, F.col("dec_chal")).otherwise(F.col("dec_champ"))
    cost = F.when(chal, F.col("c_chal")).otherwise(F.col("c_champ"))
    bad = F.col("is_fraud") == 1
    amt, none = F.col("transaction_amt"), F.lit(0).cast("decimal(18,3)")
    n = F.count("*")
    t = rows.groupBy("arm").agg(
        n.alias("transactions"), F.count_if(bad).alias("frauds"), F.count_if(dec).alias("declined"),
        F.count_if(dec & bad).alias("__tp"), F.sum(F.when(dec & bad, amt).otherwise(none)).alias("dollars_caught"),
        F.sum(F.when(bad, amt).otherwise(none)).alias("dollars_total"), mean_of(F.sum(cost), n).alias("cost_per_txn"))
    return t.select(
        "arm", "transactions", "frauds", "declined",
        ratio_or_null(F.col("declined"), F.col("transactions")).alias("decline_rate"),
        ratio_or_null(F.col("__tp"), F.col("frauds")).alias("recall"),
        ratio_or_null(F.col("__tp"), F.col("declined")).alias("precision"), "dollars_caught", "dollars_total",
        "cost_per_txn", (100.0 * ratio_or_null(F.col("dollars_caught"), F.col("dollars_total"))).alias("pct_caught"))


def subgroup_effects(accounts: DataFrame) -> DataFrame:
    """Effect among new and established, low and high ticket accounts. Descriptive only."""
    median = exact_quantiles(accounts, "mean_amt", [0.5]).first()["quantile"]
    labels = F.array(F.when(F.col("has_pre_period") > 0, "established").otherwise("new"),
                     F.when(F.col("mean_amt") >= F.lit(median), "high ticket").otherwise("low ticket"))
    out = welch(accounts.withColumn("subgroup", F.explode(labels)), group=["subgroup"])
    return out.withColumns({
        "accounts": F.col("n_a") + F.col("n_b"),
        "scaled_total": F.col("diff") * (F.col("n_a") + F.col("n_b")),
        "crosses_zero": (F.col("ci_low") < 0) & (F.col("ci_high") > 0)})


def risk_quantile_effects(accounts: DataFrame, bins: int = 5) -> DataFrame:
    ranked = global_rank(accounts.select("account_id", "risk", "arm", "y"), [F.col("risk"), F.col("account_id")])
    binned = ranked.withColumn("quintile", equal_count_bin(F.col("rank"), F.col("rank_of"), bins))
    risk = binned.groupBy("quintile").agg(mean_of(F.sum(F.col("risk").cast("decimal(18,12)")), F.count("*"))
                                          .alias("mean_risk"))
    out = welch(binned, group=["quintile"]).join(risk, "quintile")
    return out.withColumns({"accounts": F.col("n_a") + F.col("n_b"),
                            "scaled_total": F.col("diff") * (F.col("n_a") + F.col("n_b"))})


def paired_effect(accounts: DataFrame) -> DataFrame:
    """Exact effect from both potential outcomes, next to the randomised estimate."""
    t = F.col("tau")
    p = accounts.agg(F.count("*").alias("n"), F.sum(t).alias("s"), F.sum(t * t).alias("q"))
    p = p.select("n", mean_of(F.col("s"), F.col("n")).alias("effect"),
                 F.sqrt(sample_variance(F.col("n"), F.col("s"), F.col("q")) / F.col("n")).alias("paired_se"))
    w = welch(accounts).select("diff", "se")
    # Two one-row frames.
    both = p.withColumn("__k", F.lit(1)).join(w.withColumn("__k", F.lit(1)), "__k").drop("__k")
    return both.select(
        "n", "effect", "paired_se", (F.col("effect") - Z_TWO_SIDED * F.col("paired_se")).alias("ci_low"),
        (F.col("effect") + Z_TWO_SIDED * F.col("paired_se")).alias("ci_high"),
        F.col("diff").alias("randomised"), F.col("se").alias("randomised_se"),
        F.try_divide(F.col("se"), F.col("paired_se")).alias("efficiency"),
        (F.abs(F.col("effect") - F.col("diff")) < Z_TWO_SIDED * F.col("se")).alias("consistent"))


def ship_decision(accounts: DataFrame, rows: DataFrame) -> DataFrame:
    """The registered rule: all three conditions ship, a clear failure stops, the rest is inconclusive."""
    w = welch(accounts).first()
    g = {r["arm"]: r for r in guardrail(rows).collect()}["challenger"]  # two rows
    p = 2 * (1 - NormalDist().cdf(abs(w["diff"] / w["se"])))
    conditions = [("primary significant and favourable", p < 0.05 and w["diff"] < 0),
                  ("upper end of the interval below zero", w["ci_high"] < 0),
                  ("guardrail bound below the ceiling", bool(g["below_ceiling"]))]
    if all(ok for _, ok in conditions):
        verdict = "SHIP"
    elif not conditions[2][1] or w["ci_low"] > 0:
        verdict = "DO NOT SHIP"
    else:
        verdict = "INCONCLUSIVE"
    return accounts.sparkSession.createDataFrame(
        [*[(name, "PASS" if ok else "FAIL") for name, ok in conditions], ("decision", verdict)],
        "condition string, outcome string")


def ancova(df: DataFrame, value: str, covariates: Sequence[str] = (), arm: str = "arm",
           treated: str = "challenger") -> DataFrame:
    """Regression-adjusted effect with the HC1 error.

    Two passes: cross products for the normal equations, then residual-weighted cross products.
    Only k x k numbers reach the driver.
    """
    t = F.when(F.col(arm) == treated, 1.0).otherwise(0.0)
    design = [F.lit(1.0), t, *[F.col(c).cast("double") for c in covariates]]
    y = F.col(value).cast("double")
    k = len(design)
    pairs = [(i, j) for i in range(k) for j in range(i, k)]

    def square(row, prefix: str) -> np.ndarray:
        m = np.zeros((k, k))
        for i, j in pairs:
            m[i, j] = m[j, i] = row[f"{prefix}{i}_{j}"]
        return m

    first = df.agg(F.count("*").alias("n"),
                   *[F.sum(design[i] * design[j]).alias(f"x{i}_{j}") for i, j in pairs],
                   *[F.sum(design[i] * y).alias(f"y{i}") for i in range(k)]).first()
    inverse = np.linalg.pinv(square(first, "x"))
    beta = inverse @ np.array([first[f"y{i}"] for i in range(k)])
    fitted = sum((design[i] * F.lit(float(beta[i])) for i in range(k)), F.lit(0.0))
    e2 = (y - fitted) * (y - fitted)
    second = df.agg(*[F.sum(design[i] * design[j] * e2).alias(f"m{i}_{j}") for i, j in pairs]).first()
    n = first["n"]
    cov = inverse @ square(second, "m") @ inverse * (n / (n - k))
    return df.sparkSession.createDataFrame([(int(n), float(beta[1]), float(math.sqrt(cov[1, 1])))],
                                           "n long, effect double, se double")


def adjustment_gain(df: DataFrame, value: str, covariates: Sequence[str] = COVARIATES) -> DataFrame:
    """Unadjusted against adjusted estimate and the share of variance removed."""
    plain, adjusted = ancova(df, value).first(), ancova(df, value, covariates).first()
    return df.sparkSession.createDataFrame(
        [(plain["effect"], plain["se"], adjusted["effect"], adjusted["se"],
          1 - (adjusted["se"] / plain["se"]) ** 2)],
        "effect double, se double, adjusted_effect double, adjusted_se double, variance_reduction double")


def standardised_differences(df: DataFrame, columns: Sequence[str], treated: Column,
                             weight: Column | None = None, group: Sequence[str] = ()) -> DataFrame:
    """Standardised mean difference of every column; zero for a constant column.

    Values are laid out as (covariate, value) inside the map task and pre-aggregated there, so the
    plan does not grow with the number of covariates.
    """
    w = F.lit(1.0) if weight is None else weight.cast("double")
    cells = F.array(*[F.struct(F.lit(c).alias("covariate"), F.col(c).cast("double").alias("x")) for c in columns])
    long = df.select(*group, treated.alias("__a"), w.alias("__w"), F.explode(cells).alias("c")).select(
        *group, "__a", "__w", "c.*")
    wx = F.col("__w") * F.col("x")
    sums = []
    for tag, cond in (("a", F.col("__a")), ("b", ~F.col("__a"))):
        sums += [F.sum(F.when(cond, F.col("__w")).otherwise(0.0)).alias(f"n_{tag}"), F.sum(F.when(cond, wx)).alias(f"s_{tag}"),
                 F.sum(F.when(cond, wx * F.col("x"))).alias(f"q_{tag}")]
    t = long.groupBy(*group, "covariate").agg(*sums)
    mean = {x: F.try_divide(F.col(f"s_{x}"), F.col(f"n_{x}")) for x in "ab"}
    var = {x: sample_variance(F.col(f"n_{x}"), F.col(f"s_{x}"), F.col(f"q_{x}")) for x in "ab"}
    sd = F.sqrt((var["a"] + var["b"]) / 2)
    return t.select(*group, "covariate", F.when(sd > 1e-12, (mean["a"] - mean["b"]) / sd).otherwise(0.0).alias("smd"))


def paired_test(a: DataFrame, b: DataFrame, key: str | Sequence[str], value: str, group: Sequence[str] = ()) -> DataFrame:
    """Paired difference of one measure over two frames matched by ``key``, for each ``group`` of the first frame."""
    keys = [key] if isinstance(key, str) else list(key)
    # A group without a pair keeps its row, with n = 0.
    pair = a.select(*dict.fromkeys([*keys, *group]), F.col(value).cast("double").alias("__a")).join(
        b.select(*keys, F.col(value).cast("double").alias("__b"), F.lit(True).alias("__paired")), keys, "left")
    d = F.col("__a") - F.col("__b")
    t = pair.groupBy(*group).agg(F.count("__paired").alias("n"), F.avg(d).alias("mean_diff"), F.stddev_samp(d).alias("sd_diff"),
                                 F.count_if(d < 0).alias("wins"))
    t = t.withColumn("se", F.when(F.col("n") > 1, F.col("sd_diff") / F.sqrt("n")))
    return t.select(*group, "n", "mean_diff", "sd_diff", "se", F.try_divide("mean_diff", "se").alias("t"), "wins")
