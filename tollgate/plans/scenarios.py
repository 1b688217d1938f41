"""Observational scenarios: six steered rollouts, each estimated the way an analyst would."""

from __future__ import annotations

from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tollgate.operators import matching as M
from tollgate.operators.bootstrap import att_replicates, percentile_interval
from tollgate.operators.encoders import one_hot, standardise
from tollgate.session import pinned

# Covariates an analyst would see, and replicates of the matched effect.
OBSERVED = ("pre_value", "pre_n", "pre_fraud", "has_pre_period", "n_txn", "tot_amt", "first_amt", "first_hasid")
ATT_REPLICATES = 400
AT_ONCE = 3  # strengths that run side by side
CATEGORIES = ("product_cd", "device_type")


def covariate_frame(accounts: DataFrame, rows: DataFrame, categories: Sequence[str] = CATEGORIES) -> tuple[DataFrame, list[str]]:
    """Accounts with standardised observed covariates, plus ``z`` for the one that steers the rollout.

    First attributes are first non-null values per column; levels become indicators with a null level.
    """
    first = M.first_known(rows, ["transaction_amt", "has_identity", *categories])
    first = first.select("account_id", F.col("first_transaction_amt").cast("double").alias("first_amt"),
                         F.coalesce(F.col("first_has_identity").cast("double"), F.lit(0.0)).alias("first_hasid"),
                         *[f"first_{c}" for c in categories])
    df = M.with_z(accounts, "risk", "z").join(first, "account_id")
    names = list(OBSERVED)
    for c in categories:
        df, made = one_hot(df, f"first_{c}")
        df = df.withColumnsRenamed({m: m.replace("|", "_").replace(" ", "_") for m in made})
        names += [m.replace("|", "_").replace(" ", "_") for m in made]
    scaled = {c: f"cov_{i}" for i, c in enumerate(names)}
    out = standardise(df, names, population=True, out=scaled)
    return pinned(out), list(scaled.values())


def matched_run(assigned: DataFrame, covariates: Sequence[str], replicates: int = ATT_REPLICATES) -> dict:
    """Match on a fitted propensity; estimate, interval, diagnostics and sensitivity of one run."""
    scored = pinned(M.propensity_logit(assigned, covariates))
    matched = pinned(M.match(scored))
    pairs = pinned(M.pair_differences(matched, scored))
    stats = M.pair_concentration(pairs).first().asDict()
    ends = percentile_interval(att_replicates(pairs, replicates=replicates), "att").first()
    counts = M.match_summary(matched).first().asDict()
    smd = M.balance(scored, matched, covariates).agg(
        F.avg(F.abs("smd_before")).alias("before"), F.avg(F.abs("smd_after")).alias("after")).first()
    spread = scored.agg(F.stddev_samp("logit")).first()[0]
    gamma = M.overturning_gamma(M.sensitivity_bounds(pairs)).first()["gamma_to_overturn"]
    return {**stats, **counts, "estimate": stats["mean_diff"], "ci_low": ends["ci_low"], "ci_high": ends["ci_high"],
            "mean_abs_smd_before": smd["before"], "mean_abs_smd_after": smd["after"], "gamma_to_overturn": gamma,
            "caliper": M.CALIPER_SD * (spread or 0.0)}


SCHEMA = ("beta double, estimator string, estimate double, ci_low double, ci_high double, true_att double, true_ate double, "
          "bias_vs_att double, bias_vs_ate double, sign_correct boolean, treated_used long, unique_controls long, "
          "dropped_support long, dropped_caliper long, mean_abs_smd_before double, mean_abs_smd_after double, "
          "gamma_to_overturn double, zero_pct double, nonzero_neg_pct double, top1pct_share double, median_diff double, caliper double, "
          "pct_bias double")


def scenario_table(accounts: DataFrame, rows: DataFrame, betas: Sequence[float] = M.BETAS,
                   categories: Sequence[str] = CATEGORIES, replicates: int = ATT_REPLICATES) -> DataFrame:
    """Naive, observed-covariate and oracle-covariate estimates per ramp strength, with diagnostics.

    The strengths are separate jobs, a few at a time: one alone has many short stages that do not fill a cluster.
    """
    frame, observed = covariate_frame(accounts, rows, categories)

    def at_strength(beta: float) -> list[tuple]:
        assigned = pinned(M.ramp_assignment(frame, beta))
        truth = M.effect_summary(assigned).first()
        att, ate = truth["att"], truth["ate"]

        def line(name: str, value: float, run: dict | None) -> tuple:
            r = run or {}
            return (float(beta), name, value, r.get("ci_low"), r.get("ci_high"), att, ate, value - att, value - ate,
                    (value > 0) == (ate > 0) and (value == 0) == (ate == 0),
                    *[r.get(k) for k in ("treated_used", "unique_controls", "dropped_support", "dropped_caliper",
                                         "mean_abs_smd_before", "mean_abs_smd_after", "gamma_to_overturn", "zero_pct", "nonzero_neg_pct",
                                         "top1pct_share", "median_diff", "caliper")],
                    100.0 * (value - att) / abs(att) if att else None)

        out = [line("naive difference", truth["naive"], None)]
        for name, cols in (("matched, observed", observed), ("matched, oracle", [*observed, "z"])):
            run = matched_run(assigned, cols, replicates)
            if run["estimate"] is not None:
                out.append(line(name, run["estimate"], run))
        return out

    with ThreadPoolExecutor(max_workers=AT_ONCE) as pool:
        lines = list(pool.map(at_strength, betas))
    return accounts.sparkSession.createDataFrame([x for some in lines for x in some], SCHEMA)


def bias_summary(table: DataFrame) -> DataFrame:
    """`scenario_table` pivoted: one row per strength, the bias of each estimator against the effect on the treated."""
    names = {"naive difference": "naive", "matched, observed": "observed", "matched, oracle": "oracle"}
    return table.groupBy("beta").pivot("estimator", list(names)).agg(F.first("bias_vs_att")).withColumnsRenamed(names)
