"""Observational estimates: ramped assignment, propensity matching, balance and sensitivity."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import Bucketizer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tollgate.functions.hashing import account_uniform
from tollgate.functions.scalars import mean_of, sample_variance
from tollgate.operators.experiment import SALT, standardised_differences, upper_tail
from tollgate.operators.ordering import exact_quantiles, nearest_values, running_totals
from tollgate.operators.skew import join_keys
from tollgate.session import pinned

# Ramp strengths, caliper in standard deviations, score clip and sensitivity ladder.
BETAS = (0.5, 1.5, 3.0, -0.5, -1.5, -3.0)
CALIPER_SD = 0.2
SCORE_CLIP = 1e-6
GAMMAS = (1.0, 1.1, 1.25, 1.5, 1.75, 2.0, 2.5, 3.0, 4.0, 6.0)
MIN_RANKED_PAIRS = 10
OVERLAP_BINS = 40


def with_z(accounts: DataFrame, column: str = "risk", out: str = "z") -> DataFrame:
    """Standard score with the sample deviation, from exact power sums of the values."""
    v = F.col(column).cast("decimal(18,12)")
    s = accounts.agg(F.count("*").alias("n"), F.sum(v).alias("s"), F.sum(v * v).alias("q")).select(
        mean_of(F.col("s"), F.col("n")).alias("m"),
        F.sqrt(sample_variance(F.col("n"), F.col("s"), F.col("q"))).alias("sd")).first()
    return accounts.withColumn(out, (F.col(column) - F.lit(s["m"])) / F.lit(s["sd"] or 1.0))


def ramp_intercept(df: DataFrame, z: str, beta: float, share: float = 0.5, low: float = -50.0, high: float = 50.0,
                   tolerance: float = 1e-12, fan: int = 32) -> float:
    """Intercept that makes the mean of sigmoid(a + beta*z) equal ``share``.

    Each pass over the data evaluates ``fan`` candidates at once and keeps the bracket that holds
    the root, so about nine passes reach full precision.
    """
    while high - low > tolerance:
        step = (high - low) / (fan + 1)
        candidates = [low + step * (i + 1) for i in range(fan)]
        # Candidates meet rows in the map task; one line per candidate is shuffled.
        tried = df.select(z, F.explode(F.lit(candidates)).alias("a")).groupBy("a").agg(
            F.avg(1 / (1 + F.exp(-(F.col("a") + F.lit(beta) * F.col(z))))).alias("mean"))
        below = sum(r["mean"] < share for r in tried.collect())
        new_low = candidates[below - 1] if below else low
        new_high = candidates[below] if below < fan else high
        if (new_low, new_high) == (low, high):
            break
        low, high = new_low, new_high
    return (low + high) / 2


def ramp_assignment(df: DataFrame, beta: float, z: str = "z", salt: str = SALT) -> DataFrame:
    """Treatment steered by ``z``: chance sigmoid(a + beta*z), half of the accounts on average."""
    alpha = ramp_intercept(df, z, beta)
    chance = 1 / (1 + F.exp(-(F.lit(alpha) + F.lit(beta) * F.col(z))))
    u = account_uniform("account_id", salt, f"obs{beta}")
    t = F.when(u < chance, 1).otherwise(0)
    return df.withColumn("t", t).withColumn("y_obs", F.when(F.col("t") == 1, F.col("y_chal")).otherwise(F.col("y_champ")))


def effect_summary(df: DataFrame) -> DataFrame:
    """Exact average effects and the naive difference of an assigned frame."""
    t = F.col("t") == 1
    s = df.agg(F.count("*").alias("n"), F.count_if(t).alias("n_treated"),
               mean_of(F.sum("tau"), F.count("*")).alias("ate"),
               mean_of(F.sum(F.when(t, F.col("tau"))), F.count_if(t)).alias("att"),
               mean_of(F.sum(F.when(t, F.col("y_obs"))), F.count_if(t)).alias("__y1"),
               mean_of(F.sum(F.when(~t, F.col("y_obs"))), F.count_if(~t)).alias("__y0"))
    naive = F.col("__y1") - F.col("__y0")
    return s.select("n", "n_treated", "ate", "att", naive.alias("naive"), (naive - F.col("att")).alias("bias_vs_att"),
                    (naive - F.col("ate")).alias("bias_vs_ate"),
                    (F.signum(naive) == F.signum("ate")).alias("sign_correct"))


def propensity_logit(df: DataFrame, covariates: Sequence[str], treated: str = "t", out: str = "logit") -> DataFrame:
    """Logit of a ridge-penalised logistic propensity (unit penalty on the summed loss)."""
    vectors = VectorAssembler(inputCols=list(covariates), outputCol="__x").transform(
        df.withColumn("__t", F.col(treated).cast("double")))
    n = df.count()
    model = LogisticRegression(featuresCol="__x", labelCol="__t", probabilityCol="__p", rawPredictionCol="__r",
                               predictionCol="__c", maxIter=100, regParam=1.0 / n, elasticNetParam=0.0,
                               standardization=False, tol=1e-8).fit(vectors)
    p = F.greatest(F.lit(SCORE_CLIP), F.least(F.lit(1 - SCORE_CLIP), vector_to_array("__p")[1]))
    scored = model.transform(vectors).withColumn("propensity", p)
    return scored.withColumn(out, F.log(F.col("propensity") / (1 - F.col("propensity")))).drop(
        "__x", "__t", "__p", "__r", "__c")


def match(df: DataFrame, logit: str = "logit", treated: str = "t", row_id: str = "account_id",
          caliper_sd: float = CALIPER_SD) -> DataFrame:
    """Nearest control of each treated row on the logit, with replacement.

    Returns every treated row with ``control_id``, ``distance`` and ``outcome``: ``matched``,
    ``off_support`` (outside the control range) or ``off_caliper``. Equal distances go to the lower
    neighbour; of controls with one logit the last id is nearest from above and the first from below.
    """
    t = F.col(treated) == 1
    v = F.col(logit)
    lim = df.agg(F.stddev_samp(v).alias("sd"), F.min(F.when(~t, v)).alias("lo"), F.max(F.when(~t, v)).alias("hi")).first()
    caliper = caliper_sd * (lim["sd"] or 0.0)
    near = pinned(nearest_values(df.withColumn("__c", ~t), logit, "__c", row_id))
    pairs = join_keys(df.where(t).select(row_id, logit), near, logit, "inner")  # many rows may have one score
    down, up = v - F.col("below_value"), F.col("above_value") - v
    take_low = up.isNull() | (down <= up)
    pairs = pairs.select(row_id, logit,
                         F.when(take_low & down.isNotNull(), F.col("below")).otherwise(F.col("above")).alias("control_id"),
                         F.when(take_low & down.isNotNull(), down).otherwise(up).alias("distance"))
    inside = v.between(F.lit(lim["lo"]), F.lit(lim["hi"]))
    return pairs.withColumn("outcome", F.when(~inside | F.col("control_id").isNull(), "off_support")
                            .when(F.col("distance") > F.lit(caliper), "off_caliper").otherwise("matched"))


def pair_differences(matched: DataFrame, df: DataFrame, value: str = "y_obs", row_id: str = "account_id") -> DataFrame:
    """Outcome difference of each matched pair."""
    kept = matched.where(F.col("outcome") == "matched").select(row_id, "control_id")
    mine = df.select(row_id, F.col(value).alias("__mine"))
    theirs = df.select(F.col(row_id).alias("control_id"), F.col(value).alias("__theirs"))
    return join_keys(kept.join(mine, row_id), theirs, "control_id", "inner").select(  # one control may serve many
        row_id, "control_id", (F.col("__mine") - F.col("__theirs")).cast("decimal(18,6)").alias("diff"))


def match_summary(matched: DataFrame) -> DataFrame:
    ok = F.col("outcome") == "matched"
    return matched.agg(
        F.count_if(ok).alias("treated_used"), F.count_distinct(F.when(ok, F.col("control_id"))).alias("unique_controls"),
        F.count_if(F.col("outcome") == "off_support").alias("dropped_support"),
        F.count_if(F.col("outcome") == "off_caliper").alias("dropped_caliper"))


def balance(df: DataFrame, matched: DataFrame, covariates: Sequence[str], treated: str = "t",
            row_id: str = "account_id") -> DataFrame:
    """Standardised differences of each covariate before and after matching.

    Matched rows count as often as they were used, through one weight per row and side.
    """
    kept = matched.where(F.col("outcome") == "matched")
    uses = kept.select(F.col(row_id).alias("__id"), F.lit(1).alias("__side")).unionByName(
        kept.select(F.col("control_id").alias("__id"), F.lit(0).alias("__side"))).groupBy("__id", "__side").agg(
        F.count("*").alias("__w"))
    narrow = df.select(row_id, *covariates, F.col(treated).alias("__t"))
    after = narrow.join(uses, F.col(row_id) == F.col("__id")).select(
        F.lit("smd_after").alias("stage"), F.col("__side").alias("side"), "__w", *covariates)
    before = narrow.select(F.lit("smd_before").alias("stage"), F.col("__t").alias("side"),
                           F.lit(1).cast("long").alias("__w"), *covariates)
    both = standardised_differences(before.unionByName(after), covariates, F.col("side") == 1, F.col("__w"), ["stage"])
    return both.groupBy("covariate").pivot("stage", ["smd_before", "smd_after"]).agg(F.first("smd"))


def overlap_histogram(df: DataFrame, score: str = "propensity", arm: str = "t", bins: int = OVERLAP_BINS) -> DataFrame:
    """Rows per arm in equal-width score bins; the last bin includes 1."""
    edges = [i / bins for i in range(bins + 1)]
    cut = Bucketizer(splits=edges, inputCol=score, outputCol="__b")
    return cut.transform(df.select(score, arm)).groupBy(arm, F.col("__b").cast("int").alias("bin")).agg(
        F.count("*").alias("n"))


def _magnitudes(pairs: DataFrame, diff: str) -> DataFrame:
    d = F.col(diff)
    return pairs.where(d != 0).groupBy(F.abs(d).alias("size")).agg(
        F.count("*").alias("n"), F.count_if(d < 0).alias("n_neg"))


def signed_ranks(pairs: DataFrame, diff: str = "diff") -> DataFrame:
    """Signed-rank sums with average ranks of ties: pairs, W of the negatives, S and S2 of all."""
    ranked = running_totals(_magnitudes(pairs, diff), [F.col("size")], {"before": F.col("n")})
    r = F.col("before") + (F.col("n") + 1) / 2
    return ranked.agg(F.sum("n").alias("pairs"), F.sum(F.col("n_neg") * r).alias("w"), F.sum(F.col("n") * r).alias("s"),
                      F.sum(F.col("n") * r * r).alias("s2"))


def sensitivity_z(pairs: DataFrame, diff: str = "diff", gammas: Sequence[float] = GAMMAS) -> DataFrame:
    """Signed-rank z scores under hidden bias of odds up to gamma; empty below ten non-zero pairs."""
    sums = signed_ranks(pairs, diff).where(F.col("pairs") >= MIN_RANKED_PAIRS)
    g = F.col("gamma")
    high, low = g / (1 + g), 1 / (1 + g)
    spread = F.sqrt(high * low * F.col("s2"))
    return sums.withColumn("gamma", F.explode(F.array(*[F.lit(x) for x in gammas]))).select(
        "gamma", "pairs", ((F.col("w") - low * F.col("s")) / spread).alias("z_worst"),
        ((F.col("w") - high * F.col("s")) / spread).alias("z_best"))


def sensitivity_bounds(pairs: DataFrame, diff: str = "diff", gammas: Sequence[float] = GAMMAS) -> DataFrame:
    """Tail probabilities per gamma, under the names of the registered report.

    The report takes the smaller null mean for its "upper" column, so with this sign convention that
    column falls as gamma grows. The definition is kept so that results compare.
    """
    return sensitivity_z(pairs, diff, gammas).select(
        "gamma", "pairs", upper_tail("z_worst").alias("p_upper_bound"), upper_tail("z_best").alias("p_lower_bound"))


def overturning_gamma(bounds: DataFrame, level: float = 0.05) -> DataFrame:
    """Smallest gamma at which the finding is no longer significant; null when none is."""
    return bounds.agg(F.min(F.when(F.col("p_upper_bound") > level, F.col("gamma"))).alias("gamma_to_overturn"))


def pair_concentration(pairs: DataFrame, diff: str = "diff") -> DataFrame:
    """How much of the effect sits in few pairs: zero and negative shares, top 1% of |d|, mean, median."""
    d = F.col(diff)
    base = pairs.agg(F.count("*").alias("pairs"), F.count_if(d == 0).alias("zero"), F.count_if(d < 0).alias("neg"),
                     F.sum(F.abs(d)).alias("mass"), F.sum(d).alias("total"))
    row = base.first()
    top = max((row["pairs"] or 0) // 100, 1)
    by_size = running_totals(_magnitudes(pairs, diff), [F.col("size").desc()], {"before": F.col("n")})
    taken = F.greatest(F.lit(0), F.least(F.col("n"), F.lit(top) - F.col("before")))
    head = by_size.agg(F.coalesce(F.sum((taken.cast("decimal(20,0)") * F.col("size")).cast("decimal(38,6)")),
                                  F.lit(0).cast("decimal(38,6)")).alias("head"))
    median = exact_quantiles(pairs, diff, [0.5]).select(F.col("quantile").alias("median_diff"))
    one = F.lit(1).alias("__k")
    # Three one-row frames.
    both = base.select("*", one).join(head.select("*", one), "__k").join(median.select("*", one), "__k", "left")
    hundred = F.lit(100.0)
    return both.select(
        "pairs", (hundred * F.try_divide(F.col("zero").cast("double"), F.col("pairs"))).alias("zero_pct"),
        (hundred * F.try_divide(F.col("neg").cast("double"), F.col("pairs") - F.col("zero"))).alias("nonzero_neg_pct"),
        (hundred * F.col("head").cast("double") / F.greatest(F.col("mass").cast("double"), F.lit(1e-9))).alias("top1pct_share"),
        mean_of(F.col("total"), F.col("pairs")).alias("mean_diff"), "median_diff")


def first_known(rows: DataFrame, columns: Sequence[str], key: str = "account_id", order: str = "transaction_id") -> DataFrame:
    """Per account and column, the first value that is not null in row order (not the first row)."""
    return rows.groupBy(key).agg(*[
        F.min(F.when(F.col(c).isNotNull(), F.struct(order, c)))[c].alias(f"first_{c}") for c in columns])


def settled(df: DataFrame) -> DataFrame:
    """Fix an assigned frame before matching, which reads it several times."""
    return pinned(df)
