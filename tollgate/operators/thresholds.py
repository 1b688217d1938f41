"""Pricing of decline thresholds: one pass over the rows for any number of thresholds and costs."""

from __future__ import annotations

from collections.abc import Sequence
from decimal import Decimal
from fractions import Fraction

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tollgate.functions.costs import DEFAULT_COSTS, CostModel, money, threshold_grid
from tollgate.functions.scalars import ratio_or_null
from tollgate.session import pinned

# The two extreme policies and the sensitivity factors.
DECLINE_ALL, NAIVE, APPROVE_ALL = 0.0, 0.5, 1.01
SENSITIVITY = {"optimum -20%": 0.8, "optimum": 1.0, "optimum +20%": 1.2}


def outcome_cells(df: DataFrame, thresholds: Sequence[float], score: str = "score",
                  label: str = "is_fraud", amount: str = "transaction_amt",
                  group: Sequence[str] = ()) -> DataFrame:
    """Rows and dollars by label per cell, a cell being the number of thresholds at or below a score.

    The only step that reads rows. Its result has at most ``len(thresholds) + 1`` rows per group.
    """
    splits = [float("-inf"), *thresholds, float("inf")]
    cut = Bucketizer(splits=splits, inputCol=score, outputCol="__cell", handleInvalid="error")
    narrow = df.select(*group, F.col(score).cast("double").alias(score), label,
                       F.col(amount).cast("decimal(18,3)").alias(amount))
    bad = F.col(label) == 1
    nothing = F.lit(0).cast("decimal(18,3)")
    return (cut.transform(narrow).groupBy(*group, F.col("__cell").cast("int").alias("cell")).agg(
        F.count_if(bad).alias("n_bad"), F.count_if(~bad).alias("n_good"),
        F.sum(F.when(bad, F.col(amount)).otherwise(nothing)).alias("amt_bad"),
        F.sum(F.when(bad, nothing).otherwise(F.col(amount))).alias("amt_good")))


def _ladder(df: DataFrame, values: Sequence[float], index: str, name: str) -> DataFrame:
    """One row per sorted value, numbered from 1, and a row 0 below the first."""
    # One literal: a literal per threshold is a call to the JVM each, which side by side jobs wait for.
    at = F.get(F.split(F.lit(" ".join(repr(float(v)) for v in values)), " ").cast("array<double>"), (F.col("id") - 1).cast("int"))
    return df.sparkSession.range(len(values) + 1).select(F.col("id").cast("int").alias(index), at.alias(name))


def outcomes(df: DataFrame, thresholds: Sequence[float] | None = None, **columns: str) -> DataFrame:
    """Confusion counts and dollars at every threshold; a score equal to it is declined."""
    thresholds = list(thresholds or threshold_grid())
    cells = outcome_cells(df, thresholds, **columns)
    ladder = _ladder(df, thresholds, "cell", "threshold")
    # Result-sized: one row per threshold.
    filled = ladder.join(cells, "cell", "left").na.fill(0)
    above = Window.orderBy(F.col("cell").desc()).rowsBetween(Window.unboundedPreceding, 0)
    everything = Window.partitionBy()
    zero = F.lit(0).cast("decimal(28,3)")
    cols = {}
    for what in ("n_bad", "n_good", "amt_bad", "amt_good"):
        value = F.col(what) if what.startswith("n_") else F.coalesce(F.col(what), zero)
        cols[f"declined_{what}"] = F.sum(value).over(above)
        cols[f"all_{what}"] = F.sum(value).over(everything)
    d = filled.select("cell", "threshold", *[c.alias(name) for name, c in cols.items()]).where("cell > 0")
    return d.select(
        "threshold", F.col("declined_n_bad").alias("tp"), F.col("declined_n_good").alias("fp"),
        (F.col("all_n_bad") - F.col("declined_n_bad")).alias("fn"),
        (F.col("all_n_good") - F.col("declined_n_good")).alias("tn"),
        F.col("declined_amt_bad").alias("amt_tp"), F.col("declined_amt_good").alias("amt_fp"),
        (F.col("all_amt_bad") - F.col("declined_amt_bad")).alias("amt_fn"),
        (F.col("all_amt_good") - F.col("declined_amt_good")).alias("amt_tn"))


def policy_cost(costs: CostModel = DEFAULT_COSTS, false_decline: Column | None = None) -> Column:
    """Total cost of one threshold's outcome row, exact in decimals."""
    fd = money(costs.false_decline) if false_decline is None else false_decline
    margin = F.lit(costs.margin_rate).cast("decimal(6,3)")
    return (F.col("amt_fn") + F.col("fn") * money(costs.chargeback_fee) + F.col("amt_fp") * margin
            + F.col("fp") * fd + (F.col("tp") + F.col("fp")) * money(costs.review)).cast("decimal(38,6)")


def sweep(df: DataFrame, thresholds: Sequence[float] | None = None, costs: CostModel = DEFAULT_COSTS,
          **columns: str) -> DataFrame:
    return outcomes(df, thresholds, **columns).withColumn("cost", policy_cost(costs))


def cheapest(priced: DataFrame, group: Sequence[str] = ()) -> DataFrame:
    """Cheapest threshold; equal costs go to the lowest one."""
    best = F.min(F.struct("cost", "threshold")).alias("b")
    return priced.groupBy(*group).agg(best).select(*group, "b.threshold", "b.cost")


def best_threshold(df: DataFrame, costs: CostModel = DEFAULT_COSTS, **columns: str) -> tuple[float, Decimal]:
    row = cheapest(sweep(df, None, costs, **columns)).first()
    return row["threshold"], row["cost"]


def with_rates(priced: DataFrame) -> DataFrame:
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    return priced.withColumns({
        "precision": ratio_or_null(tp, tp + fp), "recall": ratio_or_null(tp, tp + fn),
        "false_decline_rate": ratio_or_null(fp, fp + tn),
        "declined": tp + fp, "approved": fn + tn})


def compare_policies(df: DataFrame, costs: CostModel = DEFAULT_COSTS, **columns: str) -> DataFrame:
    """The optimum against the naive cut-off and the two extremes, in one data pass."""
    grid = threshold_grid()
    extra = [t for t in (DECLINE_ALL, NAIVE, APPROVE_ALL) if t not in grid]
    priced = sweep(df, sorted(grid + extra), costs, **columns)
    on_grid = F.col("threshold").between(grid[0], grid[-1]) & ~F.col("threshold").isin(
        [t for t in extra if grid[0] <= t <= grid[-1]])
    best = F.min(F.when(on_grid, F.struct("cost", "threshold"))).over(Window.partitionBy())
    named = (F.when(F.col("threshold") == DECLINE_ALL, "decline everything")
             .when(F.col("threshold") == APPROVE_ALL, "approve everything"))
    kinds = F.array_compact(F.array(
        F.when(F.col("threshold") == F.col("b.threshold"), F.lit("optimum")),
        F.when(F.col("threshold") == NAIVE, F.lit("naive 0.5")), named))
    return (priced.withColumn("b", best).withColumn("policy", F.explode(kinds))
            .select("policy", "threshold", "cost", (F.col("cost") - F.col("b.cost")).alias("vs_optimum"),
                    "tp", "fp", "fn", "tn", "amt_tp", "amt_fn", "amt_fp", "amt_tn"))


def sensitivity(df: DataFrame, costs: CostModel = DEFAULT_COSTS, **columns: str) -> DataFrame:
    """Cost when the optimum is moved by a fifth either way."""
    t, _ = best_threshold(df, costs, **columns)
    factors = sorted(SENSITIVITY.items(), key=lambda kv: kv[1])
    priced = sweep(df, [t * f for _, f in factors], costs, **columns)
    label = F.lit(None).cast("string")
    for name, f in factors:
        label = F.when(F.col("threshold") == F.lit(t * f), name).otherwise(label)
    base = F.max(F.when(F.col("threshold") == F.lit(t), F.col("cost"))).over(Window.partitionBy())
    return priced.select(label.alias("label"), "threshold", "cost", (F.col("cost") - base).alias("delta"),
                         (F.lit(100.0) * ratio_or_null(F.col("cost") - base, base)).alias("delta_pct"))


def regret(df: DataFrame, false_decline_costs: Sequence[Decimal], costs: CostModel = DEFAULT_COSTS,
           **columns: str) -> DataFrame:
    """What keeping the baseline threshold costs under other prices of a false decline.

    Rows are read once; every price is applied to the same outcome table.
    """
    grid = threshold_grid()
    table = pinned(outcomes(df, sorted({*grid, NAIVE}), **columns))
    swept = F.lit(True) if NAIVE in grid else F.col("threshold") != NAIVE
    baseline = cheapest(table.where(swept).withColumn("cost", policy_cost(costs))).first()["threshold"]
    prices = F.array(*[F.lit(Decimal(p)).cast("decimal(18,6)") for p in false_decline_costs])
    priced = table.withColumn("false_decline_cost", F.explode(prices)).withColumn(
        "cost", policy_cost(costs, F.col("false_decline_cost")))
    out = priced.groupBy("false_decline_cost").agg(
        F.min(F.when(swept, F.struct("cost", "threshold"))).alias("b"),
        F.max(F.when(F.col("threshold") == baseline, F.col("cost"))).alias("at_baseline"),
        F.max(F.when(F.col("threshold") == NAIVE, F.col("cost"))).alias("at_half"))
    return out.select("false_decline_cost", F.col("b.threshold").alias("optimal_threshold"),
                      F.col("b.cost").alias("cost_at_optimum"), F.col("at_baseline").alias("cost_at_baseline"),
                      (F.col("at_baseline") - F.col("b.cost")).alias("regret"),
                      (F.col("at_half") - F.col("at_baseline")).alias("saving_vs_half"))


def cost_lines(df: DataFrame, costs: CostModel = DEFAULT_COSTS, thresholds: Sequence[float] | None = None, **columns: str) -> DataFrame:
    """Every threshold's cost as a line over the price of a false decline: threshold, slope (false declines), intercept."""
    free = policy_cost(costs, F.lit(0).cast("decimal(18,6)"))
    return outcomes(df, thresholds, **columns).select("threshold", F.col("fp").alias("slope"), free.alias("intercept"))


def flip_price(df: DataFrame, costs: CostModel = DEFAULT_COSTS, **columns: str) -> DataFrame:
    """The exact price of a false decline from which the baseline threshold no longer beats the naive one.

    Null where it does at every price; 0 where it never does.
    """
    grid = threshold_grid()
    lines = pinned(cost_lines(df, costs, sorted({*grid, NAIVE}), **columns))
    swept = F.lit(True) if NAIVE in grid else F.col("threshold") != NAIVE
    stated = F.col("intercept") + F.col("slope") * money(costs.false_decline)
    baseline = lines.where(swept).agg(F.min(F.struct(stated, "threshold")).alias("b")).select("b.threshold").first()["threshold"]
    pair = lines.agg(*[F.max(F.when(F.col("threshold") == F.lit(t), F.col(c))).alias(f"{name}_{c}")
                       for t, name in ((baseline, "base"), (NAIVE, "half")) for c in ("slope", "intercept")])
    ahead = (F.col("half_intercept") - F.col("base_intercept")).cast("double")
    steeper = F.col("base_slope") - F.col("half_slope")
    price = F.when(ahead <= 0, F.when(steeper >= 0, 0.0)).when(steeper > 0, ahead / steeper)
    return pair.select(F.lit(baseline).alias("baseline_threshold"), price.alias("flip_price"))


def price_envelope(df: DataFrame, costs: CostModel = DEFAULT_COSTS, **columns: str) -> DataFrame:
    """The cheapest threshold at every price of a false decline: pieces (price_from, price_to, threshold, cost_from).

    The lower envelope of the cost lines, walked from price 0 on. The lines come to the driver, at most one for each threshold
    of the grid. Equal lines and equal costs go to the lowest threshold; the last piece has no end.
    """
    lines = [(r["slope"], r["intercept"], r["threshold"]) for r in cost_lines(df, costs, **columns).collect()]
    slope, cost, threshold = min(lines, key=lambda x: (x[1], x[0], x[2]))
    start, pieces = Fraction(0), []
    while True:
        # The next line to fall below the present one, and of those that meet it there the flattest.
        later = [(Fraction(c - cost) / (slope - s), s, t, c) for s, c, t in lines if s < slope]
        price, s, t, c = min(later, default=(None, slope, threshold, cost))
        pieces.append((float(start), None if price is None else float(price), threshold, float(cost) + float(start) * slope))
        if price is None:
            break
        start, slope, threshold, cost = price, s, t, c
    return df.sparkSession.createDataFrame(pieces, "price_from double, price_to double, threshold double, cost_from double")


def targeted(rows: DataFrame, accounts: DataFrame, cutoffs: Sequence[float]) -> DataFrame:
    """Challenger policy only for accounts at or above a risk cut-off, champion below.

    ``accounts`` has ``account_id, risk, y_champ, y_chal``; ``rows`` has ``account_id, is_fraud,
    transaction_amt, dec_champ, dec_chal``. Rows collapse to one line per account before the join, and
    accounts to one line per risk band after it.
    """
    cutoffs = sorted(cutoffs)
    cut = Bucketizer(splits=[float("-inf"), *cutoffs, float("inf")], inputCol="risk", outputCol="__band")
    banded = cut.transform(accounts.select("account_id", "risk", "y_champ", "y_chal")).withColumn(
        "band", F.col("__band").cast("int"))
    by_account = banded.groupBy("band").agg(
        F.count("*").alias("n"), F.sum("y_champ").alias("champ"), F.sum("y_chal").alias("chal"))
    good, bad = F.col("is_fraud") == 0, F.col("is_fraud") == 1
    none = F.lit(0).cast("decimal(18,3)")
    amt = F.col("transaction_amt").cast("decimal(18,3)")
    per_account = rows.groupBy("account_id").agg(
        F.count_if(good).alias("good"),
        F.count_if(good & F.col("dec_champ")).alias("gd_champ"),
        F.count_if(good & F.col("dec_chal")).alias("gd_chal"),
        F.sum(F.when(bad & F.col("dec_champ"), amt).otherwise(none)).alias("caught_champ"),
        F.sum(F.when(bad & F.col("dec_chal"), amt).otherwise(none)).alias("caught_chal"))
    by_row = per_account.join(banded.select("account_id", "band"), "account_id").groupBy("band").agg(
        *[F.sum(c).alias(c) for c in ("good", "gd_champ", "gd_chal", "caught_champ", "caught_chal")])
    # Result-sized from here: one row per band.
    ladder = _ladder(rows, cutoffs, "band", "risk_cutoff")
    t = ladder.join(by_account, "band", "left").join(by_row, "band", "left")
    up = Window.orderBy(F.col("band").desc()).rowsBetween(Window.unboundedPreceding, 0)
    low = Window.orderBy("band").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy()

    def mix(chal: str, champ: str, dtype: str) -> Column:
        zero = F.lit(0).cast(dtype)
        return (F.coalesce(F.sum(chal).over(up), zero) + F.coalesce(F.sum(champ).over(low), zero)).cast(dtype)

    out = t.select(
        "band", "risk_cutoff", F.coalesce(F.sum("n").over(up), F.lit(0)).alias("accounts_on_challenger"),
        F.sum("n").over(whole).alias("__n"), mix("chal", "champ", "decimal(38,6)").alias("total_cost"),
        mix("gd_chal", "gd_champ", "long").alias("legit_declined"),
        F.sum("good").over(whole).alias("__good"),
        mix("caught_chal", "caught_champ", "decimal(38,3)").alias("dollars_caught"),
        F.sum("chal").over(whole).alias("__all"))
    return out.where("band > 0").select(
        "risk_cutoff", "accounts_on_challenger",
        (F.lit(100.0) * ratio_or_null(F.col("accounts_on_challenger"), F.col("__n"))).alias("pct_accounts"),
        "total_cost", "legit_declined",
        (F.lit(100.0) * ratio_or_null(F.col("legit_declined"), F.col("__good"))).alias("false_decline_pct"),
        "dollars_caught", (F.col("total_cost") - F.col("__all")).alias("vs_challenger_everywhere"))
