"""The registered queries: every operator applied to the given tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from decimal import Decimal
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tollgate.functions import costs as C
from tollgate.functions import hashing as H
from tollgate.functions import keys as K
from tollgate.functions import scalars as S
from tollgate.operators import audit as A
from tollgate.operators import bootstrap as B
from tollgate.operators import design as G
from tollgate.operators import encoders as E
from tollgate.operators import experiment as X
from tollgate.operators import matching as M
from tollgate.operators import metrics as Q
from tollgate.operators import profile as P
from tollgate.operators import quality as D
from tollgate.operators import thresholds as Th
from tollgate.operators import velocity as V
from tollgate.plans import evaluation as Ev
from tollgate.plans import layout as L
from tollgate.plans import marts
from tollgate.session import pinned, scratch
from tollgate.sources import tables as Tb
from tollgate.sources.canonical import (FOLD_DAYS, FOLD_STARTS, PRE_PERIOD, REPLAY_FROM, SPLIT_EDGES, dated_orders,
                                        identity, keyed, table, transactions)

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

# The false-decline prices and the churn-by-lifetime grid of the regret reports.
FALSE_DECLINE_PRICES = [Decimal(x) for x in ("0.5", "1", "2", "4", "6", "8", "10", "15", "20", "30", "50", "80", "120")]
CHURNS = [Decimal(x) for x in ("0.01", "0.02", "0.03", "0.05", "0.08", "0.12", "0.20")]
LIFETIMES = [Decimal(x) for x in ("50", "100", "150", "200", "300", "500", "800")]


def tidy(df: DataFrame) -> DataFrame:
    """Counts as bigint and measures as doubles of six digits, for comparison across engines."""
    cols = []
    for f in df.schema.fields:
        col = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.IntegerType, T.ShortType, T.ByteType)):
            col = col.cast("long")
        elif isinstance(f.dataType, (T.DoubleType, T.FloatType, T.DecimalType)):
            # Half up by plain arithmetic: engines disagree on round() for exact halves.
            # Where six digits no longer fit beside the whole part of a double, the value stays as it is.
            col = col.cast("double")
            col = F.when(F.abs(col) < 9e9, F.floor(col * 1e6 + 0.5).cast("double") / 1e6).otherwise(col)
        cols.append(col.alias(f.name))
    return df.select(*cols)


def query(fn: Query) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
        return tidy(fn(spark, sf_dir))
    run.__name__ = fn.__name__
    run.__doc__ = fn.__doc__
    QUERIES[fn.__name__] = run
    return fn


# ---- staging -----------------------------------------------------------------------------------

def raw_shape(spark: SparkSession, d: str) -> DataFrame:
    """The canonical rows under raw, mixed-case names and loose types."""
    return transactions(spark, d).select(
        F.col("transaction_id").cast("double").alias("TransactionID"), F.col("is_fraud").alias("isFraud"),
        F.col("transaction_dt").alias("TransactionDT"), F.col("transaction_amt").cast("string").alias("TransactionAmt"),
        F.col("product_cd").alias("ProductCD"), F.col("card1"), F.col("addr1"), F.col("d1").alias("D1"))


@query
def stg_typed(spark, d):
    """Typed, snake-case staging projection from a loosely typed raw schema."""
    return Tb.staged(raw_shape(spark, d))


@query
def txn_clock(spark, d):
    """Day, hour and weekday of relative time."""
    t = transactions(spark, d)
    return t.select("transaction_id", S.day_of().alias("txn_day"), S.hour_of().alias("txn_hour"),
                    S.weekday_of().alias("txn_dow"))


@query
def csv_roundtrip(spark, d):
    """Rows written as CSV, read with inferred types, kept as Parquet, checked for completeness."""
    out = scratch(spark)
    raw = raw_shape(spark, d)
    raw.write.mode("overwrite").option("header", True).csv(f"{out}/csv")
    parquet = Tb.csv_to_parquet(spark, f"{out}/csv", f"{out}/parquet", "TransactionDT")
    Tb.require_complete(parquet, "transactions", raw.count(), len(raw.columns) + 1)
    return Tb.staged(parquet)


@query
def by_name_union(spark, d):
    """Files with different column order, case and width loaded by name."""
    t = transactions(spark, d)
    a = t.where("is_fraud = 1").select(F.col("transaction_id").alias("TRANSACTION_ID"), "transaction_amt", "product_cd")
    b = t.where("is_fraud = 0").select(F.col("product_cd").alias("Product_CD"), "transaction_id")
    return Tb.union_by_name(a, b)


@query
def narrow_types(spark, d):
    """Extract with narrowed types; the type names are part of the result."""
    t = transactions(spark, d).select(F.col("transaction_id").cast("decimal(20,0)").alias("Transaction_ID"),
                                      F.col("transaction_amt").alias("TRANSACTION_AMT"), F.col("score").alias("Score"))
    n = Tb.narrowed(t)
    return n.select("*", *[F.typeof(c).alias(f"type_{c}") for c in n.columns])


@query
def align_by_id(spark, d):
    """Rows of one table for exactly the ids of another."""
    t = transactions(spark, d)
    ids = t.where("is_fraud = 1").select("transaction_id")
    return Tb.aligned(t.select("transaction_id", "card1", "addr1", "txn_day"), ids)


# ---- keys --------------------------------------------------------------------------------------

@query
def account_keys(spark, d):
    """Five-tier account key with its parts and the degraded flag."""
    account, tier = K.account_key()
    return transactions(spark, d).select(
        "transaction_id", "transaction_dt", "txn_day", "card1", K.whole_number(F.col("addr1")).alias("addr1"),
        K.card_start_day().alias("card_start_day"), tier.alias("account_key_tier"), account.alias("account_id"),
        K.is_degraded(tier).alias("is_degraded_key"))


def _candidate(spark, d, name):
    """Look-back block of a candidate key from the catalogue."""
    t = transactions(spark, d).withColumns({
        "card2": F.when(F.col("k") % 4 != 0, F.col("k") % 5), "card3": F.when(F.col("k") % 6 != 0, F.col("k") % 3),
        "card5": F.col("k") % 2, "p_emaildomain": F.when(F.col("k") % 8 != 0, F.col("product_cd"))})
    keyed_rows = marts.with_key(t, K.key_catalogue()[name])
    return V.velocity(keyed_rows).select("transaction_id", "account_id", "account_key_tier", "is_degraded_key",
                                         *V.feature_names())


@query
def tiered_key_email(spark, d):
    """Longest-prefix key ending in an e-mail domain, with its look-back block."""
    return _candidate(spark, d, "card_addr_start_email")


@query
def tiered_key_single(spark, d):
    """Single-part key, with its look-back block."""
    return _candidate(spark, d, "card")


@query
def tiered_key_start(spark, d):
    return _candidate(spark, d, "card_start")


@query
def tiered_key_card2(spark, d):
    return _candidate(spark, d, "card_addr_start_card2")


@query
def tiered_key_all_cards(spark, d):
    return _candidate(spark, d, "all_cards_addr_start")


@query
def key_tier_share(spark, d):
    """Rows and share per key tier."""
    return P.tier_share(keyed(spark, d))


# ---- features ----------------------------------------------------------------------------------

@query
def txn_features(spark, d):
    """The flagship: strictly prior behavioural features per account, with derived amounts and clock."""
    f = V.velocity(keyed(spark, d).select("transaction_id", "account_id", "account_key_tier", "txn_day",
                                          "transaction_dt", "transaction_amt", "is_fraud"))
    return f.withColumns({"log_amount": S.log_amount(), "txn_hour": S.hour_of(), "txn_dow": S.weekday_of()})


@query
def txn_features_peers(spark, d):
    """The same block where rows of an account share timestamps."""
    return V.velocity(dated_orders(spark, d))


@query
def txn_features_slots(spark, d):
    """The same block through the slot plan used for accounts too large for one task."""
    return V.velocity_by_slots(dated_orders(spark, d))


@query
def prior_selfjoin_check(spark, d):
    """Rows whose look-back features differ from an independent recomputation, with the rows checked."""
    fact = V.velocity(keyed(spark, d))
    bad = D.window_mismatches(fact).agg(F.count("*").alias("mismatches"), F.lit(1).alias("k"))
    rows = fact.agg(F.count("*").alias("rows_checked"), F.sum("prior_txn_count").alias("prior_pairs"),
                    F.sum("prior_amt_sum").alias("prior_amount"), F.lit(1).alias("k"))
    return rows.join(bad, "k").drop("k")


@query
def d_norm(spark, d):
    """Day counters re-based on the transaction day."""
    t = transactions(spark, d).withColumn("d2", F.col("d1") + 1)
    return t.withColumns(S.rebased_offsets(["d1", "d2"])).select("transaction_id", "d1", "d2", "d1_norm", "d2_norm")


@query
def fact_wide(spark, d):
    """The whole fact row: keys, look-back block, clock, re-based counters, identity passthrough."""
    txn = transactions(spark, d).drop("k", "score")
    return marts.build_fact(txn, identity(spark, d))


# ---- marts and profiles --------------------------------------------------------------------------

@query
def dim_accounts(spark, d):
    """One row per account over its whole history."""
    return P.account_dimension(keyed(spark, d))


def account_mart(spark, d) -> DataFrame:
    """Keyed rows stored in buckets of the account, in time order."""
    return L.bucketed(keyed(spark, d), f"mart_{uuid.uuid4().hex}", scratch(spark), "account_id", ["transaction_dt"])


@query
def mart_accounts(spark, d):
    """The account dimension read from the bucketed mart, without an exchange."""
    return P.account_dimension(account_mart(spark, d))


@query
def mart_features(spark, d):
    """The look-back block read from the bucketed mart, without an exchange."""
    return V.velocity(account_mart(spark, d)).select("transaction_id", "account_id", "transaction_dt", *V.feature_names())


BLOCK_LINES, BLOCK_SUPPLIERS = 7, 50


@query
def fact_block(spark, d):
    """Look-back features beside a passthrough block of 350 columns that no shuffle of the window carries."""
    slot = (F.col("l_linenumber") - 1) * BLOCK_SUPPLIERS + F.col("l_suppkey") % BLOCK_SUPPLIERS + 1
    lines = spark.read.parquet(f"{d}/lineitem.parquet").select(F.col("l_orderkey").alias("transaction_id"), slot.alias("slot"), "l_quantity")
    block = L.pivoted_block(lines, "transaction_id", F.col("slot"), "l_quantity", BLOCK_LINES * BLOCK_SUPPLIERS)
    rows = keyed(spark, d).select("transaction_id", "account_id", "transaction_dt", "transaction_amt")
    wide = L.bucketed(rows.join(block, "transaction_id", "left"), f"wide_{uuid.uuid4().hex}", scratch(spark), "transaction_id")
    return L.with_late_features(wide)


@query
def dim_weighted(spark, d):
    """Size of the account a typical row sits in."""
    fact = keyed(spark, d)
    return P.row_weighted_size(fact, P.account_dimension(fact))


@query
def account_size_stats(spark, d):
    return P.account_size_stats(P.account_dimension(keyed(spark, d)))


@query
def account_size_hist(spark, d):
    """Accounts and rows per size bucket."""
    return P.account_size_histogram(P.account_dimension(keyed(spark, d)))


@query
def table_counts(spark, d):
    fact = keyed(spark, d)
    return P.table_counts({"fct_transactions": fact, "stg_identity": identity(spark, d),
                           "dim_accounts": P.account_dimension(fact)})


@query
def null_profile(spark, d):
    """Null share per feature with the over-limit flag."""
    fact = marts.build_fact(transactions(spark, d), identity(spark, d))
    return P.null_profile(fact, ["prior_txn_count", "prior_amt_sum", "prior_amt_mean", "txn_count_7d",
                                 "prev_transaction_dt", "amt_to_prior_mean_ratio", "card1", "addr1", "d1_norm", "id_01"])


@query
def block_profile(spark, d):
    """Columns and example null share per passthrough block."""
    fact = marts.with_identity(transactions(spark, d), identity(spark, d))
    return P.block_profile(fact, {"key parts": ["card1", "addr1", "d1"], "identity": ["id_01", "device_type"]})


@query
def coverage(spark, d):
    """Identity coverage and label rate."""
    return P.coverage(marts.with_identity(transactions(spark, d), identity(spark, d)))


@query
def split_profile(spark, d):
    """Rows, positives and drift per time split."""
    return P.split_profile(transactions(spark, d), S.time_split(edges=SPLIT_EDGES))


@query
def fold_masks(spark, d):
    """Rows and positives per walk-forward fold and role."""
    from tollgate.plans.walkforward import fold_roles
    rows = fold_roles(transactions(spark, d), FOLD_STARTS, FOLD_DAYS)
    return rows.groupBy("fold", "role").agg(F.count("*").alias("n"), F.sum("is_fraud").alias("frauds"))


@query
def reconcile_ids(spark, d):
    """Ids missing on either side of two tables."""
    return D.reconcile(transactions(spark, d), identity(spark, d), "transaction_id")


@query
def level_frequency(spark, d):
    """Frequency of each level of a category."""
    return P.level_counts(table(spark, d, "part"), "p_name")


# ---- data quality --------------------------------------------------------------------------------

@query
def dq_unique(spark, d):
    """Repeated (order, line) keys."""
    lines = table(spark, d, "lineitem").select(
        F.concat_ws("-", "l_orderkey", "l_linenumber").alias("line_key"))
    return D.duplicates(lines, "line_key")


@query
def dq_not_null(spark, d):
    """Rows without a card."""
    return D.nulls(transactions(spark, d), "card1").select("transaction_id", "k")


@query
def dq_accepted(spark, d):
    """Tiers outside a list that leaves one out."""
    return D.unexpected_values(keyed(spark, d), "account_key_tier", [K.FULL, K.NO_ADDR, K.NO_CARD_START, K.SINGLETON])


@query
def dq_row_count(spark, d):
    """Row-count assertion that must fail: the account dimension is smaller than the fact."""
    fact = keyed(spark, d)
    return D.wrong_row_count(P.account_dimension(fact), fact.count())


@query
def dq_leakage(spark, d):
    """First rows with look-back values: none in the real feed, one per account once the count is raised by one."""
    fact = V.velocity(keyed(spark, d))
    clean = D.leaking_first_rows(fact).select(F.lit("clean").alias("feed"), "transaction_id", "prior_txn_count")
    broken = fact.withColumn("prior_txn_count", F.col("prior_txn_count") + 1)
    dirty = D.leaking_first_rows(broken).select(F.lit("broken").alias("feed"), "transaction_id", "prior_txn_count")
    return clean.unionByName(dirty)


@query
def dq_tolerance(spark, d):
    """Measures outside their tolerance."""
    measured = P.coverage(marts.with_identity(transactions(spark, d), identity(spark, d)))
    return D.out_of_tolerance(measured, {"flag_pct": (24.4, 0.1), "fraud_rate": (0.2, 0.05)})


@query
def dq_suite(spark, d):
    """All seventeen checks of the fact table in two passes: of the real feed, and of one with faults of several kinds."""
    rows = keyed(spark, d)
    tiers = [K.FULL, K.NO_ADDR, K.NO_CARD_START, K.CARD_ONLY, K.SINGLETON]
    checks = A.fact_checks(rows.count(), tiers)
    fact = V.velocity(rows)
    third = F.col("transaction_id") % 3 == 0
    broken = (fact.unionByName(fact.where(F.col("transaction_id") % 50 == 0))
              .withColumn("account_key_tier", F.when(F.col("transaction_id") % 7 == 0, "unknown").otherwise(F.col("account_key_tier")))
              .withColumn("transaction_amt", F.when(~third, F.col("transaction_amt")))
              .withColumn("prior_txn_count", F.col("prior_txn_count") + F.when(third, 1).otherwise(0)))
    found = [(feed, name, n) for feed, df in (("real", fact), ("broken", broken))
             for name, n in A.audited_write(df, scratch(spark), checks).items()]
    return spark.createDataFrame(found, "feed string, check_name string, offenders long")


@query
def sampled_sequences(spark, d):
    """Time-ordered rows of three accounts picked by hash, for reading."""
    fact = V.velocity(keyed(spark, d))
    return P.sampled_sequences(fact, P.account_dimension(fact),
                               columns=["transaction_amt", "prior_txn_count", "prior_amt_sum"])


# ---- incremental ---------------------------------------------------------------------------------

def _fact_result(df: DataFrame) -> DataFrame:
    return df.select("transaction_id", "account_id", "txn_day", "prior_txn_count", "prior_amt_sum", "txn_count_7d",
                     "seconds_since_prev_txn")


@query
def fact_incremental(spark, d):
    """Fact table built in three day-wise loads; must equal one full build."""
    path = scratch(spark) + "/fact"
    t = pinned(transactions(spark, d))  # the staged layer is stored once and read by every load
    for last in (9, 19, 29):
        marts.load_new_days(t.where(F.col("txn_day") <= last), path)
    marts.load_new_days(t, path)
    return _fact_result(marts.read_fact(spark, path))


@query
def fact_late_rows(spark, d):
    """A late row of a loaded day is not picked up, though later rows do see it as history."""
    path = scratch(spark) + "/fact"
    t = pinned(transactions(spark, d))
    late = (F.col("txn_day") == 3) & (F.col("k") < 20)
    marts.load_new_days(t.where((F.col("txn_day") <= 9) & ~late), path)
    marts.load_new_days(t, path)
    return _fact_result(marts.read_fact(spark, path))


# ---- cost ----------------------------------------------------------------------------------------

@query
def txn_cost(spark, d):
    """Cost of each decision at the challenger threshold."""
    t = transactions(spark, d)
    declined = F.col("score") >= X.CHALLENGER_THRESHOLD
    return t.select("transaction_id", declined.alias("declined"),
                    C.decision_cost(declined, F.col("is_fraud"), F.col("transaction_amt")).alias("cost"))


@query
def threshold_sweep(spark, d):
    """Outcome counts and cost at every grid threshold, from one pass."""
    return Th.sweep(transactions(spark, d)).select("threshold", "tp", "fp", "fn", "tn", "cost")


@query
def best_threshold(spark, d):
    return Th.cheapest(Th.sweep(transactions(spark, d)))


@query
def confusion(spark, d):
    """Confusion counts and rates at four thresholds, one of them above every score."""
    o = Th.with_rates(Th.outcomes(transactions(spark, d), [0.0, X.CHALLENGER_THRESHOLD, 0.5, Th.APPROVE_ALL]))
    return o.select("threshold", "tp", "fp", "fn", "tn", "precision", "recall", "false_decline_rate", "declined", "approved")


@query
def policy_compare(spark, d):
    """Optimum, naive cut-off and both extremes."""
    return Th.compare_policies(transactions(spark, d)).select("policy", "threshold", "cost", "vs_optimum")


@query
def threshold_sensitivity(spark, d):
    return Th.sensitivity(transactions(spark, d))


@query
def dollars_caught(spark, d):
    """Dollars of bad rows declined and their share, per policy."""
    p = Th.compare_policies(transactions(spark, d))
    bad = F.col("amt_tp") + F.col("amt_fn")
    return p.select("policy", F.col("amt_tp").alias("caught"), bad.alias("bad_dollars"),
                    (100.0 * S.ratio_or_null(F.col("amt_tp"), bad)).alias("pct_caught"))


@query
def extremes(spark, d):
    """Closed forms of both extreme policies next to their swept cost."""
    p = Th.compare_policies(transactions(spark, d)).where(F.col("policy").like("% everything"))
    decline = F.col("policy") == "decline everything"
    all_declined = (F.col("amt_fp") * Decimal("0.025") + F.col("fp") * Decimal("10")
                    + (F.col("tp") + F.col("fp")) * Decimal("2"))
    all_approved = F.col("amt_fn") + F.col("fn") * Decimal("25")
    # Cast before merging: two wide decimals would otherwise meet at the coarser scale.
    closed = F.when(decline, all_declined.cast("decimal(38,6)")).otherwise(all_approved.cast("decimal(38,6)"))
    return p.select("policy", "cost", closed.alias("closed_form"), (F.col("cost") - closed).alias("difference"))


@query
def regret_1d(spark, d):
    """Regret of the baseline threshold over thirteen prices of a false decline."""
    return Th.regret(transactions(spark, d), FALSE_DECLINE_PRICES)


@query
def regret_2d(spark, d):
    """Regret surface of churn probability by lifetime value; only their product enters the cost."""
    products = sorted({c * v for c in CHURNS for v in LIFETIMES})
    r = Th.regret(transactions(spark, d), products)
    grid = spark.createDataFrame([(c, v, c * v) for c in CHURNS for v in LIFETIMES],
                                 "churn decimal(18,6), lifetime decimal(18,6), false_decline_cost decimal(18,6)")
    return grid.join(r, "false_decline_cost").select("churn", "lifetime", "optimal_threshold", "cost_at_optimum", "regret")


@query
def regret_noise_share(spark, d):
    """Share of the regret surface below the noise of the cost estimate."""
    return regret_2d(spark, d).agg((100.0 * F.avg((F.col("regret") < 9900).cast("double"))).alias("pct_below_noise"),
                                   F.min("optimal_threshold").alias("threshold_low"),
                                   F.max("optimal_threshold").alias("threshold_high"))


@query
def regret_ranges(spark, d):
    """Ends and spread of the thresholds and regrets of the surface."""
    low, high = F.min("optimal_threshold"), F.max("optimal_threshold")
    return regret_2d(spark, d).agg(low.alias("threshold_low"), high.alias("threshold_high"), F.try_divide(high, low).alias("spread"),
                                   F.min("regret").alias("regret_low"), F.max("regret").alias("regret_high"))


@query
def flip_price(spark, d):
    """The price of a false decline at which the recommendation flips."""
    return Th.flip_price(transactions(spark, d))


@query
def price_envelope(spark, d):
    """The cheapest threshold at every price of a false decline."""
    return Th.price_envelope(transactions(spark, d))


def replay(spark, d) -> DataFrame:
    return X.with_policies(keyed(spark, d).where(F.col("txn_day") >= REPLAY_FROM))


def accounts(spark, d) -> DataFrame:
    lo, hi = PRE_PERIOD
    day = F.col("txn_day")
    return X.account_frame(replay(spark, d), keyed(spark, d).where((day >= lo) & (day < hi)))


def armed(spark, d) -> DataFrame:
    """Replay rows with the arm of their account; the arm is a row expression, so no join is needed."""
    return replay(spark, d).withColumn("arm", H.arm_of())


@query
def targeted_policy(spark, d):
    """Challenger above ten risk cut-offs, champion below."""
    return Th.targeted(replay(spark, d), accounts(spark, d), X.RISK_CUTOFFS)


# ---- metrics -------------------------------------------------------------------------------------

@query
def average_precision(spark, d):
    return Q.ranking_quality(Q.score_cells(transactions(spark, d))).select("average_precision")


@query
def roc_auc(spark, d):
    return Q.ranking_quality(Q.score_cells(transactions(spark, d))).select("roc_auc", "positives", "negatives")


@query
def label_quality(spark, d):
    """Ranking quality of text length as a score for document quality labels."""
    docs = table(spark, d, "documents").select("doc_id", F.col("n_chars").cast("double").alias("score"))
    rows = table(spark, d, "labels").select("doc_id", F.col("quality").alias("is_fraud")).join(docs, "doc_id")
    return Q.ranking_quality(Q.score_cells(rows))


@query
def pr_curve(spark, d):
    """Cumulative true and false positives per distinct score."""
    return Q.curve(Q.score_cells(transactions(spark, d))).select("score", "tp", "fp")


@query
def brier(spark, d):
    return transactions(spark, d).agg(Q.brier().alias("brier"))


@query
def decile_calibration(spark, d):
    """Predicted against actual per equal-count decile."""
    return Q.decile_table(transactions(spark, d))


@query
def reliability(spark, d):
    """Reliability curve over quantile bins."""
    return Q.reliability(transactions(spark, d))


@query
def score_quantiles(spark, d):
    return Q.score_distribution(transactions(spark, d))


@query
def random_split(spark, d):
    """Random splits with the exact sizes of the time split and with a fifth held out."""
    t = transactions(spark, d)
    timed = Ev.split_sizes(t.select(S.time_split(edges=SPLIT_EDGES).alias("split")))
    parts = [Ev.random_split(t, sizes, "42").groupBy(F.lit(rule).alias("rule"), "split").agg(
        F.count("*").alias("n"), F.sum("is_fraud").alias("frauds"), F.sum("transaction_id").alias("id_sum"))
        for rule, sizes in (("size-matched", timed), ("80/20", Ev.fifth_held_out(sum(timed))))]
    return parts[0].unionByName(parts[1])


@query
def split_overlap(spark, d):
    """Share of test accounts that also occur outside the test rows, by split rule."""
    timed = keyed(spark, d).withColumn("split", S.time_split(edges=SPLIT_EDGES))
    random = Ev.random_split(timed.drop("split"), Ev.split_sizes(timed), "42")
    return Ev.account_overlap(timed).withColumn("rule", F.lit("time")).unionByName(
        Ev.account_overlap(random).withColumn("rule", F.lit("random")))


# ---- encoders ------------------------------------------------------------------------------------

@query
def category_codes(spark, d):
    """Sort-order integer code of a category, zero for missing."""
    p = table(spark, d, "part").select("p_partkey", F.when(F.col("p_partkey") % 10 != 0, F.col("p_name")).alias("p_name"))
    return E.category_codes(p, "p_name")


@query
def count_encode(spark, d):
    """Past frequency of a level, for columns with at least twenty levels in the fitted rows."""
    p = table(spark, d, "part").select("p_partkey", "p_name", "p_brand", "p_type")
    return E.count_encode(p, ["p_name", "p_brand", "p_type"], F.col("p_partkey") % 4 != 0)


@query
def one_hot(spark, d):
    """Indicator per level with an explicit null level."""
    t = transactions(spark, d).select("transaction_id", F.when(F.col("k") % 9 != 0, F.col("product_cd")).alias("product_cd"))
    return E.one_hot(t, "product_cd")[0]


@query
def median_impute(spark, d):
    """Nulls filled with medians of the training days."""
    t = transactions(spark, d).select("transaction_id", "txn_day", "card1", "addr1", "d1")
    return E.median_impute(t, ["card1", "addr1", "d1"], F.col("txn_day") < SPLIT_EDGES[0])


@query
def standardise(spark, d):
    """Columns centred and scaled by the training days."""
    t = transactions(spark, d).select("transaction_id", "txn_day", "transaction_amt", "addr1", F.lit(3).alias("flat"))
    return E.standardise(t, ["transaction_amt", "addr1", "flat"], F.col("txn_day") < SPLIT_EDGES[0])


# ---- experiment ----------------------------------------------------------------------------------

@query
def hash_uniform(spark, d):
    return keyed(spark, d).select("account_id").distinct().select(
        "account_id", H.account_uniform("account_id", X.SALT).alias("u"),
        H.account_uniform("account_id", X.SALT, "obs1.5").alias("u_tagged"))


@query
def arm_assign(spark, d):
    return keyed(spark, d).select("account_id").distinct().withColumn("arm", H.arm_of())


@query
def account_frame(spark, d):
    """One row per replayed account: both potential costs, arm, pre-period covariates."""
    return accounts(spark, d)


@query
def srm(spark, d):
    """Sample-ratio chi-square."""
    return X.sample_ratio(accounts(spark, d))


@query
def srm_verdict(spark, d):
    return X.sample_ratio_verdict(accounts(spark, d))


@query
def welch(spark, d):
    return X.welch(accounts(spark, d))


@query
def clustered_ratio(spark, d):
    """False-decline ratio of all accounts with its clustered error."""
    return X.clustered_ratio(X.declined_good_rows(armed(spark, d)), "d", "n")


@query
def guardrail(spark, d):
    return X.guardrail(armed(spark, d))


@query
def arm_metrics(spark, d):
    return X.arm_metrics(armed(spark, d))


@query
def subgroups(spark, d):
    return X.subgroup_effects(accounts(spark, d))


@query
def risk_quintiles(spark, d):
    return X.risk_quantile_effects(accounts(spark, d))


@query
def paired_effect(spark, d):
    return X.paired_effect(accounts(spark, d))


@query
def ship_decision(spark, d):
    return X.ship_decision(accounts(spark, d), armed(spark, d))


@query
def ancova_hc1(spark, d):
    """Effect adjusted for one covariate, with the HC1 error."""
    return X.ancova(accounts(spark, d), "y", ["pre_value"])


@query
def cuped_gain(spark, d):
    """Unadjusted against fully adjusted estimate."""
    return X.adjustment_gain(accounts(spark, d), "y")


@query
def smd(spark, d):
    """Standardised mean differences between the arms."""
    return X.standardised_differences(accounts(spark, d), ["n_txn", "tot_amt", "risk", "pre_value", "pre_n"],
                                      F.col("arm") == "challenger")


@query
def paired_test(spark, d):
    """Paired daily cost difference of the two policies."""
    daily = replay(spark, d).groupBy("txn_day").agg(F.sum("c_chal").alias("chal"), F.sum("c_champ").alias("champ"))
    a = daily.select("txn_day", F.col("chal").alias("cost"))
    b = daily.select("txn_day", F.col("champ").alias("cost"))
    return X.paired_test(a, b, "txn_day", "cost")


@query
def cost_clustering(spark, d):
    """Intra-account correlation of row cost and the design effect."""
    return G.clustering(replay(spark, d), "c_champ")


@query
def detectable_effect(spark, d):
    """Error of the arm difference and smallest detectable effect."""
    return G.detectable_effect(accounts(spark, d))


@query
def covariate_value(spark, d):
    """Variance each pre-period covariate would remove."""
    return G.covariate_value(accounts(spark, d), ["pre_value", "pre_n", "pre_fraud", "pre_mean_amt"])


@query
def risk_explained(spark, d):
    """Share of account risk explained by nested covariate sets."""
    acc = pinned(accounts(spark, d))
    pre = ["pre_value", "pre_n", "pre_fraud", "has_pre_period"]
    sets = {"account size": ["n_txn"], "pre-period": pre, "pre-period and size": [*pre, "n_txn", "tot_amt"]}
    return spark.createDataFrame([(name, G.explained_share(acc, "risk", cols)) for name, cols in sets.items()],
                                 "covariates string, r_squared double")


@query
def expected_cost_rule(spark, d):
    """Per-row expected-cost rule against the challenger threshold."""
    rows = replay(spark, d).withColumn("c_rule", C.decision_cost(
        G.expected_cost_decline(), F.col("is_fraud"), F.col("transaction_amt")))
    return G.rule_against_threshold(rows, "c_chal", "c_rule")


# ---- bootstrap -----------------------------------------------------------------------------------

@query
def boot_cost_diff(spark, d):
    """Replicates of the paired cost difference of two policies."""
    return B.cost_difference(replay(spark, d), "c_chal", "c_champ")


@query
def boot_mean_diff(spark, d):
    """Replicates of the difference of arm means."""
    return B.mean_difference(accounts(spark, d))


@query
def boot_metric(spark, d):
    """Replicates of average precision, ROC area and Brier score."""
    return B.metric_replicates(transactions(spark, d))


@query
def bca(spark, d):
    """Bias-corrected and accelerated interval of the primary effect."""
    return B.bca_interval(pinned(accounts(spark, d)))


@query
def boot_cost_interval(spark, d):
    return B.percentile_interval(B.cost_difference(replay(spark, d), "c_chal", "c_champ"), "diff")


# ---- causal --------------------------------------------------------------------------------------

def over_strengths(spark, d, job) -> DataFrame:
    """`job` on the rollout of every strength, one below the other."""
    frame = M.settled(M.with_z(accounts(spark, d)))
    return reduce(DataFrame.unionByName, [
        job(M.settled(M.ramp_assignment(frame, b))).withColumn("beta", F.lit(float(b))) for b in M.BETAS])


def on_risk(spark, d) -> DataFrame:
    """Assigned by the arm hash and matched on risk itself, so that SQL can repeat it."""
    return M.settled(accounts(spark, d).select(
        "account_id", F.col("risk").alias("logit"), F.when(F.col("arm") == "challenger", 1).otherwise(0).alias("t"),
        F.col("y").alias("y_obs"), "n_txn", "tot_amt", "tau"))


@query
def ramp_assign(spark, d):
    """Treatment steered by account risk, at every strength."""
    return over_strengths(spark, d, lambda rolled: rolled.select("account_id", "t"))


@query
def naive_att_ate(spark, d):
    """True effects and the naive difference, at every strength."""
    return over_strengths(spark, d, M.effect_summary)


@query
def nn_match(spark, d):
    """Nearest control per treated account with caliper and support rule."""
    return M.match(on_risk(spark, d))


@query
def match_counts(spark, d):
    return M.match_summary(M.match(on_risk(spark, d)))


@query
def balance(spark, d):
    """Standardised differences before and after matching."""
    frame = on_risk(spark, d)
    return M.balance(frame, M.match(frame), ["logit", "n_txn", "tot_amt"])


def matched_pairs(spark, d) -> DataFrame:
    frame = on_risk(spark, d)
    return M.pair_differences(M.match(frame), frame)


@query
def boot_att(spark, d):
    """Replicates of the matched effect."""
    return B.att_replicates(matched_pairs(spark, d))


@query
def rosenbaum(spark, d):
    """Signed-rank z scores under hidden bias."""
    return M.sensitivity_z(matched_pairs(spark, d))


@query
def rosenbaum_bounds(spark, d):
    return M.sensitivity_bounds(matched_pairs(spark, d))


@query
def pair_concentration(spark, d):
    """How much of the effect sits in few pairs."""
    return M.pair_concentration(pinned(matched_pairs(spark, d)))


@query
def first_attributes(spark, d):
    """First known value per account and column."""
    rows = keyed(spark, d).select("account_id", "transaction_id", "transaction_amt", "d1",
                                  F.when(F.col("k") % 3 != 0, F.col("product_cd")).alias("product_cd"))
    return M.first_known(rows, ["transaction_amt", "d1", "product_cd"])


@query
def overlap_hist(spark, d):
    """Score overlap of the arms in forty bins."""
    return M.overlap_histogram(on_risk(spark, d).withColumnRenamed("logit", "propensity"))


@query
def bias_pivot(spark, d):
    """Bias of three estimators by ramp strength, pivoted; rows are matched on the risk that steered them."""
    frame = pinned(M.with_z(accounts(spark, d)))
    rows = None
    for beta in M.BETAS:
        rolled = M.settled(M.ramp_assignment(frame, beta).withColumn("logit", F.col("risk")))
        pairs = M.pair_differences(M.match(rolled), rolled)
        matched = pairs.agg(S.mean_of(F.sum("diff"), F.count("diff")).alias("estimate"))
        s = M.effect_summary(rolled).withColumn("matched", matched.scalar())
        part = s.select(F.lit(float(beta)).alias("beta"), F.explode(F.array(
            F.struct(F.lit("naive").alias("estimator"), F.col("bias_vs_att").alias("bias")),
            F.struct(F.lit("naive_vs_ate").alias("estimator"), F.col("bias_vs_ate").alias("bias")),
            F.struct(F.lit("matched").alias("estimator"), (F.col("matched") - F.col("att")).alias("bias")))).alias("r"))
        rows = part if rows is None else rows.unionByName(part)
    return rows.select("beta", "r.*").groupBy("beta").pivot("estimator", ["naive", "naive_vs_ate", "matched"]).agg(F.first("bias"))


# ---- calibration and ranking tables ----------------------------------------------------------------

@query
def isotonic_bins(spark, d):
    """Isotonic rate of twenty-five score bins."""
    from tollgate.operators.calibrate import fit_isotonic
    t = transactions(spark, d).withColumn("bin", (F.floor(F.col("score") * 25) / 25))
    model = fit_isotonic(t, "bin", "is_fraud", "rate")
    return model.transform(t.select("bin").distinct())


@query
def ranked_share(spark, d):
    """Share and running share of dollars per day, largest first, top ten kept."""
    from tollgate.plans.training import ranked_share as ranked
    daily = transactions(spark, d).groupBy("txn_day").agg(F.sum("transaction_amt").alias("amount"))
    return ranked(daily, "txn_day", "amount").orderBy(F.desc("amount"), "txn_day").limit(10)
