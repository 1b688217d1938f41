import math
from decimal import Decimal

import numpy as np
import pytest
from pyspark.sql import functions as F

from tollgate.functions.hashing import account_uniform
from tollgate.operators import bootstrap as B
from tollgate.operators import encoders as E
from tollgate.operators import experiment as X
from tollgate.operators import matching as M


@pytest.fixture(scope="module")
def frame(spark):
    rng = np.random.default_rng(1)
    rows = []
    for i in range(300):
        champ, chal = float(round(rng.gamma(1, 20), 2)), float(round(rng.gamma(1, 18), 2))
        arm = "challenger" if rng.random() < 0.5 else "champion"
        rows.append((f"a{i:03d}", arm, champ, chal, chal if arm == "challenger" else champ, chal - champ,
                     float(round(rng.random(), 3)), float(rng.normal())))
    df = spark.createDataFrame(rows, "account_id string, arm string, c double, d double, e double, f double, risk double, x double")
    money = {n: F.col(s).cast("decimal(18,6)") for n, s in (("y_champ", "c"), ("y_chal", "d"), ("y", "e"), ("tau", "f"))}
    return df.withColumns(money).drop("c", "d", "e", "f").persist(), rows


def _arms(rows):
    return (np.array([r[4] for r in rows if r[1] == "challenger"]), np.array([r[4] for r in rows if r[1] != "challenger"]))


def test_hash_uniform_is_the_documented_text(spark):
    import hashlib
    df = spark.createDataFrame([("F|1|2|3",)], "account_id string")
    for tag, text in (("", "s:F|1|2|3"), ("obs0.5", "s:obs0.5:F|1|2|3")):
        got = df.select(account_uniform("account_id", "s", tag)).first()[0]
        assert got == int(hashlib.md5(text.encode()).hexdigest()[:12], 16) / 16 ** 12


def test_welch_against_numpy(frame):
    df, rows = frame
    a, b = _arms(rows)
    got = X.welch(df).first()
    assert got["diff"] == pytest.approx(a.mean() - b.mean(), abs=1e-9)
    assert got["se"] == pytest.approx(math.sqrt(a.var(ddof=1) / len(a) + b.var(ddof=1) / len(b)), rel=1e-9)


def test_ancova_against_direct_normal_equations(frame):
    df, rows = frame
    y = np.array([r[4] for r in rows])
    t = np.array([1.0 if r[1] == "challenger" else 0.0 for r in rows])
    d = np.column_stack([np.ones(len(y)), t, [r[7] for r in rows], [r[6] for r in rows]])
    beta, *_ = np.linalg.lstsq(d, y, rcond=None)
    e, inv = y - d @ beta, np.linalg.inv(d.T @ d)
    cov = inv @ (d.T * e ** 2 @ d) @ inv * len(y) / (len(y) - 4)
    got = X.ancova(df, "y", ["x", "risk"]).first()
    assert got["effect"] == pytest.approx(beta[1], rel=1e-8) and got["se"] == pytest.approx(math.sqrt(cov[1, 1]), rel=1e-8)


def test_clustered_ratio_and_smd(spark, frame):
    clusters = spark.createDataFrame([(1, 3), (0, 2), (2, 2), (1, 9)], "d long, n long")
    r = X.clustered_ratio(clusters, "d", "n").first()
    d, n = np.array([1, 0, 2, 1]), np.array([3, 2, 2, 9])
    resid = d - d.sum() / n.sum() * n
    assert r["se"] == pytest.approx(math.sqrt((resid ** 2).sum() * 4 / 3) / n.sum())
    df, rows = frame
    got = {x["covariate"]: x["smd"] for x in X.standardised_differences(
        df.withColumn("flat", F.lit(2.0)), ["x", "flat"], F.col("arm") == "challenger").collect()}
    a, b = (np.array([r[7] for r in rows if (r[1] == "challenger") == f]) for f in (True, False))
    assert got["x"] == pytest.approx((a.mean() - b.mean()) / math.sqrt((a.var(ddof=1) + b.var(ddof=1)) / 2))
    assert got["flat"] == 0.0


def test_srm_and_paired_test(spark, frame):
    df, rows = frame
    k = sum(r[1] == "challenger" for r in rows)
    got = X.sample_ratio_verdict(df).first()
    assert got["chi2"] == pytest.approx(2 * (k - 150) ** 2 / 150)
    assert got["p_value"] == pytest.approx(math.erfc(math.sqrt(got["chi2"] / 2)))
    one = spark.createDataFrame([(1, 5.0)], "fold int, cost double")
    r = X.paired_test(one, one, "fold", "cost").first()
    assert r["se"] is None and r["t"] is None and r["n"] == 1


def test_bca_agrees_with_the_direct_formula(frame):
    df, rows = frame
    a, b = _arms(rows)
    got = B.bca_interval(df, replicates=400).first()
    assert got["observed"] == pytest.approx(a.mean() - b.mean(), abs=1e-9)
    assert got["ci_low"] < got["observed"] < got["ci_high"]
    se = X.welch(df).first()["se"]
    assert (got["ci_high"] - got["ci_low"]) / (2 * 1.96 * se) == pytest.approx(1, abs=0.2)


def test_replicates_do_not_depend_on_partitioning(frame):
    df, _ = frame
    one = B.mean_difference(df.coalesce(1), replicates=6).orderBy("rep").collect()
    many = B.mean_difference(df.repartition(7), replicates=6).orderBy("rep").collect()
    assert one == many and [r["rep"] for r in one] == list(range(6))


def test_ramp_reaches_half_and_is_monotone(frame):
    df, rows = frame
    z = M.with_z(df)
    alpha = M.ramp_intercept(z, "z", 1.5)
    got = z.agg(F.avg(1 / (1 + F.exp(-(F.lit(alpha) + 1.5 * F.col("z")))))).first()[0]
    assert got == pytest.approx(0.5, abs=1e-10)
    t = M.ramp_assignment(z, 3.0)
    means = {r["t"]: r["m"] for r in t.groupBy("t").agg(F.avg("z").alias("m")).collect()}
    assert means[1] > means[0]


def _units(spark, rows):
    return spark.createDataFrame(rows, "account_id string, t int, logit double, y_obs decimal(18,6)")


def test_matching_edges(spark):
    d = Decimal
    df = _units(spark, [("c1", 0, 0.0, d(1)), ("c2", 0, 1.0, d(2)), ("c3", 0, 1.0, d(3)), ("c4", 0, 2.0, d(4)),
                        ("t1", 1, 0.5, d(9)), ("t2", 1, 1.0, d(9)), ("t3", 1, 1.2, d(9)), ("t4", 1, -0.1, d(9)), ("t5", 1, 2.1, d(9))])
    got = {r["account_id"]: (r["control_id"], r["outcome"]) for r in M.match(df, caliper_sd=10.0).collect()}
    assert got["t1"] == ("c1", "matched")  # equal distance: lower neighbour
    assert got["t2"] == ("c2", "matched")  # at or above: first id
    assert got["t3"] == ("c3", "matched")  # below: last id
    assert got["t4"][1] == got["t5"][1] == "off_support"
    tight = {r["account_id"]: r["outcome"] for r in M.match(df, caliper_sd=0.1).collect()}
    assert tight["t1"] == "off_caliper" and tight["t2"] == "matched"


def test_signed_rank_bounds_and_small_samples(spark):
    diffs = [-5, -3, -3, 2, -1, -4, 0, -6, 1, -2, -7, 3]
    pairs = spark.createDataFrame([(str(i), Decimal(x)) for i, x in enumerate(diffs)], "account_id string, diff decimal(18,6)")
    nz = [x for x in diffs if x]
    size = sorted(abs(x) for x in nz)
    rank = {v: np.mean([i + 1 for i, s in enumerate(size) if s == v]) for v in size}
    r = M.signed_ranks(pairs).first()
    assert (r["pairs"], r["w"], r["s"]) == (11, sum(rank[abs(x)] for x in nz if x < 0), sum(rank[abs(x)] for x in nz))
    b = M.sensitivity_bounds(pairs).orderBy("gamma").collect()
    assert b[0]["p_upper_bound"] == b[0]["p_lower_bound"]
    assert all(b[i]["p_upper_bound"] >= b[i + 1]["p_upper_bound"] and b[i]["p_lower_bound"] <= b[i + 1]["p_lower_bound"]
               for i in range(len(b) - 1))
    assert M.sensitivity_z(pairs.limit(9)).isEmpty()
    c = M.pair_concentration(pairs).first()
    assert c["top1pct_share"] == pytest.approx(100 * 7 / 37) and c["median_diff"] == -2.5


def test_first_known_value_is_per_column(spark):
    rows = spark.createDataFrame([("a", 2, "x", None), ("a", 1, None, 5), ("a", 3, "y", 6)], "account_id string, transaction_id int, p string, q int")
    assert tuple(M.first_known(rows, ["p", "q"]).first()) == ("a", "x", 5)


def test_encoders_on_unseen_and_missing_levels(spark):
    df = spark.createDataFrame([(1, "b", True), (2, "a", True), (3, "b", True), (4, "zz", False), (5, None, False)], "id int, c string, fit boolean")
    codes = {r["id"]: r["c_code"] for r in E.category_codes(df, "c").collect()}
    assert codes == {1: 2, 2: 1, 3: 2, 4: 3, 5: 0}
    counts = {r["id"]: r["c_cnt"] for r in E.count_encode(df, ["c"], F.col("fit"), min_levels=2).collect()}
    assert counts == {1: 2, 2: 1, 3: 2, 4: None, 5: None}
    assert "c_cnt" not in E.count_encode(df, ["c"], F.col("fit"), min_levels=3).columns
    hot, cols = E.one_hot(df, "c")
    assert cols == ["c_a", "c_b", "c_zz", "c_null"] and hot.agg(F.sum("c_null")).first()[0] == 1
    wide, cols = E.one_hot(df, "c", F.col("fit"), max_levels=1)
    assert cols == ["c_cnt"] and {r["id"]: r["c_cnt"] for r in wide.collect()}[1] == 2


def test_median_and_scaling_are_fitted_on_the_past(spark):
    df = spark.createDataFrame([(1, 1.0, True), (2, None, True), (3, 4.0, True), (4, 100.0, False), (5, 2.0, True)], "id int, v double, fit boolean")
    filled = {r["id"]: r["v"] for r in E.median_impute(df, ["v"], F.col("fit")).collect()}
    assert filled[2] == 2.0 and filled[4] == 100.0
    scaled = {r["id"]: r["v"] for r in E.standardise(df, ["v"], F.col("fit")).collect()}
    past = np.array([1.0, 4.0, 2.0])
    assert scaled[4] == pytest.approx((100 - past.mean()) / past.std(ddof=1)) and scaled[2] == 0.0
