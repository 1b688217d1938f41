from decimal import Decimal

import numpy as np
import pytest
from pyspark.sql import functions as F

from tollgate.functions.costs import DEFAULT_COSTS, decision_cost, threshold_grid
from tollgate.functions.hashing import poisson_cuts, poisson_weights
from tollgate.operators import metrics as Q
from tollgate.operators import ordering as O
from tollgate.operators import skew
from tollgate.operators import thresholds as Th

SCHEMA = "transaction_id long, score double, is_fraud int, transaction_amt decimal(18,3)"


@pytest.fixture(scope="module")
def scored(spark):
    rng = np.random.default_rng(3)
    rows = [(i, float(round(s, 2)), int(y), Decimal(str(round(a, 2))))
            for i, (s, y, a) in enumerate(zip(rng.random(400), rng.random(400) < 0.2, rng.random(400) * 100))]
    return spark.createDataFrame(rows, SCHEMA).persist(), rows


def _cost(rows, t):
    total = Decimal(0)
    for _, s, y, a in rows:
        if s >= t:
            total += (0 if y else a * Decimal("0.025") + 10) + 2
        elif y:
            total += a + 25
    return total


def test_costs_of_the_four_outcomes(spark):
    df = spark.createDataFrame([(True, 1), (True, 0), (False, 1), (False, 0)], "d boolean, y int")
    got = [r[0] for r in df.select(decision_cost(F.col("d"), F.col("y"), F.lit(Decimal("100")))).collect()]
    assert got == [Decimal("2"), Decimal("14.5"), Decimal("125"), Decimal("0")]


def test_sweep_matches_direct_pricing_and_equal_score_is_declined(scored):
    df, rows = scored
    thresholds = [0.0, 0.1, 0.25, 0.5, 0.75, 1.01]
    got = {r["threshold"]: r for r in Th.sweep(df, thresholds).collect()}
    for t in thresholds:
        assert got[t]["cost"] == _cost(rows, t)
        assert got[t]["tp"] == sum(1 for _, s, y, _a in rows if s >= t and y)
    assert got[0.0]["fn"] == 0 and got[1.01]["tp"] + got[1.01]["fp"] == 0


def test_grid_and_best_threshold(scored):
    df, rows = scored
    grid = threshold_grid()
    assert len(grid) == 1388 and grid == sorted(set(grid)) and (grid[0], round(grid[-1], 9)) == (0.001, 0.99)
    t, cost = Th.best_threshold(df)
    direct = [(_cost(rows, g), g) for g in grid]
    assert (cost, t) == min(direct)


def test_extreme_policies_have_closed_forms(scored):
    df, rows = scored
    got = {r["policy"]: r["cost"] for r in Th.compare_policies(df).collect()}
    good = sum(a for _, _s, y, a in rows if not y)
    assert got["decline everything"] == good * Decimal("0.025") + 10 * sum(1 for r in rows if not r[2]) + 2 * len(rows)
    assert got["approve everything"] == sum(a + 25 for _, _s, y, a in rows if y)
    assert got["optimum"] <= min(got.values())


def test_regret_is_zero_at_the_baseline_price_and_never_negative(scored):
    df, _ = scored
    got = {r["false_decline_cost"]: r["regret"] for r in Th.regret(df, [Decimal(1), Decimal(10), Decimal(50)]).collect()}
    assert got[DEFAULT_COSTS.false_decline.quantize(Decimal("0.000001"))] == 0 and min(got.values()) >= 0


def test_rates_are_null_without_a_denominator(spark):
    df = spark.createDataFrame([(1, 0.2, 0, Decimal(5))], SCHEMA)
    r = Th.with_rates(Th.outcomes(df, [0.5])).first()
    assert r["precision"] is None and r["recall"] is None and r["false_decline_rate"] == 0


def _average_precision(pairs):
    total, seen, hits, out = sum(y for _, y in pairs), 0, 0, 0.0
    for s in sorted({s for s, _ in pairs}, reverse=True):
        group = [y for t, y in pairs if t == s]
        seen, hits = seen + len(group), hits + sum(group)
        out += sum(group) / total * hits / seen
    return out


def test_ranking_quality_against_brute_force(scored):
    df, rows = scored
    got = Q.ranking_quality(Q.score_cells(df)).first()
    pairs = [(s, y) for _, s, y, _a in rows]
    pos, neg = [s for s, y in pairs if y], [s for s, y in pairs if not y]
    wins = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg)
    assert got["average_precision"] == pytest.approx(_average_precision(pairs), abs=1e-12)
    assert got["roc_auc"] == pytest.approx(wins / len(pos) / len(neg), abs=1e-12)


def test_one_score_for_all_rows_gives_base_rate_and_half(spark):
    df = spark.createDataFrame([(i, 0.3, int(i < 2), Decimal(1)) for i in range(8)], SCHEMA)
    got = Q.ranking_quality(Q.score_cells(df)).first()
    assert got["average_precision"] == pytest.approx(0.25) and got["roc_auc"] == pytest.approx(0.5)


def test_equal_count_bins_are_not_ntiles(spark):
    df = spark.range(1, 94637).select(O.equal_count_bin(F.col("id"), 94636, 10).alias("b")).groupBy("b").count()
    assert [r["count"] for r in df.orderBy("b").collect()][:5] == [9464, 9464, 9463, 9464, 9463]
    one = spark.range(1, 2).select(O.equal_count_bin(F.col("id"), 1, 5)).first()[0]
    assert one == 1


def test_running_totals_over_many_ranges(spark):
    df = spark.range(0, 5000).select((F.col("id") * 7919 % 5000).alias("v"), (F.col("id") % 3).alias("g"), F.lit(2).alias("w"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # keep every range apart
    try:
        got = O.running_totals(df, [F.col("v")], {"t": F.col("w")}).collect()
        by_group = O.running_totals(df, [F.col("v")], {"t": F.col("w")}, ["g"]).collect()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert all(r["t"] == 2 * r["v"] and r["t_all"] == 10000 for r in got)
    for g in range(3):
        mine = sorted((r["v"], r["t"]) for r in by_group if r["g"] == g)
        assert [t for _, t in mine] == [2 * i for i in range(len(mine))]


def test_exact_quantiles_match_interpolation(spark):
    rng = np.random.default_rng(5)
    values = np.round(rng.random(777), 2)
    df = spark.createDataFrame([(float(v),) for v in values] + [(None,)], "v double")
    probs = [0.0, 0.025, 0.5, 0.9, 1.0]
    got = {r["prob"]: r["quantile"] for r in O.exact_quantiles(df, "v", probs).collect()}
    for p in probs:
        assert got[p] == pytest.approx(np.quantile(values, p), abs=1e-12)


def test_nearest_values_across_ranges(spark):
    rng = np.random.default_rng(9)
    rows = [(f"id{i:04d}", float(round(v, 2)), bool(c)) for i, (v, c) in enumerate(zip(rng.random(600), rng.random(600) < 0.3))]
    df = spark.createDataFrame(rows, "id string, v double, c boolean")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = O.nearest_values(df, "v", "c", "id").collect()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    anchors = [(v, i) for i, v, c in rows if c]
    for r in got:
        below, above = [a for a in anchors if a[0] < r["v"]], [a for a in anchors if a[0] >= r["v"]]
        assert (r["below_value"], r["below"]) == (max(below) if below else (None, None))
        assert (r["above_value"], r["above"]) == (min(above) if above else (None, None))


def test_poisson_weights_have_unit_mean_and_variance(spark):
    assert len(poisson_cuts()) == 12
    df = spark.range(20000).select(*[w.alias(f"w{i}") for i, w in enumerate(poisson_weights("s", F.lit(0), F.col("id")))])
    row = df.agg(*[f(f"w{i}").alias(f"{n}{i}") for i in range(4) for n, f in (("m", F.avg), ("v", F.var_samp))]).first()
    assert all(abs(row[f"{n}{i}"] - 1) < 0.05 for i in range(4) for n in "mv")


@pytest.mark.parametrize("how", ["left", "inner", "left_semi", "left_anti"])
def test_salted_join_equals_broadcast_join(spark, how):
    df = spark.createDataFrame([(i, "hot" if i % 3 else f"k{i % 7}") for i in range(200)] + [(999, None)], "id long, k string")
    keys = spark.createDataFrame([("hot", 1), ("k0", 2), ("k3", 3)], "k string, v int")
    small, plain, salted = (skew.join_keys(df, keys, "k", how, **kw) for kw in ({}, {"limit": 1}, {"limit": 1, "salts": 4, "hot_rows": 20}))
    assert small.columns == plain.columns == salted.columns
    assert sorted(map(repr, small.collect())) == sorted(map(repr, plain.collect())) == sorted(map(repr, salted.collect()))


def test_only_keys_of_many_rows_are_salted_and_only_small_tables_broadcast(spark):
    df = spark.createDataFrame([(i, "hot" if i % 3 else f"k{i}") for i in range(300)] + [(999, None)], "id long, k string")
    keys = df.select("k").distinct().withColumn("v", F.lit(1))

    def plan(out):
        return out._jdf.queryExecution().optimizedPlan().toString()

    assert "__salt" in plan(skew.join_keys(df, keys, "k", limit=1, hot_rows=100)) and "__salt" not in plan(skew.join_keys(df, keys, "k", limit=1))
    assert "broadcast" in plan(skew.join_keys(df, keys, "k")) and "broadcast" not in plan(skew.join_keys(df, keys, "k", limit=1))
    wide = keys.withColumn("v", F.repeat(F.lit("x"), 1000))
    size = keys.agg(F.sum(skew.row_bytes(keys))).first()[0]
    assert wide.agg(F.sum(skew.row_bytes(wide))).first()[0] >= size + 1000 * keys.count()
    assert skew.join_keys(df, keys, "k", "inner", limit=1, hot_rows=100).count() == 300


def test_decile_and_reliability_tables_cover_all_rows(scored):
    df, rows = scored
    assert [r["n"] for r in Q.decile_table(df).orderBy("bin").collect()] == [40] * 10
    assert sum(r["n"] for r in Q.reliability(df).collect()) == len(rows)


def test_flip_price_and_envelope_equal_a_search_over_prices(spark, sf):
    from decimal import Decimal

    from tollgate.functions.costs import threshold_grid
    from tollgate.operators import thresholds as Th
    from tollgate.sources.canonical import transactions

    rows = transactions(spark, sf)
    lines = [(r["threshold"], r["slope"], r["intercept"]) for r in Th.cost_lines(rows).collect()]
    pieces = sorted(map(tuple, Th.price_envelope(rows).collect()))
    assert pieces[0][0] == 0 and pieces[-1][1] is None and all(a[1] == b[0] for a, b in zip(pieces, pieces[1:]))
    for price in (Decimal(k) / 7 for k in range(0, 3000, 13)):
        least = min((c + s * price, t) for t, s, c in lines)
        (piece,) = [p for p in pieces if p[0] <= price and (p[1] is None or price < p[1])]
        at = {t: c + s * price for t, s, c in lines}[piece[2]]
        assert abs(at - least[0]) < Decimal("1e-6")
    r = Th.flip_price(rows).first()
    half = Th.cost_lines(rows, thresholds=sorted({*threshold_grid(), 0.5})).where("threshold = 0.5").first()
    base = next(x for x in lines if x[0] == r["baseline_threshold"])
    if r["flip_price"] is not None:
        for price, sign in ((r["flip_price"] * 0.99, 1), (r["flip_price"] * 1.01, -1)):
            saving = float(half["intercept"] - base[2]) + price * (half["slope"] - base[1])
            assert saving * sign >= 0
