from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tollgate.functions import keys as K
from tollgate.functions import scalars as S
from tollgate.operators import quality
from tollgate.operators import velocity as V
from tollgate.plans import marts
from tollgate.session import pinned

ROWS = "transaction_id long, card1 long, addr1 double, d1 double, txn_day long"


def test_every_null_pattern_gets_its_tier(spark):
    df = spark.createDataFrame([
        (1, 10, 20.0, 3.0, 9), (2, 10, None, 3.0, 9), (3, 10, 20.0, None, 9), (4, 10, None, None, 9),
        (5, None, 20.0, 3.0, 9), (6, None, None, 3.0, 9), (7, None, 20.0, None, 9), (8, None, None, None, 9)], ROWS)
    account, tier = K.account_key()
    got = {r[0]: (r[1], r[2]) for r in df.select("transaction_id", account, tier).collect()}
    assert got[1] == ("F|10|20|6", "full")
    assert got[2] == ("N|10|6", "no_addr")
    assert got[3] == ("D|10|20", "no_card_start")
    assert got[4] == ("C|10", "card_only")
    for i in (5, 6, 7, 8):
        assert got[i] == (f"X|{i}", "singleton")


def test_key_parts_round_half_away_from_zero(spark):
    df = spark.createDataFrame([(2.5,), (-2.5,), (2.4,)], "x double")
    assert [r[0] for r in df.select(K.whole_number(F.col("x"))).collect()] == [3, -3, 2]


def test_prefix_key_is_cut_at_the_first_null(spark):
    df = spark.createDataFrame([(1, 10, None, 3.0, 9), (2, None, 5.0, 3.0, 9), (3, 10, 5.0, 3.0, 9)], ROWS)
    account, tier = K.prefix_key([F.col("card1"), K.whole_number(F.col("addr1")), K.card_start_day()], "E")
    got = [tuple(r) for r in df.select(account, tier).collect()]
    assert got == [("E1|10", "depth_1"), ("X|2", "singleton"), ("E3|10|5|6", "depth_3")]
    flags = df.select(K.is_degraded(tier)).collect()
    assert all(r[0] for r in flags)


def _stream(spark, rows):
    return spark.createDataFrame([(i, a, t, Decimal(x)) for i, (a, t, x) in enumerate(rows)],
                                 "transaction_id long, account_id string, transaction_dt long, transaction_amt decimal(18,3)")


EDGES = [("a", 100, "5"), ("a", 100, "7"), ("a", 3700, "1"), ("a", 3701, "2"), ("a", 86501, "4"), ("b", 5, "9"),
         ("z", 1, "0"), ("z", 2, "3")]


def _brute(rows):
    out = []
    for i, (a, t, x) in enumerate(rows):
        prior = [(u, Decimal(y)) for b, u, y in rows if b == a and u < t]
        within = [sum(1 for u, _ in prior if u >= t - w) for w in (3600, 86400, 604800)]
        out.append((i, len(prior), sum(y for _, y in prior) if prior else None, *within, max((u for u, _ in prior), default=None)))
    return out


@pytest.mark.parametrize("plan", ["window", "slots", "mixed"])
def test_lookback_equals_brute_force(spark, plan):
    df = _stream(spark, EDGES)
    out = {"window": lambda: V.velocity(df), "slots": lambda: V.velocity_by_slots(df, slot_seconds=500),
           "mixed": lambda: V.velocity(df, hot_rows=2, slot_seconds=1000)}[plan]()
    got = [tuple(r) for r in out.orderBy("transaction_id").select(
        "transaction_id", "prior_txn_count", "prior_amt_sum", "txn_count_1h", "txn_count_24h", "txn_count_7d",
        "prev_transaction_dt").collect()]
    assert got == _brute(EDGES)


def test_same_second_rows_do_not_see_each_other_and_zero_mean_gives_no_ratio(spark):
    got = {r["transaction_id"]: r for r in V.velocity(_stream(spark, EDGES)).collect()}
    assert got[0]["prior_txn_count"] == got[1]["prior_txn_count"] == 0
    assert got[0]["prior_amt_sum"] is None and got[0]["seconds_since_prev_txn"] is None
    assert got[2]["txn_count_1h"] == 2 and got[3]["txn_count_1h"] == 1
    assert got[7]["prior_amt_mean"] == 0 and got[7]["amt_to_prior_mean_ratio"] is None


def test_lookback_plan_is_one_window_behind_one_exchange(spark, sf):
    from tollgate.sources.canonical import keyed
    plan = V.velocity(keyed(spark, sf))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and plan.count("Window [") == 1


def test_quality_checks_find_planted_faults(spark):
    fact = V.velocity(_stream(spark, EDGES))
    assert quality.leaking_first_rows(fact).isEmpty()
    assert quality.window_mismatches(fact).isEmpty()
    broken = fact.withColumn("prior_txn_count", F.col("prior_txn_count") + 1)
    assert quality.leaking_first_rows(broken).count() == 3
    assert quality.window_mismatches(broken).count() == len(EDGES)
    assert quality.duplicates(fact, "account_id").count() == 2
    assert quality.wrong_row_count(fact, 8).isEmpty() and quality.wrong_row_count(fact, 9).count() == 1
    assert quality.nulls(fact, "prior_amt_sum").count() == 4
    assert [r["value"] for r in quality.unexpected_values(fact, "account_id", ["a", "b"]).collect()] == ["z"]


def test_first_row_check_prunes_before_the_exchange(spark, sf):
    from tollgate.sources.canonical import keyed
    plan = quality.leaking_first_rows(V.velocity(keyed(spark, sf)))._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan


def test_clock_and_split(spark):
    df = spark.createDataFrame([(90061, 1), (0, 0)], "transaction_dt long, txn_day long")
    got = [tuple(r) for r in df.select(S.day_of(), S.hour_of(), S.weekday_of(), S.time_split(edges=(1, 2, 3))).collect()]
    assert got == [(1, 1, 1, "early_stop"), (0, 0, 0, "train")]


def _days(spark, rows):
    return spark.createDataFrame(
        [(i, t, t // 86400, Decimal(x), 0, "p", 1, 1.0, None) for i, t, x in rows],
        "transaction_id long, transaction_dt long, txn_day long, transaction_amt decimal(18,3), is_fraud int, "
        "product_cd string, card1 long, addr1 double, d1 double")


def test_incremental_load_equals_full_build_and_ignores_late_rows(spark, tmp_path):
    path = str(tmp_path / "fact")
    rows = [(1, 10, "1"), (2, 86410, "2"), (3, 86420, "3"), (4, 2 * 86400, "4")]
    marts.load_new_days(_days(spark, rows[:1]), path)
    assert marts.load_new_days(_days(spark, rows[:3]), path) == 1
    assert marts.load_new_days(_days(spark, rows), path) == 2
    marts.load_new_days(_days(spark, rows), path)  # nothing new
    cols = ["transaction_id", "prior_txn_count", "prior_amt_sum", "txn_count_24h"]
    full = sorted(map(tuple, marts.build_fact(_days(spark, rows)).select(*cols).collect()))
    assert sorted(map(tuple, marts.read_fact(spark, path, cols).collect())) == full
    late = rows + [(5, 20, "9")]
    marts.load_new_days(_days(spark, late), path)
    assert marts.read_fact(spark, path).count() == 4
    marts.load_new_days(_days(spark, late), path, reprocess_from=0)
    assert marts.read_fact(spark, path).count() == 5
    assert marts.read_fact(spark, path).where("transaction_id = 4").first()["prior_txn_count"] == 4


def test_increments_carry_the_state_of_older_days(spark, tmp_path, monkeypatch):
    """Loads far apart equal a full build; only days after the stored state are summed up, and a late row makes it invalid."""
    path, summed = str(tmp_path / "fact"), []
    honest = marts.history_sums

    def watched(rows):
        summed.append([r["txn_day"] for r in rows.select("txn_day").distinct().orderBy("txn_day").collect()])
        return honest(rows)

    monkeypatch.setattr(marts, "history_sums", watched)
    rows = [(i, i * 31_000 % (40 * 86400), str(i % 9) + ".5") for i in range(1, 400)]
    cols = ["transaction_id", "prior_txn_count", "prior_amt_sum", "prior_amt_mean", "txn_count_1h", "txn_count_7d", "seconds_since_prev_txn"]

    def loaded(df, last):
        assert marts.load_new_days(df.where(f"txn_day <= {last}"), path) == last
        return sorted(map(tuple, marts.read_fact(spark, path, cols).collect()))

    df = pinned(_days(spark, rows))
    full = sorted(map(tuple, marts.build_fact(df).select(*cols).collect()))
    loaded(df, 12)
    loaded(df, 20)
    loaded(df, 30)
    assert loaded(df, 39) == full
    assert [(d[0], d[-1]) for d in summed] == [(0, 5), (6, 13), (14, 23)]
    late = pinned(df.unionByName(_days(spark, [(900, 2 * 86400 + 5, "7"), (901, 40 * 86400, "8")])))
    marts.load_new_days(late, path)
    assert summed[-1][0] == 0  # the late row is in no stored state
    row = marts.read_fact(spark, path).where("transaction_id = 901").first()
    assert row["prior_txn_count"] == 400 and marts.read_fact(spark, path).where("transaction_id = 900").isEmpty()


def test_new_row_with_a_stored_id_replaces_the_stored_row(spark, tmp_path):
    path = str(tmp_path / "fact")
    marts.load_new_days(_days(spark, [(1, 10, "1"), (2, 20, "2")]), path)
    marts.load_new_days(_days(spark, [(2, 20, "2"), (1, 86410, "5")]), path)
    got = {r["transaction_id"]: r["txn_day"] for r in marts.read_fact(spark, path).collect()}
    assert got == {1: 1, 2: 0}


def test_file_stream_drives_the_same_load(spark, tmp_path):
    from tollgate.streaming.incremental import run_available
    landing, fact, mark = (str(tmp_path / n) for n in ("landing", "fact", "mark"))
    first = _days(spark, [(1, 10, "1"), (2, 86410, "2")])
    first.write.parquet(landing)
    read = lambda: spark.read.schema(first.schema).parquet(landing)
    assert run_available(spark, landing, first.schema, read, fact, mark) == 1
    _days(spark, [(3, 2 * 86400, "3")]).write.mode("append").parquet(landing)
    assert run_available(spark, landing, first.schema, read, fact, mark) == 1
    assert run_available(spark, landing, first.schema, read, fact, mark) == 0
    assert marts.read_fact(spark, fact).where("transaction_id = 3").first()["prior_txn_count"] == 2


@pytest.mark.parametrize("kind", ["decimal(18,3)", "double"])
def test_both_plans_agree_on_rows_without_time_or_key(spark, kind):
    rows = [(i, None if i % 7 == 0 else "a" if i % 3 else "b", None if i % 5 == 0 else (i * 37) % 90, 0.1 * i) for i in range(140)]
    df = spark.createDataFrame(rows, "transaction_id long, account_id string, transaction_dt long, amt double").select(
        "transaction_id", "account_id", "transaction_dt", F.col("amt").cast(kind).alias("transaction_amt"))
    plans = [V.velocity(df), V.velocity(df, hot_rows=5), V.velocity_by_slots(df)]
    one, two, three = (sorted(map(tuple, p.collect())) for p in plans)
    assert len(one) == 140 and one == two == three
    timeless = [r for r in one if r[2] is None]
    assert timeless and all(r[4] == 0 and r[5] is None and r[7] == 0 for r in timeless)


def test_recomputation_reports_rows_of_one_side(spark, monkeypatch):
    df = spark.createDataFrame([(i, "a", i * 60, Decimal(i)) for i in range(5)],
                               "transaction_id long, account_id string, transaction_dt long, transaction_amt decimal(18,3)")
    fact = V.velocity(df)
    assert quality.window_mismatches(fact).isEmpty()
    monkeypatch.setattr(quality, "velocity_by_slots", lambda rows: V.velocity_by_slots(rows).where("transaction_id <> 3"))
    assert [r["transaction_id"] for r in quality.window_mismatches(fact).collect()] == [3]
