"""Running totals in one exchange, and the isotonic fit without a central pool, against brute force."""

import random
from decimal import Decimal
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from tollgate.operators import calibrate as Cal
from tollgate.operators import ordering as O


@pytest.fixture
def many_ranges(spark):
    """Several ranges also for small tables."""
    saved = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "9")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", saved)
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_running_totals_equal_brute_force_over_groups_and_batches(spark, many_ranges):
    rng = random.Random(5)
    rows = [(rng.choice(["a", "b", "c"]), i, Decimal(rng.randrange(-500, 500)) / 100, rng.random(), f"p{i}") for i in range(400)]
    df = spark.createDataFrame(rows, "g string, k int, d decimal(12,2), x double, extra string")
    out = O.running_totals(df, [F.col("k").desc()], {"s": F.col("d"), "n": F.lit(1).cast("long"), "sx": F.col("x")}, ["g"])
    assert out.count() == len(rows)
    for r in out.collect():
        earlier = [q for q in rows if q[0] == r.g and q[1] > r.k]
        same = [q for q in rows if q[0] == r.g]
        assert r.s == sum(q[2] for q in earlier) and r.s_all == sum(q[2] for q in same) and r.extra == f"p{r.k}"
        assert r.n == len(earlier) and r.n_all == len(same) and abs(r.sx - sum(q[3] for q in earlier)) < 1e-9


def test_running_totals_of_nothing(spark):
    df = spark.createDataFrame([], "k int, v long")
    assert O.running_totals(df, [F.col("k")], {"s": F.col("v")}).collect() == []


def test_a_global_rank_exchanges_the_rows_once(spark, sf):
    ranked = O.global_rank(spark.read.parquet(f"{sf}/events.parquet").select("event_id", "value"), [F.col("value"), F.col("event_id")])
    ranked.collect()
    plan = ranked._jdf.queryExecution().executedPlan().toString()
    plan = plan.split("== Initial Plan ==")[0]
    # After the checkpoint of the sorted ranges, only the totals of the ranges are exchanged.
    assert "SortMergeJoin" not in plan and "BroadcastHashJoin" in plan
    assert "rangepartitioning" not in plan and "Window" in plan
    side = plan[:plan.index("BroadcastExchange")]
    assert "Exchange hashpartitioning" not in side


def pooled(cells):
    """Pool-adjacent-violators in exact fractions: rate of every score."""
    stack = []
    for x, pos, neg in sorted(cells):
        block = [[x], pos, pos + neg]
        while stack and Fraction(stack[-1][1], stack[-1][2]) >= Fraction(block[1], block[2]):
            xs, p, n = stack.pop()
            block = [xs + block[0], p + block[1], n + block[2]]
        stack.append(block)
    return {x: p / n for xs, p, n in stack for x in xs}


@pytest.mark.parametrize("shape", ["rising", "falling", "noise", "flat", "step"])
def test_isotonic_blocks_equal_brute_force(spark, many_ranges, shape):
    rng = random.Random(shape)
    chance = {"rising": lambda x: x, "falling": lambda x: 1 - x, "noise": lambda x: 0.4, "flat": lambda x: 0.0,
              "step": lambda x: 0.1 if x < 0.3 or x > 0.8 else 0.9}[shape]
    rows = []
    for _ in range(900):
        x = round(rng.random(), 3)
        rows.append((x, int(rng.random() < chance(x))))
    cells = {}
    for x, y in rows:
        cells.setdefault(x, [0, 0])[1 - y] += 1
    want = pooled([(x, *v) for x, v in cells.items()])
    model = Cal.fit_isotonic(spark.createDataFrame(rows, "score double, is_fraud int"))
    blocks = model.blocks.orderBy("lo").collect()
    assert [b.rate for b in blocks] == sorted({b.rate for b in blocks}) and sum(b.n for b in blocks) == len(rows)
    for x, rate in want.items():
        assert next(b.rate for b in blocks if b.lo <= x <= b.hi) == pytest.approx(rate, abs=1e-15)


def test_a_joined_map_equals_a_broadcast_one(spark, many_ranges):
    rng = random.Random(8)
    fit = spark.createDataFrame([(round(rng.random(), 2), int(rng.random() < 0.5)) for _ in range(300)], "score double, is_fraud int")
    model = Cal.fit_isotonic(fit)
    rows = [(i, x) for i, x in enumerate([None, float("nan"), -1.0, 0.0, 0.005, 2.0, *[rng.random() for _ in range(200)], 0.5, 0.5])]
    df = spark.createDataFrame(rows, "i int, score double")
    got = {r.i: r.calibrated for r in model.transform(df).collect()}
    joined = {r.i: r.calibrated for r in model.transform(df, limit=0).collect()}
    assert got == joined and got[0] is None and got[1] is None and got[2] == min(v for v in got.values() if v is not None)


def test_a_fit_without_rows_gives_null(spark):
    empty = spark.createDataFrame([], "score double, is_fraud int")
    out = Cal.fit_isotonic(empty).transform(spark.createDataFrame([(0.5,)], "score double"))
    assert out.first().calibrated is None
