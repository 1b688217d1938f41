"""Plans of stored layouts, and features of wide rows."""

import re

from pyspark.sql import functions as F

from tollgate.catalog import queries as Q
from tollgate.operators import profile as P
from tollgate.operators import velocity as V
from tollgate.plans import layout as L


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def above(plan, pattern):
    """Names of the operators above the line that matches."""
    lines = plan.split("\n")
    depth = [len(re.match(r"[\s:|+-]*", line)[0]) for line in lines]
    at = next(i for i, line in enumerate(lines) if re.search(pattern, line))
    out, low = [], depth[at]
    for i in range(at - 1, -1, -1):
        if depth[i] < low:
            low = depth[i]
            out.append(lines[i])
    return out


def test_the_account_mart_needs_no_exchange(spark, sf):
    mart = Q.account_mart(spark, sf)
    assert mart.count() == Q.keyed(spark, sf).count()
    assert "Exchange" not in plan_of(P.account_dimension(mart)) and "Exchange" not in plan_of(V.velocity(mart))
    assert "Exchange" in plan_of(P.account_dimension(Q.keyed(spark, sf)))


def test_the_window_of_wide_rows_shuffles_narrow_rows_only(spark, tmp_path):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        rows = spark.range(300).select(F.col("id").alias("transaction_id"), (F.col("id") % 7).cast("string").alias("account_id"),
                                       (F.col("id") * 977).alias("transaction_dt"), F.col("id").cast("decimal(18,3)").alias("transaction_amt"),
                                       *[(F.col("id") * i).alias(f"v{i}") for i in range(1, 301)])
        wide = L.bucketed(rows, "wide_test", str(tmp_path / "wide"), "transaction_id")
        out = L.with_late_features(wide)
        plan = plan_of(out)
        assert not any("Exchange" in line for line in above(plan, r"FileScan.*v1#")), plan
        assert all("v1#" not in line for line in plan.split("\n") if "Exchange" in line)
        narrow = V.velocity(rows).select(*out.columns)
        assert sorted(map(tuple, out.collect())) == sorted(map(tuple, narrow.collect()))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
        spark.sql("DROP TABLE IF EXISTS wide_test")


def test_a_pivoted_block_keeps_rows_and_gaps(spark):
    lines = spark.createDataFrame([(1, 1, 2.0), (1, 1, 3.0), (1, 3, 1.0), (2, 9, 1.0), (None, 2, 4.0)], "k long, slot int, v double")
    got = {r["k"]: tuple(r)[1:] for r in L.pivoted_block(lines, "k", F.col("slot"), "v", 3).collect()}
    assert got == {1: (5.0, None, 1.0), 2: (None, None, None), None: (None, 4.0, None)}


def test_late_features_are_never_broadcast(spark, tmp_path):
    """Four columns of a wide table look small by its compressed bytes, whatever the rows."""
    rows = spark.range(200).select(F.col("id").alias("transaction_id"), (F.col("id") % 7).cast("string").alias("account_id"),
                                   (F.col("id") * 977).alias("transaction_dt"), F.col("id").cast("decimal(18,3)").alias("transaction_amt"),
                                   *[F.lit(None).cast("double").alias(f"v{i}") for i in range(1, 101)])
    try:
        out = L.with_late_features(L.bucketed(rows, "wide_hint", str(tmp_path / "wide"), "transaction_id"))
        plan = plan_of(out)
        assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan and out.count() == 200
    finally:
        spark.sql("DROP TABLE IF EXISTS wide_hint")
