"""The quality suite against the single checks and by hand."""

import pytest
from pyspark.sql import functions as F

from tollgate.functions import keys as K
from tollgate.operators import audit as A
from tollgate.operators import quality as D
from tollgate.operators import velocity as V
from tollgate.session import scratch
from tollgate.sources.canonical import keyed


@pytest.fixture
def checks(spark):
    return [A.unique("id"), A.not_null("v"), A.accepted("t", ["a", "b"]), A.CountCheck("rows", 5),
            A.KeyCheck("first", F.col("g"), None, [F.col("id")], F.col("v") > 1)]


def frame(spark, rows):
    return spark.createDataFrame(rows, "id long, g string, t string, v double, check string, key int, bad boolean")


def test_every_kind_of_check_by_hand(spark, checks, tmp_path):
    rows = [(1, "x", "a", 1.0), (2, "x", "b", 9.0), (2, "y", None, 5.0), (4, "y", "c", None), (5, None, "c", 7.0), (None, "z", "a", 2.0)]
    df = frame(spark, [(*r, "extra", 7, True) for r in rows])
    found = A.audited_write(df, str(tmp_path / "mart"), checks)
    assert found == {"unique:id": 1, "not_null:v": 1, "accepted:t": 2, "rows": 1, "first": 2}  # y by its row 2, z by its null
    mart = spark.read.parquet(str(tmp_path / "mart"))
    assert mart.count() == 6
    assert [r[0] for r in A.offending_rows(mart, checks[0]).collect()] == ["2"]
    assert {r[0] for r in A.offending_rows(mart, checks[4]).collect()} == {"y", "z"}
    assert {r.id for r in A.offending_rows(mart, checks[2]).collect()} == {4, 5}


def test_an_empty_mart_fails_only_its_count(spark, checks, tmp_path):
    assert A.audited_write(frame(spark, []), str(tmp_path / "mart"), checks) == {
        "unique:id": 0, "not_null:v": 0, "accepted:t": 0, "rows": 5, "first": 0}


def test_names_must_differ(spark, tmp_path):
    with pytest.raises(ValueError):
        A.audited_write(frame(spark, []), str(tmp_path / "mart"), [A.unique("id"), A.unique("id")])


def test_two_jobs_for_seventeen_checks(spark, sf):
    """One write and one aggregate; the mart is scanned once."""
    fact = V.velocity(keyed(spark, sf))
    checks = A.fact_checks(fact.count(), [K.FULL, K.NO_ADDR, K.NO_CARD_START, K.CARD_ONLY, K.SINGLETON])
    assert len(checks) == 17
    path = scratch(spark)
    found = A.audited_write(fact, path, checks)
    mart = spark.read.schema(fact.schema).parquet(path)
    plan = A.broken_keys(mart, [c for c in checks if isinstance(c, A.KeyCheck)])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and plan.count("Exchange") == 1
    assert found["unique:transaction_id"] == D.duplicates(mart, "transaction_id").count()
    assert found["no_leakage"] == D.leaking_first_rows(mart).count()
    assert set(found.values()) == {0}


def test_a_key_with_most_rows_sends_few_lines(spark):
    df = spark.range(0, 20000, 1, 4).select(F.when(F.col("id") < 9000, 0).otherwise(F.col("id")).alias("id"))
    assert A.broken_keys(df, [A.unique("id")]).count() == 1
