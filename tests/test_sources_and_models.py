import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tollgate.catalog import models as C
from tollgate.functions.scalars import SPLIT_NAMES, feature_columns
from tollgate.operators import calibrate as Cal
from tollgate.operators import encoders as E
from tollgate.plans import training as Tr
from tollgate.plans import walkforward as W
from tollgate.plans.evaluation import account_overlap, fifth_held_out, random_split
from tollgate.sources import tables as Tb
from tollgate.sources.canonical import transactions
from tollgate.sources.tables import read_if_there


def test_csv_types_are_promoted_over_the_whole_file(spark, tmp_path):
    (tmp_path / "x.csv").write_text("TransactionID,TransactionDT,D1,M1\n1,86399,1,T\n2,86400,2.5,\n3,172800,,7\n")
    df = Tb.csv_to_parquet(spark, str(tmp_path / "x.csv"), str(tmp_path / "out"), "TransactionDT")
    kinds = dict(df.dtypes)
    assert kinds["D1"] == "double" and kinds["M1"] == "string"
    assert [r["txn_day"] for r in df.orderBy("TransactionID").collect()] == [0, 1, 2]
    s = Tb.staged(df)
    assert s.columns == ["transaction_id", "transaction_dt", "d1", "m1", "txn_day"]
    assert dict(s.dtypes)["transaction_id"] == "bigint"


def test_prepare_gives_a_day_to_transactions_only(spark, tmp_path):
    (tmp_path / "t.csv").write_text("TransactionID,TransactionDT\n1,86400\n")
    (tmp_path / "i.csv").write_text("TransactionID,DeviceType\n1,mobile\n")
    got = Tb.prepare(spark, str(tmp_path / "t.csv"), str(tmp_path / "i.csv"), str(tmp_path))
    assert "txn_day" in got["transactions"].columns and "txn_day" not in got["identity"].columns


def test_staging_rounds_whole_numbers_and_tolerates_text(spark):
    df = spark.createDataFrame([(2.5, "12.3456", "x")], "TransactionID double, TransactionAmt string, isFraud string")
    r = Tb.staged(df).first()
    assert (r["transaction_id"], str(r["transaction_amt"]), r["is_fraud"]) == (3, "12.346", None)


def test_completeness_alignment_and_cache(spark, tmp_path):
    df = spark.range(5).withColumnRenamed("id", "transaction_id")
    assert Tb.completeness(df, "t", 5, 1).isEmpty()
    with pytest.raises(ValueError):
        Tb.require_complete(df, "t", 6, 1)
    assert Tb.aligned(df, df.where("transaction_id > 2")).count() == 2
    with pytest.raises(ValueError):
        Tb.aligned(df, spark.range(9).withColumnRenamed("id", "transaction_id"))
    calls = []

    def build():
        calls.append(1)
        return df.withColumn("X", F.lit(1.5))

    path = str(tmp_path / "cache")
    for _ in range(2):
        got = Tb.read_through(spark, path, build)
    assert calls == [1] and got.columns == ["transaction_id", "x"] and isinstance(got.schema["x"].dataType, T.FloatType)
    Tb.write_result_csv(got, str(tmp_path / "csv"))
    assert Tb.read_csv(spark, str(tmp_path / "csv")).count() == 5
    Tb.publish(df, "stg_ids")
    assert spark.table("stg_ids").count() == 5


def test_scan_reads_only_the_columns_asked_for(spark, sf):
    df = spark.read.parquet(f"{sf}/events.parquet").select("event_id", "value").where("value > 10")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<event_id:bigint,value:double>" in plan and "GreaterThan(value,10.0)" in plan


def test_feature_selection_refuses_ids(spark):
    assert feature_columns(["transaction_id", "txn_day", "v1", "amt", "vx"], r"v\d+") == ["amt", "vx"]
    df = spark.createDataFrame([(1, 2.0)], "transaction_id long, amt double")
    with pytest.raises(ValueError):
        Tr.features_of(df, only=["transaction_id", "amt"])


def test_random_split_is_exact_and_disjoint(spark, sf):
    t = transactions(spark, sf)
    n = t.count()
    for sizes in ([n - 30, 10, 15, 5], fifth_held_out(n)):
        got = {r["split"]: r["count"] for r in random_split(t, sizes, "1").groupBy("split").count().collect()}
        assert [got[x] for x in SPLIT_NAMES] == sizes and sum(sizes) == n
    assert fifth_held_out(1000) == [613, 100, 87, 200]


def test_overlap_counts_every_row_outside_the_test_part(spark):
    df = spark.createDataFrame([("a", "test"), ("a", "calibration"), ("b", "test"), ("c", "train")], "account_id string, split string")
    assert account_overlap(df).first()[:2] == (2, 1)


def test_only_a_missing_path_counts_as_absent(spark, tmp_path):
    assert read_if_there(spark, str(tmp_path / "none")) is None
    (tmp_path / "broken").mkdir()
    (tmp_path / "broken" / "part-0.parquet").write_text("this is no table")
    with pytest.raises(Exception):
        read_if_there(spark, str(tmp_path / "broken"))


def test_scratch_lies_in_the_shared_folder_and_pinning_elsewhere_needs_one(spark):
    from types import SimpleNamespace

    from tollgate import session
    assert "scratch-" in session.scratch(spark)
    away = SimpleNamespace(master="spark://host:7077", getConf=lambda: {}, getCheckpointDir=lambda: None)
    with pytest.raises(ValueError):
        session.shared_folder(SimpleNamespace(sparkContext=away, conf={}))


def test_alignment_reports_missing_and_repeated_ids(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b"), (2, "c"), (3, "d")], "transaction_id long, v string")
    ids = lambda *x: spark.createDataFrame([(i,) for i in x], "transaction_id long")
    assert Tb.aligned(df, ids(1, 3)).count() == 2
    for wrong in (ids(1, 9), ids(2), ids(1, 1)):
        with pytest.raises(ValueError):
            Tb.aligned(df, wrong)


def test_levels_met_after_fitting_keep_an_indicator(spark):
    df = spark.createDataFrame([(i, f"v{i % 20}" if i < 100 else f"w{i}", i < 100) for i in range(1000)] + [(1000, None, False)],
                               "transaction_id int, c string, old boolean")
    out, names = E.one_hot(df, "c", F.col("old"))
    assert len(names) == 22
    assert out.select(sum(F.col(f"`{n}`") for n in names).alias("s")).where("s <> 1").isEmpty()


def test_fold_windows_do_not_overlap(spark):
    df = spark.range(0, 30).withColumnRenamed("id", "txn_day")
    rows = W.fold_roles(df, (18, 24), 3).collect()
    assert len({(r["txn_day"], r["fold"]) for r in rows}) == len(rows)
    assert {r["txn_day"] for r in rows if r["fold"] == 18 and r["role"] == "test"} == {18, 19, 20}


def test_isotonic_is_monotone_and_clips(spark):
    df = spark.createDataFrame([(i, x / 10, y) for i, (x, y) in enumerate([(1, 0), (2, 1), (3, 0), (4, 1), (4, 1), (5, 1)])],
                               "transaction_id long, score double, is_fraud int")
    model = Cal.fit_isotonic(df)
    out = model.transform(spark.createDataFrame([(0.0,), (0.25,), (0.4,), (9.0,)], "score double")).orderBy("score")
    got = [r["calibrated"] for r in out.collect()]
    assert got == sorted(got) and got[0] == 0.0 and got[-1] == 1.0
    assert Cal.cross_fitted(df).count() == 6


def test_walk_forward_invariants(spark, sf):
    from tollgate.session import pinned
    df = pinned(C.model_rows(spark, sf).drop("segment"))
    folds = W.run_config("x", df, (24,), 3, Tr.Boosting(rounds=4, depth=3, min_leaf_rows=10, bins=32, step=0.3))
    r = folds.first()
    assert r["cost_oracle"] <= r["cost"] + 1e-6 and r["cost_oracle"] <= r["cost_approve_all"]
    assert 1 <= r["best_iter"] <= 4
    assert 0 <= r["test_pr_auc"] <= 1 and 0 <= r["test_roc_auc"] <= 1
    assert r["n_test"] == df.where("txn_day >= 24 and txn_day < 27").count()
    s = W.summarise(folds).first()
    assert s["cost_total"] == pytest.approx(r["cost"]) and s["pr_auc_sd"] is None


def test_text_is_coded_before_the_trees_whatever_its_levels(spark):
    for levels in (3, 400):
        df = spark.createDataFrame([(i, f"s{i % levels}", i % 3 / 1.0) for i in range(800)], "transaction_id int, seg string, v double")
        coded, features = Tr.text_coded(df, Tr.Features(["seg", "v"], ["seg"]))
        assert not features.text and dict(coded.dtypes)["seg"] == "int" and coded.agg(F.max("seg")).first()[0] == levels
    with pytest.raises(ValueError):
        Tr.tree_ready(df, Tr.Features(["seg"], ["seg"]))


def test_interventions_are_all_combinations_of_the_switches(spark, monkeypatch):
    seen = []
    def config(name, df, folds, length, settings, transform):
        seen.append((name, df.first()["d1"], settings.depth, transform is not None))
        return spark.createDataFrame([(name,)], "config string")
    monkeypatch.setattr(W, "run_config", config)
    df = spark.createDataFrame([(9, 2.0)], "txn_day int, d1 double")
    assert W.interventions(df, (1,), 1, offsets=("d1",)).count() == 8
    assert {("baseline", 2.0, 5, False), ("days re-based, text counted, regularised", 7.0, 4, True)} < set(seen)
    assert len(set(seen)) == len(seen) == 8


def signal_rows(spark, n=4000):
    """A label that depends on two inputs, with noise; the last third of the rows is watched."""
    rows = spark.range(n).select(F.col("id").alias("transaction_id"), *[
        (F.conv(F.substring(F.md5(F.concat(F.lit(c), F.col("id").cast("string"))), 1, 8), 16, 10).cast("double") / 2**32).alias(c) for c in "abcn"])
    bad = F.sin(F.col("a") * 9) + F.col("b") * F.col("b") + F.col("n") * 0.8 > 1.6
    return rows.select("transaction_id", "a", "b", "c", bad.cast("int").alias("is_fraud"), (F.col("transaction_id") % 3 < 2).alias("fit"))


def test_boosting_stops_at_the_best_prefix_by_average_precision(spark):
    df, features = signal_rows(spark), Tr.Features(["a", "b", "c"])
    settings = Tr.Boosting(rounds=40, patience=6, depth=3, min_leaf_rows=20, bins=32, step=0.2)
    model = Tr.fit_boosted(df, features, F.col("fit"), ~F.col("fit"), settings)
    best = model.stages[-1].getNumTrees
    assert 1 < best <= 40
    longer = Tr.fit_boosted(df, features, F.col("fit"), ~F.col("fit"), Tr.Boosting(
        rounds=best + 2, patience=best + 2, depth=3, min_leaf_rows=20, bins=32, step=0.2))
    assert longer.stages[-1].getNumTrees == best and longer.stages[-1].treeWeights == model.stages[-1].treeWeights
    assert longer.stages[-1].toDebugString.split("\n", 1)[1] == model.stages[-1].toDebugString.split("\n", 1)[1]
    nobody = Tr.fit_boosted(df, features, F.col("fit"), F.lit(False), Tr.Boosting(rounds=3, depth=2, min_leaf_rows=20, bins=16))
    assert nobody.stages[-1].getNumTrees == 3  # nothing to watch


def test_quality_of_every_prefix_equals_brute_force(spark):
    import numpy as np

    df, features = signal_rows(spark, 1500), Tr.Features(["a", "b", "c"])
    ready = Tr.tree_ready(df, features).withColumn("is_fraud", F.col("is_fraud").cast("double"))
    rows = Tr.VectorAssembler(inputCols=["x_a", "x_b", "x_c"], outputCol="__x").transform(ready)
    model = Tr.GBTClassifier(featuresCol="__x", labelCol="is_fraud", maxIter=7, maxDepth=3, maxBins=16, stepSize=0.3, seed=1).fit(rows)
    got = {r["round"]: r["average_precision"] for r in Tr.prefix_quality(model, rows, "is_fraud").collect()}
    collected = rows.select("__x", "is_fraud").collect()
    outputs = np.array([[t.predict(r["__x"]) * w for t, w in zip(model.trees, model.treeWeights)] for r in collected])
    bad = np.array([r["is_fraud"] for r in collected])
    for k in range(1, 8):
        step = np.floor(Tr.PREFIX_CELLS / (1 + np.exp(-2 * outputs[:, :k].sum(axis=1))))
        tp = fp = 0
        value = 0.0
        for x in sorted(set(step), reverse=True):
            tp, fp, new = tp + bad[step == x].sum(), fp + (1 - bad[step == x]).sum(), bad[step == x].sum()
            value += new / bad.sum() * tp / (tp + fp)
        assert got[k] == pytest.approx(value, rel=1e-9)


def test_a_fit_with_the_same_fingerprint_is_read_from_the_store(spark, sf, monkeypatch, tmp_path):
    from tollgate.session import pinned

    fits = []
    honest = W.fit_boosted
    monkeypatch.setattr(W, "fit_boosted", lambda *a: fits.append(1) or honest(*a))
    df = pinned(C.model_rows(spark, sf).drop("segment"))
    small = Tr.Boosting(rounds=2, depth=2, min_leaf_rows=10, bins=16)
    windows, features = W.fold_windows(24, 3), Tr.features_of(df)
    first = W.evaluate(df, features, windows, small, str(tmp_path))
    again = W.evaluate(df, features, windows, small, str(tmp_path))
    assert len(fits) == 1
    same = {k: v for k, v in first.numbers.items() if k != "fit_secs"}
    assert same == {k: v for k, v in again.numbers.items() if k != "fit_secs"}
    assert first.scored.exceptAll(again.scored).isEmpty()
    for other in (dict(windows=W.fold_windows(21, 3)), dict(settings=Tr.Boosting(rounds=2, depth=3, min_leaf_rows=10, bins=16)),
                  dict(df=df.where("transaction_id <> 5")), dict(features=Tr.Features(features.names[1:], features.text))):
        W.fitted(**{"df": df, "features": features, "windows": windows, "settings": small, "store": str(tmp_path), **other})
    assert len(fits) == 5
