"""Model quality from score cells: average precision, ROC area, Brier, calibration tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tollgate.functions.scalars import ratio_or_null
from tollgate.operators.ordering import equal_count_bin, exact_quantiles, global_rank, running_totals

# The statistics of a score distribution report.
SCORE_PROBS = {"min": 0.0, "p25": 0.25, "median": 0.5, "p75": 0.75, "p95": 0.95, "max": 1.0}


def score_cells(df: DataFrame, score: str = "score", label: str = "is_fraud",
                weight: Column | None = None, group: Sequence[str] = ()) -> DataFrame:
    """Weighted positives and negatives per distinct score."""
    w = F.lit(1).cast("long") if weight is None else weight
    bad = F.col(label) == 1
    return df.groupBy(*group, F.col(score).cast("double").alias("score")).agg(
        F.sum(F.when(bad, w).otherwise(0)).alias("pos"), F.sum(F.when(bad, 0).otherwise(w)).alias("neg"))


def curve(cells: DataFrame, group: Sequence[str] = ()) -> DataFrame:
    """Cumulative true and false positives per distinct score, from the highest score down."""
    run = running_totals(cells, [F.col("score").desc()],
                         {"pos_before": F.col("pos"), "neg_before": F.col("neg")}, group)
    return run.withColumns({"tp": F.col("pos_before") + F.col("pos"), "fp": F.col("neg_before") + F.col("neg")})


def ranking_quality(cells: DataFrame, group: Sequence[str] = ()) -> DataFrame:
    """Step-sum average precision and tie-corrected ROC area, from one ordered pass.

    Average precision adds precision times the recall gained at each distinct score. It does not
    interpolate between points.
    """
    c = curve(cells, group)
    tp, fp = F.col("tp").cast("double"), F.col("fp").cast("double")
    pos, neg = F.col("pos").cast("double"), F.col("neg").cast("double")
    out = c.groupBy(*group).agg(
        F.sum(pos * ratio_or_null(tp, tp + fp)).alias("__ap"),
        # Pairs won: negatives below each positive, half of those at the same score.
        F.sum(pos * (F.col("neg_before_all").cast("double") - fp + neg / 2)).alias("__won"),
        F.max("pos_before_all").alias("__p"), F.max("neg_before_all").alias("__n"))
    return out.select(*group, ratio_or_null(F.col("__ap"), F.col("__p")).alias("average_precision"),
                      F.try_divide(F.col("__won"), F.col("__p").cast("double") * F.col("__n").cast("double"))
                      .alias("roc_auc"), F.col("__p").alias("positives"), F.col("__n").alias("negatives"))


def brier(score: str = "score", label: str = "is_fraud") -> Column:
    """Mean squared distance between score and label."""
    miss = F.col(score) - F.col(label)
    return F.avg(miss * miss)


def quality(df: DataFrame, raw: str = "score", calibrated: str | None = None,
            label: str = "is_fraud") -> dict[str, float]:
    """The evaluation numbers of one scored set; one row comes back to the driver."""
    out = ranking_quality(score_cells(df, raw, label)).first().asDict()
    out["brier"] = df.agg(brier(calibrated or raw, label).alias("b")).first()["b"]
    if calibrated:
        out["average_precision_cal"] = ranking_quality(score_cells(df, calibrated, label)).first()[
            "average_precision"]
    return out


def decile_table(df: DataFrame, score: str = "score", label: str = "is_fraud",
                 row_id: str = "transaction_id", bins: int = 10) -> DataFrame:
    """Predicted against actual per equal-count bin; equal scores are split by row id."""
    ranked = global_rank(df.select(row_id, score, label), [F.col(score), F.col(row_id)])
    exact = F.sum(F.col(score).cast("decimal(18,12)")).cast("double") / F.count("*")
    table = ranked.groupBy(equal_count_bin(F.col("rank"), F.col("rank_of"), bins).alias("bin")).agg(
        F.count("*").alias("n"), exact.alias("predicted"), F.avg(F.col(label).cast("double")).alias("actual"))
    return table.withColumn("abs_diff", F.abs(F.col("predicted") - F.col("actual")))


def reliability(df: DataFrame, score: str = "score", label: str = "is_fraud", bins: int = 10) -> DataFrame:
    """Reliability curve over quantile bins; a bin includes its right edge. Empty bins are left out."""
    inner = [i / bins for i in range(1, bins)]
    edges = sorted(r["quantile"] for r in exact_quantiles(df, score, inner).collect())  # bins - 1 numbers
    place = F.lit(0)
    for edge in edges:
        place = place + F.when(F.col(score) > F.lit(edge), 1).otherwise(0)
    exact = F.sum(F.col(score).cast("decimal(18,12)")).cast("double") / F.count("*")
    return df.groupBy(place.alias("bin")).agg(
        F.count("*").alias("n"), exact.alias("mean_predicted"),
        F.avg(F.col(label).cast("double")).alias("observed"))


def score_distribution(df: DataFrame, score: str = "score") -> DataFrame:
    names = F.create_map(*[x for name, p in SCORE_PROBS.items() for x in (F.lit(p), F.lit(name))])
    spread = exact_quantiles(df, score, list(SCORE_PROBS.values())).select(
        names[F.col("prob")].alias("statistic"), F.col("quantile").alias("value"))
    exact = F.sum(F.col(score).cast("decimal(18,12)")).cast("double") / F.count(score)
    return spread.unionByName(df.agg(exact.alias("value")).select(F.lit("mean").alias("statistic"), "value"))
