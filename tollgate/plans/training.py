"""Model fitting on Spark ML, from a feature frame to a scored frame that keeps its key."""

from __future__ import annotations

import hashlib
import json
import math
import re
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import asdict, dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.ml import PipelineModel
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier, LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tollgate.functions.scalars import feature_columns, leaked_columns
from tollgate.operators.encoders import category_codes, median_impute, one_hot, standardise
from tollgate.operators.metrics import ranking_quality
from tollgate.plans.boosting import CELLS as PREFIX_CELLS
from tollgate.plans.boosting import boosted_model
from tollgate.session import pinned

DOMINANT_PCT = 30
MISSING = -1e9  # below every feature value: one split isolates the missing rows
PART_VALUES = 4_000_000  # input values in a task of a fit; a fit of no more runs in one task to its end
TASK_VALUES = 16_000_000  # of bytes that one task holds: below it the start of a job per level costs more than other tasks save


@dataclass(frozen=True)
class Boosting:
    """Settings of the boosted trees.

    Boosting stops once the best number of rounds, by average precision on the early-stop rows, is
    ``patience`` rounds old. ``rounds`` is the limit.
    """

    rounds: int = 3000
    patience: int = 100
    depth: int = 5
    step: float = 0.05
    row_share: float = 0.8
    min_leaf_rows: int = 50
    bins: int = 128
    feature_share: str = "0.8"
    seed: int = 42


# The stronger regularisation tried as an intervention.
REGULARISED: Mapping[str, object] = {"depth": 4, "min_leaf_rows": 200, "feature_share": "0.5", "row_share": 0.7,
                                     "step": 0.03}


@dataclass(frozen=True)
class Features:
    names: Sequence[str]
    text: Sequence[str] = field(default_factory=tuple)


def features_of(df: DataFrame, drop_pattern: str | None = None, only: Sequence[str] | None = None) -> Features:
    """Model inputs by schema, split into text and numeric; ids and clocks are refused."""
    names = list(only) if only is not None else feature_columns(df.columns, drop_pattern)
    bad = leaked_columns(names)
    if bad:
        raise ValueError(f"identifier or clock columns among the features: {bad}")
    kinds = {f.name: f.dataType for f in df.schema.fields}
    return Features(names, [c for c in names if isinstance(kinds[c], T.StringType)])


def tree_ready(df: DataFrame, features: Features) -> DataFrame:
    """Inputs as doubles with missing values below all others. Text has to be coded first."""
    if features.text:
        raise ValueError(f"text columns without codes: {list(features.text)}")
    return df.withColumns({f"x_{c}": F.coalesce(F.col(c).cast("double"), F.lit(MISSING)) for c in features.names})


def text_coded(df: DataFrame, features: Features) -> tuple[DataFrame, Features]:
    """Every text column as the integer code of its level, whatever the number of levels; missing is 0.

    The codes come from a distributed lookup over all rows and enter the trees as ordered numbers.
    """
    for c in features.text:
        df = category_codes(df, c, "__code").drop(c).withColumnRenamed("__code", c)
    return df, Features(features.names)


def fingerprint(df: DataFrame, features: Features, conditions: Sequence[Column], settings: Boosting) -> str:
    """Name of a fit: its rows (count and a sum of row hashes), inputs, settings and the conditions of its windows."""
    row = F.xxhash64(*[F.col(f"`{c}`") for c in df.columns]).cast("decimal(38,0)")
    rows = df.agg(F.count("*"), F.sum(row).cast("string")).first()
    named = [list(rows), df.dtypes, list(features.names), asdict(settings), [str(c) for c in conditions]]
    return hashlib.sha256(json.dumps(named).encode()).hexdigest()[:32]


def leaf_outputs(model: GBTClassificationModel) -> np.ndarray:
    """Weighted output of every leaf, one line per tree; leaves are numbered from left to right, as in ``leafCol``."""
    trees = [[float(x) for x in re.findall(r"Predict: (\S+)", text)] for text in re.split(r"\n  Tree \d+ ", model.toDebugString)[1:]]
    out = np.zeros((len(trees), max(map(len, trees))))
    for tree, (leaves, weight) in enumerate(zip(trees, model.treeWeights)):
        out[tree, :len(leaves)] = weight * np.array(leaves)
    return out


def prefix_quality(model: GBTClassificationModel, rows: DataFrame, label: str) -> DataFrame:
    """Average precision of every prefix of the ensemble on ``rows`` (with assembled features): round, average_precision.

    One pass: the outputs of the trees are added up along the ensemble for each row, and rows are counted by (round, step of
    the score). Scores of one step count as equal. Result rows are one per round.
    """
    outputs = leaf_outputs(model)
    leaves = vector_to_array(F.col("__leaves"))

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rounds = np.arange(len(outputs))
        for batch in batches:
            for low in range(0, batch.num_rows, 1024):
                part = batch.slice(low, 1024)
                leaf = part.column(0).flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, len(outputs))
                margin = np.cumsum(outputs[rounds, leaf], axis=1)
                step = np.floor(PREFIX_CELLS / (1.0 + np.exp(-2.0 * margin))).astype(np.int64)
                bad = part.column(1).to_numpy(zero_copy_only=False).astype(np.int64)
                cells, n = np.unique((rounds * (PREFIX_CELLS + 1) + step) * 2 + bad[:, None], return_counts=True)
                cell, bad = cells >> 1, cells & 1
                yield pa.RecordBatch.from_arrays([pa.array(cell // (PREFIX_CELLS + 1) + 1), pa.array((cell % (PREFIX_CELLS + 1)).astype(float)),
                                                  pa.array(n * bad), pa.array(n * (1 - bad))], ["round", "score", "pos", "neg"])

    counts = model.setLeafCol("__leaves").transform(rows).select(leaves, label).mapInArrow(
        counted, "round bigint, score double, pos bigint, neg bigint")
    cells = counts.groupBy("round", "score").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    return ranking_quality(cells, ["round"]).select("round", "average_precision")


def fit_boosted(df: DataFrame, features: Features, train: Column, early_stop: Column,
                settings: Boosting = Boosting(), label: str = "is_fraud") -> PipelineModel:
    """Boosted trees, cut at the best prefix. Its number of trees is the best iteration.

    Rounds are grown until the best prefix is ``patience`` rounds old: judged after twice the patience, then whenever the
    rounds have doubled. A longer ensemble goes on from the shorter one. The best prefix is cut out of it.
    """
    inputs = VectorAssembler(inputCols=[f"x_{c}" for c in features.names], outputCol="__x")
    rows = inputs.transform(tree_ready(df.where(train | early_stop), features)).select(
        "__x", F.col(label).cast("double").alias(label), train.alias("__train"))
    rows = pinned(rows)
    fitted, watched = rows.agg(F.count_if("__train"), F.count_if(~F.col("__train"))).first()
    wide = max(len(features.names), 1)
    tasks = max(math.ceil(fitted * wide / PART_VALUES), 1)
    learner = GBTClassifier(
        featuresCol="__x", labelCol=label, maxDepth=settings.depth, stepSize=settings.step,
        subsamplingRate=settings.row_share, minInstancesPerNode=settings.min_leaf_rows, maxBins=settings.bins,
        seed=settings.seed, featureSubsetStrategy=settings.feature_share)
    values = (fitted + watched) * wide
    return PipelineModel(stages=[inputs, boosted_model(
        learner, rows, tasks, values <= PART_VALUES, settings.rounds, settings.patience, values <= TASK_VALUES)])


def score_boosted(model: PipelineModel, df: DataFrame, features: Features, out: str = "score_raw") -> DataFrame:
    """Add the raw score; the frame keeps its key, so nothing relies on row position."""
    scored = model.transform(tree_ready(df, features))
    return scored.withColumn(out, vector_to_array("probability")[1]).select(*df.columns, out)


def gain_ranking(model: PipelineModel, spark, features: Features) -> DataFrame:
    """Importance per feature with its share and running share, largest first (feature-count rows)."""
    gains = [float(g) for g in model.stages[-1].featureImportances.toArray()]
    df = spark.createDataFrame(list(zip(features.names, gains)), "feature string, gain double")
    return ranked_share(df, "feature", "gain")


def ranked_share(df: DataFrame, name: str, value: str) -> DataFrame:
    """Share and running share of a result-sized ranking; equal values in name order."""
    whole = Window.partitionBy()
    down = Window.orderBy(F.col(value).desc(), F.col(name)).rowsBetween(Window.unboundedPreceding, 0)
    total = F.sum(value).over(whole).cast("double")
    running = F.sum(value).over(down).cast("double")
    return df.select(name, value, (100.0 * F.try_divide(F.col(value).cast("double"), total)).alias("pct"),
                     (100.0 * F.try_divide(running, total)).alias("cum_pct")).withColumn(
        "dominates", F.col("pct") > DOMINANT_PCT)


def linear_matrix(df: DataFrame, features: Features, train: Column) -> tuple[DataFrame, list[str]]:
    """Inputs of the linear baseline: one-hot or counted text, median-filled and scaled numbers."""
    text = list(features.text)
    numeric = [c for c in features.names if c not in text]
    out = df.withColumns({f"z_{c}": F.col(c).cast("double") for c in numeric})
    out = median_impute(out, [f"z_{c}" for c in numeric], train) if numeric else out
    cols = [f"z_{c}" for c in numeric]
    for c in text:
        out, made = one_hot(out, c, train, keep=True)
        cols += made
    out = out.select(*df.columns, *[F.col(f"`{c}`").alias(f"lin_{i}") for i, c in enumerate(cols)])
    names = [f"lin_{i}" for i in range(len(cols))]
    return standardise(out, names, train), names


def fit_linear(df: DataFrame, names: Sequence[str], train: Column, label: str = "is_fraud", max_iter: int = 3000):
    rows = VectorAssembler(inputCols=list(names), outputCol="__x").transform(
        df.where(train).withColumn(label, F.col(label).cast("double")))
    n = rows.count()
    return LogisticRegression(featuresCol="__x", labelCol=label, maxIter=max_iter, regParam=1.0 / max(n, 1),
                              standardization=False, tol=1e-7).fit(rows)


def score_linear(model, df: DataFrame, names: Sequence[str], out: str = "score_raw") -> DataFrame:
    scored = model.transform(VectorAssembler(inputCols=list(names), outputCol="__x").transform(df))
    keep = [c for c in df.columns if c not in names]
    return scored.withColumn(out, vector_to_array("probability")[1]).select(*keep, out)
