"""Toxicity classifier with a counterfactual penalty.

Features are the distinct lower-cased words of a text and their beginnings of four to six characters, which carry insults in
languages that build long words. The features that differ most between toxic and other labelled texts (chi-square) enter a
logistic model. Every labelled text with sentences that name a group also gets counterfactual versions, in which the group
terms of those sentences are swapped for other terms of the same kind; the training loss adds `penalty` times the mean squared
change of the logit between a text and its versions. Naming a group neutrally therefore cannot raise a score by much, even
where the training texts that name it happen to be toxic.

Only texts and labels of rows with crc32(doc_id) mod 5 other than 0 are learnt from, at most `SAMPLE` of them (those with the
smallest hash of doc_id). Null texts are empty; empty texts get the score of the bias. Null labels are ignored, repeated labels
of one document count once (toxic if any says so). With labels of one kind only, or none, every text gets one
score, which is 0.1 without labels. Rows never meet when scored.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tollgate.llm.common import chunks, fold, map_texts, pinned

SAMPLE = 12_000  # labelled rows that the model is fitted on, at most
FEATURES = 4_096
PREFIXES = (4, 5, 6)
VERSIONS = 2
FOLDS = 5
PRIOR = (0.5, 4.5)  # toxic and other documents added to the labelled ones where nothing can be learnt from them
SENTENCE = re.compile(r"[^.!?\n]+[.!?\n]*")
WORD = re.compile(r"[^\W_]+")

# Group terms by kind; a term may be swapped for any other of its kind.
GROUPS = (
    ("women", "men"), ("woman", "man"), ("girls", "boys"), ("mujeres", "hombres"), ("femmes", "hommes"), ("frauen", "männer"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"),
    ("musulmanes", "cristianos", "judíos"), ("musulmans", "chrétiens", "juifs"), ("muslime", "christen", "juden"),
    ("black", "white", "asian", "latino", "african", "european", "arab"),
    ("gay", "straight", "lesbian", "bisexual", "transgender"),
    ("immigrants", "refugees", "foreigners", "natives", "locals"), ("inmigrantes", "refugiados", "extranjeros"),
    ("immigrés", "réfugiés", "étrangers"), ("einwanderer", "flüchtlinge", "ausländer"),
    ("mexicans", "americans", "chinese", "indians", "russians", "germans", "french"),
    ("disabled", "deaf", "blind", "autistic"), ("old", "young", "elderly"),
)
OTHERS = {term: [x for x in kind[i + 1:] + kind[:i]] for kind in GROUPS for i, term in enumerate(kind)}


def features(words: set[str]) -> set[str]:
    out = set(words)
    for size in PREFIXES:
        out.update(w[:size] + "*" for w in words if len(w) >= size)
    return out


def words_of(text: str) -> set[str]:
    return set(WORD.findall(text.lower()))


def versions(text: str) -> list[str]:
    """The text with the group terms of its sentences swapped; none if it names no group."""
    if not words_of(text) & OTHERS.keys():
        return []
    out = []
    for shift in range(VERSIONS):
        def swap(match: re.Match) -> str:
            others = OTHERS.get(match[0].lower())
            return others[shift % len(others)] if others else match[0]

        out.append("".join(WORD.sub(swap, s) if words_of(s) & OTHERS.keys() else s for s in SENTENCE.findall(text)))
    return out


@dataclass(frozen=True)
class Model:
    weights: dict[str, float]
    bias: float

    def score(self, text: str) -> float:
        hits = features(words_of(text)) & self.weights.keys()
        return probability(self.bias + math.fsum(self.weights[f] for f in hits))


def probability(z: float) -> float:
    return 1 / (1 + math.exp(-z)) if z >= 0 else math.exp(z) / (1 + math.exp(z))


def labelled_sample(docs: DataFrame, labels: DataFrame, limit: int) -> DataFrame:
    """doc_id, text and toxic of at most `limit` rows that may be learnt from: of equal doc_ids, the row with the least text hash."""
    known = (labels.where("doc_id is not null and toxic is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id"))
             .agg(F.max(F.col("toxic").cast("int")).alias("toxic")).where(fold(F.col("doc_id"), FOLDS) != 0))
    there = docs.select(F.col("doc_id").cast("long").alias("doc_id")).distinct()
    chosen = known.join(there, "doc_id", "left_semi").orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)  # at most `limit` numbers
    text = F.col("text").cast("string")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.struct(F.xxhash64(text).alias("h"), text.alias("text")).alias("row"))
    return (rows.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "toxic").agg(F.min("row").alias("row"))
            .select("doc_id", F.col("row.text").alias("text"), "toxic"))


def tally(sample: DataFrame) -> DataFrame:
    """Toxic and other documents of every feature, summed inside each slice before they are shuffled."""
    def count(batch, texts):
        sums: dict[str, list[int]] = {}
        for raw, toxic in zip(texts, batch.column(2).to_pylist()):
            for f in features(words_of(raw.decode())):
                sums.setdefault(f, [0, 0])[toxic] += 1
        return [list(sums), [v[1] for v in sums.values()], [v[0] for v in sums.values()]]

    return (map_texts(sample.select("doc_id", "text", "toxic"), count, "feature string, toxic bigint, other bigint")
            .groupBy("feature").agg(F.sum("toxic").alias("toxic"), F.sum("other").alias("other")))


def encoded(sample: DataFrame, names: list[str]) -> DataFrame:
    """Numbers of the selected features of every sampled text and of its counterfactual versions."""
    def run(batches):
        place = {f: i for i, f in enumerate(names)}

        def numbers(text: str) -> list[int]:
            return sorted(place[f] for f in features(words_of(text)) & place.keys())

        for batch, texts in chunks(batches):
            decoded = [x.decode() for x in texts]
            yield pa.RecordBatch.from_arrays(
                [batch.column(2), pa.array([numbers(t) for t in decoded], pa.list_(pa.int32())),
                 pa.array([[numbers(v) for v in versions(t)] for t in decoded], pa.list_(pa.list_(pa.int32())))],
                ["toxic", "found", "swapped"])

    return sample.select("doc_id", "text", "toxic").mapInArrow(run, "toxic int, found array<int>, swapped array<array<int>>")


class Rows:
    """Sparse zero-one rows."""

    def __init__(self, rows: list[list[int]]):
        self.count = len(rows)
        self.column = np.array([c for r in rows for c in r], np.int64)
        self.row = np.repeat(np.arange(len(rows)), [len(r) for r in rows])

    def dot(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, weights=w[self.column], minlength=self.count)

    def back(self, g: np.ndarray, size: int) -> np.ndarray:
        return np.bincount(self.column, weights=g[self.row], minlength=size)


def descend(found: Rows, toxic: np.ndarray, plain: Rows, swapped: Rows, size: int, penalty: float, ridge: float,
            rounds: int = 400, rate: float = 0.05) -> tuple[np.ndarray, float]:
    """Minimise mean log loss + penalty * mean squared logit change + ridge * |w|^2 by full gradients with momentum scaling."""
    w, bias = np.zeros(size), math.log((toxic.sum() + 0.5) / (len(toxic) - toxic.sum() + 0.5))
    first, second, fb, sb = np.zeros(size), np.zeros(size), 0.0, 0.0
    for step in range(1, rounds + 1):
        error = (1 / (1 + np.exp(-(found.dot(w) + bias))) - toxic) / len(toxic)
        grad, gb = found.back(error, size) + 2 * ridge * w, error.sum()
        if swapped.count:
            change = (plain.dot(w) - swapped.dot(w)) * (2 * penalty / swapped.count)
            grad += plain.back(change, size) - swapped.back(change, size)
        first, second = 0.9 * first + 0.1 * grad, 0.999 * second + 0.001 * grad * grad
        fb, sb = 0.9 * fb + 0.1 * gb, 0.999 * sb + 0.001 * gb * gb
        a, b = 1 - 0.9 ** step, 1 - 0.999 ** step
        w -= rate * (first / a) / (np.sqrt(second / b) + 1e-8)
        bias -= rate * (fb / a) / (math.sqrt(sb / b) + 1e-8)
    return w, bias


def fit(docs: DataFrame, labels: DataFrame, limit: int = SAMPLE, size: int = FEATURES, penalty: float = 1.0,
        ridge: float = 2e-5) -> Model:
    sample = pinned(labelled_sample(docs, labels, limit))
    n, bad = sample.agg(F.count(F.lit(1)), F.coalesce(F.sum("toxic"), F.lit(0))).first()
    if not bad or bad == n:
        return Model({}, math.log((bad + PRIOR[0]) / (n - bad + PRIOR[1])))
    a, b = F.col("toxic").cast("double"), F.col("other").cast("double")
    gap = a * (n - bad - b) - b * (bad - a)
    chi = gap * gap / ((a + b) * (F.lit(float(n)) - a - b))
    top = (tally(sample).where((a + b >= 3) & (a + b < n)).orderBy(chi.desc_nulls_last(), "feature").limit(size))
    names = [r[0] for r in top.select("feature").collect()]  # at most `size` words
    rows = encoded(sample, names).collect()  # at most `limit` rows of feature numbers
    pairs = [(list(r.found), list(s)) for r in rows for s in r.swapped]
    w, bias = descend(Rows([list(r.found) for r in rows]), np.array([r.toxic for r in rows], float), Rows([p[0] for p in pairs]),
                      Rows([p[1] for p in pairs]), len(names), penalty, ridge)
    return Model({f: float(x) for f, x in zip(names, w) if x}, float(bias))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score and predicted of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # at most `size` weights

    def columns(batch, texts):
        scores = [shared.value.score(x.decode()) for x in texts]
        return [batch.column(0), batch.column(1), scores, [int(s >= 0.5) for s in scores]]

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (fold(F.col("doc_id"), FOLDS) == 0).alias("held_out"),
                       F.col("text").cast("string").alias("text"))
    return map_texts(rows, columns, "doc_id bigint, held_out boolean, score double, predicted int")


def drop_toxic(docs: DataFrame, model: Model) -> DataFrame:
    """`docs` without the rows that the model rejects."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def clean(batches):
        for batch, texts in chunks(batches):
            yield batch.filter(pa.array([shared.value.score(x.decode()) < 0.5 for x in texts]))

    return docs.mapInArrow(clean, docs.schema)
