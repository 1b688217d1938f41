"""Quality rules whose cutoffs carry a guarantee.

Every rule compares one statistic of a text with a cutoff. For each stratum (language) and rule a fixed grid of cutoffs is
tested on labelled documents, from the cutoff that rejects least down to the one that rejects most: the null hypothesis "this cutoff
rejects more than a share `risk` of the good documents" is dropped if the exact binomial tail of the observed false rejections
is at most `delta` divided by the number of sequences, one for each rule and stratum (Bonferroni). A sequence ends at the first
hypothesis that stands (fixed-sequence testing needs no correction inside it), and the last cutoff that passed is used; where none
passes, the rule stays silent in that stratum. With probability 1 - delta no rule then rejects more than its share of good documents
in any stratum.

A document is one piece of evidence however often its row is repeated: rows of one doc_id count once, as rejected if one of
them is. Documents with equal texts under different numbers count as drawn one by one, as a labelled sample of a corpus with copies is.

Null texts have no words. A null language is a stratum of its own; a document in several languages counts in the first of them. Null
labels are ignored, repeated labels of one document count once (good only if all say so). Ties and extra columns do no harm; empty
tables give empty results.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tollgate.llm.common import map_texts, pinned, words
from tollgate.operators.skew import join_keys

SYMBOLS = re.compile(rb"[#*$%&|<>]")
WINDOW = 5
STEPS = 40  # cutoffs of a rule

# Statistic, smallest cutoff, largest cutoff. A text fails a rule if its statistic is at or above the cutoff.
GRID = (
    ("symbol_share", 0.025, 1.0),
    ("dup_line_share", 0.025, 1.0),
    ("repeat_share", 0.005, 0.2),
    ("mean_word_chars", 4.2, 12.0),
)


def cutoffs(low: float, high: float) -> list[float]:
    return [round(low + (high - low) * i / (STEPS - 1), 6) for i in range(STEPS)]


def repeated_words(tokens: list[bytes]) -> int:
    """Words that lie in a five-word window occurring twice or more; ranks of pairs, fours and fives are exact."""
    n = len(tokens)
    if n <= WINDOW:
        return 0
    rank: dict[bytes, int] = {}
    ids = np.fromiter((rank.setdefault(w, len(rank)) for w in tokens), np.int64, n)
    if len(rank) == n:
        return 0
    pairs = np.unique(ids[:-1] * n + ids[1:], return_inverse=True)[1]
    fours = np.unique(pairs[:-2] * n + pairs[2:], return_inverse=True)[1]
    _, inverse, counts = np.unique(fours[:-1] * n + ids[4:], return_inverse=True, return_counts=True)
    twice = counts[inverse] > 1
    if not twice.any():
        return 0
    edges = np.zeros(n + 1, np.int64)
    at = np.flatnonzero(twice)
    np.add.at(edges, at, 1)
    np.add.at(edges, at + WINDOW, -1)
    return int((np.cumsum(edges[:-1]) > 0).sum())


def measure(text: bytes) -> tuple[int, int, int, int, int, int]:
    """Words, code points in words, symbols, repeated lines, lines, repeated words."""
    tokens = words(text)
    chars = len(b"".join(tokens).decode("utf-8", "replace"))
    seen: set[bytes] = set()
    lines = repeats = 0
    for line in text.split(b"\n"):
        if line.strip(b" \t\n\x0b\x0c\r"):
            lines += 1
            if line in seen:
                repeats += 1
            seen.add(line)
    return len(tokens), chars, len(SYMBOLS.findall(text)), repeats, lines, repeated_words(tokens)


MEASURES = "n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_lines bigint, n_repeat_words bigint"


def measured(docs: DataFrame) -> DataFrame:
    """doc_id, lang and the counts of every text, with the fixed base rule and the shares that the rules use."""
    def columns(batch, texts):
        return [batch.column(0), batch.column(1), *map(list, zip(*map(measure, texts)))]

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"),
                       F.col("text").cast("string").alias("text"))
    n = F.greatest(F.col("n_words"), F.lit(1))
    return (map_texts(rows, columns, f"doc_id bigint, lang string, {MEASURES}")
            .withColumn("base_failed", (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words")))
            .withColumn("symbol_share", F.col("n_symbols") / n)
            .withColumn("dup_line_share", F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1)))
            .withColumn("repeat_share", F.col("n_repeat_words") / n)
            .withColumn("mean_word_chars", F.col("word_chars") / n))


def binomial_tail(k: int, n: int, p: float) -> float:
    """P(X <= k) for X binomial(n, p), summed down from k until terms no longer count; exact to rounding."""
    if k >= n:
        return 1.0
    if k > n * p:
        return 1.0 - binomial_tail(n - k - 1, n, 1 - p)
    odds = (1 - p) / p
    term = math.exp(math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1) + k * math.log(p) + (n - k) * math.log1p(-p))
    total, j = 0.0, k
    while j >= 0 and term > 1e-18 * total:
        total += term
        term *= odds * j / (n - j + 1)
        j -= 1
    return min(1.0, total)


def tested(counts: DataFrame, risk: float, delta: float) -> DataFrame:
    """One row per stratum: the cutoffs that passed their test, by rule (null: none)."""
    names = [name for name, _, _ in GRID]
    share = risk / len(names)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for row in frame.itertuples(index=False):
                record = {"stratum": row.stratum, "n_good": row.n_good}
                for name, low, high in GRID:
                    record[name + "_cut"] = None
                    for i, cutoff in reversed(list(enumerate(cutoffs(low, high)))):
                        if binomial_tail(int(getattr(row, f"{name}_{i}")), int(row.n_good), share) > delta / row.n_tests:
                            break
                        record[name + "_cut"] = cutoff
                out.append(record)
            yield pd.DataFrame(out, columns=["stratum", "n_good", *[f"{n}_cut" for n in names]])

    return counts.mapInPandas(run, "stratum string, n_good bigint, " + ", ".join(f"{n}_cut double" for n in names))


def select_cutoffs(stats: DataFrame, labels: DataFrame, risk: float = 0.02, delta: float = 0.05) -> DataFrame:
    """Certified cutoffs per stratum from labelled rows. Good documents that already fail the base rule are not counted."""
    good = (labels.where("doc_id is not null and quality is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id"))
            .agg(F.min(F.col("quality").cast("int")).alias("good")).where("good = 1"))
    rejections = [F.count(F.when(F.col(name) >= c, 1)).alias(f"{name}_{i}")
                  for name, low, high in GRID for i, c in enumerate(cutoffs(low, high))]
    votes = stats.where("not base_failed").groupBy("doc_id").agg(
        F.min(stratum(F.col("lang"))).alias("stratum"), *[F.max(name).alias(name) for name, _, _ in GRID])
    counts = votes.join(good, "doc_id").groupBy("stratum").agg(F.count(F.lit(1)).alias("n_good"), *rejections)
    tests = counts.agg((F.count(F.lit(1)) * len(GRID)).alias("n_tests"))
    return tested(counts.withColumn("n_tests", tests.scalar()), risk, delta)


def stratum(lang: Column) -> Column:
    return F.coalesce(lang, F.lit(""))


def quality_rules(docs: DataFrame, labels: DataFrame, risk: float = 0.02, delta: float = 0.05) -> DataFrame:
    """Counts, base rule and verdict of every document."""
    stats = pinned(measured(docs))  # read twice: the texts are not
    chosen = pinned(select_cutoffs(stats, labels, risk, delta).drop("n_good"))
    failed = [F.coalesce(F.col(name) >= F.col(name + "_cut"), F.lit(False)) for name, _, _ in GRID]
    fails = failed[0]
    for other in failed[1:]:
        fails = fails | other
    return (join_keys(stats.withColumn("stratum", stratum(F.col("lang"))), chosen, "stratum")
            .withColumn("kept", ~(F.col("base_failed") | fails)))
