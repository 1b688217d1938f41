"""Registered text queries, their edge cases, and the pipeline."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tollgate.llm import bloomlm, extraction, leaks, passages, pieces, reputation, rules, simhash, toxicity
from tollgate.llm.catalog import QUERIES
from tollgate.llm.common import fold, shared_folder

ROWS = [(1, "one two three four five six seven eight nine ten", "en", "s", 5), (1, "one two three four five six seven eight nine ten", "en", "s", 5),
        (2, None, None, None, None), (None, "a b", "de", "s", 3), (3, "", "en", None, 0), (4, "the end " * 4000, "en", "s", 9),
        (5, "ONE two three four five six seven eight nine ten", "fr", "s", 5), (6, "x" * 70000, "en", "s", 1)]
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture()
def docs(spark):
    clash = {c: F.lit("other") for c in ("score", "kept", "row", "d", "t", "fp", "label", "component_id", "ids", "uid", "stratum")}
    return spark.createDataFrame(ROWS, DOCS).withColumns(clash)


@pytest.fixture()
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (1, 1, 1), (2, None, 1), (3, 0, None), (None, 1, 1), (99, 0, 1)], "doc_id long, quality int, toxic int")


@pytest.fixture()
def items(spark):
    return spark.createDataFrame([(1, "two three four five six seven"), (2, None), (3, ""), (None, "seven eight NINE ten")], "item_id long, text string")


def operators(docs, labels, items):
    model = toxicity.fit(docs, labels)
    return {
        "lm": bloomlm.score_texts(docs), "rules": rules.quality_rules(docs, labels), "leaks": leaks.find_leaks(docs, items),
        "clean": leaks.drop_leaks(docs, items), "passages": passages.remove_passages(docs), "rewrite": passages.rewrite(docs),
        "pieces": pieces.encode(docs), "near": simhash.near_duplicates(docs), "one": simhash.keep_one(docs),
        "toxic": toxicity.score(docs, model), "civil": toxicity.drop_toxic(docs, model)}


def test_nulls_repeats_and_clashing_columns_keep_every_row(docs, labels, items):
    got = {k: v.collect() for k, v in operators(docs, labels, items).items()}
    for name in ("lm", "rules", "passages", "rewrite", "pieces", "near", "toxic"):
        assert len(got[name]) == len(ROWS), name
    assert all(r.lossless for r in got["pieces"])
    # Rows 1, 1 and 5 are one text apart from case; the null and the empty text share fingerprint 0.
    assert sorted(r.doc_id for r in got["one"] if r.doc_id) == [1, 2, 4, 6] and len(got["one"]) == 5
    assert {(r.doc_id, r.item_id) for r in got["leaks"]} == {(1, 1), (1, None), (5, 1), (5, None)}
    assert len(got["clean"]) == len(ROWS) - 3
    for name in ("rewrite", "one", "clean", "civil"):
        assert set(got[name][0].asDict()) == set(docs.columns), name


def test_empty_tables(spark, docs, labels, items):
    none = docs.limit(0)
    for name, df in operators(none, labels.limit(0), items.limit(0)).items():
        assert df.count() == 0, name
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    assert extraction.extract(pages).count() == 0
    outcomes = spark.createDataFrame([], "page_id long, bad boolean")
    assert reputation.filter_urls(pages, outcomes).count() == 0
    assert bloomlm.score_texts(docs.where("doc_id is null")).count() == 1  # nothing to learn from, or one row
    assert leaks.find_leaks(docs, items.limit(0)).count() == 0


def test_fold_is_crc32_of_the_text(spark):
    import zlib

    rows = spark.range(50).select("id", fold(F.col("id")).alias("f")).collect()
    assert all(r.f == zlib.crc32(str(r.id).encode()) % 5 for r in rows)


def test_a_shared_folder_is_required_away_from_local_sessions(spark):
    assert shared_folder(spark)

    class Context:
        master = "spark://elsewhere:7077"
        _jsc = spark.sparkContext._jsc

    class Unset:
        def isDefined(self):
            return False

    class Elsewhere:
        class sparkContext:  # noqa: N801
            master = "spark://elsewhere:7077"

            class _jsc:
                @staticmethod
                def sc():
                    class Inner:
                        @staticmethod
                        def getCheckpointDir():
                            return Unset()
                    return Inner

        class conf:
            @staticmethod
            def get(key, default=None):
                return default

    with pytest.raises(ValueError):
        shared_folder(Elsewhere)


def test_all_queries_are_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))


def slow_set(text):
    w = text.lower().encode().split()
    return frozenset([b" ".join(w[i:i + 5]) for i in range(len(w) - 4)] or ([b" ".join(w)] if w else []))


def test_pipeline_equals_its_stages_by_brute_force(spark, sf):
    """Each stage against its own input: verdicts, components, bytes, leaks and pieces are recomputed from collected rows."""
    import numpy as np

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, rows = docs.columns, {r.doc_id: r for r in docs.collect()}
    kept = {}
    names = [n for n, _ in corpus_pipeline.STAGES]
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf)
        kept[name] = {r.doc_id: r for r in out.collect()}
        if name != names[-1]:
            assert out.columns == columns
        docs = spark.createDataFrame(list(kept[name].values()), out.schema)
    model = toxicity.fit(spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet"))
    assert set(kept[names[0]]) == {i for i, r in rows.items() if model.score(r.text) < 0.5}
    left = sorted(kept[names[0]])
    sets = [slow_set(rows[i].text) for i in left]
    near = np.array([[5 * len(a & b) >= 4 * len(a | b) for b in sets] for a in sets])
    label = np.arange(len(left))
    while True:
        lower = np.array([label[near[i]].min() for i in range(len(left))])
        if (lower == label).all():
            break
        label = lower
    assert set(kept[names[1]]) == {left[i] for i in set(label.tolist())}
    first: dict[bytes, tuple[int, int]] = {}
    for i in sorted(kept[names[1]]):
        text = rows[i].text.encode()
        for s in range(len(text) - 99):
            first.setdefault(text[s:s + 100], (i, s))
    for i, r in kept[names[2]].items():
        text = rows[i].text.encode()
        gone = np.zeros(len(text), bool)
        for s in range(len(text) - 99):
            if first[text[s:s + 100]] != (i, s):
                gone[s:s + 100] = True
        assert r.text.encode() == bytes(np.frombuffer(text, np.uint8)[~gone]).decode("utf-8", "ignore").encode()
        assert r.n_chars == len(r.text)
    items = [r.text.lower().split() for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    whole = {i for i, r in kept[names[2]].items() if any(" ".join(x) in " ".join(r.text.lower().split()) for x in items)}
    assert whole and not whole & set(kept[names[3]])
    assert set(kept[names[4]]) == set(kept[names[3]]) and all(r.lossless for r in kept[names[4]].values())
