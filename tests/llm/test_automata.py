"""Removal of repeated word windows against brute force."""

import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest
import zstandard
from pyspark.sql import functions as F

from tollgate.llm import automata
from tollgate.llm.catalog import QUERIES


def slow_removal(rows):
    """(n_words, n_removed, kept_sha256) of (doc_id, text) rows, by every window of the corpus."""
    words = [(d, (text or "").encode().split()) for d, text in rows]
    first: dict = {}
    for d, w in words:
        at = -(1 << 63) if d is None else d
        for s in range(len(w) - 19):
            key = tuple(w[s:s + 20])
            first[key] = min(first.get(key, (at, s)), (at, s))
    out = []
    for d, w in words:
        gone = [False] * len(w)
        for s in range(len(w) - 19):
            if first[tuple(w[s:s + 20])] != (-(1 << 63) if d is None else d, s):
                gone[s:s + 20] = [True] * 20
        kept = [x for x, g in zip(w, gone) if not g]
        out.append((d, len(w), sum(gone), hashlib.sha256(b" ".join(kept)).hexdigest()))
    return sorted(out, key=str)


def found(df):
    return sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in df.select(
        "row.doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256")).collect()), key=str)


def odd_rows():
    rng = random.Random(7)
    vocabulary = ["a", "b", "ü", "x.", "Word", "word", *(str(i) for i in range(60))]
    passages = [[rng.choice(vocabulary) for _ in range(rng.randint(15, 90))] for _ in range(9)]
    rows = [(None, "z " * 45), (900, None), (901, ""), (902, " \n\t"), (903, "\v".join(["z"] * 50)), (904, "y " * 3000), (905, "only nineteen " * 9)]
    for d in range(90):
        text = []
        for _ in range(rng.randint(0, 4)):
            text += [rng.choice(vocabulary) for _ in range(rng.randint(0, 30))]
            passage = list(rng.choice(passages))
            if rng.random() < 0.5 and passage:
                passage[rng.randrange(len(passage))] = "edited"
            text += passage[rng.randint(0, 3):]
        rows.append((rng.choice([d, d, d, 5]), rng.choice([" ", "\n", " \t"]).join(text)))
    return rows + rows[-3:]  # repeated rows


@pytest.mark.parametrize("most", [automata.MOST, 2])
def test_removal_equals_brute_force_on_odd_rows(spark, most):
    rows = odd_rows()
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit("other") for c in ("a", "d", "t", "row", "kept", "spans")})
    assert found(automata.remove_windows(df.repartition(6), most)) == slow_removal(rows)


def test_query_equals_brute_force(spark, sf):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in QUERIES["op11_phrase_automata"](spark, sf).collect()), key=str)
    assert got == slow_removal(rows)
    assert sum(r[2] for r in got) > 0


def test_small_tables(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert automata.remove_windows(empty).count() == 0
    rows = [(1, " ".join(map(str, range(25)))), (2, " ".join(map(str, range(3, 23))))]
    assert found(automata.remove_windows(spark.createDataFrame(rows, "doc_id long, text string"))) == slow_removal(rows)


def test_blocks_and_parts_of_long_texts(monkeypatch):
    text = " ".join(str(i % 37) for i in range(4000)).encode()
    whole = list(automata.word_blocks(text))
    monkeypatch.setattr(automata, "BLOCK_BYTES", 100)
    blocks = list(automata.word_blocks(text))
    assert len(blocks) > 50 and [w for _, b in blocks for w in b] == whole[0][1]
    assert [f for f, _ in blocks] == np.cumsum([0] + [len(b) for _, b in blocks[:-1]]).tolist()
    zero = np.zeros(1, np.int64)
    a, p, d, t, s, e, known = automata.parsed([text], zero, zero)
    starts = [x for i, j in zip(s, e) for x in range(i, j + 1)]
    assert sorted(starts) == list(range(4000 - 19)) and known.any()
    packed = zstandard.compress(text)
    spans = [{"a": 1, "s": 3, "e": 9}, {"a": 2, "s": 5, "e": 40}, {"a": 3, "s": 3000, "e": 3000}, {"a": 4, "s": 3980, "e": 3980}]
    batch = pa.RecordBatch.from_arrays([pa.array([1]), pa.array([0]), pa.array([packed]), pa.array([spans])], ["d", "t", "z", "search"])
    (out,) = automata.part_words(iter([batch]))
    assert out.column(4).to_pylist() == [b" ".join(whole[0][1][x["s"]:x["e"] + 20]) for x in spans]
    monkeypatch.undo()
    again = automata.parsed([text], zero, zero)
    assert sorted(x for i, j in zip(again[4], again[5]) for x in range(i, j + 1)) == sorted(starts)


def test_an_automaton_finds_every_occurrence_at_words_only():
    texts = [[b"%d" % (i * k % 997) for i in range(60)] for k in (1, 1, 2)]
    speller = automata.Speller(texts)
    spelled = list(map(speller.spell, texts))
    passages = automata.passages_of(spelled)
    assert len(passages) == 41
    assert sum(1 for x in spelled for _ in automata.compiled(passages).iter(x)) == 82
    assert automata.repeats([1, 2, 3], [0, 5, 0], texts) == ([1] * 41, list(range(5, 46)))
