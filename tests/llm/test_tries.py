"""The prefix trie against brute force."""

import collections
import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from tollgate.llm import tries
from tollgate.llm.catalog import QUERIES

SCHEMA = "conv_id long, turn long, role string, text string"
COLUMNS = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def slow_trie(table):
    turns = collections.defaultdict(list)
    for conv, turn, role, text in table:
        turns[conv].append((turn is not None, turn or 0, (role or "").encode(), (text or "").encode()))
    own = {c: [x[2:] for x in sorted(rows)] for c, rows in turns.items()}
    rebuilt = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 9 if c is not None else 0
        base = None if c is None else c - (abs(c) % 5) * (1 if c >= 0 else -1)
        rebuilt[c] = tuple((own.get(base, [])[:h] if c is not None else []) + own[c][h:])
    members, ends = collections.defaultdict(list), collections.defaultdict(list)
    for c, rows in rebuilt.items():
        for d in range(len(rows) + 1):
            members[rows[:d]].append(c)
        ends[rows].append(c)
    order = lambda c: (c is not None, c or 0)
    least = {k: min([c for c in v if c is not None], default=None) for k, v in members.items()}
    kids, leaves, saved = collections.Counter(k[:-1] for k in members if k), collections.Counter(), collections.Counter()
    for k, v in members.items():
        for d in range(len(k) + 1):
            leaves[k[:d]] += not kids[k]
            saved[k[:d]] += (len(v) - 1) * len(k[-1][1]) if k else 0
    return sorted(((least[k], len(k), least[k[:-1]] if k else None, len(v), kids[k], leaves[k], saved[k], hashlib.sha256(
        ",".join("" if c is None else str(c) for c in sorted(ends[k], key=order)).encode()).hexdigest()) for k, v in members.items()), key=str)


def found(df):
    return sorted((tuple(r[c] for c in COLUMNS) for r in df.collect()), key=str)


def odd_rows():
    rng = random.Random(11)
    texts = ["hello", "hello", "", None, "ü" * 40, "what?", "x" * 5000]
    rows = [(c, rng.choice([None, *range(14)]), rng.choice(["user", "assistant", None, ""]), rng.choice(texts))
            for c in (None, -7, -6, -5, *range(70)) for _ in range(rng.randint(1, 14))]
    rows += [(c, t, "user", f"line {t}") for c in range(200, 260) for t in range(6)]  # equal conversations
    return rows + [(300, t, "user", f"{t % 90}") for t in range(900)] + [(301, 0, "user", "same")] * 40  # a long one, and equal rows


@pytest.mark.parametrize("bucket", [tries.BUCKET, 7])
def test_trie_equals_brute_force_on_odd_rows(spark, monkeypatch, bucket):
    monkeypatch.setattr(tries, "BUCKET", bucket)
    monkeypatch.setattr(tries, "CHUNK_CHARS", 20 if bucket == 7 else 1 << 16)
    rows = odd_rows()
    df = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit("other") for c in ("depth", "f0", "u", "conv", "part", "bytes")})
    assert found(tries.prefix_trie(df.repartition(5))) == slow_trie(rows)


def test_query_equals_brute_force(spark, sf):
    rows = [tuple(r[c] for c in ("conv_id", "turn", "role", "text")) for r in spark.read.parquet(f"{sf}/conversations.parquet").collect()]
    assert found(QUERIES["op12_prefix_trie"](spark, sf)) == slow_trie(rows)


@pytest.mark.parametrize("rows", [[], [(None, None, None, None)] * 2, [(3, None, None, None)]])
def test_small_tables(spark, rows):
    assert found(tries.prefix_trie(spark.createDataFrame(rows, SCHEMA))) == slow_trie(rows)


def test_colliding_digests_are_noticed(spark, monkeypatch):
    """Digests that do not tell turns apart are found out, and others are taken."""
    honest, asked = tries.digested, []

    def poor(conversations, seed):
        asked.append(seed)
        turns = honest(conversations, seed)
        return turns.withColumns({"s0": F.lit(1).cast("long"), "s1": F.length("text").cast("long")}) if seed == 0 else turns

    monkeypatch.setattr(tries, "digested", poor)
    rows = odd_rows()[:300]
    assert found(tries.prefix_trie(spark.createDataFrame(rows, SCHEMA))) == slow_trie(rows)
    assert asked == [0, 1]
