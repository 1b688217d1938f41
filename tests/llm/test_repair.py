"""Conversation repair against brute force."""

import hashlib
import itertools
import random
import zlib

import pytest
from pyspark.sql import functions as F

from tollgate.llm import repair
from tollgate.llm.catalog import QUERIES

BLANKS = " \t\n\v\f\r"


def slow_best(rows):
    """Least (cost, audit) by extending audits row by row; rows are (initial, must go, cut off)."""
    best = {"": (0, "")}  # role initials so far, as far as they matter
    nexts = {"": "su", "s": "u", "u": "a", "a": "u"}

    def inserted(best):
        out = dict(best)
        for _ in range(2):
            for state, (cost, audit) in list(out.items()):
                for step in nexts[state].replace("s", ""):
                    out[step] = min(out.get(step, (10**9, "")), (cost + 5, audit + "I"))
        return out

    for initial, gone, cut in rows:
        out = {}
        for state, (cost, audit) in inserted(best).items():
            options = [(state, cost + 2, audit + "D")]
            if not gone:
                if initial and initial in nexts[state]:
                    options.append((initial, cost + 5 * cut, audit + "K"))
                options += [(step, cost + 1 + 5 * cut, audit + "R") for step in nexts[state].replace("s", "")]
            for state2, *value in options:
                out[state2] = min(out.get(state2, (10**9, "")), tuple(value))
        best = out
    return min(v for k, v in inserted(best).items() if k in ("", "a"))


def slow_repair(table):
    out = {}
    for conv in {r[0] for r in table}:
        rows = []
        for c, turn, role, text in table:
            if c != conv:
                continue
            kind = zlib.crc32(f"{' ' if c is None else c}:{' ' if turn is None else turn}".encode()) % 20
            role, text = " " if role is None else role, " " if text is None else text
            text = "" if kind == 1 else "".join(x for x in text if x not in ".!?") if kind == 2 else text
            rows += [(turn is not None, turn or 0, "user" if kind == 4 else role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
        rows.sort(key=lambda r: (r[0], r[1], r[2].encode(), r[3].encode()))
        turns, faults, seen = [r[1] for r in rows if r[0]], [], set()
        for _, _, role, text in rows:
            bare = text.strip(BLANKS)
            faults.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else "")
            seen.add((role, text))
        cost, audit = slow_best([(r[2][:1], f in ("blank", "duplicate"), f == "truncated") for r, f in zip(rows, faults)])
        kept, at, last = [], iter(rows), ""
        for edit in audit:
            step = "a" if last == "u" else "u"
            name = {"u": "user", "a": "assistant"}[step]
            if edit == "I":
                kept.append(f"{name}:")
            else:
                row = next(at)
                if edit == "D":
                    continue
                step = row[2][0] if edit == "K" else step
                kept.append(f"{row[2] if edit == 'K' else name}:{row[3]}")
            last = step
        out[conv] = (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, *(faults.count(f) for f in ("blank", "duplicate", "truncated")),
                     sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:])), cost, audit,
                     hashlib.sha256("\n".join(kept).encode()).hexdigest())
    return out


COLUMNS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def found(df):
    rows = df.collect()
    assert len({r.conv_id for r in rows}) == len(rows)
    return {r.conv_id: tuple(r[c] for c in COLUMNS) for r in rows}


def odd_rows():
    rng = random.Random(5)
    texts = ["yes.", "no", "Why?", " ", "", None, "\n", "a. ", "end!\t", "long " * 300 + "."]
    rows = [(conv, rng.choice([None, *range(12)]), rng.choice(["user", "assistant", "system", "tool", "", None, "sys", "uaua"]), rng.choice(texts))
            for conv in (None, -7, *range(60)) for _ in range(rng.randint(1, 9))]
    # One conversation with a large share of the rows, and many equal rows.
    rows += [(500, t, ("user", "assistant")[t % 2 ^ (t % 13 == 0)], f"{t % 50} ok" + "." * (t % 7 > 0)) for t in range(700)]
    return rows + [(501, None, "user", "same.")] * 90 + [(502, 3, "assistant", "same.")] * 40


def test_cells_equal_every_sequence_of_edits():
    kinds = [("s", False, False), ("u", False, True), ("a", False, False), ("", False, False), ("u", True, False)]
    for size in range(5):
        for rows in itertools.product(kinds, repeat=size):
            spans = repair.Spans()
            for row in rows:
                spans.add(repair.ROW_CELLS[row])
            assert repair.cheapest(spans.cell()) == slow_best(rows)


def test_cells_do_not_depend_on_where_spans_are_joined():
    rng = random.Random(1)
    rows = [rng.choice(list(repair.ROW_CELLS.values())) for _ in range(40)]
    whole = repair.Spans()
    for row in rows:
        whole.add(row)
    for cut in range(41):
        left, right = repair.Spans(), repair.Spans()
        for i, row in enumerate(rows):
            (left if i < cut else right).add(row)
        assert repair.joined(left.cell(), right.cell()) == whole.cell()
    same, single = repair.Spans(), rows[0]
    for _ in range(23):
        same.add(single)
    assert repair.repeated(single, 23) == same.cell()


def test_repair_equals_brute_force_on_odd_rows(spark):
    rows = odd_rows()
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns(
        {c: F.lit("other") for c in ("copies", "blank", "part", "audit", "cell")})
    assert found(repair.repair(df.repartition(3))) == slow_repair(rows)


def test_query_equals_brute_force(spark, sf):
    rows = [tuple(r[c] for c in ("conv_id", "turn", "role", "text")) for r in spark.read.parquet(f"{sf}/conversations.parquet").collect()]
    assert found(QUERIES["op13_interval_repair"](spark, sf)) == slow_repair(rows)


@pytest.mark.parametrize("rows", [[], [(1, 1, None, None)], [(None, None, None, None)] * 2])
def test_small_tables(spark, rows):
    assert found(repair.repair(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))) == slow_repair(rows)
