"""Benchmark leaks by embedding edit distance into Hamming distance.

Texts are sequences of lower-cased words. From every word of every document a random walk reads the following words: at step j
it writes the word under the pointer and moves on if a random bit of (j, word) is set. Two windows at a small edit distance
then write equal words at most steps, so keys of a few sampled steps meet (bit-sampling hashing), and `REPEATS` independent
walks with their own samples raise the recall. The same walks start at every word of a benchmark item, in windows that fit the
item, so an edit anywhere leaves other windows intact. Whatever meets is verified: an item leaks if some span of the document
is within `rate` of the item's words by exact edit distance.

Step 0 is part of every sample and samples are read in order, so a window is dropped at the first step whose word no item has
there; this changes no key. The benchmark is read in blocks of at most `BLOCK_BYTES`; documents never meet each other, so hot
sources, copies and repeated rows do no harm. Null texts and texts without words match nothing, in either table.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tollgate.llm.common import map_texts, mix, words

WINDOW = 8  # words
SAMPLES = 7  # steps in a key
REPEATS = 6
RATE = 0.2
BLOCK_BYTES = 2 << 20
SEED = 7
BITMAP = (16, 22)  # least and most bits of the table of key prefixes


class Walk:
    """Keys of one walk over windows of `width` words, for items given as word numbers (0: a word of no item)."""

    def __init__(self, width: int, repeat: int, vocabulary: int, windows: np.ndarray, owner: np.ndarray):
        rng = np.random.default_rng([SEED, width, repeat])
        steps = 2 * width
        chosen = rng.choice(np.arange(1, steps), min(SAMPLES, width) - 1, replace=False) if width > 1 else []
        self.width, self.sample = width, sorted([0, *map(int, chosen)])
        self.moves = rng.integers(0, 2, (self.sample[-1] + 1, vocabulary), dtype=np.int32)
        self.bits = min(max(BITMAP[0], (16 * len(windows)).bit_length()), BITMAP[1])
        self.known: list[np.ndarray] = []
        at, keys = self.read(np.append(windows.ravel(), np.zeros(width, np.int64)), np.arange(len(windows)) * width, learn=True)
        order = np.argsort(keys, kind="stable")
        self.keys, self.owner = keys[order], owner[at[order] // width]

    def read(self, ids: np.ndarray, starts: np.ndarray, learn: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """(start, key) of the windows at `starts` whose sampled words all occur at that step of some item."""
        moved = np.zeros(len(starts), np.int32)
        key = np.zeros(len(starts), np.uint64)
        for step in range(self.sample[-1] + 1):
            inside = moved < self.width
            word = np.where(inside, ids[np.minimum(starts + moved, len(ids) - 1)], 0)
            if step in self.sample:
                key = mix(key + (word + inside).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(step))
                slot = (key >> np.uint64(64 - self.bits)).astype(np.int64)
                if learn:
                    table = np.zeros(1 << self.bits, bool)
                    table[slot] = True
                    self.known.append(table)
                else:
                    alive = self.known[self.sample.index(step)][slot]
                    starts, moved, key, word = starts[alive], moved[alive], key[alive], word[alive]
            moved = moved + self.moves[step][word]
        return starts, key

    def meet(self, ids: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(start, number of the item window) of every meeting."""
        at, keys = self.read(ids, starts)
        low, high = np.searchsorted(self.keys, keys), np.searchsorted(self.keys, keys, side="right")
        count = high - low
        which = np.repeat(low - (np.cumsum(count) - count), count) + np.arange(count.sum())
        return np.repeat(at, count), self.owner[which]


class Benchmark:
    """Items of one block, their words and walks."""

    def __init__(self, texts: tuple[bytes, ...], rate: float):
        self.items = [words(t.lower()) for t in texts]
        self.number = {w: i + 1 for i, w in enumerate(sorted({w for item in self.items for w in item}))}
        self.ids = [np.array([self.number[w] for w in item], np.int64) for item in self.items]
        self.members = [frozenset(ids.tolist()) for ids in self.ids]
        self.errors = [int(rate * len(item)) for item in self.items]
        by_width: dict[int, list[tuple[int, int]]] = {}
        for i, ids in enumerate(self.ids):
            width = min(WINDOW, len(ids) - self.errors[i])
            if width > 0:
                by_width.setdefault(width, []).extend((i, off) for off in range(len(ids) - width + 1))
        self.owners, self.walks = [], []
        for width, places in by_width.items():
            windows = np.array([self.ids[i][off:off + width] for i, off in places])
            base = len(self.owners)
            self.owners += places
            self.walks += [Walk(width, r, len(self.number) + 1, windows, base + np.arange(len(places))) for r in range(REPEATS)]
        self.owner_item = np.array([x[0] for x in self.owners], np.int64)
        self.owner_offset = np.array([x[1] for x in self.owners], np.int64)

    def candidates(self, ids: np.ndarray, ends: np.ndarray) -> dict[tuple[int, int], set[int]]:
        """(text, item) to the places where the item would start; `ids` are the words of all texts, `ends` where each stops."""
        found: dict[tuple[int, int], set[int]] = {}
        for walk in self.walks:
            begin = np.flatnonzero(ids)
            at, owner = walk.meet(ids, begin)
            text = np.searchsorted(ends, at, side="right")
            item, place = self.owner_item[owner], at - self.owner_offset[owner]
            for row in np.unique(np.stack((text, item, place), axis=1), axis=0) if len(at) else ():
                found.setdefault((int(row[0]), int(row[1])), set()).add(int(row[2]))
        return found

    def leaks(self, texts: list[bytes]) -> list[tuple[int, int, int, int, int]]:
        """(text, item, distance, first word, words of the span), the best span of every leaking pair."""
        tokens = [words(t.lower()) for t in texts]
        ends = np.cumsum([len(x) for x in tokens])
        get = self.number.get
        ids = np.array([get(w, 0) for x in tokens for w in x], np.int64)
        if not len(ids):
            return []
        out = []
        for (text, i), places in sorted(self.candidates(ids, ends).items()):
            item, errors = self.ids[i], self.errors[i]
            low, high = int(ends[text - 1]) if text else 0, int(ends[text])
            best, edge, member = None, None, self.members[i]
            for place in sorted(places):
                if edge is not None and place <= edge:  # this start lies in the span that was just searched
                    continue
                begin, stop = max(low, place - errors), min(high, place + len(item) + 3 * errors + WINDOW)
                edge = place + errors
                if sum(map(member.__contains__, ids[begin:stop].tolist())) < len(item) - errors:
                    continue
                got = span_distance(item, ids[begin:stop])
                if got[0] <= errors and (best is None or got[0] < best[0]):
                    best = (got[0], begin + got[1] - low, got[2] - got[1])
            if best:
                out.append((text, i, *best))
        return out


def last_row(item: np.ndarray, text: np.ndarray) -> np.ndarray:
    """Edit distance of the item to the nearest span of the text that ends at each place."""
    steps = np.arange(len(text) + 1)
    row = np.zeros(len(text) + 1, np.int64)
    for i, word in enumerate(item.tolist(), 1):
        new = np.minimum(row[:-1] + (text != word), row[1:] + 1)
        row = np.minimum.accumulate(np.concatenate(([i], new)) - steps) + steps
    return row


def span_distance(item: np.ndarray, text: np.ndarray) -> tuple[int, int, int]:
    """Smallest edit distance of the item to a span of the text, and the span (first end, then shortest)."""
    row = last_row(item, text)
    end = int(np.argmin(row))
    back = last_row(item[::-1], text[:end][::-1])
    return int(row[end]), end - int(np.flatnonzero(back == row[end])[0]) if row[end] < len(item) else end, end


@functools.lru_cache(maxsize=2)
def prepared(texts: tuple[bytes, ...], rate: float) -> Benchmark:
    return Benchmark(texts, rate)


def blocks(benchmark: DataFrame) -> list[list]:
    """The items in blocks of about BLOCK_BYTES, one block at a time in memory."""
    rows = benchmark.select("item_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    size = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    count = max(1, -(-size // BLOCK_BYTES))
    for i in range(count):
        yield rows.where(F.pmod(F.xxhash64("item_id"), F.lit(count)) == i).orderBy("item_id", "text").collect()


def find_leaks(docs: DataFrame, benchmark: DataFrame, rate: float = RATE) -> DataFrame:
    """doc_id, item_id, distance, n_item_words, first_word and n_span_words of every leaking pair."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    kind = benchmark.schema["item_id"].dataType.simpleString()
    schema = f"doc_id bigint, item_id {kind}, distance int, n_item_words int, first_word int, n_span_words int"
    out = None
    for block in blocks(benchmark):
        shared = docs.sparkSession.sparkContext.broadcast(([r.item_id for r in block], tuple(r.text.encode() for r in block)))

        def columns(batch, texts, shared=shared):
            names, items = shared.value
            known = prepared(items, rate)
            found = known.leaks(texts)
            if not found:
                return None
            text, item, distance, first, span = map(list, zip(*found))
            return [batch.column(0).take(pa.array(text)), [names[i] for i in item], distance, [len(known.ids[i]) for i in item], first, span]

        part = map_texts(rows, columns, schema)
        out = part if out is None else out.unionByName(part)
    return out


def drop_leaks(docs: DataFrame, benchmark: DataFrame, rate: float = RATE) -> DataFrame:
    """`docs` without the rows that hold an item."""
    for block in blocks(benchmark):
        shared = docs.sparkSession.sparkContext.broadcast(tuple(r.text.encode() for r in block))

        def clean(batches, shared=shared):
            from tollgate.llm.common import chunks

            for batch, texts in chunks(batches):
                bad = {x[0] for x in prepared(shared.value, rate).leaks(texts)}
                yield batch.filter(pa.array([i not in bad for i in range(len(texts))]))

        docs = docs.mapInArrow(clean, docs.schema)
    return docs
