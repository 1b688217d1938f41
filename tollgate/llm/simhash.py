"""Near-duplicates by SimHash, found through keys of the binary Golay code.

The 64 bits of a fingerprint form three segments of 22, 21 and 21 bits. Two fingerprints that differ in at most four bits
either agree in a whole segment, or have errors in all three and then two segments with exactly one error (1 + 1 + 2 or less).

* Agreeing segment: the other 42 or 43 bits hold at most four errors, so of their five pieces one agrees. The key is segment
  and piece: 15 keys.
* Two segments with one error each: a segment is read as a 23-bit word of the perfect Golay code. Words one bit apart share a
  codeword within distance four of both, and a word has one or six of those. The key is a pair of codeword indices, for each of
  the three pairs of segments: up to 108 keys, 84 on average.

Texts with equal fingerprints are one class, so keys are made once per class. Keys are shuffled, sorted and read in runs; every
candidate is verified. A run emits a spanning forest, never its pairs. A run above `MOST` classes is not compared inside one
task: its members get the keys "all words within two bits", where two words within four bits always meet, at most 2,081 in one
run, and runs are chained. No link is lost either way. Components come from distributed contraction.

Null and empty texts have fingerprint 0 and are linked like others. Repeated rows and repeated doc_ids each keep their row. A
null doc_id gets the component of its class and never names one unless nothing else is in it. Only doc_id and text are read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tollgate.llm.common import map_texts, parts, pinned, words
from tollgate.llm.graph import components, forest
from tollgate.operators.skew import join_keys

SHINGLE = 4
SEED = 42
DISTANCE = 4
MOST = 16_384  # classes compared inside one task
PAIRED = 32  # runs up to this size are compared by offsets, larger ones by search
BLOCK = 65_536

# Generator of the binary Golay code [23, 12, 7], and the segments as (lowest bit, bits).
GENERATOR = 0b101011100011
SEGMENTS = ((0, 22), (22, 21), (43, 21))


def shingle_hashes(text: bytes, size: int = SHINGLE) -> list[int]:
    """A hash of every `size` successive words, in lower case; a shorter text counts as one shingle, one without words has none."""
    tokens = words(text.lower())
    if not tokens:
        return []
    line, n = b" ".join(tokens), len(tokens)
    if n < size:
        return [xxhash.xxh64_intdigest(line, SEED)]
    ends = (np.cumsum(np.fromiter(map(len, tokens), np.int64, n) + 1) - 1).tolist()
    starts = [0, *(e + 1 for e in ends[:n - size])]
    digest = xxhash.xxh64_intdigest
    return [digest(line[a:b], SEED) for a, b in zip(starts, ends[size - 1:])]


def fingerprint(text: bytes) -> int:
    hashes = shingle_hashes(text)
    if not hashes:
        return 0
    bits = np.unpackbits(np.array(hashes, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    over = 2 * bits.sum(axis=0, dtype=np.int64) > len(hashes)
    return int(np.packbits(over, bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id and fingerprint (as a signed number) of every row."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return map_texts(rows, lambda batch, texts: [batch.column(0), list(map(fingerprint, texts))], "doc_id bigint, fp bigint")


def syndrome(words_: np.ndarray) -> np.ndarray:
    out = words_.astype(np.int64)
    for bit in range(22, 10, -1):
        out = np.where(out >> bit & 1, out ^ (GENERATOR << (bit - 11)), out)
    return out


def near_errors() -> np.ndarray:
    """For each of the 2,048 syndromes the error patterns of weight four or less; rows are padded with their first one."""
    found: list[list[int]] = [[] for _ in range(2048)]
    patterns = [sum(1 << b for b in c) for weight in range(5) for c in combinations(range(23), weight)]
    for pattern, s in zip(patterns, syndrome(np.array(patterns))):
        found[s].append(pattern)
    width = max(map(len, found))
    return np.array([row + row[:1] * (width - len(row)) for row in found])


def search_keys(fps: np.ndarray, near: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(key, position) of every key of the fingerprints."""
    word = fps.view(np.uint64)
    segment = [(word >> np.uint64(low) & np.uint64((1 << size) - 1)).astype(np.int64) for low, size in SEGMENTS]
    at = np.arange(len(fps))
    keys, places = [], []
    for s in range(3):
        (_, size_a), (_, size_b) = (SEGMENTS[i] for i in range(3) if i != s)
        a, b = (segment[i] for i in range(3) if i != s)
        rest, size = a | b << size_a, size_a + size_b
        for piece in range(5):
            low, high = size * piece // 5, size * (piece + 1) // 5
            keys.append((s * 5 + piece) << 40 | segment[s] << 9 | rest >> low & (1 << (high - low)) - 1)
            places.append(at)
    index = [(near[syndrome(x)] ^ x[:, None]) >> 11 for x in segment]  # codeword indices; padded with the first one
    fresh = [np.concatenate((np.ones((len(x), 1), bool), x[:, 1:] != x[:, :1]), axis=1) for x in index]
    for k, (i, j) in enumerate(combinations(range(3), 2)):
        both = fresh[i][:, :, None] & fresh[j][:, None, :]
        keys.append(((15 + k) << 40 | index[i][:, :, None] << 12 | index[j][:, None, :])[both])
        places.append(np.broadcast_to(at[:, None, None], both.shape)[both])
    return np.concatenate(keys), np.concatenate(places)


def search(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links inside one run, by breadth-first search in blocks."""
    left, out_a, out_b = fps, [], []
    while len(left) > 1:
        root, wave, left = left[0], left[:1], left[1:]
        while len(wave) and len(left):
            hit = (np.bitwise_count(wave[:256, None] ^ left[None, :]) <= DISTANCE).any(axis=0)
            new, left, wave = left[hit], left[~hit], wave[256:]
            out_a.append(new)
            out_b.append(np.full(len(new), root))
            wave = np.concatenate((wave, new))
    return (np.concatenate(out_a), np.concatenate(out_b)) if out_a else (fps[:0], fps[:0])


def run_links(keys: np.ndarray, fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Forest of the links of whole runs of equal keys."""
    first = np.flatnonzero(np.diff(keys, prepend=keys[0] - 1))
    size = np.diff(np.append(first, len(keys)))
    out = [search(fps[a:a + n]) for a, n in zip(first[size > PAIRED], size[size > PAIRED])]
    at, step = np.flatnonzero(np.repeat(size <= PAIRED, size)), 1
    while len(at):
        at = at[at + step < len(keys)]
        at = at[keys[at] == keys[at + step]]
        a, b = fps[at], fps[at + step]
        linked = (np.bitwise_count(a ^ b) <= DISTANCE) & (a != b)
        out.append((a[linked], b[linked]))
        step += 1
    return forest(np.concatenate([x[0] for x in out]), np.concatenate([x[1] for x in out])) if out else (fps[:0], fps[:0])


def read_runs(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """Links (hot = false), or members of runs above `most` (hot = true), from rows sorted by key."""
    def give(a, b, hot):
        return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64)),
                                           pa.array(np.full(len(a), hot))], ["a", "b", "hot"])

    keys, fps, hot_key = np.zeros(0, np.int64), np.zeros(0, np.uint64), None

    def settled(keys, fps):
        a, b = run_links(keys, fps)
        if len(a):
            yield give(a, b, False)

    for batch in batches:
        keys = np.concatenate((keys, batch.column(0).to_numpy()))
        fps = np.concatenate((fps, batch.column(1).to_numpy().view(np.uint64)))
        if hot_key is not None:  # the rest of a hot run passes through
            cut = np.searchsorted(keys, hot_key, side="right")
            if cut:
                yield give(fps[:cut], fps[:cut], True)
            keys, fps = keys[cut:], fps[cut:]
            if len(keys):
                hot_key = None
        if len(keys) >= BLOCK or len(keys) > most:
            cut = np.searchsorted(keys, keys[-1])  # the last run may go on
            if cut:
                yield from settled(keys[:cut], fps[:cut])
                keys, fps = keys[cut:], fps[cut:]
            if len(keys) > most:
                hot_key = keys[-1]
                yield give(fps, fps, True)
                keys, fps = keys[:0], fps[:0]
    if len(keys):
        yield from settled(keys, fps)


def centres(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All words within two bits of every fingerprint."""
    masks = [0, *(1 << i for i in range(64)), *(1 << i | 1 << j for i, j in combinations(range(64), 2))]
    flips = np.array(masks, np.uint64)
    for batch in batches:
        fps = batch.column(0).to_numpy().view(np.uint64)
        for start in range(0, len(fps), 256):
            some = fps[start:start + 256]
            yield pa.RecordBatch.from_arrays([pa.array((some[:, None] ^ flips).ravel().view(np.int64)),
                                              pa.array(np.repeat(some, len(flips)).view(np.int64))], ["key", "fp"])


def chained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each member of a run linked with the one before it."""
    last_key, last_fp = np.zeros(0, np.int64), np.zeros(0, np.int64)
    for batch in batches:
        keys = np.concatenate((last_key, batch.column(0).to_numpy()))
        fps = np.concatenate((last_fp, batch.column(1).to_numpy()))
        same = keys[1:] == keys[:-1]
        a, b = forest(fps[1:][same], fps[:-1][same])
        if len(a):
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])
        last_key, last_fp = keys[-1:], fps[-1:]


def links(classes: DataFrame, most: int = MOST) -> DataFrame:
    """A spanning forest (a, b) of all links between the distinct fingerprints `classes(fp)`."""
    def keyed(batches):
        near = near_errors()
        for batch in batches:
            for start in range(0, batch.num_rows, 2048):
                fps = batch.column(0).slice(start, 2048).to_numpy()
                keys, places = search_keys(fps, near)
                yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(fps[places])], ["key", "fp"])

    def dealt(df: DataFrame) -> DataFrame:
        return df.repartition(parts(df), "key").sortWithinPartitions("key", "fp")

    # Short rows come out of an aggregate in few tasks; their keys are made in as many as the keys are dealt to.
    spread = classes.select("fp").repartition(parts(classes), "fp")
    found = pinned(dealt(spread.mapInArrow(keyed, "key bigint, fp bigint"))
                   .mapInArrow(lambda batches: read_runs(batches, most), "a bigint, b bigint, hot boolean"))
    hot = found.where("hot").select(F.col("a").alias("fp")).distinct()
    chains = dealt(hot.mapInArrow(centres, "key bigint, fp bigint")).mapInArrow(chained, "a bigint, b bigint")
    return found.where("not hot").select("a", "b").unionByName(chains)


def assigned(prints: DataFrame, classes: DataFrame, labels: DataFrame) -> DataFrame:
    """`prints(doc_id, fp)` with component_id, the smallest doc_id of all classes under one label."""
    named = (classes.join(labels.withColumnRenamed("node", "fp"), "fp", "left")
             .where("n > 1 or label is not null"))
    linked = named.where("label is not null").groupBy("label").agg(F.min("least").alias("component"))
    known = pinned(join_keys(named, linked, "label").select("fp", F.coalesce("component", "least").alias("component")))
    return join_keys(prints, known, "fp").select("doc_id", "fp", F.coalesce("component", "doc_id").alias("component_id"))


def near_duplicates(docs: DataFrame, most: int = MOST) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id (smallest doc_id reachable) of every row."""
    prints = pinned(fingerprints(docs))
    classes = prints.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("n"))
    return assigned(prints, classes, components(links(classes, most))).select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, most: int = MOST, judge: Callable[[DataFrame, int], DataFrame] = near_duplicates) -> DataFrame:
    """`docs` with one row of every component that `judge` finds: the one with the smallest doc_id."""
    repeated = docs.groupBy(F.col("doc_id").alias("k")).count().where("count > 1 or k is null")
    if repeated.isEmpty():
        judged = judge(docs, most)
        return join_keys(docs, judged.where("doc_id <> component_id").select("doc_id"), "doc_id", "left_anti")
    # Rows that doc_id does not tell apart are numbered; the numbers hold because the numbered rows are written out.
    numbered = pinned(docs.withColumn("__row", F.monotonically_increasing_id()))
    judged = judge(numbered.select(F.col("__row").alias("doc_id"), "text"), most)
    dropped = judged.where("doc_id <> component_id").select(F.col("doc_id").alias("__row"))
    return join_keys(numbered, dropped, "__row", "left_anti").drop("__row")
