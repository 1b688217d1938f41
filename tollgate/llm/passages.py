"""Exact removal of repeated 100-byte strings by distributed prefix-free parsing.

A byte goes if a string of `LENGTH` bytes covers it that also starts earlier in the corpus (smaller doc_id, or the same
document and an earlier start). Strings never cross documents and are judged on the input.

1. Parse. The trigger of a string is the leftmost smallest rolling hash of its `GRAM`-byte substrings, so equal strings have
   equal triggers at equal places, and there is one for every string. Neighbouring strings with one trigger form a phrase:
   the bytes that they cover. Equal phrases repeat all their strings, so every occurrence of a phrase but its first in corpus
   order is removed as a whole. Occurrences that repeat inside one slice of a map task are settled there and leave as merged
   spans; only the first of each slice is shuffled, by trigger.
2. Dictionary. What is left are first occurrences. A phrase whose trigger belongs to no other phrase has no repeated string.
   The others are the dictionary that has to be searched: phrases are gathered by trigger, and all their strings (suffixes cut
   to `LENGTH`) are sorted, equal ones in corpus order. In this suffix array every string that equals its predecessor goes.
   A trigger with more than `MOST` phrases is not handled in one task: its suffixes are sorted by Spark over all tasks.
3. Rewrite. Spans are merged per document and cut out.

Sorting decides on bytes; phrases are compared by 64 bits of their trigger and 64 more of their content.

Null texts are empty. A null doc_id counts as the smallest. Rows with one doc_id are one document: strings at the same start
are not earlier than each other, and rows with different texts are told apart by a hash of the text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from tollgate.llm.common import chunks, parts, pinned, slices

LENGTH = 100
GRAM = 24
MOST = 16_384  # phrases of one trigger that are sorted inside one task
SLICE_BYTES = 2 << 20
BLOCK_BYTES = 1 << 19  # parsed at once
PLACE = np.uint64(28)  # bits for a position in a block
BLOCK_ROWS = 4_096
FACTORS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD], np.uint64)
SPAN = "d bigint, t bigint, s int, e int"


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """Hash of the GRAM bytes from every position, from hashes of 2, 4, 8 and 16 bytes."""
    def joined(left, right, k):
        h = left * FACTORS[k] + (right ^ right >> np.uint64(29))
        return h ^ h >> np.uint64(32)

    h, sizes = data.astype(np.uint64) * FACTORS[0], {}
    for k, n in enumerate((1, 2, 4, 8)):
        h = joined(h[:-n], h[n:], k)
        sizes[2 * n] = h
    return joined(sizes[16][:len(data) - GRAM + 1], sizes[8][16:], 4)


def parse(data: bytes, sizes: np.ndarray) -> tuple[np.ndarray, ...]:
    """Phrases of texts that lie one after another in `data`: trigger hash, text number, first and last start (in `data`)."""
    none = np.zeros(0, np.int64)
    if len(data) < LENGTH:
        return none.astype(np.uint64), none, none, none
    hashes = gram_hashes(np.frombuffer(data, np.uint8))
    low = hashes >> PLACE << PLACE | np.arange(len(hashes), dtype=np.uint64)
    width, span = 1, LENGTH - GRAM + 1
    while 2 * width <= span:
        low = np.minimum(low[:-width], low[width:])
        width *= 2
    low = np.minimum(low[:len(low) - (span - width)], low[span - width:])
    ends = np.cumsum(sizes)
    text = np.repeat(np.arange(len(sizes)), sizes)[:len(low)]
    start = np.flatnonzero(np.arange(len(low)) + LENGTH <= ends[text])
    if not len(start):
        return none.astype(np.uint64), none, none, none
    trigger, text = (low[start] & (np.uint64(1) << PLACE) - np.uint64(1)).astype(np.int64), text[start]
    first = np.flatnonzero((np.diff(trigger, prepend=-1) != 0) | (np.diff(text, prepend=-1) != 0))
    last = np.append(first[1:], len(start)) - 1
    return hashes[trigger[first]], text[first], start[first], start[last]


def parsed(texts: list[bytes], d: np.ndarray, t: np.ndarray) -> tuple[np.ndarray, ...]:
    """Columns a, p, d, t, s, e, known of the phrases of one slice."""
    found = []
    for low, high, begin in blocks(texts):
        data = b"".join(texts[low:high]) if high > low + 1 or begin is None else texts[low][begin:begin + BLOCK_BYTES + LENGTH - 1]
        sizes = np.fromiter(map(len, texts[low:high]), np.int64) if begin is None else np.array([len(data)])
        a, number, s, e = parse(data, sizes)
        digest = xxhash.xxh3_64_intdigest
        p = np.fromiter((digest(data[x:y]) for x, y in zip(s.tolist(), (e + LENGTH).tolist())), np.uint64, len(s))
        base = (begin or 0) - (np.cumsum(sizes) - sizes)[number]
        found.append((a, p, low + number, s + base, e + base))
    a, p, row, s, e = (np.concatenate(x) for x in zip(*found))
    order = np.lexsort((s, d[row], p, a))
    a, p, row, s, e = a[order], p[order], row[order], s[order], e[order]
    fresh = (np.diff(a, prepend=a[:1] - np.uint64(1)) != 0) | (np.diff(p, prepend=p[:1]) != 0)
    head = np.maximum.accumulate(np.where(fresh, np.arange(len(a)), 0))
    later = (d[row] != d[row[head]]) | (s != s[head])
    keep = ~later
    rows, starts, stops = merged(row[later], s[later], e[later])
    scatter = (d[rows] ^ starts.astype(np.int64)) * np.int64(-7046029254386353131)  # settled spans go anywhere, evenly
    return (np.concatenate((a[keep].view(np.int64), scatter)), np.concatenate((p[keep].view(np.int64), scatter)),
            d[np.concatenate((row[keep], rows))], t[np.concatenate((row[keep], rows))],
            np.concatenate((s[keep], starts)).astype(np.int32), np.concatenate((e[keep], stops)).astype(np.int32),
            np.concatenate((np.zeros(int(keep.sum()), bool), np.ones(len(rows), bool))))


def blocks(texts: list[bytes]) -> Iterator[tuple[int, int, int | None]]:
    """Runs of texts to parse together; a text above BLOCK_BYTES alone, by overlapping parts."""
    low = held = 0
    for i, text in enumerate(texts):
        if len(text) > BLOCK_BYTES:
            if i > low:
                yield low, i, None
            yield from ((i, i + 1, begin) for begin in range(0, len(text) - LENGTH + 1, BLOCK_BYTES))
            low, held = i + 1, 0
            continue
        if held + len(text) > BLOCK_BYTES:
            yield low, i, None
            low, held = i, 0
        held += len(text)
    if low < len(texts):
        yield low, len(texts), None


def merged(row: np.ndarray, s: np.ndarray, e: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ranges of starts [s, e] per row, neighbouring and overlapping ones joined."""
    order = np.lexsort((s, row))
    row, s, e = row[order], s[order], e[order]
    if not len(row):
        return row, s, e
    group = np.cumsum(np.diff(row, prepend=row[0]) != 0)
    reach = np.maximum.accumulate(e + group * (1 << 40)) - group * (1 << 40)  # largest end so far of the row
    first = np.flatnonzero(np.append(True, (group[1:] != group[:-1]) | (s[1:] > reach[:-1] + 1)))
    return row[first], s[first], reach[np.append(first[1:], len(row)) - 1]


class Sieve:
    """Reads phrases sorted by (a, p, d, s): repeats leave as spans, first occurrences of shared triggers as phrases to search."""

    def __init__(self) -> None:
        self.held: list[np.ndarray] | None = None  # first rows that may be needed again
        self.shared = False  # the held run is known to have several phrases, and its held row has left

    def feed(self, columns: list[np.ndarray]) -> list[np.ndarray]:
        size = len(self.held[0]) if self.held else 0
        if size:
            columns = [np.concatenate(x) for x in zip(self.held, columns)]
        a, p, d, t, s, e, known = columns
        if not len(a):
            return [*columns[:6], known]
        run_start = np.append(True, (a[1:] != a[:-1]) | known[1:] | known[:-1])
        fresh = run_start | np.append(True, p[1:] != p[:-1])
        head = np.maximum.accumulate(np.where(fresh, np.arange(len(a)), 0))
        first = (d == d[head]) & (s == s[head])
        run = np.cumsum(run_start) - 1
        several = np.bincount(run, weights=fresh) > 1
        if size and self.shared:
            several[0] = True
        search = first & several[run] & ~known
        gone = ~first | known
        if size and self.shared:
            search[:size] = False
        last = run == run[-1]
        if several[-1]:
            keep = np.array([head[-1]])
            self.held, self.shared = [x[keep] for x in columns], True
        else:
            keep = np.flatnonzero(last & first & ~known)
            self.held, self.shared = [x[keep] for x in columns], False
        out = search | gone
        return [*(x[out] for x in columns[:6]), search[out]]


def sieved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sieve, names = Sieve(), ["a", "d", "t", "s", "e", "search"]

    for batch in batches:
        if batch.num_rows:
            columns = sieve.feed([batch.column(i).to_numpy(zero_copy_only=False) for i in range(7)])
            if len(columns[0]):
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns[:1] + columns[2:]], names)


def phrases(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Bytes of the phrases to search, from documents with the list of theirs."""
    for batch in slices(batches):
        d, t, packed, lists = (batch.column(i) for i in range(4))
        a, rows, starts, cut = [], [], [], []
        unpack = zstandard.ZstdDecompressor()
        for row, (z, spans) in enumerate(zip(packed.to_pylist(), lists.to_pylist())):
            text = unpack.decompress(z)
            for span in spans:
                a.append(span["a"])
                rows.append(row)
                starts.append(span["s"])
                cut.append(text[span["s"]:span["e"] + LENGTH])
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), d.take(pa.array(rows, pa.int64())), t.take(pa.array(rows, pa.int64())),
                                          pa.array(starts, pa.int32()), pa.array(cut, pa.binary())], ["a", "d", "t", "s", "bytes"])


def suffixes(d: np.ndarray, t: np.ndarray, s: np.ndarray, cut: list[bytes]) -> tuple[np.ndarray, ...]:
    """All strings of the phrases: the bytes, d, t and start."""
    sizes = np.fromiter(map(len, cut), np.int64, len(cut))
    counts = sizes - LENGTH + 1
    base = np.repeat(np.cumsum(sizes) - sizes, counts)
    inside = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
    view = np.lib.stride_tricks.sliding_window_view(np.frombuffer(b"".join(cut), np.uint8), LENGTH)
    strings = np.ascontiguousarray(view[base + inside]).view(f"S{LENGTH}").ravel()
    return strings, np.repeat(d, counts), np.repeat(t, counts), np.repeat(s, counts) + inside


def repeats(strings: np.ndarray, d: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Positions of the strings that start earlier too: those after the first of their equals, in a suffix array."""
    order = np.lexsort((start, d))
    order = order[np.argsort(strings[order], kind="stable")]
    strings, d, start = strings[order], d[order], start[order]
    fresh = np.append(True, strings[1:] != strings[:-1])
    head = np.maximum.accumulate(np.where(fresh, np.arange(len(order)), 0))
    return order[(d != d[head]) | (start != start[head])]


def searched(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """Repeated strings among phrases sorted by trigger; strings of a trigger with more than `most` phrases pass on to be sorted."""
    names = ["d", "t", "s", "e", "string"]

    def settle(a, d, t, s, cut):
        first = np.flatnonzero(np.append(True, a[1:] != a[:-1]))
        size = np.diff(np.append(first, len(a)))
        pick = np.flatnonzero(np.repeat(size > 1, size))
        low = 0
        while low < len(pick):  # blocks of whole triggers
            high = min(low + BLOCK_ROWS, len(pick))
            if high < len(pick):
                high = int(np.searchsorted(a[pick], a[pick[high - 1]], side="right"))
            at = pick[low:high]
            texts = [cut[i] for i in at]
            strings, dd, _, start = suffixes(d[at], t[at], s[at], texts)
            row = np.repeat(np.arange(len(at)), [len(x) - LENGTH + 1 for x in texts])
            hit = repeats(strings, dd, start)
            r, x, y = merged(row[hit], start[hit], start[hit])
            if len(r):
                yield pa.RecordBatch.from_arrays([pa.array(d[at][r]), pa.array(t[at][r]), pa.array(x, pa.int32()), pa.array(
                    y, pa.int32()), pa.nulls(len(r), pa.binary())], names)
            low = high

    def spread(d, t, s, cut):
        for low in range(0, len(cut), 256):
            strings, dd, tt, start = suffixes(d[low:low + 256], t[low:low + 256], s[low:low + 256], cut[low:low + 256])
            raw = strings.view(np.uint8).reshape(-1, LENGTH)
            yield pa.RecordBatch.from_arrays([pa.array(dd), pa.array(tt), pa.array(start, pa.int32()), pa.array(start, pa.int32()),
                                              pa.FixedSizeBinaryArray.from_buffers(pa.binary(LENGTH), len(raw), [None, pa.py_buffer(
                                                  raw.tobytes())]).cast(pa.binary())], names)

    a, d, t, s, cut, hot = *(np.zeros(0, np.int64) for _ in range(4)), [], None
    for batch in batches:
        a, d, t, s = (np.concatenate((x, batch.column(i).to_numpy())) for i, x in enumerate((a, d, t, s)))
        cut = cut + batch.column(4).to_pylist()
        if hot is not None:
            n = int(np.searchsorted(a, hot, side="right"))
            yield from spread(d[:n], t[:n], s[:n], cut[:n])
            a, d, t, s, cut = a[n:], d[n:], t[n:], s[n:], cut[n:]
            hot = hot if not len(a) else None
        if len(a):
            n = int(np.searchsorted(a, a[-1]))  # the last trigger may go on
            if n >= BLOCK_ROWS or len(a) > most:
                yield from settle(a[:n], d[:n], t[:n], s[:n], cut[:n])
                a, d, t, s, cut = a[n:], d[n:], t[n:], s[n:], cut[n:]
            if len(a) > most and a[0] == a[-1]:
                hot = a[-1]
                yield from spread(d, t, s, cut)
                a, d, t, s, cut = a[:0], d[:0], t[:0], s[:0], []
    if len(a):
        yield from settle(a, d, t, s, cut)


def array_order(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Strings sorted by (string, d, s): all but the first of their equals."""
    last: tuple | None = None
    for batch in batches:
        strings, d, t, s = (batch.column(i).to_pylist() for i in range(4))
        keep = []
        for i, x in enumerate(strings):
            if last is None or last[0] != x:
                last = (x, d[i], s[i])
            elif (d[i], s[i]) != last[1:]:
                keep.append(i)
        part = batch.take(pa.array(keep, pa.int64()))
        yield pa.RecordBatch.from_arrays([part.column(1), part.column(2), part.column(3), part.column(3)], ["d", "t", "s", "e"])


def identified(docs: DataFrame) -> DataFrame:
    """row (all columns but text), d (order), t (tells rows of one doc_id apart; 0 where doc_ids are unique) and text."""
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "text"]).alias("row"),
                       F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))).alias("d"),
                       F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    unique = rows.groupBy("d").count().where("count > 1").isEmpty()
    return rows.withColumn("t", F.lit(0).cast("long") if unique else F.xxhash64("text")).select("row", "d", "t", "text")


def spans(rows: DataFrame, most: int = MOST) -> tuple[DataFrame, DataFrame]:
    """Texts by (d, t), and the spans of starts (d, t, s, e) whose strings start earlier too."""
    def parsing(batches):
        for batch, texts in chunks(batches, "text", SLICE_BYTES):
            columns = parsed(texts, *(batch.column(i).to_numpy() for i in (1, 2)))
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], ["a", "p", "d", "t", "s", "e", "known"])

    def packing(batches):
        pack = zstandard.ZstdCompressor(level=3)
        for batch, texts in chunks(batches, "text", SLICE_BYTES):
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(3)), pa.array([pack.compress(x) for x in texts], pa.binary())],
                                             ["row", "d", "t", "z"])

    n = parts(rows)
    phrase = rows.mapInArrow(parsing, "a bigint, p bigint, d bigint, t bigint, s int, e int, known boolean")
    sieve = (phrase.repartition(n, "a").sortWithinPartitions("a", "p", "d", "s")
             .mapInArrow(sieved, "a bigint, d bigint, t bigint, s int, e int, search boolean"))
    listed = pinned(joined_spans(sieve.groupBy("d", "t").agg(
        F.collect_list(F.when(F.col("search"), F.struct("a", "s", "e"))).alias("search"),  # one document's own phrases
        F.collect_list(F.when(~F.col("search"), F.struct("s", "e"))).alias("gone"))))
    packed = rows.mapInArrow(packing, rows.drop("text").withColumn("z", F.lit(b"")).schema).repartition(n, "d", "t")
    open_ = packed.select("d", "t", "z").join(listed.where(F.size("search") > 0).select("d", "t", "search").hint("merge"), ["d", "t"])
    found = (open_.mapInArrow(phrases, "a bigint, d bigint, t bigint, s int, bytes binary")
             .repartition(n, "a").sortWithinPartitions("a").mapInArrow(lambda b: searched(b, most), SPAN + ", string binary"))
    found = pinned(found)
    sorted_ = (found.where("string is not null").select("string", "d", "t", "s").repartition(n, F.xxhash64("string"))
               .sortWithinPartitions("string", "d", "s").mapInArrow(array_order, SPAN))
    rest = found.where("string is null").drop("string").unionByName(sorted_)
    whole = listed.where(F.size("gone") > 0).select("d", "t", F.explode("gone").alias("x")).select("d", "t", "x.s", "x.e")
    return packed, whole.unionByName(rest)


def joined_spans(listed: DataFrame) -> DataFrame:
    """`listed` with neighbouring and overlapping spans of `gone` as one."""
    def run(batches):
        for batch in batches:
            gone = batch.column(3)
            row = np.repeat(np.arange(len(gone)), np.diff(gone.offsets.to_numpy()))
            inner = gone.flatten()
            r, s, e = merged(row, inner.field(0).to_numpy().astype(np.int64), inner.field(1).to_numpy().astype(np.int64))
            offsets = np.concatenate(([0], np.cumsum(np.bincount(r, minlength=len(gone)))))
            made = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.StructArray.from_arrays(
                [pa.array(s, pa.int32()), pa.array(e, pa.int32())], ["s", "e"]))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), made], ["d", "t", "search", "gone"])

    return listed.mapInArrow(run, listed.schema)


def cut_spans(text: bytes, spans_: list[tuple[int, int]]) -> tuple[list[bytes], int, int]:
    """Kept pieces, removed bytes and maximal removed runs."""
    kept, at, removed, runs = [], 0, 0, 0
    end = -1
    for s, e in sorted(spans_):
        stop = e + LENGTH
        if s > end:
            kept.append(text[at:s])
            runs += 1
            removed += stop - s
            end = at = stop
        elif stop > end:
            removed += stop - end
            end = at = stop
    kept.append(text[at:])
    return kept, removed, runs


def cut_rows(docs: DataFrame, most: int, schema: StructType, values: Callable) -> DataFrame:
    """row (all columns but text) and `values(kept bytes, n_bytes, n_removed, n_spans)` of every row, of the types of `schema`."""
    packed, gone = spans(identified(docs), most)
    listed = gone.groupBy("d", "t").agg(F.collect_list(F.struct("s", "e")).alias("spans"))  # one document's own spans
    arrow = to_arrow_schema(schema)

    def cutting(batches):
        unpack = zstandard.ZstdDecompressor()
        for batch in slices(batches):
            made = []
            for z, spans_ in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                text = unpack.decompress(z)
                kept, removed, runs = cut_spans(text, [(x["s"], x["e"]) for x in spans_ or []])
                made.append(values(b"".join(kept), len(text), removed, runs))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, f.type) for x, f in zip(zip(*made), arrow))],
                                             ["row", *arrow.names])

    rows = packed.join(listed.hint("merge"), ["d", "t"], "left").select("row", "z", "spans")
    return rows.mapInArrow(cutting, StructType([rows.schema["row"], *schema.fields]))


def remove_passages(docs: DataFrame, most: int = MOST) -> DataFrame:
    """row (all columns but text), kept (the remaining bytes), n_bytes, n_removed and n_spans of every row."""
    schema = StructType.fromDDL("kept binary, n_bytes bigint, n_removed bigint, n_spans bigint")
    return cut_rows(docs, most, schema, lambda *values: values)


def rewrite(docs: DataFrame, most: int = MOST) -> DataFrame:
    """`docs` with shortened texts. Bytes of characters that a cut split go too; a column n_chars is counted anew."""
    text = cut_rows(docs, most, StructType.fromDDL("text string"), lambda kept, *_: (kept.decode("utf-8", "ignore"),))
    counted = {"text": F.col("text")}
    if "n_chars" in docs.columns:
        counted["n_chars"] = F.length("text").cast(docs.schema["n_chars"].dataType)
    return text.select(*[counted.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns])
