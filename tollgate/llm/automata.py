"""Removal of repeated passages of 20 words, located by sharded Aho-Corasick automata.

A word goes if a window of `WINDOW` successive words covers it whose words also start earlier in the corpus (smaller doc_id, or the same
document and an earlier start). Windows never cross documents and are judged on the input.

1. Routing. The trigger of a window is the leftmost smallest hash of its `GRAM`-word runs, so equal windows have equal triggers at equal
   places. Neighbouring windows with one trigger are a part of a document, and every window lies in one part. Only parts whose trigger
   occurs more than once can hold a recurring window. A part that equals an earlier part (128 bits of hashes) recurs as a whole, with all
   its windows; only its first occurrence needs to be read.
2. Confirmation. First occurrences go, with their words, to the shard of their trigger, in corpus order. There windows are counted word by
   word; those that occur more than once are the confirmed passages.
3. Automata. A shard is worked off in blocks of whole triggers. The confirmed passages of a block are compiled into one Aho-Corasick
   automaton (pyahocorasick); a word is spelled by two characters of two alphabets, so matches begin and end at words and nodes have few
   children. All parts of the block stream through it; every occurrence of a passage but its first is a span to remove.
4. Spans of starts are merged for each document and cut out.

A trigger with more than `MOST` different parts is not handled in one task: its windows are sorted by Spark over all tasks, and those equal
to the one before go. Parts that repeat inside one slice of a map task are settled there.

Null texts have no words. A null doc_id counts as the smallest. Rows with one doc_id are one document: windows at the same start are not
earlier than each other, and rows with different texts are told apart by a hash of the text. Other columns are only passed on.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tollgate.llm.common import chunks, mix, parts, pinned, slices
from tollgate.llm.passages import SPAN, identified, joined_spans, merged, sieved

WINDOW = 20
GRAM = 5
MOST = 8_192  # different parts of one trigger that are read inside one task
BLOCK_PARTS = 2_048  # parts of one automaton, unless one trigger has more
SLICE_BYTES = 2 << 20
BLOCK_BYTES = 1 << 20  # words of a text are split off in blocks of so many bytes
PLACE = np.uint64(28)  # bits for a position in a slice
SPACE = re.compile(rb"[\x20\x09-\x0D]")
FACTOR = np.uint64(0x9E3779B97F4A7C15)
INVERSE = np.uint64(pow(int(FACTOR), -1, 1 << 64))


def word_blocks(text: bytes) -> Iterator[tuple[int, list[bytes]]]:
    """The words of a text, in blocks with the number of their first word."""
    first = at = 0
    while at < len(text):
        cut = SPACE.search(text, at + BLOCK_BYTES) if len(text) - at > BLOCK_BYTES else None
        end = cut.start() if cut else len(text)
        block = text[at:end].split()
        yield first, block
        first, at = first + len(block), end


def parse(hashes: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, ...]:
    """Parts of word sequences that lie one after another: trigger, content hash, sequence, first and last start (in `hashes`)."""
    none = np.zeros(0, np.int64)
    n = len(hashes)
    if n < WINDOW:
        return none.astype(np.uint64), none.astype(np.uint64), none, none, none
    gram = hashes[:n - GRAM + 1].copy()
    for k in range(1, GRAM):
        gram = gram * FACTOR + hashes[k:n - GRAM + 1 + k]
    gram = mix(gram)
    low = gram >> PLACE << PLACE | np.arange(len(gram), dtype=np.uint64)
    width, span = 1, WINDOW - GRAM + 1
    while 2 * width <= span:
        low = np.minimum(low[:-width], low[width:])
        width *= 2
    low = np.minimum(low[:len(low) - (span - width)], low[span - width:])
    sequence = np.repeat(np.arange(len(sizes)), sizes)[:len(low)]
    start = np.flatnonzero(np.arange(len(low)) + WINDOW <= np.cumsum(sizes)[sequence])
    if not len(start):
        return none.astype(np.uint64), none.astype(np.uint64), none, none, none
    trigger, sequence = (low[start] & (np.uint64(1) << PLACE) - np.uint64(1)).astype(np.int64), sequence[start]
    first = np.flatnonzero((np.diff(trigger, prepend=-1) != 0) | (np.diff(sequence, prepend=-1) != 0))
    last = np.append(first[1:], len(start)) - 1
    s, e = start[first], start[last]
    powers = np.cumprod(np.full(n, FACTOR))
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(hashes * powers, dtype=np.uint64)))
    content = (sums[e + WINDOW] - sums[s]) * np.cumprod(np.full(n, INVERSE))[s]
    return gram[trigger[first]], mix(content + (e - s).astype(np.uint64)), sequence[first], s, e


def parsed(texts: list[bytes], d: np.ndarray, t: np.ndarray) -> tuple[np.ndarray, ...]:
    """Columns a, p, d, t, s, e, known of the parts of one slice; repeats inside the slice are merged spans already (known)."""
    digest = xxhash.xxh3_64_intdigest
    segments, owner, base = [], [], []
    for row, text in enumerate(texts):
        carry = np.zeros(0, np.uint64)
        for first, block in word_blocks(text):
            carry = np.concatenate((carry, np.fromiter(map(digest, block), np.uint64, len(block))))
            segments.append(carry)
            owner.append(row)
            base.append(first + len(block) - len(carry))
            carry = carry[max(0, len(carry) - WINDOW + 1):]
    sizes = np.fromiter(map(len, segments), np.int64, len(segments))
    a, p, number, s, e = parse(np.concatenate([np.zeros(0, np.uint64), *segments]), sizes)
    shift = (np.array(base, np.int64) - (np.cumsum(sizes) - sizes))[number]
    row, s, e = np.array(owner, np.int64)[number], s + shift, e + shift
    order = np.lexsort((s, d[row], p, a))
    a, p, row, s, e = a[order], p[order], row[order], s[order], e[order]
    fresh = (np.diff(a, prepend=a[:1] - np.uint64(1)) != 0) | (np.diff(p, prepend=p[:1]) != 0)
    head = np.maximum.accumulate(np.where(fresh, np.arange(len(a)), 0))
    later = (d[row] != d[row[head]]) | (s != s[head])
    rows, starts, stops = merged(row[later], s[later], e[later])
    keep = ~later
    scatter = mix((d[rows] ^ starts).view(np.uint64)).view(np.int64)  # settled spans go anywhere, evenly
    row = np.concatenate((row[keep], rows))
    return (np.concatenate((a[keep].view(np.int64), scatter)), np.concatenate((p[keep].view(np.int64), scatter)), d[row], t[row],
            np.concatenate((s[keep], starts)).astype(np.int32), np.concatenate((e[keep], stops)).astype(np.int32),
            np.arange(len(row)) >= keep.sum())


def part_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words, joined by spaces, of the parts to read, from documents with the list of theirs."""
    unpack = zstandard.ZstdDecompressor()
    for batch in slices(batches):
        a, rows, starts, cut = [], [], [], []
        for row, (z, spans) in enumerate(zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())):
            spans.sort(key=lambda x: x["s"])
            held, at = [], 0  # words from number `at` on
            blocks = word_blocks(unpack.decompress(z))
            for span in spans:
                stop = span["e"] + WINDOW
                while at + len(held) < stop:
                    passed = min(span["s"] - at, len(held))
                    held, at = held[passed:] + next(blocks)[1], at + passed
                held, at = held[span["s"] - at:], span["s"]
                a.append(span["a"])
                rows.append(row)
                starts.append(span["s"])
                cut.append(b" ".join(held[:stop - at]))
        taken = pa.array(rows, pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), batch.column(0).take(taken), batch.column(1).take(taken),
                                          pa.array(starts, pa.int32()), pa.array(cut, pa.binary())], ["a", "d", "t", "s", "words"])


class Speller:
    """Spells every different word by two characters of two alphabets."""

    def __init__(self, texts: list[list[bytes]]) -> None:
        numbers: dict[bytes, int] = {}
        for text in texts:
            for word in text:
                numbers.setdefault(word, len(numbers))
        size = max(256, int(len(numbers) ** 0.5) + 1)
        self.spelling = {word: chr(n // size) + chr(0x10000 + n % size) for word, n in numbers.items()}

    def spell(self, text: list[bytes]) -> str:
        return "".join(map(self.spelling.__getitem__, text))


def passages_of(spelled: list[str]) -> list[str]:
    """The windows that occur more than once."""
    seen: set[str] = set()
    twice: set[str] = set()
    for text in spelled:
        for i in range(0, len(text) - 2 * WINDOW + 1, 2):
            window = text[i:i + 2 * WINDOW]
            (twice if window in seen else seen).add(window)
    return list(twice)


def compiled(passages: list[str]) -> ahocorasick.Automaton:
    automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
    for number, passage in enumerate(passages):
        automaton.add_word(passage, number)
    automaton.make_automaton()
    return automaton


def repeats(d: list[int], s: list[int], texts: list[list[bytes]]) -> tuple[list[int], list[int]]:
    """(part, start) of every occurrence of a confirmed passage that is not the first in the corpus."""
    speller = Speller(texts)
    spelled = list(map(speller.spell, texts))
    passages = passages_of(spelled)
    if not passages:
        return [], []
    automaton = compiled(passages)
    found = [(number, row, s[row] + (end + 1) // 2 - WINDOW) for row, text in enumerate(spelled) for end, number in automaton.iter(text)]
    first: list[tuple[int, int] | None] = [None] * len(passages)
    for number, row, start in found:
        known = first[number]
        if known is None or (d[row], start) < known:
            first[number] = (d[row], start)
    later = [(row, start) for number, row, start in found if first[number] != (d[row], start)]
    return [row for row, _ in later], [start for _, start in later]


def located(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """Spans of repeated windows in parts sorted by trigger and corpus order; windows of a trigger with more than `most` parts pass on."""
    names = ["d", "t", "s", "e", "window"]

    def settle(a, d, t, s, texts):
        first = np.flatnonzero(np.append(True, a[1:] != a[:-1]))
        size = np.diff(np.append(first, len(a)))
        pick = np.flatnonzero(np.repeat(size > 1, size))
        low = 0
        while low < len(pick):  # blocks of whole triggers
            high = min(low + BLOCK_PARTS, len(pick))
            if high < len(pick):
                high = int(np.searchsorted(a[pick], a[pick[high - 1]], side="right"))
            at = pick[low:high]
            rows, starts = repeats(d[at].tolist(), s[at].tolist(), [texts[i].split() for i in at])
            starts = np.array(starts, np.int64)
            r, x, y = merged(np.array(rows, np.int64), starts, starts)
            if len(r):
                yield pa.RecordBatch.from_arrays([pa.array(d[at][r]), pa.array(t[at][r]), pa.array(x, pa.int32()), pa.array(y, pa.int32()),
                                                  pa.nulls(len(r), pa.binary())], names)
            low = high

    def spread(d, t, s, texts):
        for low in range(0, len(texts), 256):
            some = [x.split() for x in texts[low:low + 256]]
            counts = np.array([len(x) - WINDOW + 1 for x in some])
            starts = np.concatenate([first + np.arange(n) for first, n in zip(s[low:low + 256], counts)])
            yield pa.RecordBatch.from_arrays([
                pa.array(np.repeat(d[low:low + 256], counts)), pa.array(np.repeat(t[low:low + 256], counts)), pa.array(starts, pa.int32()),
                pa.array(starts, pa.int32()), pa.array([b" ".join(x[i:i + WINDOW]) for x, n in zip(some, counts) for i in range(n)], pa.binary())], names)

    a, d, t, s, texts, hot = *(np.zeros(0, np.int64) for _ in range(4)), [], None
    for batch in batches:
        a, d, t, s = (np.concatenate((x, batch.column(i).to_numpy())) for i, x in enumerate((a, d, t, s)))
        texts = texts + batch.column(4).to_pylist()
        if hot is not None:
            n = int(np.searchsorted(a, hot, side="right"))
            if n:
                yield from spread(d[:n], t[:n], s[:n], texts[:n])
            a, d, t, s, texts = a[n:], d[n:], t[n:], s[n:], texts[n:]
            hot = hot if not len(a) else None
        if len(a):
            n = int(np.searchsorted(a, a[-1]))  # the last trigger may go on
            if n >= BLOCK_PARTS or len(a) > most:
                yield from settle(a[:n], d[:n], t[:n], s[:n], texts[:n])
                a, d, t, s, texts = a[n:], d[n:], t[n:], s[n:], texts[n:]
            if len(a) > most:
                hot = a[-1]
                yield from spread(d, t, s, texts)
                a, d, t, s, texts = a[:0], d[:0], t[:0], s[:0], []
    if len(a):
        yield from settle(a, d, t, s, texts)


def later_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All but the first of equal windows, from rows sorted by (window, d, s)."""
    last: tuple | None = None
    for batch in batches:
        windows, d, t, s = (batch.column(i) for i in range(4))
        keep = []
        for i, (x, at) in enumerate(zip(windows.to_pylist(), zip(d.to_pylist(), s.to_pylist()))):
            if last is None or last[0] != x:
                last = (x, at)
            elif at != last[1]:
                keep.append(i)
        taken = pa.array(keep, pa.int64())
        yield pa.RecordBatch.from_arrays([d.take(taken), t.take(taken), s.take(taken), s.take(taken)], ["d", "t", "s", "e"])


def spans(rows: DataFrame, most: int) -> tuple[DataFrame, DataFrame]:
    """Packed texts by (d, t), and the spans (d, t, s, e) of starts of windows to remove."""
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
    found = rows.mapInArrow(parsing, "a bigint, p bigint, d bigint, t bigint, s int, e int, known boolean")
    sieve = (found.repartition(n, "a").sortWithinPartitions("a", "p", "d", "s")
             .mapInArrow(sieved, "a bigint, d bigint, t bigint, s int, e int, search boolean"))
    listed = pinned(joined_spans(sieve.groupBy("d", "t").agg(
        F.collect_list(F.when(F.col("search"), F.struct("a", "s", "e"))).alias("search"),  # one document's own parts
        F.collect_list(F.when(~F.col("search"), F.struct("s", "e"))).alias("gone"))))
    packed = rows.mapInArrow(packing, rows.drop("text").withColumn("z", F.lit(b"")).schema).repartition(n, "d", "t")
    open_ = packed.select("d", "t", "z").join(listed.where(F.size("search") > 0).select("d", "t", "search").hint("merge"), ["d", "t"])
    read = pinned(open_.mapInArrow(part_words, "a bigint, d bigint, t bigint, s int, words binary")
                  .repartition(n, "a").sortWithinPartitions("a", "d", "s").mapInArrow(lambda b: located(b, most), SPAN + ", window binary"))
    sorted_ = (read.where("window is not null").select("window", "d", "t", "s").repartition(n, F.xxhash64("window"))
               .sortWithinPartitions("window", "d", "s").mapInArrow(later_windows, SPAN))
    whole = listed.where(F.size("gone") > 0).select("d", "t", F.explode("gone").alias("x")).select("d", "t", "x.s", "x.e")
    return packed, whole.unionByName(read.where("window is null").drop("window")).unionByName(sorted_)


def kept_words(text: bytes, cuts: list[tuple[int, int]]) -> tuple[bytes, int, int]:
    """The words that stay, joined by spaces, the number of words and of those removed; `cuts` are ranges of starts of windows."""
    total = sum(len(block) for _, block in word_blocks(text))
    gone = np.zeros(total + 1, np.int64)
    for s, e in cuts:
        gone[s] += 1
        gone[e + WINDOW] -= 1
    stays = np.cumsum(gone)[:total] == 0
    kept = []
    for first, block in word_blocks(text):
        here = stays[first:first + len(block)]
        kept += block if here.all() else [block[i] for i in np.flatnonzero(here)]
    return b" ".join(kept), total, total - int(stays.sum())


def remove_windows(docs: DataFrame, most: int = MOST) -> DataFrame:
    """row (all columns but text), kept (the words that stay, joined by one space), n_words and n_removed of every row."""
    packed, gone = spans(identified(docs), most)
    listed = gone.groupBy("d", "t").agg(F.collect_list(F.struct("s", "e")).alias("spans"))  # one document's own spans

    def cutting(batches):
        unpack = zstandard.ZstdDecompressor()
        for batch in slices(batches):
            made = [kept_words(unpack.decompress(z), [(x["s"], x["e"]) for x in cuts or []])
                    for z, cuts in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())]
            kept, words, removed = zip(*made)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(kept, pa.binary()), pa.array(words, pa.int64()), pa.array(removed, pa.int64())],
                                             ["row", "kept", "n_words", "n_removed"])

    rows = packed.join(listed.hint("merge"), ["d", "t"], "left").select("row", "z", "spans")
    return rows.mapInArrow(cutting, StructType([rows.schema["row"], *StructType.fromDDL("kept binary, n_words bigint, n_removed bigint").fields]))
