"""Sampled subword segmentation over the piece lattice, and its lossless inverse.

A text is a sequence of words, each led by one space mark; splitting at spaces keeps every other character, so nothing is
normalised away. All segmentations of a word into vocabulary pieces form a lattice. Forward filtering sums the weights of all
paths to every position, backward sampling then draws one path with probability in proportion to its weight. The random
numbers are hashes of (seed, row key, word number, step): a row gets the same pieces in every run, whatever its partition,
batch or neighbours. Words are filtered once per batch and sampled once per occurrence, both in arrays.

A piece of rank r in the vocabulary weighs `-alpha * ln(1 + r)`. Characters that the vocabulary lacks, and space marks that
stand in the text itself, become byte pieces, so decoding gives back every text exactly. A word is one lattice, however long
it is. Words above `LONGEST` bytes are filtered one by one: their arcs are made for `WINDOW` bytes at a time and made again
for the way back, so only the forward weights, eight bytes per byte of the word, are held for the whole word.

Null texts are empty; an empty text has no pieces. A null key is a key of its own. Repeated rows get equal pieces.
"""

from __future__ import annotations

import functools
import itertools
import math
from collections import defaultdict

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tollgate.llm.common import chunks, mix, slices

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁".encode()
LEAD = b"\xff"  # stands for the leading space mark inside the lattice; no UTF-8 text has this byte
LONGEST = 1024
WINDOW = 1 << 14
BATCH_BYTES = 1 << 18
STEP = np.uint64(0x9E3779B97F4A7C15)
Vocabulary = tuple[tuple[bytes, ...], tuple[float, ...], tuple[int, ...]]


def read_vocabulary(path: str = VOCABULARY) -> Vocabulary:
    """Pieces, ranks (-1: never used in a text) and the ids of the 256 byte pieces. Its size is that of the vocabulary file."""
    from sentencepiece import SentencePieceProcessor

    model = SentencePieceProcessor(model_file=path)
    pieces, ranks, byte_ids = [], [], [-1] * 256
    for i in range(model.get_piece_size()):
        piece = model.id_to_piece(i)
        usable = not (model.IsControl(i) or model.IsUnknown(i) or model.IsUnused(i) or model.IsByte(i))
        if model.IsByte(i):
            byte_ids[int(piece[1:-1], 16)] = i
        pieces.append(piece.encode())
        ranks.append(-model.get_score(i) if usable else -1.0)
    if min(byte_ids) < 0:
        raise ValueError("the vocabulary needs a piece for every byte")
    return tuple(pieces), tuple(ranks), tuple(byte_ids)


class Lattice:
    """Tables for one vocabulary and temperature."""

    def __init__(self, vocabulary: Vocabulary, alpha: float):
        pieces, ranks, byte_ids = vocabulary
        self.byte_ids = np.array(byte_ids, np.int32)
        self.weight = -alpha * np.log1p(np.maximum(np.array(ranks), 0.0))
        self.weight[self.byte_ids] = -alpha * np.log1p(len(pieces))
        self.surface = [p.replace(MARK, b" ") for p in pieces]
        for byte, i in enumerate(byte_ids):
            self.surface[i] = bytes([byte])
        children: list[dict[int, int]] = [{}]
        ends = [-1]
        if MARK not in pieces:
            raise ValueError("the vocabulary needs the space mark as a piece")
        for i, (piece, rank) in enumerate(zip(pieces, ranks)):
            if rank < 0 or not piece or MARK in piece[1:]:  # a space mark can only lead a word
                continue
            node = 0
            for byte in LEAD + piece[3:] if piece.startswith(MARK) else piece:
                if byte not in children[node]:
                    children[node][byte] = len(children)
                    children.append({})
                    ends.append(-1)
                node = children[node][byte]
            ends[node] = i
        self.longest = max(len(p) - 2 if p.startswith(MARK) else len(p) for p in pieces)
        inner = [n for n, below in enumerate(children) if below]  # only these need a row
        row = np.zeros(len(children), np.int32) - 1
        row[inner] = np.arange(len(inner), dtype=np.int32)
        self.row, self.ends = row, np.array(ends, np.int32)
        self.next = np.full((len(inner), 256), -1, np.int32)
        for n in inner:
            for byte, child in children[n].items():
                self.next[row[n], byte] = child

    def edges(self, data: np.ndarray, left: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All pieces that match somewhere: position, length, id. `left` is the number of bytes to the end of the word."""
        at = np.arange(len(data), dtype=np.int64)
        node = np.zeros(len(data), np.int32)
        found, length = [], 0
        while len(at):
            node = self.next[self.row[node], data[at + length]]
            length += 1
            alive = node >= 0
            at, node = at[alive], node[alive]
            ids = self.ends[node]
            hit = ids >= 0
            found.append((at[hit], np.full(int(hit.sum()), length, np.int64), ids[hit]))
            more = (self.row[node] >= 0) & (left[at] > length)
            at, node = at[more], node[more]
        return tuple(np.concatenate(x) for x in zip(*found)) if found else (at, at, node)

    def arcs(self, data: np.ndarray, left: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The matching pieces, by length, and for characters without a piece of their own one arc for each of their bytes."""
        at, length, ids = self.edges(data, left)
        width = np.where((data < 0x80) | (data == LEAD[0]), 1, np.where(data >= 0xF0, 4, np.where(data >= 0xE0, 3, 2)))
        lead = (data & 0xC0) != 0x80
        covered = np.zeros(len(data), bool)
        covered[at[length == width[at]]] = True
        owner = np.maximum.accumulate(np.where(lead, np.arange(len(data)), 0))
        lone = np.flatnonzero(~covered[owner])
        return (np.concatenate((at, lone)), np.concatenate((length, np.ones(len(lone), np.int64))),
                np.concatenate((ids, self.byte_ids[data[lone]])))

    def between(self, data: np.ndarray, low: int, high: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start, end and id of the arcs of one word that start in [low, high), which are borders of characters."""
        part = data[low:high + self.longest + 4]
        at, length, ids = self.arcs(part, np.arange(len(part), 0, -1))
        inside = at < high - low
        return at[inside] + low, (at + length)[inside] + low, ids[inside]

    def long_word(self, word: bytes, key: np.uint64) -> list[int]:
        """Sampled pieces of one long word, by the same random numbers and order of arcs as `filtered` and `sample` use."""
        data = np.frombuffer(word, np.uint8)
        borders = np.flatnonzero((data & 0xC0) != 0x80)
        cuts = sorted({0, *borders[np.searchsorted(borders, np.arange(0, len(data), WINDOW), "right") - 1].tolist(), len(data)})
        alpha = [-math.inf] * (len(data) + 1)
        alpha[0] = 0.0
        for low, high in itertools.pairwise(cuts):
            start, end, ids = self.between(data, low, high)
            order = np.argsort(start, kind="stable")
            for s, e, w in zip(start[order].tolist(), end[order].tolist(), self.weight[ids[order]].tolist()):
                if (new := alpha[s] + w) > -math.inf:
                    more, less = (new, alpha[e]) if new > alpha[e] else (alpha[e], new)
                    alpha[e] = more + math.log1p(math.exp(less - more))
        out: list[int] = []
        numbers: list[float] = []
        now = len(data)
        for low, high in reversed(list(itertools.pairwise(cuts))):
            if now <= low:
                continue
            first = int(borders[np.searchsorted(borders, max(low - self.longest, 0), "right") - 1])
            start, end, ids = self.between(data, first, high)
            near = np.flatnonzero((end > low) & (end <= high))
            order = near[np.argsort(end[near], kind="stable")]
            place = np.searchsorted(end[order], np.arange(low, high + 2)).tolist()
            start, ids = start[order].tolist(), ids[order].tolist()
            while now > low:
                if len(out) == len(numbers):  # the next thousand random numbers
                    steps = key + np.arange(len(out) + 1, len(out) + 1001, dtype=np.uint64)
                    numbers += ((mix(steps) >> np.uint64(11)).astype(np.float64) / float(1 << 53)).tolist()
                rest, taken = numbers[len(out)], None
                for j in range(place[now - low], place[now - low + 1]):
                    share = math.exp(alpha[start[j]] + self.weight[ids[j]] - alpha[now])
                    if share > 0:
                        taken, rest = j, rest - share
                        if rest < 0:
                            break
                out.append(ids[taken])
                now = start[taken]
        return out[::-1]

    def filtered(self, tokens: list[bytes]) -> tuple[np.ndarray, ...]:
        """Forward filtering of distinct words: per word its last slot, per edge first slot, id and the sampling table."""
        data = np.frombuffer(b"".join(tokens), np.uint8)
        sizes = np.fromiter(map(len, tokens), np.int64, len(tokens))
        starts = np.concatenate(([0], np.cumsum(sizes)))[:-1]
        word = np.repeat(np.arange(len(tokens)), sizes)
        inside = np.arange(len(data)) - starts[word]
        at, length, ids = self.arcs(data, sizes[word] - inside)
        slot = at + word[at]  # a word of n bytes has n + 1 slots
        end = slot + length
        order = np.lexsort((end, inside[at] + length))
        slot, end, ids = slot[order], end[order], ids[order]
        reach = (inside[at] + length)[order]
        steps = np.flatnonzero(np.diff(reach, prepend=-1))
        first = np.flatnonzero(np.diff(end, prepend=-1))  # edges of one last slot are neighbours
        alpha = np.full(len(data) + len(tokens), -np.inf)
        alpha[starts + np.arange(len(tokens))] = 0.0
        value = np.empty(len(slot))
        bounds = np.append(steps, len(slot))
        lows = np.searchsorted(first, bounds)
        for k in range(len(steps)):
            a, b = bounds[k], bounds[k + 1]
            groups = first[lows[k]:lows[k + 1]]
            v = alpha[slot[a:b]] + self.weight[ids[a:b]]
            top = np.maximum.reduceat(v, groups - a)
            size = np.diff(np.append(groups, b))
            share = np.exp(v - np.repeat(top, size))
            total = np.add.reduceat(share, groups - a)
            alpha[end[groups]] = top + np.log(total)
            value[a:b] = share / np.repeat(total, size)
        running = np.cumsum(value)
        size = np.diff(np.append(first, len(slot)))
        before = np.repeat(running[first] - value[first], size)
        number = np.repeat(np.arange(len(first)), size)
        table = number + np.minimum(running - before, 1.0)
        table[first + size - 1] = np.arange(1, len(first) + 1)
        group = np.full(len(alpha), -1, np.int64)
        group[end[first]] = np.arange(len(first))
        initial = np.zeros(len(alpha), bool)
        initial[starts + np.arange(len(tokens))] = True
        return starts + sizes + np.arange(len(tokens)), slot, ids, table, group, initial

    def sample(self, texts: list[bytes], seeds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pieces of all texts one after another, and the number of pieces of each text."""
        rank: defaultdict[bytes, int] = defaultdict(itertools.count().__next__)  # a new word gets the next number
        which: list[int] = []
        long: dict[int, bytes] = {}
        counts = []
        for text in texts:
            parts = cut_words(text)
            for i, part in enumerate(parts if len(text) > LONGEST else ()):
                if len(part) > LONGEST:
                    long[len(which) + i] = part
                    parts[i] = LEAD  # its place among the words
            which.extend(map(rank.__getitem__, parts))
            counts.append(len(parts))
        if not which:
            return np.zeros(0, np.int32), np.zeros(len(texts), np.int64)
        last, slot, ids, table, group, initial = self.filtered(list(rank))
        counts = np.array(counts)
        here = np.repeat(np.arange(len(texts)), counts)
        number = np.arange(len(which)) - np.repeat(np.cumsum(counts) - counts, counts)
        key = mix(np.repeat(seeds, counts) + number.astype(np.uint64) * STEP)
        apart = {i: np.array(self.long_word(word, key[i]), np.int32) for i, word in long.items()}
        short = np.ones(len(which), bool)
        short[list(apart)] = False
        active, depth, made = np.flatnonzero(short), 0, []
        now = last[np.array(which)[active]]
        while len(active):
            u = (mix(key[active] + np.uint64(depth + 1)) >> np.uint64(11)).astype(np.float64) / float(1 << 53)
            edge = np.searchsorted(table, group[now] + u, side="right")
            made.append((active, ids[edge]))
            now = slot[edge]
            more = ~initial[now]
            active, now, depth = active[more], now[more], depth + 1
        size = np.zeros(len(which), np.int64)
        for occurrence, _ in made:
            size[occurrence] += 1
        for i, pieces in apart.items():
            size[i] = len(pieces)
        stop = np.cumsum(size)
        out = np.empty(int(stop[-1]), np.int32)
        for step, (occurrence, chosen) in enumerate(made):  # drawn from the end of the word backwards
            out[stop[occurrence] - 1 - step] = chosen
        for i, pieces in apart.items():
            out[stop[i] - size[i]:stop[i]] = pieces
        return out, np.bincount(here, weights=size, minlength=len(texts)).astype(np.int64)

    def text(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.surface.__getitem__, ids.tolist()))[1:]


def cut_words(text: bytes) -> list[bytes]:
    """Words led by the space mark."""
    return (LEAD + text.replace(b" ", b" " + LEAD)).split(b" ") if text else []


@functools.lru_cache(maxsize=2)
def lattice(vocabulary: Vocabulary, alpha: float) -> Lattice:
    return Lattice(vocabulary, alpha)


def encode(docs: DataFrame, path: str = VOCABULARY, alpha: float = 1.0, seed: int = 0, key: str = "doc_id") -> DataFrame:
    """key, `ids` (sampled pieces), `n_pieces` and `lossless` (the decoded pieces are the text) of every row of `docs`."""
    vocabulary = docs.sparkSession.sparkContext.broadcast(read_vocabulary(path))

    def run(batches):
        for batch, texts in chunks(batches, "text", BATCH_BYTES):
            tables = lattice(vocabulary.value, alpha)
            keys = batch.column(0).cast(pa.string()).to_pylist()
            seeds = np.array([xxhash.xxh64_intdigest("" if k is None else "=" + k, seed) for k in keys], np.uint64)
            ids, sizes = tables.sample(texts, seeds)
            offsets = np.concatenate(([0], np.cumsum(sizes)))
            same = [tables.text(ids[a:b]) == t for a, b, t in zip(offsets[:-1], offsets[1:], texts)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes), pa.ListArray.from_arrays(
                pa.array(offsets, pa.int32()), pa.array(ids, pa.int32())), pa.array(same)], [key, "n_pieces", "ids", "lossless"])

    rows = docs.select(key, F.col("text").cast("string").alias("text"))
    kind = rows.schema[key].dataType.simpleString()
    return rows.mapInArrow(run, f"{key} {kind}, n_pieces bigint, ids array<int>, lossless boolean")


def decode(encoded: DataFrame, path: str = VOCABULARY, key: str = "doc_id") -> DataFrame:
    """key and text of rows with `ids`; null ids give an empty text."""
    vocabulary = encoded.sparkSession.sparkContext.broadcast(read_vocabulary(path))

    def run(batches):
        for batch in slices(batches):
            tables = lattice(vocabulary.value, 1.0)
            texts = [tables.text(np.array(x or [], np.int32)).decode() for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], [key, "text"])

    rows = encoded.select(key, "ids")
    return rows.mapInArrow(run, f"{key} {rows.schema[key].dataType.simpleString()}, text string")
