"""Salted, order-free uniforms: arm assignment, random splits and bootstrap weights."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

HEX48 = float(16 ** 12)


def uniform48(*parts: Column | str) -> Column:
    """Uniform in [0, 1) from the first 48 bits of the md5 of ``a:b:c``."""
    digest = F.md5(F.concat_ws(":", *[p.cast("string") if isinstance(p, Column) else F.lit(p)
                                      for p in parts]))
    return F.conv(F.substring(digest, 1, 12), 16, 10).cast("double") / F.lit(HEX48)


def account_uniform(account: str, salt: str, tag: str = "") -> Column:
    """Uniform of an account; the hashed text is ``salt:id`` or ``salt:tag:id``."""
    parts: list[Column | str] = [salt, tag, F.col(account)] if tag else [salt, F.col(account)]
    return uniform48(*parts)


def arm_of(account: str = "account_id", salt: str = "stage2-v1") -> Column:
    """Deterministic fifty-fifty arm, independent of row order."""
    return F.when(account_uniform(account, salt) < 0.5, "challenger").otherwise("champion")


LANES = 4  # one 128-bit digest carries four 32-bit draws


def poisson_cuts() -> list[int]:
    """Upper edges, scaled to 32 bits, of the Poisson(1) distribution function."""
    edges, total, k = [], 0.0, 0
    while True:
        total += math.exp(-1.0) / math.factorial(k)
        edge = math.ceil(total * 2 ** 32)
        if edge >= 2 ** 32 or k > 12:
            return edges
        edges.append(edge)
        k += 1


def poisson_weights(seed: str, block: Column, row_key: Column) -> list[Column]:
    """Four bootstrap weights of a row for the replicates ``4*block .. 4*block+3``.

    A weight depends on seed, replicate and row key alone, so it survives any repartitioning or
    a re-run of a lost task.
    """
    digest = F.md5(F.concat_ws(":", F.lit(seed), block.cast("string"), row_key.cast("string")))
    out = []
    for lane in range(LANES):
        draw = F.conv(F.substring(digest, 1 + 8 * lane, 8), 16, 10).cast("long")
        weight = F.lit(0)
        for edge in poisson_cuts():
            weight = weight + F.when(draw >= F.lit(edge), 1).otherwise(0)
        out.append(weight)
    return out


# Fixed values of MD5: additive constants, rotations and the message word of each step.
MD5_ADD = [int(abs(math.sin(i + 1)) * 2 ** 32) for i in range(64)]
MD5_TURN = [r[i % 4] for r in ((7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21)) for i in range(16)]
MD5_WORD = [(i, 5 * i + 1, 3 * i + 5, 7 * i)[i // 16] % 16 for i in range(64)]
MD5_START = (0x67452301, 0xefcdab89, 0x98badcfe, 0x10325476)
MD5_CELLS = 16_384  # digests made together, so that their state stays in the cache
MD5_BYTES = 55  # a longer text has more than one block


def _md5_block(words: Sequence[np.ndarray], shape: tuple[int, int]) -> list[np.ndarray]:
    """The four state words of texts of one block, from 16 message words that broadcast to ``shape``."""
    a, b, c, d = (np.full(shape, x, np.uint32) for x in MD5_START)
    f, t = np.empty(shape, np.uint32), np.empty(shape, np.uint32)
    for i in range(64):
        if i < 32:  # choose c or d by b, or b or c by d
            x, y, z = (b, c, d) if i < 16 else (d, b, c)
            np.bitwise_xor(y, z, out=f)
            f &= x
            f ^= z
        elif i < 48:
            np.bitwise_xor(b, c, out=f)
            f ^= d
        else:
            np.invert(d, out=f)
            f |= b
            f ^= c
        f += a
        f += words[MD5_WORD[i]] + np.uint32(MD5_ADD[i])
        np.right_shift(f, 32 - MD5_TURN[i], out=t)
        f <<= np.uint32(MD5_TURN[i])
        f |= t
        f += b
        a, b, c, d, f = d, f, b, c, a
    return [x + np.uint32(start) for x, start in zip((a, b, c, d), MD5_START)]


def _padded(texts: Sequence[bytes], at: int, end: bool) -> np.ndarray:
    """Texts of one length as message words (16 lines), beginning at byte ``at``; the end carries the mark and the bit length."""
    n, size = len(texts), len(texts[0])
    room = np.zeros((n, 64), np.uint8)
    room[:, at:at + size] = np.frombuffer(b"".join(texts), np.uint8).reshape(n, size)
    if end:
        room[:, at + size] = 0x80
        room[:, 56:58] = np.frombuffer(np.uint16(8 * (at + size)).tobytes(), np.uint8)
    return room.view("<u4").T.astype(np.uint32)


def md5_draws(heads: Sequence[bytes], tails: Sequence[bytes]) -> np.ndarray:
    """32-bit draws of the MD5 of every tail (lines) after every head (four columns each), many digests at a time."""
    out = np.empty((len(tails), len(heads), LANES), np.uint32)
    by_head: dict[int, list[int]] = {}
    by_tail: dict[int, list[int]] = {}
    for i, head in enumerate(heads):
        by_head.setdefault(len(head), []).append(i)
    for i, tail in enumerate(tails):
        by_tail.setdefault(len(tail), []).append(i)
    for at, some in by_head.items():
        first = _padded([heads[i] for i in some], at=0, end=False)
        for size, rows in by_tail.items():
            if at + size > MD5_BYTES:
                digests = b"".join(hashlib.md5(heads[h] + tails[r]).digest() for r in rows for h in some)
                out[np.ix_(rows, some)] = np.frombuffer(digests, ">u4").reshape(len(rows), len(some), LANES)
                continue
            last = _padded([tails[i] for i in rows], at, end=True)
            step = max(1, MD5_CELLS // len(rows))
            for low in range(0, len(some), step):
                part = some[low:low + step]
                own = first[:, low:low + step]
                words = [last[g][:, None] | own[g] if own[g].any() else last[g][:, None] for g in range(16)]
                state = _md5_block(words, (len(rows), len(part)))
                out[np.ix_(rows, part)] = np.stack([x.byteswap() for x in state], axis=-1)
    return out.reshape(len(tails), -1)


def _weight_table() -> np.ndarray:
    """Weight by the upper 16 bits of a draw; 255 where an edge lies among the draws of one entry."""
    low = np.arange(65536, dtype=np.uint64) << np.uint64(16)
    edges = np.array(poisson_cuts(), np.uint64)
    below, above = (np.searchsorted(edges, x, side="right") for x in (low, low + np.uint64(65535)))
    return np.where(below == above, below, 255).astype(np.uint8)


WEIGHT_TABLE = _weight_table()


def weights_of(seed: str, tails: Sequence[bytes], replicates: int) -> np.ndarray:
    """Weights of rows (lines) in replicates (columns), whole numbers as doubles, equal to those of ``poisson_weights``.

    A tail is what follows the block in the hashed text: a colon and the row key, or nothing for a key that is null.
    """
    draws = md5_draws([f"{seed}:{block}".encode() for block in range(math.ceil(replicates / LANES))], tails)[:, :replicates]
    weights = WEIGHT_TABLE[draws >> np.uint32(16)]
    open_ = weights == 255
    weights[open_] = np.searchsorted(np.array(poisson_cuts(), np.uint64), draws[open_].astype(np.uint64), side="right")
    return weights.astype(float)
