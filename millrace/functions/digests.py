"""Whirlpool, the public 512-bit digest of ISO/IEC 10118-3, over whole batches of texts."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the standard: the two small boxes that the substitution is made of, the diffusion's row and the field's polynomial.
_E = (0x1, 0xB, 0x9, 0xC, 0xD, 0x6, 0xF, 0x3, 0xE, 0x8, 0x7, 0x4, 0xA, 0x2, 0x5, 0x0)
_R = (0x7, 0xC, 0xB, 0xD, 0xE, 0x4, 0x9, 0xF, 0x6, 0x3, 0x8, 0xA, 0x2, 0x5, 0x1, 0x0)
_ROW, _POLYNOMIAL, _ROUNDS = (1, 1, 4, 1, 8, 5, 2, 9), 0x11D, 10


def substitution() -> np.ndarray:
    """The 256 values of the substitution box."""
    e, r = np.array(_E, "u1"), np.array(_R, "u1")
    back = np.argsort(e).astype("u1")
    x = np.arange(256)
    high, low = e[x >> 4], back[x & 15]
    mixed = r[high ^ low]
    return (e[high ^ mixed] << 4) | back[low ^ mixed]


def _times(a: np.ndarray, factor: int) -> np.ndarray:
    """Products in the field of 256 elements."""
    out, a = np.zeros(256, np.int64), a.astype(np.int64)
    while factor:
        if factor & 1:
            out ^= a
        a = np.where(a & 128, (a << 1) ^ _POLYNOMIAL, a << 1)
        factor >>= 1
    return out


def _tables() -> tuple[np.ndarray, np.ndarray]:
    """What a byte at each of eight places adds to a word, and the rounds' constants."""
    box = substitution()
    first = np.zeros(256, "u8")
    for factor in _ROW:
        first = (first << np.uint64(8)) | _times(box, factor).astype("u8")
    turned = [first] + [(first >> np.uint64(8 * t)) | (first << np.uint64(64 - 8 * t)) for t in range(1, 8)]
    return np.array(turned), box[: 8 * _ROUNDS].copy().view(">u8").astype("u8")


def _diffused(words: np.ndarray, tables: np.ndarray) -> np.ndarray:
    """Substitution, shift of columns and diffusion of states ``(n, 8)``."""
    held = words.astype(">u8").view("u1").reshape(-1, 8, 8)
    out = tables[0][held[:, :, 0]]
    for t in range(1, 8):
        out ^= tables[t][np.roll(held[:, :, t], t, axis=1)]
    return out


def digest_batch(texts: list[bytes]) -> list[str]:
    """Hexadecimal digests; all texts of a batch go through each block's rounds together."""
    if not texts:
        return []
    tables, constants = _tables()
    sizes = np.array([len(t) for t in texts], np.int64)
    # a one bit, zeros, and the length in 32 bytes
    blocks = (sizes + 33 + 63) // 64
    begins = np.r_[0, np.cumsum(blocks)]
    raw = b"".join(t + b"\x80" + bytes(int(b) * 64 - len(t) - 33) + (8 * len(t)).to_bytes(32, "big") for t, b in zip(texts, blocks, strict=True))
    words = np.frombuffer(raw, ">u8").reshape(-1, 8)
    order = np.argsort(-blocks, kind="stable")
    state = np.zeros((len(texts), 8), "u8")
    longest_first = -blocks[order]
    for k in range(int(blocks.max())):
        now = order[: np.searchsorted(longest_first, -k, "left")]  # those with more than k blocks
        block, key = words[begins[now] + k].astype("u8"), state[now]
        mixed = block ^ key
        for constant in constants:
            key = _diffused(key, tables)
            key[:, 0] ^= constant
            mixed = _diffused(mixed, tables) ^ key
        state[now] ^= mixed ^ block
    return [row.tobytes().hex() for row in state.astype(">u8")]


def digest_512(s: Column) -> Column:
    """The digest of a text's UTF-8 bytes, as 128 hexadecimal digits; null for null."""

    @F.pandas_udf("string")
    def run(column: pd.Series) -> pd.Series:
        there = column.notna()
        out = pd.Series([None] * len(column), index=column.index, dtype="object")
        out[there] = digest_batch([v.encode() for v in column[there]])
        return out

    return run(s)
