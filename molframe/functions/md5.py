"""md5 of many short byte strings of one buffer, by numpy: all strings take each step together."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

# The constants of md5 (RFC 1321).
SINES = np.floor(2.0**32 * np.abs(np.sin(np.arange(1, 65)))).astype(np.uint32)
SHIFTS = [7, 12, 17, 22] * 4 + [5, 9, 14, 20] * 4 + [4, 11, 16, 23] * 4 + [6, 10, 15, 21] * 4
START = np.array([0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476], np.uint32)
#: Strings that take the steps together; their state stays in the cache.
TOGETHER = 4096


def _advance(state: list[np.ndarray], block: np.ndarray) -> list[np.ndarray]:
    """States after one block of 64 bytes a row."""
    words = np.ascontiguousarray(block.view("<u4").T)
    a, b, c, d = state
    for i in range(64):
        if i < 16:
            f, g = d ^ (b & (c ^ d)), i
        elif i < 32:
            f, g = c ^ (d & (b ^ c)), (5 * i + 1) % 16
        elif i < 48:
            f, g = b ^ c ^ d, (3 * i + 5) % 16
        else:
            f, g = c ^ (b | ~d), 7 * i % 16
        f += a
        f += SINES[i]
        f += words[g]
        turned = f << np.uint32(SHIFTS[i])
        turned |= f >> np.uint32(32 - SHIFTS[i])
        turned += b
        a, d, c, b = d, c, b, turned
    return [old + new for old, new in zip(state, (a, b, c, d))]


def md5_words(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, prefix: bytes = b"") -> np.ndarray:
    """The four 32-bit words of md5(prefix + data[start:end]), as its hex digits read, one row a word."""
    if len(prefix) > 55:
        raise ValueError("a prefix must leave room in the first block")
    front = len(prefix)
    padded = np.concatenate([np.zeros(front, np.uint8), data, np.zeros(64, np.uint8)])
    # Every 64 bytes in a row; with the prefix, a string begins where ``data`` has it.
    rows = np.lib.stride_tricks.sliding_window_view(padded, 64)
    out = np.empty((4, len(starts)), np.uint32)
    places = np.arange(64)
    for first in range(0, len(starts), TOGETHER):
        begin = starts[first : first + TOGETHER].astype(np.int64)
        size = ends[first : first + TOGETHER] - begin + front
        blocks = (size + 8) // 64 + 1
        state = [np.full(len(begin), v, np.uint32) for v in START]
        for b in range(int(blocks.max())):
            some = np.flatnonzero(blocks > b)
            left = size[some] - 64 * b
            block = rows[np.minimum(begin[some] + 64 * b, len(rows) - 1)]
            if not b and front:
                block[:, :front] = np.frombuffer(prefix, np.uint8)
            block *= places < left[:, None]
            ended = np.flatnonzero((left >= 0) & (left < 64))
            block[ended, left[ended]] = 0x80
            last = blocks[some] == b + 1
            block[last, 56:] = (8 * size[some][last]).astype("<u8").view(np.uint8).reshape(-1, 8)
            moved = _advance([s[some] for s in state], block)
            for s, m in zip(state, moved):
                s[some] = m
        for k in range(4):
            out[k, first : first + TOGETHER] = state[k].byteswap()
    return out


def bytes_of(strings: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all strings, one after the other, and where each begins and the last ends; nulls have none."""
    filled = pc.fill_null(strings, "").cast(pa.large_string())
    _, offsets, data = filled.buffers()
    bounds = np.frombuffer(offsets, np.int64)[filled.offset : filled.offset + len(filled) + 1] if len(filled) else np.zeros(1, np.int64)
    return np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8), bounds
