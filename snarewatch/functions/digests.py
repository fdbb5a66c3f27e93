"""The first 31 bits of md5 for all windows of a text at once, in numpy."""

from __future__ import annotations

import hashlib
import math

import numpy as np

#: Windows whose digests are computed at a time, so that the arrays stay in a core's cache.
CHUNK = 16_384
#: Bytes of a window of eight characters at most, and the closing bit.
MOST_BYTES = 36
_TURN = [s for four in ((7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21)) for _ in range(4) for s in four]
_ADD = [int(abs(math.sin(i + 1)) * 2**32) for i in range(64)]
_START = (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)


def md5_head(words: dict[int, np.ndarray | int], n: int) -> np.ndarray:
    """First four bytes of md5, read as a number, of ``n`` messages of one block; ``words`` holds those of 16 words that are not 0."""
    a, b, c, d = (np.full(n, v, np.uint32) for v in _START)
    # the three steps after the 61st leave this part of the digest alone
    for i in range(61):
        if i < 16:
            f, at = d ^ (b & (c ^ d)), i
        elif i < 32:
            f, at = c ^ (d & (b ^ c)), (5 * i + 1) % 16
        elif i < 48:
            f, at = b ^ c ^ d, (3 * i + 5) % 16
        else:
            f, at = c ^ (b | ~d), 7 * i % 16
        word = words.get(at, 0)
        f += a
        if isinstance(word, int):
            f += np.uint32((_ADD[i] + word) % 2**32)
        else:
            f += np.uint32(_ADD[i])
            f += word
        turned = f << np.uint32(_TURN[i])
        f >>= np.uint32(32 - _TURN[i])
        turned |= f
        turned += b
        a, d, c, b = d, c, b, turned
    return (b + np.uint32(_START[0])).byteswap()


def _heads(data: np.ndarray, at: np.ndarray, size: np.ndarray) -> np.ndarray:
    """``md5_head`` of the ``size`` bytes of ``data`` from ``at``, at most MOST_BYTES - 4."""
    place = np.arange(MOST_BYTES)
    block = data[np.minimum(at[:, None] + place, len(data) - 1)]
    block[place >= size[:, None]] = 0
    block[np.arange(len(at)), size] = 0x80
    words = np.ascontiguousarray(block).view("<u4")
    return md5_head({**{i: np.ascontiguousarray(words[:, i]) for i in range(MOST_BYTES // 4)}, 14: (size * 8).astype(np.uint32)}, len(at))


def _windows(text: str, width: int) -> np.ndarray:
    data = np.frombuffer(text.encode(), np.uint8)
    # where each character begins, and where the last one ends
    begins = np.append(np.flatnonzero((data & 0xC0) != 0x80), len(data))
    at, size = begins[:-width], begins[width:] - begins[:-width]
    out = np.empty(len(at), np.uint32)
    plain = np.flatnonzero(size == 8) if width == 8 else np.empty(0, np.int64)
    byte = data.astype(np.uint32)
    for low in range(0, len(plain), CHUNK):
        rows = plain[low : low + CHUNK]
        one, two = (byte[p] | byte[p + 1] << 8 | byte[p + 2] << 16 | byte[p + 3] << 24 for p in (at[rows], at[rows] + 4))
        out[rows] = md5_head({0: one, 1: two, 2: 0x80, 14: 64}, len(rows))
    other = np.flatnonzero(size != 8) if width == 8 else np.arange(len(at))
    for low in range(0, len(other), CHUNK):
        rows = other[low : low + CHUNK]
        out[rows] = _heads(data, at[rows], size[rows])
    return out


def window_heads(texts: list[str], width: int = 8) -> list[np.ndarray]:
    """First four bytes of md5 of all windows of ``width`` (8 at most) characters of each text, repeated ones included.

    A shorter text is one window. Short texts are put together, as a call of numpy costs as much as many windows.
    """
    out: list[np.ndarray | None] = [None] * len(texts)
    group, length = [], 0

    def flush() -> None:
        if group:
            heads, low = _windows("".join(texts[i] for i in group), width), 0
            for i in group:
                out[i] = heads[low : low + len(texts[i]) - width + 1]
                low += len(texts[i])
        group.clear()

    for i, text in enumerate(texts):
        if len(text) < width:
            out[i] = np.frombuffer(hashlib.md5(text.encode()).digest()[:4], ">u4").astype(np.uint32)
            continue
        group.append(i)
        length += len(text)
        if length >= CHUNK:
            flush()
            length = 0
    flush()
    return out
