"""md5 of many short texts at once, as numpy arrays."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np

_SHIFT = [own[k % 4] for own in ((7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21)) for k in range(16)]
_SINES = [int(abs(math.sin(k + 1)) * 2**32) for k in range(64)]
_PLACE = [k if k < 16 else (5 * k + 1) % 16 if k < 32 else (3 * k + 5) % 16 if k < 48 else 7 * k % 16 for k in range(64)]
_START = (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)


def _block(state: list[np.ndarray], words: list) -> list[np.ndarray]:
    """The state after a block of 16 words, each a number or an array."""
    a, b, c, d = state
    for k in range(64):
        if k < 16:
            f = c ^ d
            f &= b
            f ^= d
        elif k < 32:
            f = b ^ c
            f &= d
            f ^= c
        elif k < 48:
            f = b ^ c
            f ^= d
        else:
            f = ~d
            f |= b
            f ^= c
        f += a
        word = words[_PLACE[k]]
        if isinstance(word, int):
            f += np.uint32((word + _SINES[k]) & 0xFFFFFFFF)
        else:
            f += word
            f += np.uint32(_SINES[k])
        high = f << np.uint32(_SHIFT[k])
        f >>= np.uint32(32 - _SHIFT[k])
        f |= high
        f += b
        a, d, c, b = d, c, b, f
    return [x + y for x, y in zip(state, (a, b, c, d))]


def _digits(values, length: int) -> list:
    """The decimal digits of numbers of one length as bytes."""
    return [values // 10 ** (length - 1 - k) % 10 + 48 for k in range(length)]


def _heads(text: list, n: int) -> np.ndarray:
    """First 32 bits of the md5 of ``n`` texts of one length; each byte is a number or an array of ``n``."""
    size = len(text)
    text = [*text, 0x80, *[0] * ((55 - size) % 64), *(8 * size).to_bytes(8, "little")]
    state = [np.full(n, x, np.uint32) for x in _START]
    for block in range(0, len(text), 64):
        words = []
        for at in range(block, block + 64, 4):
            fixed = sum(b << 8 * k for k, b in enumerate(text[at:at + 4]) if isinstance(b, int))
            some = [b.astype(np.uint32) << np.uint32(8 * k) for k, b in enumerate(text[at:at + 4]) if not isinstance(b, int)]
            words.append(np.bitwise_or.reduce([*some, np.full(n, fixed, np.uint32)]) if some else fixed)
        state = _block(state, words)
    return state[0].byteswap()


def _by_length(first: int, end: int) -> Iterator[tuple[int, int, int]]:
    """Runs of numbers with as many digits: first, end, digits."""
    while first < end:
        length = len(str(first))
        yield first, min(end, 10**length), length
        first = 10**length


def md5_heads(
    name: bytes, rep: int, rep_end: int, first: int, end: int, at_once: int
) -> Iterator[tuple[int | np.ndarray, np.ndarray]]:
    """First 32 bits of the md5 of ``<name><rep>,<i>`` for all replicates and ``i`` of two ranges.

    Gives pieces of about ``at_once``: the replicate, or one for each text, and the numbers as int64.
    """
    for r0, r1, r_length in _by_length(rep, rep_end):
        for i0, i1, i_length in _by_length(first, end):
            together = max(1, at_once // (i1 - i0))
            for r in range(r0, r1, together):
                for i in range(i0, i1, at_once):
                    numbers, reps = np.arange(i, min(i1, i + at_once)), r
                    if (many := min(together, r1 - r)) > 1:
                        reps = np.repeat(np.arange(r, r + many), len(numbers))
                        numbers = np.tile(numbers, many)
                    text = [*name, *_digits(reps, r_length), ord(","), *_digits(numbers, i_length)]
                    yield reps, _heads(text, len(numbers)).astype(np.int64)
