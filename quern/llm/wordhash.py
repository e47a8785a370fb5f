"""Vectorised word and shingle hashing over Arrow string buffers.

Words are the maximal runs of bytes outside ``[\\x20\\x09-\\x0D]``; A-Z is
lower-cased, nothing else is changed.  UTF-8 never uses those bytes inside a
multi-byte character, so byte runs and code-point runs are the same words.

Everything here is plain numpy on one text at a time, so memory is bounded by
the text and not by the table.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa

_U = np.uint64
_ODD = 0x9E3779B97F4A7C15

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


#: For matching across layout and punctuation: every ASCII byte but letters and digits separates words.
PUNCTUATION = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])


def mix64(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser: a bijection of 64-bit words."""
    x = x.astype(_U, copy=True)
    x ^= x >> _U(30)
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


#: A-Z as a-z.
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
#: The low bytes that a word's last eight bytes have, by their number.
_KEPT = np.array([(1 << 8 * k) - 1 for k in range(9)], dtype=_U)
#: Longer words are hashed one by one.
LONG_WORD = 128


def word_spans(data: np.ndarray, space: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words of one text; ``space``: for each byte, whether it separates words."""
    word = np.empty(len(data) + 2, dtype=np.int8)
    word[0] = word[-1] = 0
    np.logical_not(space[data], out=word[1:-1].view(bool))
    edge = np.diff(word)
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def hash_words(data: np.ndarray, space: np.ndarray = _SPACE) -> np.ndarray:
    """One 64-bit hash for each word of a text, in text order.

    A word's length and its bytes, eight at a time, go through a bijection of
    64-bit words each; words of over ``LONG_WORD`` bytes through BLAKE2.
    """
    return hash_spans(data, *word_spans(data, space))


def hash_spans(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The same for words that are known by their starts and ends."""
    if not len(start):
        return np.zeros(0, dtype=_U)
    size = end - start
    low = np.zeros(len(data) + 8, dtype=np.uint8)
    np.take(_LOWER, data, out=low[: len(data)], mode="clip")
    eight = np.ndarray(len(data) + 1, dtype="<u8", buffer=low.data, strides=(1,))
    out = mix64((eight[start] & _KEPT[np.minimum(size, 8)]) + size.astype(_U) * _U(_ODD))
    left, at = np.flatnonzero(size > 8), 8
    while len(left) and at < LONG_WORD:
        out[left] = mix64(mix64(eight[start[left] + at] & _KEPT[np.minimum(size[left] - at, 8)]) + out[left] * _U(_ODD))
        at += 8
        left = left[size[left] > at]
    for k in left:
        out[k] = int.from_bytes(blake2b(low[start[k] : end[k]].data, digest_size=8).digest(), "little")
    return out


def shingle_hashes(words: np.ndarray, width: int) -> np.ndarray:
    """Hashes of every run of ``width`` words; with fewer words, of the whole sequence as one."""
    n = len(words)
    if not n:
        return np.zeros(0, dtype=_U)
    k = min(n, width)
    factor = mix64(np.arange(1, k + 1, dtype=_U) * _U(0xD6E8FEB86659FD93)) | _U(1)
    total = np.zeros(n - k + 1, dtype=_U)
    for j in range(k):
        total += words[j : n - k + 1 + j] * factor[j]
    return mix64(total + _U(k))


def text_buffers(column: pa.Array | pa.ChunkedArray) -> Iterator[np.ndarray | None]:
    """The UTF-8 bytes of each value without copying them; None for null."""
    for chunk in column.chunks if isinstance(column, pa.ChunkedArray) else [column]:
        if not len(chunk):
            continue
        wide = pa.types.is_large_string(chunk.type) or pa.types.is_large_binary(chunk.type)
        _, offsets, data = chunk.buffers()
        offset = np.frombuffer(offsets, dtype=np.int64 if wide else np.int32)[chunk.offset : chunk.offset + len(chunk) + 1]
        raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, dtype=np.uint8)
        there = None if not chunk.null_count else chunk.is_valid().to_numpy(zero_copy_only=False)
        for i in range(len(chunk)):
            yield None if there is not None and not there[i] else raw[offset[i] : offset[i + 1]]
