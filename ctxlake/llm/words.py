"""Words of whole Arrow batches at a time, with numpy: where they are, their hashes, and their shingles.

Words end at ASCII white space. Nothing is decoded and no Python object is made per word. Batches are taken in pieces of
bounded size: short texts together, a long one in several pieces that are cut at white space.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

from ctxlake.llm.common import LOWER

SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.frombuffer(LOWER, np.uint8)
_LOW_BYTES = np.array([(1 << (8 * n)) - 1 for n in range(9)], np.uint64)
_MIX = np.uint64(0x9E3779B97F4A7C15)
_STEPS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3], np.uint64)
#: Bytes of a piece, and of a word from which it is hashed on its own.
PIECE, LONG_WORD = 1 << 21, 64


def raw(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and where each text begins in them, with the last one's end; null texts are empty."""
    if texts.null_count:
        texts = pc.fill_null(texts, "")
    buffers = texts.buffers()
    if not len(texts) or buffers[2] is None:
        return np.zeros(0, np.uint8), np.zeros(len(texts) + 1, np.int64)
    kind = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    offsets = np.frombuffer(buffers[1], kind)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    return np.frombuffer(buffers[2], np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def by_bytes(column: pa.Array, most: int = 2 * PIECE) -> Iterator[tuple[int, int]]:
    """Ranges of rows of at most so many bytes, of one row at least."""
    offsets, a = raw(column)[1], 0
    while a < len(column):
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + most, side="right")) - 1)
        yield a, b
        a = b


def in_pieces(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, offsets) of at most about PIECE bytes each. A longer text comes in several pieces of one row;
    a word is never cut, so that a piece is as long as its first word at least."""
    row, n = 0, len(offsets) - 1
    while row < n:
        a = int(offsets[row])
        last = max(row + 1, int(np.searchsorted(offsets, a + PIECE, side="right")) - 1)
        if last > row + 1 or offsets[last] - a <= PIECE:
            yield row, data[a : offsets[last]], offsets[row : last + 1] - a
        else:
            end = int(offsets[last])
            while a < end:
                b = min(a + PIECE, end)
                while b < end:
                    spaces = np.flatnonzero(SPACE[data[b : min(b + PIECE, end)]])
                    if len(spaces):
                        b += int(spaces[0])
                        break
                    b = min(b + PIECE, end)
                yield row, data[a:b], np.array([0, b - a])
                a = b
        row = last


def cut(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where words start and end, and how many each text has."""
    n = len(data)
    inside = ~SPACE[data]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    starts = np.flatnonzero(inside & ~(np.concatenate([[False], inside[:-1]]) & ~edge[:n]))
    ends = np.flatnonzero(inside & ~(np.concatenate([inside[1:], [False]]) & ~edge[1:])) + 1
    return starts, ends, np.diff(np.searchsorted(starts, offsets))


def scramble(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of whole words, eight bytes a step; words of equal length up to 8 never collide."""
    size = ends - starts
    h = (size.astype(np.uint64) + np.uint64(1)) * _MIX
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    eight = np.ndarray((len(padded) - 7,), "<u8", padded, strides=(1,))
    live = np.arange(len(starts))
    for step in range(0, LONG_WORD, 8):
        if step:
            live = live[size[live] > step]
        if not len(live):
            break
        x = eight[starts[live] + step] & _LOW_BYTES[np.minimum(size[live] - step, 8)]
        h[live] = scramble(h[live] ^ x) + _MIX
    for i in np.flatnonzero(size > LONG_WORD).tolist():
        h[i] = xxhash.xxh3_64_intdigest(data[starts[i] : ends[i]].tobytes())
    return h


def word_hashes(texts: pa.Array, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of a column and the number of words of each text; lower: A-Z count as a-z."""
    data, offsets = raw(texts)
    n_words, out = np.zeros(len(texts), np.int64), []
    for row, part, at in in_pieces(data, offsets):
        if lower:
            part = _LOWER[part]
        starts, ends, n = cut(part, at)
        out.append(hashes(part, starts, ends))
        n_words[row : row + len(n)] += n
    return np.concatenate(out) if out else np.zeros(0, np.uint64), n_words


def shingles(texts: pa.Array, k: int) -> list[np.ndarray]:
    """Each text's sorted distinct 64-bit hashes of k-word shingles. Fewer words are one shingle, no words are none."""
    h, n_words = word_hashes(texts)
    n = max(0, len(h) - k + 1)
    mixed = np.full(n, k, np.uint64)
    for j in range(k):
        mixed = (mixed ^ h[j : j + n]) * _STEPS[j % 8] + _MIX
        mixed ^= mixed >> np.uint64(31)
    mixed = scramble(mixed)
    out, upto = [], np.cumsum(n_words)
    for end, size in zip(upto.tolist(), n_words.tolist()):
        if size >= k:
            s = np.sort(mixed[end - size : end - k + 1])
            if len(s) > 1:
                s = s[np.concatenate([[True], s[1:] != s[:-1]])]
        elif size:
            one = np.full(1, size, np.uint64)
            for j in range(size):
                one = (one ^ h[end - size + j]) * _STEPS[j % 8] + _MIX
                one ^= one >> np.uint64(31)
            s = scramble(one)
        else:
            s = np.zeros(0, np.uint64)
        out.append(s)
    return out
