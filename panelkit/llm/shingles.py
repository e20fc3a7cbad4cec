"""Words and shingles of whole Arrow batches in numpy: one pass over the bytes of many texts at once."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
_ODD = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser, so that every bit depends on every other."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_known_powers: dict[np.uint64, np.ndarray] = {}


def _powers(n: int, base: np.uint64) -> np.ndarray:
    """The base's first n powers or more, modulo 2 ** 64; those of an ordinary piece of text are kept."""
    if len(_known_powers.get(base, ())) >= n:
        return _known_powers[base]
    out = np.full(max(n, 1 << 16), base, dtype=np.uint64)
    out[0] = 1
    out = np.cumprod(out, dtype=np.uint64)
    if n <= 1 << 21:
        _known_powers[base] = out
    return out


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts and the n + 1 offsets of each (null: empty)."""
    column = pa.array(texts, pa.large_string()) if not isinstance(texts, pa.Array) else texts.cast(pa.large_string())
    column = column.fill_null("") if column.null_count else column
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    body = np.frombuffer(data, dtype=np.uint8)[at[0] : at[-1]] if data is not None and len(at) else np.empty(0, dtype=np.uint8)
    return body, at - at[0]


def words(body: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, first): places of all words, and of each text its first word's index (n + 1 entries)."""
    if not len(body):
        return np.empty(0, np.int64), np.empty(0, np.int64), np.zeros(len(at), np.int64)
    inside = ~_SPACE[body]
    begins, ends = inside.copy(), inside.copy()
    border = np.zeros(len(body) + 1, dtype=bool)
    border[at] = True
    begins[1:] &= ~inside[:-1] | border[1:-1]
    ends[:-1] &= ~inside[1:] | border[1:-1]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    return start, end, np.searchsorted(start, at)


def word_hashes(body: np.ndarray, start: np.ndarray, end: np.ndarray, lower: bool = True) -> np.ndarray:
    """A 64-bit hash of each word (A-Z lower-cased if lower)."""
    if not len(start):
        return np.empty(0, dtype=np.uint64)
    # running sums of byte * power: the difference at a word's borders, divided by the power at its start, is the word's own sum
    sums = np.zeros(len(body) + 1, dtype=np.uint64)
    value = (_LOWER[body] if lower else body).astype(np.uint64) + np.uint64(1)
    np.cumsum(value * _powers(len(body), _ODD)[: len(body)], out=sums[1:])
    own = (sums[end] - sums[start]) * _powers(len(body), _INVERSE)[start]
    return mixed(own + (end - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def shingle_sets(texts: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each text, one after another, and their n + 1 offsets.

    A text with fewer than `width` words, but some, has one shingle: its whole word sequence.
    """
    body, at = text_bytes(texts)
    start, end, first = words(body, at)
    h = word_hashes(body, start, end)
    rolled = np.zeros(max(0, len(h) - width + 1), dtype=np.uint64)
    factors = mixed(np.arange(1, width + 1, dtype=np.uint64) * _ODD) | np.uint64(1)
    for k in range(width):
        rolled += h[k : k + len(rolled)] * factors[k]
    rolled = mixed(rolled)
    sets = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
        if b - a >= width:
            sets.append(np.unique(rolled[a : b - width + 1]))
        elif b > a:
            sets.append(mixed((h[a:b] * factors[: b - a]).sum(dtype=np.uint64, keepdims=True) + np.uint64(b - a)))
        else:
            sets.append(h[:0])
    offsets = np.concatenate([[0], np.cumsum([len(s) for s in sets], dtype=np.int64)]).astype(np.int64)
    return (np.concatenate(sets) if sets else h[:0]), offsets


def pieces(column: pa.Array, most_bytes: int = 1_000_000) -> list[tuple[int, int]]:
    """Row ranges of about most_bytes of text (one text at least), to keep numpy's work in cache."""
    sizes = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    out, begin, held = [], 0, 0
    for i, n in enumerate(sizes.tolist()):
        if held and held + n > most_bytes:
            out.append((begin, i))
            begin, held = i, 0
        held += n
    return [*out, (begin, len(sizes))] if len(sizes) > begin else out
