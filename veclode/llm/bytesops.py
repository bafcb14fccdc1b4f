"""Small numpy helpers for tasks that look at text as bytes: Arrow buffers, words, rolling hashes."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_U = np.uint64
_BASE, _SEED = 0x9E3779B97F4A7C15 | 1, 20240917
#: One random 64-bit value per byte, from a fixed seed.
_BYTE = np.random.default_rng(_SEED).integers(1, 2**63, 256, dtype=np.uint64)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: The white space between words: space and bytes 9 to 13.
_SEP = np.zeros(256, bool)
_SEP[[32, *range(9, 14)]] = True
_powers: dict[str, np.ndarray] = {}


def pieces(batches: Iterable[pa.RecordBatch], column: str | int, most: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about `most` bytes of text (a longer single text has its own batch)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        size = pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(column) if isinstance(column, str) else column)), 0)
        group = np.cumsum(size.to_numpy(zero_copy_only=False).astype(np.int64)) // most
        cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:]):
            if b > a:
                yield batch.slice(a, b - a)


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts in a row and the n + 1 offsets; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = pc.fill_null(column, b"")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambler of 64-bit values (the splitmix64 finaliser)."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U(27))
    x = x * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def powers(n: int, base: int = _BASE) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i below n."""
    key = str(base)
    if key not in _powers or len(_powers[key][0]) < n:
        size = max(n, 1 << 16)
        both = []
        for b in (base, pow(base, -1, 2**64)):
            p = np.full(size, b, np.uint64)
            p[0] = 1
            both.append(np.cumprod(p))
        _powers[key] = tuple(both)
    up, down = _powers[key]
    return up[:n], down[:n]


def prefix(data: np.ndarray, base: int = _BASE) -> np.ndarray:
    """Prefix sums whose differences, times base**-start, hash any substring."""
    up, _ = powers(len(data) + 1, base)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[data] * up[:-1], out=sums[1:])
    return sums


def span_hash(sums: np.ndarray, start: np.ndarray, end: np.ndarray, base: int = _BASE) -> np.ndarray:
    """Rolling hashes of the substrings [start, end): equal substrings have equal hashes wherever they stand. Different
    ones of special forms can share one, so these only choose positions and contexts; units go by unit_hash."""
    _, down = powers(len(sums), base)
    return mix((sums[end] - sums[start]) * down[start] + (end - start).astype(np.uint64))


_EIGHT = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
_LANES = mix(np.arange(1, 5, dtype=np.uint64) * _U(_BASE))
_LONG, _PIECE = 1024, 512


def eights(data: np.ndarray) -> np.ndarray:
    """At each byte, it and the next seven as one little-endian number; zeros follow the end."""
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[: len(data)] = data
    return np.ndarray((len(data) + 1,), "<u8", padded, strides=(1,))


def unit_hash(data: np.ndarray, start: np.ndarray, end: np.ndarray, lane: int = 0) -> np.ndarray:
    """Hashes of the spans [start, end), eight bytes a step, each step scrambled; lanes are independent of each other.
    Long spans are hashed in pieces, and then the row of their hashes."""
    length = end - start
    h = mix(length.astype(np.uint64) ^ _LANES[lane])
    if not len(h):
        return h
    wide = eights(data)
    long = length > _LONG
    left = np.flatnonzero((length > 0) & ~long)
    at, rest, own = start[left], length[left], h[left]
    while len(left):
        own = mix(own ^ (wide[at] & _EIGHT[np.minimum(rest, 8)]))
        done = rest <= 8
        if done.any():
            h[left[done]] = own[done]
            on = np.flatnonzero(~done)
            left, at, rest, own = left[on], at[on], rest[on], own[on]
        at, rest = at + 8, rest - 8
    if long.any():
        pieces = -(-length[long] // _PIECE)
        to = np.concatenate([[0], np.cumsum(pieces)])
        begin = np.repeat(start[long] - to[:-1] * _PIECE, pieces) + np.arange(to[-1]) * _PIECE
        inner = unit_hash(data, begin, np.minimum(begin + _PIECE, np.repeat(end[long], pieces)), lane)
        h[long] = mix(h[long] ^ unit_hash(inner.view(np.uint8), 8 * to[:-1], 8 * to[1:], lane))
    return h


def words(data: np.ndarray, offsets: np.ndarray, apart: np.ndarray = _SEP) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased bytes (A-Z only), word starts, word ends and, for each text, the index of its first word (n + 1).
    apart: which bytes stand between words."""
    low = _LOWER[data]
    inside = ~apart[data]
    n = len(data)
    if not n:
        none = np.zeros(0, np.int64)
        return low, none, none, np.zeros(len(offsets), np.int64)
    before = np.zeros(n, bool)
    before[1:] = inside[:-1]
    before[offsets[:-1][offsets[:-1] < n]] = False
    after = np.zeros(n, bool)
    after[:-1] = inside[1:]
    last = offsets[1:] - 1
    after[last[last >= 0]] = False
    start = np.flatnonzero(inside & ~before)
    end = np.flatnonzero(inside & ~after) + 1
    return low, start, end, np.searchsorted(start, offsets)


def gather(data: np.ndarray, start: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """data[start:start+length] of all spans in a row, and the n + 1 offsets."""
    to = np.zeros(len(start) + 1, np.int64)
    np.cumsum(length, out=to[1:])
    index = np.repeat(start - to[:-1], length) + np.arange(to[-1])
    return data[index], to


def strings(data: np.ndarray, offsets: np.ndarray, kind: pa.DataType = pa.binary()) -> pa.Array:
    """An Arrow array of binary or string values over these bytes."""
    return pa.Array.from_buffers(kind, len(offsets) - 1, [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data))])
