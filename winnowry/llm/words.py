"""Hashes of the words of many texts at once, from their UTF-8 bytes as Arrow holds them.

A word is a run of bytes other than ASCII white space, A-Z lower-cased. Its hash is a sum of
random numbers for its bytes times powers of an odd number, scrambled with its length.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash

from .common import mix64

#: Bytes that one step handles, so that its arrays stay in cache; words longer than LONG bytes are hashed one by one.
PIECE, LONG = 1 << 17, 512
BASE = 0x9E3779B97F4A7C15
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
VALUES = np.random.default_rng(20240229).integers(1, 2**63, 256, np.uint64) * np.uint64(2) + np.uint64(1)
VALUES[65:91] = VALUES[97:123]
VALUES[SPACE] = 0
with np.errstate(over="ignore"):
    POWERS = np.cumprod(np.append(np.uint64(1), np.full(PIECE + LONG, BASE, np.uint64)), dtype=np.uint64)
    BACK = np.cumprod(np.append(np.uint64(1), np.full(PIECE + LONG, pow(BASE, -1, 2**64), np.uint64)), dtype=np.uint64)


def spans(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bounds of each text and the bytes they lie in; null texts are empty."""
    if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type):
        kind = np.int64
    else:
        kind = np.int32
    _, offsets, data = column.buffers()
    n = len(column)
    if not n:
        return np.zeros(1, np.int64), np.empty(0, np.uint8)
    at = np.frombuffer(offsets, kind, n + 1, column.offset * kind().itemsize).astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and at[-1] else np.empty(0, np.uint8)
    if column.null_count and (np.diff(at)[np.asarray(column.is_null())] != 0).any():
        return spans(column.fill_null(""))
    return at, raw


def bounds(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end) of every word within raw, and how many words lie before each of the bounds at."""
    low, high = int(at[0]), int(at[-1])
    edge = np.zeros(high - low + 1, np.int8)
    np.logical_not(SPACE[raw[low:high]], out=edge[:-1].view(bool))
    inner = at[(at > low) & (at < high)] - low
    inner = np.unique(inner[(edge[inner] & edge[inner - 1]).astype(bool)])  # words that touch over the end of a text
    step = np.flatnonzero(np.diff(edge, prepend=np.int8(0)))
    if len(inner):
        step = np.sort(np.concatenate([step, inner, inner]))
    start, end = step[::2] + low, step[1::2] + low
    return start, end, np.searchsorted(start, at)


def hashes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Each text's bounds in an array of word hashes (uint64), and that array."""
    at, raw = spans(column)
    start, end, offsets = bounds(raw, at)
    out = np.empty(len(start), np.uint64)
    a = 0
    with np.errstate(over="ignore"):
        while a < len(start):
            low = int(start[a])
            b = int(np.searchsorted(end, low + PIECE, side="right"))
            if b == a:  # one word longer than a piece
                b = a + 1
                out[a] = 0
            else:
                piece = VALUES[raw[low : int(end[b - 1])]]
                piece *= POWERS[: len(piece)]
                s = start[a:b] - low
                out[a:b] = np.add.reduceat(piece, s) * BACK[s]
            a = b
        size = (end - start).astype(np.uint64)
        out = mix64(out + size * np.uint64(0xD6E8FEB86659FD93))
    for i in np.flatnonzero(size > LONG).tolist():
        out[i] = xxhash.xxh3_64_intdigest(raw[start[i] : end[i]].tobytes().lower())
    return offsets, out


def cut_batches(stream: Iterator[pa.RecordBatch], column: str, most: int = 4_000_000, rows: int = 10_000) -> Iterator[pa.RecordBatch]:
    """The batches in slices with texts of at most so many bytes and rows, or of one row."""
    for batch in stream:
        at, _ = spans(batch.column(column))
        a = 0
        while a < len(batch):
            b = min(max(a + 1, int(np.searchsorted(at, at[a] + most, side="right")) - 1), a + rows)
            yield batch.slice(a, b - a)
            a = b


def joined_batches(stream: Iterator[pa.RecordBatch], column: str, least: int) -> Iterator[pa.RecordBatch]:
    """Neighbouring batches put together until their texts have so many bytes: for work that costs by the call."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in stream:
        at, _ = spans(batch.column(column))
        held.append(batch)
        size += int(at[-1] - at[0])
        if size >= least:
            yield pa.concat_batches(held)
            held, size = [], 0
    if held:
        yield pa.concat_batches(held)
