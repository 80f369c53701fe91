"""Words, hashes and shingles of Arrow string batches, computed with numpy over the raw UTF-8 bytes.

A word is a run of bytes other than space and 9 to 13.  All separators are ASCII, so byte runs and code point runs
have the same borders.  A word's hash is a polynomial over random byte values modulo 2**64, mixed afterwards; it is
the same in every process.  Texts are worked through in pieces of bounded size, whatever the batch holds.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
PIECE_BYTES = 1 << 19

SPACE = np.zeros(256, dtype=bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def _byte_values(lower: bool) -> np.ndarray:
    values = mix(np.arange(1, 257, dtype=U64) * U64(0x9E3779B97F4A7C15))
    if lower:
        values[65:91] = values[97:123]
    values[SPACE] = 0
    return values


EXACT, LOWER = _byte_values(False), _byte_values(True)
_power = np.ones(256, dtype=U64)
with np.errstate(over="ignore"):
    _power[1:] = np.multiply.accumulate(np.full(255, 0xD6E8FEB86659FD93, dtype=U64))


def powers(n: int) -> np.ndarray:
    global _power
    while len(_power) < n:
        _power = np.concatenate([_power, _power * (_power[-1] * U64(0xD6E8FEB86659FD93))])
    return _power


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts and the offsets of each (one more than texts); null counts as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if pa.types.is_null(texts.type):
        return np.zeros(0, np.uint8), np.zeros(len(texts) + 1, np.int64)
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def _cuts(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, int]]:
    """Pieces of about PIECE_BYTES that end at a separator, at a text's end, or at last with the data."""
    at, end = 0, len(data)
    while at < end:
        to = at + PIECE_BYTES
        if to >= end:
            to = end
        else:
            near = offsets[np.searchsorted(offsets, to, "right") - 1]
            if near > at:
                to = int(near)
            else:
                width = 1024
                while True:
                    found = np.flatnonzero(SPACE[data[to : to + width]])
                    if len(found):
                        to += int(found[0])
                        break
                    after = offsets[np.searchsorted(offsets, to, "right")] if to < end else end
                    if to + width >= after:
                        to = int(after)
                        break
                    width *= 4
        yield at, to
        at = to


def words(data: np.ndarray, offsets: np.ndarray, lower: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts, byte ends and hashes of all words, in order; a word never spans two texts."""
    values, found = LOWER if lower else EXACT, []
    for at, to in _cuts(data, offsets):
        piece = data[at:to]
        inside = ~SPACE[piece]
        edge = np.zeros(len(piece) + 1, dtype=bool)
        borders = offsets[np.searchsorted(offsets, at) : np.searchsorted(offsets, to, "right")] - at
        edge[borders] = True
        edge[0] = edge[-1] = True
        first = inside.copy()
        first[1:] &= ~inside[:-1] | edge[1:-1]
        last = inside.copy()
        last[:-1] &= ~inside[1:] | edge[1:-1]
        starts = np.flatnonzero(first)
        if not len(starts):
            continue
        ends = np.flatnonzero(last) + 1
        gaps = np.diff(np.append(starts, len(piece)))
        place = np.arange(starts[0], len(piece)) - np.repeat(starts, gaps)
        table = powers(int(place.max()) + 1)
        h = np.add.reduceat(values[piece[starts[0] :]] * table[place], starts - starts[0])
        found.append((starts + at, ends + at, mix(h + (ends - starts).astype(U64))))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, U64)
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def word_offsets(starts: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """For each text the index of its first word, and one more at the end."""
    return np.searchsorted(starts, offsets)


def code_points(data: np.ndarray) -> np.ndarray:
    """Running count of code points before each byte (one more entry than bytes)."""
    out = np.zeros(len(data) + 1, np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=out[1:])
    return out


def shingle3(h: np.ndarray) -> np.ndarray:
    """Hashes of the windows of three words; two shorter than ``h``."""
    return mix(h[:-2] * U64(0xA24BAED4963EE407) + mix(h[1:-1] ^ (h[2:] << U64(1)) ^ (h[2:] >> U64(63))) + h[2:])


def shingles(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of the windows of k words; k - 1 shorter than ``h``."""
    out = h[: len(h) - k + 1].copy()
    for i in range(1, k):
        out = mix(out * U64(0xA24BAED4963EE407) + h[i : len(h) - k + 1 + i])
    return out


def sequence_hash(h: np.ndarray) -> int:
    """Hash of a whole short sequence of words, other than that of any window."""
    x = U64(0x2545F4914F6CDD1D) + U64(len(h))
    with np.errstate(over="ignore"):
        for v in h:
            x = mix(np.array([x * U64(0x9E3779B97F4A7C15) ^ v]))[0]
    return int(x)


def trim() -> None:
    """Give freed memory back to the system: an idle worker of an executor keeps what it has, beside the next stage's."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # other systems have no such call
        pass


def per_batch(batches: Iterator[pa.RecordBatch], text: str = "text", rows: int = 512) -> Iterator[pa.RecordBatch]:
    """Slices of at most ``rows`` rows and about 512 KB (one text at least), so that numpy's intermediates stay small."""
    try:
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index(text))
            sizes = np.asarray(pc.fill_null(pc.binary_length(texts.cast(pa.large_string())), 0), np.int64)
            total, at = np.cumsum(sizes), 0
            while at < len(batch):
                limit = (total[at - 1] if at else 0) + (1 << 19)
                to = min(at + rows, max(at + 1, int(np.searchsorted(total, limit, "right"))))
                yield batch.slice(at, to - at)
                at = to
    finally:
        batch = texts = None
        trim()
