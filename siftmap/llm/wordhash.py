"""64-bit hashes of the words of an Arrow text column, many texts at a time.

A column's bytes are walked once with numpy: a table says which bytes belong to words and folds
ASCII case, a polynomial hash comes from one running sum. Work goes in chunks of about half a megabyte
of whole texts, so memory stays bounded however large an Arrow batch is (a longer single text is one chunk).
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 1 << 19

_BASE = 0x9E3779B97F4A7C15 | 1
_MASK = (1 << 64) - 1


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection on 64 bits which spreads every input bit."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


class Alphabet:
    """Which bytes of UTF-8 text belong to words, with A-Z folded to a-z unless case is kept."""

    def __init__(self, separators: bytes | None = None, members: bytes | None = None, fold_case: bool = True):
        inside = np.zeros(256, bool)
        if separators is not None:
            inside[:] = True
            inside[list(separators)] = False
        else:
            inside[list(members or b"")] = True
            inside[128:] = True
        fold = np.arange(256)
        if fold_case:
            fold[65:91] += 32
        self.inside = inside
        self.value = mix((fold.astype(np.uint64) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93))


#: Words are runs of anything but ASCII white space.
SPACED = Alphabet(separators=b"\x20\x09\x0a\x0b\x0c\x0d")
#: Words are runs of ASCII letters and digits and of anything outside ASCII.
ALNUM = Alphabet(members=b"0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz")

#: As SPACED, with case kept.
CASED = Alphabet(separators=b"\x20\x09\x0a\x0b\x0c\x0d", fold_case=False)

_powers: dict[str, np.ndarray] = {}


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if _powers.get("up") is None or len(_powers["up"]) < n + 1:
        size = max(n + 1, CHUNK_BYTES + 1)
        for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            steps = np.full(size, base & _MASK, np.uint64)
            steps[0] = 1
            _powers[name] = np.multiply.accumulate(steps)
    return _powers["up"], _powers["down"]


class Words(NamedTuple):
    hash: np.ndarray  # uint64, one per word
    row: np.ndarray  # text of the word, counted within the chunk
    start: np.ndarray  # first byte within the chunk's data
    end: np.ndarray  # byte behind the last one
    bounds: np.ndarray  # first word of each text, and the number of words


class Chunk(NamedTuple):
    first: int  # row of the first text within the column
    data: np.ndarray  # bytes
    offsets: np.ndarray  # first byte of each text, and the number of bytes


def chunks(column: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[Chunk]:
    """Whole texts of a string column; a null text counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if len(column) == 0:
        return
    if column.null_count:
        column = column.fill_null("")
    kind = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    _, off, data = column.buffers()
    offsets = np.frombuffer(off, kind, len(column) + 1 + column.offset)[column.offset:].astype(np.int64)
    buffer = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    first = 0
    while first < len(column):
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + limit, "right")) - 1)
        last = min(last, len(column))
        yield Chunk(first, buffer[offsets[first]:offsets[last]], offsets[first:last + 1] - offsets[first])
        first = last


def words(chunk: Chunk, alphabet: Alphabet, breaks: np.ndarray | None = None) -> Words:
    """The words of a chunk's texts; `breaks` marks bytes at which a new word starts even if the byte before belongs to one."""
    data, offsets = chunk.data, chunk.offsets
    n, texts = len(data), len(offsets) - 1
    if n == 0:
        none = np.zeros(0, np.int64)
        return Words(np.zeros(0, np.uint64), none, none, none, np.zeros(texts + 1, np.int64))
    inside = alphabet.inside[data]
    before = np.empty(n, bool)
    before[0] = False
    before[1:] = inside[:-1]
    heads = offsets[:-1]
    before[heads[heads < n]] = False
    if breaks is not None:
        before &= ~breaks
    start = np.flatnonzero(inside & ~before)
    after = np.empty(n, bool)
    after[-1] = False
    after[:-1] = inside[1:]
    tails = offsets[1:] - 1
    after[tails[tails >= 0]] = False
    if breaks is not None:
        after[:-1] &= ~breaks[1:]
    end = np.flatnonzero(inside & ~after) + 1
    up, down = _power(n)
    total = np.empty(n + 1, np.uint64)
    total[0] = 0
    np.cumsum(alphabet.value[data] * up[:n], out=total[1:])
    hashed = mix((total[end] - total[start]) * down[start] + (end - start).astype(np.uint64))
    bounds = np.searchsorted(start, offsets)
    row = np.repeat(np.arange(texts), np.diff(bounds))
    return Words(hashed, row, start, end, bounds)


def heads(chunk: Chunk, w: Words, alphabet: Alphabet, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of the first `size` bytes of every longer word, and the word's position in `w`."""
    at = np.flatnonzero(w.end - w.start > size)
    total = np.zeros(len(at), np.uint64)
    for k in range(size):
        total += alphabet.value[chunk.data[w.start[at] + k]] * np.uint64(pow(_BASE, k + 1, 1 << 64))
    return mix(total ^ np.uint64(0xB5297A4D00000000 + size)), at


def shingles(w: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash and text of every run of `size` words within a text, and its first word's position in `w`."""
    n = len(w.hash) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    total = np.zeros(n, np.uint64)
    for k in range(size):
        total += mix(w.hash[k:k + n] + np.uint64(k + 1)) * np.uint64((_BASE * (2 * k + 3)) & _MASK)
    at = np.flatnonzero(w.row[:n] == w.row[size - 1:])
    return mix(total[at]), at


def whole(w: Words) -> np.ndarray:
    """One hash per text of all its words in order (0 for none)."""
    out = np.zeros(len(w.bounds) - 1, np.uint64)
    if len(w.hash):
        place = (np.arange(len(w.hash)) - w.bounds[w.row]).astype(np.uint64)
        total = np.zeros(len(w.hash) + 1, np.uint64)
        np.cumsum(mix(w.hash + mix(place + np.uint64(77))), out=total[1:])
        out = mix(total[w.bounds[1:]] - total[w.bounds[:-1]])
    return out
