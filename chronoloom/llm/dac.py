"""Directly addressable codes: integers in chunk levels, read at any place without decoding what stands before.

Each integer is split into chunks, the lowest bits first.  Level 1 holds the first
chunk of every integer and a bitmap of those that go on; level 2 the second chunk of
those, and so on.  The place of an integer in the next level is the number of set
bits before it, which a directory of counts (one for each ``BLOCK`` bits) and the
bits of one block give.  Chunk widths are those with the fewest bits in all for the
numbers of integers of each bit length (Brisaboa, Ladra and Navarro, 2013).

A file, all numbers little-endian, one byte each where nothing else is said:

====================  =========================================================
``DAC1``              four bytes
partition, number     the file's place in the whole: two unsigned 32-bit numbers
documents, tokens     two unsigned 64-bit numbers
levels                unsigned 32-bit number
for each level        width (unsigned 32-bit), integers (unsigned 64-bit), and the
                      offsets of its chunks, bitmap and directory (unsigned 64-bit)
offset of documents   unsigned 64-bit number
levels                chunks, packed bits, lowest first; bitmap (none for the last
                      level); directory of unsigned 64-bit counts
documents             ids (64-bit), whether null (8-bit), ends in tokens (unsigned
                      64-bit)
====================  =========================================================
"""

from __future__ import annotations

import struct
from collections.abc import Callable

import numpy as np

MAGIC = b"DAC1"
#: Bits of a bitmap for each count of its directory.
BLOCK = 512
#: Integers that are packed or unpacked at a time.
STEP = 1 << 18
_HEAD, _LEVEL = struct.Struct("<4sIIQQIQ"), struct.Struct("<IQQQQ")


def best_widths(values: np.ndarray) -> list[int]:
    """Widths of the levels with the fewest bits, bitmaps included."""
    # frexp gives the number of bits of a positive integer
    lengths = sum((np.bincount(np.frexp(values[at : at + STEP])[1], minlength=33) for at in range(0, len(values), STEP)), np.zeros(33, np.int64))
    longest = max(int(np.flatnonzero(lengths).max(initial=0)), 1)
    beyond = lengths[::-1].cumsum()[::-1][1:].tolist()  # [k]: integers that need more than k bits
    beyond = [len(values), *beyond[1:]]
    cost, width = [0] * (longest + 1), [0] * (longest + 1)
    for at in range(longest - 1, -1, -1):
        cost[at], width[at] = min((beyond[at] * (w + (at + w < longest)) + cost[at + w], w) for w in range(1, longest - at + 1))
    found, at = [], 0
    while at < longest:
        found.append(width[at])
        at += width[at]
    return found


def _places(width: int) -> list[tuple[int, int, int]]:
    """(value, word, shift) of eight values in 64-bit words; a negative shift takes the bits that the word before has no room for."""
    found = []
    for j in range(8):
        word, shift = divmod(j * width, 64)
        found.append((j, word, shift))
        if shift + width > 64:
            found.append((j, word + 1, shift - 64))
    return found


def pack(values: np.ndarray, width: int) -> bytes:
    """The lowest ``width`` bits of each value, one after the other: eight values make ``width`` bytes."""
    parts, mask = [], np.uint64((1 << width) - 1)
    for at in range(0, len(values), STEP):  # STEP is a multiple of 8
        some = values[at : at + STEP].astype(np.uint64) & mask
        rows = np.concatenate([some, np.zeros(-len(some) % 8, np.uint64)]).reshape(-1, 8).T
        words = np.zeros(((width + 7) // 8, rows.shape[1]), np.uint64)
        for j, word, shift in _places(width):
            words[word] |= rows[j] << np.uint64(shift) if shift >= 0 else rows[j] >> np.uint64(-shift)
        raw = np.ascontiguousarray(words.T).astype("<u8", copy=False).view(np.uint8)[:, :width]
        parts.append(raw.tobytes()[: (len(some) * width + 7) // 8])
    return b"".join(parts)


def unpack(raw: memoryview | bytes, width: int, first: int, n: int) -> np.ndarray:
    """Values ``first`` to ``first + n`` of packed ones; ``raw`` begins at the byte of the first of its eight."""
    out, data, skip, mask = np.empty(n, np.uint32), np.frombuffer(raw, np.uint8), first % 8, np.uint64((1 << width) - 1)
    for at in range(0, n + skip, STEP):
        k = min(STEP, n + skip - at)
        groups = -(-k // 8)
        wide = np.zeros((groups, 8 * ((width + 7) // 8)), np.uint8)
        some = data[at // 8 * width : (at // 8 + groups) * width]
        if len(some) < groups * width:  # the last eight are not all there
            some = np.concatenate([some, np.zeros(groups * width - len(some), np.uint8)])
        wide[:, :width] = some.reshape(groups, width)
        words = np.ascontiguousarray(wide.view("<u8").astype(np.uint64, copy=False).T)
        found = np.zeros((8, groups), np.uint64)
        for j, word, shift in _places(width):
            found[j] |= words[word] >> np.uint64(shift) if shift >= 0 else words[word] << np.uint64(-shift)
        flat = (found & mask).T.reshape(-1)[:k].astype(np.uint32)
        lo = skip if not at else 0
        out[at + lo - skip : at + k - skip] = flat[lo:]
    return out


def encode(values: np.ndarray, ids: list, ends: np.ndarray, partition: int = 0, number: int = 0) -> bytes:
    """A file of ``values`` (unsigned 32-bit), which are documents ``ids`` that end at ``ends``."""
    values = np.ascontiguousarray(values, np.uint32)
    levels, rest, widths = [], values, best_widths(values)
    for k, w in enumerate(widths):
        chunks, bitmap, ranks = pack(rest, w), b"", b""
        if k + 1 < len(widths):
            on = (rest >> np.uint32(w)) != 0
            bitmap = np.packbits(on, bitorder="little").tobytes()
            before = np.add.reduceat(on, np.arange(0, max(len(on), 1), BLOCK), dtype=np.int64) if len(on) else np.zeros(0, np.int64)
            ranks = np.concatenate([[0], np.cumsum(before)]).astype("<u8").tobytes()
            levels.append((w, len(rest), chunks, bitmap, ranks))
            rest = rest[on] >> np.uint32(w)
        else:
            levels.append((w, len(rest), chunks, bitmap, ranks))
    at, table, body = _HEAD.size + len(levels) * _LEVEL.size, [], []
    for w, n, *parts in levels:
        offsets = []
        for p in parts:
            offsets.append(at)
            body.append(p)
            at += len(p)
        table.append(_LEVEL.pack(w, n, *offsets))
    absent = np.array([i is None for i in ids], np.uint8)
    documents = np.array([0 if i is None else i for i in ids], "<i8").tobytes() + absent.tobytes() + np.asarray(ends, "<u8").tobytes()
    return b"".join([_HEAD.pack(MAGIC, partition, number, len(ids), len(values), len(levels), at), *table, *body, documents])


class DacFile:
    """Reads a file through ``read(offset, length)``, so that a token costs a few small reads wherever the file lies."""

    def __init__(self, read: Callable[[int, int], bytes] | bytes):
        self._read = (lambda at, n, raw=memoryview(read): raw[at : at + n]) if isinstance(read, (bytes, memoryview, bytearray)) else read
        magic, self.partition, self.number, self.n_documents, self.n_tokens, n_levels, self._documents = _HEAD.unpack(self._read(0, _HEAD.size))
        if magic != MAGIC:
            raise ValueError("not a file of directly addressable codes")
        raw = self._read(_HEAD.size, n_levels * _LEVEL.size)
        self.levels = [_LEVEL.unpack_from(raw, k * _LEVEL.size) for k in range(n_levels)]

    def _chunks(self, k: int, first: int, n: int) -> np.ndarray:
        w, _, at, _, _ = self.levels[k]
        lo, hi = first // 8 * w, ((first + n) * w + 7) // 8
        return unpack(self._read(at + lo, hi - lo), w, first, n)

    def _bits(self, k: int, first: int, n: int) -> np.ndarray:
        lo, hi = first // 8, (first + n + 7) // 8
        bits = np.unpackbits(np.frombuffer(self._read(self.levels[k][3] + lo, hi - lo), np.uint8), bitorder="little")
        return bits[first % 8 :][:n].astype(bool)

    def _rank(self, k: int, i: int) -> int:
        """Set bits of level ``k`` before place ``i``: one count of the directory and the bits of one block."""
        block = i // BLOCK
        (count,) = struct.unpack("<Q", self._read(self.levels[k][4] + 8 * block, 8))
        return count + (int(self._bits(k, block * BLOCK, i % BLOCK).sum()) if i % BLOCK else 0)

    def token(self, i: int) -> int:
        """The token at place ``i``."""
        if not 0 <= i < self.n_tokens:
            raise IndexError(i)
        value = shift = 0
        for k, (w, *_) in enumerate(self.levels):
            value |= int(self._chunks(k, i, 1)[0]) << shift
            if k + 1 == len(self.levels) or not self._bits(k, i, 1)[0]:
                return value
            i, shift = self._rank(k, i), shift + w
        return value

    def tokens(self, first: int, last: int) -> np.ndarray:
        """Tokens from place ``first`` to before ``last``: one range of each level."""
        n = last - first
        if not n:
            return np.zeros(0, np.uint32)
        out, places, shift = np.zeros(n, np.uint32), None, 0
        for k, (w, *_) in enumerate(self.levels):
            chunk = self._chunks(k, first, n) << np.uint32(shift)
            if places is None:
                out |= chunk
            else:
                out[places] |= chunk
            if k + 1 == len(self.levels):
                break
            on = self._bits(k, first, n)
            places = np.flatnonzero(on) if places is None else places[on]
            first, n, shift = self._rank(k, first), int(on.sum()), shift + w
            if not n:
                break
        return out

    def documents(self) -> tuple[list, np.ndarray]:
        """(ids, ends) of the file's documents."""
        n = self.n_documents
        raw = self._read(self._documents, 17 * n)
        ids, absent = np.frombuffer(raw, "<i8", n).tolist(), np.frombuffer(raw, np.uint8, n, 8 * n)
        return [None if a else i for i, a in zip(ids, absent)], np.frombuffer(raw, "<u8", n, 9 * n).astype(np.int64)
