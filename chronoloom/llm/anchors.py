"""Hashes of byte strings and content-picked anchors, over numpy arrays.

A window of ``LENGTH`` bytes is represented by the smallest hash of ``UNIT``
bytes within its first ``SPAN`` bytes, its anchor.  Equal windows have equal
anchors at equal offsets, so only windows of equal anchors need comparing, and
all windows of one anchor share the ``CORE`` bytes that follow it.
"""

from __future__ import annotations

import numpy as np

LENGTH, SPAN, UNIT = 200, 168, 16
#: Bytes after an anchor that each of its windows holds.
CORE = LENGTH - (SPAN - UNIT)
#: Bytes handled at once; places within them fit 24 bits.
CHUNK = 1 << 19

_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_Q = np.uint64(0xD6E8FEB86659FD93)
_POWERS: dict[str, np.ndarray] = {}


def running_powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first ``n`` powers of the base of the running sums and of its inverse, at least."""
    if len(_POWERS.get("up", ())) < n:
        size = max(n, CHUNK + 2 * LENGTH)
        for name, base in (("up", _BASE), ("down", _INVERSE)):
            out = np.full(size, base, np.uint64)
            out[0] = 1
            _POWERS[name] = np.multiply.accumulate(out)
    return _POWERS["up"], _POWERS["down"]


_BYTES = np.random.default_rng(20).integers(0, 1 << 64, 256, np.uint64) | np.uint64(1)


class Rolled:
    """Hashes of any substring of a buffer, from running sums modulo 2**64."""

    def __init__(self, data: np.ndarray):
        up, self._down = running_powers(len(data) + 1)
        self._sum = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_BYTES[data] * up[: len(data)], out=self._sum[1:])

    def of(self, start: np.ndarray, length) -> np.ndarray:
        """Hash of ``length`` bytes from each start."""
        x = (self._sum[start + length] - self._sum[start]) * self._down[start]
        x = (x ^ (x >> np.uint64(32))) * _Q
        return x ^ (x >> np.uint64(29))

    def units(self) -> np.ndarray:
        n = len(self._sum) - 1
        x = (self._sum[UNIT:] - self._sum[: n + 1 - UNIT]) * self._down[: n + 1 - UNIT]
        return (x ^ (x >> np.uint64(32))) * _Q


def _sliding_min(v: np.ndarray, width: int) -> np.ndarray:
    size = 1
    while size * 2 <= width:
        v = np.minimum(v[:-size], v[size:])
        size *= 2
    rest = width - size
    return np.minimum(v[: len(v) - rest], v[rest:]) if rest else v


def anchor_runs(data: np.ndarray, ends: np.ndarray) -> tuple[Rolled, np.ndarray, np.ndarray, np.ndarray]:
    """(hashes, anchor, first, last): runs of window starts with one anchor.

    ``data`` holds texts one after another, ``ends`` where each ends; windows lie
    within a text.
    """
    rolled = Rolled(data)
    none = np.zeros(0, np.int64)
    if len(data) < LENGTH:
        return rolled, none, none, none
    valid = np.ones(len(data), bool)
    starts = np.concatenate([[0], ends[:-1]])
    for_end = np.maximum(ends - LENGTH + 1, starts)
    step = np.zeros(len(data) + 1, np.int32)
    np.add.at(step, for_end, 1)
    np.add.at(step, ends, -1)
    valid = np.cumsum(step[:-1]) == 0
    packed = (rolled.units() & ~np.uint64((1 << 24) - 1)) | np.arange(len(data) - UNIT + 1, dtype=np.uint64)
    low = _sliding_min(packed, SPAN - UNIT + 1)
    at = np.flatnonzero(valid[: len(low)])
    if not len(at):
        return rolled, none, none, none
    anchor = (low[at] & np.uint64((1 << 24) - 1)).astype(np.int64)
    new = np.flatnonzero(np.concatenate([[True], anchor[1:] != anchor[:-1]]))
    last = np.concatenate([new[1:] - 1, [len(at) - 1]])
    return rolled, anchor[new], at[new], at[last]
