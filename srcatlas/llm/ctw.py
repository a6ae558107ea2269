"""Context-tree weighting over bytes, as arrays.

A byte is eight binary choices, the highest bit first; a choice's node is the
bits before it. Under each node stands a tree of contexts: the byte before,
the two bytes before, and so on to the depth. Every context keeps how often
its choice was 0 and 1 in training, with the Krichevsky-Trofimov probability
of those choices, and weighs "this context is enough" against "all longer
ones" by half and half. Given the counts, the weights' posterior and the
mixed estimate of a choice follow level by level, without any loop over the
text.

A gram is a context and the byte after it. Grams are sorted with the byte
just before first, so that the grams of one longer context lie together.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

LOG_HALF = np.log(0.5)


def log_gamma(x: np.ndarray) -> np.ndarray:
    """ln Gamma(x) for x > 0: Stirling's series past 8, stepped up to it."""
    x = np.asarray(x, float)
    shift = np.zeros_like(x)
    low = x < 8
    y = np.where(low, x + 8, x)
    for i in range(8):
        shift += np.where(low, np.log(np.maximum(x + i, 1e-300)), 0.0)
    r = 1 / (y * y)
    series = (1 / 12 - r * (1 / 360 - r * (1 / 1260 - r * (1 / 1680 - r / 1188)))) / y
    return (y - 0.5) * np.log(y) - y + 0.5 * np.log(2 * np.pi) + series - shift


def log_kt(n0: np.ndarray, n1: np.ndarray) -> np.ndarray:
    """Log probability of n0 zeros and n1 ones in any fixed order."""
    return log_gamma(n0 + 0.5) + log_gamma(n1 + 0.5) - log_gamma(n0 + n1 + 1.0) - np.log(np.pi)


@dataclass
class Level:
    """One context length: for each of the eight choices, the nodes' counts,
    and for each gram of this length its node."""

    grams: np.ndarray                   # distinct (context, byte) codes, sorted
    node_of: list[np.ndarray]           # of each gram, by choice
    n0: list[np.ndarray]
    n1: list[np.ndarray]
    log_weighted: list[np.ndarray]      # set by weigh()
    enough: list[np.ndarray]            # posterior that this context is enough


def level_of(grams: np.ndarray, counts: np.ndarray) -> Level:
    """Counts of a level from sorted codes: the low byte is the coded one."""
    byte = grams & np.uint64(0xFF)
    out = Level(grams, [], [], [], [], [])
    for k in range(8):
        prefix = grams >> np.uint64(8 - k)              # context and the k bits before
        first = np.flatnonzero(np.concatenate([[True], prefix[1:] != prefix[:-1]]))
        bit = ((byte >> np.uint64(7 - k)) & np.uint64(1)).astype(float)
        ones = np.add.reduceat(counts * bit, first)
        out.node_of.append(np.cumsum(np.concatenate([[0], (prefix[1:] != prefix[:-1]).astype(np.int64)])))
        out.n1.append(ones)
        out.n0.append(np.add.reduceat(counts, first) - ones)
    return out


def shorten(grams: np.ndarray, counts: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Codes of contexts of ``length`` bytes with the oldest byte left out,
    their counts, and for each longer gram the number of its shorter one.

    The oldest byte stands just above the coded one."""
    context = grams >> np.uint64(16)
    short = (context << np.uint64(8)) | (grams & np.uint64(0xFF))
    codes, back = np.unique(short, return_inverse=True)
    return codes, np.bincount(back, counts, len(codes)), back


class Subtree:
    """The contexts of ``low`` to ``high`` bytes above given grams."""

    def __init__(self, grams: np.ndarray, counts: np.ndarray, low: int, high: int):
        self.levels: dict[int, Level] = {high: level_of(grams, counts.astype(float))}
        self.up: dict[int, np.ndarray] = {}             # gram of d+1 -> gram of d
        codes, n = grams, counts.astype(float)
        for d in range(high - 1, low - 1, -1):
            codes, n, self.up[d] = shorten(codes, n, d + 1)
            self.levels[d] = level_of(codes, n)
        self.low, self.high = low, high
        for d in range(high, low - 1, -1):
            self._weigh(d)

    def _weigh(self, d: int) -> None:
        level = self.levels[d]
        for k in range(8):
            kt = log_kt(level.n0[k], level.n1[k])
            if d == self.high:
                level.log_weighted.append(kt)
                level.enough.append(np.ones(len(kt)))
                continue
            longer = self.levels[d + 1]
            # the node of this level above each node of the next one
            above = np.zeros(len(longer.n0[k]), np.int64)
            above[longer.node_of[k]] = level.node_of[k][self.up[d]]
            split = np.bincount(above, longer.log_weighted[k], len(kt))
            both = LOG_HALF + np.logaddexp(kt, split)
            level.log_weighted.append(both)
            level.enough.append(np.exp(LOG_HALF + kt - both))

    def estimate(self) -> np.ndarray:
        """grams x 8: probability of each choice of the longest grams' bytes,
        mixed over the subtree's levels."""
        deep = self.levels[self.high]
        byte = deep.grams & np.uint64(0xFF)
        out = np.zeros((len(deep.grams), 8))
        at = np.arange(len(deep.grams))
        places = {self.high: at}
        for d in range(self.high - 1, self.low - 1, -1):
            at = self.up[d][at]
            places[d] = at
        for k in range(8):
            bit = ((byte >> np.uint64(7 - k)) & np.uint64(1)).astype(bool)
            p = np.full(len(byte), 0.5)
            for d in range(self.high, self.low - 1, -1):
                level = self.levels[d]
                node = level.node_of[k][places[d]]
                n0, n1 = level.n0[k][node], level.n1[k][node]
                kt = (np.where(bit, n1, n0) + 0.5) / (n0 + n1 + 1.0)
                w = level.enough[k][node]
                p = w * kt + (1 - w) * p
            out[:, k] = p
        return out
