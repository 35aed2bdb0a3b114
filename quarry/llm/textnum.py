"""Words of Arrow strings as numpy arrays: places, 64-bit hashes and hashes of word runs."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

_U = np.uint64
_P = _U(0x9E3779B97F4A7C15 | 1)
_CHUNK = 1 << 20
_SPACES = np.zeros(256, bool)
_SPACES[[32, *range(9, 14)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers whose result bits depend on all bits of x."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U(27))
    x = x * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


_powers = np.ones(0, _U)
_inverses = np.ones(0, _U)


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _powers, _inverses
    if len(_powers) < n:
        with np.errstate(over="ignore"):
            inverse = _U(pow(int(_P), -1, 1 << 64))
            _powers = np.cumprod(np.concatenate([np.ones(1, _U), np.full(n - 1, _P)]))
            _inverses = np.cumprod(np.concatenate([np.ones(1, _U), np.full(n - 1, inverse)]))
    return _powers, _inverses


class Words:
    """The words of a string array, split at ASCII white space; nulls have none.

    starts, ends: byte places in data; first: for each string the number of its first
    word, with one more entry at the end.
    """

    def __init__(self, strings: pa.Array, lower: bool = False):
        strings = strings.cast(pa.large_string()).fill_null("")
        n = len(strings)
        _, offsets, data = strings.buffers()
        offsets = np.frombuffer(offsets, np.int64)[strings.offset : strings.offset + n + 1] if n else np.zeros(1, np.int64)
        low, high = int(offsets[0]), int(offsets[-1])
        data = np.frombuffer(data, np.uint8)[low:high] if data is not None and high > low else np.zeros(0, np.uint8)
        offsets = offsets - low
        self.data = _LOWER[data] if lower else data
        word = ~_SPACES[data]
        begin, end = word.copy(), word.copy()
        if len(data):
            begin[1:] &= ~word[:-1]
            end[:-1] &= ~word[1:]
            cut = offsets[(offsets > 0) & (offsets < high - low)]
            begin[cut] |= word[cut]
            end[cut - 1] |= word[cut - 1]
        self.starts = np.flatnonzero(begin)
        self.ends = np.flatnonzero(end) + 1
        self.offsets = offsets
        self.first = np.searchsorted(self.starts, offsets)

    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def text(self, i: int) -> str:
        return self.data[self.starts[i] : self.ends[i]].tobytes().decode()

    def hashes(self, seed: int = 0) -> np.ndarray:
        """A 64-bit hash of each word's bytes."""
        out = np.empty(len(self.starts), _U)
        i = 0
        with np.errstate(over="ignore"):
            while i < len(out):
                low = self.starts[i]
                k = max(i + 1, int(np.searchsorted(self.ends, low + _CHUNK, "right")))
                high = self.ends[k - 1]
                powers, inverses = _tables(max(_CHUNK, int(high - low)) + 1)
                sums = np.zeros(high - low + 1, _U)
                np.cumsum((self.data[low:high].astype(_U) + _U(1)) * powers[: high - low], out=sums[1:])
                s, e = self.starts[i:k] - low, self.ends[i:k] - low
                out[i:k] = mix((sums[e] - sums[s]) * inverses[s] + (e - s).astype(_U) * _P + _U(seed))
                i = k
        return out


def runs(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of each k consecutive entries; len(h) - k + 1 of them."""
    if len(h) < k:
        return np.zeros(0, _U)
    with np.errstate(over="ignore"):
        out, have, step, power = None, 0, h, 1
        rest = k
        while rest:  # binary expansion of k: runs of 1, 2, 4, ... are put together
            if rest & 1:
                if out is None:
                    out, have = step, power
                else:
                    n = len(h) - have - power + 1
                    out = mix(out[:n] * _U(0xD6E8FEB86659FD93) + step[have : have + n])
                    have += power
            rest >>= 1
            if rest:
                n = len(step) - power
                step = mix(step[:n] * _U(0xA0761D6478BD642F) + step[power : power + n] + _U(power))
                power *= 2
        return out[: len(h) - k + 1]


def place(h: np.ndarray) -> np.ndarray:
    """As signed numbers, for Spark's long."""
    return h.view(np.int64)
