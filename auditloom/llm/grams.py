"""Hashed word n-gram sets of texts, with numpy over whole blocks of texts."""

import numpy as np

# Fixed multipliers of the 64-bit mixing steps.
_GOLDEN = np.uint64(0x9E3779B97F4A7C15)
_M1 = np.uint64(0xBF58476D1CE4E5B9)
_M2 = np.uint64(0x94D049BB133111EB)
_BASE = 0xD1342543DE82EF95
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


_BYTES = mix(np.arange(1, 257, dtype=np.uint64) * _GOLDEN)
_BYTES[65:91] = _BYTES[97:123]
_IS_SPACE = np.zeros(256, dtype=bool)
_IS_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


class _Powers:
    """Powers of the hash base and of its inverse, as long as the longest block so far."""

    up = np.ones(1, dtype=np.uint64)
    down = np.ones(1, dtype=np.uint64)

    @classmethod
    def upto(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls.up) < n:
            for name, base in (("up", _BASE), ("down", _BASE_INVERSE)):
                factors = np.full(n, base, dtype=np.uint64)
                factors[0] = 1
                setattr(cls, name, np.cumprod(factors))
        return cls.up[:n], cls.down[:n]


def runs(solid: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, stop, text number) of the runs of solid bytes; no run goes over the end of its text."""
    first = solid.copy()
    first[1:] &= ~solid[:-1]
    bounds = offsets[1:-1]
    bounds = bounds[bounds < len(solid)]
    first[bounds] = solid[bounds]
    last = solid.copy()
    last[:-1] &= ~solid[1:]
    ends = bounds[bounds > 0] - 1
    last[ends] = solid[ends]
    starts, stops = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, stops, np.searchsorted(offsets, starts, side="right") - 1


class RunHashes:
    """Hashes of any runs of the same bytes, from sums over all of them; A-Z count as a-z."""

    def __init__(self, data: np.ndarray):
        up, self.down = _Powers.upto(len(data) + 1)
        self.sums = np.zeros(len(data) + 1, dtype=np.uint64)
        np.cumsum(_BYTES[data] * up[:-1], out=self.sums[1:])

    def of(self, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
        return mix((self.sums[stops] - self.sums[starts]) * self.down[starts])


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash, text number) of the words of UTF-8 texts that lie end to end in ``data``.

    A word is a run of signs other than ASCII white space; A-Z count as a-z.
    """
    starts, stops, text = runs(~_IS_SPACE[data], offsets)
    return RunHashes(data).of(starts, stops), text


def gram_sets(data: np.ndarray, offsets: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, offsets) of the distinct n-grams of each text, in order of their hashes.

    A text of fewer words, but not none, has its whole sequence as its one n-gram.
    """
    words, text = word_hashes(data, offsets)
    n_texts = len(offsets) - 1
    grams, owner = np.empty(0, dtype=np.uint64), np.empty(0, dtype=np.int64)
    if len(words) >= size:
        whole = text[size - 1:] == text[:len(text) - size + 1]
        chained = np.full(int(whole.sum()), size, dtype=np.uint64)
        at = np.flatnonzero(whole)
        for i in range(size):
            chained = mix(chained * _GOLDEN + words[at + i])
        grams, owner = chained, text[at]
    counts = np.bincount(text, minlength=n_texts)
    short = np.flatnonzero((counts > 0) & (counts < size))
    if len(short):
        firsts = np.searchsorted(text, short)
        extra = np.empty(len(short), dtype=np.uint64)
        for j, (first, text_no) in enumerate(zip(firsts, short)):
            chained = np.array([counts[text_no]], dtype=np.uint64)
            for word in words[first:first + counts[text_no]]:
                chained = mix(chained * _GOLDEN + word)
            extra[j] = chained[0]
        grams, owner = np.concatenate([grams, extra]), np.concatenate([owner, short])
    order = np.lexsort((grams, owner))
    grams, owner = grams[order], owner[order]
    fresh = np.ones(len(grams), dtype=bool)
    fresh[1:] = (grams[1:] != grams[:-1]) | (owner[1:] != owner[:-1])
    grams, owner = grams[fresh], owner[fresh]
    return grams, np.searchsorted(owner, np.arange(n_texts + 1))


def sum_by(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sums of neighbouring values, modulo 2^64; an empty range gives 0."""
    sums = np.zeros(len(values) + 1, dtype=np.uint64)
    np.cumsum(values, out=sums[1:])
    return sums[offsets[1:]] - sums[offsets[:-1]]
