"""Words of many texts as 64-bit hashes, computed batch-wise with NumPy inside tasks.

A word is a run of anything but blanks (space, tab, line feed, vertical tab, form feed,
carriage return), with A-Z in lower case. Hashes mix a random 64-bit value per byte along
the word's polynomial, so two of 10^9 words agree with a chance below 0.1.
"""

from __future__ import annotations

import numpy as np

_rng = np.random.default_rng(20240501)
_BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BYTE[65:91] = _BYTE[97:123]
_BLANK = np.zeros(256, dtype=bool)
_BLANK[[32, 9, 10, 11, 12, 13]] = True
_NO_WORD = _BLANK.copy()  # also ASCII punctuation
_NO_WORD[[c for c in range(128) if not chr(c).isalnum()]] = True
_R = np.uint64(0x9E3779B97F4A7C15)
_R_INVERSE = np.uint64(pow(int(_R), -1, 1 << 64))
_powers = [np.ones(1, dtype=np.uint64), np.ones(1, dtype=np.uint64)]


def _power_tables(n: int) -> list[np.ndarray]:
    if len(_powers[0]) < n:
        n = max(n, 1 << 20)
        for k, base in enumerate((_R, _R_INVERSE)):
            table = np.full(n, base)
            table[0] = 1
            _powers[k] = np.multiply.accumulate(table)
    return _powers


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads their bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def hashed(texts: list, plain: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words in order, and the place of each text's first word (one more at the end).

    ``plain`` takes runs of letters and digits for words.
    """
    parts = [t.encode("utf-8", "surrogatepass") if t else b"" for t in texts]
    data = np.frombuffer(b"\n".join(parts) + b"\n", dtype=np.uint8)
    text_end = np.cumsum(np.fromiter((len(p) + 1 for p in parts), dtype=np.int64, count=len(parts)))
    blank = (_NO_WORD if plain else _BLANK)[data]
    first = ~blank
    first[1:] &= blank[:-1]
    starts = np.flatnonzero(first)
    last = blank.copy()
    last[0] = False
    last[1:] &= ~blank[:-1]
    ends = np.flatnonzero(last)
    power, inverse = _power_tables(len(data) + 1)
    sums = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(_BYTE[data] * power[: len(data)], out=sums[1:])
    words = mix((sums[ends] - sums[starts]) * inverse[starts])
    places = np.zeros(len(parts) + 1, dtype=np.int64)
    places[1:] = np.searchsorted(starts, text_end)
    return words, places


def shingles(words: np.ndarray, places: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the ``k`` words from each place on; and which of them lie inside one text."""
    n = len(words)
    out = np.zeros(n, dtype=np.uint64)
    for j in range(min(k, n)):
        out[: n - j] += mix(words[j:] + np.uint64(0x632BE59BD9B4E019 * (j + 1) % (1 << 64)))
    inside = np.ones(n, dtype=bool)
    ends = places[1:]
    for j in range(1, k):
        # The last k - 1 words of each text begin no shingle.
        at = ends - j
        inside[at[at >= places[:-1]]] = False
    return mix(out), inside


def stretches(values: np.ndarray, at: np.ndarray, k: int) -> np.ndarray:
    """Hashes of the ``k`` values from each place ``at`` on, by differences of running sums: for long stretches."""
    power, inverse = _power_tables(len(values) + 1)
    sums = np.zeros(len(values) + 1, dtype=np.uint64)
    np.cumsum(mix(values) * power[: len(values)], out=sums[1:])
    return mix((sums[at + k] - sums[at]) * inverse[at])


def short_sequence(words: np.ndarray) -> np.uint64:
    """One hash for a whole sequence shorter than a shingle; never that of a shingle of other length by rule."""
    out = np.uint64(len(words))
    for w in words:
        out = mix(np.array([(out * _R) ^ w]))[0]
    return out


def sets(texts: list, k: int) -> list[np.ndarray]:
    """Sorted distinct shingles of each text; shorter texts give their whole sequence as one."""
    words, places = hashed(texts)
    grams, _ = shingles(words, places, k)
    out = []
    for a, b in zip(places[:-1], places[1:], strict=True):
        if b - a >= k:
            out.append(np.unique(grams[a : b - k + 1]))
        elif b > a:
            with np.errstate(over="ignore"):
                out.append(np.array([short_sequence(words[a:b])], dtype=np.uint64))
        else:
            out.append(np.zeros(0, dtype=np.uint64))
    return out
