"""Numpy kernels over the UTF-8 bytes of many texts at once: word boundaries and
64-bit hashes of words and of runs of words.

A word's hash takes its bytes eight at a time through a multiplication and a shuffle of all
bits, so no two words are alike by their form, however long. A hash of a run of words is a
polynomial in an odd base modulo 2**64 over word hashes, taken from prefix sums, so that any
run costs two lookups. ``lane`` selects independent constants, and two lanes together
identify a run by 128 bits. Such polynomials are weak only for runs of thousands of words
that alternate two words in a certain order; runs here are of at most some 150 words."""

from __future__ import annotations

import numpy as np

U = np.uint64
#: ASCII white space x20 and x09-x0D.
SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
WORD = ~SPACE
#: ASCII letters, digits and everything beyond ASCII.
ALNUM = np.array([b >= 128 or chr(b).isalnum() for b in range(256)])
LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)
#: Masks of the first 0 to 8 bytes.
KEEP = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)
BASES = (U(0x9E3779B97F4A7C15), U(0xD1B54A32D192ED03), U(0xAEF17502108EF2D9), U(0xF1357AEA2E62A9C5))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits that spreads every input bit."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i < n at least."""
    if base not in _powers or len(_powers[base][0]) < n:
        size = max(1 << 16, 1 << int(n - 1).bit_length())
        b = int(BASES[base])
        both = []
        for x in (b, pow(b, -1, 1 << 64)):
            p = np.full(size, U(x))
            p[0] = U(1)
            both.append(np.multiply.accumulate(p))
        _powers[base] = (both[0], both[1])
    return _powers[base]


def prefix(values: np.ndarray, base: int) -> np.ndarray:
    out = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * powers(base, len(values))[0][: len(values)], out=out[1:])
    return out


def runs(sums: np.ndarray, start: np.ndarray, end: np.ndarray, base: int) -> np.ndarray:
    """Hashes of the runs [start, end) over what ``sums`` was made from; of equal length to be compared."""
    return mix((sums[end] - sums[start]) * powers(base, len(sums))[1][start])


def words(data: np.ndarray, at: np.ndarray, is_word: np.ndarray = WORD) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of every word, and for each text the index of its first word
    (one more entry than texts). Words end where their text ends."""
    n = len(data)
    inside = np.zeros(n + 2, bool)
    inside[1:-1] = is_word[data]
    starts, ends = inside[1:] & ~inside[:-1], inside[:-1] & ~inside[1:]  # at byte i; of the word before byte i
    cuts = at[1:-1]
    cuts = cuts[(cuts > 0) & (cuts < n)]
    both = cuts[inside[cuts + 1] & inside[cuts]]
    starts[both] = True
    ends[both] = True
    start, end = np.flatnonzero(starts[:n]), np.flatnonzero(ends)
    return start, end, np.searchsorted(start, at, side="left")


def word_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, lane: int = 0, lower: bool = False) -> np.ndarray:
    """A hash of each word; ``lower`` reads A-Z as a-z."""
    size = end - start
    out = mix(size.astype(np.uint64) + BASES[lane])
    if not len(size):
        return out
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[:-8] = LOWER[data] if lower else data
    eight = np.ndarray((len(data) + 1,), "<u8", padded.data, strides=(1,))  # the eight bytes from every place on
    left, at, open_ = size, start, np.arange(len(size))
    while len(open_):
        chunk = eight[at] & KEEP[np.minimum(left, 8)]
        out[open_] = mix((out[open_] ^ chunk) * BASES[lane + 1])
        more = np.flatnonzero(left > 8)
        open_, at, left = open_[more], at[more] + 8, left[more] - 8
    return out


def gram_hashes(hashes: np.ndarray, k: int, lane: int = 0) -> np.ndarray:
    """Hash of the k values from each position on, whether or not they are of one text."""
    if len(hashes) < k:
        return np.zeros(0, np.uint64)
    i = np.arange(len(hashes) - k + 1)
    return runs(prefix(hashes, lane + 2), i, i + k, lane + 2)


def doc_of(first: np.ndarray) -> np.ndarray:
    """The text of each word, from the index of each text's first word."""
    return np.repeat(np.arange(len(first) - 1), np.diff(first))
