"""Words of many texts at once: where they lie, and 64-bit hashes of words and of runs of words, by numpy over UTF-8 bytes.

A word is a run of bytes other than 0x20 and 0x09-0x0D; in UTF-8 those bytes never lie inside a character.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: Odd, so it has an inverse modulo 2**64: a hash of a byte range comes from two prefix sums.
BASE = 0x9E3779B97F4A7C15
BACK = pow(BASE, -1, 1 << 64)
#: A-Z to a-z, bytes of other characters stay.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


#: One array of powers a base, as long as any step so far needed, and of KEPT_POWERS at most.
_POWERS: dict[int, np.ndarray] = {}
KEPT_POWERS = 1 << 20
#: Bytes whose sums are made at once, so that they stay in the cache.
CACHED = 1 << 14


def powers(n: int, base: int) -> np.ndarray:
    """base ** 0 .. n - 1 modulo 2**64."""
    known = _POWERS.get(base)
    if known is None or len(known) < n:
        known = np.full(1 << max(16, int(n - 1).bit_length()), base, np.uint64)
        known[0] = 1
        np.multiply.accumulate(known, out=known)
        if len(known) <= KEPT_POWERS:
            _POWERS[base] = known
    return known[:n]


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A bijective scrambling of 64-bit numbers, another one for each seed."""
    x = x + np.uint64((seed * 0xD1342543DE82EF95 + 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def uniform(x: np.ndarray) -> np.ndarray:
    """Numbers in (0, 1) of hashed ones."""
    return ((x >> np.uint64(11)).astype(np.float64) + 0.5) * (1.0 / (1 << 53))


def prefix(data: np.ndarray) -> np.ndarray:
    """Sums that range_hash() takes differences of."""
    out, weights = np.zeros(len(data) + 1, np.uint64), powers(len(data), BASE)
    for lo in range(0, len(data), CACHED):
        own = out[lo + 1 : lo + 1 + CACHED]
        np.add(data[lo : lo + CACHED], np.uint64(1), out=own)
        own *= weights[lo : lo + CACHED]
        own[:1] += out[lo : lo + 1]
        np.cumsum(own, out=own)
    return out


def range_hash(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of the bytes of each range: equal bytes, equal hash, wherever they lie."""
    return mix((sums[ends] - sums[starts]) * powers(len(sums), BACK)[starts] + (ends - starts).astype(np.uint64) * np.uint64(0xA24BAED4963EE407))


@dataclass
class Words:
    starts: np.ndarray
    ends: np.ndarray
    doc: np.ndarray  # which text a word is of

    def counts(self, docs: int) -> np.ndarray:
        return np.bincount(self.doc, minlength=docs)


def find_words(data: np.ndarray, bounds: np.ndarray) -> Words:
    """The words of texts that lie one after the other; text i is data[bounds[i]:bounds[i + 1]]."""
    word = ~SPACE[data]
    begin = word.copy()
    begin[1:] &= ~word[:-1]
    end = word.copy()
    end[:-1] &= ~word[1:]
    edges = bounds[1:-1]
    inner = edges[(edges > 0) & (edges < len(data))]
    begin[inner] |= word[inner]
    end[inner - 1] |= word[inner - 1]
    starts, ends = np.flatnonzero(begin), np.flatnonzero(end) + 1
    return Words(starts, ends, np.searchsorted(bounds, starts, side="right") - 1)


def word_hashes(data: np.ndarray, bounds: np.ndarray) -> tuple[Words, np.ndarray]:
    words = find_words(data, bounds)
    return words, range_hash(prefix(data), words.starts, words.ends)


def shingle_hashes(words: Words, hashes: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of n words within a text, and their texts. A text of fewer words is one run of them all; of none, no run."""
    if not len(hashes):
        return hashes, words.doc
    same = np.zeros(len(hashes), np.uint64)
    length = len(hashes)
    for k in range(n):
        same[: length - k] = mix(same[: length - k] * np.uint64(3) + hashes[k:], 7)
    counts = np.bincount(words.doc)
    stops = np.cumsum(counts)
    at = np.arange(length)
    whole = at + n <= stops[words.doc]
    out, doc = same[whole], words.doc[whole]
    short = np.flatnonzero((counts > 0) & (counts < n))
    if len(short):
        begin = stops[short] - counts[short]
        own = np.zeros(len(short), np.uint64)
        for k in range(n - 1):
            go = counts[short] > k
            own[go] = mix(own[go] * np.uint64(3) + hashes[begin[go] + k], 7)
        out, doc = np.concatenate([out, mix(own, 1)]), np.concatenate([doc, short])
        order = np.argsort(doc, kind="stable")
        out, doc = out[order], doc[order]
    return out, doc


def distinct(doc: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (text, hash) with how often each comes, sorted."""
    order = np.lexsort((hashes, doc))
    doc, hashes = doc[order], hashes[order]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (hashes[1:] != hashes[:-1])
    at = np.flatnonzero(new)
    return doc[at], hashes[at], np.diff(np.append(at, len(doc)))
