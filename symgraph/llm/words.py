"""Words of many texts at once, as arrays of code points, with hashed features of each word."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np

#: Odd multipliers of the hashes below.
M = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F, 0x165667B1], np.uint32)


@lru_cache(1)
def letters() -> np.ndarray:
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


@dataclass
class Words:
    """`codes`: lowered code points with 0 for all but letters; `starts`, `ends`: each word's place;
    `first`: for each text the number of its first word, and one entry more."""

    codes: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray


def words_of(texts: list[str]) -> Words:
    lowered = [t.lower() for t in texts]
    joined = "\0" + "\0".join(lowered) + "\0\0\0"
    codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint32)
    letter = letters()[codes]
    codes[~letter] = 0
    edges = np.flatnonzero(letter[1:] != letter[:-1]) + 1
    starts, ends = edges[::2], edges[1::2]
    begins = np.concatenate(([1], np.cumsum(np.fromiter((len(t) + 1 for t in lowered), np.int64, len(lowered))) + 1))
    return Words(codes, starts, ends, np.searchsorted(starts, begins))


def mixed(h: np.ndarray, seed: int) -> np.ndarray:
    h = (h ^ np.uint32(seed * 0x9E3779B1 & 0xFFFFFFFF)) * M[2]
    h ^= h >> np.uint32(15)
    h *= M[1]
    return h ^ (h >> np.uint32(13))


def whole(w: Words) -> np.ndarray:
    """A hash of each whole word."""
    if not len(w.starts):
        return np.zeros(0, np.uint32)
    place = np.arange(len(w.codes), dtype=np.int64)
    begun = np.zeros(len(w.codes), np.int64)
    begun[w.starts] = w.starts
    place -= np.maximum.accumulate(begun)
    powers = np.cumprod(np.full(64, M[0], np.uint32), dtype=np.uint32)
    terms = (w.codes + np.uint32(1)) * powers[place & 63] * (w.codes > 0)
    return mixed(np.add.reduceat(terms, w.starts, dtype=np.uint32), 1)


def edge(w: Words, n: int, suffix: bool) -> np.ndarray:
    """A hash of the first (or last) `n` letters of each word; of all if there are fewer."""
    h = np.zeros(len(w.starts), np.uint32)
    for i in range(n):
        at = w.ends - 1 - i if suffix else w.starts + i
        c = np.where((at >= w.starts) & (at < w.ends), w.codes[np.clip(at, 0, len(w.codes) - 1)], 0)
        h = (h + c) * M[i % 5] + np.uint32(i)
    return mixed(h, 2 * n + suffix + 2)


def chunks(texts: list[str], most: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Runs of texts of about `most` characters; a longer text is a run of its own."""
    at, size = 0, 0
    for i, t in enumerate(texts):
        if size and size + len(t) > most:
            yield at, i
            at, size = i, 0
        size += len(t)
    if at < len(texts):
        yield at, len(texts)


def word_cuts(text: str, most: int = 1 << 20) -> list[int]:
    """Where pieces of a very long text begin, and its end: about `most` characters apart and never inside a word."""
    cuts, n = [0], len(text)
    while n - cuts[-1] > most:
        at = cuts[-1] + most
        while at < n and text[at - 1].isalpha() and text[at].isalpha():
            at += 1
        if at == n:
            break
        cuts.append(at)
    return [*cuts, n]


def after_words(text: str, at: int, count: int) -> int:
    """The place in `text` just after `count` words from `at`, or its end."""
    n = len(text)
    for _ in range(count):
        while at < n and not text[at].isalpha():
            at += 1
        while at < n and text[at].isalpha():
            at += 1
    return at
