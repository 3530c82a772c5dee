"""Words of many texts at once as 64-bit hashes, in numpy."""

from __future__ import annotations

import numpy as np

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_PRIME = np.uint64(0x9E3779B97F4A7C15)
#: Characters that are handled together; a longer text is handled alone.
GROUP = 1 << 17


def groups(texts: list[str]) -> list[slice]:
    """Runs of neighbouring texts with about GROUP characters."""
    found, start, size = [], 0, 0
    for i, text in enumerate(texts):
        if i > start and size + len(text) > GROUP:
            found.append(slice(start, i))
            start, size = i, 0
        size += len(text)
    return [*found, slice(start, len(texts))] if texts else []


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A well-mixed 64-bit value of each 64-bit value."""
    x = x ^ np.uint64(seed * 0xD6E8FEB86659FD93 & (1 << 64) - 1)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def run_hashes(raw: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes, starts and ends of the maximal runs of bytes that are ``inside``."""
    edges = np.flatnonzero(np.diff(np.concatenate(([False], inside, [False])).view(np.int8)))
    starts, ends = edges[::2], edges[1::2]
    if not len(starts):
        return np.zeros(0, np.uint64), starts, ends
    lengths = ends - starts
    first = np.cumsum(lengths) - lengths
    values = raw[inside].astype(np.uint64) + np.uint64(1)
    powers = np.cumprod(np.full(lengths.max(), _PRIME, np.uint64))
    values *= powers[np.arange(len(values)) - np.repeat(first, lengths)]
    return mix(np.add.reduceat(values, first)), starts, ends


def joined(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of the texts, a line feed behind each, and the byte where each text starts."""
    coded = [t.encode("utf-8", "surrogatepass") for t in texts]
    starts = np.cumsum([0, *(len(c) + 1 for c in coded)])[:-1]
    return np.frombuffer(b"\n".join([*coded, b""]), dtype=np.uint8), starts


def word_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words (runs of non-blanks) of all texts in order, and the number in each text."""
    raw, at = joined(texts)
    hashes, starts, _ = run_hashes(raw, ~_SPACE[raw])
    return hashes, np.bincount(np.searchsorted(at, starts, side="right") - 1, minlength=len(texts))


def shingles(words: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of k words; of a shorter text with words, the whole text is one."""
    if not len(words):
        return words
    k = min(k, len(words))
    n = len(words) - k + 1
    value = np.zeros(n, np.uint64)
    for i in range(k):
        value = value * _PRIME + words[i:i + n]
    return mix(value, k)
