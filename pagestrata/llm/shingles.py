"""Words and word shingles of whole texts as 64-bit hashes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import xxhash

_U = np.uint64
GROUP_CHARS = 1_000_000
MEMO_WORDS = 250_000


class _Memo(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= MEMO_WORDS:
            self.clear()
        got = self[word] = xxhash.xxh64_intdigest(word)
        return got


_MEMO = _Memo()


def words_of(text: str | None) -> list[bytes]:
    """Maximal runs of bytes other than space and \\t to \\r, with A-Z in lower case."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(_MEMO.__getitem__, words), dtype=_U, count=len(words))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finisher (splitmix64's)."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _factor(i: int) -> np.uint64:
    return _U((0x9E3779B97F4A7C15 * (2 * i + 1)) & 0xFFFFFFFFFFFFFFFF | 1)


def shingle_hashes(hashes: np.ndarray, k: int) -> np.ndarray:
    """One hash for each k consecutive words; with 0 < n < k words, one for all of them."""
    n = len(hashes)
    with np.errstate(over="ignore"):
        if n >= k:
            out = np.zeros(n - k + 1, dtype=_U)
            for i in range(k):
                out += hashes[i : n - k + 1 + i] * _factor(i)
            return mix(out)
        if n:
            parts = np.array([_factor(i) for i in range(n)], dtype=_U)
            return mix(np.array([(hashes * parts).sum(dtype=_U) + _U(n)], dtype=_U))
    return np.zeros(0, dtype=_U)


def shingle_sets(texts: list[str | None], k: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    group: list[list[bytes]] = []
    size = 0

    def flush() -> Iterator[np.ndarray]:
        flat = word_hashes([w for ws in group for w in ws])
        at = 0
        for ws in group:
            yield np.unique(shingle_hashes(flat[at : at + len(ws)], k))
            at += len(ws)

    for text in texts:
        group.append(words_of(text))
        size += len(text or "")
        if size >= GROUP_CHARS:
            yield from flush()
            group, size = [], 0
    yield from flush()
