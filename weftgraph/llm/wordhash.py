"""Word and shingle hashes as numpy arrays.

Words are the runs of bytes other than space, tab, line feed, vertical tab, form feed and carriage
return, after A-Z are lowered; UTF-8 keeps those bytes apart from all others. A word's hash is a
polynomial over random numbers of its bytes, modulo 2**64, read off one running sum over the text: no
object is made for a word. Texts are hashed in groups of about GROUP bytes, and longer texts in pieces that
end at white space, so memory does not follow the length of a text.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import lru_cache

import numpy as np

#: Bytes that are hashed at a time.
GROUP = 1 << 19
#: Odd multipliers that tell places apart, and the inverse of the one for bytes modulo 2**64.
GOLDEN, STEP = 0x9E3779B97F4A7C15, 0xD1342543DE82EF95
STEP_BACK = pow(STEP, -1, 1 << 64)
BYTES = np.random.default_rng(20240611).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
WHITE = np.zeros(256, bool)
WHITE[[9, 10, 11, 12, 13, 32]] = True


@lru_cache(maxsize=64)
def powers(n: int) -> np.ndarray:
    return np.array([pow(GOLDEN, i + 1, 1 << 64) for i in range(n)], np.uint64)


_forward, _back = np.ones(1, np.uint64), np.ones(1, np.uint64)


def _places(n: int) -> tuple[np.ndarray, np.ndarray]:
    """STEP ** i and STEP ** -i for i < n."""
    global _forward, _back
    while len(_forward) < n:
        k = len(_forward)
        _forward = np.concatenate([_forward, _forward * np.uint64(pow(STEP, k, 1 << 64))])
        _back = np.concatenate([_back, _back * np.uint64(pow(STEP_BACK, k, 1 << 64))])
    return _forward[:n], _back[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A finalizer that spreads every bit over all 64."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _hash(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Start and hash of the words of a piece."""
    b = np.frombuffer(raw, np.uint8)
    word = ~WHITE[b]
    edge = np.flatnonzero(np.diff(word, prepend=False, append=False))
    start, end = edge[::2], edge[1::2]
    forward, back = _places(len(b) + 1)
    total = np.zeros(len(b) + 1, np.uint64)
    np.cumsum(BYTES[b] * forward[:-1], out=total[1:])
    return start, mix((total[end] - total[start]) * back[start] + (end - start).astype(np.uint64))


def _pieces(raw: bytes) -> Iterator[bytes]:
    """A long text in pieces that end at white space."""
    at = 0
    while len(raw) - at > GROUP:
        cut = at + GROUP
        while cut < len(raw) and not WHITE[raw[cut]]:
            cut += 1
        yield raw[at : cut + 1]
        at = cut + 1
    yield raw[at:]


def words_of(texts: Sequence[str | None]) -> Iterator[np.ndarray]:
    """The hashes of the words of each text, in order."""
    group: list[bytes] = []
    size = 0
    for t in texts:
        raw = t.encode("utf-8", "replace").lower() if t else b""
        if group and size + len(raw) > GROUP:
            yield from _group(group)
            group, size = [], 0
        if len(raw) > GROUP:
            yield np.concatenate([_hash(p)[1] for p in _pieces(raw)])
        else:
            group.append(raw)
            size += len(raw) + 1
    if group:
        yield from _group(group)


def _group(group: list[bytes]) -> Iterator[np.ndarray]:
    start, hashes = _hash(b" ".join(group))
    lo = 0
    for hi in np.searchsorted(start, np.cumsum([len(g) + 1 for g in group])).tolist():
        yield hashes[lo:hi]
        lo = hi


def shingle_hashes(hashes: np.ndarray, k: int = 5) -> np.ndarray:
    """Hashes of the k-word shingles in text order; a shorter sequence is one shingle, an empty one none."""
    n = len(hashes)
    if n == 0:
        return hashes
    if n < k:
        return mix((hashes * powers(k)[:n]).sum(dtype=np.uint64, keepdims=True) + np.uint64(n))
    total = hashes[: n - k + 1] * powers(k)[0]
    for j in range(1, k):
        total = total + hashes[j : n - k + 1 + j] * powers(k)[j]
    return mix(total + np.uint64(k))


def shingle_sets(texts: Sequence[str | None], k: int = 5) -> Iterator[np.ndarray]:
    """Sorted distinct shingle hashes of each whole text."""
    for w in words_of(texts):
        yield np.unique(shingle_hashes(w, k))


def shingle_set(text: str | None, k: int = 5) -> np.ndarray:
    return next(shingle_sets([text], k))
