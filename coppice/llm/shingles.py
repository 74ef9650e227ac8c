"""Words and five-word shingles of whole texts as 64-bit fingerprints."""

from __future__ import annotations

import numpy as np
import xxhash

_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
_MIX = np.uint64(0xFF51AFD7ED558CCD)
_STEP = np.uint64(0x9E3779B97F4A7C15)
_known: dict[bytes, int] = {}


def words(text: str | None) -> list[bytes]:
    """Runs of characters other than space and U+0009 to U+000D, A-Z in lower case."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()


def word_hashes(found: list[bytes]) -> np.ndarray:
    """64-bit fingerprints; those of up to a million words are remembered."""
    got = list(map(_known.get, found))
    missing = [i for i, v in enumerate(got) if v is None]
    if missing:
        if len(_known) > 1_000_000:
            _known.clear()
        for i in missing:
            got[i] = _known[found[i]] = xxhash.xxh3_64_intdigest(found[i])
    return np.array(got, np.uint64)


def forget() -> None:
    """Drops the remembered fingerprints."""
    _known.clear()


def _scramble(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * _MIX
    return h ^ (h >> np.uint64(29))


def windows(hashes: np.ndarray, size: int) -> np.ndarray:
    """Fingerprint of every run of `size` words; of all words where there are fewer."""
    n = len(hashes)
    k = min(size, n)
    if not n:
        return hashes
    out = np.zeros(n - k + 1, np.uint64)
    for i in range(k):
        out = _scramble(out * _STEP + hashes[i : n - k + 1 + i] + np.uint64(i + 1))
    return out


def windows_of_rows(rows: np.ndarray) -> np.ndarray:
    """One fingerprint for each row of a matrix."""
    out = np.zeros(len(rows), np.uint64)
    for i in range(rows.shape[1]):
        out = _scramble(out * _STEP + rows[:, i] + np.uint64(i + 1))
    return out


def shingle_set(text: str | None, size: int = 5) -> np.ndarray:
    """Sorted distinct fingerprints of a text's shingles."""
    return np.unique(windows(word_hashes(words(text)), size))


def overlap(a: np.ndarray, b: np.ndarray) -> int:
    """Size of the intersection of two sorted sets."""
    if len(a) > len(b):
        a, b = b, a
    if not len(a):
        return 0
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    return int((b[at] == a).sum())
