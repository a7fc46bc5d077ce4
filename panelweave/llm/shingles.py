"""Hashes of word shingles, inside a task."""

from __future__ import annotations

from hashlib import blake2b, shake_256

import numpy as np

WORDS = 5
#: Bytes of a word that are hashed by place; longer words are rare and hashed by BLAKE2.
LETTERS = 64
#: Words that are hashed together, which bounds the memory for a long text.
RUN_WORDS = 16_384
_U = np.uint64
_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], dtype=_U)
_MEMO: dict[str, np.ndarray] = {}


def _letters() -> np.ndarray:
    """A random number for each place in a word and byte there, the same in every worker; 0 for white space."""
    if "letters" not in _MEMO:
        table = np.frombuffer(shake_256(b"letters").digest(LETTERS * 256 * 8), dtype="<u8").astype(_U).reshape(LETTERS, 256)
        table[:, [9, 10, 11, 12, 13, 32]] = 0
        _MEMO["letters"] = table.ravel()
    return _MEMO["letters"]


def forget() -> None:
    """Frees the numbers that this worker keeps for hashes of words."""
    _MEMO.clear()


def mix(x: np.ndarray) -> np.ndarray:
    """Scrambles 64-bit numbers one to one."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def words(text: str | None) -> list[bytes]:
    """Runs of anything but ASCII white space, A-Z in lower case."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def word_hashes(text: str | None) -> np.ndarray:
    """A hash for each of ``words(text)``, in order: the sum of its letters' numbers, scrambled."""
    raw = (text or "").encode("utf-8", "surrogatepass").lower()
    letters = np.frombuffer(raw, dtype=np.uint8)
    gap = (letters == 32) | ((letters - np.uint8(9)) < 5)
    start = np.flatnonzero(gap[1:] < gap[:-1]) + 1
    if len(raw) and not gap[0]:
        start = np.r_[0, start]
    size = np.concatenate((start[1:], [len(raw)]))[: len(start)] - start  # with the white space behind the word
    out = np.empty(len(start), dtype=_U)
    for a in range(0, len(start), RUN_WORDS):
        begin, whole = start[a : a + RUN_WORDS], size[a : a + RUN_WORDS]
        some = np.minimum(whole, LETTERS)
        first = np.cumsum(some) - some
        place = np.arange(first[-1] + some[-1])
        place -= np.repeat(first, some)
        its = letters[np.repeat(begin, some) + place] if whole.max() > LETTERS else letters[begin[0] : begin[0] + len(place)]
        place <<= 8
        place += its
        out[a : a + RUN_WORDS] = np.add.reduceat(_letters().take(place), first)
    out = mix(out)
    for i in np.flatnonzero(size > LETTERS):
        word = raw[start[i] : start[i] + size[i]].rstrip()
        if len(word) > LETTERS:
            out[i] = int.from_bytes(blake2b(word, digest_size=8).digest(), "little")
    return out


def shingles(text: str | None, size: int = WORDS) -> np.ndarray:
    """A hash for each run of ``size`` words, at most five, in order; of a shorter text one hash of all its words."""
    hashed = word_hashes(text)
    n = len(hashed)
    if not n:
        return hashed
    if n < size:
        return mix((hashed * _ODD[:n]).sum(keepdims=True, dtype=_U) + _U(n))
    total = hashed[: n - size + 1] * _ODD[0]
    for k in range(1, size):
        total += hashed[k : n - size + 1 + k] * _ODD[k]
    return mix(total)


def shingle_set(text: str | None, size: int = WORDS) -> np.ndarray:
    """The distinct shingles, sorted."""
    s = np.sort(shingles(text, size))
    new = s[1:] != s[:-1]  # np.unique takes five times as long
    return s if new.all() else s[np.r_[True, new]]
