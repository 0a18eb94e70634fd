"""Words of texts as byte strings: A-Z lower-cased, runs of [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]."""

from __future__ import annotations

import numpy as np

_OTHER = b" "
#: Maps each byte to itself, its lower case, or a space where it is part of no word.
FOLD = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else _OTHER[0]
    for b in range(256)
)


def words(text: bytes | None) -> list[bytes]:
    return text.translate(FOLD).split() if text else []


_U = np.uint64
_BASE = _U(0x9E3779B97F4A7C15 | 1)
_MIX1, _MIX2 = _U(0xBF58476D1CE4E5B9), _U(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """A fixed bijection of 64-bit values that spreads every bit (the splitmix64 finaliser)."""
    x = x ^ (x >> _U(30))
    x *= _MIX1
    x ^= x >> _U(27)
    x *= _MIX2
    x ^= x >> _U(31)
    return x


_POWERS = [np.ones(1, dtype=_U), np.ones(1, dtype=_U)]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64, n of each at least."""
    if len(_POWERS[0]) < n:
        size = 1 << (n - 1).bit_length()
        inverse = _U(pow(int(_BASE), -1, 1 << 64))
        with np.errstate(over="ignore"):
            for i, b in enumerate((_BASE, inverse)):
                p = np.full(size, b, dtype=_U)
                p[0] = 1
                _POWERS[i] = np.cumprod(p, dtype=_U)
    return _POWERS[0], _POWERS[1]


#: Bytes hashed at a time.
SEGMENT = 1 << 19


def _hash_segment(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of folded bytes, and where each begins.

    Prefix sums of a polynomial over the bytes give each word's hash, so the work is a few
    passes over the bytes whatever the number of words.
    """
    data = np.frombuffer(data + b" ", dtype=np.uint8)
    edge = np.diff((data != 32).view(np.int8), prepend=np.int8(0))
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    power, inverse = _powers(len(data) + 1)
    with np.errstate(over="ignore"):
        sums = np.empty(len(data) + 1, dtype=_U)
        sums[0] = 0
        np.cumsum((data.astype(_U) + _U(1)) * power[: len(data)], out=sums[1:])
        return mix((sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(_U) * _MIX1), starts


def hashed_words(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of all texts, one after the other, and the words of each text."""
    joined = b" ".join([x or b"" for x in texts]).translate(FOLD)
    hashes, starts, at = [], [], 0
    while at < len(joined):
        end = joined.find(b" ", at + SEGMENT)
        end = len(joined) if end < 0 else end
        h, s = _hash_segment(joined[at:end])
        hashes.append(h)
        starts.append(s + at)
        at = end
    lengths = np.array([len(x) + 1 if x else 1 for x in texts], dtype=np.int64)
    if not hashes:
        return np.zeros(0, dtype=_U), np.zeros(len(texts), dtype=np.int64)
    bounds = np.searchsorted(np.concatenate(starts), np.cumsum(lengths))
    return np.concatenate(hashes), np.diff(bounds, prepend=0)


def shingle_sets(texts: list[bytes | None], size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles of ``size`` words of each text, as sorted 64-bit hashes.

    Returns the hashes of all texts one after the other, where each text begins (with the
    end), and the words of each text. A text of fewer words, but not none, is one shingle.
    """
    hashes, counts = hashed_words(texts)
    n_texts = len(counts)
    ends = np.cumsum(counts)
    begins = ends - counts
    with np.errstate(over="ignore"):
        rolled = np.zeros(max(len(hashes) - size + 1, 0), dtype=_U)
        for i in range(size):
            rolled = rolled * _BASE + hashes[i : i + len(rolled)]
        rolled = mix(rolled + _U(size))
    owner = np.repeat(np.arange(n_texts), counts)
    keep = np.zeros(len(rolled), dtype=bool)
    if len(rolled):
        keep = owner[: len(rolled)] == owner[size - 1 :]
    sets, owners = rolled[keep], owner[: len(rolled)][keep]
    short = np.flatnonzero((counts > 0) & (counts < size))
    if len(short):
        extra = np.empty(len(short), dtype=_U)
        with np.errstate(over="ignore"):
            for k, t in enumerate(short):
                h = _U(0)
                for x in hashes[begins[t] : ends[t]]:
                    h = h * _BASE + x
                extra[k] = h + _U(counts[t])
            extra = mix(extra)
        sets, owners = np.concatenate([sets, extra]), np.concatenate([owners, short])
    order = np.lexsort((sets, owners))
    sets, owners = sets[order], owners[order]
    if len(sets):
        first = np.ones(len(sets), dtype=bool)
        first[1:] = (sets[1:] != sets[:-1]) | (owners[1:] != owners[:-1])
        sets, owners = sets[first], owners[first]
    return sets, np.searchsorted(owners, np.arange(n_texts + 1)), counts
