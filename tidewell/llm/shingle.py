"""Word and shingle hashes of whole Arrow text columns, without Python strings.

Words are runs of bytes other than 0x20 and 0x09-0x0D, with A-Z lower-cased. A
word's hash is a polynomial over random numbers of its bytes, taken from one
running sum over the buffer: (sum up to its end - sum up to its begin) times the
inverse power of its begin, modulo 2^64, then mixed.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash

#: Words of a shingle; bytes that are hashed at once.
WORDS, RANGE = 5, 1 << 17

_BASE = 0x9E3779B97F4A7C15
_R, _RINV = np.uint64(_BASE), np.uint64(pow(_BASE, -1, 1 << 64))


def _tables() -> tuple[np.ndarray, np.ndarray]:
    value = np.random.default_rng(20_11).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
    value[ord("A") : ord("Z") + 1] = value[ord("a") : ord("z") + 1]
    space = np.zeros(256, bool)
    space[[32, *range(9, 14)]] = True
    value[space] = 0
    return value, space


_VALUE, _SPACE = _tables()
_POWERS: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def _powers(name: str, of: np.uint64, n: int) -> np.ndarray:
    """1, of, of ** 2, ...: at least n of them; only those for usual ranges are kept."""
    if name not in _POWERS:
        p = np.full(RANGE + 1, of, np.uint64)
        p[0] = 1
        _POWERS[name] = np.cumprod(p)
    if n <= len(_POWERS[name]):
        return _POWERS[name]
    p = np.full(n, of, np.uint64)
    p[0] = 1
    return np.cumprod(p)


def _hashed(x: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash, begin) of the words of some bytes; a word ends at a begin of a text at the latest."""
    space = _SPACE[x]
    first = ~space
    first[1:] &= space[:-1]
    first[begins] = ~space[begins]
    last = ~space
    last[:-1] &= space[1:] | first[1:]
    a, e = np.flatnonzero(first), np.flatnonzero(last) + 1
    total = np.zeros(len(x) + 1, np.uint64)
    np.cumsum(_VALUE[x] * _powers("up", _R, len(x))[: len(x)], out=total[1:])
    return mix((total[e] - total[a]) * _powers("down", _RINV, len(x))[a]), a


def _cut(data: np.ndarray, at: int, end: int) -> int:
    """Where a range that begins at `at` may end: behind white space, or at the end of the text."""
    to = at + RANGE
    while to < end:
        seen = np.flatnonzero(_SPACE[data[max(at, to - RANGE) : to]])
        if len(seen):
            return max(at, to - RANGE) + int(seen[-1]) + 1
        to += RANGE
    return end


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of a text column, and the number of words of each text (null: none)."""
    texts = texts.combine_chunks() if isinstance(texts, pa.ChunkedArray) else texts
    if texts.null_count:
        texts = texts.fill_null("")
    _, ends, data = texts.buffers()
    kind = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    ends = np.frombuffer(ends, kind, len(texts) + 1, texts.offset * kind().itemsize).astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    out, counts, i = [], np.zeros(len(texts), np.int64), 0
    while i < len(texts):
        j = max(i + 1, int(np.searchsorted(ends, ends[i] + RANGE, "right")) - 1)
        if j > i + 1 or ends[j] - ends[i] <= RANGE:
            begins = ends[i:j] - ends[i]
            h, a = _hashed(data[ends[i] : ends[j]], begins[begins < ends[j] - ends[i]])
            counts[i:j] = np.diff(np.searchsorted(a, ends[i : j + 1] - ends[i]))
            out.append(h)
        else:
            at = int(ends[i])
            while at < ends[j]:
                to = _cut(data, at, int(ends[j]))
                out.append(_hashed(data[at:to], np.zeros(1, np.int64))[0])
                counts[i] += len(out[-1])
                at = to
        i = j
    return np.concatenate(out) if out else np.empty(0, np.uint64), counts


def windows(texts: pa.Array, k: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all k-word windows in order, and their number for each text; of fewer words, the whole sequence is one."""
    h, words = word_hashes(texts)
    begin = np.cumsum(words) - words
    number = np.where(words >= k, words - k + 1, np.minimum(words, 1))
    out = np.zeros(int(number.sum()), np.uint64)
    put = np.cumsum(number) - number
    for width in range(1, k + 1):
        own = words >= k if width == k else words == width
        n = number[own]
        if not n.sum():
            continue
        step = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        at = np.repeat(begin[own], n) + step
        s = h[at] + np.uint64(width)
        for j in range(1, width):
            s = s * _R + h[at + j]
        out[np.repeat(put[own], n) + step] = mix(s)
    return out, number


def sets(texts: pa.Array, k: int = WORDS) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of every text."""
    s, number = windows(texts, k)
    ends = np.cumsum(number)
    for a, e in zip(ends - number, ends, strict=True):
        s[a:e].sort()
    keep = np.ones(len(s), bool)
    keep[1:] = s[1:] != s[:-1]
    keep[(ends - number)[number > 0]] = True
    cuts = np.concatenate([[0], np.cumsum(keep)])[np.concatenate([[0], ends])] if len(number) else [0]
    s = s[keep]
    return [s[a:e] for a, e in zip(cuts[:-1], cuts[1:], strict=True)]


def shingles(text: str | None, k: int = WORDS) -> np.ndarray:
    """Sorted distinct hashes of one text's shingles."""
    return sets(pa.array([text], pa.string()), k)[0]


def digest(s: np.ndarray) -> int:
    """A 64-bit hash of a set, 0 for the empty one."""
    return int(np.uint64(xxhash.xxh3_64_intdigest(s.tobytes())).astype(np.int64)) if len(s) else 0
