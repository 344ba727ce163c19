"""Word hashes of many texts at once with numpy: no Python loop over words."""

from __future__ import annotations

import hashlib

import numpy as np

BASE = 0x9E3779B97F4A7C15
#: multiplier of the mixing step and the inverse of BASE modulo 2 ** 64
MIX, BASE_INV = np.uint64(0xBF58476D1CE4E5B9), pow(BASE, -1, 1 << 64)
#: bytes beyond which a stretch is hashed on its own
LONG = 512
#: by number of bytes, which part of eight little-endian bytes counts
_PART = np.array([(1 << 8 * i) - 1 for i in range(9)], np.uint64)

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
#: letters and digits of ASCII and all bytes of other letters
ALNUM = np.zeros(256, bool)
ALNUM[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True

_pow: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_pow.get("up", ())) < n:
        size = max(n, 1 << 20)
        for name, base in (("up", BASE), ("down", BASE_INV)):
            p = np.full(size, base, np.uint64)
            p[0] = 1
            _pow[name] = np.cumprod(p)
    return _pow["up"], _pow["down"]


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ h >> np.uint64(32)) * MIX
    return h ^ h >> np.uint64(29)


def concatenate(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """All texts in UTF-8, each followed by a line feed, and each text's first byte (one more entry at the end)."""
    raw = [t.encode() for t in texts]
    starts = np.cumsum([0] + [len(r) + 1 for r in raw])
    return np.frombuffer(b"\n".join([*raw, b""]), np.uint8), starts


def _eights(buf: np.ndarray) -> np.ndarray:
    """The eight bytes that begin at each place, as one row each; zeros follow the buffer."""
    return np.lib.stride_tricks.sliding_window_view(np.concatenate([buf, np.zeros(8, np.uint8)]), 8)


def _chunk(eights: np.ndarray, at: np.ndarray, left: np.ndarray) -> np.ndarray:
    return eights[at].view("<u8")[:, 0] & _PART[np.minimum(left, 8)]


def stretch_hash(buf: np.ndarray, first: np.ndarray, last: np.ndarray, seed: int = 0) -> np.ndarray:
    """64-bit hash of the bytes first..last-1 of each stretch and of its length: every eight bytes are mixed in
    turn, so stretches of one length up to eight bytes never share a hash, and no pattern of longer ones cancels out."""
    eights, size = _eights(buf), last - first
    h = mix((size + 1).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93) + np.uint64(seed * BASE & (1 << 64) - 1))
    h = mix((h ^ _chunk(eights, first, size)) * np.uint64(0x9FB21C651E98DF25))
    more = np.flatnonzero((size > 8) & (size <= LONG))
    for k in range(8, LONG, 8):
        more = more[size[more] > k]
        if not len(more):
            break
        h[more] = mix((h[more] ^ _chunk(eights, first[more] + k, size[more] - k)) * np.uint64(0x9FB21C651E98DF25))
    salt = seed.to_bytes(8, "little")
    for i in np.flatnonzero(size > LONG).tolist():
        h[i] = int.from_bytes(hashlib.blake2b(buf[first[i] : last[i]].tobytes(), digest_size=8, salt=salt).digest(), "little")
    return h


def same_bytes(a: np.ndarray, a_first: np.ndarray, a_last: np.ndarray, b: np.ndarray, b_first: np.ndarray, b_last: np.ndarray) -> np.ndarray:
    """Whether the stretches of ``a`` and ``b`` hold the same bytes, pair by pair."""
    size = a_last - a_first
    out = size == b_last - b_first
    ea, eb = _eights(a), _eights(b)
    more, k = np.flatnonzero(out), 0
    while len(more) and k <= LONG:
        equal = _chunk(ea, a_first[more] + k, size[more] - k) == _chunk(eb, b_first[more] + k, size[more] - k)
        out[more[~equal]] = False
        k += 8
        more = more[equal & (size[more] > k)]
    for i in more.tolist():
        out[i] = np.array_equal(a[a_first[i] : a_last[i]], b[b_first[i] : b_last[i]])
    return out


def words(buf: np.ndarray, starts: np.ndarray, inside: np.ndarray, fold: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash, text number, first and last+1 byte of each maximal run of bytes that ``inside`` marks."""
    keep = inside[buf]
    none = np.zeros(1, np.int8)
    edge = np.diff(np.concatenate([none, keep.view(np.int8), none]))
    first, last = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    h = stretch_hash(LOWER[buf] if fold else buf, first, last)
    return h, np.searchsorted(starts, first, "right") - 1, first, last


class Probe:
    """Which of many hashes are in a set: a bit table first, then the sorted set."""

    def __init__(self, keys: np.ndarray):
        self.keys = keys
        self.mask = np.uint64(max(1 << 12, 1 << int(16 * len(keys)).bit_length()) - 1)
        self.bits = np.zeros(int(self.mask) + 1, bool)
        self.bits[keys & self.mask] = True

    def __call__(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions in ``x`` that hold a key, and which one."""
        some = np.flatnonzero(self.bits[x & self.mask])
        if not len(self.keys):
            return some, some
        at = np.minimum(np.searchsorted(self.keys, x[some]), len(self.keys) - 1)
        good = self.keys[at] == x[some]
        return some[good], at[good]
