"""64-bit hashes of words and word shingles, computed in arrays for many texts at once.

Words are lower-cased (A-Z) runs of other characters than ASCII white space.  Null and blank
texts have none.  A word of any length is hashed whole; bytes are hashed some at a time, so
memory follows the longest word, not the longest text.
"""

from __future__ import annotations

import numpy as np

#: Bytes hashed at once (a longer word is hashed by itself).
CHUNK = 1 << 20


def _sequence(seed: int, n: int) -> np.ndarray:
    """``n`` odd 64-bit numbers by a linear rule."""
    out = []
    for _ in range(n):
        seed = (seed * 6364136223846793005 + 1442695040888963407) % (1 << 64)
        out.append((seed ^ seed >> 33) | 1)
    return np.array(out, np.uint64)


_BYTES = _sequence(1, 256)
_BYTES[32] = 0
_PLACES = _sequence(2, 64)
_BASE = 0x9E3779B97F4A7C15


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection that spreads every bit."""
    x = (x ^ x >> np.uint64(32)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ x >> np.uint64(29)) * np.uint64(0x94D049BB133111EB)
    return x ^ x >> np.uint64(32)


def word_hashes(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of all words of all texts, in order, and the number of words of each text."""
    joined = [b" ".join((t or b"").lower().split()) for t in texts]
    counts = np.array([b.count(b" ") + 1 if b else 0 for b in joined], np.int64)
    raw = np.frombuffer(b" ".join(b for b in joined if b), np.uint8)
    if not len(raw):
        return np.empty(0, np.uint64), counts
    spaces = np.flatnonzero(raw == 32)
    starts, ends = np.r_[0, spaces + 1], np.r_[spaces, len(raw)]
    powers = np.cumprod(np.full(int((ends - starts).max()) + 1, _BASE, np.uint64))
    out, at = [], 0
    while at < len(starts):
        end = max(at + 1, int(np.searchsorted(ends, starts[at] + CHUNK, "right")))
        first = starts[at:end] - starts[at]
        part = raw[starts[at] : ends[end - 1]]
        place = np.arange(len(part)) - np.repeat(first, np.diff(np.r_[first, len(part)]))
        out.append(np.add.reduceat(_BYTES[part] * powers[place], first))
        at = end
    return mixed(np.concatenate(out)), counts


def shingle_hashes(words: np.ndarray, width: int) -> np.ndarray:
    """One hash per ``width`` consecutive word hashes."""
    n = max(0, len(words) - width + 1)
    out = np.zeros(n, np.uint64)
    for k in range(width if n else 0):
        out += words[k : k + n] * _PLACES[k]
    return mixed(out)


def text_shingles(words: np.ndarray, width: int) -> np.ndarray:
    """As :func:`shingle_hashes`; a text of fewer words has one shingle, of all of them (also if it has none)."""
    return shingle_hashes(words, width) if len(words) >= width else mixed(np.array([(words * _PLACES[: len(words)]).sum() + np.uint64(len(words))], np.uint64))


def majority(parts) -> int:
    """64 bits, each set where over half of the hashes have it; ``parts`` are arrays of them."""
    counts, n = np.zeros(64, np.int64), 0
    for hashes in parts:
        m = len(hashes)
        # eight bit flags to a 64-bit lane: up to 255 rows add up without overflow
        lanes = np.unpackbits(hashes.view(np.uint8)).view(np.uint64).reshape(m, 8)
        full = m - m % 255
        sums = [lanes[:full].reshape(-1, 255, 8).sum(1), lanes[full:].sum(0, keepdims=True)]
        counts += np.concatenate(sums).view(np.uint8).reshape(-1, 64).sum(0, dtype=np.int64)
        n += m
    return int.from_bytes(np.packbits(2 * counts > n).tobytes(), "big")


def pieces_of(hashes: np.ndarray, n: int = 1 << 16):
    """The array in pieces of ``n``."""
    return (hashes[k : k + n] for k in range(0, len(hashes), n))


def per_text(words: np.ndarray, counts: np.ndarray):
    """The word hashes of each text."""
    return np.split(words, np.cumsum(counts)[:-1]) if len(counts) else []
