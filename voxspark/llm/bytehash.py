"""Vectorised 64-bit polynomial hashes over UTF-8 bytes.

Each byte value gets a 64-bit pseudo-random weight; a string's hash is the
polynomial of its weights modulo 2**64, scrambled at the end.  With running sums
over a buffer, the hash of any slice costs two look-ups and one product.
"""

from __future__ import annotations

import numpy as np

U = np.uint64
BASE = U(0x9E3779B97F4A7C15 | 1)
BASE_INV = U(pow(int(BASE), -1, 1 << 64))
_POWERS: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """Scramble 64-bit words (a bijection)."""
    x = np.array(x, dtype=U)
    x ^= x >> U(30)
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


def combine(*parts: np.ndarray) -> np.ndarray:
    """One key for a tuple of 64-bit keys; order matters."""
    out = np.full(np.shape(parts[0]), U(0x51ED270B), dtype=U)
    for part in parts:
        out = mix(out * BASE + np.asarray(part, dtype=U))
    return out


WEIGHT = mix(np.arange(1, 257, dtype=U) * U(0xD6E8FEB86659FD93))


def powers(n: int, name: str) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64, kept by the worker."""
    have = _POWERS.get(name)
    if have is None or len(have) < n:
        size = max(1, -(-n // (1 << 16))) << 16
        have = np.empty(size, dtype=U)
        have[0], filled = 1, 1
        base = BASE if name == "up" else BASE_INV
        while filled < size:
            step = U(pow(int(base), filled, 1 << 64))
            more = min(filled, size - filled)
            have[filled : filled + more] = have[:more] * step
            filled += more
        _POWERS[name] = have
    return have[:n]


class Rolling:
    """Hashes of slices of one byte buffer."""

    def __init__(self, data: np.ndarray):
        n = len(data)
        self.sums = np.zeros(n + 1, dtype=U)
        np.cumsum(WEIGHT[data] * powers(n, "up"), out=self.sums[1:])
        self.down = powers(n + 1, "down")

    def slices(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Keys of data[start:end]; equal slices get equal keys wherever they stand."""
        return mix((self.sums[end] - self.sums[start]) * self.down[start] + (end - start).astype(U))

    def windows(self, length: int) -> np.ndarray:
        """Keys of all windows of one length."""
        n = len(self.sums) - length
        if n <= 0:
            return np.empty(0, dtype=U)
        return mix((self.sums[length:] - self.sums[:n]) * self.down[:n] + U(length))


SPACE = np.zeros(256, dtype=bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def lower_ascii(data: np.ndarray) -> np.ndarray:
    return LOWER[data]


def join_texts(texts: list[bytes], gap: int) -> tuple[np.ndarray, np.ndarray]:
    """One buffer with `gap` spaces after each text; starts (and the end) of the texts in it."""
    sep = b" " * gap
    data = np.frombuffer(sep.join(texts) + sep, dtype=np.uint8)
    starts = np.zeros(len(texts) + 1, dtype=np.int64)
    np.cumsum([len(t) + gap for t in texts], out=starts[1:])
    return data, starts


def word_spans(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of runs of non-space bytes (space: 0x20 and 0x09-0x0D)."""
    word = np.zeros(len(data) + 2, dtype=np.int8)
    word[1:-1] = ~SPACE[data]
    turn = np.flatnonzero(np.diff(word))
    return turn[::2], turn[1::2]


def as_bytes(text) -> bytes:
    """UTF-8 of a text; null is empty."""
    return text.encode("utf-8", "surrogatepass") if isinstance(text, str) else b""


def batches(texts: list[bytes], limit: int):
    """Index ranges of consecutive texts of about `limit` bytes together."""
    start = size = 0
    for i, t in enumerate(texts):
        if size and size + len(t) > limit:
            yield start, i
            start, size = i, 0
        size += len(t) + 1
    if start < len(texts):
        yield start, len(texts)


def pieces(texts: list[bytes], limit: int) -> tuple[list[bytes], np.ndarray]:
    """Texts cut into pieces of at most `limit` bytes, at a space where there is one; the text of each piece."""
    out, of = [], []
    for k, t in enumerate(texts):
        start = 0
        while len(t) - start > limit:
            stop = max(t.rfind(b" ", start, start + limit), t.rfind(b"\n", start, start + limit)) + 1
            stop = stop if stop > start else start + limit
            out.append(t[start:stop])
            of.append(k)
            start = stop
        out.append(t[start:])
        of.append(k)
    return out, np.array(of, dtype=np.int64)
