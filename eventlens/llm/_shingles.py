"""Word shingle hashes of many texts at once, in numpy."""

from __future__ import annotations

import numpy as np

#: Words of a shingle.
WIDTH = 5
_P = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_P), -1, 1 << 64))
_powers = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit (the splitmix finaliser)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers["up"]) < n:
        for name, base in (("up", _P), ("down", _INVERSE)):
            x = np.full(n, base, np.uint64)
            x[0] = 1
            _powers[name] = np.cumprod(x)
    return _powers["up"][:n], _powers["down"][:n]


def word_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words, and the number of words of each text.

    Words are runs of anything but ASCII white space, with A-Z lower-cased.
    """
    raw = [t.encode("utf-8", "surrogatepass") for t in texts]
    data = np.frombuffer(b" ".join([b"", *raw, b""]), np.uint8)
    data = data + ((data >= 65) & (data <= 90)).astype(np.uint8) * np.uint8(32)
    solid = ~((data == 32) | ((data >= 9) & (data <= 13)))
    edge = np.flatnonzero(solid[1:] != solid[:-1]) + 1
    first, last = edge[::2], edge[1::2]
    up, down = _power(len(data) + 1)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[:-1], out=total[1:])
    hashes = mix((total[last] - total[first]) * down[first] + (last - first).astype(np.uint64))
    begins = np.cumsum([1] + [len(r) + 1 for r in raw])
    return hashes, np.diff(np.searchsorted(first, begins))


def shingles(texts: list[str], width: int = WIDTH) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text.

    A text of fewer than ``width`` words has its whole word sequence as one shingle, a
    text without words has none.
    """
    out: list[np.ndarray] = []
    k = 0
    while k < len(texts):
        end, size = k, 0
        while end < len(texts) and (end == k or size + len(texts[end]) <= 1 << 19):
            size += len(texts[end])
            end += 1
        words, counts = word_hashes(texts[k:end])
        rolled = _roll(words, width) if len(words) >= width else words[:0]
        at = 0
        for n in counts:
            n = int(n)
            if n >= width:
                out.append(np.unique(rolled[at : at + n - width + 1]))
            elif n:
                out.append(mix(_roll(words[at : at + n], n) + np.uint64(n)))
            else:
                out.append(words[:0])
            at += n
        k = end
    return out


def _roll(words: np.ndarray, width: int) -> np.ndarray:
    n = len(words) - width + 1
    x = words[:n].copy()
    for j in range(1, width):
        x = x * _P + words[j : n + j]
    return mix(x)
