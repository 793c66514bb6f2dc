"""Word-run sets of texts, in vector form."""

from __future__ import annotations

import re

import numpy as np
import xxhash

#: Unbroken letters and digits.
WORD = re.compile(r"[^\W_]+")
#: Bytes kept of a run's hash; two runs among some hundred of a pair of texts collide with a chance of about 1e-7.
WIDTH = 5
_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)
_CACHE: dict[str, int] = {}
_CACHE_WORDS = 500_000


def _code(word: str) -> int:
    if len(_CACHE) >= _CACHE_WORDS:
        _CACHE.clear()
    code = _CACHE[word] = xxhash.xxh3_64_intdigest(word.encode("utf-8", "surrogatepass"))
    return code


def word_codes(text: str) -> np.ndarray:
    get = _CACHE.get
    return np.array([get(w) or _code(w) for w in WORD.findall(text.lower())], np.uint64)


def run_set(text: str, k: int) -> np.ndarray:
    """The sorted distinct hashes of the runs of k words; empty for fewer words."""
    codes = word_codes(text)
    if len(codes) < k:
        return np.zeros(0, np.uint64)
    mixed = np.zeros(len(codes) - k + 1, np.uint64)
    for i in range(k):
        mixed = (mixed ^ codes[i : len(codes) - k + 1 + i]) * _ODD[i % len(_ODD)]
        mixed ^= mixed >> np.uint64(29)
    return np.unique(mixed >> np.uint64(64 - 8 * WIDTH))


def pack(runs: np.ndarray) -> bytes:
    return runs.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :WIDTH].tobytes()


def unpack(data: bytes) -> np.ndarray:
    wide = np.zeros((len(data) // WIDTH, 8), np.uint8)
    wide[:, :WIDTH] = np.frombuffer(data, np.uint8).reshape(-1, WIDTH)
    return wide.view("<u8").reshape(-1)
