"""BLAKE3-256 from its published specification, as an Arrow-batched UDF. All 1 KiB leaves of a batch are compressed
together: the sixteen state words are numpy vectors with one lane per leaf, and parents are reduced level by level."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Fixed values of the BLAKE3 specification: initial words, message permutation, flags.
IV = (0x6A09E667, 0xBB67AE85, 0x3C6EF372, 0xA54FF53A, 0x510E527F, 0x9B05688C, 0x1F83D9AB, 0x5BE0CD19)
PERMUTATION = (2, 6, 3, 10, 7, 0, 4, 13, 1, 11, 12, 5, 9, 14, 15, 8)
CHUNK_START, CHUNK_END, PARENT, ROOT = 1, 2, 4, 8
LEAF, BLOCK = 1024, 64


def _rotate(x: np.ndarray, n: int) -> np.ndarray:
    return (x >> np.uint32(n)) | (x << np.uint32(32 - n))


def _mix(v: list, a: int, b: int, c: int, d: int, x: np.ndarray, y: np.ndarray) -> None:
    for word, rd, rb in ((x, 16, 12), (y, 8, 7)):
        v[a] = v[a] + v[b] + word
        v[d] = _rotate(v[d] ^ v[a], rd)
        v[c] = v[c] + v[d]
        v[b] = _rotate(v[b] ^ v[c], rb)


def _compress(cv: np.ndarray, block: np.ndarray, counter: np.ndarray, length: np.ndarray, flags: np.ndarray) -> np.ndarray:
    """cv: lanes x 8, block: lanes x 16 words. The first eight output words of each lane."""
    lanes = len(cv)
    v = [cv[:, i].copy() for i in range(8)] + [np.full(lanes, IV[i], np.uint32) for i in range(4)]
    v += [counter.astype(np.uint32), (counter >> 32).astype(np.uint32), length.astype(np.uint32), flags.astype(np.uint32)]
    m = [block[:, i] for i in range(16)]
    for _ in range(7):
        for i in range(4):
            _mix(v, i, 4 + i, 8 + i, 12 + i, m[2 * i], m[2 * i + 1])
        for i in range(4):
            _mix(v, i, 4 + (i + 1) % 4, 8 + (i + 2) % 4, 12 + (i + 3) % 4, m[8 + 2 * i], m[9 + 2 * i])
        m = [m[p] for p in PERMUTATION]
    return np.stack([v[i] ^ v[i + 8] for i in range(8)], axis=1)


def _split(n: int) -> int:
    """Leaves of the left subtree: the largest power of two below n."""
    return 1 << ((n - 1).bit_length() - 1)


def digests(values: list[bytes]) -> list[str]:
    """Hex digests of the values."""
    if not values:
        return []
    counts = [max(1, -(-len(v) // LEAF)) for v in values]
    starts = np.concatenate([[0], np.cumsum(counts)])
    total = int(starts[-1])
    data = np.zeros((total, LEAF), np.uint8)
    sizes = np.zeros(total, np.int64)
    for value, at, n in zip(values, starts, counts):
        flat = data[at : at + n].reshape(-1)
        flat[: len(value)] = np.frombuffer(value, np.uint8)
        sizes[at : at + n] = np.clip(len(value) - LEAF * np.arange(n), 0, LEAF)
    counter = np.arange(total) - np.repeat(starts[:-1], counts)
    single = np.repeat(np.array(counts) == 1, counts)
    words = data.view("<u4").reshape(total, LEAF // BLOCK, 16)
    cvs = np.tile(np.array(IV, np.uint32), (total, 1))
    last = np.maximum(0, -(-sizes // BLOCK) - 1)
    for b in range(LEAF // BLOCK):
        on = np.flatnonzero(b <= last)
        if not len(on):
            break
        end = b == last[on]
        flags = CHUNK_START * (b == 0) + np.where(end, CHUNK_END + ROOT * single[on], 0)
        cvs[on] = _compress(cvs[on], words[on, b], counter[on], np.clip(sizes[on] - b * BLOCK, 0, BLOCK), flags)

    # Trees of all values are folded together, lowest parents first.
    levels: dict[int, list[tuple[int, int, int, bool]]] = {}
    parents = 0

    def plan(at: int, n: int, root: bool) -> tuple[int, int]:
        nonlocal parents
        if n == 1:
            return at, 0
        left, hl = plan(at, _split(n), False)
        right, hr = plan(at + _split(n), n - _split(n), False)
        slot, height = total + parents, 1 + max(hl, hr)
        parents += 1
        levels.setdefault(height, []).append((slot, left, right, root))
        return slot, height

    roots = [plan(int(at), n, True)[0] for at, n in zip(starts, counts)]
    cvs = np.concatenate([cvs, np.zeros((parents, 8), np.uint32)])
    for height in sorted(levels):
        slot, left, right, root = (np.array(x) for x in zip(*levels[height]))
        lanes = len(slot)
        cvs[slot] = _compress(np.tile(np.array(IV, np.uint32), (lanes, 1)), np.concatenate([cvs[left], cvs[right]], axis=1), np.zeros(lanes, np.int64), np.full(lanes, BLOCK), PARENT + ROOT * root.astype(np.int64))
    return [cvs[r].astype("<u4").tobytes().hex() for r in roots]


@F.pandas_udf(T.StringType())
def blake3_hex(data: pd.Series) -> pd.Series:
    """Hex digest of each binary value; null for null. Batches are cut so that padded leaves stay within 16 MiB."""
    out: list[str | None] = [None] * len(data)
    batch: list[int] = []
    held = 0

    def flush() -> None:
        for i, digest in zip(batch, digests([bytes(data.iloc[i]) for i in batch])):
            out[i] = digest
        batch.clear()

    for i, value in enumerate(data):
        if value is None:
            continue
        if batch and held + max(LEAF, len(value)) > 16 << 20:
            flush()
            held = 0
        batch.append(i)
        held += max(LEAF, len(value))
    flush()
    return pd.Series(out, dtype=object)
