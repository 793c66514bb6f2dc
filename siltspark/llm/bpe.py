"""Byte-pair encoding with the vocabulary of a public tokenizer, by segment trees over byte positions.

A text is split by the tokenizer's pattern; each part is encoded by itself. Over the byte positions of a part lies a
tree whose leaves hold the rank of the pair that begins there and whose nodes hold the least rank below, with the
leftmost position of it. The root names the next merge; a merge changes the leaves of the merged token, of its left
neighbour and of the swallowed token, and the path above each: logarithmic work on live neighbours.

Parts of one tree size are encoded together, one numpy lane a part. Parts seen before come from a bounded cache; it
saves time and changes nothing."""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

#: Bytes of text encoded at once, and parts kept in a worker's cache.
SLICE_BYTES, CACHE_PARTS = 2 << 20, 400_000
#: The longest part that shares a batch; longer ones are encoded one by one, by the same tree in plain integers.
LANE_BYTES = 64
NONE = (1 << 31) - 1


class Vocabulary:
    """ranks: token bytes to id, which is also the priority of the merge that makes it."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.pattern = regex.compile(pattern)
        self.single = np.array([ranks[bytes([i])] for i in range(256)], np.int64)
        pairs: dict[int, int] = {}
        for token, rank in ranks.items():
            for i in range(1, len(token)):
                left, right = ranks.get(token[:i]), ranks.get(token[i:])
                if left is not None and right is not None:
                    pairs[left << 32 | right] = rank
        self.pairs = pairs
        # Open addressing for vector look-ups, at most a quarter full.
        keys, values = np.fromiter(pairs, np.int64, len(pairs)), np.fromiter(pairs.values(), np.int64, len(pairs))
        self.bits = max(4, (4 * len(pairs)).bit_length())
        self.slot_key, self.slot_rank = np.full(1 << self.bits, -1, np.int64), np.full(1 << self.bits, NONE, np.int64)
        slot, left = self._slot(keys), np.arange(len(keys))
        self.probes = 0
        while len(left):
            self.probes += 1
            free = left[self.slot_key[slot[left]] < 0]
            self.slot_key[slot[free]] = keys[free]
            self.slot_rank[slot[free]] = values[free]
            left = left[self.slot_key[slot[left]] != keys[left]]
            slot[left] = (slot[left] + 1) & ((1 << self.bits) - 1)
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.lengths: list[np.ndarray] = []
        self.pool: list[np.ndarray] = []

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair of ids, NONE where there is no such merge or an id is negative."""
        keys = np.where((left >= 0) & (right >= 0), left << 32 | right, -2)
        slot = self._slot(keys)
        out = np.full(len(keys), NONE, np.int64)
        open_ = np.arange(len(keys))
        for _ in range(self.probes):
            found = self.slot_key[slot[open_]]
            hit = found == keys[open_]
            out[open_[hit]] = self.slot_rank[slot[open_[hit]]]
            open_ = open_[~hit & (found >= 0)]
            if not len(open_):
                break
            slot[open_] = (slot[open_] + 1) & ((1 << self.bits) - 1)
        return out

    def _lanes(self, parts: list[bytes], size: int) -> list[np.ndarray]:
        """Ids of parts of at most `size` bytes, size a power of two."""
        n, levels = len(parts), size.bit_length() - 1
        length = np.array([len(p) for p in parts])
        text = np.zeros((n, size), np.uint8)
        text[np.arange(size) < length[:, None]] = np.frombuffer(b"".join(parts), np.uint8)
        # Token ids by start position; position `size` stands for "no neighbour".
        ids = np.full((n, size + 1), -1, np.int64)
        ids[:, :size] = np.where(np.arange(size) < length[:, None], self.single[text], -1)
        after = np.tile(np.minimum(np.arange(1, size + 2), size), (n, 1))
        before = np.tile(np.r_[size, np.arange(size)], (n, 1))
        after[np.arange(n), length - 1] = size
        # Leaf p: rank of the pair at p times size, plus p; so the least value is the leftmost least rank.
        none = NONE * size
        tree = np.full((n, 2 * size), none, np.int64)
        row, col = np.nonzero(np.arange(size - 1) < (length - 1)[:, None])
        tree[row, size + col] = self.rank(ids[row, col], ids[row, col + 1]) * size + col
        for level in range(levels - 1, -1, -1):
            lo = 1 << level
            tree[:, lo : 2 * lo] = np.minimum(tree[:, 2 * lo : 4 * lo : 2], tree[:, 2 * lo + 1 : 4 * lo : 2])
        live = np.flatnonzero(tree[:, 1] < none)
        while len(live):
            at, rank = tree[live, 1] % size, tree[live, 1] // size
            gone = after[live, at]
            follow, lead = after[live, gone], before[live, at]
            ids[live, at], ids[live, gone] = rank, -1
            after[live, at], before[live, follow] = follow, at
            here = self.rank(rank, ids[live, follow])
            left = self.rank(ids[live, lead], rank)
            leaf = np.stack([at, gone, np.where(lead < size, lead, at)])
            value = np.stack([here, np.full(len(live), NONE), np.where(lead < size, left, here)])
            for p, v in zip(leaf, value):
                node = p + size
                tree[live, node] = np.where(v < NONE, v * size + p, none)
            for p in leaf:
                node = (p + size) >> 1
                for _ in range(levels):
                    tree[live, node] = np.minimum(tree[live, 2 * node], tree[live, 2 * node + 1])
                    node >>= 1
            live = live[tree[live, 1] < none]
        ids = ids[:, :size]
        there = ids >= 0
        return np.split(ids[there].astype(np.int32), np.cumsum(there.sum(axis=1))[:-1])

    def encode_long(self, part: bytes) -> np.ndarray:
        """Ids of one part by a tree of plain integers."""
        n = len(part)
        size = 1 << max(1, (n - 1).bit_length())
        get, none = self.pairs.get, NONE * size
        ids = self.single[np.frombuffer(part, np.uint8)]
        first = np.full(2 * size, none, np.int64)
        r = self.rank(ids[:-1], ids[1:])
        first[size : size + n - 1] = np.where(r < NONE, r * size + np.arange(n - 1), none)
        lo = size >> 1
        while lo:
            first[lo : 2 * lo] = np.minimum(first[2 * lo : 4 * lo : 2], first[2 * lo + 1 : 4 * lo : 2])
            lo >>= 1
        tree, ids = first.tolist(), ids.tolist()
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))

        def put(p: int, rank: int | None) -> None:
            node = p + size
            tree[node] = none if rank is None else rank * size + p
            node >>= 1
            while node:
                a, b = tree[2 * node], tree[2 * node + 1]
                least = a if a <= b else b
                if tree[node] == least:
                    break
                tree[node] = least
                node >>= 1

        while tree[1] < none:
            rank, at = divmod(tree[1], size)
            gone = after[at]
            follow, lead = after[gone], before[at]
            ids[at], ids[gone], after[at] = rank, -1, follow
            put(gone, None)
            put(at, get(rank << 32 | ids[follow]) if follow < n else None)
            if follow < n:
                before[follow] = at
            if lead >= 0:
                put(lead, get(ids[lead] << 32 | rank))
        return np.array([i for i in ids if i >= 0], np.int32)

    def encode_parts(self, parts: list[bytes]) -> list[np.ndarray]:
        out: list = [None] * len(parts)
        by_size: dict[int, list[int]] = {}
        for i, p in enumerate(parts):
            if len(p) == 1:
                out[i] = self.single[p[0] : p[0] + 1].astype(np.int32)
            elif len(p) > LANE_BYTES:
                out[i] = self.encode_long(p)
            else:
                by_size.setdefault(1 << max(1, (len(p) - 1).bit_length()), []).append(i)
        for size, members in by_size.items():
            for lo in range(0, len(members), 1 << 16):
                some = members[lo : lo + (1 << 16)]
                for i, ids in zip(some, self._lanes([parts[i] for i in some], size)):
                    out[i] = ids
        return out

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Offsets (one more than texts) and all ids in a row; null and empty texts have none."""
        if len(self.known) > CACHE_PARTS:
            self.forget()
        parts, counts = [], []
        for text in texts:
            found = self.pattern.findall(text) if text else []
            parts += found
            counts.append(len(found))
        known = self.known
        fresh = list(dict.fromkeys(p for p in parts if p not in known))
        if fresh:
            done = self.encode_parts([p.encode("utf-8", "replace") for p in fresh])
            known.update(zip(fresh, range(len(known), len(known) + len(fresh))))
            self.lengths.append(np.array([len(d) for d in done]))
            self.pool.append(np.concatenate(done))
            if len(self.lengths) > 1:
                self.lengths, self.pool = [np.concatenate(self.lengths)], [np.concatenate(self.pool)]
        which = np.array(list(map(known.__getitem__, parts)), np.int64)
        ends = np.zeros(len(texts) + 1, np.int64)
        if not len(which):
            return ends, np.zeros(0, np.int32)
        lengths, pool = self.lengths[0], self.pool[0]
        starts = np.cumsum(lengths) - lengths
        size = lengths[which]
        total = np.cumsum(size)
        at = np.arange(total[-1]) + np.repeat(starts[which] - (total - size), size)
        part_ends = np.cumsum(counts)
        ends[1:] = np.r_[0, total][part_ends]
        return ends, pool[at]


_LOADED: dict[bytes, Vocabulary] = {}


def load_vocabulary(ranks: bytes, pattern: str) -> Vocabulary:
    """From the text of a ranks file (base64 token and rank a line); made once a process."""
    key = hashlib.sha256(ranks + pattern.encode()).digest()
    if key not in _LOADED:
        _LOADED[key] = Vocabulary({base64.b64decode(t): int(r) for t, r in map(bytes.split, ranks.splitlines()) if t}, pattern)
    return _LOADED[key]


def read_tokenizer(spark: SparkSession, ranks_path: str, pattern: str | None = None):
    """A broadcast of the ranks file (some MB at most, whatever the corpus) and the splitting pattern."""
    if pattern is None:
        import public_tokenizers

        pattern = public_tokenizers.PATTERN
    with open(ranks_path, "rb") as f:
        return spark.sparkContext.broadcast((f.read(), pattern))


def _slices(texts: pa.Array) -> Iterator[list]:
    held, size = [], 0
    for t in texts.to_pylist():
        held.append(t)
        size += len(t or "")
        if size >= SLICE_BYTES:
            yield held
            held, size = [], 0
    if held:
        yield held


def encode_column(df: DataFrame, id: str, text: str, tokenizer, counts_only: bool = False) -> DataFrame:
    """id and ids (array of int, without special tokens), or with counts_only id and tokens (long), of each row of df.
    Null and empty texts have an empty list, a count of 0. Strings of special tokens in a text are ordinary text.
    Texts of any length and repeated rows are fine; other columns are ignored."""
    kind = dict(df.select(id).dtypes)[id]
    schema = f"`{id}` {kind}, " + ("tokens long" if counts_only else "ids array<int>")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = load_vocabulary(*tokenizer.value)
        for batch in batches:
            at = 0
            for texts in _slices(batch.column(1)):
                ends, ids = vocabulary.encode(texts)
                value = pa.array(np.diff(ends)) if counts_only else pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(ids))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(texts)), value], names=[id, "tokens" if counts_only else "ids"])
                at += len(texts)

    return df.select(id, text).mapInArrow(run, schema)
