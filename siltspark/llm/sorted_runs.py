"""Sorted runs in persisted key ranges, read by key.

A run is a folder of parquet files, one (or some, in order) for each range of the key space, each sorted by key in small
row groups. Keys are hashes, so ranges of equal width are even. A lookup opens only the files of the ranges its keys fall
in and decodes only the row groups whose bounds hold one of them: with more row groups than keys, the work follows the
keys and not the runs. Files are never changed; opened footers are kept by the worker process."""

from __future__ import annotations

import re
from collections import OrderedDict

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siltspark.session import list_files

#: Footers that a worker keeps, and bytes of decoded sets.
MOST_OPEN, SET_CACHE = 512, 48 << 20
#: A record's file: its generation and its file's number in it.
PART_BITS = 20
_PART = re.compile(r"part-(\d+)-")
_open: OrderedDict[str, tuple] = OrderedDict()


def key_range(key: Column, ranges: int) -> Column:
    """Number of the range that a key falls in; ranges is a power of two."""
    bits = ranges.bit_length() - 1
    return F.shiftrightunsigned(key.bitwiseXOR(F.lit(-(1 << 63))), 64 - bits).cast("int") if bits else F.lit(0)


def write_run(df: DataFrame, path: str, group_rows: int, file_rows: int = 0) -> None:
    """Write df, which is sorted by key in partitions that are its ranges. file_rows: a range with more rows, a hot
    key's, takes several files."""
    df.write.option("parquet.block.row.count.limit", group_rows).option("maxRecordsPerFile", file_rows).parquet(path)


def run_files(spark: SparkSession, path: str) -> dict:
    """What the state keeps of a run: its files and their bytes."""
    found = [(n, size) for n, size in list_files(spark, path) if n.startswith("part-")]
    return {"path": path, "files": [n for n, _ in found], "bytes": sum(s for _, s in found)}


def part_of(name: str) -> int:
    return int(_PART.match(name)[1])


def _location(path: str) -> tuple:
    path = re.sub(r"^file:/+", "/", path)
    return pafs.FileSystem.from_uri(re.sub(r"^s3[an]:", "s3:", path)) if "://" in path else (pafs.LocalFileSystem(), path)


def _bounds(meta, column: str) -> tuple[np.ndarray, np.ndarray]:
    at = meta.schema.names.index(column)
    stats = [meta.row_group(g).column(at).statistics for g in range(meta.num_row_groups)]
    return np.array([s.min for s in stats], np.int64), np.array([s.max for s in stats], np.int64)


def open_sorted(path: str, column: str) -> tuple:
    """The parquet file and the bounds of a column in its row groups."""
    if path in _open:
        _open.move_to_end(path)
        return _open[path]
    fs, at = _location(path)
    file = pq.ParquetFile(at, filesystem=fs)
    while len(_open) >= MOST_OPEN:
        _open.popitem(last=False)[1][0].close()
    _open[path] = (file, *_bounds(file.metadata, column))
    return _open[path]


class KeyReader:
    """Entries of runs by key, in a worker. rows: those decoded so far."""

    def __init__(self, runs: list[dict], ranges: int, columns: list[str]):
        self.columns, self.rows = columns, 0
        self.shift = 64 - (ranges.bit_length() - 1)
        self.files: dict[int, list[str]] = {}
        for run in runs:
            for name in run["files"]:
                self.files.setdefault(part_of(name), []).append(f"{run['path']}/{name}")

    def find(self, keys: np.ndarray) -> list[pa.Table]:
        """Entries whose key is among keys (int64, sorted, distinct)."""
        spans = (keys.view(np.uint64) ^ np.uint64(1 << 63)) >> np.uint64(self.shift) if self.shift < 64 else np.zeros(len(keys), np.uint64)
        cut = np.flatnonzero(np.r_[True, np.diff(spans) != 0, True]) if len(keys) else []
        out = []
        for lo, hi in zip(cut[:-1], cut[1:]):
            part = keys[lo:hi]
            for path in self.files.get(int(spans[lo]), ()):
                file, low, high = open_sorted(path, "key")
                at = np.searchsorted(part, low)
                groups = np.flatnonzero((at < len(part)) & (part[np.minimum(at, len(part) - 1)] <= high))
                if not len(groups):
                    continue
                table = file.read_row_groups(groups.tolist(), columns=self.columns, use_threads=False)
                self.rows += table.num_rows
                found = table["key"].to_numpy()
                at = np.minimum(np.searchsorted(part, found), len(part) - 1)
                out.append(table.filter(pa.array(part[at] == found)))
        return out

    def arrays(self, keys: np.ndarray) -> list[np.ndarray]:
        """find, as one numpy array a column."""
        found = [t for t in self.find(keys) if t.num_rows]
        return [np.concatenate([t[c].to_numpy() for t in found]) if found else np.zeros(0, np.int64) for c in self.columns]


class SetReader:
    """Packed sets of records by id and place, in a worker. Row groups are kept as long as there is room."""

    def __init__(self, generations: dict[int, str], unpack):
        """generations: the path of a generation's files, with %05d for the number."""
        self.generations, self.unpack = generations, unpack
        self.cache: OrderedDict[tuple, tuple] = OrderedDict()
        self.held = 0

    def _group(self, loc: int, ident: int) -> tuple:
        file, low, _ = open_sorted(self.generations[loc >> PART_BITS] % (loc & ((1 << PART_BITS) - 1)), "id")
        group = int(np.searchsorted(low, ident, "right")) - 1
        if (loc, group) in self.cache:
            self.cache.move_to_end((loc, group))
        else:
            table = file.read_row_group(group, columns=["id", "runs"], use_threads=False)
            self.cache[loc, group] = table["id"].to_numpy(), table["runs"].combine_chunks(), table.nbytes
            self.held += table.nbytes
            while self.held > SET_CACHE and len(self.cache) > 1:
                self.held -= self.cache.popitem(last=False)[1][2]
        return self.cache[loc, group]

    def get(self, ident: int, loc: int) -> np.ndarray:
        ids, runs, _ = self._group(loc, ident)
        return self.unpack(runs[int(np.searchsorted(ids, ident))].as_buffer().to_pybytes())
