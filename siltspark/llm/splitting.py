"""Splitting oversized files at natural boundaries, content-defined.

Segments are put together by position, then cut where a rolling hash of the bytes says so, each such landmark moved to
the nearest natural boundary; an edit changes the pieces around it and leaves the others as they were.

A file may be any size. Sparse landmarks, one in some 64 KiB, are joints: wherever one lies, a piece ends, so what
lies between two joints is cut the same whatever comes before or after. A file is handled in windows of WINDOW bytes.
A window cuts the stretches that begin at joints inside it, up to the first joint of the next window, which it sees
too, so windows are cut independently and the pieces still join. Only a window without any joint (long repetitions)
begins at its first landmark instead. Within a partition windows come one after the other and only one is held."""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes of a window, and what it sees before it and after it: the next window, and enough to place joints in that.
WINDOW, BEFORE, AFTER = 1 << 20, 1 << 16, (1 << 20) + (1 << 16)
#: A joint is a place where that many bits of the rolling hash are zero, that far from another before it.
JOINT_BITS, JOINT_GAP = 16, 1 << 14
#: Bytes that the rolling hash looks at.
REACH = 32
_GEAR = np.random.default_rng(20240101).integers(0, 1 << 63, 256, dtype=np.int64).astype(np.uint64)

_SCHEMA = "job_id string, file_path string, offset long, size long, repeated long, cut string, data binary"


@dataclass(frozen=True)
class SplitRule:
    """limit: most bytes of a piece. overlap: bytes of the piece before it that a piece repeats (up to three more
    where that would fall inside a character). least: fewest new bytes of a piece that isn't the last of its stretch.
    bits: a landmark is a place where that many bits of the rolling hash are zero. near: how far a landmark is moved to
    a strong boundary (paragraph, line, sentence) before a weaker one (word) is taken."""

    limit: int = 8192
    overlap: int = 256
    least: int = 2048
    bits: int = 12
    near: int = 512

    def __post_init__(self) -> None:
        if not 0 <= self.overlap <= min(self.limit // 4, 2048) or not 1 <= self.least <= self.limit // 2 or self.limit < 64:
            raise ValueError("need overlap <= limit / 4 and <= 2048, 1 <= least <= limit / 2, limit >= 64")


def rolling_hash(data: np.ndarray) -> np.ndarray:
    """At every byte, a hash of it and the 31 before it (fewer at the start), by doubling the reach five times."""
    h = _GEAR[data]
    width = 1
    while width < REACH:
        grown = h.copy()
        grown[width:] += h[:-width] << np.uint64(width)
        h, width = grown, 2 * width
    return h


def _at(n: int, *hits: np.ndarray) -> np.ndarray:
    """Sorted distinct positions within 1..n-1."""
    every = np.unique(np.concatenate(hits)) if hits else np.zeros(0, np.int64)
    return every[(every > 0) & (every < n)]


class Boundaries:
    """Places before which a text may be cut, by strength: 0 paragraph, 1 line, 2 sentence, 3 word, 4 character."""

    NAMES = ("paragraph", "line", "sentence", "word", "character")

    def __init__(self, b: np.ndarray):
        n = len(b)
        pad = np.concatenate([b, np.zeros(4, np.uint8)])
        b1, b2, b3 = pad[1 : n + 1], pad[2 : n + 2], pad[3 : n + 3]
        inner = (b & 0xC0) == 0x80
        # More than three continuation bytes in a row are no character; there any place may be a cut.
        if inner.any():
            run = inner & np.r_[False, inner[:-1]] & np.r_[False, False, inner[:-2]] & np.r_[False, False, False, inner[:-3]]
            inner &= ~run
        joined = inner.copy()
        # Marks that belong to the character before them: combining marks, joiners, variation selectors, skin tones.
        joined |= (b == 0xCC) & (b1 >= 0x80) | (b == 0xCD) & (b1 >= 0x80) & (b1 <= 0xAF)
        zwj = (b == 0xE2) & (b1 == 0x80) & (b2 == 0x8D)
        joined |= zwj | (b == 0xEF) & (b1 == 0xB8) & (b2 >= 0x80) & (b2 <= 0x8F)
        joined |= (b == 0xF0) & (b1 == 0x9F) & (b2 == 0x8F) & (b3 >= 0xBB) & (b3 <= 0xBF)
        after = np.flatnonzero(zwj) + 3
        joined[after[after < n]] = True
        crlf = (b == 10) & np.r_[False, b[:-1] == 13]
        joined |= crlf
        free = ~joined
        keep = lambda at: at[free[at]] if len(at) else at
        newline = (b == 10) | (b == 13)
        line = np.flatnonzero(newline) + 1
        line = np.concatenate([line, np.flatnonzero((b == 0xE2) & (b1 == 0x80) & ((b2 == 0xA8) | (b2 == 0xA9))) + 3])
        line = keep(_at(n, line))
        # An empty line before the cut: the line break follows another, with nothing but blanks between.
        blank = newline | (b == 32) | (b == 9)
        last_ink = np.maximum.accumulate(np.where(blank, -1, np.arange(n)))
        breaks = np.cumsum((b == 10) | ((b == 13) & (b1 != 10)))
        held = breaks[line - 1] - np.where(last_ink[line - 1] >= 0, breaks[np.maximum(last_ink[line - 1], 0)], 0)
        paragraph = line[held >= 2]
        space = (b == 32) | (b == 9)
        stop = (b == 46) | (b == 33) | (b == 63)
        ended = np.r_[False, stop[:-1]] & space | np.r_[False, False, stop[:-2]] & np.r_[False, np.isin(b[:-1], (34, 39, 41))] & space
        sentence = np.flatnonzero(ended) + 1
        wide = (b == 0xE3) & (b1 == 0x80) & (b2 == 0x82) | (b == 0xEF) & (b1 == 0xBC) & ((b2 == 0x81) | (b2 == 0x9F))
        wide |= (b == 0xE0) & (b1 == 0xA5) & (b2 == 0xA4) | (b == 0xEF) & (b1 == 0xBD) & (b2 == 0xA1)
        sentence = keep(_at(n, sentence, np.flatnonzero(wide) + 3))
        arabic = np.flatnonzero((b == 0xD8) & (b1 == 0x9F)) + 2
        blanks = [np.flatnonzero(space) + 1, np.flatnonzero((b == 0xC2) & (b1 == 0xA0)) + 2]
        blanks.append(np.flatnonzero((b == 0xE3) & (b1 == 0x80) & ((b2 == 0x80) | (b2 == 0x81)) | (b == 0xEF) & (b1 == 0xBC) & (b2 == 0x8C) | (b == 0xE2) & (b1 == 0x80) & (((b2 >= 0x80) & (b2 <= 0x8A)) | (b2 == 0x8B))) + 3)
        word = keep(_at(n, *blanks))
        self.strong = np.sort(np.concatenate([line, keep(_at(n, sentence, arabic))]))
        self.strong = np.unique(self.strong)
        self.by_class = [paragraph, line, keep(_at(n, sentence, arabic)), word, np.flatnonzero(free)]
        self.lists = [x.tolist() for x in (self.strong, word)]
        self.paragraphs = paragraph.tolist()
        self.free, self.inner = free, inner

    def name(self, at: int) -> str:
        for name, places in zip(self.NAMES, self.by_class):
            i = np.searchsorted(places, at)
            if i < len(places) and places[i] == at:
                return name
        return "byte"

    def head(self, at: int) -> int:
        """The last place not inside a character among `at` and the three before it."""
        for free in (self.free, ~self.inner):
            for p in range(at, max(at - 4, -1), -1):
                if free[p]:
                    return p
        return at

    def character(self, at: int, low: int) -> int:
        """The last place at or before `at`, above low, that is not inside a character."""
        for free in (self.free, ~self.inner):
            for p in range(at, max(low, at - 64), -1):
                if free[p]:
                    return p
        return at


def _nearest(places: list[int], at: int, low: int, high: int) -> int | None:
    """The place within [low, high] nearest to `at`; the earlier one of two."""
    i, lo, hi = bisect_left(places, at), bisect_left(places, low), bisect_right(places, high)
    near = [places[j] for j in (i - 1, i) if lo <= j < hi]
    return min(near, key=lambda p: (abs(p - at), p)) if near else None


def cut_places(b: np.ndarray, start: int, end: int, rule: SplitRule, marks: np.ndarray, bounds: Boundaries, first: bool) -> list[int]:
    """Ends of the pieces of b[start:end]. first: nothing is repeated by the first piece."""
    out = []
    landmarks = marks.tolist()
    strong, word = bounds.lists
    room = rule.limit - rule.overlap - 3
    s = start
    while s < end:
        most = rule.limit if first and s == start else room
        if end - s <= most:
            out.append(end)
            break
        # Not so far that a last piece of less than the least size is left.
        low, high = s + rule.least, max(s + rule.least, min(s + most, end - rule.least))
        i = bisect_left(landmarks, low)
        mark = landmarks[i] if i < len(landmarks) and landmarks[i] <= high else None
        cut = None
        if mark is not None:
            within = max(low, mark - rule.near), min(high, mark + rule.near)
            cut = _nearest(bounds.paragraphs, mark, *within)
            cut = cut if cut is not None else _nearest(strong, mark, *within)
            cut = cut if cut is not None else _nearest(word, mark, low, high)
            cut = cut if cut is not None else _nearest(strong, mark, low, high)
        if cut is None:
            for places in (strong, word):
                j = bisect_right(places, high) - 1
                if j >= 0 and places[j] >= low:
                    cut = places[j]
                    break
        if cut is None:
            # No natural place at all between the bounds: below the least size there may still be one.
            for places in (strong, word):
                j = bisect_right(places, high) - 1
                if j >= 0 and places[j] > s:
                    cut = places[j]
                    break
        out.append(cut if cut is not None else bounds.character(mark if mark is not None else high, s))
        s = out[-1]
    return out


class _Window:
    """The bytes of one window as segments arrive, earliest segment first; a byte keeps its first content."""

    def __init__(self, file: tuple, number: int):
        self.file, self.number = file, number
        self.low = max(0, number * WINDOW - BEFORE)
        self.data = np.zeros(0, np.uint8)
        self.there = np.zeros(0, bool)

    def put(self, offset: int, data: np.ndarray) -> None:
        at = offset - self.low
        need = at + len(data)
        if need > len(self.data):
            grow = max(need, min(2 * len(self.data), BEFORE + WINDOW + AFTER)) - len(self.data)
            self.data, self.there = np.concatenate([self.data, np.zeros(grow, np.uint8)]), np.concatenate([self.there, np.zeros(grow, bool)])
        new = ~self.there[at:need]
        self.data[at:need][new] = data[new]
        self.there[at:need] = True

    def _anchor(self, at: int, marks: np.ndarray, run_end: int, bounds: Boundaries) -> int:
        """Where a window without joints that starts at `at` begins to cut: at the first landmark after the hash's reach,
        snapped forward, else at the first character."""
        high = min(run_end, at + (1 << 16) - 1024)
        i = np.searchsorted(marks, at + REACH)
        if i < len(marks) and marks[i] < high:
            mark = int(marks[i])
            for places in bounds.lists:
                j = bisect_left(places, mark)
                if j < len(places) and places[j] <= min(high, mark + 512):
                    return places[j]
            at = mark
        for p in range(at, min(at + 64, run_end)):
            if bounds.free[p]:
                return p
        return at

    def _joints(self, hashes: np.ndarray, begins: int, ends: int, bounds: Boundaries, rule: SplitRule) -> list[int]:
        """Joints of a run, each at the nearest natural boundary. begins, ends: where the run does, -1 if it goes on."""
        raw = np.flatnonzero(hashes >> np.uint64(64 - JOINT_BITS) == 0) + 1
        gap = max(JOINT_GAP, 2 * rule.limit)
        before = np.r_[begins if begins >= 0 else -gap, raw[:-1]] if len(raw) else raw
        raw = raw[(raw - before >= gap) & ((raw + gap <= ends) if ends >= 0 else True)]
        out = []
        for mark in raw.tolist():
            within = mark - rule.near, min(mark + rule.near, len(hashes) - 1)
            cut = _nearest(bounds.paragraphs, mark, *within)
            for places in bounds.lists:
                cut = cut if cut is not None else _nearest(places, mark, *within)
            out.append(cut if cut is not None else bounds.character(mark, mark - rule.near))
        return out

    def pieces(self, rule: SplitRule) -> Iterator[tuple]:
        edge = np.flatnonzero(np.diff(np.r_[False, self.there, False]))
        start, stop = self.number * WINDOW - self.low, (self.number + 1) * WINDOW - self.low
        for lo, hi in zip(edge[::2], edge[1::2]):
            if hi <= start or lo >= stop:
                continue
            run = self.data[lo:hi]
            if start <= lo < stop and hi <= stop and hi - lo <= rule.limit:
                yield int(self.low + lo), int(hi - lo), 0, "end", run.tobytes()
                continue
            bounds = Boundaries(run)
            # The hash is taken from the run's own bytes; marks follow the byte that completes them.
            hashes = rolling_hash(run)
            marks = np.flatnonzero(hashes >> np.uint64(64 - rule.bits) == 0) + 1
            # A run that reaches the edge of what the window sees goes on there.
            begun = lo >= start or self.number == 0
            goes_on = hi >= stop + AFTER
            joints = self._joints(hashes, 0 if lo > 0 or self.number == 0 else -1, -1 if goes_on else len(run), bounds, rule)

            def of_window(low: int, high: int) -> list[int]:
                """Joints in the window [low, high), both relative to the run; one without any has its anchor."""
                found = [j for j in joints if low <= j < high]
                return found or ([self._anchor(low, marks, len(run), bounds)] if 0 < low and high <= len(run) else [])

            own, after = of_window(start - lo, stop - lo), of_window(stop - lo, stop - lo + WINDOW)
            heads = ([0] if begun else []) + [j for j in own if j > 0]
            last = after[0] if after else len(run)
            for first, end_at in zip(heads, [*heads[1:], last]):
                at = first
                for end in cut_places(run, first, end_at, rule, marks, bounds, begun and first == 0):
                    head = at if at == 0 and begun else bounds.head(max(0, at - rule.overlap))
                    yield int(self.low + lo + head), int(end - head), int(at - head), "end" if end == len(run) and not goes_on else bounds.name(end), run[head:end].tobytes()
                    at = end


def split_files(segments: DataFrame, rule: SplitRule | None = None, with_data: bool = True) -> DataFrame:
    """Pieces of all files put together from their segments: job_id, file_path, offset (of the piece in the file), size,
    repeated (bytes at its start that the piece before it ends with), cut (what it ends at: paragraph, line, sentence,
    word, character, byte where there is no character, or end of a stretch), data.

    segments: segment_no, job_id, file_path, offset, data. Pieces of one file cover every byte that some segment
    covers; without their repeated bytes they do so once. A byte covered by several segments has the content of the
    one with the smallest segment_no. Where bytes are lost a stretch ends: no piece spans a gap. Segments without
    data, offset, job_id or file_path cannot be placed and give nothing; file_size, is_last_segment and order of arrival play
    no part. Files below the limit come out as one piece a stretch."""
    rule = rule or SplitRule()
    size = F.length("data")
    placed = segments.select("segment_no", "job_id", "file_path", "offset", "data").filter((size > 0) & (F.col("offset") >= 0) & F.col("job_id").isNotNull() & F.col("file_path").isNotNull())
    first = F.greatest(F.lit(0).cast("long"), F.floor((F.col("offset") - AFTER) / WINDOW))
    last = F.floor((F.col("offset") + size + BEFORE - 1) / WINDOW)
    spread = placed.withColumn("window", F.explode(F.sequence(first, last)))
    low, high = F.greatest(F.col("offset"), F.col("window") * WINDOW - BEFORE), F.least(F.col("offset") + size, (F.col("window") + 1) * WINDOW + AFTER)
    spread = spread.filter(high > low).select("job_id", "file_path", "window", "segment_no", low.alias("at"), F.substring(F.col("data"), (low - F.col("offset") + 1).cast("int"), (high - low).cast("int")).alias("data"))
    keys = ["job_id", "file_path", "window"]
    # Segments of a window come together; a window is all that a task holds at a time.
    ordered = spread.repartition(*keys).sortWithinPartitions(*keys, "segment_no", "at")
    names = ["job_id", "file_path", "offset", "size", "repeated", "cut", "data"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: _Window | None = None
        rows: list[tuple] = []

        def flush() -> pa.RecordBatch:
            columns = list(zip(*rows))
            types = [pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
            out = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=names)
            rows.clear()
            return out

        def close() -> None:
            if held is not None:
                rows.extend((*held.file, o, n, r, c, d if with_data else None) for o, n, r, c, d in held.pieces(rule))

        for batch in batches:
            jobs, paths, windows, ats = (batch.column(i).to_pylist() for i in (0, 1, 2, 4))
            for job, path, window, at, value in zip(jobs, paths, windows, ats, batch.column(5)):
                if held is None or held.file != (job, path) or held.number != window:
                    close()
                    held = _Window((job, path), window)
                    if len(rows) >= 512:
                        yield flush()
                held.put(at, np.frombuffer(value.as_buffer(), np.uint8))
        close()
        if rows:
            yield flush()

    return ordered.mapInArrow(run, _SCHEMA)


def oversized(pieces: DataFrame, limit: int = 8192) -> DataFrame:
    """job_id, file_path, covered: the files whose pieces cover more than limit bytes, each byte once."""
    covered = pieces.groupBy("job_id", "file_path").agg(F.sum(F.col("size") - F.col("repeated")).alias("covered"))
    return covered.filter(F.col("covered") > limit)
