"""Deduplicating new batches against all history, exactly and nearly.

Texts are sets of k-word runs; two match if they have at least `similarity` of their union in common. The method is
multi-key sorted neighbourhood: every record has many sort keys, and sorted runs of (key, record) lie in persisted key
ranges (sorted_runs). Per batch:

1. The batch's sets are written, sorted by record.
2. Its distinct fingerprints and whole sets, two kinds of exact keys, are looked up in the exact runs.
3. Each set that is new gives its rarest word runs as keys: by the prefix-filter theorem two sets of n runs that share
   enough must share one of their first n - ceil(similarity n) + 1 runs under any common order, so the window of a
   record, all entries with one of its keys, misses no match. The entries become a sorted run of the index.
4. Only windows around new entries are compared. A wide window first shows its head alone, the smallest record: in a
   cluster of thousands of variants that already is the earliest match. A record that its heads don't settle then meets
   its wide windows up to its best match so far. The places of common keys and their number bound what two sets can
   share; sets are fetched, by place, for the pairs that are left, earliest first and up to the first match.

Nothing scans or shuffles what earlier batches left. Lookups decode only the row groups that hold a key of the batch
(`entries_read` counts their rows): they follow the batch once the runs have more row groups than the batch has keys,
and are at most one pass over the narrow runs (about 30 bytes an entry) below that. Runs are merged by size, so an
entry is rewritten a logarithmic number of times; whenever the index is three times as large, its order of rarity is learned
anew and its entries are made again."""

from __future__ import annotations

import json
import uuid
from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltspark.functions.columns import fingerprint_bytes, sha2_hex
from siltspark.llm.shingles import WIDTH, pack, run_set, unpack
from siltspark.llm.sorted_runs import PART_BITS, KeyReader, SetReader, key_range, part_of, run_files, write_run
from siltspark.session import default_parallelism, list_files, read_bytes, remove_path, scratch_path, write_bytes

#: Cells of the sketch of run counts: the upper 16 bits of a run's hash.
CELL_SHIFT = 8 * WIDTH - 16
CELLS = 1 << 16
#: Earlier entries in a window beyond which a record meets the head before the others.
STAR = 64
#: Rows of a row group of sets, of entries; rows of a file of entries.
SET_ROWS, GROUP_ROWS, FILE_ROWS = 64, 4096, 1 << 22
#: The order of rarity is learned again when the index has grown by that.
RELEARN = 3
#: Entries of wide windows that a worker keeps.
WINDOW_CACHE = 4 << 20
#: Brings a run's hash, and a record's id in the order of matches, to the upper bits of a key.
_KEY_SHIFT, _SPREAD = np.uint64(64 - 8 * WIDTH), 0x9E3779B97F4A7C15
_NONE = np.int64((1 << 63) - 1)
_EXACT = "key long, kind int, check binary, id long, part int, first long, near long"
_NEAR = "key long, id long, near long"
_ENTRY = "key long, id long, n int, place int, loc long"
_PROBE = "id long, part int, n int, x long, m int, xloc long, close boolean, wide boolean, key long, place int"


def _sets(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, fps, data = batch.column(0), batch.column(1), batch.column(2)
            n, whole, runs = [], [], []
            for value in data:
                found = None
                if value.is_valid:
                    try:
                        found = run_set(value.as_buffer().to_pybytes().decode("utf-8"), k)
                    except UnicodeDecodeError:
                        pass
                if found is None or not len(found):
                    n.append(0), whole.append(None), runs.append(None)
                else:
                    packed = pack(found)
                    n.append(len(found)), whole.append(xxhash.xxh3_128_digest(packed)), runs.append(packed)
            yield pa.RecordBatch.from_arrays([ids, fps, pa.array(n, pa.int32()), pa.array(whole, pa.binary()), pa.array(runs, pa.binary())], names=["id", "fp", "n", "whole", "runs"])

    return run


def _sketch(sets: dict[int, str]):
    """Run counts by cell over a partition of records (id, loc), as 64 rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, reader = np.zeros(CELLS, np.int64), SetReader(sets, unpack)
        for batch in batches:
            for ident, loc in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                counts += np.bincount((reader.get(ident, loc) >> np.uint64(CELL_SHIFT)).astype(np.int64), minlength=CELLS)
        yield pa.RecordBatch.from_arrays([pa.array(range(64), pa.int32()), pa.array([c.tobytes() for c in np.split(counts, 64)], pa.binary())], names=["cell", "counts"])

    return run


def _add(pdf):
    import pandas as pd

    total = sum(np.frombuffer(c, np.int64) for c in pdf["counts"])
    return pd.DataFrame({"cell": [int(pdf["cell"].iloc[0])], "counts": [total.tobytes()]})


def _near_key(ids: np.ndarray) -> np.ndarray:
    return (ids.astype(np.uint64) * np.uint64(_SPREAD)).view(np.int64)


def _known(runs: list[dict], nears: list[dict], ranges: int, counter):
    """Batch keys (key, kind, check, id, part) with the first record of each in the exact runs, and what that matches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader, matched = KeyReader(runs, ranges, ["key", "check", "id"]), KeyReader(nears, ranges, ["key", "id", "near"])
        for batch in batches:
            found: dict[tuple, int] = {}
            for t in reader.find(np.unique(batch.column(0).to_numpy())) if runs else ():
                for key, check, ident in zip(*(t[c].to_pylist() for c in reader.columns)):
                    found[key, check] = min(ident, found.get((key, check), ident))
            first = [found.get(x) for x in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist())] if found else [None] * batch.num_rows
            firsts = np.array(sorted({f for f, kind in zip(first, batch.column(1).to_pylist()) if f is not None and kind == 1}), np.int64)
            _, ids, near = matched.arrays(np.unique(_near_key(firsts)))
            near = dict(zip(ids.tolist(), near.tolist()))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(first, pa.int64()), pa.array([near.get(f) for f in first], pa.int64())], names=[*batch.schema.names, "first", "near"])
        counter.add(reader.rows + matched.rows)

    return run


def _entries(sets: dict[int, str], order, tenths: int):
    """The keys of records (id, loc): their rarest runs, by place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rank, reader = np.frombuffer(order.value, np.uint16).astype(np.uint64) << np.uint64(48), SetReader(sets, unpack)
        for batch in batches:
            keys, ns, lengths = [], [], []
            for ident, loc in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                runs = reader.get(ident, loc)
                # tenths / 10 is the similarity; whole numbers keep the bound exact.
                p = len(runs) - (tenths * len(runs) + 9) // 10 + 1
                ranked = np.sort(rank[(runs >> np.uint64(CELL_SHIFT)).astype(np.int64)] | runs)[:p]
                keys.append(ranked << _KEY_SHIFT)
                ns.append(len(runs)), lengths.append(p)
            if keys:
                places = np.concatenate([np.arange(p, dtype=np.int32) for p in lengths])
                columns = np.concatenate(keys).view(np.int64), np.repeat(batch.column(0).to_numpy(), lengths), np.repeat(np.array(ns, np.int32), lengths), places, np.repeat(batch.column(1).to_numpy(), lengths)
                for lo in range(0, len(places), 1 << 16):
                    yield pa.RecordBatch.from_arrays([pa.array(c[lo : lo + (1 << 16)]) for c in columns], names=["key", "id", "n", "place", "loc"])

    return run


def _close(n, i, m, j, tenths: int):
    """Whether two sets of n and m runs whose first common run is at places i and j can share enough."""
    return np.minimum(n - i, m - j) * (10 + tenths) >= (n + m) * tenths


def _fits(n, m, tenths: int):
    return np.minimum(n, m) * 10 >= np.maximum(n, m) * tenths


def _windows(runs: list[dict], ranges: int, generation: int, tenths: int, star: int, counter):
    """What the new entries (sorted by key) meet in their windows: all earlier entries, or the head of a wide window."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = KeyReader(runs, ranges, ["key", "id", "n", "place", "loc"])
        names = [c.split()[0] for c in _PROBE.split(", ")]
        for batch in batches:
            key, ident, n, place, loc = (batch.column(i).to_numpy() for i in range(5))
            keys = np.unique(key)
            wkey, wid, wn, wplace, wloc = reader.arrays(keys)
            slot = np.searchsorted(keys, wkey)
            by = np.lexsort((wid, slot))
            slot, wid, wn, wplace, wloc = slot[by], wid[by], wn[by].astype(np.int64), wplace[by].astype(np.int64), wloc[by]
            every, number = np.unique(np.concatenate([wid, ident]), return_inverse=True)
            own = np.searchsorted(keys, key)
            start = np.searchsorted(slot, own)
            width = np.searchsorted(slot * len(every) + number[: len(wid)], own * len(every) + number[len(wid) :]) - start
            wide = width > star
            shown = np.where(wide, 1, width)
            for lo in range(0, len(key), 2048):
                part = slice(lo, lo + 2048)
                probe = np.repeat(np.arange(len(key))[part], shown[part])
                if not len(probe):
                    continue
                at = start[probe] + np.arange(len(probe)) - np.repeat(np.cumsum(shown[part]) - shown[part], shown[part])
                a, m = n[probe].astype(np.int64), wn[at]
                keep = wide[probe] | _fits(a, m, tenths)
                probe, at, a, m = probe[keep], at[keep], a[keep], m[keep]
                near = _close(a, place[probe].astype(np.int64), m, wplace[at], tenths) & _fits(a, m, tenths)
                columns = ident[probe], (loc[probe] & ((1 << PART_BITS) - 1)).astype(np.int32), a.astype(np.int32), wid[at], m.astype(np.int32), wloc[at], near, wide[probe], np.where(wide[probe], key[probe], 0), np.where(wide[probe], place[probe], 0).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=names)
        counter.add(reader.rows)

    return run


class _Judge:
    """Finds the earliest match of records from what their windows showed, in a worker."""

    def __init__(self, sets: dict[int, str], runs: list[dict], ranges: int, generation: int, tenths: int):
        self.sets, self.index, self.tenths, self.generation = SetReader(sets, unpack), KeyReader(runs, ranges, ["key", "id", "n", "place", "loc"]), tenths, generation
        self.kept: OrderedDict[int, list[np.ndarray]] = OrderedDict()
        self.size = 0

    def _match(self, a: np.ndarray, ident: int, loc: int) -> bool:
        b = self.sets.get(ident, loc)
        common = len(np.intersect1d(a, b, assume_unique=True))
        return 10 * common >= self.tenths * (len(a) + len(b) - common)

    def _window(self, key: int) -> list[np.ndarray]:
        if key in self.kept:
            self.kept.move_to_end(key)
        else:
            self.kept[key] = self.index.arrays(np.array([key], np.int64))[1:]
            self.size += len(self.kept[key][0])
            while self.size > WINDOW_CACHE and len(self.kept) > 1:
                self.size -= len(self.kept.popitem(last=False)[1][0])
        return self.kept[key]

    def _least(self, n, m):
        """Keys that two matching sets share at least: of the runs they share, only those beyond the keys of the one
        whose keys end first can be missing."""
        t = self.tenths
        return -(-(n + m) * t // (10 + t)) - np.maximum((n * t + 9) // 10 - 1, (m * t + 9) // 10 - 1)

    def _tally(self, rec, x, n, m, xloc, close) -> list[np.ndarray]:
        """One row a pair: rec, x, n, m, xloc, whether any common key is close, common keys."""
        by = np.lexsort((x, rec))
        rec, x, n, m, xloc, close = (c[by] for c in (rec, x, n, m, xloc, close))
        lead = np.flatnonzero(np.r_[True, (np.diff(rec) != 0) | (np.diff(x) != 0)]) if len(rec) else np.zeros(0, np.int64)
        any_close = np.logical_or.reduceat(close, lead) if len(lead) else close
        return [c[lead] for c in (rec, x, n, m, xloc)] + [any_close, np.diff(np.r_[lead, len(rec)])]

    def decide(self, t: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """id, near of the records that have an earlier match. t: all rows of some records, as numpy columns."""
        ids, lead, rec = np.unique(t["id"], return_index=True, return_inverse=True)
        own = [self.sets.get(int(i), (self.generation << PART_BITS) | int(p)) for i, p in zip(ids, t["part"][lead])]
        best = np.full(len(ids), _NONE)
        wide, n, m = t["wide"], t["n"].astype(np.int64), t["m"].astype(np.int64)
        narrow = ~wide
        near = [c[narrow] for c in (rec, t["x"], n, m, t["xloc"], t["close"])]
        r, x, a, b, loc, close, count = self._tally(*near)
        # A pair's common keys in wide windows are not among those met here.
        keep = close & (count + np.bincount(rec[wide], minlength=len(ids))[r] >= self._least(a, b))
        heads = wide & t["close"]
        r, x, loc = np.concatenate([r[keep], rec[heads]]), np.concatenate([x[keep], t["x"][heads]]), np.concatenate([loc[keep], t["xloc"][heads]])
        tried: dict[int, set[int]] = {}
        for i in np.lexsort((x, r)):
            who, ident = int(r[i]), int(x[i])
            if best[who] == _NONE and ident not in tried.setdefault(who, set()):
                tried[who].add(ident)
                if self._match(own[who], ident, int(loc[i])):
                    best[who] = ident
        bound = np.minimum(best, ids)
        left = np.flatnonzero(wide & (t["x"] < bound[rec]))
        for who in np.unique(rec[left]).tolist():
            asked = left[rec[left] == who]
            met = [[c[near[0] == who] for c in near[1:]]]
            for i in asked.tolist():
                wid, wn, wplace, wloc = self._window(int(t["key"][i]))
                wn, wplace = wn.astype(np.int64), wplace.astype(np.int64)
                on = (wid < bound[who]) & _fits(n[i], wn, self.tenths)
                met.append([wid[on], np.full(on.sum(), n[i]), wn[on], wloc[on], _close(n[i], int(t["place"][i]), wn[on], wplace[on], self.tenths)])
            x, a, b, loc, close = (np.concatenate(c) for c in zip(*met))
            _, x, a, b, loc, close, count = self._tally(np.zeros(len(x), np.int64), x, a, b, loc, close)
            keep = close & (count >= self._least(a, b)) & (x < bound[who])
            for ident, at in zip(x[keep].tolist(), loc[keep].tolist()):
                if ident not in tried.get(who, ()) and self._match(own[who], ident, at):
                    best[who] = ident
                    break
        hit = best < ids
        return ids[hit], best[hit]


def _nears(sets: dict[int, str], runs: list[dict], ranges: int, generation: int, tenths: int, counter):
    """key, id, near from probes that come sorted by record."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = _Judge(sets, runs, ranges, generation, tenths)
        held: dict[str, np.ndarray] | None = None

        def out(t: dict[str, np.ndarray]) -> pa.RecordBatch:
            ids, near = judge.decide(t)
            return pa.RecordBatch.from_arrays([pa.array(_near_key(ids)), pa.array(ids, pa.int64()), pa.array(near, pa.int64())], names=["key", "id", "near"])

        for batch in batches:
            t = {c: batch.column(i).to_numpy(zero_copy_only=False) for i, c in enumerate(batch.schema.names)}
            if held is not None:
                t = {c: np.concatenate([held[c], v]) for c, v in t.items()}
            # The last record may go on in the next batch.
            cut = int(np.searchsorted(t["id"], t["id"][-1])) if len(t["id"]) else 0
            if cut:
                yield out({c: v[:cut] for c, v in t.items()})
            held = {c: v[cut:] for c, v in t.items()}
        if held is not None and len(held["id"]):
            yield out(held)
        counter.add(judge.index.rows)

    return run


class History:
    """State of all batches admitted so far; the same path and parameters open it again. Batches come in order of their
    ids: a batch's ids are greater than those admitted before. A batch is admitted by one writer; it takes effect with
    the last small file it writes, and one whose driver dies before is as if it never came."""

    def __init__(self, spark: SparkSession, path: str | None = None, k: int = 3, similarity_tenths: int = 7, ranges: int | None = None, compact_every: int = 4, star: int = STAR, group_rows: int = GROUP_ROWS):
        """similarity_tenths: the similarity times ten. ranges: of the key space, a power of two, fixed when the history
        is made. compact_every: runs of similar size that are merged into one. star, group_rows: see STAR, GROUP_ROWS."""
        self.spark, self.k, self.tenths, self.star, self.group_rows = spark, k, similarity_tenths, star, group_rows
        self.compact_every = compact_every
        self.path = path or scratch_path(spark, "history")
        self.order = None
        #: Index rows decoded by lookups of this session.
        self.entries_read = spark.sparkContext.accumulator(0)
        logs = [int(n[:-5]) for n, _ in list_files(spark, f"{self.path}/log") if n.endswith(".json")]
        if logs:
            self.state = json.loads(read_bytes(spark, f"{self.path}/log/{max(logs):012d}.json"))
            if self.state["order"]:
                self.order = spark.sparkContext.broadcast(read_bytes(spark, f"{self.path}/{self.state['order']}"))
        else:
            self.state = {"version": 0, "generation": 0, "ranges": ranges or 1 << (default_parallelism(spark).bit_length() - 1), "sets": {}, "exact": [], "nears": [], "index": [], "order": None, "learned_at": 0}

    # -- small things

    def _commit(self) -> None:
        self.state["version"] += 1
        write_bytes(self.spark, f"{self.path}/log/{self.state['version']:012d}.json", json.dumps(self.state).encode())

    def _sets_of(self) -> dict[int, str]:
        return {int(g): f"{self.path}/{name}" for g, name in self.state["sets"].items()}

    def _runs(self, kind: str) -> list[dict]:
        return [r | {"path": f"{self.path}/{r['path']}"} for r in self.state[kind]]

    def _new_run(self, kind: str, df: DataFrame, sorted_already: bool = False) -> dict:
        name = f"{kind}/{uuid.uuid4().hex}"
        write_run(df if sorted_already else self._sorted(df, "key", "id"), f"{self.path}/{name}", self.group_rows, FILE_ROWS)
        return run_files(self.spark, f"{self.path}/{name}") | {"path": name}

    def _scan(self, run: dict, schema: str) -> DataFrame:
        return self.spark.read.schema(schema).parquet(f"{self.path}/{run['path']}")

    def _learn(self, records: DataFrame) -> None:
        """Learn the order of rarity from the sets of records (id, loc)."""
        parts = records.select("id", "loc").mapInArrow(_sketch(self._sets_of()), "cell int, counts binary").groupBy("cell").applyInPandas(_add, "cell int, counts binary")
        rows = {r["cell"]: r["counts"] for r in parts.collect()}  # 64 rows of 8 KB
        counts = np.concatenate([np.frombuffer(bytes(rows.get(i, bytes(8 * CELLS // 64))), np.int64) for i in range(64)])
        # Counts are ranked on a log scale, so that the order fits in 16 bits at any corpus size.
        ranks = np.minimum(np.log2(counts + 1.0) * 1000, 65535).astype(np.uint16).tobytes()
        self.state["order"] = f"order/{uuid.uuid4().hex}"
        write_bytes(self.spark, f"{self.path}/{self.state['order']}", ranks)
        self.order = self.spark.sparkContext.broadcast(ranks)

    # -- admission

    def admit(self, batch: DataFrame, id: str, fingerprint: str, data: str) -> DataFrame:
        """Add the batch and answer for each of its rows: id, exact, near; the smallest earlier record with the same
        fingerprint, and the smallest earlier one with a matching set (an equal set matches too), each null if none.
        The answers are kept in a table of their own and stay readable.

        The fingerprint is taken from data where it is missing or unreadable. Null, binary or short data (fewer than k
        words) has no set and matches by fingerprint only. ids are unique and not null. Empty batches are fine."""
        g = self.state["generation"] = self.state["generation"] + 1
        folder = f"sets/{g:08d}-{uuid.uuid4().hex}"
        d = F.col(f"`{data}`").cast("binary")
        source = batch.select(F.col(f"`{id}`").cast("long").alias("id"), F.coalesce(fingerprint_bytes(F.col(f"`{fingerprint}`")), F.unhex(sha2_hex(d))).alias("f"), d.alias("data"))
        # Half a hash of the fingerprint stands for it: 128 bits, as for whole sets.
        source = source.select("id", F.unhex(F.substring(F.sha2("f", 256), 1, 32)).alias("fp"), "data")
        sets = source.mapInArrow(_sets(self.k), "id long, fp binary, n int, whole binary, runs binary").sortWithinPartitions("id")
        sets.write.option("parquet.block.row.count.limit", SET_ROWS).parquet(f"{self.path}/{folder}")
        files = [n for n, _ in list_files(self.spark, f"{self.path}/{folder}") if n.startswith("part-")]
        # One task wrote each file, so names differ in their number only.
        self.state["sets"][str(g)] = f"{folder}/part-%05d-{files[0].split('-', 2)[2]}"
        parts = 1 + max(map(part_of, files))
        light = self.spark.read.schema("id long, fp binary, whole binary").parquet(f"{self.path}/{folder}").select("id", "fp", "whole", F.regexp_extract(F.col("_metadata.file_name"), r"part-(\d+)-", 1).cast("int").alias("part"))

        kinds = F.explode(F.array(F.struct(F.lit(0).alias("kind"), F.col("fp").alias("check")), F.struct(F.lit(1).alias("kind"), F.col("whole").alias("check")))).alias("k")
        keyed = light.select("id", "part", kinds).filter("k.check is not null").select(F.xxhash64("k.kind", "k.check").alias("key"), "k.kind", "k.check", F.struct("id", "part").alias("at"))
        # One combinable aggregate: copies that a third of the batch consists of are one row a task.
        firsts = keyed.groupBy("key", "kind", "check").agg(F.min("at").alias("at")).select("key", "kind", "check", "at.id", "at.part")
        found = self._sorted(firsts, "key").mapInArrow(_known(self._runs("exact"), self._runs("nears"), self.state["ranges"], self.entries_read), _EXACT)
        self.state["exact"].append(self._new_run("exact", found, sorted_already=True))
        found = self._scan(self.state["exact"][-1], _EXACT)

        loc = (F.lit(g << PART_BITS).cast("long") + F.col("part")).alias("loc")
        new = found.filter("kind = 1 and first is null").select("id", "part", loc)
        if self.order is None:
            self._learn(new)
        new = new.repartitionById(parts, "part").sortWithinPartitions("id").select("id", "loc")
        self.state["index"].append(self._new_run("index", new.mapInArrow(_entries(self._sets_of(), self.order, self.tenths), _ENTRY)))
        self.state["nears"].append(self._new_run("nears", self._near(self.state["index"][-1], parts)))

        answers = f"{self.path}/answers/{g:08d}-{uuid.uuid4().hex}"
        self._answers(light, found, self._scan(self.state["nears"][-1], _NEAR)).write.parquet(answers)
        self._commit()
        self._compact()
        return self.spark.read.schema("id long, exact long, near long").parquet(answers).select(F.col("id").alias(id), "exact", "near")

    def _sorted(self, df: DataFrame, *order: str) -> DataFrame:
        return df.repartitionById(self.state["ranges"], key_range(F.col("key"), self.state["ranges"])).sortWithinPartitions(*order)

    def _near(self, run: dict, parts: int) -> DataFrame:
        """key, id, near: the smallest record that a new set matches, where that is smaller."""
        g, ranges, runs = self.state["generation"], self.state["ranges"], self._runs("index")
        met = self._scan(run, _ENTRY).mapInArrow(_windows(runs, ranges, g, self.tenths, self.star, self.entries_read), _PROBE)
        met = met.repartitionById(parts, "part").sortWithinPartitions("id")
        return met.mapInArrow(_nears(self._sets_of(), runs, ranges, g, self.tenths, self.entries_read), _NEAR)

    def _answers(self, light: DataFrame, exact: DataFrame, nears: DataFrame) -> DataFrame:
        """id, exact, near of the batch's rows. Rows join with one row a key, so a key with a third of the rows makes a
        skewed side only, which adaptive execution splits; rows without a key get one of their own that nothing has."""
        own = F.encode(F.concat(F.lit("none "), F.lpad(F.col("id").cast("string"), 20, "0")), "UTF-8")
        rows = light.select("id", F.coalesce("fp", own).alias("fp"), F.coalesce("whole", own).alias("whole"))
        by_fp = exact.filter("kind = 0").select(F.col("check").alias("fp"), F.coalesce("first", "id").alias("first"))
        by_set = exact.filter("kind = 1").select("id", F.col("check").alias("whole"), "first", F.col("near").alias("held")).join(nears.select("id", "near"), "id", "left")
        by_set = by_set.select("whole", F.coalesce("first", "id").alias("same"), F.coalesce("held", F.when(F.col("first").isNull(), F.col("near"))).alias("near"))
        rows = rows.join(by_fp, "fp", "left").join(by_set, "whole", "left")
        earlier = lambda c: F.when(F.col(c) < F.col("id"), F.col(c))
        return rows.select("id", earlier("first").alias("exact"), F.coalesce(earlier("near"), earlier("same")).alias("near"))

    # -- compaction

    def _tail(self, runs: list[dict]) -> int:
        """How many of the newest runs to merge: none before there are compact_every of them, then all that are not
        larger than what is newer, so that sizes of the runs left grow in a geometric series."""
        if len(runs) < self.compact_every:
            return 0
        n, total = 1, runs[-1]["bytes"]
        while n < len(runs) and runs[-1 - n]["bytes"] <= 1.1 * total:
            total += runs[-1 - n]["bytes"]
            n += 1
        return n if n > 1 else 0

    def _compact(self) -> None:
        """Merge runs of similar size. If the index is three times as large as when its order was learned, learn it again
        from all its records and make all its entries again."""
        gone, spark = [], self.spark
        for kind, schema, keys in (("exact", _EXACT, ("key", "kind", "check")), ("nears", _NEAR, ("key", "id"))):
            n = self._tail(self.state[kind])
            if n:
                old, kept = self.state[kind][-n:], self.state[kind][:-n]
                rows = spark.read.schema(schema).parquet(*[f"{self.path}/{r['path']}" for r in old])
                if kind == "exact":
                    rows = rows.filter("first is null")  # all others are in an older run
                self.state[kind] = [*kept, self._new_run(kind, rows)]
                gone += old
        size = sum(r["bytes"] for r in self.state["index"])
        n = self._tail(self.state["index"])
        if n and size > RELEARN * self.state["learned_at"]:
            n = len(self.state["index"])
        if n:
            old, kept = self.state["index"][-n:], self.state["index"][:-n]
            rows = spark.read.schema(_ENTRY).parquet(*[f"{self.path}/{r['path']}" for r in old])
            if not kept and size > RELEARN * self.state["learned_at"]:
                # Each record has one entry with place 0; sorted by place, sets are read in the order they lie in.
                records = rows.filter("place = 0").select("id", "loc").repartitionByRange(default_parallelism(spark), "loc", "id").sortWithinPartitions("loc", "id")
                self._learn(records)
                rows = records.mapInArrow(_entries(self._sets_of(), self.order, self.tenths), _ENTRY)
                self.state["learned_at"] = size
            self.state["index"] = [*kept, self._new_run("index", rows)]
            gone += old
        if gone:
            self._commit()
            for run in gone:
                remove_path(spark, f"{self.path}/{run['path']}")
