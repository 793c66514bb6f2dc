"""Segments as a stream: files put together across micro-batches, then ingested."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from siltspark.engine import Engine
from siltspark.operators.store import VersionedTable
from siltspark.session import materialize

FILE = "job_id string, file_path string, content binary"
PROGRESS = "job_id string, current_file string, bytes_processed long, bytes_deduplicated long, message string"


class _Assembler(StatefulProcessor):
    """State of a file: its segments so far, by offset, and what they add up to. It is emitted once the last segment and
    all bytes before it are there; then the state is cleared, so a file sent again is a new version. Bytes are read back
    only when they add up to the end of the file."""

    def __init__(self, ttl_ms: int | None):
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.parts = handle.getMapState("parts", "offset long", "data binary, is_last boolean", self.ttl_ms)
        self.sums = handle.getValueState("sums", "held long, end long", self.ttl_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer) -> Iterator[pd.DataFrame]:
        held, end = self.sums.get() if self.sums.exists() else (0, -1)
        for pdf in rows:
            for offset, data, last in zip(pdf["offset"], pdf["data"], pdf["is_last_segment"]):
                offset, data = int(offset), bytes(data)
                before = self.parts.getValue((offset,)) if self.parts.containsKey((offset,)) else None
                if before is None or len(data) > len(bytes(before[0])) or last and not before[1]:
                    held += len(data) - (len(bytes(before[0])) if before else 0)
                    self.parts.updateValue((offset,), (data, bool(last)))
                if last:
                    end = max(end, offset + len(data))
        self.sums.update((held, end))
        if end < 0 or held < end:
            return
        at, pieces, done = 0, [], False
        for offset, data, last in sorted((k[0], bytes(v[0]), v[1]) for k, v in self.parts.iterator()):
            if offset > at:
                break
            pieces.append(data[at - offset :])
            at = max(at, offset + len(data))
            if last:
                done = True
                break
        if done:
            self.parts.clear()
            self.sums.clear()
            yield pd.DataFrame({"job_id": [key[0]], "file_path": [key[1]], "content": [b"".join(pieces)]})

    def close(self) -> None:
        pass


def assemble(segments: DataFrame, ttl_ms: int | None = None) -> DataFrame:
    """job_id, file_path, content of each file of a segment stream, when its last byte has come. Segments may come in
    any order, twice and interleaved; those without job, path, offset or data are left out. Of two segments at one offset
    the longer one counts. ttl_ms: state of files that got no segment for that long is dropped. Needs the RocksDB state
    store. State is one file's bytes; files beyond 2 GB go through the batch splitter instead."""
    whole = segments.filter(F.col("job_id").isNotNull() & F.col("file_path").isNotNull() & F.col("offset").isNotNull() & F.col("data").isNotNull())
    whole = whole.select("job_id", "file_path", "offset", "data", F.coalesce("is_last_segment", F.lit(False)).alias("is_last_segment"))
    mode = "None" if ttl_ms is None else "ProcessingTime"
    return whole.groupBy("job_id", "file_path").transformWithStateInPandas(statefulProcessor=_Assembler(ttl_ms), outputStructType=FILE, outputMode="Append", timeMode=mode)


def progress_table(engine: Engine) -> VersionedTable:
    """The progress events of an engine's streams. Its folders are never merged, so that a stream can follow them."""
    return VersionedTable(engine.spark, f"{engine.path}/progress", PROGRESS, merge_at=1 << 30)


def record_progress(engine: Engine, files: DataFrame, outcomes: DataFrame, batch: str | None = None) -> None:
    """Append the progress event of each file of a micro-batch; counters go on from the job's events before."""
    events = progress_table(engine)
    before = events.read().groupBy("job_id").agg(F.max("bytes_processed").alias("_b"), F.max("bytes_deduplicated").alias("_d"))
    new = engine.progress(files, outcomes).join(before, "job_id", "left")
    plus = lambda c, base: (F.col(c) + F.coalesce(base, F.lit(0))).alias(c)
    events.append(new.select("job_id", "current_file", plus("bytes_processed", "_b"), plus("bytes_deduplicated", "_d"), "message"), batch)


def progress_stream(engine: Engine) -> DataFrame:
    """Progress events as a stream, as a client receives them, with line: how it would print each."""
    events = engine.spark.readStream.schema(PROGRESS).parquet(f"{engine.path}/progress/commit=*")
    line = F.format_string("[%s] %s (%d bytes processed, %d bytes deduplicated)", "job_id", "message", "bytes_processed", "bytes_deduplicated")
    return events.select(*[c.split()[0] for c in PROGRESS.split(", ")], line.alias("line"))


def ingest_stream(engine: Engine, segments: DataFrame, checkpoint: str, available_now: bool = True, ttl_ms: int | None = None):
    """Start a query that assembles files, ingests each micro-batch into the engine's store and records its progress
    events; a micro-batch that is run again is committed once."""

    def sink(batch: DataFrame, number: int) -> None:
        files = materialize(batch.select("job_id", "file_path", "content"), "micro-batch")
        name = f"{checkpoint}#{number}"
        record_progress(engine, files, engine.ingest(files, batch=name), name)

    writer = assemble(segments, ttl_ms).writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
