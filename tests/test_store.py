import hashlib
from datetime import datetime

import pytest
from conftest import rows
from pyspark.sql import functions as F

from siltspark import Engine, EngineConfig
from siltspark.operators import jobs, store
from siltspark.session import scratch_path
from siltspark.sources.files import SEGMENT_SCHEMA, binary_files, job_end, job_start, random_bytes, segments

FILE = "job_id string, file_path string, content binary"
T0 = datetime(1970, 1, 1)


def files(spark, *items):
    return spark.createDataFrame([(j, p, bytearray(c) if c is not None else None) for j, p, c in items], FILE)


def test_put_and_get(spark):
    s = store.ChunkStore(spark, scratch_path(spark, "t"))
    requests = spark.createDataFrame([("fp1", bytearray(b"abc")), ("", bytearray(b"x")), (None, bytearray(b"x")), ("fp2", None), ("fp3", bytearray()), ("fp1", bytearray(b"abc"))], "fingerprint string, chunk_data binary")
    answers = rows(s.put(requests), "fingerprint", "success", "error_message")
    assert answers.count(("fp1", True, None)) == 2 and sum(not a[1] for a in answers) == 4
    assert {a[2] for a in answers} == {None, "fingerprint is required", "chunk_data is required"}
    got = rows(s.get(spark.createDataFrame([("fp1",), ("nope",), ("",), (None,)], "fingerprint string")), "fingerprint", "found", "size", "error_code")
    assert ("fp1", True, 3, None) in got and ("nope", False, None, None) in got and ("", False, None, "InvalidArgument") in got and (None, False, None, "InvalidArgument") in got
    assert rows(s.exists(spark.createDataFrame([("fp1",), ("no",)], "fingerprint string")), "fingerprint", "exists") == [("fp1", True), ("no", False)]
    assert s.objects().count() == 1
    wrong = store.put_results(spark.createDataFrame([("ab", bytearray(b"abc"))], "fingerprint string, chunk_data binary"), "n", verify=True).first()
    assert wrong["error_message"] == "fingerprint does not match chunk_data"


def test_hash_algorithms_do_not_mix(spark):
    path = scratch_path(spark, "t")
    Engine(spark, path, EngineConfig(hash_alg="sha2")).ingest(files(spark, ("j", "a", b"hello")))
    with pytest.raises(ValueError):
        Engine(spark, path, EngineConfig(hash_alg="blake3"))


def test_commits(spark):
    t = store.VersionedTable(spark, scratch_path(spark, "t"), "a int, b string")
    assert t.read().count() == 0 and t.version() == 0
    t.append(spark.createDataFrame([(1, "x")], "a int, b string"), "one")
    t.append(spark.createDataFrame([(1, "x")], "a int, b string"), "one")
    t.append(spark.createDataFrame([(2, "y")], "a int, b string"))
    assert rows(t.read()) == [(1, "x"), (2, "y")]
    t.replace(t.read().withColumn("b", F.upper("b")))
    assert rows(t.read()) == [(1, "X"), (2, "Y")]
    new = spark.createDataFrame([(2, "z"), (9, "q"), (None, "n")], "a int, b string")
    assert rows(store.update_by_key(t.read(), new, "a")) == [(1, "X"), (2, "z")]


def test_ingest_restore_and_progress(spark):
    body = random_bytes(20000, 1)
    e = Engine(spark, scratch_path(spark, "t"))
    first = files(spark, ("j1", "a", body), ("j1", "b", body), ("j1", "empty", b""), ("j1", "null", None))
    out = e.ingest(first, F.lit(T0), "b1")
    assert out.filter("outcome = 'STORED'").count() * 2 == out.count()
    summary = e.summary(first, out).first()
    assert (summary["files_processed"], summary["bytes_processed"], summary["bytes_deduplicated"]) == (4, 40000, 20000)
    second = files(spark, ("j2", "c", body + b"tail"))
    out2 = e.ingest(second, F.timestamp_seconds(F.lit(100)), "b2")
    assert out2.filter("outcome like '%from DB%'").count() > 0
    e.ingest(second, F.timestamp_seconds(F.lit(200)), "b2")
    assert e.store.chunks.read().count() == e.store.chunks.read().select("fingerprint").distinct().count() == e.store.objects().count()
    assert e.store.chunks.read().filter("last_referenced_time > timestamp'1970-01-01 00:00:50'").count() > 0
    got = {r["file_path"]: bytes(r["content"]) for r in e.restore("j1").collect()}
    assert got == {"a": body, "b": body}
    assert bytes(e.restore("j2", ["c"]).first()["content"]) == body + b"tail"
    sent = e.restore_stream("j2", 7).orderBy("offset").collect()
    assert b"".join(bytes(r["data"]) for r in sent) == body + b"tail" and sent[-1]["is_last_segment"] and sent[0]["restore_job_id"] == "restore-7"
    assert e.store.verify_fingerprints().count() == 0
    assert e.manifest("j2").first()["size"] == 20004


def test_missing_chunk_is_not_silent(spark):
    from siltspark.operators.restore import restore_check, restore_files

    chunks = spark.createDataFrame([("f", 0, 2, "x"), ("f", 2, 2, "y"), ("g", 1, 2, "x"), ("h", 0, 2, "x")], "p string, offset long, size long, fingerprint string")
    objects = spark.createDataFrame([("x", bytearray(b"ab"))], "fingerprint string, chunk_data binary")
    out = restore_files(chunks, objects, ["p"])
    assert rows(out, "p", "complete", "missing_chunks") == [("f", False, 1), ("g", False, 0), ("h", True, 0)]
    originals = spark.createDataFrame([("f", bytearray(b"abcd")), ("h", bytearray(b"ab")), ("e", bytearray())], "p string, content binary")
    assert rows(restore_check(out, originals, ["p"])) == [("e", True), ("f", False), ("h", True)]


def test_jobs_table(spark):
    s = store.ChunkStore(spark, scratch_path(spark, "t"))
    job = spark.createDataFrame([("j1", "c", None, datetime(2024, 1, 1), None, "INITIATED", None, None, None)], store.JOBS)
    s.create_jobs(job)
    with pytest.raises(ValueError):
        s.create_jobs(job)
    s.update_jobs(spark.createDataFrame([("j1", "COMPLETED"), ("j9", "FAILED")], "job_id string, status string"))
    assert rows(s.jobs.read(), "job_id", "status", "client_id") == [("j1", "COMPLETED", "c")]
    states = spark.createDataFrame([("a", 1, "x"), ("a", 3, "y"), ("a", None, "z"), ("b", None, "w")], "job_id string, at int, status string")
    assert rows(store.latest_jobs(states, "at"), "job_id", "status") == [("a", "y"), ("b", "w")]


def test_sessions(spark):
    events = spark.createDataFrame(
        [(1, 1, "SEGMENT", None, 10, None), (1, 2, "START", "a", 20, None), (1, 3, "START", "b", 30, None), (1, 4, "END", "a", 40, "DONE"), (1, 5, "START", "c", 50, None), (1, 6, "END", "c", 5000, "DONE"), (2, 1, "END", "x", 1, "DONE")],
        "stream_id int, seq int, event_type string, backup_job_id string, timestamp long, status string",
    )
    got = rows(jobs.session_violations(events, timeout_s=1800), "stream_id", "seq", "error_code")
    assert got == [(1, 1, "FailedPrecondition"), (1, 3, "AlreadyActive"), (1, 4, "JobMismatch"), (1, 6, "DeadlineExceeded"), (2, 1, "FailedPrecondition")]
    assert ("b", "INITIATED") in rows(jobs.job_status(events), "backup_job_id", "status")


def test_segments_and_files(spark, tmp_path):
    (tmp_path / "x.txt").write_bytes(b"0123456789")
    (tmp_path / "empty").write_bytes(b"")
    found = binary_files(spark, str(tmp_path))
    assert rows(found, "size") == [(10,)]
    cut = segments(found, ["path"], segment_bytes=4).orderBy("offset").collect()
    assert [(r["offset"], bytes(r["data"]), r["is_last_segment"], r["file_size"]) for r in cut] == [(0, b"0123", False, 10), (4, b"4567", False, 10), (8, b"89", True, 10)]
    with pytest.raises(ValueError):
        binary_files(spark, "")
    start = spark.range(1).select(job_start(EngineConfig(), F.lit('a"b'), F.lit(5)).alias("s"), job_end(F.lit("p"), F.lit(3)).alias("e")).first()
    assert start["s"]["backup_job_id"] == "backup-5" and start["s"]["source_details"] == '{"path":"a\\"b"}' and start["e"]["summary"] == "Backed up p in 3 segments"


def test_stream_equals_batch(spark):
    from siltspark.streaming.ingest import ingest_stream
    from siltspark.sources.files import segment_stream

    landing = scratch_path(spark, "landing")
    bodies = {"p%d" % i: random_bytes(1000 * i + 1, i) for i in range(5)}
    cut = segments(files(spark, *[("j", p, b) for p, b in bodies.items()]), ["job_id", "file_path"], segment_bytes=700).withColumn("file_hash", F.lit(None).cast("string")).select(*[f.name for f in SEGMENT_SCHEMA.fields])
    odd = F.floor(F.col("offset") / 700) % 2 == 1
    cut.filter(odd).coalesce(1).write.parquet(landing)
    cut.filter(~odd).unionAll(cut.filter(odd).limit(2)).coalesce(1).write.mode("append").parquet(landing)
    e = Engine(spark, scratch_path(spark, "store"))
    ingest_stream(e, segment_stream(spark, landing, 1), scratch_path(spark, "state")).awaitTermination()
    got = {r["file_path"]: hashlib.sha256(bytes(r["content"])).hexdigest() for r in e.restore("j").collect()}
    assert got == {p: hashlib.sha256(b).hexdigest() for p, b in bodies.items()}
    from siltspark.streaming.ingest import progress_table

    events = progress_table(e).read()
    assert events.count() == len(bodies) and events.agg(F.max("bytes_processed")).first()[0] == sum(map(len, bodies.values()))


def test_resent_files_and_remembered_keys(spark):
    e = Engine(spark, scratch_path(spark, "t"))
    e.ingest(files(spark, ("j", "a", b"one" * 4000), ("j", "b", b"stays")), F.lit(T0), "v1")
    e.ingest(files(spark, ("j", "a", b"another, shorter")), F.lit(T0), "v2")
    assert {r["file_path"]: bytes(r["content"]) for r in e.restore("j").collect()} == {"a": b"another, shorter", "b": b"stays"}
    assert rows(e.versions("j"), "file_path", "version", "size") == [("a", 1, 12000), ("a", 2, 16), ("b", 1, 5)]
    assert bytes(e.restore("j", ["a"], version=1).first()["content"]) == b"one" * 4000
    lru = Engine(spark, scratch_path(spark, "t"), EngineConfig(mode="lru", lru_capacity=2))
    first = lru.ingest(files(spark, ("j", "a", b"x"), ("j", "b", b"y"), ("j", "c", b"z")))
    assert rows(first, "file_path", "outcome") == [("a", "STORED"), ("b", "STORED"), ("c", "STORED")]
    again = lru.ingest(files(spark, ("k", "a", b"z"), ("k", "b", b"x")))
    assert rows(again, "file_path", "outcome") == [("a", "DEDUPLICATED"), ("b", "STORED")]


def test_blake3_store_verifies_with_its_own_hash(spark):
    e = Engine(spark, scratch_path(spark, "t"), EngineConfig(hash_alg="blake3"))
    e.ingest(files(spark, ("j", "a", b"hello")), F.lit(T0))
    assert bytes(e.restore("j").first()["content"]) == b"hello" and e.store.verify_fingerprints().count() == 0
    wrong = store.put_results(spark.createDataFrame([("ab", bytearray(b"abc"))], "fingerprint string, chunk_data binary"), "n", True, "blake3").first()
    assert not wrong["success"]


def test_many_commits_stay_one_scan(spark):
    t = store.VersionedTable(spark, scratch_path(spark, "t"), "a int, b string", ["b"], merge_at=4)
    for i in range(14):
        t.append(spark.createDataFrame([(i, "05")], "a int, b string"))
    assert rows(t.read()) == sorted(((i, "05") for i in range(14)), key=repr)
    assert len(t.entry()["folders"]) <= 6 and t.read()._jdf.queryExecution().executedPlan().toString().count("FileScan") == 1
    assert t.vacuum() > 0 and t.read().count() == 14


def test_touches_and_job_defaults(spark):
    s = store.ChunkStore(spark, scratch_path(spark, "t"))
    out = spark.createDataFrame([("f1", 3, "STORED", 1), ("f2", 4, "STORED", 2), ("f1", 3, "DEDUPLICATED", 3)], "fingerprint string, size long, outcome string, n int")
    s.insert_chunks(out, ["n"], F.timestamp_seconds(F.lit(10)))
    s.touch(out, F.timestamp_seconds(F.lit(99)))
    seen = lambda: rows(s.metadata().select("fingerprint", F.unix_seconds("last_referenced_time").alias("t")))
    assert seen() == [("f1", 99), ("f2", 10)]
    s.fold_touches()
    assert seen() == [("f1", 99), ("f2", 10)] and s.touches.read().count() == 0
    s.create_jobs(spark.createDataFrame([("a", "c1", "FAILED"), ("b", "c2", "FAILED")], "job_id string, client_id string, status string"), F.timestamp_seconds(F.lit(7)))
    assert rows(s.find_jobs(status="FAILED", client_id="c1").select("job_id", F.unix_seconds("start_time"))) == [("a", 7)]
    assert s.exists(spark.createDataFrame([(None,), ("f1",)], "fingerprint string")).filter("exists").count() == 0


def test_command_line(spark, tmp_path, monkeypatch):
    from siltspark import cli

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "x.bin").write_bytes(random_bytes(9000, 3))
    monkeypatch.setenv("SILTSPARK_STORE", f"file://{tmp_path}/store")
    done = cli.run(spark, cli.parser().parse_args(["backup", "--file", str(tmp_path / "in"), "--job", "j1"]))
    assert (done["files_processed"], done["bytes_processed"]) == (1, 9000)
    done = cli.run(spark, cli.parser().parse_args(["restore", "--job", "j1", "--to", f"file://{tmp_path}/out"]))
    assert done["restored"] == 1 and done["incomplete"] == 0
    assert bytes(spark.read.parquet(f"file://{tmp_path}/out").first()["content"]) == random_bytes(9000, 3)
    assert EngineConfig.from_env({"NODE_ID": "n7", "SILTSPARK_STORE": "p"}, mode="lru") == EngineConfig(node_id="n7", store_path="p", mode="lru")
