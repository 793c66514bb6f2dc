"""SQL for DuckDB that gives the same rows as the core queries."""

from __future__ import annotations

#: The digits of a fingerprint, for a column {0}.
KEY = "(SELECT CASE WHEN len(l) = 1 THEN l[1] END FROM (SELECT list_filter(regexp_extract_all(lower({0}), '[0-9a-f]+'), lambda x: length(x) = 64) AS l))"

FILES = "files AS (SELECT doc_id AS file_id, coalesce(source, '(none)') AS job, coalesce(text, '') AS text FROM documents)"


def _chunk_cte(source: str, name: str = "c", least: int = 64, most: int = 8192) -> str:
    """CTEs ending in `name`: k, idx, off, size, fp of the chunks of source (k, h: the bytes in hex)."""
    return f"""
{name}_b AS (SELECT k, h, length(h) // 2 AS n FROM {source}),
{name}_e AS (SELECT k, list(e ORDER BY e) es FROM (SELECT k, h, unnest(range(4, n + 1)) e FROM {name}_b WHERE contains(h, '0A0A0A0A') OR contains(h, '00000000'))
  WHERE substr(h, 2 * (e - 4) + 1, 8) IN ('00000000', 'FFFFFFFF', '0A0A0A0A') GROUP BY k),
{name}_s AS (SELECT k, n, coalesce(es, []::BIGINT[]) es FROM {name}_b LEFT JOIN {name}_e USING (k)),
{name}_w AS (SELECT k, n, es, -1::BIGINT idx, 0::BIGINT off, 0::BIGINT nxt FROM {name}_s
  UNION ALL
  SELECT k, n, es, idx + 1, nxt, CASE WHEN n - nxt < {least} THEN n
    ELSE coalesce(list_min(list_filter(es, lambda e: e >= nxt + {least} AND e < nxt + least({most}, n - nxt))), nxt + least({most}, n - nxt)) END
  FROM {name}_w WHERE nxt < n),
{name} AS (SELECT {name}_w.k, idx, off, nxt - off AS size, sha256(unhex(substr(h, 2 * off + 1, 2 * (nxt - off)))) fp FROM {name}_w JOIN {name}_b USING (k) WHERE idx >= 0)"""


#: The chunks of the documents: job, k, idx, off, size, fp; and pos, the place in the order of jobs, files and chunks.
CHUNKS = f"WITH RECURSIVE {FILES}, src AS (SELECT file_id AS k, hex(encode(text)) AS h FROM files), {_chunk_cte('src')}, d AS (SELECT f.job, c.*, row_number() OVER (ORDER BY f.job, c.k, c.idx) AS pos FROM c JOIN files f ON f.file_id = c.k)"
OUTCOMES = CHUNKS + ", o AS (SELECT *, CASE WHEN row_number() OVER (PARTITION BY fp ORDER BY pos) = 1 THEN 'STORED' ELSE 'DEDUPLICATED' END AS outcome FROM d)"
PER_FILE = OUTCOMES + """, p AS (SELECT f.job, f.file_id, count(o.k) AS chunks, coalesce(sum(o.size), 0) AS b, coalesce(sum(o.size) FILTER (outcome <> 'STORED'), 0) AS dup
FROM files f LEFT JOIN o ON o.k = f.file_id GROUP BY ALL)"""
WEAK = "list_sum(list_transform(range(1, length(fp) + 1), lambda i: ascii(substr(fp, i::BIGINT, 1)) * i))"
FIRSTS = CHUNKS + f", u AS (SELECT fp, min(pos) AS pos, arg_min(k, pos) AS k FROM d GROUP BY fp), h AS (SELECT fp, pos, k, ({WEAK})::BIGINT AS w FROM u), s AS (SELECT w % 2500 AS bucket, arg_max(w, pos) AS slot, max(pos) AS last FROM h GROUP BY 1)"


EVENTS = """WITH e AS (SELECT user_id % 50 AS stream_id, event_id AS seq, CASE event_id % 7 WHEN 0 THEN 'START' WHEN 1 THEN 'END' ELSE 'SEGMENT' END AS event_type, 'job-' || (event_id % 5) AS job, floor(epoch(ts))::BIGINT AS t,
  CASE WHEN event_id % 2 = 0 THEN 'COMPLETED' ELSE 'FAILED' END AS status FROM events)"""
FIRST_CHUNKS = f"""WITH c AS (SELECT {KEY.format('fingerprint')} AS fp, * EXCLUDE (fingerprint) FROM chunks), f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY fp
  ORDER BY creation_time NULLS FIRST, size NULLS FIRST, storage_location NULLS FIRST, last_referenced_time NULLS FIRST) AS rn FROM c WHERE fp IS NOT NULL) WHERE rn = 1)"""
#: Caches that evict nothing: a key is held from its put to its removal or a clear; a filter slot holds the last put's hash.
CACHE = f"""WITH e AS (SELECT user_id % 50 AS cache, event_id AS seq, CASE WHEN event_id % 101 = 0 THEN 'clear' WHEN event_id % 13 = 0 THEN 'remove' WHEN event_id % 7 = 0 THEN 'contains' WHEN event_id % 11 = 0 THEN 'size' WHEN event_id % 2 = 0 THEN 'put' ELSE 'get' END AS op,
  'k' || ((event_id * 7 + event_id // 8) % 23) AS key FROM events),
h AS (SELECT *, ({WEAK.replace('fp', 'key')})::BIGINT AS h, coalesce(sum(CASE WHEN op = 'clear' THEN 1 ELSE 0 END) OVER (PARTITION BY cache ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS epoch FROM e),
b AS (SELECT *, last_value(CASE op WHEN 'put' THEN 1 WHEN 'remove' THEN 0 END IGNORE NULLS) OVER (PARTITION BY cache, epoch, key ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS held,
  last_value(CASE op WHEN 'put' THEN struct_pack(h := h, seq := seq) END IGNORE NULLS) OVER (PARTITION BY cache, h % 2500 ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS slot,
  last_value(CASE op WHEN 'remove' THEN seq END IGNORE NULLS) OVER (PARTITION BY cache, h ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS gone FROM h),
d AS (SELECT *, CASE WHEN op = 'put' AND coalesce(held, 0) = 0 THEN 1 WHEN op = 'remove' AND held = 1 THEN -1 ELSE 0 END AS step FROM b),
s AS (SELECT *, coalesce(sum(step) OVER (PARTITION BY cache, epoch ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS n FROM d)
SELECT cache, seq, op, key, CASE WHEN op IN ('get', 'remove') THEN coalesce(held, 0) WHEN op = 'size' THEN n WHEN op = 'contains' THEN CASE WHEN slot.h = h AND (gone IS NULL OR gone < slot.seq) THEN 1 ELSE 0 END END::BIGINT AS answer FROM s"""


def _scalar(node: str, field: str) -> str:
    """A string's content or a number's text."""
    return f"CASE json_type({node}, '$.{field}') WHEN 'NULL' THEN 'null' WHEN 'OBJECT' THEN NULL WHEN 'ARRAY' THEN NULL ELSE json_extract_string({node}, '$.{field}') END"


#: The files of the listings by job and state of its text, numbered in order of appearance: the places of keys and elements on the way to a file.
LISTED = """WITH RECURSIVE raw AS (SELECT DISTINCT job_id, md5(files_metadata) AS state, files_metadata AS t FROM backup_jobs WHERE files_metadata IS NOT NULL AND json_valid(files_metadata)),
once AS (SELECT job_id, state, CASE WHEN json_type(t) = 'VARCHAR' THEN json_extract_string(t, '$') ELSE t END AS t FROM raw),
doc AS (SELECT job_id, state, t::JSON AS j FROM once WHERE json_valid(t)),
tree AS (SELECT job_id, state, [list_position(json_keys(j), 'tree')] AS way, json_extract_string(j, '$.tree.name') AS path, json_extract(j, '$.tree') AS f FROM doc WHERE json_type(j) = 'OBJECT' AND json_type(j, '$.tree') = 'OBJECT'
  UNION ALL SELECT job_id, state, way || [place, n], path || '/' || json_extract_string(s, '$.name'), s FROM (SELECT job_id, state, way, path, list_position(json_keys(f), 'folders') AS place, unnest(from_json(json_extract(f, '$.folders'), '["JSON"]')) AS s, generate_subscripts(from_json(json_extract(f, '$.folders'), '["JSON"]'), 1) AS n FROM tree WHERE json_type(f, '$.folders') = 'ARRAY')),
lists AS (SELECT job_id, state, CASE WHEN json_type(j) = 'ARRAY' THEN 0 ELSE list_position(json_keys(j), 'files') END AS place, from_json(CASE WHEN json_type(j) = 'ARRAY' THEN j ELSE json_extract(j, '$.files') END, '["JSON"]') AS l FROM doc WHERE json_type(j) = 'ARRAY' OR json_type(j) = 'OBJECT' AND json_type(j, '$.files') = 'ARRAY'),
listed AS (SELECT job_id, state, place, unnest(l) AS f, generate_subscripts(l, 1) AS n FROM lists),
maps AS (SELECT job_id, state, list_position(json_keys(j), 'files') AS place, map_entries(json_extract(j, '$.files')::MAP(VARCHAR, JSON)) AS l FROM doc WHERE json_type(j) = 'OBJECT' AND json_type(j, '$.files') = 'OBJECT'),
named AS (SELECT job_id, state, place, unnest(l) AS m, generate_subscripts(l, 1) AS n FROM maps),
found AS (SELECT job_id, state, [place, n] AS way, json_extract_string(f, '$.path') AS file_path, f FROM listed
  UNION ALL SELECT job_id, state, [place, n], m.key, m.value FROM named
  UNION ALL SELECT job_id, state, way || [place, n], path || '/' || json_extract_string(s, '$.name'), s FROM (SELECT job_id, state, way, path, list_position(json_keys(f), 'files') AS place, unnest(from_json(json_extract(f, '$.files'), '["JSON"]')) AS s, generate_subscripts(from_json(json_extract(f, '$.files'), '["JSON"]'), 1) AS n FROM tree WHERE json_type(f, '$.files') = 'ARRAY')),
file AS (SELECT job_id, state, row_number() OVER (PARTITION BY job_id, state ORDER BY way) - 1 AS file_no, file_path, f FROM found WHERE json_type(f) = 'OBJECT')
"""


def oracle_sql() -> dict[str, str]:
    return {
        "file_segments": f"WITH {FILES}, b AS (SELECT file_id, hex(encode(text)) h, octet_length(encode(text)) n FROM files), r AS (SELECT *, unnest(range(0, n, 4096)) AS o FROM b) "
        "SELECT file_id, n AS file_size, o AS \"offset\", o + 4096 >= n AS is_last_segment, sha256(unhex(substr(h, 2 * o + 1, 8192))) AS sha256 FROM r",
        "chunk_documents": CHUNKS + ' SELECT k AS file_id, idx::INTEGER AS chunk_index, off AS "offset", size, fp AS fingerprint FROM d',
        "chunk_boundaries": f"WITH RECURSIVE src AS (SELECT doc_id AS k, hex(encode(replace(coalesce(text, ''), chr(10), repeat(chr(10), 4)))) AS h FROM documents), {_chunk_cte('src')} "
        'SELECT k AS file_id, idx::INTEGER AS chunk_index, off AS "offset", size, fp AS fingerprint FROM c',
        "chunk_blockwise": f"WITH RECURSIVE {FILES}, w AS (SELECT file_id, hex(encode(text)) AS h, octet_length(encode(text)) AS n FROM files), cut AS (SELECT file_id, h, unnest(range(0, n, 1024)) AS b FROM w), "
        f"src AS (SELECT {{'f': file_id, 'b': b}} AS k, substr(h, 2 * b + 1, 2048) AS h FROM cut), {_chunk_cte('src', most=1024)} "
        'SELECT k.f AS file_id, (row_number() OVER (PARTITION BY k.f ORDER BY k.b, idx) - 1)::INTEGER AS chunk_index, k.b + off AS "offset", size, fp AS fingerprint FROM c',
        "chunk_listing": CHUNKS + " SELECT k AS file_id, idx::INTEGER AS chunk_index, size, substr(fp, 1, 16) AS fingerprint FROM d",
        "dedup_outcomes": OUTCOMES + " SELECT k AS file_id, idx::INTEGER AS chunk_index, outcome FROM o",
        "unique_chunks": CHUNKS + " SELECT fp AS fingerprint, 'minio://dedupe-chunks/' || fp AS storage_location, arg_min(size, pos) AS size FROM d GROUP BY fp",
        "incremental_ingest": CHUNKS + ", b AS (SELECT d.*, CASE WHEN authored_at < TIMESTAMPTZ '2025-01-01 00:00:00+00' THEN 1 ELSE 2 END AS batch FROM d JOIN documents ON doc_id = k), "
        "n AS (SELECT *, row_number() OVER (PARTITION BY batch, fp ORDER BY pos) AS rn, min(batch) OVER (PARTITION BY fp) AS first FROM b) "
        "SELECT k AS file_id, idx::INTEGER AS chunk_index, batch, CASE WHEN rn > 1 THEN 'DEDUPLICATED' WHEN first < batch THEN 'DEDUPLICATED (from DB)' ELSE 'STORED' END AS outcome FROM n",
        "job_summary": PER_FILE + " SELECT job, count(*) AS files_processed, sum(chunks)::BIGINT AS chunks_processed, sum(b)::BIGINT AS bytes_processed, sum(dup)::BIGINT AS bytes_deduplicated, "
        "'Backup completed. Processed ' || count(*) || ' files, ' || sum(chunks)::BIGINT || ' chunks' AS message FROM p GROUP BY job",
        "file_progress": PER_FILE + " SELECT job, file_id, file_id::VARCHAR AS current_file, (sum(b) OVER w)::BIGINT AS bytes_processed, (sum(dup) OVER w)::BIGINT AS bytes_deduplicated, 'Processed file: ' || file_id AS message "
        "FROM p WINDOW w AS (PARTITION BY job ORDER BY file_id ROWS UNBOUNDED PRECEDING)",
        "dedup_ratios": CHUNKS + ", g AS (SELECT job, fp, count(*) n, sum(size) b, max(size) one FROM d GROUP BY ALL), t AS (SELECT job, sum(n)::BIGINT AS chunks, count(*) AS unique_chunks, sum(b)::BIGINT AS total_bytes, sum(one) AS u FROM g GROUP BY job), "
        "z AS (SELECT job, arg_min(size, pos) AS first FROM d GROUP BY job) SELECT job, chunks, unique_chunks, total_bytes, round((total_bytes - u)::DOUBLE / total_bytes * 100, 6) AS dedup_ratio_exact, "
        "round((total_bytes - unique_chunks * first)::DOUBLE / total_bytes * 100, 6) AS dedup_ratio_approx FROM t JOIN z USING (job)",
        "lru_outcomes": CHUNKS + ", a AS (SELECT *, lag(pos) OVER (PARTITION BY fp ORDER BY pos) AS prev FROM d), r AS (SELECT * FROM a WHERE prev IS NOT NULL), "
        "n AS (SELECT r.pos, count(*) FILTER (a.pos IS NOT NULL) AS between_ FROM r LEFT JOIN a ON a.pos > r.prev AND a.pos < r.pos AND (a.prev IS NULL OR a.prev <= r.prev) GROUP BY r.pos) "
        "SELECT a.k AS file_id, a.idx::INTEGER AS chunk_index, coalesce(n.between_ < 300, false) AS hit FROM a LEFT JOIN n USING (pos)",
        "filter_slots": FIRSTS + " SELECT bucket, slot FROM s",
        "filter_misses": FIRSTS + " SELECT fp AS fingerprint FROM h JOIN s ON w % 2500 = bucket WHERE w <> slot",
        "filter_removals": FIRSTS + " SELECT bucket, CASE WHEN EXISTS (SELECT 1 FROM h WHERE h.w = s.slot AND h.k % 2 = 0) THEN 0 ELSE slot END AS slot FROM s",
        "put_validation": CHUNKS + ", q AS (SELECT k, idx, k % 10 AS t, CASE k % 10 WHEN 0 THEN '' WHEN 1 THEN NULL WHEN 2 THEN reverse(fp) ELSE fp END AS f, k % 10 = 3 AS no_data, fp FROM d), "
        "m AS (SELECT *, CASE WHEN coalesce(f, '') = '' THEN 'fingerprint is required' WHEN no_data THEN 'chunk_data is required' WHEN f <> fp THEN 'fingerprint does not match chunk_data' END AS msg FROM q) "
        "SELECT k AS file_id, idx::INTEGER AS chunk_index, msg IS NULL AS success, CASE WHEN msg IS NULL THEN f END AS storage_location, CASE WHEN msg IS NULL THEN 'storage-node-1' END AS storage_node_id, "
        "CASE WHEN msg IS NOT NULL THEN 'InvalidArgument' END AS error_code, msg AS error_message FROM m",
        "chunk_lookup": CHUNKS + " SELECT fp AS fingerprint, true AS found, size, count(*) AS requests FROM d GROUP BY ALL UNION ALL SELECT substr(fp, 1, 32), false, NULL, count(*) FROM d GROUP BY 1",
        "manifest": CHUNKS + ' SELECT job, k AS file_id, (sum(size) OVER (PARTITION BY k))::BIGINT AS file_size, idx::INTEGER AS position, fp AS fingerprint, off AS "offset", size FROM d',
        "manifest_json": CHUNKS + ", m AS (SELECT job, k AS path, sum(size)::BIGINT AS size, list(struct_pack(fingerprint := fp, \"offset\" := off, size := size) ORDER BY idx) AS chunks FROM d GROUP BY ALL) "
        "SELECT job, sha256(to_json(struct_pack(files := list(struct_pack(path := path, size := size, chunks := chunks) ORDER BY path)))::VARCHAR) AS sha256 FROM m GROUP BY job",
        "restore_roundtrip": f"WITH {FILES} SELECT file_id, true AS ok, octet_length(encode(text)) AS size, sha256(encode(text)) AS sha256 FROM files",
        "restore_segments": f"WITH {FILES}, b AS (SELECT file_id, hex(encode(text)) h, octet_length(encode(text)) n FROM files), r AS (SELECT *, unnest(range(0, n, 4096)) AS o FROM b) "
        "SELECT 'restore-0' AS restore_job_id, file_id, o AS \"offset\", o + 4096 >= n AS is_last_segment, sha256(unhex(substr(h, 2 * o + 1, 8192))) AS sha256 FROM r",
        "streamed_files": f"WITH {FILES} SELECT job AS job_id, file_id::VARCHAR AS file_path, octet_length(encode(text)) AS size, sha256(encode(text)) AS sha256 FROM files WHERE text <> ''",
        "stored_backup": f"WITH {FILES} SELECT job AS job_id, file_id::VARCHAR AS file_path, true AS complete, sha256(encode(text)) AS sha256 FROM files WHERE text <> '' AND job = 'mainline'",
        "resent_files": f"WITH {FILES} SELECT 'nightly' AS job_id, file_id::VARCHAR AS file_path, CASE WHEN text = '' THEN 1 ELSE 2 END::BIGINT AS versions, true AS complete, sha256(encode('second version' || chr(10) || text)) AS sha256 FROM files",
        "verify_blake3": CHUNKS + " SELECT k AS file_id, idx::INTEGER AS chunk_index, k % 3 <> 0 AS success, CASE WHEN k % 3 <> 0 THEN 'storage-node-1' END AS storage_node_id, CASE WHEN k % 3 = 0 THEN 'fingerprint does not match chunk_data' END AS error_message FROM d",
        "session_messages": "WITH m AS (SELECT doc_id, text, coalesce(repo, '') || '/\"' || doc_id || '\".txt' AS path, coalesce(floor(epoch(authored_at))::BIGINT, 0) AS t FROM documents WHERE text <> '') "
        "SELECT doc_id, 'test-client' AS client_id, 'backup-' || t AS backup_job_id, 'default-policy' AS backup_policy_id, '' AS encryption_key_id, t AS timestamp, 'filesystem' AS source_type, to_json({'path': path})::VARCHAR AS source_details, "
        "'COMPLETED' AS status, 'Backed up ' || path || ' in ' || ((octet_length(encode(text)) + 4095) // 4096) || ' segments' AS summary FROM m",
        "streamed_progress": f"WITH {FILES} SELECT job AS job_id, count(*) AS events, sum(octet_length(encode(text)))::BIGINT AS bytes_processed, count(*) AS lines FROM files WHERE text <> '' GROUP BY job",
        "job_events": EVENTS + ", g AS (SELECT job, min(t) FILTER (event_type = 'START') AS a, max(t) FILTER (event_type = 'END') AS b, max(struct_pack(t := t, s := status)) FILTER (event_type = 'END') AS l FROM e WHERE event_type <> 'SEGMENT' GROUP BY job) "
        "SELECT job AS backup_job_id, to_timestamp(a) AS start_time, to_timestamp(b) AS end_time, coalesce(l.s, 'INITIATED') AS status FROM g",
        "chunk_metadata": FIRST_CHUNKS + f", a AS (SELECT DISTINCT {KEY.format('fingerprint')} AS fp FROM chunk_arrivals) SELECT a.fp AS fingerprint, size, creation_time FROM a LEFT JOIN f USING (fp) WHERE a.fp IS NOT NULL",
        "touched_chunks": FIRST_CHUNKS + f", a AS (SELECT {KEY.format('fingerprint')} AS fp, max(observed_at) AS met FROM chunk_arrivals GROUP BY 1) SELECT f.fp AS fingerprint, greatest(last_referenced_time, met) AS last_referenced_time FROM f LEFT JOIN a USING (fp)",
        "object_exists": f"WITH o AS (SELECT {KEY.format('object_key')} AS fp, max(size) AS size FROM chunk_store GROUP BY 1), c AS (SELECT DISTINCT {KEY.format('fingerprint')} AS fp FROM chunks) SELECT c.fp AS fingerprint, o.fp IS NOT NULL AS exists, size FROM c LEFT JOIN o USING (fp)",
        "created_jobs": "WITH s AS (SELECT * REPLACE (CASE WHEN floor(epoch(start_time))::BIGINT % 2 = 0 THEN start_time END AS start_time) FROM backup_jobs), l AS (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY end_time DESC NULLS LAST, client_id DESC NULLS LAST, "
        "backup_policy_id DESC NULLS LAST, start_time DESC NULLS LAST, status DESC NULLS LAST) AS rn FROM s) SELECT job_id, client_id, coalesce(start_time, TIMESTAMPTZ '2020-01-01 00:00:00+00') AS start_time, status FROM l WHERE rn = 1",
        "jobs_of_client": "SELECT job_id, status, start_time FROM backup_jobs WHERE client_id = 'test-client'",
        "jobs_of_status": "SELECT job_id, client_id, start_time FROM backup_jobs WHERE status = 'FAILED'",
        "cache_facade": CACHE,
        "scanned_files": "SELECT n_name AS name, octet_length(encode(v)) + 1 AS size, sha256(v || chr(10)) AS sha256 FROM (SELECT n_name, n_name || ' of region ' || n_regionkey AS v FROM nation)",
        "p4_files": LISTED + f"SELECT job_id, state, file_no, file_path, {_scalar('f', 'size')} AS size_text, CASE WHEN json_type(f, '$.chunks') = 'ARRAY' THEN json_array_length(f, '$.chunks') ELSE 0 END::BIGINT AS n_chunks FROM file",
        "p4_chunks": LISTED + ", part AS (SELECT * EXCLUDE (f), from_json(json_extract(f, '$.chunks'), '[\"JSON\"]') AS l FROM file WHERE json_type(f, '$.chunks') = 'ARRAY'), "
        "piece AS (SELECT * EXCLUDE (l), unnest(range(0, len(l))) AS chunk_no, unnest(l) AS e FROM part) "
        "SELECT job_id, state, file_no, file_path, chunk_no, CASE json_type(e) WHEN 'VARCHAR' THEN json_extract_string(e, '$') WHEN 'OBJECT' THEN CASE WHEN json_type(e, '$.fingerprint') = 'VARCHAR' THEN json_extract_string(e, '$.fingerprint') END END AS fingerprint_text, "
        f"CASE WHEN json_type(e) = 'OBJECT' AND json_type(e, '$.fp') = 'VARCHAR' THEN json_extract_string(e, '$.fp') END AS fp_text, {_scalar('e', 'offset')} AS offset_text, {_scalar('e', 'size')} AS size_text FROM piece",
        "p4_access": LISTED + ", part AS (SELECT * EXCLUDE (f), from_json(json_extract(f, '$.acl'), '[\"JSON\"]') AS l FROM file WHERE json_type(f, '$.acl') = 'ARRAY'), "
        "piece AS (SELECT * EXCLUDE (l), unnest(range(0, len(l))) AS entry_no, unnest(l) AS e FROM part) "
        f"SELECT job_id, state, file_no, file_path, entry_no, {_scalar('e', 'who')} AS who, CASE WHEN json_type(e, '$.perms') = 'ARRAY' THEN array_to_string(from_json(json_extract(e, '$.perms'), '[\"VARCHAR\"]'), ',') END AS perms FROM piece",
        "update_chunks": f"WITH c AS (SELECT {KEY.format('fingerprint')} AS fp, * EXCLUDE (fingerprint) FROM chunks), "
        "f AS (SELECT fp, size, storage_location FROM (SELECT *, row_number() OVER (PARTITION BY fp ORDER BY creation_time NULLS FIRST, size NULLS FIRST, storage_location NULLS FIRST) AS rn FROM c WHERE fp IS NOT NULL) WHERE rn = 1), "
        f"s AS (SELECT {KEY.format('object_key')} AS fp, max(size) AS size FROM chunk_store GROUP BY 1) "
        "SELECT f.fp AS fingerprint, CASE WHEN s.fp IS NOT NULL THEN s.size ELSE f.size END AS size, CASE WHEN s.fp IS NOT NULL THEN 'minio://dedupe-chunks/' || s.fp ELSE f.storage_location END AS storage_location FROM f LEFT JOIN s USING (fp)",
        "latest_jobs": "SELECT job_id, status, end_time FROM (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY end_time DESC NULLS LAST, status DESC, client_id DESC) AS rn FROM backup_jobs) WHERE rn = 1",
        "recent_chunks": "SELECT fingerprint, size, last_referenced_time FROM chunks WHERE last_referenced_time < TIMESTAMPTZ '2025-01-01 00:00:00+00'",
        "constraints": " UNION ALL ".join(f"SELECT '{c} not null' AS \"constraint\", count(*) FILTER ({c} IS NULL) AS rows FROM chunks" for c in ("fingerprint", "storage_location", "size", "creation_time", "last_referenced_time"))
        + " UNION ALL SELECT 'fingerprint unique', count(fingerprint) - count(DISTINCT fingerprint) FROM chunks",
        "session_violations": EVENTS + """,
v AS (SELECT *, last_value(CASE WHEN event_type = 'START' THEN job END IGNORE NULLS) OVER w AS active, last_value(CASE WHEN event_type = 'START' THEN t END IGNORE NULLS) OVER w AS begun,
  last_value(CASE event_type WHEN 'START' THEN true WHEN 'END' THEN false END IGNORE NULLS) OVER w AS open FROM e WINDOW w AS (PARTITION BY stream_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
x AS (SELECT stream_id, seq, event_type, CASE WHEN event_type <> 'START' AND active IS NULL THEN 1 WHEN event_type = 'END' AND job <> active THEN 2 WHEN event_type = 'START' AND coalesce(open, false) THEN 3 WHEN t - begun > 1800 THEN 4 END AS c FROM v)
SELECT stream_id, seq, event_type, ['FailedPrecondition', 'JobMismatch', 'AlreadyActive', 'DeadlineExceeded'][c] AS error_code, ['No active backup job', 'end of another job', 'start while a job is active', 'session timed out'][c] AS error_message FROM x WHERE c IS NOT NULL""",
        "p2_found": P2,
        "p2_counts": f"SELECT source_table, period, kind, count(*) AS orphans, count(DISTINCT source_key) AS sources FROM ({P2}) GROUP BY ALL",
        "p2_arrivals": "SELECT a.arrival_no, CASE WHEN a.job_id IS NULL THEN 'job_id' WHEN a.client_id IS NULL THEN 'client_id' ELSE '' END AS mask FROM chunk_arrivals a WHERE (a.job_id IS NOT NULL OR a.client_id IS NOT NULL) "
        "AND NOT EXISTS (SELECT 1 FROM (SELECT DISTINCT job_id, client_id FROM backup_jobs) b WHERE (a.job_id IS NULL OR a.job_id = b.job_id) AND (a.client_id IS NULL OR a.client_id = b.client_id))",
        "p4_found": P4 + " SELECT DISTINCT job_id, file_path, chunk_no, fp AS fingerprint FROM k WHERE fp IS NOT NULL",
    }


#: Chunks of the listings, by walking each JSON document: k has the columns of the job row, file_path, chunk_no, fp.
P4 = f"""WITH RECURSIVE raw AS (SELECT job_id, start_time, end_time, files_metadata AS t FROM backup_jobs WHERE files_metadata IS NOT NULL AND json_valid(files_metadata)),
once AS (SELECT job_id, start_time, end_time, CASE WHEN json_type(t) = 'VARCHAR' THEN json_extract_string(t, '$') ELSE t END AS t FROM raw),
doc AS (SELECT job_id, start_time, end_time, t::JSON AS j FROM once WHERE json_valid(t)),
tree AS (SELECT job_id, start_time, end_time, json_extract_string(j, '$.tree.name') AS path, json_extract(j, '$.tree') AS f FROM doc WHERE json_type(j) = 'OBJECT' AND json_type(j, '$.tree') = 'OBJECT'
  UNION ALL SELECT job_id, start_time, end_time, path || '/' || json_extract_string(s, '$.name'), s FROM (SELECT job_id, start_time, end_time, path, unnest(from_json(json_extract(f, '$.folders'), '["JSON"]')) AS s FROM tree WHERE json_type(f, '$.folders') = 'ARRAY')),
listed AS (SELECT job_id, start_time, end_time, unnest(from_json(CASE WHEN json_type(j) = 'ARRAY' THEN j ELSE json_extract(j, '$.files') END, '["JSON"]')) AS f FROM doc WHERE json_type(j) = 'ARRAY' OR json_type(j, '$.files') = 'ARRAY'),
named AS (SELECT job_id, start_time, end_time, unnest(map_entries(json_extract(j, '$.files')::MAP(VARCHAR, JSON))) AS m FROM doc WHERE json_type(j) = 'OBJECT' AND json_type(j, '$.files') = 'OBJECT'),
file AS (SELECT job_id, start_time, end_time, json_extract_string(f, '$.path') AS file_path, f FROM listed
  UNION ALL SELECT job_id, start_time, end_time, m.key, m.value FROM named
  UNION ALL SELECT job_id, start_time, end_time, path || '/' || json_extract_string(s, '$.name'), s FROM (SELECT job_id, start_time, end_time, path, unnest(from_json(json_extract(f, '$.files'), '["JSON"]')) AS s FROM tree WHERE json_type(f, '$.files') = 'ARRAY')),
part AS (SELECT job_id, start_time, end_time, file_path, from_json(json_extract(f, '$.chunks'), '["JSON"]') AS l FROM file WHERE json_type(f, '$.chunks') = 'ARRAY'),
piece AS (SELECT job_id, start_time, end_time, file_path, unnest(range(0, len(l))) AS chunk_no, unnest(l) AS e FROM part),
text AS (SELECT job_id, start_time, end_time, file_path, chunk_no, CASE json_type(e) WHEN 'VARCHAR' THEN json_extract_string(e, '$') WHEN 'OBJECT' THEN json_extract_string(e, '$.fingerprint') END AS a, CASE json_type(e) WHEN 'OBJECT' THEN json_extract_string(e, '$.fp') END AS b FROM piece),
k AS (SELECT job_id, start_time, end_time, file_path, chunk_no, coalesce({KEY.format('a')}, {KEY.format('b')}) AS fp FROM text)"""

P2 = P4 + f""", c AS (SELECT {KEY.format('fingerprint')} AS fp, {KEY.format('storage_location')} AS loc, creation_time, last_referenced_time FROM chunks),
g AS (SELECT {KEY.format('fingerprint')} AS fp, deleted_at FROM gc_log), o AS (SELECT {KEY.format('object_key')} AS fp, stored_at, deleted_at FROM chunk_store),
wk AS (SELECT {KEY.format('fingerprint')} AS fp FROM wellknown_chunks),
r1 AS (SELECT DISTINCT job_id, strftime(start_time, '%Y-%m') AS period, end_time AS t, fp FROM k WHERE fp IS NOT NULL AND fp NOT IN (SELECT fp FROM wk)),
l1 AS (SELECT r1.job_id, r1.period, r1.t, r1.fp, count(c.fp) AS n, coalesce(bool_or(c.fp IS NOT NULL AND (r1.t IS NULL OR c.creation_time <= r1.t) AND NOT EXISTS (SELECT 1 FROM g WHERE g.fp = c.fp AND g.deleted_at >= c.creation_time AND (r1.t IS NULL OR g.deleted_at <= r1.t))), false) AS alive,
  coalesce(bool_and(r1.t IS NOT NULL AND c.creation_time > r1.t), false) AS late FROM r1 LEFT JOIN c ON c.fp = r1.fp GROUP BY ALL),
r2 AS (SELECT DISTINCT fp, strftime(creation_time, '%Y-%m') AS period, last_referenced_time AS t, loc FROM c WHERE fp IS NOT NULL AND loc IS NOT NULL),
l2 AS (SELECT r2.fp, r2.period, r2.t, r2.loc, count(o.fp) AS n, coalesce(bool_or(o.fp IS NOT NULL AND (r2.t IS NULL OR o.stored_at <= r2.t) AND (o.deleted_at IS NULL OR r2.t IS NOT NULL AND o.deleted_at > r2.t)), false) AS alive,
  coalesce(bool_and(r2.t IS NOT NULL AND o.stored_at > r2.t), false) AS late FROM r2 LEFT JOIN o ON o.fp = r2.loc GROUP BY ALL)
SELECT DISTINCT 'backup_jobs' AS source_table, period, job_id AS source_key, fp AS target_key, CASE WHEN n = 0 THEN 'missing' WHEN late THEN 'late' ELSE 'deleted' END AS kind FROM l1 WHERE NOT alive
UNION SELECT DISTINCT 'chunks', period, fp, loc, CASE WHEN n = 0 THEN 'missing' WHEN late THEN 'late' ELSE 'deleted' END FROM l2 WHERE NOT alive"""
