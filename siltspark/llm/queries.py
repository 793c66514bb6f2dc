"""Queries over the test tables by the operators of this package, and their SQL where there is some."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siltspark.functions.columns import fingerprint_bytes
from siltspark.llm.bpe import encode_column, read_tokenizer
from siltspark.llm.history import History
from siltspark.llm.ledger import KeyLedger, answer_errors
from siltspark.llm.mixing import mix_sources
from siltspark.llm.quality import text_quality
from siltspark.llm.splitting import oversized, split_files
from siltspark.session import materialize, scratch_path, table, widen

#: The ranks file of byte_bpe_50k; executors need no copy.
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return widen(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))


def _history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "chunks").select("fingerprint").unionAll(table(spark, sf_dir, "wellknown_chunks").select("fingerprint"))


def _answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    ledger = KeyLedger(spark)
    ledger.learn(_history(spark, sf_dir), fingerprint_bytes("fingerprint"))
    return ledger.admit(table(spark, sf_dir, "chunk_arrivals"), fingerprint_bytes("fingerprint"), "arrival_no")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _answers(spark, sf_dir).filter("seen").select("arrival_no")


def p5_error_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    history = _history(spark, sf_dir).select(fingerprint_bytes("fingerprint").alias("key"))
    return answer_errors(_answers(spark, sf_dir), history, "arrival_no")


#: Batches that the jobs of chunks_of_file are grouped into; places where a batch may begin are looked for by that many blocks.
BATCHES, BLOCKS = 10, 1000


def job_batches(rows: DataFrame, batches: int = BATCHES) -> list[int]:
    """The first ids of batches of whole jobs, in order of arrival, of rows (occurrence_id, job_id). A batch begins at
    the first job, from each of that many even cuts on, before which no job is open; jobs that overlap everywhere
    make fewer and larger batches. Rows without a job are jobs of their own."""
    jobs = rows.groupBy(F.coalesce("job_id", F.concat(F.lit("none "), F.col("occurrence_id").cast("string"))).alias("job")).agg(F.min("occurrence_id").alias("first"), F.max("occurrence_id").alias("last"))
    jobs = materialize(jobs, "jobs")
    low, high = jobs.agg(F.min("first"), F.max("last")).first()
    if low is None:
        return []
    width = max(1, -(-(high - low + 1) // BLOCKS))
    jobs = jobs.withColumn("block", F.floor((F.col("first") - low) / width))
    # What earlier blocks leave open is one row a block, so that no window spans all jobs.
    until = jobs.groupBy("block").agg(F.max("last").alias("last"))
    before = until.select("block", F.max("last").over(Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)).alias("open"))
    within = Window.partitionBy("block").orderBy("first").rowsBetween(Window.unboundedPreceding, -1)
    open_until = F.greatest(F.max("last").over(within), F.col("open"))
    clean = jobs.join(before, "block").select("first", open_until.alias("until")).filter(F.col("until").isNull() | (F.col("until") < F.col("first")))
    cut = F.floor((F.col("first") - low) * batches / (high - low + 1))
    return sorted(r[0] for r in clean.groupBy(cut.alias("cut")).agg(F.min("first")).select(F.col("min(first)")).collect())


def _duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers for all rows, admitted in batches of whole jobs in order of arrival."""
    rows = table(spark, sf_dir, "chunks_of_file").select("occurrence_id", "job_id", "fingerprint", "data")
    begins = job_batches(rows.select("occurrence_id", "job_id"))
    # Batches are laid out apart once, as they would arrive, so that none reads the table of all.
    number = sum((F.when(F.col("occurrence_id") >= b, 1).otherwise(0) for b in begins), F.lit(0))
    landing = scratch_path(spark, "arrivals")
    widen(rows.drop("job_id")).withColumn("batch", number).write.partitionBy("batch").option("compression", "zstd").parquet(landing)
    history, out = History(spark), None
    for i in range(len(begins)):
        batch = spark.read.schema("occurrence_id long, fingerprint string, data binary").parquet(f"{landing}/batch={i + 1}")
        part = history.admit(batch, "occurrence_id", "fingerprint", "data")
        out = part if out is None else out.unionByName(part)
    return out if out is not None else history.admit(rows, "occurrence_id", "fingerprint", "data")


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _duplicates(spark, sf_dir)
    earlier = F.coalesce(F.least("exact", "near"), "exact", "near")
    return found.select(earlier.alias("earlier_id"), F.col("occurrence_id").alias("later_id")).filter(F.col("earlier_id").isNotNull())


def p1_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """occurrence_id, outcome: exact, near or new."""
    return _duplicates(spark, sf_dir).select("occurrence_id", F.when(F.col("exact").isNotNull(), "exact").when(F.col("near").isNotNull(), "near").otherwise("new").alias("outcome"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = split_files(table(spark, sf_dir, "file_segments"), with_data=False)
    return oversized(pieces).select("job_id", "file_path")


def _pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pieces, with the hash of their bytes in place of these."""
    pieces = split_files(table(spark, sf_dir, "file_segments"))
    return materialize(pieces.select("job_id", "file_path", "offset", "size", "repeated", "cut", F.sha2("data", 256).alias("sha256")), "pieces")


def p3_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """job_id, file_path, offset, size, repeated, cut, sha256 of the pieces of the oversized files."""
    pieces = _pieces(spark, sf_dir)
    return pieces.join(oversized(pieces).select("job_id", "file_path"), ["job_id", "file_path"], "left_semi")


def p3_cover(spark: SparkSession, sf_dir: str) -> DataFrame:
    """job_id, file_path, covered, largest_fits of the oversized files: the bytes their pieces cover, and whether all are
    within the limit."""
    by_file = p3_pieces(spark, sf_dir).groupBy("job_id", "file_path")
    return by_file.agg(F.sum(F.col("size") - F.col("repeated")).alias("covered"), (F.max("size") <= 8192).alias("largest_fits"))


def p6_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_column(_documents(spark, sf_dir), "doc_id", "text", read_tokenizer(spark, TOKENIZER))


def p7_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, source, uses, tokens of each document of the mix."""
    return mix_sources(_documents(spark, sf_dir), table(spark, sf_dir, "mix_targets"), read_tokenizer(spark, TOKENIZER))[0]


def p7_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shares reached, beside the targets."""
    return mix_sources(_documents(spark, sf_dir), table(spark, sf_dir, "mix_targets"), read_tokenizer(spark, TOKENIZER))[1]


def p7_caps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """source, over_cap, foreign of every target: its documents in the mix that are used more than max_repeats times, and
    those whose own label is another source's. Both are to be 0."""
    label = lambda c: F.lower(F.trim(c))
    mixed = p7_mix(spark, sf_dir).groupBy("source", "doc_id").agg(F.sum("uses").alias("uses"))
    own = table(spark, sf_dir, "documents").select("doc_id", label("source").alias("own"))
    targets = table(spark, sf_dir, "mix_targets").select(label("source").alias("source"), "max_repeats")
    rows = targets.join(mixed.join(own, "doc_id", "left"), "source", "left")
    return rows.groupBy("source").agg(F.count(F.when(F.col("uses") > F.col("max_repeats"), 1)).alias("over_cap"), F.count(F.when(F.col("doc_id").isNotNull() & ~F.col("own").eqNullSafe(F.col("source")), 1)).alias("foreign"))


def p8_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text_quality(_documents(spark, sf_dir), "doc_id", "text", table(spark, sf_dir, "common_words"))


def p8_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_words, letters, common: the counts behind the word statistics."""
    whole = lambda c: F.round(F.col(c) * F.col("n_words")).cast("long")
    return p8_stats(spark, sf_dir).select("doc_id", F.col("n_words").cast("long").alias("n_words"), whole("mean_word_length").alias("letters"), whole("common_words").alias("common"))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p8_stats(spark, sf_dir).select("doc_id", "kind").filter(F.col("kind").isNotNull())


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (p1_found, p1_outcomes, p3_found, p3_pieces, p3_cover, p5_found, p5_error_rate, p6_ids, p7_mix, p7_shares, p7_caps, p8_found, p8_stats, p8_words)}


#: The digits of a fingerprint in DuckDB, for a column {0}.
KEY = "(SELECT CASE WHEN len(l) = 1 THEN l[1] END FROM (SELECT list_filter(regexp_extract_all(lower({0}), '[0-9a-f]+'), lambda x: length(x) = 64) AS l))"
_P5 = f"""WITH h AS (SELECT {KEY.format('fingerprint')} AS k FROM chunks UNION SELECT {KEY.format('fingerprint')} FROM wellknown_chunks),
a AS (SELECT arrival_no, {KEY.format('fingerprint')} AS k FROM chunk_arrivals),
s AS (SELECT arrival_no, k, k IS NOT NULL AND (arrival_no > min(arrival_no) OVER (PARTITION BY k) OR k IN (SELECT k FROM h WHERE k IS NOT NULL)) AS seen FROM a)
"""

_P1 = f"""WITH f AS (SELECT occurrence_id AS id, coalesce({KEY.format('fingerprint')}, sha256(data)) AS fp, lower(TRY(decode(data))) AS t FROM chunks_of_file),
w AS (SELECT id, regexp_extract_all(t, '[\\p{{L}}\\p{{N}}]+') AS w FROM f WHERE t IS NOT NULL),
g AS (SELECT DISTINCT id, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) AS s FROM w WHERE len(w) >= 3),
n AS (SELECT id, count(*) AS n FROM g GROUP BY id),
p AS (SELECT a.id AS a, b.id AS b, count(*) AS c FROM g a JOIN g b ON a.s = b.s AND a.id < b.id GROUP BY ALL),
e AS (SELECT x.id AS earlier, y.id AS later FROM f x JOIN f y ON x.fp = y.fp AND x.id < y.id),
m AS (SELECT a AS earlier, b AS later FROM p JOIN n na ON na.id = a JOIN n nb ON nb.id = b WHERE 10 * c >= 7 * (na.n + nb.n - c))
"""


_P3 = """WITH s AS (SELECT job_id, file_path, "offset" AS a, "offset" + octet_length(data) AS b FROM file_segments WHERE octet_length(data) > 0 AND "offset" >= 0 AND job_id IS NOT NULL AND file_path IS NOT NULL),
m AS (SELECT *, coalesce(max(b) OVER (PARTITION BY job_id, file_path ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS top FROM s)
"""


def oracle_sql() -> dict[str, str]:
    return {
        "p1_found": _P1 + "SELECT min(earlier) AS earlier_id, later AS later_id FROM (SELECT * FROM e UNION ALL SELECT * FROM m) GROUP BY later",
        "p1_outcomes": _P1 + "SELECT id AS occurrence_id, CASE WHEN id IN (SELECT later FROM e) THEN 'exact' WHEN id IN (SELECT later FROM m) THEN 'near' ELSE 'new' END AS outcome FROM f",
        "p3_found": _P3 + "SELECT job_id, file_path FROM m GROUP BY job_id, file_path HAVING sum(greatest(b - greatest(a, top), 0)) > 8192",
        "p3_cover": _P3 + "SELECT job_id, file_path, sum(greatest(b - greatest(a, top), 0))::BIGINT AS covered, true AS largest_fits FROM m GROUP BY job_id, file_path HAVING sum(greatest(b - greatest(a, top), 0)) > 8192",
        "p7_caps": "SELECT lower(trim(source)) AS source, 0::BIGINT AS over_cap, 0::BIGINT AS \"foreign\" FROM mix_targets",
        "p8_words": """WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[\\p{L}\\p{N}]+(?:[''’-][\\p{L}\\p{N}]+)*') AS l FROM documents), c AS (SELECT list(DISTINCT lower(trim(word))) AS c FROM common_words WHERE lang IS NOT NULL AND word IS NOT NULL)
SELECT doc_id, len(l)::BIGINT AS n_words, coalesce(list_sum(list_transform(l, lambda x: length(x))), 0)::BIGINT AS letters, len(list_filter(l, lambda x: list_contains(c, lower(x))))::BIGINT AS common FROM w, c""",
        "p5_found": _P5 + "SELECT arrival_no FROM s WHERE seen",
        "p5_error_rate": _P5 + "SELECT count(*) AS rows, count(*) FILTER (k IS NULL) AS without_key, count(*) FILTER (seen) AS seen, 0::BIGINT AS wrong, 0.0::DOUBLE AS error_rate FROM s",
    }
