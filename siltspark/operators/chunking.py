"""Variable-size chunking of byte values with Catalyst built-ins.

A chunk ends at the first place, at least min bytes in, whose last four bytes are one of the boundary patterns, else
after max bytes; what is left below min goes whole into the last chunk. Over bytes decoded one to one into characters
that rule is a single regular expression, so chunking is a projection and a generator in one codegen stage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltspark.config import EngineConfig
from siltspark.functions.blake3 import blake3_hex
from siltspark.functions.columns import binary_text, sha2_hex, text_binary

#: The boundary patterns, four equal bytes each.
BOUNDARY = r"\x00{4}|\xFF{4}|\n{4}"


def chunk_pattern(min_size: int, max_size: int) -> str:
    """The regular expression whose successive matches are the chunks."""
    least, most = max(min_size, 4) - 4, max_size - 5
    whole = rf".{{1,{max_size}}}"
    if most < least:
        return f"(?s){whole}"
    # A remainder below min_size must not be cut, even where min_size is under the pattern's own length.
    return rf"(?s)(?:.{{{least},{most}}}?(?:{BOUNDARY})|{whole})"


def fingerprint(data: Column | str, hash_alg: str = "sha2") -> Column:
    """64 hex digits of the bytes."""
    return sha2_hex(data) if hash_alg == "sha2" else blake3_hex(data)


def _running(sizes: Column, base: Column) -> Column:
    """base plus the sum of the elements before each one."""
    start = F.struct(F.array().cast("array<long>").alias("at"), base.alias("next"))
    return F.aggregate(sizes, start, lambda acc, n: F.struct(F.concat(acc["at"], F.array(acc["next"])).alias("at"), (acc["next"] + n).alias("next")))["at"]


def _starts(part: Column) -> Column:
    """Offset of every piece. Appending to an array copies it, so sums run in runs of 256 pieces and over the runs."""
    run = 256
    # Most files are one chunk.
    single = F.array(F.lit(0).cast("long"))
    runs = F.transform(F.sequence(F.lit(0), F.floor((F.size(part) - 1) / run).cast("int")), lambda g: F.transform(F.slice(part, g * run + 1, F.lit(run)), lambda s: F.length(s).cast("long")))
    totals = F.transform(runs, lambda r: F.aggregate(r, F.lit(0).cast("long"), lambda a, n: a + n))
    many = F.flatten(F.zip_with(runs, _running(totals, F.lit(0).cast("long")), lambda r, b: _running(r, b)))
    return F.when(F.size(part) == 1, single).otherwise(many)


def _split(text: Column, config: EngineConfig) -> Column:
    """The pieces of a byte text. A text without any boundary pattern, which a plain search tells, is cut at every
    max_size bytes; the expression that looks for patterns is left to the others."""
    patterned = F.regexp_extract_all(text, F.lit(chunk_pattern(config.min_size, config.max_size)), F.lit(0))
    some = F.lit(False)
    for code in (0, 255, 10):
        some = some | F.contains(text, F.lit(chr(code) * 4))
    starts = F.sequence(F.lit(1), F.length(text), F.lit(config.max_size))
    return F.when(some, patterned).otherwise(F.transform(starts, lambda at: F.substring(text, at, F.lit(config.max_size))))


def chunk_files(df: DataFrame, content: str = "content", config: EngineConfig | None = None, with_data: bool = False) -> DataFrame:
    """One row per chunk: df's columns without content, then chunk_index int (from 0), offset long, size long,
    fingerprint string and, on demand, data binary. Null or empty content gives no chunk. Columns of df with the
    names of added ones are replaced. No shuffle: indexes and offsets come from the row's own array."""
    config = config or EngineConfig()
    added = ["chunk_index", "offset", "size", "fingerprint", *["data"] * with_data]
    keep = [F.col(f"`{c}`") for c in df.columns if c != content and c not in added]
    whole = F.col("_silt_text")
    part = _split(whole, config)
    if config.block_aligned:
        blocks = F.sequence(F.lit(0), F.length(whole) - 1, F.lit(config.max_size))
        part = F.flatten(F.transform(blocks, lambda b: _split(F.substring(whole, b + 1, F.lit(config.max_size)), config)))
    src = df.select(*keep, binary_text(F.col(f"`{content}`").cast("binary")).alias("_silt_text")).filter(F.length("_silt_text") > 0)
    src = src.select(*keep, part.alias("_silt_part"))
    rows = src.select(*keep, F.posexplode(F.arrays_zip(F.col("_silt_part").alias("s"), _starts(F.col("_silt_part")).alias("at"))).alias("chunk_index", "_silt"))
    data = text_binary("_silt.s")
    out = [F.col("chunk_index"), F.col("_silt.at").alias("offset"), F.length("_silt.s").cast("long").alias("size"), fingerprint(data, config.hash_alg).alias("fingerprint")]
    return rows.select(*keep, *out, *[data.alias("data")] * with_data)
