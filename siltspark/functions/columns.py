"""Column expressions shared by the operators; all stay inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A fingerprint: a run of exactly 64 hex digits.
FINGERPRINT_RUN = r"(?<![0-9a-f])[0-9a-f]{64}(?![0-9a-f])"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def fingerprint_key(c: Column | str) -> Column:
    """The 64 digits in lower case if the text holds exactly one run of exactly 64 hex digits, else null."""
    runs = F.regexp_extract_all(F.lower(_col(c)), F.lit(FINGERPRINT_RUN), F.lit(0))
    return F.when(F.size(runs) == 1, runs[0])


def fingerprint_bytes(c: Column | str) -> Column:
    """fingerprint_key as 32 bytes: half the width in every shuffle and on disk."""
    return F.unhex(fingerprint_key(c))


def sha2_hex(data: Column | str) -> Column:
    return F.sha2(_col(data), 256)


def short_fingerprint(fp: Column | str) -> Column:
    """The first 16 digits, as listings show them."""
    return F.substring(_col(fp), 1, 16)


def storage_location(fp: Column | str, prefix: str) -> Column:
    return F.concat(F.lit(prefix), _col(fp))


def weak_hash(key: Column | str) -> Column:
    """Position-weighted sum of code points, positions from 1: the hash of the one-slot filter model."""
    k = _col(key)
    steps = F.when(F.length(k) > 0, F.sequence(F.lit(1), F.length(k))).otherwise(F.array().cast("array<int>"))
    return F.aggregate(steps, F.lit(0).cast("long"), lambda acc, i: acc + F.ascii(F.substring(k, i, F.lit(1))).cast("long") * i)


def binary_text(data: Column | str) -> Column:
    """Bytes as a string of one character per byte, so that regular expressions see bytes."""
    return F.decode(_col(data), "ISO-8859-1")


def text_binary(text: Column | str) -> Column:
    return F.encode(_col(text), "ISO-8859-1")


def unix_time(seconds: Column | str) -> Column:
    return F.timestamp_seconds(_col(seconds))


def month(ts: Column | str) -> Column:
    """yyyy-MM in the session's time zone (UTC in this library)."""
    return F.date_format(_col(ts), "yyyy-MM")
