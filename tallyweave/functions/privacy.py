"""Masking, redaction and blind indexes as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def masked(number: Column) -> Column:
    """All but the last four characters as X; short numbers wholly, null as an empty string."""
    n = F.length(number)
    hidden = F.when(n <= 4, F.repeat(F.lit("X"), n)).otherwise(F.concat(F.repeat(F.lit("X"), n - 4), F.right(number, F.lit(4))))
    return F.coalesce(hidden, F.lit(""))


def redacted(text: Column) -> Column:
    """Runs of nine digits or more give way to a mark."""
    return F.regexp_replace(text, r"\d{9,}", "[REDACTED]")


def redacted_fields(df: DataFrame, fields: list[str]) -> DataFrame:
    return df.withColumns({f: redacted(F.col(f).cast("string")) for f in fields if f in df.columns})


def blind_index(value: Column, pepper: str | None) -> Column:
    """HMAC-SHA256 of the upper-cased value in hex, without a pepper null; nested sha2 calls, no Python."""
    if not pepper:
        return F.lit(None).cast("string")
    key = pepper.encode()
    if len(key) > 64:
        import hashlib

        key = hashlib.sha256(key).digest()
    key = key.ljust(64, b"\0")
    inner, outer = (F.lit(bytearray(k ^ p for k in key)) for p in (0x36, 0x5C))
    digest = F.unhex(F.sha2(F.concat(inner, F.upper(F.trim(value)).cast("binary")), 256))
    return F.sha2(F.concat(outer, digest), 256)
