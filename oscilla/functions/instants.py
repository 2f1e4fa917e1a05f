"""Exact instants: whole seconds since 1970 in UTC and a decimal fraction, from text with a zone."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed pattern: date, T or blank, time, optional fraction, zone (never -00:00, never beyond 23:59).
PATTERN = r"^(\d{4}-\d{2}-\d{2})[T ](\d{2}:\d{2}:\d{2})(?:\.(\d+))?(Z|(?!-00:00)[+-](?:[01]\d|2[0-3]):[0-5]\d)$"


def parse(text: Column) -> Column:
    """struct(sec long, frac decimal(20,18)), or null for text without a zone or no instant at all."""
    whole = F.try_to_timestamp(F.concat(F.regexp_extract(text, PATTERN, 1), F.lit(" "), F.regexp_extract(text, PATTERN, 2), F.regexp_replace(F.regexp_extract(text, PATTERN, 4), "^Z$", "+00:00")), F.lit("yyyy-MM-dd HH:mm:ssXXX"))
    fraction = F.rpad(F.substring(F.regexp_extract(text, PATTERN, 3), 1, 18), 18, "0")
    exact = F.concat(F.lit("0."), fraction).cast("decimal(20,18)")
    return F.when(text.rlike(PATTERN) & whole.isNotNull(), F.struct(F.unix_seconds(whole).alias("sec"), exact.alias("frac")))


def since(later: Column, earlier: Column) -> Column:
    """Exact seconds between two parsed instants."""
    return (later["sec"] - earlier["sec"]).cast("decimal(19,0)") + (later["frac"] - earlier["frac"])


def canonical(instant: Column) -> Column:
    """ISO text with a Z and at least six digits of fraction, without further trailing zeros."""
    digits = F.substring(instant["frac"].cast("string"), 3, 18)
    kept = F.regexp_replace(digits, "0+$", "")
    return F.concat(F.date_format(F.timestamp_seconds(instant["sec"]), "yyyy-MM-dd'T'HH:mm:ss"), F.lit("."), F.when(F.length(kept) >= 6, kept).otherwise(F.rpad(kept, 6, "0")), F.lit("Z"))


def micros(ts: Column) -> Column:
    """Microseconds since 1970 of a timestamp with or without zone, the latter read as UTC."""
    return F.unix_micros(ts.cast("timestamp"))
