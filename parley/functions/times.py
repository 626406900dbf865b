"""Timestamps as APIs and files write them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _column(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def utc_timestamp(text) -> Column:
    """ISO text as a timestamp, whatever the session's zone: with Z or an offset as it says, without one in UTC, a date alone its midnight; null for other text."""
    t = F.trim(_column(text))
    zoned = F.when(t.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$"), F.concat(t, F.lit("T00:00:00Z"))).when(t.rlike(r"[Tt ].*([Zz]|[+-][0-9]{2}(:?[0-9]{2})?)$"), F.upper(t)).otherwise(F.concat(F.upper(t), F.lit("Z")))
    return F.try_to_timestamp(zoned)


def parse_timestamp(value) -> Column:
    """Epoch seconds or ISO text (Z or offset; none means UTC) as a timestamp; null, and what is neither, gives null. Numbers first: as a date, 175441 would be a year."""
    text = _column(value).cast("string")
    seconds = F.timestamp_micros(F.round(text.try_cast("double") * 1_000_000).try_cast("bigint"))
    return F.coalesce(seconds, utc_timestamp(text))


def parse_bound(value: str) -> Column:
    """A date or time given by a user: without offset it is UTC, a date is its midnight. What can't be read fails the query."""
    return F.coalesce(utc_timestamp(F.lit(value)), F.raise_error(F.lit(f"not a date: {value}")).cast("timestamp"))


def iso_text(timestamp) -> Column:
    """UTC ISO text with offset, whatever the session's zone; the fraction has six digits and is left out where it is zero."""
    micros = F.unix_micros(_column(timestamp))
    day = F.lit(86_400_000_000)
    seconds = (F.pmod(micros, day) / F.lit(1_000_000)).cast("decimal(18,6)")
    plain = F.expr("timestamp_ntz'1970-01-01 00:00:00'") + F.make_dt_interval(F.floor(micros / day).cast("int"), F.lit(0), F.lit(0), seconds)
    fraction = F.pmod(micros, F.lit(1_000_000))
    return F.concat(F.replace(F.substring(plain.cast("string"), 1, 19), F.lit(" "), F.lit("T")), F.when(fraction == 0, "").otherwise(F.concat(F.lit("."), F.lpad(fraction.cast("string"), 6, "0"))), F.lit("+00:00"))


def lenient_text(value) -> Column:
    """ISO text of what can be read as ISO time, other text as it is, null for null or empty text."""
    text = _column(value)
    return F.when(text != "", F.coalesce(iso_text(utc_timestamp(text)), text))
