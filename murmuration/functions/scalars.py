"""Time, number and JSON functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Numbers above are milliseconds, others seconds.
MILLISECONDS = 1e11
#: The last microsecond of year 9999; later epochs are no time.
LATEST_MICROS = 253402300799999999
EARLIEST_MICROS = -62135596800000000
FORMATS = ("yyyy-MM-dd HH:mm:ss", "yyyy/MM/dd HH:mm:ss", "yyyy-MM-dd HH:mm", "yyyy-MM-dd")
ISO = r"^\d{4}-?\d{2}-?\d{2}([ T]\d{2}(:?\d{2}(:?\d{2}([.,]\d{1,6})?)?)?(Z|[+-]\d{2}(:?\d{2}(:?\d{2})?)?)?)?$"


def epoch(c: Column) -> Column:
    """Timestamp of seconds or milliseconds; null if out of range."""
    v = c.cast("double")
    micros = F.round(F.when(v > MILLISECONDS, v / 1000.0).otherwise(v) * 1e6)
    return F.when((micros <= LATEST_MICROS) & (micros >= EARLIEST_MICROS), F.timestamp_micros(micros.cast("long")))


def parse_time(c: Column) -> Column:
    """Timestamp of a text: digits as an epoch, ISO 8601 (no offset: UTC), or one of FORMATS; null for anything else."""
    raw = F.regexp_replace(c, r"(?U)^\s+|\s+$", "")
    digits = raw.rlike(r"^[0-9]+$")
    iso = F.when(raw.rlike(ISO), F.try_to_timestamp(F.regexp_replace(F.replace(raw, F.lit(","), F.lit(".")), r"^(\d{4})-?(\d{2})-?(\d{2})", "$1-$2-$3")))
    formats = [F.try_to_timestamp(raw, F.lit(f)) for f in FORMATS]
    return F.when(digits, epoch(F.when(digits, raw).try_cast("double") if hasattr(raw, "try_cast") else raw.cast("double"))).otherwise(F.coalesce(iso, *formats))


def safe_div(a: Column, b: Column, default: float = 0.0) -> Column:
    return F.when(b == 0, F.lit(default)).otherwise(a / b)


def clamp(c: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), c))


def micros(c: Column) -> Column:
    return F.unix_micros(c.cast("timestamp"))


def age_days(created: Column, now: Column) -> Column:
    return (micros(now) - micros(created)) / 8.64e10


def follower_ratio(following: Column, followers: Column) -> Column:
    return following / (followers + 1)


def isoformat(c: Column) -> Column:
    """ISO 8601 in UTC, with microseconds only if there are any."""
    whole = F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss")
    rest = F.date_format(c, "SSSSSS")
    return F.concat(whole, F.when(rest == "000000", F.lit("")).otherwise(F.concat(F.lit("."), rest)), F.lit("+00:00"))


def to_int(c: Column) -> Column:
    """Whole number of a text; what isn't one gives 0."""
    return F.coalesce(F.when(F.trim(c).rlike(r"^[+-]?\d+$"), F.trim(c)).try_cast("long"), F.lit(0).cast("long"))


def optional(c: Column) -> Column:
    return F.when(c != "", c)
