"""Column functions over epoch ids, ISO texts, relative times and time buckets.

All functions expect a UTC session; ``as_of`` stands for "now" and is always given.
"""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import Column
from pyspark.sql import functions as F

MINUTE, HOUR, DAY = 60, 3_600, 86_400
# A month is 30 days and a year 365 days in relative times.
WEEK, MONTH, YEAR = 7 * DAY, 30 * DAY, 365 * DAY
BUCKETS = ("hour", "day", "none")


def instant(value: str | datetime | Column) -> Column:
    """A timestamp column from an ISO text, a datetime (UTC when naive) or a column."""
    if isinstance(value, Column):
        return value
    if isinstance(value, str):
        value = datetime.fromisoformat(value.replace("Z", "+00:00"))
    if value.tzinfo is None:
        value = value.replace(tzinfo=timezone.utc)
    return F.timestamp_micros(F.lit(round(value.timestamp() * 1_000_000)))


def from_epoch(text: Column) -> Column:
    """Epoch text with up to six decimals to a timestamp, exact; malformed gives null."""
    micros = text.try_cast("decimal(20,6)") * F.lit(1_000_000)
    return F.timestamp_micros(micros.cast("bigint"))


def from_iso(text: Column) -> Column:
    """ISO-8601 text to a timestamp; malformed or empty gives null."""
    return text.try_cast("timestamp")


def iso_text(ts: Column) -> Column:
    """ISO-8601 with ``Z``; the fraction is left out when it is zero."""
    whole = F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'")
    exact = F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
    return F.when(F.unix_micros(ts) % 1_000_000 == 0, whole).otherwise(exact)


def day_of(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd")


def seconds_between(ts: Column, as_of: Column) -> Column:
    return F.floor((F.unix_micros(as_of) - F.unix_micros(ts)) / 1_000_000).cast("bigint")


def _whole(seconds: Column, unit: int) -> Column:
    return F.floor(seconds / unit).cast("bigint")


def relative_long(ts: Column, as_of: Column) -> Column:
    """"just now", "5 mins ago", "1 hour ago" … "2 years ago"."""
    seconds = seconds_between(ts, as_of)
    text = F.when(seconds < MINUTE, "just now")
    steps = [
        (HOUR, MINUTE, "min"),
        (DAY, HOUR, "hour"),
        (WEEK, DAY, "day"),
        (MONTH, WEEK, "week"),
        (YEAR, MONTH, "month"),
        (None, YEAR, "year"),
    ]
    for below, unit, word in steps:
        n = _whole(seconds, unit)
        phrase = F.concat(n, F.lit(f" {word}"), F.when(n == 1, "").otherwise("s"), F.lit(" ago"))
        text = text.otherwise(phrase) if below is None else text.when(seconds < below, phrase)
    return F.when(ts.isNotNull(), text)


def relative_short(ts: Column, as_of: Column) -> Column:
    """"just now", "5m ago", "3h ago", "2d 4h ago"."""
    seconds = seconds_between(ts, as_of)
    text = (
        F.when(seconds < MINUTE, "just now")
        .when(seconds < HOUR, F.concat(_whole(seconds, MINUTE), F.lit("m ago")))
        .when(seconds < DAY, F.concat(_whole(seconds, HOUR), F.lit("h ago")))
        .otherwise(
            F.concat(
                _whole(seconds, DAY), F.lit("d "), _whole(seconds % DAY, HOUR), F.lit("h ago")
            )
        )
    )
    return F.when(ts.isNotNull(), text)


def stamp(text: Column, as_of: Column) -> Column:
    """``YYYY-MM-DD HH:MM (relative)``; malformed keeps its first 16 characters."""
    ts = from_iso(text)
    good = F.concat(
        F.date_format(ts, "yyyy-MM-dd HH:mm"), F.lit(" ("), relative_long(ts, as_of), F.lit(")")
    )
    return (
        F.when(F.coalesce(text, F.lit("")) == "", "unknown time")
        .when(ts.isNull(), F.substring(text, 1, 16))
        .otherwise(good)
    )


def stamp_short(text: Column) -> Column:
    """``HH:MM``; malformed keeps its first 5 characters."""
    ts = from_iso(text)
    return (
        F.when(F.coalesce(text, F.lit("")) == "", "unknown")
        .when(ts.isNull(), F.substring(text, 1, 5))
        .otherwise(F.date_format(ts, "HH:mm"))
    )


def bucket_start(ts: Column, bucket: str) -> Column:
    if bucket not in ("hour", "day"):
        raise ValueError(f"Invalid bucket_type: {bucket}")
    return F.date_trunc(bucket, ts)


def bucket_end(ts: Column, bucket: str) -> Column:
    """Last whole second of the bucket."""
    width = {"hour": HOUR, "day": DAY}[bucket]
    start = F.unix_seconds(bucket_start(ts, bucket))
    return F.timestamp_seconds(start + width - 1)


def bucket_label(start: Column, bucket: str) -> Column:
    if bucket == "hour":
        return F.date_format(start, "yyyy-MM-dd HH:'00'-HH:'59'")
    return F.date_format(start, "yyyy-MM-dd")
