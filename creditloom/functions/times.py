"""UTC timestamps, day and month keys, retry delays."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from ..config import RETRY_DELAYS

__all__ = [
    "epoch_seconds_iso",
    "registered_iso",
    "day_key",
    "month_key",
    "seconds_until_tomorrow",
    "retry_delay_seconds",
]

_ISO = "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"


def epoch_seconds_iso(seconds: Column) -> Column:
    return F.date_format(F.timestamp_seconds(seconds), _ISO)


def registered_iso(unixtime: Column, text: Column) -> Column:
    """Registration time from epoch seconds, else from text; null when neither parses."""
    seconds = unixtime.try_cast("bigint")
    # Words such as "yesterday" parse as timestamps too, so a date must lead.
    dated = F.when(F.trim(text).rlike(r"^[0-9]{4}-"), F.trim(text))
    from_text = F.date_format(F.try_to_timestamp(dated), _ISO)
    return F.when(seconds >= 0, epoch_seconds_iso(seconds)).otherwise(from_text)


def day_key(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd")


def month_key(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM")


def seconds_until_tomorrow(ts: Column) -> Column:
    """Whole seconds to the next UTC day, rounded up, at least one."""
    micros = F.unix_micros(ts)
    day = F.lit(86_400_000_000)
    left = day - F.pmod(micros, day)
    return F.greatest(F.lit(1).cast("bigint"), F.ceil(left / F.lit(1_000_000)).cast("bigint"))


def retry_delay_seconds(attempts: Column) -> Column:
    """Delay after the given attempt (1-based), clamped to the table."""
    delays = F.array(*[F.lit(d) for d in RETRY_DELAYS])
    return F.element_at(delays, F.greatest(F.lit(1), F.least(attempts, F.lit(len(RETRY_DELAYS)))).cast("int"))
