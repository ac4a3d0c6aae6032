"""Time helpers that do not depend on the session time zone.

Every helper takes a TIMESTAMP or a TIMESTAMP_NTZ column. A TIMESTAMP is an
instant; a TIMESTAMP_NTZ is read as UTC wall-clock time.
"""

from __future__ import annotations

import re
from datetime import date, datetime, timedelta, timezone

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidelog.schema import BUCKETS

UTC = timezone.utc
EPOCH = datetime(1970, 1, 1, tzinfo=UTC)
MICROSECOND = timedelta(microseconds=1)
DAY_MICROS = 86_400_000_000

# Fixed pattern: ISO-8601 date-time that carries Z or an offset below 16 hours;
# seconds and their fraction may be absent. The calendar itself (month length,
# hour 24) is left to the cast.
ISO_PATTERN = (
    r"^(?!0000)\d{4}-\d{2}-\d{2}T\d{2}:\d{2}(:\d{2}(\.\d+)?)?"
    r"(Z|[+-](0\d|1[0-5]):[0-5]\d)(?![\s\S])"
)
_ISO = re.compile(ISO_PATTERN, re.ASCII)


def whole_quotient(number: Column, by: Column) -> Column:
    """Integer division of integers, cut towards zero; never goes through a double."""
    return F.call_function("div", number, by)


def is_ntz(df: DataFrame, name: str) -> bool:
    return isinstance(df.schema[name].dataType, T.TimestampNTZType)


def parse_iso(text: str) -> datetime:
    """ISO-8601 text to an aware UTC datetime; digits past microseconds are cut."""
    if not isinstance(text, str) or _ISO.match(text) is None:
        raise ValueError(f"not an ISO-8601 timestamp: {text!r}")
    text = re.sub(r"(\.\d{6})\d+", r"\1", text)
    return datetime.fromisoformat(text).astimezone(UTC)


def format_iso(moment: datetime) -> str:
    """Aware datetime to ISO-8601 UTC text with all six fraction digits."""
    return moment.astimezone(UTC).strftime("%Y-%m-%dT%H:%M:%S.%f").rjust(26, "0") + "Z"


def iso_to_timestamp(text: Column) -> Column:
    """ISO-8601 text column to TIMESTAMP, NULL when it is not a valid one."""
    with_seconds = F.when(F.substring(text, 17, 1) == ":", text).otherwise(
        F.concat(F.substring(text, 1, 16), F.lit(":00"), F.substring(text, 17, 6))
    )
    return F.when(text.rlike(ISO_PATTERN), with_seconds.try_cast("timestamp"))


def time_literal(moment: datetime, ntz: bool = False) -> Column:
    """A foldable literal of the type of the column it is compared with."""
    if ntz:
        text = moment.astimezone(UTC).strftime("%Y-%m-%d %H:%M:%S.%f").rjust(26, "0")
        return F.lit(text).cast("timestamp_ntz")
    return F.timestamp_micros(F.lit(to_micros(moment)).cast("long"))


def to_micros(moment: datetime) -> int:
    return (moment - EPOCH) // MICROSECOND


def bucket(ts: Column, width: str) -> Column:
    """Start of the tumbling bucket of ``ts``, aligned to the Unix epoch in UTC."""
    return F.window(ts, BUCKETS[width])["start"]


def utc_wall_clock(df: DataFrame, name: str) -> Column:
    """The UTC wall-clock time of a timestamp column, as TIMESTAMP_NTZ."""
    if is_ntz(df, name):
        return F.col(name)
    seconds = F.unix_micros(F.col(name)).cast("decimal(24,0)") / F.lit(1_000_000)
    zero = F.lit(0)
    return F.lit("1970-01-01 00:00:00").cast("timestamp_ntz") + F.make_dt_interval(
        zero, zero, zero, seconds.cast("decimal(18,6)")
    )


def epoch_micros(df: DataFrame, name: str) -> Column:
    """Microseconds since the Unix epoch."""
    ts = F.col(name)
    if not is_ntz(df, name):
        return F.unix_micros(ts)
    minutes = (F.unix_date(F.to_date(ts)) * F.lit(24).cast("long") + F.hour(ts)) * 60 + F.minute(ts)
    seconds = F.extract(F.lit("SECOND"), ts)
    return minutes * 60_000_000 + (seconds * 1_000_000).cast("long")


def utc_instant(df: DataFrame, name: str) -> Column:
    """The instant of a timestamp column, as TIMESTAMP."""
    return F.timestamp_micros(epoch_micros(df, name)) if is_ntz(df, name) else F.col(name)


def day_of(df: DataFrame, name: str) -> Column:
    """UTC calendar day of a timestamp column."""
    if is_ntz(df, name):
        return F.to_date(F.col(name))
    micros, day = F.unix_micros(F.col(name)), F.lit(DAY_MICROS)
    return F.date_from_unix_date(whole_quotient(micros - F.pmod(micros, day), day).cast("int"))


def iso_text(df: DataFrame, name: str, digits: int = 3) -> Column:
    """ISO-8601 UTC text with ``digits`` fraction digits (cut, not rounded)."""
    text = utc_wall_clock(df, name).cast("string")
    fraction = F.rpad(F.substring(text, 21, digits), digits, "0")
    return F.concat(
        F.substring(text, 1, 10), F.lit("T"), F.substring(text, 12, 8),
        F.lit("."), fraction, F.lit("Z"),
    )


def floor_minute(moment: datetime) -> datetime:
    return moment.replace(second=0, microsecond=0)


def ceil_minute(moment: datetime) -> datetime:
    """Next whole minute, exact to the microsecond."""
    floor = floor_minute(moment)
    return floor if floor == moment else floor + timedelta(minutes=1)


def utc_day(moment: datetime) -> date:
    return moment.astimezone(UTC).date()


def partition_name(day: Column, prefix: str = "logs_") -> Column:
    """Name of a day partition, ``logs_YYYYMMDD``."""
    return F.concat(F.lit(prefix), F.date_format(day, "yyyyMMdd"))


def partition_day(name: Column, prefix: str = "logs_") -> Column:
    """Day of a partition name; NULL when the name is not one of ours."""
    digits = F.regexp_extract(name, f"^{re.escape(prefix)}(\\d{{8}})$", 1)
    return F.when(digits != "", F.to_date(F.try_to_timestamp(digits, F.lit("yyyyMMdd"))))
