"""Duration strings, time buckets and offsets."""

from __future__ import annotations

import datetime as dt
import re
from dataclasses import dataclass

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

# Units of a duration string, in microseconds or calendar months.
_MICROS = {"us": 1, "ms": 1_000, "s": 1_000_000, "m": 60_000_000, "h": 3_600_000_000, "d": 86_400_000_000, "w": 604_800_000_000}
_MONTHS = {"mo": 1, "q": 3, "y": 12}
_PART = re.compile(r"(\d+)(us|µs|ms|mo|ns|s|m|h|d|w|q|y)")
DAY_US = 86_400_000_000
WEEK_US = 7 * DAY_US
_MONDAY_US = 4 * DAY_US  # 1970-01-05


@dataclass(frozen=True)
class Duration:
    months: int = 0
    micros: int = 0

    def __neg__(self) -> Duration:
        return Duration(-self.months, -self.micros)


def parse_duration(value: str | dt.timedelta) -> Duration:
    """``"15m"``, ``"1d12h"``, ``"-2h"``, ``"1mo"`` or a timedelta; nanoseconds are truncated to microseconds."""
    if isinstance(value, dt.timedelta):
        return Duration(0, (value.days * 86_400 + value.seconds) * 1_000_000 + value.microseconds)
    if not isinstance(value, str):
        raise TypeError(f"a duration is a str or timedelta, not {type(value).__name__}")
    text, sign = (value[1:], -1) if value.startswith("-") else (value, 1)
    parts = _PART.findall(text)
    if not parts or "".join(n + u for n, u in parts) != text:
        raise ValueError(f"cannot read the duration {value!r}")
    months = sum(int(n) * _MONTHS[u] for n, u in parts if u in _MONTHS)
    nanos = sum(int(n) for n, u in parts if u == "ns")
    micros = sum(int(n) * _MICROS[u.replace("µ", "u")] for n, u in parts if u not in _MONTHS and u != "ns") + nanos // 1000
    return Duration(sign * months, sign * micros)


def _utc() -> bool:
    spark = SparkSession.getActiveSession()
    return spark is not None and (spark.conf.get("spark.sql.session.timeZone") or "").upper() in ("UTC", "ETC/UTC", "GMT", "Z")


def to_micros(ts: Column) -> Column:
    """Microseconds since 1970 of a TIMESTAMP_NTZ's wall clock, whatever the session's time zone."""
    if _utc():
        return F.unix_micros(ts.cast("timestamp"))
    ntz = ts.cast("timestamp_ntz")
    seconds = F.unix_date(ntz.cast("date")).cast("long") * 86_400 + F.hour(ntz) * 3_600 + F.minute(ntz) * 60
    return seconds * 1_000_000 + (F.extract(F.lit("SECOND"), ntz) * 1_000_000).cast("long")


def from_micros(us: Column) -> Column:
    """The TIMESTAMP_NTZ of microseconds since 1970."""
    if _utc():
        return F.timestamp_micros(us).cast("timestamp_ntz")
    zero = F.lit(0)
    return F.lit("1970-01-01 00:00:00").cast("timestamp_ntz") + F.make_dt_interval(zero, zero, zero, (us.cast("decimal(20,0)") / 1_000_000).cast("decimal(18,6)"))


def floor_to(us: Column, step: int, origin: int = 0) -> Column:
    """Largest ``origin + k * step`` not above ``us`` (a bigint), also before the origin."""
    return us - F.pmod(us - F.lit(origin), F.lit(step))


def bucket_start(ts: Column, size: Duration) -> Column:
    """Start of the bucket: fixed sizes from the epoch, whole weeks from a Monday, calendar sizes from month 0."""
    if size.months < 0 or size.micros < 0 or not (size.months or size.micros):
        raise ValueError("a bucket must be longer than 0")
    if size.months and size.micros:
        raise ValueError("a bucket is either calendar months or a fixed length")
    if size.micros:
        return from_micros(floor_to(to_micros(ts), size.micros, _MONDAY_US if size.micros % WEEK_US == 0 else 0))
    month = F.year(ts) * 12 + F.month(ts) - 1
    month = month - F.pmod(month, F.lit(size.months))
    return F.make_date(F.floor(month / 12).cast("int"), (F.pmod(month, F.lit(12)) + 1).cast("int"), F.lit(1)).cast("timestamp_ntz")


def shifted(ts: Column, by: Duration) -> Column:
    """``ts`` moved by calendar months (last day of month kept within the month), then by microseconds."""
    if by.months:
        ts = ts + F.make_ym_interval(F.lit(0), F.lit(by.months))
    return from_micros(to_micros(ts) + F.lit(by.micros)) if by.micros else ts
