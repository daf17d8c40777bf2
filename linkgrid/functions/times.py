"""Time columns: hour floors, cyclical features, local solar phrasing, fixed schedule."""

from __future__ import annotations

from datetime import UTC, datetime

from pyspark.sql import Column
from pyspark.sql import functions as F

# Seconds of every UTC minute at which links are reassigned.
RECONFIG_SECONDS = (12, 27, 42, 57)
# Dayparts by local hour, end exclusive; everything else is night.
DAYPARTS = ((5, 12, "morning"), (12, 17, "afternoon"), (17, 22, "evening"))

HOUR_SECONDS = 3600
HORIZON_HOURS = 48
_MINUTE_MICROS = 60_000_000


def utc_literal(when: datetime) -> Column:
    """A timestamp literal; naive input is read as UTC."""
    aware = when if when.tzinfo is not None else when.replace(tzinfo=UTC)
    return F.timestamp_micros(F.lit(round(aware.timestamp() * 1e6)).cast("bigint"))


def hour_of(ts: Column) -> Column:
    """UTC hour a timestamp falls in."""
    return F.date_trunc("hour", ts)


def hour_of_epoch(seconds: Column) -> Column:
    return hour_of(F.timestamp_seconds(seconds))


def shift_hours(ts: Column, hours: int) -> Column:
    return F.timestamp_seconds(F.unix_seconds(ts) + hours * HOUR_SECONDS)


def time_features(ts: Column, lon: Column) -> dict[str, Column]:
    """Cyclical hour of day, Monday-based weekday and the solar offset in hours."""
    decimal = F.hour(ts) + F.minute(ts) / 60.0 + F.second(ts) / 3600.0
    angle = F.lit(2.0) * F.pi() * decimal / 24.0
    return {
        "hour_sin": F.sin(angle),
        "hour_cos": F.cos(angle),
        "day_of_week": F.weekday(ts).cast("double"),
        "local_solar_offset_h": lon / 15.0,
    }


def solar_phrase(ts: Column, lon: Column) -> Column:
    """'Monday evening' in local solar time."""
    offset = F.bround(lon / 15.0 * 3_600_000_000.0).cast("bigint")
    local = F.timestamp_micros(F.unix_micros(ts) + offset)
    hour = F.hour(local)
    part = F.lit("night")
    for first, stop, name in DAYPARTS:
        part = F.when((hour >= first) & (hour < stop), F.lit(name)).otherwise(part)
    return F.concat_ws(" ", F.date_format(local, "EEEE"), part)


def next_reconfig(ts: Column) -> Column:
    """First scheduled instant strictly after ``ts``."""
    micros = F.unix_micros(ts)
    into_minute = F.pmod(micros, F.lit(_MINUTE_MICROS))
    ahead = [F.lit(s * 1_000_000) for s in RECONFIG_SECONDS]
    wrap = F.lit(_MINUTE_MICROS + RECONFIG_SECONDS[0] * 1_000_000)
    step = F.coalesce(F.array_min(F.filter(F.array(*ahead), lambda b: b > into_minute)), wrap)
    return F.timestamp_micros(micros - into_minute + step)


def seconds_to_reconfig(ts: Column) -> Column:
    return (F.unix_micros(next_reconfig(ts)) - F.unix_micros(ts)) / 1e6


def horizon_hours(now: Column, hours: int = HORIZON_HOURS) -> Column:
    """Array of hour starts from the current hour on."""
    start = hour_of(now)
    return F.sequence(start, shift_hours(start, hours - 1), F.expr("INTERVAL 1 HOUR"))
