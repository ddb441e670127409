"""Column expressions: clock assembly, durations, class cuts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Recording date given to every clock, RUL class cuts and labels.
RECORDING_DATE = "2023-01-01"
RUL_CUTS = (0.25, 0.5)
RUL_LABELS = (3, 2, 1)


def clean(value: Column) -> Column:
    """NaN becomes NULL, so that aggregates skip it."""
    return F.when(~F.isnan(value), value)


def assemble_time(hour: Column, minute: Column, second: Column, millisecond: Column) -> Column:
    """Clock parts added to the recording date; parts beyond their range carry over."""
    seconds = second.cast("decimal(18,6)") + millisecond.cast("decimal(18,6)") / F.lit(1000)
    span = F.make_dt_interval(F.lit(0), hour.cast("int"), minute.cast("int"), seconds.cast("decimal(18,6)"))
    return F.to_timestamp_ntz(F.lit(RECORDING_DATE)) + span


def micros(time: Column) -> Column:
    """Microseconds since 1970 of a zone-less timestamp, whatever the session zone."""
    whole = F.unix_date(F.to_date(time)).cast("bigint") * 86_400_000_000
    clock = F.hour(time).cast("bigint") * 3_600_000_000 + F.minute(time).cast("bigint") * 60_000_000
    return whole + clock + (F.extract(F.lit("SECOND"), time) * 1_000_000).cast("bigint")


def remaining_share(end_us: Column, start_us: Column, now_us: Column) -> Column:
    """(end - now) / (end - start); NULL for a series without duration."""
    return F.try_divide((end_us - now_us).cast("double"), (end_us - start_us).cast("double"))


def rul_class(rul: Column) -> Column:
    """Below 0.25 is 3, below 0.5 is 2, else 1; missing stays missing."""
    return (
        F.when(rul.isNull() | F.isnan(rul), F.lit(None).cast("int"))
        .when(rul < RUL_CUTS[0], RUL_LABELS[0])
        .when(rul < RUL_CUTS[1], RUL_LABELS[1])
        .otherwise(RUL_LABELS[2])
    )


def rul_class5(value: Column) -> Column:
    """Fifths of [0, 1], cut toward zero."""
    return (value * 5).cast("int")
