"""Dates, deadlines and retries as Spark columns. `now` is always given."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def day_key(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd")


def millis(ts: Column) -> Column:
    return F.unix_millis(ts.cast("timestamp"))


def deadline_countdown(deadline: Column, now_ms: Column) -> Column:
    """struct<end_ms, passed, days, hours, urgency> of a yyyy-mm-dd deadline anywhere on earth; null if it is no date."""
    day = F.try_to_timestamp(F.when(deadline.rlike(r"^\d{4}-\d{2}-\d{2}$"), deadline), F.lit("yyyy-MM-dd"))
    end = F.unix_millis(day) + (36 * 3600 - 1) * 1000
    left = end - now_ms
    passed = left < 0
    days = F.abs(F.floor(left / F.lit(86_400_000)))
    hours = F.floor(F.pmod(F.abs(left), F.lit(86_400_000)) / F.lit(3_600_000))
    urgency = F.when(passed, "passed").when(days <= 3, "critical").when(days <= 14, "soon").when(days <= 45, "normal").otherwise("far")
    return F.when(day.isNotNull(), F.struct(end.alias("end_ms"), passed.alias("passed"), days.cast("int").alias("days"), hours.cast("int").alias("hours"), urgency.alias("urgency")))


def retry_delay_ms(attempt: Column, base: int = 2_000, most: int = 30_000) -> Column:
    return F.least(F.lit(most), F.lit(base) * F.pow(F.lit(2), F.greatest(attempt, F.lit(0)))).cast("long")


def relative_time(ts_ms: Column, now_ms: Column) -> Column:
    """刚刚, N 分钟前, N 小时前, N 天前, or month, day and time."""
    ago = F.greatest(F.lit(0), now_ms - ts_ms)
    return (
        F.when(ago < 60_000, "刚刚")
        .when(ago < 3_600_000, F.concat(F.floor(ago / F.lit(60_000)).cast("string"), F.lit(" 分钟前")))
        .when(ago < 86_400_000, F.concat(F.floor(ago / F.lit(3_600_000)).cast("string"), F.lit(" 小时前")))
        .when(ago < 7 * 86_400_000, F.concat(F.floor(ago / F.lit(86_400_000)).cast("string"), F.lit(" 天前")))
        .otherwise(F.date_format(F.timestamp_millis(ts_ms), "MM/dd HH:mm"))
    )
