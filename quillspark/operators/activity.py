"""Activity and usage by day: pivot, last-N-days summary, gap-filled heat map, cost, retention.

Day rows are pre-aggregated before they are shuffled; what comes after works on days, whose number is bounded by the
calendar and not by the events.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Activity kinds and their counters.
KINDS = {"read-minutes": "read_minutes", "page-translated": "pages_translated", "tokens": "tokens", "paper-opened": "papers_opened", "agent-ask": "agent_asks"}
KEEP_DAYS, USAGE_DAYS = 400, 45


def by_day(activity: DataFrame, keep: int = KEEP_DAYS) -> DataFrame:
    """activity (day DATE, kind, amount) -> a row for each of the newest `keep` days with a counter for each kind.

    Amounts are rounded and never negative; unknown kinds count for nothing.
    """
    n = F.greatest(F.lit(0), F.floor(F.coalesce("amount", F.lit(0.0)) + 0.5)).cast("long")
    known = activity.filter(F.col("kind").isin(*KINDS) & F.col("day").isNotNull())
    days = known.groupBy("day").agg(*[F.sum(F.when(F.col("kind") == k, n).otherwise(0)).alias(c) for k, c in KINDS.items()])
    return days.orderBy(F.col("day").desc()).limit(keep)


def summary(days: DataFrame, today: dt.date, n: int = 7) -> DataFrame:
    """One row: the sums of the n days up to today and active_days (those with reading, pages or asks)."""
    window = days.filter(F.col("day").between(F.lit(today - dt.timedelta(n - 1)), F.lit(today)))
    active = (F.col("read_minutes") != 0) | (F.col("pages_translated") != 0) | (F.col("agent_asks") != 0)
    return window.agg(*[F.coalesce(F.sum(c), F.lit(0).cast("long")).alias(c) for c in KINDS.values()], F.count_if(active).alias("active_days"))


def heatmap(days: DataFrame, today: dt.date, weeks: int = 12) -> DataFrame:
    """A row for each cell of weeks x 7 days from a Monday on: week, weekday, day, minutes, level; days to come are null."""
    monday = today - dt.timedelta(today.weekday())
    start = monday - dt.timedelta(7 * (weeks - 1))
    spine = days.sparkSession.range(weeks * 7).select(F.floor(F.col("id") / 7).cast("int").alias("week"), (F.col("id") % 7).cast("int").alias("weekday"), F.date_add(F.lit(start), F.col("id").cast("int")).alias("day"))
    values = days.filter(F.col("day").between(F.lit(start), F.lit(today))).select("day", (F.col("read_minutes") + 2 * F.col("pages_translated")).alias("minutes"))
    # at most weeks * 7 rows
    cells = spine.join(F.broadcast(values), "day", "left").withColumn("minutes", F.when(F.col("day") <= F.lit(today), F.coalesce("minutes", F.lit(0).cast("long"))))
    top = F.max("minutes").over(Window.partitionBy())
    m = F.col("minutes")
    level = F.when(m.isNull(), None).when(m == 0, 0).when(m >= top * 0.75, 4).when(m >= top * 0.5, 3).when(m >= top * 0.25, 2).otherwise(1)
    return cells.select("week", "weekday", "day", "minutes", level.alias("level"))


def flat_cost(days: DataFrame, price: float) -> DataFrame:
    """One row: all kept tokens and their cost at a price for a million."""
    total = F.coalesce(F.sum("tokens"), F.lit(0).cast("long"))
    return days.agg(total.alias("tokens"), (total / 1e6 * max(price, 0.0)).alias("cost"))


def usage_by_day(samples: DataFrame, keep: int = USAGE_DAYS) -> DataFrame:
    """samples (day, prompt_tokens, completion_tokens) -> day (null: all samples), requests and sums; the newest `keep` days."""
    p, c = (F.greatest(F.lit(0), F.floor(F.coalesce(x, F.lit(0)) + 0.5)).cast("long") for x in ("prompt_tokens", "completion_tokens"))
    days = samples.groupBy("day").agg(F.count("*").alias("requests"), F.sum(p).alias("prompt_tokens"), F.sum(c).alias("completion_tokens"))
    newest = days.orderBy(F.col("day").desc()).limit(keep)
    total = days.agg(F.lit(None).cast("date").alias("day"), F.sum("requests").alias("requests"), F.sum("prompt_tokens").alias("prompt_tokens"), F.sum("completion_tokens").alias("completion_tokens"))
    return newest.unionByName(total)


def usage_cost(total: DataFrame, in_price: float | None, out_price: float | None) -> DataFrame:
    """One row: prompt and completion tokens priced apart for a million; null without any price."""
    p, c = F.coalesce(F.sum("prompt_tokens"), F.lit(0).cast("long")), F.coalesce(F.sum("completion_tokens"), F.lit(0).cast("long"))
    cost = F.lit(None).cast("double") if in_price is None and out_price is None else p / 1e6 * float(in_price or 0) + c / 1e6 * float(out_price or 0)
    return total.agg(p.alias("prompt_tokens"), c.alias("completion_tokens"), cost.alias("cost"))
