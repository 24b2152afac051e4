"""Activity and usage analytics over events and conversations; `today` is fixed so that results repeat."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillspark.functions import text as T
from quillspark.operators import activity as A
from quillspark.sources import tables

TODAY = dt.date(2024, 1, 24)


def activity_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = tables.read(spark, sf_dir, "events")
    kinds = list(A.KINDS)
    kind = F.element_at(F.array(*[F.lit(k) for k in [*kinds, "unknown"]]), (F.col("event_id") % 6 + 1).cast("int"))
    return events.select(F.to_date("ts").alias("day"), kind.alias("kind"), F.col("value").alias("amount"), "user_id", "event_id")


def _days(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.by_day(activity_log(spark, sf_dir))


_N = "greatest(0, floor(coalesce(value, 0) + 0.5))::BIGINT"
DAYS_SQL = "SELECT ts::DATE AS day, " + ", ".join(f"sum(CASE WHEN event_id % 6 = {i} THEN {_N} ELSE 0 END)::BIGINT AS {c}" for i, c in enumerate(A.KINDS.values())) + f" FROM events WHERE event_id % 6 < 5 GROUP BY ALL ORDER BY day DESC LIMIT {A.KEEP_DAYS}"


def last_day(days: DataFrame) -> dt.date:
    return days.agg(F.max("day")).first()[0] or TODAY


def activity_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _days(spark, sf_dir)


def activity_summary_7d(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = _days(spark, sf_dir)
    return A.summary(days, last_day(days))


_SUMS = ", ".join(f"coalesce(sum({c}), 0)::BIGINT AS {c}" for c in A.KINDS.values())
_ACTIVE = "count(*) FILTER (read_minutes <> 0 OR pages_translated <> 0 OR agent_asks <> 0) AS active_days"
SUMMARY_SQL = f"WITH d AS ({DAYS_SQL}), t AS (SELECT max(day) AS today FROM d) SELECT {_SUMS}, {_ACTIVE} FROM d, t WHERE day BETWEEN today - INTERVAL 6 DAY AND today"


def activity_week_over_week(spark: SparkSession, sf_dir: str) -> DataFrame:
    """This week's sums against the week's before: one row for each counter."""
    days = _days(spark, sf_dir)
    today = last_day(days)
    this, last = A.summary(days, today), A.summary(days, today - dt.timedelta(7))
    names = [*A.KINDS.values(), "active_days"]
    long = lambda df, c: df.select(F.explode(F.array(*[F.struct(F.lit(n).alias("counter"), F.col(n).cast("long").alias(c)) for n in names])).alias("x")).select("x.*")
    return long(this, "this_week").join(long(last, "last_week"), "counter").withColumn("change", F.col("this_week") - F.col("last_week"))


_COUNTERS = [*A.KINDS.values(), "active_days"]
WEEKS_SQL = (
    f"WITH d AS ({DAYS_SQL}), t AS (SELECT max(day) AS today FROM d), a AS (SELECT {_SUMS}, {_ACTIVE} FROM d, t WHERE day BETWEEN today - INTERVAL 6 DAY AND today), b AS (SELECT {_SUMS}, {_ACTIVE} FROM d, t WHERE day BETWEEN today - INTERVAL 13 DAY AND today - INTERVAL 7 DAY) "
    + " UNION ALL ".join(f"SELECT '{c}' AS counter, a.{c}::BIGINT AS this_week, b.{c}::BIGINT AS last_week, (a.{c} - b.{c})::BIGINT AS change FROM a, b" for c in _COUNTERS)
)


def activity_heatmap(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = _days(spark, sf_dir)
    return A.heatmap(days, last_day(days))


HEATMAP_SQL = f"""
    WITH d AS ({DAYS_SQL}), t AS (SELECT max(day) AS today FROM d), s AS (SELECT today, (today - (isodow(today) - 1)::INTEGER - 77)::DATE AS start FROM t),
    g AS (SELECT i // 7 AS week, i % 7 AS weekday, (start + i::INTEGER)::DATE AS day, today FROM s, range(84) AS r(i)),
    c AS (SELECT week, weekday, g.day, CASE WHEN g.day <= today THEN coalesce(read_minutes + 2 * pages_translated, 0) END AS minutes FROM g LEFT JOIN d ON d.day = g.day AND g.day <= today),
    m AS (SELECT max(minutes) AS top FROM c)
    SELECT week::INTEGER AS week, weekday::INTEGER AS weekday, day, minutes::BIGINT AS minutes, CASE WHEN minutes IS NULL THEN NULL WHEN minutes = 0 THEN 0 WHEN minutes >= top * 0.75 THEN 4 WHEN minutes >= top * 0.5 THEN 3 WHEN minutes >= top * 0.25 THEN 2 ELSE 1 END AS level FROM c, m"""


def activity_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.flat_cost(_days(spark, sf_dir), 2.5).select("tokens", F.round("cost", 9).alias("cost"))


def estimate_tokens_by_role(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = tables.read(spark, sf_dir, "conversations")
    n = T.estimated_tokens(F.col("text"))
    return turns.groupBy("role").agg(F.count("*").alias("turns"), F.sum(n).alias("tokens"), F.max(n).alias("longest"))


_TOKENS = "ceil(length(regexp_replace(coalesce(text, ''), '[^\\x{3000}-\\x{9fff}\\x{f900}-\\x{faff}\\x{ff00}-\\x{ffef}]', '', 'g')) + (length(coalesce(text, '')) - length(regexp_replace(coalesce(text, ''), '[^\\x{3000}-\\x{9fff}\\x{f900}-\\x{faff}\\x{ff00}-\\x{ffef}]', '', 'g'))) / 4.0)::BIGINT"


def usage_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A request for each turn: its text is the prompt or the completion, by role; the day follows the conversation."""
    turns = tables.read(spark, sf_dir, "conversations")
    n = T.estimated_tokens(F.col("text"))
    asked = F.col("role") == "user"
    return turns.select(F.date_add(F.lit(TODAY), -(F.col("conv_id") % 60).cast("int")).alias("day"), F.when(asked, n + 600).otherwise(0).alias("prompt_tokens"), F.when(asked, 0).otherwise(n).alias("completion_tokens"))


_SAMPLES = f"SELECT (DATE '{TODAY}' - (conv_id % 60)::INTEGER)::DATE AS day, CASE WHEN role = 'user' THEN {_TOKENS} + 600 ELSE 0 END AS p, CASE WHEN role = 'user' THEN 0 ELSE {_TOKENS} END AS c FROM conversations"


def usage_by_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.usage_by_day(usage_samples(spark, sf_dir))


USAGE_SQL = f"WITH s AS ({_SAMPLES}), d AS (SELECT day, count(*) AS requests, sum(p)::BIGINT AS prompt_tokens, sum(c)::BIGINT AS completion_tokens FROM s GROUP BY day) (SELECT * FROM d ORDER BY day DESC LIMIT {A.USAGE_DAYS}) UNION ALL SELECT NULL, sum(requests)::BIGINT, sum(prompt_tokens)::BIGINT, sum(completion_tokens)::BIGINT FROM d"


def usage_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    total = A.usage_by_day(usage_samples(spark, sf_dir)).filter("day IS NULL")
    return A.usage_cost(total, 3.0, 15.0).select("prompt_tokens", "completion_tokens", F.round("cost", 9).alias("cost"))


COST_SQL = f"WITH s AS ({_SAMPLES}) SELECT sum(p)::BIGINT AS prompt_tokens, sum(c)::BIGINT AS completion_tokens, round(sum(p) / 1e6 * 3.0 + sum(c) / 1e6 * 15.0, 9) AS cost FROM s"


def session_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user's sessions: runs of events at most 30 minutes apart."""
    events = tables.read(spark, sf_dir, "events").filter("user_id IS NOT NULL")
    own = Window.partitionBy("user_id").orderBy("ts", "event_id")
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    fresh = F.when(at - F.lag(at).over(own) <= 1_800_000_000, 0).otherwise(1)
    rows = events.select("user_id", "event_id", "ts", fresh.alias("fresh")).withColumn("session", F.sum("fresh").over(own))
    return rows.groupBy("user_id", "session").agg(F.count("*").alias("events"), F.min("ts").alias("begins"), F.max("ts").alias("ends"))


GAPS_SQL = """
    WITH f AS (SELECT user_id, event_id, ts, CASE WHEN ts - lag(ts) OVER w <= INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM events WHERE user_id IS NOT NULL WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
    s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id)::BIGINT AS session FROM f)
    SELECT user_id, session, count(*) AS events, min(ts) AS begins, max(ts) AS ends FROM s GROUP BY ALL"""

QUERIES = {
    "activity_pivot": (activity_pivot, DAYS_SQL),
    "activity_summary_7d": (activity_summary_7d, SUMMARY_SQL),
    "activity_week_over_week": (activity_week_over_week, WEEKS_SQL),
    "activity_heatmap": (activity_heatmap, HEATMAP_SQL),
    "activity_cost": (activity_cost, f"WITH d AS ({DAYS_SQL}) SELECT sum(tokens)::BIGINT AS tokens, round(sum(tokens) / 1e6 * 2.5, 9) AS cost FROM d"),
    "estimate_tokens_by_role": (estimate_tokens_by_role, f"SELECT role, count(*) AS turns, sum({_TOKENS})::BIGINT AS tokens, max({_TOKENS}) AS longest FROM conversations GROUP BY role"),
    "usage_by_day": (usage_by_day, USAGE_SQL),
    "usage_cost": (usage_cost, COST_SQL),
    "session_gaps": (session_gaps, GAPS_SQL),
}
