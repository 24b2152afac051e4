"""Streams over a replay of events and conversations, and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.plans import collections
from quillspark.operators import ranking as R
from quillspark.plans.chats import turns
from quillspark.sources import sinks, tables
from quillspark.streaming import streams as S


def stream_activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.finished(S.daily_counts(S.replay(spark, sf_dir, "events")), tables.place(spark, "activity"), "complete")


def stream_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.finished(S.first_records(S.replay(spark, sf_dir, "events"), ["user_id", "event_type"], "400 days"), tables.place(spark, "dedupe"))


def stream_inactivity(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = S.replay(spark, sf_dir, "events")
    kind = F.element_at(F.array(*[F.lit(x) for x in ("bump", "output", "hold", "bump", "output")]), (F.col("event_id") % 5 + 1).cast("int"))
    rows = events.select(F.col("user_id").alias("request"), F.unix_millis(F.col("ts").cast("timestamp")).alias("ms"), kind.alias("event"))
    return S.finished(S.inactive_requests(rows), tables.place(spark, "inactivity"))


def stream_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as records that arrive in two chunks each."""
    t = S.replay(spark, sf_dir, "conversations")
    line = F.concat(F.to_json(F.struct(F.concat(F.lit("n"), F.col("turn") - F.col("turn") % 2).alias("id"), F.coalesce("text", F.lit("")).alias("text"))), F.lit("\n"))
    cut = F.floor(F.char_length(line) / F.lit(2)).cast("int")
    chunks = t.select("conv_id", "turn", F.posexplode(F.array(F.left(line, cut), F.substring(line, cut + 1, F.lit(1 << 30)))).alias("half", "value"))
    return S.finished(S.assembled_records(chunks.select(F.col("conv_id").alias("request"), (F.col("turn") * 2 + F.col("half")).alias("seq"), "value")), tables.place(spark, "records"))


def translation_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = tables.read(spark, sf_dir, "documents")
    pages = docs.select(F.col("source").alias("doc"), F.col("doc_id").alias("num"), F.when(F.col("doc_id") % 4 != 0, F.col("text")).alias("text"), F.when(F.col("doc_id") % 8 == 0, "error").otherwise("done").alias("outcome"), F.lit("timeout").alias("error"))
    out = sinks.page_report(pages, "译文")
    return out.select("doc", F.md5(F.encode("markdown", "UTF-8")).alias("digest"), "pages", "exported")


REPORT_SQL = """
    WITH p AS (SELECT source AS doc, doc_id AS num, CASE WHEN doc_id % 4 <> 0 THEN regexp_replace(coalesce(text, ''), '^\\s+|\\s+$', '', 'g') ELSE '' END AS t FROM documents),
    r AS (SELECT doc, num, t, '## 第 ' || num || ' 页' || chr(10) || chr(10) || CASE WHEN t <> '' THEN t WHEN num % 8 = 0 THEN '*翻译失败：timeout*' ELSE '*此页尚未翻译*' END || chr(10) AS part FROM p)
    SELECT doc, md5('# 译文' || chr(10) || chr(10) || string_agg(part, chr(10) ORDER BY num)) AS digest, count(*) AS pages, count(*) FILTER (t <> '') AS exported FROM r GROUP BY doc"""


def redaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = tables.read(spark, sf_dir, "customer")
    message = F.concat(F.lit("GET https://u:p@host/x?token="), "c_mktsegment", F.lit("&a=1 Bearer "), F.col("c_custkey").cast("string"))
    return c.select("c_custkey", sinks.redacted(message).alias("message"))


def radar_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    papers = collections.papers(spark, sf_dir)
    return sinks.radar_digest(R.ranked(papers, collections.KEYWORDS, collections.CATEGORIES, papers.filter("false").select("id"), collections.NOW_MS, 50))


def queue_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = tables.read(spark, sf_dir, "events")
    jobs = e.select(F.col("event_id").alias("seq"), F.when(F.col("event_id") % 6 == 0, "priority").otherwise("normal").alias("lane"), (F.col("user_id") % 4).alias("priority"))
    return S.queue_order(jobs)


def bibtex_stubs(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = tables.read(spark, sf_dir, "supplier")
    return s.select("s_suppkey", sinks.bibtex(F.concat(F.lit("k"), "s_suppkey"), F.col("s_name"), F.array(F.lit("A"), F.lit("B")), F.lit(2020)).alias("entry"))


QUERIES = {
    "stream_activity": (stream_activity, "SELECT ts::DATE AS day, event_type, count(*) AS events, round(sum(value), 4) AS total FROM events GROUP BY ALL"),
    "stream_dedupe": (stream_dedupe, "SELECT DISTINCT user_id, event_type FROM events"),
    "stream_inactivity": (stream_inactivity, None),
    "stream_records": (stream_records, "SELECT conv_id AS request, 'n' || (turn - turn % 2) AS id, coalesce(arg_min(text, turn), '') AS text FROM conversations GROUP BY ALL"),
    "translation_report": (translation_report, REPORT_SQL),
    "redaction": (redaction, "SELECT c_custkey, 'GET https://host/x?token=***&a=1 Bearer ***' AS message FROM customer"),
    "radar_digest": (radar_digest, None),
    "queue_positions": (queue_positions, "SELECT event_id AS seq, CASE WHEN event_id % 6 = 0 THEN 'priority' ELSE 'normal' END AS lane, user_id % 4 AS priority, row_number() OVER (PARTITION BY event_id % 6 = 0 ORDER BY user_id % 4, event_id)::INTEGER AS position FROM events"),
    "bibtex_stubs": (bibtex_stubs, "SELECT s_suppkey, '@article{k' || s_suppkey || ',' || chr(10) || '  title = {' || s_name || '},' || chr(10) || '  author = {A and B},' || chr(10) || '  year = {2020}' || chr(10) || '}' || chr(10) AS entry FROM supplier"),
}
