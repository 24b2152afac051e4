"""Conversations, geometry and batches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.operators import chats as C
from quillspark.operators import layout as L
from quillspark.operators import stores as S
from quillspark.plans import dialect as D
from quillspark.sources import tables


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = tables.read(spark, sf_dir, "conversations")
    return t.select(F.col("conv_id").alias("conv"), "turn", "role", F.col("text").alias("content"), F.when(F.col("turn") % 3 == 0, (F.col("conv_id") % 9).cast("int")).alias("page_num"), (F.col("turn") % 4 == 0).alias("had_image"))


_TRIM = "regexp_replace(coalesce(text, ''), '^\\s+|\\s+$', '', 'g')"
_TURNS = f"SELECT conv_id AS conv, turn, role, text, {_TRIM} AS content, CASE WHEN turn % 3 = 0 THEN conv_id % 9 END AS page_num, turn % 4 = 0 AS had_image FROM conversations"


def session_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.sessions(turns(spark, sf_dir))


_LINE = D.one_line("content")
_SESSIONS = f"""
    t AS ({_TURNS}), s AS (SELECT * FROM t WHERE role IN ('user', 'assistant') AND (content <> '' OR had_image) QUALIFY row_number() OVER (PARTITION BY conv ORDER BY turn DESC) <= 80),
    n AS (SELECT *, CASE WHEN role = 'user' THEN CASE WHEN {_LINE} = '' THEN '页图提问 · ' || coalesce('第 ' || page_num || ' 页', '页面') WHEN length({_LINE}) <= 48 THEN {_LINE} ELSE left({_LINE}, 47) || '…' END END AS title FROM s),
    z AS (SELECT conv, coalesce(arg_min(title, turn) FILTER (title IS NOT NULL), '新对话') AS title, count(*) AS messages, count(*) FILTER (role = 'user') AS user_turns, max(turn) AS last_turn FROM n GROUP BY conv)"""


def session_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = C.sessions(turns(spark, sf_dir)).withColumn("place", F.col("conv"))
    return S.capped(rows, S.STORES["chat_sessions"]).select("conv", "title", "messages", C.doc_key(F.col("title"), F.col("messages")).alias("doc_key"), C.doc_title(C.doc_key(F.col("title"), F.col("messages"))).alias("doc_title"))


LIST_SQL = f"WITH {_SESSIONS} SELECT conv, title, messages, 't:' || title || '|p:' || messages AS doc_key, title AS doc_title FROM z ORDER BY conv DESC LIMIT 80"


def stored_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.stored_messages(turns(spark, sf_dir), 4).select("conv", "turn", "role", "content")


def request_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.request_window(turns(spark, sf_dir), 6, 1).select("conv", "turn", "role", "content", "keeps_image")


WINDOW_SQL = f"""
    WITH t AS ({_TURNS}), a AS (SELECT conv, turn, role, page_num, left(regexp_replace(regexp_replace(coalesce(text, ''), '\\r\\n?', chr(10), 'g'), '^\\s+|\\s+$', '', 'g'), 8000) AS content, had_image AND role = 'user' AS image FROM t WHERE role IN ('user', 'assistant')),
    b AS (SELECT *, row_number() OVER w AS back, sum(image::INTEGER) OVER w AS nth FROM a WHERE content <> '' OR image WINDOW w AS (PARTITION BY conv ORDER BY turn DESC))
    SELECT conv, turn, role, image AND nth <= 1 AS keeps_image, CASE WHEN image AND nth > 1 THEN left(regexp_replace(content || chr(10) || chr(10) || CASE WHEN page_num IS NOT NULL THEN '（原消息附有第 ' || page_num || ' 页截图，此处从略）' ELSE '（原消息附有页面截图，此处从略）' END, '^\\s+|\\s+$', '', 'g'), 8000) ELSE content END AS content FROM b WHERE back <= 6"""


def dialogue_compaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.compacted(turns(spark, sf_dir), 4, 2, 30)


COMPACT_SQL = f"""
    WITH t AS ({_TURNS}), a AS (SELECT conv, turn, role, left(content, 4500) AS content FROM t WHERE role IN ('user', 'assistant') AND content <> ''),
    b AS (SELECT *, count(*) OVER (PARTITION BY conv) AS n, row_number() OVER (PARTITION BY conv ORDER BY turn DESC) AS back FROM a)
    SELECT conv, turn + 1 AS ord, role, content FROM b WHERE NOT (n > 4 AND back > 2) UNION ALL
    SELECT conv, 0, 'digest', string_agg(CASE WHEN role = 'user' THEN '用户：' ELSE '助手：' END || left({_LINE}, 30), chr(10) ORDER BY turn) FROM b WHERE n > 4 AND back > 2 GROUP BY conv"""


def contextual_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole turns; every fourth one refers to the one before, and some are short questions of their own."""
    said = F.when(F.col("turn") % 4 == 2, F.concat(F.lit("这个呢 "), F.coalesce("content", F.lit("")))).when(F.col("conv") % 7 == 3, F.concat(F.lit("why "), F.col("turn").cast("string"))).otherwise(F.col("content"))
    return C.contextual_queries(turns(spark, sf_dir).withColumn("content", said))


CONTEXT_SQL = f"""
    WITH a AS (SELECT conv_id AS conv, turn, {D.one_line("CASE WHEN turn % 4 = 2 THEN '这个呢 ' || coalesce(text, '') WHEN conv_id % 7 = 3 THEN 'why ' || turn ELSE text END")} AS q FROM conversations WHERE role = 'user'),
    b AS (SELECT *, lag(q) OVER (PARTITION BY conv ORDER BY turn) AS p FROM a WHERE q <> '')
    SELECT conv, turn, left(CASE WHEN (length(q) <= 18 OR regexp_matches(q, '{C.FOLLOW_UP}')) AND p IS NOT NULL AND p <> q THEN p || chr(10) || '跟进问题：' || q ELSE q END, 700) AS query FROM b"""


def conversation_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.exported_markdown(turns(spark, sf_dir)).select("conv", F.md5(F.encode("markdown", "UTF-8")).alias("digest"), F.char_length("markdown").alias("n_chars"))


MARKDOWN_SQL = f"""
    WITH t AS ({_TURNS}), a AS (SELECT conv, turn, content, role, row_number() OVER (PARTITION BY conv ORDER BY turn) AS n FROM t WHERE role IN ('user', 'assistant') AND content <> ''),
    m AS (SELECT conv, '# 对话导出' || chr(10) || chr(10) || string_agg('## ' || n || CASE WHEN role = 'user' THEN '. 用户' ELSE '. AI 助手' END || chr(10) || chr(10) || content || chr(10), chr(10) ORDER BY turn) AS markdown FROM a GROUP BY conv)
    SELECT conv, md5(markdown) AS digest, length(markdown)::INTEGER AS n_chars FROM m"""


def agent_routing(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = turns(spark, sf_dir)
    whole = F.coalesce("content", F.lit(""))
    text = F.when(F.col("turn") % 5 == 1, F.concat(whole, F.lit(" 第 "), (F.col("conv") % 40).cast("string"), F.lit(" 页的公式"))).when(F.col("turn") % 5 == 2, F.concat(F.lit("请看本页 "), whole)).when(F.col("conv") % 6 == 0, "where?").otherwise(whole)
    out = t.withColumn("q", text).withColumn("a", C.page_anchor(F.col("q"), F.lit(7)))
    return out.select("conv", "turn", C.needs_agent(F.col("q")).alias("agent"), "a.anchored", "a.page", C.question_title(F.col("q")).alias("title"))


ROUTING_SQL = """
    WITH a AS (SELECT conv_id AS conv, turn, CASE WHEN turn % 5 = 1 THEN coalesce(text, '') || ' 第 ' || (conv_id % 40) || ' 页的公式' WHEN turn % 5 = 2 THEN '请看本页 ' || coalesce(text, '') WHEN conv_id % 6 = 0 THEN 'where?' ELSE coalesce(text, '') END AS q FROM conversations),
    b AS (SELECT *, regexp_extract(q, '第\\s*(\\d{1,5})\\s*页', 1) AS n, regexp_matches(q, '(当前页|这一?页|本页|此页)') AS here FROM a)
    SELECT conv, turn, length(q) >= 80 OR regexp_matches(q, '(?i)(对比|比较|区别|compare|versus|推导|证明|derive|prove|全文|整篇|所有|across|哪一页|哪里|出处|where|总结|综述|summar)') AS agent, n <> '' OR here AS anchored, CASE WHEN n <> '' THEN n::INTEGER WHEN here THEN 7 END AS page,
    left(regexp_replace(string_split(regexp_replace(q, '^\\s+|\\s+$', '', 'g'), chr(10))[1], '^\\s+|\\s+$', '', 'g'), 40) AS title FROM b"""


def nearest_box(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = tables.read(spark, sf_dir, "embeddings")
    unit = lambda i: (F.get("embedding", i).cast("double") + 3) / 6.0
    points = v.filter("vec_id % 2 = 0").select(F.col("label").alias("page"), F.col("vec_id").alias("point"), unit(0).alias("x"), unit(1).alias("y"))
    boxes = v.filter("vec_id % 2 = 1").select(F.col("label").alias("page"), F.col("vec_id").alias("id"), unit(0).alias("x0"), unit(1).alias("y0"), (unit(0) + 0.03).alias("x1"), (unit(1) + 0.02 + (F.col("vec_id") % 5) / 100).alias("y1"), F.col("vec_id").alias("ord"))
    return L.nearest_targets(points, boxes)


_UNIT = "((embedding[{}]::DOUBLE + 3) / 6.0)"
NEAREST_SQL = f"""
    WITH p AS (SELECT label AS page, vec_id AS point, {_UNIT.format(1)} AS x, {_UNIT.format(2)} AS y FROM embeddings WHERE vec_id % 2 = 0),
    b AS (SELECT label AS page, vec_id AS id, {_UNIT.format(1)} AS x0, {_UNIT.format(2)} AS y0, {_UNIT.format(1)} + 0.03::DOUBLE AS x1, {_UNIT.format(2)} + 0.02::DOUBLE + (vec_id % 5)::DOUBLE / 100 AS y1 FROM embeddings WHERE vec_id % 2 = 1),
    n AS (SELECT point, id, x BETWEEN x0 AND x1 AND y BETWEEN y0 AND y1 AS inside, (x1 - x0) * (y1 - y0) AS area, pow(CASE WHEN x < x0 THEN x0 - x WHEN x > x1 THEN x - x1 ELSE 0 END, 2) + pow(CASE WHEN y < y0 THEN y0 - y WHEN y > y1 THEN y - y1 ELSE 0 END, 2) AS d FROM p JOIN b USING (page) WHERE x BETWEEN 0 AND 1 AND y BETWEEN 0 AND 1)
    SELECT point, id FROM n WHERE inside OR d <= {L.REACH} * {L.REACH} QUALIFY row_number() OVER (PARTITION BY point ORDER BY inside DESC, CASE WHEN inside THEN 0 ELSE d END, area, id) = 1"""


def node_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = tables.read(spark, sf_dir, "documents")
    parts = docs.select(F.col("doc_id").alias("doc"), F.posexplode(F.split("text", "\n")).alias("i", "text"))
    return L.unit_batches(parts.select("doc", F.col("i").cast("long").alias("ord"), F.concat(F.lit("u"), F.col("i")).alias("id"), "text"))


def glyph_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of documents set in two columns, put together again."""
    docs = tables.read(spark, sf_dir, "documents")
    w = docs.select(F.col("doc_id").alias("page"), F.posexplode(F.split("text", " ")).alias("i", "str"))
    row, col = F.floor(F.col("i") / 8), F.col("i") % 8
    x = 50.0 + col * 28 + F.when(col >= 4, 40).otherwise(0)
    return L.page_blocks(w.select("page", F.col("i").alias("ord"), "str", x.alias("x"), (60.0 + row * 12).alias("y"), F.lit(24.0).alias("width"), F.lit(10.0).alias("size")))


QUERIES = {
    "session_titles": (session_titles, f"WITH {_SESSIONS} SELECT * FROM z"),
    "session_list": (session_list, LIST_SQL),
    "stored_messages": (stored_messages, f"SELECT conv, turn, role, content FROM ({_TURNS}) WHERE role IN ('user', 'assistant') AND (content <> '' OR had_image) QUALIFY row_number() OVER (PARTITION BY conv ORDER BY turn DESC) <= 4"),
    "request_window": (request_window, WINDOW_SQL),
    "dialogue_compaction": (dialogue_compaction, COMPACT_SQL),
    "contextual_queries": (contextual_queries, CONTEXT_SQL),
    "conversation_markdown": (conversation_markdown, MARKDOWN_SQL),
    "agent_routing": (agent_routing, ROUTING_SQL),
    "nearest_box": (nearest_box, NEAREST_SQL),
    "node_batches": (node_batches, None),
    "glyph_blocks": (glyph_blocks, None),
}
