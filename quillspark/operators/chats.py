"""Chat histories: storage rows, session records, titles, request windows, compaction, contextual queries, exports.

Turns come as rows (conv, turn, role, content, page_num, had_image). What looks at neighbouring turns is a window over a
conversation; sessions are pre-aggregated.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.functions import text as T

# Limits of stored and sent histories.
STORED_MESSAGES, SENT_MESSAGES, SENT_IMAGES, TITLE, MESSAGE = 80, 20, 2, 48, 8000
DIALOGUE_TURNS, RECENT_TURNS, DIGEST_ENTRY, TURN_CHARS = 28, 17, 220, 4500
FOLLOW_UP = r"^(继续|展开|详细说|为什么|怎么理解|这个|那个|上面|这里|还有呢|然后呢|具体呢)"


def stored_messages(turns: DataFrame, most: int = STORED_MESSAGES) -> DataFrame:
    """Rows of users and assistants with text or an image, without the image itself; the last `most` of a conversation."""
    clean = turns.withColumn("content", T.trimmed(F.coalesce("content", F.lit(""))))
    rows = clean.filter(F.col("role").isin("user", "assistant") & ((F.col("content") != "") | F.coalesce("had_image", F.lit(False))))
    back = F.row_number().over(Window.partitionBy("conv").orderBy(F.col("turn").desc()))
    return rows.withColumn("_back", back).filter(F.col("_back") <= most).drop("_back")


def title(content: Column, page: Column, most: int = TITLE) -> Column:
    """A session's title from a user's message, blank ones name their page."""
    line = T.one_line(content)
    asked = F.concat(F.lit("页图提问 · "), F.coalesce(F.concat(F.lit("第 "), page.cast("string"), F.lit(" 页")), F.lit("页面")))
    return F.when(line == "", asked).when(F.char_length(line) <= most, line).otherwise(F.concat(F.left(line, F.lit(most - 1)), F.lit("…")))


def sessions(turns: DataFrame) -> DataFrame:
    """conv, title (of the first user message), messages, user_turns, last_turn."""
    rows = stored_messages(turns)
    own = rows.withColumn("_title", F.when(F.col("role") == "user", title(F.col("content"), F.col("page_num"))))
    out = own.groupBy("conv").agg(F.min_by("_title", F.when(F.col("_title").isNotNull(), F.col("turn"))).alias("title"), F.count("*").alias("messages"), F.count_if(F.col("role") == "user").alias("user_turns"), F.max("turn").alias("last_turn"))
    return out.withColumn("title", F.coalesce("title", F.lit("新对话")))


def question_title(question: Column) -> Column:
    return F.left(T.trimmed(F.get(F.split(T.trimmed(F.coalesce(question, F.lit(""))), "\n"), 0)), F.lit(40))


def doc_key(name: Column, pages: Column) -> Column:
    clean = F.left(T.one_line(name), F.lit(200))
    n = F.greatest(F.lit(0), F.coalesce(pages, F.lit(0)))
    return F.when((clean == "") & (n == 0), "unknown").otherwise(F.concat(F.lit("t:"), clean, F.lit("|p:"), n.cast("string")))


def doc_title(key: Column) -> Column:
    return F.coalesce(F.nullif(F.regexp_extract(key, r"^t:(.*)\|p:\d+$", 1), F.lit("")), F.lit("未命名 PDF"))


def chat_text(raw: Column, most: int = MESSAGE) -> Column:
    return F.left(T.trimmed(F.regexp_replace(F.coalesce(raw, F.lit("")), "\r\n?", "\n")), F.lit(most))


def request_window(turns: DataFrame, most: int = SENT_MESSAGES, images: int = SENT_IMAGES) -> DataFrame:
    """The last `most` turns with keeps_image: only the newest `images` of the user's images are sent, others become a note."""
    rows = turns.filter(F.col("role").isin("user", "assistant")).withColumn("content", chat_text(F.col("content")))
    with_image = F.coalesce("had_image", F.lit(False)) & (F.col("role") == "user")
    rows = rows.filter((F.col("content") != "") | with_image).withColumn("_image", with_image)
    back = Window.partitionBy("conv").orderBy(F.col("turn").desc())
    rows = rows.withColumn("_back", F.row_number().over(back)).filter(F.col("_back") <= most)
    nth = F.sum(F.col("_image").cast("int")).over(back)
    rows = rows.withColumn("keeps_image", F.col("_image") & (nth <= images))
    page = F.when(F.col("page_num").isNotNull(), F.concat(F.lit("（原消息附有第 "), F.col("page_num").cast("string"), F.lit(" 页截图，此处从略）"))).otherwise("（原消息附有页面截图，此处从略）")
    return rows.withColumn("content", F.when(F.col("_image") & ~F.col("keeps_image"), chat_text(F.concat("content", F.lit("\n\n"), page))).otherwise(F.col("content"))).drop("_back", "_image")


def compacted(turns: DataFrame, most: int = DIALOGUE_TURNS, recent: int = RECENT_TURNS, clip: int = DIGEST_ENTRY) -> DataFrame:
    """conv, ord, role, content: a conversation of over `most` turns keeps the `recent` last; the older become one digest (ord 0)."""
    rows = turns.filter(F.col("role").isin("user", "assistant")).select("conv", "turn", "role", F.left(T.trimmed(F.coalesce("content", F.lit(""))), F.lit(TURN_CHARS)).alias("content")).filter("content <> ''")
    own = Window.partitionBy("conv")
    rows = rows.withColumn("n", F.count("*").over(own)).withColumn("back", F.row_number().over(own.orderBy(F.col("turn").desc())))
    old = (F.col("n") > most) & (F.col("back") > recent)
    line = F.concat(F.when(F.col("role") == "user", "用户：").otherwise("助手："), F.left(T.one_line(F.col("content")), F.lit(clip)))
    digest = rows.filter(old).groupBy("conv").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", line.alias("line")))), lambda x: x["line"]), "\n").alias("content"))
    kept = rows.filter(~old).select("conv", (F.col("turn") + 1).cast("long").alias("ord"), "role", "content")
    return kept.unionByName(digest.select("conv", F.lit(0).cast("long").alias("ord"), F.lit("digest").alias("role"), "content"))


def contextual_queries(turns: DataFrame, most: int = 700) -> DataFrame:
    """conv, turn, query of each user turn: short or referring ones follow the user's turn before."""
    asked = turns.filter(F.col("role") == "user").select("conv", "turn", T.one_line(F.col("content")).alias("q")).filter("q <> ''")
    previous = F.lag("q").over(Window.partitionBy("conv").orderBy("turn"))
    refers = (F.char_length("q") <= 18) | F.col("q").rlike(FOLLOW_UP)
    joined = F.when(refers & previous.isNotNull() & (previous != F.col("q")), F.concat(previous, F.lit("\n跟进问题："), F.col("q"))).otherwise(F.col("q"))
    return asked.select("conv", "turn", F.left(joined, F.lit(most)).alias("query"))


def page_anchor(question: Column, current: Column) -> Column:
    """struct<anchored, page>: 第 N 页, else the current page where the question speaks of it."""
    page = T.found(question, r"第\s*(\d{1,5})\s*页").cast("int")
    here = F.coalesce(question, F.lit("")).rlike(r"(当前页|这一?页|本页|此页)")
    return F.struct((page.isNotNull() | here).alias("anchored"), F.coalesce(page, F.when(here, current)).alias("page"))


def exported_markdown(turns: DataFrame, heading: str = "对话导出") -> DataFrame:
    """conv, markdown: turns with text in order, numbered from 1."""
    rows = turns.filter(F.col("role").isin("user", "assistant")).withColumn("content", T.trimmed(F.coalesce("content", F.lit("")))).filter("content <> ''")
    n = F.row_number().over(Window.partitionBy("conv").orderBy("turn"))
    part = F.concat(F.lit("## "), n.cast("string"), F.when(F.col("role") == "user", ". 用户").otherwise(". AI 助手"), F.lit("\n\n"), F.col("content"), F.lit("\n"))
    parts = rows.select("conv", "turn", part.alias("part"))
    out = parts.groupBy("conv").agg(F.array_sort(F.collect_list(F.struct("turn", "part"))).alias("x"))
    return out.select("conv", F.concat(F.lit(f"# {heading}\n\n"), F.array_join("x.part", "\n")).alias("markdown"))


def needs_agent(text: Column) -> Column:
    """Long questions and those that compare, derive, search or summarise."""
    return (F.char_length(text) >= 80) | text.rlike(r"(?i)(对比|比较|区别|compare|versus|推导|证明|derive|prove|全文|整篇|所有|across|哪一页|哪里|出处|where|总结|综述|summar)")
