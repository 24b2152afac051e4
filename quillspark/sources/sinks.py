"""Writers: Markdown and BibTeX reports, packs, vault notes, bounded redacted logs. Reports are rows of text, written by Spark."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.functions import text as T
from quillspark.operators import stores as S


def redacted(message: Column, most: int = 2000) -> Column:
    """Without tokens: Bearer x becomes Bearer ***, credentials and secret query values of URLs go; clipped."""
    m = F.regexp_replace(F.coalesce(message, F.lit("")), r"(?i)\bBearer\s+[^\s\"',;]+", "Bearer ***")
    m = F.regexp_replace(m, r"(?i)\b(https?://)[^/\s:@]+:[^/\s@]+@", "$1")
    m = F.regexp_replace(m, r"(?i)([?&](?:api[_-]?key|key|token|access_token|secret|password)=)[^&\s#]+", "$1***")
    return F.left(F.regexp_replace(m, r"\bsk-[A-Za-z0-9_-]{8,}", "sk-***"), F.lit(most))


def diagnostics(log: DataFrame) -> DataFrame:
    """log (ord, component, kind, message): the last rows that the log keeps, redacted."""
    return S.capped(log.withColumn("place", F.col("ord")), S.STORES["diagnostics"]).withColumn("message", redacted(F.col("message"))).drop("place")


def page_report(pages: DataFrame, heading: str) -> DataFrame:
    """pages (doc, num, text, outcome, error) -> doc, markdown, pages, exported: pages in order, with what happened to those without text."""
    text = T.trimmed(F.coalesce("text", F.lit("")))
    instead = F.when(F.col("outcome") == "error", F.concat(F.lit("*翻译失败："), F.coalesce("error", F.lit("未知错误")), F.lit("*"))).when(F.col("outcome") == "skipped", "*此页已跳过*").otherwise("*此页尚未翻译*")
    part = F.concat(F.lit("## 第 "), F.col("num").cast("string"), F.lit(" 页\n\n"), F.when(text != "", text).otherwise(instead), F.lit("\n"))
    rows = pages.select("doc", "num", part.alias("part"), (text != "").cast("int").alias("has"))
    out = rows.groupBy("doc").agg(F.array_sort(F.collect_list(F.struct("num", "part"))).alias("x"), F.count("*").alias("pages"), F.sum("has").alias("exported"))
    return out.select("doc", F.concat(F.lit(f"# {heading}\n\n"), F.array_join("x.part", "\n")).alias("markdown"), "pages", "exported")


def plain_text(markdown: Column) -> Column:
    """Without heading, quote and emphasis marks."""
    out = F.regexp_replace(markdown, r"(?m)^#{1,6}\s+|^>\s?", "")
    return F.regexp_replace(out, r"\*\*?([^*\n]+)\*\*?", "$1")


def notes_report(notes: DataFrame) -> DataFrame:
    """notes (paper, ord, title, content) -> first, section: a section for each paper; sections are ordered by first."""
    part = F.concat(F.lit("### "), F.col("title"), F.lit("\n\n"), F.coalesce("content", F.lit("")), F.lit("\n"))
    papers = notes.select("paper", "ord", part.alias("part")).groupBy("paper").agg(F.min("ord").alias("first"), F.array_sort(F.collect_list(F.struct("ord", "part"))).alias("x"))
    return papers.select("first", F.concat(F.lit("## "), F.col("paper"), F.lit("\n\n"), F.array_join("x.part", "\n")).alias("section"))


def pack_json(packs: DataFrame, tag: str) -> DataFrame:
    """packs (title, target, total_pages, pages: map<int, string>, glossary, pdf) -> title, value: one JSON document each."""
    kept = F.map_filter("pages", lambda k, v: k.between(1, F.col("total_pages")) & (T.trimmed(v) != ""))
    body = F.struct(F.lit(tag).alias("format"), "title", F.col("target").alias("targetLang"), F.col("total_pages").alias("totalPages"), F.size(kept).alias("translatedCount"), F.map_from_entries(F.transform(F.map_entries(kept), lambda e: F.struct(e["key"].cast("string"), e["value"]))).alias("translations"), F.slice("glossary", 1, 200).alias("glossary"), F.base64("pdf").alias("pdf"))
    return packs.select("title", F.to_json(body).alias("value"))


def vault_note(title: Column, content: Column, paper: Column, day: Column) -> Column:
    """A note with front matter and a link back."""
    return F.concat(F.lit("---\ntitle: "), title, F.lit("\ndate: "), day, F.lit("\n---\n\n"), F.coalesce(content, F.lit("")), F.lit("\n\n来源：[["), paper, F.lit("]]\n"))


def bibtex(key: Column, title: Column, authors: Column, year: Column) -> Column:
    return F.concat(F.lit("@article{"), key, F.lit(",\n  title = {"), title, F.lit("},\n  author = {"), F.array_join(authors, " and "), F.lit("},\n  year = {"), F.coalesce(year.cast("string"), F.lit("")), F.lit("}\n}\n"))


def radar_digest(ranked: DataFrame, must: int = 5, skim: int = 8) -> DataFrame:
    """The first must-reads and skims of a ranking (rank, tier, title, score): rank, line; without either, the first of all."""
    rows = ranked.filter(F.col("tier").isin("must", "skim"))
    rows = ranked if rows.isEmpty() else rows
    from pyspark.sql import Window

    n = F.row_number().over(Window.partitionBy("tier").orderBy("rank"))
    kept = rows.withColumn("n", n).filter(F.col("n") <= F.when(F.col("tier") == "must", must).otherwise(skim))
    return kept.select("rank", "tier", F.concat(F.lit("- **"), F.col("title"), F.lit("** · "), F.col("score").cast("string")).alias("line"))
