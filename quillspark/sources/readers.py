"""Readers: Markdown folders, Atom feeds, citation JSON, inverted abstracts, packs, model responses.

Files come through Spark's own sources (binaryFile, text, XML), so any store that Spark reads will do; what is parsed from
strings is a function of a column.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.functions import text as T

# Limits of folders and fields.
MAX_FILES, MAX_BYTES = 4000, 512 * 1024


def markdown_folder(spark: SparkSession, folder: str, most: int = MAX_FILES) -> DataFrame:
    """path, name, text (cut at MAX_BYTES), mtime, truncated of .md files, the first `most` by path; hidden folders and node_modules are skipped."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.md").load(folder)
    # paths and lengths are ordered and cut before any content is read
    files = files.filter(~F.contains("path", F.lit("/node_modules/")) & ~F.col("path").rlike(r"/\.[^/]+/")).orderBy("path").limit(most)
    name = F.regexp_extract("path", r"([^/]+)\.md$", 1)
    head = F.call_function("substring", F.col("content"), F.lit(1), F.lit(MAX_BYTES))
    # a character that the cut splits goes, and nothing else: up to three bytes at the end
    cuts = [F.call_function("try_validate_utf8", F.call_function("substring", head, F.lit(1), F.octet_length(head) - k).cast("string")) for k in range(4)]
    body = F.coalesce(*cuts)
    return files.select("path", name.alias("name"), F.coalesce(body, F.lit("")).alias("text"), F.col("modificationTime").alias("mtime"), (F.col("length") > MAX_BYTES).alias("truncated"))


def overview(notes: DataFrame, recent: int = 10) -> DataFrame:
    """notes, and the newest ones: one row."""
    newest = notes.orderBy(F.col("mtime").desc()).limit(recent).agg(F.array_sort(F.collect_list(F.struct((-F.unix_millis("mtime")).alias("age"), "name"))).alias("x"))
    return notes.agg(F.count("*").alias("notes")).crossJoin(newest).select("notes", F.col("x.name").alias("recent"))


def _unescaped(c: Column) -> Column:
    for a, b in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&amp;", "&")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return T.one_line(c)


def atom_entries(feeds: DataFrame, summary: int = 1200, authors: int = 12) -> DataFrame:
    """feeds (xml) -> a row for each entry with a title."""
    entries = feeds.select(F.explode(F.regexp_extract_all("xml", F.lit(r"(?s)<entry>(.*?)</entry>"), 1)).alias("e"))
    part = lambda tag: _unescaped(F.regexp_extract("e", rf"(?s)<{tag}[^>]*>(.*?)</{tag}>", 1))
    own = F.regexp_extract(part("id"), r"abs/([^v]+(?:v\d+)?)", 1)
    rows = entries.select(
        own.alias("arxiv_id"), part("title").alias("title"), F.slice(F.transform(F.regexp_extract_all("e", F.lit(r"(?s)<name>(.*?)</name>"), 1), _unescaped), 1, authors).alias("authors"), F.left(part("published"), F.lit(10)).alias("published"),
        F.left(part("summary"), F.lit(summary)).alias("summary"), F.regexp_extract_all("e", F.lit(r'term="([^"]+)"'), 1).alias("categories"),
    )
    rows = rows.withColumn("primary_category", F.coalesce(F.get("categories", 0), F.lit("")))
    return rows.withColumn("pdf_url", F.when(F.col("arxiv_id") != "", F.concat(F.lit("https://arxiv.org/pdf/"), "arxiv_id")).otherwise("")).filter("title <> ''")


_CITATION = "title string, year int, authors array<struct<name:string>>, venue string, publicationVenue struct<name:string>, abstract string, citationCount int, tldr struct<text:string>, openAccessPdf struct<url:string>, url string"


def citation(raw: Column) -> Column:
    """A citation service's JSON as a flat struct with defaults; null if it is none."""
    d = F.from_json(raw, _CITATION)
    text = lambda c, n=None: F.coalesce(F.left(c, F.lit(n)) if n else c, F.lit(""))
    names = F.filter(F.transform(F.coalesce(d["authors"], F.array().cast("array<struct<name:string>>")), lambda a: F.coalesce(a["name"], F.lit(""))), lambda n: n != "")
    return F.when(d.isNotNull(), F.struct(text(d["title"]).alias("title"), F.nullif(d["year"], F.lit(0)).alias("year"), F.slice(names, 1, 12).alias("authors"), F.coalesce(F.nullif(d["venue"], F.lit("")), d["publicationVenue"]["name"], F.lit("")).alias("venue"), text(d["abstract"], 1600).alias("abstract"), F.coalesce(d["citationCount"], F.lit(0)).alias("citations"), text(d["tldr"]["text"], 500).alias("tldr"), text(d["openAccessPdf"]["url"]).alias("pdf"), text(d["url"]).alias("url")))


def citation_route(reference: Column) -> Column:
    """struct<kind, key> by which a reference is looked up: arxiv, doi or title."""
    arxiv = T.found(reference, r"(?i)(?:arxiv[:/]|arxiv\.org/(?:abs|pdf)/)(\d{4}\.\d{4,5})")
    doi = T.found(reference, r"\b(10\.\d{4,9}/\S+)\b")
    return F.struct(F.when(arxiv.isNotNull(), "arxiv").when(doi.isNotNull(), "doi").otherwise("title").alias("kind"), F.coalesce(arxiv, doi, T.trimmed(reference)).alias("key"))


def abstract_of(inverted: Column) -> Column:
    """An abstract from its inverted index, a map of words to their places."""
    pairs = F.flatten(F.transform(F.map_entries(inverted), lambda e: F.transform(e["value"], lambda p: F.struct(p.alias("at"), e["key"].alias("word")))))
    return F.array_join(F.transform(F.array_sort(pairs), lambda x: x["word"]), " ")


_PACK = "format string, title string, targetLang string, totalPages int, translatedCount int, translations map<string,string>, glossary array<struct<term:string,translation:string>>, pdf string"


def packs(spark: SparkSession, path: str, tag: str) -> DataFrame:
    """Pack files (one JSON document each) of the given format tag: title, pages (map), terms (at most 200), pdf as bytes; others raise."""
    return packs_of(spark.read.text(path, wholetext=True), tag)


def packs_of(documents: DataFrame, tag: str) -> DataFrame:
    """The same of documents (value)."""
    d = documents.select(F.from_json("value", _PACK).alias("d")).select("d.*")
    pages = F.map_filter("translations", lambda k, v: k.rlike(r"^\d+$") & (T.trimmed(v) != "") & (k.try_cast("int").between(1, F.greatest("totalPages", F.lit(1)))))
    pdf = F.unbase64(F.coalesce("pdf", F.lit("")))
    ok = (F.col("format") == tag) & ((F.octet_length(pdf) == 0) | (F.call_function("substring", pdf, F.lit(1), F.lit(4)) == F.lit(b"%PDF")))
    return d.select(F.when(F.coalesce(ok, F.lit(False)), F.col("title")).otherwise(F.raise_error(F.lit("not a pack of this format"))).alias("title"), "targetLang", "totalPages", pages.alias("pages"), F.slice(F.coalesce("glossary", F.array().cast("array<struct<term:string,translation:string>>")), 1, 200).alias("glossary"), pdf.alias("pdf"))


def response_entries(value: str | None) -> list[tuple[str, str]]:
    """(id, text) of a model's answer: a JSON array, or one JSON object on each line, fenced or not; bad lines are skipped."""
    text = re.sub(r"^\s*```(?:json|ndjson|jsonl)?\s*|\s*```\s*$", "", value or "", flags=re.I)
    items: list = []
    try:
        data = json.loads(text)
        items = data if isinstance(data, list) else data.get("items", [data]) if isinstance(data, dict) else []
    except ValueError:
        for line in text.splitlines():
            try:
                items.append(json.loads(line.strip().rstrip(",")))
            except ValueError:
                continue
    return [(x["id"].strip(), x["text"]) for x in items if isinstance(x, dict) and isinstance(x.get("id"), str) and x["id"].strip() and isinstance(x.get("text"), str)]


def responses(rows: DataFrame) -> DataFrame:
    """rows (request, value) -> request, ord, id, text."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            yield pd.DataFrame([(r, i, k, t) for r, v in zip(part["request"], part["value"]) for i, (k, t) in enumerate(response_entries(v))], columns=["request", "ord", "id", "text"])

    kind = rows.schema["request"].dataType.simpleString()
    return rows.select("request", "value").mapInPandas(run, f"request {kind}, ord int, id string, text string")


def inspected(expected: DataFrame, answered: DataFrame) -> DataFrame:
    """expected (request, id, source) and answered (request, ord, id, text) -> request, id, text (the last one), state: ok, blank, unchanged or missing."""
    last = answered.groupBy("request", "id").agg(F.max_by("text", "ord").alias("text"), F.count("*").alias("times"))
    rows = expected.join(last, ["request", "id"], "left")
    state = F.when(F.col("text").isNull(), "missing").when(T.trimmed(F.col("text")) == "", "blank").when(T.one_line(F.col("text")) == T.one_line(F.col("source")), "unchanged").otherwise("ok")
    return rows.select("request", "id", "text", F.coalesce("times", F.lit(0)).alias("times"), state.alias("state"))


def data_url(value: Column) -> Column:
    """struct<mime, payload> of a base64 image URL, null otherwise."""
    mime = T.found(value, r"^data:(image/[a-zA-Z0-9.+-]+);base64,")
    return F.when(mime.isNotNull(), F.struct(mime.alias("mime"), F.regexp_replace(value, r"^[^,]*,", "").alias("payload")))


def agent_calls(text: Column) -> Column:
    """struct<calls: array<struct<name, args>>, answer> of lines `CALL name {json}` and `FINAL answer`."""
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"(?m)^\s*(CALL\s+\w+\s*\{.*\})\s*$"), 1)
    calls = F.transform(found, lambda c: F.struct(F.regexp_extract(c, r"^CALL\s+(\w+)", 1).alias("name"), F.regexp_extract(c, r"(\{.*\})", 1).alias("args")))
    return F.struct(calls.alias("calls"), T.trimmed(F.regexp_extract(F.coalesce(text, F.lit("")), r"(?s)(?:^|\n)\s*FINAL:?\s*(.*)$", 1)).alias("answer"))


def interest_query(categories: list[str], keywords: list[str], most: int = 40) -> dict[str, str]:
    """Options of a feed source: categories, else the first four keywords; 10 to 80 rows."""
    terms = [f"cat:{c}" for c in categories] or [f'all:"{k}"' for k in keywords[:4]]
    return {"query": " OR ".join(terms), "limit": str(min(80, max(10, most)))}
