"""Records as they are read: each kind's fields, what they default to and how long they may be. Bad rows are dropped, none fails.

A kind is a table of rules that become one projection, so reading a collection is a scan with a filter.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.functions import keys as K
from quillspark.functions import text as T
from quillspark.operators.stores import clean_tags

Rule = Callable[[Column], Column]


def line(most: int, default: str = "") -> Rule:
    """One line of at most `most` characters."""
    return lambda c: F.coalesce(F.nullif(F.left(T.one_line(c), F.lit(most)), F.lit("")), F.lit(default))


def body(most: int) -> Rule:
    return lambda c: F.left(F.coalesce(c, F.lit("")), F.lit(most))


def whole(least: int = 0, most: int | None = None) -> Rule:
    """A whole number, rounded half up, within its bounds."""
    return lambda c: (lambda n: F.least(n, F.lit(most)) if most is not None else n)(F.greatest(F.lit(least), F.floor(F.coalesce(c.cast("double"), F.lit(0.0)) + 0.5).cast("int")))


def within(least: int, most: int) -> Rule:
    """A whole number, null outside its bounds."""
    return lambda c: F.when(c.cast("int").between(least, most), c.cast("int"))


def one_of(values: list[str], default: str) -> Rule:
    return lambda c: F.when(c.isin(values), c).otherwise(default)


def matching(pattern: str) -> Rule:
    return lambda c: F.when(T.trimmed(F.coalesce(c, F.lit(""))).rlike(pattern), T.trimmed(c)).otherwise("")


def flag(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def stamp(c: Column) -> Column:
    return F.greatest(F.lit(0).cast("long"), F.coalesce(c.cast("long"), F.lit(0).cast("long")))


@dataclass(frozen=True)
class Kind:
    """fields: rules by name. needs: of these fields at least one must not be blank. id: prefix and fields of a missing id."""

    fields: dict[str, Rule]
    needs: tuple[str, ...]
    id: tuple[str, tuple[str, ...]] | None = None


# The kinds' fields and lengths.
KINDS = {
    "library": Kind({"path": line(500), "title": line(160), "total_pages": whole(), "last_page": whole(), "translated_count": whole(), "updated_at": stamp, "starred": flag, "tags": clean_tags, "one_liner": line(160), "arxiv_id": line(32), "year": within(1990, 2099)}, ("path",)),
    "note": Kind({"title": line(120, "笔记"), "content": body(20_000), "paper_title": line(160), "source": line(24), "created_at": stamp}, ("content",), ("n", ("title", "content"))),
    "todo": Kind({"text": line(300), "paper_path": line(500), "done": flag, "created_at": stamp}, ("text",), ("t", ("text", "paper_path"))),
    "fact": Kind({"fact": line(500), "paper_path": line(500), "created_at": stamp}, ("fact",), ("m", ("fact",))),
    "venue": Kind({"abbr": line(40), "name": line(120), "deadline": matching(r"^\d{4}-\d{2}-\d{2}$"), "url": line(300), "note": line(200)}, ("abbr",), ("v", ("abbr", "deadline"))),
    "reading_item": Kind({"title": line(200), "arxiv_id": line(32), "url": matching(r"^https?://\S+$"), "note": line(200), "done": flag, "created_at": stamp}, ("title",), ("r", ("arxiv_id", "url", "title"))),
    "glossary": Kind({"term": line(80), "translation": line(80), "created_at": stamp}, ("term",)),
    "highlight": Kind({"path": line(500), "page": whole(1), "text": line(500), "color": one_of(["yellow", "green", "blue", "pink"], "yellow"), "note": body(300), "created_at": stamp}, ("text",), ("h", ("path", "page", "text"))),
    "draft": Kind({"title": line(120, "未命名草稿"), "body": body(100_000), "kind": line(32, "general"), "paper_path": line(500), "updated_at": stamp, "created_at": stamp}, ("body",), ("d", ("title",))),
    "profile": Kind({"name": line(80), "field": line(200), "goal": line(400)}, ("name", "field", "goal")),
    "reading": Kind({"doc_key": line(300), "title": line(200), "page": whole(1), "page_count": whole(), "source_url": matching(r"^https?://\S+$"), "updated_at": stamp}, ("doc_key",)),
    "tab": Kind({"path": line(500), "name": line(120), "total_pages": whole(), "last_page": whole(1)}, ("path",), ("tab_", ("path",))),
}


def normalized(rows: DataFrame, kind: str) -> DataFrame:
    """rows with a kind's fields by its rules (missing columns: their defaults), id where the kind has one, and ord if there is one."""
    k = KINDS[kind]
    given = lambda f: F.col(f) if f in rows.columns else F.lit(None).cast(_types.get(k.fields[f], "string"))
    out = rows.select(*[c for c in rows.columns if c in ("ord", "id")], *[rule(given(f)).alias(f) for f, rule in k.fields.items()])
    some = F.lit(False)
    for f in k.needs:
        some = some | (T.trimmed(F.col(f)) != "")
    out = out.filter(some)
    if k.id:
        own = K.row_id(k.id[0], F.concat_ws("|", *[F.col(f).cast("string") for f in k.id[1]]))
        own = F.coalesce(F.nullif(F.trim(F.col("id").cast("string")), F.lit("")), own) if "id" in rows.columns else own
        out = out.withColumn("id", own)
    if kind == "reading":
        out = out.withColumn("page", F.when(F.col("page_count") > 0, F.least("page", "page_count")).otherwise(F.col("page")))
    return out


_types = {flag: "boolean", stamp: "long", clean_tags: "array<string>"}


def interests(categories: Column, keywords: Column) -> Column:
    """struct<categories, keywords>: well-formed categories, at most 8; keywords, each once whatever the case, at most 12."""
    c = F.array_distinct(F.filter(F.transform(F.coalesce(categories, F.array().cast("array<string>")), lambda x: F.left(F.trim(x), F.lit(20))), lambda x: x.rlike(r"^[a-z-]+(\.[A-Za-z-]+)?$")))
    k = clean_tags(F.transform(keywords, lambda x: F.left(T.one_line(x), F.lit(60))), 12)
    return F.struct(F.slice(c, 1, 8).alias("categories"), k.alias("keywords"))


def first_of_each(rows: DataFrame, key: str, texts: list[str]) -> DataFrame:
    """Rows (key, texts, ord) with trimmed values, without blank keys; of rows with one key the first by ord."""
    clean = rows.withColumns({c: F.trim(F.coalesce(c, F.lit(""))) for c in (key, *texts)}).filter(F.col(key) != "")
    return clean.groupBy(key).agg(F.min_by(F.struct(*texts, "ord"), "ord").alias("r")).select(key, "r.*")


def day_counts(rows: DataFrame, counts: list[str], most: int = 400) -> DataFrame:
    """Rows (day, counts): the newest days, as yyyy-mm-dd, with whole counts of at least zero."""
    days = rows.filter(F.col("day").rlike(r"^\d{4}-\d{2}-\d{2}$"))
    whole = lambda c: F.greatest(F.lit(0), F.floor(F.coalesce(c, F.lit(0.0)) + 0.5)).cast("long")
    return days.select("day", *[whole(c).alias(c) for c in counts]).orderBy(F.col("day").desc()).limit(most)


def public_profile(rows: DataFrame) -> DataFrame:
    """Without the key: whether there is one, and its last two characters."""
    key = F.coalesce("api_key", F.lit(""))
    return rows.withColumns({"has_key": key != "", "key_suffix": F.when(key != "", F.right(key, F.lit(2))).otherwise("")}).drop("api_key")


def progress(done: Column, total: Column) -> Column:
    return F.when(total > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), done / total))).otherwise(0.0)


def next_pending(pages: DataFrame, cursor: int) -> DataFrame:
    """doc, page: the first pending page at or after the cursor, else the first of all. pages (doc, page, status)."""
    order = F.struct((F.col("page") < cursor).alias("before"), "page")
    return pages.filter("status = 'pending'").groupBy("doc").agg(F.min_by("page", order).alias("page"), F.count("*").alias("pending"))
