"""Keyed stores: one merge, dedupe and retention operator, and the rules of each store.

A store is a table of updates with an order column. Its state is the keyed reduction of the updates, so nothing is
read back and rewritten row by row: each rule is an aggregate with map-side combine, and a cap is a ranking by the store's
order. Caps that hold for a whole store are bounded top-k sorts; caps for a partition are window ranks.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.functions import text as T


@dataclass(frozen=True)
class Store:
    """keys: what makes rows equal (lower: whatever the case). keep: which of equal rows counts, "first" or "last".
    place: where it stands, by its "first" or "last" update. cap and newest: how many rows stay, and from which end.
    within: columns that the cap holds for (none: the whole store)."""

    keys: tuple[str, ...]
    cap: int
    keep: str = "last"
    place: str = "last"
    newest: bool = True
    lower: bool = False
    within: tuple[str, ...] = ()
    fields: dict[str, str] = field(default_factory=dict)  # other rules: max, or, coalesce


# What each store holds, and how much.
STORES = {
    "library": Store(("path",), 200, fields={"last_page": "max", "starred": "or", "title": "coalesce"}),
    "notes": Store(("paper_title", "content"), 500, keep="first", place="first"),
    "todos": Store(("text", "paper_path"), 100, keep="first", place="first"),
    "facts": Store(("fact",), 80, lower=True),
    "venues": Store(("id",), 40),
    "reading_list": Store(("id",), 200, keep="first", place="first"),
    "glossary": Store(("term",), 200, place="last", lower=True),
    "glossary_in_place": Store(("term",), 200, place="first", lower=True),
    "highlights": Store(("path", "page", "text"), 200, keep="first", place="first", within=("path",)),
    "drafts": Store(("id",), 40),
    "mobile_drafts": Store(("id",), 30),
    "mobile_library": Store(("id",), 40),
    "reading_history": Store(("doc_key",), 30),
    "file_handles": Store(("doc_key",), 30),
    "chat_sessions": Store(("id",), 80),
    "desktop_sessions": Store(("id",), 30),
    "tabs": Store(("path",), 8),
    "compare_queue": Store(("id",), 20, keep="first", place="first"),
    "research_notes": Store((), 40, within=("doc_key",)),
    "diagnostics": Store((), 40),
}


def merged(updates: DataFrame, store: Store, order: str = "ord") -> DataFrame:
    """The rows that a store holds after all updates, with place (the order value of where a row stands)."""
    if store.keys:
        by = [(F.lower(F.col(k)) if store.lower else F.col(k)).alias(f"_k{i}") for i, k in enumerate(store.keys)]
        pick = F.min_by if store.keep == "first" else F.max_by
        rest = [c for c in updates.columns if c not in store.fields]
        rules = {
            "max": lambda c: F.max(c),
            "or": lambda c: F.bool_or(c),
            "coalesce": lambda c: F.max_by(F.col(c), F.when(F.col(c).isNotNull() & (F.col(c).cast("string") != ""), F.col(order))),
        }
        place = F.min(order) if store.place == "first" else F.max(order)
        rows = updates.groupBy(*by).agg(pick(F.struct(*rest), F.col(order)).alias("_row"), *[rules[r](c).alias(c) for c, r in store.fields.items()], place.alias("place"))
        rows = rows.select("_row.*", *store.fields, "place")
    else:
        rows = updates.withColumn("place", F.col(order))
    return capped(rows, store)


def capped(rows: DataFrame, store: Store) -> DataFrame:
    by = F.col("place").desc() if store.newest else F.col("place").asc()
    if store.within:
        rank = F.row_number().over(Window.partitionBy(*store.within).orderBy(by))
        return rows.withColumn("_rank", rank).filter(F.col("_rank") <= store.cap).drop("_rank")
    return rows.orderBy(by).limit(store.cap)


def without(rows: DataFrame, removed: DataFrame, keys: list[str]) -> DataFrame:
    """Deletes by key."""
    return rows.join(removed.select(*keys).distinct(), keys, "left_anti")


def patched(rows: DataFrame, patch: DataFrame, key: str) -> DataFrame:
    """Rows with the patch's values where it has any; patch has one row for each key at most."""
    new = patch.select(F.col(key), *[F.col(c).alias(f"_{c}") for c in patch.columns if c != key])
    return rows.join(new, key, "left").select(*[F.coalesce(f"_{c}", c).alias(c) if c in patch.columns and c != key else F.col(c) for c in rows.columns])


def toggled(rows: DataFrame, chosen: DataFrame, key: str, flag: str) -> DataFrame:
    """Rows with the flag turned where the key is among the chosen."""
    turned = chosen.select(key).distinct().withColumn("_turned", F.lit(True))
    return rows.join(turned, key, "left").withColumn(flag, F.col(flag) != F.coalesce("_turned", F.lit(False))).select(*rows.columns)


def looked_up(requests: DataFrame, cache: DataFrame, key: str) -> DataFrame:
    """Requests with the cache's value, null where it has none. cache has one row for each key."""
    return requests.join(cache, key, "left")


def cleared(rows: DataFrame) -> DataFrame:
    """The same table without rows."""
    return rows.filter("false")


def appended_once(rows: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Inserts those of new whose key is not there; of several equal new ones, the first by ord."""
    fresh = new.groupBy(*keys).agg(F.min_by(F.struct(*new.columns), "ord").alias("r")).select("r.*").join(rows.select(*keys).distinct(), keys, "left_anti")
    return rows.unionByName(fresh.select(*rows.columns))


def tag_counts(rows: DataFrame, tags: str = "tags", order: str = "ord") -> DataFrame:
    """tag (the last casing seen), n: whatever the case; the commonest first, then the first seen."""
    each = rows.select(F.col(order).alias("o"), F.posexplode(tags).alias("p", "tag"))
    at = F.struct("o", "p")
    out = each.groupBy(F.lower("tag").alias("k")).agg(F.max_by("tag", at).alias("tag"), F.count("*").alias("n"), F.min(at).alias("first"))
    return out.select("tag", "n", "first")


def clean_tags(tags: Column, most: int = 8) -> Column:
    """Trimmed tags without blanks and repeats (whatever the case: the first stays), at most `most`."""
    every = F.filter(F.transform(F.coalesce(tags, F.array().cast("array<string>")), lambda t: F.trim(t)), lambda t: t != "")
    # where the first of equal ones stands; maps are looked up by hash
    pairs = F.transform(every, lambda t, i: F.struct(F.lower(t).alias("k"), i.alias("i"), t.alias("t")))
    ordered = F.array_sort(pairs)
    first = T.bound(ordered, lambda o: F.filter(o, lambda x, i: (i == 0) | (F.get(o, i - 1)["k"] != x["k"])))
    return F.transform(F.slice(F.array_sort(F.transform(first, lambda x: F.struct(x["i"].alias("i"), x["t"].alias("t")))), 1, most), lambda x: x["t"])


def library_search(rows: DataFrame, query: str = "", tag: str = "", starred: bool = False) -> DataFrame:
    q, t = query.strip().lower(), tag.strip().lower()
    out = rows.filter("starred") if starred else rows
    if t:
        out = out.filter(F.exists("tags", lambda x: F.lower(x) == t))
    if q:
        has = lambda c: F.contains(F.lower(F.coalesce(c, F.lit(""))), F.lit(q))
        out = out.filter(has("title") | has("one_liner") | F.exists("tags", lambda x: F.contains(F.lower(x), F.lit(q))))
    return out


def for_paper(rows: DataFrame, path: str, done: bool = True) -> DataFrame:
    """Rows of a paper and those of none (todos: done ones only if asked for)."""
    out = rows.filter((F.coalesce("paper_path", F.lit("")) == "") | (F.col("paper_path") == path))
    return out if done or "done" not in rows.columns else out.filter("not done")
