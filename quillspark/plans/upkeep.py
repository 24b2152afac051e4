"""What is taken out of stores and changed in them, and records as they are read."""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.operators import records as R
from quillspark.operators import stores as S
from quillspark.plans import collections as C
from quillspark.plans import dialect as D
from quillspark.sources import tables

#: Updates whose keys are taken out or changed.
CHOSEN = "ord < 12"


def _key(store: S.Store, name: str):
    return F.lower(F.col(name)) if store.lower else F.col(name)


def removed(spark: SparkSession, sf_dir: str, name: str, keys: tuple[str, ...] = ()) -> DataFrame:
    """A store's state without the chosen keys (or without all rows of some of its columns)."""
    store = S.STORES[name]
    keys = keys or store.keys
    named = [f"_x{i}" for i in range(len(keys))]
    own = lambda df: df.withColumns({n: _key(store, k) for n, k in zip(named, keys)})
    state = own(C.store_state(spark, sf_dir, name))
    return S.without(state, own(C.updates(spark, sf_dir).filter(CHOSEN)), named).drop(*named)


def _removed_sql(name: str, keys: tuple[str, ...] = ()) -> str:
    store = S.STORES[name]
    same = " AND ".join(f"lower(g.{k}) = lower(s.{k})" if store.lower else f"g.{k} = s.{k}" for k in keys or store.keys)
    return f"SELECT s.* FROM ({C._store_sql(name)}) s WHERE NOT EXISTS (SELECT 1 FROM ({C._UPDATES}) g WHERE {CHOSEN} AND {same})"


def _chosen(spark: SparkSession, sf_dir: str, key: str) -> DataFrame:
    return C.updates(spark, sf_dir).filter(CHOSEN).select(key).distinct()


def done_marked(spark: SparkSession, sf_dir: str, name: str, key: str) -> DataFrame:
    """A store's rows with done, which is set for the chosen keys."""
    rows = C.store_state(spark, sf_dir, name).withColumn("done", F.lit(False))
    return S.patched(rows, _chosen(spark, sf_dir, key).withColumn("done", F.lit(True)), key)


def _done_sql(name: str, key: str) -> str:
    return f"SELECT s.*, s.{key} IN (SELECT {key} FROM ({C._UPDATES}) g WHERE {CHOSEN}) AS done FROM ({C._store_sql(name)}) s"


def entry_patched(spark: SparkSession, sf_dir: str, name: str, key: str) -> DataFrame:
    """A store's rows with a new title and last page for the chosen keys; a null in the patch changes nothing."""
    patch = _chosen(spark, sf_dir, key).select(key, F.concat(F.lit("New "), key).alias("title"), F.when(F.length(key) % 2 == 0, 99).alias("last_page"))
    return S.patched(C.store_state(spark, sf_dir, name), patch, key)


def _patched_sql(name: str, key: str) -> str:
    return f"""
        SELECT s.* REPLACE (CASE WHEN g.k IS NOT NULL THEN 'New ' || s.{key} ELSE s.title END AS title, CASE WHEN g.k IS NOT NULL AND length(g.k) % 2 = 0 THEN 99 ELSE s.last_page END AS last_page)
        FROM ({C._store_sql(name)}) s LEFT JOIN (SELECT DISTINCT {key} AS k FROM ({C._UPDATES}) WHERE {CHOSEN}) g ON g.k = s.{key}"""


def star_toggled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.toggled(C.store_state(spark, sf_dir, "mobile_library"), _chosen(spark, sf_dir, "id"), "id", "starred")


TOGGLED_SQL = f"SELECT s.* REPLACE (s.starred <> (s.id IN (SELECT id FROM ({C._UPDATES}) WHERE {CHOSEN})) AS starred) FROM ({C._store_sql('mobile_library')}) s"


# ---- records -----------------------------------------------------------------------------------------------------------

# A messy text of each turn: line ends, double blanks, blanks at both ends, or nothing.
_MESSY = "CASE WHEN turn % 7 = 3 THEN '  ' WHEN turn % 7 = 5 THEN NULL ELSE ' ' || regexp_replace(coalesce(text, ''), 'th', 't  \n h', 'g') || chr(10) END"


def _messy(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = tables.read(spark, sf_dir, "conversations")
    own = F.concat(F.lit(" "), F.regexp_replace(F.coalesce("text", F.lit("")), "th", "t  \n h"), F.lit("\n"))
    messy = F.when(F.col("turn") % 7 == 3, "  ").when(F.col("turn") % 7 == 5, F.lit(None)).otherwise(own)
    k = F.col("conv_id")
    return t.select(
        (k * 1000 + F.col("turn")).alias("ord"), messy.alias("m"), F.concat(F.lit(" /p/"), k.cast("string"), F.lit("\t")).alias("path"), F.when(k % 2 == 0, F.lit(True)).when(k % 3 == 0, F.lit(False)).alias("done"),
        F.when(k % 5 != 0, k - 7).alias("created_at"), (k % 40 - 3.5).alias("number"), F.when(k % 2 == 0, F.concat(F.lit(" https://x.org/"), k.cast("string"))).otherwise("ftp://x.org").alias("url"),
    )


_ROWS = f"SELECT conv_id * 1000 + turn AS ord, {_MESSY} AS m, ' /p/' || conv_id || chr(9) AS path, CASE WHEN conv_id % 2 = 0 THEN true WHEN conv_id % 3 = 0 THEN false END AS done, CASE WHEN conv_id % 5 <> 0 THEN conv_id - 7 END AS created_at, conv_id % 40 - 3.5 AS number, CASE WHEN conv_id % 2 = 0 THEN ' https://x.org/' || conv_id ELSE 'ftp://x.org' END AS url FROM conversations".replace("\n", "' || chr(10) || '")


def _line(c: str, most: int, default: str = "") -> str:
    return f"coalesce(nullif(left({D.one_line(c)}, {most}), ''), '{default}')"


_STAMP = "greatest(0, coalesce(created_at, 0))::BIGINT"
_PAGE = "greatest(1, floor(number + 0.5))::INTEGER"

#: Kinds of records: which columns of the messy rows are their fields, the SQL of each field, and of what must not be blank.
RECORDS = {
    "note": ({"title": "m", "content": "m", "paper_title": "path", "source": "url", "created_at": "created_at"}, {"title": _line("m", 120, "笔记"), "content": "left(coalesce(m, ''), 20000)", "paper_title": _line("path", 160), "source": _line("url", 24), "created_at": _STAMP}, "content"),
    "todo": ({"text": "m", "paper_path": "path", "done": "done", "created_at": "created_at"}, {"text": _line("m", 300), "paper_path": _line("path", 500), "done": "coalesce(done, false)", "created_at": _STAMP}, "text"),
    "fact": ({"fact": "m", "created_at": "created_at"}, {"fact": _line("m", 500), "paper_path": "''", "created_at": _STAMP}, "fact"),
    "reading_item": ({"title": "m", "url": "url", "done": "done"}, {"title": _line("m", 200), "arxiv_id": "''", "url": "CASE WHEN regexp_matches(trim(url), '^https?://\\S+$') THEN trim(url) ELSE '' END", "note": "''", "done": "coalesce(done, false)", "created_at": "0"}, "title"),
    "glossary": ({"term": "m", "translation": "url", "created_at": "created_at"}, {"term": _line("m", 80), "translation": _line("url", 80), "created_at": _STAMP}, "term"),
    "draft": ({"title": "m", "body": "m", "kind": "path", "updated_at": "created_at"}, {"title": _line("m", 120, "未命名草稿"), "body": "left(coalesce(m, ''), 100000)", "kind": _line("path", 32), "paper_path": "''", "updated_at": _STAMP, "created_at": "0"}, "body"),
    "profile": ({"name": "m", "field": "path"}, {"name": _line("m", 80), "field": _line("path", 200), "goal": "''"}, "field"),
    "reading": ({"doc_key": "m", "title": "m", "page": "number", "page_count": "number", "source_url": "url", "updated_at": "created_at"}, {"doc_key": _line("m", 300), "title": _line("m", 200), "page": f"CASE WHEN floor(number + 0.5) > 0 THEN least({_PAGE}, floor(number + 0.5)) ELSE {_PAGE} END::INTEGER", "page_count": "greatest(0, floor(number + 0.5))::INTEGER", "source_url": "CASE WHEN regexp_matches(trim(url), '^https?://\\S+$') THEN trim(url) ELSE '' END", "updated_at": _STAMP}, "doc_key"),
    "tab": ({"path": "m", "name": "path", "total_pages": "number", "last_page": "number"}, {"path": _line("m", 500), "name": _line("path", 120), "total_pages": "greatest(0, floor(number + 0.5))::INTEGER", "last_page": _PAGE}, "path"),
}


def records(spark: SparkSession, sf_dir: str, kind: str) -> DataFrame:
    given = RECORDS[kind][0]
    rows = _messy(spark, sf_dir).select("ord", *[F.col(c).alias(f) for f, c in given.items()])
    return R.normalized(rows, kind).select("ord", *RECORDS[kind][1])


def _records_sql(kind: str) -> str:
    _, fields, needed = RECORDS[kind]
    return f"SELECT * FROM (SELECT ord, {', '.join(f'{e} AS {f}' for f, e in fields.items())} FROM ({_ROWS})) WHERE regexp_replace({needed}, '^\\s+|\\s+$', '', 'g') <> ''"


def interest_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns' marks as categories, their words as keywords."""
    t = tables.read(spark, sf_dir, "conversations")
    words = F.split(F.coalesce("text", F.lit("")), " ")
    out = t.select("conv_id", "turn", R.interests(F.array(F.lit(" cs.LG "), "role", F.upper("role"), F.concat("role", F.lit(".X")), "role"), words).alias("i"))
    return out.select("conv_id", "turn", F.array_join("i.categories", ",").alias("categories"), F.array_join("i.keywords", ",").alias("keywords"))


INTERESTS_SQL = f"""
    WITH a AS (SELECT conv_id, turn, list_filter(['cs.LG', role, upper(role), role || '.X', role], lambda x: regexp_matches(x, '^[a-z-]+(\\.[A-Za-z-]+)?$')) AS c, list_filter(list_transform(string_split(coalesce(text, ''), ' '), lambda x: trim(left({D.one_line("x")}, 60))), lambda x: x <> '') AS w FROM conversations),
    b AS (SELECT *, list_transform(w, lambda x: lower(x)) AS l FROM a)
    SELECT conv_id, turn, array_to_string(list_filter(c, lambda x, i: list_position(c, x) = i)[1:8], ',') AS categories, array_to_string(list_filter(w, lambda x, i: list_position(l, lower(x)) = i)[1:12], ',') AS keywords FROM b"""


def highlight_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Highlights by paper: each id once (the first), at most 200 of a paper, as maps are read."""
    u = C.updates(spark, sf_dir)
    first = u.groupBy("path", F.col("id").alias("hid")).agg(F.min("ord").alias("ord"))
    kept = S.capped(first.withColumn("place", F.col("ord")), S.Store((), 200, newest=False, within=("path",)))
    return kept.groupBy("path").agg(F.count("*").alias("highlights"), F.min("ord").alias("first"), F.max("ord").alias("last"))


MAP_SQL = f"WITH f AS (SELECT path, id, min(ord) AS ord FROM ({C._UPDATES}) GROUP BY 1, 2), k AS (SELECT *, row_number() OVER (PARTITION BY path ORDER BY ord) AS r FROM f) SELECT path, count(*) AS highlights, min(ord) AS first, max(ord) AS last FROM k WHERE r <= 200 GROUP BY 1"


def formula_hints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Formulas by id: blank ids go, the first of each id stays."""
    e = tables.read(spark, sf_dir, "events")
    rows = e.select(F.col("event_id").alias("ord"), F.when(F.col("event_id") % 13 == 0, " ").otherwise(F.concat(F.lit(" f"), (F.col("user_id") % 61).cast("string"), F.lit(" "))).alias("id"), F.concat(F.lit(" "), "event_type", F.lit(" ")).alias("source_text"))
    return R.first_of_each(rows, "id", ["source_text"]).select("id", "source_text", "ord")


HINTS_SQL = "WITH a AS (SELECT event_id AS ord, CASE WHEN event_id % 13 = 0 THEN '' ELSE 'f' || (user_id % 61) END AS id, event_type AS s FROM events) SELECT id, arg_min(s, ord) AS source_text, min(ord) AS ord FROM a WHERE id <> '' GROUP BY id"


def newest_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days of reading statistics: keys that are no days go, the newest 400 stay, counts are whole and not negative."""
    o = tables.read(spark, sf_dir, "orders")
    day = F.when(F.col("o_orderkey") % 17 == 0, F.date_format("o_orderdate", "yyyy/MM/dd")).otherwise(F.date_format("o_orderdate", "yyyy-MM-dd"))
    rows = o.groupBy(day.alias("day")).agg(F.sum(F.round(F.col("o_totalprice") * 100) - 15_000_000).alias("minutes"), F.count("*").alias("pages"))
    return R.day_counts(rows, ["minutes", "pages"])


DAYS_SQL = """
    WITH a AS (SELECT CASE WHEN o_orderkey % 17 = 0 THEN strftime(o_orderdate, '%Y/%m/%d') ELSE strftime(o_orderdate, '%Y-%m-%d') END AS day, sum(round(o_totalprice * 100) - 15000000) AS m, count(*) AS p FROM orders GROUP BY 1)
    SELECT day, greatest(0, round(m))::BIGINT AS minutes, p AS pages FROM a WHERE regexp_matches(day, '^\\d{4}-\\d{2}-\\d{2}$') ORDER BY day DESC LIMIT 400"""

_REMOVALS = {
    "remove_chat_session": ("chat_sessions", ()), "remove_term": ("glossary", ()), "remove_term_in_place": ("glossary_in_place", ()), "remove_library_entry": ("library", ()), "remove_note": ("notes", ()), "remove_todo": ("todos", ()),
    "remove_fact": ("facts", ()), "remove_venue": ("venues", ()), "remove_reading_item": ("reading_list", ()), "remove_highlight": ("highlights", ()), "clear_highlights": ("highlights", ("path",)), "remove_draft": ("drafts", ()),
    "remove_desktop_session": ("desktop_sessions", ()), "close_tab": ("tabs", ()), "remove_mobile_entry": ("mobile_library", ()), "remove_mobile_draft": ("mobile_drafts", ()), "remove_compared": ("compare_queue", ()),
}

QUERIES = {
    **{query: (partial(removed, name=name, keys=keys), _removed_sql(name, keys)) for query, (name, keys) in _REMOVALS.items()},
    "todo_done": (partial(done_marked, name="todos", key="text"), _done_sql("todos", "text")),
    "reading_item_done": (partial(done_marked, name="reading_list", key="id"), _done_sql("reading_list", "id")),
    "library_entry_update": (partial(entry_patched, name="library", key="path"), _patched_sql("library", "path")),
    "tab_progress": (partial(entry_patched, name="tabs", key="path"), _patched_sql("tabs", "path")),
    "library_star": (star_toggled, TOGGLED_SQL),
    **{f"{kind}_records": (partial(records, kind=kind), _records_sql(kind)) for kind in RECORDS},
    "interest_records": (interest_records, INTERESTS_SQL),
    "highlight_map": (highlight_map, MAP_SQL),
    "formula_hints": (formula_hints, HINTS_SQL),
    "newest_days": (newest_days, DAYS_SQL),
}
