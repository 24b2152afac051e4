"""Keyed collections: every store of operators.stores over a log of updates made from events, and what is read from them."""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.functions import text as T
from quillspark.operators import documents as O
from quillspark.operators import ranking as R
from quillspark.operators import stores as S
from quillspark.plans import dialect as D
from quillspark.sources import tables

NOW_MS = 1_706_000_000_000

_COLUMNS = {
    "path": ("concat('/p/', user_id % 97)", "'/p/' || (user_id % 97)"),
    "page": ("int(event_id % 7)", "(event_id % 7)::INTEGER"),
    "text": ("concat('note ', user_id % 11)", "'note ' || (user_id % 11)"),
    "id": ("concat('id', user_id % 53)", "'id' || (user_id % 53)"),
    "doc_key": ("concat('t:', user_id % 41, '|p:', user_id % 3)", "'t:' || (user_id % 41) || '|p:' || (user_id % 3)"),
    "term": ("if(event_id % 2 = 0, upper(concat('term', user_id % 301)), concat('term', user_id % 301))", "CASE WHEN event_id % 2 = 0 THEN upper('term' || (user_id % 301)) ELSE 'term' || (user_id % 301) END"),
    "fact": ("if(event_id % 3 = 0, concat('Fact ', user_id % 120), concat('fact ', user_id % 120))", "CASE WHEN event_id % 3 = 0 THEN 'Fact ' || (user_id % 120) ELSE 'fact ' || (user_id % 120) END"),
    "paper_title": ("concat('Paper ', user_id % 31)", "'Paper ' || (user_id % 31)"),
    "content": ("concat(event_type, ' ', event_id % 29)", "event_type || ' ' || (event_id % 29)"),
    "paper_path": ("concat('/p/', event_id % 19)", "'/p/' || (event_id % 19)"),
    "title": ("if(event_id % 4 = 0, null, concat('Title ', event_id % 13))", "CASE WHEN event_id % 4 = 0 THEN NULL ELSE 'Title ' || (event_id % 13) END"),
    "last_page": ("int(event_id % 40)", "(event_id % 40)::INTEGER"),
    "starred": ("event_id % 50 = 0", "event_id % 50 = 0"),
    "ord": ("event_id", "event_id"),
}


def updates(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = tables.read(spark, sf_dir, "events").filter("user_id IS NOT NULL")
    return events.selectExpr(*[f"{e} AS {c}" for c, (e, _) in _COLUMNS.items()])


_UPDATES = "SELECT " + ", ".join(f"{e} AS {c}" for c, (_, e) in _COLUMNS.items()) + " FROM events WHERE user_id IS NOT NULL"


def store_state(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return S.merged(updates(spark, sf_dir), S.STORES[name]).select(*_COLUMNS, "place")


def _store_sql(name: str) -> str:
    store = S.STORES[name]
    if store.keys:
        pick = "arg_min" if store.keep == "first" else "arg_max"
        one = {
            "max": lambda c: f"max({c})",
            "or": lambda c: f"bool_or({c})",
            "coalesce": lambda c: f"arg_max({c}, ord) FILTER ({c} IS NOT NULL AND {c}::VARCHAR <> '')",
        }
        columns = ", ".join((one[store.fields[c]](c) if c in store.fields else f"{pick}({c}, ord)" if c != "title" else f"{pick}({{'v': {c}}}, ord).v") + f" AS {c}" for c in _COLUMNS)
        by = ", ".join(f"lower({k})" if store.lower else k for k in store.keys)
        place = "min(ord)" if store.place == "first" else "max(ord)"
        rows = f"SELECT {columns}, {place} AS place FROM (SELECT {', '.join(f'{k} AS _{k}' for k in store.keys)}, * FROM u) GROUP BY {', '.join(f'lower(_{k})' if store.lower else f'_{k}' for k in store.keys)}"
    else:
        rows = "SELECT *, ord AS place FROM u"
    if store.within:
        return f"WITH u AS ({_UPDATES}), r AS ({rows}), k AS (SELECT *, row_number() OVER (PARTITION BY {', '.join(store.within)} ORDER BY place DESC) AS _rank FROM r) SELECT * EXCLUDE (_rank) FROM k WHERE _rank <= {store.cap}"
    return f"WITH u AS ({_UPDATES}), r AS ({rows}) SELECT * FROM r ORDER BY place DESC LIMIT {store.cap}"


def latest_per_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = tables.read(spark, sf_dir, "events")
    last = events.groupBy("user_id").agg(F.max_by(F.struct("event_id", "event_type", "value"), F.struct("ts", "event_id")).alias("e"), F.count("*").alias("updates"))
    return last.select("user_id", "e.event_id", "e.event_type", F.col("e.value").alias("value"), "updates")


def keyed_merge_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as updates of a customer's entry: last status, largest price, first and last day."""
    o = tables.read(spark, sf_dir, "orders")
    at = F.struct("o_orderdate", "o_orderkey")
    return o.groupBy("o_custkey").agg(F.max_by("o_orderstatus", at).alias("status"), F.max("o_totalprice").alias("largest"), F.min("o_orderdate").alias("first_day"), F.max("o_orderdate").alias("last_day"), F.bool_or(F.col("o_orderpriority") == "1-URGENT").alias("urgent"))


def retention_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 newest orders of each customer."""
    o = tables.read(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderdate", F.unix_micros(F.col("o_orderdate").cast("timestamp")).alias("at"))
    ranked = S.capped(o.withColumn("place", F.struct("at", "o_orderkey")), S.Store((), 5, within=("o_custkey",)))
    return ranked.select("o_custkey", "o_orderkey", "o_orderdate")


def _entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with labels as library entries."""
    docs, labels = tables.read(spark, sf_dir, "documents"), tables.read(spark, sf_dir, "labels")
    tags = S.clean_tags(F.array("lang", F.concat(F.lit("S"), F.substring("source", 2, 9)), F.when(F.col("toxic") == 1, "Toxic"), F.upper("lang"), F.lit(" ")))
    return docs.join(labels, "doc_id", "left").select("doc_id", F.left("text", F.lit(60)).alias("title"), F.substring("text", 61, 60).alias("one_liner"), tags.alias("tags"), F.coalesce(F.col("quality") == 1, F.lit(False)).alias("starred"))


_ENTRIES = "SELECT doc_id, left(text, 60) AS title, substr(text, 61, 60) AS one_liner, list_filter([lang, 'S' || substr(source, 2, 9), CASE WHEN toxic = 1 THEN 'Toxic' END], lambda x: x IS NOT NULL) AS tags, coalesce(quality = 1, false) AS starred FROM documents LEFT JOIN labels USING (doc_id)"


def library_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = S.library_search(_entries(spark, sf_dir), query="tion", tag="EN", starred=True)
    return found.select("doc_id", "title", F.array_join("tags", ",").alias("tags"))


SEARCH_SQL = f"SELECT doc_id, title, array_to_string(tags, ',') AS tags FROM ({_ENTRIES}) WHERE starred AND list_contains(list_transform(tags, lambda t: lower(t)), 'en') AND (contains(lower(title), 'tion') OR contains(lower(one_liner), 'tion') OR len(list_filter(tags, lambda t: contains(lower(t), 'tion'))) > 0)"


def library_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _entries(spark, sf_dir).withColumn("tags", F.when(F.col("doc_id") % 2 == 0, F.transform("tags", F.upper)).otherwise(F.col("tags")))
    return S.tag_counts(rows, order="doc_id").select("tag", "n")


TAGS_SQL = f"WITH e AS (SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN list_transform(tags, lambda t: upper(t)) ELSE tags END AS tags FROM ({_ENTRIES})), x AS (SELECT doc_id, unnest(tags) AS tag, generate_subscripts(tags, 1) AS p FROM e) SELECT arg_max(tag, doc_id * 100 + p) AS tag, count(*) AS n FROM x GROUP BY lower(tag)"


def _terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Glossary terms: the first words of benchmark items, at most 200 after the store's rules."""
    items = tables.read(spark, sf_dir, "benchmark")
    word = F.regexp_extract("text", r"\w{4,}", 0)
    rows = items.select(word.alias("term"), F.concat(F.lit("t"), F.col("item_id") % 50).alias("translation"), F.col("item_id").alias("ord")).filter("term <> ''")
    return S.merged(rows, S.STORES["glossary"])


_TERMS = "SELECT arg_max(term, ord) AS term, arg_max(translation, ord) AS translation, max(ord) AS place FROM (SELECT regexp_extract(text, '\\w{4,}') AS term, 't' || (item_id % 50) AS translation, item_id AS ord FROM benchmark) WHERE term <> '' GROUP BY lower(term) ORDER BY place DESC LIMIT 200"


def glossary_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.term_hits(tables.read(spark, sf_dir, "documents"), _terms(spark, sf_dir)).select("doc_id", "term", "translation")


HITS_SQL = f"WITH t AS ({_TERMS}) SELECT doc_id, term, translation FROM documents, t WHERE contains(lower(text), lower(term))"


def glossary_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = O.term_hits(tables.read(spark, sf_dir, "documents"), _terms(spark, sf_dir))
    return O.term_fingerprints(hits)


FINGERPRINT_SQL = f"WITH t AS ({_TERMS}), h AS (SELECT doc_id, lower(term) || '=>' || translation AS x FROM documents, t WHERE contains(lower(text), lower(term))) SELECT doc_id, count(*) AS terms, md5(string_agg(x, chr(1) ORDER BY x)) AS fingerprint FROM h GROUP BY doc_id"


def todos_for_paper(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.for_paper(updates(spark, sf_dir), "/p/3").select("ord", "paper_path", "text")


# ---- ranking -----------------------------------------------------------------------------------------------------------

KEYWORDS, CATEGORIES = ["tion", "the ing", "ouch"], ["en", "de.x"]


def papers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as papers: the first 80 characters are the title, all the rest is the summary."""
    docs = tables.read(spark, sf_dir, "documents")
    return docs.select(
        F.concat(F.lit("p"), F.floor(F.col("doc_id") / 2)).alias("id"), F.col("doc_id").alias("ord"), F.left("text", F.lit(80)).alias("title"), F.substring("text", 81, F.lit(1 << 30)).alias("summary"), F.array("lang", "source").alias("categories"),
        (F.lit(NOW_MS) - (F.col("doc_id") * 37 % 240) * 3_600_000).alias("published_ms"), (F.col("doc_id") * 37 % 240).cast("string").alias("published"), (F.col("doc_id") % 6).cast("int").alias("n_authors"),
    )


_PAPERS = f"SELECT 'p' || (doc_id // 2) AS id, doc_id AS ord, lower(left(text, 80)) AS title, lower(substr(text, 81)) AS summary, lang, source, {NOW_MS} - (doc_id * 37 % 240) * 3600000 AS published_ms, (doc_id * 37 % 240)::VARCHAR AS published FROM documents"


def _scored_papers_sql(only_first: bool) -> str:
    local = " + ".join(
        f"(CASE WHEN contains(title, '{k}') THEN 5 ELSE 0 END + CASE WHEN contains(summary, '{k}') THEN 2 ELSE 0 END" + (f" + CASE WHEN contains(title, '{k}') OR contains(summary, '{k}') THEN 3 ELSE 0 END" if " " in k else "") + ")"
        for k in KEYWORDS
    )
    days = f"(({NOW_MS} - published_ms) / 86400000.0)"
    hit = "CASE WHEN lang = 'en' OR source = 'en' OR lang = 'de' THEN 8 ELSE 0 END"
    first = f"SELECT * FROM ({_PAPERS}) QUALIFY row_number() OVER (PARTITION BY id ORDER BY ord) = 1" if only_first else _PAPERS
    return f"""
        p AS ({first}), l AS (SELECT *, {local} AS local FROM p),
        r AS (SELECT *, local + {hit} + CASE WHEN {days} <= 1 THEN 12 WHEN {days} <= 3 THEN 8 WHEN {days} <= 7 THEN 4 ELSE 0 END AS raw FROM l),
        s AS (SELECT *, CASE WHEN local = 0 AND raw > 0 THEN least(45, least(100, floor(raw * 4.2::DOUBLE + 0.5))) ELSE least(100, floor(raw * 4.2::DOUBLE + 0.5)) END::INTEGER AS score FROM r),
        e AS (SELECT min(score) AS lo, max(score) AS hi FROM s),
        c AS (SELECT s.* EXCLUDE (score), score AS score_raw, floor(12 + (score - lo)::DOUBLE / (hi - lo) * 88 + 0.5)::INTEGER AS score FROM s, e)"""


def radar_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = R.interest_scores(papers(spark, sf_dir), KEYWORDS, CATEGORIES, NOW_MS)
    return out.select("ord", "raw", "score", "stars")


_STARS = "CASE WHEN score >= 80 THEN 5 WHEN score >= 65 THEN 4 WHEN score >= 45 THEN 3 WHEN score >= 25 THEN 2 WHEN score > 0 THEN 1 ELSE 0 END"


def calibrate_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = R.first_of_each(papers(spark, sf_dir), "id")
    return R.tiered(R.calibrated(R.interest_scores(own, KEYWORDS, CATEGORIES, NOW_MS))).select("id", "score_raw", "score", "tier")


_TIER = "CASE WHEN score >= 70 THEN 'must' WHEN score >= 45 THEN 'skim' ELSE 'browse' END"


def radar_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    all_papers = papers(spark, sf_dir)
    seen = all_papers.filter("ord % 10 < 6").select("id")
    return R.ranked(all_papers, KEYWORDS, CATEGORIES, seen, NOW_MS, 50).select("rank", "id", "is_new", "score", "tier")


RANK_SQL = f"WITH {_scored_papers_sql(True)}, f AS (SELECT *, id NOT IN (SELECT 'p' || (doc_id // 2) FROM documents WHERE doc_id % 10 < 6) AS is_new FROM c), k AS (SELECT *, row_number() OVER (ORDER BY is_new DESC, score DESC, published DESC, ord) AS rank FROM f) SELECT rank::INTEGER AS rank, id, is_new, score, {_TIER} AS tier FROM k WHERE rank <= 50"


def mobile_radar(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.mobile_scores(papers(spark, sf_dir), KEYWORDS).select("ord", "mobile_score")


MOBILE_SQL = "SELECT ord, 8 + " + " + ".join(f"CASE WHEN contains(title, '{k}') THEN 8 WHEN contains(summary, '{k}') THEN 3 ELSE 0 END" for k in KEYWORDS) + f" AS mobile_score FROM ({_PAPERS})"


def _notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.read(spark, sf_dir, "documents").select("doc_id", F.left("text", F.lit(30)).alias("name"), "text", F.col("doc_id").alias("mtime"))


def vault_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.vault_search(_notes(spark, sf_dir), "retion ingen ouch x", 20).select("doc_id", "score")


VAULT_SQL = "SELECT doc_id, " + " + ".join(f"CASE WHEN contains(lower(left(text, 30)), '{t}') THEN 5 ELSE 0 END + least(10, {D.count_of('lower(text)', t)})" for t in ["retion", "ingen", "ouch"]) + " AS score FROM documents ORDER BY score DESC, doc_id DESC LIMIT 20"


def note_snippets(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = R.vault_search(_notes(spark, sf_dir), "retion ingen", 20)
    return R.with_snippets(hits, "retion ingen").select("doc_id", "score", "snippets")


def venue_board(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = tables.read(spark, sf_dir, "orders")
    day = F.date_format(F.date_add(F.lit("2024-01-01"), (F.col("o_orderkey") % 200).cast("int") - 60), "yyyy-MM-dd")
    venues = o.select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("abbr"), F.when(F.col("o_orderkey") % 9 == 0, "soon").otherwise(day).alias("deadline"))
    return R.venue_board(venues, NOW_MS).select("id", "deadline", "countdown.days", "countdown.hours", "countdown.passed", "countdown.urgency", "state")


BOARD_SQL = f"""
    WITH v AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 9 = 0 THEN 'soon' ELSE strftime(DATE '2024-01-01' + ((o_orderkey % 200)::INTEGER - 60), '%Y-%m-%d') END AS deadline, CASE WHEN o_orderkey % 9 = 0 THEN NULL ELSE epoch_ms((DATE '2024-01-01' + ((o_orderkey % 200)::INTEGER - 60))::TIMESTAMP) + 129599000 - {NOW_MS} END AS ms FROM orders),
    c AS (SELECT id, deadline, abs(floor(ms / 86400000.0))::INTEGER AS days, floor((abs(ms) % 86400000) / 3600000.0)::INTEGER AS hours, ms < 0 AS passed FROM v)
    SELECT *, CASE WHEN passed IS NULL THEN NULL WHEN passed THEN 'passed' WHEN days <= 3 THEN 'critical' WHEN days <= 14 THEN 'soon' WHEN days <= 45 THEN 'normal' ELSE 'far' END AS urgency, CASE WHEN passed IS NULL THEN 2 WHEN passed THEN 1 ELSE 0 END AS state FROM c"""

QUERIES = {
    **{f"store_{name}": (partial(store_state, name=name), _store_sql(name)) for name in S.STORES},
    "latest_per_key": (latest_per_key, "SELECT user_id, arg_max(event_id, (ts, event_id)) AS event_id, arg_max(event_type, (ts, event_id)) AS event_type, arg_max(value, (ts, event_id)) AS value, count(*) AS updates FROM events GROUP BY user_id"),
    "keyed_merge_fields": (keyed_merge_fields, "SELECT o_custkey, arg_max(o_orderstatus, (o_orderdate, o_orderkey)) AS status, max(o_totalprice) AS largest, min(o_orderdate) AS first_day, max(o_orderdate) AS last_day, bool_or(o_orderpriority = '1-URGENT') AS urgent FROM orders GROUP BY o_custkey"),
    "retention_top_k": (retention_top_k, "SELECT o_custkey, o_orderkey, o_orderdate FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) <= 5"),
    "library_search": (library_search, SEARCH_SQL),
    "library_tags": (library_tags, TAGS_SQL),
    "glossary_hits": (glossary_hits, HITS_SQL),
    "glossary_fingerprint": (glossary_fingerprint, FINGERPRINT_SQL),
    "todos_for_paper": (todos_for_paper, f"SELECT ord, paper_path, text FROM ({_UPDATES}) WHERE paper_path = '' OR paper_path = '/p/3'"),
    "radar_scores": (radar_scores, f"WITH {_scored_papers_sql(False)} SELECT ord, raw::INTEGER AS raw, score, {_STARS} AS stars FROM s"),
    "calibrate_scores": (calibrate_scores, f"WITH {_scored_papers_sql(True)} SELECT id, score_raw, score, {_TIER} AS tier FROM c"),
    "radar_rank": (radar_rank, RANK_SQL),
    "mobile_radar": (mobile_radar, MOBILE_SQL),
    "vault_search": (vault_search, VAULT_SQL),
    "note_snippets": (note_snippets, None),
    "venue_board": (venue_board, BOARD_SQL),
}
