"""Text forms, reports, packs and tools over the tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.functions import keys as K
from quillspark.functions import text as T
from quillspark.functions import times
from quillspark.operators import chats as C
from quillspark.plans import dialect as D
from quillspark.plans import tools as P
from quillspark.sources import readers, sinks, tables

NOW_MS = 1_706_000_000_000


def _digest(c):
    return F.md5(F.encode(c, "UTF-8"))


def text_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each turn's text with messy white space in the forms that searches, matches, selections and messages take."""
    t = tables.read(spark, sf_dir, "conversations")
    messy = F.concat(F.lit(" \r\n"), F.regexp_replace(F.coalesce("text", F.lit("")), " a", "\t \r\n\n\n\nA "), F.lit(" "))
    return t.select("conv_id", "turn", _digest(T.search_text(messy)).alias("searched"), _digest(T.matched_text(messy)).alias("matched"), _digest(T.one_line(messy)).alias("selected"), _digest(C.chat_text(messy, 500)).alias("sent"), C.question_title(messy).alias("title"))


def _forms_sql() -> str:
    messy = "' ' || chr(13) || chr(10) || regexp_replace(coalesce(text, ''), ' a', chr(9) || ' ' || chr(13) || chr(10) || chr(10) || chr(10) || chr(10) || 'A ', 'g') || ' '"
    sent = "left(regexp_replace(regexp_replace(m, '\\r\\n?', chr(10), 'g'), '^\\s+|\\s+$', '', 'g'), 500)"
    return f"""
        WITH a AS (SELECT conv_id, turn, {messy} AS m FROM conversations)
        SELECT conv_id, turn, md5(lower({D.squeezed("m")})) AS searched, md5({D.one_line("lower(m)")}) AS matched, md5({D.one_line("m")}) AS selected, md5({sent}) AS sent,
        left(regexp_replace(string_split(regexp_replace(m, '^\\s+|\\s+$', '', 'g'), chr(10))[1], '^\\s+|\\s+$', '', 'g'), 40) AS title FROM a"""


def times_and_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders' days, ages and paths."""
    o = tables.read(spark, sf_dir, "orders")
    ago = F.col("o_orderkey") * 7_000_003 % 900_000_000
    path = F.concat(F.lit("/Notes & more/"), "o_orderpriority", F.lit("//ä ö/"), F.col("o_orderkey").cast("string"), F.lit(".md"))
    name = F.concat(F.col("o_orderpriority"), F.lit(": [draft]/"), F.col("o_orderkey").cast("string"), F.lit("? "))
    url = F.concat(F.lit("see https://arxiv.org/"), F.when(F.col("o_orderkey") % 3 == 0, "pdf/").when(F.col("o_orderkey") % 3 == 1, "abs/").otherwise("x"), F.lpad((F.col("o_orderkey") % 9999).cast("string"), 4, "2"), F.lit("."), F.lpad((F.col("o_orderkey") % 99999).cast("string"), 5, "1"), F.when(F.col("o_orderkey") % 2 == 0, "v2").otherwise(""))
    return o.select("o_orderkey", times.day_key(F.col("o_orderdate")).alias("day"), times.relative_time(F.lit(NOW_MS) - ago, F.lit(NOW_MS)).alias("age"), T.path_encoded(path).alias("path"), T.safe_segment(name).alias("name"), F.regexp_extract(url, r"/(?:abs|pdf)/(\d{4}\.\d{4,5}(?:v\d+)?)", 1).alias("arxiv_id"), C.doc_title(C.doc_key(name, F.col("o_orderkey"))).alias("title"))


PATHS_SQL = f"""
    WITH a AS (SELECT *, o_orderkey * 7000003 % 900000000 AS ago, o_orderpriority || ': [draft]/' || o_orderkey || '? ' AS n, 'see https://arxiv.org/' || CASE o_orderkey % 3 WHEN 0 THEN 'pdf/' WHEN 1 THEN 'abs/' ELSE 'x' END || lpad((o_orderkey % 9999)::VARCHAR, 4, '2') || '.' || lpad((o_orderkey % 99999)::VARCHAR, 5, '1') || CASE WHEN o_orderkey % 2 = 0 THEN 'v2' ELSE '' END AS u FROM orders),
    b AS (SELECT *, list_filter(string_split('/Notes & more/' || o_orderpriority || '//ä ö/' || o_orderkey || '.md', '/'), lambda s: s <> '') AS parts, {D.one_line("n")} AS nl FROM a)
    SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS day, CASE WHEN ago < 60000 THEN '刚刚' WHEN ago < 3600000 THEN ago // 60000 || ' 分钟前' WHEN ago < 86400000 THEN ago // 3600000 || ' 小时前' WHEN ago < 604800000 THEN ago // 86400000 || ' 天前' ELSE strftime(make_timestamp(({NOW_MS} - ago) * 1000), '%m/%d %H:%M') END AS age,
    array_to_string(list_transform(parts, lambda s: url_encode(s)), '/') AS path, left(regexp_replace(regexp_replace(regexp_replace(n, '[\\\\/:*?"<>|#^\\[\\]]+', ' ', 'g'), '\\s+', ' ', 'g'), '^ | $', '', 'g'), 80) AS name,
    regexp_extract(u, '/(?:abs|pdf)/(\\d{{4}}\\.\\d{{4,5}}(?:v\\d+)?)', 1) AS arxiv_id, left(nl, 200) AS title FROM b"""


def reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as notes of their customers: a section for each customer, a vault note and an entry for each order."""
    o = tables.read(spark, sf_dir, "orders")
    notes = o.select(F.concat(F.lit("Paper "), F.col("o_custkey").cast("string")).alias("paper"), F.col("o_orderkey").alias("ord"), F.col("o_orderpriority").alias("title"), F.when(F.col("o_orderkey") % 5 != 0, F.concat(F.lit("> **bold** of\n## "), "o_orderstatus")).alias("content"))
    return sinks.notes_report(notes).select("first", _digest(F.col("section")).alias("section"), _digest(sinks.plain_text(F.col("section"))).alias("plain"))


_NOTES = "SELECT 'Paper ' || o_custkey AS paper, o_orderkey AS ord, o_orderpriority AS title, CASE WHEN o_orderkey % 5 <> 0 THEN '> **bold** of' || chr(10) || '## ' || o_orderstatus END AS content FROM orders"
REPORTS_SQL = f"""
    WITH n AS ({_NOTES}), s AS (SELECT min(ord) AS first, '## ' || paper || chr(10) || chr(10) || string_agg('### ' || title || chr(10) || chr(10) || coalesce(content, '') || chr(10), chr(10) ORDER BY ord) AS section FROM n GROUP BY paper)
    SELECT first, md5(section) AS section, md5(regexp_replace(regexp_replace(section, '(?m)^#{{1,6}}\\s+|^>\\s?', '', 'g'), '\\*\\*?([^*\\n]+)\\*\\*?', '\\1', 'g')) AS plain FROM s"""


def vault_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = tables.read(spark, sf_dir, "orders")
    title = F.concat(F.lit("On "), "o_orderpriority")
    note = sinks.vault_note(title, F.when(F.col("o_orderkey") % 5 != 0, F.col("o_orderstatus")), F.concat(F.lit("P"), F.col("o_custkey").cast("string")), times.day_key(F.col("o_orderdate")))
    entry = sinks.bibtex(F.concat(F.lit("k"), F.col("o_orderkey").cast("string")), title, F.array(F.lit("A. B"), F.concat(F.lit("C"), F.col("o_custkey").cast("string"))), F.when(F.col("o_orderkey") % 4 != 0, F.year("o_orderdate")))
    return o.select("o_orderkey", _digest(note).alias("note"), _digest(entry).alias("entry"), T.safe_segment(F.concat(title, F.lit("/"), F.col("o_orderkey").cast("string"))).alias("file"))


VAULT_SQL = """
    WITH a AS (SELECT *, 'On ' || o_orderpriority AS t, chr(10) AS n FROM orders)
    SELECT o_orderkey, md5('---' || n || 'title: ' || t || n || 'date: ' || strftime(o_orderdate, '%Y-%m-%d') || n || '---' || n || n || CASE WHEN o_orderkey % 5 <> 0 THEN o_orderstatus ELSE '' END || n || n || '来源：[[P' || o_custkey || ']]' || n) AS note,
    md5('@article{k' || o_orderkey || ',' || n || '  title = {' || t || '},' || n || '  author = {A. B and C' || o_custkey || '},' || n || '  year = {' || CASE WHEN o_orderkey % 4 <> 0 THEN year(o_orderdate)::VARCHAR ELSE '' END || '}' || n || '}' || n) AS entry, t || ' ' || o_orderkey AS file FROM a"""


def pack_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders packed as documents (lines are pages) and read again: what survives."""
    li = tables.read(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.max("l_quantity").alias("l_quantity"), F.max("l_returnflag").alias("l_returnflag"))
    page = F.struct(F.col("l_linenumber").cast("int").alias("key"), F.when(F.col("l_quantity") > 5, F.concat(F.lit("Text "), "l_returnflag")).otherwise(" ").alias("value"))
    docs = li.groupBy("l_orderkey").agg(F.map_from_entries(F.collect_list(page)).alias("pages"), F.max("l_linenumber").alias("n"))
    terms = F.array(F.struct(F.lit("a").alias("term"), F.lit("b").alias("translation")))
    made = docs.select(F.col("l_orderkey").cast("string").alias("title"), F.lit("zh").alias("target"), (F.col("n") - F.col("l_orderkey") % 2).cast("int").alias("total_pages"), "pages", terms.alias("glossary"), F.encode(F.concat(F.lit("%PDF-"), F.col("n").cast("string")), "UTF-8").alias("pdf"))
    read = readers.packs_of(sinks.pack_json(made, "pack-v1"), "pack-v1")
    return read.select("title", F.size("pages").alias("pages"), F.aggregate(F.map_keys("pages"), F.lit(0), lambda a, k: a + k.cast("int")).alias("numbers"), F.size("glossary").alias("terms"), F.decode("pdf", "UTF-8").alias("pdf"))


PACK_SQL = """
    WITH d AS (SELECT l_orderkey, max(l_linenumber) AS n FROM lineitem GROUP BY 1), p AS (SELECT l_orderkey, l_linenumber AS k FROM lineitem GROUP BY 1, 2 HAVING max(l_quantity) > 5)
    SELECT d.l_orderkey::VARCHAR AS title, count(k)::INTEGER AS pages, coalesce(sum(k), 0)::INTEGER AS numbers, 1 AS terms, '%PDF-' || any_value(n) AS pdf FROM d LEFT JOIN p ON p.l_orderkey = d.l_orderkey AND k BETWEEN 1 AND n - d.l_orderkey % 2 GROUP BY d.l_orderkey"""


def page_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tools that list a paper's pages, and find a string in them."""
    return _paper(spark, sf_dir).call("list_pages")


def text_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _paper(spark, sf_dir).call("search_paper_text", {"query": " Ation "})


def page_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _paper(spark, sf_dir).call("get_page_range", {"start": 7, "end": 30}).select("page", "status", _digest(F.col("text")).alias("digest"))


def paper_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _paper(spark, sf_dir).call("get_paper_meta")


def _paper(spark: SparkSession, sf_dir: str) -> P.Registry:
    docs = tables.read(spark, sf_dir, "documents")
    pages = docs.select((F.col("doc_id") + 1).alias("page"), F.coalesce("text", F.lit("")).alias("text"), F.when(F.col("doc_id") % 3 == 0, "done").otherwise("pending").alias("status"))
    return P.Registry(P.paper_tools(pages, pages, 4))


_PAGES = "SELECT doc_id + 1 AS page, coalesce(text, '') AS text, CASE WHEN doc_id % 3 = 0 THEN 'done' ELSE 'pending' END AS status FROM documents"
HITS_SQL = f"WITH p AS ({_PAGES}), h AS (SELECT page, text, instr(lower(text), 'ation') AS pos FROM p) SELECT page, substr(text, greatest(1, pos - 40), 200) AS snippet FROM h WHERE pos > 0 ORDER BY page LIMIT {P.MAX_HITS}"


def trace_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as traces of calls: the pages that they touched, and the calls that were not made before."""
    li = tables.read(spark, sf_dir, "lineitem")
    q = F.col("l_quantity").cast("int")
    step = F.struct(F.col("l_linenumber").alias("n"), F.when(q % 3 == 0, q).alias("page"), F.when(q % 3 == 1, q).alias("from"), F.when(q % 3 == 1, q + F.col("l_linenumber").cast("int") * 2 - 4).alias("to"), (F.col("l_returnflag") != "R").alias("ok"), F.when(q % 3 == 2, F.array(q, F.lit(0), q - 1)).alias("pages"))
    name, args = F.concat(F.lit("get_"), "l_returnflag"), F.create_map(F.lit("page"), (q % 4).cast("string"), F.lit("a"), F.lit("1"))
    rows = li.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(step)).alias("steps"), F.count_distinct(K.call_signature(name, args)).alias("new_calls"))
    return rows.select("l_orderkey", F.array_join(P.pages_of_trace(F.col("steps")).cast("array<string>"), ",").alias("pages"), "new_calls")


TRACE_SQL = """
    WITH a AS (SELECT l_orderkey, l_linenumber AS n, l_quantity::INTEGER AS q, l_returnflag AS f FROM lineitem),
    b AS (SELECT l_orderkey, unnest(CASE q % 3 WHEN 0 THEN [q] WHEN 1 THEN CASE WHEN n * 2 - 4 >= 0 THEN range(q, least(q + n * 2 - 4, q + 5) + 1) ELSE [] END ELSE [q, 0, q - 1] END) AS p FROM a WHERE f <> 'R'),
    c AS (SELECT l_orderkey, array_to_string(list_sort(list(DISTINCT p) FILTER (p >= 1)), ',') AS pages FROM b GROUP BY 1), d AS (SELECT l_orderkey, count(DISTINCT f || (q % 4)) AS new_calls FROM a GROUP BY 1)
    SELECT d.l_orderkey, coalesce(pages, '') AS pages, new_calls FROM d LEFT JOIN c ON c.l_orderkey = d.l_orderkey"""


def data_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Images as data URLs, base64 there and back, and lines of agents' answers."""
    c = tables.read(spark, sf_dir, "customer")
    mime = F.when(F.col("c_custkey") % 3 == 0, "image/png").when(F.col("c_custkey") % 3 == 1, "image/svg+xml").otherwise("text/plain")
    value = F.concat(F.lit("data:"), mime, F.lit(";base64,"), F.base64(F.encode("c_name", "UTF-8")))
    said = F.concat(F.lit("I look.\nCALL get_page {\"page\": "), F.col("c_custkey").cast("string"), F.lit("}\n CALL x {}\n"), F.when(F.col("c_custkey") % 2 == 0, F.concat(F.lit("FINAL: it is "), "c_mktsegment", F.lit(" \n"))).otherwise(""))
    rows = c.select("c_custkey", readers.data_url(value).alias("u"), readers.agent_calls(said).alias("a"))
    return rows.select("c_custkey", F.col("u.mime").alias("mime"), F.decode(F.unbase64("u.payload"), "UTF-8").alias("content"), F.array_join(F.transform("a.calls", lambda x: F.concat(x["name"], F.lit(" "), x["args"])), ";").alias("calls"), F.col("a.answer").alias("answer"))


URLS_SQL = "SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN 'image/png' WHEN 1 THEN 'image/svg+xml' END AS mime, CASE WHEN c_custkey % 3 < 2 THEN c_name END AS content, 'get_page {\"page\": ' || c_custkey || '};x {}' AS calls, CASE WHEN c_custkey % 2 = 0 THEN 'it is ' || c_mktsegment ELSE '' END AS answer FROM customer"

QUERIES = {
    "text_forms": (text_forms, _forms_sql()),
    "times_and_paths": (times_and_paths, PATHS_SQL),
    "note_reports": (reports, REPORTS_SQL),
    "vault_notes": (vault_notes, VAULT_SQL),
    "pack_round_trip": (pack_round_trip, PACK_SQL),
    "tool_list_pages": (page_list, f"SELECT page, status, left({D.one_line('text')}, 80) AS preview FROM ({_PAGES})"),
    "tool_text_hits": (text_hits, HITS_SQL),
    "tool_page_range": (page_range, f"SELECT page, status, md5(text) AS digest FROM ({_PAGES}) WHERE page BETWEEN 7 AND 11"),
    "tool_paper_state": (paper_state, f"SELECT count(*) AS pages, count(*) FILTER (status = 'done') AS done, max(page) AS last_page, 4 AS current FROM ({_PAGES})"),
    "trace_pages": (trace_pages, TRACE_SQL),
    "data_urls": (data_urls, URLS_SQL),
}
