"""The reader's rules over the tables: budgets, geometry, labels, prompts, settings and the cache."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.functions import keys as K
from quillspark.functions import text as T
from quillspark.operators import reader as R
from quillspark.operators import stores as S
from quillspark.plans import dialect as D
from quillspark.sources import tables


def _quote(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _array(items: list) -> str:
    return "[" + ", ".join(_quote(x) if isinstance(x, str) else str(x) for x in items) + "]"


def _estimated(text: str) -> str:
    wide = f"len(regexp_extract_all({text}, '{T.WIDE}'))"
    return f"ceil({wide} + (length({text}) + len(regexp_extract_all({text}, '[\\x{{10000}}-\\x{{10FFFF}}]')) - {wide}) / 4)::BIGINT"


def request_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = tables.read(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"), "source")
    prompt = F.concat(F.lit("Page\nSOURCE_TEXT_HINT_BEGIN\n"), "text", F.lit("\nSOURCE_TEXT_HINT_END"))
    tokens = R.request_tokens(F.col("text"), F.col("source"), F.left("text", F.lit(300)), F.col("doc_id") % 3 == 0)
    out = docs.withColumn("t", tokens)
    return out.select("doc_id", R.render_width(F.char_length("text"), F.col("doc_id") % 11 == 0).alias("width"), R.answer_ceiling(prompt, F.col("doc_id") % 13 == 0).alias("ceiling"), "t.prompt", "t.completion")


BUDGET_SQL = f"""
    WITH a AS (SELECT doc_id, coalesce(text, '') AS t, source, length(regexp_replace(coalesce(text, ''), '\\s+', '', 'g')) AS n FROM documents)
    SELECT doc_id, CASE WHEN doc_id % 11 = 0 THEN 2050 WHEN length(t) >= 4300 THEN 1780 WHEN length(t) >= 2800 THEN 1640 ELSE 1500 END::INTEGER AS width,
    CASE WHEN doc_id % 13 = 0 THEN 4096 WHEN n >= 4300 THEN 8192 WHEN n >= 2600 THEN 6144 ELSE 4096 END::INTEGER AS ceiling,
    {_estimated("t")} + {_estimated("source")} + 600 + CASE WHEN doc_id % 3 = 0 THEN 1100 ELSE 0 END AS prompt, {_estimated("left(t, 300)")} AS completion FROM a"""


def page_geometry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of orders as pages: which come first, points and boxes on turned pages, scrolling."""
    li = tables.read(spark, sf_dir, "lineitem")
    x, y = F.col("l_discount") * 10, F.col("l_tax") * 10
    rows = li.select("l_orderkey", "l_linenumber", "l_quantity", x.alias("x"), y.alias("y"), R.page_point(x, y, F.col("l_linenumber") * 45.0).alias("p"))
    box = lambda a, b: F.array(F.col("x") - 0.2, F.col("y") - 0.1, F.col("x") + a, F.col("y") + b)
    boxes = R.target_boxes(F.array(box(0.0, 0.1), box(0.1, -0.2)), box(0.05, 0.05))
    order = R.page_order(F.col("l_linenumber") - 1, (F.col("l_quantity") % 6).cast("int"))
    return rows.select(
        "l_orderkey", "l_linenumber", F.array_join(order.cast("array<string>"), ",").alias("first_pages"), F.round("p.x", 6).alias("px"), F.round("p.y", 6).alias("py"), F.size(boxes).alias("n_boxes"), F.round(F.coalesce(F.get(F.get(boxes, 0), 2), F.lit(-1.0)), 6).alias("right_edge"),
        F.round(R.scroll_delta(F.col("l_quantity"), F.col("y") * 40 - 5, F.col("x") - 0.2, F.lit(7.0)), 6).alias("scroll"), F.round(R.centre_ratio(F.col("l_quantity"), F.col("y"), F.lit(3.0), F.col("l_quantity") % 40 + F.col("x") - 0.3), 6).alias("centre"),
    )


GEOMETRY_SQL = """
    WITH a AS (SELECT l_orderkey, l_linenumber, l_quantity AS q, l_discount * 10 AS x, l_tax * 10 AS y, floor(l_linenumber * 45.0 / 90 + 0.5)::INTEGER % 4 AS k FROM lineitem),
    b AS (SELECT *, [[x - 0.2, y - 0.1, x + 0.0, y + 0.1], [x - 0.2, y - 0.1, x + 0.1, y - 0.2]] AS f, [x - 0.2, y - 0.1, x + 0.05, y + 0.05] AS u FROM a),
    c AS (SELECT *, list_filter(f, lambda v: v[1] >= 0 AND v[2] >= 0 AND v[3] <= 1 AND v[4] <= 1 AND v[3] > v[1] AND v[4] > v[2]) AS ok, u[1] >= 0 AND u[2] >= 0 AND u[3] <= 1 AND u[4] <= 1 AND u[3] > u[1] AND u[4] > u[2] AS uok FROM b),
    d AS (SELECT *, CASE WHEN len(ok) > 0 THEN ok WHEN uok THEN [u] ELSE [] END AS bx, q % 40 + x - 0.3 AS h FROM c)
    SELECT l_orderkey, l_linenumber, array_to_string(list_filter([l_linenumber - 1, l_linenumber - 2, l_linenumber, l_linenumber + 1, l_linenumber + 2], lambda p: p >= 0 AND p < (q % 6)::INTEGER), ',') AS first_pages,
    round(CASE k WHEN 1 THEN y WHEN 2 THEN 1 - x WHEN 3 THEN 1 - y ELSE x END, 6) AS px, round(CASE k WHEN 1 THEN 1 - x WHEN 2 THEN 1 - y WHEN 3 THEN x ELSE y END, 6) AS py, len(bx)::INTEGER AS n_boxes, round(coalesce(bx[1][3], -1.0), 6) AS right_edge,
    round(q + least(1.0, greatest(0.0, x - 0.2)) * greatest(1.0, y * 40 - 5) - 7, 6) AS scroll, round(CASE WHEN h > 0 THEN least(1.0, greatest(0.0, (q + y / 2 - 3) / h)) ELSE 0.5 END, 6) AS centre FROM d"""


def reader_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as documents, their lines as pages."""
    li = tables.read(spark, sf_dir, "lineitem")
    n = li.groupBy("l_orderkey").agg(F.count("*").alias("total"), F.count_if(F.col("l_linestatus") == "F").alias("done"), F.count_if(F.col("l_returnflag") == "N").alias("running"), F.count_if(F.col("l_quantity") > 45).alias("issues"))
    out = n.withColumn("p", R.reader_progress(F.col("total"), F.col("done"), F.col("running"), F.col("issues")))
    resume = R.offers_resume(F.col("done"), F.col("total") - 1)
    return out.select("l_orderkey", "p.label", "p.detail", "p.tone", "p.percent", resume.alias("resume"), R.retry_label(F.col("done"), F.col("total") * 1700).alias("retry"))


PROGRESS_SQL = """
    WITH n AS (SELECT l_orderkey, count(*) AS t, count(*) FILTER (l_linestatus = 'F') AS d, count(*) FILTER (l_returnflag = 'N') AS r, count(*) FILTER (l_quantity > 45) AS i FROM lineitem GROUP BY 1)
    SELECT l_orderkey, CASE WHEN d >= t THEN d || '/' || t || ' 页' WHEN i > 0 THEN d || '/' || t || ' · ' || i || '待处理' WHEN r > 0 THEN d || '/' || t || ' 页' ELSE '0/' || t || ' 页' END AS label,
    CASE WHEN d >= t THEN '全文翻译完成 · ' || t || ' 页' WHEN i > 0 THEN d || '/' || t || ' 页完成 · ' || i || ' 页待处理' WHEN r > 0 THEN '正在翻译 · ' || d || '/' || t || ' 页完成' ELSE '准备翻译 · 共 ' || t || ' 页' END AS detail,
    CASE WHEN d >= t THEN 'success' WHEN i > 0 THEN 'warning' WHEN r > 0 THEN 'busy' ELSE 'idle' END AS tone, CASE WHEN d >= t THEN 100 ELSE floor(d::DOUBLE / t * 100 + 0.5) END::INTEGER AS percent,
    d >= 2 AND (t - 1 = 0 OR d <= t - 1) AS resume, greatest(1, ceil(t * 1700 / 1000.0))::BIGINT || 's 后自动重试（第 ' || greatest(1, d) || ' 次）' AS retry FROM n"""


def page_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = tables.read(spark, sf_dir, "lineitem")
    q = F.col("l_quantity").cast("int")
    outcome = F.when(q % 5 == 0, "failed").when(q % 5 == 1, "done").when(q % 5 == 2, "partial")
    state = R.page_state(F.col("l_returnflag") == "A", F.when(q % 2 == 0, "waiting-layout"), outcome, F.when(q % 7 == 3, "x").otherwise(""), F.col("l_linestatus") == "F", F.col("l_linenumber") % 3)
    return li.select("l_orderkey", "l_linenumber", state.alias("s")).select("l_orderkey", "l_linenumber", "s.label", "s.tone", "s.retry")


STATES_SQL = """
    WITH a AS (SELECT l_orderkey, l_linenumber, l_quantity::INTEGER AS q, l_returnflag = 'A' AS act, l_linestatus = 'F' AS warned, l_linenumber % 3 AS u FROM lineitem)
    SELECT l_orderkey, l_linenumber, CASE WHEN act AND warned THEN '精修中 · 译文可读' WHEN act AND q % 2 = 0 THEN '正在识别版面' WHEN act THEN '正在翻译' WHEN warned THEN '译文可读 · 待精修' WHEN q % 5 = 0 OR q % 7 = 3 THEN '需要重试' WHEN q % 5 = 1 THEN '已完成' WHEN q % 5 = 2 AND u > 0 THEN u || ' 处待补全' WHEN q % 5 = 2 THEN '部分待补全' ELSE '等待翻译' END AS label,
    CASE WHEN act AND warned THEN 'warning' WHEN act THEN 'busy' WHEN warned THEN 'warning' WHEN q % 5 = 0 OR q % 7 = 3 THEN 'error' WHEN q % 5 = 1 THEN 'success' WHEN q % 5 = 2 THEN 'warning' ELSE 'idle' END AS tone,
    NOT act AND (warned OR q % 5 = 0 OR q % 7 = 3 OR q % 5 = 2) AS retry FROM a"""


def library_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = tables.read(spark, sf_dir, "part")
    name = F.concat(F.repeat(F.concat("p_name", F.lit(" ")), (F.col("p_partkey") % 4 + 1).cast("int")), F.when(F.col("p_partkey") % 2 == 0, "v.PDF").otherwise("v"))
    card = R.card(name, F.col("p_size"), (F.col("p_partkey") % 60).cast("int"), (F.col("p_partkey") % 3).cast("int"))
    return p.select("p_partkey", card.alias("c")).select("p_partkey", "c.title", "c.percent", "c.subtitle")


CARDS_SQL = """
    WITH a AS (SELECT p_partkey, regexp_replace(repeat(p_name || ' ', (p_partkey % 4 + 1)::INTEGER) || CASE WHEN p_partkey % 2 = 0 THEN 'v.PDF' ELSE 'v' END, '(?i)\\.pdf$', '') AS n, p_size AS l, p_partkey % 60 AS t, p_partkey % 3 AS d FROM part)
    SELECT p_partkey, CASE WHEN length(n) > 60 THEN left(n, 57) || '…' ELSE n END AS title, CASE WHEN t > 0 THEN least(100, floor(l::DOUBLE / t * 100 + 0.5)) ELSE 0 END::INTEGER AS percent,
    CASE WHEN t > 0 THEN '读到第 ' || l || ' / ' || t || ' 页' || CASE WHEN d > 0 THEN ' · 已译 ' || d || ' 页' ELSE '' END ELSE '尚未开始' END AS subtitle FROM a"""

ERROR_PIECES = [["", "HTTP 429", "  rate-limit hit", "request timed out", "API key missing", "403 Forbidden", "排队超时", "ping 超时", "Failed to fetch", "502", "error 1502 in", "模型返回空", "占位符 lost", "nothing known"], ["", " x", " network", " timeout", " 500 ", " and so on " * 14]]


def error_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = tables.read(spark, sf_dir, "events").select("event_id", (F.col("event_id") * 31 % 997).alias("k"))
    raw = D.picked(ERROR_PIECES, "k", False)
    status = F.element_at(F.array(*[F.lit(s) for s in (200, 408, 429, 500, 503)]), (F.col("k") % 5 + 1).cast("int"))
    name = F.element_at(F.array(*[F.lit(s) for s in ("Error", "TypeError", "NetworkError", "AbortError")]), (F.col("k") % 4 + 1).cast("int"))
    code = F.when(F.col("k") % 9 == 0, "econnreset").otherwise("E1")
    return e.select("event_id", R.error_label(raw).alias("label"), R.fetch_may_pass(status, code, name, raw, F.col("k") % 17 == 0).alias("may_pass"))


def _errors_sql() -> str:
    cases = " ".join(f"WHEN regexp_matches(r, {_quote(pattern)}) THEN {_quote(said)}" for pattern, said in R.ERROR_LABELS)
    return f"""
        WITH k AS (SELECT event_id, event_id * 31 % 997 AS k FROM events), a AS (SELECT *, {D.picked(ERROR_PIECES, "k", True)} AS raw FROM k), b AS (SELECT *, trim(raw) AS r FROM a)
        SELECT event_id, CASE WHEN r = '' THEN {_quote(R.NO_ERROR)} {cases} WHEN length(r) > 120 THEN left(r, 117) || '…' ELSE r END AS label,
        k % 17 <> 0 AND k % 4 <> 3 AND (k % 5 IN (1, 2, 4) OR k % 9 = 0 OR (k % 4 IN (1, 2) AND regexp_matches(lower(raw), '{R.FETCH_MESSAGES}'))) AS may_pass FROM b"""


URL_PIECES = [["https://", "http://", "HTTPS://", "ftp://", ""], ["api.example.org", "localhost:8080", "user:pw@api.example.org", "[::1]", "127.0.0.1", ""], ["", "/v1", "/v1//", "/v1?token=x", "/v1/?a=b&API_KEY=c", "/#top", "/v1?keys=1"]]


def profile_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = tables.read(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_mktsegment", (F.col("c_custkey") * 13 % 10_007).alias("k"))
    url = D.picked(URL_PIECES, "k", False)
    protocol = F.when(F.col("k") % 19 == 0, "smtp").when(F.col("k") % 2 == 0, "openai").otherwise("gemini")
    return c.select("c_custkey", R.profile_fault(F.col("c_name"), F.when(F.col("k") % 23 != 0, "key"), F.col("c_mktsegment"), protocol, url).alias("fault"), R.base_url(url).alias("base"))


PROFILE_SQL = f"""
    WITH k AS (SELECT c_custkey, c_custkey * 13 % 10007 AS k FROM customer), a AS (SELECT *, {D.picked(URL_PIECES, "k", True)} AS u FROM k),
    b AS (SELECT *, lower(regexp_extract(u, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?(\\[[^\\]]*\\]|[^:/?#]*)', 1)) AS h FROM a)
    SELECT c_custkey, CASE WHEN k % 23 = 0 THEN 'incomplete' WHEN k % 19 = 0 THEN 'protocol' WHEN u = '' THEN 'no-url' WHEN h = '' THEN 'bad-url' WHEN NOT (u ILIKE 'https://%' OR (u ILIKE 'http://%' AND h IN ('localhost', '127.0.0.1', '[::1]', '::1'))) THEN 'not-https'
    WHEN regexp_matches(u, '^[^:]+://[^/?#]*@') THEN 'credentials' WHEN contains(u, '#') THEN 'fragment' WHEN regexp_matches(u, '(?i)[?&](key|api_key|apikey|api-key|x-api-key|token|access_token)(=|&|$)') THEN 'secret-parameter' ELSE '' END AS fault,
    CASE WHEN contains(u, '?') THEN rtrim(string_split(u, '?')[1], '/') || '?' || string_split(u, '?')[2] ELSE rtrim(u, '/') END AS base FROM b"""


def settings_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = tables.read(spark, sf_dir, "part")
    k = F.col("p_partkey")
    ui = R.ui_settings(F.when(k % 2 == 0, "dark").when(k % 3 == 0, "blue"), F.when(k % 5 == 0, F.lit(False)), F.when(k % 7 == 0, F.lit(True)), F.when(k % 4 == 0, F.lit(True)).otherwise(F.lit(False)), F.col("p_retailprice"))
    link = R.link_setting(F.when(k % 6 != 0, F.concat(F.lit(" "), "p_brand", F.lit("/"))).otherwise("  "), F.when(k % 9 == 0, F.lit(False)))
    return s.select("p_partkey", ui.alias("u"), link.alias("l")).select("p_partkey", "u.theme", "u.linked", "u.auto", "u.bilingual", "u.width", F.col("l.address").alias("address"), F.col("l.enabled").alias("enabled"))


SETTINGS_SQL = """
    SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN 'dark' ELSE 'light' END AS theme, p_partkey % 5 <> 0 AS linked, p_partkey % 7 = 0 AS auto, p_partkey % 4 = 0 AS bilingual, CASE WHEN floor(p_retailprice + 0.5) BETWEEN 300 AND 1200 THEN floor(p_retailprice + 0.5) ELSE 420 END::INTEGER AS width,
    CASE WHEN p_partkey % 6 <> 0 THEN p_brand || '/' END AS address, CASE WHEN p_partkey % 6 <> 0 THEN p_partkey % 9 <> 0 END AS enabled FROM part"""


def selection_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as questions about the text of the turn's first half, with its second half around it."""
    t = tables.read(spark, sf_dir, "conversations").select("conv_id", "turn", F.coalesce("text", F.lit("")).alias("t"))
    half = F.floor(F.char_length("t") / 2).cast("int")
    picked, around = F.when(F.col("turn") % 4 != 3, F.left("t", half)).otherwise(" "), F.when(F.col("turn") % 3 != 0, F.substring("t", half + 1, F.lit(100_000))).otherwise("")
    asked = F.when(F.col("turn") % 2 == 0, F.concat(F.lit(" why "), F.col("conv_id").cast("string"))).otherwise("")
    intent = F.element_at(F.array(*[F.lit(x) for x in ("explain", "plain", "why", "custom", "other")]), (F.col("conv_id") % 5 + 1).cast("int"))
    digest = lambda c: F.md5(F.encode(c, "UTF-8"))
    return t.select("conv_id", "turn", digest(R.selection_request(picked, around, F.lit(None).cast("string"))).alias("request"), digest(R.selection_question(picked, around, intent)).alias("question"), digest(R.message_with_quote(asked, picked, around)).alias("message"))


def _selection_sql() -> str:
    n = "chr(10)"
    leads = " ".join(f"WHEN {i} THEN '{R.ASKED[k]}'" for i, k in enumerate(R.ASKED))
    quoted = f"{n} || {n} || '“' || e || '”' || CASE WHEN x <> '' AND x <> e THEN {n} || {n} || '（上下文参考：' || x || '）' ELSE '' END"
    return f"""
        WITH a AS (SELECT conv_id, turn, coalesce(text, '') AS t, length(coalesce(text, '')) // 2 AS h FROM conversations),
        b AS (SELECT *, CASE WHEN turn % 4 <> 3 THEN left(t, h) ELSE ' ' END AS p, CASE WHEN turn % 3 <> 0 THEN substr(t, h + 1) ELSE '' END AS r, CASE WHEN turn % 2 = 0 THEN 'why ' || conv_id ELSE '' END AS q FROM a),
        c AS (SELECT *, {D.one_line("p")} AS o, {D.one_line("r")} AS a1, left({D.one_line("p")}, {R.EXCERPT}) AS e, left({D.one_line("r")}, {R.EXCERPT}) AS x FROM b),
        d AS (SELECT *, CASE conv_id % 5 {leads} ELSE '{R.ASKED["explain"]}' END AS lead FROM c)
        SELECT conv_id, turn, md5(CASE WHEN o = '' THEN '' WHEN a1 = '' THEN o ELSE '{R.CONTEXT_MARKER}' || {n} || a1 || ' ' || o || {n} || {n} || '{R.EXCERPT_MARKER}' || {n} || o END) AS request,
        md5(CASE WHEN e = '' OR conv_id % 5 = 3 THEN '' ELSE lead || {quoted} END) AS question,
        md5(CASE WHEN e = '' THEN q WHEN q = '' THEN '{R.ASKED["explain"]}' || {quoted} ELSE '关于下面这段内容：' || {quoted} || {n} || {n} || q END) AS message FROM d"""


def prompt_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as projects: their orders are tasks and facts, their segments terms."""
    c, o = tables.read(spark, sf_dir, "customer"), tables.read(spark, sf_dir, "orders")
    item = F.struct("o_orderkey", F.struct(F.concat(F.lit("t"), F.col("o_orderkey").cast("string")).alias("id"), F.col("o_orderpriority").alias("text")).alias("todo"), F.col("o_orderstatus").alias("fact"))
    own = o.groupBy("o_custkey").agg(F.array_sort(F.collect_list(item)).alias("x"))
    rows = c.join(own, c["c_custkey"] == own["o_custkey"], "left").withColumn("x", F.coalesce("x", F.array().cast(own.schema["x"].dataType)))
    todos, facts = F.transform("x", lambda i: i["todo"]), F.transform("x", lambda i: i["fact"])
    terms = F.transform("x", lambda i: F.struct(i["todo"]["text"].alias("term"), i["fact"].alias("translation")))
    field, goal = F.concat(F.lit("the study of "), "c_mktsegment"), F.when(F.col("c_custkey") % 3 == 0, F.concat("c_name", F.lit(" and Graph-based graph-based NLP models")))
    digest = lambda col: F.md5(F.encode(col, "UTF-8"))
    return rows.select("c_custkey", R.profile_block(F.when(F.col("c_custkey") % 2 == 0, field), F.lit(""), goal).alias("profile"), F.array_join(R.profile_keywords(field, goal), ",").alias("keywords"), digest(R.memory_block(F.when(F.col("c_custkey") % 4 == 0, F.col("c_name")).otherwise(""), todos, facts)).alias("memory"), digest(R.glossary_block(terms)).alias("glossary"))


def _blocks_sql() -> str:
    n = "chr(10)"
    stop = _array(R.PROFILE_STOP_WORDS)
    return f"""
        WITH o AS (SELECT o_custkey, list({{'id': 't' || o_orderkey, 'text': o_orderpriority, 'fact': o_orderstatus}} ORDER BY o_orderkey) AS x FROM orders GROUP BY 1),
        a AS (SELECT c_custkey, c_name, coalesce(x, []) AS x, 'the study of ' || c_mktsegment AS f, CASE WHEN c_custkey % 3 = 0 THEN c_name || ' and Graph-based graph-based NLP models' END AS g FROM customer LEFT JOIN o ON c_custkey = o_custkey),
        b AS (SELECT *, regexp_extract_all(concat_ws(' ', f, g), '[A-Za-z][A-Za-z0-9+_-]{{2,}}') AS w FROM a),
        c AS (SELECT *, list_transform(w, lambda v: lower(v)) AS l FROM b)
        SELECT c_custkey, CASE WHEN c_custkey % 2 <> 0 AND g IS NULL THEN '' ELSE concat_ws({n}, '【用户研究档案】', CASE WHEN c_custkey % 2 = 0 THEN '领域：' || f END, '当前目标：' || g, '调研、选会、写作建议尽量贴合该方向。') END AS profile,
        array_to_string(list_filter(w, lambda v, i: list_position(l, lower(v)) = i AND NOT list_contains({stop}, lower(v)))[1:8], ',') AS keywords,
        md5(CASE WHEN len(x) = 0 THEN '' ELSE concat_ws({n}, '【课题记忆 · 跨会话】', CASE WHEN c_custkey % 4 = 0 THEN '关联论文：' || c_name END, '未完成待办：' || {n} || array_to_string(list_transform(x[1:8], lambda i: '- [' || i.id || '] ' || i.text), {n}), '已记要点：' || {n} || array_to_string(list_transform(x[1:8], lambda i: '- ' || i.fact), {n})) END) AS memory,
        md5(CASE WHEN len(x) = 0 THEN '' ELSE {_quote(R.GLOSSARY_HEAD[0])} || {n} || {_quote(R.GLOSSARY_HEAD[1])} || {n} || array_to_string(list_transform(x[greatest(1, len(x) - 59):], lambda i: '- ' || i.text || ' => ' || i.fact), {n}) END) AS glossary FROM c"""


TALK = ["\nWait, let me see", "\nLet me re-read this", "\nHmm, odd", "\nokay so then", " wait, let me", "\nLet me out"]


def self_talk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of which each is cut in two by something that a model may say."""
    docs = tables.read(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("t"))
    said = F.element_at(F.array(*[F.lit(x) for x in TALK]), (F.col("doc_id") % len(TALK) + 1).cast("int"))
    at = (F.col("doc_id") * 7 % 200).cast("int")
    text = F.concat(F.left("t", at), said, F.lit(" "), F.substring("t", at + 1, F.lit(1_000_000)))
    return docs.select("doc_id", F.md5(F.encode(R.without_self_talk(text), "UTF-8")).alias("digest"))


def _talk_sql() -> str:
    picked = "([" + ", ".join(f"chr(10) || {_quote(x[1:])}" if x[0] == "\n" else _quote(x) for x in TALK) + f"])[doc_id % {len(TALK)} + 1]"
    pattern = R"(?i)\n(?:(?:Wait[,.]?\s+let me|Let me (?:look|check|think|re-?read)|Actually[,.]?\s+wait)\b|(?:Hmm[,.]?\s+|Okay[,.]?\s+so\b))"
    return f"""
        WITH a AS (SELECT doc_id, coalesce(text, '') AS t, (doc_id * 7 % 200)::INTEGER AS k FROM documents), b AS (SELECT doc_id, left(t, k) || {picked} || ' ' || substr(t, k + 1) AS x FROM a),
        c AS (SELECT doc_id, x, regexp_matches(x, '{pattern}') AS met, regexp_replace(regexp_replace(x, '(?s){pattern}.*$', ''), '^\\s+|\\s+$', '', 'g') AS h FROM b)
        SELECT doc_id, md5(CASE WHEN met AND (length(h) >= 80 OR regexp_matches(h, '[\\x{{4e00}}-\\x{{9fff}}]{{8,}}') OR regexp_matches(h, '(?m)^#{{1,3}}\\s')) THEN h ELSE x END) AS digest FROM c"""


SIGN_PIECES = [["x", "= 3", "the sum", "(12)", "αβ", "12 34 5", "", " and of that"], ["", " + y", " ≤ ∑", " is here", "→", " 77%"], ["", "^2", " words in a row", "()"]]


def graphic_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = tables.read(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_orderkey") * 17 % 4_099).alias("k"))
    return o.select("o_orderkey", R.graphic_text(D.picked(SIGN_PIECES, "k", False)).alias("graphic"), R.cacheable(F.element_at(F.array(F.lit(" \n"), F.lit("x"), F.lit(None).cast("string")), (F.col("k") % 3 + 1).cast("int"))).alias("cacheable"))


GRAPHIC_SQL = f"""
    WITH k AS (SELECT o_orderkey, o_orderkey * 17 % 4099 AS k FROM orders), a AS (SELECT *, trim({D.picked(SIGN_PIECES, "k", True)}) AS t FROM k),
    b AS (SELECT *, greatest(1, length(t)) AS n, len(regexp_extract_all(t, '[A-Za-z]')) AS l, len(regexp_extract_all(t, '[0-9]')) AS d, len(regexp_extract_all(t, '[\\x{{370}}-\\x{{3ff}}]')) + len(regexp_extract_all(t, '[=+\\-*/^_{{}}\\\\<>|·⋅×÷±∓∑∏∫∇∈∉⊂⊆⊇⊕⊗∀∃∅∞≤≥≠≈≡∝√∂→←↦↔⟨⟩‖∘∗]')) AS s FROM a)
    SELECT o_orderkey, length(t) >= 2 AND NOT regexp_matches(t, '^\\(?\\d{{1,3}}\\)?$') AND ((s / n >= 0.16 AND l / n < 0.6) OR (len(regexp_extract_all(t, '[A-Za-z]{{3,}}')) <= 1 AND (s + d) / n > 0.4 AND n <= 90)) AS graphic, k % 3 = 1 AS cacheable FROM b"""


def trusted_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as found tables with a row for each line."""
    li = tables.read(spark, sf_dir, "lineitem")
    rows = li.groupBy("l_orderkey").agg(F.collect_list(F.array_repeat(F.lit("c"), F.col("l_quantity").cast("int"))).alias("rows"), F.max("l_discount").alias("d"), F.min("l_returnflag").alias("f"))
    kind, detector = F.when(F.col("l_orderkey") % 10 == 0, "figure").otherwise("table"), F.when(F.col("f") == "A", "pymupdf-layout").when(F.col("f") == "N", "pymupdf-ruled-text").otherwise("ocr")
    return rows.select("l_orderkey", R.trusted_table(kind, detector, 1 - F.col("d"), F.col("rows"), (F.col("l_orderkey") % 120).cast("int")).alias("trusted"))


TABLES_SQL = "SELECT l_orderkey, l_orderkey % 10 <> 0 AND min(l_returnflag) IN ('A', 'N') AND 1 - max(l_discount) >= 0.9 AND count(*) * greatest(max(l_quantity::INTEGER), l_orderkey % 120) <= 512 AS trusted FROM lineitem GROUP BY l_orderkey"


def _cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What was put into the cache last under each key, a hash of the request's settings and text."""
    t = tables.read(spark, sf_dir, "conversations").filter("text IS NOT NULL AND role = 'assistant'")
    key = K.strong_hash_key(F.concat_ws("|", F.lit("chat"), (F.col("conv_id") % 500).cast("string"), F.col("turn").cast("string")))
    put = t.select(key.alias("cache_key"), F.col("text").alias("value"), (F.col("conv_id") * 1000 + F.col("turn")).alias("ord"))
    return put.filter(R.cacheable(F.col("value"))).groupBy("cache_key").agg(F.max_by("value", "ord").alias("value"))


def cache_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests and what the cache has for them; null is a miss."""
    asked = tables.read(spark, sf_dir, "conversations").select((F.col("conv_id") % 700).alias("conv"), "turn").distinct()
    keyed = asked.withColumn("cache_key", K.strong_hash_key(F.concat_ws("|", F.lit("chat"), F.col("conv").cast("string"), F.col("turn").cast("string"))))
    return S.looked_up(keyed, _cache(spark, sf_dir), "cache_key").select("conv", "turn", "value")


_CACHED = "SELECT conv_id % 500 AS conv, turn, arg_max(text, conv_id * 1000 + turn) AS value FROM conversations WHERE role = 'assistant' AND trim(text, ' ' || chr(9) || chr(10) || chr(13)) <> '' GROUP BY 1, 2"


def cache_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries before and after the cache is cleared."""
    cache = _cache(spark, sf_dir)
    return cache.agg(F.count("*").alias("entries")).crossJoin(S.cleared(cache).agg(F.count("*").alias("after")))


QUERIES = {
    "request_budget": (request_budget, BUDGET_SQL),
    "page_geometry": (page_geometry, GEOMETRY_SQL),
    "reader_progress": (reader_progress, PROGRESS_SQL),
    "page_states": (page_states, STATES_SQL),
    "library_cards": (library_cards, CARDS_SQL),
    "error_labels": (error_labels, _errors_sql()),
    "profile_checks": (profile_checks, PROFILE_SQL),
    "settings_records": (settings_records, SETTINGS_SQL),
    "selection_prompts": (selection_prompts, _selection_sql()),
    "prompt_blocks": (prompt_blocks, _blocks_sql()),
    "self_talk": (self_talk, _talk_sql()),
    "graphic_pieces": (graphic_pieces, GRAPHIC_SQL),
    "trusted_tables": (trusted_tables, TABLES_SQL),
    "cache_lookup": (cache_lookup, f"WITH c AS ({_CACHED}) SELECT DISTINCT conv_id % 700 AS conv, t.turn, c.value FROM conversations t LEFT JOIN c ON c.conv = t.conv_id % 700 AND c.turn = t.turn"),
    "cache_size": (cache_size, f"SELECT count(*) AS entries, 0 AS after FROM ({_CACHED})"),
}
