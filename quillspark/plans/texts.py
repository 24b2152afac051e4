"""Text functions over documents and pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.functions import keys as K
from quillspark.functions import text as T
from quillspark.operators import documents as O
from quillspark.plans import dialect as D
from quillspark.sources import tables


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.read(spark, sf_dir, "documents")


def html_to_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.read(spark, sf_dir, "pages").select("page_id", T.readable_html(F.col("html")).alias("text"))


def _html_sql() -> str:
    out = "coalesce(html, '')"
    for pattern, to in [
        (r"(?is)<script\b.*?</script>", "' '"), (r"(?is)<style\b.*?</style>", "' '"), (r"(?is)<(nav|header|footer|aside)\b.*?</(nav|header|footer|aside)>", "' '"),
        (r"(?i)<br\s*/?>(\s|$)", r"' \1'"), (r"(?i)<br\s*/?>", "chr(10)"), (r"(?i)</(p|div|li|h[1-6]|tr)>", "chr(10)"), (r"(?s)<[^>]+>", "' '"), ("(?i)&nbsp;", "' '"), ("(?i)&amp;", "'&'"), ("(?i)&lt;", "'<'"), ("(?i)&gt;", "'>'"),
        ("[ \\t]+", "' '"), (r"\n\s*\n\s*\n+", "chr(10) || chr(10)"), (r"^\s+|\s+$", "''"),
    ]:
        out = f"regexp_replace({out}, '{pattern}', {to}, 'g')"
    return f"SELECT page_id, {out} AS text FROM pages"


def section_cues(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat_ws(" ", "text", F.when(F.col("doc_id") % 3 == 0, "Abstract: the method"), F.when(F.col("doc_id") % 5 == 0, "实验 Table 3"))
    return _docs(spark, sf_dir).select("doc_id", F.array_join(T.section_cues(text), ",").alias("cues"))


def _cues_sql() -> str:
    text = "concat_ws(' ', text, CASE WHEN doc_id % 3 = 0 THEN 'Abstract: the method' END, CASE WHEN doc_id % 5 = 0 THEN '实验 Table 3' END)"
    cases = ", ".join(f"CASE WHEN regexp_matches(t, '{p}') THEN '{label}' END" for p, label in T.SECTION_CUES)
    return f"WITH a AS (SELECT doc_id, {text} AS t FROM documents), b AS (SELECT doc_id, list_filter([{cases}], lambda x: x IS NOT NULL) AS l FROM a) SELECT doc_id, array_to_string({_first_of_each('l')}, ',') AS cues FROM b"


def _first_of_each(items: str) -> str:
    return f"list_filter({items}, lambda x, i: list_position({items}, x) = i)"


def key_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", F.array_join(T.key_numbers(_numbered()), ",").alias("numbers"))


def _numbered():
    return F.concat_ws(" ", "text", F.concat((F.col("doc_id") % 97).cast("string"), F.lit(".25 and 17 % of 2019 or 0.5 (3) [12, 13] and 4096")))


_NUMBERED = "concat_ws(' ', text, (doc_id % 97)::VARCHAR || '.25 and 17 % of 2019 or 0.5 (3) [12, 13] and 4096')"


def _numbers_sql() -> str:
    return f"WITH a AS (SELECT doc_id, list_filter(list_transform(regexp_extract_all({_NUMBERED}, '(\\d+\\.\\d+\\s*%|\\d+\\s*%|\\d+\\.\\d{{2,}})'), lambda x: trim(x)), lambda x: NOT regexp_matches(x, '^(19|20)\\d{{2}}$')) AS l FROM documents) SELECT doc_id, array_to_string(({_first_of_each('l')})[1:12], ',') AS numbers FROM a"


def anchor_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", F.array_join(T.anchors(_numbered()), ",").alias("anchors"))


def _anchors_sql() -> str:
    t = _NUMBERED
    cites = f"list_transform(regexp_extract_all({t}, '\\[(\\d{{1,3}}(?:\\s*[,–-]\\s*\\d{{1,3}})*)\\]', 1), lambda x: '[' || regexp_replace(x, '\\s+', '', 'g') || ']')"
    numbers = f"list_transform(regexp_extract_all({t}, '\\((\\d{{1,3}})\\)', 1), lambda x: '(' || x || ')')"
    integers = f"list_filter(regexp_extract_all({t}, '[\\d.]+'), lambda x: regexp_matches(x, '^\\d{{3,}}$'))"
    every = f"list_filter(list_transform(list_concat({cites}, {numbers}, regexp_extract_all({t}, '[A-Za-z][A-Za-z-]{{2,}}'), regexp_extract_all({t}, '\\d+\\.\\d+%?'), {integers}), lambda x: lower(x)), lambda x: length(x) >= 2)"
    return f"WITH a AS (SELECT doc_id, {every} AS l FROM documents) SELECT doc_id, array_to_string(({_first_of_each('l')})[1:24], ',') AS anchors FROM a"


def symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat_ws(" ", F.lit("HTTP BERT x_1 ResNet \\alpha AND bert y_ij DeepMind"), "text")
    return _docs(spark, sf_dir).select("doc_id", F.array_join(F.transform(T.symbols(text), lambda s: F.concat(s["kind"], F.lit(":"), s["token"])), ",").alias("symbols"))


def _symbols_sql() -> str:
    t = "concat_ws(' ', 'HTTP BERT x_1 ResNet \\alpha AND bert y_ij DeepMind', text)"
    kinds = [("acronym", "\\b([A-Z]{2,6})\\b"), ("symbol", "\\b([A-Za-z][A-Za-z0-9]{0,6}_[A-Za-z0-9]{1,6})\\b"), ("greek", "(?i)(\\\\(?:alpha|beta|gamma|delta|epsilon|theta|lambda|mu|sigma|omega|phi|psi))\\b"), ("term", "\\b([A-Z][a-z]+(?:[A-Z][a-z0-9]+){1,3})\\b")]
    each = ", ".join(f"list_transform(regexp_extract_all({t}, '{p}', 1), lambda x: {{'k': '{k}', 't': {'lower(x)' if k == 'greek' else 'x'}}})" for k, p in kinds)
    stop = ", ".join(f"'{w}'" for w in T.NO_SYMBOLS)
    return f"""
        WITH a AS (SELECT doc_id, list_filter(flatten([{each}]), lambda s: length(s.t) BETWEEN 2 AND 24 AND upper(s.t) NOT IN ({stop})) AS l FROM documents),
        b AS (SELECT doc_id, l, list_transform(l, lambda s: lower(s.t)) AS k FROM a)
        SELECT doc_id, coalesce(array_to_string(list_transform((list_filter(l, lambda s, i: list_position(k, lower(s.t)) = i))[1:16], lambda s: s.k || ':' || s.t), ','), '') AS symbols FROM b"""


def text_measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Small text functions side by side."""
    c = F.col("text")
    return _docs(spark, sf_dir).select(
        "doc_id",
        T.estimated_tokens(c).alias("tokens"),
        T.token_label(T.estimated_tokens(c) * 1000).alias("token_label"),
        F.coalesce(T.year(F.concat_ws(" ", c, (F.lit(1985) + F.col("doc_id") % 60).cast("string"))), F.lit(0)).alias("year"),
        T.arxiv_id(F.concat_ws(" ", F.lit("arXiv: 2203.15"), F.col("doc_id") % 1000 + 100)).alias("arxiv_id"),
        T.occurrences(F.lower(c), "the").alias("occurrences"),
        F.char_length(T.squeezed(c)).alias("squeezed"),
        T.clipped(c, 40).alias("clipped"),
        T.middle_clipped(c).alias("middle"),
        T.has_enough_letters(c).alias("translatable"),
        T.translatable_selection(c).alias("selection"),
        T.askable_selection(c).alias("askable"),
    )


def _measures_sql() -> str:
    line = D.one_line("text")
    year = "concat_ws(' ', text, (1985 + doc_id % 60)::VARCHAR)"
    y = "\\b(199\\d|20[0-3]\\d)\\b"
    tokens = "ceil(length(coalesce(text, '')) / 4.0)::BIGINT"
    trimmed = "regexp_replace(coalesce(text, ''), '^\\s+|\\s+$', '', 'g')"
    return f"""
        SELECT doc_id, {tokens} AS tokens,
        CASE WHEN {tokens} * 1000 >= 100000000 THEN printf('%.2f亿', {tokens} * 1000 / 1e8) WHEN {tokens} * 1000 >= 10000 THEN printf('%.1f万', {tokens} * 1000 / 1e4) ELSE ({tokens} * 1000)::VARCHAR END AS token_label,
        coalesce(nullif(regexp_extract(left({year}, 600), '{y}', 1), ''), nullif(regexp_extract({year}, '{y}', 1), ''), '0')::INTEGER AS year,
        regexp_extract(concat_ws(' ', 'arXiv: 2203.15', doc_id % 1000 + 100), '(?i)arXiv[:\\s]*(\\d{{4}}\\.\\d{{4,5}}(?:v\\d+)?)', 1) AS arxiv_id,
        {D.count_of("lower(text)", "the")} AS occurrences, length({D.squeezed("text")}) AS squeezed,
        CASE WHEN length(text) > 40 THEN left(text, 40) || '…' ELSE text END AS clipped,
        CASE WHEN length({line}) <= 72 THEN {line} ELSE left({line}, 39) || '…' || right({line}, 32) END AS middle,
        length({trimmed}) >= 3 AND length(regexp_replace({trimmed}, '[^\\p{{L}}]', '', 'g')) >= 0.2 * length({trimmed}) AS translatable,
        length({line}) BETWEEN 2 AND 1200 AND regexp_matches({line}, '[\\p{{L}}\\p{{N}}]') AS selection,
        length({line}) BETWEEN 1 AND 1500 AND regexp_matches({line}, '[\\p{{L}}\\p{{N}}]') AS askable
        FROM documents"""


def repeated_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.repeated_lines(_docs(spark, sf_dir).select("doc_id", "text"))


REPEATED_SQL = f"""
    WITH l AS (SELECT doc_id, lower({D.one_line("regexp_replace(x, '^[#>*\\-\\d.\\s]+', '', 'g')")}) AS line FROM (SELECT doc_id, unnest(regexp_split_to_array(text, '\\r?\\n')) AS x FROM documents)),
    c AS (SELECT doc_id, line, count(*) AS n FROM l WHERE length(line) >= 14 GROUP BY ALL)
    SELECT doc_id, count(*) AS repeated, sum(n)::BIGINT AS lines FROM c WHERE n >= 3 GROUP BY doc_id"""


def _named(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.read(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_mktsegment")


def cache_key_fnv(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _named(spark, sf_dir)
    return rows.select("c_custkey", K.hash_key(F.col("c_name")).alias("short_key"), K.strong_hash_key(F.concat_ws("|", "c_name", "c_mktsegment")).alias("strong_key"))


def _units(text: str) -> str:
    return f"list_transform(range(1, length({text}) + 1), lambda i: unicode({text}[i])::HUGEINT)"


def _fnv(text: str, seed: int) -> str:
    return f"lower(to_base((list_reduce(list_prepend({seed}::HUGEINT, {_units(text)}), lambda h, u: (xor(h, u) * 16777619) % 4294967296))::BIGINT, 36))"


FNV_SQL = f"WITH a AS (SELECT c_custkey, c_name AS a, c_name || '|' || c_mktsegment AS b FROM customer) SELECT c_custkey, {_fnv('a', 0x811C9DC5)} AS short_key, {_fnv('b', 0x811C9DC5)} || '.' || {_fnv('b', 0x9747B28C)} AS strong_key FROM a"


def hash31_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _named(spark, sf_dir).select("c_custkey", K.hash31(F.col("c_name")).alias("hash"), K.row_id("n", F.col("c_name")).alias("id"))


HASH31_SQL = f"WITH a AS (SELECT c_custkey, list_reduce(list_prepend(0::HUGEINT, {_units('c_name')}), lambda h, u: ((h * 31 + u + 2147483648) % 4294967296 + 4294967296) % 4294967296 - 2147483648)::BIGINT AS hash FROM customer) SELECT c_custkey, hash, 'n' || lower(to_base(abs(hash), 36)) AS id FROM a"


def path_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = tables.read(spark, sf_dir, "part")
    raw = F.concat(F.col("p_name"), F.lit(": a/b? "), F.col("p_brand"))
    return rows.select("p_partkey", T.safe_segment(raw).alias("segment"), T.escaped_html(F.concat(F.lit("<b>&\"'"), "p_name")).alias("escaped"), T.neutral_html(F.concat(F.lit("a < b <i>"), "p_name")).alias("neutral"), F.size(T.keyword_list(F.concat_ws("，", "p_name", "p_type", "p_brand"))).alias("keywords"))


NAMES_SQL = """
    SELECT p_partkey, left(regexp_replace(regexp_replace(regexp_replace(p_name || ': a/b? ' || p_brand, '[\\\\/:*?"<>|#^\\[\\]]+', ' ', 'g'), '\\s+', ' ', 'g'), '^\\s+|\\s+$', '', 'g'), 80) AS segment,
    '&lt;b&gt;&amp;&quot;&#39;' || p_name AS escaped, 'a < b &lt;i>' || p_name AS neutral, 3 AS keywords FROM part"""


def citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The four citation rules side by side."""
    turns = tables.read(spark, sf_dir, "conversations")
    text = F.concat(F.lit("第 "), (F.col("conv_id") * 31 % 20000).cast("string"), F.lit(" 页, see page "), (F.col("turn") + 4).cast("string"), F.lit(" and p. 7（第3页） 第0页 (p. 9)"))
    join = lambda a: F.array_join(a, ",")
    return turns.select("conv_id", "turn", join(T.page_citations(text)).alias("cited"), join(T.skill_citations(text)).alias("skill"), join(T.any_citations(text, 30)).alias("any_form"), join(T.mobile_citations(text)).alias("mobile"))


CITATIONS_SQL = """
    WITH a AS (SELECT conv_id, turn, conv_id * 31 % 20000 AS n, turn + 4 AS p FROM conversations),
    b AS (SELECT *, [n, 3, 0] AS every, CASE WHEN n < 10000 THEN [n, 3] ELSE [3] END AS short FROM a)
    SELECT conv_id, turn, array_to_string(list_filter(every, lambda x, i: list_position(every, x) = i), ',') AS cited,
    array_to_string(list_filter(short, lambda x, i: x >= 1 AND list_position(short, x) = i), ',') AS skill,
    array_to_string(list_sort(list_distinct(list_filter([n, 3, p, 7, 9], lambda x: x >= 1 AND x <= 30))), ',') AS any_form,
    array_to_string(list_filter(short, lambda x, i: x >= 1 AND list_position(short, x) = i), ',') AS mobile FROM b"""


def outline(spark: SparkSession, sf_dir: str) -> DataFrame:
    marked = _docs(spark, sf_dir).select(F.col("source").alias("doc"), F.col("doc_id").alias("page"), F.concat(F.lit("# "), F.left(T.one_line(F.col("text")), F.lit(20)), F.lit("\ntext\n### Part "), F.col("doc_id") % 7, F.lit("\n#### too deep\n### Part "), F.col("doc_id") % 7).alias("markdown"))
    return O.outline(marked)


OUTLINE_SQL = f"""
    WITH h AS (SELECT source AS doc, doc_id AS page, unnest([1, 2]) AS i, '{{}}' AS x, text FROM documents),
    t AS (SELECT doc, page, i, CASE WHEN i = 1 THEN 1 ELSE 3 END AS level, CASE WHEN i = 1 THEN regexp_replace(left({D.one_line("text")}, 20), '\\s+$', '') ELSE 'Part ' || (page % 7) END AS title FROM h),
    f AS (SELECT * FROM t WHERE title <> ''), r AS (SELECT *, row_number() OVER (PARTITION BY doc ORDER BY page, i) AS n FROM f)
    SELECT doc, page, level::INTEGER AS level, title, n FROM r WHERE n <= 120"""

QUERIES = {
    "html_to_text": (html_to_text, _html_sql()),
    "section_cues": (section_cues, _cues_sql()),
    "key_numbers": (key_numbers, _numbers_sql()),
    "anchor_extract": (anchor_extract, _anchors_sql()),
    "symbols": (symbols, _symbols_sql()),
    "text_measures": (text_measures, _measures_sql()),
    "repeated_lines": (repeated_lines, REPEATED_SQL),
    "cache_key_fnv": (cache_key_fnv, FNV_SQL),
    "hash31_id": (hash31_id, HASH31_SQL),
    "path_names": (path_names, NAMES_SQL),
    "citations": (citations, CITATIONS_SQL),
    "outline": (outline, OUTLINE_SQL),
}
