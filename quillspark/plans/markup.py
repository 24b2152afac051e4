"""References in Markdown and links in HTML, over parts put together and over whole pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.operators import markup as K
from quillspark.plans import dialect as D
from quillspark.plans import formulas
from quillspark.sources import tables

REFERENCES = [["References\n", "12: [1] Wang, Y. A, 2013\n", "Text before.\n", ""], ["[2] Li, B. A title\n", "107: [3] Ü, C.\n", "2. Ärger, D.\n\n\n\n"], ["  [4] see\n", "2023: Wu, X., On it\n", "Doe, J. K., Of this, Journal\n", "see [5] there\n"], ["last [6] A", "Springer\n[7] B", "3. Zed"]]


def reference_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = tables.read(spark, sf_dir, "orders")
    return o.select("o_orderkey", K.reference_paragraphs(D.picked(REFERENCES, "o_orderkey", False)).alias("markdown"))


def _apart(t: str) -> str:
    for start in K.ENTRY_STARTS:
        pattern = D.re2(rf"([^\n])\n([ \t]*)({start})")
        t = f"regexp_replace({t}, {pattern}, '\\1' || chr(10) || chr(10) || '\\2\\3', 'g')"
    return f"regexp_replace({t}, '\\n{{3,}}', chr(10) || chr(10), 'g')"


#: A line number goes with its mark put back, as there is no looking ahead; entries with authors are told by their marks in these parts.
_ENTRY = "len(list_filter(string_split(t, chr(10)), lambda v: length(" + D.one_line("v") + ") BETWEEN 18 AND 1400 AND regexp_matches(" + D.one_line("v") + ", '^(?:\\[\\s*\\d{1,4}\\s*\\]\\s+[A-ZÀ-ÖØ-Þ].{8,},|\\[\\s*\\d{1,4}\\s*\\]\\s+\\S.*\\b(?:19|20)\\d{2}\\b)'))) >= 2"
PARAGRAPHS_SQL = f"""WITH x AS (SELECT o_orderkey, regexp_replace({D.picked(REFERENCES, "o_orderkey", True)}, '(?m)^([ \\t]*)\\d{{1,4}}\\s*[:：]\\s*(\\[\\s*\\d{{1,4}}\\s*\\])', '\\1\\2', 'g') AS t FROM orders)
    SELECT o_orderkey, CASE WHEN {formulas._LISTED} OR {_ENTRY} THEN {_apart("t")} ELSE t END AS markdown FROM x"""


def safe_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole pages behind links of all kinds."""
    p = tables.read(spark, sf_dir, "pages")
    kinds = ["<a href=\"{}\">", "<a HREF = '{}' onclick=x>", "<img src={}>", "<img alt=x src=\"{}\">"]
    urls = ["https://a.b/c?d", "javascript:alert(1)", " #top ", "data:image/png;base64,AA", "MAILTO:x@y", "data:text/html;base64,AA", "//a.b/c"]
    pick = lambda values, c: F.element_at(F.array(*[F.lit(v) for v in values]), (c % len(values) + 1).cast("int"))
    planted = F.replace(pick(kinds, F.col("page_id")), F.lit("{}"), pick(urls, F.floor(F.col("page_id") / len(kinds))))
    rows = p.select("page_id", planted.alias("planted"), F.coalesce("html", F.lit("")).alias("html"))
    return rows.select("page_id", K.safe_links(F.col("planted")).alias("link"), F.md5(K.safe_links(F.col("html"))).alias("page"))


def _links(t: str) -> str:
    pattern = "'" + K.LINK.replace("'", "''") + "'"
    url = f"regexp_replace(concat(regexp_extract(m, {pattern}, 2), regexp_extract(m, {pattern}, 3), regexp_extract(m, {pattern}, 4)), '^\\s+|\\s+$', '', 'g')"
    name, quote = f"lower(regexp_extract(m, {pattern}, 1))", "CASE WHEN regexp_matches(m, '=\\s*''[^'']*''$') THEN '''' ELSE '\"' END"
    safe = f"regexp_matches({url}, CASE WHEN {name} = 'href' THEN '{K.SAFE['href']}' ELSE '{K.SAFE['src']}' END)"
    shown = f"list_transform(regexp_extract_all({t}, {pattern}), lambda m: CASE WHEN {safe} THEN ' ' || {name} || '=' || {quote} || {url} || {quote} ELSE '' END)"
    return f"array_to_string(list_transform(list_zip(regexp_split_to_array({t}, {pattern}), list_append({shown}, '')), lambda z: z[1] || z[2]), '')"


LINKS_SQL = f"""WITH x AS (SELECT page_id, coalesce(html, '') AS html, replace(['<a href="{{}}">', '<a HREF = ''{{}}'' onclick=x>', '<img src={{}}>', '<img alt=x src="{{}}">'][page_id % 4 + 1], '{{}}',
    ['https://a.b/c?d', 'javascript:alert(1)', ' #top ', 'data:image/png;base64,AA', 'MAILTO:x@y', 'data:text/html;base64,AA', '//a.b/c'][page_id // 4 % 7 + 1]) AS planted FROM pages)
    SELECT page_id, {_links("planted")} AS link, md5({_links("html")}) AS page FROM x"""

QUERIES = {
    "reference_paragraphs": (reference_paragraphs, PARAGRAPHS_SQL),
    "safe_links": (safe_links, LINKS_SQL),
}
