"""Pseudocode in Markdown, over steps made of whole documents and over parts put together."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.operators import algorithms as A
from quillspark.plans import dialect as D
from quillspark.plans import formulas
from quillspark.sources import tables

#: Words that steps begin with, by document and place; words of a document in each step.
BEGINNINGS, WORDS = ["Begin", "If", "While", "For all", "Else", "Else If", "End If", "End", "x", "Endless", "如果x", "Function f", "结束 y", "END WHILE"], 6


def step_texts(docs: DataFrame, *others: str) -> DataFrame:
    """doc_id, other columns, steps: each document's words, some of them to a numbered line that begins with a word of control or another."""
    rows = docs.select("doc_id", *others, F.split(F.coalesce("text", F.lit("")), " ").alias("w"))
    line = lambda i: F.concat((i % 999 + 1).cast("string"), F.lit(": "), F.element_at(F.array(*map(F.lit, BEGINNINGS)), ((F.col("doc_id") + i * 5 + F.floor(i / 3)) % len(BEGINNINGS) + 1).cast("int")), F.lit(" "), F.array_join(F.slice(F.col("w"), i * WORDS + 1, F.lit(WORDS)), " "))
    return rows.select("doc_id", *others, F.array_join(F.transform(F.sequence(F.lit(0), F.floor((F.size("w") - 1) / WORDS).cast("int")), line), "\n").alias("steps"))


def algorithm_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    steps = step_texts(tables.read(spark, sf_dir, "documents"))
    rows = steps.select("doc_id", F.explode(F.array(A.lines_with_depth(F.col("steps")))).alias("l"))
    return rows.select("doc_id", F.size("l").alias("lines"), F.array_max(F.transform("l", lambda x: x["depth"])).alias("deepest"), F.md5(A.shown(F.col("l"))).alias("content"))


def _re(pattern: str) -> str:
    """A pattern that looks ahead for a word only, as SQL."""
    return D.re2(pattern.replace("(?=[A-Za-z0-9_])", r"\b"))


def _indented(lines: str, key: str, table: str) -> str:
    """CTEs from a list of lines in a table to d (key, ls: num, body, back, on; ds: depth by line)."""
    return rf"""
    l1 AS (SELECT {key}, list_transform({lines}, lambda x: {{'num': regexp_extract(x, {D.re2(A.LABEL)}, 1), 'body': regexp_replace(regexp_replace(x, {D.re2(A.LABEL)}, ''), '^\s+|\s+$', '', 'g')}}) AS ls FROM {table}),
    l2 AS (SELECT {key}, list_transform(ls, lambda x: {{'num': x.num, 'body': x.body, 'back': (regexp_matches(x.body, {_re(A.ELSE)}) OR regexp_matches(x.body, {_re(A.CLOSES)}))::INT, 'on': (regexp_matches(x.body, {_re(A.ELSE)}) OR (regexp_matches(x.body, {_re(A.OPENS)}) AND NOT regexp_matches(x.body, {_re(A.CLOSES)})))::INT}}) AS ls FROM l1),
    l3 AS (SELECT {key}, ls, list_reduce(list_prepend([0, 0], list_transform(ls, lambda x: [x.back, x.on])), lambda a, x: list_append(list_append(a[1:-2], greatest(0, a[-1] - x[1])), least({A.DEPTH}, greatest(0, a[-1] - x[1]) + x[2]))) AS ds FROM l2),
    d AS MATERIALIZED (SELECT {key}, ls, list_transform(ls, lambda x, i: CASE WHEN x.num = '' AND x.body = '' THEN '' ELSE regexp_replace(CASE WHEN x.num <> '' THEN x.num || ': ' ELSE '' END || repeat(' ', {A.INDENT} * ds[i + 1]) || x.body, '\s+$', '') END) AS shown, ds FROM l3)"""


_BEGINNINGS = "[" + ", ".join(f"'{b}'" for b in BEGINNINGS) + "]"
DEPTH_SQL = f"""WITH w AS (SELECT doc_id, string_split(coalesce(text, ''), ' ') AS w FROM documents),
    s AS (SELECT doc_id, string_split(array_to_string(list_transform(range(0, (len(w) - 1) // {WORDS} + 1), lambda i: (i % 999 + 1)::VARCHAR || ': ' || ({_BEGINNINGS})[(doc_id + i * 5 + i // 3) % {len(BEGINNINGS)} + 1] || ' ' || array_to_string(w[i * {WORDS} + 1 : i * {WORDS} + {WORDS}], ' ')), chr(10)), chr(10)) AS ls FROM w),{_indented("ls", "doc_id", "s")}
    SELECT doc_id, len(ls)::INTEGER AS lines, list_max(ds[2:len(ls) + 1])::INTEGER AS deepest, md5(array_to_string(shown, chr(10))) AS content FROM d"""

PARTS = [["Algorithm 1 Sort all ", "算法 2  **Names** ", "", "What is said here is longer than any title of an algorithm may be, by some words more ", "## Steps "], ["1: **Begin** 2: x_{0:i-1} ", "1. Begin\n2：  `a`\n3: __b__  c\n", "7：If a ", "in 2023. "], ["3: While  a<b ", "3: for all m do\n", "0.05 ", "[1] Wang, "], ["4: Else 5: c", "4: End While\n\n5: Return", "nothing", "[2] Li, B., 2013\n8. z"]]


def algorithm_recovery(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = tables.read(spark, sf_dir, "orders").select("o_orderkey", D.picked(PARTS, "o_orderkey", False).alias("text"))
    rows = o.select("o_orderkey", F.explode_outer(F.array(A.recovered(F.col("text")))).alias("r"))
    return rows.select("o_orderkey", "r.title", F.array_join("r.lines", "\n").alias("steps"))


def _plain(t: str) -> str:
    """Marks by patterns that do not look around: these parts have pairs of marks only."""
    for pattern, by in A.MARKS:
        if "(?<=" in pattern:
            pattern, by = pattern.replace(r"(?<=\S)", r"(\S)"), "$1" + by
        if "(?!" not in pattern and "(?=" not in pattern:
            t = f"regexp_replace({t}, '{pattern}', '{by.replace('$', chr(92))}', 'g')".replace("'\n'", "chr(10)")
    return f"regexp_replace({t}, '^\\s+|\\s+$', '', 'g')"


#: A range in an index is not a step: its colon gives way to a letter, as there is no looking ahead.
_HELD = "regexp_replace({0}, '(\\d{{1,3}}\\s*)[:：]([a-zA-Z](?:-\\d+)?(?:[_\\s,}}.\\\\)\\]]|$))', '\\1' || chr(1) || '\\2', 'g')"
_STEP = r"(\d{1,3})\s*(?:[:：]\s*|[.．]\s+)"
_MATCHES = f"len(regexp_extract_all({{0}}, '(?:^|\\D){_STEP}'))".replace("{1,3}", "{{1,3}}")
_TRIM = "regexp_replace({0}, '^\\s+|\\s+$', '', 'g')"
RECOVERY_SQL = rf"""WITH t0 AS (SELECT o_orderkey, {D.picked(PARTS, "o_orderkey", True)} AS t FROM orders), x AS (SELECT o_orderkey, {_plain("t")} AS t FROM t0),
    x2 AS (SELECT *, {formulas._HEAVY} AS heavy, {formulas._LISTED} AS listed, {formulas._STEP_COUNT} AS n, {_HELD.format("t")} AS h FROM x),
    x3 AS (SELECT *, length(t) >= 24 AND NOT listed AND NOT heavy AND n >= 3 AND (regexp_matches(t, {D.re2(A.M.PSEUDOCODE)}) OR n >= 4) AS compact, regexp_extract(h, '(?s)^(|.*?\D)({_STEP}.*)$', 1) AS pre, regexp_extract(h, '(?s)^(|.*?\D)({_STEP}.*)$', 2) AS post FROM x2),
    x4 AS (SELECT *, pre <> '' AND (regexp_matches(pre, {D.re2(A.TITLE)}) OR length({_TRIM.format("pre")}) BETWEEN 1 AND {A.TITLE_CHARS}) AS titled FROM x3),
    x5 AS (SELECT o_orderkey, compact, CASE WHEN titled THEN {_TRIM.format("regexp_replace(regexp_replace(" + _TRIM.format("pre") + ", '^#{1,3}\\s*', ''), '^\\*+|\\*+$', '', 'g')")} ELSE '' END AS title, CASE WHEN titled THEN {_TRIM.format("post")} ELSE h END AS body FROM x4),
    x6 AS (SELECT *, list_filter(string_split(body, chr(10)), lambda v: {_TRIM.format("v")} <> '') AS lines, {_TRIM.format("regexp_replace(regexp_replace(body, '[ \\t]*\\n[ \\t]*', ' ', 'g'), '[ \\t]+', ' ', 'g')")} AS flat FROM x5),
    x7 AS (SELECT *, CASE WHEN len(list_filter(lines, lambda v: regexp_matches(v, '^\s*{_STEP}'))) >= {A.STEP_LINES} THEN list_transform(lines, lambda v: regexp_replace(v, '^\s*{_STEP}', '\1: '))
        WHEN {_MATCHES.format("flat")} >= 2 THEN list_transform(string_split(regexp_replace(flat, '(^|\D){_STEP}', '\1' || chr(10) || '\2: ', 'g'), chr(10))[2:], lambda v: {_TRIM.format("v")}) ELSE string_split(body, chr(10)) END AS rows FROM x6),{_indented("rows", "o_orderkey", "x7")}
    SELECT o_orderkey, CASE WHEN ok THEN title END AS title, CASE WHEN ok THEN replace(array_to_string(kept, chr(10)), chr(1), ':') END AS steps
    FROM (SELECT o_orderkey, title, kept, compact AND len(kept) >= {A.STEP_LINES} AS ok FROM (SELECT o_orderkey, x7.title, x7.compact, list_filter(d.shown, lambda v: {_TRIM.format("v")} <> '') AS kept FROM d JOIN x7 USING (o_orderkey)))"""

SPOKEN = [["Begin ", "end  while ", "For each ", "\\(If\\) ", "Algorithm "], ["input : a ", "$Else$ ", "Forward ", "else\tif b "], ["Return x; ", "ENSURE: y ", "if_a "], ["then do", "$$\nEnd $$", "End"]]


def algorithm_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of control and of a title in Chinese."""
    o = tables.read(spark, sf_dir, "orders").select("o_orderkey", D.picked(SPOKEN, "o_orderkey", False).alias("text"), F.concat(F.lit("algorithm "), F.col("o_orderkey") % 20, F.lit(" Mutation of "), F.col("o_orderpriority"), F.lit(" selection")).alias("title"))
    return A.with_words(o, "text").select("o_orderkey", "text", A.title_words(F.col("title")).alias("title"))


def _spoken(t: str, table: dict[str, str]) -> str:
    for word, by in table.items():
        t = f"regexp_replace({t}, '(?i)\\b{word}\\b', '{by}', 'g')"
    return t


_PIECE = lambda i, key: f"list_element([{', '.join(chr(39) + o + chr(39) for o in SPOKEN[i])}], ({key} % {len(SPOKEN[i])} + 1)::BIGINT)"
WORDS_SQL = f"""WITH p AS (SELECT o_orderkey, o_orderpriority, [{_PIECE(0, "o_orderkey")}, {_PIECE(1, "(o_orderkey // 5)")}, {_PIECE(2, "(o_orderkey // 20)")}, {_PIECE(3, "(o_orderkey // 60)")}] AS ps FROM orders)
    SELECT o_orderkey, array_to_string(list_transform(ps, lambda t: CASE WHEN t LIKE '\\(%' OR t LIKE '$%' THEN t ELSE regexp_replace({_spoken("t", A.KEYWORDS)}, '(输入|输出)\\s*:', '\\1：', 'g') END), '') AS text,
        {_spoken("'算法 ' || (o_orderkey % 20)::VARCHAR || ' Mutation of ' || o_orderpriority || ' selection'", A.TITLE_WORDS)} AS title FROM p"""


def algorithm_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Steps in one line each third document, below a title each other third, in front of the text as it is."""
    docs = tables.read(spark, sf_dir, "documents").select("doc_id", "text")
    rows = step_texts(docs, "text").select("doc_id", F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("Algorithm 1 All\n"), "steps")).when(F.col("doc_id") % 3 == 1, F.replace("steps", F.lit("\n"), F.lit(" "))).otherwise("").alias("steps"), F.coalesce("text", F.lit("")).alias("text"))
    return A.formatted(rows.select("doc_id", F.concat("steps", F.lit("\n\n"), "text").alias("markdown")), "markdown").select("doc_id", "markdown")


QUERIES = {
    "algorithm_depth": (algorithm_depth, DEPTH_SQL),
    "algorithm_recovery": (algorithm_recovery, RECOVERY_SQL),
    "algorithm_words": (algorithm_words, WORDS_SQL),
    "algorithm_markdown": (algorithm_markdown, None),
}
