"""Formulas and numbered steps in Markdown, over the documents with formulas among their words and over parts put together."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.operators import math_spans as M
from quillspark.plans import dialect as D
from quillspark.sources import tables

#: What becomes of every seventeenth word, by its place; the rest stay. The first part holds a formula in another, the last two are no formulas.
PLANTED = {2: (r"\[", r" $$z$$\]"), 4: ("$$", "$$"), 7: ("$", "$"), 9: (r"\(", r"\)"), 11: (r"\(\[", r"\]\)"), 13: ("$$$", "\n"), 15: ("@@MATHX1@@", "")}


def formula_texts(docs: DataFrame) -> DataFrame:
    """doc_id, markdown; some texts end in a formula that isn't closed."""

    def planted(w, j):
        out = w
        for at, (before, after) in PLANTED.items():
            out = F.when(j % 17 == at, F.concat(F.lit(before), w, F.lit(after))).otherwise(out)
        return out

    words = F.transform(F.split(F.coalesce("text", F.lit("")), " "), planted)
    return docs.select("doc_id", F.concat(F.array_join(words, " "), F.when(F.col("doc_id") % 4 == 0, r" \[ \( $$ never closed").otherwise("")).alias("markdown"))


def formula_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Formulas taken out and put back: what is left without them, and that nothing changes."""
    texts = formula_texts(tables.read(spark, sf_dir, "documents"))
    rows = texts.select("doc_id", F.explode(F.array(M.protected(F.col("markdown"), M.PAIRED))).alias("p"))
    plain = F.regexp_replace("p.masked", F.concat("p.mark", F.lit(r"\d+@@")), F.lit("@"))
    back = M.restored(F.col("p.masked"), F.col("p.mark"), F.col("p.formulas"))
    return rows.select("doc_id", F.size("p.formulas").alias("formulas"), F.md5(plain).alias("plain"), F.md5(back).alias("restored"))


def formula_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = formula_texts(tables.read(spark, sf_dir, "documents"))
    found = M.spans(texts, ["doc_id"], "markdown")
    return found.groupBy("doc_id", "kind").agg(F.count("*").alias("formulas"), F.sum(F.col("stop") - F.col("start")).alias("chars"), F.min("start").alias("first"), F.md5(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "formula"))), lambda x: x["formula"]), "|")).alias("content"))


_CASES = " ".join(f"WHEN {at} THEN {D.re2(before)} || x || {'chr(10)' if after == chr(10) else D.re2(after)}" for at, (before, after) in PLANTED.items())
#: Each kind gives way to a letter of its own; the last kind needs its neighbours, so it is looked for in pieces between them.
_MASKED = f"""
    texts AS (SELECT doc_id, array_to_string(list_transform(string_split(coalesce(text, ''), ' '), lambda x, j: CASE (j - 1) % 17 {_CASES} ELSE x END), ' ') || CASE WHEN doc_id % 4 = 0 THEN ' \\[ \\( $$ never closed' ELSE '' END AS t FROM documents),
    m1 AS (SELECT doc_id, t, regexp_replace(t, '\\$\\$[\\s\\S]+?\\$\\$', chr(1), 'g') AS a FROM texts),
    m2 AS (SELECT *, regexp_replace(a, '\\\\\\[[\\s\\S]+?\\\\\\]', chr(2), 'g') AS b FROM m1),
    m3 AS (SELECT *, regexp_replace(b, '\\\\\\([\\s\\S]+?\\\\\\)', chr(3), 'g') AS c FROM m2),
    m4 AS (SELECT *, regexp_replace(replace(c, '$$', chr(5)), '\\$[^\\n$' || chr(5) || ']+?\\$', chr(4), 'g') AS d FROM m3),
    m5 AS MATERIALIZED (SELECT *, replace(d, chr(5), '$$') AS e FROM m4)"""
_COUNT = "(length({0}) - length(replace({0}, chr({1}), '')))"

ROUND_TRIP_SQL = f"""WITH {_MASKED}
    SELECT doc_id, ({_COUNT.format("a", 1)} + {_COUNT.format("b", 2)} + {_COUNT.format("c", 3)} + {_COUNT.format("e", 4)})::INTEGER AS formulas, md5(regexp_replace(e, '[\\x01-\\x04]', '@', 'g')) AS plain, md5(t) AS restored FROM m5"""

# ---- equation numbers and steps ------------------------------------------------------------------------------------------

FORMULA_PARTS = [["$$", r"\[", "$"], ["x_1 + y", "a \\tag{9}", "b  ", "E = m\nc"], ["$$", r"\]", "$$"], ["\n", " ", "\r\n  ", ""], ["(3)", "（ 12 ）", "(12345)", "(4) more", "(5)\nrest"]]


def equation_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = tables.read(spark, sf_dir, "orders")
    return o.select("o_orderkey", M.merged_equation_numbers(D.picked(FORMULA_PARTS, "o_orderkey", False)).alias("markdown"))


def _folded(t: str, opened: str, closed: str, between: str) -> str:
    """One formula in a text: its parts by a pattern for the whole text, as there is no looking ahead."""
    pattern = D.re2(rf"^([\s\S]*?)({opened})([\s\S]+?)({closed}){between}({M.EQUATION_NUMBER})(\s*(?:\r?\n[\s\S]*)?)$")
    part = [f"regexp_extract({t}, {pattern}, {g})" for g in range(7)]
    body, number = f"regexp_replace({part[3]}, '\\s+$', '')", f"regexp_replace({part[5]}, '[（()）\\s]', '', 'g')"
    tagged = f"{part[2]} || {part[3]} || {part[4]} || chr(10) || {part[5]}"
    fresh = f"{part[2]} || {body} || CASE WHEN {body} <> '' THEN chr(10) ELSE '' END || '\\tag{{' || {number} || '}}' || chr(10) || {part[4]}"
    return f"CASE WHEN regexp_matches({t}, {pattern}) THEN {part[1]} || CASE WHEN regexp_matches({part[3]}, {D.re2(M.TAGGED)}) THEN {tagged} ELSE {fresh} END || {part[6]} ELSE {t} END"


_STEPS = [(between, opened, closed) for between in M.BETWEEN for opened, closed in M.DISPLAY]
TAGS_SQL = "WITH t0 AS (SELECT o_orderkey, " + D.picked(FORMULA_PARTS, "o_orderkey", True) + " AS t FROM orders)" + "".join(f",\n    t{i + 1} AS (SELECT o_orderkey, {_folded('t', opened, closed, between)} AS t FROM t{i})" for i, (between, opened, closed) in enumerate(_STEPS)) + f"\n    SELECT o_orderkey, t AS markdown FROM t{len(_STEPS)}"

STEP_PARTS = [
    ["1: Begin 2: ", "3：init ", r"\frac{a}{b} ", "[1] Wang, ", "a_{0:i-1} ", "in 2023. It "], ["x 3: for ", r"\alpha_{1} ", "5. go ", "695: [16] Ü ", "see "], ["4: end", r"\sum \cdot", "[2] Li, A long title of a work, 2013, pp. 4", "0.05 and 1:n-1", "nothing of the kind"], ["", "\nReferences\n", " return", " 7: a, 8: b"],
]


def step_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = tables.read(spark, sf_dir, "orders")
    text = D.picked(STEP_PARTS, "o_orderkey", False)
    return o.select("o_orderkey", M.latex_heavy(text).alias("heavy"), M.reference_list(text).alias("listed"), M.compact_algorithm(text).alias("compact"))


_HEAVY = f"""length(t) >= {M.LATEX_CHARS} AND ({D.times("t", M.COMMAND)} >= {M.LATEX_COUNTS["commands"]} OR {D.times("t", M.MATH_COMMAND)} >= {M.LATEX_COUNTS["math"]} OR ({D.times("t", M.SUBSCRIPT)} >= {M.LATEX_COUNTS["subscripts"][0]} AND {D.times("t", M.COMMAND)} >= {M.LATEX_COUNTS["subscripts"][1]})
        OR ({D.times("t", M.RANGE)} >= {M.LATEX_COUNTS["ranges"][0]} AND {D.times("t", M.COMMAND)} >= {M.LATEX_COUNTS["ranges"][1]} AND NOT regexp_matches(t, {D.re2(M.PSEUDOCODE)})))"""
#: Of these parts only numbered entries can make a list; a line that is an entry begins with its number.
_LISTED = f"""(regexp_matches(t, {D.re2(M.REFERENCE_HEADING)}) AND {D.times("t", M.ENTRY_MARK)} >= 1) OR {D.times("t", M.FALSE_STEP)} >= 2 OR {D.times("t", M.ENTRY_AUTHOR)} >= 2"""
#: Ranges lose their number first, as there is no looking ahead.
_RANGES = "regexp_replace(t, '\\d{1,3}\\s*[:：]([a-zA-Z](?:-\\d+)?(?:[_\\s,}.\\\\)\\]]|$))', '\\1', 'g')"
_STEP_COUNT = f"len(regexp_extract_all({_RANGES}, '(?:^|\\D)\\d{{1,3}}\\s*(?:[:：]\\s*|[.．]\\s+)'))"
CHECKS_SQL = f"""WITH x AS (SELECT o_orderkey, {D.picked(STEP_PARTS, "o_orderkey", True)} AS t FROM orders), y AS (SELECT *, {_HEAVY} AS heavy, {_LISTED} AS listed, {_STEP_COUNT} AS steps FROM x)
    SELECT o_orderkey, heavy, listed, length(t) >= {M.ALGORITHM_CHARS} AND NOT listed AND NOT heavy AND steps >= {M.STEPS} AND (regexp_matches(t, {D.re2(M.PSEUDOCODE)}) OR steps >= {M.STEPS_ALONE}) AS compact FROM y"""

QUERIES = {
    "formula_round_trip": (formula_round_trip, ROUND_TRIP_SQL),
    "formula_places": (formula_places, None),
    "equation_tags": (equation_tags, TAGS_SQL),
    "step_checks": (step_checks, CHECKS_SQL),
}
