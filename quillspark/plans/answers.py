"""Rounds of requests over the units of pages, and formulas read from answers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.operators import reading_plan as R
from quillspark.operators import retry as A
from quillspark.plans import dialect as D
from quillspark.plans import pages
from quillspark.sources import tables

_QUOTED = ("«", "»")


def retry_rounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The units of pages: two thirds are answered at once, the others by slots, some of which stay unanswered or get a token too many."""
    planned = tables.written(pages._planned(spark, sf_dir).select("doc_id", "place", "id", "text", "tokens", "slots"), "units")
    quoted = lambda c: F.concat(F.lit(_QUOTED[0]), c, F.lit(_QUOTED[1]))
    first = planned.select("doc_id", "place", "id", F.lit(1).alias("attempt"), F.when(F.col("place") % 3 != 1, quoted(F.col("text"))).alias("text"))
    first = first.withColumn("state", F.when(F.col("text").isNotNull(), "ok").otherwise("missing_node"))
    open_units = planned.join(first.filter("state <> 'ok'").select("doc_id", "place"), ["doc_id", "place"], "left_semi")
    asked = tables.written(A.requests(open_units, ["doc_id"]), "requests")
    slot = F.coalesce("slot", F.lit(-1))
    given = asked.filter(F.pmod(F.col("place") + slot, F.lit(5)) != 2).select("doc_id", "id", F.when((F.col("place") % 11 == 4) & (slot == 0), "[[PLM:x]]").otherwise(quoted(F.trim("text"))).alias("text"))
    second = A.resolved(open_units, asked, given, ["doc_id"]).select("doc_id", "place", "id", F.lit(2).alias("attempt"), "text", "state")
    return A.merged(first.unionByName(second), ["doc_id", "place", "id"]).select("doc_id", "place", "id", "attempt", "state", F.md5("text").alias("text"))


#: Slots come from the segments between formulas; a slot without a letter keeps its text.
ROUNDS_SQL = f"""WITH RECURSIVE {pages._UNITS},
    u AS MATERIALIZED (SELECT *, (row_number() OVER (PARTITION BY doc_id ORDER BY b, spot) - 1)::BIGINT AS place FROM kept),
    ends AS (SELECT doc_id, unit_id, generate_series AS slot FROM (SELECT doc_id, unit_id, sum(math::INT) AS n FROM named GROUP BY ALL HAVING sum(math::INT) > 0), generate_series(0, n::BIGINT)),
    texts AS (SELECT doc_id, unit_id, sl AS slot, coalesce(string_agg(CASE WHEN math THEN NULL ELSE text END, '' ORDER BY j), '') AS text FROM (SELECT *, slot - min(slot - math::INT) OVER (PARTITION BY doc_id, unit_id) AS sl FROM named) GROUP BY ALL),
    toks AS (SELECT doc_id, unit_id, row_number() OVER (PARTITION BY doc_id, unit_id ORDER BY j) - 1 AS slot, piece FROM named WHERE math),
    parts AS (SELECT u.doc_id, u.place, e.slot, coalesce(t.text, '') AS text, coalesce(k.piece, '') AS token, regexp_matches(coalesce(t.text, ''), {D.re2(R.MEANING)}) AS asked
        FROM u JOIN ends e ON e.doc_id = u.doc_id AND e.unit_id = u.id LEFT JOIN texts t ON t.doc_id = e.doc_id AND t.unit_id = e.unit_id AND t.slot = e.slot LEFT JOIN toks k ON k.doc_id = e.doc_id AND k.unit_id = e.unit_id AND k.slot = e.slot WHERE u.place % 3 = 1),
    said AS (SELECT *, asked AND (place + slot) % 5 = 2 AS lost, asked AND place % 11 = 4 AND slot = 0 AS broken,
        CASE WHEN asked THEN regexp_extract(text, '^\\s*') || '«' || trim(text) || '»' || regexp_extract(text, '\\s*$') ELSE text END || token AS part FROM parts),
    second AS (SELECT doc_id, place, bool_or(lost) AS lost, bool_or(broken) AS broken, string_agg(part, '' ORDER BY slot) AS text FROM said GROUP BY ALL),
    done AS (SELECT u.doc_id, u.place, u.id, CASE WHEN u.place % 3 <> 1 THEN 1 ELSE 2 END AS attempt,
        CASE WHEN u.place % 3 <> 1 THEN 'ok' WHEN s.place IS NOT NULL THEN CASE WHEN lost THEN 'formula_text_slot_unresolved' WHEN broken THEN 'rebuilt_formula_unit_unacceptable' ELSE 'ok' END WHEN (u.place + 4) % 5 = 2 THEN 'missing_node' ELSE 'ok' END AS state,
        CASE WHEN u.place % 3 <> 1 THEN '«' || u.text || '»' WHEN s.place IS NOT NULL THEN s.text ELSE '«' || trim(u.text) || '»' END AS text FROM u LEFT JOIN second s USING (doc_id, place))
    SELECT doc_id, place, id, attempt::INTEGER AS attempt, state, CASE WHEN state = 'ok' THEN md5(text) END AS text FROM done"""

FORMULAS = [["", "$$ ", "\\[", " "], ["\\frac{a}{b}", "x_1", "these are words and nothing else", "{c}", "}d{", "\\{ e", "", "a || b", "f_{1}_2", "\\left( g", "three short words"], ["", " + {h}", " = \\{i\\}"], ["", "$$", "\\]"]]


def formula_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four orders to an answer: some formulas are not answered, some twice, some were not asked for; every ninth answer is no list."""
    o = tables.read(spark, sf_dir, "orders").select("o_orderkey", F.floor(F.col("o_orderkey") / 8).alias("request"), D.picked(FORMULAS, "o_orderkey", False).alias("latex"))
    k = F.col("o_orderkey")
    name = F.concat(F.when(k % 7 == 5, "q").otherwise("f"), (k % 8).cast("string"))
    entry = F.struct(F.concat(F.lit(" "), name).alias("id"), F.col("latex"), F.when(k % 2 == 0, F.concat(F.lit("("), k.cast("string"), F.lit(") "))).alias("number"))
    listed = F.filter(F.flatten(F.array_sort(F.collect_list(F.struct(k.alias("k"), F.when(k % 5 == 0, F.array(entry, entry)).otherwise(F.array(entry)).alias("e"))))["e"]), lambda x: x["id"] != " f3")
    value = F.when(F.col("request") % 9 == 4, "no list").when(F.col("request") % 2 == 0, F.concat(F.lit("```json\n"), F.to_json("x"), F.lit("\n```"))).otherwise(F.concat(F.lit('{"items":'), F.to_json("x"), F.lit("}")))
    answers = o.groupBy("request").agg(listed.alias("x")).select("request", value.alias("value"))
    expected = o.select("request", F.concat(F.lit("f"), (k % 8).cast("string")).alias("id"), F.lit("").alias("source"))
    return A.formula_answers(expected, answers, ["request"])


_T = "regexp_replace({0}, '^\\s+|\\s+$', '', 'g')"
_INNER = f"CASE WHEN regexp_matches(t, '(?s)^\\$\\$.*\\$\\$$') THEN {_T.format('t[3:-3]')} WHEN regexp_matches(t, '(?s)^\\\\\\[.*\\\\\\]$') THEN {_T.format('t[3:-3]')} ELSE t END"
ANSWERS_SQL = f"""WITH o AS (SELECT o_orderkey AS k, o_orderkey // 8 AS request, {D.picked(FORMULAS, "o_orderkey", True)} AS latex FROM orders),
    x AS (SELECT *, CASE WHEN k % 7 = 5 THEN 'q' ELSE 'f' END || (k % 8) AS id, {_T.format("latex")} AS t FROM o),
    y AS (SELECT *, {_INNER} AS l FROM x WHERE request % 9 <> 4 AND (CASE WHEN k % 7 = 5 THEN 'q' ELSE 'f' END || (k % 8)) <> 'f3'),
    z AS (SELECT *, regexp_extract_all(regexp_replace(l, '\\\\[{{}}]', '', 'g'), '[{{}}]') AS br FROM y),
    g AS (SELECT *, l <> '' AND (regexp_matches(l, {D.re2(A.FORMULA_SIGN)}) OR len(regexp_extract_all(l, '[A-Za-z]{{2,}}')) < {A.PROSE_WORDS})
        AND list_reduce(list_prepend(0, list_transform(br, lambda c: CASE WHEN c = '{{' THEN 1 ELSE -1 END)), lambda a, c: CASE WHEN a < 0 OR a + c < 0 THEN -1 ELSE a + c END) = 0
        AND NOT regexp_matches(l, '//|\\|\\|') AND NOT regexp_matches(l, '(?:_\\{{[^{{}}]*\\}}|_[A-Za-z0-9])\\s*(?:_\\{{|_[A-Za-z0-9])') AND NOT regexp_matches(l, '\\\\left\\b') AS good FROM z),
    e AS (SELECT request, 'f' || (k % 8) AS id FROM o),
    s AS (SELECT coalesce(e.request, g.request) AS request, coalesce(e.id, g.id) AS id, l, k, CASE WHEN e.id IS NULL THEN 'unknown' WHEN g.id IS NULL THEN 'missing' WHEN good THEN 'ok' ELSE 'rejected' END AS state FROM e FULL JOIN g ON e.request = g.request AND e.id = g.id)
    SELECT request, id, CASE WHEN state = 'ok' THEN l END AS latex, CASE WHEN state = 'ok' THEN CASE WHEN k % 2 = 0 THEN '(' || k || ')' ELSE '' END END AS number, state FROM s"""

QUERIES = {
    "retry_rounds": (retry_rounds, ROUNDS_SQL),
    "formula_answers": (formula_answers, ANSWERS_SQL),
}
