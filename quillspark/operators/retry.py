"""Answers to requests for units: second rounds by slots, what all rounds give, and formulas read from answers.

A unit with formulas that got no usable answer is asked for again in pieces, the texts between its tokens; the answers are put together around the
tokens. Rounds are joins on the key of a unit and reductions by it; nothing is held for a whole document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillspark.functions import text as T
from quillspark.operators import gate as G
from quillspark.operators import reading_plan as R
from quillspark.operators import units as U


def requests(units: DataFrame, keys: list[str]) -> DataFrame:
    """keys, place, slot, id, text: what is asked for each unit (reading_plan.units); slot is null where the unit is asked for as it is.

    Slots without a letter are not asked for; a unit that has no other is asked for as it is. A slot goes by the id of its first node; where that is
    taken, by the unit's id, "-text-slot-" and its number.
    """
    slots = F.transform(
        F.sequence(F.lit(0), F.size("tokens")),
        lambda k: T.bound(F.filter("slots", lambda s: s["slot"] == k), lambda held: F.struct(k.alias("slot"), F.get(held, 0)["id"].alias("id"), F.array_join(F.transform(held, lambda s: s["text"]), "").alias("text"))),
    )
    asked = F.when(F.size("tokens") > 0, F.filter(slots, lambda s: s["text"].rlike(R.MEANING))).otherwise(F.array().cast("array<struct<slot:int,id:string,text:string>>"))
    whole = F.array(F.struct(F.lit(None).cast("int").alias("slot"), F.col("id"), F.col("text")))
    rows = units.select(*keys, "place", F.col("id").alias("_unit"), F.explode_outer(F.array(asked)).alias("_asked"), whole.alias("_whole"))
    rows = rows.select(*keys, "place", "_unit", F.explode(F.when(F.size("_asked") > 0, F.col("_asked")).otherwise(F.col("_whole"))).alias("_r")).select(*keys, "place", "_unit", "_r.*")
    taken = units.select(*keys, "id", F.lit(True).alias("_taken")).distinct()
    rows = rows.join(taken, [*keys, "id"], "left").withColumn("_nth", F.row_number().over(Window.partitionBy(*keys, "id").orderBy(F.col("slot").isNotNull(), "place", "slot")))
    other = F.concat("_unit", F.lit("-text-slot-"), F.col("slot").cast("string"))
    clash = F.col("slot").isNotNull() & (F.coalesce("_taken", F.lit(False)) | (F.col("_nth") > 1))
    return rows.select(*keys, "place", "slot", F.when(clash, other).otherwise(F.col("id")).alias("id"), "text")


def _around(source: Column, answer: Column) -> Column:
    """The answer with the white space around its source."""
    return F.concat(F.regexp_extract(source, r"(?U)^\s*", 0), T.trimmed(answer), F.when(T.trimmed(source) != "", F.regexp_extract(source, r"(?U)(?<!\s)\s*\z", 0)).otherwise(""))


def resolved(units: DataFrame, asked: DataFrame, answers: DataFrame, keys: list[str]) -> DataFrame:
    """keys, place, id, text, state, missing of units by answers (keys, id, text) to requests.

    state: ok, missing_node, formula_text_slot_unresolved (missing: ids without an answer) or rebuilt_formula_unit_unacceptable. Of several
    answers to one request the least text counts.
    """
    given = answers.groupBy(*keys, "id").agg(F.min("text").alias("_answer"))
    rows = asked.join(given, [*keys, "id"], "left")
    found = rows.groupBy(*keys, "place").agg(F.array_sort(F.collect_list(F.struct("slot", "id", F.when(F.col("slot").isNull(), F.col("_answer")).otherwise(_around(F.col("text"), F.col("_answer"))).alias("answer")))).alias("_got"))
    each = units.join(found, [*keys, "place"])
    whole = F.get("_got", 0)["slot"].isNull()
    lost = F.transform(F.filter("_got", lambda g: g["answer"].isNull()), lambda g: g["id"])

    def part(k: Column) -> Column:
        own = F.array_join(F.transform(F.filter("slots", lambda s: s["slot"] == k), lambda s: s["text"]), "")
        return F.coalesce(F.get(F.filter("_got", lambda g: g["slot"] == k), 0)["answer"], own)

    joined = F.array_join(F.transform(F.sequence(F.lit(0), F.size("tokens")), lambda k: F.concat(part(k), F.coalesce(F.get("tokens", k), F.lit("")))), "")
    each = each.select(*keys, "place", "id", "tokens", F.col("text").alias("_source"), whole.alias("_whole"), lost.alias("missing"), F.when(whole, F.get("_got", 0)["answer"]).otherwise(joined).alias("text"))
    fit = (T.trimmed(F.col("text")) != "") & U.tokens_intact(F.col("tokens"), F.col("text")) & (T.one_line(F.col("text")) != T.one_line(F.col("_source")))
    state = F.when(F.size("missing") == 0, F.when(F.col("_whole") | fit, "ok").otherwise("rebuilt_formula_unit_unacceptable")).otherwise(F.when(F.col("_whole"), "missing_node").otherwise("formula_text_slot_unresolved"))
    return each.select(*keys, "place", "id", F.when(state == "ok", F.col("text")).alias("text"), state.alias("state"), "missing")


def merged(attempts: DataFrame, keys: list[str]) -> DataFrame:
    """keys, attempt, text, state of rows (keys, attempt, text, state): the first attempt that is ok, else the last one."""
    ok = F.col("state") == "ok"
    best = F.min_by(F.struct("attempt", "text", "state"), F.struct((~ok).alias("failed"), F.when(ok, F.col("attempt")).otherwise(-F.col("attempt")).alias("order")))
    return attempts.groupBy(*keys).agg(best.alias("_best")).select(*keys, "_best.*")


# ---- formulas in answers ------------------------------------------------------------------------------------------------

# Fences around an answer, delimiters around a formula, what prose has none of and how many words it has; braces.
ANSWER_FENCE, DELIMITED = r"(?i)^```(?:json|latex|tex)?\s*|```\s*$", [r"^\$\$([\s\S]*)\$\$$", r"^\\\[([\s\S]*)\\\]$"]
FORMULA_SIGN, PROSE_WORDS, BRACE = r"\\[A-Za-z]+|[_^{}=+\-*/<>]|[∑∫√≤≥≠≈]", 4, r"(?<!\\)[{}]"


def balanced(formula: Column) -> Column:
    """Whether each brace closes an earlier one; escaped ones don't count."""
    step = lambda state, b: F.when((state < 0) | ((b == "}") & (state == 0)), -1).otherwise(state + F.when(b == "{", 1).otherwise(-1))
    return F.aggregate(F.regexp_extract_all(formula, F.lit(BRACE), 0), F.lit(0), step) == 0


def formula(raw: Column, source: Column) -> Column:
    """A formula as it was transcribed, without its delimiters; null if it is empty, prose, unbalanced or has lost what its source shows."""
    text = T.trimmed(F.coalesce(raw, F.lit("")))
    inside = [F.when(text.rlike(p), T.trimmed(F.regexp_extract(text, p, 1))) for p in DELIMITED]

    def kept(l: Column) -> Column:
        prose = ~l.rlike(FORMULA_SIGN) & (F.size(F.regexp_extract_all(l, F.lit(r"[A-Za-z]{2,}"), 0)) >= PROSE_WORDS)
        return F.when((l != "") & ~prose & balanced(l) & (G.formula_reason(l, F.coalesce(source, F.lit(""))) == ""), l)

    return T.bound(F.coalesce(*inside, text), kept)


def formula_answers(expected: DataFrame, answers: DataFrame, keys: list[str]) -> DataFrame:
    """keys, id, latex, number, state of expected formulas (keys, id, source) by one answer each (keys, value: JSON, a list or its items).

    state: ok, rejected, missing or unknown (an id that was not expected). The first of several items with one id counts. An answer that is no
    such list gives nothing, so that its formulas are missing. One answer a key is assumed.
    """
    value = T.trimmed(F.regexp_replace(T.trimmed(F.coalesce("value", F.lit(""))), ANSWER_FENCE, ""))
    listed = F.from_json(F.when(value.startswith("["), value).otherwise(F.get_json_object(value, "$.items")), "array<string>")
    items = answers.select(*keys, F.posexplode(listed).alias("_at", "_item")).select(*keys, "_at", F.from_json("_item", "id string, latex string, number string").alias("_i"))
    rows = items.select(*keys, "_at", T.trimmed(F.col("_i.id")).alias("id"), "_i.latex", "_i.number").filter("id <> ''")
    first = rows.groupBy(*keys, "id").agg(F.min_by(F.struct("latex", "number"), "_at").alias("_first"))
    both = expected.select(*keys, "id", "source", F.lit(True).alias("_asked")).join(first, [*keys, "id"], "full")
    both = both.select(*keys, "id", "_asked", "_first", F.explode_outer(F.array(formula(F.col("_first.latex"), F.col("source")))).alias("latex"))
    state = F.when(F.col("_asked").isNull(), "unknown").when(F.col("_first").isNull(), "missing").when(F.col("latex").isNull(), "rejected").otherwise("ok")
    ok = state == "ok"
    return both.select(*keys, "id", F.when(ok, F.col("latex")).alias("latex"), F.when(ok, T.trimmed(F.coalesce("_first.number", F.lit("")))).alias("number"), state.alias("state"))
