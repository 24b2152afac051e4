"""Second rounds by slots, what rounds give together, and formulas read from answers."""

from pyspark.sql import functions as F

from quillspark.operators import retry as A

UNIT = "doc long, place long, id string, text string, tokens array<string>, slots array<struct<slot:int,id:string,text:string>>"
UNITS = [
    (1, 0, "u0", " Let [[PLM:m]] be  one. ", ["[[PLM:m]]"], [(0, "s0", " Let "), (1, "s1", " be"), (1, "s2", "  one. ")]),
    (1, 1, "u1", "no formula", [], [(0, "u1", "no formula")]),
    (1, 2, "u2", "[[PLM:a]]=[[PLM:b]] then", ["[[PLM:a]]", "[[PLM:b]]"], [(1, "s3", "="), (2, "u1", " then")]),
    (1, 3, "u3", "[[PLM:c]] 7", ["[[PLM:c]]"], [(1, "s9", " 7")]),
    (2, 0, "u0", "same [[PLM:d]]", ["[[PLM:d]]"], [(0, "s0", "same ")]),
]


def units(spark):
    return spark.createDataFrame(UNITS, UNIT)


def test_requests_by_slot(spark):
    got = sorted(tuple(r) for r in A.requests(units(spark), ["doc"]).select("doc", "place", F.coalesce("slot", F.lit(-1)), "id", "text").collect())
    assert got == [(1, 0, 0, "s0", " Let "), (1, 0, 1, "s1", " be  one. "), (1, 1, -1, "u1", "no formula"), (1, 2, 2, "u2-text-slot-2", " then"), (1, 3, -1, "u3", "[[PLM:c]] 7"), (2, 0, 0, "s0", "same ")]


def states(spark, answers):
    asked = A.requests(units(spark), ["doc"])
    rows = A.resolved(units(spark), asked, spark.createDataFrame(answers, "doc long, id string, text string"), ["doc"])
    return {(r["doc"], r["place"]): (r["state"], r["text"], r["missing"]) for r in rows.collect()}


def test_answers_are_put_around_tokens(spark):
    got = states(spark, [(1, "s0", "Sei"), (1, "s1", " eins.  "), (1, "u1", "ohne"), (1, "u2-text-slot-2", "dann"), (1, "u3", "[[PLM:c]] sieben"), (1, "nobody", "x"), (2, "s0", "gleich [[PLM:x]]")])
    assert got == {
        (1, 0): ("ok", " Sei [[PLM:m]] eins. ", []), (1, 1): ("ok", "ohne", []), (1, 2): ("ok", "[[PLM:a]]=[[PLM:b]] dann", []), (1, 3): ("ok", "[[PLM:c]] sieben", []),
        (2, 0): ("rebuilt_formula_unit_unacceptable", None, []),
    }
    got = states(spark, [(1, "s0", "Sei"), (2, "s0", "same")])
    assert got[1, 0] == ("formula_text_slot_unresolved", None, ["s1"]) and got[1, 1] == ("missing_node", None, ["u1"]) and got[2, 0][0] == "rebuilt_formula_unit_unacceptable"


def test_first_good_attempt_counts(spark):
    rows = [(1, 1, None, "missing_node"), (1, 2, "b", "ok"), (1, 3, "c", "ok"), (2, 1, None, "missing_node"), (2, 2, None, "formula_text_slot_unresolved")]
    got = {r["id"]: (r["attempt"], r["text"], r["state"]) for r in A.merged(spark.createDataFrame(rows, "id long, attempt int, text string, state string"), ["id"]).collect()}
    assert got == {1: (2, "b", "ok"), 2: (2, None, "formula_text_slot_unresolved")}


def balanced(formula):
    depth = 0
    for i, c in enumerate(formula):
        if c in "{}" and formula[i - 1 : i] != "\\":
            depth += 1 if c == "{" else -1
        if depth < 0:
            return False
    return depth == 0


def test_balance_of_random_formulas(spark):
    import random

    rng = random.Random(2)
    texts = ["".join(rng.choices("{}\\a", k=rng.randint(0, 12))) for _ in range(400)]
    got = {r["t"]: r["b"] for r in spark.createDataFrame([(t,) for t in texts], "t string").select("t", A.balanced(F.col("t")).alias("b")).collect()}
    assert got == {t: balanced(t) for t in texts}


def test_formula_answers(spark):
    expected = spark.createDataFrame([(1, "a", ""), (1, "b", "∇ f"), (1, "c", ""), (2, "a", ""), (3, "a", None)], "r long, id string, source string")
    value = '```json\n[{"id":" a ","latex":"$$ x_1 $$","number":" (3) "},{"id":"a","latex":"y"},{"id":"b","latex":"f"},{"id":"z","latex":"f"},{"latex":"no id"},7]\n```'
    answers = spark.createDataFrame([(1, value), (2, "no list"), (3, '{"items":[{"id":"a","latex":"words that are not any formula"}]}')], "r long, value string")
    got = {(r["r"], r["id"]): (r["state"], r["latex"], r["number"]) for r in A.formula_answers(expected, answers, ["r"]).collect()}
    assert got == {(1, "a"): ("ok", "x_1", "(3)"), (1, "b"): ("rejected", None, None), (1, "c"): ("missing", None, None), (1, "z"): ("unknown", None, None), (2, "a"): ("missing", None, None), (3, "a"): ("rejected", None, None)}
