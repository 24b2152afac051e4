"""Formulas in Markdown: places against a scan, hostile texts, and rules on single cases."""

import random
import re
import time

from pyspark.sql import functions as F

from quillspark.operators import math_spans as M
from quillspark.plans import formulas as Q
from quillspark.sources import tables

FOLDER = "/root/testdata/sf0.001"


def outermost(text):
    """Places of the outermost formulas: kinds one after the other over marks that remember what they stand for."""
    held = [(c, i, i + 1, None) for i, c in enumerate(text)]
    kinds = [("dollars", r"\$\$[\s\S]+?\$\$"), ("brackets", r"\\\[[\s\S]+?\\\]"), ("parentheses", r"\\\([\s\S]+?\\\)"), ("dollar", r"(?<!\$)\$(?!\$)[^\n$]+?\$(?!\$)")]
    for kind, pattern in kinds:
        flat, out, at = "".join(c for c, *_ in held), [], 0
        for m in re.finditer(pattern, flat):
            out += held[at : m.start()] + [("\ue000", held[m.start()][1], held[m.end() - 1][2], kind)]
            at = m.end()
        held = out + held[at:]
    return [(a, b, kind, text[a:b]) for c, a, b, kind in held if kind]


def back(df):
    """Each text with what protects it (in a step of its own, which keeps expressions small) and what comes back."""
    p = F.col("p")
    rows = df.select("text", F.explode(F.array(M.protected(F.col("text")))).alias("p"))
    return rows.select("text", "p", M.restored(p["masked"], p["mark"], p["formulas"]).alias("back"))


def texts(rng):
    pieces = ["$", "$$", "\\[", "\\]", "\\(", "\\)", "a", " ", "\n", "x_i", "@@MATH0@@", "@@MATHX", "é𝒙"]
    return ["".join(rng.choices(pieces, k=rng.randint(0, 40))) for _ in range(150)]


def test_places_and_round_trip_of_random_texts(spark):
    rows = [(i, t) for i, t in enumerate([*texts(random.Random(7)), None, ""])]
    df = spark.createDataFrame(rows, "id long, text string")
    got = {}
    for r in M.spans(df, ["id"]).orderBy("id", "place").collect():
        got.setdefault(r["id"], []).append((r["start"], r["stop"], r["kind"], r["formula"]))
    assert got == {i: spans for i, t in rows if (spans := outermost(t or ""))}
    for r in back(df).collect():
        assert r["back"] == (r["text"] or "") and len(r["p"]["kinds"]) == len(r["p"]["formulas"])


def test_places_over_documents(spark):
    found = {(r["doc_id"], r["kind"]): (r["formulas"], r["chars"], r["first"]) for r in Q.formula_places(spark, FOLDER).collect()}
    want = {}
    for r in Q.formula_texts(tables.read(spark, FOLDER, "documents")).collect():
        for a, b, kind, _ in outermost(r["markdown"]):
            n, chars, first = want.get((r["doc_id"], kind), (0, 0, a))
            want[r["doc_id"], kind] = (n + 1, chars + b - a, min(first, a))
    assert found == want


def test_hostile_texts_are_linear(spark):
    hostile = ["\\[" * 60_000, "\\(" * 60_000, "$$" * 60_001, "$a" * 60_000, "\\]" * 60_000, "\\[x\\]\\[" * 3_000]
    df = spark.createDataFrame([(t,) for t in hostile], "text string")
    back(spark.createDataFrame([("$x$",)], "text string")).collect()
    began = time.time()
    rows = back(df).collect()
    assert all(r["text"] == r["back"] for r in rows) and time.time() - began < 60


def test_equation_numbers(spark):
    cases = {
        "$$x$$\n(3)\nrest": "$$x\n\\tag{3}\n$$\nrest", "\\[x \\] （12）": "\\[x\n\\tag{12}\n\\]", "$$x \\tag{1}$$ (2)": "$$x \\tag{1}$$\n(2)", "$$x$$ (12345)": "$$x$$ (12345)", "$$x$$ (3) more": "$$x$$ (3) more", "$x$ (3)": "$x$ (3)",
        "$$a$$\n(1)\n\n$$b$$\n(2)": "$$a\n\\tag{1}\n$$\n\n$$b\n\\tag{2}\n$$", None: "", "": "",
    }
    df = spark.createDataFrame([(k,) for k in cases], "text string")
    assert {r["text"]: r["out"] for r in df.select("text", M.merged_equation_numbers(F.col("text")).alias("out")).collect()} == cases


def test_lists_of_references_without_numbers(spark):
    cases = [
        ("Wu, X., Li, Y.: A study of things. In: Proceedings of something, Springer, 2023. Pages one, two.\n", True), ("2023: Wu X and others, a longer title of the first paper, Journal of A\n2021: Li Y and others, a longer title of the second paper, IEEE\n", True),
        ("We compare with IEEE floats, 2023, and others.", False), ("arXiv preprint arXiv: 1, 2, and arXiv preprint arXiv: 3, 4, 5", True), ("", False), (None, False),
    ]
    df = spark.createDataFrame(cases, "text string, want boolean")
    assert all(r["got"] == r["want"] for r in df.select("want", M.reference_list(F.col("text")).alias("got")).collect())
