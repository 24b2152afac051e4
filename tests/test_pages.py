"""Page trees and reading plans on small pages whose results are written out."""

import json

import pytest

from quillspark.operators import page_ir as P
from quillspark.operators import reading_plan as R
from pyspark.sql import functions as F


def normal(spark, *pages):
    rows = [(i, p if isinstance(p, str) or p is None else json.dumps(p)) for i, p in enumerate(pages)]
    return P.normalized(spark.createDataFrame(rows, "page long, ir string"))


def page(*blocks, **more):
    return {"index": 0, "blocks": list(blocks), **more}


def nodes(df):
    return {r["page"]: [n.asDict() for n in r["nodes"]] if r["nodes"] is not None else None for r in df.collect()}


def test_faults_are_a_column(spark):
    many = {"kind": "table", "rows": [["x"] * 200] * 150}
    pages = [
        None, "[1]", "{", {"index": 1.5, "blocks": []}, {"index": 0}, page(), page(*[{"kind": "heading"}] * 4097), page({"id": "a"}, {"kind": "paragraph", "id": "b", "segments": [{"id": "a"}]}),
        page({"kind": "table", "rows": [[1]] * 2049}), page({"kind": "table", "rows": [["x"] * 257]}), page(many), page({"kind": "table", "rows": [["x"] * 200] * 60}, {"kind": "table", "rows": [["x"] * 200] * 60}), page({"text": "x" * (5 * 1024 * 1024 + 1)}),
        page({"kind": "paragraph", "segments": [{"text": "x"}] * 4097}), page({"kind": "table", "columns": 1, "rows": [["x", {"id": "y"}]]}, {"id": "y"}),
    ]
    got = [r["fault"] for r in normal(spark, *pages).orderBy("page").collect()]
    assert got == ["not_object", "not_object", "not_object", "bad_index", "bad_blocks", None, "blocks", "duplicate_id a", "table_rows", "table_columns", "table_cells", "page_table_cells", "text_characters", "segments", "duplicate_id y"]
    assert P.normalized(spark.createDataFrame([], "page long, ir string")).count() == 0


def test_messy_blocks_become_nodes(spark):
    got = nodes(normal(spark, page(
        None, 7, {"kind": "mystery", "text": "kept", "bbox": [1, 2, "x", 4]}, {"kind": "paragraph", "text": "alone", "segments": [3, None]}, {"kind": "paragraph", "segments": [{"kind": "inline_math", "text": "y"}, {"text": 5}, {"text": "t", "id": ""}]},
        {"kind": "figure", "caption": {"text": "Caption"}}, {"kind": "table", "columns": 1, "header_rows": 9, "caption": 4, "rows": [[1.5, None, {"text": "h", "role": "header", "kind": "formula"}], "junk", ["a"]]}, {"kind": "heading", "text": 9, "translatable": False, "role": " Author "},
    )))[0]
    assert [(n["level"], n["id"], n["kind"], n["text"], n["latex"]) for n in got] == [
        ("block", "p0-b0", "plain_text", "kept", None), ("block", "p0-b1", "paragraph", "alone", None), ("segment", "p0-b1-s0", "text", "alone", None), ("block", "p0-b2", "paragraph", "", None), ("segment", "p0-b2-m0", "inline_math", None, "y"), ("segment", "p0-b2-s1", "text", "", None),
        ("segment", "p0-b2-s2", "text", "t", None), ("block", "p0-b3", "figure", None, None), ("caption", "p0-b3-caption", "caption", "Caption", None), ("block", "p0-b4", "table", None, None), ("cell", "p0-b4-r0-c0", None, "1.5", None), ("cell", "p0-b4-r0-c1", None, "", None), ("cell", "p0-b4-r0-c2", "formula", "h", None),
        ("cell", "p0-b4-r1-c0", None, "a", None), ("cell", "p0-b4-r1-c1", None, "", None), ("cell", "p0-b4-r1-c2", None, "", None), ("block", "p0-b5", "heading", "", None),
    ]
    table = next(n for n in got if n["kind"] == "table")
    assert (table["columns"], table["rows"], table["header_rows"]) == (3, 2, 2)
    assert got[0]["box"] == [0.0] * 4 and got[-1]["frozen"] and got[-1]["role"] == "Author"


def test_items_and_hidden_tables(spark):
    table = {"kind": "table", "confidence": 0.5, "caption": {"text": "Results"}, "rows": [["Method", "3 ± 1", "x_i", {"text": "E", "kind": "formula"}, "SOTA", "a = b", "mean of x = 3"]]}
    pages = normal(spark, page({"kind": "heading", "text": "Title"}, {"kind": "paragraph", "segments": [{"text": "We see "}, {"kind": "inline_math", "latex": "x"}, {"text": "  "}]}, {"kind": "display_math", "latex": "x"}, table))
    assert [r["text"] for r in P.items(pages).orderBy("place").collect()] == ["Title", "We see ", "Results", "Method", "SOTA", "mean of x = 3"]
    assert [r["text"] for r in P.visible_items(pages).orderBy("place").collect()] == ["Title", "We see ", "Results"]
    model = P.table_models(pages).collect()[0]
    assert model["source_only"] and [c["numeric"] for c in model["body"]] == [False, True, False, False, False, False, False]


def units(df):
    return [(r["id"], r["text"], r["tokens"], [(s["slot"], s["id"], s["text"]) for s in r["slots"]]) for r in R.units(df.select("page", "nodes"), ["page"]).orderBy("page", "place").collect()]


def test_units_of_prose_citations_and_authors(spark):
    got = units(normal(spark, page(
        {"kind": "paragraph", "text": "[7]."}, {"kind": "heading", "text": "Adam Smith1, Eve Jones2"}, {"kind": "heading", "text": "Method"}, {"kind": "plain_text", "text": "12"}, {"kind": "paragraph", "segments": [{"text": "Let "}, {"kind": "inline_math", "id": "m 1", "latex": "x"}, {"text": " be."}]},
        {"kind": "paragraph", "text": " [1, 2] "}, {"kind": "plain_text", "text": "[3]"}, {"kind": "figure", "caption": {"text": "A figure"}}, {"kind": "plain_text", "text": "[4] Wang, A long title of a paper, 2013, pp. 4"}, {"kind": "paragraph", "text": "by the role", "content_role": "AUTHOR"},
    )))
    token = "[[PLM:m%201]]"
    assert got == [
        ("p0-b2", "Method", [], [(0, "p0-b2", "Method")]), ("p0-b4", f"Let {token} be. [1, 2] [3]", [token], [(0, "p0-b4-s0", "Let "), (1, "p0-b4-s2", " be."), (1, "p0-b5-s0", " [1, 2] "), (1, "p0-b6", "[3]")]),
        ("p0-b7-caption", "A figure", [], [(0, "p0-b7-caption", "A figure")]),
    ]


def grouped(segments):
    """The state machine as a loop."""
    import re

    means = lambda s: s[0] == "text" and re.search(r"[A-Za-z]", s[1])
    if sum(s[0] != "text" for s in segments) <= 3:
        return [0] * len(segments)
    out, unit, held = [], 0, 0
    for s in segments:
        clause = means(s) and held >= 3 and re.match(r"\s*(?:[.!?]\s+[A-Za-z]|[;:]\s+|(?:where|then|because)\b)", s[1])
        if out and (clause or (held >= 7 and (s[0] != "text" or means(s)))):
            unit, held = unit + 1, 0
        held += s[0] != "text"
        out.append(unit)
    return out


@pytest.mark.parametrize("seed", range(4))
def test_formulas_cut_paragraphs_like_the_loop(spark, seed):
    import random

    rng = random.Random(seed)
    segments = [rng.choice([("inline_math", "x"), ("inline_math", "y"), ("text", " where "), ("text", ", "), ("text", ". Then"), ("text", "; "), ("text", " a word ")]) for _ in range(120)]
    rows = spark.createDataFrame([(segments,)], "segments array<struct<kind:string,text:string>>")
    assert rows.select(R.clause_groups(F.col("segments"))).first()[0] == grouped(segments)
    blocks = [{"kind": kind, ("latex" if kind == "inline_math" else "text"): text} for kind, text in segments]
    for _, _, tokens, slots in units(normal(spark, page({"kind": "paragraph", "segments": blocks}))):
        assert len(tokens) <= 7 and slots


def test_lines_of_algorithms(spark):
    lines = [{"text": "Input ", "algorithm_line": 2}, {"text": "for all"}, {"kind": "inline_math", "latex": "x", "algorithm_line": 2}, {"text": "return", "algorithm_line": 1}]
    got = units(normal(spark, page({"kind": "paragraph", "layout": "algorithm", "segments": lines})))
    assert [(i, t) for i, t, *_ in got] == [("p0-b0-line2", "Input [[PLM:p0-b0-m2]]"), ("p0-b0-line0", "for all"), ("p0-b0-line1", "return")]


def test_changes_keep_tokens_and_empty_the_rest_of_a_slot(spark):
    pages = normal(spark, page({"kind": "paragraph", "segments": [{"text": "a "}, {"text": "b "}, {"kind": "inline_math", "id": "m", "latex": "x"}, {"text": " c"}]}))
    rows = R.units(pages.select("page", "nodes"), ["page"]).crossJoin(spark.createDataFrame([(1, "甲 [[PLM:m]] 乙"), (2, "甲 ［［PLM：m］］ 乙"), (3, "甲 乙"), (4, "[[PLM:m]][[PLM:m]]"), (5, None)], "case int, given string"))
    got = {}
    for r in R.changes(rows, F.col("given"), ["case"]).collect():
        got.setdefault(r["case"], {})[r["id"]] = r["text"]
    want = {"p0-b0-s0": "甲 ", "p0-b0-s1": "", "p0-b0-s3": " 乙"}
    assert got == {1: want, 2: want}
