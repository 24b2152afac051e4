import json

from pyspark.sql import functions as F

from quillspark.operators import math_spans as M
from quillspark.operators import page_ir as P
from quillspark.operators import reading_plan as R
from quillspark.plans import algorithms

FOLDER = "/root/testdata/sf0.001"


def analyzed(df) -> str:
    return df._jdf.queryExecution().analyzed().toString()


def test_steps_are_counted_before_references_are_looked_for(spark):
    """algorithm_markdown tests each line, and most have no steps; a list of references is the costly test."""
    plan = analyzed(spark.createDataFrame([("a",)], "t string").select(M.compact_algorithm(F.col("t"))))
    assert plan.index(M.STEP[:20]) < plan.index(M.REFERENCE_HEADING[:20])


def test_markdown_reads_its_documents_once(spark):
    """steps are made beside the text, not joined to it; a document without an id keeps its text."""
    assert "Join" not in analyzed(algorithms.algorithm_markdown(spark, FOLDER))


def test_signs_of_references_stay(spark):
    rows = {
        "[1] Wang, A., A long title of a work, 2013\n[2] Li, B., Another title of a work, 2014": True, "1: [1] a\n2: [2] b": True, "参考文献\n[3] x": True, "plain words": False, "": False,
        "arXiv preprint arXiv: 1, 2, arXiv preprint arXiv: 3, 4, 5": True, "2013: A long title of a work, with doi: and words\n2014: Another title of a work, with IEEE and words": True, "1: Begin 2: a 3: End": False,
    }
    df = spark.createDataFrame([(k,) for k in rows], "t string")
    assert {r.t: r.r for r in df.select("t", M.reference_list(F.col("t")).alias("r")).collect()} == rows


def executed(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_units_are_made_in_the_row_of_their_page(spark):
    """nodes and units of a page are not dealt out and gathered again, nor sorted."""
    pages = P.normalized(spark.range(1).selectExpr("id AS page", "'{}' AS ir"), limits=P.UNLIMITED)
    plan = executed(R.units(pages.select("page", "nodes"), ["page"]))
    assert not any(step in plan for step in ("Exchange", "Window", "Aggregate", "Sort"))


def test_units_read_only_what_they_are_made_of(spark):
    """fields that no unit has are not made of the page, unless limits count them."""
    pages = spark.range(1).selectExpr("id AS page", "'{}' AS ir")
    made = lambda **how: P.normalized(pages, fields=R.FIELDS, **how).schema["nodes"].dataType.elementType.names
    assert sorted(made(limits=P.UNLIMITED)) == sorted(R.FIELDS) and made() == list(P.NODE)


def test_citations_before_the_first_unit_go_and_later_ones_join(spark):
    blocks = [{"kind": "plain_text", "text": t} for t in ("[1]", "Some words here", "[2]", "[3, 4].", "12", "More words of it")]
    pages = P.normalized(spark.createDataFrame([(1, json.dumps({"index": 0, "blocks": blocks})), (2, json.dumps({"index": 0, "blocks": []})), (3, None)], "page int, ir string"))
    got = R.units(pages.select("page", "nodes"), ["page"]).orderBy("place").collect()
    assert [(r.page, r.place, r.id, r.text, [s.id for s in r.slots]) for r in got] == [(1, 0, "p0-b1", "Some words here [2] [3, 4].", ["p0-b1", "p0-b2", "p0-b3"]), (1, 1, "p0-b5", "More words of it", ["p0-b5"])]
