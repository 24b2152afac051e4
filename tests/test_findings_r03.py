"""Findings of round 3 that ask for work that grows with the input and is done once."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillspark.functions import text as T
from quillspark.operators import documents as O
from quillspark.operators import layout
from quillspark.operators import math_spans as M
from quillspark.operators import retrieval as R
from quillspark.operators import revisions as V
from quillspark.plans import advice, algorithms, quality, search

FOLDER = "/root/testdata/sf0.001"


def _plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_pages_are_ranked_once(spark):
    # before, the winners were computed once for themselves and once for their texts
    assert _plan(search.evidence_pack(spark, FOLDER)).count("GlobalLimit") == 1


def test_only_winners_are_cut_into_chunks_again(spark):
    plan = _plan(search.evidence_search(spark, FOLDER))
    assert "LeftSemi" in plan[plan.index("MapInPandas") :]


def test_search_tokens_keep_order_stems_and_single_digits(spark):
    row = spark.createDataFrame([("A_b a x- 7 3.5 Studies withing\r\n the Classes\t汉字 a-b-1 _z",)], "text string")
    assert row.select(T.search_tokens(F.col("text")).alias("t")).first()["t"] == ["a_b", "7", "3.5", "studies", "study", "withing", "classes", "class", "a-b-1", "汉字", "汉字"]


def test_phrase_is_found_across_blanks(spark):
    chunks = spark.createDataFrame([(1, "Deep \t Blue", ""), (2, "deep and blue", "")], "page int, text string, heading string").withColumn("source_type", F.lit("source"))
    scores = {r["page"]: r["score"] for r in R.scored_chunks(chunks, "deep blue").collect()}
    assert scores[1] - scores[2] > R.PHRASE - 1e-9


def test_units_are_numbered_across_batches_without_their_texts(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        texts = ["word " * 40, "", "x" * 2000, "a-b cd", None, "to be"] * 5
        rows = [(doc, i, " u1" if i == 7 else "" if i == 9 else f"u{i}", t) for doc in (1, 2) for i, t in enumerate(texts)]
        batches = layout.unit_batches(spark.createDataFrame(rows, "doc long, ord long, id string, text string"))
        found = {doc: sorted((r["ord"], r["cost"], r["batch"]) for r in batches.collect() if r["doc"] == doc) for doc in (1, 2)}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    costs = [layout.unit_cost(t or "") for i, t in enumerate(texts) if i not in (7, 9)]
    assert found[1] == found[2] == list(zip([i for i in range(len(texts)) if i not in (7, 9)], costs, layout.batch_numbers(costs)))
    # before, each document was a group of its own in pandas, with its texts
    assert "FlatMapGroupsInPandas" not in _plan(batches)


def test_pages_of_glyphs_run_across_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        rows = [(page, i, f"w{i}", 50.0 + i % 8 * 28, 60.0 + i // 8 * 12, 24.0, 10.0) for page in (1, 2, 3) for i in range(40 * page)]
        found = layout.page_blocks(spark.createDataFrame(rows, "page long, ord int, str string, x double, y double, width double, size double"))
        texts = {r["page"]: r["text"] for r in found.collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert texts == {page: " ".join(f"w{i}" for i in range(40 * page)) for page in (1, 2, 3)}
    assert "FlatMapGroupsInPandas" not in _plan(found)


def test_symbols_and_claims_read_a_text_once(spark):
    text = F.col("text")
    df = spark.createDataFrame([("CNN cnn_a cnn_A \\Alpha, CNN ResNet. We propose x_1 and outperform SOTA GPT here! Relatedwork aMethods",)], "text string")
    row = df.select(T.symbols(text).alias("s"), T.section_cues(text).alias("c"), O.claims(text).alias("k")).first()
    assert [(x["kind"], x["token"]) for x in row["s"]] == [("acronym", "CNN"), ("acronym", "SOTA"), ("acronym", "GPT"), ("symbol", "cnn_a"), ("symbol", "x_1"), ("greek", "\\alpha"), ("term", "ResNet")]
    assert row["c"] == []
    assert [(x["score"], x["confidence"]) for x in row["k"]] == [(5, "high")]
    # before, a pattern stood in the plan once for each use of what it finds
    assert str(T.symbols(text)).count("[A-Z]{2,6}") == 1 and str(O.claims(text)).count("outperform|improve") == 1


def test_words_of_an_abstract_are_dealt_once(spark):
    plan = quality.inverted_abstracts(spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    # before, words were dealt by document and word, then by document
    assert plan.count("Exchange hashpartitioning") == 1


def test_anchors_are_found_once(spark):
    # before, what a kind finds was written out once for its share and once for its list
    assert _plan(advice.anchor_losses(spark, FOLDER)).count("Net|Set") == 2


def test_pieces_of_a_text_do_not_carry_it_along(spark):
    rows = spark.createDataFrame([(1, r"a $x$ b \[ $$z$$ \] c $$$ \(y\) @@MATHX1@@ $$ open"), (2, None), (3, "plain")], "id int, text string")
    found = [(r["id"], r["place"], r["start"], r["stop"], r["kind"], r["formula"]) for r in M.spans(rows, ["id"]).orderBy("id", "place").collect()]
    text = rows.filter("id = 1").first()["text"]
    assert found and all(text[a:b] == formula for _, _, a, b, _, formula in found)
    # before, the row of a piece held the whole text
    assert "posexplode(transform(" in _plan(M.spans(rows, ["id"]))


def test_lines_get_their_depth_once(spark):
    assert _plan(algorithms.algorithm_depth(spark, FOLDER)).count("End(?:") <= 2


def test_changes_are_handed_on_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(V, "HELD_LINES", 3)
    rows = [(i, "\n".join("abcdef"[: i % 7]), "\n".join("acdxf"[: i % 5])) for i in range(40)] + [(40, None, None)]
    out = V.line_diffs(spark.createDataFrame(rows, "id int, before string, after string").coalesce(1))
    assert {r["id"]: [tuple(c) for c in r["changes"]] for r in out.collect()} == {i: V.line_changes(b, a) for i, b, a in rows}
    # before, all changes of a batch of 10,000 pairs were held at once
    assert "MapInArrow" in _plan(out)
