import pytest
from pyspark.sql import functions as F

from quillspark.operators import records, retrieval, units
from quillspark.plans import tools


@pytest.fixture(scope="module")
def paper(spark):
    rows = [(1, "# Title\nintro about graphs", "done"), (2, "the graph search method", "done"), (3, "", "pending"), (4, "results of search", "done")]
    pages = spark.createDataFrame(rows, "page int, text string, status string")
    chunks = retrieval.chunk_pages(pages.select(F.lit("d").alias("doc"), "page", "text", F.lit("").alias("heading"), F.lit("source").alias("source_type"), "status"))
    return tools.Registry(tools.paper_tools(pages, chunks, 2))


def test_paper_tools(paper):
    assert paper.call("get_paper_meta").first()["done"] == 3
    assert [r["page"] for r in paper.call("get_page_range", {"start": 2, "end": 99}).collect()] == [2, 3, 4]
    assert paper.call("search_paper", {"query": "graph search"}).first()["page"] == 2
    assert [r["page"] for r in paper.call("retrieve_evidence", {"query": "graph search method"}).collect()][:2] == [2, 1]
    assert [r["title"] for r in paper.call("get_outline").collect()] == ["Title"]
    assert [r["page"] for r in paper.call("search_paper_text", {"query": "SEARCH"}).collect()] == [2, 4]
    with pytest.raises(KeyError):
        paper.call("nothing")
    with pytest.raises(ValueError):
        paper.call("get_page", {})
    assert {"get_page", "search_paper"} <= {s["function"]["name"] for s in paper.schemas()}


def test_turns_and_traces(spark, paper):
    script = iter([([("get_page", {"page": 1}), ("get_page", {"page": 1})], ""), ([("get_page", {"page": 1})], "")])
    answer, trace = tools.turn(lambda results: next(script), paper)
    assert answer == "" and trace == [('get_page:{"page": 1}', True)]
    steps = F.array(F.struct(F.lit(3).alias("page"), F.lit(None).cast("int").alias("from"), F.lit(None).cast("int").alias("to"), F.lit(True).alias("ok"), F.lit(None).cast("array<int>").alias("pages")), F.struct(F.lit(None).cast("int").alias("page"), F.lit(5).alias("from"), F.lit(99).alias("to"), F.lit(True).alias("ok"), F.array(F.lit(1)).alias("pages")))
    assert spark.range(1).select(tools.pages_of_trace(steps)).first()[0] == [1, 3, 5, 6, 7, 8, 9, 10]


def test_workbench_tools(spark):
    notes = spark.createDataFrame([("a", "graph graph", 1), ("graph", "none", 2)], "name string, text string, mtime int")
    reading = spark.createDataFrame([("x", "X", 1)], "id string, title string, ord int")
    facts = spark.createDataFrame([("Old", 1)], "fact string, ord int")
    papers = spark.createDataFrame([("p", 1, "graph nets", "s", ["cs.LG"], 0, "2024", 2)], "id string, ord int, title string, summary string, categories array<string>, published_ms long, published string, n_authors int")
    venues = spark.createDataFrame([("v", "V", "V", "2024-01-01")], "id string, abbr string, name string, deadline string")
    bench = tools.Registry(tools.workbench_tools(notes, papers, reading, venues, facts, 0))
    assert [r["name"] for r in bench.call("search_knowledge_base", {"query": "graph"}).collect()] == ["graph", "a"]
    with pytest.raises(PermissionError):
        bench.call("add_to_reading_list", {"id": "x", "title": "X"})
    assert bench.call("add_to_reading_list", {"id": "x", "title": "X"}, confirmed=True).count() == 1
    assert bench.call("remember_research_fact", {"fact": "OLD"}, confirmed=True).count() == 1
    assert bench.call("fetch_frontier_papers", {"keywords": "graph"}).first()["rank"] == 1
    assert bench.call("list_submission_deadlines").count() == 1


def test_records_and_units(spark):
    df = spark.createDataFrame([(" ", None), ("  a \n b ", 7.6)], "path string, last_page double")
    got = records.normalized(df, "library").collect()
    assert [(r["path"], r["last_page"], r["tags"]) for r in got] == [("a b", 8, [])]
    row = spark.range(1).select(records.interests(F.array(F.lit("cs.LG"), F.lit("bad cat"), F.lit("cs.LG")), F.array(F.lit("A"), F.lit("a"), F.lit(" b "))).alias("i"), units.title_like(F.lit("Deep Residual Learning")).alias("t"), units.equation_number(F.lit(" (12) ")).alias("e")).first()
    assert row["i"]["categories"] == ["cs.LG"] and row["i"]["keywords"] == ["A", "b"] and row["t"] and row["e"] == "12"
