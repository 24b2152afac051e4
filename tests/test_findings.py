"""Small cases that an earlier state of the code got wrong."""

import random

import duckdb
import numpy as np
from pyspark.sql import functions as F

from quillspark.operators import gate as G
from quillspark.operators import layout as L
from quillspark.operators import math_spans as M
from quillspark.operators import units as U
from quillspark.plans import flows, pages


def test_a_stream_reads_a_table_of_several_files(spark, tmp_path):
    rows = [(c, t, "user", None if t == 2 else f"{c}.{t}") for c in range(4) for t in range(4)]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(3).write.parquet(str(tmp_path / "conversations.parquet"))
    got = {(r["request"], r["id"]): r["text"] for r in flows.stream_records(spark, str(tmp_path)).collect()}
    assert got == {(c, f"n{t}"): "" if t == 2 else f"{c}.{t}" for c in range(4) for t in (0, 2)}


def test_the_last_of_three_dollars_is_single(spark):
    cases = {"$a$$$ b": 0, "$$x$$ a$$$ b$ c": 2, "a$$$ b$ c": 1, "$$x$$$ b$": 2, "a$$ b$ c": 0, "$a$ and $b$": 2}
    df = spark.createDataFrame([(k,) for k in cases], "text string")
    rows = df.select("text", F.explode(F.array(M.protected(F.col("text"), M.PAIRED))).alias("p")).select("text", F.size("p.formulas").alias("n"), M.restored(F.col("p.masked"), F.col("p.mark"), F.col("p.formulas")).alias("back")).collect()
    assert {r["text"]: r["n"] for r in rows} == cases and all(r["text"] == r["back"] for r in rows)


def test_the_number_of_an_entry_is_no_year(spark):
    cases = {"[1900] Wang, some long title of a work": False, "695: [2013] Wang, some long title of a work": False, "[1900] Wang, some long title of a work, 2013": True, "[12] Wang, some long title 2013": True}
    df = spark.createDataFrame([(k,) for k in cases], "text string")
    assert {r["text"]: r["entry"] for r in df.select("text", U.reference_entry(F.col("text")).alias("entry")).collect()} == cases


def test_a_long_line_does_not_lose_its_page(spark, tmp_path):
    words = " ".join("see x where" if i % 5 == 0 else "ab" for i in range(4500))
    text = f"Head\n{words}\nmore words here"
    spark.createDataFrame([(6, text)], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    folder = str(tmp_path)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet/*.parquet'")
    for name in ("page_nodes", "page_items", "reading_units", "reading_changes"):
        query, sql = pages.QUERIES[name]
        got = query(spark, folder)
        want = con.execute(f"SELECT {', '.join(got.columns)} FROM ({sql})").fetchall()
        assert want and sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)


def test_the_gate_finds_the_anchors_of_a_text_once(spark):
    rows = spark.createDataFrame([("BERT, GPT-2 and ResNet", "BERT")], "source string, output string")
    plan = G.verdicts(rows)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("[A-Z]{2,}-") == 2  # the source's and the output's


def test_periods_by_their_breaks():
    rng = np.random.default_rng(5)
    for _ in range(3000):
        units, period, times = rng.choice(rng.integers(2, 4), rng.integers(1, 60), p=None).astype(np.uint32), int(rng.integers(1, 8)), int(rng.integers(2, 6))
        if rng.random() < 0.5:
            units = np.concatenate([units, np.tile(units[:period], int(rng.integers(1, 7))), units[::-1]])
        need = (times - 1) * period
        same = "".join("1" if a == b else "0" for a, b in zip(units, units[period:]))
        assert G.has_period(units, period, times) == (len(units) >= need + period and "1" * need in same)


def test_nearest_boxes_against_all_pairs(spark):
    rng, rows = random.Random(3), {"p": [], "b": []}
    for k in range(600):
        page, mid = k % 3, [(0.5, 0.02), (0.5, 0.3), (0.95, 0.1)][k % 3]
        x, y = rng.gauss(*mid), rng.gauss(*mid)
        rows["p"].append((page, k, x, y))
        x, y = rng.gauss(*mid), rng.gauss(*mid)
        rows["b"].append((page, k, x, y, x + rng.choice([0.0, 0.03, 0.1, 0.8]), y + rng.choice([0.0, 0.02, 0.06]), k))
    points, boxes = spark.createDataFrame(rows["p"], "page int, point int, x double, y double"), spark.createDataFrame(rows["b"], "page int, id int, x0 double, y0 double, x1 double, y1 double, ord int")
    want = {}
    for page, point, x, y in rows["p"]:
        for own, id, x0, y0, x1, y1, ord in rows["b"]:
            if own == page and 0 <= x <= 1 and 0 <= y <= 1:
                inside = x0 <= x <= x1 and y0 <= y <= y1
                d = max(x0 - x, x - x1, 0) ** 2 + max(y0 - y, y - y1, 0) ** 2
                if inside or d <= L.REACH**2:
                    want[point] = min(want.get(point, (2,)), (not inside, d, (x1 - x0) * (y1 - y0), ord, id))
    found = L.nearest_targets(points, boxes)
    assert len(want) > 300 and {r["point"]: r["id"] for r in found.collect()} == {p: w[-1] for p, w in want.items()}


def test_a_dense_page_leaves_few_boxes_a_cell(spark):
    def pairs(n):
        rng = random.Random(1)
        some = lambda: [(1, k, rng.uniform(0.4, 0.6), rng.uniform(0.4, 0.6)) for k in range(n)]
        points = spark.createDataFrame(some(), "page int, point int, x double, y double")
        boxes = spark.createDataFrame(some(), "page int, id int, x0 double, y0 double").select("*", (F.col("x0") + 0.03).alias("x1"), (F.col("y0") + 0.02).alias("y1"), F.col("id").alias("ord"))
        found = L.nearest_targets(points, boxes)
        found.collect()
        plan, most = [found._jdf.queryExecution().executedPlan()], 0
        while plan:
            node = plan.pop()
            if "Join" in node.nodeName() and node.metrics().contains("numOutputRows"):
                most = max(most, node.metrics().apply("numOutputRows").value())
            name = node.nodeName()
            below = [node.finalPhysicalPlan()] if name == "AdaptiveSparkPlan" else [node.plan()] if name.endswith("QueryStage") else [node.children().apply(i) for i in range(node.children().size())]
            plan += below
        return most

    # copies into cells and their pairs grow with the input, not with its square
    few, many = pairs(2000), pairs(8000)
    assert 0 < many < 6 * few
