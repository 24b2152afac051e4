import datetime as dt

from pyspark.sql import functions as F

from quillspark.functions import keys, text, times
from quillspark.operators import activity, chats, documents, gate, layout, ranking, retrieval, stores
from quillspark.sources import readers, sinks
from quillspark.streaming import streams


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def test_search_tokens(spark):
    got = one(spark, text.search_tokens(F.lit("The studies of ResNet-50 running 3.5 本文提出方法论")).alias("a"), text.search_tokens(F.lit("图像分割"), query=True).alias("b"))
    assert got["a"][:6] == ["studies", "study", "resnet-50", "running", "runn", "3.5"]
    assert "出方" in got["a"] and "本文" not in got["a"]
    assert got["b"] == ["图像分割", "图像", "像分", "分割", "图像分", "像分割"]


def test_estimates_and_labels(spark):
    got = one(spark, text.estimated_tokens(F.lit("中文abcd")).alias("a"), text.estimated_tokens(F.lit("𝜽a")).alias("b"), text.token_label(F.lit(1234567)).alias("c"), text.estimated_tokens(F.lit(None).cast("string")).alias("d"))
    assert (got["a"], got["b"], got["c"], got["d"]) == (3, 1, "123.5万", 0)


def test_hashes(spark):
    got = one(spark, keys.fnv1a32(F.lit("hello")).alias("a"), keys.hash31(F.lit("hello")).alias("b"), keys.hash31(F.lit("polygenelubricants")).alias("c"), keys.hash_key(F.lit("")).alias("d"))
    assert (got["a"], got["b"], got["c"], got["d"]) == (0x4F9F2CAB, 99162322, -2147483648, "ztntfp")


def test_deadline(spark):
    now = int(dt.datetime(2024, 1, 2, 12, 0, 0, tzinfo=dt.timezone.utc).timestamp() * 1000)
    got = one(spark, times.deadline_countdown(F.lit("2024-01-01"), F.lit(now)).alias("a"), times.deadline_countdown(F.lit("2024-01-05"), F.lit(now)).alias("b"), times.deadline_countdown(F.lit("soon"), F.lit(now)).alias("c"))
    assert (got["a"]["passed"], got["a"]["days"], got["a"]["urgency"]) == (True, 1, "passed")
    assert (got["b"]["days"], got["b"]["urgency"]) == (3, "critical") and got["c"] is None


def test_chunks():
    long = "One sentence here. " * 200
    got = retrieval.chunks_of(f"# Head\n\nshort\n\n{long}")
    assert got[0] == ("# Head\n\nshort", "Head")
    assert all(len(c) <= 1201 for c, _ in got) and got[1][0].endswith(".")
    assert retrieval.chunks_of("") == []


def test_audit_and_support(spark):
    df = spark.createDataFrame([("见第 3 页和第 9 页，第 40 页", 20, [3])], "answer string, total_pages int, allowed array<int>")
    got = retrieval.citation_audit(df).first()
    assert (got["cited"], got["invalid"], got["unsupported"], got["supported"], got["coverage"], got["ok"]) == ([3, 9, 40], [40], [9], [3], 0.333, False)


def test_activity(spark):
    day = dt.date(2024, 1, 24)
    rows = [(day, "read-minutes", 30.0), (day, "page-translated", 2.6), (day, "nonsense", 5.0), (day - dt.timedelta(8), "tokens", 10.0), (day, "tokens", -4.0)]
    days = activity.by_day(spark.createDataFrame(rows, "day date, kind string, amount double"))
    got = activity.summary(days, day).first()
    assert (got["read_minutes"], got["pages_translated"], got["tokens"], got["active_days"]) == (30, 3, 0, 1)
    cells = activity.heatmap(days, day).collect()
    assert len(cells) == 84 and sum(c["level"] is None for c in cells) == 4 and max(c["level"] or 0 for c in cells) == 4


def test_calibration_of_equal_scores(spark):
    df = spark.createDataFrame([(i, 16) for i in range(3)], "ord int, score int")
    assert [r["score"] for r in ranking.calibrated(df).orderBy("ord").collect()] == [40, 39, 38]
    assert ranking.calibrated(df.limit(1)).first()["score"] == 16


def test_snippets():
    assert ranking.snippets("aaa needle bbb needle", "needle x", radius=4) == ["aaa needle bbb", "bbb needle"]
    assert ranking.snippets(None, "needle") == []


def test_store_rules(spark):
    rows = [(1, "A", "x"), (2, "b", "y"), (3, "a", "z")]
    df = spark.createDataFrame(rows, "ord int, term string, translation string")
    in_place = stores.merged(df, stores.STORES["glossary_in_place"]).orderBy("place").collect()
    moved = stores.merged(df, stores.STORES["glossary"]).orderBy("place").collect()
    assert [(r["term"], r["translation"]) for r in in_place] == [("a", "z"), ("b", "y")]
    assert [(r["term"], r["translation"]) for r in moved] == [("b", "y"), ("a", "z")]
    tags = one(spark, stores.clean_tags(F.array(F.lit(" A"), F.lit("a"), F.lit(""), F.lit("B"))).alias("t"))
    assert tags["t"] == ["A", "B"]


def test_titles_and_windows(spark):
    lines = ["arXiv:1234", "A Long Enough Title of a Paper", "Ann B, Carl D, Eve F", "Abstract", "More text that is longer than the title here"]
    got = spark.createDataFrame([("\n".join(lines),), (None,)], "t string").select(documents.title_line(documents.text_lines(F.col("t"))).alias("title")).collect()
    assert [r["title"] for r in got] == ["A Long Enough Title of a Paper", ""]
    assert documents.best_window(["none", "resnet on imagenet", "gets 76.5", "none"], ["resnet", "imagenet", "76.5"]) == (1, 2, 5)
    assert documents.best_window(["a"], ["zz"]) is None


def test_gate(spark):
    rows = [(1, "", "x"), (2, "抱歉，我无法", ""), (3, "a $x$ 好", ""), (4, "b $x 好", ""), (5, "same line here twice\n" * 3, ""), (6, "ab" * 200 + "cdefghijklmnopqrstuv" * 6, "")]
    got = {r["id"]: r["reasons"] for r in gate.verdicts(spark.createDataFrame(rows, "id int, output string, source string")).collect()}
    assert got[1] == ["empty"] and got[2] == ["model-refusal"] and got[3] == [] and got[4] == ["math-delimiter-damaged"]
    assert "duplicate-blocks" in got[5] and "repetition-loop" in got[6]
    assert gate.longest_shared_run("a b c d".split(), "x b c y".split()) == 2


def test_batches_and_boxes(spark):
    assert layout.batch_numbers([500, 300, 10, 10, 10, 10, 10, 10, 5000, 1]) == [0, 0, 1, 1, 1, 1, 1, 2, 3, 4]
    got = one(spark, layout.rotated_box(F.array(F.lit(0.25), F.lit(0.5), F.lit(0.5), F.lit(1.0)), 90).alias("b"))
    assert got["b"] == [0.0, 0.25, 0.5, 0.5]


def test_two_columns():
    glyphs = [{"str": f"w{r}{c}", "x": 50 + 30 * c + (60 if c >= 3 else 0), "end": 74 + 30 * c + (60 if c >= 3 else 0), "y": 50 + 12 * r, "size": 10} for r in range(10) for c in range(6)]
    got = layout.blocks_of(glyphs)
    assert len(got) == 2 and got[0]["text"].startswith("w00 w01 w02 w10") and got[1]["text"].startswith("w03 w04 w05 w13")


def test_guard_and_decoders():
    state, fired = streams.guard((0, 0, 0), [(0, "bump"), (80_000, "output"), (200_000, "bump")])
    assert fired == [125_000] and state[2] == 1
    assert streams.guard((0, 0, 0), [(0, "hold"), (440_000, "bump"), (450_000, "done"), (10**9, "bump")])[1] == []
    tail, got = streams.sse("", 'data: {"choices":[{"delta":{"content":"a"}}]}\n\ndata: [DO')
    assert streams.deltas(got) == "a" and tail == "data: [DO"
    seen = set()
    tail, first = streams.records("", '{"id":"1","text":"x"}\n{"id":"2","te', seen)
    assert first == [("1", "x")] and streams.records(tail, 'xt":"y"}\n{"id":"1","text":"z"}', seen, last=True)[1] == [("2", "y")]
    assert streams.heartbeats([0, 5_000, 15_000, 16_000, 31_000]) == [0, 15_000, 31_000]


def test_readers(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "n.md").write_text("hello")
    (tmp_path / "a" / "n.txt").write_text("no")
    assert [(r["name"], r["text"], r["truncated"]) for r in readers.markdown_folder(spark, str(tmp_path)).collect()] == [("n", "hello", False)]
    assert readers.response_entries('```json\n{"id":"a","text":"x"}\nbad\n{"id":"b","text":"y"},\n```') == [("a", "x"), ("b", "y")]
    got = one(spark, readers.agent_calls(F.lit('CALL get_page {"page": 3}\nFINAL: done')).alias("a"), readers.data_url(F.lit("data:image/png;base64,AAA")).alias("b"), readers.citation_route(F.lit("see 10.1000/xyz1")).alias("c"))
    assert got["a"]["calls"][0]["name"] == "get_page" and got["a"]["answer"] == "done" and got["b"]["mime"] == "image/png" and got["c"]["kind"] == "doi"


def test_packs_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("T", "zh", 3, {1: "one", 2: " ", 9: "x"}, [("a", "b")], bytearray(b"%PDF-1"))], "title string, target string, total_pages int, pages map<int,string>, glossary array<struct<term:string,translation:string>>, pdf binary")
    path = tmp_path / "p.json"
    path.write_text(sinks.pack_json(df, "pack-1").first()["value"])
    got = readers.packs(spark, str(path), "pack-1").first()
    assert got["pages"] == {"1": "one"} and got["title"] == "T" and bytes(got["pdf"]) == b"%PDF-1"


def test_chat_rules(spark):
    turns = spark.createDataFrame([(1, i, "user" if i % 2 else "assistant", f"t{i}", None, i in (1, 3, 5)) for i in range(8)], "conv int, turn int, role string, content string, page_num int, had_image boolean")
    kept = {r["turn"]: r["keeps_image"] for r in chats.request_window(turns, 8, 2).collect()}
    assert kept[5] and kept[3] and not kept[1]
    assert chats.compacted(turns, 4, 2).filter("role = 'digest'").count() == 1
