from quillspark.operators import gate, revisions
from quillspark.sources import readers


def test_markdown_folder(spark, tmp_path):
    for name, text in {"b.md": "two", "a.md": "é" * readers.MAX_BYTES, ".hidden/c.md": "no", "sub/d.md": "four", "node_modules/e.md": "no", "f.txt": "no"}.items():
        path = tmp_path / name
        path.parent.mkdir(exist_ok=True)
        # an odd number of bytes before the cut splits a character
        path.write_text("x" + text, encoding="utf-8")
    got = {r["name"]: r for r in readers.markdown_folder(spark, str(tmp_path)).collect()}
    assert sorted(got) == ["a", "b", "d"] and got["b"]["text"] == "xtwo"
    assert got["a"]["truncated"] and got["a"]["text"] == "x" + "é" * ((readers.MAX_BYTES - 1) // 2)
    assert [r["name"] for r in readers.markdown_folder(spark, str(tmp_path), 2).orderBy("name").collect()] == ["a", "b"]


def test_loops():
    import random
    import re

    rng = random.Random(2)
    some = lambda n: "".join(rng.choice("abcdefg ") for _ in range(n))
    for n in (15, 16, 17, 50, 100, 101):
        for times in (4, 5, 6):
            text = some(150) + some(n) * times + some(150)
            assert gate.loops(text) == bool(re.search(r"([\s\S]{16,100})\1{4}", text)), (n, times)
    assert not gate.loops("ab" * 50) and gate.loops("ab" * 100) and not gate.loops(None)


def test_line_changes():
    got = revisions.line_changes("a\nb\nc\nd", "a\nx\nc\nd\ne")
    assert got == [("same", "a"), ("del", "b"), ("add", "x"), ("same", "c"), ("same", "d"), ("add", "e")]
    assert revisions.line_changes(None, None) == [("same", "")]
