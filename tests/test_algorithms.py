"""Pseudocode: depth against a stack, cases of rules, and whole documents that keep their words."""

import random
import re

from pyspark.sql import functions as F

from quillspark.operators import algorithms as A
from quillspark.plans import algorithms as Q
from quillspark.sources import tables

FOLDER = "/root/testdata/sf0.001"


def rows_of(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "id long, t string")


def by_stack(text):
    """Lines with blanks for each open block, by a stack of the words that opened one (eight at most)."""
    out, held = [], []
    for line in text.split("\n"):
        m = re.match(r"^\s*(\d{1,3})\s*[:.：．]\s*(.*)$", line)
        num, body = (m[1], m[2].strip()) if m else ("", line.strip())
        word = re.match(r"[A-Za-z0-9_]*", body)[0].lower()
        ends, other = word in ("end", "endif", "endfor", "endwhile", "endfunction", "endprocedure"), word in ("else", "elseif")
        if (ends or other) and held:
            held.pop()
        out.append(((num + ": " if num else "") + "  " * len(held) + body).rstrip() if num or body else "")
        if (other or word in ("begin", "function", "procedure", "require", "input", "output", "if", "while", "for")) and len(held) < 8:
            held.append(word)
    return "\n".join(out)


def test_depth_equals_a_stack(spark):
    rng = random.Random(5)
    pieces = ["1: Begin", "2. If a", "  3：Else", "END If", "while x", "for all y do", "4: x = 1", "", "  ", "Ending", "5:", "Endif", "12: Procedure p", "elseif b", "Input: z  "]
    texts = ["\n".join(rng.choices(pieces, k=rng.randint(0, 40))) for _ in range(200)]
    got = {r["id"]: r["l"] for r in rows_of(spark, texts).select("id", A.indented(F.col("t")).alias("l")).collect()}
    assert got == {i: by_stack(t) for i, t in enumerate(texts)}


def test_display_lines(spark):
    lines = ["12:    x y", "3:\ty", "  z ", "", None, "1234: a", "7:" + " " * 40 + "deep"]
    got = [tuple(r["d"]) for r in rows_of(spark, lines).orderBy("id").select(A.display_line(F.col("t")).alias("d")).collect()]
    assert got == [("12:", 2, "x y"), ("3:", 1, "y"), ("", 1, "z"), ("", 0, ""), ("", 0, ""), ("", 0, "1234: a"), ("7:", 8, "deep")]


MARKDOWN = {
    "Algorithm 1 Sort 1: Begin 2: // init 3: While x_{0:i-1} do 4: a 5: End While": "Algorithm 1 Sort\n\n```algorithm\n1: Begin\n2:   // init\n3:   While x_{0:i-1} do\n4:     a\n5:   End While\n```",
    "## 算法 2 Name\n1: **Begin**\n2:   init 0.05\n3. For all m do\n4: g←0\n5: End For\n\nAfter words.": "算法 2 Name\n\n```algorithm\n1: Begin\n2:   init 0.05\n3:   For all m do\n4:     g←0\n5:   End For\n```\n\nAfter words.",
    "plain text\n\n\nwith nothing": "plain text\n\n\nwith nothing",
    "intro\n\n```\n1: Begin 2: If x 3: End If\n```\nnext": "intro\n\n```algorithm\n1: Begin\n2:   If x\n3:   End If\n```\nnext",
    "```python\n1: Begin 2: If x 3: End\n```": "```python\n1: Begin 2: If x 3: End\n```",
    "```algorithm\n695: [16] Wang, Y.\n107: [17] Li, B.\n```": "[16] Wang, Y.\n\n[17] Li, B.",
    "We keep $x_{0:i-1}$ here 1: Begin 2: If x = {a,b} 3: do it 4: End": "We keep $x_{0:i-1}$ here\n\n```algorithm\n1: Begin\n2:   If x = {a,b}\n3:     do it\n4:   End\n```",
    "In 2023. 0.05 and 1.5 and 2.5 are numbers, while 3.5 is not": "In 2023. 0.05 and 1.5 and 2.5 are numbers, while 3.5 is not",
    r"0: \frac{a}{b} 1: \frac{c}{d} 2: \alpha 3: while": r"0: \frac{a}{b} 1: \frac{c}{d} 2: \alpha 3: while",
    "words\n1: Begin 2: a 3: b 4: End\nmore words": "words\n```algorithm\n1: Begin\n2:   a\n3:   b\n4: End\n```\nmore words",
    "": "",
}


def test_markdown(spark):
    df = rows_of(spark, [*MARKDOWN, None])
    got = [r["t"] for r in A.formatted(df, "t").orderBy("id").collect()]
    assert got == [*MARKDOWN.values(), ""]


def test_documents_keep_their_words(spark):
    """Steps of whole documents: fences and labels apart, every word stays in its order; texts without steps stay as they are."""
    docs = {r["doc_id"]: r for r in tables.read(spark, FOLDER, "documents").select("doc_id", "text").collect()}
    steps = {r["doc_id"]: r["steps"] for r in Q.step_texts(tables.read(spark, FOLDER, "documents")).collect()}
    words = lambda t: re.findall(r"[^\W\d_]+", re.sub(r"```(?:algorithm)?", " ", t))
    fences = 0
    for r in Q.algorithm_markdown(spark, FOLDER).collect():
        text, before = docs[r["doc_id"]]["text"] or "", steps[r["doc_id"]]
        kind = r["doc_id"] % 3
        want = ("Algorithm 1 All\n" + before if kind == 0 else before if kind == 1 else "") + "\n\n" + text
        assert words(r["markdown"]) == words(want), r["doc_id"]
        fences += "```algorithm\n1:" in r["markdown"]
        if kind == 2:
            assert "```algorithm" in r["markdown"] or r["markdown"] == want
    assert fences > len(docs) / 2


def test_bare_mathematics_gets_delimiters(spark):
    df = rows_of(spark, ["If x_1 = {a, b} then", "设 x^2 ，End For", r"keep \(y_1\) and plain words", "S = (种群)", None])
    got = [r["t"] for r in A.display_bodies(df, "t").orderBy("id").collect()]
    assert got[1:] == [r"设 \(x^2\) ，结束循环", r"keep \(y_1\) and plain words", r"\(S =\) (种群)", ""]
    assert got[0] == r"如果 \(x_1 = \{a, b\}\) 则"
    same = A.display_bodies(df, "t", "English").orderBy("id").first()["t"]
    assert same == r"\(If x_1 = \{a, b\} then\)"


def test_recovery_needs_three_lines_of_steps(spark):
    df = rows_of(spark, ["Algorithm 2 **Fast** 1: Begin 2: `a` 3: End and so on", "nothing of the kind at all", None, "1: a 2: b", r"1: \frac{a}{b} 2: \sum c 3: while d 4: e"])
    got = [r["r"] for r in df.orderBy("id").select(A.recovered(F.col("t")).alias("r")).collect()]
    assert tuple(got[0]) == ("Algorithm 2 Fast", ["1: Begin", "2:   a", "3: End and so on"]) and got[1:] == [None] * 4
