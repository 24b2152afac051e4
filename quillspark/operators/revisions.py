"""Line differences, skills by their names and keywords, and what readers are told of a quality check."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

from quillspark.functions import text as T

#: Lines that a difference looks ahead; changed lines after which a task hands on what it has.
AHEAD, HELD_LINES = 8, 4096
# Points of a term that is a name, begins one, stands in one, in the title, in the prompt; of long and short keywords, and the least.
NAME_IS, NAME_BEGINS, NAME_HAS, TITLE_HAS, PROMPT_HAS = 12, 7, 5, 3, 1
LONG_KEYWORD, LONG_POINTS, SHORT_POINTS, LEAST_POINTS = 4, 2, 1, 2
#: What a finding is called; the first ones are followed by what is missing.
FINDINGS = {
    "equation-number-loss": "疑似缺少方程编号",
    "citation-anchor-loss": "疑似缺少引用标记",
    "numeric-anchor-loss": "疑似缺少关键数值",
    "term-anchor-loss": "疑似缺少数据集、缩写或专名",
    "algorithm-structure-damaged": "算法的分行、行号或缩进可能不完整",
    "figure-structure-missing": "图形定位标记或图注可能缺失",
    "table-structure-missing": "表格定位标记或表注可能缺失",
    "math-delimiter-damaged": "LaTeX 公式定界符可能不完整",
    "math-brace-damaged": "LaTeX 公式花括号可能不平衡",
    "english-residual": "正文译文中可能仍有成段英文（参考文献不参与检查）",
    "source-coverage-low": "译文可能存在漏段",
    "source-coverage-abnormal": "译文长度异常，可能重复或错序",
    "duplicate-blocks": "译文可能出现重复段落",
    "model-refusal": "模型可能拒绝了本页翻译",
    "model-self-talk": "模型可能输出了推理过程",
}
OTHER_FINDING, SHOWN = "本地检查发现这页可能存在漏译或结构偏差", 5


def line_changes(before: str | None, after: str | None) -> list[tuple[str, str]]:
    """(same, add or del, line): lines that are not equal are sought a few lines ahead in the other text; the nearer one wins."""
    old, new = ((t or "").replace("\r\n", "\n").split("\n") for t in (before, after))
    out: list[tuple[str, str]] = []

    def distance(lines: list[str], begin: int, line: str) -> int | None:
        return next((k for k, x in enumerate(lines[begin : begin + AHEAD]) if x == line), None)

    i, j = 0, 0
    while i < len(old) or j < len(new):
        down = distance(new, j, old[i]) if i < len(old) else None
        up = distance(old, i, new[j]) if j < len(new) else None
        if down == 0:
            out.append(("same", old[i]))
            i, j = i + 1, j + 1
        elif down is not None and (up is None or down <= up) or i == len(old):
            stop = j + (down or 1)
            out += [("add", x) for x in new[j:stop]]
            j = stop
        else:
            stop = i + (up or 1)
            out += [("del", x) for x in old[i:stop]]
            i = stop
    return out


def line_diffs(pairs: DataFrame) -> DataFrame:
    """pairs (..., before, after) with changes: array<struct<kind, line>>. The changes of a few pairs are held at a time."""
    kinds = pa.struct([("kind", pa.string()), ("line", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            begin = 0
            while begin < rows.num_rows:
                end, changes, lines = begin, [], 0
                while end < rows.num_rows and lines < HELD_LINES:
                    found = line_changes(rows.column("before")[end].as_py(), rows.column("after")[end].as_py())
                    changes.append([{"kind": k, "line": x} for k, x in found])
                    end, lines = end + 1, lines + len(found)
                yield rows.slice(begin, end - begin).append_column("changes", pa.array(changes, pa.list_(kinds)))
                begin = end

    changed = StructType([StructField("kind", StringType()), StructField("line", StringType())])
    schema = StructType([*pairs.schema.fields, StructField("changes", ArrayType(changed))])
    return pairs.mapInArrow(run, schema)


def skills_found(skills: DataFrame, query: str) -> DataFrame:
    """skills (ord, id, label, short, title, prompt) with score, those that some term of the query speaks for; all without terms."""
    terms = query.strip().lower().split()
    low = {c: F.lower(F.coalesce(c, F.lit(""))) for c in ("id", "label", "short", "title", "prompt")}
    names = [low["id"], low["label"], low["short"]]
    points = lambda held, n: F.when(held, n).otherwise(0)
    any_of = lambda held: F.greatest(*held)
    score = F.lit(0)
    for t in terms:
        score = score + points(any_of([n == t for n in names]), NAME_IS) + points(any_of([n.startswith(t) for n in names]), NAME_BEGINS) + points(low["label"].contains(t) | low["short"].contains(t), NAME_HAS)
        score = score + points(low["title"].contains(t), TITLE_HAS) + points(low["prompt"].contains(t), PROMPT_HAS)
    out = skills.withColumn("score", score)
    return out.filter("score > 0") if terms else out


def skill_for(question: Column, skills: list[tuple[str, list[str]]]) -> Column:
    """The skill with most points by its keywords in the question, the first of equal ones; null under the least points."""
    asked = F.lower(T.trimmed(F.coalesce(question, F.lit(""))))
    rated = []
    for i, (name, keywords) in enumerate(skills):
        points = F.lit(0)
        for k in keywords:
            points = points + F.when(F.contains(asked, F.lit(k.lower())), LONG_POINTS if len(k) >= LONG_KEYWORD else SHORT_POINTS).otherwise(0)
        rated.append(F.struct(points.alias("points"), F.lit(-i).alias("place"), F.lit(name).alias("name")))
    best = F.array_max(F.array(*rated))
    return F.when(best["points"] >= LEAST_POINTS, best["name"])


def finding(reason: Column, missing: Column) -> Column:
    """What a quality check's first reason is called, with the first of the missing anchors (an array) where it is about those."""
    label = F.coalesce(*[F.when(reason == k, F.lit(v)) for k, v in FINDINGS.items()], F.lit(OTHER_FINDING))
    items = F.array_distinct(F.filter(F.transform(missing, T.trimmed), lambda x: x != ""))
    shown = F.concat(F.array_join(F.slice(items, 1, SHOWN), "、"), F.when(F.size(items) > SHOWN, F.concat(F.lit(" 等 "), F.size(items).cast("string"), F.lit(" 项"))).otherwise(""))
    about = reason.isin(list(FINDINGS)[:4]) & (F.size(items) > 0)
    return F.when(about, F.concat(label, F.lit("："), shown)).otherwise(label)
