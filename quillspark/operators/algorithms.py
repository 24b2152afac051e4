"""Numbered pseudocode in Markdown: lines of steps, their depth, titles, fences, and words of control in another language.

A text is split into lines, paragraphs or steps by patterns that read it once; depth is a fold over the lines. Formulas are taken out first
(math_spans), so that a range in an index is never a step. Null texts are empty ones. Word boundaries are those of ASCII words: a word of
control in Chinese opens or closes a block only where an ASCII letter or digit follows it.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.functions import text as T
from quillspark.operators import markup as K
from quillspark.operators import math_spans as M

# A step's mark with what is before it and its number; words that open and close blocks; the greatest depth and blanks for each.
STEP_PARTS = M.STEP.replace(r"(?:^|\D)\d{1,3}", r"(^|\D)(\d{1,3})")
LABEL = r"^\s*(\d{1,3})\s*[:.：．]\s*"
OPENS = r"(?i)^(?:Begin|Function|Procedure|Require|Input|Output|If|While|For)(?![A-Za-z0-9_])|^(?:当|如果|对于)(?=[A-Za-z0-9_])"
CLOSES = r"(?i)^End(?:\s*(?:If|For|While|Function|Procedure))?(?![A-Za-z0-9_])|^结束(?:如果|循环|对于)?(?=[A-Za-z0-9_])"
ELSE = r"(?i)^Else(?:\s*If)?(?![A-Za-z0-9_])|^否则(?=[A-Za-z0-9_])"
DEPTH, INDENT = 8, 2
TITLE, TITLE_CHARS, TITLE_LINE = r"(?i)算法\s*\d|Algorithm\s*\d", 80, r"(?i)^(?:#{1,3}\s*)?\*{0,2}(?:算法|Algorithm)\s*\d"
STEP_LINES, MARKED_STEPS, LOOSE_MARK = 3, 4, r"\d{1,3}\s*[:.：．]\s*\S"
FENCE = r"(?i)```(?:algorithm|pseudocode|pseudo|algo)?[ \t]*\n[\s\S]*?```"

# What emphasis and code marks leave of a text, in this order; then labels and blanks within lines.
MARKS = [
    (r"\r\n?", "\n"), (r"(?m)^\s*\*{1,4}\s*$", ""), (r"\*\*([^*\n]+)\*\*", "$1"), (r"__([^_\n]+)__", "$1"), (r"(^|[^*])\*([^*\n]+)\*(?!\*)", "$1$2"), (r"\*{1,2}(?=[A-Za-z0-9_])", ""), (r"([A-Za-z0-9_])\*{1,2}", "$1"), ("`([^`\n]+)`", "$1"),
    (r"(?m)^([^\S\n]*\d{1,3})([^\S\n]*)[:.：．]", "$1$2:"), (r"(?m)^([^\S\n]*\d{1,3})[^\S\n]+:", "$1 :"), (r"(?m)^([^\S\n]*\d{1,3} ?:)[^\S\n]+", "$1 "), (r"(?<=\S)[ \t]{2,}", " "), (r"(?m)(?<=\S)[ \t]+$", ""),
]

# Words of control, and of titles, with what they become in Chinese; longer ones first.
KEYWORDS = {
    r"End\s+Function": "结束函数", r"End\s+Procedure": "结束过程", r"End\s+While": "结束循环", r"End\s+For": "结束循环", r"End\s+If": "结束条件", r"Else\s+If": "否则如果", r"For\s+all": "对每个", r"For\s+each": "对每个", "Require": "输入", "Ensure": "输出", "Input": "输入",
    "Output": "输出", "Begin": "开始", "While": "当", "For": "对于", "If": "如果", "Else": "否则", "Then": "则", "Do": "执行", "Return": "返回", "End": "结束",
}
TITLE_WORDS = {"Reproduction": "繁殖", "Initialization": "初始化", "Selection": "选择", "Crossover": "交叉", "Mutation": "变异", "Training": "训练", "Inference": "推理", "Update": "更新"}
CHINESE = r"(?i)中文|汉语|简体|繁体|Chinese"


def stripped(text: Column) -> Column:
    """Without emphasis, code marks and doubled blanks; labels end in a colon. Trimmed. Patterns of a mark are skipped where a text doesn't hold it."""

    def replaced(text: Column, pairs: list[tuple[str, str]]) -> Column:
        for pattern, by in pairs:
            text = F.regexp_replace(text, pattern, by)
        return text

    def where_held(mark: str, pairs: list[tuple[str, str]]) -> Callable[[Column], Column]:
        return lambda t: F.when(F.contains(t, F.lit(mark)), replaced(t, pairs)).otherwise(t)

    text = F.coalesce(text, F.lit(""))
    for mark, pairs in itertools.groupby(MARKS, _mark):
        text = T.bound(text, where_held(mark, list(pairs))) if mark else replaced(text, list(pairs))
    return T.trimmed(text)


def _mark(pair: tuple[str, str]) -> str | None:
    """The mark without which a pattern of MARKS finds nothing, if there is one."""
    outside = re.sub(r"\[[^\]]*\]", "", pair[0])
    return next((mark for sign, mark in ((r"\r", "\r"), (r"\*", "*"), ("_", "_"), ("`", "`")) if sign in outside), None)


def one_line_a_step(text: Column) -> Column:
    """Steps that share a line get lines of their own; what is before the first goes. Texts with less than two steps, or with lines already, keep theirs."""

    def by_lines(source: Column) -> Column:
        lines = F.filter(F.transform(F.split(source, "\n"), lambda x: F.regexp_replace(x, r"(?<=\S)[ \t]+$", "")), lambda x: T.trimmed(x) != "")
        numbered = lambda ls: F.size(F.filter(ls, lambda x: x.rlike(r"^\s*" + STEP_PARTS.replace(r"(^|\D)", ""))))
        flat = T.trimmed(F.regexp_replace(F.regexp_replace(source, r"[ \t]*\n[ \t]*", " "), r"[ \t]+", " "))
        labelled = lambda ls: F.array_join(F.transform(ls, lambda x: F.regexp_replace(x, r"^\s*(\d{1,3})(?:\s*[:：]\s*|\s*[.．]\s+)", "$1: ")), "\n")

        def tidy(line: Column) -> Column:
            steps = F.split(F.regexp_replace(line, STEP_PARTS, "$1\n$2: "), "\n")
            own = lambda s: F.array_join(F.transform(F.slice(s, F.lit(2), F.size(s)), lambda x: T.trimmed(F.regexp_replace(x, r"^(\d{1,3}: )\s+|[ \t]{2,}", "$1"))), "\n")
            return F.when(F.regexp_count(line, F.lit(STEP_PARTS)) >= 2, T.bound(steps, own)).otherwise(source)

        return T.bound(lines, lambda ls: F.when(numbered(ls) >= STEP_LINES, labelled(ls)).otherwise(T.bound(flat, tidy)))

    return T.bound(stripped(text), by_lines)


def lines_with_depth(text: Column) -> Column:
    """array of (num, depth, body), one for each line: num is null without a label."""
    lines = F.transform(
        F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: F.struct(F.nullif(F.regexp_extract(x, LABEL, 1), F.lit("")).alias("num"), T.trimmed(F.regexp_replace(x, LABEL, "")).alias("body"))
    )

    def moves(x: Column) -> Column:
        seen = F.struct(x["body"].rlike(ELSE).alias("other"), x["body"].rlike(CLOSES).alias("closes"), x["body"].rlike(OPENS).alias("opens"))
        return T.bound(seen, lambda s: F.struct((s["other"] | s["closes"]).cast("int").alias("back"), (s["other"] | (s["opens"] & ~s["closes"])).cast("int").alias("on")))

    def step(state: Column, m: Column) -> Column:
        at = F.greatest(F.lit(0), state["depth"] - m["back"])
        return F.struct(F.least(F.lit(DEPTH), at + m["on"]).alias("depth"), F.concat(state["seen"], at.cast("string"), F.lit(",")).alias("seen"))

    start = F.struct(F.lit(0).alias("depth"), F.lit("").alias("seen"))
    depths = lambda ls: F.split(F.aggregate(F.transform(ls, moves), start, step, lambda s: s["seen"]), ",")
    return T.bound(lines, lambda ls: T.bound(depths(ls), lambda ds: F.transform(ls, lambda x, i: F.struct(x["num"].alias("num"), F.get(ds, i).cast("int").alias("depth"), x["body"].alias("body")))))


def indented(text: Column) -> Column:
    return shown(lines_with_depth(text))


def shown(lines: Column) -> Column:
    """Lines with depth as "num: ", blanks by depth, body."""

    def line(x: Column) -> Column:
        blank = x["num"].isNull() & (x["body"] == "")
        shown = F.concat(F.coalesce(F.concat(x["num"], F.lit(": ")), F.lit("")), F.repeat(F.lit(" " * INDENT), x["depth"]), x["body"])
        return F.when(blank, "").otherwise(F.regexp_replace(shown, r"\s+$", ""))

    return F.array_join(F.transform(lines, line), "\n")


def display_line(line: Column) -> Column:
    """num (with its colon, or empty), depth and body of one shown line."""
    raw = F.coalesce(line, F.lit(""))
    labelled, lead = raw.rlike(r"^\d{1,3}:[^\n]*$"), F.regexp_extract(raw, r"^(?:\d{1,3}:)?(\s*)", 1)
    wide = F.when(labelled, F.char_length(F.replace(lead, F.lit("\t"), F.lit("  ")))).otherwise(F.char_length(F.regexp_extract(raw, r"^\s*", 0)))
    return F.struct(F.when(labelled, F.regexp_extract(raw, r"^\d{1,3}:", 0)).otherwise("").alias("num"), F.least(F.lit(DEPTH), F.floor(wide / INDENT).cast("int")).alias("depth"), F.when(labelled, F.regexp_replace(raw, r"^\d{1,3}:\s*", "")).otherwise(T.trimmed(raw)).alias("body"))


def title_and_body(text: Column) -> Column:
    """title, body: the words before the first step are a title if they name an algorithm or are few."""
    pattern = r"(?s)^(|.*?\D)(" + STEP_PARTS.replace(r"(^|\D)", "") + r".*)$"

    def parts(t: Column) -> Column:
        # the words before the first step are looked for once, what they are is told once
        def of(lead: Column) -> Column:
            words = F.struct(lead.alias("lead"), T.trimmed(lead).alias("before"))
            told = lambda w: F.struct(w["before"].alias("before"), ((w["lead"] != "") & (w["before"].rlike(TITLE) | F.char_length(w["before"]).between(1, TITLE_CHARS))).alias("titled"))
            return T.bound(T.bound(words, told), shown)

        def shown(w: Column) -> Column:
            return F.struct(F.when(w["titled"], without_heading(w["before"])).otherwise("").alias("title"), F.when(w["titled"], T.trimmed(F.regexp_extract(t, pattern, 2))).otherwise(t).alias("body"))

        return T.bound(F.regexp_extract(t, pattern, 1), of)

    return T.bound(T.trimmed(F.coalesce(text, F.lit(""))), parts)


def without_heading(title: Column) -> Column:
    return T.trimmed(F.regexp_replace(F.regexp_replace(title, r"^#{1,3}\s*", ""), r"^\*+|\*+$", ""))


def recovered(text: Column) -> Column:
    """title, lines of a text that is pseudocode in one piece; null of other texts, and where less than three lines come out."""

    def lines(p: Column) -> Column:
        steps = F.filter(F.split(indented(one_line_a_step(p["body"])), "\n"), lambda x: T.trimmed(x) != "")
        enough = ~M.latex_heavy(p["body"]) & (M.compact_algorithm(p["body"]) | (F.regexp_count(p["body"], F.lit(M.STEP)) >= STEP_LINES))
        return F.when(enough, T.bound(steps, lambda s: F.when(F.size(s) >= STEP_LINES, F.struct(stripped(p["title"]).alias("title"), s.alias("lines")))))

    return T.bound(stripped(text), lambda raw: F.when(M.compact_algorithm(raw), T.bound(title_and_body(raw), lines)))


# ---- words of control ---------------------------------------------------------------------------------------------------


def _words(text: Column, table: dict[str, str]) -> Column:
    for word, by in table.items():
        text = F.regexp_replace(text, T.ascii_words(rf"(?i)\b{word}\b"), by)
    return text


def with_words(rows: DataFrame, text: str, target: str = "简体中文") -> DataFrame:
    """rows with words of control in text as the target language has them (Chinese; others leave it), formulas and names untouched."""
    if not is_chinese(target):
        return rows
    p = F.col("_p")
    masked = F.regexp_replace(_words(p["masked"], KEYWORDS), r"(输入|输出)\s*:", "$1：")
    return rows.withColumn("_p", F.explode(F.array(M.protected(F.col(text))))).withColumn(text, M.restored(masked, p["mark"], p["formulas"])).drop("_p")


def is_chinese(target: str | None) -> bool:
    return bool(re.search(CHINESE, target or ""))


def title_words(title: Column) -> Column:
    """A short title in Chinese, names left as they are."""
    return _words(F.regexp_replace(F.coalesce(title, F.lit("")), r"(?i)^\s*Algorithm\s*(\d+)", "算法 $1"), TITLE_WORDS)


# Signs of mathematics without delimiters, and what parts prose from it.
BARE_SIGN, PROSE = r"\\[A-Za-z]+|[_^]\s*(?:\{|[A-Za-z0-9])|[=<>≤≥≠≈∈∪∅←→]|[A-Za-z0-9]'", r"[\p{IsHan}，。；：！？（）【】“”‘’]+"


def with_delimiters(piece: Column) -> Column:
    """A piece without prose: mathematics in it gets delimiters, without the blanks and marks at its ends; braces of a set are kept."""

    def wrapped(p: Column) -> Column:
        lead = F.regexp_extract(p, r"^[\s),;:]+", 0)
        trail = F.regexp_extract(p, r"(?<![\s,;:.])[\s,;:.]+$", 0)
        inner = F.substring(p, F.char_length(lead) + 1, F.char_length(p) - F.char_length(lead) - F.char_length(trail))
        more = F.regexp_count(inner, F.lit(r"\(")) > F.regexp_count(inner, F.lit(r"\)"))
        loose = F.when(more, F.regexp_extract(inner, r"(?<!\s)\s*\(+\s*$", 0)).otherwise("")
        core = T.trimmed(F.left(inner, F.char_length(inner) - F.char_length(loose)))
        tex = F.regexp_replace(core, r"([=∈]\s*)\{([^{}]+)\}", r"$1\\{$2\\}")
        return F.when(core.rlike(BARE_SIGN), F.concat(lead, F.lit("\\("), tex, F.lit("\\)"), loose, trail)).otherwise(p)

    return F.when(piece.rlike(BARE_SIGN), T.bound(piece, wrapped)).otherwise(piece)


def display_bodies(rows: DataFrame, text: str, target: str = "简体中文") -> DataFrame:
    """rows with text as it is shown: words of control in the target language, mathematics between delimiters."""
    p = F.col("_p")
    apart = F.concat(p["mark"], F.lit(rf"\d+@@|{PROSE}"))
    between = F.regexp_extract_all(p["masked"], apart, F.lit(0))
    shown = T.bound(between, lambda b: F.array_join(F.transform(F.split(p["masked"], apart, -1), lambda x, i: F.concat(with_delimiters(x), F.coalesce(F.get(b, i), F.lit("")))), ""))
    found = with_words(rows, text, target).withColumn("_p", F.explode(F.array(M.protected(F.col(text)))))
    return found.withColumn(text, M.restored(shown, p["mark"], p["formulas"])).drop("_p")


# ---- Markdown -----------------------------------------------------------------------------------------------------------


def fenced(body: Column) -> Column:
    return F.concat(F.lit("```algorithm\n"), indented(one_line_a_step(body)), F.lit("\n```"))


def _steps_of(body: Column) -> Column:
    return ~body.contains("`") & M.compact_algorithm(body)


def _with_title(title: Column, body: Column) -> Column:
    return F.concat(F.when(title != "", F.concat(title, F.lit("\n\n"))).otherwise(""), fenced(body))


def _paragraph(text: Column) -> Column:
    """A paragraph of one line that is steps is split into its title and steps; of several lines, those that are steps get fences."""
    dense = (F.regexp_count(text, F.lit(LOOSE_MARK)) >= MARKED_STEPS) & _steps_of(text)
    whole = T.bound(title_and_body(text), lambda p: _with_title(p["title"], p["body"]))

    def line(ls: Column) -> Callable[[Column, Column], Column]:
        ends = lambda i: ~F.coalesce(F.get(ls, i + 1), F.lit("x")).rlike(r"^\d")
        return lambda x, i: F.when(ends(i) & (F.regexp_count(x, F.lit(r"\d{1,3}\s*[:.：．]\s")) >= MARKED_STEPS) & _steps_of(x), fenced(x)).otherwise(x)

    lines = T.bound(F.split(text, "\n"), lambda ls: F.array_join(F.transform(ls, line(ls)), "\n"))
    return F.when(text.contains("\n"), lines).when(dense, whole).otherwise(text)


def _titled(text: Column) -> Column:
    """A title's line and the steps below it, or behind it in the line."""

    def shown(below: Column) -> Column:
        title = F.substring_index(text, "\n", 1)
        steps = ~below.contains("`") & ~M.latex_heavy(below) & (M.compact_algorithm(below) | M.compact_algorithm(text))
        behind = T.bound(title_and_body(title), lambda p: F.when(_steps_of(p["body"]), F.concat(_with_title(p["title"], p["body"]), F.when(below != "", F.concat(F.lit("\n"), below)).otherwise(""))).otherwise(text))
        return F.when((T.trimmed(below) != "") & steps, _with_title(without_heading(title), T.trimmed(below))).otherwise(behind)

    return T.bound(F.regexp_replace(text, r"^[^\n]*\n?", ""), shown)


def _outside(text: Column) -> Column:
    """Paragraphs, those of steps below a title with it; each keeps the empty lines behind it."""
    paragraphs = F.split(text, r"(?<=\n\n)(?=[^\n])", -1)
    goes_on = lambda p: ~p.rlike(r"^#{1,3}\s") & ~p.rlike(TITLE_LINE) & F.substring_index(p, "\n", 1).rlike(r"\d{1,3}\s*[:.：．]")

    def groups(ps: Column) -> Column:
        starts = F.filter(F.sequence(F.lit(0), F.size(ps) - 1), lambda i: (i == 0) | ~goes_on(F.get(ps, i)))
        return T.bound(starts, lambda s: F.flatten(F.transform(s, lambda at, i: joined(F.slice(ps, at + 1, F.coalesce(F.get(s, i + 1), F.size(ps)) - at)))))

    def joined(part: Column) -> Column:
        return F.when(F.get(part, 0).rlike(TITLE_LINE), F.array(F.array_join(part, ""))).otherwise(part)

    def shown(p: Column) -> Column:
        core = F.regexp_replace(p, r"(?<!\n)\n+$", "")
        return T.bound(core, lambda c: F.concat(F.when(c.rlike(TITLE_LINE), _titled(c)).otherwise(_paragraph(c)), F.substring(p, F.char_length(c) + 1, F.char_length(p))))

    return T.bound(paragraphs, lambda ps: F.array_join(F.transform(groups(ps), shown), ""))


def _fence(text: Column) -> Column:
    """A fence for steps, or one without a name whose content is steps, is written anew; lists of references lose theirs and become paragraphs."""
    pattern = r"(?is)^```([a-z]*)[ \t]*\n(.*?)```$"
    named, body = F.regexp_extract(text, pattern, 1) != "", F.regexp_extract(text, pattern, 2)
    return F.when(M.reference_list(body), K.reference_paragraphs(T.trimmed(body))).when(~M.latex_heavy(body) & (named | M.compact_algorithm(body)), fenced(body)).otherwise(text)


def formatted(rows: DataFrame, text: str) -> DataFrame:
    """rows with steps in text (Markdown) as fences of their own, a line for each step, indented by blocks."""
    p = F.col("_p")
    found = F.regexp_extract_all(p["masked"], F.lit(FENCE), 0)
    between = F.split(p["masked"], FENCE, -1)
    shown = T.bound(found, lambda f: F.array_join(F.transform(between, lambda x, i: F.concat(_outside(x), F.coalesce(_fence(F.get(f, i)), F.lit("")))), ""))
    masked = rows.withColumn("_p", F.explode(F.array(M.protected(F.col(text)))))
    return masked.withColumn(text, M.restored(shown, p["mark"], p["formulas"])).drop("_p")
