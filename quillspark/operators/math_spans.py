"""Formulas in Markdown: found with their places, taken out before other rules and put back, and rules that depend on them.

Display formulas come first, so that a single dollar never takes half of a pair; each kind is found in what the kinds before it left.
A formula may lie in another one, so putting back unwraps one kind after the other.

All is split and joined by patterns that read a text once: a pattern with an end mark is applied up to the last such mark only, behind which
no formula of its kind can begin.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillspark.functions import text as T
from quillspark.operators import units as U

# Kinds of delimited formulas in the order in which they are taken, their patterns, and what ends one.
KINDS = {
    "dollars": (r"\$\$[\s\S]+?\$\$", "$$"), "brackets": (r"\\\[[\s\S]+?\\\]", r"\]"), "parentheses": (r"\\\([\s\S]+?\\\)", r"\)"), "dollar": (r"(?<!\$)\$(?!\$)[^\n$]+?\$(?!\$)", "$"),
}
# Fixed value: the same where dollars are read in pairs from the left, so that the last of three is single. The kinds before leave no longer odd run.
PAIRED = KINDS | {"dollar": (r"(?<=(?<!\$)(?:\$\$)?)\$(?!\$)[^\n$]+?\$(?!\$)", "$")}
TOKEN = "@@MATH"


def replaced(text: Column, pattern: str, body: Callable[[Column, Column], Column]) -> Column:
    """text with body(match, number from 0) for each match."""
    found = F.regexp_extract_all(text, F.lit(pattern), 0)
    pieces = lambda m: F.transform(F.split(text, pattern, -1), lambda p, i: F.concat(p, F.when(i < F.size(m), body(F.get(m, i), i)).otherwise("")))
    return T.bound(found, lambda m: F.array_join(pieces(m), ""))


def _up_to_last(text: Column, end: str) -> Column:
    """The length of text up to the last end mark, with it; 0 without one."""
    return F.char_length(text) - F.char_length(F.substring_index(text, end, -1))


def protected(text: Column, of: dict[str, tuple[str, str]] = KINDS) -> Column:
    """masked, mark, kinds, formulas: the text with a token for each formula. Tokens begin with the mark, which the text doesn't hold.

    A null text is an empty one. Put the result into a column by an explode before it is used: expressions over it would repeat it.
    """
    text = F.coalesce(text, F.lit(""))
    runs = F.regexp_extract_all(text, F.lit(f"{TOKEN}(X*)"), 1)
    mark = T.bound(runs, lambda r: F.concat(F.lit(TOKEN), F.when(F.size(r) > 0, F.repeat(F.lit("X"), F.array_max(F.transform(r, lambda x: F.char_length(x))) + 1)).otherwise("")))
    none = F.array().cast("array<string>")
    state = F.struct(text.alias("masked"), mark.alias("mark"), none.alias("kinds"), none.alias("formulas"))

    def step(kind: str, pattern: str, end: str) -> Callable[[Column], Column]:
        def cut(s: Column) -> Column:
            n = _up_to_last(s["masked"], end)
            return F.struct(F.left(s["masked"], n).alias("head"), F.substring(s["masked"], n + 1, F.char_length(s["masked"])).alias("tail"), s.alias("s"))

        def taken(c: Column) -> Column:
            s = c["s"]
            token = lambda i: F.concat(s["mark"], (F.size(s["formulas"]) + i).cast("string"), F.lit("@@"))
            between = lambda m: F.transform(F.split(c["head"], pattern, -1), lambda p, i: F.concat(p, F.when(i < F.size(m), token(i)).otherwise("")))
            with_tokens = lambda m: F.struct(F.concat(F.array_join(between(m), ""), c["tail"]).alias("masked"), s["mark"].alias("mark"), F.concat(s["kinds"], F.transform(m, lambda _: F.lit(kind))).alias("kinds"), F.concat(s["formulas"], m).alias("formulas"))
            return T.bound(F.regexp_extract_all(c["head"], F.lit(pattern), 0), lambda m: F.when(F.size(m) > 0, with_tokens(m)).otherwise(s))

        return lambda s: T.bound(cut(s), taken)

    for kind, (pattern, end) in of.items():
        state = T.bound(state, step(kind, pattern, end))
    return state


def _pieces(text: Column, mark: Column) -> Column:
    """Literal text and numbers of tokens by turns: a piece that ends a token begins with its digits."""
    return F.split(text, F.concat(mark, F.lit("(?=\\d+@@)")), -1)


def _unwrapped(text: Column, mark: Column, formulas: Column) -> Column:
    inside = lambda p: F.concat(F.get(formulas, F.substring_index(p, "@@", 1).cast("int")), F.substring(p, F.locate("@@", p) + 2, F.char_length(p)))
    return T.bound(_pieces(text, mark), lambda ps: F.array_join(F.transform(ps, lambda p, i: F.when(i == 0, p).otherwise(inside(p))), ""))


def restored(masked: Column, mark: Column, formulas: Column) -> Column:
    """masked with the formulas in place of their tokens, those inside formulas included. What holds no token is left alone."""
    for _ in KINDS:
        masked = T.bound(masked, lambda t: F.when(F.contains(t, mark), _unwrapped(t, mark, formulas)).otherwise(t))
    return masked


def spans(rows: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """keys, place, start, stop, kind, formula of the outermost formulas, in characters from 0. keys name a row.

    Formulas are put back where the row is whole: a row of each piece with the text beside it would grow with the square of the text.
    """
    p = F.col("_p")
    found = rows.select(*keys, F.explode(F.array(protected(F.col(text)))).alias("_p"))

    def part(piece: Column, place: Column) -> Column:
        n = F.when(place > 0, F.substring_index(piece, "@@", 1).cast("int"))
        after = F.when(place > 0, F.char_length(piece) - F.locate("@@", piece) - 1).otherwise(F.char_length(piece))
        return F.struct(F.get(p["kinds"], n).alias("kind"), restored(F.get(p["formulas"], n), p["mark"], p["formulas"]).alias("formula"), after.alias("after"))

    each = found.select(*keys, F.posexplode(F.transform(_pieces(p["masked"], p["mark"]), part)).alias("place", "_part"))
    each = each.select(*keys, "place", "_part.kind", "_part.formula", F.col("_part.after").alias("_after"))
    long = F.coalesce(F.char_length("formula"), F.lit(0))
    each = each.withColumn("_end", F.sum(long + F.col("_after")).over(Window.partitionBy(*keys).orderBy("place"))).filter("place > 0")
    return each.select(*keys, F.col("place") - 1, (F.col("_end") - F.col("_after") - long).alias("start"), (F.col("_end") - F.col("_after")).alias("stop"), "kind", "formula").toDF(*keys, "place", "start", "stop", "kind", "formula")


# ---- equation numbers ---------------------------------------------------------------------------------------------------

# Delimiters of display formulas, a number behind one and what may stand between; a formula that has its tag.
DISPLAY = [(r"\$\$", r"\$\$"), (r"\\\[", r"\\\]")]
BETWEEN = [r"[ \t]*\r?\n[ \t]*", r"[ \t]+"]
EQUATION_NUMBER = r"[（(]\s*\d{1,4}\s*[)）]"
TAGGED = r"\\tag(?![A-Za-z0-9_])"


def numbered_display(opened: str, closed: str, between: str) -> str:
    return rf"({opened})([\s\S]+?)({closed}){between}({EQUATION_NUMBER})(?=\s*(?:\r?\n|$))"


def merged_equation_numbers(markdown: Column) -> Column:
    """A number alone behind a display formula becomes its tag; behind a formula that has one it goes to a line of its own."""
    text = F.coalesce(markdown, F.lit(""))
    for between in BETWEEN:
        for opened, closed in DISPLAY:
            text = _with_tags(text, numbered_display(opened, closed, between))
    return text


def _with_tags(text: Column, pattern: str) -> Column:
    def tagged(m: Column, _: Column) -> Column:
        part = lambda g: F.regexp_extract(m, pattern, g)
        body = F.regexp_replace(part(2), r"(?U)\s+$", "")
        number = F.regexp_replace(part(4), r"[（()）\s]", "")
        with_tag = F.concat(part(1), body, F.when(body != "", "\n").otherwise(""), F.lit("\\tag{"), number, F.lit("}\n"), part(3))
        return F.when(part(2).rlike(TAGGED), F.concat(part(1), part(2), part(3), F.lit("\n"), part(4))).otherwise(with_tag)

    return T.bound(text, lambda t: replaced(t, pattern, tagged))


# ---- numbered steps -----------------------------------------------------------------------------------------------------

# Commands, those of mathematics, ranges in indices, words of pseudocode, a step's mark (not a range), and from how many on each one counts.
COMMAND, SUBSCRIPT, RANGE = r"\\[A-Za-z]+", r"_\{", r"\d{1,3}\s*[:：]\s*[a-z](?![A-Za-z0-9_])"
MATH_COMMANDS = (
    "frac partial sum int prod boldsymbol mathbf mathrm mathit mathcal mathbb mathfrak mathsf left right nabla cdot times infty quad qquad overline underline hat tilde bar vec dot ddot varphi vartheta varepsilon "
    "theta alpha beta gamma lambda phi psi omega sigma mu nu xi pi rho tau eta delta kappa chi zeta"
).split()
MATH_COMMAND = rf"\\(?:{'|'.join(MATH_COMMANDS)})(?![A-Za-z0-9_])"
PSEUDOCODE = r"(?i)Begin|End\s*(?:If|For|While)?|While|For(?![A-Za-z0-9_])|If(?![A-Za-z0-9_])|Else|Return|Input|Output|算法|开始|结束|初始化|循环|伪代码|Algorithm\s*\d"
STEP = r"(?:^|\D)\d{1,3}\s*(?:[:：](?![a-zA-Z](?:-\d+)?(?:[_\s,}.\\)\]]|$))\s*|[.．]\s+)"
LATEX_CHARS, LATEX_COUNTS, ALGORITHM_CHARS, STEPS, STEPS_ALONE = 12, {"commands": 4, "math": 2, "subscripts": (3, 2), "ranges": (2, 1)}, 24, 3, 4
# Lists of references: a heading with an entry, steps that are entries, entries with authors; signs of entries without numbers.
REFERENCE_HEADING, ENTRY_MARK, FALSE_STEP, ENTRY_AUTHOR = r"(?im)参考文献|^\s*#{0,3}\s*References(?![A-Za-z0-9_])", r"\[\s*\d{1,4}\s*\]", r"\d{1,4}\s*[:：]\s*\[\s*\d{1,4}\s*\]", r"\[\s*\d{1,4}\s*\]\s*[A-ZÀ-ÖØ-Þ]"


def _times(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern))


def latex_heavy(text: Column) -> Column:
    """A dump of formulas, which is never a list of steps. Each sign but the first needs a command, of which most texts have none."""

    def heavy(t: Column) -> Column:
        (subs, of_subs), (ranges, of_ranges) = LATEX_COUNTS["subscripts"], LATEX_COUNTS["ranges"]
        signs = lambda commands: (commands >= LATEX_COUNTS["commands"]) | (_times(t, MATH_COMMAND) >= LATEX_COUNTS["math"]) | ((commands >= of_subs) & (_times(t, SUBSCRIPT) >= subs)) | ((commands >= of_ranges) & (_times(t, RANGE) >= ranges) & ~t.rlike(PSEUDOCODE))
        return F.contains(t, F.lit("\\")) & (F.char_length(t) >= LATEX_CHARS) & T.bound(_times(t, COMMAND), signs)

    return T.bound(F.coalesce(text, F.lit("")), heavy)


#: Each row is enough: a sign and how often it occurs at least.
UNNUMBERED_SIGNS = {
    "arxiv": r"(?i)(?<![A-Za-z0-9_])arXiv\s+preprint\s+arXiv\s*:", "venue": r"(?i)(?<![A-Za-z0-9_])(?:doi\s*:|arXiv\s*:|(?:Journal|Proceedings|Transactions|Conference|Springer|Elsevier|Wiley|IEEE|ACM|Cambridge University Press)(?![A-Za-z0-9_]))",
    "year": r"(?m)(?:^|[\s,(])(?:19|20)\d{2}[a-z]?(?=[\s.,;:)]|$)", "year_led": r"(?m)(?:^|\n)\s*(?:19|20)\d{2}[a-z]?\s*[:.：]\s*[A-ZÀ-ÖØ-Þ][^\n]{24,}", "comma": "[,，]",
    "author_led": r"(?m)^\s*(?:(?:19|20)\d{2}[a-z]?\s*[:.：]\s*)?[A-ZÀ-ÖØ-Þ][A-Za-zÀ-ÖØ-öø-ÿ'’-]{1,32},\s+(?:[A-Z](?:\.-?|(?![A-Za-z0-9_]))){1,4}[,.;]",
}
UNNUMBERED_LISTS = [{"author_led": 1, "venue": 1, "year": 1, "comma": 3, "characters": 80}, {"arxiv": 2, "comma": 4}, {"venue": 3, "year": 2, "comma": 5}, {"year_led": 2, "venue": 2}]
#: The order in which signs are looked for.
SIGNS_BY_COST = ["comma", "characters", "arxiv", "year_led", "year", "author_led", "venue"]


def reference_list(text: Column) -> Column:
    """Whether a text is a list of references, by numbered entries or by what speaks for entries without numbers.

    The cheapest signs come first, and none is looked for once the answer is known.
    """

    def listed(t: Column) -> Column:
        entries = F.filter(F.transform(F.split(t, r"\n+"), T.trimmed), lambda x: (x != "") & U.reference_entry(x))
        heading = t.rlike(REFERENCE_HEADING) & t.rlike(ENTRY_MARK)
        bracketed = F.contains(t, F.lit("[")) & (heading | (_times(t, FALSE_STEP) >= 2) | (_times(t, ENTRY_AUTHOR) >= 2))
        count = lambda sign: F.char_length(T.trimmed(t)) if sign == "characters" else _times(t, UNNUMBERED_SIGNS[sign])
        # each list needs some commas or years, which are quickly counted, then its other signs in turn
        lists = [functools.reduce(Column.__and__, [count(sign) >= row[sign] for sign in sorted(row, key=SIGNS_BY_COST.index)]) for row in UNNUMBERED_LISTS]
        return bracketed | functools.reduce(Column.__or__, lists) | (F.size(entries) >= 2)

    return T.bound(F.coalesce(text, F.lit("")), listed)


def compact_algorithm(text: Column) -> Column:
    """Several numbered steps, with words of pseudocode or more of them, which are neither references nor formulas.

    Steps are counted first: most texts have too few, and are read no further.
    """

    def compact(t: Column) -> Column:
        enough = lambda steps: (steps >= STEPS) & ((steps >= STEPS_ALONE) | t.rlike(PSEUDOCODE))
        return (F.char_length(t) >= ALGORITHM_CHARS) & T.bound(_times(t, STEP), enough) & ~latex_heavy(t) & ~reference_list(t)

    return T.bound(F.coalesce(text, F.lit("")), compact)
