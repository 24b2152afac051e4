"""Text functions as Spark columns.

White space and lengths follow the model's own rules: runs of tabs and no-break spaces are one space, lengths of token
estimates count UTF-16 units. Everything here is a built-in expression; what needs a loop is in operators/.
"""

from __future__ import annotations

import functools
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words and Han strings that carry no meaning for search.
LATIN_STOP_WORDS = (
    "a an and are as at be been by for from has have in into is it its of on or our that the their these this those to using was we were with without which can may than then"
).split()
HAN_STOP_WORDS = "一个 一种 以及 对于 本文 我们 这个 这些 其中 通过 可以 进行 使用 提出 基于 方法 结果 为了".split()
# What a search token is, the same without single letters and ways back, and the blocks that count one token for each character.
TOKEN = r"[a-z][a-z0-9]*(?:[_-][a-z0-9]+)*|\d+(?:\.\d+)?"
LONG_TOKEN = r"[a-z][a-z0-9]++(?:[_-][a-z0-9]++)*+|[a-z](?:[_-][a-z0-9]++)++|\d++(?:\.\d++)?+"
WIDE = "[　-鿿豈-﫿＀-￯]"


def bound(value: Column, body) -> Column:
    """body of value, which is computed once though body may name it several times."""
    return F.get(F.transform(F.array(value), body), 0)


def squeezed(text: Column) -> Column:
    """Line ends as \\n, blanks squeezed, at most one empty line, trimmed."""
    text = F.regexp_replace(F.coalesce(text, F.lit("")), "\r\n?", "\n")
    text = F.regexp_replace(text, "[\t\f\u000b ]+", " ")
    text = F.regexp_replace(text, " {2,}", " ")
    text = F.regexp_replace(text, "\n{3,}", "\n\n")
    return trimmed(text)


def trimmed(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def one_line(text: Column) -> Column:
    """All white space is one space; trimmed."""
    return trimmed(F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)\s+", " "))


def search_text(text: Column) -> Column:
    """For matching: squeezed, lower case. (Compatibility forms are folded by operators.retrieval.compatible.)"""
    return F.lower(squeezed(text))


def matched_text(text: Column) -> Column:
    """For the comparison of passages: lower case, one line."""
    return one_line(F.lower(text))


def stem(token: Column) -> Column:
    n = F.char_length(token)
    cut = lambda k: F.left(token, n - k)
    return (
        F.when(n <= 4, token)
        .when(token.endswith("ies") & (n > 5), F.concat(cut(3), F.lit("y")))
        .when(token.endswith("ing") & (n > 6), cut(3))
        .when(token.endswith("ed") & (n > 5), cut(2))
        .when(token.endswith("es") & (n > 5), cut(2))
        .when(token.endswith("s") & ~token.endswith("ss"), cut(1))
        .otherwise(token)
    )


def _latin(text: Column) -> Column:
    """Each token and, where it differs, its stem; no stop words."""
    both = lambda t: F.array(t, F.nullif(stem(t), t))
    tokens = F.flatten(F.transform(F.regexp_extract_all(text, F.lit(LONG_TOKEN), F.lit(0)), both))
    return F.filter(tokens, lambda x: x.isNotNull() & ~x.isin(LATIN_STOP_WORDS))


def _grams(run: Column, n: int) -> Column:
    at = F.when(F.char_length(run) >= n, F.sequence(F.lit(1), F.char_length(run) - (n - 1))).otherwise(F.array().cast("array<int>"))
    return F.transform(at, lambda i: F.substring(run, i, F.lit(n)))


def _han(text: Column, query: bool) -> Column:
    def parts(run: Column) -> Column:
        n = F.char_length(run)
        whole = F.when((F.lit(query) | (n <= 6)) & (n <= 12) & ~run.isin(HAN_STOP_WORDS), F.array(run)).otherwise(F.array().cast("array<string>"))
        pairs = F.filter(_grams(run, 2), lambda g: ~g.isin(HAN_STOP_WORDS))
        triples = _grams(run, 3) if query else F.array().cast("array<string>")
        return F.when(n == 1, F.array(run)).otherwise(F.concat(whole, pairs, triples))

    # a text in ASCII has no such run
    runs = F.when(F.octet_length(text) > F.char_length(text), F.regexp_extract_all(text, F.lit(r"\p{IsHan}++"), F.lit(0)))
    return F.coalesce(F.flatten(F.transform(runs, parts)), F.array().cast("array<string>"))


def search_tokens(text: Column, query: bool = False) -> Column:
    """Search tokens in order, repeats included: Latin words and numbers with their stems, then Han runs and n-grams.

    White space is in no token, so it stays as it is.
    """
    return bound(F.lower(F.coalesce(text, F.lit(""))), lambda t: F.concat(_latin(t), _han(t, query)))


def estimated_tokens(text: Column) -> Column:
    """Wide characters plus a quarter of the other UTF-16 units, rounded up."""
    text = F.coalesce(text, F.lit(""))
    wide = F.regexp_count(text, F.lit(WIDE))
    units = F.char_length(text) + F.regexp_count(text, F.lit("[\\x{10000}-\\x{10FFFF}]"))
    return F.ceil(wide + (units - wide) / F.lit(4.0)).cast("long")


def occurrences(text: Column, term: str) -> Column:
    """How often term stands in text, not overlapping."""
    return ((F.char_length(text) - F.char_length(F.replace(text, F.lit(term), F.lit("")))) / F.lit(len(term))).cast("int")


def clipped(text: Column, n: int, mark: str = "…") -> Column:
    return F.when(F.char_length(text) > n, F.concat(F.left(text, F.lit(n)), F.lit(mark))).otherwise(text)


_WORD = "[A-Za-z0-9_]"


def ascii_words(pattern: str) -> str:
    """A pattern whose word boundaries are those of ASCII words, as the rules mean them."""
    return pattern.replace(r"\b", f"(?:(?<={_WORD})(?!{_WORD})|(?<!{_WORD})(?={_WORD}))")


def all_matches(text: Column, pattern: str, group: int = 1) -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(ascii_words(pattern)), group)


def found(text: Column, pattern: str, group: int = 1) -> Column:
    """The first match's group, null if there is none."""
    return F.nullif(F.regexp_extract(F.coalesce(text, F.lit("")), ascii_words(pattern), group), F.lit(""))


# ---- citations: four rules that differ on purpose -----------------------------------------------------------------


def page_citations(text: Column) -> Column:
    """Pages cited as 第 N 页 (1 to 5 digits), each once, in order."""
    return F.array_distinct(F.transform(all_matches(text, r"第\s*(\d{1,5})\s*页"), lambda x: x.cast("int")))


def skill_citations(text: Column) -> Column:
    """The same with 1 to 4 digits and pages from 1."""
    return F.filter(F.array_distinct(F.transform(all_matches(text, r"第\s*(\d{1,4})\s*页"), lambda x: x.cast("int"))), lambda n: n >= 1)


def any_citations(text: Column, max_page: int = 0) -> Column:
    """Pages cited in any of the known forms, sorted; max_page (0: none) bounds them."""
    text = F.coalesce(text, F.lit(""))
    forms = [r"第\s*(\d{1,4})\s*页", r"(?i)\bpages?\s*(\d{1,4})\b", r"(?i)\bp\.\s*(\d{1,4})\b", r"[（(]\s*第?\s*(\d{1,4})\s*页\s*[）)]", r"(?i)[（(]\s*p\.?\s*(\d{1,4})\s*[）)]"]
    every = F.flatten(F.array(*[F.transform(all_matches(text, p), lambda x: x.cast("int")) for p in forms]))
    return F.array_sort(F.array_distinct(F.filter(every, lambda n: (n >= 1) & ((n <= max_page) | F.lit(max_page <= 0)))))


def mobile_citations(text: Column) -> Column:
    """At most 12 pages cited as 第 N 页."""
    return F.slice(skill_citations(text), 1, 12)


# ---- anchors, symbols, numbers, cues ------------------------------------------------------------------------------


def anchors(text: Column, most: int = 24) -> Column:
    """What survives translation: citations, equation numbers, Latin words, decimals, long integers; lower case, distinct."""
    cites = F.transform(all_matches(text, r"\[(\d{1,3}(?:\s*[,–-]\s*\d{1,3})*)\]"), lambda x: F.concat(F.lit("["), F.regexp_replace(x, r"\s+", ""), F.lit("]")))
    numbers = F.transform(all_matches(text, r"\((\d{1,3})\)"), lambda x: F.concat(F.lit("("), x, F.lit(")")))
    words = all_matches(text, r"([A-Za-z][A-Za-z-]{2,})")
    decimals = all_matches(text, r"(\d+\.\d+%?)")
    integers = all_matches(text, r"(?<![\d.])(\d{3,})(?![\d.])")
    every = F.transform(F.concat(cites, numbers, words, decimals, integers), F.lower)
    return F.slice(F.array_distinct(F.filter(every, lambda x: F.char_length(x) >= 2)), 1, most)


# Capitals that are no symbols.
NO_SYMBOLS = "THE AND FOR WITH FROM THIS THAT ARE WAS WERE PDF HTTP HTTPS DOI URL IEEE ACM VOL NO".split()


def symbols(text: Column, most: int = 16) -> Column:
    """array<struct<token, kind>>: acronyms, subscripted names, Greek commands, CamelCase terms; the first of equal ones.

    A pattern looks at the first character before it tests a word's boundary; what it finds is bound, so that a text is read once for each.
    """
    forms = [
        ("acronym", r"(?=[A-Z])\b([A-Z]{2,6})\b"),
        ("symbol", r"(?=[A-Za-z])(?<![A-Za-z0-9_])([A-Za-z][A-Za-z0-9]{0,6}_[A-Za-z0-9]{1,6})\b"),
        ("greek", r"(?i)(\\(?:alpha|beta|gamma|delta|epsilon|theta|lambda|mu|sigma|omega|phi|psi))\b"),
        ("term", r"(?=[A-Z])\b([A-Z][a-z]+(?:[A-Z][a-z0-9]+){1,3})\b"),
    ]

    def firsts(every: Column) -> Column:
        first = lambda keys: F.transform(F.slice(F.array_distinct(keys), 1, most), lambda k: F.get(every, (F.array_position(keys, k) - 1).cast("int")))
        return bound(F.transform(every, lambda s: F.lower(s["token"])), first)

    found = F.concat(*[_kinded(all_matches(text, p) if kind != "symbol" else F.when(F.contains(text, F.lit("_")), all_matches(text, p)).otherwise(F.array().cast("array<string>")), kind) for kind, p in forms])
    return bound(F.filter(found, lambda s: F.char_length(s["token"]).between(2, 24) & ~F.upper(s["token"]).isin(NO_SYMBOLS)), firsts)


def _kinded(tokens: Column, kind: str) -> Column:
    shown = F.lower if kind == "greek" else (lambda x: x)
    return F.transform(tokens, lambda x: F.struct(shown(x).alias("token"), F.lit(kind).alias("kind")))


def key_numbers(text: Column, most: int = 12) -> Column:
    """Percentages and numbers with at least two decimals, each once, without bare years."""
    every = F.transform(all_matches(text, r"(\d+\.\d+\s*%|\d+\s*%|\d+\.\d{2,})"), trimmed)
    return F.slice(F.array_distinct(F.filter(every, lambda x: ~x.rlike(r"^(19|20)\d{2}$"))), 1, most)


# What names a part of a paper, and its label.
SECTION_CUES = [
    (r"(?i)\bAbstract\b", "摘要"), (r"(?i)\bIntroduction\b", "引言"), (r"(?i)\bRelated Work\b", "相关工作"), (r"(?i)\bMethod", "方法"), (r"(?i)\bExperiment", "实验"), (r"(?i)\bConclusion\b", "结论"),
    (r"(?i)\bAlgorithm\s+\d+", "算法"), (r"(?i)\bTable\s+\d+", "表格"), (r"(?i)\bFigure\s+\d+", "图"), ("摘要", "摘要"), ("引言|介绍", "引言"), ("相关工作", "相关工作"), ("实验", "实验"), ("结论", "结论"),
]


def section_cues(text: Column) -> Column:
    """Labels of the parts that a text names. Most texts lack a cue's word, which is looked for before its pattern."""
    text = F.coalesce(text, F.lit(""))

    def labels(low: Column) -> Column:
        named = lambda p: functools.reduce(Column.__or__, [F.contains(low, F.lit(w.lower())) for w in re.sub(r"\(\?i\)|\\b|\\s.*", "", p).split("|")])
        return F.array_distinct(F.filter(F.array(*[F.when(named(p) & text.rlike(ascii_words(p)), F.lit(label)) for p, label in SECTION_CUES]), lambda x: x.isNotNull()))

    return bound(F.lower(text), labels)


def arxiv_id(text: Column) -> Column:
    """arXiv:2203.15386v2 -> 2203.15386v2, else empty."""
    return F.regexp_extract(F.coalesce(text, F.lit("")), r"(?i)arXiv[:\s]*(\d{4}\.\d{4,5}(?:v\d+)?)", 1)


def year(text: Column) -> Column:
    """The first year from 1990 to 2039, rather in the first 600 characters."""
    pattern = r"\b(199\d|20[0-3]\d)\b"
    return F.coalesce(found(F.left(F.coalesce(text, F.lit("")), F.lit(600)), pattern), found(text, pattern)).cast("int")


def readable_html(html: Column) -> Column:
    """Readable text of a page by fixed replacements: boilerplate elements go, block ends become line ends."""
    t = F.coalesce(html, F.lit(""))
    for pattern, to in [
        (r"(?is)<script\b.*?</script>", " "), (r"(?is)<style\b.*?</style>", " "), (r"(?is)<(nav|header|footer|aside)\b.*?</(nav|header|footer|aside)>", " "),
        (r"(?i)<br\s*/?>(?=\S)", "\n"), (r"(?i)</(p|div|li|h[1-6]|tr)>", "\n"), (r"(?s)<[^>]+>", " "), ("(?i)&nbsp;", " "), ("(?i)&amp;", "&"), ("(?i)&lt;", "<"), ("(?i)&gt;", ">"),
        ("[ \t]+", " "), (r"\n\s*\n\s*\n+", "\n\n"),
    ]:
        t = F.regexp_replace(t, pattern, to)
    return trimmed(t)


# ---- labels and small formats -------------------------------------------------------------------------------------


def token_label(n: Column) -> Column:
    """A count in 万 (10^4) or 亿 (10^8)."""
    v = F.greatest(F.lit(0), F.round(F.coalesce(n, F.lit(0))).cast("long"))
    return F.when(v >= 100_000_000, F.format_string("%.2f亿", v / 1e8)).when(v >= 10_000, F.format_string("%.1f万", v / 1e4)).otherwise(v.cast("string"))


def path_encoded(path: Column) -> Column:
    """Each segment of a path URL-encoded, blanks as %20; empty segments go."""
    parts = F.filter(F.split(F.coalesce(path, F.lit("")), "/"), lambda s: s != "")
    return F.array_join(F.transform(parts, lambda s: F.replace(F.url_encode(s), F.lit("+"), F.lit("%20"))), "/")


def safe_segment(name: Column, fallback: str = "untitled-paper", most: int = 80) -> Column:
    """A file name part without path and reserved characters, at most `most` characters."""
    clean = F.left(one_line(F.regexp_replace(F.coalesce(name, F.lit("")), r"[\\/:*?\"<>|#^\[\]]+", " ")), F.lit(most))
    return F.coalesce(F.nullif(clean, F.lit("")), F.lit(fallback))


def escaped_html(text: Column) -> Column:
    out = F.coalesce(text, F.lit(""))
    for a, b in [("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")]:
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def neutral_html(markdown: Column) -> Column:
    """A < that would begin a tag becomes &lt;."""
    return F.regexp_replace(F.coalesce(markdown, F.lit("")), r"<(?=[A-Za-z/!?])", "&lt;")


def keyword_list(raw: Column, most: int = 8) -> Column:
    """Keywords between commas, semicolons (either width) and line ends."""
    return F.slice(F.filter(F.transform(F.split(F.coalesce(raw, F.lit("")), "[,，;；\n]"), trimmed), lambda x: x != ""), 1, most)


def middle_clipped(text: Column, most: int = 72) -> Column:
    """At most `most` characters: 55 % from the start and the rest from the end, around an ellipsis."""
    text = one_line(text)
    head = int((most - 1) * 0.55)
    return F.when(F.char_length(text) <= most, text).otherwise(F.concat(F.left(text, F.lit(head)), F.lit("…"), F.right(text, F.lit(most - 1 - head))))


def has_letter_or_digit(text: Column) -> Column:
    return text.rlike(r"[\p{L}\p{N}]")


def translatable_selection(text: Column) -> Column:
    t = one_line(text)
    return F.char_length(t).between(2, 1200) & has_letter_or_digit(t)


def askable_selection(text: Column) -> Column:
    t = one_line(text)
    return F.char_length(t).between(1, 1500) & has_letter_or_digit(t)


def has_enough_letters(text: Column) -> Column:
    """At least three characters, of which a fifth are letters."""
    t = trimmed(F.coalesce(text, F.lit("")))
    return (F.char_length(t) >= 3) & (F.regexp_count(t, F.lit(r"[\p{L}]")) >= 0.2 * F.char_length(t))
