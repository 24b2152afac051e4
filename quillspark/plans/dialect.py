"""Pieces of DuckDB SQL that mirror functions of the engine."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillspark.functions.text import LATIN_STOP_WORDS, TOKEN
from quillspark.operators import units as U


def squeezed(c: str) -> str:
    out = f"regexp_replace(coalesce({c}, ''), '\\r\\n?', chr(10), 'g')"
    out = f"regexp_replace({out}, '[\\t\\f\\v\\x{{00a0}}]+', ' ', 'g')"
    out = f"regexp_replace({out}, ' {{2,}}', ' ', 'g')"
    out = f"regexp_replace({out}, '\\n{{3,}}', chr(10) || chr(10), 'g')"
    return f"regexp_replace({out}, '^\\s+|\\s+$', '', 'g')"


def one_line(c: str) -> str:
    return f"regexp_replace(regexp_replace(coalesce({c}, ''), '\\s+', ' ', 'g'), '^\\s+|\\s+$', '', 'g')"


def stem(t: str) -> str:
    return (
        f"CASE WHEN length({t}) <= 4 THEN {t} WHEN {t} LIKE '%ies' AND length({t}) > 5 THEN left({t}, length({t}) - 3) || 'y' WHEN {t} LIKE '%ing' AND length({t}) > 6 THEN left({t}, length({t}) - 3)"
        f" WHEN {t} LIKE '%ed' AND length({t}) > 5 THEN left({t}, length({t}) - 2) WHEN {t} LIKE '%es' AND length({t}) > 5 THEN left({t}, length({t}) - 2) WHEN {t} LIKE '%s' AND {t} NOT LIKE '%ss' THEN left({t}, length({t}) - 1) ELSE {t} END"
    )


STOP = ", ".join(f"'{w}'" for w in LATIN_STOP_WORDS)


def tokens(c: str) -> str:
    """List of search tokens (Latin ones; the tables have no others)."""
    found = f"list_filter(regexp_extract_all(lower({squeezed(c)}), '{TOKEN}'), lambda t: length(t) > 1 OR regexp_matches(t, '\\d'))"
    return f"flatten(list_transform({found}, lambda t: list_filter([CASE WHEN t NOT IN ({STOP}) THEN t END, CASE WHEN ({stem('t')}) <> t AND ({stem('t')}) NOT IN ({STOP}) THEN {stem('t')} END], lambda x: x IS NOT NULL)))"


def count_of(text: str, term: str) -> str:
    return f"((length({text}) - length(replace({text}, '{term}', ''))) // {len(term)})"


def picked(pieces: list[list[str]], key: str, sql: bool):
    """Parts of a text that follow the digits of a key in mixed radix."""
    out, divisor = [], 1
    for options in pieces:
        n = len(options)
        if sql:
            out.append("([" + ", ".join("'" + o.replace("'", "''") + "'" for o in options) + f"])[{key} // {divisor} % {n} + 1]")
        else:
            out.append(F.element_at(F.array(*[F.lit(o) for o in options]), (F.floor(F.col(key) / divisor) % n + 1).cast("int")))
        divisor *= n
    return " || ".join(out) if sql else F.concat(*out)


def re2(pattern: str) -> str:
    """A pattern of the engine as a literal: RE2 names scripts otherwise, knows no (?U) and looks around at the edges of words only."""
    for ours, theirs in (("(?U)", ""), (r"\p{Is", r"\p{"), ("(?![A-Za-z0-9_])", r"\b"), ("(?<![A-Za-z0-9_])", r"\b"), ("'", "''")):
        pattern = pattern.replace(ours, theirs)
    return f"'{pattern}'"


def times(text: str, pattern: str) -> str:
    return f"len(regexp_extract_all({text}, {re2(pattern)}))"


def value_cell(c: str) -> str:
    """Whether a table cell is a value."""
    value = f"regexp_replace(coalesce({c}, ''), '^\\s+|\\s+$', '', 'g')"
    tight = f"regexp_replace({value}, '\\s+', '', 'g')"
    words = ", ".join(f"'{w}'" for w in U.MATH_WORDS)
    prose = f"list_filter(regexp_extract_all({value}, '\\p{{L}}+'), lambda w: length(w) >= 2 AND NOT regexp_matches(w, '^\\p{{Lu}}+$') AND lower(w) NOT IN ({words}))"
    forms = [f"{value} = ''", f"NOT regexp_matches({value}, '\\p{{L}}')", *[f"regexp_matches({tight}, {re2(p)})" for p in U.NUMBER_CELLS], *[f"regexp_matches({value}, {re2(p)})" for p in (U.MEASURE_CELL, U.SYMBOL_CELL)]]
    return f"({' OR '.join(forms)} OR (regexp_matches({value}, {re2(U.MATH_SIGN)}) AND len({prose}) = 0))"
