"""Reading plans: the nodes of a page become ordered units of text with tokens for formulas, and translated units become changes of nodes.

A paragraph is one unit; one with many formulas is cut where a sentence or clause begins after a few of them, or after the most a unit
may hold (a state machine over its segments); an algorithm gives a unit for each of its lines. A citation alone joins the unit before it.
Author lines, references, page numbers and formulas alone are no units.

A unit's slots are its pieces of text, each with the number of tokens before it: a translation is cut at the tokens, its parts
go to the first node of their slot and the slot's other nodes become empty.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.functions import text as T
from quillspark.operators import units as U

# Formulas from which a unit may end at a clause, and at which it ends.
PREFERRED_FORMULAS, MOST_FORMULAS = 3, 7
# How a clause begins; what carries meaning; a citation alone; a page number.
CLAUSE = r"(?i)^\s*(?:(?:[.!?]\s+)(?=[A-Z\p{IsHan}])|[;:]\s+|(?:if\s+and\s+only\s+if|such\s+that|provided\s+that|where(?:as)?|although|because|however|therefore|hence|then)\b)"
MEANING = r"[A-Za-z\p{IsHan}]"
CITATION = r"^(?:\[\s*\d+(?:\s*[-–,]\s*\d+)*\s*\]\s*[,.;:]?\s*)+$"
PAGE_NUMBER = r"^\d{1,4}$"
# Author lines: an address gives one away, these exclude one; letters, names, words between names, marks; bounds.
ADDRESS = r"[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+"
NO_AUTHORS = [
    r"(?i)\b(?:university|department|institute|laboratory|school|college|center|centre|email|correspondence|inc\.|ltd\.|china|kong|usa|uk|germany|japan)\b",
    r"(?i)^\s*(?:table|tab\.?|fig(?:ure)?\.?|表|图)\s*(?:[IVXLCDM]+|\d+)", r"(?i)^\s*(?:algorithm|procedure)\s+\d+",
]
AUTHOR_SIGNS = r"^[A-Za-zÀ-ÖØ-öø-ÿ0-9\s,.\-–—*&†‡§¹²³⁴⁵⁶⁷⁸⁹⁰′'’]+$"
AUTHOR_WORD, AUTHOR_NAME, AUTHOR_GLUE, AUTHOR_MARK = r"([A-Za-zÀ-ÖØ-öø-ÿ]+)", r"^(?:[A-Z][a-zà-öø-ÿ]*|[A-Z]{2,3})$", ["and", "et", "al"], r"[\d¹²³⁴⁵⁶⁷⁸⁹⁰*†‡]"
#: Fields of nodes that units are made of.
FIELDS = "level id kind text role content_role frozen line layout".split()
AUTHOR_CHARS, AUTHOR_WORDS, UNMARKED_NAMES, UNMARKED_CHARS = 220, (2, 20), 8, 90


def author_line(text: Column) -> Column:
    """Names of people with their marks, or an address. A long line is neither, which is told first."""

    def named(t: Column) -> Column:
        glue = lambda w: F.lower(w).isin(AUTHOR_GLUE)
        other = functools.reduce(Column.__or__, [t.rlike(p) for p in NO_AUTHORS])

        def listed(words: Column) -> Column:
            names = lambda n: (n >= 2) & (t.rlike(AUTHOR_MARK) | ((n <= UNMARKED_NAMES) & (F.char_length(t) <= UNMARKED_CHARS)))
            return F.size(words).between(*AUTHOR_WORDS) & F.forall(words, lambda w: glue(w) | w.rlike(AUTHOR_NAME)) & T.bound(F.size(F.filter(words, lambda w: ~glue(w))), names)

        return t.rlike(ADDRESS) | (t.rlike(AUTHOR_SIGNS) & ~other & T.bound(T.all_matches(t, AUTHOR_WORD), listed))

    return T.bound(T.one_line(text), lambda t: (t != "") & (F.char_length(t) <= AUTHOR_CHARS) & named(t))


def worth_translating(text: Column) -> Column:
    """A unit with prose besides its tokens."""
    bare = T.trimmed(F.regexp_replace(F.coalesce(text, F.lit("")), U.TOKEN, ""))
    return T.bound(bare, lambda t: t.rlike(MEANING) & ~t.rlike(PAGE_NUMBER) & ~t.rlike(CITATION) & ~author_line(t) & ~U.reference_entry(t))


def clause_groups(segments: Column) -> Column:
    """For each segment (kind, text) the number of its unit.

    State: the unit so far, its formulas, and the numbers given. Formulas beyond the most wait for the next formula or meaningful text.
    """
    math = lambda s: s["kind"] == "inline_math"
    means = lambda s: F.coalesce((s["kind"] == "text") & s["text"].rlike(MEANING), F.lit(False))
    start = F.struct(F.lit(0).alias("unit"), F.lit(0).alias("held"), F.array().cast("array<int>").alias("given"))

    def step(state: Column, s: Column) -> Column:
        clause = means(s) & (state["held"] >= PREFERRED_FORMULAS) & F.coalesce(s["text"].rlike(CLAUSE), F.lit(False))
        full = (state["held"] >= MOST_FORMULAS) & (math(s) | means(s))
        new = (F.size(state["given"]) > 0) & (clause | full)
        unit = state["unit"] + new.cast("int")
        return F.struct(unit.alias("unit"), (F.when(new, 0).otherwise(state["held"]) + math(s).cast("int")).alias("held"), F.array_append(state["given"], unit).alias("given"))

    numbered = F.aggregate(segments, start, step, lambda state: state["given"])
    few = F.size(F.filter(segments, math)) <= PREFERRED_FORMULAS
    return F.when(few, F.transform(segments, lambda s: F.lit(0))).otherwise(numbered)


def _unit(id: Column, segments: Column) -> Column:
    """id, text, tokens, slots (slot, id, text) of some segments; a text's slot is the number of formulas before it. No array grows by one at a time."""
    math = lambda s: s["kind"] == "inline_math"

    def of(segments: Column) -> Column:
        marks = F.transform(segments, lambda s: F.when(math(s), U.placeholder(s["id"])))
        places = F.filter(F.transform(segments, lambda s, i: F.when(math(s), i)), lambda i: i.isNotNull())
        return T.bound(F.struct(marks.alias("marks"), places.alias("places")), lambda m: shown(segments, m))

    def shown(segments: Column, m: Column) -> Column:
        bounds = F.concat(F.array(F.lit(-1)), m["places"], F.array(F.size(segments)))
        text = F.array_join(F.transform(segments, lambda s, i: F.when(math(s), F.get(m["marks"], i)).otherwise(s["text"])), "")
        tokens = F.transform(m["places"], lambda i: F.get(m["marks"], i))
        return F.struct(id.alias("id"), text.alias("text"), tokens.alias("tokens"), T.bound(bounds, lambda b: slots(segments, b)).alias("slots"))

    def slots(segments: Column, bounds: Column) -> Column:
        # the texts between a formula and the next
        texts = lambda n, a, z: F.transform(F.slice(segments, a + 2, z - a - 1), lambda s: F.struct(n.alias("slot"), s["id"].alias("id"), s["text"].alias("text")))
        return F.flatten(F.transform(F.sequence(F.lit(0), F.size(bounds) - 2), lambda n: texts(n, F.get(bounds, n), F.get(bounds, n + 1))))

    return T.bound(segments, of)


def _units_of(block: Column, nodes: Column) -> Column:
    """Candidates of a block, in order."""
    direct = lambda n: F.struct(n["id"].alias("id"), n["text"].alias("text"), F.array().cast("array<string>").alias("tokens"), F.array(F.struct(F.lit(0).alias("slot"), n["id"].alias("id"), n["text"].alias("text"))).alias("slots"))
    segments = F.filter(nodes, lambda n: n["level"] == "segment")
    lined = F.coalesce((block["layout"] == "algorithm") & F.exists(segments, lambda s: s["line"].isNotNull()), F.lit(False))

    def paragraph(held: Column) -> Column:
        groups = F.when(lined, F.transform(held, lambda s: F.coalesce(s["line"], F.lit(0)))).otherwise(clause_groups(held))

        def cut(g: Column) -> Column:
            several = F.size(F.array_distinct(g)) > 1
            name = lambda k: F.when(lined, F.concat(block["id"], F.lit("-line"), k.cast("string"))).when(several, F.concat(block["id"], F.lit("-unit"), k.cast("string"))).otherwise(block["id"])
            lines = F.transform(F.array_distinct(g), lambda k: _unit(name(k), F.filter(held, lambda s, i: F.get(g, i) == k)))
            # clauses lie one after the other: each is cut out, so that the work stays in proportion to the segments
            starts = F.filter(F.sequence(F.lit(0), F.greatest(F.size(g) - 1, F.lit(0))), lambda i: (i < F.size(g)) & ((i == 0) | (F.get(g, i) != F.get(g, i - 1))))
            clauses = T.bound(starts, lambda s: F.transform(s, lambda a, n: _unit(name(F.get(g, a)), F.slice(held, a + 1, F.coalesce(F.get(s, n + 1), F.size(g)) - a))))
            return F.when(lined, lines).otherwise(clauses)

        return T.bound(groups, cut)

    caption = F.transform(F.filter(nodes, lambda n: n["level"] == "caption"), direct)
    return F.when(block["kind"] == "paragraph", T.bound(segments, paragraph)).when(block["kind"].isin("heading", "caption", "plain_text"), F.array(direct(block))).when(block["kind"].isin("table", "figure"), caption)


def units(pages: DataFrame, keys: list[str]) -> DataFrame:
    """keys, place, id, text, tokens, slots of normalized pages (page_ir.normalized); keys name a page.

    All is done in the page's row, whose nodes lie block by block: nothing is dealt out and gathered again. An explode of one keeps what is used
    several times from being made several times.
    """
    once = lambda rows, made, name: rows.select(*keys, F.explode(F.array(made)).alias(name))
    starts = F.filter(F.transform("nodes", lambda n, i: F.when(n["level"] == "block", i)), lambda i: i.isNotNull())
    own = lambda at, k: F.slice("nodes", at + 1, F.coalesce(F.get("_starts", k + 1), F.size("nodes")) - at)
    blocks = pages.filter(F.size("nodes") > 0).select(*keys, "nodes", F.explode(F.array(starts)).alias("_starts"))
    hidden = lambda b: F.coalesce(b["frozen"], F.lit(False)) | F.coalesce(F.lower(F.coalesce(b["role"], b["content_role"])) == "author", F.lit(False)) | F.coalesce(author_line(b["text"]), F.lit(False))

    def candidates(nodes: Column) -> Column:
        made = lambda b: T.bound(_units_of(b, nodes), lambda us: F.transform(us, flagged))
        return T.bound(F.get(nodes, 0), lambda b: F.when(~hidden(b), made(b)))

    def flagged(u: Column) -> Column:
        told = lambda t: F.when(t != "", F.struct(worth_translating(u["text"]).alias("kept"), t.rlike(CITATION).alias("cited"), u.alias("unit")))
        return T.bound(T.trimmed(u["text"]), told)

    flags = F.transform("_starts", lambda at, k: T.bound(own(at, k), candidates))
    given = F.flatten(F.filter(F.transform(flags, lambda us: F.filter(us, lambda x: x["kept"] | x["cited"])), lambda us: us.isNotNull()))
    each = once(blocks, given, "_all")
    # a unit and the citations after it; those before the first unit go
    firsts = F.filter(F.transform("_all", lambda x, i: F.when(x["kept"], i)), lambda i: i.isNotNull())
    each = each.select(*keys, "_all", F.explode(F.array(firsts)).alias("_firsts"))
    groups = F.transform("_firsts", lambda at, k: F.slice("_all", at + 1, F.coalesce(F.get("_firsts", k + 1), F.size("_all")) - at))
    joined = each.select(*keys, F.posexplode(groups).alias("place", "_group"))
    first = F.get("_group", 0)["unit"]
    cited = F.transform(F.slice("_group", 2, F.greatest(F.size("_group") - 1, F.lit(0))), lambda x: x["unit"])
    glue = F.when((F.size("_group") > 1) & ~first["text"].rlike(r"(?U)\s$"), " ").otherwise("")
    text = F.when(F.size("_group") > 1, F.concat(first["text"], glue, F.array_join(F.transform(cited, lambda u: T.trimmed(u["text"])), " "))).otherwise(first["text"])
    last = F.size(first["tokens"])
    more = F.flatten(F.transform(cited, lambda u: F.transform(u["slots"], lambda s: F.struct(last.alias("slot"), s["id"].alias("id"), s["text"].alias("text")))))
    return joined.select(*keys, F.col("place").cast("long").alias("place"), first["id"].alias("id"), text.alias("text"), first["tokens"].alias("tokens"), F.concat(first["slots"], more).alias("slots"))


def changes(rows: DataFrame, translated: Column, keys: list[str]) -> DataFrame:
    """keys, id, text: what each node of a unit (tokens, slots) becomes. A translation that lost, changed or moved a token gives no changes."""
    kept = rows.filter(U.tokens_intact(F.col("tokens"), translated))
    parts = F.split(F.coalesce(translated, F.lit("")), U.TOKEN, -1)
    kept = kept.select(*keys, "slots", F.explode_outer(F.array(parts)).alias("_parts"))

    def change(s: Column, i: Column) -> Column:
        first = (i == 0) | (F.get(F.col("slots"), i - 1)["slot"] != s["slot"])
        return F.struct(s["id"].alias("id"), F.when(first, F.get(F.col("_parts"), s["slot"])).otherwise("").alias("text"))

    return kept.select(*keys, F.explode(F.transform("slots", change)).alias("_change")).select(*keys, "_change.id", "_change.text")
