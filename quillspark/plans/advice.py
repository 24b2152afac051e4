"""Differences of lines, skills, missing anchors and what is said of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.operators import gate as G
from quillspark.operators import revisions as V
from quillspark.plans import dialect as D
from quillspark.sources import tables


def line_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents, a sentence a line, against the same with some lines left out, changed and doubled; both texts are put together again from
    the changes."""
    docs = tables.read(spark, sf_dir, "documents").select("doc_id", F.split(F.coalesce("text", F.lit("")), r"\. ").alias("l"))
    changed = F.flatten(F.transform("l", lambda x, i: F.when((i + F.col("doc_id")) % 5 == 0, F.array().cast("array<string>")).when((i + F.col("doc_id")) % 7 == 0, F.array(x, F.concat(x, F.lit("!")))).otherwise(F.array(x))))
    out = V.line_diffs(docs.select("doc_id", F.array_join("l", "\n").alias("before"), F.array_join(changed, "\n").alias("after")))
    text = lambda *kinds: F.md5(F.encode(F.array_join(F.transform(F.filter("changes", lambda c: c["kind"].isin(*kinds)), lambda c: c["line"]), "\n"), "UTF-8"))
    return out.select("doc_id", text("same", "del").alias("before"), text("same", "add").alias("after"))


DIFF_SQL = """
    WITH a AS (SELECT doc_id, string_split(coalesce(text, ''), '. ') AS l FROM documents),
    b AS (SELECT doc_id, l, flatten(list_transform(l, lambda x, i: CASE WHEN (i - 1 + doc_id) % 5 = 0 THEN [] WHEN (i - 1 + doc_id) % 7 = 0 THEN [x, x || '!'] ELSE [x] END)) AS c FROM a)
    SELECT doc_id, md5(array_to_string(l, chr(10))) AS before, md5(array_to_string(c, chr(10))) AS after FROM b"""

QUERY = "brand#1 STEEL e large"


def skill_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as skills: brand, name and type are their names."""
    p = tables.read(spark, sf_dir, "part")
    skills = p.select(F.col("p_partkey").alias("ord"), F.col("p_brand").alias("id"), F.col("p_name").alias("label"), F.col("p_type").alias("short"), F.concat("p_type", F.lit(" "), "p_name").alias("title"), F.concat(F.lit("Explain "), "p_brand").alias("prompt"))
    return V.skills_found(skills, QUERY).select("ord", "score")


def _skill_sql() -> str:
    terms = []
    for t in QUERY.lower().split():
        terms.append(
            f"CASE WHEN id = '{t}' OR label = '{t}' OR short = '{t}' THEN {V.NAME_IS} ELSE 0 END + CASE WHEN starts_with(id, '{t}') OR starts_with(label, '{t}') OR starts_with(short, '{t}') THEN {V.NAME_BEGINS} ELSE 0 END"
            f" + CASE WHEN contains(label, '{t}') OR contains(short, '{t}') THEN {V.NAME_HAS} ELSE 0 END + CASE WHEN contains(title, '{t}') THEN {V.TITLE_HAS} ELSE 0 END + CASE WHEN contains(prompt, '{t}') THEN {V.PROMPT_HAS} ELSE 0 END"
        )
    return f"WITH s AS (SELECT p_partkey AS ord, lower(p_brand) AS id, lower(p_name) AS label, lower(p_type) AS short, lower(p_type || ' ' || p_name) AS title, lower('Explain ' || p_brand) AS prompt FROM part), r AS (SELECT ord, ({' + '.join(terms)})::INTEGER AS score FROM s) SELECT ord, score FROM r WHERE score > 0"


SKILLS = [("review", ["tion", "ing", "the review"]), ("compare", ["ore", "hea", "an"]), ("derive", ["ndre", "is", "proof"]), ("plan", ["ly", "plan"])]


def skill_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = tables.read(spark, sf_dir, "conversations")
    return t.select("conv_id", "turn", V.skill_for(F.col("text"), SKILLS).alias("skill"))


def _match_sql() -> str:
    points = [" + ".join(f"CASE WHEN contains(q, '{k}') THEN {V.LONG_POINTS if len(k) >= V.LONG_KEYWORD else V.SHORT_POINTS} ELSE 0 END" for k in keywords) for _, keywords in SKILLS]
    best = "greatest(" + ", ".join(f"p{i}" for i in range(len(SKILLS))) + ")"
    cases = " ".join(f"WHEN p{i} = {best} THEN '{name}'" for i, (name, _) in enumerate(SKILLS))
    return f"WITH a AS (SELECT conv_id, turn, lower(coalesce(text, '')) AS q FROM conversations), b AS (SELECT *, {', '.join(f'{p} AS p{i}' for i, p in enumerate(points))} FROM a) SELECT conv_id, turn, CASE WHEN {best} < {V.LEAST_POINTS} THEN NULL {cases} END AS skill FROM b"


# Pieces that documents' sources and outputs get, each by its own digits of a key.
SOURCE_ANCHORS = [["see [1]", "in [2, 3] and [4-6]", "as [12]", "none"], ["12.5 % of 3.14", "7% or 0.5", "2.50 and 1.5 × 10 3", "half"], ["BERT and GPT-2", "ResNet, ImageNet", "the CNN-LSTM of IEEE", "A U-Net in TABLE"]]
OUTPUT_ANCHORS = [["[1]", "[2,3]", "[12] [4 - 6]"], ["12.5%", "0.5 3.14", "1.5×10 3"], ["BERT", "GPT-2 ResNet", "CNN-LSTM"]]
_KINDS = {"citations": G.citation_anchors, "percentages": G.percent_anchors, "numbers": G.number_anchors, "terms": G.term_anchors}


def _anchored(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = tables.read(spark, sf_dir, "documents").select("doc_id", "text", (F.col("doc_id") * 7919 % 10_007).alias("k"))
    return docs.select("doc_id", F.concat(D.picked(SOURCE_ANCHORS, "k", False), F.lit(" "), F.coalesce("text", F.lit(""))).alias("source"), F.concat(D.picked(OUTPUT_ANCHORS, "k", False), F.lit(" "), F.substring("text", 200, 400)).alias("output"))


def anchor_losses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What of a source's anchors its output has, and which it lacks."""
    rows = _anchored(spark, sf_dir)
    # each is found once: expressions over it would find it again
    each = [F.struct(anchors(F.col("source")).alias("wanted"), anchors(F.coalesce("output", F.lit(""))).alias("found")).alias(kind) for kind, anchors in _KINDS.items()]
    rows = rows.select("doc_id", F.explode(F.array(F.struct(*each))).alias("a"))
    columns = []
    for kind in _KINDS:
        wanted, found = F.col(f"a.{kind}.wanted"), F.col(f"a.{kind}.found")
        columns += [F.round(G.coverage(wanted, found), 3).alias(kind), F.array_join(F.array_sort(F.array_except(wanted, found)), "|").alias(f"no_{kind}")]
    return rows.select("doc_id", *columns)


R_CITATION = r"\[(\d{1,3}(?:\s*[-–—,]\s*\d{1,3})*)\]"


def _anchor_sql(c: str, kind: str) -> str:
    matched = lambda p: f"regexp_extract_all({c}, '{p}', 1)"
    tight = lambda items: f"list_transform({items}, lambda x: regexp_replace(x, '\\s+', '', 'g'))"
    no_terms = ", ".join(f"'{w}'" for w in G.NO_TERMS)
    own = {
        "citations": f"list_transform({tight(matched(R_CITATION))}, lambda x: '[' || x || ']')",
        "percentages": tight(matched(r"\b(\d+(?:\.\d+)?\s*%)")),
        "numbers": f"list_concat({matched(r'\b(\d+\.\d+)\b')}, list_transform({tight(matched(r'(?i)\b(\d+(?:\.\d+)?\s*[×x]\s*10\s*[-−^]?\s*\d+)\b'))}, lambda x: replace(x, '−', '-')))",
        "terms": f"list_concat(list_filter({matched(r'\b([A-Z][A-Z0-9-]{1,11})\b')}, lambda x: upper(x) NOT IN ({no_terms})), {matched(r'\b([A-Z][A-Za-z0-9]*(?:Net|Set)|ImageNet|[A-Z]{2,}-\d+)\b')})",
    }[kind]
    return f"list_distinct({own})"


def _losses_sql() -> str:
    lists = ", ".join(f"{_anchor_sql('s', k)} AS w_{k}, {_anchor_sql('o', k)} AS f_{k}" for k in _KINDS)
    out = ", ".join(f"round(CASE WHEN len(w_{k}) = 0 THEN 1.0 ELSE len(list_intersect(w_{k}, f_{k}))::DOUBLE / len(w_{k}) END, 3) AS {k}, array_to_string(list_sort(list_filter(w_{k}, lambda x: NOT list_contains(f_{k}, x))), '|') AS no_{k}" for k in _KINDS)
    return f"""
        WITH k AS (SELECT doc_id, text, doc_id * 7919 % 10007 AS k FROM documents),
        a AS (SELECT doc_id, {D.one_line(D.picked(SOURCE_ANCHORS, 'k', True) + " || ' ' || coalesce(text, '')")} AS s, {D.one_line(D.picked(OUTPUT_ANCHORS, 'k', True) + " || ' ' || substr(text, 200, 400)")} AS o FROM k),
        b AS (SELECT doc_id, {lists} FROM a) SELECT doc_id, {out} FROM b"""


def quality_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as findings, with anchors that are missing."""
    e = tables.read(spark, sf_dir, "events")
    reasons = [*V.FINDINGS, "unheard-of"]
    reason = F.element_at(F.array(*[F.lit(r) for r in reasons]), (F.col("event_id") % len(reasons) + 1).cast("int"))
    missing = F.transform(F.sequence(F.lit(0), (F.col("user_id") % 9).cast("int")), lambda i: F.concat(F.lit(" a"), ((i * 2 + F.col("event_id")) % 8).cast("string")))
    return e.filter("user_id IS NOT NULL").select("event_id", V.finding(reason, F.when(F.col("event_id") % 6 == 0, F.array(F.lit(" "))).otherwise(missing)).alias("finding"))


def _findings_sql() -> str:
    labels = ", ".join(f"'{v}'" for v in [*V.FINDINGS.values(), V.OTHER_FINDING])
    n = len(V.FINDINGS) + 1
    return f"""
        WITH a AS (SELECT event_id, event_id % {n} AS r, CASE WHEN event_id % 6 = 0 THEN [] ELSE list_transform(range(0, user_id % 9 + 1), lambda i: 'a' || ((i * 2 + event_id) % 8)) END AS m FROM events WHERE user_id IS NOT NULL),
        b AS (SELECT *, list_filter(m, lambda x, i: list_position(m, x) = i) AS d, ([{labels}])[r + 1] AS l FROM a)
        SELECT event_id, CASE WHEN r < 4 AND len(d) > 0 THEN l || '：' || array_to_string(d[1:{V.SHOWN}], '、') || CASE WHEN len(d) > {V.SHOWN} THEN ' 等 ' || len(d) || ' 项' ELSE '' END ELSE l END AS finding FROM b"""


QUERIES = {
    "line_diff": (line_diff, DIFF_SQL),
    "skill_search": (skill_search, _skill_sql()),
    "skill_match": (skill_match, _match_sql()),
    "anchor_losses": (anchor_losses, _losses_sql()),
    "quality_findings": (quality_findings, _findings_sql()),
}
