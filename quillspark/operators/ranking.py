"""Explainable relevance ranking: keyword scores, batch calibration, tiers; vault search; venue board."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.functions import text as T
from quillspark.functions import times

TITLE, ABSTRACT, PHRASE, CATEGORY = 5, 2, 3, 8


def interest_scores(papers: DataFrame, keywords: list[str], categories: list[str], now_ms: int) -> DataFrame:
    """papers (title, summary, categories, published_ms, n_authors, ...) with raw, score (0 to 100), stars, matched, freshness."""
    title, summary = F.lower(F.coalesce("title", F.lit(""))), F.lower(F.coalesce("summary", F.lit("")))
    raw, matched = F.lit(0), []
    for word in keywords:
        k = word.strip().lower()
        if not k:
            continue
        own = F.when(F.contains(title, F.lit(k)), TITLE).otherwise(0) + F.when(F.contains(summary, F.lit(k)), ABSTRACT).otherwise(0)
        if " " in k:
            own = own + F.when(own > 0, PHRASE).otherwise(0)
        raw = raw + own
        matched.append(F.when(own > 0, F.lit(word)))
    wanted = [w.lower() for w in categories if w]
    hit = F.lit(False)
    for w in wanted:
        hit = hit | _category(w)
    days = (F.lit(now_ms) - F.col("published_ms")) / F.lit(86_400_000.0)
    fresh = F.when(F.col("published_ms").isNull(), 0).when(days <= 1, 12).when(days <= 3, 8).when(days <= 7, 4).otherwise(0)
    raw = raw + F.when(hit, CATEGORY).otherwise(0) + fresh
    names = F.filter(F.array(*matched), lambda x: x.isNotNull()) if matched else F.array().cast("array<string>")
    if keywords:
        full = F.least(F.lit(100), F.floor(raw * 4.2 + 0.5))
        score = F.when((F.size(names) == 0) & (raw > 0), F.least(F.lit(45), full)).otherwise(full)
    else:
        score = F.least(F.lit(55), 15 + raw * 2 + F.when(hit, 5).otherwise(0) + F.least(F.lit(10), F.coalesce("n_authors", F.lit(0))))
    out = papers.withColumns({"raw": raw.cast("int"), "score": score.cast("int"), "matched": names, "freshness_days": F.greatest(F.lit(0.0), days)})
    s = F.col("score")
    return out.withColumn("stars", F.when(s >= 80, 5).when(s >= 65, 4).when(s >= 45, 3).when(s >= 25, 2).when(s > 0, 1).otherwise(0))


def _category(w: str) -> Column:
    return F.exists("categories", lambda c: (F.lower(c) == w) | F.startswith(F.lower(c), F.lit(w + ".")) | ((c != "") & F.startswith(F.lit(w), F.lower(c))))


def first_of_each(rows: DataFrame, key: str, order: str = "ord") -> DataFrame:
    """The first row of each key; rows without one go."""
    kept = rows.filter(F.coalesce(F.col(key).cast("string"), F.lit("")) != "")
    return kept.groupBy(key).agg(F.min_by(F.struct(*rows.columns), order).alias("r")).select("r.*")


def calibrated(rows: DataFrame, order: str = "ord") -> DataFrame:
    """score stretched to 12 to 100 over the batch, score_raw kept; equal scores become 40, 39, ... (at least 1) by order.

    The extremes are one row. Equal scores are told apart only where all are equal, and only the first 40 differ.
    """
    ends = rows.agg(F.min("score").alias("_min"), F.max("score").alias("_max"), F.count("*").alias("_n"))
    both = rows.crossJoin(F.broadcast(ends))
    stretched = F.floor(12 + (F.col("score") - F.col("_min")) / (F.col("_max") - F.col("_min")) * 88 + 0.5)
    # of the first 40 rows, when all are equal
    head = rows.orderBy(order).limit(40).select(F.col(order).alias("_o")).withColumn("_i", F.row_number().over(Window.orderBy("_o")) - 1)
    out = both.join(F.broadcast(head), F.col(order) == F.col("_o"), "left")
    new = F.when(F.col("_n") < 2, F.col("score")).when(F.col("_max") <= F.col("_min"), F.greatest(F.lit(1), 40 - F.coalesce("_i", F.lit(39)))).otherwise(stretched)
    return out.withColumns({"score_raw": F.col("score"), "score": new.cast("int")}).drop("_min", "_max", "_n", "_o", "_i")


def tiered(rows: DataFrame) -> DataFrame:
    s = F.col("score")
    return rows.withColumn("tier", F.when(s >= 70, "must").when(s >= 45, "skim").otherwise("browse"))


def ranked(papers: DataFrame, keywords: list[str], categories: list[str], seen: DataFrame, now_ms: int, k: int) -> DataFrame:
    """The k best: papers not in seen (column id) first, then by calibrated score and date; tier and rank from 1."""
    own = first_of_each(papers, "id")
    scored = calibrated(interest_scores(own, keywords, categories, now_ms))
    flagged = scored.join(seen.select("id", F.lit(True).alias("_seen")).distinct(), "id", "left").withColumn("is_new", F.col("_seen").isNull()).drop("_seen")
    order = [F.col("is_new").desc(), F.col("score").desc(), F.col("published").desc(), F.col("ord")]
    top = flagged.orderBy(*order).limit(k)
    return tiered(top).withColumn("rank", F.row_number().over(Window.orderBy(*order)))


def mobile_scores(papers: DataFrame, keywords: list[str]) -> DataFrame:
    """Base 8; +8 for each keyword in the title, else +3 for one in the abstract."""
    title, summary = F.lower(F.coalesce("title", F.lit(""))), F.lower(F.coalesce("summary", F.lit("")))
    score = F.lit(8)
    for k in (w.strip().lower() for w in keywords):
        if k:
            score = score + F.when(F.contains(title, F.lit(k)), 8).when(F.contains(summary, F.lit(k)), 3).otherwise(0)
    return papers.withColumn("mobile_score", score)


def vault_search(notes: DataFrame, query: str, k: int = 8) -> DataFrame:
    """notes (name, text, mtime, ...) whose name or text holds a term of the query: score, by score and age; at most k (1 to 20)."""
    terms = [t for t in query.lower().split() if len(t) >= 2]
    name, text = F.lower(F.coalesce("name", F.lit(""))), F.lower(F.coalesce("text", F.lit("")))
    score = F.lit(0)
    for t in terms:
        score = score + F.when(F.contains(name, F.lit(t)), 5).otherwise(0) + F.least(F.lit(10), T.occurrences(text, t))
    hits = notes.withColumn("score", score).filter(F.col("score") > 0)
    return hits.orderBy(F.col("score").desc(), F.col("mtime").desc()).limit(min(20, max(1, k)))


def snippets(text: str | None, query: str, radius: int = 160, most: int = 3) -> list[str]:
    """At most `most` stretches around the query's terms that don't overlap, white space squeezed."""
    hay = text or ""
    lower, out, used = hay.lower(), [], []
    for term in (t for t in query.lower().split() if len(t) >= 2):
        at = lower.find(term)
        while at >= 0 and len(out) < most:
            if not any(a <= at <= b for a, b in used):
                a, b = max(0, at - radius), min(len(hay), at + len(term) + radius)
                used.append((a, b))
                out.append(" ".join(hay[a:b].split()))
            at = lower.find(term, at + len(term))
    return out


def with_snippets(rows: DataFrame, query: str, radius: int = 160, most: int = 3) -> DataFrame:
    cut = F.pandas_udf(lambda s: s.map(lambda x: snippets(x, query, radius, most)), "array<string>")
    return rows.withColumn("snippets", cut("text"))


def venue_board(venues: DataFrame, now_ms: int) -> DataFrame:
    """venues (id, abbr, name, deadline) with their countdown; open ones by days, then those that passed, then undated ones."""
    out = venues.withColumn("countdown", times.deadline_countdown(F.col("deadline"), F.lit(now_ms)))
    state = F.when(F.col("countdown").isNull(), 2).when(F.col("countdown.passed"), 1).otherwise(0)
    return out.withColumn("state", state)
