"""Document fingerprints by closed syncmers over words.

A k-mer is a run of K words, its inner substrings are its runs of S words. It is a closed syncmer, and so an anchor, if
the inner substring with the smallest hash stands first or last in it. Whether a k-mer is an anchor depends on its
own words only, so an edit elsewhere neither adds nor moves anchors: they can be matched between two texts
and their positions lined up (matched_positions). On average 2 in K - S + 1 k-mers are anchors. An anchor's hash has 64 bits.

Case rules: a null text counts as empty and has no anchors; a text of under K words has an anchor for each word;
two texts without anchors are alike if both are empty. Equal texts have equal fingerprints.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.llm.common import bound, once, partitions

K = 5
S = 2
BLANK = r"[\x20\x09-\x0D]+"


def word_hashes(text: Column) -> Column:
    parts = F.filter(F.split(F.coalesce(text, F.lit("")), BLANK), lambda w: w != "")
    return F.transform(parts, lambda w: F.xxhash64(w))


def anchors(hashes: Column, k: int = K, s: int = S) -> Column:
    """array<struct<position int, hash bigint>> of the closed syncmers over word hashes, in order."""
    last = k - s

    def inner(h: Column) -> Column:
        if s == 1:
            return h
        return F.when(F.size(h) >= s, F.transform(F.sequence(F.lit(0), F.size(h) - s), lambda i: F.xxhash64(*[F.get(h, i + j) for j in range(s)])))

    def edge(low: Column, i: Column) -> Column:
        within = [F.get(low, i + j) for j in range(1, last)]
        if not within:
            return F.lit(True)
        return F.least(F.get(low, i), F.get(low, i + last)) <= (F.least(*within) if len(within) > 1 else within[0])

    def found(h: Column) -> Column:
        at = bound(inner(h), lambda low: F.filter(F.sequence(F.lit(0), F.size(h) - k), lambda i: edge(low, i)))
        return F.transform(at, lambda i: F.struct(i.alias("position"), F.xxhash64(*[F.get(h, i + j) for j in range(k)]).alias("hash")))

    def short(h: Column) -> Column:
        return F.transform(h, lambda x, i: F.struct(i.alias("position"), F.xxhash64(x).alias("hash")))

    return bound(hashes, lambda h: F.when(F.size(h) >= k, found(h)).otherwise(short(h)))


def fingerprint(found: Column) -> Column:
    """The anchors' hashes in order, 16 hex digits each."""
    return F.lower(F.array_join(F.transform(found, lambda a: F.lpad(F.hex(a["hash"]), 16, "0")), ""))


def likeness(a: Column, b: Column) -> Column:
    """Share of the distinct anchors of two texts that both have, 0 to 1 (Dice)."""
    x, y = F.array_distinct(a["hash"]), F.array_distinct(b["hash"])
    both = F.size(x) + F.size(y)
    return F.when(both > 0, 2.0 * F.size(F.array_intersect(x, y)) / both).otherwise(F.lit(1.0))


def matched_positions(a: DataFrame, b: DataFrame) -> DataFrame:
    """Anchors of documents in a (id, text) that stand in documents in b (id, text): a_id, b_id, offset (of b's position
    against a's), matches. Many matches at one offset are a shared passage."""
    spread = lambda df, name: df.select(F.col("id").alias(f"{name}_id"), F.explode(anchors(word_hashes(F.col("text")))).alias("x")).select(f"{name}_id", F.col("x.hash").alias("hash"), F.col("x.position").alias(f"{name}_at"))
    met = spread(a, "a").join(spread(b, "b"), "hash")
    return met.groupBy("a_id", "b_id", (F.col("b_at") - F.col("a_at")).alias("offset")).agg(F.count("*").alias("matches"))


def _constant(values: list[int | None]) -> Column:
    """An array that is one literal of the plan, however long it is."""
    return F.from_json(F.lit(json.dumps(values)), "array<bigint>")


def _block_of(doc_id: Column, cuts: list[int]) -> Column:
    """How many of the sorted cuts are at most doc_id, by halving."""
    if not cuts:
        return F.lit(0)
    known = _constant(cuts)
    halves = F.sequence(F.lit(1), F.lit(len(cuts).bit_length()))
    narrowed = lambda x, mid: F.when(F.get(known, mid) <= doc_id, F.struct((mid + 1).alias("low"), x["high"].alias("high"))).otherwise(F.struct(x["low"].alias("low"), mid.alias("high")))
    step = lambda x, _: F.when(x["low"] < x["high"], narrowed(x, ((x["low"] + x["high"]) / 2).cast("int"))).otherwise(x)
    return F.aggregate(halves, F.struct(F.lit(0).alias("low"), F.lit(len(cuts)).alias("high")), step, lambda x: x["low"])


def with_next(docs: DataFrame) -> DataFrame:
    """doc_id, text, block and order columns such that in each block, by desc doc_id, every row is followed by its next one.

    doc_ids are cut into ranges of about equal row counts. Each range also gets the first row of the range below
    it (the lowest range: the very first row), marked as a guest. The ranges' cuts and first ids are two literals of the plan.
    """
    spark = docs.sparkSession
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    parts = 4 * partitions(spark)
    share = [i / parts for i in range(1, parts)]
    cuts = sorted(set(rows.agg(F.percentile_approx("doc_id", share, 20 * parts).alias("q")).first()["q"] or []))
    # rows without an id come last: they are block 0
    rows = once(rows, "block", F.when(F.col("doc_id").isNull(), F.lit(0)).otherwise(_block_of(F.col("doc_id"), cuts) + 1))
    # one row for each block
    tops = {r["block"]: r["top"] for r in rows.groupBy("block").agg(F.max("doc_id").alias("top")).collect()}
    order = sorted(tops)
    rows = rows.withColumns({"guest": F.lit(False), "wrapped": F.lit(False)})
    if not order:
        return rows
    size = order[-1] + 1
    above: list[int | None] = [None] * size
    for i, b in enumerate(order):
        above[b] = order[(i + 1) % len(order)]
    first = F.col("doc_id").eqNullSafe(F.get(_constant([tops.get(b) for b in range(size)]), F.col("block")))
    guests = rows.filter(first).select("doc_id", "text", F.get(_constant(above), F.col("block")).cast("int").alias("block"), F.lit(True).alias("guest"), (F.col("block") == order[-1]).alias("wrapped"))
    return rows.unionByName(guests)


def edited_fingerprints(docs: DataFrame, k: int = K, s: int = S) -> DataFrame:
    """docs (doc_id, text) -> doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The edited text is the text whose last floor(n_chars / 2) characters give way to the first as many of the next
    document by descending doc_id. Rows with the same doc_id follow one another in the order of their texts' hashes.
    """
    placed = with_next(docs)
    placed = once(placed.repartition(partitions(docs.sparkSession) * 2, "block"), "found", anchors(word_hashes(F.col("text")), k, s))
    order = Window.partitionBy("block").orderBy(F.col("wrapped"), F.col("guest"), F.col("doc_id").desc_nulls_last(), F.xxhash64("text"))
    placed = placed.withColumns({"next_text": F.lead("text").over(order), "next_found": F.lead("found").over(order)}).filter(~F.col("guest"))
    n = F.char_length("text")
    half = F.floor(n / 2).cast("int")
    out = placed.select("doc_id", "found", "next_found", n.cast("long").alias("n_chars"), F.concat(F.left("text", n - half), F.left("next_text", half)).alias("edited"))
    out = once(once(out, "edited_text", F.col("edited")), "edited_found", anchors(word_hashes(F.col("edited_text")), k, s))
    return out.select(
        "doc_id",
        "n_chars",
        F.sha2(F.encode("edited_text", "UTF-8"), 256).alias("edited_sha256"),
        fingerprint(F.col("found")).alias("fingerprint"),
        fingerprint(F.col("edited_found")).alias("edited_fingerprint"),
        likeness(F.col("found"), F.col("edited_found")).alias("near_edited"),
        likeness(F.col("found"), F.col("next_found")).alias("near_next"),
    )
