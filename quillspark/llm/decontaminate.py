"""Benchmark decontamination: test items that stand inside documents, found by containment search.

A document may be a thousand times as long as an item, so their Jaccard similarity says nothing; what counts is the
containment of the item's word shingles in the document's. The items are partitioned by size (powers of two of
their shingle counts). Each partition has a sketch size k: an item is represented by its k smallest shingle hashes
(its bottom-k MinHash). k = u - ceil(threshold * u) + 1 for the partition's largest count u, so a document that
contains at least the threshold of an item's shingles cannot miss all k of them: the sketches lose no match. A
document that holds an element of a sketch is a candidate for that item and is verified by the exact containment
of the shingles themselves.

Documents stream past the sketches and are neither shuffled nor sorted; only candidate pairs are. Up to
SKETCH_LIMIT sketch elements travel with the plan, two numbers each; a larger benchmark is joined by shingle hash instead.

Case rules: texts with under SHINGLE_WORDS words have one shingle of all their words; null and blank texts have none
and match nothing; an item_id or doc_id on several rows counts once, with its best containment; null ids are kept
as an id of their own; other columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import SHINGLE_WORDS, SIMILARITY, once, text_key, word_shingle_hashes, word_shingles, words

SKETCH_LIMIT = 20_000


def sketch_size(count: int, threshold: float) -> int:
    """k of the size partition that an item of count shingles falls into."""
    upper = 1 << max(0, (count - 1).bit_length())
    return min(count, upper - math.ceil(threshold * upper - 1e-9) + 1)


def _sketch(threshold: float) -> Column:
    """The same as sketch_size, over the column hashes, which is sorted."""
    upper = F.pow(F.lit(2), F.ceil(F.log2(F.size("hashes").cast("double")))).cast("int")
    return F.slice("hashes", F.lit(1), F.least(F.size("hashes"), upper - F.ceil(upper * threshold - 1e-9).cast("int") + 1))


def item_sketches(items: DataFrame, threshold: float, n: int) -> DataFrame:
    """item_id, shingles, sketch of each item that has a word."""
    tokens = once(items.select("item_id", "text"), "tokens", words(F.col("text"))).filter(F.size("tokens") > 0)
    hashed = tokens.select("item_id", word_shingles(F.col("tokens"), n).alias("shingles"), F.array_sort(F.array_distinct(word_shingle_hashes(F.col("tokens"), n))).alias("hashes"))
    return hashed.select("item_id", "shingles", _sketch(threshold).alias("sketch"))


def contained_items(docs: DataFrame, items: DataFrame, threshold: float = SIMILARITY, n: int = SHINGLE_WORDS) -> DataFrame:
    """doc_id, item_id, n_shingles (distinct, of the item), n_shared, containment >= threshold; one row for each pair."""
    sketches = item_sketches(items, threshold, n)
    elements = sketches.select("item_id", F.explode("sketch").alias("element")).distinct()
    few = [r[0] for r in elements.select("element").distinct().limit(SKETCH_LIMIT + 1).collect()]
    tokens = once(docs.select("doc_id", "text"), "tokens", words(F.col("text"))).select("doc_id", "tokens")
    hashes = word_shingle_hashes(F.col("tokens"), n)
    if len(few) <= SKETCH_LIMIT:
        # one constant set, which every shingle is looked up in
        found = F.array_distinct(F.filter(hashes, lambda h: h.isin(few) if few else F.lit(False)))
        hit = once(tokens, "found", found).filter(F.size("found") > 0)
        # two numbers for each element of a sketch; the items' shingles come to candidates only
        near = hit.select("doc_id", "tokens", F.explode("found").alias("element")).join(F.broadcast(elements), "element").select("doc_id", "tokens", "item_id").distinct()
    else:
        # keys and hashes are shuffled; texts come to candidates only
        keyed = docs.select("doc_id", "text", *text_key(F.col("text")))
        once_each = once(keyed.dropDuplicates(["key1", "key2"]), "tokens", words(F.col("text")))
        probes = once_each.select("key1", "key2", F.explode(F.array_distinct(word_shingle_hashes(F.col("tokens"), n))).alias("element"))
        met = probes.join(elements, "element").select("key1", "key2", "item_id").distinct()
        near = keyed.join(met, ["key1", "key2"]).select("doc_id", words(F.col("text")).alias("tokens"), "item_id")
    pairs = near.join(sketches.select(F.col("item_id").alias("own_id"), "shingles"), F.col("item_id").eqNullSafe(F.col("own_id")))
    shared = F.size(F.array_intersect(word_shingles(F.col("tokens"), n), "shingles"))
    pairs = pairs.select("doc_id", "item_id", F.size("shingles").alias("n_shingles"), shared.alias("n_shared"))
    pairs = pairs.withColumn("containment", F.col("n_shared") / F.col("n_shingles")).filter(F.col("containment") >= threshold - 1e-9)
    best = pairs.groupBy("doc_id", "item_id").agg(F.max(F.struct("containment", "n_shared", "n_shingles")).alias("best"))
    return best.select("doc_id", "item_id", F.col("best.n_shingles").alias("n_shingles"), F.col("best.n_shared").alias("n_shared"), F.col("best.containment").alias("containment"))


def without_leaks(docs: DataFrame, items: DataFrame, threshold: float = SIMILARITY, n: int = SHINGLE_WORDS) -> DataFrame:
    """The rows of docs, with all their columns, whose text contains no item."""
    named = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), F.xxhash64("text").alias("doc_id"), F.col("text").alias("text"))
    leaks = contained_items(named, items, threshold, n).select(F.col("doc_id")).distinct()
    return named.join(leaks, "doc_id", "left_anti").select("row.*")
