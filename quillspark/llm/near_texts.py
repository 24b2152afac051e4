"""Near-duplicate texts: the links of SimHash, and every pair whose sets of five-word shingles have a Jaccard index of 0.8.

Candidates are texts that agree in a band of MinHash values: with BANDS bands of ROWS values a pair at 0.8 is missed
with a probability of about 7 in a million, one at 0.9 practically never. Each candidate pair's index is exact.

Pairs are not made group by group, for a group of n copies has n * n of them. First every member of a bucket is compared
with the bucket's smallest. Where a bucket then holds several components, the members outside its largest one meet two
members of it each, and the closest of all these is compared. Only where a bucket holds several components even then,
the members outside its largest one are compared with all members of other components; so each pair of a bucket is
compared or connected already. Pairs whose sketches of parities differ in too many bits can't be close and are left out
(these bits are no more than the shingles in which two sets differ, see jaccard_join).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.llm import jaccard_join, simhash
from quillspark.llm.common import bound, text_key, word_shingle_hashes, words, written

BANDS, ROWS = 30, 5
#: The index that links, in hundredths.
CLOSE = 80

_SKETCH = jaccard_join.SKETCH


def _shingles(text: Column) -> Column:
    return bound(words(text), lambda w: word_shingle_hashes(w))


def _banded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rng = np.random.default_rng(5)
    turn = rng.integers(0, 2**64, BANDS * ROWS, np.uint64)
    factor = rng.integers(0, 2**64, BANDS * ROWS, np.uint64) | np.uint64(1)
    for batch in batches:
        lists = batch.column("shingles")
        values, offsets = lists.values.to_numpy().view(np.uint64), lists.offsets.to_numpy()
        sizes, bands, odd = [], [], []
        for a, b in zip(offsets[:-1], offsets[1:]):
            own = np.unique(values[a:b])
            low = np.full(BANDS * ROWS, 2**64 - 1, np.uint64)
            for at in range(0, len(own), 256):
                low = np.minimum(low, ((own[at : at + 256, None] ^ turn) * factor).min(0))
            sizes.append(len(own))
            odd.append(jaccard_join.parities(own))
            bands.append([xxhash.xxh64_intdigest(x.tobytes(), i) for i, x in enumerate(low.reshape(BANDS, ROWS))])
        flat = pa.array(np.array(bands, np.uint64).view(np.int64).ravel(), pa.int64())
        held = pa.ListArray.from_arrays(pa.array(np.arange(len(sizes) + 1) * BANDS, pa.int32()), flat)
        odd = np.array(odd, np.int64).reshape(-1, len(_SKETCH))
        columns = [batch.column("key1"), batch.column("key2"), pa.array(sizes, pa.int32()), held, *[pa.array(x) for x in odd.T]]
        yield pa.RecordBatch.from_arrays(columns, names=["key1", "key2", "size", "bands", *_SKETCH])


def _may_be_close(a: Column, b: Column) -> Column:
    """Whether sets of these sizes can have an index of 0.8."""
    return 10 * F.least(a, b) >= 8 * F.greatest(a, b)


def close_links(texts: DataFrame, pairs: DataFrame) -> DataFrame:
    """The pairs (a, b: nodes) whose index is 0.8 or more. texts: key1, key2, text."""
    pairs = written(pairs.distinct(), "pairs")
    asked = written(pairs.select("a.*").union(pairs.select("b.*")).distinct(), "asked")
    sets = texts.join(asked, ["key1", "key2"]).dropDuplicates(["key1", "key2"])
    sets = written(sets.select(F.struct("key1", "key2").alias("node"), F.array_distinct(_shingles(F.col("text"))).alias("held")), "sets")
    both = pairs.join(sets.toDF("b", "held_b"), "b").join(sets.toDF("a", "held_a"), "a")
    both = both.select("a", "b", F.size("held_a").alias("n_a"), F.size("held_b").alias("n_b"), F.size(F.array_intersect("held_a", "held_b")).alias("n"))
    return written(both.filter(10 * F.col("n") >= 8 * (F.col("n_a") + F.col("n_b") - F.col("n"))).select("a", "b"), "close")


def components_of_texts(texts: DataFrame, links: DataFrame) -> DataFrame:
    """node, label for the nodes of links (a, b: nodes) and of close pairs. texts: key1, key2, text, each text once or more."""
    banded = texts.select("key1", "key2", _shingles(F.col("text")).alias("shingles")).filter(F.size("shingles") > 0)
    banded = written(banded.mapInArrow(_banded, "key1 long, key2 long, size int, bands array<bigint>, " + ", ".join(f"{x} long" for x in _SKETCH)).dropDuplicates(["key1", "key2"]), "bands")
    members = banded.select(F.struct("key1", "key2").alias("node"), "size", F.explode("bands").alias("bucket"))
    centres = members.groupBy("bucket").agg(F.count("*").alias("n"), F.min(F.struct("node", "size")).alias("first")).filter("n > 1")
    centres = written(centres.select("bucket", F.col("first.node").alias("centre"), F.col("first.size").alias("centre_size")), "centres")
    members = written(members.join(centres, "bucket"), "members")
    first = members.filter((F.col("node") != F.col("centre")) & _may_be_close(F.col("size"), F.col("centre_size")))
    first = written(first.select(F.col("node").alias("a"), F.col("centre").alias("b")).distinct(), "first-pairs")
    links = written(links.select("a", "b").union(close_links(texts, first)), "all-links")
    labels = simhash.components(links)

    # buckets that still hold several components
    sketches = banded.select(F.struct("key1", "key2").alias("node"), F.struct(F.col("size").cast("long").alias("n"), *_SKETCH).alias("of"))
    labelled = jaccard_join.labelled_again(members.select("bucket", "node").join(sketches, "node"), labels)
    mixed = jaccard_join.mixed_components(labelled, "bucket")
    known = first.union(first.select("b", "a"))
    near = written(jaccard_join.closest(jaccard_join.beside(mixed, "bucket", CLOSE).join(known, ["a", "b"], "left_anti")), "near")
    if not near.isEmpty():
        links = written(links.union(close_links(texts, near)), "all-links")
        labels = simhash.components(links)
        known = known.union(near).union(near.select("b", "a"))
        mixed = jaccard_join.mixed_components(jaccard_join.labelled_again(mixed, labels), "bucket")
    met = jaccard_join.across(mixed, "bucket", CLOSE).select("a", "b")
    more = close_links(texts, met.join(known, ["a", "b"], "left_anti"))
    return labels if more.isEmpty() else simhash.components(links.union(more))


def one_of_each(docs: DataFrame) -> DataFrame:
    """The rows of docs, all columns, with the smallest doc_id of each group of near-duplicate texts (one row where it is repeated)."""
    keyed = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), F.col("doc_id").alias("doc_id"), F.col("text").alias("text"), *text_key(F.col("text")))
    fps = written(simhash.fingerprints(keyed, ["doc_id", "key1", "key2"]), "documents")
    alike = simhash.components(simhash.close_pairs(written(fps.select("fp").distinct(), "fingerprints"))).withColumnRenamed("node", "fp")
    labelled = written(fps.select("key1", "key2", "fp").distinct().join(alike, "fp", "left").select(F.struct("key1", "key2").alias("a"), F.coalesce("label", "fp").alias("group")), "texts")
    first = written(labelled.groupBy("group").agg(F.count("*").alias("n"), F.min("a").alias("b")).filter("n > 1").select("group", "b"), "first-texts")
    links = labelled.join(first, "group").filter("a != b").select("a", "b")
    labels = written(components_of_texts(keyed.select("key1", "key2", "text"), links).select("node.*", "label"), "text-labels")
    found = fps.join(labels, ["key1", "key2"], "left").groupBy(F.coalesce("label", F.struct("key1", "key2")).alias("label"))
    kept = found.agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key1", "key2")).alias("first")).select("first.*")
    same = (F.col("l.key1") == F.col("r.key1")) & (F.col("l.key2") == F.col("r.key2")) & F.col("l.doc_id").eqNullSafe(F.col("r.doc_id"))
    rows = keyed.alias("l").join(kept.alias("r"), same, "left_semi")
    return rows.dropDuplicates(["key1", "key2", "doc_id"]).select("row.*")
