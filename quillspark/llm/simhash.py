"""SimHash near-deduplication by meet-in-the-middle ball hashing.

Two 64-bit fingerprints differ in at most two bits if and only if some word lies within one bit of both. So every
distinct fingerprint emits the 65 words of its ball of radius one (half the linking radius), and the shuffle is on those
words. The fingerprints that meet at a word are the word with one bit turned, or the word itself: they are at most 65,
and a 64-bit mask and a flag hold them, which are combined before the shuffle. Each meeting fingerprint is linked to the
smallest one there, and the links are verified.

Components are the smallest fingerprints reachable over links, by label propagation with pointer jumping. Copies meet
as one fingerprint, so their number plays no part; no fingerprint has more than 64 + 2016 links. Each round's labels
are written to the shared folder.

Case rules: null and blank texts have fingerprint zero and are linked like any other; null doc_ids are kept, and the
component id is the smallest doc_id that isn't null (null if there is none); rows that are repeated are kept.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import text_key, written

SHINGLE = 3
BLANK = r"[\x20\x09-\x0D]+"
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def shingle_hashes(text: Column, n: int = SHINGLE) -> Column:
    """XXH64, seed 42, of each run of n words (fewer words: of them all), repeats included; none without words."""
    tokens = F.filter(F.split(F.translate(F.coalesce(text, F.lit("")), _UPPER, _UPPER.lower()), BLANK), lambda w: w != "")
    starts = lambda w: F.sequence(F.lit(0), F.greatest(F.size(w) - n, F.lit(0)))
    each = lambda w: F.transform(starts(w), lambda i: F.xxhash64(F.concat_ws(" ", *[F.get(w, i + k) for k in range(n)])))
    # the outer transform binds the words, which are then split once
    return F.get(F.transform(F.array(tokens), lambda w: F.when(F.size(w) > 0, each(w)).otherwise(F.array().cast("array<bigint>"))), 0)


def majority(hashes: np.ndarray) -> int:
    """The signed 64-bit word whose bits are set in over half the hashes."""
    if not len(hashes):
        return 0
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 4096):
        part = np.ascontiguousarray(hashes[at : at + 4096]).view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<i8")[0])


def _majorities(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lists = batch.column("hashes")
        values, offsets = lists.values.to_numpy(), lists.offsets.to_numpy()
        words = [majority(values[a:b]) for a, b in zip(offsets[:-1], offsets[1:])]
        columns = [c for c in batch.schema.names if c != "hashes"]
        yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in columns], pa.array(words, pa.int64())], names=[*columns, "fp"])


def fingerprints(docs: DataFrame, keep: list[str], n: int = SHINGLE) -> DataFrame:
    """The columns keep and fp, the fingerprint as a signed long."""
    rows = docs.select(*keep, shingle_hashes(F.col("text"), n).alias("hashes"))
    kind = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])
    return rows.mapInArrow(_majorities, f"{kind}, fp long")


def close_pairs(distinct: DataFrame) -> DataFrame:
    """a, b: links between fingerprints (column fp, distinct) at 1 or 2 differing bits, enough to connect all that are."""
    bit = lambda i: F.expr(f"shiftleft(1L, {i})")
    ball = distinct.select("fp", F.explode(F.sequence(F.lit(0), F.lit(64))).alias("i"))
    ball = ball.select(F.when(F.col("i") == 64, F.col("fp")).otherwise(F.col("fp").bitwiseXOR(bit("i"))).alias("word"), F.when(F.col("i") < 64, bit("i")).otherwise(F.lit(0).cast("long")).alias("turned"), (F.col("i") == 64).alias("itself"))
    met = ball.groupBy("word").agg(F.bit_or("turned").alias("turned"), F.bool_or("itself").alias("itself"))
    met = met.filter(F.bit_count("turned") + F.col("itself").cast("int") > 1)
    turned = F.transform(F.filter(F.sequence(F.lit(0), F.lit(63)), lambda i: F.get(F.split(F.lpad(F.bin("turned"), 64, "0"), ""), 63 - i) == "1"), lambda i: F.col("word").bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), i)))
    members = F.when(F.col("itself"), F.concat(turned, F.array("word"))).otherwise(turned)
    links = met.select(F.array_min(members).alias("b"), F.explode(members).alias("a")).filter("a != b")
    return links.filter(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= 2).distinct()


def components(links: DataFrame) -> DataFrame:
    """node, label: the smallest node reachable, for the nodes of links (a, b)."""
    both = written(links.select("a", "b").union(links.select("b", "a")), "links")
    labels = written(both.groupBy(F.col("a").alias("node")).agg(F.min(F.least("a", "b")).alias("label")), "labels")
    while True:
        heard = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("heard"))
        near = labels.join(heard, "node").select("node", "label", F.least("label", "heard").alias("near"))
        roots = labels.select(F.col("node").alias("near"), F.col("label").alias("root"))
        moved = near.join(roots, "near").select("node", F.least("near", "root").alias("label"), (F.least("near", "root") != F.col("label")).alias("changed"))
        moved = written(moved, "labels")
        labels = moved.select("node", "label")
        if moved.filter("changed").isEmpty():
            return labels


def components_of(fps: DataFrame) -> DataFrame:
    """fps (doc_id, fp) -> fp, component_id for each distinct fingerprint."""
    distinct = written(fps.groupBy("fp").agg(F.min("doc_id").alias("least")), "fingerprints")
    labels = components(close_pairs(distinct.select("fp"))).withColumnRenamed("node", "fp")
    labelled = distinct.join(labels, "fp", "left").select("fp", "least", F.coalesce("label", "fp").alias("label"))
    ids = labelled.groupBy("label").agg(F.min("least").alias("component_id"))
    return labelled.join(ids, "label").select("fp", "component_id")


def near_copies(docs: DataFrame, n: int = SHINGLE) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id for each row of docs (doc_id, text)."""
    fps = written(fingerprints(docs, ["doc_id"], n), "documents")
    found = fps.join(components_of(fps), "fp")
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def one_of_each(docs: DataFrame, n: int = SHINGLE) -> DataFrame:
    """The rows of docs, all columns, with the smallest doc_id of each component (one row where it is repeated)."""
    keyed = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), F.col("doc_id").alias("doc_id"), F.col("text").alias("text"), *text_key(F.col("text")))
    fps = written(fingerprints(keyed, ["doc_id", "key1", "key2"], n), "documents")
    found = fps.join(components_of(fps.select("doc_id", "fp")), "fp")
    kept = found.groupBy("component_id", F.when(F.col("component_id").isNull(), F.col("fp")).alias("alone"))
    kept = kept.agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key1", "key2")).alias("first")).select("first.*")
    same = (F.col("l.key1") == F.col("r.key1")) & (F.col("l.key2") == F.col("r.key2")) & F.col("l.doc_id").eqNullSafe(F.col("r.doc_id"))
    rows = keyed.alias("l").join(kept.alias("r"), same, "left_semi")
    return rows.dropDuplicates(["key1", "key2", "doc_id"]).select("row.*")
