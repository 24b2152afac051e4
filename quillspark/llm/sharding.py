"""Contiguous shards of near equal byte size, cut at equal targets of global prefix sums.

Rows are put in an order by a range shuffle and each partition is written with its number. The partitions' byte
totals, one row each, are summed up on the driver; every partition then knows where it begins and adds its own rows.
A shard is the stretch between two targets.

Equal texts stay in one shard: their rows stand together, at the smallest doc_id of the group, and a group goes where
its middle byte lies. A group with over 1 / LARGE of a shard's bytes (there are at most shards * LARGE) would push
others aside there, so large groups come first: each goes to the shard with least so far, and the targets of the rest are
set so that all shards fill up evenly.

Case rules: a null text has no bytes and equals the empty one; null doc_ids come first; repeated rows are kept; other
columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillspark.llm.common import partitions, text_key, written

LARGE = 100


def fill_levels(filled: list[int], rest: int) -> list[float]:
    """Bytes that each shard takes of rest so that the fullest of those that take any is as empty as possible."""
    order = sorted(range(len(filled)), key=filled.__getitem__)
    level = 0.0
    for n in range(1, len(order) + 1):
        level = (sum(filled[s] for s in order[:n]) + rest) / n
        if n == len(order) or level <= filled[order[n]]:
            break
    return [max(0.0, level - x) for x in filled]


def _group_starts(starts: dict[int, int], carried: dict[int, int]):
    """Adds group_start, the bytes before the first row of a row's group, to the rows of a partition.

    starts: the bytes before a partition. carried: before the group that its first row belongs to.
    """

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("row")
        part, size, place = rows["part"].iat[0], rows["size"].to_numpy(), rows["place"].to_numpy()
        begins = starts[part] + np.cumsum(size) - size
        first = np.flatnonzero(np.concatenate(([True], place[1:] != place[:-1])))
        heads = begins[first]
        heads[0] = carried[part]
        return rows.assign(group_start=np.repeat(heads, np.diff(np.append(first, len(rows)))))[_SUMMED]

    return run


_SUMMED = ["doc_id", "size", "text_crc32", "part", "row", "group_bytes", "group_start"]


def shard_by_bytes(docs: DataFrame, shards: int = 8) -> DataFrame:
    """docs (doc_id, text) -> doc_id, size, text_crc32, shard, slot."""
    n_parts = partitions(docs.sparkSession)
    text = F.encode(F.coalesce("text", F.lit("")), "UTF-8")
    rows = docs.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), *text_key(F.col("text")))
    rows = written(rows, "sizes")
    total = rows.agg(F.sum("size")).first()[0] or 0
    groups = rows.groupBy("key1", "key2").agg(F.count("*").alias("copies"), F.sum("size").alias("group_bytes"), F.min(F.struct(F.col("doc_id").isNotNull().alias("some"), "doc_id")).alias("first"))
    groups = groups.filter("copies > 1").withColumn("large", F.col("group_bytes") * shards * LARGE > total)
    groups = written(groups, "groups")
    # at most shards * LARGE rows
    large = sorted(((r["group_bytes"], r["key1"], r["key2"]) for r in groups.filter("large").collect()), reverse=True)
    filled, home = [0] * shards, {}
    for size, k1, k2 in large:
        least = min(range(shards), key=lambda s: (filled[s], s))
        filled[least] += size
        home[k1, k2] = least
    homes = docs.sparkSession.createDataFrame([(k1, k2, s) for (k1, k2), s in home.items()], "key1 long, key2 long, home int")
    small = groups.filter("not large").select("key1", "key2", "first", "group_bytes")

    alike = rows.join(small, ["key1", "key2"], "left").join(F.broadcast(homes), ["key1", "key2"], "left")
    placed = alike.select("doc_id", "size", "text_crc32", "home", F.coalesce("group_bytes", "size").alias("group_bytes"), F.coalesce("first.doc_id", F.when(F.col("first").isNull(), F.col("doc_id"))).alias("lead"), "key1")
    order = [F.col("home").asc_nulls_last(), F.col("lead").asc_nulls_first(), F.col("key1"), F.col("doc_id").asc_nulls_first()]
    placed = placed.repartitionByRange(n_parts, *order).sortWithinPartitions(*order)
    place = F.concat_ws(":", F.coalesce(F.col("home").cast("string"), F.lit("")), F.coalesce(F.col("lead").cast("string"), F.lit("")), F.col("key1").cast("string"))
    placed = placed.select("doc_id", "size", "text_crc32", "home", "group_bytes", place.alias("place"), F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("row"))
    placed = written(placed, "placed")

    rest = placed.filter("home is null")
    # one row for each partition
    parts = rest.groupBy("part").agg(F.sum("size").alias("bytes"), F.min_by("place", "row").alias("first"), F.max_by("place", "row").alias("last")).orderBy("part").collect()
    tails = rest.join(F.broadcast(docs.sparkSession.createDataFrame([(r["part"], r["last"]) for r in parts], "part int, place string")), ["part", "place"]).groupBy("part").agg(F.sum("size").alias("bytes"))
    tail = {r["part"]: r["bytes"] for r in tails.collect()}
    starts, carried, at, open_place, open_at = {}, {}, 0, None, 0
    for r in parts:
        starts[r["part"]] = at
        carried[r["part"]] = open_at if r["first"] == open_place else at
        at += r["bytes"]
        if r["last"] != r["first"] or r["first"] != open_place:
            open_at = at - tail[r["part"]]
        open_place = r["last"]
    cuts = np.cumsum(fill_levels(filled, at))[:-1].tolist()

    kind = "doc_id {}, size long, text_crc32 long, part int, row long, group_bytes long, group_start long".format(placed.schema["doc_id"].dataType.simpleString())
    summed = rest.groupBy("part").applyInPandas(_group_starts(starts, carried), kind)
    middle = F.col("group_start") + F.col("group_bytes") / 2
    shard = F.lit(0)
    for c in cuts:
        shard = shard + (middle >= c).cast("int")
    cut = summed.select("doc_id", "size", "text_crc32", "part", "row", shard.alias("shard"))
    first = placed.filter("home is not null").select("doc_id", "size", "text_crc32", "part", "row", F.col("home").alias("shard"))
    out = written(first.unionByName(cut), "shards")

    # slots: the rows of a shard before a partition, then those before the row in it
    counts = out.groupBy("shard", "part").agg(F.count("*").alias("n")).collect()
    before, seen = [], {}
    for r in sorted(counts, key=lambda r: (r["shard"], r["part"])):
        before.append((r["shard"], r["part"], seen.get(r["shard"], 0)))
        seen[r["shard"]] = seen.get(r["shard"], 0) + r["n"]
    before = docs.sparkSession.createDataFrame(before, "shard int, part int, before long")
    own = F.row_number().over(Window.partitionBy("shard", "part").orderBy("row")) - 1
    return out.withColumn("own", own).join(F.broadcast(before), ["shard", "part"]).select("doc_id", "size", "text_crc32", "shard", (F.col("own") + F.col("before")).cast("long").alias("slot"))
