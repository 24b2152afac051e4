"""Structured Streaming: daily activity, first-of-each records, and stateful decoders and timeouts by key.

State is a few numbers or the unfinished tail of a text for each request, so it is small and recovers from checkpoints.
Folds over a key's records are pure functions, which are tested without a stream.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

# Windows of the inactivity guard and of the heartbeat, in milliseconds.
FIRST_MS, IDLE_MS, HOLD_MS, HEARTBEAT_MS = 90_000, 45_000, 450_000, 15_000


def replay(spark: SparkSession, folder: str, table: str) -> DataFrame:
    """A table's files as a stream; a table is one file or a folder of files."""
    path = f"{folder}/{table}.parquet"
    found = spark.read.parquet(path)
    stream = spark.readStream.schema(found.schema)
    if any(f"/{table}.parquet/" in f for f in found.inputFiles()):
        return stream.parquet(path)
    return stream.option("pathGlobFilter", f"{table}.parquet").option("recursiveFileLookup", False).parquet(folder)


def finished(stream: DataFrame, path: str, mode: str = "append") -> DataFrame:
    """Runs a stream over what is there now and reads its result; path lies in a folder that all executors share."""
    spark = stream.sparkSession
    if mode == "append":
        query = stream.writeStream.format("parquet").option("checkpointLocation", f"{path}/state").option("path", f"{path}/rows").outputMode("append").trigger(availableNow=True).start()
    else:
        query = stream.writeStream.foreachBatch(lambda df, _: df.write.mode("overwrite").parquet(f"{path}/rows")).option("checkpointLocation", f"{path}/state").outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{path}/rows")


def daily_counts(events: DataFrame, late: str = "2 days") -> DataFrame:
    """events (ts, event_type, value) -> day, event_type, events, total. With a watermark old days leave the state in append and update mode; complete mode keeps all."""
    marked = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return marked.groupBy(F.window("ts", "1 day").alias("w"), "event_type").agg(F.count("*").alias("events"), F.sum("value").alias("total")).select(F.to_date("w.start").alias("day"), "event_type", "events", F.round("total", 4).alias("total"))


def first_records(events: DataFrame, keys: list[str], late: str = "30 days") -> DataFrame:
    """The keys that occur, each once."""
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).select(*keys, "ts").dropDuplicatesWithinWatermark(keys).select(*keys)


# ---- inactivity guard --------------------------------------------------------------------------------------------------


def guard(state: tuple[int, int, int], events: list[tuple[int, str]]) -> tuple[tuple[int, int, int], list[int]]:
    """Advances a request's guard over (ms, event) in order; returns its state and the times at which it ran out.

    State: (deadline, has output begun, is it over). bump keeps a request alive, output begins the idle window, hold stops
    the clock for HOLD_MS at most, done ends the guard. A guard runs out once.
    """
    deadline, output, over = state
    fired = []
    for at, event in events:
        if over:
            break
        if deadline and at > deadline:
            fired.append(deadline)
            over = 1
            break
        if event == "done":
            over = 1
        elif event == "hold":
            deadline = at + HOLD_MS
        else:
            output = output or int(event == "output")
            deadline = at + (IDLE_MS if output else FIRST_MS)
    return (deadline, output, over), fired


def inactive_requests(events: DataFrame) -> DataFrame:
    """events (request, ms, event), a stream -> request, timed_out_at."""

    def run(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(parts)).sort_values(["ms", "event"])
        held = state.get if state.exists else (0, 0, 0)
        held, fired = guard(tuple(held), list(zip(rows["ms"].tolist(), rows["event"].tolist())))
        state.update(held)
        yield pd.DataFrame({"request": [key[0]] * len(fired), "timed_out_at": fired})

    kind = events.schema["request"].dataType.simpleString()
    return events.groupBy("request").applyInPandasWithState(run, f"request {kind}, timed_out_at long", "deadline long, output int, over int", "append", GroupStateTimeout.NoTimeout)


def heartbeats(times: list[int], last: int | None = None, every: int = HEARTBEAT_MS) -> list[int]:
    """The times that may be reported: at most one in every `every` milliseconds."""
    out = []
    for t in times:
        if last is None or t - last >= every:
            out.append(t)
            last = t
    return out


# ---- incremental decoders ----------------------------------------------------------------------------------------------


def sse(tail: str, chunk: str) -> tuple[str, list[str]]:
    """Whole `data:` payloads of a server-sent stream so far, and the unfinished tail."""
    *lines, tail = (tail + chunk).replace("\r\n", "\n").split("\n")
    return tail, [x[5:].strip() for x in lines if x.startswith("data:") and x[5:].strip() not in ("", "[DONE]")]


def deltas(payloads: list[str]) -> str:
    """The text that chat payloads add."""
    out = []
    for p in payloads:
        try:
            out.append((json.loads(p).get("choices") or [{}])[0].get("delta", {}).get("content") or "")
        except (ValueError, AttributeError):
            continue
    return "".join(out)


def records(tail: str, chunk: str, seen: set[str], last: bool = False) -> tuple[str, list[tuple[str, str]]]:
    """Records {"id", "text"} that are whole now, one a line and each id once; seen is added to."""
    *lines, tail = (tail + chunk).split("\n")
    if last:
        lines, tail = [*lines, tail], ""
    out = []
    for line in lines:
        try:
            x = json.loads(line.strip().rstrip(","))
        except ValueError:
            continue
        if isinstance(x, dict) and isinstance(x.get("id"), str) and isinstance(x.get("text"), str) and x["id"] not in seen:
            seen.add(x["id"])
            out.append((x["id"], x["text"]))
    return tail, out


def assembled_records(chunks: DataFrame) -> DataFrame:
    """chunks (request, seq, value), a stream -> request, id, text of each whole record, once."""

    def run(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(parts)).sort_values("seq")
        tail, known = state.get if state.exists else ("", "[]")
        seen, out = set(json.loads(known)), []
        for value in rows["value"]:
            tail, new = records(tail, value or "", seen)
            out += new
        state.update((tail, json.dumps(sorted(seen))))
        yield pd.DataFrame([(key[0], i, t) for i, t in out], columns=["request", "id", "text"])

    kind = chunks.schema["request"].dataType.simpleString()
    return chunks.groupBy("request").applyInPandasWithState(run, f"request {kind}, id string, text string", "tail string, seen string", "append", GroupStateTimeout.NoTimeout)


def latest_generation(results: DataFrame, current: DataFrame, keys: list[str]) -> DataFrame:
    """Results of the current generation of their page; stale ones are dropped."""
    return results.join(current.select(*keys, F.col("generation").alias("_g")), keys).filter(F.col("generation") == F.col("_g")).drop("_g")


def queue_order(jobs: DataFrame) -> DataFrame:
    """jobs (seq, lane, priority): the priority lane first, then by priority and arrival, as position from 1 within a lane."""
    from pyspark import StorageLevel
    from pyspark.sql import Window

    lane = F.when(F.col("lane") == "priority", 0).otherwise(1)
    # ranges in the queue's order; each is numbered by itself and starts where those before it end, so no task has a whole lane
    ranged = jobs.withColumn("_lane", lane).repartitionByRange("_lane", "priority", "seq").withColumn("_part", F.spark_partition_id()).persist(StorageLevel.MEMORY_AND_DISK)
    sizes = ranged.groupBy("_lane", "_part").agg(F.count("*").alias("_n"))
    # a row for each range
    before = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(Window.partitionBy("_lane").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    own = F.row_number().over(Window.partitionBy("_lane", "_part").orderBy("priority", "seq"))
    return ranged.withColumn("_own", own).join(F.broadcast(before), ["_lane", "_part"]).withColumn("position", (F.col("_own") + F.col("_before")).cast("int")).drop("_lane", "_part", "_own", "_before")
