"""Packing of tokenised documents into windows of fixed length, planned by non-negative least squares.

Every document is cut into full windows and a rest of 1 to WINDOW - 1 tokens (or none); rests are not cut. The plan
needs only the histogram of rest lengths, which has WINDOW rows however many documents there are:

1. Patterns. All multisets of up to three lengths of the histogram that fill a window exactly are enumerated
   (where they are over PATTERNS, triples with the commonest lengths are).
2. Non-negative least squares. How often each pattern is used is solved against the histogram by multiplicative
   updates, which keep the counts non-negative, and rounded down to whole numbers. Rounding can only ask for less than
   there is; counts that ask for more are lowered.
3. What is left over is packed greedily: the longest piece, then the longest that fits, until none does. Equal
   windows are made in one step, so the work depends on the number of lengths and patterns only.

A plan is a list of runs: a pattern, how many windows use it, and which pieces of each length (by rank) they take. The
rank of a piece in its length comes from counts for each partition, so documents are never sorted or gathered.

Case rules: a null text is an empty one and has the end token only; null doc_ids and repeated rows are packed like
any other; other columns are ignored; an empty table gives no pieces.
"""

from __future__ import annotations

import re
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillspark.llm.common import written

WINDOW = 2048
END = 1
PATTERNS = 400_000
ROUNDS = 150
#: Words that a tokenizing process remembers in each of two generations.
REMEMBERED = 400_000

# Letters for which Python's lower case and NFC agree with the tokenizer's; other texts go through it as a whole.
_PLAIN = re.compile(r"[\t-\r -~¡-¬®-ÿ–—‘-”…]*")
_PRETOKENS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zªµºß-öø-ÿ]+|[0-9²³¹¼-¾]|[^\sa-z0-9ªµºß-öø-ÿ²³¹¼-¾]+")


def _byte_letters() -> dict[int, str]:
    """The letter that stands for each byte: itself where it can be seen, else one from 256 on."""
    seen = [*range(33, 127), *range(161, 173), *range(174, 256)]
    unseen = [b for b in range(256) if b not in set(seen)]
    return {b: chr(b) for b in seen} | {b: chr(256 + i) for i, b in enumerate(unseen)}


class _Words(dict):
    """Ids of words between white space, as bytes. Made on first use; the older half goes when there are too many."""

    def __init__(self, model):
        super().__init__()
        self.model, self.older, self.letters = model, {}, _byte_letters()

    def __missing__(self, word: str) -> bytes:
        ids = self.older.get(word)
        if ids is None:
            parts = _PRETOKENS.findall(word)
            if len(parts) == 1:
                seen = word if word.isascii() else word.encode().decode("latin-1").translate(self.letters)
                ids = b"".join([x.id.to_bytes(4, "little") for x in self.model.tokenize(seen)])
            else:
                ids = b"".join([self[x] for x in parts])
        if len(self) >= REMEMBERED:
            self.older = dict(self)
            self.clear()
        self[word] = ids
        return ids


class WordTokenizer:
    """Ids of a text as little-endian unsigned 32-bit bytes; words are looked up, new ones go to the tokenizer's model."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.words = _Words(self.tokenizer.model)

    def ids(self, text: str) -> bytes:
        if "<|" in text or not _PLAIN.fullmatch(text):
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        words = self.words
        return b"".join([words[x] for x in unicodedata.normalize("NFC", text).lower().split()])


_KEPT: dict[str, WordTokenizer] = {}


def word_tokenizer(path: str) -> WordTokenizer:
    """One for each process, whose words outlast a task."""
    if path not in _KEPT:
        _KEPT[path] = WordTokenizer(path)
    return _KEPT[path]


def _tokenized(path: str | None, window: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        where = path
        if where is None:
            import public_tokenizers

            where = public_tokenizers.path("word_bpe_49k.json")
        tokenizer, end = word_tokenizer(where), np.array([END], "<u4").tobytes()
        for rows in batches:
            out = []
            for doc_id, text in zip(rows["doc_id"], rows["text"]):
                ids = tokenizer.ids(text) + end
                cuts = range(0, len(ids), 4 * window)
                out.append((doc_id, len(ids) // 4, [zlib.crc32(ids[i : i + 4 * window]) for i in cuts]))
            yield pd.DataFrame(out, columns=["doc_id", "doc_tokens", "crcs"]).astype({"doc_id": rows["doc_id"].dtype})

    return run


def patterns(counts: np.ndarray, limit: int = PATTERNS) -> np.ndarray:
    """Rows of up to three lengths (0: none) that fill len(counts) tokens exactly, by lengths that counts has."""
    window = len(counts)
    there = np.flatnonzero(counts)
    there = there[there > 0]
    a = there[there * 2 <= window]
    pairs = np.stack([a, window - a], 1)
    pairs = pairs[counts[np.minimum(pairs[:, 1], window - 1)] > 0]
    common = there[np.argsort(-counts[there], kind="stable")][: int((2 * limit) ** 0.5)]
    x, y = np.meshgrid(common, common, indexing="ij")
    x, y = x.ravel(), y.ravel()
    z = window - x - y
    keep = (x <= y) & (z > 0)
    x, y, z = x[keep], y[keep], z[keep]
    triples = np.sort(np.stack([x, y, z], 1)[counts[z] > 0], axis=1)
    return np.unique(np.concatenate([np.pad(pairs, ((0, 0), (1, 0))), triples]), axis=0)


def solve(rows: np.ndarray, counts: np.ndarray, rounds: int = ROUNDS) -> np.ndarray:
    """Non-negative x that make the patterns' lengths come close to counts in the least squares sense.

    Multiplicative updates x *= (A'b) / (A'Ax), where A has how often a pattern holds a length.
    """
    b = counts.astype(float).copy()
    b[0] = 0
    gather = lambda v: v[rows].sum(axis=1)  # noqa: E731  (v[0] is 0: no piece)
    target = gather(b)
    x = np.full(len(rows), b.sum() / max(1, 3 * len(rows)))
    for _ in range(rounds):
        made = np.zeros(len(counts))
        for k in range(3):
            made += np.bincount(rows[:, k], x, len(counts))
        made[0] = 0
        x *= target / np.maximum(gather(made), 1e-12)
    return x


def plan(counts: np.ndarray) -> list[tuple[tuple[int, ...], int]]:
    """counts: rests by length (index 0: none). (lengths, windows) runs that hold every rest once; no sum is over len(counts)."""
    window, left, runs = len(counts), counts.astype(np.int64).copy(), []
    left[0] = 0
    if left.sum():
        rows = patterns(left)
        if len(rows):
            x = solve(rows, left)
            for i in np.argsort(-x, kind="stable"):
                times = int(x[i])
                if not times:
                    break
                held = {int(v): int((rows[i] == v).sum()) for v in rows[i] if v}
                times = min(times, *(int(left[v]) // n for v, n in held.items()))
                if times:
                    for v, n in held.items():
                        left[v] -= n * times
                    runs.append((tuple(int(v) for v in rows[i] if v), times))
    while left.any():
        piece, room, took = [], window, {}
        while room:
            there = np.flatnonzero(left[: room + 1])
            there = [v for v in there[::-1][:8] if left[v] > took.get(int(v), 0)]
            if not there:
                break
            v = int(there[0])
            took[v] = took.get(v, 0) + 1
            piece.append(v)
            room -= v
        times = min(int(left[v]) // n for v, n in took.items())
        for v, n in took.items():
            left[v] -= n * times
        runs.append((tuple(piece), times))
    return runs


def pack(docs: DataFrame, tokenizer: str | None = None, window: int = WINDOW) -> DataFrame:
    """docs (doc_id, text) -> doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset for each piece.

    tokenizer: the path of a tokenizers file on every executor; by default the public word tokenizer's.
    """
    spark = docs.sparkSession
    kind = docs.schema["doc_id"].dataType.simpleString()
    tokens = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).mapInPandas(_tokenized(tokenizer, window), f"doc_id {kind}, doc_tokens long, crcs array<long>")
    tokens = written(tokens.select("*", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("row")), "tokens")
    rests = tokens.select("doc_id", "doc_tokens", "crcs", "part", "row", (F.col("doc_tokens") % window).cast("int").alias("length"))

    # full windows are sequences of their own; their numbers follow those of the planned ones
    fulls = tokens.groupBy("part").agg(F.sum(F.floor(F.col("doc_tokens") / window)).cast("long").alias("n")).orderBy("part").collect()
    lengths = {r["length"]: r["n"] for r in rests.groupBy("length").agg(F.count("*").alias("n")).collect()}
    counts = np.zeros(window, np.int64)
    for v, n in lengths.items():
        counts[v] = n
    runs, used, first, table = plan(counts), {}, 0, []
    for run, (held, times) in enumerate(runs):
        offset, seen = 0, {}
        for v in held:
            seen[v] = seen.get(v, 0) + 1
        done: dict[int, int] = {}
        for v in held:
            # the k-th of a length in window i takes rank used + i * n + k
            table.append((v, used.get(v, 0), used.get(v, 0) + times * seen[v], seen[v], done.get(v, 0), first, offset))
            done[v] = done.get(v, 0) + 1
            offset += v
        for v, n in seen.items():
            used[v] = used.get(v, 0) + n * times
        first += times
    slots = spark.createDataFrame(table, "length int, since long, until long, n int, k int, first long, at int")

    # ranks: those of a length in earlier partitions, and the row number in its own
    sizes = rests.filter("length > 0").groupBy("length", "part").agg(F.count("*").alias("c"))
    sizes = sizes.withColumn("before", F.sum("c").over(Window.partitionBy("length").orderBy("part")) - F.col("c")).drop("c")
    own = F.row_number().over(Window.partitionBy("part", "length").orderBy("row")) - 1
    ranked = rests.filter("length > 0").withColumn("own", own).join(sizes, ["length", "part"]).withColumn("rank", F.col("own") + F.col("before"))
    spots = slots.groupBy("length").agg(F.sort_array(F.collect_list(F.struct("since", "until", "n", "k", "first", "at"))).alias("spots"))
    met = ranked.join(F.broadcast(spots), "length")
    spot = F.element_at(F.filter("spots", lambda s: (s["since"] <= F.col("rank")) & (F.col("rank") < s["until"]) & (((F.col("rank") - s["since"]) % s["n"]) == s["k"])), 1)
    met = met.withColumn("spot", spot)
    last = met.select(
        "doc_id",
        (F.col("doc_tokens") - F.col("length")).alias("start"),
        F.col("length").cast("long").alias("length"),
        F.element_at("crcs", -1).alias("ids_crc32"),
        "doc_tokens",
        (F.col("spot.first") + F.floor((F.col("rank") - F.col("spot.since")) / F.col("spot.n"))).alias("sequence_id"),
        F.col("spot.at").cast("long").alias("offset"),
    )
    at, begins = first, []
    for r in fulls:
        begins.append((r["part"], at))
        at += r["n"]
    begins = spark.createDataFrame(begins, "part int, begin long")
    long = rests.filter(F.col("doc_tokens") >= window).withColumn("n", F.floor(F.col("doc_tokens") / window))
    long = long.withColumn("before", F.sum("n").over(Window.partitionBy("part").orderBy("row").rowsBetween(Window.unboundedPreceding, -1)))
    long = long.join(F.broadcast(begins), "part").select("doc_id", "doc_tokens", "n", (F.col("begin") + F.coalesce("before", F.lit(0))).alias("from"), F.posexplode(F.expr("slice(crcs, 1, int(n))")).alias("i", "ids_crc32"))
    whole = long.select("doc_id", (F.col("i") * F.lit(window)).cast("long").alias("start"), F.lit(window).cast("long").alias("length"), "ids_crc32", "doc_tokens", (F.col("from") + F.col("i")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return whole.unionByName(last)
