"""Spelling variants: words that differ in one code point, grouped without making pairs.

Replacements: words that are equal but for the code point at one position have the same (length, position, prefix, suffix). Such a
group holds at most a word for each letter of the alphabet; its size and its two most frequent words tell every member what
it needs: how many near words it has there, and the most frequent of them that isn't itself. Two words share at most one such group.

Insertions and deletions: a word's distinct deletions that are words themselves are near it, and it is near them. Deletions are joined
with the vocabulary once; each word's shorter words are combined by word, and longer ones by deletion.

Prefixes and suffixes go as two hashes modulo 2^61 - 1 each, computed for all positions of a word in one pass, so that a word of n letters costs
n rows of a few longs and not n strings of its length. (A chance agreement would take both hashes: for any two rows about 1e-36 times the length.)

A word's form is its most frequent near word, if that is ten times as frequent; forms form chains whose counts grow tenfold with every
step, and roots are found by doubling, in as many rounds as the logarithm of the longest chain.

Case rules: null texts have no words; a null doc_id reads as an empty string in the hash that decides on deletions; repeated rows count
again; words of any length are handled.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillspark.llm.common import written

#: Letters of a word, code points and occurrences of a word of the vocabulary, how much more frequent a form is.
RUN, LEAST_LENGTH, LEAST_COUNT, TIMES = "A-Za-zÀ-ÿ", 7, 2, 10
#: Runs whose hash this divides lose a letter.
LOSES = 31
#: Distinct words that a task counts before it hands them on.
COUNTED = 1 << 18

_PRIME = (1 << 61) - 1
_BASES = 0x0B5AD4ECEDA1CE2, 0x1F83D9ABFB41BD6
_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def variant(doc_id: object, run: str) -> str:
    """The lower-case run, without the letter that its document's hash takes."""
    h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
    at = h % len(run)
    return run if h % LOSES else run[:at] + run[at + 1 :]


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    runs = re.compile(f"[{RUN}]{{{LEAST_LENGTH},}}")  # greedy, so maximal runs; shorter ones have no results of that length
    counts: Counter[str] = Counter()
    out = lambda: pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], names=["word", "n"])
    for batch in batches:
        for doc_id, text in zip(batch.column("doc_id"), batch.column("text")):
            own = Counter(runs.findall((text.as_py() or "").translate(_LOWER)))
            for run, n in own.items():
                word = variant(doc_id.as_py(), run)
                if len(word) >= LEAST_LENGTH:
                    counts[word] += n
            if len(counts) >= COUNTED:
                yield out()
                counts.clear()
    if counts:
        yield out()


def vocabulary(docs: DataFrame) -> DataFrame:
    """word, n: the words that occur often enough over all docs (doc_id, text)."""
    counted = docs.select("doc_id", "text").mapInArrow(_counted, "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= LEAST_COUNT)


def hashed(word: str, base: int) -> tuple[list[int], list[int], int]:
    """The hashes of the word without each letter, of it with a wildcard for each letter, and of itself.

    A letter is a digit of at least 65 and the wildcard is the digit 1, so that length and position are part of the number.
    """
    points = list(map(ord, word))
    n = len(points)
    before, after, powers = [0] * (n + 1), [0] * (n + 1), [1] * (n + 1)
    for i, c in enumerate(points):
        before[i + 1] = (before[i] * base + c) % _PRIME
    for i in range(n - 1, -1, -1):
        after[i] = (points[i] * powers[i + 1] + after[i + 1]) % _PRIME
        powers[i] = powers[i + 1] * base % _PRIME  # base to the number of letters from i on
    without = [(before[i] * powers[i + 1] + after[i + 1]) % _PRIME for i in range(n)]
    wild = [(before[i] * powers[i] + powers[i + 1] + after[i + 1]) % _PRIME for i in range(n)]
    return without, wild, before[n]


def _keyed(kind: str):
    """key1, key2 with word and n: what a word meets others by. Equal letters in a row give one deletion."""

    def out(keys: tuple[list[int], list[int]], words: list[str], counts: list[int]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(keys[0], pa.int64()), pa.array(keys[1], pa.int64()), pa.array(words, pa.string()), pa.array(counts, pa.int64())], names=["key1", "key2", "word", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, words, counts = ([], []), [], []
        for batch in batches:
            for word, n in zip(batch.column("word").to_pylist(), batch.column("n").to_pylist()):
                for own, base in zip(keys, _BASES):
                    without, wild, itself = hashed(word, base)
                    own += wild if kind == "wild" else [itself] if kind == "itself" else [h for h, c, last in zip(without, word, " " + word) if c != last]
                new = len(keys[0]) - len(words)
                words += [word] * new
                counts += [n] * new
                if len(words) >= 1 << 14:
                    yield out(keys, words, counts)
                    keys, words, counts = ([], []), [], []
        if words:
            yield out(keys, words, counts)

    return run


def _best(n: Column, word: Column) -> Column:
    """A struct that is smallest for the most frequent word, ties to the smaller word (Spark compares UTF-8, which is code-point order)."""
    return F.struct((-n).alias("less"), word.alias("word"))


def near_words(words: DataFrame) -> DataFrame:
    """word, n, n_near, best (-n and word of its most frequent near word; null without one). words: word, n, each word once."""
    keyed = lambda kind: words.mapInArrow(_keyed(kind), "key1 long, key2 long, word string, n long")
    key = ["key1", "key2"]

    group = Window.partitionBy(*key)
    ranked = group.orderBy(F.col("n").desc(), "word").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    each = _best(F.col("n"), F.col("word"))
    wild = keyed("wild").select(*key, "word", F.count("*").over(group).alias("size"), F.first(each).over(ranked).alias("top"), F.nth_value(each, 2).over(ranked).alias("next"))
    wild = wild.filter("size > 1")
    replaced = wild.select("word", (F.col("size") - 1).alias("k"), F.when(F.col("top.word") == F.col("word"), F.col("next")).otherwise(F.col("top")).alias("best"))

    own = keyed("itself").select(*key, F.col("word").alias("of"), F.col("n").alias("of_n"))
    met = keyed("shorter").join(own, key)
    met = written(met.select("word", "n", "of", "of_n"), "spelling-deletions")
    shorter = met.select("word", F.lit(1).cast("long").alias("k"), _best(F.col("of_n"), F.col("of")).alias("best"))
    longer = met.groupBy(F.col("of").alias("word")).agg(F.count("*").alias("k"), F.min(_best(F.col("n"), F.col("word"))).alias("best"))

    found = replaced.union(shorter).union(longer).groupBy("word").agg(F.sum("k").alias("n_near"), F.min("best").alias("best"))
    return words.join(found, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), "best")


def _roots(forms: DataFrame) -> DataFrame:
    """word, root for words with a form: the last of its chain. Every round doubles the step."""
    steps = written(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        on = steps.select(F.col("word").alias("root"), F.col("root").alias("further"))
        moved = steps.join(on, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved"))
        moved = written(moved, "roots")
        steps = moved.select("word", "root")
        if moved.filter("moved").isEmpty():
            return steps


def variants(docs: DataFrame) -> DataFrame:
    """word, form, root, n, n_near, form_n for each word of the vocabulary of docs (doc_id, text)."""
    words = written(vocabulary(docs), "words")
    near = near_words(words)
    enough = -F.col("best.less") >= TIMES * F.col("n")
    formed = written(near.select("word", "n", "n_near", F.when(enough, F.col("best.word")).alias("form"), F.when(enough, -F.col("best.less")).alias("form_n")), "forms")
    roots = _roots(formed.filter("form is not null"))
    return formed.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
