"""Product codes of vectors: each of eight parts goes by the nearest entry of its codebook, found by exponion search.

Components are integers, floor(4096 x), and so is all that follows: squared distances, sums and the entries themselves, so that
the partition of the rows makes no difference. A part's search starts at its previous entry a, at the squared distance u. An entry j
that is as near or nearer lies within twice that distance of a, so D(a, j) <= 4 u in squared distances, exactly. The
other entries are kept in order of D(a, j), and only the head of that list within the radius is measured; ties go to the lower index.

A round writes each vector with its codes (the previous round's are removed), sums parts by entry inside the tasks and takes one
row for each part and entry to the driver: entries times parts, whatever the number of vectors.

Case rules: null vectors, and those with null or non-finite components, go. The 16 smallest vec_ids (null last, ties by the vector)
start the codebooks; with fewer vectors the codebooks have fewer entries. The smallest one's length counts: vectors of another length,
or with a component of 32,768 or more (its squares would leave the longs), keep their row with null code and error. A
length that isn't a multiple of eight is filled up with zeros. Rows that are repeated are kept; an empty table gives none.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import removed, written

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
#: Components whose squares and sums of squares stay in the longs.
LARGEST = 1 << 27


def neighbours(book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each entry of a part's codebook (entries, width) the entries by distance, itself first, and their squared distances."""
    apart = ((book[:, None, :] - book[None, :, :]) ** 2).sum(2)
    apart[np.arange(len(book)), np.arange(len(book))] = -1  # before entries that are equal to it
    order = np.argsort(apart, axis=1, kind="stable")
    return order, np.maximum(np.take_along_axis(apart, order, 1), 0)


def nearest(x: np.ndarray, book: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Entry and squared distance of each row of x (rows, width), and how many distances were measured. start: entries to begin at."""
    order, apart = neighbours(book)
    best, least, measured = start.astype(np.int64), ((x - book[start]) ** 2).sum(1), len(x)
    radius = 4 * least
    for a in np.unique(start):
        rows = np.flatnonzero(start == a)
        reach = np.searchsorted(apart[a], radius[rows], side="right")  # entries of the list within the radius
        by_reach = np.argsort(-reach, kind="stable")
        rows, reach = rows[by_reach], reach[by_reach]
        for place in range(1, int(reach[0])):
            within = rows[: np.searchsorted(-reach, -place, side="left")]
            j = order[a, place]
            d = ((x[within] - book[j]) ** 2).sum(1)
            measured += len(within)
            better = (d < least[within]) | ((d == least[within]) & (j < best[within]))
            best[within[better]], least[within[better]] = j, d[better]
    return best, least, measured


def _matrix(batch: pa.RecordBatch, width: int) -> np.ndarray:
    return batch.column("q").flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, PARTS, width)


def _coded(books: np.ndarray):
    """The batches with codes of these codebooks (parts, entries, width) and the squared distance."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch, books.shape[2])
            before = np.frombuffer(b"".join(batch.column("codes").to_pylist()), np.uint8).reshape(-1, PARTS)
            found = [nearest(x[:, p], books[p], before[:, p]) for p in range(PARTS)]
            codes = np.stack([f[0] for f in found], 1).astype(np.uint8) if len(x) else before
            error = np.sum([f[1] for f in found], 0) if len(x) else np.empty(0, np.int64)
            packed = pa.array([c.tobytes() for c in codes], pa.binary())
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in ("vec_id", "label", "q")], packed, pa.array(error, pa.int64())], names=["vec_id", "label", "q", "codes", "error"])

    return run


def _summed(width: int):
    """part, entry, n and the sums of its components: a row for each part and entry of a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = np.zeros((PARTS, ENTRIES), np.int64), np.zeros((PARTS, ENTRIES, width), object)
        for batch in batches:
            x = _matrix(batch, width)
            codes = np.frombuffer(b"".join(batch.column("codes").to_pylist()), np.uint8).reshape(-1, PARTS)
            for p in range(PARTS):
                own = np.zeros((ENTRIES, width), np.int64)
                np.add.at(own, codes[:, p], x[:, p])
                total[p] += own  # Python's integers from here on
                n[p] += np.bincount(codes[:, p], minlength=ENTRIES)
        at = [(p, e, i) for p in range(PARTS) for e in range(ENTRIES) if n[p, e] for i in range(width)]
        columns = [[a[0] for a in at], [a[1] for a in at], [a[2] for a in at], [int(n[a[0], a[1]]) for a in at]]
        sums = pa.array([str(total[a]) for a in at], pa.string())
        yield pa.RecordBatch.from_arrays([*[pa.array(c, pa.int64()) for c in columns], sums], names=["part", "entry", "place", "n", "total"])

    return run


def _next(books: np.ndarray, state: DataFrame) -> np.ndarray:
    """The codebooks after one update: floors of means; entries that aren't used stay."""
    rows = state.select("q", "codes").mapInArrow(_summed(books.shape[2]), "part long, entry long, place long, n long, total string")
    rows = rows.groupBy("part", "entry", "place").agg(F.sum("n").alias("n"), F.sum(F.col("total").cast("decimal(38,0)")).alias("total"))
    out = books.copy()
    for r in rows.collect():  # parts x entries x width
        out[r["part"], r["entry"], r["place"]] = int(r["total"]) // r["n"]
    return out


def sha256_of(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def _integers(vector: Column) -> Column:
    """floor(4096 x), the scaling done in doubles; null for components too large."""
    one = lambda x: F.floor(x.cast("double") * SCALE)
    return F.when(F.forall(vector, lambda x: F.abs(x.cast("double") * SCALE) < LARGEST), F.transform(vector, one))


def coded(rows: DataFrame, vector: str = "embedding", rounds: int = ROUNDS) -> tuple[DataFrame, np.ndarray | None]:
    """(vec_id, label, codes, error of each kept row, and the final codebooks). rows: vec_id, label and the vector column.

    codes are eight bytes; both are null where a row has no code. Without any vector that can be coded there are no codebooks.
    """
    x = F.col(vector)
    kept = rows.filter(x.isNotNull() & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v.cast("double")) & (F.abs(v.cast("double")) < float("inf"))))
    kept = kept.select("vec_id", "label", _integers(x).alias("q"))
    kind = f"vec_id {rows.schema['vec_id'].dataType.simpleString()}, label {rows.schema['label'].dataType.simpleString()}, q array<bigint>, codes binary, error long"
    blank = kept.select("vec_id", "label", "q", F.lit(None).cast("binary").alias("codes"), F.lit(None).cast("long").alias("error"))
    first = kept.filter(F.col("q").isNotNull()).orderBy(F.col("vec_id").asc_nulls_last(), "q").limit(ENTRIES).collect()
    length = len(first[0]["q"]) if first else 0
    if not length:
        return blank.drop("q"), None
    first = [r["q"] for r in first if len(r["q"]) == length]
    width = -(-length // PARTS)
    books = np.array([q + [0] * (PARTS * width - length) for q in first], np.int64).reshape(len(first), PARTS, width).transpose(1, 0, 2)

    filled = F.concat("q", F.array_repeat(F.lit(0).cast("long"), PARTS * width - length)) if PARTS * width > length else F.col("q")
    has = F.col("q").isNotNull() & (F.size("q") == length)
    state = kept.filter(has).select("vec_id", "label", filled.alias("q"), F.lit(bytes(PARTS)).alias("codes"))
    for _ in range(rounds):
        before, state = state, written(state.mapInArrow(_coded(books), kind), "vector-codes")
        removed(before)
        books = _next(books, state)
    last = written(state.mapInArrow(_coded(books), kind).select("vec_id", "label", "codes", "error"), "vector-codes")
    removed(state)
    return last.unionByName(blank.filter(~has | F.col("q").isNull()).drop("q")), books


def codes_and_errors(rows: DataFrame, vector: str = "embedding") -> DataFrame:
    """vec_id, code (two hex digits a part), error, label_error (null labels together), codebooks_sha256."""
    found, books = coded(rows, vector)
    sums = found.groupBy("label").agg(F.sum("error").alias("label_error"))
    same = F.col("l.label").eqNullSafe(F.col("r.label"))
    both = found.alias("l").join(sums.alias("r"), same, "left")
    sha = F.lit(sha256_of(books) if books is not None else None).cast("string")
    return both.select("l.vec_id", F.lower(F.hex("l.codes")).alias("code"), "l.error", "r.label_error", sha.alias("codebooks_sha256"))


def measured_share(x: np.ndarray, books: np.ndarray, start: np.ndarray) -> float:
    """The share of all entries that exponion search measures for rows x (rows, parts, width)."""
    counts = [nearest(x[:, p], books[p], start[:, p])[2] for p in range(PARTS)]
    return reduce(lambda a, b: a + b, counts) / (len(x) * PARTS * books.shape[1])
