"""Suffix-array deduplication: every byte that lies in a repeated string of LENGTH bytes is found and removed.

A sorted array of all suffixes of 100 TB cannot be shuffled. It is cut into buckets instead, such that two equal
strings of LENGTH bytes always meet in one bucket:

1. Anchors. In each window of LENGTH bytes the GRAM-byte string with the smallest hash is the window's anchor.
   Equal windows have equal anchors at equal offsets, and neighbouring windows mostly share theirs, so a text has
   an anchor every (LENGTH - GRAM) / 2 bytes or so. The windows of one anchor form a context: the bytes from the
   first such window's start to the last one's end. A text that has one context at several places gives one row with
   all of them (within a block of BLOCK windows), so rows follow the texts, however often a text repeats itself.
2. Anchors whose string occurs once are dropped. Equal contexts of one anchor are counted by a 128-bit hash; if
   there are two, all their windows are repeated. So copies never meet one by one.
3. What is left (contexts that occur once, but whose anchor occurs elsewhere in other contexts) goes to buckets
   by anchor. A bucket sorts its suffixes at the anchor, takes the common prefixes of neighbours and walks the
   interval tree of common prefixes with a stack. At each interval, which has a common right extension, the members
   are held in the order of their left extensions; a neighbour with another left extension ends the repeat there,
   so each repeat found is maximal on both sides. An interval reports all its occurrences, not just neighbours.
4. A bucket of more than BUCKET_ROWS contexts is split: the windows' offsets from the anchor are halved, and the
   bytes that all windows of a half share are added to the bucket's key. After a few halvings a context is a
   single window and equal windows have been counted in step 2's way, so no bucket outgrows its task.

Case rules: a null text counts as empty; texts under LENGTH bytes have nothing removed; rows repeated with the same
doc_id count as further occurrences; a string that occurs twice within one text counts; matches never cross
texts. An empty table gives an empty result. Extra columns are kept out of the result unless asked for.
"""

from __future__ import annotations

import bisect
import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import partitions, removed, text_key, written

LENGTH = 400
GRAM = 32
BUCKET_ROWS = 5_000
#: Rows of one context from which on they are dealt to SALTS keys.
HEAVY, SALTS = 2_048, 64
#: Window starts that are handled at once; below 2**16, for positions are packed into the low 16 bits of a hash.
BLOCK = 32_768

_MULTIPLIER = 0x9E3779B97F4A7C15
#: more: the other places of the same context in the same text, null if there are none.
_ANCHORS = "anchor long, ctx1 long, ctx2 long, key1 long, key2 long, pos int, dlo int, dhi int, more array<int>"


def _mixed(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    return x ^ (x >> np.uint64(29))


def gram_hashes(data: np.ndarray, gram: int) -> np.ndarray:
    """A 64-bit hash of each run of gram bytes (gram: a power of two), by doubling."""
    h = _mixed(data.astype(np.uint64) + np.uint64(1))
    size, factor = 1, _MULTIPLIER
    while size < gram:
        h = h[:-size] * np.uint64(factor) + h[size:]
        factor = factor * factor % (1 << 64)
        size *= 2
    return _mixed(h)


def window_minima(values: np.ndarray, window: int) -> np.ndarray:
    """The smallest of each run of window values, by doubling."""
    size, low = 1, values
    while size * 2 <= window:
        low = np.minimum(low[:-size], low[size:])
        size *= 2
    if size < window:
        rest = window - size
        low = np.minimum(low[: len(low) - rest], low[rest:])
    return low


def anchor_runs(data: np.ndarray, ends: np.ndarray, length: int, gram: int) -> Iterator[tuple[np.ndarray, ...]]:
    """For texts that lie one after another in data and stop at ends: (anchor hash, anchor position, first and last
    window start) of each run of windows that share an anchor. Windows that cross an end are left out."""
    total, width = len(data), length - gram + 1
    for begin in range(0, max(0, total - length + 1), BLOCK):
        stop = min(begin + BLOCK, total - length + 1)
        hashes = gram_hashes(data[begin : stop + length - 1], gram)
        packed = (hashes & ~np.uint64(0xFFFF)) | np.arange(len(hashes), dtype=np.uint64)
        low = window_minima(packed, width)
        at = (low & np.uint64(0xFFFF)).astype(np.int64)
        starts = np.arange(begin, stop)
        owner = np.searchsorted(ends, starts, side="right")
        whole = starts + length <= ends[np.minimum(owner, len(ends) - 1)]
        state = np.where(whole, at, -1 - (owner % 2))
        change = np.flatnonzero(np.concatenate(([True], (state[1:] != state[:-1]) | (owner[1:] != owner[:-1]))))
        last = np.concatenate((change[1:], [len(state)])) - 1
        keep = whole[change]
        change, last = change[keep], last[keep]
        if len(change):
            yield hashes[at[change]].view(np.int64), at[change] + begin, change + begin, last + begin, owner[change]


def places_of_each(keys: tuple[np.ndarray, ...], pos: np.ndarray) -> tuple[np.ndarray, pa.ListArray]:
    """The first row of each set of rows with equal keys, and the other rows' pos (null if there are none), in order."""
    order = np.lexsort(keys)
    new = np.zeros(len(order), bool)
    new[:1] = True
    for x in keys:
        new[1:] |= x[order[1:]] != x[order[:-1]]
    heads = np.flatnonzero(new)
    sizes = np.diff(np.append(heads, len(order))) - 1
    more = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(sizes))), pa.int32()), pa.array(pos[order[~new]], pa.int32()), mask=pa.array(sizes == 0))
    return order[heads], more


def _find_anchors(length: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("bytes")
            if not len(texts):
                continue
            raw = texts.to_pylist()
            data = b"".join(raw)
            ends = np.cumsum([len(x) for x in raw])
            begins = ends - [len(x) for x in raw]
            key1, key2 = (batch.column(k).to_numpy() for k in ("key1", "key2"))
            for anchors, at, first, last, owner in anchor_runs(np.frombuffer(data, np.uint8), ends, length, gram):
                digest = b"".join([xxhash.xxh3_128_digest(data[a : b + length]) for a, b in zip(first.tolist(), last.tolist())])
                two = np.frombuffer(digest, np.int64).reshape(-1, 2)
                # the anchor's offset is part of what makes two contexts equal
                ctx1, ctx2, pos = two[:, 0] ^ (at - first), two[:, 1], (at - begins[owner]).astype(np.int32)
                one, more = places_of_each((owner, anchors, ctx1, ctx2), pos)
                columns = (anchors, ctx1, ctx2, key1[owner], key2[owner], pos, (at - last).astype(np.int32), (at - first).astype(np.int32))
                yield pa.RecordBatch.from_arrays([*(pa.array(x[one]) for x in columns), more], names=["anchor", "ctx1", "ctx2", "key1", "key2", "pos", "dlo", "dhi", "more"])

    return run


def _common(a: bytes, b: bytes) -> int:
    """Length of the common prefix."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    low, high = 0, n  # a[:low] == b[:low], a[:high] != b[:high]
    while high - low > 1:
        mid = (low + high) // 2
        if a[low:mid] == b[low:mid]:
            low = mid
        else:
            high = mid
    return low


def repeats_at_anchor(lefts: list[bytes], rights: list[bytes], length: int) -> list[tuple[int, int, int, int]]:
    """Maximal repeats of at least length bytes around an anchor that all members share.

    lefts: each member's bytes before the anchor, the nearest first. rights: its bytes from the anchor on.
    Returns (member, partner, bytes to the left, bytes to the right), such that for every member and every repeat
    of it that is maximal on both sides, one row covers the repeat.
    """
    order = sorted(range(len(rights)), key=rights.__getitem__)
    rank = {m: i for i, m in enumerate(sorted(range(len(lefts)), key=lefts.__getitem__))}
    by_rank = sorted(rank, key=rank.__getitem__)
    found: list[tuple[int, int, int, int]] = []

    def meet(x: int, y: int, right: int) -> None:
        left = _common(lefts[by_rank[x]], lefts[by_rank[y]])
        if left + right >= length:
            found.append((by_rank[x], by_rank[y], left, right))
            found.append((by_rank[y], by_rank[x], left, right))

    def merged(a: list[int], b: list[int], right: int) -> list[int]:
        """Members of two child intervals in the order of their left extensions; new neighbours are compared."""
        if len(a) < len(b):
            a, b = b, a
        for x in b:
            i = bisect.bisect_left(a, x)
            if i:
                meet(x, a[i - 1], right)
            if i < len(a):
                meet(x, a[i], right)
            a.insert(i, x)
        return a

    stack: list[tuple[int, list[int]]] = []  # (common prefix with what follows, members)
    for i, m in enumerate(order):
        here = _common(rights[m], rights[order[i + 1]]) if i + 1 < len(order) else -1
        members = [rank[m]]
        while stack and stack[-1][0] > here:
            prefix, before = stack.pop()
            members = merged(before, members, prefix)
        if stack and stack[-1][0] == here:
            prefix, before = stack.pop()
            members = merged(before, members, prefix)
        stack.append((here, members))
    return found


def _buckets(length: int, most: int):
    """Works off the buckets of a partition that is sorted by bucket; those of over most rows are left for splitting."""

    def spans_of(own: list[tuple]) -> list[tuple[int, int, int, int]]:
        if len(own) < 2 or len(own) > most or all(x[4] > 1 for x in own):
            return []
        found: dict[int, list[tuple[int, int]]] = {}
        for m, _, left, right in repeats_at_anchor([x[5][: x[3]][::-1] for x in own], [x[5][x[3] :] for x in own], length):
            found.setdefault(m, []).append((-left, right))
        return [(own[m][0], own[m][1], own[m][2] + a, own[m][2] + b) for m, each in found.items() for a, b in _united(each)]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names, here, own = ["key1", "key2", "start", "stop"], None, []
        for rows in batches:
            out = []
            places = zip(rows["bucket1"].tolist(), rows["bucket2"].tolist())
            for place, *row in zip(places, *(rows[c].tolist() for c in ("key1", "key2", "pos", "dhi", "n", "ctx"))):
                if place != here:
                    out += spans_of(own)
                    here, own = place, []
                if len(own) <= most:
                    own.append(row)
            yield pd.DataFrame(out, columns=names)
        yield pd.DataFrame(spans_of(own), columns=names)

    return run


def _united(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def _contexts(length: int):
    """Cuts the contexts that a text must give out of it."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            out = []
            for k1, k2, text, asked in zip(rows["key1"], rows["key2"], rows["bytes"], rows["asked"]):
                for x in asked:
                    pos, dlo, dhi = x["pos"], x["dlo"], x["dhi"]
                    out.append((x["anchor"], 0, k1, k2, pos, dlo, dhi, x["n"], text[pos - dhi : pos - dlo + length]))
            yield pd.DataFrame(out, columns=_CONTEXT_NAMES)

    return run


_CONTEXT_NAMES = ["bucket1", "bucket2", "key1", "key2", "pos", "dlo", "dhi", "n", "ctx"]
_CONTEXTS = "bucket1 long, bucket2 long, key1 long, key2 long, pos int, dlo int, dhi int, n long, ctx binary"


def _halves(length: int, width: int):
    """Splits the windows of each context at fixed offsets from the anchor that are width apart."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            out = []
            for b1, b2, k1, k2, pos, dlo, dhi, n, ctx in rows[_CONTEXT_NAMES].itertuples(index=False):
                for a in range(dlo // width * width, dhi + 1, width):
                    lo, hi, z = max(dlo, a), min(dhi, a + width - 1), a + width - 1
                    core = ctx[dhi - a : dhi - z + length]
                    key = xxhash.xxh3_128_digest(core + b1.to_bytes(8, "little", signed=True) + b2.to_bytes(8, "little", signed=True) + a.to_bytes(4, "little"))
                    n1, n2 = np.frombuffer(key, np.int64).tolist()
                    part = ctx[dhi - hi : dhi - lo + length]
                    p1, p2 = np.frombuffer(xxhash.xxh3_128_digest(part + hi.to_bytes(4, "little")), np.int64).tolist()
                    out.append((n1, n2, k1, k2, pos, lo, hi, n, part, p1, p2))
            yield pd.DataFrame(out, columns=[*_CONTEXT_NAMES, "part1", "part2"])

    return run


def _of_classes(rows: DataFrame, classes: DataFrame) -> DataFrame:
    """The rows whose class (anchor, ctx1, ctx2) has an n above 1, each once.

    A class of over HEAVY rows is dealt to SALTS keys by its rows' texts, so that no task has more than its share of a hot one.
    """
    each = ["anchor", "ctx1", "ctx2"]
    heavy = written(classes.filter(F.col("n") > HEAVY).select(*each, F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt")), "heavy-classes")
    multiple = classes.filter((F.col("n") > 1) & (F.col("n") <= HEAVY)).select(*each, F.lit(-1).alias("salt")).unionByName(heavy)
    salted = rows.withColumn("salt", F.pmod(F.xxhash64("key1", "key2", "pos"), F.lit(SALTS)).cast("int"))
    marked = salted.join(heavy.withColumn("heavy", F.lit(True)), [*each, "salt"], "left")
    return marked.withColumn("salt", F.when(F.col("heavy"), F.col("salt")).otherwise(-1)).join(multiple, [*each, "salt"], "left_semi")


def repeated_spans(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """key1, key2 (of common.text_key), spans (start, stop): bytes of texts that repeated strings of length bytes cover.

    docs has key1, key2, bytes (one row for each occurrence of a text; null-free). A text may have several rows, and its
    spans may overlap.
    """
    if gram & (gram - 1) or not gram < length <= BLOCK:
        raise ValueError("gram must be a power of two below length")
    anchors = docs.filter(F.length("bytes") >= length).select("key1", "key2", "bytes").mapInArrow(_find_anchors(length, gram), _ANCHORS)
    anchors = written(anchors, "anchors")
    # counts are tables of their own: joined as such, a side with a hot key can be split
    times = F.sum(1 + F.coalesce(F.array_size("more"), F.lit(0)))
    often = written(anchors.groupBy("anchor").agg(times.alias("m")).filter("m > 1").select("anchor"), "often")
    repeated = written(anchors.join(often, "anchor"), "repeated-anchors")
    removed(anchors)  # nothing reads them from here on
    classes = repeated.groupBy("anchor", "ctx1", "ctx2").agg(times.alias("n"), F.min(F.struct("key1", "key2", "pos", "dlo", "dhi")).alias("first"))
    classes = written(classes, "context-classes")

    # contexts that occur more than once: all their windows are repeated
    span = lambda pos: F.struct((pos - F.col("dhi")).alias("start"), (pos - F.col("dlo") + length).alias("stop"))
    alone = F.array(span(F.col("pos")))
    whole = _of_classes(repeated, classes).select("key1", "key2", F.when(F.col("more").isNull(), alone).otherwise(F.concat(alone, F.transform("more", span))).alias("spans"))

    # the others meet in buckets
    mixed = written(classes.groupBy("anchor").agg(F.count("*").alias("c"), F.min("n").alias("least")).filter("c > 1 and least = 1").select("anchor"), "mixed-anchors")
    asked = classes.join(mixed, "anchor").select("anchor", "n", "first.*")
    asked = asked.groupBy("key1", "key2").agg(F.collect_list(F.struct("anchor", "pos", "dlo", "dhi", "n")).alias("asked"))
    # each text once, however many rows hold it
    texts = docs.filter(F.length("bytes") >= length).groupBy("key1", "key2").agg(F.first("bytes").alias("bytes"))
    rows = written(texts.join(asked, ["key1", "key2"]).select("key1", "key2", "bytes", "asked").mapInPandas(_contexts(length), _CONTEXTS), "contexts")

    spans, width = [whole], 1 << (length - gram).bit_length()
    while True:
        sizes = rows.groupBy("bucket1", "bucket2").agg(F.count("*").alias("rows"))
        large = written(sizes.filter(F.col("rows") > bucket_rows).select("bucket1", "bucket2"), "large-buckets")
        fit = rows if large.isEmpty() else rows.join(large, ["bucket1", "bucket2"], "left_anti")
        fit = fit.repartition(2 * partitions(rows.sparkSession), "bucket1", "bucket2").sortWithinPartitions("bucket1", "bucket2")
        spans.append(fit.mapInPandas(_buckets(length, bucket_rows), "key1 long, key2 long, start int, stop int").select("key1", "key2", F.array(F.struct("start", "stop")).alias("spans")))
        if width <= 1 or large.isEmpty():
            break
        width //= 2
        parts = rows.join(large, ["bucket1", "bucket2"]).mapInPandas(_halves(length, width), _CONTEXTS + ", part1 long, part2 long")
        parts = written(parts, "context-halves")
        each = ["bucket1", "bucket2", "part1", "part2"]
        counted = parts.groupBy(*each).agg(F.sum("n").alias("all"), F.min(F.struct("key1", "key2", "pos", "dlo", "dhi", "ctx")).alias("first"))
        twice = counted.filter("all > 1").select(*each)
        spans.append(parts.join(twice, each).select("key1", "key2", alone.alias("spans")))
        rows = written(counted.select("bucket1", "bucket2", "first.key1", "first.key2", "first.pos", "first.dlo", "first.dhi", F.col("all").alias("n"), "first.ctx"), "contexts")
    out = spans[0]
    for x in spans[1:]:
        out = out.unionByName(x)
    return out


def _removed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for rows in batches:
        out = []
        for k1, k2, text, spans in zip(rows["key1"], rows["key2"], rows["bytes"], rows["spans"]):
            runs = _united([(x["start"], x["stop"]) for x in spans])
            kept, at = [], 0
            for a, b in runs:
                kept.append(text[at:a])
                at = b
            kept.append(text[at:])
            rest = b"".join(kept)
            out.append((k1, k2, sum(b - a for a, b in runs), len(runs), rest.decode("utf-8", "ignore"), hashlib.sha256(rest).hexdigest()))
        yield pd.DataFrame(out, columns=["key1", "key2", "n_removed", "n_spans", "kept", "kept_sha256"])


def remove_repeats(docs: DataFrame, length: int = LENGTH, with_text: bool = False, gram: int = GRAM, bucket_rows: int = BUCKET_ROWS, with_kept: bool = False) -> DataFrame:
    """docs (doc_id, text, ...) -> doc_id, n_bytes, n_removed, n_spans, kept_sha256 for each row.

    with_text: instead all columns of docs, the text without its repeats (bytes that no longer form a character
    go with them), and no others. with_kept: this text follows the others as a column text.
    """
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), *text_key(F.col("text")), F.encode(F.coalesce("text", F.lit("")), "UTF-8").alias("bytes"))
    keys = rows.groupBy("key1", "key2").agg(F.count("*").alias("copies"), F.first(F.octet_length("bytes").cast("long")).alias("size"))
    spans = repeated_spans(rows, length, gram, bucket_rows)
    spans = spans.groupBy("key1", "key2").agg(F.flatten(F.collect_set("spans")).alias("spans"))
    # texts with copies are repeated as a whole and need not be sent again
    alone = spans.join(keys.filter("copies = 1").select("key1", "key2"), ["key1", "key2"])
    cut = rows.select("key1", "key2", "bytes").filter(F.length("bytes") >= length).join(alone, ["key1", "key2"])
    kind = "key1 long, key2 long, n_removed long, n_spans long, " + ("kept string" if with_text else "kept_sha256 string") + (", kept string" if with_kept and not with_text else "")
    names = [x.split()[0] for x in kind.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for out in _removed(batches):
            yield out[names]

    cut = cut.mapInPandas(run, kind)
    nothing = {"kept": F.lit(""), "kept_sha256": F.lit(hashlib.sha256(b"").hexdigest())}
    copied = keys.filter((F.col("copies") > 1) & (F.col("size") >= length)).select("key1", "key2", F.col("size").alias("n_removed"), F.lit(1).cast("long").alias("n_spans"), *(nothing[c].alias(c) for c in names[4:]))
    done = cut.unionByName(copied)
    if with_text:
        left = rows.select("row", "key1", "key2").join(done, ["key1", "key2"], "left")
        return left.select(*[(F.coalesce("kept", "row.text") if c == "text" else F.col("row").getField(c)).alias(c) for c in docs.columns])
    small = rows.select(F.col("row.doc_id").alias("doc_id"), "key1", "key2", F.octet_length("bytes").cast("long").alias("n_bytes"), F.sha2("bytes", 256).alias("sha"), *([F.coalesce("row.text", F.lit("")).alias("text")] if with_kept else []))
    return small.join(done, ["key1", "key2"], "left").select(
        "doc_id", "n_bytes", F.coalesce("n_removed", F.lit(0).cast("long")).alias("n_removed"), F.coalesce("n_spans", F.lit(0).cast("long")).alias("n_spans"), F.coalesce("kept_sha256", "sha").alias("kept_sha256"),
        *([F.coalesce("kept", "text").alias("text")] if with_kept else []),
    )
