"""Similarity join of word n-gram sets at a Jaccard index of 0.85, by PartEnum signatures, and the components of its links.

Two sets whose index is at least 0.85 differ in at most 15 / 185 of the sum of their sizes. Sizes are cut into bands, each
ending at its start / 0.85, so two such sets lie in one band or in neighbouring ones: a set signs for its own band and for the
next, and in the larger one's band both are known to differ in at most k = 30 / 185 of the band's largest size. The feature
domain is cut into cells by a hash:

- up to SHORT differences: (k + 1) / 2 first-level partitions of three cells. Some partition holds at most one difference, so
  two of its three cells agree: all pairs of cells are enumerated, each is a signature;
- beyond: k + 1 + slack cells, one signature each. slack + 1 of them agree at least, so a set may leave out its cells with the
  fewest elements, as long as it leaves out no more than slack (whole levels of emptiness only, so that two sets leave out the
  same of the cells they agree in). That spares the signatures of empty cells, which unlike sets share.

Sets that share a signature meet at its smallest member. Map tasks do so for their own documents first and hand on one member
of a signature each, so that a hot one costs a task a row for each map task. A set goes with a sketch of PARITIES bits, each the parity
of the number of its elements there; the bits in which two sketches differ are no more than the elements in which the sets do, so that
most unlike pairs go without a look at the sets. Of a set's meetings one is verified at first; those that it doesn't connect come after.

Where a signature of three members or more then still holds several components (sets that agree in one cell only), the members outside
its largest component meet two members of it each, by the order of a hash, and of all these the closest sketch is verified: a group of near
copies is connected by some of its links, without its pairs. Where a signature holds several components even then, the members outside its
largest one are compared with those of other components, by sizes and sketches first. Signatures of more than MANY members
are not compared as a whole: their members meet at their rarest elements, for sets of n elements with an index of 0.85 share one of the
first n - ceil(0.85 n) + 1 in any common order. Texts of that kind which agree in such elements, too, but are not alike, cost the square of
their number in comparisons of sketches (not in rows).

Equal sets are one node throughout. Nodes go by 128 bits; the signatures carry 64 of them, and nodes that agree in these are
verified against each other as well.

Case rules: words are runs without blanks, A-Z in lower case; fewer words than a shingle has are one shingle; null and blank
texts have no shingles and link with nothing, so that they are their own components. Null doc_ids are kept, and
the component id is the smallest doc_id that isn't null (null if there is none); repeated rows are kept.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillspark.llm import simhash
from quillspark.llm.common import written

SHINGLE = 4
#: The Jaccard index that links, in hundredths.
LINK = 85
#: Differences up to which pairs of three cells are signatures.
SHORT = 15
#: Signatures that a task gathers before it hands them on, and those of a partition that they meet in.
FLUSH, MEETING = 1 << 19, 1 << 20
#: Bits of a sketch, and members of a signature that are compared with each other.
PARITIES, MANY = 512, 2048
#: Members among which one that is outside of the largest component looks for two of it.
PART = 256

SKETCH = [f"odd{i}" for i in range(PARITIES // 64)]
_STEP = np.uint64(0x9E3779B97F4A7C15)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words whose output bits all depend on all input bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_PLACES = mixed(np.arange(1, SHINGLE + 2, dtype=np.uint64) * _STEP) | np.uint64(1)


def shingle_set(text: bytes | None) -> np.ndarray:
    """The distinct shingles' hashes, in order."""
    found = (text or b"").lower().split()
    if not found:
        return np.empty(0, np.uint64)
    words = np.fromiter(map(xxhash.xxh64_intdigest, found), np.uint64, len(found))
    n = min(SHINGLE, len(words))
    total = np.full(len(words) - n + 1, _PLACES[SHINGLE] * np.uint64(n), np.uint64)
    for i in range(n):
        total += words[i : len(words) - n + 1 + i] * _PLACES[i]
    total = np.sort(mixed(total))
    return total[np.concatenate([[True], total[1:] != total[:-1]])]


@lru_cache(1 << 16)
def bands(n: int) -> tuple[tuple[int, int], tuple[int, int]]:
    """Number and largest size of the size's own band and of the next."""
    i, low = 0, 1
    while True:
        high = low * 100 // LINK
        if n <= high:
            return (i, high), (i + 1, (high + 1) * 100 // LINK)
        i, low = i + 1, high + 1


def signatures(own: np.ndarray) -> np.ndarray:
    """The signatures of a set of hashes. Two sets with an index of 0.85 that are not equal have one in common."""
    out = []
    for band, high in bands(len(own)):
        k = 2 * (100 - LINK) * high // (100 + LINK)
        if k == 0:
            continue  # such sets are alike only if they are equal
        slack = 0 if k <= SHORT else (k + 1) // 4
        cells = 3 * ((k + 2) // 2) if k <= SHORT else k + 1 + slack
        seed = mixed(np.array([band + 1], np.uint64) * _STEP)
        x = mixed(own ^ seed)
        at = ((x >> np.uint64(32)) * np.uint64(cells) >> np.uint64(32)).astype(np.int64)
        content = np.zeros(cells, np.uint64)
        np.add.at(content, at, mixed(x + _STEP))
        content = mixed(content + (np.arange(cells, dtype=np.uint64) + np.uint64(1)) * seed)
        if k <= SHORT:
            triples = content.reshape(-1, 3)
            out += [mixed(triples[:, a] + triples[:, b] * _PLACES[b]) for a, b in combinations(range(3), 2)]
            continue
        size = np.bincount(at, minlength=cells)
        fewer = np.cumsum(np.bincount(size))
        least = int(np.searchsorted(fewer, slack, side="right"))  # cells of fewer elements are slack at most
        out.append(content[size >= least])
    return np.concatenate(out) if out else np.empty(0, np.uint64)


def node_of(own: np.ndarray) -> tuple[int, int]:
    """Two signed longs that name a set."""
    low = xxhash.xxh128_digest(own.tobytes())
    return int.from_bytes(low[:8], "big", signed=True), int.from_bytes(low[8:], "big", signed=True)


def parities(own: np.ndarray) -> np.ndarray:
    """The sketch as signed longs."""
    odd = np.bincount((mixed(own + _STEP) % np.uint64(PARITIES)).astype(np.int64), minlength=PARITIES) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64)


def _texts(batch: pa.RecordBatch) -> Iterator[bytes | None]:
    column = batch.column("text")
    return (x.as_py() for x in column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()))


def _noded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [(*node_of(s), len(s), *parities(s)) for s in map(shingle_set, _texts(batch))]
        values = np.array(found, np.int64).reshape(-1, 3 + len(SKETCH))
        columns = [c for c in batch.schema.names if c != "text"]
        rest = [pa.array(values[:, i]) for i in range(values.shape[1])]
        yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in columns], *rest], names=[*columns, "key1", "key2", "n", *SKETCH])


def _held(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The sets themselves, a few rows at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            sets = [shingle_set(t) for t in _texts(batch.slice(at, 256))]
            keys = np.array([node_of(s) for s in sets], np.int64).reshape(-1, 2)
            flat = np.concatenate([*sets, np.empty(0, np.uint64)]).view(np.int64)
            offsets = np.concatenate([[0], np.cumsum([len(s) for s in sets])])
            held = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat))
            yield pa.RecordBatch.from_arrays([pa.array(keys[:, 0]), pa.array(keys[:, 1]), held], names=["key1", "key2", "held"])


def _met(sigs: np.ndarray, names: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (signature, name) in order, and for each the smallest name of its signature."""
    order = np.lexsort((names, sigs))
    sigs, names = sigs[order], names[order]
    new = np.ones(len(sigs), bool)
    new[1:] = (sigs[1:] != sigs[:-1]) | (names[1:] != names[:-1])
    sigs, names = sigs[new], names[new]
    first = np.ones(len(sigs), bool)
    first[1:] = sigs[1:] != sigs[:-1]
    return sigs, names, names[first][np.cumsum(first) - 1] if len(sigs) else names


def _lists(rows: list[tuple[int, np.ndarray, np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    """Rows of a place and three lists of words."""
    offsets = pa.array(np.concatenate([[0], np.cumsum([len(r[1]) for r in rows])]), pa.int32())
    each = [pa.ListArray.from_arrays(offsets, pa.array(np.concatenate([r[i] for r in rows]).view(np.int64))) for i in (1, 2)]
    rest = pa.array(np.concatenate([[0], np.cumsum([len(r[3]) for r in rows])]), pa.int32())
    each.append(pa.ListArray.from_arrays(rest, pa.array(np.concatenate([r[3] for r in rows]).view(np.int64))))
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), *each], names=["place", "sigs", "names", "centres"])


def _signed(places: int, most: int):
    """Signatures by place, as one row of lists for each; meetings among a task's own documents as rows with centres."""

    def flush(sigs: list[np.ndarray], names: list[int]) -> pa.RecordBatch:
        each = np.repeat(np.array(names, np.int64), [len(s) for s in sigs]).view(np.uint64)
        flat, name, centre = _met(np.concatenate(sigs), each)
        none = np.empty(0, np.uint64)
        place = (flat >> np.uint64(32)) * np.uint64(places) >> np.uint64(32)  # flat is in order, so is place
        first = name == centre
        bounds = np.searchsorted(place[first], np.arange(places + 1))
        ones, by = flat[first], name[first]
        rows = [(p, ones[a:b], by[a:b], none) for p, (a, b) in enumerate(zip(bounds[:-1], bounds[1:])) if b > a]
        rest = [x[~first] for x in (flat, name, centre)]
        for at in range(0, len(rest[0]), 1 << 16):
            part = [x[at : at + (1 << 16)] for x in rest]
            rows.append((int(part[0][0] % np.uint64(places)), *part))
        return _lists(rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sigs, names, n = [], [], 0
        for batch in batches:
            for text in _texts(batch):
                own = shingle_set(text)
                if not len(own) or not len(found := signatures(own)):
                    continue
                sigs.append(found)
                names.append(node_of(own)[0])
                n += len(found)
                if n >= most:
                    yield flush(sigs, names)
                    sigs, names, n = [], [], 0
        if n:
            yield flush(sigs, names)

    return run


def _meetings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """sig, member, centre: for each signature of several members, all but the smallest with the smallest."""

    def out(sigs: np.ndarray, names: np.ndarray, centres: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x.view(np.int64)) for x in (sigs, names, centres)], names=["sig", "member", "centre"])

    words = lambda column: column.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
    sigs, names = [], []
    for batch in batches:
        done = np.array([len(c) > 0 for c in batch.column("centres")], bool)
        ready, rest = batch.filter(pa.array(done)), batch.filter(pa.array(~done))
        if ready.num_rows:
            yield out(*[words(ready.column(c)) for c in ("sigs", "names", "centres")])
        sigs.append(words(rest.column("sigs")))
        names.append(words(rest.column("names")))
    if sigs:
        flat, name, centre = _met(np.concatenate(sigs), np.concatenate(names))
        more = name != centre
        yield out(flat[more], name[more], centre[more])


def _node(prefix: str = "") -> Column:
    return F.struct(F.col(f"{prefix}key1").alias("key1"), F.col(f"{prefix}key2").alias("key2"))


def _apart(a: str, b: str) -> Column:
    """The bits in which the sketches of two rows' structs differ."""
    return sum((F.bit_count(F.col(f"{a}.{x}").bitwiseXOR(F.col(f"{b}.{x}"))) for x in SKETCH), F.lit(0))


def _may_link(a: str, b: str, link: int = LINK) -> Column:
    """Whether two rows (structs of n and a sketch) can have the index (in hundredths), by sizes and parities."""
    n = F.col(f"{a}.n"), F.col(f"{b}.n")
    return (100 * F.least(*n) >= link * F.greatest(*n)) & ((100 + link) * _apart(a, b) <= (100 - link) * (n[0] + n[1]))


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b: nodes) that link, written. sets: node, held."""
    both = pairs.join(sets.toDF("a", "held_a"), "a").join(sets.toDF("b", "held_b"), "b")
    both = both.select("a", "b", (F.size("held_a") + F.size("held_b")).alias("sum"), F.size(F.array_intersect("held_a", "held_b")).alias("shared"))
    return written(both.filter(100 * F.col("shared") >= LINK * (F.col("sum") - F.col("shared"))).select("a", "b"), "verified")


def _sets(keyed: DataFrame, nodes: DataFrame) -> DataFrame:
    """node, held of some nodes (doc_id, of_text), written; keyed: doc_id, of_text, text."""
    same = (F.col("l.of_text") == F.col("r.of_text")) & F.col("l.doc_id").eqNullSafe(F.col("r.doc_id"))
    texts = keyed.dropDuplicates(["of_text", "doc_id"]).alias("l").join(nodes.select("doc_id", "of_text").alias("r"), same, "left_semi").select("text")
    sets = texts.mapInArrow(_held, "key1 long, key2 long, held array<bigint>")
    return written(sets.select(_node().alias("node"), "held"), "sets")


def mixed_components(members: DataFrame, by: str) -> DataFrame:
    """members (by, node, label, of) of each by that holds several components, with the label of its largest one (main) and the number of its members, written."""
    kinds = members.groupBy(by, "label").agg(F.count("*").alias("k")).groupBy(by)
    kinds = kinds.agg(F.count("*").alias("labels"), F.sum("k").alias("size"), F.max(F.struct("k", "label")).alias("most")).filter("labels > 1")
    return written(members.select(by, "node", "label", "of").join(kinds.select(by, "size", F.col("most.label").alias("main")), by), "across")


def beside(members: DataFrame, by: str, link: int = LINK) -> DataFrame:
    """a, b, apart: members outside of a by's largest component with two of it, which come next to them by a hash, if they may link. members: mixed_components.

    So there are two rows for each member at most. Large groups are dealt to parts of about PART members.
    """
    parts = members.withColumn("part", F.pmod(F.xxhash64("node"), F.ceil(F.col("size") / PART))).withColumn("turn", F.xxhash64(by, "node"))
    inside = F.when(F.col("label") == F.col("main"), F.struct("node", "of"))
    next_to = [F.last(inside, ignorenulls=True).over(Window.partitionBy(by, "part").orderBy(turn, "node")) for turn in (F.col("turn"), F.col("turn").desc())]
    met = parts.select("node", "label", "main", "of", F.array(*next_to).alias("others")).filter("label != main")
    met = met.select("node", "of", F.explode("others").alias("other")).filter("other is not null").filter(_may_link("of", "other.of", link))
    return met.select(F.col("node").alias("a"), F.col("other.node").alias("b"), _apart("of", "other.of").alias("apart")).distinct()


def across(members: DataFrame, by: str, link: int = LINK) -> DataFrame:
    """a, b, apart: pairs of members of one by whose labels differ and that may link. apart: of their sketches. members: mixed_components.

    Members of the largest component of a by are not compared with each other; a is never one of them.
    """
    x, y = members.filter("label != main").alias("x"), members.alias("y")
    new = (F.col("x.label") != F.col("y.label")) & ((F.col("y.label") == F.col("y.main")) | (F.col("x.node") < F.col("y.node")))
    met = x.join(y, (F.col(f"x.{by}") == F.col(f"y.{by}")) & new & _may_link("x.of", "y.of", link))
    return met.select(F.col("x.node").alias("a"), F.col("y.node").alias("b"), _apart("x.of", "y.of").alias("apart")).distinct()


def labelled_again(members: DataFrame, labels: DataFrame) -> DataFrame:
    return members.drop("label").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))


def closest(pairs: DataFrame) -> DataFrame:
    """Of each a the b with the closest sketch. pairs: a, b, apart."""
    return pairs.groupBy("a").agg(F.min(F.struct("apart", "b")).alias("best")).select("a", "best.b")


def _rarest(sets: DataFrame) -> DataFrame:
    """element, node: of each set of n the first n - ceil(0.85 n) + 1 elements, the rarest of these sets first."""
    each = sets.select("node", F.size("held").alias("n"), F.explode("held").alias("element"))
    rare = each.join(each.groupBy("element").agg(F.count("*").alias("often")), "element")
    listed = rare.groupBy("node", "n").agg(F.sort_array(F.collect_list(F.struct("often", "element"))).alias("own"))  # a set's own elements
    first = F.slice("own", 1, F.col("n") - F.ceil(F.col("n") * LINK / 100).cast("int") + 1)
    return listed.select("node", F.explode(F.transform(first, lambda x: x["element"])).alias("element"))


def components_of_sets(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(doc_id, key1, key2, n for each row of docs, node and label for the nodes that have links). docs: doc_id, text."""
    spark = docs.sparkSession
    keyed = docs.select("doc_id", F.xxhash64("text").alias("of_text"), "text")
    noded = written(keyed.mapInArrow(_noded, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, of_text long, key1 long, key2 long, n long, {', '.join(f'{x} long' for x in SKETCH)}"), "noded")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "of_text")).alias("first")
    nodes = noded.filter("n > 0").groupBy("key1", "key2").agg(F.first(F.struct("n", *SKETCH)).alias("of"), first)
    nodes = written(nodes.select("key1", _node().alias("node"), "of", "first.doc_id", "first.of_text"), "nodes")

    total = nodes.agg(F.sum("of.n")).first()[0] or 0
    places = max(1, -(-total // MEETING)) * 4
    packed = docs.select("text").mapInArrow(_signed(places, FLUSH), "place int, sigs array<bigint>, names array<bigint>, centres array<bigint>")
    met = packed.repartition(places // 4, "place").mapInArrow(_meetings, "sig long, member long, centre long")
    met = written(met, "meetings")

    # names to nodes; nodes of one name meet, too
    named = lambda x: nodes.select(F.col("key1").alias(x), F.col("node").alias(f"{x}_node"), F.col("of").alias(f"{x}_of"))
    pairs = met.groupBy("member", "centre").agg(F.count("*").alias("meetings"))
    pairs = pairs.join(named("member"), "member").join(named("centre"), "centre").filter(_may_link("member_of", "centre_of"))
    pairs = pairs.select(F.col("member_node").alias("a"), F.col("centre_node").alias("b"), "meetings")
    namesakes = nodes.groupBy("key1").agg(F.min("node").alias("b"), F.max("node").alias("a")).filter("a != b")
    pairs = written(pairs.union(namesakes.select("a", "b", F.lit(0).cast("long"))), "pairs")
    ends = lambda pairs: pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
    sets = _sets(keyed, nodes.join(ends(pairs), "node", "left_semi"))

    # a set's likeliest meeting first, then those that it doesn't connect
    likeliest = pairs.groupBy("a").agg(F.max(F.struct("meetings", "b")).alias("best")).select("a", "best.b")
    links = verified(likeliest, sets)
    labels = simhash.components(links)
    label = lambda x: labels.select(F.col("node").alias(x), F.col("label").alias(f"{x}_label"))
    apart = lambda df: df.join(label("a"), "a", "left").join(label("b"), "b", "left").filter(F.coalesce("a_label", "a") != F.coalesce("b_label", "b")).select("a", "b")
    more = written(apart(pairs.select("a", "b").join(likeliest, ["a", "b"], "left_anti")), "more")
    if not more.isEmpty():
        links = written(links.union(verified(more, sets)), "links")
        labels = simhash.components(links)

    # signatures of three members or more that may still hold several components
    members = met.select("sig", F.col("member").alias("key1")).union(met.select("sig", "centre")).distinct()
    sizes = members.groupBy("sig").agg(F.count("*").alias("members")).filter("members > 2")
    members = members.join(sizes, "sig").join(nodes, "key1").join(labels, "node", "left")
    members = written(members.select("sig", "members", "node", F.coalesce("label", "node").alias("label"), "of"), "members")
    mixed = mixed_components(members.filter(F.col("members") <= MANY), "sig")
    known = pairs.select("a", "b").union(pairs.select("b", "a"))
    near = written(closest(beside(mixed, "sig").join(known, ["a", "b"], "left_anti")), "near")
    with_sets = lambda pairs: sets.union(_sets(keyed, nodes.join(ends(pairs), "node", "left_semi").join(sets, "node", "left_anti")))
    if not near.isEmpty():
        sets = with_sets(near)
        links = written(links.union(verified(near, sets)), "links")
        labels = simhash.components(links)
        known = known.union(near).union(near.select("b", "a"))
        mixed = mixed_components(labelled_again(mixed, labels), "sig")
    found = across(mixed, "sig")
    many = members.filter(F.col("members") > MANY).select("node", "label", "of").dropDuplicates(["node"])
    many = written(labelled_again(many, labels), "many")
    if not many.isEmpty():
        held = sets.join(many, "node", "left_semi").union(_sets(keyed, nodes.join(many, "node", "left_semi").join(sets, "node", "left_anti")))
        found = found.union(across(mixed_components(_rarest(held).join(many, "node"), "element"), "element")).distinct()
    found = written(found.join(known, ["a", "b"], "left_anti"), "found")
    if found.isEmpty():
        return noded, labels
    sets = with_sets(found)

    # the closest sketch first, then those that it doesn't connect
    first = closest(found)
    links = written(links.union(verified(first, sets)), "links")
    labels = simhash.components(links)
    more = written(apart(found.select("a", "b").join(first, ["a", "b"], "left_anti")), "more")
    return noded, labels if more.isEmpty() else simhash.components(links.union(verified(more, sets)))


def join_components(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id for each row of docs (doc_id, text)."""
    docs = docs.select("doc_id", "text")
    noded, labels = components_of_sets(docs)
    nodes = noded.filter("n > 0").groupBy(_node().alias("node")).agg(F.min("doc_id").alias("least")).join(labels, "node", "left")
    nodes = written(nodes.select("node", "least", F.coalesce("label", "node").alias("label")), "labelled")
    ids = nodes.groupBy("label").agg(F.min("least").alias("component_id"))
    found = written(nodes.join(ids, "label").select("node.*", "component_id"), "ids")
    linked = noded.filter("n > 0").join(found, ["key1", "key2"]).select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    return linked.union(noded.filter("n = 0").select("doc_id", "n", F.col("doc_id").alias("component_id")))
