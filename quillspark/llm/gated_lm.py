"""Document log-likelihoods by a gated recurrent language model with a class-factored output.

log P(text) is a sum over its tokens (words, then one end) of log P(class | state) + log P(word | class, state). The state
is that of a gated recurrent unit in numpy, zero at a text's start and carried through it from window to window, so the whole
text is scored. The VOCABULARY commonest words form word classes, in which a softmax over the state chooses the word. All
other words, however rare, are in tail classes that are chosen by the state like any class; a word in a tail class has the
probability (c + 0.5) / Z with its count c in all training tokens and the class's total Z, so unknown words have one too.

What is gathered from the corpus, all of it from every training text:
- counts of every word (a distributed aggregation; kept as a table, never on the driver), of which the FREQUENT commonest
  words, at most, travel to the executors to look words up;
- which of the CONTEXTS commonest words the texts hold that words and endings stand in; that tells the topics (such as
  languages) that word classes and tail classes are made of;
- the weights, by truncated backpropagation: a first fit on SEED_STRETCHES distinct stretches of SEED_TOKENS tokens gives all
  tasks one place to start from; then training texts are dealt to groups of about GROUP_TOKENS tokens by their ids and
  contents, each group goes on from the first fit through all its texts, and the weights are averaged by tokens. How the
  table is cut into partitions makes no difference.

Case rules: a null text is an empty one: it has the end token only; null doc_ids and repeated rows are scored like any
other; a null doc_id is not held out; other columns are ignored; with no training rows every word is unknown.
"""

from __future__ import annotations

import ctypes
import heapq
import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import pairwise, repeat
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import written

FREQUENT = 131_072
VOCABULARY = 2_048
#: Buckets that the endings of other words are hashed to.
ENDINGS = 2_048
CONTEXTS = 48
TOPICS = 32
CLASS_WORDS = 44
SEED_STRETCHES, SEED_TOKENS = 1_500, 512
GROUP_TOKENS = 4_000_000
HIDDEN = 32
WINDOW = 40
#: Lanes that are scored side by side, and trained on in the first fit and in the groups.
LANES, SEED_LANES, TRAIN_LANES = 512, 96, 1_024
#: Steps of the weights that a stretch of training has at least, if it is long enough.
UPDATES = 64
#: Tokens that a task holds at a time.
HELD_TOKENS = 4_000_000
END = b"\n"
#: Words that a task counts before it hands them on.
COUNTED = 1_000_000
#: Bytes of texts whose words are told apart at a time.
CUT_BYTES = 4_000_000


def tokens(text: str | bytes | None) -> list[bytes]:
    """Words as UTF-8, and the end. Of bytes, lower() and split() touch A-Z and the ASCII white space only."""
    own = (text.encode() if isinstance(text, str) else text or b"").lower().split()
    own.append(END)
    return own


def _cut(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """The same rows in batches with texts of about CUT_BYTES."""
    ends, at = np.cumsum(pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy(zero_copy_only=False).astype(np.int64)), 0
    while at < len(batch):
        stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + CUT_BYTES, side="right")))
        yield batch.slice(at, stop - at)
        at = stop


def distinct_tokens(texts: pa.Array) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """For strings: their distinct words and the end, which of these each token is, and each text's number of tokens."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    flat = lists.flatten()
    full = pc.binary_length(flat).to_numpy(zero_copy_only=False) > 0  # white space at a text's ends gives empty words
    before = np.concatenate(([0], np.cumsum(full)))
    offsets = lists.offsets.to_numpy() - lists.offsets[0].as_py()
    numbers = before[offsets[1:]] - before[offsets[:-1]] + 1
    coded = flat.filter(pa.array(full)).dictionary_encode()
    words = [*coded.dictionary.cast(pa.binary()).to_pylist(), END]
    of_words = np.ones(int(numbers.sum()), bool)
    of_words[np.cumsum(numbers) - 1] = False
    at = np.full(len(of_words), len(words) - 1, np.int32)
    at[of_words] = coded.indices.to_numpy()
    return words, at, numbers


def _keep_memory() -> None:
    """Tells the C library to use freed memory again. Otherwise each large array is mapped anew, which takes longer than
    the arithmetic."""
    try:
        library = ctypes.CDLL(None)
        library.mallopt(-3, 1 << 30)  # M_MMAP_THRESHOLD
        library.mallopt(-1, 1 << 30)  # M_TRIM_THRESHOLD
    except (OSError, AttributeError):  # not the GNU library: slower, nothing else
        pass


def held_out(doc_id: Column, parts: int = 5) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % parts == 1, F.lit(False))


def ending(word: bytes) -> int:
    """The bucket of a word's last three bytes; punctuation after it counts for nothing."""
    return crc32(word.rstrip(b".,;:!?")[-3:]) % ENDINGS


@dataclass
class Words:
    """Codes of words: their ranks below the size of the vocabulary, from there on the buckets of endings."""

    ids: dict[bytes, int]  # ranks of frequent words
    logs: np.ndarray  # log10(c + 0.5) of frequent words, in the order of ids
    vocabulary: int

    def codes(self) -> np.ndarray:
        """The code of each frequent word."""
        return np.array([i if i < self.vocabulary else self.vocabulary + ending(w) for w, i in self.ids.items()], np.int16)


@dataclass
class Classes:
    """What the network chooses from: a topic, then one of the topic's word classes or its tail, then a word of the class."""

    vocabulary: int
    topics: int
    words: list[list[np.ndarray]]  # of each topic, the words of each of its classes
    endings: np.ndarray  # topic of each bucket of endings
    topic: np.ndarray = field(init=False)  # topic of each code
    kind: np.ndarray = field(init=False)  # class of each code; those of a topic follow one another, the last is its tail
    row: np.ndarray = field(init=False)  # place of each word among all words in the order of their classes
    topic_edges: list[int] = field(init=False)  # where topics begin among classes
    word_edges: list[int] = field(init=False)  # where classes begin among words

    def __post_init__(self) -> None:
        n = self.vocabulary + len(self.endings)
        self.topic, self.kind, self.row = np.zeros(n, np.int16), np.zeros(n, np.int16), np.zeros(n, np.int64)
        self.topic_edges, self.word_edges = [0], [0]
        for t, classes in enumerate(self.words):
            for own in classes:
                self.topic[own], self.kind[own] = t, len(self.word_edges) - 1
                self.row[own] = self.word_edges[-1] + np.arange(len(own))
                self.word_edges.append(self.word_edges[-1] + len(own))
            tail = self.vocabulary + np.flatnonzero(self.endings == t)
            self.topic[tail], self.kind[tail] = t, len(self.word_edges) - 1
            self.word_edges.append(self.word_edges[-1])
            self.topic_edges.append(len(self.word_edges) - 1)

    @property
    def start(self) -> int:
        """The input before a text's first token."""
        return len(self.kind)


def learn_classes(neighbours: np.ndarray, vocabulary: int, topics: int = TOPICS) -> Classes:
    """neighbours: for each code, how much of each of the commonest words the texts have that it stands in."""
    total = neighbours.sum(1, keepdims=True)
    share = np.sqrt(neighbours / np.maximum(total, 1.0))
    weight = np.sqrt(np.minimum(total, 1e4))
    groups = np.zeros(len(neighbours), np.int64)
    if neighbours.sum() > 0:
        left, strength, _ = np.linalg.svd(share * weight, full_matrices=False)
        width = min(2 * topics, left.shape[1])
        low = left[:, :width] * strength[:width] / np.maximum(weight, 1e-9)
        low /= np.maximum(np.linalg.norm(low, axis=1, keepdims=True), 1e-9)
        mass = np.minimum(total[:, 0], 1e4)
        # the commonest code, then the codes that are farthest from those before, by weight
        centre = low[[int(mass.argmax())]]
        for _ in range(topics - 1):
            far = (1 - low @ centre.T).min(1) * mass
            centre = np.concatenate([centre, low[[int(far.argmax())]]])
        for _ in range(30):
            groups = (low @ centre.T).argmax(1)
            for g in range(topics):
                if mass[groups == g].sum() > 0:
                    centre[g] = (low[groups == g] * mass[groups == g, None]).sum(0)
            centre /= np.maximum(np.linalg.norm(centre, axis=1, keepdims=True), 1e-9)
    words = []
    for g in range(topics):
        own = np.flatnonzero(groups[:vocabulary] == g)
        words.append([own[i : i + CLASS_WORDS] for i in range(0, len(own), CLASS_WORDS)])
    return Classes(vocabulary, topics, words, groups[vocabulary:])


class Network:
    """A gated recurrent unit over codes with a class-factored softmax; weights are float32 arrays by name.

    Each code has a gate z (what is kept of every number of the state) and a candidate c, and h = z * h + (1 - z) * c: the
    minimal form of the unit, whose gates are read off the input. Sigmoids and tangents are taken once for each code, not
    for each token.
    """

    def __init__(self, classes: Classes, weights: dict[str, np.ndarray] | None = None):
        self.classes = classes
        n_in, rng = classes.start + 1, np.random.default_rng(1)
        some = lambda n: (rng.normal(size=(n, HIDDEN)) * 0.1 / np.sqrt(HIDDEN)).astype(np.float32)
        # some numbers of the state forget within a few tokens, others last for hundreds
        lasting = np.linspace(0, 5, HIDDEN)
        sizes = {"topic": classes.topics, "kind": classes.topic_edges[-1], "word": classes.word_edges[-1]}
        self.w = weights or {
            "gate": (rng.normal(size=(n_in, HIDDEN)) * 0.1 + lasting).astype(np.float32), "input": (rng.normal(size=(n_in, HIDDEN)) * 0.5).astype(np.float32),
            **{f"{k}_out": some(n) for k, n in sizes.items()}, **{f"{k}_bias": np.zeros(n, np.float32) for k, n in sizes.items()},
        }

    def inputs(self) -> tuple[np.ndarray, np.ndarray]:
        """z and c of each code."""
        return 1 / (1 + np.exp(-self.w["gate"])), np.tanh(self.w["input"])

    def states(self, x: np.ndarray, h: np.ndarray, inputs: tuple[np.ndarray, np.ndarray], saved: list | None = None):
        """States after each step of x (steps, lanes) from h (lanes, HIDDEN). A text's start sets its lane to zero."""
        z, c = inputs[0].take(x, 0), inputs[1].take(x, 0)
        if saved is not None:
            saved += [h, z, c]
        out = (1 - z) * c
        kept = np.where((x == self.classes.start)[:, :, None], 0, z)
        for t in range(len(x)):
            h = kept[t] * h
            h += out[t]
            out[t] = h
        if saved is not None:
            saved += [kept]
        return out, h

    def _choices(self, y: np.ndarray) -> tuple[np.ndarray, list[tuple[str, int, int, int, int, np.ndarray]]]:
        """Rows in the order of their classes, and the choices to be made: (of what, first and last of those to choose from,
        first and last row in that order, and what the rows choose, from zero)."""
        classes = self.classes
        kinds = classes.kind[y]
        order = np.argsort(kinds, kind="stable")
        y, kinds = y[order], kinds[order]
        choices = [("topic", 0, classes.topics, 0, len(y), classes.topic[y])]
        by_topic = np.searchsorted(kinds, classes.topic_edges).tolist()
        for (a, b), (first, last) in zip(pairwise(by_topic), pairwise(classes.topic_edges)):
            if b > a and last - first > 1:
                choices.append(("kind", first, last, a, b, kinds[a:b] - first))
        by_kind, rows = np.searchsorted(kinds, np.arange(len(classes.word_edges))).tolist(), classes.row[y]
        for (a, b), (first, last) in zip(pairwise(by_kind), pairwise(classes.word_edges)):
            if b > a and last - first > 1:
                choices.append(("word", first, last, a, b, rows[a:b] - first))
        return order, choices

    def _bounds(self) -> dict[str, bool]:
        """Whether logits may be too great for exp; the state's numbers are below 1, so the weights bound them."""
        return {k: len(self.w[f"{k}_out"]) > 0 and float((np.abs(self.w[f"{k}_out"]).sum(1) + np.abs(self.w[f"{k}_bias"])).max()) > 60 for k in ("topic", "kind", "word")}

    @staticmethod
    def _softmax(states: np.ndarray, weights: np.ndarray, bias: np.ndarray, target: np.ndarray, great: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """exp of the logits (by a common factor in each row), their sums, and the log probability of each row's target."""
        logits = states @ weights.T
        logits += bias
        if great:
            logits -= logits.max(1, keepdims=True)
        found = logits[np.arange(len(target)), target].astype(float)
        np.exp(logits, out=logits)
        sums = logits @ np.ones(logits.shape[1], logits.dtype)
        return logits, sums, found - np.log(sums)

    def log_probabilities(self, states: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Natural log of P(code | state) for each row; that of a tail class for the codes of endings."""
        order, choices = self._choices(y)
        states, logs, out, great = states[order], np.zeros(len(y)), np.empty(len(y)), self._bounds()
        for what, first, last, a, b, chosen in choices:
            logs[a:b] += self._softmax(states[a:b], self.w[f"{what}_out"][first:last], self.w[f"{what}_bias"][first:last], chosen, great[what])[2]
        out[order] = logs
        return out

    def gradients(self, x: np.ndarray, y: np.ndarray, mask: np.ndarray, h: np.ndarray):
        """Loss per token, gradients of its mean over a window and the last state (truncated backpropagation)."""
        w, n, saved = self.w, HIDDEN, []
        inputs = self.inputs()
        states, last = self.states(x, h, inputs, saved)
        first, z, c, kept = saved
        rows = np.flatnonzero(mask.ravel())
        order, choices = self._choices(y.ravel()[rows])
        rows = rows[order]
        flat, at, count, total = states.reshape(-1, n)[rows], np.arange(len(rows)), max(1, len(rows)), 0.0
        g = {k: np.zeros_like(v) for k, v in w.items() if k.endswith(("_out", "_bias"))}
        back_rows, great = np.zeros_like(flat), self._bounds()
        for what, begin, end, a, b, chosen in choices:
            own = w[f"{what}_out"][begin:end]
            p, sums, logs = self._softmax(flat[a:b], own, w[f"{what}_bias"][begin:end], chosen, great[what])
            total += float(logs.sum())
            p *= (1 / (count * sums))[:, None]
            p[at[: b - a], chosen] -= 1 / count
            g[f"{what}_out"][begin:end] = p.T @ flat[a:b]
            g[f"{what}_bias"][begin:end] = np.ones(b - a, p.dtype) @ p
            back_rows[a:b] += p @ own
        dh = np.zeros((x.size, n), flat.dtype)
        dh[rows] = back_rows
        dh = dh.reshape(*x.shape, n)
        for t in range(len(x) - 2, -1, -1):
            dh[t] += kept[t + 1] * dh[t + 1]
        # the candidate has the share 1 - z, and z weighs the state before against it; a start has no state before
        before = np.concatenate([first[None], states[:-1]])
        before *= (x != self.classes.start)[:, :, None]
        before -= c
        before *= dh
        dh *= 1 - z
        size = len(inputs[0])
        places = (x.ravel()[:, None] * n + np.arange(n)).ravel()
        d_gate = np.bincount(places, before.ravel(), size * n).reshape(size, n)
        d_input = np.bincount(places, dh.ravel(), size * n).reshape(size, n)
        g["gate"] = (d_gate * inputs[0] * (1 - inputs[0])).astype(flat.dtype)
        g["input"] = (d_input * (1 - inputs[1] ** 2)).astype(flat.dtype)
        return -total / count, g, last

    def train(self, stream: np.ndarray, rate: float, lanes: int) -> None:
        """Adam over windows of a stream of ids in which every text follows a start; lanes carry their states along."""
        start = self.classes.start
        if len(stream) < 2:
            return
        moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in self.w.items()}
        lanes = max(1, min(lanes, len(stream) // (UPDATES * WINDOW)))
        steps = -(-len(stream) // lanes)
        grid = np.ascontiguousarray(np.concatenate([stream, np.full(steps * lanes - len(stream), start)]).reshape(lanes, steps).T)
        # what a lane's last step is followed by is the next lane's first
        after = np.concatenate([grid[1:], np.append(grid[0, 1:], start)[None]])
        h, i, total = np.zeros((lanes, HIDDEN), np.float32), 0, -(-steps // WINDOW)
        for at in range(0, steps, WINDOW):
            x, y = grid[at : at + WINDOW], after[at : at + WINDOW]
            real = y != start
            _, g, h = self.gradients(x, np.where(real, y, 0), real, h)
            i += 1
            norm = np.sqrt(sum(float(np.vdot(v, v)) for v in g.values()))
            scale, lr = np.float32(min(1.0, 1.0 / (norm + 1e-9))), rate * (1 - 0.9 * i / total)
            for k, v in g.items():
                a, b = moments[k]
                v *= scale
                a *= 0.9
                a += 0.1 * v
                b *= 0.999
                v *= v
                b += 0.001 * v
                step = np.sqrt(b)
                step *= 1 / math.sqrt(1 - 0.999**i)
                step += 1e-8
                np.divide(a, step, out=step)
                step *= lr / (1 - 0.9**i)
                self.w[k] -= step


def streamed(texts: list[np.ndarray], start: int) -> np.ndarray:
    """Texts one after another, each after a start."""
    return np.concatenate([np.concatenate([[start], x]) for x in texts]).astype(np.int64) if texts else np.zeros(0, np.int64)


def score_texts(network: Network, texts: list[np.ndarray]) -> np.ndarray:
    """Natural log probabilities of texts of ids, without those of words within tail classes.

    Texts are dealt to lanes, the longest first, each to the lane that ends first; a lane has its texts one after another.
    """
    start, out = network.classes.start, np.zeros(len(texts))
    if not texts:
        return out
    sizes = np.array([len(x) for x in texts])
    lanes: list[list[int]] = [[] for _ in range(min(LANES, len(texts)))]
    ends = [(0, i) for i in range(len(lanes))]
    for t in np.argsort(-sizes, kind="stable").tolist():
        end, lane = ends[0]
        lanes[lane].append(t)
        heapq.heapreplace(ends, (end + int(sizes[t]), lane))
    lengths = np.array([sum(int(sizes[t]) for t in own) for own in lanes])
    by_length = np.argsort(-lengths, kind="stable")
    lengths = lengths[by_length]
    flat_y = np.concatenate([texts[t] for i in by_length.tolist() for t in lanes[i]]).astype(np.int64)
    flat_text = np.repeat([t for i in by_length.tolist() for t in lanes[i]], [int(sizes[t]) for i in by_length.tolist() for t in lanes[i]])
    flat_x = np.empty_like(flat_y)
    flat_x[1:] = flat_y[:-1]
    flat_x[np.flatnonzero(np.concatenate([[True], flat_text[1:] != flat_text[:-1]]))] = start
    begins = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    inputs, h = network.inputs(), np.zeros((len(lanes), HIDDEN), np.float32)
    for begin in range(0, int(lengths[0]), WINDOW):
        live = int(np.searchsorted(-lengths, -begin, side="left"))  # lanes that are longer than begin come first
        stop = min(begin + WINDOW, int(lengths[0]))
        steps = np.arange(begin, stop)[:, None]
        real = steps < lengths[:live]
        places = np.where(real, begins[:live] + steps, 0)
        states, h = network.states(np.where(real, flat_x[places], start), h[:live], inputs)
        chosen = places[real]
        out += np.bincount(flat_text[chosen], network.log_probabilities(states[real], flat_y[chosen]), len(texts))
    return out


# ---- passes over the corpus -----------------------------------------------------------------------------------------


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: Counter[bytes] = Counter()

    def handed_on() -> pa.RecordBatch:
        words = pa.array(list(counts), pa.binary()).cast(pa.string())
        out = pa.RecordBatch.from_arrays([words, pa.array(list(counts.values()), pa.int64())], names=["word", "c"])
        counts.clear()
        return out

    for batch in batches:
        for part in _cut(batch):
            words, at, _ = distinct_tokens(part.column("text"))
            counts.update(dict(zip(words, np.bincount(at, minlength=len(words)).tolist())))
            if len(counts) > COUNTED:
                yield handed_on()
    if counts:
        yield handed_on()


def word_counts(texts: DataFrame) -> DataFrame:
    """word, c of every token of texts (text)."""
    return texts.select("text").mapInArrow(_counted, "word string, c long").groupBy("word").agg(F.sum("c").alias("c"))


def most_frequent(counts: DataFrame, most: int) -> list[tuple[bytes, int]]:
    """About `most` of the commonest words, at most, the commonest first.

    Words are taken by levels of their counts; of the last level, which has too many, those with the smallest hashes are.
    """
    level = F.floor(F.log2(F.col("c").cast("double")) * 16)
    sizes = counts.groupBy(level.alias("level")).agg(F.count("*").alias("n")).collect()
    room, whole = most, 1 << 30
    wanted = F.lit(False)
    for r in sorted(sizes, key=lambda r: -r["level"]):
        if r["n"] > room:
            limit = int(0.95 * room / r["n"] * 2**64) - 2**63
            wanted = (level == r["level"]) & (F.xxhash64("word") < limit)
            break
        room, whole = room - r["n"], r["level"]
    found = [(r["word"].encode(), r["c"]) for r in counts.filter((level >= whole) | wanted).collect()]
    return sorted(found, key=lambda x: (-x[1], x[0]))


_ENCODED = "codes array<smallint>, n_frequent long, frequent_logs double, tail_logs double, rare array<long>"


class _Rare(dict):
    """Code and hash of words that aren't frequent, as they are met."""

    def __init__(self, vocabulary: int):
        super().__init__()
        self.vocabulary = vocabulary

    def __missing__(self, word: bytes) -> tuple[int, int]:
        if len(self) > 200_000:
            self.clear()
        h = xxhash.xxh64_intdigest(word, 42)
        self[word] = found = self.vocabulary + ending(word), h - (1 << 64) if h >> 63 else h
        return found


def encoded(docs: DataFrame, shared) -> DataFrame:
    """docs (text, ...) with what Words (a broadcast) say of the text in place of it.

    codes; the frequent words' number and logs, and the logs of those outside of the vocabulary; hashes of the other words.
    """
    keep = [c for c in docs.columns if c != "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _keep_memory()
        words = shared.value
        size, rare_words = words.vocabulary, _Rare(words.vocabulary)
        # the last ones are of the words that aren't frequent
        codes, logs = np.append(words.codes(), np.int16(0)), np.append(words.logs, 0.0)
        lists = lambda numbers, values: pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(numbers))), pa.int32()), pa.array(values))
        for batch in (part for whole in batches for part in _cut(whole)):
            found, at, numbers = distinct_tokens(batch.column("text"))
            ranks = np.fromiter(map(words.ids.get, found, repeat(-1)), np.int32, len(found))
            ids, hashes, unknown = codes[ranks], np.zeros(len(found), np.int64), np.flatnonzero(ranks < 0)
            if len(unknown):
                ids[unknown], hashes[unknown] = zip(*[rare_words[found[i]] for i in unknown.tolist()])
            ranks, begins = ranks[at], np.cumsum(numbers) - numbers
            each, rare = logs[ranks], ranks < 0
            n_rare = np.add.reduceat(rare.astype(np.int64), begins)
            columns = [lists(numbers, ids[at]), numbers - n_rare, np.add.reduceat(each, begins), np.add.reduceat(np.where(ranks >= size, each, 0.0), begins), lists(n_rare, hashes[at[rare]])]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), *(x if isinstance(x, pa.Array) else pa.array(x) for x in columns)], names=[*keep, "codes", "n_frequent", "frequent_logs", "tail_logs", "rare"])

    kinds = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
    return docs.select(*keep, "text").mapInArrow(run, f"{kinds}, {_ENCODED}")


def _codes(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    lists = batch.column("codes")
    return lists.values.to_numpy(), lists.offsets.to_numpy()


def _met(size: int, contexts: int):
    """place (code * contexts + rank), n: the occurrences of a code, each by the shares of the commonest words in its text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met = np.zeros((size, contexts))
        for batch in batches:
            codes, offsets = _codes(batch)
            for a, b in pairwise(offsets.tolist()):
                own, times = np.unique(codes[a:b], return_counts=True)
                common = int(np.searchsorted(own, contexts))
                if common:
                    shares = np.zeros(contexts)
                    shares[own[:common]] = times[:common] / (b - a)
                    met[own] += times[:, None] * shares
        at = np.flatnonzero(met)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(met.ravel()[at])], names=["place", "n"])

    return run


def seed_stretches(training: DataFrame, stretches: int) -> list[np.ndarray]:
    """At most so many distinct stretches of SEED_TOKENS codes, those with the smallest hashes, whatever text they are from."""
    total = training.agg(F.sum(F.ceil(F.size("codes") / SEED_TOKENS)).alias("n")).first()["n"] or 0
    if not total or not stretches:
        return []
    # each task hands on its share, and some more
    limit = min(1.0, 1.5 * stretches / total) * 2.0**64 - 2.0**63

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes, offsets = _codes(batch)
            found, hashes = [], []
            for a, b in pairwise(offsets.tolist()):
                for i in range(a, b, SEED_TOKENS):
                    raw = codes[i : min(b, i + SEED_TOKENS)].tobytes()
                    h = xxhash.xxh64_intdigest(raw, 7) - (1 << 63)
                    if h <= limit:
                        found.append(raw)
                        hashes.append(h)
            yield pa.RecordBatch.from_arrays([pa.array(hashes, pa.int64()), pa.array(found, pa.binary())], names=["h", "raw"])

    picked = training.select("codes").mapInArrow(run, "h long, raw binary").dropDuplicates(["h", "raw"]).orderBy("h", "raw").limit(stretches)
    return [np.frombuffer(bytes(r["raw"]), np.int16) for r in picked.collect()]


def _trained(shared):
    """tokens, weights of a group, which go on from the broadcast classes and weights through all its texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _keep_memory()
        classes, weights = shared.value
        network = Network(classes, {k: v.copy() for k, v in weights.items()})
        held, size, used = [], 0, 0
        for batch in batches:
            codes, offsets = _codes(batch)
            for a, b in pairwise(offsets.tolist()):
                held.append(codes[a:b])
                size += b - a
                if size > HELD_TOKENS:
                    network.train(streamed(held, classes.start), 0.005, TRAIN_LANES)
                    held, size, used = [], 0, used + size
        if held:
            network.train(streamed(held, classes.start), 0.005, TRAIN_LANES)
            used += size
        if used:
            flat = np.concatenate([network.w[k].ravel() for k in sorted(network.w)])
            yield pa.RecordBatch.from_arrays([pa.array([used], pa.int64()), pa.array([flat], pa.list_(pa.float32()))], names=["tokens", "weights"])

    return run


def groups_of(training: DataFrame, group_tokens: int) -> tuple[DataFrame, int]:
    """training (doc_id, key, codes) dealt to groups by doc_id and key, in one order whatever its partitions; the groups' number.

    Rows that are repeated so often that they would fill a group are dealt to all groups.
    """
    size = training.agg(F.sum(F.size("codes")).alias("tokens"), F.count("*").alias("rows")).first()
    groups = max(1, -(-(size["tokens"] or 0) // group_tokens))
    if groups > 1:
        # at most one for each group
        often = training.groupBy("doc_id", "key").agg(F.count("*").alias("n")).filter(F.col("n") > size["rows"] // groups + 1).select(F.col("doc_id").alias("d"), F.col("key").alias("k"))
        hot = training.join(F.broadcast(often), F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("key") == F.col("k")), "left")
        training = hot.withColumn("turn", F.when(F.col("k").isNotNull(), F.monotonically_increasing_id() % groups).otherwise(0)).drop("d", "k")
    else:
        training = training.withColumn("turn", F.lit(0))
    # a group is a partition, whatever number of partitions the session deals keys to: each group hands on all weights
    training = training.withColumn("group", ((F.pmod(F.xxhash64("doc_id", "key"), F.lit(groups)) + F.col("turn")) % groups).cast("int"))
    return training.repartitionById(groups, "group").sortWithinPartitions("key", "doc_id").select("codes"), groups


def fitted(training: DataFrame, first, group_tokens: int = GROUP_TOKENS) -> DataFrame:
    """tokens, weights of each group of training (doc_id, key, codes), from the broadcast classes and weights."""
    return groups_of(training, group_tokens)[0].mapInArrow(_trained(first), "tokens long, weights array<float>")


def averaged(fits: DataFrame, weights: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    sums = fits.select("tokens", F.posexplode("weights").alias("i", "w")).groupBy("i").agg((F.sum(F.col("w") * F.col("tokens")) / F.sum("tokens")).alias("w")).collect()
    if not sums:
        return weights
    flat = np.empty(len(sums), np.float32)
    for r in sums:
        flat[r["i"]] = r["w"]
    at, out = 0, {}
    for k in sorted(weights):
        out[k] = flat[at : at + weights[k].size].reshape(weights[k].shape).copy()
        at += weights[k].size
    return out


@dataclass
class Model:
    words: Words
    classes: Classes
    weights: dict[str, np.ndarray]
    tail_totals: np.ndarray  # Z of each tail class
    tokens: int  # of all training texts
    distinct: int
    counts: DataFrame  # word, c


def learn(docs: DataFrame, stretches: int = SEED_STRETCHES, frequent: int = FREQUENT, group_tokens: int = GROUP_TOKENS) -> tuple[Model, DataFrame]:
    """The model of the rows of docs (doc_id, text) that aren't held out, and all rows encoded."""
    spark = docs.sparkSession
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    training = docs.filter(~held_out(F.col("doc_id")))
    counts = written(word_counts(training), "word-counts")
    total = counts.agg(F.sum("c").alias("n"), F.count("*").alias("v")).first()
    common = most_frequent(counts, frequent)
    size = min(VOCABULARY, len(common))
    words = Words({w: i for i, (w, _) in enumerate(common)}, np.log10(np.array([c for _, c in common], float) + 0.5), size)
    known = spark.sparkContext.broadcast(words)
    rows = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.xxhash64("text").alias("key"), "text")
    rows = written(encoded(rows, known).withColumn("row", F.monotonically_increasing_id()), "encoded")
    training = rows.filter(~F.col("held_out")).select("doc_id", "key", "codes")

    contexts = min(CONTEXTS, size)
    neighbours = np.zeros((size + ENDINGS) * max(1, contexts))
    if contexts:
        met = training.select("codes").mapInArrow(_met(size + ENDINGS, contexts), "place int, n double").groupBy("place").agg(F.sum("n").alias("n"))
        for r in met.collect():
            neighbours[r["place"]] = r["n"]
    classes = learn_classes(neighbours.reshape(size + ENDINGS, -1), size)
    network = Network(classes)
    seeds = seed_stretches(training, stretches)
    _keep_memory()
    network.train(streamed(seeds + seeds, classes.start), 0.02, SEED_LANES)
    first = spark.sparkContext.broadcast((classes, network.w))
    weights = averaged(fitted(training, first, group_tokens), network.w)

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = known.value.ids
        for batch in batches:
            found = [w.as_py().encode() for w in batch.column("word")]
            place = [-1 if ids.get(w, size) < size else ending(w) for w in found]
            yield pa.RecordBatch.from_arrays([pa.array(place, pa.int32()), batch.column("c")], names=["place", "c"])

    totals = np.full(classes.topics, 0.5)
    masses = counts.mapInArrow(placed, "place int, c long").filter("place >= 0").groupBy("place").agg(F.sum(F.col("c") + 0.5).alias("z"))
    for r in masses.collect():
        totals[classes.endings[r["place"]]] += r["z"]
    return Model(words, classes, weights, totals, total["n"] or 0, total["v"], counts), rows


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about HELD_TOKENS codes."""
    held, size = [], 0
    for batch in batches:
        _, offsets = _codes(batch)
        at = 0
        while at < len(batch):
            stop = int(np.searchsorted(offsets, offsets[at] + HELD_TOKENS - size, side="right")) - 1
            stop = min(len(batch), max(stop, at + 1))
            held.append(batch.slice(at, stop - at))
            size += int(offsets[stop] - offsets[at])
            at = stop
            if size >= HELD_TOKENS or at < len(batch):
                yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                held, size = [], 0
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def _scored(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _keep_memory()
        classes, weights, log_totals = shared.value
        network = Network(classes, weights)
        log_of_code = np.concatenate([np.zeros(classes.vocabulary), log_totals[classes.endings]])
        for batch in _parts(batches):
            codes, offsets = _codes(batch)
            texts = [codes[a:b] for a, b in pairwise(offsets.tolist())]
            inside = [float(log_of_code[x].sum()) for x in texts]
            columns = [*(batch.column(c) for c in _KEPT), pa.array([len(x) for x in texts], pa.int64()), pa.array(score_texts(network, texts) / np.log(10) - np.array(inside))]
            yield pa.RecordBatch.from_arrays(columns, names=[*_KEPT, "n_tokens", "model"])

    return run


_KEPT = ["row", "doc_id", "held_out", "n_frequent", "frequent_logs", "tail_logs"]


def scored(rows: DataFrame, model: Model) -> DataFrame:
    """What score returns, for rows that learn has encoded."""
    shared = rows.sparkSession.sparkContext.broadcast((model.classes, model.weights, np.log10(model.tail_totals)))
    kinds = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in _KEPT)
    parts = rows.select(*_KEPT, "codes").mapInArrow(_scored(shared), f"{kinds}, n_tokens long, model double")
    rare = rows.select("row", F.explode("rare").alias("h"))
    met = rare.join(model.counts.select(F.xxhash64("word").alias("h"), "c"), "h", "left")
    sums = met.groupBy("row").agg(F.sum(F.log10(F.coalesce("c", F.lit(0)) + 0.5)).alias("rare_logs"), F.count("c").alias("rare_known"))
    rare_logs = F.coalesce("rare_logs", F.lit(0.0))
    return parts.join(sums, "row", "left").select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("n_frequent") + F.coalesce("rare_known", F.lit(0))).cast("long").alias("n_known"),
        F.lit(model.tokens).cast("long").alias("train_tokens"),
        (F.col("frequent_logs") + rare_logs - F.col("n_tokens") * math.log10(model.tokens + 0.5 * (model.distinct + 1))).alias("base_score"),
        (F.col("model") + F.col("tail_logs") + rare_logs).alias("score"),
    )


def score(docs: DataFrame, stretches: int = SEED_STRETCHES, frequent: int = FREQUENT, group_tokens: int = GROUP_TOKENS) -> DataFrame:
    """docs (doc_id, text) -> doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score (log10)."""
    model, rows = learn(docs, stretches, frequent, group_tokens)
    return scored(rows, model)
