"""Groups of near copies are connected without their pairs."""

import random

from quillspark.llm import jaccard_join, near_texts
from quillspark.llm.common import text_key


def near_copies(n, edits, words=160):
    """Copies of one text, each with some words of its own."""
    rng = random.Random(7)
    base = [f"w{i}" for i in range(words)]
    texts = []
    for i in range(n):
        own = list(base)
        for at in rng.sample(range(words), edits):
            own[at] = f"x{rng.randrange(40)}"
        texts.append(" ".join(own))
    return texts


def by_pairs(texts, shingle, share):
    """The smallest index reachable over pairs of sets with the index share (in hundredths)."""
    sets = [{tuple(w[i : i + shingle]) for i in range(len(w) - shingle + 1)} for w in map(str.split, texts)]
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            if 100 * len(a & sets[j]) >= share * len(a | sets[j]) and find(i) != find(j):
                root[max(find(i), find(j))] = min(find(i), find(j))
    return [find(i) for i in range(len(texts))]


def counting(monkeypatch, module):
    counts, written = {}, module.written

    def count(df, name):
        out = written(df, name)
        counts[name] = counts.get(name, 0) + out.count()
        return out

    monkeypatch.setattr(module, "written", count)
    return counts


def test_a_group_of_near_copies_is_joined_without_its_pairs(spark, monkeypatch):
    texts = near_copies(200, 4, 320)
    counts = counting(monkeypatch, jaccard_join)
    rows = jaccard_join.join_components(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert {r["doc_id"]: r["component_id"] for r in rows} == dict(enumerate(by_pairs(texts, 4, 85)))
    assert counts["found"] < 5 * len(texts)


def test_a_group_of_near_texts_is_connected_without_its_pairs(spark, monkeypatch):
    texts = near_copies(200, 3)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    keyed = docs.select("doc_id", *text_key(docs["text"]), "text")
    none = spark.createDataFrame([], "a struct<key1:bigint,key2:bigint>, b struct<key1:bigint,key2:bigint>")
    counts = counting(monkeypatch, near_texts)
    labels = near_texts.components_of_texts(keyed.select("key1", "key2", "text"), none)
    found = {(r["node"]["key1"], r["node"]["key2"]): tuple(r["label"]) for r in labels.collect()}
    ids = {r["doc_id"]: (r["key1"], r["key2"]) for r in keyed.collect()}
    want = by_pairs(texts, 5, 80)
    same = lambda f: {(i, j) for i in ids for j in ids if f(i) == f(j)}
    assert same(lambda i: found.get(ids[i], ids[i])) == same(lambda i: want[i])
    assert counts["pairs"] < 25 * len(texts)
