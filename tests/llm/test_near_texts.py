import re
from collections import defaultdict

import corpus_pipeline
from quillspark.llm import near_texts
from test_operators import brute_fingerprint

FOLDER = "/root/testdata/sf0.001"


def shingles(text, n=5):
    w = [x for x in re.split(r"[\W_]+", (text or "").lower()) if x]
    return {" ".join(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


def close(a, b):
    return bool(a and b) and 10 * len(a & b) >= 8 * len(a | b)


def brute_kept(rows):
    """The smallest doc_id of each group, by comparing all pairs of texts."""
    texts = sorted({t or "" for _, t in rows})
    sets, fps = [shingles(t) for t in texts], [brute_fingerprint(t) for t in texts]
    parent = list(range(len(texts)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 2 or close(sets[i], sets[j]):
                parent[find(i)] = find(j)
    groups = defaultdict(list)
    for d, t in rows:
        groups[find(texts.index(t or ""))].append(d)
    return sorted(min(ids) for ids in groups.values())


def planted():
    """Groups of near copies, a chain whose ends are far apart, and texts that share a half only."""
    rows, d = [], 10_000
    for g in range(12):
        base = [f"g{g}w{i}" for i in range(120)]
        for k in range(7):
            own = list(base)
            if k:
                own[(17 * k) % 120] = f"edit{k}"
            rows.append((d, " ".join(own)))
            d += 1
    chain = [f"chain{i}" for i in range(200)]
    for k in range(8):
        chain[k * 20 : k * 20 + 8] = [f"c{k}x{i}" for i in range(8)]
        rows.append((d, " ".join(chain)))
        d += 1
    for k in range(5):
        rows.append((d, " ".join([f"half{i}" for i in range(60)] + [f"own{k}x{i}" for i in range(60)])))
        d += 1
    return rows


def test_near_copies_as_by_brute_force(spark):
    rows = planted() + [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()] + [(1, None), (2, ""), (3, "two words")]
    got = near_texts.one_of_each(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(r["doc_id"] for r in got) == brute_kept(rows)


def test_one_of_each_group_stays_whole(spark):
    rows = planted()[: 12 * 7]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for stage in (corpus_pipeline.one_of_near_copies, corpus_pipeline.without_repeats):
        docs = corpus_pipeline.written(stage(spark, docs, FOLDER), "test")
    assert {(r["doc_id"], r["text"]) for r in docs.collect()} == set(rows[::7])
