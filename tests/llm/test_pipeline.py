import random
import re
import sys
from collections import Counter
from pathlib import Path

import corpus_pipeline

sys.path.insert(0, str(Path(__file__).parent))
from test_operators import brute_fingerprint, check_packing  # noqa: E402

FOLDER = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    columns = docs.columns
    ids = {r["doc_id"] for r in docs.select("doc_id").collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.written(stage(spark, docs, FOLDER), "test")
        assert docs.columns == columns, name
        left = {r["doc_id"] for r in docs.select("doc_id").collect()}
        assert left <= ids and len(left) == docs.count(), name
        ids = left
    last = corpus_pipeline.STAGES[-1][1](spark, docs, FOLDER)
    assert {r["doc_id"] for r in last.select("doc_id").collect()} == ids
    benchmark = spark.read.parquet(f"{FOLDER}/benchmark.parquet")
    assert corpus_pipeline.decontaminate.contained_items(docs, benchmark).count() == 0
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{FOLDER}/labels.parquet").collect()}
    assert sum(labels.get(i) == 0 for i in ids) <= 2


def test_empty(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.written(stage(spark, docs, FOLDER), "test")
    assert docs.count() == 0


def shingles(text):
    w = [x for x in re.split(r"[\W_]+", (text or "").lower()) if x]
    return {" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def test_run_by_brute_force(spark, tmp_path):
    """run() on planted copies, near copies, shared passages and leaks, against the stages done pair by pair."""
    base = spark.read.parquet(f"{FOLDER}/documents.parquet").orderBy("doc_id").limit(70).collect()
    rows = [r.asDict() for r in base]
    rng = random.Random(3)
    leak = spark.read.parquet(f"{FOLDER}/benchmark.parquet").orderBy("item_id").first()["text"]
    good = [r for r in rows if r["lang"] == "en" and 150 < len(r["text"].split()) < 700]
    for i, r in enumerate(good[:4]):
        words = r["text"].split()
        near = [*words]
        near[len(near) // 2] = "changed"
        rows += [dict(r, doc_id=10_000 + 10 * i), dict(r, doc_id=10_001 + 10 * i, text=" ".join(near))]
    passage = " ".join(rng.choice(good[5]["text"].split()) for _ in range(70))
    for i, r in enumerate(good[6:9]):
        words = r["text"].split()
        rows.append(dict(r, doc_id=20_000 + i, text=" ".join([*words[: 60 + i], passage, *words[60 + i :: 2], *words[61 + i :: 2]])))
    rows.append(dict(good[9], doc_id=30_000, text=good[9]["text"] + " " + leak))
    # nulls, ties and repeated rows
    rows += [dict(rows[0], doc_id=40_000, text=None), dict(rows[0], doc_id=None, text="a text of few words"), rows[3], dict(rows[3], lang=None, source=None)]
    docs = spark.createDataFrame([tuple(r.values()) for r in rows], spark.read.parquet(f"{FOLDER}/documents.parquet").schema)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{FOLDER}/{name}.parquet").write.parquet(f"{tmp_path}/{name}.parquet")

    # the classifier's verdicts are its own; all that follows is done pair by pair
    kept = [(r["doc_id"], r["text"]) for r in corpus_pipeline.good_quality(spark, spark.read.parquet(f"{tmp_path}/documents.parquet"), str(tmp_path)).collect()]
    held = {d for d, _ in kept}
    assert held & {10_000, 10_001} and len(held & {20_000, 20_001, 20_002}) > 1 and 30_000 in held
    fps, sets = [brute_fingerprint(t) for _, t in kept], [shingles(t) for _, t in kept]
    group = list(range(len(kept)))
    for i in range(len(kept)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if kept[i][1] == kept[j][1] or (fps[i] ^ fps[j]).bit_count() <= 2 or (both and 10 * both >= 8 * len(sets[i] | sets[j])):
                a, b = group[i], group[j]
                group = [b if g == a else g for g in group]
    first = {}
    for g, row in zip(group, kept):
        first[g] = min(first.get(g, row), row, key=lambda x: (x[0] is None, x[0] or 0))
    texts = list(first.values())
    out = []
    raw = [(t or "").encode() for _, t in texts]
    n = corpus_pipeline.REPEAT_BYTES
    seen = Counter(t[i : i + n] for t in raw for i in range(len(t) - n + 1))
    for (d, _), t in zip(texts, raw):
        gone = bytearray(len(t))
        for i in range(len(t) - n + 1):
            if seen[t[i : i + n]] > 1:
                gone[i : i + n] = b"\1" * n
        left = bytes(x for x, y in zip(t, gone) if not y).decode("utf-8", "ignore")
        if left.strip(" "):
            out.append((d, left))
    items = [shingles(r["text"]) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]
    out = [(d, t) for d, t in out if not any(x and len(x & shingles(t)) >= 0.8 * len(x) - 1e-9 for x in items)]

    pieces = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {p["doc_id"] for p in pieces} == {d for d, _ in out}
    # near copies go, shared passages are cut, the leak is gone
    assert 30_000 not in {d for d, _ in out} and not any(passage in t for _, t in out)
    assert check_packing(out, pieces) > 0.5
