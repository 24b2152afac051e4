import hashlib
import random

from quillspark.llm import queries
from quillspark.llm import suffix_dedup as S


def brute(texts, length):
    seen = {}
    raw = [(t or "").encode() for t in texts]
    for d, t in enumerate(raw):
        for i in range(len(t) - length + 1):
            seen.setdefault(t[i : i + length], []).append((d, i))
    cover = [bytearray(len(t)) for t in raw]
    for where in seen.values():
        if len(where) > 1:
            for d, i in where:
                cover[d][i : i + length] = b"\1" * length
    out = []
    for t, c in zip(raw, cover):
        kept = bytes(x for x, y in zip(t, c) if not y)
        spans = sum(1 for i in range(len(c)) if c[i] and (i == 0 or not c[i - 1]))
        out.append((len(t), sum(c), spans, hashlib.sha256(kept).hexdigest()))
    return out


def corpus(seed, n=60, length=40):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abé") for _ in range(rng.randint(1, 6)))
    passages = [" ".join(word() for _ in range(30)) for _ in range(6)]
    texts = [None, "", "a" * (3 * length), "short", "ab" * length]
    for _ in range(n):
        parts = [" ".join(word() for _ in range(rng.randint(1, 25)))]
        for _ in range(rng.randint(0, 3)):
            p = rng.choice(passages)
            i = rng.randint(0, len(p) // 2)
            p = p[i : i + rng.randint(length // 2, len(p))]
            if rng.random() < 0.5 and p:
                j = rng.randrange(len(p))
                p = p[:j] + "X" + p[j + 1 :]
            parts.insert(rng.randint(0, len(parts)), p)
        texts.append(" ".join(parts))
    return texts + [texts[10], texts[10], texts[11]]


def check(spark, texts, length, **more):
    rows = [(i, t, i % 2) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, key1 int")
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in S.remove_repeats(docs, length, gram=8, **more).collect()}
    assert got == dict(enumerate(brute(texts, length)))


def test_matches_brute_force(spark):
    check(spark, corpus(1), 40)


def test_splits_large_buckets(spark):
    rng = random.Random(3)
    base = " ".join("".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(40))
    texts = []
    for _ in range(40):
        chars = list(base)
        for _ in range(3):
            chars[rng.randrange(len(chars))] = rng.choice("XYZ")
        texts.append("".join(chars))
    check(spark, texts, 40, bucket_rows=3)


def test_empty_table_and_columns(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert S.remove_repeats(docs, 40, gram=8).count() == 0
    docs = spark.createDataFrame([(1, "x" * 100, "a"), (None, "y", "b"), (None, None, None)], "doc_id long, text string, bytes string")
    out = {(r["doc_id"], r["bytes"]): r["text"] for r in S.remove_repeats(docs, 40, gram=8, with_text=True).collect()}
    assert out == {(1, "a"): "", (None, "b"): "y", (None, None): None}


def test_hot_contexts_are_dealt_to_many_keys(spark, monkeypatch):
    monkeypatch.setattr(S, "HEAVY", 4)
    shared = "the same passage of sixty bytes or so stands in all of these texts, "
    check(spark, corpus(2, 20) + [f"text {i} {shared} and goes on {i * 7}" for i in range(30)], 40)


def test_production_length_and_long_texts(spark, monkeypatch):
    rng = random.Random(5)
    some = lambda n: "".join(rng.choice("abcdefghij é") for _ in range(n))
    passage, long = some(500), some(45_000)
    assert len(long) > S.BLOCK
    texts = [some(900) + passage + some(50), passage + some(300), some(20) + passage[:399], long + passage[:410] + long[:600], some(2_000), None]
    # repeated rows of one doc_id count as occurrences
    docs = spark.createDataFrame([(i // 2, t) for i, t in enumerate([x for t in texts for x in (t, t[:-1] if t else t)])] + [(0, texts[4])], "doc_id long, text string")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    want = sorted((repr(d), *x) for (d, _), x in zip(rows, brute([t for _, t in rows], 400)))
    assert sorted((repr(r["doc_id"]), r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in S.remove_repeats(docs).collect()) == want


def test_a_text_that_repeats_itself_has_one_row_for_a_context(spark, monkeypatch):
    line = "one line of over forty bytes that stands in each text again and again; "
    texts = [f"{i} {'xyzw'[i % 4] * i} {line * 12} {i * 7}" for i in range(8)]
    met, real = [], S._of_classes

    def counted(rows, classes):
        out = real(rows, classes)
        met.append((rows.count(), out.count(), classes.agg({"n": "max"}).first()[0]))
        return out

    monkeypatch.setattr(S, "_of_classes", counted)
    check(spark, [*texts, "a" * 200], 40)
    (rows, out, most), anchors = met[0], 2 * len(line) // (40 - 8)
    # some context stands at over 80 places; rows follow the texts and the line's anchors
    assert most >= 80 and out <= rows < 8 * 2 * anchors + 60


def test_op1_shows_what_is_left(spark, tmp_path):
    rng = random.Random(8)
    some = lambda n: "".join(rng.choice("abcdefghij k") for _ in range(n))
    passage, clean = some(450), some(700)
    rows = [(1, "ä" + some(300) + passage), (2, passage + some(300) + "é"), (3, clean), (4, None), (5, passage), (6, passage)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    out = {r["doc_id"]: r for r in queries.op1_suffix_array_dedup(spark, str(tmp_path)).collect()}
    assert {i: r["text"] for i, r in out.items()} == {1: rows[0][1][:301], 2: rows[1][1][450:], 3: clean, 4: "", 5: "", 6: ""}
    assert all(hashlib.sha256(r["text"].encode()).hexdigest() == r["kept_sha256"] for r in out.values())
