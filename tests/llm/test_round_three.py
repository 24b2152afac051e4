"""Similarity join, vector codes and spelling variants against brute force."""

import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from quillspark.llm import jaccard_join, queries, spelling, vector_codes
from quillspark.llm.common import table

FOLDER = "/root/testdata/sf0.001"
LOWER = {i: i + 32 for i in range(65, 91)}
ODD = [(1, None, "x"), (2, "", "x"), (3, " \n\t ", "y"), (None, "null id here with some words", None), (5, "repeated row of words", "z"), (5, "repeated row of words", "z"), (6, "w " * 30_000, "long"), (7, "é" * 20_000, "long"), (8, "one", None), (9, "ONE", None), (10, "null id here with some words", None)]


def odd(spark, extra):
    return spark.createDataFrame(ODD, f"doc_id long, text string, {extra}")


# ---- similarity join -----------------------------------------------------------------------------------------------


def joined(rows, n=4):
    sets = []
    for _, text in rows:
        w = [x for x in re.split(r"[\x20\x09-\x0D]+", (text or "").translate(LOWER)) if x]
        sets.append({tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set())
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            k = len(a & b)
            if k and 100 * k >= 85 * (len(a) + len(b) - k):
                parent[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[root(i)] = min(least.get(root(i), d), d)
    return sorted(((d, len(sets[i]), least.get(root(i))) for i, (d, _) in enumerate(rows)), key=repr)


def result(df):
    return sorted(map(tuple, df.collect()), key=repr)


def edited(rng, words, times):
    words = list(words)
    for _ in range(times):
        at = rng.integers(0, len(words))
        words[at : at + 1] = [["changed"], [], [words[at], "added"]][rng.integers(0, 3)]
    return words


def test_alike_sets_share_a_signature():
    rng = np.random.default_rng(1)
    for n in [*range(1, 60), 99, 100, 101, 250, 700, 3_000]:
        for _ in range(8):
            whole = np.unique(rng.integers(0, 2**63, 2 * n).astype(np.uint64))
            rng.shuffle(whole)
            most = 15 * n // 100
            gone = int(rng.integers(0, most + 1))
            new = (100 * (n - gone) - 85 * n) // 85  # as many as the index allows
            a, b = np.sort(whole[:n]), np.sort(np.concatenate([whole[gone:n], whole[n : n + new]]))
            k = len(np.intersect1d(a, b))
            assert 100 * k >= 85 * (len(a) + len(b) - k)
            assert np.array_equal(a, b) or len(np.intersect1d(jaccard_join.signatures(a), jaccard_join.signatures(b)))


def test_components_equal_all_pairs(spark):
    rng = np.random.default_rng(2)
    vocabulary = [f"w{i}" for i in range(400)]
    rows, shared = [], [vocabulary[i] for i in rng.integers(0, 400, 60)]
    for length in (2, 5, 9, 12, 20, 60, 150):
        base = [vocabulary[i] for i in rng.integers(0, 400, length)]
        rows += [" ".join(edited(rng, base, int(rng.integers(0, 1 + length // 40)))) for _ in range(12)]
    for own in range(0, 60, 4):  # a passage that many texts share, from nearly alone to half of the text
        rows += [" ".join(shared + [f"own{own}x{j}y{i}" for i in range(own)]) for j in range(4)]
    rows = [(int(i), t) for i, t in zip(rng.permutation(len(rows)), rows)]
    assert result(jaccard_join.join_components(spark.createDataFrame(rows, "doc_id long, text string"))) == joined(rows)


def test_join_of_documents_and_odd_rows(spark, monkeypatch):
    rows = [(r["doc_id"], r["text"]) for r in table(spark, FOLDER, "documents").collect()]
    monkeypatch.setattr(jaccard_join, "FLUSH", 300)  # tasks hand on in many pieces
    monkeypatch.setattr(jaccard_join, "MANY", 3)
    assert result(queries.op11_jaccard_join(spark, FOLDER)) == joined(rows)
    assert result(jaccard_join.join_components(odd(spark, "key1 string"))) == joined([r[:2] for r in ODD])
    assert jaccard_join.join_components(spark.createDataFrame([], "doc_id long, text string")).count() == 0


# ---- vector codes --------------------------------------------------------------------------------------------------


def codes(rows):
    """The contract by whole distance tables."""
    kept = [(i, [float(np.float32(x)) for x in v], label) for i, v, label in rows if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    q = np.floor(np.array([v for _, v, _ in kept]) * 4096).astype(np.int64).reshape(len(kept), 8, -1)
    start = sorted(range(len(kept)), key=lambda r: (kept[r][0] is None, kept[r][0]))[:16]
    books = [q[start, p].copy() for p in range(8)]
    for turn in range(7):
        apart = [((q[:, p, None, :] - books[p][None]) ** 2).sum(2) for p in range(8)]
        at = [d.argmin(1) for d in apart]
        if turn < 6:
            for p in range(8):
                for e in range(len(books[p])):
                    own = q[at[p] == e, p]
                    if len(own):
                        books[p][e] = own.sum(0) // len(own)
    error = sum(d.min(1) for d in apart)
    by_label = Counter()
    for (_, _, label), e in zip(kept, error):
        by_label[label] += int(e)
    sha = hashlib.sha256(",".join(str(x) for b in books for row in b for x in row.tolist()).encode()).hexdigest()
    return sorted(((i, "".join(f"{at[p][r]:02x}" for p in range(8)), int(error[r]), by_label[label], sha) for r, (i, _, label) in enumerate(kept)), key=repr)


def test_vector_codes(spark):
    rows = [tuple(r) for r in table(spark, FOLDER, "embeddings").select("vec_id", "embedding", "label").collect()]
    assert result(queries.op12_vector_codes(spark, FOLDER)) == codes(rows)


def test_codes_of_odd_vectors(spark):
    rng = np.random.default_rng(3)
    # few distinct values, so that distances tie and entries are equal
    rows = [(int(i), [float(x) for x in rng.integers(-2, 3, 16) / 4096], [None, 1, 2][i % 3]) for i in range(300)]
    rows += [(300, None, 1), (301, [1.0] * 15 + [float("nan")], 1), (302, [None] + [1.0] * 15, 1), (303, [float("-inf")] * 16, 2), (None, [-0.5] * 16, 1), (5, [0.25] * 16, None), (5, [0.25] * 16, None)]
    kind = "vec_id long, embedding array<float>, label int, codes string"
    frame = lambda rows: spark.createDataFrame([(*r, "x") for r in rows], kind)
    assert result(vector_codes.codes_and_errors(frame(rows[9:]))) == codes(rows[9:])
    assert result(vector_codes.codes_and_errors(frame(rows[:5]))) == codes(rows[:5])
    assert vector_codes.codes_and_errors(frame([])).count() == 0
    got = {r["vec_id"]: (r["code"], r["error"]) for r in vector_codes.codes_and_errors(frame([(1, [1.0] * 16, 1), (2, [1e30] * 16, 1), (3, [1.0], 1), (4, [], 1)])).collect()}
    assert got == {1: ("00" * 8, 0), 2: (None, None), 3: (None, None), 4: (None, None)}
    assert [r["code"] for r in vector_codes.codes_and_errors(frame([(1, [1.0, 2.0, 3.0], 1)])).collect()] == ["00" * 8]


def test_exponion_search_is_exact_and_short():
    rng = np.random.default_rng(4)
    for spread in (2, 50, 10_000):
        book = rng.integers(-spread, spread + 1, (16, 8))
        x = book[rng.integers(0, 16, 500)] + rng.integers(-spread // 8 - 1, spread // 8 + 2, (500, 8))
        apart = ((x[:, None, :] - book[None]) ** 2).sum(2)
        best, least, measured = vector_codes.nearest(x, book, rng.integers(0, 16, 500))
        assert (best == apart.argmin(1)).all() and (least == apart.min(1)).all()
        again, _, few = vector_codes.nearest(x, book, best)
        assert (again == best).all() and (spread == 2 or few < measured / 2)


# ---- spelling variants ---------------------------------------------------------------------------------------------


def near(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def spelled(rows):
    n = Counter()
    for d, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if d is None else d}:{run}".encode())
            n[run if h % 31 else run[: h % len(run)] + run[h % len(run) + 1 :]] += 1
    n = {w: k for w, k in n.items() if len(w) >= 7 and k >= 2}
    form, count = {}, {}
    for w in n:
        others = [v for v in n if near(w, v)]
        best = min(others, key=lambda v: (-n[v], v), default=None)
        form[w], count[w] = (best if best is not None and n[best] >= 10 * n[w] else None), len(others)
    out = []
    for w in n:
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, form[w], root, n[w], count[w], n[form[w]] if form[w] else None))
    return sorted(out, key=repr)


def test_spelling_variants(spark):
    rows = [(r["doc_id"], r["text"]) for r in table(spark, FOLDER, "documents").limit(60).collect()]
    long = "abcdefghij" * 300
    rows += [(900, "letters " * 1200 + "lettres Letterés LetterÉs " * 3 + "lettters " * 110 + "letttters " * 10), (901, "aaaaaaaa aaaaaaa aaaaaaaab aaaaaaab " * 2), (902, f"{long} {long}x " * 2), (903, "letttterz letttterz")]
    got = result(spelling.variants(spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, n int")))
    assert got == spelled(rows)
    assert any(w == "letttters" and root == "letters" for w, _, root, *_ in got)


@pytest.mark.parametrize("rows", [ODD, []])
def test_spelling_of_odd_rows(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string, word string")
    assert result(spelling.variants(docs)) == spelled([r[:2] for r in rows])


def test_hash_of_a_deletion_is_the_hash_of_the_shorter_word():
    for base in spelling._BASES:
        word = "spellingés"
        without, wild, _ = spelling.hashed(word, base)
        assert without == [spelling.hashed(word[:i] + word[i + 1 :], base)[2] for i in range(len(word))]
        assert wild == [spelling.hashed(word[:i] + "\x01" + word[i + 1 :], base)[2] for i in range(len(word))]


def test_sketches_never_overstate():
    rng = np.random.default_rng(6)
    for n in (1, 40, 900):
        a, b = (np.unique(rng.integers(0, 3 * n + 2, n).astype(np.uint64)) for _ in range(2))
        bits = sum(int(x).bit_count() for x in (jaccard_join.parities(a) ^ jaccard_join.parities(b)).view(np.uint64))
        assert bits <= len(np.setxor1d(a, b))
