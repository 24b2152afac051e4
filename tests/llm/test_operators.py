import hashlib
import zlib
from collections import defaultdict

import numpy as np
import pytest
import xxhash

from quillspark.llm import decontaminate, gated_lm, html_extract, license_scan, packing, quality, queries, sharding, simhash, syncmers
from quillspark.llm.common import table

FOLDER = "/root/testdata/sf0.001"
ODD = [(1, None, "x"), (2, "", "x"), (3, " \n\t ", "y"), (None, "null id here", None), (5, "repeated row of words", "z"), (5, "repeated row of words", "z"), (6, "w " * 30_000, "long"), (7, "é" * 20_000, "long"), (8, "one", None), (9, "ONE", None)]
#: Extra columns with names that the operators use themselves.
COLUMNS = "doc_id long, text string, {}"


def odd(spark, extra="tokens string"):
    return spark.createDataFrame(ODD, COLUMNS.format(extra))


def none(spark):
    return spark.createDataFrame([], "doc_id long, text string")


def documents(spark):
    return table(spark, FOLDER, "documents").select("doc_id", "text").collect()


# ---- decontamination and licenses ----------------------------------------------------------------------------------


def shingles(text, n=5):
    import re

    w = [x for x in re.split(r"[\W_]+", (text or "").lower()) if x]
    return {" ".join(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


@pytest.mark.parametrize("limit", [20_000, 3])
def test_contained_items(spark, monkeypatch, limit):
    monkeypatch.setattr(decontaminate, "SKETCH_LIMIT", limit)
    base = "the quick brown fox jumps over a lazy dog while seven wise owls look down from old tall trees tonight".split()
    items = [(1, " ".join(base)), (2, " ".join(base[:6])), (3, "tiny item"), (4, None), (5, "")]
    docs = [(i, "start here " + " ".join(base[:k] + ["changed"] + base[k + 1 :]) + " and go on with many other words", i) for i, k in enumerate(range(0, 20, 2))]
    docs += [(100, "tiny item", 0), (101, None, 0), (102, "", 0), (103, "Tiny, ITEM!", 0), (None, " ".join(base), 0), (104, " ".join(base), 0), (104, " ".join(base), 0)]
    got = decontaminate.contained_items(spark.createDataFrame(docs, "doc_id long, text string, element int"), spark.createDataFrame(items, "item_id long, text string"))
    got = {(r["doc_id"], r["item_id"]): (r["n_shingles"], r["n_shared"]) for r in got.collect()}
    want = {}
    for d, text, _ in docs:
        for i, item in items:
            a, b = shingles(item), shingles(text)
            if a and len(a & b) >= 0.8 * len(a) - 1e-9:
                want[d, i] = (len(a), len(a & b))
    assert got == want and (None, 1) in got


def test_sketches_never_miss():
    for n in range(1, 300):
        k = decontaminate.sketch_size(n, 0.8)
        assert k >= n - -(-8 * n // 10) + 1 or k == n


def test_without_leaks(spark):
    items = spark.createDataFrame([(1, "one two three four five six")], "item_id long, text string")
    docs = spark.createDataFrame([(1, "zero one two three four five six", "a"), (2, "clean text", "b"), (3, None, "c")], "doc_id long, text string, row string")
    assert sorted(r["doc_id"] for r in decontaminate.without_leaks(docs, items).collect()) == [2, 3]


def test_license_scan(spark):
    rows = [(1, "a b c. Released under the MIT License. d"), (2, "released under another license"), (3, None), (4, "x " * 5000 + dict(license_scan.TEMPLATES)["mit-permission"] + " y" * 3000), (None, "Released under the MIT License."), (6, ("Licensed under CC BY-NC 4.0. " * 50))]
    got = {(r["doc_id"], r["license_id"]) for r in license_scan.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {(1, "mit-short"), (4, "mit-permission"), (None, "mit-short"), (6, "cc-by-nc-4.0-short")}
    assert license_scan.scan(none(spark)).count() == 0


# ---- packing -------------------------------------------------------------------------------------------------------


def check_packing(rows, pieces, window=2048):
    import public_tokenizers
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = defaultdict(int)
    for d, text in rows:
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [1]
        want[d] += len(ids)
    by_doc, by_sequence = defaultdict(int), defaultdict(list)
    texts = {}
    for d, text in rows:
        texts.setdefault(d, np.array(tokenizer.encode(text or "", add_special_tokens=False).ids + [1], "<u4"))
    for p in pieces:
        by_doc[p["doc_id"]] += p["length"]
        by_sequence[p["sequence_id"]].append((p["offset"], p["length"]))
        ids = texts[p["doc_id"]]
        assert p["ids_crc32"] == zlib.crc32(ids[p["start"] : p["start"] + p["length"]].tobytes()) and p["doc_tokens"] == len(ids)
    assert dict(by_doc) == dict(want)
    for own in by_sequence.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= window
    return sum(want.values()) / (window * len(by_sequence))


def test_packing(spark):
    rows = [(r["doc_id"], r["text"]) for r in documents(spark)]
    pieces = packing.pack(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert check_packing(rows, pieces) > 0.93
    check_packing([(r[0], r[1]) for r in ODD], packing.pack(odd(spark, "crcs string")).collect())
    assert packing.pack(none(spark)).count() == 0


def test_plan_uses_each_piece_once():
    rng = np.random.default_rng(0)
    for n in (0, 1, 7, 5_000):
        counts = np.bincount(rng.integers(1, 64, n), minlength=64) if n else np.zeros(64, int)
        used = np.zeros(64, int)
        for held, times in packing.plan(counts):
            assert sum(held) <= 64 and times > 0
            for v in held:
                used[v] += times
        assert (used == counts).all()


def test_tokens_are_the_tokenizers():
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    whole, mine = Tokenizer.from_file(path), packing.WordTokenizer(path)
    for text in ["", "It's 12.5 Éçà, don't!!  x", "日本語 text", "<|endoftext|> a", "a b\x1cc", "İÅ ﬁ Σας", "étude", "'s's't "]:
        assert mine.ids(text) == np.array(whole.encode(text, add_special_tokens=False).ids, "<u4").tobytes(), text


# ---- quality -------------------------------------------------------------------------------------------------------


def test_quality_on_held_out_rows(spark):
    folder = "/root/testdata/sf0.01"
    out = queries.op5_quality(spark, folder).join(table(spark, folder, "labels"), "doc_id").collect()
    held = [r for r in out if r["held_out"]]
    good, bad = [r["score"] for r in held if r["quality"] == 1], [r["score"] for r in held if r["quality"] == 0]
    auc = np.mean([[(a > b) + 0.5 * (a == b) for b in bad] for a in good])
    assert auc > 0.97 and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in out)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in out)


def test_rules_compile_to_columns(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(800, len(quality.STATISTICS)))
    y = ((x[:, 0] > 0) & (x[:, 3] < 0.5)).astype(float)
    model = quality.fit_rows(x, y)
    assert np.mean((model.predict(x) >= 0.5) == y) > 0.97 and len(model.rules) < 200
    df = spark.createDataFrame(x[:50].tolist(), quality.STATISTICS)
    assert np.allclose([r[0] for r in df.select(model.column()).collect()], model.predict(x[:50]))


def test_quality_edges(spark):
    labels = spark.createDataFrame([(1, 1), (2, None), (99, 0)], "doc_id long, quality int")
    model = quality.fit(odd(spark), labels)
    assert all(r["score"] > 0.5 for r in quality.scored(odd(spark, "words string"), model, ["doc_id"]).collect())
    assert quality.fit(none(spark), labels).base == 0.0


# ---- pages ---------------------------------------------------------------------------------------------------------


def test_main_text():
    for page in html_extract.LABELLED:
        start, end = page.index("[["), page.index("]]")
        got = html_extract.extract(page.replace("[[", "").replace("]]", ""))
        inside = page[start:end]
        assert all(w in inside for w in got.split()) and got.split()[0] in inside
    assert html_extract.extract("<article><p>A &amp; B&nbsp;&lt;c&gt;<br>d <script>x()</script></p><p>e<p>f") == "A & B <c> d e f"
    assert html_extract.extract(None) == html_extract.extract("") == html_extract.extract("<p></p>") == ""
    assert html_extract.extract("plain words only") == "plain words only"


# Layouts and names that no labelled page has; articles stand between the marks.
HELD_OUT = [
    """<html><head><title>t</title><body><div class="wrap"><div class="site-menu"><a>One</a><a>Two</a></div><div class="story-body">[[<h1>Old clocks</h1><p>He has mended clocks for forty years, and he does not own a watch.</p><p>Ask him <i>why</i>.</p>]]</div><div class="user-feedback">Was this page of help to you?</div><ol class="commentlist"><li>Same here, I do not own one either</li></ol></div><div class="site-footer">Imprint</div></body></html>""",
    """<html><body><svg width="1"/><table class="layout"><tr><td class="leftnav"><ul><li>Home<li>News<li>Shop</ul><td>[[<article><h2>The lake</h2><p>The lake froze early &amp; the boats lay on the ice until spring came.<p>Nobody minded.</article>]]<div id="disqus_thread">I minded it a great deal, to be honest</div></table></body></html>""",
    """<body><main>[[<h1>Sums</h1><p>If <math><mi>x</mi></math> is two then so is the other, which proves what was to be shown here.</p><pre>x = 2</pre>]]<div style="display: none">secret words that nobody sees</div><div class="promobox">Buy two books and pay for one of them</div></main><iframe src="x"/><footer>end</footer></body>""",
    """<form id="aspnetForm"><div id="page"><div id="header-bar">The firm</div><div id="main-content">[[<p>The form holds the whole page, as some servers make it, and still this is the text of it.</p><p>All of it.</p>]]</div><div id="cookie-bar">We use cookies here</div></div></form>""",
]


def test_held_out_pages():
    from collections import Counter

    for page in HELD_OUT:
        start, end = page.index("[["), page.index("]]")
        want = " ".join(x[1] for x in html_extract.blocks(page[start + 2 : end], {}))
        got = html_extract.extract(page.replace("[[", "").replace("]]", ""))
        both = sum((Counter(got.split()) & Counter(want.split())).values())
        assert 2 * both / (len(got.split()) + len(want.split())) > 0.97, (got, want)


def sentences(*numbers):
    return "".join(f"<p>part{i} and the river was high and the boats lay along the bank until the sun rose again</p>" for i in numbers)


#: Pages and the words of theirs that have to come out; "bad" words must not.
PROBES = [
    (f'<nav>bad menu</nav><article><h1>Title</h1>{sentences(1, 2, 3)}<div class="ad">{"bad offer " * 15}</div>{sentences(4, 5, 6)}</article><footer>bad</footer>', "Title part1 part2 part3 part4 part5 part6"),
    (f'<article><h1>Title</h1>{sentences(1, 2, 3)}<aside class="related"><ul>{"<li>bad story here</li>" * 14}</ul></aside>{sentences(4, 5, 6, 7, 8)}</article>', "Title part1 part2 part3 part4 part5 part6 part7 part8"),
    (f'<article>{sentences(1)}<div class="user-feedback">Was it bad yes no</div><p>Cheers</p></article>', "part1 Cheers"),
    (f'<div class="post-body">{sentences(1)}<div id="disqus_thread">bad words of a reader</div><div class="signup">bad letter</div><p>Cheers</p></div>', "part1 Cheers"),
    (f'<header>bad site</header><article><header class="entry-header"><h1>Title</h1></header>{sentences(1)}</article>', "Title part1"),
    ("<article><p>one <span class='ad'>bad <span>bad</span> bad</span> two <a class='advert' href=x>bad</a> three <span class='x'>four</span></p><pre><span class='comment'># code</span></pre></article>", "one two three four code"),
    (f"<article><h1>Title</h1>{sentences(1, 2)}</article><div><h3>2 bad responses</h3><p>I do not agree with the bad text</p></div>", "Title part1 part2"),
    (f"<article>{sentences(1)}<label>bad field</label>{sentences(2)}</article>", "part1 part2"),
    (f'<div><ul><li><a>Home</a></li></ul></div><div><h1>Title</h1>{sentences(1, 2)}<div class="ad">{"bad offer " * 6}</div>{sentences(3, 4)}</div>', "Title part1 part2 part3 part4"),
]


def test_boxes_inside_articles_and_around_them():
    for page, want in PROBES:
        got = html_extract.extract(f"<html><head><title>bad</title></head><body>{page}</body></html>").split()
        assert "bad" not in got and set(want.split()) <= set(got), (page, got)


def test_learned_weights_on_pages_that_hide_their_labels(spark):
    from collections import Counter

    rows = table(spark, "/root/testdata/sf0.01", "pages").select("page_id", "html").collect()
    known = html_extract.learned(spark.createDataFrame([r for r in rows if r["page_id"] % 2], "page_id long, html string"))
    assert known["nav"] < -1 and not {"div", "li", "p"} & set(known)
    for r in rows:
        if not r["page_id"] % 2:
            want = Counter(html_extract.extract(r["html"]).split())
            got = Counter(html_extract.extract(r["html"].replace("<article", "<div").replace("</article", "</div"), html_extract.built_in()[0] | known).split())
            assert 2 * sum((got & want).values()) > 0.97 * (sum(got.values()) + sum(want.values()))


def test_hostile_pages():
    import time

    for page in ["<script " * 130_000, '<script a="' * 100_000, "<!--" * 250_000, "<" * 1_000_000, "<a b='>" * 140_000, "<iframe>" * 120_000, '<p a="' + '"' * 500_000 + ">", "<li>" * 100_000, "<div>" * 100_000 + "</span>" * 100_000, "<p " + " " * 1_000_000 + '"']:
        began = time.time()
        html_extract.extract(page)
        assert time.time() - began < 15, page[:20]
    assert html_extract.extract('<p title="x>hello') == "hello"


def test_pages_edges(spark):
    kind = "page_id long, url string, html string"
    assert html_extract.main_texts(spark.createDataFrame([], kind)).count() == 0
    long = "<article>" + "<p>many words stand here</p>" * 20_000 + "</article><footer>end</footer>"
    rows = [(1, "u", long), (2, "a", "<p>same</p>"), (2, "a", "<p>same</p>")]
    got = sorted((r["page_id"], r["n_chars"]) for r in html_extract.main_texts(spark.createDataFrame(rows, kind)).collect())
    assert got == [(1, 20_000 * 22 - 1), (2, 4), (2, 4)]
    # a name that pages which label themselves have outside of their articles
    pages = [(i, "u", f"<body><div class='zzquux'>{'noise ' * 30}</div><article><p>{'words ' * 50}</p></article></body>") for i in range(12)]
    learned = html_extract.learned(spark.createDataFrame(pages, kind))
    assert learned[".zzquux"] < -1


def test_pages_query(spark):
    pages = spark.createDataFrame([(1, None, None, "t"), (None, "u", "<body><nav>Home</nav><article><h1>T</h1><p>some words stand here</p></article></body>", None)], "page_id long, url string, html string, text string")
    got = {r["page_id"]: (r["url"], r["text"], r["n_chars"]) for r in html_extract.main_texts(pages).collect()}
    assert got == {1: (None, "", 0), None: ("u", "T some words stand here", 23)}


# ---- SimHash -------------------------------------------------------------------------------------------------------


def brute_fingerprint(text):
    lower = (text or "").translate({c: c + 32 for c in range(65, 91)})
    import re

    w = re.findall("[^\x20\x09-\x0d]+", lower)
    hashes = [xxhash.xxh64_intdigest(" ".join(w[i : i + 3]), 42) for i in range(max(1, len(w) - 2))] if w else []
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if hashes else 0


def brute_components(rows):
    fps = [brute_fingerprint(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 2:
                parent[find(i)] = find(j)
    groups = defaultdict(list)
    for i, (d, _) in enumerate(rows):
        groups[find(i)].append(d)
    least = {g: min((d for d in ids if d is not None), default=None) for g, ids in groups.items()}
    return sorted(((d, f"{fps[i]:016x}", least[find(i)]) for i, (d, _) in enumerate(rows)), key=repr)


def test_near_copies(spark):
    rows = [(r["doc_id"], r["text"]) for r in documents(spark)]
    long = " ".join(f"w{i % 313}" for i in range(3000))
    rows += [(1000 + i, long + f" tail{i}") for i in range(8)] + [(r[0], r[1]) for r in ODD[:6]]
    got = simhash.near_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(((r["doc_id"], r["fingerprint"], r["component_id"]) for r in got), key=repr) == brute_components(rows)
    assert simhash.near_copies(none(spark)).count() == 0


def test_one_of_each(spark):
    got = simhash.one_of_each(odd(spark, "fp string")).collect()
    assert sorted((r["doc_id"] for r in got), key=repr) == sorted([1, None, 5, 6, 7, 8], key=repr) and set(got[0].asDict()) == {"doc_id", "text", "fp"}


def test_chains_are_one_component(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(1, 40)] + [(100, 101)], "a long, b long")
    got = {r["node"]: r["label"] for r in simhash.components(links).collect()}
    assert got == {**{i: 1 for i in range(1, 41)}, 100: 100, 101: 100}


# ---- syncmers ------------------------------------------------------------------------------------------------------


def test_edited_fingerprints(spark):
    rows = [(r["doc_id"], r["text"]) for r in documents(spark)]
    got = {r["doc_id"]: r for r in syncmers.edited_fingerprints(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    order = sorted(rows, reverse=True)
    for (d, text), (_, after) in zip(order, order[1:] + order[:1]):
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        r = got[d]
        assert r["n_chars"] == len(text) and r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert 0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1
    assert len(got) == len(rows)
    by_text = defaultdict(set)
    for d, text in rows:
        by_text[text].add(got[d]["fingerprint"])
    assert all(len(x) == 1 for x in by_text.values())
    assert 0.35 < np.mean([r["near_edited"] for r in got.values()]) < 0.75 and np.mean([r["near_next"] for r in got.values()]) < 0.2


def brute_anchors(text, k=syncmers.K, s=syncmers.S):
    import re
    import struct

    words = re.findall("[^\x20\x09-\x0d]+", text or "")
    signed = lambda h: h - (1 << 64) if h >> 63 else h
    ids = [signed(xxhash.xxh64_intdigest(w.encode(), 42)) for w in words]

    def chained(values):
        # several columns: each one's hash is the seed of the next
        seed = 42
        for v in values:
            seed = xxhash.xxh64_intdigest(struct.pack("<q", v), seed)
        return signed(seed)

    if len(ids) < k:
        return [chained([x]) for x in ids]
    inner = [chained(ids[i : i + s]) for i in range(len(ids) - s + 1)]
    last = k - s
    return [chained(ids[i : i + k]) for i in range(len(ids) - k + 1) if min(inner[i : i + last + 1]) in (inner[i], inner[i + last])]


def test_fingerprints_and_likeness_by_brute_force(spark):
    rows = sorted([(r["doc_id"], r["text"]) for r in documents(spark)][:80], reverse=True)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = {r["doc_id"]: r for r in syncmers.edited_fingerprints(docs).collect()}

    def likeness(a, b):
        a, b = set(a), set(b)
        return 2 * len(a & b) / (len(a) + len(b)) if a or b else 1.0

    for (d, text), (_, after) in zip(rows, rows[1:] + rows[:1]):
        half = len(text) // 2
        own, edited, following = brute_anchors(text), brute_anchors(text[: len(text) - half] + after[:half]), brute_anchors(after)
        assert got[d]["fingerprint"] == "".join(f"{x & (1 << 64) - 1:016x}" for x in own)
        assert got[d]["edited_fingerprint"] == "".join(f"{x & (1 << 64) - 1:016x}" for x in edited)
        assert abs(got[d]["near_edited"] - likeness(own, edited)) < 1e-9 and abs(got[d]["near_next"] - likeness(own, following)) < 1e-9


def test_syncmers_are_free_of_context(spark):
    words = [f"w{i}" for i in range(60)]
    a, b = " ".join(words), "other start " + " ".join(words[5:]) + " other end"
    df = spark.createDataFrame([(1, a), (2, b)], "id long, text string")
    met = syncmers.matched_positions(df.filter("id = 1"), df.filter("id = 2")).collect()
    assert max(met, key=lambda r: r["matches"])["offset"] == -3


def test_syncmer_edges(spark):
    got = {}
    for r in syncmers.edited_fingerprints(odd(spark, "block string")).collect():
        got.setdefault(r["doc_id"], []).append(r)
    assert sum(map(len, got.values())) == len(ODD) and got[1][0]["fingerprint"] == "" and got[5][0]["near_next"] == 1.0
    assert syncmers.edited_fingerprints(none(spark)).count() == 0


# ---- language model ------------------------------------------------------------------------------------------------


def small_network():
    # three words in two classes of one topic, and three endings
    return gated_lm.Network(gated_lm.Classes(3, 2, [[np.array([0, 1]), np.array([2])], []], np.array([0, 1, 1])))


def test_gradients():
    net = small_network()
    net.w = {k: v.astype(np.float64) for k, v in net.w.items()}
    rng = np.random.default_rng(0)
    x, y = rng.integers(0, 7, (6, 3)), rng.integers(0, 6, (6, 3))
    assert (x == net.classes.start).any()
    mask, h = rng.random((6, 3)) < 0.8, rng.normal(size=(3, gated_lm.HIDDEN)) * 0.1
    _, g, _ = net.gradients(x, y, mask, h)
    for name, v in net.w.items():
        for _ in range(5):
            at = tuple(rng.integers(0, n) for n in v.shape)
            before = v[at]
            v[at] = before + 1e-4
            up = net.gradients(x, y, mask, h)[0]
            v[at] = before - 1e-4
            down = net.gradients(x, y, mask, h)[0]
            v[at] = before
            assert abs((up - down) / 2e-4 - g[name][at]) < 1e-5 + 1e-3 * abs(g[name][at]), name


def test_probabilities_sum_to_one():
    net = small_network()
    state = np.random.default_rng(0).normal(size=(1, gated_lm.HIDDEN)).astype(np.float32)
    # the last two endings are of one tail class
    p = [float(np.exp(net.log_probabilities(state, np.array([i]))[0])) for i in range(5)]
    assert abs(sum(p) - 1) < 1e-5


def test_windows_do_not_change_scores(monkeypatch):
    net = small_network()
    rng = np.random.default_rng(0)
    texts = [rng.integers(0, 6, n) for n in (1, 5, 50, 200, 49, 48)]
    whole = gated_lm.score_texts(net, texts)
    monkeypatch.setattr(gated_lm, "WINDOW", 7)
    monkeypatch.setattr(gated_lm, "LANES", 2)
    assert np.allclose(whole, gated_lm.score_texts(net, texts), atol=1e-3)


def step_by_step(model, counts, text):
    """log10 P(text), token by token in plain floats; and which class each token has."""
    words, classes, w = model.words, model.classes, {k: v.astype(float) for k, v in model.weights.items()}
    sigmoid = lambda a: 1 / (1 + np.exp(-a))
    softmax = lambda a: np.exp(a - a.max()) / np.exp(a - a.max()).sum()
    tails = defaultdict(lambda: 0.5)
    for x, c in counts.items():
        if words.ids.get(x, words.vocabulary) >= words.vocabulary:
            tails[classes.endings[gated_lm.ending(x)]] += c + 0.5
    h, before, total = np.zeros(gated_lm.HIDDEN), classes.start, 0.0
    for token in gated_lm.tokens(text):
        z = sigmoid(w["gate"][before])
        h = z * h + (1 - z) * np.tanh(w["input"][before])
        rank = words.ids.get(token, words.vocabulary)
        code = rank if rank < words.vocabulary else words.vocabulary + gated_lm.ending(token)
        t, k = classes.topic[code], classes.kind[code]
        a, b = classes.topic_edges[t], classes.topic_edges[t + 1]
        p = softmax(w["topic_out"] @ h + w["topic_bias"])[t] * softmax(w["kind_out"][a:b] @ h + w["kind_bias"][a:b])[k - a]
        if rank < words.vocabulary:
            a, b = classes.word_edges[k], classes.word_edges[k + 1]
            p *= softmax(w["word_out"][a:b] @ h + w["word_bias"][a:b])[classes.row[code] - a]
        else:
            p *= (counts.get(token, 0) + 0.5) / tails[t]
        total += np.log10(p)
        before = code
    return total


def test_scores_step_by_step(spark, monkeypatch):
    monkeypatch.setattr(gated_lm, "VOCABULARY", 300)
    rows = [(r["doc_id"], r["text"]) for r in documents(spark)][:60] + [(r[0], r[1]) for r in ODD[:6]] + [(700, "Words that no text has: qqzzq xxyyx")]
    model, encoded = gated_lm.learn(spark.createDataFrame(rows, "doc_id long, text string"), 60, 500)
    counts = defaultdict(int)
    for d, t in rows:
        if d is None or zlib.crc32(str(d).encode()) % 5 != 1:
            for w in gated_lm.tokens(t):
                counts[w] += 1
    got = sorted((repr(r["doc_id"]), round(r["score"], 2)) for r in gated_lm.scored(encoded, model).collect())
    want = sorted((repr(d), step_by_step(model, counts, t)) for d, t in rows)
    assert [d for d, _ in got] == [d for d, _ in want] and np.allclose([s for _, s in got], [s for _, s in want], rtol=1e-4, atol=0.02)


def test_partitions_do_not_change_scores(spark):
    rows = [(r["doc_id"], r["text"]) for r in documents(spark)] + [(r[0], r[1]) for r in ODD]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    one, other = (sorted((repr(r["doc_id"]), round(r["score"], 3)) for r in gated_lm.score(docs.repartition(n), 60, 500, 20_000).collect()) for n in (1, 7))
    assert [d for d, _ in one] == [d for d, _ in other] and np.allclose([s for _, s in one], [s for _, s in other], rtol=1e-4, atol=0.01)


def test_scores(spark):
    rows = [(r["doc_id"], r["text"]) for r in documents(spark)] + [(r[0], r[1]) for r in ODD[:6]]
    got = gated_lm.score(spark.createDataFrame(rows, "doc_id long, text string"), stretches=60, frequent=500).collect()
    counts = defaultdict(int)
    out = lambda d: d is not None and zlib.crc32(str(d).encode()) % 5 == 1
    for d, t in rows:
        if not out(d):
            for w in gated_lm.tokens(t):
                counts[w] += 1
    n, v = sum(counts.values()), len(counts)
    want = sorted((repr(d), len(gated_lm.tokens(t)), sum(w in counts for w in gated_lm.tokens(t)), round(sum(np.log10((counts.get(w, 0) + 0.5) / (n + 0.5 * (v + 1))) for w in gated_lm.tokens(t)), 6)) for d, t in rows)
    assert sorted((repr(r["doc_id"]), r["n_tokens"], r["n_known"], round(r["base_score"], 6)) for r in got) == want
    assert all(r["train_tokens"] == n and r["held_out"] == out(r["doc_id"]) for r in got)
    assert all(r["score"] < 0 for r in got)
    assert gated_lm.score(none(spark)).count() == 0


def test_model_beats_unigrams_on_held_out_texts(spark):
    held = [r for r in queries.op9_lm_score(spark, "/root/testdata/sf0.01").collect() if r["held_out"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)


# ---- shards --------------------------------------------------------------------------------------------------------


def check_shards(rows, got, shards=8):
    assert len(got) == len(rows)
    size, slots, homes = defaultdict(int), defaultdict(list), defaultdict(set)
    for r in got:
        size[r["shard"]] += r["size"]
        slots[r["shard"]].append(r["slot"])
    texts = defaultdict(list)
    for d, t in rows:
        texts[d].append((t or "").encode())
    for r in got:
        raw = next(t for t in texts[r["doc_id"]] if zlib.crc32(t) == r["text_crc32"])
        assert r["size"] == len(raw) + 1
        homes[raw].add(r["shard"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and all(len(h) == 1 for h in homes.values())
    return [size[s] for s in range(shards)]


def test_shards(spark):
    rows = [(r["doc_id"], r["text"]) for r in documents(spark)]
    sizes = check_shards(rows, sharding.shard_by_bytes(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert max(sizes) - min(sizes) < 2 * max(len(t.encode()) for _, t in rows)
    rows = [(i, "copy " * 20 if i % 3 == 0 else f"text {i} " * 10) for i in range(900)]
    sizes = check_shards(rows, sharding.shard_by_bytes(spark.createDataFrame(rows, "doc_id long, text string").repartition(7)).collect())
    assert sorted(sizes)[-2] - sizes[np.argmin(sizes)] < 300
    check_shards([(r[0], r[1]) for r in ODD], sharding.shard_by_bytes(odd(spark, "shard string")).collect())
    assert sharding.shard_by_bytes(none(spark)).count() == 0
