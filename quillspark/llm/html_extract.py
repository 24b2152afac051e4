"""Main text of HTML pages by a maximum-scoring subsequence.

A page is a sequence of words and tags. A tag has a negative score; a word has a score by where it stands: a little, and the
log odds for and against the article of the strongest of the open elements' names and marks (words of class, id and role).
A linear scan finds the run with the greatest sum, which is the content region. Blocks of it that score negative (a menu, an
advert, comments) go. Where an element around such a block speaks for the article, the block and its tags cost at most BOX, however
long it is, so that a box inside an article does not part its two sides; elsewhere a block costs at most LOOSE. What follows an article that fills most of the region, and
stands outside of it, goes too. Inline elements whose marks speak against the article are blocks of their own, except in code. A header
inside an article element is the article's, and its name says nothing.

Weights come from labelled pages of two kinds: the ones below, whose articles stand between marks, and pages of the table that
label themselves, with one article element (or else one main element). Of those, at most about LEARN_PAGES pages are read, by a
hash of the page; names and marks are counted by the words that stand inside and outside, and the odds of the pages below count as PRIOR
words. At most MARKS of them, the commonest, are kept.

Pages are read by a scanner that goes over each character a bounded number of times, whatever the page holds.

Case rules: a null page and one without text give an empty text; repeated pages each give their row. Unclosed and stray tags
are allowed; a quote that isn't closed ends with its tag. Scripts, styles, hidden elements, forms' parts and drawings are
skipped: an unclosed script or style to the end of the page, others to the end of the element around them. Of an empty table
only the pages below are learned from.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Iterator
from functools import cache
from math import exp, log

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Names and marks learned from the table, and the words and pages that one needs to count.
MARKS, MARK_WORDS, MARK_PAGES = 10_000, 200, 5
#: Pages that weights are learned from (about, where the table has more), and the words that the built-in odds of a name count as.
LEARN_PAGES, PRIOR = 20_000, 2_000

# Elements that do not end a block; that have no end tag; whose content is no markup; that are not read; that say
# where a word stands; that end a paragraph; whose names' weights are learned (others are of all layouts alike); and which of equal names end one another.
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark math q rp rt ruby s samp small span strike strong sub sup time tt u var".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title iframe noembed noframes xmp".split())
UNREAD = frozenset("svg canvas object select button template noscript audio video applet datalist label".split())
PLACES = frozenset("article main section div nav header footer aside form ul ol li table td th dl dd dt figure figcaption blockquote pre h1 h2 h3 h4 h5 h6 p details dialog menu address fieldset body".split())
BLOCKS = frozenset("article main section div nav header footer aside form ul ol table dl figure blockquote pre h1 h2 h3 h4 h5 h6 p hr address fieldset".split())
LANDMARKS = frozenset("main section nav header footer aside form dialog menu address".split())
CLOSES = {"li": {"li"}, "td": {"td", "th"}, "th": {"td", "th"}, "tr": {"tr", "td", "th"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "option": {"option"}}
SCOPES = frozenset("ul ol table dl select body article main section".split())

# Labelled pages: their articles stand between the marks [[ and ]].
LABELLED = [
    """<body><nav><ul><li><a href=/>Home</a></li><li><a>News</a></li><li><a>About us</a></li></ul></nav><div class="ad">Buy one get one free today</div><article>[[<h1>A walk along the river</h1><p>We set out early and followed the path by the water until noon.</p><p>The mill stood empty.<br>Nobody had been there for years.</p>]]</article><footer>All rights reserved 2020</footer></body>""",
    """<body><header class="header"><a>Logo</a> The daily paper<form class="search">Search the site</form></header><main><article>[[<h1>Prices rise</h1><p>Bread costs more than it did last year, and bakers say that it will not change soon.</p><ul><li>Flour is dearer</li><li>So is power</li></ul><p>Some have closed.</p>]]<aside class="related">More stories you may like</aside><section id="comments" class="comments"><h2>Comments</h2><p>I do not agree with this at all, says a reader who has read it.</p><div class="comment reply">Me neither.</div></section></article></main><aside class="sidebar"><p>Most read this week</p></aside><footer class="footer"><p>Contact and imprint</p></footer></body>""",
    """<body><div id="cookie-banner" class="cookie notice consent">We use cookies to make this site better. Accept all of them.</div><div id="menu" class="menu navigation"><ul><li>Sports</li><li>Weather</li></ul></div><div class="content main post entry"><div class="article body text">[[<h1>Rain again</h1><h2>The north is wet</h2><p>It rained for the third week and the fields stand under water now.</p><blockquote>We have never seen this</blockquote><table><tr><td>Monday</td><td>12 mm</td></tr></table><pre>total 12</pre>]]</div></div><div class="newsletter subscribe form"><p>Subscribe to our letter</p></div><div class="share social">Share this page</div><div class="footer copyright">Copyright</div></body>""",
    """<body><div class="header banner"><h2>The site of the town</h2></div><div class="breadcrumb">Home / Town / News</div><section><div class="story content">[[<h1>Bridge opens</h1><p>After two years of work the bridge is open again to all who want to cross it.</p><figure><figcaption>The bridge at night</figcaption></figure><p>Cheers.</p>]]<div class="advert advertisement ads sponsored promo">Cheap flights to the sea</div></div></section><div class="widget sidebar"><ul><li>Old news</li></ul></div><div class="popup modal alert notice disclaimer">This page is not advice</div><dialog>Leave your mail</dialog><menu>File Edit</menu><form>Name and mail <fieldset>Send</fieldset></form></body>""",
    """<body><header><h1>Blog of a cook</h1></header><nav class="nav menu">Start Recipes</nav><main>[[<h1>Soup</h1><p>Cut the roots and let them boil for an hour with salt and a leaf of bay.</p><ol><li>Cut</li><li>Boil</li></ol><dl><dt>Salt</dt><dd>Not too much</dd></dl>]]</main><div class="discussion responses"><p>Great soup, thank you so much for it!</p></div><div class="tags meta byline author">By a cook in soups</div><footer><nav>Top of page</nav></footer></body>""",
    """<body><div id="masthead"><p>The valley post</p></div><div id="content" role="main"><div class="hentry"><div class="entry-content">[[<h2>Goats</h2><p>The goats came down from the hill before the snow, as they do in every year.</p><p>They are well.</p>]]</div></div><div id="disqus"><p>What a nice text about goats, more of it please</p></div><div class="feedback"><p>Was this page of use to you? Yes or no</p></div></div><div id="footnav" role="navigation"><ul><li>Archive</li></ul></div><div role="banner">Winter sale</div><div role="complementary">Friends of ours</div><div role="contentinfo">Made in the valley</div></body>""",
    """<body><div class="toolbar pagination pager"><a>Next</a> <a>Last</a></div><div class="post-body">[[<h3>Two wheels</h3><p>I bought the bicycle from a man who had kept it in his barn since the war.</p><p>It rolls.</p>]]</div><div class="recommended trending outbrain taboola"><p>You will not believe what these stars look like today</p></div><div class="signup login register subscription paywall"><p>Log in or register to read on</p></div><div class="gdpr privacy"><p>Your data is safe with us and our partners</p></div><div class="reviews shoutbox guestbook"><p>Lovely, said a guest</p></div><div class="skip hidden dropdown submenu">Skip to the text</div></body>""",
]

_TAG_STOP = re.compile("[>\"']")
_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
_MARK = re.compile(r"(?<![^\s\"'/])(?:class|id|role|itemprop)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+))", re.I)
_HIDDEN = re.compile(r"(?<![^\s\"'/])(?:hidden(?=[\s/=]|$)|aria-hidden\s*=\s*[\"']?true|style\s*=\s*[\"'][^\"']*(?:display\s*:\s*none|visibility\s*:\s*hidden))", re.I)
_NAMED = re.compile(r"[a-z]+|[A-Z][a-z]+|[A-Z]+")


def marks(attributes: str) -> list[str]:
    """Words of the names that an element's attributes give it, each after a dot."""
    found = []
    for m in _MARK.finditer(attributes):
        found += ["." + x.lower() for x in _NAMED.findall(m[1] or m[2] or m[3] or "")]
    return found


def scanned(page: str) -> Iterator[tuple[str, str, str]]:
    """("text", text, ""), ("open", name, attributes) and ("close", name, "") in page order.

    What is between a raw element's tags is left out. A tag ends at the first > outside of quoted values. Once a quote was found to
    have no end, tags end at the first > from there on, so that no part of the page is searched over and over.
    """
    at, size, last, loose, ends = 0, len(page), page.rfind(">"), False, {}
    while at < size:
        begin = page.find("<", at)
        if begin < 0:
            yield "text", page[at:], ""
            return
        if begin > at:
            yield "text", page[at:begin], ""
        after = page[begin + 1 : begin + 2]
        closing = after == "/"
        named = page[begin + 2 : begin + 3] if closing else after
        if after not in ("!", "?") and not (named.isascii() and named.isalpha()):
            yield "text", "<", ""
            at = begin + 1
            continue
        if begin > last:
            return  # a tag that never ends
        if after in ("!", "?") or closing:
            comment = after == "!" and page.startswith("<!--", begin) and ends.get("--", True)
            end = page.find("-->", begin + 4) if comment else -1
            if comment and end < 0:
                ends["--"] = False
            at = end + 3 if end >= 0 else page.find(">", begin) + 1
            if closing:
                yield "close", _NAME.match(page, begin + 2)[0].lower(), ""
            continue
        stop, place = -1, begin + 1
        while not loose and stop < 0:
            m = _TAG_STOP.search(page, place)
            if m is None:
                loose = True
            elif m[0] == ">":
                stop = m.start()
            else:
                before = m.start() - 1
                while page[before].isspace():
                    before -= 1
                # a quote that begins no value is a character like any other
                place = page.find(m[0], m.start() + 1) + 1 if page[before] == "=" else m.end()
                loose = place == 0
        stop = page.find(">", begin) if loose else stop
        name = _NAME.match(page, begin + 1)[0].lower()
        yield "open", name, page[begin + 1 + len(name) : stop]
        at = stop + 1
        if name in RAW and page[stop - 1] != "/" and ends.get(name, True):
            m = _raw_end(name).search(page, at)
            if m is not None:
                at = m.start()
            elif name in ("script", "style"):
                return
            else:
                ends[name] = False


@cache
def _raw_end(name: str) -> re.Pattern:
    return re.compile(rf"</{name}(?=[\s/>])", re.I)


def blocks(page: str, weights: dict[str, float], without: frozenset[str] = frozenset()) -> Iterator[tuple[str, str, float, float, tuple[str, ...], bool]]:
    """("block", its text, the score of each of its words, the score of the tags before it, names and marks around it, whether one speaks for the article).

    Names and marks are those of the innermost MOST elements only; scores are those of all. without: names that count for nothing.
    """
    stack: list[tuple[str, float, float, bool, tuple[str, ...], bool]] = []  # name, strongest for, strongest against, unread, its own names, held
    opened, parts, cost = Counter(), [], 0.0

    def state() -> tuple[float, float, bool]:
        return stack[-1][1:4] if stack else (0.0, 0.0, False)

    def close(name: str) -> None:
        while stack:
            gone = stack.pop()[0]
            opened[gone] -= 1
            if gone == name:
                return

    def block() -> Iterator[tuple]:
        nonlocal parts, cost
        text = " ".join(entities.unescape("".join(parts)).split())
        parts = []
        if text:
            best, worst, _ = state()
            around = tuple(x for entry in stack[-MOST:] for x in entry[4])
            yield "block", text, PLAIN_WORD + FOR * best + AGAINST * worst, cost, around, bool(stack) and stack[-1][5]
            cost = 0.0

    for kind, value, attributes in scanned(page):
        if kind == "text":
            if not state()[2]:
                parts.append(value)
            continue
        own, inline = (), value in INLINE
        if kind == "open" and inline and attributes and not (opened["pre"] or opened["code"]):
            own = tuple(x for x in marks(attributes) if x not in without)
            inline = not any(weight_of(x, weights) <= STRONG for x in own)
        if not inline or opened[value]:
            yield from block()
        cost += tag_scores().get(value, OTHER_TAG)
        if kind == "close":
            if opened[value]:
                close(value)
            elif value == "p":
                continue
        else:
            if value in BLOCKS and stack and stack[-1][0] in ("p", "button", "select"):
                close(stack[-1][0])
            for inner in CLOSES.get(value, ()):
                # of the same list or table only
                if opened[inner] and next((n for n, *_ in reversed(stack[-8:]) if n in SCOPES or n == inner), "") == inner:
                    close(inner)
            hidden = bool(_HIDDEN.search(attributes)) if attributes else False
            if value in VOID or value in RAW or attributes.endswith("/") or not (value in PLACES or value in UNREAD or value == "code" or hidden or not inline or opened[value]):
                continue
            if value in PLACES or value in UNREAD or hidden:
                own = tuple(x for x in (value, *marks(attributes)) if x not in without) if attributes else tuple(x for x in (value,) if x not in without)
                if value == "header" and opened["article"]:
                    own = tuple(x for x in own if x not in ("header", ".header"))
            best, worst, unread = state()
            scores = [weight_of(x, weights) for x in own]
            stack.append((value, max([best, *scores]), min([worst, *(x for x in scores if x <= STRONG)]), unread or hidden or value in UNREAD, own, bool(stack) and stack[-1][5] or value in HOLDERS and max(scores, default=0.0) >= HOLDS))
            opened[value] += 1
    yield from block()


#: Score of a word that stands nowhere in particular and of a tag that no labelled page has; elements around a block that are named.
PLAIN_WORD, OTHER_TAG, MOST = 0.5, -0.05, 24
#: The weight from which an element holds the article, which elements can, and what a block against it costs at most inside of one and elsewhere.
HOLDS, HOLDERS, BOX, LOOSE = 0.7, frozenset("article main section div".split()), 0.25, 12.0
#: How much the strongest weights for and against count; weights above STRONG do not speak against.
FOR, AGAINST, STRONG = 0.5, 1.5, -1.0
#: Letters of a mark that others may begin with (comment: commentlist), and marks that others may end with (nav: leftnav).
STEM, ENDS = 5, ("nav", "menu", "footer")


def weight_of(name: str, weights: dict[str, float]) -> float:
    """The weight of a name or mark, or else of the mark that it ends with, or of the longest one that it begins with and that speaks against."""
    found = weights.get(name)
    if found is None and name.endswith(ENDS):
        found = weights.get(next("." + x for x in ENDS if name.endswith(x)))
    elif found is None and len(name) > STEM + 1 and name[0] == ".":
        found = next((weights[name[:n]] for n in range(len(name) - 1, STEM, -1) if weights.get(name[:n], 0.0) < 0), None)
    return found or 0.0


def _odds(inside: float, outside: float) -> float:
    return max(-4.0, min(3.0, log((inside + 0.5) / (outside + 0.5))))


@cache
def built_in() -> tuple[dict[str, float], dict[str, float]]:
    """Log odds of words by names and marks, and the (negative) scores of tags, from the labelled pages."""
    inside, outside, tag_in, tag_out = Counter(), Counter(), Counter(), Counter()
    for page in LABELLED:
        for piece, within in zip(re.split(r"\[\[|\]\]", page), (False, True, False)):
            (tag_in if within else tag_out).update(value for kind, value, _ in scanned(piece) if kind != "text")
        within, stack = False, []
        for kind, value, attributes in scanned(page):
            if kind == "text":
                for piece in re.split(r"(\[\[|\]\])", value):
                    if piece in ("[[", "]]"):
                        within = piece == "[["
                    elif n := len(piece.split()):
                        (inside if within else outside).update({x: n for own in stack for x in own[1]})
            elif kind == "open" and value in PLACES:
                stack.append((value, (value, *marks(attributes))))
            elif kind == "close" and any(n == value for n, _ in stack):
                while stack.pop()[0] != value:
                    pass
    places = {x: _odds(inside[x], outside[x]) for x in {*inside, *outside}}
    tags = {x: min(-0.01, 0.25 * _odds(tag_in[x], tag_out[x])) for x in {*tag_in, *tag_out}}
    return places, tags


def tag_scores() -> dict[str, float]:
    return built_in()[1]


def extract(page: str | None, weights: dict[str, float] | None = None) -> str:
    """The main text: white space inside it is one space."""
    known = built_in()[0] | (weights or {})
    for without in (frozenset(), frozenset(["form", "fieldset", "body", ".form"])):
        found = list(blocks(page or "", known, without))
        # the greatest sum over words and tags
        best, begin, stop, total, since = 0.0, 0, 0, 0.0, 0
        for i, (_, text, score, cost, _, held) in enumerate(found):
            value = score * (text.count(" ") + 1)
            if held:
                cost = max(cost, -BOX)
                value = max(value, -BOX - cost)
            value = max(value, -LOOSE)
            if total + cost <= 0:
                total, since = 0.0, i
            else:
                total += cost
            total += value
            if total > best:
                best, begin, stop = total, since, i + 1
        if best or not found:
            break  # else all of the page may stand in a form
    region = [(text, text.count(" ") + 1, held) for _, text, score, _, _, held in found[begin:stop] if score > 0]
    if 2 * sum(n for _, n, held in region if held) > sum(n for _, n, _ in region):
        while not region[-1][2]:
            region.pop()
    return " ".join(text for text, _, _ in region)


# ---- learning from pages that label themselves ------------------------------------------------------------------------


def _label(page: str) -> str:
    """The element that holds the article, if the page has one such element."""
    low = page.lower()
    return next((x for x in ("article", "main") if len(re.findall(rf"<{x}[\s>]", low)) == 1), "")


def _counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    known, tally = built_in()[0], {}
    for rows in batches:
        for page in rows["html"]:
            if not page or not (holder := _label(page)):
                continue
            seen = set()
            for _, text, score, _, around, _ in blocks(page, known):
                n = text.count(" ") + 1
                # what is boilerplate by its other names says nothing of those that stand in the article's element
                within = holder in around and score > 0
                if not within and holder in around:
                    around = around[around.index(holder) + 1 :]
                for x in {y for y in around if y[0] == "." or y in LANDMARKS} - {holder}:
                    row = tally.setdefault(x, [0, 0, 0])
                    row[0 if within else 1] += n
                    row[2] += x not in seen
                    seen.add(x)
        if len(tally) > 100_000:
            yield _rows(tally)
            tally = {}
    yield _rows(tally)


def _rows(tally: dict[str, list[int]]) -> pd.DataFrame:
    return pd.DataFrame([(x, *row) for x, row in tally.items()], columns=["mark", "inside", "outside", "pages"])


def learned(pages: DataFrame) -> dict[str, float]:
    """Log odds of names and marks from those pages (html) that label themselves, with the odds of this module's pages as a prior."""
    read, share = pages.select("html"), pages.count() // LEARN_PAGES
    if share > 1:
        read = read.filter(F.pmod(F.xxhash64("html"), F.lit(share)) == 0)
    counts = read.mapInPandas(_counted, "mark string, inside long, outside long, pages long")
    counts = counts.groupBy("mark").agg(F.sum("inside").alias("inside"), F.sum("outside").alias("outside"), F.sum("pages").alias("pages"))
    words = F.col("inside") + F.col("outside")
    chosen = counts.filter((words >= MARK_WORDS) & (F.col("pages") >= MARK_PAGES)).orderBy(words.desc(), "mark").limit(MARKS)
    found = {}
    for r in chosen.collect():
        known = built_in()[0].get(r["mark"])
        share = 0.0 if known is None else 1 / (1 + exp(-known))
        prior = 0 if known is None else PRIOR
        found[r["mark"]] = _odds(r["inside"] + prior * share, r["outside"] + prior * (1 - share))
    return found


def main_texts(pages: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """pages (page_id, url, html) -> page_id, url, text, n_chars. weights: what learned returns; by default it is asked for these pages."""
    known = learned(pages) if weights is None else weights

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            yield pd.DataFrame({"row": rows["row"], "text": [extract(x, known) for x in rows["html"]]})

    kept = pages.select(F.struct("page_id", "url").alias("row"), "html")
    shape = kept.schema["row"].dataType.simpleString()
    out = kept.mapInPandas(run, f"row {shape}, text string")
    return out.select("row.page_id", "row.url", "text", F.char_length("text").cast("long").alias("n_chars"))
