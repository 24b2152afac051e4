"""Lists of references in Markdown as clean entries, and links in HTML that are safe to show."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillspark.functions import text as T
from quillspark.operators import math_spans as M
from quillspark.operators import units as U

# Fences that may hold references; how an entry begins that stands directly below another line.
FENCE, FENCED = r"(?i)```(?:algorithm|pseudo|pseudocode|algo)?[ \t]*\n[\s\S]*?```", r"(?is)^```[a-z]*[ \t]*\n(.*?)```$"
ENTRY_STARTS = [
    r"\[\s*\d{1,4}\s*\]\s+\S", r"\d{1,3}\.\s+[A-ZÀ-ÖØ-Þ]", r"(?:19|20)\d{2}[a-z]?\s*[:.：]\s+[A-ZÀ-ÖØ-Þ]", r"[A-ZÀ-ÖØ-Þ][A-Za-zÀ-ÖØ-öø-ÿ'’-]{1,32},\s+(?:[A-Z](?:\.-?|(?![A-Za-z0-9_]))){1,4}[,.;]",
]


def reference_paragraphs(markdown: Column) -> Column:
    """Each entry of a list of references as a paragraph, without line numbers and fences; texts that are no such list keep theirs. Null is empty."""
    unwrapped = lambda m, _: T.bound(F.regexp_extract(m, FENCED, 1), lambda body: F.when(M.reference_list(body), T.trimmed(body)).otherwise(m))

    def apart(text: Column) -> Column:
        out = text
        for start in ENTRY_STARTS:
            out = F.regexp_replace(out, rf"([^\n])\n([ \t]*)({start})", "$1\n\n$2$3")
        return F.when(M.reference_list(text), F.regexp_replace(out, r"\n{3,}", "\n\n")).otherwise(text)

    return T.bound(U.without_line_numbers(markdown), lambda t: T.bound(M.replaced(t, FENCE, unwrapped), apart))


# Attributes that load or lead somewhere, and the addresses that each may have.
LINK = r"""(?i)\s(href|src)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))"""
SAFE = {"href": r"(?i)^(?:https?:|mailto:|#)", "src": r"(?i)^data:image/(?:png|jpeg|jpg|gif|webp);base64,"}


def safe_links(html: Column) -> Column:
    """Links to web, mail and the page itself and images that are in the page stay, in quotes; other href and src attributes go. Null is empty."""

    def link(m: Column, _: Column) -> Column:
        part = lambda g: F.regexp_extract(m, LINK, g)
        name, url = F.lower(part(1)), T.trimmed(F.concat(part(2), part(3), part(4)))
        quote = F.when(m.rlike(r"=\s*'[^']*'$"), "'").otherwise('"')
        safe = F.when(name == "href", url.rlike(SAFE["href"])).otherwise(url.rlike(SAFE["src"]))
        return F.when(safe, F.concat(F.lit(" "), name, F.lit("="), quote, url, quote)).otherwise("")

    return T.bound(F.coalesce(html, F.lit("")), lambda t: M.replaced(t, LINK, link))
