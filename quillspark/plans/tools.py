"""Named tools over a collection: a registry with JSON schemas, a dispatcher, and the paper and workbench tools.

A tool takes plain arguments and returns a DataFrame (or, for writers, the new state of a store). Calls are deduplicated by
name and sorted arguments; the pages that a trace of calls touched are a column expression.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.functions import text as T
from quillspark.operators import documents as O
from quillspark.operators import ranking, retrieval, stores

MAX_RANGE, MAX_HITS, ROUNDS = 5, 15, 16


@dataclass(frozen=True)
class Tool:
    name: str
    about: str
    run: Callable[..., Any]
    parameters: dict[str, str] = field(default_factory=dict)  # name -> JSON type
    required: tuple[str, ...] = ()
    confirm: bool = False


class Registry:
    """Tools by name; unknown names and missing arguments raise, unknown arguments are left out."""

    def __init__(self, tools: list[Tool]):
        self.tools = {t.name: t for t in tools}

    def schemas(self) -> list[dict]:
        return [{"type": "function", "function": {"name": t.name, "description": t.about, "parameters": {"type": "object", "properties": {p: {"type": k} for p, k in t.parameters.items()}, "required": list(t.required)}}} for t in self.tools.values()]

    def call(self, name: str, args: dict[str, Any] | None = None, confirmed: bool = False) -> Any:
        tool = self.tools.get(name)
        if tool is None:
            raise KeyError(f"no tool named {name}")
        given = {k: v for k, v in (args or {}).items() if k in tool.parameters}
        if missing := [p for p in tool.required if p not in given]:
            raise ValueError(f"{name} needs {', '.join(missing)}")
        if tool.confirm and not confirmed:
            raise PermissionError(f"{name} has to be confirmed")
        return tool.run(**given)


def signature(name: str, args: dict[str, Any] | None) -> str:
    return f"{name}:{json.dumps(args or {}, sort_keys=True, ensure_ascii=False)}"


def new_calls(calls: list[tuple[str, dict]], done: set[str]) -> tuple[list[tuple[str, dict]], list[tuple[str, dict]]]:
    """Calls that were not made before, and those that were; done is added to."""
    fresh, repeated = [], []
    for name, args in calls:
        key = signature(name, args)
        (repeated if key in done else fresh).append((name, args))
        done.add(key)
    return fresh, repeated


def turn(ask: Callable[[list], tuple[list[tuple[str, dict]], str]], registry: Registry, rounds: int = ROUNDS) -> tuple[str, list[tuple[str, bool]]]:
    """Asks until there is an answer or no new call, at most `rounds` times; the answer and a trace of (signature, did it work)."""
    done: set[str] = set()
    trace: list[tuple[str, bool]] = []
    results: list = []
    answer = ""
    for _ in range(min(32, max(1, rounds))):
        calls, answer = ask(results)
        fresh, _ = new_calls(calls, done)
        if answer or not fresh:
            break
        for name, args in fresh:
            try:
                results.append((name, registry.call(name, args)))
                trace.append((signature(name, args), True))
            except (KeyError, ValueError, PermissionError) as error:
                results.append((name, error))
                trace.append((signature(name, args), False))
    return answer, trace


def pages_of_trace(steps: Column, most: int = 6) -> Column:
    """Pages that steps (array of struct<name, page, from, to, ok, pages>) touched, sorted; ranges count `most` pages at most."""
    ranged = lambda s: F.when(s["from"].isNotNull() & s["to"].isNotNull() & (s["to"] >= s["from"]), F.sequence(s["from"], F.least(s["to"], s["from"] + most - 1))).otherwise(F.array().cast("array<int>"))
    each = F.transform(F.filter(steps, lambda s: s["ok"]), lambda s: F.concat(F.when(s["page"].isNotNull(), F.array(s["page"])).otherwise(F.array().cast("array<int>")), ranged(s), F.coalesce(s["pages"], F.array().cast("array<int>"))))
    return F.array_sort(F.array_distinct(F.filter(F.flatten(each), lambda p: p >= 1)))


def paper_tools(pages: DataFrame, chunks: DataFrame, current: int = 1) -> list[Tool]:
    """Tools over the pages (page, text, status) and chunks of one paper."""

    def status() -> DataFrame:
        return pages.agg(F.count("*").alias("pages"), F.count_if(F.col("status") == "done").alias("done"), F.max("page").alias("last_page")).withColumn("current", F.lit(current))

    def one(page: int) -> DataFrame:
        return pages.filter(F.col("page") == page)

    def some(start: int, end: int) -> DataFrame:
        return pages.filter(F.col("page").between(start, min(end, start + MAX_RANGE - 1))).orderBy("page")

    def previews() -> DataFrame:
        return pages.select("page", "status", F.left(T.one_line(F.col("text")), F.lit(80)).alias("preview")).orderBy("page")

    def outline() -> DataFrame:
        return O.outline(pages.select(F.lit("paper").alias("doc"), "page", F.col("text").alias("markdown")))

    def search(query: str) -> DataFrame:
        return retrieval.evidence(chunks, query, current, 12)

    def evidence(query: str) -> DataFrame:
        return retrieval.with_neighbours(retrieval.evidence(chunks, query, current), pages)

    def substring(query: str) -> DataFrame:
        low, q = F.lower(F.coalesce("text", F.lit(""))), query.strip().lower()
        at = F.locate(q, low)
        found = pages.filter(F.contains(low, F.lit(q)) & F.lit(bool(q))).select("page", F.substring("text", F.greatest(F.lit(1), at - 40), F.lit(200)).alias("snippet"))
        return found.orderBy("page").limit(MAX_HITS)

    text, number = "string", "integer"
    return [
        Tool("get_paper_meta", "counts of pages", status),
        Tool("get_current_page", "the page that is open", lambda: one(current)),
        Tool("get_page", "one page", one, {"page": number}, ("page",)),
        Tool("get_page_range", f"up to {MAX_RANGE} pages", some, {"start": number, "end": number}, ("start", "end")),
        Tool("list_pages", "state and first words of every page", previews),
        Tool("get_outline", "headings", outline),
        Tool("search_paper", "best pages for a question", search, {"query": text}, ("query",)),
        Tool("retrieve_evidence", "best pages and their neighbours", evidence, {"query": text}, ("query",)),
        Tool("search_paper_text", "pages that hold a string", substring, {"query": text}, ("query",)),
    ]


def workbench_tools(notes: DataFrame, papers: DataFrame, reading: DataFrame, venues: DataFrame, facts: DataFrame, now_ms: int) -> list[Tool]:
    """Tools over a workspace's tables."""

    def add_reading(id: str, title: str) -> DataFrame:
        last = reading.agg(F.coalesce(F.max("ord"), F.lit(0)).alias("m"))
        new = last.select(F.lit(id).alias("id"), F.lit(title).alias("title"), (F.col("m") + 1).alias("ord"))
        return stores.appended_once(reading.select("id", "title", "ord"), new, ["id"])

    def remember(fact: str) -> DataFrame:
        new = facts.agg((F.coalesce(F.max("ord"), F.lit(0)) + 1).alias("ord")).select(F.lit(fact).alias("fact"), "ord")
        return stores.merged(facts.select("fact", "ord").unionByName(new), stores.STORES["facts"])

    text, number = "string", "integer"
    return [
        Tool("search_knowledge_base", "notes with a query's terms", lambda query, k=8: ranking.with_snippets(ranking.vault_search(notes, query, k), query), {"query": text, "k": number}, ("query",)),
        Tool("read_knowledge_note", "one note", lambda name: notes.filter(F.col("name") == name), {"name": text}, ("name",)),
        Tool("fetch_frontier_papers", "ranked papers", lambda keywords, k=20: ranking.ranked(papers, [x.strip() for x in keywords.split(",")], [], papers.filter("false").select("id"), now_ms, k), {"keywords": text, "k": number}, ("keywords",)),
        Tool("add_to_reading_list", "adds a paper once", add_reading, {"id": text, "title": text}, ("id", "title"), confirm=True),
        Tool("list_reading_list", "papers to read, newest first", lambda: reading.orderBy(F.col("ord").desc())),
        Tool("list_submission_deadlines", "venues by days left", lambda: ranking.venue_board(venues, now_ms).orderBy("state", "countdown.days")),
        Tool("remember_research_fact", "keeps a fact once", remember, {"fact": text}, ("fact",), confirm=True),
    ]
