"""Geometry: the reading target nearest to a point, column anchors, box rotation; text blocks from glyphs; batches of units."""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterator
from statistics import median

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

REACH = 0.04
# Limits of the first and of later batches.
FIRST_ITEMS, FIRST_COST, ITEMS, COST = 2, 900, 5, 1800
WORD = r"[A-Za-z]{2,}(?:[-'][A-Za-z]{2,})*"


def nearest_targets(points: DataFrame, boxes: DataFrame, reach: float = REACH) -> DataFrame:
    """points (page, point, x, y) and boxes (page, id, x0, y0, x1, y1, ord) -> point, id: the smallest box around the point, else the nearest within reach.

    A page is cut into cells. Of the boxes that cover a cell whole, only the smallest one can be a point's; of those that cover a part of it, only
    those that are smaller still. So a dense page leaves few boxes a cell, and points meet these. Points in no box meet the boxes around them.
    """
    inside = F.col("x").between(F.col("x0"), F.col("x1")) & F.col("y").between(F.col("y0"), F.col("y1"))
    points = points.filter(F.col("x").between(0, 1) & F.col("y").between(0, 1))
    boxes = boxes.select("page", "id", "x0", "y0", "x1", "y1", F.struct(((F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0"))).alias("area"), "ord").alias("_size"))
    cell = ["page", "_cx", "_cy"]

    def cells(column: Column, size: float) -> Column:
        return F.floor(column / size).cast("int")

    def spread(rows: DataFrame, size: float, bounds: dict[str, tuple[Column, Column]]) -> DataFrame:
        """rows once for each cell between two places, both included, on the page."""
        for name, (low, high) in bounds.items():
            low, high = F.greatest(low, F.lit(0.0)), F.least(high, F.lit(1.0))
            rows = rows.filter(low <= high).select("*", F.explode(F.sequence(cells(low, size), cells(high, size))).alias(name))
        return rows

    # a quotient never falls as its dividend grows: a point's cell between those of two edges, without them, lies between the edges
    small = reach / 4
    covered = spread(boxes, small, {"_cx": (F.col("x0"), F.col("x1")), "_cy": (F.col("y0"), F.col("y1"))})
    whole = (F.col("_cx") > F.floor(F.col("x0") / small)) & (F.col("_cx") < F.floor(F.col("x1") / small)) & (F.col("_cy") > F.floor(F.col("y0") / small)) & (F.col("_cy") < F.floor(F.col("y1") / small))
    best = covered.filter(whole).groupBy(*cell).agg(F.min_by(F.struct("id", "x0", "y0", "x1", "y1", "_size"), "_size").alias("_best"))
    parts = covered.filter(~whole).join(best, cell, "left").filter(F.col("_best").isNull() | (F.col("_size") < F.col("_best._size"))).drop("_best")
    there = parts.unionByName(best.select(*cell, "_best.*"))
    met = points.select("page", "point", "x", "y", cells(F.col("x"), small).alias("_cx"), cells(F.col("y"), small).alias("_cy")).join(there, cell).filter(inside)
    held = met.groupBy("point").agg(F.min_by("id", "_size").alias("id"))

    gap = lambda p, a, b: F.when(F.col(p) < F.col(a), F.col(a) - F.col(p)).when(F.col(p) > F.col(b), F.col(p) - F.col(b)).otherwise(0.0)
    dx, dy = gap("x", "x0", "x1"), gap("y", "y0", "y1")
    span = lambda a, b: (F.least(a, b) - 1.01 * reach, F.greatest(a, b) + 1.01 * reach)
    around = spread(boxes, reach, {"_cx": span("x0", "x1"), "_cy": span("y0", "y1")})
    rest = points.join(held.select("point"), "point", "left_anti").select("page", "point", "x", "y", cells(F.col("x"), reach).alias("_cx"), cells(F.col("y"), reach).alias("_cy"))
    near = rest.join(around, cell).select("point", "id", (dx * dx + dy * dy).alias("_distance"), "_size").filter(F.col("_distance") <= reach * reach)
    return held.unionByName(near.groupBy("point").agg(F.min_by("id", F.struct("_distance", "_size")).alias("id")))


def rotated_box(box: Column, turn: int) -> Column:
    """A normalised box [x0, y0, x1, y1] turned by 0, 90, 180 or 270 degrees."""
    x0, y0, x1, y1 = (F.get(box, i) for i in range(4))
    by = {0: (x0, y0, x1, y1), 90: (1 - y1, x0, 1 - y0, x1), 180: (1 - x1, 1 - y1, 1 - x0, 1 - y0), 270: (y0, 1 - x1, y1, 1 - x0)}
    return F.array(*by[turn % 360])


def column_anchor(rects: Column, top: Column) -> Column:
    """struct<index, ratio> of the first rect (top, bottom) that ends below top + 1, else the last one."""
    at = F.array_position(F.transform(rects, lambda r: r["bottom"] > top + 1), F.lit(True)) - 1
    r = F.get(rects, F.greatest(at, F.lit(0)).cast("int"))
    ratio = F.least(F.lit(1.0), F.greatest(F.lit(0.0), (top - r["top"]) / F.greatest(F.lit(1.0), r["bottom"] - r["top"])))
    return F.struct(F.when(at >= 0, at).otherwise(F.greatest(F.lit(0), F.size(rects) - 1)).cast("int").alias("index"), F.when(at >= 0, ratio).otherwise(0.0).alias("ratio"))


# ---- batches -----------------------------------------------------------------------------------------------------------


def unit_cost(text: str, math_tokens: int = 0) -> int:
    words = len(re.findall(WORD, text))
    return max(1, len(text) + min(900, 4 * words + 48 * math_tokens))


def taken(state: tuple[int, int, int], cost: int) -> tuple[int, int, int]:
    """Batch, items and cost after one more unit: greedy and in order; the first batch is small, an oversized unit goes alone."""
    batch, held, spent = state
    items, limit = (FIRST_ITEMS, FIRST_COST) if batch == 0 else (ITEMS, COST)
    if held and (held >= items or spent + cost > limit or spent >= limit):
        batch, held, spent = batch + 1, 0, 0
    return batch, held + 1, spent + cost


def batch_numbers(costs: list[int]) -> list[int]:
    """The batch of each unit."""
    return [state[0] for state in itertools.accumulate(costs, taken, initial=(0, 0, 0))][1:]


def unit_batches(units: DataFrame) -> DataFrame:
    """units (doc, ord, id, text) -> doc, ord, id, cost, batch; repeated ids go, the first stays.

    Costs are taken from the texts where they are read; documents then come one after the other, in order, and only the open batch is carried on.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        doc, seen, state = None, set(), (0, 0, 0)
        for rows in batches:
            docs, ids, costs = (rows.column(c).to_pylist() for c in ("doc", "id", "cost"))
            kept, numbers = [], []
            for i, (own, name, cost) in enumerate(zip(docs, ids, costs)):
                if own != doc:
                    doc, seen, state = own, set(), (0, 0, 0)
                key = name.strip() if name is not None else None
                if key != "" and key not in seen:
                    seen.add(key)
                    state = taken(state, cost)
                    kept.append(i)
                    numbers.append(state[0])
            yield rows.take(pa.array(kept, pa.int64())).append_column("batch", pa.array(numbers, pa.int32()))

    text = F.coalesce("text", F.lit(""))
    extra = F.least(F.lit(900), 4 * F.regexp_count(text, F.lit(WORD)))
    costs = units.select("doc", F.col("ord").cast("long").alias("ord"), "id", F.greatest(F.lit(1), F.char_length(text) + extra).cast("int").alias("cost"))
    doc = units.schema["doc"].dataType.simpleString()
    return costs.repartition("doc").sortWithinPartitions("doc", "ord").mapInArrow(run, f"doc {doc}, ord long, id string, cost int, batch int")


# ---- blocks from glyphs ------------------------------------------------------------------------------------------------


def column_gap(glyphs: list[dict], left: float, right: float, bins: int = 120) -> float | None:
    """The middle of the widest nearly empty stretch of the page's centre, if both sides hold a quarter of the glyphs."""
    if len(glyphs) < 30 or right <= left:
        return None
    counts, step = [0] * bins, (right - left) / bins
    for g in glyphs:
        a, b = int((g["x"] - left) / step), int((g["end"] - left) / step)
        for i in range(max(0, a), min(bins - 1, b) + 1):
            counts[i] += 1
    low = max(1.0, 0.12 * median(counts))
    best, run = (0, 0), 0
    for i in range(int(bins * 0.33), int(bins * 0.67) + 1):
        run = run + 1 if counts[i] <= low else 0
        best = max(best, (run, i))
    if not best[0]:
        return None
    gap = left + (best[1] - best[0] / 2 + 0.5) * step
    lefts = sum(g["end"] <= gap for g in glyphs)
    rights = sum(g["x"] >= gap for g in glyphs)
    return gap if min(lefts, rights) >= 0.25 * len(glyphs) else None


def rows_of(glyphs: list[dict]) -> list[list[dict]]:
    """Glyphs by baseline: a row takes what lies within max(2, half the font) of its running mean."""
    out: list[list] = []
    for g in sorted(glyphs, key=lambda g: (g["y"], g["x"])):
        row = out[-1] if out else None
        if row and abs(row[0] - g["y"]) <= max(2.0, 0.5 * g["size"]):
            row[1].append(g)
            row[0] += (g["y"] - row[0]) / len(row[1])
        else:
            out.append([g["y"], [g]])
    return [sorted(r[1], key=lambda g: g["x"]) for r in out]


def lines_of(rows: list[list[dict]], gap: float | None, width: float) -> list[dict]:
    """Rows cut at the column gap where they leave it free; a line knows its side: left, right or full."""
    out = []
    for row in rows:
        parts = [[]]
        for g in row:
            if parts[-1] and gap is not None and parts[-1][-1]["end"] <= gap <= g["x"] and g["x"] - parts[-1][-1]["end"] > 2.2 * min(g["size"], width):
                parts.append([])
            parts[-1].append(g)
        for p in parts:
            text = ""
            for g in p:
                blank = text and not text.endswith(" ") and g["x"] - end > 0.2 * g["size"]
                text, end = text + (" " if blank else "") + g["str"], g["end"]
            side = "full" if gap is None or (p[0]["x"] < gap < p[-1]["end"]) else "left" if p[-1]["end"] <= gap else "right"
            out.append({"text": text.strip(), "x": p[0]["x"], "end": p[-1]["end"], "y": p[0]["y"], "size": max(g["size"] for g in p), "side": side})
    return [x for x in out if x["text"]]


def in_reading_order(lines: list[dict]) -> list[dict]:
    """Full lines part the page; between them the left column comes before the right one."""
    out, held = [], []
    for line in [*lines, None]:
        if line is None or line["side"] == "full":
            out += [x for x in held if x["side"] == "left"] + [x for x in held if x["side"] == "right"]
            held = []
            out += [line] if line else []
        else:
            held.append(line)
    return out


def blocks_of(glyphs: list[dict]) -> list[dict]:
    """Blocks of a page: text, font size, kind (title, heading, body) and box, in reading order."""
    glyphs = [g for g in glyphs if g["str"].strip()]
    if not glyphs:
        return []
    left, right = min(g["x"] for g in glyphs), max(g["end"] for g in glyphs)
    lines = in_reading_order(lines_of(rows_of(glyphs), column_gap(glyphs, left, right), right - left))
    body = median(x["size"] for x in lines)
    blocks: list[dict] = []
    for line in lines:
        b = blocks[-1] if blocks else None
        joined = b and b["side"] == line["side"] and abs(b["size"] - line["size"]) <= 0.15 * body and 0 <= line["y"] - b["last"] <= 1.8 * line["size"] and line["x"] - b["x"] <= 2 * body
        if joined:
            b["text"] = b["text"][:-1] + line["text"] if b["text"].endswith("-") else b["text"] + " " + line["text"]
            b.update(last=line["y"], x=min(b["x"], line["x"]), end=max(b["end"], line["end"]))
        else:
            blocks.append(line | {"last": line["y"], "top": line["y"]})
    for i, b in enumerate(blocks):
        b["kind"] = "title" if i == 0 and b["size"] >= 1.5 * body else "heading" if b["size"] >= 1.15 * body and len(b["text"]) < 120 else "body"
    return blocks


def page_blocks(glyphs: DataFrame) -> DataFrame:
    """glyphs (page, ord, str, x, y, width, size) -> page, block, kind, text, size, x, y, right. Pages come one after the other, in order."""
    names = ["page", "block", "kind", "text", "size", "x", "y", "right"]

    def blocks(page: object, items: list[dict]) -> list[tuple]:
        return [(page, i, b["kind"], b["text"], float(b["size"]), float(b["x"]), float(b["top"]), float(b["end"])) for i, b in enumerate(blocks_of(items))]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        page, held = None, []
        for rows in batches:
            columns = (rows[c].tolist() for c in ("page", "str", "x", "y", "width", "size"))
            out = []
            for own, s, x, y, w, z in zip(*columns):
                if held and own != page:
                    out += blocks(page, held)
                    held = []
                page = own
                held.append({"str": s, "x": x, "y": y, "end": x + w, "size": z})
            yield pd.DataFrame(out, columns=names)
        if held:
            yield pd.DataFrame(blocks(page, held), columns=names)

    page = glyphs.schema["page"].dataType.simpleString()
    ordered = glyphs.select("page", "ord", "str", "x", "y", "width", "size").repartition("page").sortWithinPartitions("page", "ord")
    return ordered.mapInPandas(run, f"page {page}, block int, kind string, text string, size double, x double, y double, right double")
