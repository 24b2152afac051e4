"""Page trees: messy JSON of blocks, segments, captions and table cells becomes checked nodes, and these become items to translate.

A page is one JSON string. It is read as a variant, so that the type of every value is known: a text that is a number is no text, an
array with other things in it keeps its objects only. All nodes of a page are made in one narrow step (a page is bounded by
LIMITS); ids that are missing are derived from the place, and have to be unique over all levels.

Whatever is wrong with a page is its fault, a column: no job fails for a page. Faults, in this order: not_object, bad_index, bad_blocks; then limits by
name (the first of LIMITS that is exceeded); then duplicate_id with the smallest id that occurs twice. A page with a fault has no nodes.
A null page isn't an object.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.functions import text as T
from quillspark.operators import units as U

# Kinds of blocks, those with a text of their own, and what a page may hold.
KINDS = "heading paragraph display_math table figure caption plain_text".split()
TEXT_KINDS = "heading paragraph caption plain_text".split()
LIMITS = {"blocks": 4096, "segments": 4096, "table_rows": 2048, "table_columns": 256, "table_cells": 20000, "page_table_cells": 20000, "nodes": 50000, "text_characters": 5 * 1024 * 1024}
#: For pages of any size.
UNLIMITED = dict.fromkeys(LIMITS, 1 << 62)
FORMULA_KINDS = "formula inline_math display_math".split()
# Below this confidence a table is shown as its source only.
TABLE_CONFIDENCE = 0.8
# Fixed value: what a cell with a number looks like, with deviation, sign or unit.
NUMBER = r"[+\-−]?(?:\d+(?:[.,]\d+)?|\.\d+)(?:e[+\-−]?\d+)?"
NUMERIC = rf"(?i)^\s*{NUMBER}(?:(?:\s*(?:±|\+/-)\s*{NUMBER})|(?:\s*\(\s*{NUMBER}\s*\)))?\s*(?:%|[+\-−≈])?(?:\s*[a-zµμ]+(?:\s*[/·]\s*[a-zµμ]+)*)?\s*$"

#: Fields of a node. block: the block's place in the page; place: the node's in its block; row, col: a cell's; line: a segment's line of an algorithm.
NODE = {
    "level": "string", "block": "int", "place": "int", "row": "int", "col": "int", "id": "string", "kind": "string", "text": "string", "latex": "string", "role": "string", "content_role": "string", "frozen": "boolean", "box": "array<double>", "line": "int",
    "layout": "string", "detector": "string", "confidence": "double", "columns": "int", "header_rows": "int", "rows": "int", "chars": "long",
}


def _get(v: Column, key: str) -> Column:
    return F.try_variant_get(v, f"$.{key}", "variant")


def _kind(v: Column) -> Column:
    return F.coalesce(F.schema_of_variant(v), F.lit("VOID"))


def is_object(v: Column) -> Column:
    """By a cast: the schema of an object would be that of all below it."""
    return F.try_variant_get(v, "$", "map<string,variant>").isNotNull()


def is_array(v: Column) -> Column:
    return F.try_variant_get(v, "$", "array<variant>").isNotNull()


def string(v: Column, key: str) -> Column:
    """The text under a key; null if it is something else."""
    return T.bound(_get(v, key), lambda x: F.when(_kind(x) == "STRING", F.try_variant_get(x, "$", "string")))


def number(v: Column, key: str) -> Column:
    return T.bound(_get(v, key), lambda x: F.when(_kind(x).rlike("^(?:BIGINT|DECIMAL|DOUBLE|FLOAT)"), F.try_variant_get(x, "$", "double")))


def whole(v: Column, key: str) -> Column:
    return T.bound(number(v, key), lambda x: F.when((x == F.floor(x)) & (F.abs(x) < 1 << 31), x.cast("int")))


def array(v: Column, key: str) -> Column:
    """The array under a key as variants; empty if there is none."""
    return F.coalesce(F.try_variant_get(v, f"$.{key}", "array<variant>"), F.array().cast("array<variant>"))


def box(v: Column, key: str = "bbox") -> Column:
    """Four finite numbers; otherwise zeros."""
    parts = array(v, key)
    right = (F.size(parts) == 4) & F.forall(parts, lambda x: _kind(x).rlike("^(?:BIGINT|DECIMAL|DOUBLE|FLOAT)"))
    return F.when(right, F.transform(parts, lambda x: F.try_variant_get(x, "$", "double"))).otherwise(F.array(*[F.lit(0.0)] * 4))


def _node(wanted: list[str], **fields: Column) -> Column:
    return F.struct(*[(fields[k] if k in fields else F.lit(None)).cast(NODE[k]).alias(k) for k in wanted])


def _length(*texts: Column) -> Column:
    return sum((F.coalesce(F.char_length(t), F.lit(0)) for t in texts), F.lit(0))


def _named(v: Column, fallback: Column) -> Column:
    return F.coalesce(F.nullif(string(v, "id"), F.lit("")), fallback)


def _segments(block: Column, id: Column, at: Column, wanted: list[str]) -> Column:
    """Text and formulas of a paragraph; one with a text and no segments is one segment."""

    def one(s: Column, i: Column) -> Column:
        read = F.struct(F.coalesce(string(s, "kind") == "inline_math", F.lit(False)).alias("math"), string(s, "text").alias("text"), string(s, "latex").alias("latex"), F.nullif(string(s, "id"), F.lit("")).alias("id"))
        named = lambda x: F.coalesce(x["id"], F.concat(id, F.when(x["math"], "-m").otherwise("-s"), i.cast("string")))
        return T.bound(read, lambda x: _node(
            wanted, level=F.lit("segment"), block=at, place=i + 1, id=named(x), kind=F.when(x["math"], "inline_math").otherwise("text"), text=F.when(~x["math"], F.coalesce(x["text"], F.lit(""))),
            latex=F.when(x["math"], F.coalesce(x["latex"], x["text"], F.lit(""))), line=whole(s, "algorithm_line"), box=box(s), chars=_length(x["text"], x["latex"]),
        ))

    text = F.coalesce(string(block, "text"), F.lit(""))
    alone = _node(wanted, level=F.lit("segment"), block=at, place=F.lit(1), id=F.concat(id, F.lit("-s0")), kind=F.lit("text"), text=text, box=F.array(*[F.lit(0.0)] * 4), chars=_length(text))
    found = F.transform(F.filter(array(block, "segments"), is_object), one)
    return F.when(F.size(found) > 0, found).when(T.trimmed(text) != "", F.array(alone)).otherwise(F.slice(found, 1, 0))


def _caption(block: Column, id: Column, at: Column, wanted: list[str]) -> Column:
    v = _get(block, "caption")
    text = F.coalesce(string(v, "text"), F.lit(""))
    node = _node(wanted, level=F.lit("caption"), block=at, place=F.lit(1), id=_named(v, F.concat(id, F.lit("-caption"))), kind=F.lit("caption"), text=text, box=box(v), chars=_length(text))
    return F.when(is_object(v), F.array(node)).otherwise(F.slice(F.array(node), 1, 0))


def _table_rows(block: Column) -> Column:
    rows = F.filter(array(block, "rows"), is_array)
    return F.transform(rows, lambda r: F.try_variant_get(r, "$", "array<variant>"))


def _width(block: Column, rows: Column) -> Column:
    return F.greatest(F.coalesce(whole(block, "columns"), F.lit(0)), F.coalesce(F.array_max(F.transform(rows, lambda r: F.size(r))), F.lit(0)))


def _cells(rows: Column, columns: Column, id: Column, at: Column, wanted: list[str]) -> Column:
    """Every row is filled up to the table's width."""

    def one(v: Column, r: Column, c: Column) -> Column:
        held = F.when(is_object(v), _get(v, "text")).otherwise(v)
        text = F.coalesce(F.try_variant_get(held, "$", "string"), F.lit(""))
        role = F.when(is_object(v) & string(v, "role").isin("row_header", "header"), string(v, "role")).otherwise("data")
        named = F.when(is_object(v), _named(v, F.lit(None).cast("string")))
        named = F.coalesce(named, F.concat(id, F.lit("-r"), r.cast("string"), F.lit("-c"), c.cast("string")))
        return _node(wanted, level=F.lit("cell"), block=at, place=2 + r * columns + c, row=r, col=c, id=named, kind=F.when(is_object(v), string(v, "kind")), text=text, role=role, chars=F.when(_kind(held) == "STRING", _length(text)).otherwise(0))

    places = F.filter(F.sequence(F.lit(0), F.greatest(columns - 1, F.lit(0))), lambda c: c < columns)
    return F.flatten(F.transform(rows, lambda row, r: F.transform(places, lambda c: T.bound(F.get(row, c), lambda v: one(v, r, c)))))


def _block(v: Column, at: Column, page: Column, limits: dict[str, int], wanted: list[str]) -> Column:
    """The block's node and all below it."""
    kind = F.when(string(v, "kind").isin(KINDS), string(v, "kind")).otherwise("plain_text")
    id = _named(v, F.concat(F.lit("p"), page.cast("string"), F.lit("-b"), at.cast("string")))
    named = T.bound(_table_rows(v), lambda rows: F.struct(kind.alias("kind"), id.alias("id"), rows.alias("rows"), _width(v, rows).alias("wide")))

    def nodes(x: Column) -> Column:
        table, figure = x["kind"] == "table", x["kind"] == "figure"
        wide = F.when(table, x["wide"])
        own = _node(
            wanted, level=F.lit("block"), block=at, place=F.lit(0), id=x["id"], kind=x["kind"], text=F.when(x["kind"].isin(TEXT_KINDS), F.coalesce(string(v, "text"), F.lit(""))), latex=F.when(x["kind"] == "display_math", F.coalesce(string(v, "latex"), F.lit(""))),
            role=F.nullif(T.trimmed(string(v, "role")), F.lit("")), content_role=F.nullif(T.trimmed(string(v, "content_role")), F.lit("")), frozen=(_kind(_get(v, "translatable")) == "BOOLEAN") & ~F.try_variant_get(v, "$.translatable", "boolean"), box=box(v),
            layout=string(v, "layout"), detector=string(v, "detector"), confidence=number(v, "confidence"), columns=wide, rows=F.when(table, F.size(x["rows"])),
            header_rows=F.when(table, F.least(F.greatest(F.coalesce(whole(v, "header_rows"), F.lit(0)), F.lit(0)), F.size(x["rows"]))), chars=_length(string(v, "text"), string(v, "latex"), string(v, "number")),
        )
        # a table over its limits is a fault: its cells are not made
        fits = table & (F.size(x["rows"]) <= limits["table_rows"]) & (wide <= limits["table_columns"]) & (F.size(x["rows"]) * wide <= limits["table_cells"])
        below = F.when(x["kind"] == "paragraph", _segments(v, x["id"], at, wanted)).when(fits, F.concat(_caption(v, x["id"], at, wanted), _cells(x["rows"], x["wide"], x["id"], at, wanted))).when(table | figure, _caption(v, x["id"], at, wanted))
        return F.concat(F.array(own), F.coalesce(below, F.slice(F.array(own), 1, 0)))

    return T.bound(named, nodes)


def normalized(pages: DataFrame, ir: str = "ir", limits: dict[str, int] = LIMITS, fields: list[str] | None = None) -> DataFrame:
    """pages with index, width, height, fault and nodes instead of the JSON column.

    fields: those of NODE that are asked for (None: all); others are not made. Without limits no node is counted.
    """
    unlimited = limits == UNLIMITED
    wanted = [k for k in NODE if fields is None or k in fields or k == "id" or not unlimited]
    keys = [c for c in pages.columns if c != ir]
    v = F.col("_page")
    found = pages.select(*keys, F.try_parse_json(F.col(ir)).alias("_page"))
    found = found.select(*keys, "_page", whole(v, "index").alias("index"), F.coalesce(number(v, "width"), F.lit(0.0)).alias("width"), F.coalesce(number(v, "height"), F.lit(0.0)).alias("height"), array(v, "blocks").alias("_blocks"))
    fault = F.when(~is_object(v), "not_object").when(F.col("index").isNull() | (F.col("index") < 0), "bad_index").when(~is_array(_get(v, "blocks")), "bad_blocks").when(F.size("_blocks") > limits["blocks"], "blocks")
    found = found.withColumn("_fault", fault)
    blocks = F.filter(F.col("_blocks"), is_object)
    nodes = F.when(F.col("_fault").isNull(), F.flatten(F.transform(blocks, lambda b, i: _block(b, i, F.col("index"), limits, wanted))))
    # an explode keeps the optimizer from copying the nodes into every use of them
    found = found.select(*keys, "index", "width", "height", "_fault", F.explode_outer(F.array(nodes)).alias("nodes"))
    each = lambda test: F.filter("nodes", test)
    over = lambda test: F.exists("nodes", lambda n: F.coalesce(test(n), F.lit(False)))
    ids = F.array_sort(F.transform("nodes", lambda n: n["id"]))
    twice = T.bound(ids, lambda s: F.array_min(F.filter(s, lambda x, i: x == F.get(s, i + 1))))
    faults = {} if unlimited else {
        "segments": over(lambda n: (n["level"] == "segment") & (n["place"] > limits["segments"])), "table_rows": over(lambda n: n["rows"] > limits["table_rows"]), "table_columns": over(lambda n: (n["level"] == "block") & (n["columns"] > limits["table_columns"])),
        "table_cells": over(lambda n: n["rows"] * n["columns"] > limits["table_cells"]), "page_table_cells": F.size(each(lambda n: n["level"] == "cell")) > limits["page_table_cells"], "nodes": F.size("nodes") > limits["nodes"],
        "text_characters": F.aggregate("nodes", F.lit(0).cast("long"), lambda a, n: a + n["chars"]) > limits["text_characters"],
    }
    first = F.coalesce(F.col("_fault"), *[F.when(test, F.lit(name)) for name, test in faults.items()], F.concat(F.lit("duplicate_id "), twice))
    found = found.select(*keys, "index", "width", "height", first.alias("fault"), "nodes")
    return found.withColumn("nodes", F.when(F.col("fault").isNull(), F.col("nodes")))


def translatable(n: Column) -> Column:
    """Whether a node's text may be translated: prose, captions, and cells with more than values."""
    own = (n["level"] == "block") & n["kind"].isin([k for k in TEXT_KINDS if k != "paragraph"])
    prose = (n["level"] == "segment") & (n["kind"] == "text")
    cell = (n["level"] == "cell") & ~F.coalesce(n["kind"].isin(FORMULA_KINDS), F.lit(False)) & ~U.value_cell(n["text"])
    return F.coalesce((own | prose | (n["level"] == "caption") | cell) & (T.trimmed(n["text"]) != ""), F.lit(False))


def items(pages: DataFrame) -> DataFrame:
    """A row for each item of normalized pages, in order: the page's columns, place (from 0), id, text."""
    keys = [c for c in pages.columns if c != "nodes"]
    kept = F.transform(F.filter("nodes", translatable), lambda n: F.struct(n["id"].alias("id"), n["text"].alias("text")))
    return pages.select(*keys, F.posexplode(kept).alias("place", "item")).select(*keys, "place", "item.id", "item.text")


def visible_items(pages: DataFrame) -> DataFrame:
    """The items without the cells of tables that were found with little confidence."""
    keys = [c for c in pages.columns if c != "nodes"]
    hidden = F.transform(F.filter("nodes", lambda n: (n["level"] == "block") & (n["kind"] == "table") & (n["confidence"] < TABLE_CONFIDENCE)), lambda n: n["block"])
    shown = T.bound(hidden, lambda h: F.filter("nodes", lambda n: (n["level"] != "cell") | ~F.array_contains(h, n["block"])))
    return items(pages.select(*keys, shown.alias("nodes")))


def table_models(pages: DataFrame) -> DataFrame:
    """A row for each table of normalized pages: its shape, head and body cells in order, whether they are numbers, and whether only its source is shown."""
    keys = [c for c in pages.columns if c != "nodes"]
    numeric = lambda n: (T.trimmed(n["text"]) != "") & n["text"].rlike(NUMERIC)
    cell = lambda n: F.struct(n["row"].alias("row"), n["col"].alias("col"), n["id"].alias("id"), n["text"].alias("text"), n["role"].alias("role"), numeric(n).alias("numeric"))
    starts = F.filter(F.sequence(F.lit(0), F.greatest(F.size("nodes") - 1, F.lit(0))), lambda i: F.coalesce((F.get("nodes", i)["level"] == "block") & (F.get("nodes", i)["kind"] == "table"), F.lit(False)))

    def model(t: Column, i: Column) -> Column:
        # its cells follow a table and its caption: no table looks at, or is handed, the other nodes of its page
        below = F.filter(F.slice("nodes", i + 2, t["rows"] * t["columns"] + 1), lambda n: (n["level"] == "cell") & (n["block"] == t["block"]))
        part = lambda head: F.transform(F.filter(below, lambda n: (n["row"] < t["header_rows"]) == F.lit(head)), cell)
        return F.struct(
            t["id"].alias("id"), t["columns"].alias("columns"), t["rows"].alias("rows"), part(True).alias("head"), part(False).alias("body"), F.coalesce(t["confidence"] < TABLE_CONFIDENCE, F.lit(False)).alias("source_only"),
        )

    each = pages.filter(F.col("nodes").isNotNull()).select(*keys, F.explode(F.transform(starts, lambda i: T.bound(F.get("nodes", i), lambda t: model(t, i)))).alias("_table"))
    return each.select(*keys, "_table.*")
