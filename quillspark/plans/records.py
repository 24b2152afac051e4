"""Records and units over the tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.functions import text as T
from quillspark.operators import gate as G
from quillspark.operators import math_spans as M
from quillspark.operators import records as R
from quillspark.operators import units as U
from quillspark.plans import dialect as D
from quillspark.sources import tables


def library_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = tables.read(spark, sf_dir, "customer")
    rows = c.select(
        F.when(F.col("c_custkey") % 11 == 0, " ").otherwise(F.concat(F.lit(" /p/"), "c_name", F.lit(" "))).alias("path"), F.concat(F.col("c_name"), F.lit("  of \n "), "c_mktsegment").alias("title"), F.col("c_acctbal").alias("total_pages"), F.lit(None).cast("int").alias("last_page"),
        F.lit(2.5).alias("translated_count"), F.col("c_custkey").alias("updated_at"), (F.col("c_custkey") % 2 == 0).alias("starred"), (F.col("c_custkey") % 300 + 1900).alias("year"), F.array(F.lit("a"), F.lit("A "), "c_mktsegment").alias("tags"),
    )
    return R.normalized(rows, "library").withColumn("tags", F.array_join("tags", ","))


LIBRARY_SQL = f"""
    SELECT trim('/p/' || c_name) AS path, left({D.one_line("c_name || '  of ' || chr(10) || ' ' || c_mktsegment")}, 160) AS title, greatest(0, floor(c_acctbal + 0.5))::INTEGER AS total_pages, 0 AS last_page, 3 AS translated_count, c_custkey AS updated_at, c_custkey % 2 = 0 AS starred,
    'a,' || c_mktsegment AS tags, '' AS one_liner, '' AS arxiv_id, CASE WHEN c_custkey % 300 + 1900 BETWEEN 1990 AND 2099 THEN (c_custkey % 300 + 1900)::INTEGER END AS year FROM customer WHERE c_custkey % 11 <> 0"""


def highlight_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = tables.read(spark, sf_dir, "part")
    rows = p.select(F.col("p_partkey").alias("ord"), F.col("p_brand").alias("path"), (F.col("p_size") - 10).alias("page"), F.concat(F.lit(" "), "p_name", F.lit("\n x")).alias("text"), F.element_at(F.array(*[F.lit(c) for c in ("green", "red", "pink")]), (F.col("p_partkey") % 3 + 1).cast("int")).alias("color"), F.col("p_partkey").alias("created_at"))
    return R.normalized(rows, "highlight").drop("id")


HIGHLIGHT_SQL = "SELECT p_partkey AS ord, p_brand AS path, greatest(1, p_size - 10)::INTEGER AS page, p_name || ' x' AS text, (['green', 'yellow', 'pink'])[p_partkey % 3 + 1] AS color, '' AS note, p_partkey AS created_at FROM part"


def venue_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = tables.read(spark, sf_dir, "supplier")
    rows = s.select(F.when(F.col("s_suppkey") % 5 != 0, F.col("s_name")).alias("abbr"), F.when(F.col("s_suppkey") % 2 == 0, " 2024-05-01").otherwise("May").alias("deadline"))
    return R.normalized(rows, "venue").select("abbr", "name", "deadline", "url", "note", F.char_length("id").between(2, 8).alias("has_id"))


VENUE_SQL = "SELECT s_name AS abbr, '' AS name, CASE WHEN s_suppkey % 2 = 0 THEN '2024-05-01' ELSE '' END AS deadline, '' AS url, '' AS note, true AS has_id FROM supplier WHERE s_suppkey % 5 <> 0"


def reading_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = tables.read(spark, sf_dir, "lineitem")
    done = line.groupBy("l_orderkey").agg(F.count_if(F.col("l_linestatus") == "F").alias("done"), F.count("*").alias("total"))
    return done.select("l_orderkey", F.round(R.progress(F.col("done"), F.col("total")), 6).alias("progress"))


def pending_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = tables.read(spark, sf_dir, "lineitem")
    pages = line.select(F.col("l_orderkey").alias("doc"), F.col("l_linenumber").alias("page"), F.when(F.col("l_returnflag") == "N", "pending").otherwise("done").alias("status"))
    return R.next_pending(pages, 3)


PENDING_SQL = "SELECT l_orderkey AS doc, arg_min(l_linenumber, (l_linenumber < 3, l_linenumber)) AS page, count(*) AS pending FROM lineitem WHERE l_returnflag = 'N' GROUP BY l_orderkey"


#: Parts of cells; a key's digits pick one of each.
CELL_PARTS = [["12.5%", "3 ± 1", "7 km/h", "x", "α", "β_1", "x₂", "θ^2", "Total", "a = b", "—", "SOTA", "log x", "mean of x", ""], ["", " ", " + 1", "_i", " = 3", " e-3", "²"]]


def value_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = tables.read(spark, sf_dir, "part")
    return p.select("p_partkey", U.value_cell(D.picked(CELL_PARTS, "p_partkey", False)).alias("is_value"))


VALUE_SQL = f"SELECT p_partkey, {D.value_cell('cell')} AS is_value FROM (SELECT p_partkey, {D.picked(CELL_PARTS, 'p_partkey', True)} AS cell FROM part)"


def reference_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = tables.read(spark, sf_dir, "orders")
    line = F.concat(F.when(F.col("o_orderkey") % 2 == 0, "695: ").otherwise(""), F.lit("["), F.col("o_custkey").cast("string"), F.lit("] Wang, some long title of a work"), F.when(F.col("o_orderkey") % 3 == 0, ", 2013").otherwise(""), F.when(F.col("o_orderkey") % 5 == 0, " see").otherwise(""))
    return o.select("o_orderkey", U.reference_entry(line).alias("entry"), U.without_line_numbers(line).alias("clean"))


REFERENCE_SQL = "SELECT o_orderkey, o_custkey < 10000 AND o_orderkey % 3 = 0 AS entry, CASE WHEN o_orderkey % 2 = 0 AND o_custkey >= 10000 THEN '695: ' ELSE '' END || '[' || o_custkey || '] Wang, some long title of a work' || CASE WHEN o_orderkey % 3 = 0 THEN ', 2013' ELSE '' END || CASE WHEN o_orderkey % 5 = 0 THEN ' see' ELSE '' END AS clean FROM orders"


def protected_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Units with two tokens and what came back: intact, reshaped, swapped, one lost, or broken."""
    p = tables.read(spark, sf_dir, "part")
    a, b = U.placeholder(F.concat(F.lit("m "), "p_partkey")), U.placeholder(F.lit("n"))
    back = [F.concat(a, F.lit(" 与 "), b), F.concat(F.lit("［［PLM："), F.concat(F.lit("m%20"), "p_partkey"), F.lit("］］ 与 "), b), F.concat(b, F.lit(" 与 "), a), a, F.concat(a, F.lit(" 与 "), b, F.lit(" [[PLM:"))]
    got = F.element_at(F.array(*back), (F.col("p_partkey") % 5 + 1).cast("int"))
    return p.select("p_partkey", U.tokens_intact(F.array(a, b), got).alias("intact"), F.size(U.math_tokens(got)).alias("tokens"))


def untranslated_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = tables.read(spark, sf_dir, "documents")
    pairs = docs.select("doc_id", F.col("text").alias("source"), F.when(F.col("doc_id") % 2 == 0, F.col("text")).otherwise("译文译文译文").alias("output"))
    rows = G.shared_runs(pairs)
    verdict = U.likely_untranslated(G.latin_words(F.col("source")), G.latin_words(F.col("output")), U.wide_characters(F.col("output")), F.col("shared_run"), T.one_line(F.col("output")) == "", U.title_like(F.col("source")))
    return rows.select("doc_id", verdict.alias("untranslated"))


def markdown_repairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = tables.read(spark, sf_dir, "part")
    formula = F.concat(F.lit("$$x_"), "p_partkey", F.lit("$$\n(3)\nrest"))
    algorithm = F.concat(F.lit("1: Input x 2: for all 3: return "), "p_name")
    table = F.concat(F.lit("a\n| x | y |\n|--|--|\n| 1 | "), "p_partkey", F.lit(" |\nb"))
    return p.select("p_partkey", M.merged_equation_numbers(formula).alias("formula"), M.compact_algorithm(algorithm).alias("compact"), U.one_step_a_line(algorithm).alias("steps"), U.without_tables(table).alias("without_tables"), M.latex_heavy(formula).alias("heavy"))


REPAIRS_SQL = "SELECT p_partkey, '$$x_' || p_partkey || chr(10) || '\\tag{3}' || chr(10) || '$$' || chr(10) || 'rest' AS formula, true AS compact, '1: Input x' || chr(10) || '2: for all' || chr(10) || '3: return ' || p_name AS steps, 'a' || chr(10) || '@@TABLE@@' || chr(10) || 'b' AS without_tables, false AS heavy FROM part"

QUERIES = {
    "library_entries": (library_entries, LIBRARY_SQL),
    "highlight_records": (highlight_records, HIGHLIGHT_SQL),
    "venue_records": (venue_records, VENUE_SQL),
    "reading_progress": (reading_progress, "SELECT l_orderkey, round(count(*) FILTER (l_linestatus = 'F')::DOUBLE / count(*), 6) AS progress FROM lineitem GROUP BY l_orderkey"),
    "pending_pages": (pending_pages, PENDING_SQL),
    "value_cells": (value_cells, VALUE_SQL),
    "reference_lines": (reference_lines, REFERENCE_SQL),
    "protected_units": (protected_units, "SELECT p_partkey, p_partkey % 5 IN (0, 1) AS intact, CASE WHEN p_partkey % 5 = 3 THEN 1 ELSE 2 END AS tokens FROM part"),
    "untranslated_pairs": (untranslated_pairs, None),
    "markdown_repairs": (markdown_repairs, REPAIRS_SQL),
}
