"""Evidence search over documents: each document is a page of one collection."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.functions import text as T
from quillspark.operators import retrieval as R
from quillspark.plans import dialect as D
from quillspark.sources import tables

QUERY = "retion of the ingen edthes and thereas"
TERMS = ["retion", "ingen", "edthes", "edth", "thereas", "therea"]
TOP = 20


def whole_pages(docs: DataFrame) -> DataFrame:
    """Each document as one chunk."""
    return docs.select(F.col("doc_id").alias("page"), F.lit(0).alias("chunk"), F.concat(F.lit("p"), F.col("doc_id").cast("string"), F.lit("-c0")).alias("chunk_id"), "text", F.lit("").alias("heading"), F.lit("translation").alias("source_type"), F.lit("").alias("status"))


def bm25_top_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = R.scored_chunks(whole_pages(tables.read(spark, sf_dir, "documents")), QUERY)
    top = scored.orderBy(F.col("score").desc(), F.col("term_coverage").desc(), "page").limit(TOP)
    return top.select(F.col("page").alias("doc_id"), F.round("score", 4).alias("score"), F.round("term_coverage", 3).alias("term_coverage"))


def _scored_sql() -> str:
    terms = ", ".join(f"'{t}'" for t in TERMS)
    n = len(TERMS)
    return f"""
        t AS (SELECT doc_id, text, {D.tokens("text")} AS tok FROM documents),
        l AS (SELECT doc_id, text, greatest(1, len(tok)) AS len, tok FROM t),
        s AS (SELECT greatest(1, count(*)) AS n, greatest(1.0, avg(len)) AS av FROM l),
        q AS (SELECT unnest([{terms}]) AS q, unnest(range({n})) AS i),
        tf AS (SELECT l.doc_id, q.q, q.i, len(list_filter(l.tok, lambda x: x = q.q)) AS tf, l.len FROM l CROSS JOIN q),
        df AS (SELECT q, count(*) FILTER (tf > 0) AS df FROM tf GROUP BY q),
        b AS (SELECT tf.doc_id, sum(CASE WHEN tf > 0 THEN ln(1 + (n - df + 0.5) / (df + 0.5)) * (tf * {R.K1 + 1}) / (tf + {R.K1} * (1 - {R.B} + {R.B} * len / av)) ELSE 0 END) AS bm, count(*) FILTER (tf > 0)::DOUBLE / {n} AS cov FROM tf JOIN df USING (q) CROSS JOIN s GROUP BY tf.doc_id),
        scored AS (SELECT b.doc_id AS page, bm + CASE WHEN contains(lower({D.squeezed("text")}), '{QUERY}') THEN {R.PHRASE} ELSE 0 END + CASE WHEN b.doc_id = 0 THEN {R.CURRENT} ELSE 0 END + {R.TRANSLATION} + cov * {R.COVERAGE} AS score, cov AS term_coverage FROM b JOIN l USING (doc_id))"""


BM25_SQL = f"WITH {_scored_sql()} SELECT page AS doc_id, round(score, 4) AS score, round(term_coverage, 3) AS term_coverage FROM scored ORDER BY scored.score DESC, scored.term_coverage DESC, page LIMIT {TOP}"


def token_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = tables.read(spark, sf_dir, "documents")
    return docs.select(F.explode(T.search_tokens(F.col("text"))).alias("token")).groupBy("token").agg(F.count("*").alias("tf"))


def document_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = tables.read(spark, sf_dir, "documents")
    return docs.select(F.explode(F.array_distinct(T.search_tokens(F.col("text")))).alias("token")).groupBy("token").agg(F.count("*").alias("df"))


def corpus_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = tables.read(spark, sf_dir, "documents")
    lengths = docs.select("doc_id", F.greatest(F.lit(1), F.size(T.search_tokens(F.col("text")))).alias("n"))
    return lengths.agg(F.count("*").alias("chunks"), F.round(F.avg("n"), 6).alias("average_length"), F.max("doc_id").alias("total_pages"))


def postings_by_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = tables.read(spark, sf_dir, "documents").select("lang", "text")
    return R.postings(docs, ["lang"])


def _source_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = tables.read(spark, sf_dir, "documents")
    return docs.select(F.col("source").alias("doc"), (F.col("doc_id") + 1).alias("page"), "text", F.lit("").alias("heading"), F.lit("source").alias("source_type"), F.lit("done").alias("status"))


def chunk_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.chunk_pages(_source_pages(spark, sf_dir))


def evidence_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole query path: chunks, BM25, best chunk of each page, snippets."""
    pages = _source_pages(spark, sf_dir)
    return R.evidence(R.chunk_pages(pages), QUERY, chunks_of=lambda few: R.chunk_pages(pages.join(F.broadcast(few), "page", "left_semi").select(pages.columns)))


def _hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages count from 1, documents from 0."""
    docs = tables.read(spark, sf_dir, "documents")
    return R.evidence(whole_pages(docs).withColumn("page", F.col("page") + 1), QUERY)


def evidence_neighbors(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = tables.read(spark, sf_dir, "documents").select((F.col("doc_id") + 1).alias("page"), "text")
    return R.with_neighbours(_hits(spark, sf_dir), pages)


NEIGHBOURS_SQL = f"""
    WITH {_scored_sql().replace("b.doc_id AS page", "b.doc_id + 1 AS page").replace("b.doc_id = 0", "b.doc_id = -1")},
    hits AS (SELECT page, round(score, 4) AS score, row_number() OVER (ORDER BY scored.score DESC, term_coverage DESC, page) AS rank FROM scored ORDER BY rank LIMIT {R.PAGES}),
    near AS (SELECT rank * 3 + o AS ord, page + d AS page, page AS hit, d, score FROM hits CROSS JOIN (VALUES (0, 0), (1, -1), (2, 1)) AS v(o, d)),
    ok AS (SELECT * FROM near WHERE page >= 1 AND (d = 0 OR page IN (SELECT doc_id + 1 FROM documents WHERE trim(coalesce(text, '')) <> ''))),
    first AS (SELECT *, row_number() OVER (PARTITION BY page ORDER BY ord) AS r FROM ok)
    SELECT ord, page, CASE WHEN d = 0 THEN score ELSE round(greatest(0, score * {R.NEIGHBOUR}), 6) END AS score, CASE WHEN d <> 0 THEN hit END AS neighbour_of FROM first WHERE r = 1 ORDER BY ord LIMIT {R.NEIGHBOUR_PAGES}"""


def evidence_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.evidence_pack(_hits(spark, sf_dir), QUERY)


def _answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = tables.read(spark, sf_dir, "conversations")
    cited = lambda n: F.concat(F.lit("第 "), n.cast("string"), F.lit(" 页"))
    answer = F.concat(F.lit("见"), cited(F.col("conv_id") % 23), F.lit("和"), cited(F.col("turn") * 7 + 1), F.lit("，"), cited(F.col("conv_id") % 23))
    return turns.select("conv_id", "turn", answer.alias("answer"), F.lit(20).alias("total_pages"), F.array(F.lit(1), F.lit(2), F.lit(3), F.lit(8), F.lit(15), (F.col("turn") + 3).cast("int")).alias("allowed"))


def citation_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = R.citation_audit(_answers(spark, sf_dir))
    return out.select("conv_id", "turn", F.array_join("cited", ",").alias("cited"), F.array_join("invalid", ",").alias("invalid"), F.array_join("unsupported", ",").alias("unsupported"), F.array_join("supported", ",").alias("supported"), "coverage", "ok")


AUDIT_SQL = """
    WITH a AS (SELECT conv_id, turn, [1, 2, 3, 8, 15, turn + 3] AS allowed, CASE WHEN conv_id % 23 = turn * 7 + 1 THEN [conv_id % 23] ELSE [conv_id % 23, turn * 7 + 1] END AS cited FROM conversations),
    b AS (SELECT *, list_filter(cited, lambda p: p < 1 OR p > 20) AS invalid FROM a),
    c AS (SELECT *, list_filter(cited, lambda p: NOT (p < 1 OR p > 20) AND NOT list_contains(allowed, p)) AS unsupported, list_filter(cited, lambda p: NOT (p < 1 OR p > 20) AND list_contains(allowed, p)) AS supported FROM b)
    SELECT conv_id, turn, array_to_string(cited, ',') AS cited, array_to_string(invalid, ',') AS invalid, array_to_string(unsupported, ',') AS unsupported, array_to_string(supported, ',') AS supported,
    round(len(supported)::DOUBLE / len(cited), 3) AS coverage, len(invalid) = 0 AND len(unsupported) = 0 AS ok FROM c"""


def answer_support(spark: SparkSession, sf_dir: str) -> DataFrame:
    audit = R.citation_audit(_answers(spark, sf_dir))
    items = F.transform(F.sequence(F.lit(1), F.col("turn").cast("int") % 5 + 1), lambda i: F.struct(i.alias("page"), (i * 1.5).alias("score"), (F.lit(1.0) / (i + 1)).alias("term_coverage")))
    out = audit.withColumn("s", R.support_score(F.size("cited"), F.size("invalid"), F.size("unsupported"), F.col("coverage"), items))
    return out.select("conv_id", "turn", F.col("s.score").alias("support"), F.col("s.level").alias("level"))


SUPPORT_SQL = f"""
    WITH z AS ({AUDIT_SQL}), y AS (SELECT conv_id, turn, coverage, len(string_split(cited, ',')) AS nc, CASE WHEN invalid = '' THEN 0 ELSE len(string_split(invalid, ',')) END AS ni, CASE WHEN unsupported = '' THEN 0 ELSE len(string_split(unsupported, ',')) END AS nu, range(1, turn % 5 + 2) AS it FROM z),
    x AS (SELECT *, list_sum(list_transform(it, lambda i: 1.0 / (i + 1))) / len(it) AS tc, list_sum(list_transform(it, lambda i: i * 1.5)) / len(it) AS sc FROM y),
    w AS (SELECT conv_id, turn, round(greatest(0, least(1, coverage * 0.48 + 0.16 + least(1, tc * 0.65 + (1 - exp(-sc / 4)) * 0.35) * 0.22 + least(1, len(it) / 4.0) * 0.14 - least(0.85, ni * 0.35 + nu * 0.2))) * 100)::INTEGER AS support FROM x)
    SELECT conv_id, turn, support, CASE WHEN support >= 78 THEN 'strong' WHEN support >= 48 THEN 'moderate' ELSE 'weak' END AS level FROM w"""

QUERIES = {
    "bm25_top_documents": (bm25_top_documents, BM25_SQL),
    "token_frequency": (token_frequency, f"SELECT token, count(*) AS tf FROM (SELECT unnest({D.tokens('text')}) AS token FROM documents) GROUP BY token"),
    "document_frequency": (document_frequency, f"SELECT token, count(*) AS df FROM (SELECT unnest(list_distinct({D.tokens('text')})) AS token FROM documents) GROUP BY token"),
    "corpus_stats": (corpus_stats, f"SELECT count(*) AS chunks, round(avg(greatest(1, len({D.tokens('text')}))), 6) AS average_length, max(doc_id) AS total_pages FROM documents"),
    "postings_by_language": (postings_by_language, f"SELECT lang, token, count(*) AS tf FROM (SELECT lang, unnest({D.tokens('text')}) AS token FROM documents) GROUP BY ALL"),
    "chunk_documents": (chunk_documents, None),
    "evidence_search": (evidence_search, None),
    "evidence_neighbors": (evidence_neighbors, NEIGHBOURS_SQL),
    "evidence_pack": (evidence_pack, None),
    "citation_audit": (citation_audit, AUDIT_SQL),
    "answer_support": (answer_support, SUPPORT_SQL),
}
