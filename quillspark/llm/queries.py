"""The queries of this subpackage: each operator over its whole table, with production settings."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm import decontaminate, gated_lm, html_extract, jaccard_join, license_scan, packing, quality, sharding, simhash, spelling, suffix_dedup, syncmers, vector_codes
from quillspark.llm.common import NOT_WORD, SHINGLE_WORDS, SIMILARITY, table


def op1_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"), with_kept=True)


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contained_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(table(spark, sf_dir, "documents"))


def op4_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels")
    model = quality.fit(docs, labels.filter(~quality.held_out(F.col("doc_id"))))
    return quality.scored(docs, model, ["doc_id"]).select("doc_id", quality.held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def op6_extract_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.main_texts(table(spark, sf_dir, "pages"))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_copies(table(spark, sf_dir, "documents"))


def op8_syncmer_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return syncmers.edited_fingerprints(table(spark, sf_dir, "documents"))


def op9_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gated_lm.score(table(spark, sf_dir, "documents"))


def op10_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sharding.shard_by_bytes(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op11_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.join_components(table(spark, sf_dir, "documents"))


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.codes_and_errors(table(spark, sf_dir, "embeddings"))


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = [op1_suffix_array_dedup, op2_decontaminate, op3_license_scan, op4_pack, op5_quality, op6_extract_html, op7_simhash, op8_syncmer_fingerprints, op9_lm_score, op10_shards, op11_jaccard_join, op12_vector_codes, op13_spelling_variants]
    return {f.__name__: f for f in own}


def _word_list(column: str) -> str:
    return f"list_filter(string_split_regex(lower(coalesce({column}, '')), '{NOT_WORD}'), lambda x: x <> '')"


def _shingle_rows(source: str) -> str:
    """SQL: id, i (from 0) and s, the shingle at each position of source (id, w)."""
    n = SHINGLE_WORDS
    return f"SELECT id, i, array_to_string(w[i + 1 : i + {n}], ' ') AS s FROM (SELECT id, w, unnest(range(greatest(len(w) - {n}, 0)::BIGINT + 1)) AS i FROM {source} WHERE len(w) > 0)"


def _decontaminate_sql() -> str:
    return f"""
        WITH d AS (SELECT doc_id AS id, {_word_list("text")} AS w FROM documents),
        b AS (SELECT item_id AS id, {_word_list("text")} AS w FROM benchmark),
        ds AS (SELECT DISTINCT id, s FROM ({_shingle_rows("d")})),
        bs AS (SELECT DISTINCT id, s FROM ({_shingle_rows("b")})),
        n AS (SELECT id, count(*) AS n FROM bs GROUP BY id),
        m AS (SELECT ds.id AS doc_id, bs.id AS item_id, count(*) AS k FROM ds JOIN bs USING (s) GROUP BY ALL)
        SELECT doc_id, item_id, n::INTEGER AS n_shingles, k::INTEGER AS n_shared, k::DOUBLE / n AS containment
        FROM m JOIN n ON n.id = m.item_id WHERE k::DOUBLE / n >= {SIMILARITY} - 1e-9"""


def _license_sql() -> str:
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    known = ", ".join(f"({quote(name)}, {quote(text)}, {len(license_scan.template_words(text))})" for name, text in license_scan.TEMPLATES)
    return f"""
        WITH t AS (SELECT name AS id, m, {_word_list("text")} AS w FROM (VALUES {known}) AS v(name, text, m)),
        ts AS (SELECT DISTINCT id, s FROM ({_shingle_rows("t")})),
        n AS (SELECT id, count(*) AS n FROM ts GROUP BY id),
        d AS (SELECT doc_id AS id, {_word_list("text")} AS w FROM documents),
        hits AS (SELECT d.id AS doc_id, d.i, d.s, ts.id AS license_id, t.m FROM ({_shingle_rows("d")}) d JOIN ts USING (s) JOIN t ON t.id = ts.id),
        placed AS (SELECT DISTINCT doc_id, license_id, m, s, unnest([i // m, i // m - 1]) AS w, i FROM hits),
        windows AS (SELECT doc_id, license_id, m, w, count(DISTINCT s) AS k FROM placed WHERE w >= 0 AND i >= w * m AND i < w * m + 2 * m - {SHINGLE_WORDS - 1} GROUP BY ALL)
        SELECT doc_id, license_id, max(k::DOUBLE / n) AS containment, count(DISTINCT w) AS n_windows, min(w * m)::INTEGER AS first_word
        FROM windows JOIN n ON n.id = windows.license_id WHERE k::DOUBLE / n >= {SIMILARITY} - 1e-9 GROUP BY ALL"""


def _jaccard_sql() -> str:
    n, upper = jaccard_join.SHINGLE, "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return f"""
        WITH RECURSIVE w AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), '{upper}', '{upper.lower()}'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
        s AS (SELECT DISTINCT doc_id, array_to_string(w[i + 1 : i + {n}], ' ') AS s FROM (SELECT doc_id, w, unnest(range(greatest(len(w) - {n}, 0)::BIGINT + 1)) AS i FROM w WHERE len(w) > 0)),
        n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
        shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b USING (s) WHERE a.doc_id <> b.doc_id GROUP BY ALL),
        links AS (SELECT a, b FROM shared JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= {jaccard_join.LINK} * (x.n + y.n - k)),
        reached AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reached r JOIN links l ON l.a = r.b)
        SELECT w.doc_id, coalesce(any_value(n.n), 0) AS n_shingles, least(w.doc_id, min(r.b)) AS component_id
        FROM w LEFT JOIN n ON n.doc_id = w.doc_id LEFT JOIN reached r ON r.a = w.doc_id GROUP BY w.doc_id"""


def _codes_sql() -> str:
    parts, entries, scale = vector_codes.PARTS, vector_codes.ENTRIES, vector_codes.SCALE
    assigned = """a{r} AS MATERIALIZED (SELECT p, vec_id, q, min(struct_pack(d := d, e := e)) AS best FROM (
            SELECT x.p, x.vec_id, x.q, b.e, list_sum(list_transform(list_zip(x.q, b.c), lambda t: (t[1] - t[2]) * (t[1] - t[2])))::BIGINT AS d FROM x JOIN b{r} b ON b.p = x.p) GROUP BY p, vec_id, q)"""
    updated = """m{r} AS (SELECT p, best.e AS e, i, sum(q[i]) AS total, count(*) AS n FROM a{r}, range(1, 1 + (SELECT max(len(q)) FROM x)) AS t(i) GROUP BY ALL),
        u{r} AS (SELECT p, e, list((total // n - CASE WHEN total % n < 0 THEN 1 ELSE 0 END)::BIGINT ORDER BY i) AS c FROM m{r} GROUP BY p, e),
        b{s} AS MATERIALIZED (SELECT b.p, b.e, coalesce(u.c, b.c) AS c FROM b{r} b LEFT JOIN u{r} u ON u.p = b.p AND u.e = b.e)"""
    rounds = ",\n        ".join(f"{assigned.format(r=r)},\n        {updated.format(r=r, s=r + 1)}" for r in range(vector_codes.ROUNDS))
    last = vector_codes.ROUNDS
    return f"""
        WITH k AS (SELECT vec_id, label, list_transform(embedding, lambda v: floor(v::DOUBLE * {scale})::BIGINT) AS q FROM embeddings
            WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda v: v IS NULL OR NOT isfinite(v))) = 0),
        x AS MATERIALIZED (SELECT vec_id, p, q[p * (len(q) // {parts}) + 1 : (p + 1) * (len(q) // {parts})] AS q FROM k, range({parts}) AS t(p)),
        b0 AS MATERIALIZED (SELECT p, row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS e, q AS c FROM x QUALIFY e < {entries}),
        {rounds},
        {assigned.format(r=last)},
        c AS (SELECT vec_id, string_agg(printf('%02x', best.e::INTEGER), '' ORDER BY p) AS code, sum(best.d)::BIGINT AS error FROM a{last} GROUP BY vec_id),
        h AS (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM b{last})
        SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error, codebooks_sha256 FROM c JOIN k USING (vec_id), h"""


def _spelling_sql() -> str:
    """The hash is worked out byte by byte: x becomes its upper bytes XOR the table's entry for its lowest byte XOR the next byte."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return f"""
        WITH RECURSIVE bits AS (SELECT i, list_reduce(range(8), lambda x, _: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384) ELSE x // 2 END, i) AS v FROM range(256) AS t(i)),
        tab AS MATERIALIZED (SELECT list(v ORDER BY i) AS tab FROM bits),
        runs AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, '{upper}', '{upper.lower()}'), '[A-Za-z\u00C0-\u00FF]+')) AS run FROM documents),
        own AS MATERIALIZED (SELECT doc_id, run, count(*) AS n, hex(encode(concat(doc_id, ':', run))) AS x FROM runs WHERE length(run) >= {spelling.LEAST_LENGTH} GROUP BY doc_id, run),
        crc AS (SELECT run, n, xor(4294967295, list_reduce(list_transform(range(length(x) // 2), lambda i: ('0x' || x[2 * i + 1 : 2 * i + 2])::BIGINT),
            lambda s, y: xor(s // 256, tab[xor(s, y) % 256 + 1]), 4294967295)) AS h FROM own, tab),
        words AS (SELECT CASE WHEN h % {spelling.LOSES} = 0 THEN run[1 : h % length(run)] || run[h % length(run) + 2 :] ELSE run END AS word, n FROM crc),
        v AS MATERIALIZED (SELECT word, sum(n)::BIGINT AS n FROM words WHERE length(word) >= {spelling.LEAST_LENGTH} GROUP BY word HAVING sum(n) >= {spelling.LEAST_COUNT}),
        placed AS (SELECT word, n, unnest(range(length(word))) AS i FROM v),
        cut AS MATERIALIZED (SELECT DISTINCT word, n, word[1 : i] || word[i + 2 :] AS less FROM placed),
        wild AS MATERIALIZED (SELECT word, n, word[1 : i] || '*' || word[i + 2 :] AS key FROM placed),
        near AS (SELECT a.word, b.word AS other, b.n FROM wild a JOIN wild b ON a.key = b.key AND a.word <> b.word
            UNION ALL SELECT c.word, v.word, v.n FROM cut c JOIN v ON v.word = c.less UNION ALL SELECT v.word, c.word, c.n FROM cut c JOIN v ON v.word = c.less),
        best AS (SELECT word, count(*) AS n_near, min(struct_pack(less := -n, other := other)) AS best FROM near GROUP BY word),
        formed AS MATERIALIZED (SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN -best.less >= {spelling.TIMES} * v.n THEN best.other END AS form,
            CASE WHEN -best.less >= {spelling.TIMES} * v.n THEN -best.less END AS form_n FROM v LEFT JOIN best ON best.word = v.word),
        chain AS (SELECT word, word AS root, 0 AS step FROM v UNION ALL SELECT c.word, f.form, step + 1 FROM chain c JOIN formed f ON f.word = c.root WHERE f.form IS NOT NULL)
        SELECT f.word, form, any_value(r.root) AS root, f.n, f.n_near, form_n::BIGINT AS form_n
        FROM formed f JOIN (SELECT word, arg_max(root, step) AS root FROM chain GROUP BY word) r ON r.word = f.word GROUP BY ALL"""


def oracle_sql() -> dict[str, str]:
    return {
        "op2_decontaminate": _decontaminate_sql(), "op3_license_scan": _license_sql(), "op11_jaccard_join": _jaccard_sql(), "op12_vector_codes": _codes_sql(),
        "op13_spelling_variants": _spelling_sql(),
    }
