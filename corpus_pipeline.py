"""A corpus pipeline: from raw documents to packed training windows, in five stages.

Each stage is written as Parquet and read again as the next one's documents. All but the last return the columns of
documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm import decontaminate, near_texts, packing, quality, suffix_dedup
from quillspark.llm.common import table, written

#: Documents below this score go.
KEEP_SCORE = 0.5
#: Bytes of a passage that repeats: fewer than nearly all runs of fifty words have (of the sampled ones of a small table, 117 of 34,476
#: are shorter, being runs of very short words; those stay).
REPEAT_BYTES = 240


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier, which is learned from all labels, doesn't reject."""
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), F.col("text").alias("text"))
    return quality.scored(rows, model, ["row"]).filter(F.col("score") >= KEEP_SCORE).select("row.*")


def one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: by SimHash at two bits, or five-word shingles that agree to 0.8.

    The smallest doc_id stays, a null one only if there is no other; of rows that are repeated, one.
    """
    return near_texts.one_of_each(docs)


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without their repeated passages, with n_chars of what is left; documents of which nothing is left go."""
    out = suffix_dedup.remove_repeats(docs, REPEAT_BYTES, with_text=True)
    out = out.filter(F.coalesce(F.trim("text"), F.lit("")) != "")
    return out.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain no test item."""
    return decontaminate.without_leaks(docs, table(spark, sf_dir, "benchmark"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of training windows; a null text is an empty one and gives its end only."""
    return packing.pack(docs)


STAGES = [
    ("quality classifier", good_quality),
    ("SimHash near-dedup", one_of_near_copies),
    ("suffix-array dedup", without_repeats),
    ("benchmark decontamination", without_benchmark),
    ("packing", packed),
]

#: The classifier, the bit-wise fingerprints and the tokenizer have no SQL; tests/llm/test_pipeline.py does all that follows the classifier
#: pair by pair on a small fixture and compares run()'s rows with it.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = written(docs, "pipeline")
    return docs
