"""What the operators of this subpackage share: tables, the shared folder, words and shingles."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words of a shingle, and the share of shingles that makes two texts alike, unless a contract says otherwise.
SHINGLE_WORDS = 5
SIMILARITY = 0.8
#: Java and RE2 read this alike; what lies between words.
NOT_WORD = r"[^\p{L}\p{N}]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: the session's spark.checkpoint.dir.

    Only a local session without that setting (as in tests) gets a temporary folder of its own.
    """
    context = spark.sparkContext
    found = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not found:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="quillspark-")
        context.setCheckpointDir(found)
    return found.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """Writes df as Parquet in the shared folder and reads it again, which cuts its lineage.

    Unlike an RDD checkpoint the columns are compressed and can be pruned when they are read.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def removed(df: DataFrame) -> None:
    """Deletes the folder of a written table that nothing reads any more; other tables are left alone."""
    spark = df.sparkSession
    shared = shared_folder(spark)
    folders = {f.rsplit("/", 1)[0] for f in df.inputFiles()}
    own = shared.split(":", 1)[-1].lstrip("/")
    for folder in folders:
        if folder.split(":", 1)[-1].lstrip("/").startswith(f"{own}/"):
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def once(df: DataFrame, name: str, expr: Column) -> DataFrame:
    """df with a column that is computed once for each row.

    The optimizer would copy a plain projection into every filter and lambda that names it; it keeps a generator apart.
    """
    return df.select("*", F.explode_outer(F.array(expr)).alias(name))


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of value, which is computed once though body may name it in its lambdas."""
    return F.get(F.transform(F.array(value), body), 0)


def words(text: Column) -> Column:
    """Lower-case words of letters and digits, in order; none for a null text."""
    parts = F.split(F.lower(F.coalesce(text, F.lit(""))), NOT_WORD)
    return F.filter(parts, lambda w: w != "")


def word_shingle_hashes(tokens: Column, n: int = SHINGLE_WORDS) -> Column:
    """XXH64 of each run of n words, in order, repeats included.

    Fewer than n words make one shingle of them all; no words make none.
    """
    one = lambda i: F.xxhash64(*[F.get(tokens, i + k) for k in range(n)])
    starts = F.sequence(F.lit(0), F.greatest(F.size(tokens) - n, F.lit(0)))
    return F.when(F.size(tokens) > 0, F.transform(starts, one)).otherwise(F.array().cast("array<bigint>"))


def word_shingles(tokens: Column, n: int = SHINGLE_WORDS) -> Column:
    """The distinct shingles themselves, as strings; the rules are those of word_shingle_hashes."""
    starts = F.sequence(F.lit(0), F.greatest(F.size(tokens) - n, F.lit(0)))
    each = F.transform(starts, lambda i: F.array_join(F.slice(tokens, i + 1, n), " "))
    return F.when(F.size(tokens) > 0, F.array_distinct(each)).otherwise(F.array().cast("array<string>"))


def text_key(text: Column) -> list[Column]:
    """Two columns, key1 and key2, that are equal for equal texts (128 bits of two differently seeded hashes)."""
    text = F.coalesce(text, F.lit(""))
    return [F.xxhash64(text).alias("key1"), F.xxhash64(F.lit("quillspark"), text).alias("key2")]
