"""Recovery of pseudocode: the first step is looked for once."""

from pyspark.sql import functions as F

from quillspark.operators import algorithms as A


def test_the_first_step_is_looked_for_once(spark):
    rows = spark.createDataFrame([(1, "Algorithm 1 Sort 1: Begin 2: x 3: End")], "id long, t string")
    plan = rows.select(A.recovered(F.col("t")).alias("r"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("(?s)^(|.*?") == 2  # its lead and its body
