import numpy as np

from quillspark.llm import gated_lm, queries


def test_every_training_text_is_trained_on(spark):
    texts = [f"some words of text {i} stand here" for i in range(60)] + ["a text that many rows hold"] * 40
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(3)
    model, encoded = gated_lm.learn(rows, 10, 500)
    first = spark.sparkContext.broadcast((model.classes, model.weights))
    for size in (10_000, 100):
        fits = gated_lm.fitted(encoded.select("doc_id", "key", "codes"), first, size).collect()
        assert sum(r["tokens"] for r in fits) == sum(len(gated_lm.tokens(t)) for t in texts)


def test_rows_that_are_repeated_are_dealt_to_all_groups(spark):
    rows = [(1, 5, [0] * 10)] * 300 + [(i, i, [0] * 10) for i in range(100)]
    training = spark.createDataFrame(rows, "doc_id long, key long, codes array<smallint>")
    dealt, groups = gated_lm.groups_of(training, 400)
    sizes = [sum(1 for _ in part) for part in dealt.rdd.glom().collect()]
    assert groups == 10 and sum(sizes) == 400 and np.max(sizes) < 120


def test_held_out_texts_at_full_width(spark):
    held = [r for r in queries.op9_lm_score(spark, "/root/testdata/sf0.01").collect() if r["held_out"]]
    # 24 hidden units: -3.634
    assert sum(r["score"] for r in held) / sum(r["n_tokens"] for r in held) > -3.63
