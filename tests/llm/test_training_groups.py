"""Groups of training follow the tokens only."""

import numpy as np

from quillspark.llm import gated_lm


def test_groups_follow_the_tokens_however_keys_are_dealt(spark, monkeypatch):
    rows = [(1, 5, [0] * 10)] * 300 + [(i, i, [0] * 10) for i in range(100)]
    training = spark.createDataFrame(rows, "doc_id long, key long, codes array<smallint>")
    frame, plain = type(training), type(training).repartition
    monkeypatch.setattr(frame, "repartition", lambda self, n, *by: plain(self, max(n, 60), *by))
    dealt, groups = gated_lm.groups_of(training, 400)
    sizes = [sum(1 for _ in part) for part in dealt.rdd.glom().collect()]
    assert groups == 10 and len(sizes) == 10 and sum(sizes) == 400 and np.max(sizes) < 60
