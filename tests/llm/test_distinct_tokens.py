"""Words are looked up once for each distinct one of a batch, not once for each token."""

import numpy as np
import pyarrow as pa

from quillspark.llm import gated_lm

TEXTS = ["", None, " \t\n", "One one\x0bTWO\x0c\r two ", "É é ÀB", "a\x1cb\x85c d e\x00f", "  led", "x" * 50, "one\none"]


def test_as_tokens():
    for texts in (pa.array(TEXTS), pa.array(["cut off", *TEXTS, "cut off"]).slice(1, len(TEXTS)), pa.array(["", None])):
        words, at, numbers = gated_lm.distinct_tokens(texts)
        assert len(set(words)) == len(words) and words[-1] == gated_lm.END
        own = np.split([words[i] for i in at], np.cumsum(numbers)[:-1])
        assert [list(x) for x in own] == [gated_lm.tokens(t) for t in texts.to_pylist()]


def test_rows_stay_in_order_when_cut(monkeypatch):
    monkeypatch.setattr(gated_lm, "CUT_BYTES", 12)
    batch = pa.RecordBatch.from_arrays([pa.array(TEXTS), pa.array(range(len(TEXTS)))], names=["text", "i"])
    parts = list(gated_lm._cut(batch))
    assert len(parts) > 3 and [x for p in parts for x in p.column("i").to_pylist()] == list(range(len(TEXTS)))


def test_a_word_is_looked_up_once_in_a_batch(monkeypatch):
    class Counted(dict):
        asked = 0

        def get(self, *key):
            Counted.asked += 1
            return super().get(*key)

    class Shared:
        value = gated_lm.Words(Counted({gated_lm.END: 0, b"often": 1}), np.zeros(2), 2)

    class Docs:
        """Stands for a table: runs the function of its mapInArrow on one batch."""

        columns, schema = ["text"], {}

        def select(self, *names):
            return self

        def mapInArrow(self, run, kind):
            return list(run(iter([pa.RecordBatch.from_arrays([pa.array(["often rare often"] * 100)], names=["text"])])))

    (out,) = gated_lm.encoded(Docs(), Shared())
    row = out.slice(7, 1).to_pylist()[0]
    assert row["codes"][0] == row["codes"][2] == 1 and row["codes"][3] == 0 and row["n_frequent"] == 3 and len(row["rare"]) == 1
    assert Counted.asked == 3
