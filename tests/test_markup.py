"""Entries of references as paragraphs, and links that are safe to show."""

import time

from pyspark.sql import functions as F

from quillspark.operators import markup as K


def of(spark, rule, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "id int, t string")
    return [r["c"] for r in df.orderBy("id").select(rule(F.col("t")).alias("c")).collect()]


def test_references(spark):
    cases = {
        "695: [16] Wang, Y. A\n107:[17] Li, B. C": "[16] Wang, Y. A\n\n[17] Li, B. C",
        "References\n[1] A one\n[2] B two\n\n\n\n[3] C": "References\n\n[1] A one\n\n[2] B two\n\n[3] C",
        "```\n[1] Wang, Y.\n[2] Li, B.\n```": "[1] Wang, Y.\n\n[2] Li, B.",
        "```python\n[1] Wang\n```": "```python\n[1] Wang\n```",
        "as [12] says\n[3] and more": "as [12] says\n[3] and more",
        "see 12: [note]": "see 12: [note]",
        None: "",
        "": "",
    }
    assert of(spark, K.reference_paragraphs, list(cases)) == list(cases.values())


def test_links(spark):
    cases = {
        '<a href="https://a.b">': '<a href="https://a.b">',
        "<a HREF = ' #top '>": "<a href='#top'>",
        "<a href=javascript:alert(1) title=x>": "<a title=x>",
        '<a href=" JavaScript:x">': "<a>",
        '<img src="http://a/b.png" alt=y>': "<img alt=y>",
        "<img src=data:image/png;base64,AA>": '<img src="data:image/png;base64,AA">',
        '<a href="">': "<a>",
        "<a data-href=x>": "<a data-href=x>",
        None: "",
    }
    assert of(spark, K.safe_links, list(cases)) == list(cases.values())
    began = time.time()
    of(spark, K.safe_links, [' href="' * 50_000, " " * 200_000 + "src", " href=" + "x" * 200_000])
    assert time.time() - began < 20
