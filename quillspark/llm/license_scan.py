"""License scan: known notices and license texts inside documents, retrieved by MinHash bands over text windows.

Templates are grouped by their number of words m. For a group a document is cut into windows of 2m words, one every
m words, so that any m consecutive words lie in a window whole. A window that contains at least the threshold of a
template's shingles has a Jaccard similarity to it of at least j = ceil(t * n) / (2m - 4 + n - ceil(t * n)); with b bands of
one MinHash value each the two collide in some band with probability 1 - (1 - j)^b, and b is chosen to make that at
least GUARANTEE. Colliding pairs are verified by the exact containment of the shingles.

Only windows that hold some shingle of some template can collide, so signatures are made for those alone: the
pass over a document's other windows is one set lookup for each shingle. Nothing but verified pairs is shuffled.

Case rules: null and blank texts match nothing; templates need SHINGLE_WORDS words; a doc_id on several rows counts
once; null doc_ids are kept as an id of their own; other columns are ignored.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import SHINGLE_WORDS, SIMILARITY, once, word_shingle_hashes, words

GUARANTEE = 0.9999

# Notices and opening clauses of public licenses.
TEMPLATES = [
    ("apache-2.0-short", "Licensed under the Apache License, Version 2.0."),
    ("apache-2.0-header", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("mit-short", "Released under the MIT License."),
    ("mit-permission", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction"),
    ("gpl-3.0-short", "This work is licensed under the GNU General Public License, version 3."),
    ("gpl-3.0-header", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("lgpl-header", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation"),
    ("cc-by-nc-4.0-short", "Licensed under CC BY-NC 4.0."),
    ("cc-by-4.0-short", "Licensed under CC BY 4.0."),
    ("cc-by-sa-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("cc-by-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("bsd-redistribution", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("mpl-2.0-header", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("isc-permission", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("unlicense", "This is free and unencumbered software released into the public domain."),
    ("all-rights-reserved", "No part of this publication may be reproduced, distributed, or transmitted in any form or by any means"),
]


def template_words(text: str) -> list[str]:
    return [w for w in re.split(r"[\W_]+", text.lower()) if w]


def bands(m: int, n: int, threshold: float, shingle: int) -> int:
    """Bands that make a window of 2m words collide with a template of n shingles that it contains."""
    need = math.ceil(threshold * n - 1e-9)
    j = need / (2 * m - shingle + 1 + n - need)
    return max(1, math.ceil(math.log(1 - GUARANTEE) / math.log(1 - j))) if j < 1 else 1


def scan(docs: DataFrame, templates: list[tuple[str, str]] | None = None, threshold: float = SIMILARITY, shingle: int = SHINGLE_WORDS) -> DataFrame:
    """doc_id, license_id, containment (the best), n_windows that contain it, first_word (where the first of them starts)."""
    spark = docs.sparkSession
    rows = [(name, text, len(template_words(text))) for name, text in (TEMPLATES if templates is None else templates)]
    if any(m < shingle for _, _, m in rows):
        raise ValueError(f"a template needs {shingle} words")
    known = spark.createDataFrame(rows, "license_id string, text string, m int")
    known = once(known, "tokens", words(F.col("text"))).select("license_id", "m", F.array_distinct(word_shingle_hashes(F.col("tokens"), shingle)).alias("known"))
    # a fixed list, whose size does not depend on the documents
    known_rows = known.collect()
    if not known_rows:
        return docs.select("doc_id").filter("false").selectExpr("doc_id", "'' license_id", "0D containment", "0L n_windows", "0 first_word")
    count = {m: max(bands(m, len(r["known"]), threshold, shingle) for r in known_rows if r["m"] == m) for m in {r["m"] for r in known_rows}}
    all_known = F.array(*[F.lit(x) for x in sorted({x for r in known_rows for x in r["known"]})])

    def signature(shingles, b):
        return F.transform(F.sequence(F.lit(0), b - 1), lambda j: F.struct(j.alias("band"), F.array_min(F.transform(shingles, lambda x: F.xxhash64(x, j))).alias("low")))

    m_bands = F.create_map(*[F.lit(x) for pair in sorted(count.items()) for x in pair])
    keyed = known.withColumn("sig", signature(F.col("known"), F.element_at(m_bands, F.col("m"))))
    keyed = keyed.select("license_id", "m", "known", F.explode("sig").alias("sig")).select("license_id", "m", "known", "sig.band", "sig.low")

    tokens = once(docs.select("doc_id", "text"), "tokens", words(F.col("text"))).select("doc_id", "tokens")
    hashes = once(tokens, "hashes", word_shingle_hashes(F.col("tokens"), shingle)).select("doc_id", "hashes")
    hashes = once(hashes, "known", F.array_intersect("hashes", all_known)).filter(F.size("known") > 0)
    at = F.filter(F.transform("hashes", lambda x, i: F.when(F.array_contains("known", x), i)), lambda i: i.isNotNull())
    hits = once(hashes, "at", at).drop("known")
    # window w of size m covers words w*m to w*m + 2m - 1
    def touched(m: int):
        both = F.flatten(F.transform("at", lambda i: F.array(F.floor(i / F.lit(m)), F.floor(i / F.lit(m)) - 1)))
        return F.transform(F.array_distinct(both), lambda w: F.struct(F.lit(m).alias("m"), w.cast("int").alias("w")))

    each = F.flatten(F.array(*[touched(m) for m in sorted(count)]))
    windows = hits.select("doc_id", "hashes", F.explode(each).alias("x")).filter("x.w >= 0").select("doc_id", "x.m", "x.w", F.array_distinct(F.slice("hashes", F.col("x.w") * F.col("x.m") + 1, F.col("x.m") * 2 - shingle + 1)).alias("window"))
    windows = windows.filter(F.size("window") > 0)
    signed = windows.select("doc_id", "m", "w", "window", F.explode(signature(F.col("window"), F.element_at(m_bands, F.col("m")))).alias("sig"))
    pairs = signed.select("doc_id", "m", "w", "window", "sig.band", "sig.low").join(F.broadcast(keyed), ["m", "band", "low"])
    pairs = pairs.withColumn("containment", F.size(F.array_intersect("window", "known")) / F.size("known")).filter(F.col("containment") >= threshold - 1e-9)
    return pairs.groupBy("doc_id", "license_id").agg(
        F.max("containment").alias("containment"), F.count_distinct("w").alias("n_windows"), F.min(F.col("w") * F.col("m")).alias("first_word")
    )
