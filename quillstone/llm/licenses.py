"""License scans: MinHash bands over overlapping windows, then exact shingle containment.

A text is lower-cased ASCII words; templates and windows are sets of five-word
shingles. For every class of template lengths (up to 8, 16, 32 ... words), windows a
quarter longer than its longest template begin every quarter, so a window holds every
occurrence whole. A window and a template are candidates if one of ``BANDS`` minimum
hashes is equal (bands of one row: with a Jaccard index of j all differ with
probability (1 - j)**BANDS; five words in a window of ten have j = 1/6, so 0.0007). The shingles of the template that the window has are counted exactly.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import settled

SHINGLE, BANDS, CONTAINED = 5, 40, 0.8

#: License and a text that grants or names it.
TEMPLATES = (
    ("apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.'),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("cc-by-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc-by-4.0", "Licensed under CC BY 4.0"),
    ("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0"),
    ("cc-by-sa-4.0", "Licensed under CC BY-SA 4.0"),
    ("gpl-3.0", "This work is licensed under the GNU General Public License, version 3"),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("mit", "Released under the MIT License"),
    ("mit", "Licensed under the MIT License"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("unlicense", "This is free and unencumbered software released into the public domain"),
)


def ascii_words(text: Column) -> Column:
    """Lower-cased runs of ASCII letters and digits; none for null."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9]+"), lambda w: w != "")


def shingles(tokens: Column) -> Column:
    """Hash of each five words in a row."""
    starts = F.when(F.size(tokens) >= SHINGLE, F.sequence(F.lit(1), F.size(tokens) - (SHINGLE - 1))).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.xxhash64(F.array_join(F.slice(tokens, i, SHINGLE), " ")))


def bands(hashes: Column) -> Column:
    """The least value of each band's hash over a set of shingles, with the band mixed in."""

    def least(band: int) -> Column:
        return F.array_min(F.transform(hashes, lambda x: F.xxhash64(x, F.lit(band))))

    return F.array(*(least(band) for band in range(BANDS)))


def template_sets(spark: SparkSession, templates=TEMPLATES) -> list[dict]:
    """Number, license, word list, shingle hashes and band values of each template."""
    rows = spark.createDataFrame([(i, name, text) for i, (name, text) in enumerate(templates)], "template int, license string, text string")
    rows = rows.withColumn("tokens", ascii_words(F.col("text"))).withColumn("own", F.array_distinct(shingles(F.col("tokens"))))
    found = [r.asDict() for r in rows.filter(F.size("own") > 0).withColumn("values", bands(F.col("own"))).collect()]
    if len(found) < len(templates):
        raise ValueError(f"templates need {SHINGLE} words at least")
    return found


def anchors(tokens: list[str]) -> set[str]:
    """Longest words of a template without all of which more than a fifth of its shingles
    are missing: a text that has none of them can't reach the containment."""
    n = len(tokens) - SHINGLE + 1
    sets = [set(tokens[i : i + SHINGLE]) for i in range(n)]
    chosen: set[str] = set()
    for word in sorted(set(tokens), key=lambda w: (-len(w), w)):
        if len({tuple(sorted(s)) for s in sets if s & chosen}) > (1 - CONTAINED) * n:
            break
        chosen.add(word)
    return chosen


def scan(docs: DataFrame, templates=TEMPLATES) -> DataFrame:
    """Licenses in each row of ``docs`` (doc_id, text): doc_id, license, containment (the share of
    a template's shingles, 0.8 to 1, in one window), windows (how many windows have as much).

    Only texts with one of the templates' ``anchors`` are cut into windows: the others
    can't have 80 % of any template's shingles. One row for each license of a row of ``docs``; rows with the same
    doc_id are told apart. Null, empty and short texts have none; an empty table gives no
    rows; other columns are not read. Hashes of templates are broadcast: their number is fixed.
    """
    spark = docs.sparkSession
    known = template_sets(spark, templates)
    needed = sorted(set().union(*(anchors(t["tokens"]) for t in known)))
    rows = docs.select("doc_id", F.monotonically_increasing_id().alias("row"), ascii_words(F.col("text")).alias("tokens"))
    rows = rows.filter(F.arrays_overlap("tokens", F.array(*(F.lit(a) for a in needed))))
    rows = settled(rows.withColumn("own", shingles(F.col("tokens"))).filter(F.size("own") > 0).select("doc_id", "row", "own"), "license-texts")
    sizes: dict[int, list[dict]] = {}
    for t in known:  # classes of lengths by powers of two
        sizes.setdefault(1 << math.ceil(math.log2(len(t["tokens"]))), []).append(t)
    found = None
    for longest, members in sorted(sizes.items()):
        step = max(2, longest // 4)
        span = longest + step - SHINGLE + 1
        starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("own")), F.lit(step))
        windows = rows.select("doc_id", "row", "own", F.explode(starts).alias("start")).select("doc_id", "row", F.expr(f"slice(own, start, {span})").alias("part"))
        values = sorted({v for t in members for v in t["values"]})
        windows = windows.withColumn("values", bands(F.col("part"))).filter(F.arrays_overlap("values", F.array(*(F.lit(v) for v in values))))
        sketch = spark.createDataFrame([(b, v, t["template"]) for t in members for b, v in enumerate(t["values"])], "band int, value long, template int")
        sets = spark.createDataFrame([(t["template"], t["license"], t["own"]) for t in members], "template int, license string, wanted array<long>")
        window = windows.select("doc_id", "row", "part", "values", F.monotonically_increasing_id().alias("window"))
        tried = window.select("doc_id", "row", "part", "window", F.posexplode("values").alias("band", "value")).join(F.broadcast(sketch), ["band", "value"])
        tried = tried.groupBy("window", "template").agg(*(F.first(c).alias(c) for c in ("doc_id", "row", "part"))).join(F.broadcast(sets), "template")
        hit = tried.withColumn("containment", F.size(F.array_intersect("wanted", "part")) / F.size("wanted")).filter(F.col("containment") >= CONTAINED)
        hit = hit.select("doc_id", "row", "license", "containment")
        found = hit if found is None else found.unionByName(hit)
    # Of several templates of a license, and several windows, the best counts.
    best = found.groupBy("row", "license").agg(F.first("doc_id").alias("doc_id"), F.max("containment").alias("containment"), F.count("*").alias("windows"))
    return best.select("doc_id", "license", "containment", "windows")
