"""License scans: MinHash bands over text windows retrieve templates, shingle containment verifies.

Everything here is DataFrame expressions. Words are runs of letters and digits in lower case, so that
punctuation and line breaks do not matter. A document that shares no shingle with any template can
contain none, so windows are laid only where a shingle of a template stands.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from velotide.llm.common import let

SHINGLE = 5
CONTAINED = 0.8
BANDS, ROWS = 20, 2  # a window with Jaccard 0.6 is retrieved with probability 1 - (1 - 0.36)^20 = 0.9999
STEP_SHARE = 8  # windows are laid every 1/8 of their length, so the best one has Jaccard (1 - 1/16) / (1 + 1/16) at least

# Short forms and notices as their licenses word them.
TEMPLATES = {
    "apache-2.0-line": "Licensed under the Apache License, Version 2.0.",
    "apache-2.0-notice": (
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in '
        "compliance with the License. You may obtain a copy of the License at "
        "http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, "
        'software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR '
        "CONDITIONS OF ANY KIND, either express or implied."
    ),
    "bsd-redistribution": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided "
        "that the following conditions are met:"
    ),
    "cc-by-4.0-line": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "cc-by-nc-4.0-line": "Licensed under CC BY-NC 4.0.",
    "gpl-3.0-line": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-3.0-notice": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU "
        "General Public License as published by the Free Software Foundation, either version 3 of the License, or "
        "(at your option) any later version."
    ),
    "isc-permission": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is "
        "hereby granted, provided that the above copyright notice and this permission notice appear in all copies."
    ),
    "mit-line": "Released under the MIT License.",
    "mit-permission": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
        'associated documentation files (the "Software"), to deal in the Software without restriction, including '
        "without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell "
        "copies of the Software, and to permit persons to whom the Software is furnished to do so"
    ),
    "mpl-2.0-notice": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL "
        "was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."
    ),
}


def _words(text: Column) -> Column:
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def _shingles(words: Column) -> Column:
    """Hashes of the windows of five words; a shorter text is one shingle, one without words none."""

    def at(i: Column) -> Column:
        return F.xxhash64(*(F.get(words, i + k) for k in range(SHINGLE)))

    n = F.size(words)
    full = F.transform(F.sequence(F.lit(0), n - SHINGLE), at)
    short = F.array(F.xxhash64(*(F.coalesce(F.get(words, F.lit(k)), F.lit("")) for k in range(SHINGLE))))
    none = F.expr("cast(array() as array<bigint>)")
    return F.when(n >= SHINGLE, full).when(n > 0, short).otherwise(none)


def _bands(shingles: Column) -> Column:
    """One hash per band: the MinHash of the band's rows, each with a hash function of its own."""
    signature = F.transform(
        F.sequence(F.lit(1), F.lit(BANDS * ROWS)), lambda j: F.array_min(F.transform(shingles, lambda s: F.xxhash64(j, s)))
    )

    def bands(values: Column) -> Column:
        rows = [[F.get(values, F.lit(b * ROWS + r)) for r in range(ROWS)] for b in range(BANDS)]
        return F.array(*(F.xxhash64(F.lit(b), *row) for b, row in enumerate(rows)))

    return let(signature, bands)


def templates(spark: SparkSession, texts: dict[str, str] = TEMPLATES) -> DataFrame:
    """``license_id``, ``shingles`` (distinct), ``n`` (shingles with repeats) of every template."""
    listed = F.array(*(F.struct(F.lit(k).alias("license_id"), F.lit(texts[k]).alias("body")) for k in sorted(texts)))
    rows = spark.range(1).select(F.inline(listed))
    found = rows.select("license_id", let(_words(F.col("body")), _shingles).alias("all"))
    return found.select("license_id", F.array_distinct("all").alias("shingles"), F.size("all").alias("n"))


def scan(docs: DataFrame, texts: dict[str, str] = TEMPLATES) -> DataFrame:
    """``doc_id``, ``license_id``, ``containment`` (share of the template's distinct shingles in the
    best window, 0.8 or more) and ``word`` (where the first such window begins) for every license text
    that a row of ``docs`` (``doc_id``, ``text``) contains.

    Null and blank texts contain none; an empty table gives an empty one. Rows that repeat an id are one
    document. Ties go to the first window. The templates are a parameter of the program, some dozens
    of short texts, and so are broadcast; nothing else is, and no text is shuffled.
    """
    spark = docs.sparkSession
    known = templates(spark, texts)
    everything = known.agg(F.array_distinct(F.flatten(F.collect_list("shingles"))).alias("any"))
    lengths = sorted({r.n for r in known.select("n").collect()})
    any_shingle = F.array(*(F.lit(h) for h in sorted(everything.first()[0])))
    hashed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), let(_words(F.col("text")), _shingles).alias("h"))
    near = hashed.where(F.arrays_overlap("h", any_shingle))
    hits = F.filter(
        F.transform("h", lambda s, i: F.when(F.array_contains(any_shingle, s), i)), lambda i: i.isNotNull()
    )
    laid = near.withColumn("hits", hits).select("doc_id", "h", "hits", F.explode(F.array(*map(F.lit, lengths))).alias("n"))
    laid = laid.withColumn("step", F.greatest(F.lit(1), F.floor(F.col("n") / STEP_SHARE)).cast("int"))

    def around_hit(i: Column) -> Column:
        """Windows begin at multiples of the step; those that hold the hit."""
        low = (F.ceil(F.greatest(F.lit(0), i - F.col("n") + 1) / F.col("step")) * F.col("step")).cast("int")
        high = (F.floor(i / F.col("step")) * F.col("step")).cast("int")
        return F.when(low <= high, F.sequence(low, high, F.col("step"))).otherwise(F.expr("cast(array() as array<int>)"))

    def window(start: Column) -> Column:
        # The verified passage is a step longer on either side, so that no offset cuts a shingle.
        around = F.slice("h", F.greatest(F.lit(1), start + 1 - F.col("step")), F.col("n") + 2 * F.col("step"))
        return F.struct(
            start.alias("start"), F.array_distinct(F.slice("h", start + 1, F.col("n"))).alias("window"), around.alias("around")
        )

    starts = F.array_distinct(F.flatten(F.transform("hits", around_hit)))
    inside = laid.select("doc_id", "n", F.explode(F.transform(starts, window)).alias("w")).select("doc_id", "n", "w.*")
    banded = inside.select("doc_id", "n", "start", "around", F.posexplode(_bands(F.col("window"))).alias("band", "key"))
    of_template = known.select("license_id", "shingles", "n", F.posexplode(_bands(F.col("shingles"))).alias("band", "key"))
    candidates = (
        banded.join(F.broadcast(of_template), ["n", "band", "key"])
        .groupBy("doc_id", "start", "license_id", "n")
        .agg(F.first("around").alias("around"), F.first("shingles").alias("shingles"))
    )
    share = F.size(F.array_intersect("shingles", "around")) / F.size("shingles")
    verified = candidates.withColumn("containment", share).where(F.col("containment") >= CONTAINED)
    best = F.max(F.struct("containment", (-F.col("start")).alias("s")))
    return verified.groupBy("doc_id", "license_id").agg(best.alias("b")).select(
        "doc_id", "license_id", F.round("b.containment", 6).alias("containment"), (-F.col("b.s")).cast("long").alias("word")
    )
