"""License notices in texts: MinHash bands of overlapping text windows retrieve templates, shingle containment decides.

A template of s shingles meets windows of 2 s shingles, s apart at most, so that a notice lies whole in one of them. With
the share of its shingles that must be there, c = 0.8, window and template have a Jaccard similarity of c / (3 - c) = 0.36 or
more, and BANDS bands of one row collide with probability 1 - (1 - 0.36) ** BANDS > 0.999999. DataFrame operations only.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tamis.session import written

WORDS, CONTAINMENT, BANDS = 5, 0.8, 32

#: Notices by license (fixed values: the licenses' own words).
TEMPLATES = (
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    # The part of the GPL's notice that tells its version, and it from its kin: either change leaves under 0.8 of it.
    ("GPL-3.0", "the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License"),
    ("GPL-2.0", "the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License"),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    # Parts that tell these from the GPL, whose notice has the same words around them.
    ("LGPL", "the GNU Lesser General Public License as published"),
    ("AGPL-3.0", "the GNU Affero General Public License as published"),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("EPL-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at"),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("Zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software."),
)


#: ASCII punctuation, and what stands between two words: white space with the punctuation around it.
MARKS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
_MARK = r"[!-/:-@\[-`{-~]"
_BETWEEN = rf"(?<!{_MARK}){_MARK}*+[\x20\x09-\x0D][\x09-\x0D\x20-/:-@\[-`{{-~]*+"


def words_of(text: Column) -> Column:
    """The words of a text, A-Z in lower case, split at ASCII white space, without ASCII punctuation at their edges.

    So marks after a notice, quotes, and the signs that begin comment lines do not hide it.
    """
    lower = F.translate(F.coalesce(text, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    bare = F.btrim(lower, F.lit(MARKS + " \t\n\x0b\f\r"))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, _BETWEEN))


def shingle_hashes(words: Column, size: int = WORDS) -> Column:
    """A hash of every run of ``size`` words; none for a shorter text.

    The words are bound to a variable: an expression inside a lambda would be evaluated anew for each of its elements.
    """
    def hashed(bound: Column) -> Column:
        return F.when(
            F.size(bound) >= size, F.transform(F.sequence(F.lit(1), F.size(bound) - size + 1), lambda i: F.xxhash64(F.slice(bound, i, size)))
        ).otherwise(F.array().cast("array<bigint>"))

    return F.transform(F.array(words), hashed)[0]


def _least(hashes: Column, bands: int) -> Column:
    """For each band, the least value of any shingle under the band's permutation, and the shingle that has it."""
    return F.transform(
        F.sequence(F.lit(0), F.lit(bands - 1)),
        lambda band: F.array_min(F.transform(hashes, lambda h: F.struct(F.xxhash64(h, band).alias("value"), h.alias("shingle")))),
    )


def template_table(spark: SparkSession, templates=TEMPLATES, bands: int = BANDS) -> DataFrame:
    """license, template (its number), shingles (distinct hashes), least (the key of each band and its shingle)."""
    rows = spark.createDataFrame([(name, at, text) for at, (name, text) in enumerate(templates)], "license string, template int, text string")
    hashed = rows.select("license", "template", F.array_distinct(shingle_hashes(words_of(F.col("text")))).alias("shingles")).where(F.size("shingles") > 0)
    return written(written(hashed, "templates").withColumn("least", _least(F.col("shingles"), bands)), "template-keys")


def scan(
    docs: DataFrame, *, id_column: str = "doc_id", text_column: str = "text", templates=TEMPLATES,
    containment: float = CONTAINMENT, bands: int = BANDS,
) -> DataFrame:
    """The licenses of every document: doc_id, licenses (sorted), n_licenses, containment (the largest share of a template).

    A document has a license if one of its windows of 2 s shingles, placed every s shingles, holds at least ``containment`` of
    the s distinct shingles of one of the license's templates, and shares a band key with it. A band key of a window is one
    of its shingles, so only texts that hold a shingle that is least in a band of some template can collide: the others are
    passed over before windows are formed, without loss.

    Missing and blank texts and texts of fewer than WORDS words have no license; a template of fewer words is an error; long
    texts are read whole; rows repeated give equal rows; an empty table gives no rows; other columns are ignored.
    """
    spark = docs.sparkSession
    table = template_table(spark, templates, bands)
    known = table.collect()  # the parameter, hashed
    if len(known) < len(templates):
        raise ValueError(f"a template has fewer than {WORDS} words")
    sketch = F.array(*map(F.lit, sorted({least["shingle"] for row in known for least in row["least"]})))
    keyed = docs.select(
        F.col(id_column).alias("doc_id"), F.xxhash64(F.col(id_column).cast("string"), F.col(text_column)).alias("row"), F.col(text_column).alias("text")
    )
    hashed = keyed.select("row", shingle_hashes(words_of(F.col("text"))).alias("hashes"))
    # Written, so that hashes are not computed anew for each window cut from them; a few documents in a hundred are left.
    may = written(hashed.where(F.arrays_overlap("hashes", sketch)), "license-texts")
    sizes = F.explode(F.array(*map(F.lit, sorted({len(row["shingles"]) for row in known}))))
    windows = written(
        may.select("row", "hashes", sizes.alias("size"))
        .select("row", "hashes", "size", F.explode(F.sequence(F.lit(1), F.size("hashes"), F.col("size"))).alias("at"))
        .select("row", "size", F.slice("hashes", F.col("at"), 2 * F.col("size")).alias("window"))
        .where(F.arrays_overlap("window", sketch)).distinct(), "license-windows",
    )
    signed = windows.select("row", "size", "window", F.posexplode(_least(F.col("window"), bands)).alias("band", "least")).select(
        "row", "size", "window", "band", F.col("least.value").alias("band_key")
    )
    # The templates are a parameter of a few kilobytes: their band keys are a small side of this join.
    index = table.select("license", F.size("shingles").alias("size"), "shingles", F.posexplode("least").alias("band", "least")).select(
        "license", "size", "shingles", "band", F.col("least.value").alias("band_key")
    )
    retrieved = signed.join(F.broadcast(index), ["size", "band", "band_key"])
    shared = F.size(F.array_intersect("window", "shingles")) / F.col("size")
    verified = retrieved.select("row", "license", shared.alias("share")).where(F.col("share") >= containment)
    per_row = written(verified.groupBy("row").agg(F.array_sort(F.collect_set("license")).alias("licenses"), F.max("share").alias("share")), "licenses")
    return keyed.select("doc_id", "row").join(per_row, "row", "left").select(
        "doc_id", F.coalesce("licenses", F.array().cast("array<string>")).alias("licenses"),
        F.coalesce(F.size("licenses"), F.lit(0)).alias("n_licenses"), F.coalesce("share", F.lit(0.0)).alias("containment"),
    )


def collision_probability(containment: float = CONTAINMENT, bands: int = BANDS) -> float:
    """Least probability that a window with so large a share of a template is retrieved."""
    return 1 - math.pow(1 - containment / (3 - containment), bands)
