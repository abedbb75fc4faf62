"""Licence scans: sparse TF-IDF cosine of headers and licence files to templates, then inheritance by directory.

Natively: the sentences of a text that speak of a licence are its header; a text most of whose words are such
sentences, or that is named like one, is a licence file. Terms of headers are weighted by their frequency
and by how few of the corpus's headers and templates have them; a header's cosine to each template comes from one
equality join on terms. A file without a licence of its own takes the one of the licence file in its nearest ancestor
directory, found by joining the directories above a path to the directories of licence files.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stresslens.llm.common import BLANKS, cut

#: How licences are named in headers, by SPDX identifier; a header needs no more than its notice.
TEMPLATES = (
    ("MIT", "Released under the MIT License. Permission is hereby granted, free of charge, to any person obtaining a copy of this software"),
    ("MIT", "Licensed under the MIT License"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0; you may not use this file except in compliance with the License"),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3"),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License version 3"),
    ("LGPL-3.0", "This library is licensed under the GNU Lesser General Public License, version 3"),
    ("AGPL-3.0", "This program is licensed under the GNU Affero General Public License, version 3"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("BSD-2-Clause", "Use of this source code is governed by the BSD 2-Clause License"),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style 3-Clause License"),
    ("ISC", "Licensed under the ISC License. Permission to use, copy, modify, and/or distribute this software for any purpose"),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    ("CC0-1.0", "Dedicated to the public domain under the CC0 1.0 Universal License"),
    ("Unlicense", "This is free and unencumbered software released into the public domain"),
    ("Proprietary", "All rights reserved. Proprietary and confidential. Unauthorized copying is prohibited"),
)
#: A sentence with one of these belongs to the header.
CUES = r"(?i)licen[sc]e|copyright|public domain|all rights reserved|free software|spdx-"
FILE_NAMES = r"(?i)(^|/)(un)?licen[sc]e[^/]*$|(?i)(^|/)copying[^/]*$"


def terms(text: Column) -> Column:
    return F.filter(F.split(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}.]+|\.(?![0-9])", " "), " "), lambda w: w != "")


def ancestors(path: Column) -> Column:
    """(dir, depth) of a path's directory and of all above it; the root is the empty string at depth 0."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda i: F.struct(F.array_join(F.slice(parts, 1, i), "/").alias("dir"), i.alias("depth")))


def headers(files: DataFrame) -> DataFrame:
    """id, path, header (its sentences, null without), share (of the words), for id, path, text."""
    lines = F.split(F.coalesce("text", F.lit("")), r"\n|(?<=[.!?;])\s+")
    picked = F.filter(lines, lambda x: x.rlike(CUES))
    # most texts have none: they are told by one look
    header = F.when(F.coalesce(F.col("text").rlike(CUES), F.lit(False)), F.array_join(picked, " "))
    words = F.regexp_count("text", F.lit(f"[^{BLANKS}]+"))
    share = F.when(header.isNotNull(), F.regexp_count(header, F.lit(f"[^{BLANKS}]+")) / F.greatest(words, F.lit(1)))
    return files.select("id", "path", header.alias("header"), share.alias("share"))


def scan(files: DataFrame, threshold: float = 0.5, file_share: float = 0.5) -> DataFrame:
    """id, path, license, score, kind (header, file, inherited or none), license_path for every row of files (id, path, text).

    license is the template's with the highest cosine, of equal ones the first by name; below the threshold there is
    none. A file whose header makes up file_share of its words, or whose name says so, is a licence file and speaks
    for its directory; of several in a directory the first by path does. Null and empty texts, and null paths, have
    no licence of their own; a null path inherits none. Repeated rows each come back.
    """
    spark: SparkSession = files.sparkSession
    h = cut(headers(files.select(F.col("id"), F.col("path"), F.col("text"))).withColumn("row", F.monotonically_increasing_id()))
    own = h.where("header is not null")
    templates = spark.createDataFrame([(i, n, t) for i, (n, t) in enumerate(TEMPLATES)], "template int, license string, text string")
    t_terms = templates.select("template", F.explode(terms(F.col("text"))).alias("term")).groupBy("template", "term").agg(F.count("*").alias("tf"))
    # a header is looked at once however many files have it
    texts = own.select(F.xxhash64("header").alias("k1"), F.xxhash64(F.lit(1), "header").alias("k2"), "header").groupBy("k1", "k2").agg(F.first("header").alias("header"), F.count("*").alias("files"))
    texts = cut(texts)
    d_terms = texts.select("k1", "k2", "files", F.explode(terms(F.col("header"))).alias("term")).groupBy("k1", "k2", "files", "term").agg(F.count("*").alias("tf"))
    n = texts.agg(F.coalesce(F.sum("files"), F.lit(0)).alias("n")).first().n + len(TEMPLATES)
    df = d_terms.groupBy("term").agg(F.sum("files").alias("df")).unionByName(t_terms.groupBy("term").agg(F.count("*").alias("df"))).groupBy("term").agg(F.sum("df").alias("df"))
    idf = df.select("term", (F.log((F.lit(float(n)) + 1) / (F.col("df") + 1)) + 1).alias("idf"))

    def weighted(x: DataFrame) -> DataFrame:
        return x.join(idf, "term").withColumn("w", (1 + F.log("tf")) * F.col("idf"))

    # a header's words that no template has say nothing against a template: its norm is over the templates' vocabulary
    tw = cut(weighted(t_terms).select("template", "term", "w"))
    vocabulary = tw.select("term").distinct()
    dw = weighted(d_terms.join(vocabulary, "term", "left_semi"))
    norms = dw.groupBy("k1", "k2").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    t_norms = tw.groupBy("template").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("t_norm"))
    dots = dw.select("k1", "k2", "term", F.col("w").alias("v")).join(tw, "term").groupBy("k1", "k2", "template").agg(F.sum(F.col("v") * F.col("w")).alias("dot"))
    scored = dots.join(norms, ["k1", "k2"]).join(t_norms, "template").join(templates.select("template", "license"), "template")
    scored = scored.withColumn("score", F.round(F.col("dot") / (F.col("norm") * F.col("t_norm")), 9))
    best = scored.groupBy("k1", "k2").agg(F.max("score").alias("score"), F.min_by("license", F.struct(-F.col("score"), "license")).alias("license")).where(F.col("score") >= threshold)
    found = own.withColumns({"k1": F.xxhash64("header"), "k2": F.xxhash64(F.lit(1), "header")}).join(best, ["k1", "k2"])
    named = F.coalesce(F.col("path").rlike(FILE_NAMES), F.lit(False))
    found = cut(found.select("row", "path", "license", "score", (named | (F.col("share") >= file_share)).alias("is_file")))
    parent = F.regexp_replace("path", "(^|/)[^/]*$", "")
    dirs = found.where(F.col("is_file") & F.col("path").isNotNull()).groupBy(parent.alias("dir")).agg(F.min(F.struct("path", "license", "score")).alias("of"))
    bare = h.join(found.select("row"), "row", "left_anti").where("path is not null")
    # the directories above are looked up once for each directory, not for each file
    above = bare.select(parent.alias("at")).distinct().select("at", F.explode(ancestors(F.when(F.col("at") == "", F.lit("x")).otherwise(F.concat("at", F.lit("/x"))))).alias("a"))
    nearest = above.join(dirs, F.col("a.dir") == F.col("dir")).groupBy("at").agg(F.max_by("of", "a.depth").alias("of"))
    inherited = bare.select("row", parent.alias("at")).join(nearest, "at").select("row", F.col("of.license").alias("license"), F.col("of.score").alias("score"), F.lit("inherited").alias("kind"), F.col("of.path").alias("license_path"))
    told = found.select("row", "license", "score", F.when(F.col("is_file"), "file").otherwise("header").alias("kind"), F.col("path").alias("license_path")).unionByName(inherited)
    return h.select("id", "path", "row").join(told, "row", "left").select("id", "path", "license", "score", F.coalesce("kind", F.lit("none")).alias("kind"), "license_path")
