"""License scans: sparse TF-IDF cosine to templates, then inheritance from the nearest ancestor directory.

Every whole text is cut into passages of three forms: lines; paragraphs (lines up to a blank one, comment marks off, joined), so
that headers and licence texts count as they are wrapped; and sentences of paragraphs. Those with a licensing word are compared
with the templates, which are notices, and paragraphs of licence texts. A passage is a sparse vector of term counts times inverse
document frequency, where the frequencies come from all these passages of the corpus; a term of no template weighs as one that no
passage holds, so the only table that is broadcast is the templates' own vocabulary, fixed by this file. The best template of a
text at ``min_cosine`` or more is its own license. A licence file (by its name, or because licence passages of one form make up
half of its text) also licenses its directory: files without a license of their own take that of the nearest ancestor directory
that has one, found by joining each distinct directory's ancestors to the licensed directories.

All built-in functions. Defined results: a null or empty text has no license of its own; a null path has no directory
and inherits nothing; ties between templates go to the smaller name, between licence files of a directory to the higher
cosine, then the smaller name; repeated rows are rows of their own; an empty table gives an empty result; other columns
are ignored."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import table, written

#: License names with the words of their notices and texts.
TEMPLATES = (
    ("AGPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License, version 3."),
    ("AGPL-3.0", "Licensed under the GNU Affero General Public License, version 3."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "you may not use this file except in compliance with the License."),
    ("BSD-2-Clause", "Licensed under the BSD 2-Clause License."),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC0-1.0", "This work is dedicated to the public domain under CC0 1.0."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License, version 3."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted."),
    ("LGPL-3.0", "Licensed under the GNU Lesser General Public License, version 3."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("Proprietary", "All rights reserved."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("AGPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("Apache-2.0", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("BSD-3-Clause", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("LGPL-3.0", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 3 of the License, or (at your option) any later version."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("Unlicense", "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means, as released into the public domain."),
)
TRIGGER = r"(?i)licen[cs]|copyright|\bspdx|hereby granted|redistribution and use|public domain|rights reserved|creative commons|neither the name of|free software"
#: Marks of comments at the beginnings of lines, and what ends a paragraph.
MARKS, PARAGRAPH = r"[ \t]*(?:#+|//+|/?\*+/?|;+|--+|>+)?[ \t]*", r"\n(?:[ \t]*(?:#+|//+|/?\*+/?|;+|--+|>+)?[ \t]*\n)+"
SENTENCE = r"(?<=[.!?])[ \t]+"
FILE_NAME = r"(?i)(^|/)(un)?(licen[cs]e|copying|notice)[^/]*$"


def terms(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda t: t != "")


def _vectors(pieces: DataFrame, key: list[str], idf: DataFrame, rare: Column) -> DataFrame:
    """key, term, w (weight), of passages given as arrays of terms."""
    tf = pieces.select(*key, F.explode("terms").alias("term")).groupBy(*key, "term").agg(F.count(F.lit(1)).alias("tf"))
    return tf.join(F.broadcast(idf), "term", "left").withColumn("w", F.col("tf") * F.coalesce("idf", rare))


def own_licenses(docs: DataFrame, id_col: str, text_col: str, min_cosine: float) -> DataFrame:
    """row, license, cosine, share (of the text in licence passages) for rows that have a license."""
    spark = docs.sparkSession
    templates = spark.createDataFrame([(i, n, t) for i, (n, t) in enumerate(TEMPLATES)], "template int, license string, text string")
    flagged = docs.filter(F.col(text_col).rlike(TRIGGER)).select(F.col(id_col).alias("id"), F.xxhash64(id_col, text_col).alias("row"), F.col(text_col).alias("text"))
    paragraphs = F.filter(F.split("text", PARAGRAPH), lambda p: p.rlike(TRIGGER))
    joined = F.transform(paragraphs, lambda p: F.regexp_replace(F.regexp_replace(p, "^" + MARKS, ""), r"\n" + MARKS, " "))
    forms = (F.flatten(F.transform(paragraphs, lambda p: F.split(p, "\n"))), joined, F.flatten(F.transform(joined, lambda p: F.split(p, SENTENCE))))
    tagged = lambda i, c: F.transform(F.filter(c, lambda p: p.rlike(TRIGGER)), lambda p: F.struct(F.lit(i).alias("form"), p.alias("passage")))
    pieces = flagged.select("row", F.length("text").alias("chars"), F.posexplode(F.concat(*[tagged(i, c) for i, c in enumerate(forms)])).alias("piece", "p")).select("row", "chars", "piece", "p.*")
    pieces = written(pieces.select("row", "piece", "form", "chars", F.length("passage").alias("n"), terms(F.col("passage")).alias("terms")).dropDuplicates(["row", "piece"]), "passages")
    known = templates.select("template", F.explode(F.array_distinct(terms(F.col("text")))).alias("term"))
    vocabulary = known.select("term").distinct()
    n = pieces.count()
    seen = pieces.select(F.explode(F.array_distinct("terms")).alias("term")).join(F.broadcast(vocabulary), "term", "left_semi").groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    weight = lambda df: F.log((1.0 + n) / (1.0 + df)) + 1.0
    idf = written(vocabulary.join(seen, "term", "left").select("term", weight(F.coalesce("df", F.lit(0))).alias("idf")), "idf")
    rare = weight(F.lit(0))
    of_templates = _vectors(templates.select("template", terms(F.col("text")).alias("terms")), ["template"], idf, rare).select("template", "term", F.col("w").alias("tw"))
    sizes = of_templates.groupBy("template").agg(F.sqrt(F.sum(F.col("tw") * F.col("tw"))).alias("tnorm"))
    of_pieces = written(_vectors(pieces, ["row", "piece"], idf, rare).select("row", "piece", "term", "w"), "vectors")
    norms = of_pieces.groupBy("row", "piece").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    dots = of_pieces.join(F.broadcast(of_templates), "term").groupBy("row", "piece", "template").agg(F.sum(F.col("w") * F.col("tw")).alias("dot"))
    scored = dots.join(norms, ["row", "piece"]).join(F.broadcast(sizes), "template").join(F.broadcast(templates.drop("text")), "template")
    scored = scored.withColumn("cosine", F.round(F.col("dot") / (F.col("norm") * F.col("tnorm")), 9)).filter(F.col("cosine") >= min_cosine)
    best = scored.groupBy("row", "piece").agg(F.max("cosine").alias("cosine"), F.min(F.struct(-F.col("cosine"), "license")).alias("b"))
    best = best.join(pieces.select("row", "piece", "form", "n", "chars"), ["row", "piece"])
    each = best.groupBy("row", "form").agg(F.min(F.struct(-F.col("cosine"), F.col("b.license").alias("license"))).alias("b"), (F.sum("n") / F.max("chars")).alias("share"))
    return each.groupBy("row").agg(F.min("b").alias("b"), F.max("share").alias("share")).select("row", F.col("b.license").alias("license"), (-F.col("b.col1")).alias("cosine"), "share")


def folder(path: Column) -> Column:
    """Directory of a path; '' at the top."""
    return F.regexp_replace(path, r"/?[^/]*$", "")


def scan(docs: DataFrame, path: Column, id_col: str = "doc_id", text_col: str = "text", min_cosine: float = 0.75) -> DataFrame:
    """id, path, license, cosine (of an own license), licensed_by: 'text', a directory ('.' is the top one), or null."""
    found = written(own_licenses(docs, id_col, text_col, min_cosine), "licenses")
    files = docs.select(F.col(id_col).alias("id"), F.xxhash64(id_col, text_col).alias("row"), path.alias("path"))
    rows = written(files.join(found.dropDuplicates(["row"]), "row", "left"), "licensed")
    rows_dir = rows.withColumn("dir", folder(F.col("path")))
    grants = rows_dir.filter(F.col("license").isNotNull() & F.col("path").isNotNull() & (F.col("path").rlike(FILE_NAME) | (F.col("share") >= 0.5)))
    granted = written(grants.groupBy("dir").agg(F.min(F.struct(-F.col("cosine"), "license")).alias("g")).select(F.col("dir").alias("from_dir"), F.col("g.license").alias("from_license")), "granted")
    dirs = rows_dir.filter("path is not null").select("dir").distinct()
    parts = F.split("dir", "/")
    ancestors = F.when(F.col("dir") == "", F.array(F.lit(""))).otherwise(F.concat(
        F.array(F.lit("")), F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, F.lit(1), k), "/"))))
    up = dirs.select("dir", F.explode(ancestors).alias("from_dir")).join(granted, "from_dir")
    nearest = written(up.groupBy("dir").agg(F.max(F.struct(F.length("from_dir").alias("l"), "from_dir", "from_license")).alias("n")).select("dir", "n.from_dir", "n.from_license"), "nearest")
    salts = 32
    salted = nearest.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    out = rows_dir.withColumn("salt", F.pmod(F.xxhash64("row"), F.lit(salts)).cast("int")).join(salted, ["dir", "salt"], "left")
    by = F.when(F.col("license").isNotNull(), F.lit("text")).when(F.col("from_dir") == "", F.lit(".")).otherwise(F.col("from_dir"))
    return out.select(F.col("id").alias(id_col), "path", F.coalesce("license", "from_license").alias("license"), "cosine", by.alias("licensed_by"))


def query(spark, sf_dir: str) -> DataFrame:
    """Documents as files: source, language and id make their paths."""
    path = F.concat_ws("/", "source", "lang", F.concat(F.col("doc_id").cast("string"), F.lit(".txt")))
    return scan(table(spark, sf_dir, "documents"), path)
