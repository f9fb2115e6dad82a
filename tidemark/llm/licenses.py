"""License scans: TF-IDF cosine to templates, and inheritance from directories.

Lines that could speak of a license are taken from whole texts. Their terms,
weighted by term frequency and inverse document frequency, are compared with
license templates through sparse products: line terms join the templates'
terms and sum up. Whole texts are compared in the same way with full license texts, and
windows of lines and sentences around such a line with license headers, under document
frequencies of all files; SPDX ids are read as they are. A file whose words are largely
such a line, or whose text is a full license text, is a licence file
and speaks for its directory; files without a license of their own inherit from
the nearest ancestor directory that has one, found by joins on paths.

Only DataFrame functions are used. The templates and their terms are constants, so
they are broadcast whatever the input.

Nulls and edges: a null text counts as empty and has no license of its own but may
inherit; a row with a null path has no directories; rows that share a path share
the best license found in any of them; ties go to the smaller license name; an empty table gives an empty result.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from importlib.resources import files

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.graph import join_dealt
from tidemark.llm.runtime import materialize

#: License names and the sentences by which files state them.
TEMPLATES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("Proprietary", "All rights reserved."),
)
#: A line is looked at if it holds one of these.
ANCHOR = r"(?i)licen[cs]|rights reserved|permission|redistribution|copyright"
TERM = r"[a-z0-9]+(?:\.[0-9]+)*"
LEAST_COSINE = 0.6
#: A licence file has at most this many words for each word of its license line.
FILE_WORDS = 8

#: Full texts, by name; the short ones also stand at the top of source files.
TEXTS = {p.name.removesuffix(".txt"): p.read_text() for p in sorted((files(__package__) / "license_texts").iterdir(), key=lambda p: p.name) if p.name.endswith(".txt")}
SHORT_TEXTS = ("BSD-2-Clause", "BSD-3-Clause", "ISC", "MIT")
_GNU = (
    "This {what} is free software; you can redistribute it and/or modify it under the terms of the GNU {name} General Public License"
    " as published by the Free Software Foundation; either version {version} of the License, or (at your option) any later version."
)
_GNU_REST = (
    " This {what} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY"
    " or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {name} General Public License for more details. You should have received a copy of the GNU"
    " {name} General Public License along with this {what}. If not, see <https://www.gnu.org/licenses/>."
)
_APACHE = (
    "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License."
    " You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"
)
_APACHE_REST = (
    " Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS,"
    " WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and"
    " limitations under the License."
)
_MPL = "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."
#: Headers in their short and long forms.
HEADERS = (
    *((f"{short}-{version}.0" if "." not in version else f"{short}-{version}", (_GNU + rest).format(what=what, name=name, version=version))
      for short, name, what, versions in (("GPL", "", "program", "123"), ("LGPL", "Lesser", "library", ("2.1", "3")), ("LGPL", "Library", "library", "2"), ("AGPL", "Affero", "program", "3"))
      for version in versions for rest in ("", _GNU_REST)),
    ("Apache-2.0", _APACHE), ("Apache-2.0", _APACHE + _APACHE_REST),
    ("MPL-2.0", _MPL), ("MPL-2.0", _MPL + " If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("Proprietary", "Copyright (c) All rights reserved."),
    *((name, TEXTS[name]) for name in SHORT_TEXTS),
)
LEAST_TEXT, LEAST_HEADER = 0.9, 0.7
SPDX = r"(?i)SPDX-License-Identifier:[ \t(]*([a-z0-9][a-z0-9.+-]*)"
#: Windows begin at most BEFORE units before a line that is looked at, and are this many units long.
UNIT = r"\n|(?<=[.;:!?])[ \t]+"
BEFORE, WIDTHS = 3, (1, 2, 3, 4, 6, 8, 11, 15, 20, 27, 36, 48)
#: Windows of so many neighbouring starts are cut by one task.
BLOCK = 64


def _terms(text: str) -> list[str]:
    return re.findall(TERM, text.lower())


def template_weights() -> tuple[dict[str, float], float, list[tuple[int, str, str, float]]]:
    """Inverse document frequencies, that of unknown terms, and the templates' unit vectors."""
    bags = [_terms(t) for _, t in TEMPLATES]
    n = len(bags)
    idf = {t: math.log((1 + n) / (1 + sum(t in b for b in bags))) + 1 for b in bags for t in b}
    rows = []
    for i, (name, _) in enumerate(TEMPLATES):
        w = {t: bags[i].count(t) * idf[t] for t in sorted(set(bags[i]))}
        norm = math.sqrt(sum(x * x for x in w.values()))
        rows += [(i, name, t, x / norm) for t, x in w.items()]
    return idf, math.log(1 + n) + 1, rows


def license_lines(files: DataFrame) -> DataFrame:
    """``path``, ``words``, ``line``, ``terms`` of lines that could state a license; ``files`` has path and text."""
    line = F.explode(F.filter(F.split("text", "\n"), lambda x: x.rlike(ANCHOR)))
    words = F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+"))
    rows = files.filter(F.col("text").rlike(ANCHOR)).select("path", words.alias("words"), line.alias("line"))
    return rows.withColumn("terms", F.regexp_extract_all(F.lower("line"), F.lit(f"({TERM})"), 1))


def detect(files: DataFrame) -> DataFrame:
    """``path``, ``license``, ``score``, ``licence_file`` of the files that state a license."""
    idf, unknown, weights = template_weights()
    spark = files.sparkSession
    terms = F.broadcast(spark.createDataFrame([(t, x) for t, x in idf.items()], "term string, idf double"))
    vectors = F.broadcast(spark.createDataFrame(weights, "template int, license string, term string, w double"))
    # Equal lines of equal files are one row: the sums below are by line, not by file.
    lines = license_lines(files).distinct()
    bag = lines.select("path", "words", "line", F.size("terms").alias("line_words"), F.explode("terms").alias("term"))
    bag = bag.groupBy("path", "words", "line", "line_words", "term").agg(F.count("*").alias("tf"))
    bag = bag.join(terms, "term", "left").withColumn("x", F.col("tf") * F.coalesce("idf", F.lit(unknown)))
    keys = ["path", "words", "line", "line_words"]
    norms = bag.groupBy(*keys).agg(F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("norm"))
    dots = bag.join(vectors, "term").groupBy(*keys, "template", "license").agg(F.sum(F.col("x") * F.col("w")).alias("dot"))
    scored = dots.join(norms, keys).withColumn("score", F.round(F.col("dot") / F.col("norm"), 6)).filter(F.col("score") >= LEAST_COSINE)
    best = F.min(F.struct((-F.col("score")).alias("s"), "license", (F.col("words") > FILE_WORDS * F.col("line_words")).alias("long")))
    found = scored.groupBy("path").agg(best.alias("b"))
    return found.select("path", F.col("b.license").alias("license"), (-F.col("b.s")).alias("score"), (~F.col("b.long")).alias("licence_file"))


def _nearest(texts: DataFrame, keys: list[str], references: tuple[tuple[str, str], ...], idf: dict[str, float], unknown: float, least: float) -> DataFrame:
    """``keys``, ``license`` and ``score`` of the nearest reference of each text, from a cosine of ``least`` on; ``texts`` has ``keys`` and ``terms``.

    References are columns of the broadcast terms, so a text's terms are neither multiplied by them nor, if ``texts``
    is dealt out by one of the keys, shuffled.
    """
    bags = [Counter(_terms(text)) for _, text in references]
    norms = [math.sqrt(sum((n * idf[t]) ** 2 for t, n in bag.items())) for bag in bags]
    rows = [(t, idf[t], *(bag[t] * idf[t] / norm for bag, norm in zip(bags, norms))) for t in sorted(set().union(*bags))]
    schema = ", ".join(["term string", "idf double", *(f"w{i} double" for i in range(len(bags)))])
    # Terms in no reference here may be in others: these too have their frequencies.
    rows += [(t, x, *[0.0] * len(bags)) for t, x in idf.items() if not any(t in bag for bag in bags)]
    known = F.broadcast(texts.sparkSession.createDataFrame(rows, schema))
    bag = texts.select(*keys, F.explode("terms").alias("term")).groupBy(*keys, "term").agg(F.count("*").alias("tf"))
    bag = bag.join(known, "term", "left").withColumn("x", F.col("tf") * F.coalesce("idf", F.lit(unknown)))
    dots = [F.sum(F.col("x") * F.coalesce(f"w{i}", F.lit(0.0))).alias(f"d{i}") for i in range(len(bags))]
    sums = bag.groupBy(*keys).agg(F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("norm"), *dots)
    scores = [F.struct((-F.round(F.col(f"d{i}") / F.col("norm"), 6)).alias("s"), F.lit(name).alias("license")) for i, (name, _) in enumerate(references)]
    best = sums.select(*keys, F.array_min(F.array(*scores)).alias("b")).filter(-F.col("b.s") >= least)
    return best.select(*keys, F.col("b.license").alias("license"), (-F.col("b.s")).alias("score"))


def _term_array(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(f"({TERM})"), 1)


def document_weights(files: DataFrame) -> tuple[dict[str, float], float]:
    """Inverse document frequencies over all ``files`` of the terms of full texts and headers, and that of a term in none."""
    spark = files.sparkSession
    terms = sorted({t for text in (*TEXTS.values(), *(h for _, h in HEADERS)) for t in _terms(text)})
    asked = F.broadcast(spark.createDataFrame([(t,) for t in terms], "term string"))
    held = files.select(F.explode(F.array_distinct(_term_array(F.col("text")))).alias("term")).join(asked, "term")
    counts = {r["term"]: r["n"] for r in held.groupBy("term").agg(F.count("*").alias("n")).collect()}  # at most the terms asked for
    n = files.count()
    return {t: math.log((1 + n) / (1 + counts.get(t, 0))) + 1 for t in terms}, math.log(1 + n) + 1


def _header_windows(rows: DataFrame) -> DataFrame:
    """``digest``, ``block``, ``start``, ``width``, ``terms`` of windows of lines and sentences around lines that are looked at.

    A text is cut into blocks of ``BLOCK`` starts, each with the units that its windows reach, and blocks are dealt out: the work is linear
    in a text and does not meet in one task.
    """
    units = F.filter(F.split("text", UNIT), lambda x: x.rlike("[A-Za-z0-9]"))
    cut = rows.select("digest", units.alias("units")).filter(F.size("units") > 0)
    ids = F.sequence(F.lit(0), F.floor((F.size("units") - 1) / BLOCK).cast("int"))
    blocks = F.transform(ids, lambda b: F.struct(b.alias("block"), F.slice("units", b * BLOCK + 1, BLOCK + max(WIDTHS)).alias("near")))
    dealt = cut.select("digest", F.size("units").alias("n"), F.explode(blocks).alias("b")).select("digest", "n", "b.*")
    dealt = dealt.filter(F.exists(F.slice("near", 1, BLOCK + BEFORE), lambda x: x.rlike(ANCHOR)))
    dealt = dealt.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), "digest", "block")
    at = F.filter(F.transform(F.slice("near", 1, BLOCK + BEFORE), lambda x, i: F.when(x.rlike(ANCHOR), i)), lambda i: i.isNotNull())
    starts = F.array_distinct(F.flatten(F.transform(at, lambda i: F.sequence(F.greatest(i - BEFORE, F.lit(0)), i))))
    at_start = F.explode(F.filter(starts, lambda i: i < BLOCK)).alias("i")
    cut = dealt.select("digest", "block", "n", "near", at_start).withColumn("start", F.col("block") * BLOCK + F.col("i"))
    cut = cut.withColumn("width", F.explode(F.lit(list(WIDTHS)))).filter("width = 1 OR start + width <= n OR start + width - n < width / 3")
    return cut.select("digest", "block", "start", "width", _term_array(F.array_join(F.slice("near", F.col("i") + 1, F.col("width")), " ")).alias("terms"))


def detect_texts(files: DataFrame) -> DataFrame:
    """``path``, ``license``, ``score``, ``licence_file`` by full texts, SPDX ids and headers, in this order; a reserved right counts last."""
    rows = files.filter(F.col("text").rlike(ANCHOR) & F.col("path").isNotNull()).select("path", "text", F.sha2("text", 256).alias("digest"))
    # Equal texts are compared once; what follows is by digest and needs no other shuffle.
    texts = materialize(rows.select("digest", "text").dropDuplicates(["digest"]), "license_candidates")
    texts = texts.repartition(int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions")), "digest")
    idf, unknown = document_weights(files)
    full = _nearest(texts.select("digest", _term_array(F.col("text")).alias("terms")), ["digest"], tuple(TEXTS.items()), idf, unknown, LEAST_TEXT)
    full = materialize(full, "license_files")
    rest = texts.join(full, "digest", "left_anti")
    spdx = rest.select("digest", F.regexp_extract("text", SPDX, 1).alias("license")).filter("license <> ''")
    spdx = spdx.withColumn("license", F.regexp_replace("license", r"(?i)-only$|-or-later$|\+$", "")).withColumn("score", F.lit(1.0))
    headers = _nearest(_header_windows(rest), ["digest", "block", "start", "width"], HEADERS, idf, unknown, LEAST_HEADER)
    kinds = ((0, full), (1, spdx), (2, headers))
    found = None
    for kind, df in kinds:
        df = df.select("digest", F.when(F.col("license") == "Proprietary", 3).otherwise(kind).alias("kind"), "license", "score")
        found = df if found is None else found.unionByName(df)
    best = F.min(F.struct("kind", (-F.col("score")).alias("s"), "license"))
    told = materialize(found.groupBy("digest").agg(best.alias("b")), "license_texts")
    found = rows.select("path", "digest").join(told, "digest").groupBy("path").agg(F.min("b").alias("b"))
    return found.select("path", F.col("b.license").alias("license"), (-F.col("b.s")).alias("score"), F.col("b.kind").alias("kind"))


def detect_all(files: DataFrame) -> DataFrame:
    """Licenses of files by their texts, ids and headers, and by their lines.

    A full text or an id decides. Else the better of header and line does, a reserved right only if nothing else is stated.
    """
    told = detect_texts(files).select("path", F.struct("kind", "license", "score").alias("t"))
    both = detect(files).select("path", F.struct("license", "score", "licence_file").alias("l")).join(told, "path", "full")
    decided = F.col("t.kind") <= 1
    named = (F.col("t.kind") == 2) & ((F.col("l.license") == "Proprietary") | (F.col("t.score") > F.col("l.score")))
    last = (F.col("t.kind") == 3) & (F.col("l.license") == "Proprietary") & (F.col("t.score") > F.col("l.score"))
    by_text = F.coalesce(F.col("l").isNull() | decided | named | last, F.lit(False))
    pick = lambda name: F.when(by_text, F.col(f"t.{name}")).otherwise(F.col(f"l.{name}")).alias(name)
    file = F.coalesce(F.col("t.kind") == 0, F.lit(False)) | F.coalesce("l.licence_file", F.lit(False))
    return both.select("path", pick("license"), pick("score"), file.alias("licence_file"))


def _parent(path: Column) -> Column:
    return F.regexp_replace(path, r"/?[^/]*$", "")


def inherit(paths: DataFrame, found: DataFrame) -> DataFrame:
    """``dir``, ``from_dir``, ``license`` for directories of ``paths`` below or at one with a licence file.

    Works on distinct directories; each looks up its ancestors, nearest first, up to the root (an empty name), which holds relative
    paths without a directory.
    """
    speaking = found.filter("licence_file").withColumn("from_dir", _parent(F.col("path")))
    choice = F.min(F.struct((-F.col("score")).alias("s"), "license", "path"))
    speaking = speaking.groupBy("from_dir").agg(choice.alias("b")).select("from_dir", F.col("b.license").alias("dir_license"))
    dirs = paths.filter("path IS NOT NULL").select(_parent(F.col("path")).alias("dir")).distinct()
    parts = F.split("dir", "/")
    up = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))
    climbs = dirs.select("dir", F.posexplode(F.array_distinct(F.concat(F.array(F.lit("")), up))).alias("depth", "from_dir"))
    near = climbs.join(speaking, "from_dir").groupBy("dir").agg(F.max(F.struct("depth", "from_dir", "dir_license")).alias("b"))
    return near.select("dir", F.col("b.from_dir").alias("from_dir"), F.col("b.dir_license").alias("dir_license"))


def scan(files: DataFrame) -> DataFrame:
    """The rows of ``files`` (any columns, with ``path`` and ``text``) less the text, with own and effective licenses."""
    found = materialize(detect_all(files.select("path", F.col("text").cast("string").alias("text"))), "licenses")
    rows = files.drop("text", "license", "score", "licence_file", "from_dir", "dir_license", "effective", "origin", "dir")
    rows = rows.withColumn("dir", _parent(F.col("path")))
    # Very many files may share a path or a directory: their rows are dealt out.
    paths = files.select("path", _parent(F.col("path")).alias("dir"))
    total, keyed = paths.count(), paths.filter("path IS NOT NULL")
    own = join_dealt(rows.withColumn("__key", F.xxhash64(*[c for c, kind in rows.dtypes if "map" not in kind])), found, "path", "__key", total, keyed, "left")
    out = join_dealt(own, inherit(paths, found), "dir", "__key", total, keyed, "left").drop("__key")
    origin = F.when(F.col("license").isNotNull(), "own").when(F.col("dir_license").isNotNull(), "inherited").otherwise("none")
    inherited = F.when(F.col("license").isNull(), F.col("from_dir"))
    return out.select(
        *rows.columns[:-1], "license", "score", F.coalesce("licence_file", F.lit(False)).alias("licence_file"),
        F.coalesce("license", "dir_license").alias("effective"), origin.alias("origin"), inherited.alias("from_dir"),
    )
