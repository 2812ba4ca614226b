"""Licence scan: sparse TF-IDF cosine of headers and licence files to templates, then inheritance along paths.

DataFrame functions only. In order of precedence a text's own licence is

0. the first known identifier of its SPDX lines, word for word;
1. if the file is a licence file by name (``LICENSE``, ``COPYING``, ...), the whole licence text (``licence_texts``) nearest to the whole file,
   at a cosine of ``LEAST_WHOLE`` or more;
2. the notice or permission text (``TEMPLATES``) nearest to any of its segments, at ``least`` or more: its lines, its runs of up to ``RUN`` pieces
   (sentences, cut at line breaks too) that begin with one that has a telling term, the part of each run from its first to its last telling
   term, and licence files as a whole;
3. a reservation of all rights (``RIGHTS``), which counts only where nothing else is named.

Terms are runs of a-z and 0-9 of the lower-cased text; telling terms are the templates' terms but for ``STOP``. A term of the templates weighs
``tf * (ln((1 + n) / (1 + df)) + 1)``, a term that no template has weighs as one with df 0 and only lengthens its segment. A segment must share two
terms with a template; it is joined to templates through shared terms, never by pairing all with all. A version is named only if the segment has
its number. Scores are rounded to 4 places, ties go by name.

Files without a licence of their own take that of the nearest directory above them that holds a licence file with a licence.
Each distinct directory is looked up once along its ancestors by an equi-join on the path.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from civicspark.session import materialise

# The usual short notices of common licences, and the sentences by which permission texts are known.
TEMPLATES = [
    ("AGPL-3.0", "This program is licensed under the GNU Affero General Public License, version 3."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license. Redistribution and use in source and binary forms are permitted."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("BSD-3-Clause", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("ISC", "Permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby granted"),
    ("LGPL-3.0", "This library is licensed under the GNU Lesser General Public License, version 3."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
]
# Identifiers of the SPDX list, without the endings -only, -or-later and +.
SPDX_IDS = ["0BSD", "AFL-3.0", "AGPL-3.0", "Apache-1.1", "Apache-2.0", "Artistic-2.0", "BSD-2-Clause", "BSD-3-Clause", "BSL-1.0", "CC-BY-4.0", "CC-BY-NC-4.0", "CC-BY-SA-4.0", "CC0-1.0",
            "EPL-1.0", "EPL-2.0", "EUPL-1.2", "GPL-1.0", "GPL-2.0", "GPL-3.0", "ISC", "LGPL-2.0", "LGPL-2.1", "LGPL-3.0", "MIT", "MIT-0", "MPL-1.1", "MPL-2.0", "MS-PL", "NCSA", "OFL-1.1",
            "PostgreSQL", "Unlicense", "UPL-1.0", "WTFPL", "Zlib"]
SPDX = r"(?i)spdx-license-identifier:[ \t(]*([a-z0-9.+-]+)"
RIGHTS = r"(?i)all[ \t]+rights[ \t]+reserved"
PROPRIETARY = "Proprietary"
STOP = frozenset("0 2 3 4 a and any are be by code copy following for form forms free from general in is its may met modify name names neither nor of or permitted person products provided public "
                 "purpose source style subject terms that "
                 "the this to under use used v version with without work".split())
PIECE_ENDS = r"[.!?;][ \t]+|[\r\n]+"
RUN = 5
LEAST_WHOLE = 0.9  # whole texts share so many ordinary words that less says nothing
SALTS = 16  # one text may be that of a third of all files
LICENCE_FILE = r"(?i)^(licen[cs]e|copying|notice|copyright)([.-][^/]*)?$"
TERM = "[a-z0-9]+"
VERSION = r"-([0-9]+)[.0-9]*$"


def whole_texts() -> list[tuple[str, str]]:
    """Licence and text of the whole licence texts beside this module."""
    return [(p.stem, p.read_text(encoding="utf-8")) for p in sorted((Path(__file__).parent / "licence_texts").glob("*.txt"))]


def terms(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(TERM), 0)


def template_weights(spark: SparkSession, templates: list[tuple[str, str]]) -> DataFrame:
    """term, template (number), licence, share: each template's TF-IDF vector of length one; and idf of the term."""
    n = len(templates)
    rows = [F.struct(F.lit(i).alias("template"), F.lit(name).alias("licence"), F.lit(text).alias("words")) for i, (name, text) in enumerate(templates)]
    rows = spark.range(1).select(F.inline(F.array(*rows)))
    counted = rows.select("template", "licence", F.explode(terms(F.col("words"))).alias("term")).groupBy("template", "licence", "term").agg(F.count("*").alias("tf"))
    idf = counted.groupBy("term").agg((F.log(F.lit(1.0 + n) / (1 + F.count("*"))) + 1).alias("idf"))
    weighed = counted.join(idf, "term").withColumn("w", F.col("tf") * F.col("idf"))
    norms = weighed.groupBy("template").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    return weighed.join(norms, "template").select("term", "template", "licence", "idf", (F.col("w") / F.col("norm")).alias("share"))


def own_licences(segments: DataFrame, templates: list[tuple[str, str]] = TEMPLATES, least: float = 0.5) -> DataFrame:
    """Best licence of each key: ``segments`` has key and segment (several per key); returns key, licence, score.

    Two terms at least must be shared. A licence whose version number the segment lacks is named without it.
    Each distinct segment is compared once, however many texts have it. The templates are a fixed list, so broadcasting them is bounded.
    """
    spark = segments.sparkSession
    weights = template_weights(spark, templates)
    idf = weights.select("term", "idf").distinct()
    unseen = F.log(F.lit(1.0 + len(templates))) + 1
    part = F.struct(F.xxhash64("segment").alias("h"), F.length("segment").alias("n"))  # stands for the segment in what follows
    named = segments.select("key", part.alias("part"), "segment")
    counted = (named.select("part", "segment").dropDuplicates(["part"]).select("part", F.explode(terms(F.col("segment"))).alias("term"))
               .groupBy("part", "term").agg(F.count("*").alias("tf")))
    counted = counted.join(F.broadcast(idf), "term", "left").withColumn("w", F.col("tf") * F.coalesce("idf", unseen)).drop("idf")
    norms = counted.groupBy("part").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    dots = (counted.join(F.broadcast(weights.select("term", "template", "licence", "share")), "term")
            .groupBy("part", "template", "licence").agg(F.sum(F.col("w") * F.col("share")).alias("dot"), F.count("*").alias("n"),
                                                        F.max(F.col("term") == F.regexp_extract("licence", VERSION, 1)).alias("version")))
    dots = dots.filter(F.col("n") > 1).withColumn("licence", F.when(F.col("version"), F.col("licence")).otherwise(F.regexp_replace("licence", VERSION, "")))
    scored = dots.join(norms, "part").withColumn("score", F.round(F.col("dot") / F.col("norm"), 4)).filter(F.col("score") >= least)
    of_part = scored.groupBy("part").agg(F.min(F.struct((-F.col("score")).alias("s"), F.col("licence").alias("licence"))).alias("hit"))
    best = named.select("key", "part").distinct().join(of_part, "part").groupBy("key").agg(F.min("hit").alias("best"))
    return best.select("key", F.col("best.licence").alias("licence"), (-F.col("best.s")).alias("score"))


def telling_terms(templates: list[tuple[str, str]]) -> list[str]:
    """The templates' terms that are no stop words."""
    return sorted({t for _, words in templates for t in re.findall(TERM, words.lower())} - STOP)


def telling(templates: list[tuple[str, str]]) -> str:
    """A pattern, for lower-cased text, of a telling term; of all from the first to the last one as its group."""
    strong = "|".join(telling_terms(templates))
    return f"(?s)(?:^|[^a-z0-9])((?:{strong})(?:[^a-z0-9](?:.*[^a-z0-9])?(?:{strong}))?)(?:$|[^a-z0-9])"


def likely(templates: list[tuple[str, str]], least: float) -> Callable[[Column], Column]:
    """A cheap test that every segment with a telling term passes which reaches ``least``.

    By Cauchy's inequality it shares terms that hold ``least ** 2`` of a template's squared weight: so many of them as it takes
    to hold that much, and two at least (see ``own_licences``). A segment passes if a part of it does.
    """
    counts = [Counter(re.findall(TERM, words.lower())) for _, words in templates]
    df = Counter(t for c in counts for t in c)
    enough = set()
    for c in counts:
        mass = sorted(((k * (math.log((1 + len(counts)) / (1 + df[t])) + 1)) ** 2 for t, k in c.items()), reverse=True)
        need, k = (least ** 2 - 1e-3) * sum(mass), 0  # scores are rounded
        while need > 0:
            need, k = need - mass[k], k + 1
        enough.add((max(2, k), tuple(sorted(c))))
    strong = F.array(*map(F.lit, telling_terms(templates)))

    def shares(words: Column) -> Column:
        out = F.lit(False)
        for k, of in sorted(enough):
            out = out | (F.size(F.array_intersect(words, F.array(*map(F.lit, of)))) >= k)
        return F.arrays_overlap(words, strong) & out

    return lambda segment: F.exists(F.array(terms(segment)), shares)


def spdx_licence(text: Column) -> Column:
    """The first known identifier among a text's SPDX lines, NULL if there is none."""
    plain = F.transform(F.regexp_extract_all(text, F.lit(SPDX), 1), lambda x: F.regexp_replace(F.lower(x), r"(-only|-or-later|\+)$", ""))
    names = F.create_map(*[F.lit(x) for i in SPDX_IDS for x in (i.lower(), i)])
    return F.get(F.filter(F.transform(plain, lambda x: F.try_element_at(names, x)), lambda x: x.isNotNull()), F.lit(0))


def parent(path: Column) -> Column:
    """The directory of a path: what precedes the last slash, the empty text for the root."""
    return F.regexp_replace(path, "/?[^/]*$", "")


def scan(files: DataFrame, templates: list[tuple[str, str]] = TEMPLATES, least: float = 0.5) -> DataFrame:
    """file_id, path, licence, score, origin and from_dir of every row of ``files`` (file_id, path, text; others are ignored).

    origin: ``own``, ``inherited`` (then from_dir is the directory and score that of its licence file) or ``none`` (licence and
    score NULL). NULL or empty texts have no licence of their own. Files with a NULL path inherit nothing. Repeated rows give
    a row each; of several licence files of a directory the best counts (ties by name). Very long lines are compared whole. An identifier and a
    reservation of rights score 1.
    """
    text = F.col("text").cast("string")
    files = files.select("file_id", F.col("path").cast("string").alias("path"), text.alias("text"))
    whole = F.coalesce(F.regexp_extract("path", "[^/]*$", 0).rlike(LICENCE_FILE), F.lit(False))
    key = F.struct(F.xxhash64("text").alias("h"), F.length("text").alias("n"))
    pattern, test, lower = telling(templates), likely(templates, least), F.lower("text")
    may = F.coalesce(lower.rlike(pattern), F.lit(False))
    marked = files.select("file_id", "path", whole.alias("whole"), spdx_licence(F.col("text")).alias("spdx"), F.coalesce(F.col("text").rlike(RIGHTS), F.lit(False)).alias("rights"),
                          F.when(may | whole, key).alias("key"), F.when(whole, F.col("text")).alias("body"),
                          F.when(may, F.split(lower, "[\r\n]+")).alias("lines"), F.when(may, F.split(lower, PIECE_ENDS)).alias("pieces"))
    run = lambda i, k: F.array_join(F.slice("pieces", i, k), " ")
    starts = F.filter(F.sequence(F.lit(1), F.size("pieces")), lambda i: F.element_at("pieces", i).rlike(pattern) & test(run(i, F.lit(RUN))))
    runs = F.flatten(F.transform(starts, lambda i: F.transform(F.sequence(F.lit(1), F.least(F.lit(RUN), F.size("pieces") - i + 1)), lambda k: run(i, k))))
    marked = marked.select("file_id", "path", "whole", "spdx", "rights", "key", "body", F.filter("lines", test).alias("lines"), F.when(F.size("pieces") > 0, F.filter(runs, test)).alias("runs"))
    cores = F.filter(F.transform("runs", lambda x: F.regexp_extract(x, pattern, 1)), test)
    none = F.array().cast("array<string>")
    marked = marked.select("file_id", "path", "whole", "spdx", "rights", "key", "body",
                           F.array_distinct(F.concat(*(F.coalesce(c, none) for c in (F.col("lines"), F.col("runs"), cores)))).alias("segments"))
    marked = materialise(marked, "licence-lines")
    segments = marked.filter("key is not null").select("key", F.explode("segments").alias("segment"))
    bodies = marked.filter("key is not null and body is not null").select("key", F.lower("body").alias("segment"))
    own = own_licences(segments.unionAll(bodies), templates, least).select("key", F.lit(2).alias("rank"), "licence", "score")
    own = own.unionAll(own_licences(bodies, whole_texts(), LEAST_WHOLE).select("key", F.lit(1), "licence", "score"))
    own = own.groupBy("key").agg(F.min(F.struct("rank", (-F.col("score")).alias("s"), "licence")).alias("best"))
    # the files of one text may be many: they are dealt over SALTS keys, its one row is repeated for each
    own = own.select(F.col("key").alias("of"), F.col("best.licence").alias("named"), (-F.col("best.s")).alias("named_score"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("of_salt"))
    salted = marked.drop("segments", "body").withColumn("salt", F.pmod(F.xxhash64("file_id", "path"), F.lit(SALTS)).cast("int"))
    joined = salted.join(own, (F.col("key") == F.col("of")) & (F.col("salt") == F.col("of_salt")), "left")
    licence = F.coalesce("spdx", "named", F.when(F.col("rights"), PROPRIETARY))
    score = F.when(F.col("spdx").isNotNull(), 1.0).otherwise(F.coalesce("named_score", F.when(F.col("rights"), 1.0)))
    found = materialise(joined.select("file_id", "path", "whole", licence.alias("licence"), score.alias("score"), parent(F.col("path")).alias("dir")), "licences")
    of_dir = (found.filter("whole and licence is not null and dir is not null").groupBy(F.col("dir").alias("from_dir"))
              .agg(F.min(F.struct((-F.col("score")).alias("s"), F.col("licence").alias("licence"))).alias("best")))
    dirs = found.filter("licence is null and dir is not null").select("dir").distinct()
    steps = F.split("dir", "/")
    above = dirs.select("dir", F.explode(F.transform(F.sequence(F.lit(0), F.size(steps)), lambda i: F.concat_ws("/", F.slice(steps, 1, i)))).alias("above")).distinct()
    nearest = (above.join(of_dir, F.col("above") == F.col("from_dir"))
               .groupBy("dir").agg(F.max(F.struct(F.length("from_dir").alias("depth"), "from_dir", "best")).alias("near"))
               .select(F.col("dir").alias("of_dir"), "near.from_dir", F.col("near.best.licence").alias("heir"), (-F.col("near.best.s")).alias("heir_score")))
    out = found.join(nearest, (F.col("dir") == F.col("of_dir")) & F.col("licence").isNull(), "left")
    origin = F.when(F.col("licence").isNotNull(), "own").when(F.col("heir").isNotNull(), "inherited").otherwise("none")
    return out.select("file_id", "path", F.coalesce("licence", "heir").alias("licence"), F.coalesce("score", "heir_score").alias("score"),
                      origin.alias("origin"), F.when(F.col("licence").isNull(), F.col("from_dir")).alias("from_dir"))
