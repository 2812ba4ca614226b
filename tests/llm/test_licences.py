"""Licences: identifiers, permission texts wherever they stand, rights lines; the scan against plain comparison of all segments."""

import math
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from civicspark.llm import licenses as L
from civicspark.llm.op4 import layout
from civicspark.llm.queries import ORACLES
from civicspark.plans.compare import compare, duck

TEXTS = dict(L.whole_texts())
CODE = "import os\n\n\ndef main():\n    return os.getcwd()\n"


def commented(text):
    return "\n".join("# " + line for line in text.splitlines())


CASES = [
    ("SPDX-License-Identifier: BSD-3-Clause", "BSD-3-Clause"), ("// SPDX-License-Identifier: ISC\n" + CODE, "ISC"), ("# SPDX-License-Identifier: MPL-2.0", "MPL-2.0"),
    ("/* SPDX-License-Identifier: GPL-2.0-only */", "GPL-2.0"), ("# SPDX-License-Identifier: GPL-3.0-or-later", "GPL-3.0"), ("# SPDX-License-Identifier: apache-2.0", "Apache-2.0"),
    ("# SPDX-License-Identifier: (MIT OR Apache-2.0)", "MIT"), ("# SPDX-License-Identifier: LicenseRef-own", None),
    (commented(TEXTS["MIT"]) + "\n" + CODE, "MIT"), (commented(TEXTS["ISC"]) + "\n" + CODE, "ISC"),
    ("# Copyright (c) 2020 A. Author. All rights reserved.\n" + commented(TEXTS["BSD-3-Clause"]) + "\n" + CODE, "BSD-3-Clause"),
    (CODE + "\nAll rights reserved.\n", "Proprietary"), ("all seats were reserved and the rights of way closed", None), ("All rights reserved. Released under the MIT License.", "MIT"),
    ("Licensed under the Apache License, Version 2.0 (the \"License\");\nyou may not use this file except in compliance", "Apache-2.0"), (CODE, None), (None, None), ("", None),
    ("words " * 20_000 + "Released under the MIT License.", "MIT"),
]


def test_headers_texts_and_identifiers(spark):
    df = spark.createDataFrame([(i, f"/d{i}/x.py", t, "x", "x") for i, (t, _) in enumerate(CASES)], "file_id long, path string, text string, licence string, salt string")
    got = {r.file_id: r.licence for r in L.scan(df).collect()}
    assert got == {i: want for i, (_, want) in enumerate(CASES)}


def brute(text, templates, least):
    """Every segment of a text with every template, by the definition."""
    terms = lambda t: Counter(re.findall(L.TERM, t.lower()))
    counts = [(name, terms(words)) for name, words in templates]
    df = Counter(t for _, c in counts for t in c)
    idf = lambda t: math.log((1 + len(counts)) / (1 + df[t])) + 1
    pattern = re.compile(L.telling(templates))
    pieces = re.split(L.PIECE_ENDS, text.lower())
    runs = [" ".join(pieces[i:i + k]) for i in range(len(pieces)) if pattern.search(pieces[i]) for k in range(1, L.RUN + 1) if i + k <= len(pieces)]
    segments = re.split("[\r\n]+", text.lower()) + runs + [m.group(1) for m in map(pattern.search, runs) if m]
    best = None
    for segment in segments:
        if not pattern.search(segment):
            continue
        c = terms(segment)
        norm = math.sqrt(sum((n * idf(t)) ** 2 for t, n in c.items()))
        for name, of in counts:
            shared = set(c) & set(of)
            score = round(sum(c[t] * of[t] * idf(t) ** 2 for t in shared) / norm / math.sqrt(sum((n * idf(t)) ** 2 for t, n in of.items())), 4)
            if len(shared) > 1 and score >= least:
                version = re.search(L.VERSION, name)
                named = name if not version or version.group(1) in c else name[:version.start()]
                best = min(best or (1, ""), (-score, named))
    return (best[1], -best[0]) if best else (None, None)


def test_scan_equals_comparing_all_segments(spark):
    import random

    rng = random.Random(6)
    words = "the a plain text about licensed software under mit license version gnu general public 2 3 permission granted hereby free charge redistribution source binary forms cc by nc".split()
    texts = []
    for _ in range(150):
        parts = [" ".join(rng.choices(words, k=rng.randint(1, 14))) for _ in range(rng.randint(1, 7))]
        if rng.random() < 0.5:
            parts[rng.randrange(len(parts))] = rng.choice(L.TEMPLATES)[1]
        texts.append("".join(p + rng.choice([". ", "\n", "; ", "! ", ".", "\n\n"]) for p in parts))
    df = spark.createDataFrame([(i, f"/{i}/x.py", t) for i, t in enumerate(texts)], "file_id long, path string, text string")
    got = {r.file_id: (r.licence, r.score) for r in L.scan(df).collect()}
    for i, t in enumerate(texts):
        want = brute(t, L.TEMPLATES, 0.5)
        assert got[i][0] == want[0] and (want[0] is None or got[i][1] == pytest.approx(want[1], abs=2e-4)), t


def test_one_text_of_many_files(spark):
    df = spark.range(3000).select(F.col("id").alias("file_id"), F.concat(F.lit("/d/"), F.col("id").cast("string")).alias("path"), F.lit("Released under the MIT License.").alias("text"))
    out = L.scan(df)
    assert out.filter("licence = 'MIT' and origin = 'own'").count() == 3000


def test_sql_twin_on_the_cases(spark, tmp_path):
    rows = [(i, t, "s") for i, (t, _) in enumerate(CASES)] + [(1000, TEXTS["MIT"], "s"), (1001, "x", "s"), (1010, TEXTS["GPL-3.0"], "s"), (1011, "y", "s"), (1020, "x", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").coalesce(1)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    con = duck("/root/testdata/sf0.001")
    con.execute(f"CREATE OR REPLACE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    message = compare(L.scan(layout(docs)).withColumnRenamed("file_id", "doc_id"), con, ORACLES["op4_license_scan"])
    assert message.startswith("ok"), message
