"""Quality field, licence scans, decontamination."""

import itertools
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from datascout.llm import decontaminate, licenses, quality

SF = "/root/testdata/sf0.01"


def test_marginals_are_those_of_all_labelings():
    scores, turn = [0.3, -1.2, 2.0, 0.1, -0.4], [[0.7, -0.5], [-0.2, 1.1]]
    weight = {}
    for y in itertools.product((0, 1), repeat=len(scores)):
        weight[y] = np.exp(sum(s for s, v in zip(scores, y) if v) + sum(turn[a][b] for a, b in zip(y, y[1:])))
    total = sum(weight.values())
    want = [sum(w for y, w in weight.items() if y[i]) / total for i in range(len(scores))]
    assert np.allclose(quality.marginals(scores, turn), want)
    assert quality.marginals([500.0, -500.0], turn) and quality.marginals([0.0], turn) == [0.5]


def test_gradient_matches_differences():
    rng = np.random.default_rng(1)
    data, mask, y = rng.normal(size=(3, 4, 2)), np.array([[1, 1, 1, 1], [1, 1, 0, 0], [1, 0, 0, 0]], float), np.array([1, 0, 1])
    data *= mask[:, :, None]

    def loss(theta):
        out = 0.0
        for x, m, label in zip(data, mask, y):
            t = int(m.sum())
            s, turn = x[:t] @ theta[:-4], theta[-4:].reshape(2, 2)
            each = {v: sum(s[i] for i in range(t) if v[i]) + sum(turn[a][b] for a, b in zip(v, v[1:])) for v in itertools.product((0, 1), repeat=t)}
            out -= each[(label,) * t] - np.log(sum(map(np.exp, each.values())))
        return out / mask.sum()

    theta = rng.normal(size=6)
    steps = [(loss(theta + e) - loss(theta - e)) / 2e-5 for e in np.eye(6) * 1e-5]
    assert np.allclose(quality.Model._gradient(theta, data, mask, y), steps, atol=1e-6)


def test_held_out_accuracy_and_odd_texts(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    model = quality.fit_quality(docs, labels)
    odd = spark.createDataFrame([(-1, None), (-2, ""), (-3, "\n\n \n"), (-4, "x" * 100_000), (-4, "x" * 100_000)], "doc_id long, text string")
    table = docs.select("doc_id", "text").unionByName(odd).withColumns({"score": F.lit("clash"), "quality": F.lit(9)})
    found = quality.score_quality(table, model).join(labels.select("doc_id", F.col("quality").alias("y")), "doc_id", "left").collect()
    assert len(found) == docs.count() + 5 and all(0 <= r.score <= 1 for r in found)
    assert len({r.score for r in found if r.doc_id in (-1, -2, -3)}) == 1 and len({r.score for r in found if r.doc_id == -4}) == 1
    test = [r for r in found if r.y is not None and zlib.crc32(str(r.doc_id).encode()) % 4 == 2]
    assert np.mean([(r.score >= 0.7) == (r.y == 1) for r in test]) > 0.95
    out = docs.select("doc_id", quality.held_out(F.col("doc_id")).alias("h")).collect()
    assert all(r.h == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in out)


def test_no_labels_give_the_prior(spark):
    docs = spark.createDataFrame([(1, "a"), (2, None)], "doc_id long, text string")
    model = quality.fit_quality(docs, spark.createDataFrame([(1, None), (2, 7)], "doc_id long, quality int"))
    assert {r.score for r in quality.score_quality(docs, model).collect()} == {0.5}
    assert quality.score_quality(docs.limit(0), model).count() == 0


@pytest.fixture(scope="module")
def scanner(spark):
    return licenses.fit_scanner(spark.read.parquet(f"{SF}/documents.parquet"))


def test_all_notices_are_recognised(scanner):
    for family, notices in licenses.TEMPLATES.items():
        for n in notices:
            for text in (n, n.upper(), "This file: " + n):
                assert scanner.classify(text)[0] == family, text
    for text in [*licenses.UNKNOWN, "", "An ordinary line of prose about the weather and nothing else.", "Licensed under the Foo License, Version 9."]:
        assert (scanner.classify(text) or ("unknown",))[0] == "unknown", text


def test_versions_qualifiers_and_negations_decide(scanner):
    gnu = "This {} is free software; you can redistribute it and/or modify it under the terms of the GNU {}General Public License as published by the Free Software Foundation; either version {}, or (at your option) any later version."
    texts = {
        gnu.format("program", "", "2 of the License"): "GPL-2.0", gnu.format("program", "", "3 of the License"): "GPL-3.0", gnu.format("program", "", "1"): "GPL-1.0",
        gnu.format("library", "Lesser ", "2.1 of the License"): "LGPL-2.1", gnu.format("library", "Lesser ", "3 of the License"): "LGPL-3.0",
        gnu.format("program", "Affero ", "3 of the License"): "AGPL-3.0", gnu.format("program", "", "4 of the License"): "unknown",
        "This work is licensed under a Creative Commons Attribution 3.0 Unported License.": "CC-BY-3.0",
        "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License.": "CC-BY-ND-4.0",
        "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License.": "CC-BY-NC-SA-4.0",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 2.0 Generic License.": "unknown",
        "Licensed under the Apache Software License, Version 1.1.": "Apache-1.1", "Licensed under the Apache License, Version 3.0.": "unknown",
        "The contents of this file are subject to the Mozilla Public License Version 1.1.": "MPL-1.1",
        "This software is not released under the MIT License.": "unknown", "It was never licensed under the Apache License, Version 2.0.": "unknown",
        "Released under the BSD 2-Clause License.": "BSD-2-Clause", "Released under the BSD 3-Clause License.": "BSD-3-Clause",
    }
    assert {t: [n[0] for n in scanner.notices([t])] for t in texts} == {t: [f] for t, f in texts.items()}


def test_scores_of_known_runs_are_those_of_all_grams(spark, scanner):
    for r in spark.read.parquet(f"{SF}/documents.parquet").collect():
        for paragraph in licenses.paragraphs(r.text):
            words = licenses.WORD.findall(paragraph.lower())
            every = sorted(scanner.column[g] for g in licenses.grams(words) if g in scanner.column)
            assert scanner._columns(words) == every
            z = (scanner.b + scanner.w[every].sum(0) / np.sqrt(max(1, len(every)))) / scanner.heat
            told = scanner.classify(paragraph)
            if told is None:
                assert not every or z.argmax() == len(z) - 1
            elif told[0] != "unknown":
                assert licenses.NAMES[int(z.argmax())] == told[0]


def test_scan_of_the_documents(spark, scanner):
    lines = {
        "Licensed under CC BY-NC 4.0.": "CC-BY-NC-4.0", "Released under the MIT License.": "MIT",
        "This work is licensed under the GNU General Public License, version 3.": "GPL-3.0", "Licensed under the Apache License, Version 2.0.": "Apache-2.0",
    }
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    want = sorted((r.doc_id, lines[x]) for r in docs.collect() for x in r.text.split("\n") if x in lines)
    odd = spark.createDataFrame([(None, "Released under the\nMIT License."), (-1, None), (-2, "")], "doc_id long, text string")
    found = licenses.scan_licenses(docs.unionByName(odd).withColumn("family", F.lit(1)), scanner).collect()
    assert [(r.family, r.paragraph) for r in found if r.doc_id is None] == [("MIT", 0)]
    assert sorted((r.doc_id, r.family) for r in found if r.doc_id is not None and r.family != "unknown") == want and len(want) > 20
    assert licenses.scan_licenses(docs.limit(0), scanner).count() == 0


def test_short_forms_and_several_notices_of_a_paragraph(spark, scanner):
    mit, apache = licenses.TEMPLATES["MIT"][0], licenses.TEMPLATES["Apache-2.0"][0]
    prose = "and then the weather was fine over the hills where we walked all day " * 3
    texts = {
        "MIT License": ["MIT"], "The MIT License (MIT)": ["MIT"], "License: MIT": ["MIT"], "# SPDX-License-Identifier: MIT": ["MIT"],
        "// SPDX-License-Identifier: (MIT OR Apache-2.0)": ["Apache-2.0", "MIT"], "SPDX-License-Identifier: GPL-3.0-or-later": ["GPL-3.0"],
        "SPDX-License-Identifier: Zlib": ["unknown"], "MIT License\nApache License, Version 2.0": ["Apache-2.0", "MIT"],
        "All rights reserved, copyright by the author.": ["unknown"],
        f"{mit[:-1]}\n{apache[:-1]}": ["Apache-2.0", "MIT"], f"{prose}{mit} {prose}{apache} {prose}": ["Apache-2.0", "MIT"],
        prose: [],
    }
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = licenses.scan_licenses(docs, scanner).collect()
    assert {t: sorted(r.family for r in found if r.doc_id == i) for i, t in enumerate(texts)} == texts


def grams(text, k):
    words = decontaminate.item_words(text)
    return {tuple(words[i : i + k]) for i in range(len(words) - k + 1)}


@pytest.mark.parametrize("size", [4_000_000, 300])
def test_contained_items_are_those_of_all_pairs(spark, monkeypatch, size):
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", size)  # the smaller makes several blocks
    rng = np.random.default_rng(2)
    words = [f"w{i}" for i in range(30)]
    items = [(i, " ".join(rng.choice(words, rng.integers(1, 30)))) for i in range(25)] + [(90, None), (91, ""), (92, "..."), (1, "w1 w2"), (1, "w1 w2")]
    docs = [(i, " ".join(rng.choice(words, 200))) for i in range(20)] + [(100, None), (101, ""), (102, "w1 w2"), (None, "W1, w2!")]
    for i, t in items[:25]:
        part = t.split()
        cut = int(len(part) * rng.uniform(0.6, 1))
        docs.append((200 + i, " ".join(rng.choice(words, 50)) + " (" + ", ".join(part[:cut]).upper() + ") " + " ".join(rng.choice(words, 50))))
    want = []
    for i, t in items:
        k = min(5, len(decontaminate.item_words(t)))
        if k:
            for d, text in docs:
                shared = len(grams(t, k) & grams(text, k))
                if 100 * shared >= 75 * len(grams(t, k)):
                    want.append((-1 if d is None else d, i, len(grams(t, k)), shared))
    table = spark.createDataFrame(docs, "doc_id long, text string").withColumn("item_id", F.lit(5))
    asked = spark.createDataFrame(items, "item_id int, text string")
    found = decontaminate.find_contained(table, asked).collect()
    assert sorted((-1 if r.doc_id is None else r.doc_id, *r[1:]) for r in found) == sorted(want) and want
    clean = decontaminate.drop_contaminated(table, asked)
    dirty = {d for d, *_ in want}
    assert clean.columns == table.columns
    assert sorted(-1 if r.doc_id is None else r.doc_id for r in clean.collect()) == sorted(x for x in (-1 if d is None else d for d, _ in docs) if x not in dirty)
    assert decontaminate.find_contained(table, asked.limit(0)).count() == decontaminate.find_contained(table.limit(0), asked).count() == 0
