"""Licence scans: a trained paragraph classifier, confirmed by comparison with templates.

Paragraphs are classified by sparse multinomial logistic regression on word 1- to 3-grams into
licence families and an unknown class. It is fitted on varied template notices and on paragraphs of
the documents themselves; a temperature, fitted on variations kept apart, calibrates its
probabilities. A family is reported if it is likelier than all else and a template of it agrees.
Paragraphs with a word of licensing are classified by overlapping windows as well, so that several
notices in one are told apart. Lines that only name licences (`MIT License`, `License: MIT`, SPDX
identifiers) are read by rule.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from datascout.llm.bpe import slices

#: Notices of each family: fixed values.
TEMPLATES = {
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.',
    ],
    "MIT": [
        "Released under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, "
        "to deal in the Software without restriction.",
    ],
    "GPL-3.0": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as "
        "published by the Free Software Foundation, either version 3 of the License, or any later version.",
    ],
    "GPL-2.0": [
        "This work is licensed under the GNU General Public License, version 2.",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as "
        "published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    ],
    "GPL-1.0": [
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as "
        "published by the Free Software Foundation; either version 1, or (at your option) any later version.",
    ],
    "LGPL-3.0": [
        "This library is licensed under the GNU Lesser General Public License, version 3.",
        "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as "
        "published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ],
    "LGPL-2.1": [
        "This library is licensed under the GNU Lesser General Public License, version 2.1.",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as "
        "published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    ],
    "AGPL-3.0": [
        "This work is licensed under the GNU Affero General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as "
        "published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ],
    "Apache-1.1": ["Licensed under the Apache Software License, Version 1.1."],
    "BSD-2-Clause": ["Released under the BSD 2-Clause License."],
    "ISC": [
        "Released under the ISC License.",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.",
    ],
    "Unlicense": ["This is free and unencumbered software released into the public domain.", "Released under the Unlicense."],
    "MPL-1.1": ["The contents of this file are subject to the Mozilla Public License Version 1.1."],
    "CC-BY-3.0": ["Licensed under CC BY 3.0.", "This work is licensed under a Creative Commons Attribution 3.0 Unported License."],
    "CC-BY-ND-4.0": ["Licensed under CC BY-ND 4.0.", "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License."],
    "CC-BY-NC-SA-4.0": [
        "Licensed under CC BY-NC-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License.",
    ],
    "BSD-3-Clause": [
        "Released under the BSD 3-Clause License.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following "
        "conditions are met.",
    ],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."],
    "CC-BY-4.0": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "CC-BY-SA-4.0": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "CC0-1.0": ["Released under CC0 1.0 Universal.", "To the extent possible under law, the author has waived all copyright to this work."],
}
#: Near misses that name no family of the above.
UNKNOWN = [
    "All rights reserved.", "Copyright by the author, all rights reserved.", "The driver's license was issued in another version.",
    "Used under license from the owner.", "This work may not be copied without permission.", "Licensed to the public library.",
    "See the license file for details.", "The general public is free to use this work.", "This program is free.",
    "Released in version 2.0 of the product.", "Licensed under the terms of our own agreement, version 3.",
]
NAMES = [*TEMPLATES, "unknown"]
#: Words that tell families apart: a notice and its template have the same ones of them, and the same versions.
DECIDING = {"lesser", "affero", "noderivatives", "noderivs", "nd", "noncommercial", "nc", "sharealike", "sa"}
VERSION = re.compile(r"(?:\bversions?\s+|\bv\.?\s*|\b(?:attribution|sharealike|noncommercial|noderivatives|by|sa|nc|nd|cc0|l?a?gpl|mpl|apache|bsd)[ -])(\d+(?:\.\d+)?)\b|\b(\d)-clause")
NEGATED = re.compile(r"\b(?:not|never|no longer)\s+(?:\w+\s+){0,2}?(?:released|licensed|distributed|available|covered|under)\b")
#: Variations of each notice, paragraphs of documents, and rounds of fitting.
VARIED, SAMPLED, EPOCHS = 60, 4_000, 200
LIKELY, AGREED = 0.5, 0.75
BATCH_BYTES = 4_000_000
#: Words that make a paragraph worth windows; without a family, it is reported as unknown for one of NOTICE.
NOTICE = {"license", "licence", "licensed", "licenced", "licenses", "licences", "copyright", "copyrighted", "spdx"}
SIGNAL = NOTICE | {"permission", "redistribution", "waived", "cc", "cc0", "gpl", "lgpl", "agpl", "mpl", "mit", "bsd", "apache", "mozilla", "gnu", "commons"}
#: Names of the families, as `_named` reduces them.
SHORT = {
    "apache 2": "Apache-2.0", "mit": "MIT", "gpl 3": "GPL-3.0", "gpl 2": "GPL-2.0", "lgpl 3": "LGPL-3.0", "agpl 3": "AGPL-3.0",
    "bsd 3": "BSD-3-Clause", "3 bsd": "BSD-3-Clause", "mpl 2": "MPL-2.0", "cc by 4": "CC-BY-4.0", "cc by sa 4": "CC-BY-SA-4.0",
    "cc by nc 4": "CC-BY-NC-4.0", "cc0 1": "CC0-1.0", "cc0": "CC0-1.0", "gpl 1": "GPL-1.0", "lgpl 2.1": "LGPL-2.1",
    "apache 1.1": "Apache-1.1", "bsd 2": "BSD-2-Clause", "2 bsd": "BSD-2-Clause", "isc": "ISC", "unlicense": "Unlicense",
    "mpl 1.1": "MPL-1.1", "cc by 3": "CC-BY-3.0", "cc by nd 4": "CC-BY-ND-4.0", "cc by nc sa 4": "CC-BY-NC-SA-4.0",
}
LONG = {
    "gnu lesser general public": "lgpl", "gnu affero general public": "agpl", "gnu general public": "gpl", "mozilla public": "mpl",
    "creative commons": "cc", "attribution": "by", "sharealike": "sa", "noncommercial": "nc",
    "noderivatives": "nd",
}
DROPPED = set("the a license licence version v gnu only or later international universal software clause".split())
WORD = re.compile(r"[a-z0-9]+(?:\.[0-9]+)*")
FILLER = "this file work project code data text version the is copy of our free new all in document site page".split()


def _named(name: str) -> str | None:
    """The family of a licence's short name, `unknown` for another; None if nothing is named."""
    name = re.sub(r"\bv\.?\s*(?=[0-9])|(?<=[a-z])v(?=[0-9])", " ", name.lower())
    words = " ".join(w.removesuffix(".0") for w in WORD.findall(name))
    for long, short in LONG.items():
        words = words.replace(long, short)
    key = " ".join(w for w in words.split() if w not in DROPPED)
    return SHORT.get(key, "unknown") if key else None


def short_forms(line: str) -> list[str]:
    """Families that a line names which is nothing but a licence's name, a licence field or an SPDX expression."""
    line = line.strip(" \t#/*;-<>!.%\"'")
    field = re.match(r"(?:spdx-license-identifier|licen[sc]es?)\s*[:=]\s*(.+)", line, re.IGNORECASE)
    if not field and (len(line) > 150 or not re.search("licen[sc]e", line, re.IGNORECASE)):
        return []
    names = re.sub("[()]", " ", field[1]) if field else re.sub(r"\([^)]*\)", " ", line)
    names = re.sub(r"\s+with\s+\S+", "", names, flags=re.IGNORECASE)
    parts = re.split(r"\s+(?:or|and)\s+(?!later)|\s*[/|;&]\s*|,\s*(?![\sv])", names, flags=re.IGNORECASE)
    found = [f for n in parts if (f := _named(n))]
    if field and line[:4].lower() != "spdx" and len(WORD.findall(names)) > 14:
        return []  # a sentence after a colon
    return found if field or "unknown" not in found else []


def paragraphs(text: str | None) -> list[str]:
    """Lines joined up to a blank line or one that ends a sentence."""
    return [" ".join(lines) for lines in lined_paragraphs(text)]


def lined_paragraphs(text: str | None) -> list[list[str]]:
    out, held = [], []
    for line in (text or "").split("\n"):
        line = line.strip()
        if line:
            held.append(line)
        if held and (not line or line[-1] in ".!?:;"):
            out.append(held)
            held = []
    return [*out, held] if held else out


def grams(words: list[str]) -> set[str]:
    return {" ".join(words[i : i + n]) for n in (1, 2, 3) for i in range(len(words) - n + 1)}


def deciding(words: list[str]) -> tuple[frozenset, frozenset]:
    """(words that tell families apart, versions) of a text."""
    text = " ".join(words)
    stated = {(a or f"{b}-clause").removesuffix(".0") for a, b in VERSION.findall(text)}
    return frozenset(DECIDING.intersection(words)), frozenset(stated)


def _varied(notice: str, rng: np.random.Generator) -> str:
    """A notice with words dropped, put in or around it."""
    words = [w for w in notice.split() if rng.random() > 0.06]
    for _ in range(rng.integers(0, 3)):
        words.insert(int(rng.choice([0, len(words)])), str(rng.choice(FILLER)))
    return " ".join(words)


class Scanner:
    def __init__(self, ordinary: list[str], seed: int = 3):
        rng = np.random.default_rng(seed)
        examples = [(p, len(NAMES) - 1) for p in [*ordinary, *(u for u in UNKNOWN for _ in range(VARIED // 2))]]
        for label, notices in enumerate(TEMPLATES.values()):
            examples += [(_varied(n, rng) if i else n, label) for n in notices for i in range(VARIED)]
        tokens = [(grams(WORD.findall(p.lower())), y) for p, y in examples]
        kept = {g for t, y in tokens if y < len(NAMES) - 1 for g in t} | {g for u in UNKNOWN for g in grams(WORD.findall(u.lower()))}
        self.column = {g: i for i, g in enumerate(sorted(kept))}
        part = rng.random(len(tokens)) < 0.25  # kept apart for calibration
        self.w, self.b = np.zeros((len(self.column), len(NAMES))), np.zeros(len(NAMES))
        self.heat = 1.0
        self._fit([t for t, p in zip(tokens, part) if not p])
        self._calibrate([t for t, p in zip(tokens, part) if p])
        self.spans = []  # widths of windows, each at most three quarters of the next
        for n in sorted({len(WORD.findall(n.lower())) for ns in TEMPLATES.values() for n in ns}, reverse=True):
            if not self.spans or n <= 0.75 * self.spans[-1]:
                self.spans.append(n)
        self.templates = {f: [(grams(w), deciding(w)) for n in ns for w in [WORD.findall(n.lower())]] for f, ns in TEMPLATES.items()}
        # Words, pairs and triples of the classifier by their words: a known gram has known words only.
        self.known = {tuple(g.split(" ")): i for g, i in self.column.items()}

    def _fit(self, examples) -> None:
        rows = [[self.column[g] for g in t if g in self.column] for t, _ in examples]
        y = np.array([y for _, y in examples])
        flat = np.array([c for r in rows for c in r], np.int64)
        owner = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
        weight = (1 / np.sqrt(np.maximum(1, [len(r) for r in rows])))[owner][:, None]
        share = np.array([1 / max(1, (y == c).sum()) for c in range(len(NAMES))])[y]  # classes weigh the same
        share = share / share.sum()
        # Sums by row and by column over sorted entries; rows and columns without entries stay zero.
        filled, row_starts = np.unique(owner, return_index=True)
        order = np.argsort(flat, kind="stable")
        columns, column_starts = np.unique(flat[order], return_index=True)
        squares = np.full(self.w.shape, 1e-8), np.full(len(NAMES), 1e-8)
        for _ in range(EPOCHS):
            scores = np.tile(self.b, (len(rows), 1))
            scores[filled] += np.add.reduceat(self.w[flat] * weight, row_starts)
            p = np.exp(scores - scores.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            p[np.arange(len(y)), y] -= 1
            pull = p * share[:, None]
            grad = 1e-5 * self.w
            grad[columns] += np.add.reduceat((pull[owner] * weight)[order], column_starts)
            for value, g, sq in ((self.w, grad, squares[0]), (self.b, pull.sum(0), squares[1])):
                sq += g * g
                value -= 0.3 * g / np.sqrt(sq)

    def scores(self, found: set[str]) -> np.ndarray:
        known = [self.column[g] for g in found if g in self.column]
        return self.b + self.w[known].sum(0) / np.sqrt(max(1, len(known)))

    def _calibrate(self, examples) -> None:
        s, y = np.array([self.scores(t) for t, _ in examples]), np.array([y for _, y in examples])

        def loss(heat: float) -> float:
            z = s / heat
            return float((np.log(np.exp(z - z.max(1, keepdims=True)).sum(1)) + z.max(1) - z[np.arange(len(y)), y]).mean())

        self.heat = min((0.25 * 1.15**i for i in range(25)), key=loss)

    def classify(self, paragraph: str) -> tuple[str, float, float] | None:
        """(family or unknown, its probability, agreement of its closest template); None if it reads
        like no notice."""
        return self._told(WORD.findall(paragraph.lower()))

    def _told(self, words: list[str], before: list[str] = ()) -> tuple[str, float, float] | None:
        known = self._columns(words)
        if not known:
            return None  # no word of a notice
        z = (self.b + self.w[known].sum(0) / np.sqrt(len(known))) / self.heat
        if z[-1] >= z.max() and NOTICE.isdisjoint(words):
            return None
        p = np.exp(z - z.max())
        p /= p.sum()
        best = int(p.argmax())
        if best == len(NAMES) - 1:
            return None if NOTICE.isdisjoint(words) else ("unknown", float(p[best]), 0.0)
        found, stated = grams(words), deciding(words)
        # A template agrees by the share of its grams; without the same deciding words and versions it is another notice.
        agreed = max((len(found & t) / len(t) for t, d in self.templates[NAMES[best]] if d == stated), default=0.0)
        sure = p[best] >= LIKELY and agreed >= AGREED and not NEGATED.search(" ".join([*before, *words]))
        return (NAMES[best] if sure else "unknown"), float(p[best]), float(agreed)

    def _columns(self, words: list[str]) -> list[int]:
        """The classifier's columns of a text's grams, each once, in order; only runs of known words are looked at."""
        known, found = self.known, set()
        one = [w if (w,) in known else None for w in words]
        n = len(one)
        for i, w in enumerate(one):
            if w is not None:
                found.add(known[(w,)])
                if i + 1 < n and (x := one[i + 1]) is not None:
                    if (c := known.get((w, x))) is not None:
                        found.add(c)
                    if i + 2 < n and (y := one[i + 2]) is not None and (c := known.get((w, x, y))) is not None:
                        found.add(c)
        return sorted(found)

    def notices(self, lines: list[str]) -> list[tuple[str, float, float]]:
        """`classify` for every notice of a paragraph: a row for each family; `unknown` where there is none,
        or a field names another licence. Names read by rule have probability and agreement 1."""
        words = WORD.findall(" ".join(lines).lower())
        whole = self._told(words)
        if SIGNAL.isdisjoint(words):
            return [whole] if whole else []
        best: dict[str, tuple[str, float, float]] = {f: (f, 1.0, 1.0) for line in lines for f in short_forms(line)}
        named = set(best)
        marked = np.concatenate(([0], np.cumsum([w in SIGNAL for w in words])))
        told = [whole]
        for n in self.spans:  # a window of each width holds any notice of that length, or less, whole
            step = max(1, n // 4)
            for i in range(0, max(1, len(words) - n + 1), step) if len(words) > n else ():
                end = min(len(words), i + n + step)
                if marked[end] > marked[i]:
                    told.append(self._told(words[i:end], words[max(0, i - 4) : i]))
        for t in told:
            if t and (t[0] not in best or t[1:] > best[t[0]][1:]):
                best[t[0]] = t
        if len(best) > 1 and "unknown" not in named:
            best.pop("unknown", None)
        return [best[f] for f in sorted(best)]


def fit_scanner(docs: DataFrame, text_col: str = "text") -> Scanner:
    """Fits on the templates and at most SAMPLED paragraphs of documents chosen by hash (texts of up to 20,000
    characters) that share no three words in a row with a template."""
    texts = docs.select(F.col(text_col).alias("t")).where(F.char_length("t").between(1, 20_000))
    one_in = max(1, texts.count() // 1_000)
    rows = texts.where(F.pmod(F.xxhash64("t"), F.lit(one_in)) == 0).limit(2_000).collect()
    known = {g for ns in TEMPLATES.values() for n in ns for g in grams(WORD.findall(n.lower())) if g.count(" ") == 2}
    ordinary = sorted({p for r in rows for p in paragraphs(r["t"])})
    ordinary = [p for p in ordinary if not grams(WORD.findall(p.lower())) & known]
    return Scanner(ordinary[:: max(1, len(ordinary) // SAMPLED)][:SAMPLED])


def scan_licenses(docs: DataFrame, scanner: Scanner, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, paragraph, family, probability, agreement) for each family of each paragraph that reads like a
    licence notice; family is `unknown` where the classifier or the templates are not sure.

    Paragraphs count from 0. Null and empty texts have none. Equal rows are scanned each. Other
    columns are not read.
    """
    schema = T.StructType(
        [
            T.StructField(id_col, docs.schema[id_col].dataType),
            T.StructField("paragraph", T.IntegerType()),
            T.StructField("family", T.StringType()),
            T.StructField("probability", T.DoubleType()),
            T.StructField("agreement", T.DoubleType()),
        ]
    )
    names = schema.names
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", BATCH_BYTES):
                hits, seen = [], {}  # paragraphs that occur again in the batch are scored once
                for i, t in enumerate(part.column("text").to_pylist()):
                    for n, lines in enumerate(lined_paragraphs(t)):
                        key = tuple(lines)
                        if (told := seen.get(key)) is None:
                            told = seen[key] = scanner.notices(lines)
                        hits += [(i, n, *x) for x in told]
                kinds = (pa.int32(), pa.string(), pa.float64(), pa.float64())
                ids = part.column("id").take(pa.array([h[0] for h in hits], pa.int64()))
                yield pa.RecordBatch.from_arrays([ids, *(pa.array([h[c] for h in hits], k) for c, k in enumerate(kinds, 1))], names=names)

    return rows.mapInArrow(run, schema)
