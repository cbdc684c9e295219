"""Spelling variants."""

import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from datascout.llm import queries, variants  # noqa: F401
from datascout.plans.registry import QUERIES

SF = "/root/testdata/sf0.001"
LETTERS = "abcdefghijklmnopqrstuvwxyzàéÿ"


def near(a, b):
    """Exactly one inserted, deleted or replaced letter."""
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute_words(rows, drop=97):
    counts = Counter()
    for d, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if d is None else d}:{run}".encode())
            if h % drop == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    return {w: n for w, n in counts.items() if len(w) >= 5 and n >= 3}


def brute_forms(counts):
    """By deletions: two words are near only if they share a word with a letter less, or one is it."""
    by: dict[str, set] = {}
    for w in counts:
        for k in {w, *(w[:i] + w[i + 1 :] for i in range(len(w)))}:
            by.setdefault(k, set()).add(w)
    told = {}
    for w, n in counts.items():
        others = {x for k in {w, *(w[:i] + w[i + 1 :] for i in range(len(w)))} for x in by[k]} - {w}
        others = [x for x in others if near(w, x)]
        best = min(others, key=lambda x: (-counts[x], x), default=None)
        told[w] = (best if best and counts[best] >= 2 * n else None, len(others))
    rows = []
    for w, n in counts.items():
        root = w
        while told[root][0]:
            root = told[root][0]
        form = told[w][0]
        rows.append((w, form, root, n, told[w][1], counts[form] if form else None))
    return sorted(rows)


@settings(max_examples=200, deadline=None)
@given(st.binary(max_size=9), st.binary(max_size=300))
def test_joined_checksums(a, b):
    got = variants.crc_joined(np.array([zlib.crc32(a)], np.uint64), np.array([zlib.crc32(b)], np.uint64), np.array([len(b)]))
    assert got.tolist() == [zlib.crc32(a + b)]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.none() | st.text(st.sampled_from("aZé×ÿĀ  '中"), max_size=12), max_size=8), st.integers(0, 3))
def test_runs_of_letters(texts, skipped):
    found, owner = variants.runs(pa.array(texts, pa.string())[skipped:])
    want = [(i, "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in r)) for i, t in enumerate(texts[skipped:]) for r in re.findall("[A-Za-zÀ-ÿ]+", t or "")]
    assert list(zip(owner.tolist(), found.to_pylist())) == want


@settings(max_examples=60, deadline=None)
@given(st.sets(st.text(st.sampled_from("abé"), min_size=4, max_size=8), max_size=150), st.integers(5, 8))
def test_bit_sliced_sets_find_all_pairs(words, c):
    asked, block = sorted(w for w in words if len(w) in (c, c - 1)), sorted(w for w in words if len(w) == c)
    q, t = variants.near_pairs(asked, block, c)
    got = sorted((asked[i], block[j]) for i, j in zip(q.tolist(), t.tolist()))
    assert got == sorted((a, b) for a in asked for b in block if near(a, b))
    for a, b in got:  # two parts of three are in common
        x, y = variants.part_keys([a], c), variants.part_keys([b], c)
        assert any(i == j for i, j in zip(x, y))


def test_op13_on_whole_tables(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    found = sorted(map(tuple, QUERIES["op13_spelling"](spark, SF).collect()))
    assert found == brute_forms(brute_words(rows)) and any(f for _, f, *_ in found)


@pytest.mark.parametrize("hot, block", [(8192, 1024), (3, 4)])
def test_forms_of_made_words(spark, monkeypatch, hot, block):
    monkeypatch.setattr(variants, "HOT_ROWS", hot)
    monkeypatch.setattr(variants, "BLOCK", block)
    rng = np.random.default_rng(1)
    counts = {}
    for _ in range(60):
        base = "".join(rng.choice(list(LETTERS), rng.integers(1, 9)))
        n = int(rng.integers(3, 50)) * 8
        for w in [base, base + "a", "b" + base, base[1:], base[:-1] + "z", base + "aa", "prefix" + base, "prefix" + base + base[-1]]:
            counts[w] = int(rng.choice([n, n // 2, n // 4, 3, 6]))
    counts |= {f"commonest{x}{y}": 7 for x in "abcdef" for y in "éab"} | {"commonest": 700, "e" * 400: 3, "e" * 401: 9, "ab" * 300: 4}
    counts.pop("", None)
    words = spark.createDataFrame(list(counts.items()), "word string, n long").repartition(3)
    assert sorted(map(tuple, variants.variant_forms(words).collect())) == brute_forms(counts)


def test_words_of_odd_documents(spark):
    rows = [(1, None), (2, ""), (3, "Straße straße STRASSE straßE"), (3, "Straße"), (None, "hello HELLO hello"), (4, "x" * 30000 + " hello ÀÉÎÕÜ àéîõü " * 3)]
    docs = spark.createDataFrame([(d, t, "clash", 1) for d, t in rows], "doc_id long, text string, word string, n int")
    for drop in (97, 2, 1):
        assert dict(map(tuple, variants.count_words(docs, drop_one_in=drop).collect())) == brute_words(rows, drop)
    assert variants.variant_forms(variants.count_words(docs.limit(0))).count() == 0
