"""Packing under several limits."""

import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from datascout.llm import packing, queries  # noqa: F401
from datascout.plans.registry import QUERIES

PATH = public_tokenizers.path("byte_bpe_50k.json")
SF = "/root/testdata/sf0.001"


def dealt(limits, documents):
    """Sequences as lists of (key, start, length), and each document's pieces."""
    sequences: dict[int, list] = {}

    def place(key, start, length, sequence, offset):
        here = sequences.setdefault(sequence, [])
        assert offset == sum(p[2] for p in here) and length > 0
        here.append((key, start, length))

    filled = []
    packer = packing.Packer(limits, place, lambda key, start: filled.append([(key, start, limits.tokens)]), pool=8)
    for key, (length, before) in enumerate(documents):
        packer.add(key, length, before)
    packer.finish()
    assert sorted(sequences) == list(range(len(sequences)))
    return [*sequences.values(), *filled]


@settings(max_examples=60, deadline=None)
@given(st.data())
def test_limits_hold_and_every_token_is_placed_once(data):
    limits = packing.Limits(data.draw(st.integers(1, 40)), data.draw(st.integers(1, 6)), data.draw(st.integers(1, 40)))
    documents = []
    for length in data.draw(st.lists(st.integers(0, 130), max_size=40)):
        bears = data.draw(st.none() | st.lists(st.booleans(), min_size=length, max_size=length))
        documents.append((length, None if bears is None else np.concatenate(([0], np.cumsum(np.array(bears, int))))))
    sequences = dealt(limits, documents)
    got: dict[int, list] = {}
    for pieces in sequences:
        loss = 0
        for key, start, length in pieces:
            got.setdefault(key, []).append((start, length))
            before = documents[key][1]
            loss += length if before is None else before[start + length] - before[start]
        assert sum(p[2] for p in pieces) <= limits.tokens and len(pieces) <= limits.segments and loss <= limits.loss
    for key, (length, _) in enumerate(documents):
        at = 0
        for start, n in sorted(got.get(key, [])):
            assert start == at
            at += n
        assert at == length


def test_scarce_limits_decide_who_comes_next():
    """With a tight limit of loss, prompts (no loss) and answers (all loss) are mixed, so fewer
    sequences are needed than when each kind is packed for itself."""
    prompt, answer = (50, np.zeros(51, int)), (50, None)
    sequences = dealt(packing.Limits(100, 8, 50), [prompt, answer] * 20)
    assert len(sequences) <= 21
    whole = [p for pieces in sequences for p in pieces if p[2] == 50]
    assert len(whole) >= 36


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 50), min_size=1, max_size=12))
def test_rests_are_cut_into_powers_of_two(lengths):
    total = sum(lengths)
    cut = list(packing.in_powers([(k, 0, n) for k, n in enumerate(lengths)], 7, 1024))
    sizes: dict[int, int] = {}
    for key, start, length, sequence, offset in cut:
        assert offset == sizes.get(sequence, 0)
        sizes[sequence] = offset + length
    assert sum(sizes.values()) == total and all(n & (n - 1) == 0 for n in sizes.values()) and list(sizes) == list(range(7, 7 + len(sizes)))
    for key, n in enumerate(lengths):
        assert sum(p[2] for p in cut if p[0] == key) == n
    full = list(packing.in_powers([("a", 0, 9), ("b", 3, 3)], 0, 12))
    assert full == [("a", 0, 9, 0, 0), ("b", 3, 3, 0, 9)]


def check(rows, texts, limits, library):
    """texts: (id, text); ids may repeat."""
    coded = [(d, [*library.encode(t or "", add_special_tokens=False).ids, 0]) for d, t in texts]
    sequences: dict[int, list] = {}
    by: dict = {}
    for r in rows:
        sequences.setdefault(r.sequence_id, []).append(r)
        by.setdefault(r.doc_id, []).append(r)
    for pieces in sequences.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= limits.tokens and len(pieces) <= limits.segments and sum(r.loss_tokens for r in pieces) <= limits.loss
    assert sum(r.length for r in rows) == sum(len(i) for _, i in coded)
    for d, ids in coded:
        if sum(1 for x, _ in coded if x == d) == 1:
            at = 0
            for r in sorted(by[d], key=lambda r: r.start):
                assert (r.start, r.doc_tokens) == (at, len(ids))
                assert r.ids_crc32 == zlib.crc32(np.array(ids[at : at + r.length], "<u4").tobytes())
                at += r.length
            assert at == len(ids)
    assert sorted(sequences) == list(range(len(sequences)))
    return [sum(r.length for r in p) for p in sequences.values()]


def test_op11_on_whole_tables(spark):
    library = Tokenizer.from_file(PATH)
    texts = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    sizes = check(QUERIES["op11_packing"](spark, SF).collect(), texts, packing.Limits(), library)
    short = [n for n in sizes if n != 1024]
    assert all(n & (n - 1) == 0 for n in short) and len(short) <= 11


@pytest.mark.parametrize("parts", [1, 3])
def test_odd_tables(spark, parts):
    library = Tokenizer.from_file(PATH)
    odd = [(1, None), (2, ""), (3, "x" * 9000), (3, "x" * 9000), (None, "a b c"), (4, "<|endoftext|>"), (5, "tie"), (6, "tie"), *((i, "") for i in range(10, 210))]
    docs = spark.createDataFrame([(d, t, i, "clash") for i, (d, t) in enumerate(odd)], "doc_id long, text string, length int, sequence string").repartition(parts)
    limits = packing.Limits(64, 4, 50)
    rows = packing.pack_documents(docs, PATH, limits, with_ids=True).collect()
    check(rows, odd, limits, library)
    assert all(zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32 and len(r.ids) == r.length for r in rows)
    assert packing.pack_documents(docs.limit(0), PATH).count() == 0
    prompts = docs.where("doc_id in (4, 5, 6)").withColumn("p", packing.F.lit(2))
    assert {(r.doc_id, r.loss_tokens) for r in packing.pack_documents(prompts, PATH, loss_from="p").collect()} == {(4, 1), (5, 1), (6, 1)}
