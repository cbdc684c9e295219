"""Perfect hashing and the alignment of two tokenizers."""

import hashlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from datascout.llm import align, bpe, perfect, queries  # noqa: F401
from datascout.plans.registry import QUERIES

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
SF = "/root/testdata/sf0.001"
ODD = [
    None, "", " ", "  ", "a", " a", "a ", "a  b", "a \n b", "x▁y z", "<|endoftext|> b <s> <unk>", "ﬁ Ⅷ …  x é", "中文 🙂🙂 don't",
    "a", "aaaa bbbb", "\x00 ﻿", "tab\t tab \t", "the the the", "line\nline two\n", "w" * 3000 + " " + "é" * 500, " " * 50, "a" + " " * 9 + "b",
]


@pytest.mark.parametrize("n", [0, 1, 2, 63, 5000])
def test_perfect_hash_numbers_keys_without_gaps(n):
    keys = np.random.default_rng(n).choice(1 << 40, n, replace=False)
    made = perfect.PerfectHash.of(keys)
    assert sorted(made.numbers(keys).tolist()) == list(range(n)) and made.size == n
    others = np.arange(1 << 41, (1 << 41) + 100)
    assert (made.numbers(others) < n).all()
    with pytest.raises(ValueError):
        perfect.PerfectHash.of(np.array([7, 7]))


def brute(rows):
    """Every link of every document, spelled out."""
    first, second = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    first.encode_special_tokens = True
    alphabet = bpe.byte_alphabet()
    shown, counts = [], Counter()
    for d, text in rows:
        led = (" " + (text or "")).encode()
        a = first.encode(" " + (text or ""), add_special_tokens=False).ids
        b = second.encode(text or "")
        bytes_a = [bytes(alphabet[c] for c in first.id_to_token(i)) for i in a]
        bytes_b = [bytes([int(p[3:5], 16)]) if second.is_byte(i) else p.replace("▁", " ").encode() for i in b for p in [second.id_to_piece(i)]]
        if not text or b"".join(bytes_a) != led or b"".join(bytes_b) != led:
            a, b = [], []
        ends_a, ends_b = np.cumsum([len(x) for x in bytes_a])[: len(a)], np.cumsum([len(x) for x in bytes_b])[: len(b)]
        ends = sorted({*ends_a.tolist()} & {*ends_b.tolist()})
        groups, i, j = [], 0, 0
        for e in ends:
            i2, j2 = int(np.searchsorted(ends_a, e, "right")), int(np.searchsorted(ends_b, e, "right"))
            groups.append((a[i:i2], b[j:j2]))
            i, j = i2, j2
        links = [(x, y) for xs, ys in groups for x in xs for y in ys]
        counts.update(set(links))
        text = ";".join(",".join(map(str, xs)) + "|" + ",".join(map(str, ys)) for xs, ys in groups)
        shown.append((d, len(a), len(b), len(groups), links, hashlib.sha256(text.encode()).hexdigest() if a else ""))
    best = Counter()
    for (x, _), n in counts.items():
        best[x] = max(best[x], n)
    return [(d, na, nb, g, len(ls), sum(counts[p] == best[p[0]] for p in ls), sum(counts[p] for p in ls), h) for d, na, nb, g, ls, h in shown]


def ordered(rows):
    return sorted((tuple(r) for r in rows), key=repr)


def test_op12_on_whole_tables(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    assert ordered(QUERIES["op12_cross_tokenizer"](spark, SF).collect()) == ordered(brute(rows))


@pytest.mark.parametrize("chunk, held, fan", [(1 << 20, 1 << 20, 16), (20, 5, 2)])
def test_odd_texts_in_one_and_many_chunks(spark, monkeypatch, chunk, held, fan):
    monkeypatch.setattr(align, "CHUNK_PAIRS", chunk)
    monkeypatch.setattr(align, "HELD_PAIRS", held)
    monkeypatch.setattr(align, "FAN_IN", fan)
    monkeypatch.setattr(align, "SLICE", 8)
    rows = [(None if i == 3 else i // 2, t) for i, t in enumerate(ODD * 2)]
    docs = spark.createDataFrame([(d, t, i, "clash") for i, (d, t) in enumerate(rows)], "doc_id long, text string, node int, pairs string").repartition(5)
    assert ordered(align.align_documents(docs, A, B).collect()) == ordered(brute(rows))


def test_no_documents_and_no_tokens(spark):
    docs = spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string")
    assert ordered(align.align_documents(docs, A, B).collect()) == [(1, 0, 0, 0, 0, 0, 0, ""), (2, 0, 0, 0, 0, 0, 0, "")]
    assert align.align_documents(docs.limit(0), A, B).count() == 0
