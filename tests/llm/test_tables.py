"""The registered queries that SQL does not check, on the smallest tables."""

import hashlib
import zlib

import numpy as np
import public_tokenizers
import pytest
from test_near import brute_components
from tokenizers import Tokenizer

import corpus_pipeline
from datascout.llm import decontaminate, queries, quality
from datascout.plans.registry import QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    return sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect())


@pytest.fixture(scope="module")
def ids(docs):
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    return [library.encode(t or "", add_special_tokens=False).ids for _, t in docs]


def test_token_ids(spark, docs, ids):
    want, start = [], 0
    for (d, _), i in zip(docs, ids):
        want.append((d, start, len(i) + 1, zlib.crc32(np.array([*i, 0], "<u4").tobytes())))
        start += len(i) + 1
    assert sorted(map(tuple, QUERIES["op1_token_ids"](spark, SF).collect())) == want


def test_bpe(spark, docs, ids):
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = [(d, len(i), sha(",".join(map(str, i))), sha(t)) for (d, t), i in zip(docs, ids)]
    assert sorted(map(tuple, QUERIES["op8_bpe"](spark, SF).collect())) == want


def test_jaccard(spark, docs):
    assert sorted(map(tuple, QUERIES["op10_jaccard_join"](spark, SF).collect())) == brute_components(docs)


def test_pipeline(spark, docs, ids):
    found = corpus_pipeline.run(spark, SF).collect()
    model = quality.fit_quality(spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet"))
    good = [(d, t) for d, t in docs if model.score(t) >= corpus_pipeline.ACCEPTED]
    single = {c for _, _, c in brute_components(good)}
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    sketches = decontaminate.Sketches(items, 5, 75)
    want = {d: t for d, t in good if d in single and not sketches.contained(t)}
    coded = {d: i for (d, _), i in zip(docs, ids)}
    assert {r.doc_id: r.text for r in found} == want and all(r.ids == coded[r.doc_id] and r.n_tokens == len(r.ids) for r in found)
    assert len(good) < len(docs) and len(want) < len(good)


def test_each_operator_has_its_query():
    assert {f"op{n}" for n in range(1, 14)} == {q.split("_")[0] for q in QUERIES if q.startswith("op")} and queries
