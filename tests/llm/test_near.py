"""Jaccard join, components, nearest neighbours."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from datascout.llm import ann, jaccard, queries  # noqa: F401
from datascout.llm.components import components
from datascout.plans.registry import QUERIES


def shingles(text):
    words = jaccard.words_of(text)
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def brute_components(rows):
    sets = [shingles(t) for _, t in rows]
    parent = list(range(len(rows)))

    def top(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and 100 * both >= 75 * len(sets[i] | sets[j]):
                parent[top(i)] = top(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[top(i)] = min(least.get(top(i), d), d)
    return sorted((d, len(sets[i]), least[top(i)]) for i, (d, _) in enumerate(rows))


def corpus(seed, groups=12, hot=60):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    shared = rng.choices(words, k=40)
    texts = [None, "", " \t ", "One two", "one  TWO", "a b c d", "A b c d e", "é É ß", "\u00a0x y\u2003z"]
    for g in range(groups):
        base = rng.choices(words, k=rng.randint(8, 200))
        for _ in range(hot if g == 0 else rng.randint(1, 8)):
            copy = list(base)
            for _ in range(rng.randint(0, max(1, len(copy) // 25))):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            if rng.random() < 0.3:
                copy = copy[: int(len(copy) * rng.uniform(0.7, 1))]
            if rng.random() < 0.3:
                copy += shared
            texts.append(" ".join(copy))
    texts += [" ".join(rng.choices(words, k=30) + shared) for _ in range(40)] + texts[-20:]
    ids = rng.sample(range(10_000), len(texts))
    return list(zip(ids, texts))


@pytest.mark.parametrize("seed,size", [(1, 8_000_000), (2, 1500)])
def test_join_finds_the_links_of_all_pairs(spark, monkeypatch, seed, size):
    monkeypatch.setattr(jaccard, "TASK_SHINGLES", size)  # the smaller cuts regions into blocks
    monkeypatch.setattr(jaccard, "BATCH_BYTES", 20_000)
    rows = corpus(seed)
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as class", "'x' as root", "2 as n").repartition(3)
    found = jaccard.jaccard_components(docs).collect()
    assert sorted(map(tuple, found)) == brute_components(rows)


def test_set_search_alone():
    rng = np.random.default_rng(4)
    base = rng.integers(0, 10_000, 60).astype(np.uint64)
    sets = sorted((np.unique(np.where(rng.random(60) < 0.12, rng.integers(0, 10_000, 60).astype(np.uint64), base)) for _ in range(80)), key=len)
    label = jaccard.link_sets(np.array([len(s) for s in sets]), sets, 75)
    rows = [(i, set(s.tolist())) for i, s in enumerate(sets)]
    want = list(range(80))
    for i, a in rows:
        for j, b in rows[:i]:
            if 100 * len(a & b) >= 75 * len(a | b) and want[i] != want[j]:
                x, y = sorted((want[i], want[j]))
                want = [x if w == y else w for w in want]
    assert label.tolist() == want and len(set(want)) < 80


def test_one_of_each_group_stays(spark):
    rows = corpus(3, groups=4, hot=10)
    docs = spark.createDataFrame([*rows, rows[-1], (None, "x"), (None, "x")], "doc_id long, text string").withColumn("class", F.lit(5))
    kept = jaccard.keep_one(docs)
    want = sorted(c for c in {c for _, _, c in brute_components(rows)})
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.where("doc_id is not null").collect()) == want
    assert kept.where("doc_id is null").count() == 2
    assert jaccard.keep_one(docs.limit(0)).count() == 0


@pytest.mark.parametrize("sent", [500_000, 0])
def test_rows_of_one_id_are_decided_one_by_one(spark, monkeypatch, sent):
    monkeypatch.setattr(jaccard, "SENT_IDS", sent)
    a, b, c, d = (" ".join(f"{x}{i}" for i in range(40)) for x in "abcd")
    near = {t: t + " more" for t in (a, b, d)}
    rows = [
        (5, a), (9, near[a]), (5, b), (3, near[b]),  # one id in two components, in one of them as a copy
        (5, c), (5, c), (5, c.upper()),  # a text of its own, repeated
        (7, d), (7, near[d]), (None, d), (8, d),  # both texts of an id in one component
        (5, None), (5, " \n"), (7, ""), (6, None), (4, "alone"),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"class": F.lit(5), "copy": F.lit(1)}).repartition(3)
    kept = jaccard.keep_one(docs)
    assert kept.columns == docs.columns
    want = [(5, a), (3, near[b]), (5, c.upper()), (7, d), (None, d), (5, None), (5, " \n"), (7, ""), (6, None), (4, "alone")]
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=str) == sorted(want, key=str)


@pytest.mark.parametrize("kind", ["long", "string"])
def test_components(spark, kind):
    rng = random.Random(5)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(i, i + 1) for i in range(1000, 1100)] + [(7, 7), (None, 1)]
    name = (lambda i: i) if kind == "long" else (lambda i: i if i is None else f"{i:05}")
    found = dict(map(tuple, components(spark.createDataFrame([tuple(map(name, e)) for e in edges], f"u {kind}, v {kind}").repartition(4)).collect()))
    parent = {}
    for u, v in edges:
        if u is not None and u != v:
            a, b = (parent.setdefault(x, {x}) for x in (u, v))
            if a is not b:
                a |= b
                for x in b:
                    parent[x] = a
    assert found == {name(x): name(min(s)) for x, s in parent.items()}


def exact(rows, k):
    ok = [(i, np.array(v, float)) for i, v in rows if v is not None and None not in v and np.isfinite(v).all() and any(v) and len(v) == 8]
    out = {}
    for q, x in ok:
        if q % 10 == 0:
            near = sorted((float(np.sqrt(((x - y) ** 2).sum())), i) for i, y in ok if i != q)[:k]
            out[q] = [(n, i, d) for n, (d, i) in enumerate(near, 1)]
    return out


@pytest.mark.parametrize("count,k", [(600, 10), (6, 10), (0, 10)])
def test_neighbours(spark, monkeypatch, count, k):
    monkeypatch.setattr(ann, "LEAF_ROWS", 40)
    monkeypatch.setattr(ann, "LEAF_SAMPLE", 10)
    monkeypatch.setattr(ann, "CHUNK_ROWS", 25)
    rng = np.random.default_rng(6)
    centers = rng.normal(size=(6, 8))
    rows = [(i, (centers[i % 6] + 0.3 * rng.normal(size=8)).astype(np.float32).tolist()) for i in range(count)]
    rows += [(1000 + i, rows[0][1]) for i in range(200)] if count > 100 else []
    odd = [None, [0.0] * 8, [1.0] * 7 + [None], [float("nan")] * 8, [float("inf")] * 8, [1.0, 2.0]]
    rows += [(2000 + 10 * i, v) for i, v in enumerate(odd)]
    table = spark.createDataFrame([(i, v, 1, "x") for i, v in rows], "vec_id long, embedding array<float>, leaf int, id string")
    found = {}
    for r in ann.nearest(table, lambda i: i % 10 == 0, k).collect():
        found.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    want = exact(rows, k)
    assert set(found) == set(want) if count else not found
    hits = total = 0
    for q, near in want.items():
        got = sorted(found[q])
        assert [n for n, _, _ in got] == list(range(1, len(near) + 1))
        hits += len({i for _, i, _ in got} & {i for _, i, _ in near})
        total += len(near)
        assert got == sorted(got, key=lambda x: (x[2], x[1]))
    assert hits >= 0.9 * total


def test_best_bin_first_visits_each_leaf_once():
    rng = np.random.default_rng(7)
    x = rng.normal(size=(800, 5))
    tree = ann.Tree(x, 30)
    assert tree.leaves > 10 and sorted(tree.visits(x[3])) == list(range(tree.leaves))
    assert next(tree.visits(x[3])) == tree.assign(x[3:4])[0]


def test_repeated_rows_and_ids_leave_no_neighbour_out(spark):
    v, w, u = [1.0, 0.0], [0.0, 3.0], [1.0, 1.0]
    for rows in ([(0, v)] * 15 + [(5, v), (6, w)], [(0, v)] * 3 + [(5, v), (6, w)], [(0, v), (0, w), (5, v), (5, v), (6, w)], [(7, v)] * 9 + [(0, v), (6, u), (8, u)]):
        df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
        got = [tuple(r) for r in ann.nearest(df, lambda i: i == 0, k=3).orderBy("rank").collect()]
        own = min(x for i, x in rows if i == 0)
        near = sorted((float(np.sqrt(((np.array(x) - own) ** 2).sum())), i) for i, x in rows if i)[:3]
        assert got == [(0, k, i, d) for k, (d, i) in enumerate(near, 1)]


def test_op6_recall_on_whole_tables(spark):
    sf = "/root/testdata/sf0.001"
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    ids, x = np.array([i for i, _ in rows]), np.array([e for _, e in rows], np.float64)
    found = {}
    for r in QUERIES["op6_nearest"](spark, sf).collect():
        found.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    hits = 0
    asked = [i for i in ids if i % 100 == 0]
    for q in asked:
        d = np.sqrt(((x - x[ids == q][0]) ** 2).sum(1))
        best = [int(ids[j]) for j in np.lexsort((ids, d)) if ids[j] != q][:10]
        hits += len(set(best) & {i for _, i, _ in found[q]})
        assert all(s == d[ids == i][0] for _, i, s in found[q]) and sorted(k for k, _, _ in found[q]) == list(range(1, len(best) + 1))
    assert set(found) == set(asked) and hits >= 0.9 * 10 * len(asked)
