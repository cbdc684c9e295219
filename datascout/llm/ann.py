"""Approximate nearest neighbours with a hierarchical k-means tree.

The tree is fitted on a bounded sample and every vector is put into the leaf that greedy descent
reaches. A query walks the tree best-bin-first: a priority queue holds the branches not taken by
their distance, and leaves are opened in that order. How many leaves are opened is widened until the
recall of calibration queries, whose exact neighbours are found by a scan, reaches the target.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from datascout.llm.stage import shuffle_parts, staged

#: Vectors the tree is fitted on; queries that calibrate it; recall they have to reach.
SAMPLE, CALIBRATED, TARGET = 20_000, 100, 0.97
#: Children of an inner node; sampled vectors a leaf has at least; vectors it should hold.
BRANCHES, LEAF_SAMPLE, LEAF_ROWS = 8, 24, 500
#: Vectors of one leaf that one task compares.
CHUNK_ROWS = 50_000
#: Neighbours that a task holds before it hands them on.
HELD_ROWS = 1_000_000


def _kmeans(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 12) -> tuple[np.ndarray, np.ndarray]:
    centers = x[rng.choice(len(x), k, replace=False)]
    for _ in range(rounds):
        near = _distances(x, centers).argmin(1)
        centers = np.stack([x[near == i].mean(0) if (near == i).any() else centers[i] for i in range(k)])
    return centers, _distances(x, centers).argmin(1)


def _distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return (x * x).sum(1)[:, None] - 2 * x @ y.T + (y * y).sum(1)[None]


class Tree:
    """Inner nodes have the centers of their children; a child is a node (>= 0) or a leaf (~leaf)."""

    def __init__(self, sample: np.ndarray, leaf_size: int, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.centers: list[np.ndarray] = []
        self.children: list[list[int]] = []
        self.leaves = 0
        self.root = self._grow(sample, leaf_size, rng)

    def _grow(self, x: np.ndarray, leaf_size: int, rng) -> int:
        if len(x) > leaf_size and len(np.unique(x, axis=0)) >= BRANCHES:
            centers, near = _kmeans(x, BRANCHES, rng)
            if len(np.unique(near)) > 1:
                used = np.unique(near)
                node = len(self.centers)
                self.centers.append(centers[used])
                self.children.append([])
                self.children[node] = [self._grow(x[near == i], leaf_size, rng) for i in used]
                return node
        self.leaves += 1
        return ~(self.leaves - 1)

    def assign(self, x: np.ndarray) -> np.ndarray:
        """Leaf of each vector."""
        out = np.empty(len(x), np.int32)
        todo = [(self.root, np.arange(len(x)))]
        while todo:
            node, rows = todo.pop()
            if node < 0:
                out[rows] = ~node
            elif len(rows):
                near = _distances(x[rows], self.centers[node]).argmin(1)
                todo += [(child, rows[near == i]) for i, child in enumerate(self.children[node])]
        return out

    def visits(self, q: np.ndarray) -> Iterator[int]:
        """Leaves, best bin first."""
        queue = [(0.0, self.root)]
        while queue:
            _, node = heapq.heappop(queue)
            while node >= 0:
                d = ((self.centers[node] - q) ** 2).sum(1)
                best = int(d.argmin())
                for i, child in enumerate(self.children[node]):
                    if i != best:
                        heapq.heappush(queue, (float(d[i]), child))
                node = self.children[node][best]
            yield ~node


def valid_vectors(df: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(id, vec) of the vectors that take part: not null or zero, all components finite, and of the
    most frequent length (of equally frequent ones, the smallest)."""
    finite = ~F.exists("vec", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = df.select(F.col(id_col).alias("id"), F.col(vec_col).alias("vec")).where(
        F.col("vec").isNotNull() & finite & F.exists("vec", lambda x: x != 0)
    )
    common = rows.groupBy(F.size("vec").alias("n")).count().orderBy(F.desc("count"), "n").first()
    return rows.where(F.size("vec") == (common["n"] if common else 0))


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


def fit_tree(vectors: DataFrame, rows: int) -> Tree:
    """Fits on at most 2 * SAMPLE vectors, chosen by the hash of their ids."""
    one_in = max(1, rows // SAMPLE)
    taken = vectors.where(F.pmod(F.xxhash64("id"), F.lit(one_in)) == 0).limit(2 * SAMPLE).collect()
    sample = np.array([r["vec"] for r in taken], np.float64)
    return Tree(sample, max(LEAF_SAMPLE, len(sample) * LEAF_ROWS // max(rows, 1)))


def build_index(vectors: DataFrame, tree: Tree) -> DataFrame:
    """Every vector with its leaf."""
    kinds = {f.name: f.dataType for f in vectors.schema.fields}
    schema = T.StructType([T.StructField("id", kinds["id"]), T.StructField("vec", kinds["vec"]), T.StructField("leaf", T.IntegerType())])

    def run(batches):
        for b in batches:
            leaf = tree.assign(_matrix(b.column("vec"))) if b.num_rows else np.empty(0, np.int32)
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("vec"), pa.array(leaf)], ["id", "vec", "leaf"])

    return vectors.mapInArrow(run, schema)


def _spread(index: DataFrame, k: int) -> DataFrame:
    """The rows that can be results: of equal vectors those of the k + 1 smallest ids, a query's own id being
    one of them, and of each id k rows. WindowGroupLimit cuts the copies in the map tasks."""
    copies, ids = Window.partitionBy("vec", "id").orderBy("leaf"), Window.partitionBy("vec").orderBy("id")
    some = index.withColumn("copy", F.row_number().over(copies)).where(F.col("copy") <= k).drop("copy")
    return some.withColumn("place", F.dense_rank().over(ids)).where(F.col("place") <= k + 1).drop("place")


def _nearest(ids: np.ndarray, x: np.ndarray, q: np.ndarray, own, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k nearest rows of x to q by distance and id, without the query itself."""
    d = np.sqrt(((x - q) ** 2).sum(1))
    other = ids != own
    d, ids = d[other], ids[other]
    if len(d) > k:
        near = d <= np.partition(d, k - 1)[k - 1]
        d, ids = d[near], ids[near]
    order = np.lexsort((ids, d))[:k]
    return ids[order], d[order]


def _scan(batches: Iterator[pa.RecordBatch], queries: list[tuple], k: int) -> Iterator[pa.RecordBatch]:
    for b in batches:
        if not b.num_rows:
            continue
        ids, x, leaf = b.column("id").to_numpy(), _matrix(b.column("vec")), b.column("leaf").to_numpy()
        at = dict(zip(ids.tolist(), leaf.tolist()))
        for own, q in queries:
            near, d = _nearest(ids, x, np.array(q, np.float64), own, k)
            yield pa.RecordBatch.from_arrays(
                [pa.array([own] * len(near), pa.int64()), pa.array(near), pa.array(d), pa.array([at[i] for i in near.tolist()], pa.int32())],
                ["query_id", "vec_id", "score", "leaf"],
            )


def calibrate(rows: DataFrame, tree: Tree, total: int, k: int, target: float) -> int:
    """Leaves to open so that the calibration queries find `target` of their exact neighbours."""
    one_in = max(1, total // CALIBRATED)
    chosen = rows.where(F.pmod(F.xxhash64(F.col("id") + 1), F.lit(one_in)) == 0).limit(2 * CALIBRATED).collect()
    queries = [(r["id"], r["vec"]) for r in chosen]
    if not queries:
        return tree.leaves
    best = Window.partitionBy("query_id").orderBy("score", "vec_id")
    exact = (
        rows.mapInArrow(lambda b: _scan(b, queries, k), "query_id long, vec_id long, score double, leaf int")
        .withColumn("rank", F.row_number().over(best))
        .where(F.col("rank") <= k)
        .select("query_id", "leaf")
        .collect()
    )
    place = {own: {leaf: i for i, leaf in enumerate(tree.visits(np.array(q, np.float64)))} for own, q in queries}
    needed = sorted(place[r["query_id"]][r["leaf"]] + 1 for r in exact)
    return needed[min(len(needed) - 1, int(np.ceil(target * len(needed))))] if needed else tree.leaves


def _merged(found: list[tuple[np.ndarray, np.ndarray, np.ndarray]], k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k nearest of each query, of all that was found."""
    query, ids, d = (np.concatenate(c) for c in zip(*found))
    order = np.lexsort((ids, d, query))
    query, ids, d = query[order], ids[order], d[order]
    first = np.flatnonzero(np.concatenate(([True], query[1:] != query[:-1]))) if len(query) else np.empty(0, np.int64)
    sizes = np.diff(np.append(first, len(query)))
    kept = np.arange(len(query)) - np.repeat(first, sizes) < k
    return query[kept], ids[kept], d[kept]


def _search(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (leaf, chunk), queries first: yields the k nearest of each query in this task's
    leaves together. What is held meanwhile is handed on early if it is more than HELD_ROWS."""
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    size = 0

    def compare(queries, held):
        ids = np.concatenate([h[0] for h in held])
        x = np.concatenate([h[1] for h in held])
        for own, q in queries:
            near, d = _nearest(ids, x, q, own, k)
            yield np.full(len(near), own, np.int64), near, d

    def told(rows):
        return pa.RecordBatch.from_arrays([pa.array(c) for c in rows], ["query_id", "vec_id", "score"])

    now, queries, held = None, [], []
    for b in batches:
        if not b.num_rows:
            continue
        keys = list(zip(b.column("leaf").to_pylist(), b.column("chunk").to_pylist(), b.column("asks").to_pylist()))
        ids, x = b.column("id").to_numpy(), _matrix(b.column("vec"))
        cuts = [0, *(i for i in range(1, len(keys)) if keys[i] != keys[i - 1]), len(keys)]
        for a, z in zip(cuts, cuts[1:]):
            if keys[a][:2] != now:
                if queries and held:
                    found += compare(queries, held)
                now, queries, held = keys[a][:2], [], []
            if keys[a][2]:
                queries += zip(ids[a:z].tolist(), x[a:z])
            else:
                held.append((ids[a:z], x[a:z]))
            size = sum(len(f[0]) for f in found) if len(found) > 1000 else size
            if size > HELD_ROWS:
                found = [_merged(found, k)]
                size = len(found[0][0])
                if size > HELD_ROWS // 2:
                    yield told(found[0])
                    found, size = [], 0
    if queries and held:
        found += compare(queries, held)
    if found:
        yield told(_merged(found, k))


def nearest(
    df: DataFrame, is_query, k: int = 10, id_col: str = "vec_id", vec_col: str = "embedding", target: float = TARGET
) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found of each row for which `is_query` (a
    Column over `id_col`) holds, by Euclidean distance in double precision, ties to smaller ids.

    All rows but the query are candidates; fewer than k in all are returned whole. Vectors that are
    null, zero, of an unusual length, or hold null or non-finite components take no part; nor do null
    ids. Ids are integers; rows with one id count as that many candidates, none of which a query of
    that id finds. An id asks once, with the least of its vectors (by the first components that differ). Other columns are not read. An empty table gives an empty result.
    """
    spark, parts = df.sparkSession, shuffle_parts(df)
    vectors = valid_vectors(df.where(F.col(id_col).isNotNull()), id_col, vec_col)
    total = vectors.count()
    if not total:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    tree = fit_tree(vectors, total)
    index = staged(build_index(vectors, tree), "vectors")
    rows = staged(_spread(index, k), "candidates")
    counts = {r["leaf"]: r["count"] for r in rows.groupBy("leaf").count().collect()}  # one row a leaf of the fitted tree
    opened = calibrate(rows, tree, total, k, target)

    def routes(batches):
        for b in batches:
            where, leaves, chunks = [], [], []
            for i, q in enumerate(_matrix(b.column("vec")) if b.num_rows else []):
                met = 0
                for n, leaf in enumerate(tree.visits(q)):
                    if n >= opened and met > k:
                        break
                    held = counts.get(leaf, 0)
                    met += held
                    pieces = -(-held // CHUNK_ROWS)
                    where += [i] * pieces
                    leaves += [leaf] * pieces
                    chunks += range(pieces)
            some = b.take(pa.array(where, pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [some.column("id"), some.column("vec"), pa.array(leaves, pa.int32()), pa.array(chunks, pa.int32())], ["id", "vec", "leaf", "chunk"]
            )

    shape = T.StructType([*index.schema.fields, T.StructField("chunk", T.IntegerType())])
    asked = index.where(is_query(F.col("id"))).groupBy("id").agg(F.min("vec").alias("vec")).mapInArrow(routes, shape)
    pieces = spark.createDataFrame([(leaf, -(-n // CHUNK_ROWS)) for leaf, n in counts.items()], "leaf int, pieces int")
    stored = rows.join(F.broadcast(pieces), "leaf").withColumn("chunk", F.pmod(F.xxhash64("id"), F.col("pieces")).cast("int"))
    both = asked.withColumn("asks", F.lit(True)).unionByName(stored.drop("pieces").withColumn("asks", F.lit(False)))
    found = (
        both.repartition(parts, "leaf", "chunk")
        .sortWithinPartitions("leaf", "chunk", F.desc("asks"))
        .mapInArrow(lambda b: _search(b, k), "query_id long, vec_id long, score double")
    )
    best = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
