"""N-gram Jaccard join by T-occurrence search.

1. *Index.* Every document becomes its set of distinct word shingles (64-bit hashes); equal sets are
   one class from here on. The postings of all sets are dealt to ranges of hashes, as sorted packed
   arrays, and each range counts how many documents hold each of its shingles.
2. *Survivors.* A set of n shingles needs ceil(0.75 n) that some other set holds too. The others
   have no partner, which leaves a small part of the classes.
3. *Regions.* Of each survivor the n - ceil(0.75 n) + 1 rarest shingles are its prefix: linked sets
   share one at least. Sets are tied to the first set of each prefix list (a star, not all pairs),
   and the connected regions are the places where links can be.
4. *DivideSkip* within a region: for each set, inverted lists are divided into the longest and the
   rest; the short ones are merged, counting occurrences, candidates with at least T - L are
   looked up by binary search in the L long ones, and those that reach T are linked. Sets that are
   in one component already are not compared. A region too large for a task is cut into blocks,
   and each pair of blocks whose sizes can be linked is a task of its own.
5. The links of all tasks are joined to components.

The k-way merge of the short lists is a counting merge in numpy rather than a heap of Python
objects: it visits the same postings and gives the same counts.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from datascout.llm.bpe import slices
from datascout.llm.components import components
from datascout.llm.stage import released, shuffle_parts, staged
from datascout.schema import ident

#: Bytes of text indexed at once in a task; bytes of text for each range of hashes.
BATCH_BYTES, RANGE_BYTES = 4_000_000, 6_000_000
#: Shingles of a region (or of a block of it) that one task holds.
TASK_SHINGLES = 1_500_000
#: Share of probed lists: the longer the lists, the fewer are merged.
PROBE_WEIGHT = 0.01
MIX = [np.uint64(m) for m in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)]

INDEXED = "bucket int, batch binary, ord int, doc_id {id}, class binary, n int, head binary, ords binary"
SURVIVOR = "class binary, n int, hashes binary, counts binary"


def words_of(text: str | None) -> list[bytes]:
    """Words of the text in UTF-8 with A-Z lower-cased: runs of anything but 0x20 and 0x09-0x0D."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def shingle_hashes(words: list[bytes], width: int = 5) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles; of fewer words, of the whole sequence."""
    if not words:
        return np.empty(0, np.uint64)
    if len(words) < width:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), len(words))], np.uint64)
    one = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    n = len(words) - width + 1
    mixed = one[:n] * MIX[0]
    for k in range(1, width):
        mixed ^= mixed >> np.uint64(29)
        mixed *= MIX[1]
        mixed += one[k : n + k]
    mixed ^= mixed >> np.uint64(32)
    mixed *= MIX[2]
    mixed ^= mixed >> np.uint64(29)
    return np.unique(mixed)


def class_of(hashes: np.ndarray) -> bytes | None:
    """128-bit name of a set; null for the empty set."""
    return hashlib.blake2b(hashes.tobytes(), digest_size=16).digest() if len(hashes) else None


def needed(n: int, percent: int) -> int:
    """Shingles that a set of n must share with any set that it is linked to."""
    return -(-percent * n // 100)


def pack(values: np.ndarray) -> bytes:
    """Compressed bytes of an array, one byte plane after the other."""
    planes = np.ascontiguousarray(values.view(np.uint8).reshape(len(values), values.itemsize).T)
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def unpack(data: bytes, kind) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    return np.ascontiguousarray(planes.reshape(np.dtype(kind).itemsize, -1).T).reshape(-1).view(kind)


def _gaps(hashes: np.ndarray) -> np.ndarray:
    return np.diff(hashes, prepend=np.uint64(0))


def _row(**values) -> dict:
    empty = dict.fromkeys(("bucket", "batch", "ord", "doc_id", "class", "n", "head", "ords"))
    return empty | values


def _index(batches: Iterator[pa.RecordBatch], ranges: int, width: int, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """A row per document (its class and size), and a row of postings per range of hashes."""
    bounds = np.array([(i << 64) // ranges for i in range(1, ranges)], np.uint64)
    task, number = TaskContext.get().partitionId(), 0
    for batch in batches:
        for part in slices(batch, "text", BATCH_BYTES):
            ids = part.column("doc_id")
            sets: list[np.ndarray] = []
            seen: dict[bytes | None, int] = {}
            classes: list[bytes | None] = []
            for text in part.column("text"):
                hashes = shingle_hashes(words_of(text.as_py()), width)
                name = class_of(hashes)
                if name is not None and name not in seen:
                    seen[name] = len(sets)
                    sets.append(hashes)
                classes.append(name)
            lengths = np.array([len(s) for s in sets], np.int64)
            key = hashlib.blake2b(b"".join(c or b"-" for c in classes) + f"{task} {number}".encode(), digest_size=16).digest()
            number += 1
            ords = [seen.get(c, -1) for c in classes]
            firsts = set()
            told = []
            for o in ords:  # the first document of a class names its size to the survivors' step
                told.append(None if o < 0 or o in firsts else key)
                firsts.add(o)
            docs = {
                "bucket": [(int.from_bytes(key[:4], "big") + i // 512) % ranges for i in range(len(ids))],
                "batch": told,
                "ord": ords,
                "doc_id": ids,
                "class": classes,
                "n": [int(lengths[o]) if o >= 0 else 0 for o in ords],
                "head": [None] * len(ids),
                "ords": [None] * len(ids),
            }
            yield pa.RecordBatch.from_pydict(docs, schema)
            if not sets:
                continue
            every = np.concatenate(sets)
            owner = np.repeat(np.arange(len(sets), dtype=np.uint32), lengths)
            order = np.argsort(every, kind="stable")
            every, owner = every[order], owner[order]
            cuts = [0, *np.searchsorted(every, bounds).tolist(), len(every)]
            rows = [
                _row(bucket=b, batch=key, head=pack(_gaps(every[a:z])), ords=pack(owner[a:z]))
                for b, (a, z) in enumerate(zip(cuts, cuts[1:]))
                if z > a
            ]
            yield pa.RecordBatch.from_pylist(rows, schema)


def _count(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Documents pass through; of the postings of a range, those of shingles that two documents at
    least hold remain, with that number."""
    held: dict[int, list[tuple[bytes, bytes, bytes]]] = {}
    for batch in batches:
        is_doc = batch.column("head").is_null()
        yield batch.filter(is_doc)
        rest = batch.filter(batch.column("head").is_valid())
        for bucket, key, head, ords in zip(*(rest.column(c).to_pylist() for c in ("bucket", "batch", "head", "ords"))):
            held.setdefault(bucket, []).append((key, head, ords))
    for bucket in list(held):
        rows = held.pop(bucket)
        hashes = [np.cumsum(unpack(head, np.uint64)) for _, head, _ in rows]
        # Each batch tells a hash once, with its number of documents there.
        folded = [np.unique(h, return_counts=True) for h in hashes]
        values, where, counts = np.unique(np.concatenate([h for h, _ in folded]), return_inverse=True, return_counts=True)
        totals = np.bincount(where, weights=np.concatenate([c for _, c in folded]), minlength=len(counts)).astype(np.int64)
        shared, totals = values[totals >= 2], totals[totals >= 2]
        if not len(shared):
            continue
        for (key, _, ords), h in zip(rows, hashes):
            at = np.minimum(np.searchsorted(shared, h), len(shared) - 1)
            kept = shared[at] == h
            if kept.any():
                owner = unpack(ords, np.uint32)[kept]
                number = np.minimum(totals[at[kept]], 2**32 - 1).astype(np.uint32)
                data = pack(h[kept])
                head = len(data).to_bytes(4, "little") + data + pack(number)
                yield pa.RecordBatch.from_pylist([_row(bucket=bucket, batch=key, head=head, ords=pack(owner))], schema)


def _survive(batches: Iterator[pa.RecordBatch], percent: int, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Rows sorted by batch, classes before postings; yields the sets that may have a partner."""

    def finish(names, sizes, parts):
        if not parts or not names:
            return None
        owner = np.concatenate([p[0] for p in parts])
        order = np.argsort(owner, kind="stable")
        owner, hashes, counts = owner[order], np.concatenate([p[1] for p in parts])[order], np.concatenate([p[2] for p in parts])[order]
        present, starts = np.unique(owner, return_index=True)
        rows = []
        for o, a, z in zip(present.tolist(), starts.tolist(), [*starts[1:].tolist(), len(owner)]):
            if z - a >= needed(sizes[o], percent):
                rows.append({"class": names[o], "n": sizes[o], "hashes": hashes[a:z].tobytes(), "counts": counts[a:z].tobytes()})
        return pa.RecordBatch.from_pylist(rows, schema) if rows else None

    now, names, sizes, parts = None, {}, {}, []
    for batch in batches:
        for key, o, name, n, head, ords in zip(*(batch.column(c).to_pylist() for c in ("batch", "ord", "class", "n", "head", "ords"))):
            if key != now:
                if made := finish(names, sizes, parts):
                    yield made
                now, names, sizes, parts = key, {}, {}, []
            if head is None:
                names[o], sizes[o] = name, n
            else:
                size = int.from_bytes(head[:4], "little")
                parts.append((unpack(ords, np.uint32), unpack(head[4 : 4 + size], np.uint64), unpack(head[4 + size :], np.uint32)))
    if made := finish(names, sizes, parts):
        yield made


def _prefixes(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """(shingle, node) for the rarest shingles of each set. Shingles of one document alone come
    first in that order; they are not stored, but take their places."""
    for batch in batches:
        hashes_out, nodes = [], []
        for name, n, data, counts in zip(*(batch.column(c).to_pylist() for c in ("class", "n", "hashes", "counts"))):
            hashes, counts = np.frombuffer(data, np.uint64), np.frombuffer(counts, np.uint32)
            length = n - needed(n, percent) + 1 - (n - len(hashes))
            first = hashes[np.lexsort((hashes, counts))[: max(0, length)]]
            hashes_out.append(first.view(np.int64))
            nodes.append(np.full(len(first), node_of(name), np.int64))
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(hashes_out)), pa.array(np.concatenate(nodes))], ["shingle", "node"])


def node_of(name: bytes) -> int:
    """Short name of a class, to draw regions; two classes with one name only widen a region."""
    return int.from_bytes(name[:8], "big", signed=True)


def link_sets(sizes: np.ndarray, sets: list[np.ndarray], percent: int, side: np.ndarray | None = None) -> np.ndarray:
    """For each set, the first set of its component. `sizes` ascend and count shingles that are not
    in `sets` too (nobody else holds those). With `side`, only links across sides are sought."""
    m = len(sets)
    label = np.arange(m)
    lengths = np.array([len(s) for s in sets])
    flat = np.concatenate(sets)
    _, term = np.unique(flat, return_inverse=True)
    owner = np.repeat(np.arange(m), lengths)
    order = np.argsort(term, kind="stable")  # inverted lists, each by ascending set
    lists, inside = owner[order], np.empty(len(order), np.int64)
    inside[order] = np.arange(len(order))
    list_start = np.concatenate(([0], np.cumsum(np.bincount(term))))[term]
    set_start = np.concatenate(([0], np.cumsum(lengths)))
    share = 100 + percent  # 100 i >= percent (a + b - i)  <=>  share i >= percent (a + b)
    for q in range(1, m):
        size = int(sizes[q])
        low = int(np.searchsorted(sizes, needed(size, percent)))
        if low >= q:
            continue
        mine = slice(set_start[q], set_start[q + 1])
        starts, ends = list_start[mine], inside[mine]  # the part of each list before q
        some = ends > starts
        starts, ends = starts[some], ends[some]
        least = -(-percent * (size + int(sizes[low])) // share)
        if len(starts) < least:
            continue
        spans = ends - starts
        probed = min(least - 1, int(least / (PROBE_WEIGHT * math.log2(spans.max() + 1) * 10 + 1)))
        by_span = np.argsort(spans, kind="stable")
        short, long = by_span[: len(spans) - probed], by_span[len(spans) - probed :]
        n = spans[short]
        place = np.repeat(starts[short] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        met = lists[place]
        count = np.bincount(met[met >= low] - low, minlength=q - low)
        open_ = np.flatnonzero(count >= least - probed)
        open_ = open_[label[open_ + low] != label[q]]
        if side is not None:
            open_ = open_[side[open_ + low] != side[q]]
        if not len(open_):
            continue
        count, open_ = count[open_], open_ + low
        for k in long:
            segment = lists[starts[k] : ends[k]]
            at = np.minimum(np.searchsorted(segment, open_), len(segment) - 1)
            count += segment[at] == open_
        for other in np.unique(label[open_[share * count >= percent * (size + sizes[open_])]]):
            a, b = sorted((int(other), int(label[q])))
            label[label == b] = a
    return label


def _link(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """Rows sorted by task, size and class; yields (class, first class of its component) links."""

    def finish(held):
        if len(held) < 2:
            return None
        names = [h[0] for h in held]
        side = np.array([h[3] for h in held])
        label = link_sets(
            np.array([h[1] for h in held], np.int64), [np.frombuffer(h[2], np.uint64) for h in held], percent, side if side.any() else None
        )
        pairs = [(names[i], names[a]) for i, a in enumerate(label.tolist()) if i != a]
        return pa.RecordBatch.from_arrays([pa.array(list(c), pa.binary()) for c in zip(*pairs)], ["u", "v"]) if pairs else None

    now, held = None, []
    for batch in batches:
        for task, name, n, data, side in zip(*(batch.column(c).to_pylist() for c in ("task", "class", "n", "hashes", "side"))):
            if task != now:
                if made := finish(held):
                    yield made
                now, held = task, []
            held.append((name, n, data, side))
    if made := finish(held):
        yield made


def _tasks(sets: DataFrame, percent: int) -> DataFrame:
    """Adds `task` and `side`: a region is one task, or a task for each pair of its blocks.

    Blocks are bands of sizes, in which each size is at least `percent` of the largest, cut further by hash.
    Linked sets are in the same band or in neighbouring ones."""
    band = F.floor(F.log(F.col("n")) / F.lit(math.log(100 / percent))).cast("long")
    banded = sets.withColumns({"band": band, "weight": (F.octet_length("hashes") / 8).cast("long")})
    whole = banded.groupBy("root").agg(F.sum("weight").alias("all"))
    bands = banded.groupBy("root", "band").agg(F.ceil(F.sum("weight") / TASK_SHINGLES).alias("k"))
    large = whole.where(F.col("all") > TASK_SHINGLES).select("root")
    near = bands.join(large, "root")
    pairs = (
        near.alias("a")
        .join(near.alias("b"), (F.col("a.root") == F.col("b.root")) & (F.col("b.band") - F.col("a.band")).isin(0, 1))
        .select(
            F.col("a.root").alias("root"), F.col("a.band").alias("low"), F.col("b.band").alias("high"),
            F.explode(F.sequence(F.lit(0).cast("long"), F.col("a.k") - 1)).alias("i"), F.col("b.k").alias("kb"),
        )
        .select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("kb") - 1)).alias("j"))
        .where((F.col("low") < F.col("high")) | (F.col("i") <= F.col("j")))
    )
    pairs = pairs.withColumn("task", F.xxhash64("root", "low", "high", "i", "j"))
    same = (F.col("low") == F.col("high")) & (F.col("i") == F.col("j"))
    ends = pairs.select("root", F.col("low").alias("band"), F.col("i").alias("block"), "task", F.lit(0).alias("side")).unionByName(
        pairs.where(~same).select("root", F.col("high").alias("band"), F.col("j").alias("block"), "task", F.lit(1).alias("side"))
    )
    small = banded.join(large, "root", "left_anti").withColumns({"task": F.col("root"), "side": F.lit(0)})
    cut = (
        banded.join(bands, ["root", "band"])
        .join(large, "root", "left_semi")
        .withColumn("block", F.pmod(F.xxhash64("class"), F.col("k")))
        .join(ends, ["root", "band", "block"])
    )
    wanted = ["task", "side", "class", "n", "hashes"]
    return small.select(*wanted).unionByName(cut.select(*wanted))


def _placed(docs: DataFrame, id_col: str, text_col: str, width: int, percent: int) -> DataFrame:
    """One row per row of `docs`: doc_id, class, n, root (the class that names its component; null
    for the empty set), component_id (the smallest id there)."""
    spark, parts = docs.sparkSession, shuffle_parts(docs)
    kind = docs.schema[id_col].dataType
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    total = rows.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    ranges = max(parts, -(-total // RANGE_BYTES))

    indexed = rows.limit(0).selectExpr(*(f"cast(null as {t}) as {c}" for c, t in (x.split() for x in INDEXED.format(id=kind.simpleString()).split(", ")))).schema
    arrow = to_arrow_schema(indexed)
    counted = staged(
        rows.mapInArrow(lambda b: released(_index(b, ranges, width, arrow)), indexed)
        .repartitionById(ranges, F.col("bucket"))
        .mapInArrow(lambda b: released(_count(b, arrow)), indexed),
        "shingles",
    )
    documents = counted.where("head is null").select("doc_id", "class", "n")
    survivor = spark.createDataFrame([], SURVIVOR).schema
    survivor_arrow = to_arrow_schema(survivor)
    found = (
        counted.where("batch is not null")
        .select("batch", "ord", "class", "n", "head", "ords")
        .repartition(ranges, "batch")
        .sortWithinPartitions("batch", F.desc(F.col("head").isNull()))
        .mapInArrow(lambda b: released(_survive(b, percent, survivor_arrow)), survivor)
    )
    survivors = staged(found.dropDuplicates(["class"]), "survivors")

    postings = survivors.mapInArrow(lambda b: released(_prefixes(b, percent)), "shingle long, node long")
    first = postings.groupBy("shingle").agg(F.min("node").alias("v"), F.count("*").alias("many")).where("many > 1").drop("many")
    stars = postings.join(first, "shingle").where("node != v").select(F.col("node").alias("u"), "v").distinct()
    regions = components(stars)
    node = F.conv(F.hex(F.col("class").substr(1, 8)), 16, -10).cast("long")
    placed = survivors.drop("counts").withColumn("node", node).join(regions, "node")
    dealt = _tasks(staged(placed.drop("node"), "regions"), percent).repartition(ranges, "task").sortWithinPartitions("task", "n", "class")
    links = components(dealt.mapInArrow(lambda b: released(_link(b, percent)), "u binary, v binary"))

    linked = documents.join(links.withColumnRenamed("node", "class"), "class", "left").withColumn("root", F.coalesce("root", "class"))
    least = linked.where("root is not null").groupBy("root").agg(F.min("doc_id").alias("component_id"))
    return linked.join(least, "root", "left").select("doc_id", "class", "n", "root", F.coalesce("component_id", "doc_id").alias("component_id"))


def jaccard_components(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 75
) -> DataFrame:
    """One row per row of `docs`: id, n_shingles, component_id (the smallest id that links reach).

    Two documents are linked when 100 * intersection >= percent * union of their sets of `width`-word
    shingles. A text with fewer words is one shingle; null texts and those without words have an
    empty set, are linked with nothing and are their own component. Equal rows are linked with each
    other. Null ids are returned but never name a component that has other ids. Other columns are
    not read. An empty table gives an empty result.
    """
    return _placed(docs, id_col, text_col, width, percent).select(
        F.col("doc_id").alias(id_col), F.col("n").cast("long").alias("n_shingles"), "component_id"
    )


#: Ids of copies up to which they are sent to all tasks instead of being joined by a shuffle.
SENT_IDS = 500_000


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 75) -> DataFrame:
    """The rows of `docs`, all columns, without near copies: of each component one row stays, that of
    the smallest id and, among rows of this id, the smallest text.

    Rows are decided one by one: an id may name several texts, and each is kept or left by its own
    component. Rows with null ids cannot be named and stay, as do those without words.
    """
    found = staged(_placed(docs, id_col, text_col, width, percent), "components").where("doc_id is not null")
    is_copy = F.col("root").isNotNull() & (F.col("doc_id") != F.col("component_id"))
    by_id = found.groupBy("doc_id").agg((F.count("*") > 1).alias("again"), F.max(is_copy).alias("copy")).where("again or copy")
    by_id = staged(by_id, "copies")
    # An id of one row decides it; the rows of a repeated id are told apart by their classes.
    copies = by_id.where("not again").select(F.col("doc_id").alias("__copy"))
    repeated = by_id.where("again").select(F.col("doc_id").alias("__again"))

    def sent(ids: DataFrame) -> DataFrame:
        return F.broadcast(ids) if ids.count() <= SENT_IDS else ids

    kept = docs.join(sent(copies), F.col(id_col) == F.col("__copy"), "left_anti")
    if repeated.isEmpty():
        return kept
    ids = sent(repeated)
    single = kept.join(ids, F.col(id_col) == F.col("__again"), "left_anti")
    several = docs.join(ids, F.col(id_col) == F.col("__again"), "left_semi")
    has_words = F.coalesce(F.col(text_col).rlike(r"[^ \t-\r]"), F.lit(False))

    @F.arrow_udf("binary")
    def class_named(texts: pa.Array) -> pa.Array:
        return pa.array([class_of(shingle_hashes(words_of(t.as_py()), width)) for t in texts], pa.binary())

    firsts = (
        found.where(F.col("root").isNotNull() & (F.col("doc_id") == F.col("component_id")))
        .select(F.col("doc_id").alias("__id"), F.col("class").alias("__of"), F.col("root").alias("__root"))
        .distinct()
    )
    named = several.where(has_words).withColumn("__class", class_named(F.col(text_col)))
    named = named.join(firsts, (F.col(id_col) == F.col("__id")) & (F.col("__class") == F.col("__of")))
    least = Window.partitionBy("__root").orderBy(text_col)
    chosen = named.withColumn("__nth", F.row_number().over(least)).where("__nth = 1").select(*[ident(c) for c in docs.columns])
    return single.unionByName(several.where(~has_words)).unionByName(chosen)
