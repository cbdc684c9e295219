"""Benchmark decontamination: test items contained in documents, found by MinHash sketches.

Items are partitioned by size, documents are not: an item of n word shingles is sketched by its
n - ceil(0.75 n) + 1 smallest hashes. A document that contains 75 % of the item misses fewer than
that, so it holds one of them: no document is lost, however long it is. Each size class has a
threshold, the greatest hash of its sketches; of a document only hashes up to it are looked up.
Items found this way are compared shingle by shingle, as text.

The items are the stated query set. They go to the tasks in blocks of bounded size, one scan of the
documents each; documents are not shuffled.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from datascout.llm.bpe import slices
from datascout.llm.jaccard import MIX, needed
from datascout.llm.stage import released

#: Bytes of item text in one block.
BLOCK_BYTES = 4_000_000
BATCH_BYTES = 4_000_000
WORD = re.compile(r"\w+")


def item_words(text: str | None) -> list[str]:
    """Runs of letters, digits and underscores, in lower case."""
    return WORD.findall(text.lower()) if text else []


def rolled(words: list[str], width: int) -> np.ndarray:
    """Hash of the shingle at each place; empty if there are fewer words than `width`."""
    if len(words) < width:
        return np.empty(0, np.uint64)
    one = np.fromiter((xxhash.xxh64_intdigest(w) for w in words), np.uint64, len(words))
    return _roll(one, width)


def _roll(one: np.ndarray, width: int) -> np.ndarray:
    n = len(one) - width + 1
    mixed = one[:n] * MIX[0] + np.uint64(width)
    for k in range(1, width):
        mixed ^= mixed >> np.uint64(29)
        mixed *= MIX[1]
        mixed += one[k : n + k]
    mixed ^= mixed >> np.uint64(32)
    mixed *= MIX[2]
    return mixed ^ (mixed >> np.uint64(29))


class Sketches:
    """Sketches of a block of items, by shingle width and size class."""

    def __init__(self, items: list[tuple[object, str]], width: int, percent: int):
        self.ids, self.grams, self.hashes = [], [], []
        self.percent = percent
        entries: dict[tuple[int, int], list[tuple[int, int]]] = {}
        for item_id, text in items:
            words = item_words(text)
            if not words:
                continue
            w = min(width, len(words))
            hashes = np.unique(rolled(words, w))
            number = len(self.ids)
            self.ids.append(item_id)
            self.grams.append({tuple(words[i : i + w]) for i in range(len(words) - w + 1)})
            self.hashes.append(hashes)
            least = len(hashes) - needed(len(hashes), percent) + 1
            entries.setdefault((w, len(hashes).bit_length()), []).extend((int(h), number) for h in hashes[:least])
        self.classes: dict[int, list[tuple[np.uint64, np.ndarray, np.ndarray]]] = {}
        for (w, _), found in sorted(entries.items()):
            found.sort()
            sketch = np.array([h for h, _ in found], np.uint64)
            self.classes.setdefault(w, []).append((sketch[-1], sketch, np.array([i for _, i in found])))

    def contained(self, text: str | None) -> list[tuple[object, int, int]]:
        """(item id, shingles, shingles in the text) of the items that the text contains."""
        words = item_words(text)
        if not words or not self.ids:
            return []
        one = np.fromiter((xxhash.xxh64_intdigest(w) for w in words), np.uint64, len(words))
        out = []
        for w, classes in self.classes.items():
            if len(words) < w:
                continue
            here = _roll(one, w)
            found: set[int] = set()
            for threshold, sketch, owner in classes:
                low = here[here <= threshold]
                first, last = np.searchsorted(sketch, low, "left"), np.searchsorted(sketch, low, "right")
                for a, z in {(a, z) for a, z in zip(first[last > first].tolist(), last[last > first].tolist())}:
                    found.update(owner[a:z].tolist())
            for number in sorted(found):
                places = np.flatnonzero(np.isin(here, self.hashes[number])).tolist()
                shared = len({tuple(words[i : i + w]) for i in places} & self.grams[number])
                total = len(self.grams[number])
                if 100 * shared >= self.percent * total:
                    out.append((self.ids[number], total, shared))
        return out


def _blocks(items: DataFrame, id_col: str, text_col: str, width: int, percent: int) -> Iterator[Sketches]:
    rows = items.select(F.col(id_col).alias("i"), F.col(text_col).alias("t")).where(F.col("t").isNotNull())
    total = rows.agg(F.sum(F.octet_length("t").cast("long"))).first()[0] or 0
    count = max(1, -(-total // BLOCK_BYTES))
    for block in range(count):
        held = rows.where(F.pmod(F.xxhash64("i", "t"), F.lit(count)) == block).collect()
        yield Sketches([(r["i"], r["t"]) for r in held], width, percent)


def find_contained(
    docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id",
    item_text: str = "text", width: int = 5, percent: int = 75,
) -> DataFrame:
    """(doc id, item id, item_shingles, shared_shingles) for every document that contains `percent`
    of an item's distinct word shingles, in any places.

    An item with fewer words than `width` is one shingle of that many words. Null and wordless texts
    contain nothing and are contained nowhere. Equal documents and equal items are reported each.
    Other columns are not read. Without items or documents the result is empty.
    """
    spark = docs.sparkSession
    kinds = docs.schema[id_col].dataType, items.schema[item_id].dataType
    names = [id_col, item_id if item_id != id_col else f"{item_id}_of_item", "item_shingles", "shared_shingles"]
    schema = T.StructType([T.StructField(n, k) for n, k in zip(names, (*kinds, T.LongType(), T.LongType()))])
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    found = None
    for sketches in _blocks(items, item_id, item_text, width, percent):
        shared = spark.sparkContext.broadcast(sketches)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part in slices(batch, "text", BATCH_BYTES):
                    hits = [(i, *hit) for i, t in enumerate(part.column("text")) for hit in shared.value.contained(t.as_py())]
                    ids = part.column("id").take(pa.array([h[0] for h in hits], pa.int64()))
                    rest = [pa.array([h[c] for h in hits], k) for c, k in zip((1, 2, 3), arrow[1:])]
                    yield pa.RecordBatch.from_arrays([ids, *rest], names=names)

        arrow = to_arrow_schema(schema).types
        one = rows.mapInArrow(lambda b, run=run: released(run(b)), schema)
        found = one if found is None else found.unionByName(one)
    return found


def drop_contaminated(docs: DataFrame, items: DataFrame, text_col: str = "text", item_id: str = "item_id", item_text: str = "text", width: int = 5, percent: int = 75) -> DataFrame:
    """The rows of `docs`, all columns, whose text contains no item; null texts stay."""
    spark = docs.sparkSession
    for sketches in _blocks(items, item_id, item_text, width, percent):
        shared = spark.sparkContext.broadcast(sketches)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part in slices(batch, text_col, BATCH_BYTES):
                    yield part.filter(pa.array([not shared.value.contained(t.as_py()) for t in part.column(text_col)], pa.bool_()))

        docs = docs.mapInArrow(lambda b, run=run: released(run(b)), docs.schema)
    return docs
