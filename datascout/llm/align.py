"""Cross-tokenizer alignment: which tokens of two tokenizers stand for the same bytes, and how often.

Both tokenizers give tokens of the same bytes. Where tokens of both end at one byte, the text is cut into
groups; tokens of one group are linked. In how many documents a pair of ids is linked is counted over
the whole corpus:

1. every task aligns its documents and writes its distinct pairs with their numbers of documents;
2. the distinct pairs of all tasks get a minimal perfect hash;
3. every task turns its numbers into a dense vector indexed by the hash; vectors are summed as a tree;
4. every task aligns its documents again and looks the counts up, verifying each key.

Hash, keys and counts are sent to all tasks in chunks of at most about CHUNK_PAIRS pairs (chosen by the
first id), 17 bytes each; a corpus with more pairs goes through step 4 once for each chunk. Both
tokenizers cut at spaces, so that what lies between two spaces is aligned once and then looked up.
"""

from __future__ import annotations

import functools
import gc
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from datascout.llm.bpe import byte_alphabet, slices
from datascout.llm.perfect import PerfectHash, mix
from datascout.llm.stage import released, staged
from datascout.llm.tokens import Encoder
from datascout.llm.words import Known, Parts, cut

CHUNK_PAIRS = 2_000_000
#: Entries of a dense vector in a row, and vectors that one task adds up.
SLICE, FAN_IN = 65_536, 16
#: Distinct pairs that a task holds before it writes them.
HELD_PAIRS = 2_000_000
#: The second tokenizer reads this character as a space.
MARK = "▁"
#: Units that the second tokenizer may join with their neighbours: a lone space, the character above.
JOINED = f"^ $|{MARK}"
ONE = np.int64(1)


class Aligner:
    """Both tokenizers' tokens of strings, and the groups they make."""

    def __init__(self, byte_path: str, piece_path: str):
        import sentencepiece

        self.first = Encoder(byte_path)
        self.first.tokenizer.encode_special_tokens = True
        self.second = sentencepiece.SentencePieceProcessor(model_file=piece_path)
        alphabet = byte_alphabet()
        added = {i: t.content.encode() for i, t in self.first.tokenizer.get_added_tokens_decoder().items()}
        names = [self.first.tokenizer.id_to_token(i) or "" for i in range(self.first.size)]
        self.sizes = np.array([len(added[i]) if i in added else len(n) for i, n in enumerate(names)], np.int64)
        if any(c not in alphabet for i, n in enumerate(names) if i not in added for c in n):
            raise ValueError(f"{byte_path} is not a byte-level vocabulary")
        pieces = self.second
        self.bytes = [
            bytes([int(pieces.id_to_piece(i)[1:-1], 16)]) if pieces.is_byte(i) else pieces.id_to_piece(i).replace(MARK, " ").encode()
            for i in range(pieces.get_piece_size())
        ]
        for i in range(len(self.bytes)):
            if pieces.is_unknown(i):
                self.bytes[i] = b"\xff"  # stands for no bytes of a text
        inner = [i for i in range(len(self.bytes)) if MARK in (p := pieces.id_to_piece(i))[1:] and p.strip(MARK)]
        self.apart = not inner  # no piece goes on over a space
        self.other_sizes = np.array([len(b) for b in self.bytes], np.int64)
        told = [f"{i}{mark}" for i in range(self.first.size) for mark in ",|"] + [f"{i}{mark}" for i in range(len(self.bytes)) for mark in ",;"]
        self.told = pa.array([t.encode() for t in told], pa.large_binary())

    def cut(self, texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
        """As `words.cut`, of each text after a space; null texts count as empty and give one empty string."""
        texts = pc.fill_null(texts, "").cast(pa.large_string())
        led = pc.if_else(pc.equal(texts, ""), texts, pc.binary_join_element_wise(pa.scalar("", pa.large_string()), texts, pa.scalar(" ", pa.large_string())))
        return cut(led, JOINED if self.apart else "^ ")

    def align(self, keys: pa.Array) -> dict:
        """Of strings that begin with a space (or are empty): `ok`, tokens of each (`a`, `b`), groups,
        links, the linked pairs as one integer each, and the digest string of the groups."""
        strings = keys.to_pylist()
        (coded,) = self.first.coder.units(keys)
        other = self.second.encode([s[1:] for s in strings], num_threads=1)
        n_b = np.array([len(x) for x in other], np.int64)
        size = pc.binary_length(keys).to_numpy().astype(np.int64)
        same = [not s or b"".join([self.bytes[i] for i in ids]) == s.encode() for s, ids in zip(strings, other)]
        a, n_a = coded.values.astype(np.int64), coded.lengths
        unit_a, unit_b = (np.repeat(np.arange(len(keys)), n) for n in (n_a, n_b))
        ok = np.array(same, bool) & (np.bincount(unit_a, self.sizes[a], len(keys)).astype(np.int64) == size) & (size > 0)
        b = np.array([i for x in other for i in x], np.int64)
        a, b, n_a, n_b, size = a[ok[unit_a]], b[ok[unit_b]], np.where(ok, n_a, 0), np.where(ok, n_b, 0), np.where(ok, size, 0)
        ends_a, ends_b = np.cumsum(self.sizes[a]), np.cumsum(self.other_sizes[b])
        ends = np.intersect1d(ends_a, ends_b, assume_unique=True)
        group_a, group_b = np.searchsorted(ends, ends_a), np.searchsorted(ends, ends_b)
        in_a, in_b = (np.bincount(g, minlength=len(ends)) for g in (group_a, group_b))
        owner = np.searchsorted(np.cumsum(size), ends, "left")
        groups = np.bincount(owner, minlength=len(keys))
        links = np.bincount(owner, in_a * in_b, len(keys)).astype(np.int64)
        wide = in_b[group_a]  # every first token meets all second tokens of its group
        first_b = (np.cumsum(in_b) - in_b)[group_a]
        pairs = np.repeat(a << 32, wide) | b[np.repeat(first_b - (np.cumsum(wide) - wide), wide) + np.arange(wide.sum())]
        # The digest string: tokens of both sides in the order of groups, each with the mark after it.
        base = np.cumsum(in_a + in_b) - in_a - in_b
        place_a = base[group_a] + np.arange(len(a)) - (np.cumsum(in_a) - in_a)[group_a]
        place_b = (base + in_a)[group_b] + np.arange(len(b)) - (np.cumsum(in_b) - in_b)[group_b]
        shown = np.empty(len(a) + len(b), np.int64)
        shown[place_a] = 2 * a + (np.append(group_a[1:], -1) != group_a)
        shown[place_b] = 2 * (self.first.size + b) + (np.append(group_b[1:], -1) != group_b)
        told = self.told.take(pa.array(shown))
        bounds = np.frombuffer(told.buffers()[1], np.int64)[: len(shown) + 1]
        stops = np.concatenate(([0], np.cumsum(n_a + n_b)))
        text = pa.Array.from_buffers(pa.large_binary(), len(keys), [None, pa.py_buffer(bounds[stops]), told.buffers()[2] or pa.py_buffer(b"")])
        return {"ok": ok | (size == 0) & np.array([not s for s in strings], bool), "a": n_a, "b": n_b, "groups": groups, "links": links, "pairs": Parts(pairs, links), "text": text}


@functools.lru_cache(maxsize=2)
def aligner(byte_path: str, piece_path: str) -> Aligner:
    return Aligner(byte_path, piece_path)


def chunk_of(first_ids: np.ndarray, chunks: int) -> np.ndarray:
    return (mix(first_ids, 977) % np.uint64(chunks)).astype(np.int64)


def _pair_rows(docs: DataFrame, paths: tuple[str, str]) -> DataFrame:
    """(node, pairs, counts): the distinct pairs of some documents of a task, and how many of them have each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool, known, node = aligner(*paths), Known(), TaskContext.get().partitionId()
        pairs, counts = np.empty(0, np.int64), np.empty(0, np.int64)

        def row():
            listed = lambda x: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), pa.array(x))
            return pa.RecordBatch.from_arrays([pa.array([node], pa.int64()), listed(pairs), listed(counts)], ["node", "pairs", "counts"])

        def columns(keys):
            found = tool.align(keys)
            return found["ok"], found["pairs"]

        for batch in batches:
            for part in slices(batch, "text"):
                gc.disable()
                keys, numbers, n = tool.cut(part.column("text"))
                table, places = known.with_all(keys, columns)
                gc.enable()
                wanted, owner = places[numbers], np.repeat(np.arange(len(n)), n)
                good = np.bincount(owner, ~table[0][wanted], len(n)) == 0
                each = np.unique((owner << 32 | wanted)[good[owner]])  # each string of a document once
                strings = each & 0xFFFFFFFF
                found = table[1].gather(strings)
                documents = np.repeat(each >> 32, table[1].lengths[strings])
                # Pairs get numbers, so that a document and a pair fit one integer.
                distinct, number = np.unique(found, return_inverse=True)
                held = np.unique(documents << 32 | number)
                met = np.bincount(held & 0xFFFFFFFF, minlength=len(distinct))
                pairs, inverse = np.unique(np.concatenate((pairs, distinct)), return_inverse=True)
                counts = np.bincount(inverse, np.concatenate((counts, met)), len(pairs)).astype(np.int64)
                known = table.without_long()
                if len(pairs) > HELD_PAIRS:
                    yield row()
                    pairs, counts = pairs[:0], counts[:0]
        if len(pairs):
            yield row()

    return docs.mapInArrow(lambda b: released(run(b)), "node long, pairs array<long>, counts array<long>")


def _summed(rows: DataFrame) -> DataFrame:
    """(slice, vector): the sums of the vectors of all nodes, added up as a tree of FAN_IN branches."""
    rows = staged(rows, "counts")
    while (rows.agg(F.max("node")).first()[0] or 0) > 0:
        def add(key, table):  # of at most FAN_IN vectors
            total = sum(v.values.to_numpy() for v in table.column("vector"))
            made = pa.ListArray.from_arrays(pa.array([0, len(total)], pa.int32()), pa.array(total))
            return pa.table([pa.array([k.as_py()], pa.int64()) for k in key] + [made], ["node", "slice", "vector"])

        dealt = rows.withColumn("node", F.floor(F.col("node") / FAN_IN))
        rows = staged(dealt.groupBy("node", "slice").applyInArrow(add, "node long, slice long, vector array<long>"), "counts")
    return rows.select("slice", "vector")


class PairCounts:
    """Counts of pairs: a perfect hash of them, the keys in its order, and which have their first id's highest."""

    def __init__(self, levels: list[np.ndarray], keys: np.ndarray, counts: np.ndarray):
        self.levels, self.keys, self.counts = levels, keys, counts
        first = keys >> 32
        most = np.zeros(int(first.max(initial=-1)) + 1, np.int64)
        np.maximum.at(most, first, counts)
        self.best = counts == most[first]

    def __getstate__(self):
        return self.levels, self.keys, self.counts, self.best

    def __setstate__(self, state):
        self.levels, self.keys, self.counts, self.best = state
        self.hash = PerfectHash(self.levels)

    def look(self, pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(count, whether it is its first id's highest) of each pair; 0 of a pair that is not there."""
        at = self.hash.numbers(pairs)
        there = at >= 0
        there[there] = self.keys[at[there]] == pairs[there]
        counts, best = np.zeros(len(pairs), np.int64), np.zeros(len(pairs), np.int64)
        counts[there], best[there] = self.counts[at[there]], self.best[at[there]]
        return counts, best


def count_pairs(docs: DataFrame, paths: tuple[str, str]) -> list[PairCounts]:
    """In how many documents each pair is linked, chunk by chunk. `docs` has a column `text`."""
    spark = docs.sparkSession
    rows = staged(_pair_rows(docs.select("text"), paths), "pairs")
    distinct = staged(rows.select(F.explode("pairs").alias("pair")).distinct(), "distinct")
    chunks = max(1, -(-distinct.count() // CHUNK_PAIRS))

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        told = [b.column("pair").to_numpy() for b in batches]
        keys = np.concatenate([np.empty(0, np.int64), *told])
        keys = keys[np.argsort(keys)]
        for c in range(chunks):
            own = keys[chunk_of(keys >> 32, chunks) == c]
            if len(own):
                made = PerfectHash.of(own)
                ordered = np.empty(len(own), np.int64)
                ordered[made.numbers(own)] = own
                levels = pa.ListArray.from_arrays(pa.array([0, len(made.levels)], pa.int32()), pa.array([x.tobytes() for x in made.levels], pa.binary()))
                yield pa.RecordBatch.from_arrays([pa.array([c]), levels, pa.array([ordered.tobytes()], pa.large_binary()).cast(pa.binary())], ["chunk", "levels", "keys"])

    # A chunk's keys are dealt by their first ids, as chunk_of does; a task may get several chunks.
    dealt = distinct if chunks == 1 else distinct.mapInArrow(_with_chunk(chunks), "chunk long, pair long")
    dealt = dealt.repartition(1) if chunks == 1 else dealt.repartition(chunks, "chunk").select("pair")
    hashes = staged(dealt.mapInArrow(build, "chunk long, levels array<binary>, keys binary"), "hashes")
    out = []
    for c in range(chunks):
        head = hashes.where(F.col("chunk") == c).first()
        if head is None:
            continue
        levels, keys = [np.frombuffer(x, np.uint64) for x in head["levels"]], np.frombuffer(head["keys"], np.int64)
        sent = spark.sparkContext.broadcast((levels, keys))

        def dense(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            levels, keys = sent.value
            hashed, total = PerfectHash(levels), np.zeros(len(keys), np.int64)
            for batch in batches:
                for pairs, counts in zip(batch.column("pairs"), batch.column("counts")):
                    pairs, counts = pairs.values.to_numpy(), counts.values.to_numpy()
                    at = hashed.numbers(pairs)
                    mine = at >= 0
                    mine[mine] = keys[at[mine]] == pairs[mine]
                    np.add.at(total, at[mine], counts[mine])
            node = TaskContext.get().partitionId()
            for k in range(0, len(total), SLICE) if total.any() else ():
                part = total[k : k + SLICE]
                made = pa.ListArray.from_arrays(pa.array([0, len(part)], pa.int32()), pa.array(part))
                yield pa.RecordBatch.from_arrays([pa.array([node], pa.int64()), pa.array([k // SLICE], pa.int64()), made], ["node", "slice", "vector"])

        vectors = _summed(rows.select("pairs", "counts").mapInArrow(dense, "node long, slice long, vector array<long>"))
        parts = sorted((r["slice"], r["vector"]) for r in vectors.collect())
        out.append(PairCounts(levels, keys, np.concatenate([np.array(v, np.int64) for _, v in parts])))
        sent.unpersist()
    return out


def _with_chunk(chunks: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs = batch.column("pair")
            yield pa.RecordBatch.from_arrays([pa.array(chunk_of(pairs.to_numpy() >> 32, chunks)), pairs], ["chunk", "pair"])

    return run


COUNTED = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum"]


def align_documents(docs: DataFrame, byte_path: str, piece_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per document: the id, n_a and n_b (tokens of the two tokenizers: a byte-level BPE file of the
    tokenizers library read after a space, and a sentencepiece model that adds one), n_groups, n_links,
    n_best (links whose pair is its first id's most frequent, ties included), count_sum (of the links'
    counts, in documents) and groups_sha256 (of `a1,a2|b1;a3|b2,b3`; empty without tokens).

    Strings of special tokens are plain text. Null and empty texts, and those whose bytes either
    tokenizer does not keep, have no tokens and count nowhere. Equal rows and repeated or null ids
    are documents each. Other columns are not read. An empty table gives no rows.
    """
    spark, paths = docs.sparkSession, (byte_path, piece_path)
    kind = docs.schema[id_col].dataType
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    chunks = count_pairs(texts, paths) or [PairCounts([], np.empty(0, np.int64), np.empty(0, np.int64))]
    if len(chunks) > 1:
        texts = staged(texts.withColumn("row", F.monotonically_increasing_id()), "rows")
    fields = [T.StructField("id", kind), *(T.StructField(n, T.LongType()) for n in COUNTED), T.StructField("groups_sha256", T.StringType())]
    if len(chunks) > 1:
        fields.append(T.StructField("row", T.LongType()))

    def looked_up(sent):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            tool, known, counted = aligner(*paths), Known(), sent.value

            def columns(keys):
                found = tool.align(keys)
                counts, best = counted.look(found["pairs"].values)
                owner = np.repeat(np.arange(len(keys)), found["pairs"].lengths)
                sums = [np.zeros(len(keys), np.int64) for _ in range(2)]
                np.add.at(sums[0], owner, best)
                np.add.at(sums[1], owner, counts)
                return np.stack([~found["ok"], found["a"], found["b"], found["groups"], found["links"], *sums], 1), found["text"]

            for batch in batches:
                for part in slices(batch, "text"):
                    gc.disable()
                    keys, numbers, n = tool.cut(part.column("text"))
                    table, places = known.with_all(keys, columns)
                    gc.enable()
                    wanted, bounds = places[numbers], np.concatenate(([0], np.cumsum(n)))
                    sums = np.concatenate((np.zeros((1, 7), np.int64), np.cumsum(table[0][wanted], 0)))
                    sums = np.diff(sums[bounds], axis=0)
                    sums[sums[:, 0] > 0] = 0
                    told = table[1].take(pa.array(wanted))
                    offsets, data = np.frombuffer(told.buffers()[1], np.int64)[: len(wanted) + 1], memoryview(told.buffers()[2] or b"")
                    cuts = offsets[bounds].tolist()
                    digests = ["" if not s else hashlib.sha256(data[a : z - 1]).hexdigest() for s, a, z in zip(sums[:, 1].tolist(), cuts, cuts[1:])]
                    known = table.without_long()
                    arrays = [part.column("id"), *(pa.array(sums[:, c]) for c in range(1, 7)), pa.array(digests, pa.string())]
                    if len(chunks) > 1:
                        arrays.append(part.column("row"))
                    yield pa.RecordBatch.from_arrays(arrays, [f.name for f in fields])

        return texts.mapInArrow(lambda b: released(run(b)), T.StructType(fields))

    passes = [looked_up(spark.sparkContext.broadcast(c)) for c in chunks]
    if len(passes) == 1:
        return passes[0].withColumnRenamed("id", id_col)
    every = functools.reduce(DataFrame.unionByName, passes)
    same = [F.first(c).alias(c) for c in ("id", "n_a", "n_b", "n_groups", "n_links")]
    told = every.groupBy("row").agg(*same, F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"), F.first("groups_sha256").alias("groups_sha256"))
    return told.select(F.col("id").alias(id_col), *COUNTED, "groups_sha256")
