"""Token files: each document's ids as one small zstandard frame, all with one shared dictionary.

A file set below `path` has three tables:

* `dictionary` - one row: its bytes, their SHA-256, bytes per id, the end id;
* `blocks` - documents in ascending order, about a megabyte of frames a row: the frames one after
  the other, and an index of them (document ids, byte ends, token counts), the ids the block spans,
  the dictionary's hash, and the tokens of its part before it;
* `parts` - the tokens of all parts before each part.

A document is read from its block alone, by its place in the index. Spark's writers commit the
tables, so a lost executor costs its tasks and nothing else.
"""

from __future__ import annotations

import functools
import hashlib
import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from datascout.llm.bpe import slices
from datascout.llm.stage import released, shuffle_parts, staged
from datascout.llm.words import WordCoder, spread

#: The dictionary is trained on about so many documents of at most so many characters.
SAMPLED_DOCS, SAMPLED_CHARS = 2_000, 65_536
DICTIONARY_BYTES = 64 * 1024
BLOCK_BYTES = 1 << 20
#: Pieces handed to the library as one text.
JOINED_PIECES = 500


class Encoder:
    """Ids of texts by the tokenizers library; of each distinct piece once, while it is cached.

    Byte-level BPE never joins across pieces, so the ids of a text are those of its pieces. A text
    that holds the string of an added token is handed to the library whole.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.size = self.tokenizer.get_vocab_size()
        self.marks = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.coder = WordCoder(self._many)
        names = (self.tokenizer.id_to_token(i) or "" for i in range(self.size))
        self.spaced = np.array([n.startswith("\u0120") for n in names])  # the character for a space

    def _ids(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def _many(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all pieces, how many each has). Those that begin with a space are coded as one text, which
        the library cuts into the same pieces again: a token that begins with a space begins a piece."""
        joined = [i for i, p in enumerate(pieces) if p[0] == " " and len(p) > 1 and not p[1].isspace()]
        coded, lengths, order = [], [], []
        for k in range(0, len(joined), JOINED_PIECES):
            some = joined[k : k + JOINED_PIECES]
            (e,) = self.tokenizer.encode_batch_fast(["".join([pieces[i] for i in some])], add_special_tokens=False)
            ids = np.array(e.ids, "<i4")
            firsts = np.flatnonzero(self.spaced[ids])
            if len(firsts) == len(some):  # else the library's tables of characters differ here
                coded.append(ids)
                lengths.append(np.diff(np.append(firsts, len(ids))))
                order += some
        done = set(order)
        others = [i for i in range(len(pieces)) if i not in done]
        alone = [e.ids for e in self.tokenizer.encode_batch_fast([pieces[i] for i in others], add_special_tokens=False)]
        ids = np.concatenate([*coded, np.array([i for x in alone for i in x], "<i4")])
        n = np.concatenate([*lengths, np.array([len(x) for x in alone], np.int64)])
        back = np.argsort(np.array([*order, *others], np.int64))
        return ids[spread(np.cumsum(n) - n, n, back)], n[back]

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, their ends); null texts have none."""
        whole = np.zeros(len(texts), bool)
        for mark in self.marks:
            whole |= pc.fill_null(pc.match_substring(texts, mark), False).to_numpy(zero_copy_only=False)
        if not whole.any():
            return self.coder.encode(texts)
        ids, ends = self.coder.encode(pc.if_else(pa.array(whole), pa.scalar(None, texts.type), texts))
        parts = np.split(ids, ends[:-1])
        for i in np.flatnonzero(whole):
            parts[i] = np.array(self._ids(texts[int(i)].as_py()), "<i4")
        return np.concatenate(parts), np.cumsum([len(x) for x in parts])


@functools.lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


@functools.lru_cache(maxsize=2)
def _dictionary(data: bytes) -> zstandard.ZstdCompressionDict | None:
    return zstandard.ZstdCompressionDict(data) if data else None


def ended(ids: np.ndarray, ends: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """The ids with an end id after each text."""
    return np.insert(ids, ends, end_id), ends + np.arange(1, len(ends) + 1)


def _kind(width: int) -> str:
    return "<u2" if width == 2 else "<u4"


def train_dictionary(docs: DataFrame, path: str, text_col: str, width: int) -> bytes:
    """A dictionary from the serialized ids of a bounded sample of documents, chosen by their hash;
    empty if the sample is too small to train one."""
    sized = docs.select(F.col(text_col).alias("text")).where(F.char_length("text").between(1, SAMPLED_CHARS))
    one_in = max(1, sized.count() // SAMPLED_DOCS)
    rows = sized.where(F.pmod(F.xxhash64("text"), F.lit(one_in)) == 0).limit(2 * SAMPLED_DOCS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                ids, ends = encoder(path).encode(part.column("text"))
                raw = [i.astype(_kind(width)).tobytes() for i in np.split(ids, ends[:-1])]
                yield pa.RecordBatch.from_arrays([pa.array(raw, pa.binary())], ["ids"])

    samples = [bytes(r[0]) for r in rows.mapInArrow(run, "ids binary").collect()]
    if len(samples) < 100:
        return b""
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples).as_bytes()
    except zstandard.ZstdError:
        return b""


def write_tokens(docs: DataFrame, out: str, path: str, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encodes every whole text (null: empty), appends `end_id` and writes the tables below `out`.

    Documents are in ascending order of `id_col`, nulls first; of equal ids, by the checksum of
    their tokens. Equal rows are documents each. Other columns are not read. An empty table gives
    tables without blocks.
    """
    spark = docs.sparkSession
    width = 2 if max(encoder(path).size, end_id + 1) <= 1 << 16 else 4
    trained = train_dictionary(docs, path, text_col, width)
    digest = hashlib.sha256(trained).hexdigest()
    kind = docs.schema[id_col].dataType
    meta = "sha256 string, dictionary binary, width int, end_id int"
    spark.createDataFrame([(digest, bytearray(trained), width, end_id)], meta).coalesce(1).write.parquet(f"{out}/dictionary")

    def frames(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = zstandard.ZstdCompressor(level=3, dict_data=_dictionary(trained))
        for batch in batches:
            for part in slices(batch, "text"):
                ids, ends = ended(*encoder(path).encode(part.column("text")), end_id)
                data, cuts = ids.astype(_kind(width)).tobytes(), [0, *(width * ends).tolist()]
                raw = [data[a:z] for a, z in zip(cuts, cuts[1:])]
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("id"),
                        pa.array([zlib.crc32(r) for r in raw], pa.int64()),
                        pa.array([len(r) // width for r in raw], pa.int64()),
                        pa.array([packer.compress(r) for r in raw], pa.binary()),
                    ],
                    ["id", "tie", "n", "frame"],
                )

    framed = T.StructType(
        [T.StructField("id", kind), T.StructField("tie", T.LongType()), T.StructField("n", T.LongType()), T.StructField("frame", T.BinaryType())]
    )
    rows = staged(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(lambda b: released(frames(b)), framed), "frames")
    ordered = rows.repartitionByRange(shuffle_parts(docs), F.asc_nulls_first("id"), "tie").sortWithinPartitions(
        F.asc_nulls_first("id"), "tie"
    )

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number, before = TaskContext.get().partitionId(), 0, 0
        held: list[pa.RecordBatch] = []
        for batch in _chunks(batches):
            held.append(batch)
            if sum(b.column("frame").nbytes for b in held) >= BLOCK_BYTES:
                block, tokens = _block(held, part, number, before, digest)
                yield block
                held, number, before = [], number + 1, before + tokens
        if held:
            yield _block(held, part, number, before, digest)[0]

    block = T.StructType(
        [
            T.StructField("part", T.IntegerType()),
            T.StructField("block", T.LongType()),
            T.StructField("before", T.LongType()),
            T.StructField("n_tokens", T.LongType()),
            T.StructField("dictionary_sha256", T.StringType()),
            T.StructField("first_id", kind),
            T.StructField("last_id", kind),
            T.StructField("ids", T.ArrayType(kind)),
            T.StructField("ends", T.ArrayType(T.LongType())),
            T.StructField("counts", T.ArrayType(T.LongType())),
            T.StructField("frames", T.BinaryType()),
        ]
    )
    ordered.mapInArrow(blocks, block).write.parquet(f"{out}/blocks")
    # One row a partition.
    sums = spark.read.parquet(f"{out}/blocks").groupBy("part").agg(F.sum("n_tokens").alias("n")).orderBy("part").collect()
    starts, total = [], 0
    for r in sums:
        starts.append((r["part"], total))
        total += r["n"]
    spark.createDataFrame(starts, "part int, start long").coalesce(1).write.parquet(f"{out}/parts")


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield from slices(batch, "frame", BLOCK_BYTES // 4)


def _block(held: list[pa.RecordBatch], part: int, number: int, before: int, digest: str) -> tuple[pa.RecordBatch, int]:
    table = pa.Table.from_batches(held).combine_chunks()
    ids, counts = table.column("id").combine_chunks(), table.column("n").to_numpy()
    frames = table.column("frame").to_pylist()
    tokens = int(counts.sum())
    one = lambda value, kind: pa.array([value], kind)
    listed = lambda values: pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)
    arrays = [
        one(part, pa.int32()), one(number, pa.int64()), one(before, pa.int64()), one(tokens, pa.int64()), one(digest, pa.string()),
        ids.slice(0, 1), ids.slice(len(ids) - 1, 1), listed(ids), listed(pa.array(np.cumsum([len(f) for f in frames]), pa.int64())),
        listed(pa.array(counts, pa.int64())), one(b"".join(frames), pa.binary()),
    ]
    names = ["part", "block", "before", "n_tokens", "dictionary_sha256", "first_id", "last_id", "ids", "ends", "counts", "frames"]
    return pa.RecordBatch.from_arrays(arrays, names), tokens


def read_tokens(spark: SparkSession, out: str, where: Column | None = None) -> DataFrame:
    """One row per document, from the files: doc_id, start (tokens of all documents before it),
    n_tokens, ids (little-endian unsigned 32-bit). `where` picks blocks by first_id and last_id."""
    head = spark.read.parquet(f"{out}/dictionary").first()
    trained, digest, width = bytes(head["dictionary"]), head["sha256"], head["width"]
    if hashlib.sha256(trained).hexdigest() != digest:
        raise ValueError("the dictionary does not have its hash")
    blocks = spark.read.parquet(f"{out}/blocks")
    kind = blocks.schema["first_id"].dataType
    # One row a partition of the writing job.
    blocks = (blocks if where is None else blocks.where(where)).join(F.broadcast(spark.read.parquet(f"{out}/parts")), "part")
    wanted = blocks.select(
        "dictionary_sha256", (F.col("before") + F.col("start")).alias("start"), "ids", "ends", "counts", "frames"
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpacker = zstandard.ZstdDecompressor(dict_data=_dictionary(trained))
        for batch in batches:
            for b in range(batch.num_rows):
                sha, start, ids, ends, counts, frames = (batch.column(c)[b] for c in range(6))
                if sha.as_py() != digest:
                    raise ValueError("a block was written with another dictionary")
                data, ends, counts = frames.as_py(), ends.values.to_numpy(), counts.values.to_numpy()
                begins = np.concatenate(([0], ends[:-1]))
                raw = [unpacker.decompress(data[a:z]) for a, z in zip(begins, ends)]
                yield pa.RecordBatch.from_arrays(
                    [
                        ids.values,
                        pa.array(start.as_py() + np.cumsum(counts) - counts, pa.int64()),
                        pa.array(counts, pa.int64()),
                        pa.array([np.frombuffer(r, _kind(width)).astype("<u4").tobytes() for r in raw], pa.binary()),
                    ],
                    ["doc_id", "start", "n_tokens", "ids"],
                )

    schema = T.StructType(
        [T.StructField("doc_id", kind), T.StructField("start", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("ids", T.BinaryType())]
    )
    return wanted.mapInArrow(run, schema)


def read_document(spark: SparkSession, out: str, doc_id) -> DataFrame:
    """The document of one id: only blocks that span the id are opened, by the statistics of the files."""
    near = (F.col("first_id").isNull() | (F.col("first_id") <= doc_id)) & (F.col("last_id") >= doc_id)
    return read_tokens(spark, out, near).where(F.col("doc_id") == doc_id)
