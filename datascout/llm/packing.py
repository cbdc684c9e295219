"""Packing of instruction data: vector bin packing under limits on tokens, segments and loss-bearing tokens.

Every document is a demand vector (tokens, 1 segment, loss-bearing tokens), every open sequence a vector of
what is left of its limits. The next document of a sequence is, of those that fit whole, the one with
the greatest dot product of demand and remainder, each dimension weighted by its mean demand: where a
limit is scarce, documents that spend little of it come first. When none fits whole, a part of the
document with the greatest product fills the sequence up and its rest goes on as a document. Whole
sequences are cut off the front of longer documents first. A sequence that a limit closes early, and what a
task has left at its end, is cut into sequences of powers of two, which need no padding.

A task packs its own partition over a pool of bounded size; nothing is shuffled. Sequence ids follow
from the number of sequences of each partition.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from datascout.llm.bpe import slices
from datascout.llm.stage import released, staged
from datascout.llm.tokens import ended, encoder

#: Documents that wait in a task to be placed.
POOL = 256


@dataclass(frozen=True)
class Limits:
    """Of a sequence: tokens, segments, loss-bearing tokens."""

    tokens: int = 1024
    segments: int = 64
    loss: int = 1024

    def __post_init__(self):
        if min(self.tokens, self.segments, self.loss) < 1:
            raise ValueError("limits are at least 1")


class Packer:
    """Deals spans of documents to sequences. `place(key, start, length, sequence, offset)` is called
    for each piece, of one sequence after the other; sequences count from 0. `fill(key, start)` is
    called for each part of a document that is a sequence of its own."""

    def __init__(self, limits: Limits, place, fill, pool: int = POOL):
        self.limits, self.place, self.fill, self.most = limits, place, fill, pool
        # Of the waiting documents: tokens and loss-bearing tokens still to place, the place in the
        # document where they begin, the key, the loss counts.
        self.tokens, self.loss, self.starts = (np.zeros(pool, np.int64) for _ in range(3))
        self.keys: list = [None] * pool
        self.before: list[np.ndarray | None] = [None] * pool
        self.waiting, self.seen, self.all_tokens, self.all_loss = 0, 0, 0, 0
        self.sequence = 0
        self._open()

    def _open(self) -> None:
        self.offset, self.left = 0, self.limits.tokens
        self.left_segments, self.left_loss = self.limits.segments, self.limits.loss

    def add(self, key, length: int, loss_before: np.ndarray | None = None) -> None:
        """A document of `length` tokens. `loss_before[i]` counts its loss-bearing tokens before token
        i (length + 1 numbers); without it, every token bears loss."""
        start, whole = 0, self.limits.tokens
        while length - start >= whole and (whole if loss_before is None else loss_before[start + whole] - loss_before[start]) <= self.limits.loss:
            self.fill(key, start)
            start += whole
        if start == length:
            return
        if self.waiting == self.most:
            self._one()
        i, self.waiting = self.waiting, self.waiting + 1
        self.keys[i], self.starts[i], self.before[i] = key, start, loss_before
        self.tokens[i] = length - start
        self.loss[i] = length - start if loss_before is None else loss_before[-1] - loss_before[start]
        self.seen += 1
        self.all_tokens += int(self.tokens[i])
        self.all_loss += int(self.loss[i])

    def finish(self) -> None:
        while self.waiting:
            self._one()
        self._close()

    def _one(self) -> None:
        """Places documents until one of those that wait is done with."""
        before = self.waiting
        while self.waiting == before:
            tokens, loss = self.tokens[:before], self.loss[:before]
            # The demands of one document in units of the mean demand, times what is left in the same units;
            # every document asks for one segment.
            mean_tokens, mean_loss = self.all_tokens / self.seen, max(self.all_loss / self.seen, 1e-9)
            worth = tokens * (self.left / mean_tokens**2) + loss * (self.left_loss / mean_loss**2) + self.left_segments
            if self.left_segments:
                fits = (tokens <= self.left) & (loss <= self.left_loss)
                best = int((worth * fits).argmax())
                if fits[best]:
                    self._put(best, int(tokens[best]))
                    continue
            best = int(worth.argmax())
            length = self._part(best)
            if length:
                self._put(best, length)
            elif self.offset:
                self._close()
            else:
                raise RuntimeError("a token does not fit an empty sequence")

    def _part(self, i: int) -> int:
        """Tokens of document i that still fit the open sequence."""
        if not self.left_segments:
            return 0
        length = int(min(self.tokens[i], self.left))
        before = self.before[i]
        if before is None:
            return min(length, self.left_loss)
        start = int(self.starts[i])
        most = int(np.searchsorted(before, before[start] + self.left_loss, "right")) - 1 - start
        return min(length, most)

    def _put(self, i: int, length: int) -> None:
        start, before = int(self.starts[i]), self.before[i]
        spent = length if before is None else int(before[start + length] - before[start])
        self.place(self.keys[i], start, length, self.sequence, self.offset)
        self.left -= length
        self.left_segments -= 1
        self.left_loss -= spent
        self.offset += length
        if length < self.tokens[i]:
            self.starts[i] += length
            self.tokens[i] -= length
            self.loss[i] -= spent
        else:
            self.waiting -= 1
            last = self.waiting
            self.keys[i], self.before[i] = self.keys[last], self.before[last]
            self.starts[i], self.tokens[i], self.loss[i] = self.starts[last], self.tokens[last], self.loss[last]
            self.keys[last] = self.before[last] = None
        if not self.left:
            self._close()

    def _close(self) -> None:
        if self.offset:
            self.sequence += 1
            self._open()


def in_powers(pieces: list[tuple], sequence: int, tokens: int) -> Iterator[tuple]:
    """The pieces (key, start, length) of one sequence that is not full, cut into sequences whose lengths
    are powers of two, longest first: (key, start, length, sequence, offset) each."""
    total = sum(p[2] for p in pieces)
    if total == tokens:
        sizes = [total]
    else:
        sizes = [1 << b for b in range(total.bit_length() - 1, -1, -1) if total >> b & 1]
    k, offset = 0, 0
    for key, start, length in pieces:
        while length:
            part = min(length, sizes[k] - offset)
            yield key, start, part, sequence + k, offset
            start, length, offset = start + part, length - part, offset + part
            if offset == sizes[k]:
                k, offset = k + 1, 0


def pack_documents(
    docs: DataFrame, path: str, limits: Limits = Limits(), end_id: int | None = 0, loss_from: str | None = None,
    id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False,
) -> DataFrame:
    """Packs the token ids of all whole texts, each followed by `end_id`, into sequences under `limits`.

    Returns a row per piece: the id, start (ids of its document before it), length, ids_crc32 (of its ids as
    little-endian unsigned 32-bit integers), doc_tokens, loss_tokens, sequence_id and offset (its place in
    that sequence, from 0, without gaps), and with `with_ids` the ids. Sequence ids count from 0. A
    sequence that ends short of the limit of tokens has a power of two, so that it needs no padding.

    `loss_from` names a column with the number of characters of the text that bear no loss (a prompt); the
    tokens that begin there or later, and the end id, bear loss. Without it, or where it is null, all do.

    Null and empty texts are their end id alone (without one, they have no pieces). Equal rows and
    repeated or null ids are documents each. Other columns are not read. An empty table gives no rows.
    """
    kind = docs.schema[id_col].dataType
    columns = [F.col(id_col).alias("id"), F.col(text_col).alias("text"), *([F.col(loss_from).cast("long").alias("free")] if loss_from else [])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, coder = TaskContext.get().partitionId(), encoder(path)
        held: dict[int, tuple] = {}  # documents with pieces to place: id, ids, tokens not placed yet
        done: list[tuple] = []
        open_pieces: list[tuple] = []
        state = {"open": 0, "next": 0}  # the packer's number of the open sequence, the next number given

        def emit(key, start, length, sequence, offset):
            row, ids, left, before = held[key]
            spent = length if before is None else int(before[start + length] - before[start])
            done.append((row, start, length, zlib.crc32(ids[start : start + length].tobytes()), len(ids), spent, sequence, offset, ids[start : start + length] if with_ids else None))
            if left == length:
                del held[key]
            else:
                held[key] = (row, ids, left - length, before)

        def flush():
            for piece in in_powers(open_pieces, state["next"], limits.tokens):
                emit(*piece)
            total = sum(p[2] for p in open_pieces)
            state["next"] += (total > 0) if total == limits.tokens else total.bit_count()
            open_pieces.clear()

        def fill(key, start):
            emit(key, start, limits.tokens, state["next"], 0)
            state["next"] += 1

        def place(key, start, length, sequence, offset):
            if sequence != state["open"]:
                flush()
                state["open"] = sequence
            open_pieces.append((key, start, length))

        packer, number = Packer(limits, place, fill), 0
        for batch in batches:
            for rows in slices(batch, "text"):
                ids, ends = coder.encode(rows.column("text"))
                if end_id is not None:
                    ids, ends = ended(ids, ends, end_id)
                ids = ids.astype("<u4")
                texts = rows.column("text").to_pylist() if loss_from else None
                for i, found in enumerate(np.split(ids, ends[:-1])):
                    if not len(found):
                        continue
                    free = rows.column("free")[i].as_py() if loss_from else None
                    before = None if free is None else loss_before(coder, texts[i] or "", len(found), free)
                    held[number] = (rows.column("id").slice(i, 1), found.copy(), len(found), before)
                    packer.add(number, len(found), before)
                    number += 1
                if done:
                    yield rows_of(done, part, kind)
                    done = []
        packer.finish()
        flush()
        if done:
            yield rows_of(done, part, kind)

    def rows_of(done: list[tuple], part: int, kind) -> pa.RecordBatch:
        n = len(done)
        numbers = [pa.array([d[c] for d in done], pa.int64()) for c in range(1, 8)]
        arrays = [pa.concat_arrays([d[0] for d in done]), *numbers, pa.array([part] * n, pa.int32())]
        if with_ids:
            arrays.append(pa.array([d[8] for d in done], pa.list_(pa.int64())))
        return pa.RecordBatch.from_arrays(arrays, placed.names)

    long = T.LongType()
    placed = T.StructType(
        [T.StructField("id", kind)]
        + [T.StructField(n, long) for n in ("start", "length", "ids_crc32", "doc_tokens", "loss_tokens", "sequence", "offset")]
        + [T.StructField("part", T.IntegerType())]
        + ([T.StructField("ids", T.ArrayType(long))] if with_ids else [])
    )
    pieces = staged(docs.select(*columns).mapInArrow(lambda b: released(run(b)), placed), "packed")
    # One row a partition of the packing job.
    counts = pieces.groupBy("part").agg((F.max("sequence") + 1).alias("n")).orderBy("part").collect()
    firsts, total = [], 0
    for r in counts:
        firsts.append((r["part"], total))
        total += r["n"]
    firsts = F.broadcast(docs.sparkSession.createDataFrame(firsts, "part int, first long"))
    return pieces.join(firsts, "part").select(
        F.col("id").alias(id_col), "start", "length", "ids_crc32", "doc_tokens", "loss_tokens",
        (F.col("first") + F.col("sequence")).alias("sequence_id"), "offset", *(["ids"] if with_ids else []),
    )


def loss_before(coder, text: str, n: int, free: int) -> np.ndarray:
    """Loss-bearing tokens before each of n tokens: those that begin at character `free` or later, and the end id."""
    told = coder.tokenizer.encode(text, add_special_tokens=False).offsets
    bears = np.array([begin >= free for begin, _ in told] + [True] * (n - len(told)), np.int64)
    return np.concatenate(([0], np.cumsum(bears)))
