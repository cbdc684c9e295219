"""Byte-level BPE: a backtracking encoder and an offset-table decoder.

Encoding a piece of text takes the longest vocabulary token that starts at each place (found by one
Aho-Corasick pass) and checks it against its left neighbour: two tokens may stand side by side only
if the merges would not have joined anything across their border. Where no token fits, the encoder
steps back and marks the place as dead, so each place is tried once: time linear in the piece.
Pieces are encoded once per worker while they stay in a bounded table.
"""

from __future__ import annotations

import functools
import json
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from datascout.llm.stage import released
from datascout.llm.words import WordCoder

#: Pairs of tokens whose border a worker has looked at and keeps.
CACHED_PAIRS = 250_000
#: Characters of text handled at once in a task.
BATCH_CHARS = 2_000_000
#: Ids decoded at once.
DECODED_IDS = 1 << 20


#: A character that is in no token: tokens are matched as the characters of their bytes.
SEPARATOR = chr(256)


def byte_alphabet() -> dict[str, int]:
    """The characters that stand for bytes in vocabulary files: printable bytes for themselves,
    the others, in order, for the characters from 256."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in printable]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(others)}


class Vocabulary:
    """Tables of one vocabulary file of the tokenizers library (model BPE, byte level)."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            told = json.load(f)
        model, before = told["model"], told["pre_tokenizer"]
        if model["type"] != "BPE" or before["type"] != "ByteLevel" or before["add_prefix_space"] or told["normalizer"]:
            raise ValueError(f"{path} is not a plain byte-level BPE vocabulary")
        added = {a["content"]: a["id"] for a in told["added_tokens"]}
        if any(a["single_word"] or a["lstrip"] or a["rstrip"] for a in told["added_tokens"]):
            raise ValueError("added tokens that strip or match whole words are not supported")
        alphabet = byte_alphabet()
        size = 1 + max([*model["vocab"].values(), *added.values()])
        self.bytes = [b""] * size
        ids = {}
        for token, i in model["vocab"].items():
            if token not in added:
                self.bytes[i] = bytes(alphabet[c] for c in token)
                ids[token] = i
        for token, i in added.items():
            self.bytes[i] = token.encode()
        self.added = added
        self.split_added = regex.compile("|".join(map(regex.escape, sorted(added, key=len, reverse=True)))) if added else None
        # Pair of tokens -> rank of the merge that joins them; token -> rank and parts of its merge.
        self.pair_rank: dict[tuple[int, int], int] = {}
        self.rank, self.parts = [-1] * size, [(0, 0)] * size
        for rank, merge in enumerate(model["merges"]):
            a, b = merge if isinstance(merge, list) else merge.split(" ")
            left, right, joined = ids[a], ids[b], ids[a + b]
            self.pair_rank[left, right] = rank
            self.rank[joined], self.parts[joined] = rank, (left, right)
        self.automaton = ahocorasick.Automaton()
        for token in ids.values():
            self.automaton.add_word(self.bytes[token].decode("latin-1"), (len(self.bytes[token]), token))
        self.automaton.make_automaton()
        self.lengths = np.array([len(b) for b in self.bytes], np.int64)
        self.offsets = np.concatenate(([0], np.cumsum(self.lengths)))
        self.blob = np.frombuffer(b"".join(self.bytes), np.uint8)
        # Of each token, the longest other token that begins it.
        own = {b: i for i, b in enumerate(self.bytes) if b and i not in added.values()}
        self.shorter = [-1] * size
        for token, i in own.items():
            self.shorter[i] = next((own[token[:k]] for k in range(len(token) - 1, 0, -1) if token[:k] in own), -1)
        self.sizes = self.lengths.tolist()
        self.compatible: dict[tuple[int, int], bool] = {}
        self.coder = WordCoder(self.encode_pieces)

    def fits(self, left: int, right: int) -> bool:
        """Whether the merges leave the border between two tokens alone.

        The merges of both tokens are undone from the last to the first; at each step the two
        parts at the border must not have been joined before the merge just undone. A merge on the
        left goes before one of equal rank on the right.
        """
        key = (left, right)
        found = self.compatible.get(key)
        if found is None:
            found, before = True, len(self.pair_rank)
            while True:
                joined = self.pair_rank.get((left, right), before)
                if joined < before:
                    found = False
                    break
                if self.rank[left] > self.rank[right]:
                    before, left = self.rank[left], self.parts[left][1]
                elif self.rank[right] >= 0:
                    before, right = self.rank[right] + 1, self.parts[right][0]
                else:
                    break
            if len(self.compatible) >= CACHED_PAIRS:
                self.compatible.clear()
            self.compatible[key] = found
        return found

    def encode_pieces(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all pieces, how many each has); one run of the automaton finds the tokens of all."""
        raw = [p.encode().decode("latin-1") for p in pieces]
        text = SEPARATOR.join(raw)
        longest = [0] * len(text)
        for last, (length, token) in self.automaton.iter(text):
            longest[last + 1 - length] = token  # a later end is a longer token
        out: list[int] = []
        counts, at = [], 0
        for piece in raw:
            found = self._piece(longest, at, at + len(piece))
            out += found
            counts.append(len(found))
            at += len(piece) + 1
        return np.array(out, "<i4"), np.array(counts, np.int64)

    def _piece(self, longest: list[int], start: int, end: int) -> list[int]:
        sizes, shorter, compatible = self.sizes, self.shorter, self.compatible
        token, at = longest[start], start
        if sizes[token] == end - start:
            return [token]
        out: list[int] = []
        dead: set[int] = set()
        while at < end:
            while token >= 0:
                if at + sizes[token] not in dead:
                    if not out:
                        break
                    fits = compatible.get((out[-1], token))
                    if self.fits(out[-1], token) if fits is None else fits:
                        break
                token = shorter[token]
            if token >= 0:
                out.append(token)
                at += sizes[token]
                token = longest[at] if at < end else 0
            else:
                dead.add(at)
                token = out.pop()
                at -= sizes[token]
                token = shorter[token]
        return out

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, their ends); null texts have none."""
        texts = pc.fill_null(texts, "")
        marked = np.zeros(len(texts), bool)
        for mark in self.added:
            marked |= pc.match_substring(texts, mark).to_numpy(zero_copy_only=False)
        if not marked.any():
            return self.coder.encode(texts)
        ids, ends = self.coder.encode(pc.if_else(pa.array(marked), pa.scalar("", texts.type), texts))
        parts = np.split(ids, ends[:-1])
        for i in np.flatnonzero(marked):
            text, found, at = texts[int(i)].as_py(), [], 0
            for m in self.split_added.finditer(text):
                found += [self.coder.encode(pa.array([text[at : m.start()]]))[0], [self.added[m[0]]]]
                at = m.end()
            parts[i] = np.concatenate([*found, self.coder.encode(pa.array([text[at:]]))[0]]).astype("<i4")
        return np.concatenate(parts), np.cumsum([len(x) for x in parts])

    def decode(self, ids: np.ndarray) -> bytes:
        """The bytes of the ids, gathered from one blob by the offset of each token."""
        return b"".join(self._gather(ids[i : i + DECODED_IDS]) for i in range(0, len(ids), DECODED_IDS))

    def texts(self, ids: np.ndarray, ends: np.ndarray) -> list[str]:
        """The texts of consecutive ids that end at `ends`."""
        data = self.decode(ids)
        cuts = np.concatenate(([0], np.cumsum(self.lengths[ids])))[np.concatenate(([0], ends))].tolist()
        return [data[a:z].decode("utf-8", "replace") for a, z in zip(cuts, cuts[1:])]

    def _gather(self, ids: np.ndarray) -> bytes:
        lengths = self.lengths[ids]
        ends = np.cumsum(lengths)
        source = np.repeat(self.offsets[ids] - (ends - lengths), lengths) + np.arange(ends[-1])
        return self.blob[source].tobytes()


@functools.lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def slices(batch: pa.RecordBatch, column: str, most: int = BATCH_CHARS) -> Iterator[pa.RecordBatch]:
    """Cuts a batch so that the values of `column` in each part have about `most` bytes (or items)
    together; one value alone may have more."""
    start, total = 0, 0
    for i, n in enumerate(_sizes(batch.column(column))):
        if i > start and total + n > most:
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += n
    if batch.num_rows > start:
        yield batch.slice(start)


def _sizes(values: pa.Array) -> np.ndarray:
    count = pc.list_value_length if pa.types.is_list(values.type) else pc.binary_length
    return pc.fill_null(count(values), 0).to_numpy(zero_copy_only=False)


def _with(df: DataFrame, added: dict[str, T.DataType], run, source: str) -> DataFrame:
    """`df` and new columns; those of the same names are replaced."""
    made = {n.lower() for n in added}
    wanted = [c for c in df.columns if c.lower() not in made]
    fields = [df.schema[c] for c in wanted] + [T.StructField(n, k) for n, k in added.items()]

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, made in run(batch):
                yield pa.RecordBatch.from_arrays([*(rows.column(c) for c in wanted), *made], names=[*wanted, *added])

    return df.select(*wanted, *([source] if source.lower() in made else [])).mapInArrow(lambda b: released(mapped(b)), T.StructType(fields))


def encode_texts(df: DataFrame, path: str, text_col: str = "text", into: str = "ids", decoded: str | None = None) -> DataFrame:
    """Adds the token ids of each whole text as array<int>, as the tokenizers library gives them
    with no added end tokens, truncation or padding. With ``decoded`` that column gets the text
    decoded from those ids, in the same pass.

    Null texts count as empty and have no ids. Strings of added tokens in a text become those
    tokens. Columns of any names pass through; those called as a new one are replaced. `path` names
    the vocabulary file, which every executor has to have.
    """

    def run(batch):
        v = vocabulary(path)
        for rows in slices(batch, text_col):
            ids, ends = v.encode(rows.column(text_col))
            made = [pa.ListArray.from_arrays(pa.array(np.concatenate(([0], ends)).astype(np.int32)), pa.array(ids))]
            if decoded:
                made.append(pa.array(v.texts(ids, ends), pa.string()))
            yield rows, made

    added = {into: T.ArrayType(T.IntegerType())} | ({decoded: T.StringType()} if decoded else {})
    return _with(df, added, run, text_col)


def decode_ids(df: DataFrame, path: str, ids_col: str = "ids", into: str = "decoded") -> DataFrame:
    """Adds the text of each array of token ids; bytes that are no UTF-8 become U+FFFD.

    Null arrays and null ids in them give no text; ids outside the vocabulary end the job.
    """

    def run(batch):
        v = vocabulary(path)
        for rows in slices(batch, ids_col):
            texts = []
            for ids in rows.column(ids_col):
                known = ids.values.drop_null().to_numpy() if ids.is_valid else np.empty(0, np.int32)
                texts.append(v.decode(known).decode("utf-8", "replace"))
            yield rows, [pa.array(texts, pa.string())]

    return _with(df, {into: T.StringType()}, run, ids_col)


def ids_text(ids: str = "ids"):
    """Decimal ids joined by commas."""
    return F.concat_ws(",", F.col(ids).cast("array<string>"))
