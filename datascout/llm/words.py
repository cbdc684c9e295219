"""Token ids of many texts at once: each distinct word of a batch is coded once, then gathered.

A byte-level BPE never joins across pieces, and a piece holds a space only at its start or in a run of
white space. So a space and what follows it up to the next space (a unit here) is coded alike wherever
it occurs, and a batch of texts is the numbers of its units, found by Arrow without a copy, and the
ids of its distinct units. Units and pieces that a worker has coded before are looked up in tables.
"""

from __future__ import annotations

import gc
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex

#: The public pattern of byte-level BPE that cuts a text into pieces: a fixed value.
PIECES = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Entries of a worker's tables; a full one keeps what its last batch used.
KEPT = 400_000
#: White space at the start (after the unit's space) or at the end of a unit.
SPACE = r"[\s\p{Z}\x0b\x1c-\x1f\x{85}]"
OPENS, CLOSES, PLAIN = f"^ (?:{SPACE}|$)", f"{SPACE}$", r"^ [^\s\p{Z}\x0b\x1c-\x1f\x{85}]"


def mask(found: pa.Array) -> np.ndarray:
    return found.to_numpy(zero_copy_only=False).astype(bool)


def spread(starts: np.ndarray, lengths: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """The places of the parts `wanted`, one part after the other."""
    n = lengths[wanted]
    return np.repeat(starts[wanted] - (np.cumsum(n) - n), n) + np.arange(n.sum())


class Parts:
    """Parts of different lengths, one after the other in one array."""

    def __init__(self, values: np.ndarray, lengths: np.ndarray):
        self.values, self.lengths = values, lengths
        self.starts = np.cumsum(lengths) - lengths

    def gather(self, wanted: np.ndarray) -> np.ndarray:
        return self.values[spread(self.starts, self.lengths, wanted)]

    def take(self, wanted: np.ndarray) -> Parts:
        return Parts(self.gather(wanted), self.lengths[wanted])

    def joined(self, other: Parts) -> Parts:
        return Parts(np.concatenate((self.values, other.values)), np.concatenate((self.lengths, other.lengths)))


def _take(column, wanted: np.ndarray):
    return column[wanted] if isinstance(column, np.ndarray) else column.take(pa.array(wanted) if isinstance(column, pa.Array) else wanted)


def _joined(a, b):
    if isinstance(a, Parts):
        return a.joined(b)
    return pa.concat_arrays([a, b]) if isinstance(a, pa.Array) else np.concatenate((a, b))


class Known:
    """What has been found for strings: columns (arrays or parts) in the order of the keys."""

    def __init__(self, keys: pa.Array | None = None, *columns):
        self.keys, self.columns = pa.array([], pa.large_string()) if keys is None else keys, columns

    def __getitem__(self, column: int):
        return self.columns[column]

    def take(self, wanted: np.ndarray) -> Known:
        return Known(self.keys.take(pa.array(wanted)), *(_take(c, wanted) for c in self.columns))

    def with_all(self, keys: pa.Array, find: Callable[[pa.Array], tuple], most: int = KEPT) -> tuple[Known, np.ndarray]:
        """(a table that has all of the distinct `keys`, their places there); `find` gives the columns
        of those that are new. Beyond `most` entries only those that these keys use are kept."""
        at = pc.fill_null(pc.index_in(keys, self.keys), -1).to_numpy().astype(np.int64)
        new = np.flatnonzero(at < 0)
        if not len(new):
            return self, at
        fresh = keys.take(pa.array(new))
        held = self
        if len(self.keys) + len(new) > most:
            used = np.flatnonzero(at >= 0)
            held = self.take(at[used])
            at[used] = np.arange(len(used))
        at[new] = len(held.keys) + np.arange(len(new))
        columns = find(fresh)
        if held.columns:
            columns = [_joined(a, b) for a, b in zip(held.columns, columns)]
        return Known(pa.concat_arrays([held.keys, fresh]), *columns), at

    def without_long(self, most: int = 64) -> Known:
        """The entries of short keys: whole texts are not worth keeping."""
        size = pc.binary_length(self.keys).to_numpy()
        return self if (size <= most).all() else self.take(np.flatnonzero(size <= most))


def units(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """(the units of all texts, how many each text has): a text's first unit has no space before it,
    and is empty where the text begins with a space or is empty. No data is copied."""
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    _, offsets, data = texts.buffers()
    ends = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    first, last = int(ends[0]), int(ends[-1])
    raw = np.frombuffer(data, np.uint8)[first:last] if last > first else np.empty(0, np.uint8)
    spaces = np.flatnonzero(raw == 32) + first
    # An unit begins at each text and at each space; of equal places, the text's comes first.
    begins = np.insert(spaces, np.searchsorted(spaces, ends[:-1], "left"), ends[:-1])
    counts = 1 + np.diff(np.searchsorted(spaces, ends, "left"))
    bounds = np.append(begins, last)
    return pa.LargeStringArray.from_buffers(len(begins), pa.py_buffer(bounds.astype(np.int64)), data or pa.py_buffer(b"")), counts


def cut(texts: pa.Array, whole: str | None = None) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """(distinct strings, their numbers text by text, how many each text has) that make up the texts and
    are coded alike anywhere. A text is one string where a space has white space, or nothing, on both
    sides, which makes it no border, or where a unit matches the pattern `whole`."""
    found, counts = units(texts)
    coded = found.dictionary_encode()
    numbers, distinct = coded.indices.to_numpy().astype(np.int64), coded.dictionary
    ends = np.cumsum(counts)
    opens, closes = (mask(pc.match_substring_regex(distinct, p))[numbers] for p in (OPENS, CLOSES))
    at = np.flatnonzero(closes[:-1] & opens[1:])
    owners = np.searchsorted(ends, at, "right")
    owners = owners[at + 1 < ends[owners]]
    if whole is not None:
        owners = np.append(owners, np.searchsorted(ends, np.flatnonzero(mask(pc.match_substring_regex(distinct, whole))[numbers]), "right"))
    owners = np.unique(owners)
    if not len(owners):
        return distinct, numbers, counts
    kept = np.ones(len(counts), bool)
    kept[owners] = False
    strings = pc.fill_null(texts, "").take(pa.array(owners)).cast(pa.large_string())
    keys = pa.concat_arrays([distinct, strings]).dictionary_encode()  # a text may equal a unit
    same = keys.indices.to_numpy().astype(np.int64)
    numbers = np.insert(same[numbers[np.repeat(kept, counts)]], np.cumsum(np.where(kept, counts, 0))[owners], same[len(distinct) :])
    return keys.dictionary, numbers, np.where(kept, counts, 1)


class WordCoder:
    """Ids of whole texts; `encode_pieces` gives the ids of distinct pieces, one after the other, and
    how many each has."""

    def __init__(self, encode_pieces: Callable[[list[str]], tuple[np.ndarray, np.ndarray]]):
        self.encode_pieces = encode_pieces
        # The first texts may have no pieces.
        self.pieces, self.known = Known(None, Parts(np.empty(0, "<i4"), np.empty(0, np.int64))), Known()
        self.find = regex.compile(PIECES).findall

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, their ends); null texts have none."""
        if not len(texts):
            return np.empty(0, "<i4"), np.empty(0, np.int64)
        gc.disable()  # many strings are made, no cycles
        try:
            keys, numbers, counts = cut(texts)
            table, places = self.known.with_all(keys, self.units)
        finally:
            gc.enable()
        self.known = table.without_long()
        wanted = places[numbers]
        total = np.concatenate(([0], np.cumsum(table[0].lengths[wanted])))
        return table[0].gather(wanted), total[np.cumsum(counts)]

    def units(self, keys: pa.Array) -> tuple[Parts]:
        """The ids of distinct strings that `cut` gives."""
        plain = mask(pc.match_substring_regex(keys, PLAIN)) & ~mask(pc.match_substring_regex(keys, CLOSES))
        plain &= mask(pc.equal(pc.count_substring(keys, " "), 1))
        easy, others = np.flatnonzero(plain), np.flatnonzero(~plain)
        # One text is cut: in it, only a unit's first piece begins with a space.
        pieces = self.find("".join(keys.take(pa.array(easy)).to_pylist()))
        firsts = np.flatnonzero(mask(pc.starts_with(pa.array(pieces, pa.large_string()), " ")))
        if len(firsts) != len(easy):
            raise RuntimeError("units were cut otherwise than in their texts")
        n = np.zeros(len(keys), np.int64)
        n[easy] = np.diff(np.append(firsts, len(pieces)))
        cut = [self.find(t) for t in keys.take(pa.array(others)).to_pylist()]
        n[others] = list(map(len, cut))
        coded = pa.array(pieces + [p for ps in cut for p in ps], pa.large_string()).dictionary_encode()
        self.pieces, at = self.pieces.with_all(coded.dictionary, lambda new: (Parts(*self.encode_pieces(new.to_pylist())),))
        wanted = at[coded.indices.to_numpy()]
        # From the order of cutting to that of the keys.
        order = np.concatenate((easy, others))
        begins = np.empty(len(keys), np.int64)
        begins[order] = np.cumsum(n[order]) - n[order]
        wanted = wanted[spread(begins, n, np.arange(len(keys)))]
        sums = np.concatenate(([0], np.cumsum(self.pieces[0].lengths[wanted])))
        ends = np.cumsum(n)
        return (Parts(self.pieces[0].gather(wanted), sums[ends] - sums[ends - n]),)
