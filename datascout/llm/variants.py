"""Spelling variants: words of a corpus that differ by one letter, grouped under their commonest form.

Two words with one error have two of three parts in common: with the longer word's length c, cut c - 1 letters
into three parts; the error leaves two of them whole, counted from the start or, behind the error, from
the end. So the vocabulary is dealt out under three keys for each length, and only words of one key
are compared.

They are compared by a bit-sliced position index: for each position and letter, a bitset over the words of
a block. For a word, one letter after the other, two sets of all words of the block are kept in bits:
those without an error so far, and those with one - a replaced letter, at the same position, or an
inserted one, at the position shifted by one. A block's words are asked together, so each step is a
few operations on whole arrays.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from datascout.llm.bpe import slices
from datascout.llm.stage import released, staged

#: Words of a block that are compared at once, and rows of one key from which it is dealt to several tasks.
BLOCK, HOT_ROWS = 1024, 8192
#: Copies of the table of forms, so that words of a common form are looked up by several tasks.
SALTS = 8
LETTERS = 26 + 64  # a to z, U+00C0 to U+00FF
PARTS = 3


def _shift_tables() -> list[np.ndarray]:
    """For each power of two, tables of what that many zero bytes do to a CRC-32: (4, 256) each."""
    zero = np.array([zlib.crc32(b"\0", int(x) ^ 0xFFFFFFFF) ^ zlib.crc32(b"\0", 0xFFFFFFFF) for x in 1 << np.arange(32)], np.uint64)

    def tables(columns: np.ndarray) -> np.ndarray:
        out = np.zeros((4, 256), np.uint64)
        for byte in range(4):
            for bit in range(8):
                out[byte] ^= np.where(np.arange(256) >> bit & 1, columns[8 * byte + bit], np.uint64(0))
        return out

    made = []
    for _ in range(40):
        made.append(tables(zero))
        zero = _through(made[-1], zero)
    return made


def _through(tables: np.ndarray, x: np.ndarray) -> np.ndarray:
    return tables[0][x & 255] ^ tables[1][x >> 8 & 255] ^ tables[2][x >> 16 & 255] ^ tables[3][x >> 24 & 255]


SHIFTS = _shift_tables()


def crc_joined(first: np.ndarray, second: np.ndarray, length: np.ndarray) -> np.ndarray:
    """CRC-32 of strings put together, from those of the parts and the byte lengths of the second."""
    out = first.astype(np.uint64)
    for k in range(int(length.max(initial=0)).bit_length()):
        hit = length >> k & 1 == 1
        out[hit] = _through(SHIFTS[k], out[hit])
    return out ^ second.astype(np.uint64)


def runs(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """(maximal runs of the letters A-Z, a-z and U+00C0 to U+00FF, A-Z lower-cased; the text of each)."""
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    _, offsets, data = texts.buffers()
    ends = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    if ends[-1] == ends[0]:
        return pa.array([], pa.large_string()), np.empty(0, np.int64)
    raw = np.frombuffer(data, np.uint8)[ends[0] : ends[-1]]
    low = raw | 32
    letter = (low >= 97) & (low <= 122) & (raw < 128)
    two = raw == 0xC3  # the first byte of exactly U+00C0 to U+00FF
    letter |= two
    letter[1:] |= two[:-1]
    opens = letter.copy()
    opens[1:] &= ~letter[:-1]
    starts = ends[:-1] - ends[0]
    starts = starts[starts < len(raw)]
    opens[starts] |= letter[starts]
    kept = np.where(raw < 128, low, raw)[letter]
    at = np.flatnonzero(opens)
    bounds = np.append(np.cumsum(letter)[at] - 1, len(kept))
    words = pa.LargeStringArray.from_buffers(len(at), pa.py_buffer(bounds.astype(np.int64)), pa.py_buffer(kept))
    return words, np.searchsorted(ends[1:] - ends[0], at, "right")


def count_words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", drop_one_in: int | None = None, least_chars: int = 5, least: int = 3) -> DataFrame:
    """(word, n): the runs of letters of all whole texts with at least `least_chars` code points that occur
    `least` times or more.

    With `drop_one_in`, of each run whose unsigned CRC-32 h of `<id>:<run>` that number divides, the code
    point h % length is taken out first. Null texts have no words, a null id is an empty one, equal
    rows and repeated ids count each. Other columns are not read.
    """
    ids = F.coalesce(F.col(id_col).cast("string"), F.lit(""))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                found, owner = runs(part.column("text"))
                coded = found.dictionary_encode()
                words, numbers = coded.dictionary, coded.indices.to_numpy().astype(np.int64)
                changed: list[str] = []
                kept = np.ones(len(numbers), bool)
                if drop_one_in and len(numbers):
                    heads = np.array([zlib.crc32(f"{i}:".encode()) for i in part.column("id").to_pylist()], np.uint64)
                    listed = words.to_pylist()
                    crc = np.array([zlib.crc32(w.encode()) for w in listed], np.uint64)
                    size = pc.binary_length(words).to_numpy().astype(np.int64)
                    h = crc_joined(heads[owner], crc[numbers], size[numbers])
                    hit = np.flatnonzero(h % drop_one_in == 0)
                    kept[hit] = False
                    for word, x in zip((listed[i] for i in numbers[hit]), h[hit].tolist()):
                        at = x % len(word)
                        changed.append(word[:at] + word[at + 1 :])
                counts = np.bincount(numbers[kept], minlength=len(words))
                rows = pa.table({"word": pa.concat_arrays([words, pa.array(changed, pa.large_string())]), "n": np.append(counts, np.ones(len(changed), np.int64))})
                rows = rows.filter(pc.and_(pc.greater(rows["n"], 0), pc.greater_equal(pc.utf8_length(rows["word"]), least_chars)))
                yield from pa.table({"word": rows["word"].cast(pa.string()), "n": rows["n"]}).to_batches()

    counted = docs.select(ids.alias("id"), F.col(text_col).alias("text")).mapInArrow(lambda b: released(run(b)), "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least)


def part_keys(words: np.ndarray, c: int) -> list[list[str]]:
    """The keys of words of c or c - 1 letters under each of the three pairs of parts."""
    a, b = (c - 1) // 3, 2 * (c - 1) // 3
    return [
        [w[:b] for w in words],  # an error behind both
        [w[:a] + w[len(w) - (c - 1 - b) :] for w in words],  # between them
        [w[len(w) - (c - 1 - a) :] for w in words],  # before both
    ]


def letters(words: list[str], c: int) -> np.ndarray:
    """Letter numbers, one row a word, LETTERS behind its end."""
    out = np.full((len(words), c + 1), LETTERS, np.int16)
    for i, w in enumerate(words):
        code = np.frombuffer(w.encode("latin-1"), np.uint8).astype(np.int16)
        out[i, : len(code)] = np.where(code < 128, code - 97, code - 192 + 26)
    return out


def near_pairs(asked: list[str], block: list[str], c: int) -> tuple[np.ndarray, np.ndarray]:
    """(places in `asked`, places in `block`) of all pairs with one error: block words have c letters, those
    asked c (one is replaced) or c - 1 (one is inserted)."""
    asked_letters, n = letters(asked, c), len(block)
    block_letters = letters(block, c)
    size = np.array([len(w) for w in asked])
    width = -(-n // 64) * 64

    def bitsets(position: int) -> np.ndarray:
        """Of each letter, the words of the block that have it at the position."""
        out = np.zeros((LETTERS + 1, width), bool)
        out[block_letters[:, position], np.arange(n)] = True
        out[LETTERS] = False
        return np.packbits(out, axis=1, bitorder="little").view(np.uint64)

    everyone = np.packbits(np.arange(width) < n, bitorder="little").view(np.uint64)
    found = []
    for length in (c, c - 1):
        own = np.flatnonzero(size == length)
        if not len(own) or not n:
            continue
        exact = np.tile(everyone, (len(own), 1))  # no error so far
        one = np.zeros_like(exact) if length == c else exact.copy()  # one: replaced; or an inserted letter
        now = bitsets(0)
        for i in range(length):
            letter = asked_letters[own, i]
            same = now[letter]
            if length == c:
                one = (one & same) | (exact & ~same)
                exact &= same
                now = bitsets(i + 1) if i + 1 < length else now
            else:
                after = bitsets(i + 1)
                exact &= same
                one = exact | (one & after[letter])
                now = after
        bits = np.unpackbits(one.view(np.uint8), axis=1, bitorder="little")
        q, t = np.nonzero(bits)
        found.append((own[q], t))
    if not found:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])


class Block:
    """Words of one length c (and c - 1) and one kind of key, compared with each other."""

    def __init__(self, c: int, kind: int, words: list[str], counts: list[int], keys: list[str], sides: list[int]):
        self.c, self.kind, self.words, self.keys = c, kind, words, np.array(keys, object)
        self.counts, self.sides = np.array(counts, np.int64), np.array(sides, np.int64)

    def rows(self) -> Iterator[tuple[str, int, int, str]]:
        """(word, its near words here, n and word of the best of them)."""
        long = [i for i, w in enumerate(self.words) if len(w) == self.c]
        near: dict[int, list[int]] = {}
        for a in range(0, len(self.words), BLOCK):
            asked = range(a, min(a + BLOCK, len(self.words)))
            for b in range(0, len(long), BLOCK):
                block = long[b : b + BLOCK]
                q, t = near_pairs([self.words[i] for i in asked], [self.words[i] for i in block], self.c)
                q, t = q + a, np.array(block, np.int64)[t]
                here = self.keys[q] == self.keys[t]
                here &= (self.sides[q] != self.sides[t]) | (self.sides[q] < 0)
                q, t = q[here].tolist(), t[here].tolist()
                # A pair that an earlier kind of key brings together counts there.
                u, v = [self.words[i] for i in q], [self.words[i] for i in t]
                earlier = np.zeros(len(q), bool)
                for x, y in zip(part_keys(u, self.c)[: self.kind], part_keys(v, self.c)[: self.kind]):
                    earlier |= np.array([i == j for i, j in zip(x, y)], bool)
                for i, j, e in zip(q, t, earlier.tolist()):
                    if not e:
                        near.setdefault(i, []).append(j)
                        if len(self.words[i]) < self.c:
                            near.setdefault(j, []).append(i)
        for i, others in near.items():
            best = min(others, key=lambda j: (-self.counts[j], self.words[j]))
            yield self.words[i], len(others), int(self.counts[best]), self.words[best]


def _near_rows(keyed: DataFrame) -> DataFrame:
    """(word, near, best_n, best): of each word the near words of each of its blocks. `keyed`: (c, kind, key, tile,
    side, word, n), all rows of a (c, kind, key, tile) in one task, in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def made(block):
            got = list(Block(block[0][0], block[0][1], [r[5] for r in block], [r[6] for r in block], [f"{r[2]}/{r[3]}" for r in block], [r[4] for r in block]).rows())
            kinds = (pa.string(), pa.int64(), pa.int64(), pa.string())
            return pa.RecordBatch.from_arrays([pa.array([g[c] for g in got], k) for c, k in enumerate(kinds)], ["word", "near", "best_n", "best"])

        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in range(7))):
                # A block holds whole keys of one length and kind.
                if held and (held[-1][:2] != row[:2] or held[-1][:4] != row[:4] and len(held) >= BLOCK):
                    yield made(held)
                    held = []
                held.append(row)
        if held:
            yield made(held)

    return keyed.mapInArrow(lambda b: released(run(b)), "word string, near long, best_n long, best string")


def near_words(words: DataFrame) -> DataFrame:
    """(word, n_near, best_n, best) of each word of (word, n) with near words: how many there are, and the
    one of largest n (ties: the smallest in code-point order)."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            by: dict[int, list[int]] = {}
            told, n = batch.column("word").to_pylist(), batch.column("n")
            for i, w in enumerate(told):
                by.setdefault(len(w), []).append(i)
                by.setdefault(len(w) + 1, []).append(i)
            for c, places in by.items():
                own = [told[i] for i in places]
                for kind, keys in enumerate(part_keys(own, c)):
                    fixed = [pa.array([x] * len(own), k) for x, k in ((c, pa.int32()), (kind, pa.int32()))]
                    yield pa.RecordBatch.from_arrays([*fixed, pa.array(keys), pa.array(own), n.take(pa.array(places))], ["c", "kind", "key", "word", "n"])

    key = ["c", "kind", "key"]
    dealt = words.select("word", "n").mapInArrow(deal, "c int, kind int, key string, word string, n long")
    # Keys of one word have no pairs; large ones are cut into pairs of sides, so that no task holds them whole.
    sizes = dealt.groupBy(*key).agg(F.count("*").alias("size"), F.max(F.char_length("word")).alias("longest"))
    sizes = staged(sizes.where("size > 1 and longest = c").drop("longest"), "keys")
    rows = dealt.join(sizes, key)
    parts = F.ceil(F.col("size") / HOT_ROWS).cast("int")
    side = F.pmod(F.xxhash64("word"), F.col("parts")).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.col("parts") - 1))
    hot = rows.where(F.col("size") > HOT_ROWS).withColumn("parts", parts).withColumn("own", side).select("*", other.alias("other"))
    # The tile (x, y) compares side x with side y; (x, x) one side with itself.
    hot = hot.select(*key, F.concat_ws(",", F.least("own", "other"), F.greatest("own", "other")).alias("tile"), F.when(F.col("own") == F.col("other"), -1).otherwise(F.col("own")).alias("side"), "word", "n")
    cold = rows.where(F.col("size") <= HOT_ROWS).select(*key, F.lit("").alias("tile"), F.lit(-1).alias("side"), "word", "n")
    every = cold.unionByName(hot)
    order = [*key, "tile"]
    found = _near_rows(every.repartition(*order).sortWithinPartitions(*order, "word"))
    best = F.min(F.struct((-F.col("best_n")).alias("less"), F.col("best").alias("word"))).alias("best")
    told = found.groupBy("word").agg(F.sum("near").alias("n_near"), best)
    return told.select("word", "n_near", (-F.col("best.less")).alias("best_n"), F.col("best.word").alias("best"))


def variant_forms(words: DataFrame, times: int = 2) -> DataFrame:
    """Words (word, n; each word once, of letters a-z and U+00C0 to U+00FF) with their forms: (word, form, root, n,
    n_near, form_n).

    Two words are near if they differ by one inserted, deleted or replaced letter. A word's form is its
    near word of largest n (ties: the smallest in code-point order), if that n is at least `times` its
    own n; else null. Root is the end of the chain of forms, n_near the number of near words. Every
    form is commoner than its word (`times` must be more than 1), so chains end.
    """
    if times < 2:
        raise ValueError("a form has to be commoner than its word")
    words = staged(words.select("word", "n"), "words")
    near = near_words(words).withColumnRenamed("word", "near_word")
    good = F.col("best_n") >= times * F.col("n")
    formed = words.join(near, F.col("word") == F.col("near_word"), "left").select(
        "word", F.when(good, F.col("best")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(good, F.col("best_n")).alias("form_n")
    )
    formed = staged(formed, "forms")
    # Only words that are forms are followed: each once, however many words it is the form of.
    heads = formed.where("form is not null").select(F.col("form").alias("head")).distinct()
    steps = staged(heads.join(formed.select("word", "form"), F.col("head") == F.col("word")).select("head", F.coalesce("form", "head").alias("to")), "steps")
    while True:
        ahead = steps.select(F.col("head").alias("via"), F.col("to").alias("next"))
        further = steps.join(_copied(ahead), _salted(F.col("to"), F.col("head"), "via")).select("head", F.col("next").alias("to"), (F.col("next") != F.col("to")).alias("moved"))
        further = staged(further, "steps")
        moved = further.where("moved").limit(1).count()
        steps = further.select("head", "to")
        if not moved:
            break
    rooted = formed.join(_copied(steps.withColumnRenamed("head", "via")), _salted(F.col("form"), F.col("word"), "via"), "left")
    return rooted.select("word", "form", F.coalesce("to", "word").alias("root"), "n", "n_near", "form_n")


def _copied(df: DataFrame) -> DataFrame:
    return df.withColumn("salt", F.explode(F.array(*map(F.lit, range(SALTS)))))


def _salted(wanted, own, name: str):
    """Equality with a column of a table that `_copied` has made, by a copy that depends on the row's own word."""
    return (wanted == F.col(name)) & (F.pmod(F.xxhash64(own), F.lit(SALTS)) == F.col("salt"))
