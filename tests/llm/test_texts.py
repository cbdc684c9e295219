"""Chat formatting, BPE and token files."""

import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from datascout import runtime
from datascout.llm import bpe, chat, tokens, words

PATH = public_tokenizers.path("byte_bpe_50k.json")
ODD = [
    None, "", "\\### Assistant: </turn> ok", "####### <</turn>/turn> \\h\\\\s", "a\nb</turn>\n### user: x", "é" * 50, "\\", "</turn></turn>",
    "<|endoftext|>x<|endoftext|>", "  two  spaces\t\r\n\n end ", "don't 12345 ½ ʼn 中文 🙂🙂", "a" * 5000 + " " * 3000 + "=" * 999,
]
EVENTS = "conv_id long, turn long, seq long, kind string, role string, text string"


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def test_events_fold_into_messages(spark):
    rows = [
        (1, 0, 1, "message", "user", "hi"),
        (1, 1, 2, "message", "assistant", ""), (1, 1, 3, "delta", None, "he"), (1, 1, 4, "delta", None, "llo"),
        (1, 1, 5, "regenerate", None, "By"), (1, 1, 6, "delta", None, "e"),
        (1, 0, 7, "edit", None, "hey"),
        (1, 2, 8, "delta", "user", "no opening"), (1, 2, 8, "message", "user", "tie: the message goes first"),
        (2, None, 1, "odd kind", None, None), (2, 0, 1, "message", "user", "same"), (2, 0, 1, "message", "user", "same"),
        (None, 0, 1, "message", "user", "nobody"),
    ]
    found = chat.fold_events(spark.createDataFrame(rows[::-1], EVENTS)).collect()
    got = sorted(((r.conv_id or 0, -1 if r.turn is None else r.turn, r.nth, r.role, r.text) for r in found))
    assert got == [
        (0, 0, 1, "user", "nobody"),
        (1, 0, 1, "user", "hey"),
        (1, 1, 1, "assistant", "Bye"),
        (1, 2, 1, "user", "tie: the message goes firstno opening"),
        (2, -1, 1, "", ""),
        (2, 0, 1, "user", "same"),
        (2, 0, 2, "user", "same"),
    ]


def test_rendered_chats_read_back(spark):
    turns = [(7, i, i, "message", ["user", "assistant", "a: b\\c", None][i % 4], ODD[i % len(ODD)]) for i in range(200)]
    rows = turns + [(8, 0, 0, "message", "user", ODD[2]), (8, 1, 1, "message", "assistant", ODD[2])]
    events = spark.createDataFrame(rows[::-1], EVENTS).withColumns({"chunk": F.lit("clash"), "formatted": F.lit(1)})
    chats = chat.render_chats(chat.fold_events(events))
    read = chats.select("*", chat.read_turns(F.col("formatted")).alias("t"), chat.loss_text(F.col("formatted"), F.col("loss_spans")).alias("loss"))
    found = {r.conv_id: r for r in read.collect()}
    want = [(r or "", t or "") for _, _, _, _, r, t in turns]
    assert [tuple(x) for x in found[7].t] == want and found[7].n_turns == 200
    assert found[7].loss == "".join(t for r, t in want if r == "assistant")
    assert found[8].loss == ODD[2] and found[8].formatted.count("</turn>") == 2
    assert chat.render_chats(chat.fold_events(events.limit(0))).count() == 0


def test_encoder_and_decoder_match_the_library(library):
    v = bpe.Vocabulary(PATH)
    rng = np.random.default_rng(0)
    pieces = [b.decode("utf-8", "ignore") for b in v.bytes]
    texts = [t for t in ODD if t] + ["".join(rng.choice(pieces, 9)) for _ in range(300)] + ["".join(rng.choice(list("  \u00a0aAbe-=\t\n$é0'"), rng.integers(1, 50))) for _ in range(3000)]
    texts += ["<|endoftext|>", "a<|endoftext|> b", " ", "  ", "   ", " \n", "x \n y", "\n x", "a\u2003 b", "a \x1c b"]
    ids, ends = v.encode(pa.array([*texts, None]))
    coded = [x.tolist() for x in np.split(ids, ends[:-1])]
    again, stops = tokens.Encoder(PATH).encode(pa.array([*texts, None]))
    assert again.tolist() == ids.tolist() and stops.tolist() == ends.tolist() and coded[-1] == []
    for t, found in zip(texts, coded):
        ids = library.encode(t, add_special_tokens=False).ids
        assert found == ids
        assert v.decode(np.array(ids, np.int32)).decode("utf-8", "replace") == library.decode(ids, skip_special_tokens=False) == t
    broken = [library.encode("é", add_special_tokens=False).ids[0], 447, 222, 64]
    assert v.decode(np.array(broken)).decode("utf-8", "replace") == library.decode(broken, skip_special_tokens=False)


def test_every_code_point_is_coded_as_by_the_library(library):
    texts = [chr(c) + "a " + chr(c) + " b" + chr(c) for c in range(0x20000) if not 0xD800 <= c < 0xE000]
    for coder in (bpe.Vocabulary(PATH), tokens.Encoder(PATH)):
        ids, ends = coder.encode(pa.array(texts))
        want = [e.ids for e in library.encode_batch_fast(texts, add_special_tokens=False)]
        assert ids.tolist() == [i for x in want for i in x] and ends.tolist() == np.cumsum([len(x) for x in want]).tolist()


def test_a_full_table_keeps_what_was_used():
    asked = []

    def encode(new):
        asked.extend(new.to_pylist())
        return (words.Parts(np.array([int(x) for x in new.to_pylist()], "<i4"), np.ones(len(new), np.int64)),)

    table = words.Known()
    for batch in (["1", "2"], ["2", "3"], ["2", "3"], ["1"]):
        table, at = table.with_all(pa.array(batch, pa.large_string()), encode, 2)
        assert table[0].gather(at).tolist() == [int(x) for x in batch]
    assert asked == ["1", "2", "3", "1"]


def test_coding_tables(spark, library, monkeypatch):
    monkeypatch.setattr(bpe, "BATCH_CHARS", 40)
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in enumerate(ODD * 2)], "doc_id long, text string, ids string, decoded int")
    coded = bpe.encode_texts(docs, PATH)
    found = bpe.decode_ids(coded, PATH).select("*", bpe.ids_text().alias("told")).collect()
    assert len(found) == 2 * len(ODD)
    for r in found:
        want = library.encode(r.text or "", add_special_tokens=False).ids
        assert r.ids == want and r.decoded == (r.text or "") and r.told == ",".join(map(str, want))
    both = bpe.encode_texts(docs, PATH, decoded="text").collect()
    assert sorted((r.text, r.ids) for r in both) == sorted((r.decoded, r.ids) for r in found)
    assert bpe.decode_ids(bpe.encode_texts(docs.limit(0), PATH), PATH).count() == 0


@pytest.mark.parametrize("many", [1, 30])
def test_token_files_round_trip(spark, library, monkeypatch, many):
    monkeypatch.setattr(tokens, "BLOCK_BYTES", 2000)
    rows = [(None if i == 5 else i // 2, t, i) for i, t in enumerate(ODD * many)]
    docs = spark.createDataFrame(rows[::-1], "doc_id long, text string, start int").repartition(5)
    out = runtime.scratch_path(spark, "tokens-test")
    tokens.write_tokens(docs, out, PATH)
    found = tokens.read_tokens(spark, out).orderBy("start").collect()
    key = lambda d: -1 if d is None else d
    want = sorted((key(d), [*library.encode(t or "", add_special_tokens=False).ids, 0]) for d, t, _ in rows)
    got = [(key(r.doc_id), np.frombuffer(r.ids, "<u4").tolist()) for r in found]
    assert [d for d, _ in got] == [d for d, _ in want] and sorted(got) == want
    assert [r.start for r in found] == np.cumsum([0, *(r.n_tokens for r in found[:-1])]).tolist()
    assert all(r.n_tokens == len(np.frombuffer(r.ids, "<u4")) for r in found)
    one = tokens.read_document(spark, out, 3).collect()
    assert sorted(r.start for r in one) == sorted(r.start for r in found if r.doc_id == 3)
    head = spark.read.parquet(f"{out}/dictionary").first()
    assert (len(head.dictionary) > 0) == (many > 1)


def test_token_files_of_no_documents(spark):
    out = runtime.scratch_path(spark, "tokens-test")
    tokens.write_tokens(spark.createDataFrame([], "doc_id long, text string"), out, PATH)
    assert tokens.read_tokens(spark, out).count() == 0


def test_crc_of_ids(spark):
    data = np.array([1, 2, 70000], "<u4").tobytes()
    assert spark.createDataFrame([(bytearray(data),)], "b binary").select(F.crc32("b")).first()[0] == zlib.crc32(data)
