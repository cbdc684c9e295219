"""Chat formatting from event logs, with DataFrame functions only.

Events of a conversation are ordered by sequence and folded into messages: `message` opens one,
`delta` appends to the last one of its turn, `edit` replaces its text, `regenerate` drops its text
and starts it anew. Messages are rendered as

    ### role: text</turn>\\n

Inside texts the control strings are replaced by a backslash and a letter, and so is the backslash
itself: every backslash of a rendered text starts such a pair, which makes the way back exact.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

HEAD, END, COLON = "### ", "</turn>\n", ": "
#: Control strings and what stands for them; the backslash comes first in, last out.
ESCAPES = (("\\", "\\s"), ("</turn>", "\\t"), ("###", "\\h"))
#: Roles must not hold the colon that ends them.
ROLE_ESCAPES = (*ESCAPES, (":", "\\c"))
KINDS = ("message", "delta", "edit", "regenerate")
#: Turns that are joined to one text before the texts of a conversation meet.
CHUNK_TURNS = 64


def escape(text: Column, pairs=ESCAPES) -> Column:
    for plain, coded in pairs:
        text = F.replace(text, F.lit(plain), F.lit(coded))
    return text


def unescape(text: Column, pairs=ESCAPES) -> Column:
    for plain, coded in reversed(pairs):
        text = F.replace(text, F.lit(coded), F.lit(plain))
    return text


def fold_events(events: DataFrame) -> DataFrame:
    """Events (conv_id, turn, seq, kind, role, text) become messages (conv_id, turn, chunk, nth,
    role, text).

    Null text or role: empty. A null conversation or turn is a value of its own, turns in it come
    first. Null or unknown kinds are messages. Events with equal seq are taken in the order
    message, edit, regenerate, delta, then by role and text. A second `message` on a turn is a
    further message of that turn (`nth`), also if all its columns are equal to the first. A turn
    whose first event is no message starts one all the same. The role is that of the opening event.
    """
    known = F.col("kind").isin(*KINDS)
    kind = F.when(known, F.col("kind")).otherwise("message")
    rows = events.select(
        "conv_id",
        "turn",
        F.floor(F.col("turn") / CHUNK_TURNS).alias("chunk"),
        F.col("seq").alias("at"),
        F.array_position(F.array(*map(F.lit, ("message", "edit", "regenerate", "delta"))), kind).alias("rank"),
        F.coalesce("role", F.lit("")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"),
    ).repartition("conv_id", "chunk")
    order = Window.partitionBy("conv_id", "chunk", "turn").orderBy("at", "rank", "role", "text")
    upto = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    numbered = rows.withColumns(
        {
            "row": F.row_number().over(order),
            "nth": F.greatest(F.sum((F.col("rank") == 1).cast("long")).over(upto), F.lit(1)),
            "version": F.sum((F.col("rank") != 4).cast("long")).over(upto),
        }
    )
    piece = F.struct("row", "version", "role", "text")
    grouped = numbered.groupBy("conv_id", "chunk", "turn", "nth").agg(F.sort_array(F.collect_list(piece)).alias("p"))
    last = F.element_at("p", -1)["version"]
    return grouped.select(
        "conv_id",
        "turn",
        "chunk",
        "nth",
        F.col("p")[0]["role"].alias("role"),
        F.concat_ws("", F.transform(F.filter("p", lambda e: e["version"] == last), lambda e: e["text"])).alias("text"),
    )


def render_chats(messages: DataFrame, learned: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """One row per conversation: conv_id, n_turns, formatted, loss_spans.

    `loss_spans` are (turn, start, length): the turn from 0, and code points within the rendered
    turn, of each text of a role in `learned`. Long conversations are joined in chunks first; the
    text of one conversation has to fit one row.
    """
    head = F.concat(F.lit(HEAD), escape(F.col("role"), ROLE_ESCAPES), F.lit(COLON))
    body = escape(F.col("text"))
    turned = messages.select(
        "conv_id",
        "chunk",
        F.struct(
            "turn",
            "nth",
            F.concat(head, body, F.lit(END)).alias("shown"),
            F.when(F.col("role").isin(*learned), F.char_length(head)).alias("start"),
            F.char_length(body).alias("length"),
        ).alias("t"),
    )
    chunks = (
        turned.groupBy("conv_id", "chunk")
        .agg(F.sort_array(F.collect_list("t")).alias("t"), F.count("*").alias("n"))
        .select(
            "conv_id",
            F.struct(
                F.col("chunk").alias("chunk"),
                F.col("n").alias("n"),
                F.concat_ws("", "t.shown").alias("shown"),
                F.col("t.start").alias("starts"),
                F.col("t.length").alias("lengths"),
            ).alias("c"),
        )
    )
    chats = chunks.groupBy("conv_id").agg(F.sort_array(F.collect_list("c")).alias("c"))
    starts, lengths = F.flatten("c.starts"), F.flatten("c.lengths")
    spans = F.transform(
        F.arrays_zip(starts.alias("start"), lengths.alias("length")),
        lambda s, i: F.struct(i.alias("turn"), s["start"].alias("start"), s["length"].alias("length")),
    )
    return chats.select(
        "conv_id",
        F.aggregate("c.n", F.lit(0).cast("long"), lambda a, n: a + n).alias("n_turns"),
        F.concat_ws("", "c.shown").alias("formatted"),
        F.filter(spans, lambda s: s["start"].isNotNull()).alias("loss_spans"),
    )


def rendered_turns(formatted: Column) -> Column:
    """The rendered turns of a formatted text, without their end marks."""
    turns = F.split(formatted, END, -1)
    return F.slice(turns, 1, F.size(turns) - 1)


def read_turns(formatted: Column) -> Column:
    """Array of (role, text) read back from a formatted text."""

    def parse(turn: Column) -> Column:
        rest = turn.substr(F.lit(len(HEAD) + 1), F.length(turn))
        role = F.substring_index(rest, COLON, 1)
        text = rest.substr(F.length(role) + len(COLON) + 1, F.length(rest))
        return F.struct(unescape(role, ROLE_ESCAPES).alias("role"), unescape(text).alias("text"))

    return F.transform(rendered_turns(formatted), parse)


def loss_text(formatted: Column, loss_spans: Column) -> Column:
    """The unescaped texts under the loss mask, one after the other."""
    turns = rendered_turns(formatted)
    return F.concat_ws(
        "", F.transform(loss_spans, lambda s: unescape(F.get(turns, s["turn"]).substr(s["start"] + 1, s["length"])))
    )
