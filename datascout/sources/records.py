"""Records of large text files, cut by many tasks: delimited text with quoted line breaks, JSON arrays.

Whether a line break ends a record depends on all that stands before it in the file. The state is found by
a scan: every byte range of a file (a block that one task reads) says how it would end for each state it may
begin in; a running composition over the blocks of a file gives the state in which each one truly
begins. Then every block is cut where a record really ends, and only the pieces of records that lie
across the border of blocks are brought together.

A block is read as units that end at a byte which may end a record: lines, or in JSON what ends with a closing
brace. Within a block the units are in order; a task holds one record at a time.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from datascout.runtime import written

class QuotedLines:
    """Lines of delimited text, quoted by `"` at the start of a field and escaped by doubling it. State: inside
    quotes or not; a line that ends outside ends a record."""

    separator = "\n"

    def __init__(self, sep: bytes):
        self.sep, self.opens = sep, sep + b'"'

    def matters(self, value: Column) -> Column:
        """Whether a unit can change the state."""
        return F.contains(value, F.lit('"'))

    def after(self, inside: bool, line: bytes) -> tuple[bool, int]:
        """(whether the line ends inside quotes, 0)."""
        at = 0
        if not inside:
            if line[:1] == b'"':
                inside, at = True, 1
            else:
                at = line.find(self.opens)
                if at < 0:
                    return False, 0
                inside, at = True, at + len(self.opens)
        while True:
            quote = line.find(b'"', at)
            if quote < 0:
                return True, 0
            if line[quote + 1 : quote + 2] == b'"':
                at = quote + 2
                continue
            # The quote closes; what follows it up to the delimiter belongs to the value.
            next_field = line.find(self.sep, quote + 1)
            if next_field < 0:
                return False, 0
            at = next_field + len(self.sep)
            if line[at : at + 1] == b'"':
                at += 1
                continue
            at = line.find(self.opens, at)
            if at < 0:
                return False, 0
            at += len(self.opens)

    def ends(self, inside: bool, depth: int) -> bool:
        return not inside


class ArrayElements:
    """Objects of one JSON array a file. State: inside a string or not, and how many brackets are open; a
    closing brace that leaves only the array open ends a record."""

    separator = "}"

    def matters(self, value: Column) -> Column:
        return F.lit(True)

    def after(self, inside: bool, unit: bytes) -> tuple[bool, int]:
        """(whether the unit ends inside a string, by how many brackets it changes the depth); the brace that
        ends the unit counts."""
        depth = 0
        parts = unit.replace(b"\\\\", b"").replace(b'\\"', b"").split(b'"')
        # Between quotes, texts inside and outside strings take turns.
        for k, part in enumerate(parts):
            if (k % 2 == 1) == inside:
                depth += part.count(b"{") + part.count(b"[") - part.count(b"]")
        inside = inside == (len(parts) % 2 == 1)
        return inside, depth - (not inside)

    def ends(self, inside: bool, depth: int) -> bool:
        return not inside and depth <= 1


def text_units(spark: SparkSession, path: str | Sequence[str], separator: str) -> DataFrame:
    """(path, block, value) in the order of each block."""
    units = spark.read.option("lineSep", separator).text(path)
    return units.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), F.col("value").cast("binary").alias("value"))


def _by_block(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[str, int], pa.RecordBatch]]:
    """The batches, cut where another block begins."""
    for batch in batches:
        paths, blocks = batch.column("path").dictionary_encode().indices.to_numpy(), batch.column("block").to_numpy()
        cuts = [0, *((paths[1:] != paths[:-1]) | (blocks[1:] != blocks[:-1])).nonzero()[0] + 1, batch.num_rows]
        for a, z in zip(cuts, cuts[1:]):
            if z > a:
                yield (batch.column("path")[int(a)].as_py(), int(blocks[a])), batch.slice(int(a), int(z - a))


def block_states(units: DataFrame, kind) -> DataFrame:
    """(path, block, inside, depth, closed): the state in which each block begins, and whether every unit of
    the block ends a record.

    One row a block is gathered; the state before a block is the last one that does not depend on how
    the file began, turned over once for each block since then that turns it over.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[tuple, list] = {}
        for key, rows in _by_block(batches):
            now = found.setdefault(key, [False, 0, True, 0, True])
            for value in rows.column("value").drop_null():
                unit = value.as_py()
                for k in (0, 2):
                    now[k], depth = kind.after(now[k], unit)
                    now[k + 1] += depth
                now[4] &= not now[0]
        columns = list(zip(*((*key, *now) for key, now in found.items()))) or [[]] * 7
        types = (pa.string(), pa.int64(), pa.bool_(), pa.int64(), pa.bool_(), pa.int64(), pa.bool_())
        names = ["path", "block", "from_out", "depth_out", "from_in", "depth_in", "closed"]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names)

    seen = units.withColumn("value", F.when(kind.matters(F.col("value").cast("string")), F.col("value")))
    schema = "path string, block long, from_out boolean, depth_out long, from_in boolean, depth_in long, closed boolean"
    blocks = written(seen.mapInArrow(run, schema), "blocks")
    order = Window.partitionBy("path").orderBy("block")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    turns = F.coalesce(F.sum(F.when(F.col("from_out") & ~F.col("from_in"), 1).otherwise(0)).over(before), F.lit(0))
    blocks = blocks.withColumn("turns", turns)
    fixed = F.last(F.when(F.col("from_out") == F.col("from_in"), F.struct("from_out", "turns")), ignorenulls=True).over(before)
    blocks = blocks.withColumn("fixed", fixed)
    odd = (F.col("turns") - F.coalesce("fixed.turns", F.lit(0))) % 2 == 1
    blocks = blocks.withColumn("inside", F.coalesce("fixed.from_out", F.lit(False)) != odd)
    depth = F.sum(F.when(F.col("inside"), F.col("depth_in")).otherwise(F.col("depth_out"))).over(before)
    return blocks.select("path", "block", "inside", F.coalesce(depth, F.lit(0)).alias("depth"), (F.col("closed") & ~F.col("inside")).alias("closed"))


def _cut(units: DataFrame, kind, whole: bool) -> DataFrame:
    """The records that lie in one block (`whole`), or the pieces of the others: (path, block, value, opens, first)
    in the order of each block. A piece opens a record or goes on with one; `first` is the first record of a file."""
    close = kind.separator.encode()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, inside, depth, held, opens, first = None, False, 0, [], True, False

        def made(values, opened, firsts):
            n = len(values)
            arrays = [pa.array([current[0]] * n, pa.string()), pa.array([current[1]] * n, pa.int64()), pa.array(values, pa.binary())]
            return pa.RecordBatch.from_arrays([*arrays, pa.array(opened, pa.bool_()), pa.array(firsts, pa.bool_())], ["path", "block", "value", "opens", "first"])

        for key, rows in _by_block(batches):
            if key != current:
                if held and not whole:
                    yield made([b"".join(held)], [opens], [first])
                state = rows.column("inside")[0].as_py()
                if state is None:
                    raise RuntimeError("the files were split otherwise than before; keep spark.sql.files.* and the cores fixed while they are read")
                current, inside, depth, held = key, state, rows.column("depth")[0].as_py(), []
                first = key[1] == 0
                opens = first or kind.ends(inside, depth)
            done, firsts, piece = [], [], None
            for unit in rows.column("value").to_pylist():
                inside, change = kind.after(inside, unit)
                depth += change
                if not kind.ends(inside, depth):
                    held.append(unit + close)
                elif opens:
                    done.append(b"".join([*held, unit]) if held else unit)
                    firsts.append(first)
                    held, first = [], False
                else:
                    piece = b"".join([*held, unit, close])
                    held, opens = [], True
            if whole and done:
                yield made(done, [True] * len(done), firsts)
            if not whole and piece is not None:
                yield made([piece], [False], [False])
        if held and not whole:
            yield made([b"".join(held)], [opens], [first])

    return units.mapInArrow(run, "path string, block long, value binary, opens boolean, first boolean")


def split_records(spark: SparkSession, path: str | Sequence[str], kind, states: DataFrame | None = None) -> DataFrame:
    """(path, block, value, first): the records of all files, without the byte that ends them; those across the
    border of blocks have the block in which they begin. An unfinished record at the end of a file is one.

    Equal files give equal records each. An empty file has none.
    """
    units = text_units(spark, path, kind.separator)
    states = written(block_states(units, kind), "states") if states is None else states
    # One row a block, of those that the driver lists as tasks.
    placed = units.join(F.broadcast(states.select("path", "block", "inside", "depth")), ["path", "block"], "left")
    pieces = written(_cut(placed, kind, False), "pieces")
    order = Window.partitionBy("path").orderBy("block", F.col("opens").asc())
    joined = pieces.withColumn("record", F.sum(F.col("opens").cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    parts = F.sort_array(F.collect_list(F.struct("block", "value")))
    stitched = joined.groupBy("path", "record").agg(F.min("block").alias("block"), parts.alias("parts"), F.max("first").alias("first"))
    value = F.aggregate("parts", F.lit(b""), lambda a, x: F.concat(a, x["value"]))
    stitched = stitched.select("path", "block", value.alias("value"), "first")
    close = F.expr(f"substring(value, -1, 1) = CAST('{kind.separator}' AS BINARY)" if kind.separator != "\n" else "substring(value, -1, 1) = X'0A'")
    stitched = stitched.withColumn("value", F.when(close, F.expr("substring(value, 1, length(value) - 1)")).otherwise(F.col("value")))
    columns = ["path", "block", "value", "first"]
    return _cut(placed, kind, True).select(*columns).unionByName(stitched.select(*columns))
