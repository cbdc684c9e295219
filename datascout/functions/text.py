"""Words, relevance scores and display text."""

from __future__ import annotations

import re
from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

from datascout.schema import WHITESPACE

# Every whitespace character; the last is the ideographic space.
SPACES = "".join(c for c in map(chr, range(0x3001)) if c.isspace())
SIZE_UNITS = ["B", "KB", "MB", "GB", "TB", "PB"]


def words(text: Column) -> Column:
    """Distinct whitespace-separated words of the lower-cased text."""
    parts = F.split(F.lower(text), WHITESPACE + "+")
    return F.array_distinct(F.array_remove(parts, ""))


def strip(text: Column) -> Column:
    """Without whitespace at both ends; looks at the ends only, however long the text."""
    return F.trim(text, F.lit(SPACES))


def match_score(
    query: str | Column,
    id: Column,
    name: Column,
    description: Column,
    popularity: Column,
    quality: Column,
    distinct: Column | None = None,
) -> Column:
    """Relevance of a catalog record for a query, 0 to 100.

    A literal query unrolls into plain ``contains`` tests that stay in generated code; a
    query column goes through array functions, over its ``distinct`` words where they are known.
    """
    name_l, id_l = F.lower(name), F.lower(id)
    desc_l = F.lower(F.coalesce(description, F.lit("")))
    if isinstance(query, str):
        whole = F.lit(query.lower())
        # dict keeps the order of first appearance
        distinct = list(dict.fromkeys(w for w in re.split(WHITESPACE + "+", query.lower()) if w))
        if not distinct:
            return F.lit(0.0)
        n_words = F.lit(len(distinct))
        title_hits = F.lit(0)
        desc_hits = F.lit(0)
        for w in distinct:
            title_hits = title_hits + (name_l.contains(w) | id_l.contains(w)).cast("int")
            desc_hits = desc_hits + desc_l.contains(w).cast("int")
    else:
        whole = F.lower(query)
        distinct = words(query) if distinct is None else distinct
        n_words = F.size(distinct)
        title_hits = F.size(F.filter(distinct, lambda w: F.contains(name_l, w) | F.contains(id_l, w)))
        desc_hits = F.size(F.filter(distinct, lambda w: F.contains(desc_l, w)))
    return hits_score(title_hits, desc_hits, n_words, whole_bonus(whole, name_l, id_l), popularity, quality)


def whole_bonus(whole: Column, name_l: Column, id_l: Column) -> Column:
    """What a record gains if its name or id is, or holds, the whole query (all in lower case)."""
    return (
        F.when((whole == name_l) | (whole == id_l), 50.0)
        .when(F.contains(name_l, whole) | F.contains(id_l, whole), 30.0)
        .otherwise(0.0)
    )


def hits_score(
    title_hits: Column, desc_hits: Column, n_words: Column, bonus: Column, popularity: Column, quality: Column
) -> Column:
    """``match_score`` from the number of words of a query in the title and in the description of a record."""
    relevance = (
        F.coalesce(F.try_divide(title_hits, n_words), F.lit(0.0)) * 40.0
        + F.coalesce(F.try_divide(desc_hits, n_words), F.lit(0.0)) * 10.0
        + bonus
    )
    total = relevance + popularity * 0.2 + quality * 0.1
    return (
        F.when(n_words == 0, 0.0)
        .when((title_hits == 0) & (desc_hits == 0) & (bonus == 0.0), 0.0)
        .otherwise(F.least(F.lit(100.0), total))
    )


def format_size(size: Column) -> Column:
    """Bytes as text with one decimal, base 1024; NULL and negative sizes are "Unknown".

    Works on whole numbers so that ties round to even, exactly, at any size. Decimals may exceed 64 bits.
    """
    whole = size.try_cast("decimal(38,0)")
    least, most = F.lit(Decimal(-(2**63))), F.lit(Decimal(2**63))
    beyond = F.coalesce((whole < least) | (whole >= most), F.lit(False))
    size = F.when(~beyond, size.cast("bigint"))  # a cast beyond 64 bits ends the job
    # The first condition has the size in it, so that it is worked out once for all of them.
    out = F.when(size.isNull() | (size < 0), F.when(whole >= most, _format_most(whole)).otherwise("Unknown"))
    for power, unit in enumerate(SIZE_UNITS):
        scale = 1024**power
        tenths = F.lit(10) * (size % scale)
        down = F.floor(size / scale) if power == 0 else F.shiftright(size, 10 * power)
        base = down * 10 + F.shiftright(tenths, 10 * power)
        rest = tenths % scale
        up = (rest * 2 > scale) | ((rest * 2 == scale) & (base % 2 == 1))
        rounded = base + up.cast("bigint")
        text = F.concat(
            F.floor(rounded / 10).cast("string"), F.lit("."), (rounded % 10).cast("string"), F.lit(" " + unit)
        )
        out = out.otherwise(text) if unit == "PB" else out.when(size < scale * 1024, text)
    return out


def _format_most(size: Column) -> Column:
    """`format_size` of decimals from 2**63 on."""
    scale = 1024 ** (len(SIZE_UNITS) - 1)
    rest = size % F.lit(Decimal(scale))
    # Ten times the rest has 53 bits and a zero, so that the double is exact; ten is even, so ties are those of the digit.
    digit = F.rint(rest.cast("double") * 10 / float(scale)).cast("int")
    above = ((size - rest) / F.lit(Decimal(scale)) + (digit == 10).cast("int")).cast("decimal(38,0)")
    return F.concat(above.cast("string"), F.lit("."), (digit % 10).cast("string"), F.lit(" " + SIZE_UNITS[-1]))


def safe_id(id: Column) -> Column:
    return F.replace(id, F.lit("/"), F.lit("_"))


def parse_size(text: Column) -> Column:
    """"12 MB" to bytes; a bare number is bytes; text without a leading number is NULL."""
    parts = F.split(strip(text), WHITESPACE + "+")
    first = F.get(parts, F.lit(0))
    number = F.when(
        first.rlike(r"^[+-]?([0-9]+(_[0-9]+)*\.?([0-9]+(_[0-9]+)*)?|\.[0-9]+(_[0-9]+)*)([eE][+-]?[0-9]+)?$"),
        F.replace(first, F.lit("_"), F.lit("")).try_cast("double"),
    )
    unit = F.upper(F.get(parts, F.lit(1)))
    scale = F.lit(1)
    for power, name in enumerate(SIZE_UNITS[1:5], start=1):
        scale = F.when(unit == name, F.lit(1024**power)).otherwise(scale)
    return (number * scale).try_cast("bigint")


def band(value: Column) -> Column:
    return F.when(value > 75, "high").when(value > 40, "medium").otherwise("low")


def card_description(description: Column, name: Column) -> Column:
    """Text without links; the name when nothing is left, else the first 200 characters."""
    clean = F.regexp_replace(F.coalesce(description, F.lit("")), r"https?://\S+", "")
    clean = strip(F.regexp_replace(clean, r"www\.\S+", ""))
    return F.when(clean == "", name).otherwise(F.concat(F.substring(clean, 1, 200), F.lit("...")))
