"""Deduplicate, score, rank and resolve catalog records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from datascout.functions.text import hits_score, match_score, whole_bonus, words
from datascout.operators.groups import first_per_group, sent_join, top_n_per_group
from datascout.operators.substring import needles_within, substring_pairs
from datascout.runtime import cut_lineage, written

# Id prefixes that differ from the provider name.
ID_PREFIX_PROVIDER = {"hf": "huggingface"}


def dedupe(cat: DataFrame) -> DataFrame:
    """One record per normalised name, the one with most popularity plus quality.

    Names without any ASCII letter or digit are kept apart by id.
    """
    key = F.regexp_replace(F.lower("name"), "[^a-z0-9]", "")
    key = F.when(key == "", F.concat(F.lit("#"), "id")).otherwise(key)
    best = [(F.col("popularity") + F.col("quality_score")).desc(), F.col("provider"), F.col("id")]
    return first_per_group(cat.withColumn("__key", key), ["__key"], best).drop("__key")


def _score(query: str | Column, distinct: Column | None = None) -> Column:
    return match_score(
        query,
        F.col("id"),
        F.col("name"),
        F.col("description"),
        F.col("popularity"),
        F.col("quality_score"),
        distinct,
    )


def scored(cat: DataFrame, query: str) -> DataFrame:
    return cat.withColumn("score", _score(query))


def search(cat: DataFrame, query: str, limit: int = 10, min_score: float = 0.0) -> DataFrame:
    """Best records for one query. Records without any match score 0 and come last;
    a positive ``min_score`` leaves them out."""
    hits = scored(cat, query)
    if min_score > 0:
        hits = hits.where(F.col("score") >= min_score)
    return hits.orderBy(F.col("score").desc(), "id").limit(limit)


def search_local(downloads: DataFrame, query: str) -> DataFrame:
    return downloads.where(F.lower("name").contains(query.lower())).withColumn("score", F.lit(100.0))


def _matched_records(cat: DataFrame, asked: DataFrame, scope: list[str]) -> DataFrame:
    """The records with an asked word: ``id``, popularity, quality and, sorted, the asked words that lie in the
    name or id (``titles``), that lie in the description (``descs``), and that are the whole name or id (``wholes``).

    A word holds no whitespace, so it lies within one whitespace-separated token. Words are
    matched to the distinct tokens of the catalog, far fewer than its records, and the token
    postings then give the records by equality.
    """
    name, id_l = F.lower("name"), F.lower("id")

    def tokens(col: Column, in_title: bool) -> Column:
        return F.transform(
            words(col),
            lambda t: F.struct(
                t.alias("token"),
                F.lit(in_title).alias("in_title"),
                (((t == name) | (t == id_l)) & F.lit(in_title)).alias("is_whole"),
            ),
        )

    all_tokens = F.concat(
        tokens(F.concat_ws(" ", "name", "id"), True), tokens(F.coalesce("description", F.lit("")), False)
    )
    # A record without an id is no answer.
    record = [*scope, "id", "popularity", "quality_score"]
    postings = cat.where("id is not null").select(*record, F.explode(all_tokens).alias("t")).select(*record, "t.*")
    pairs = needles_within(postings.select("token").distinct(), asked.select("word").distinct())

    def found(where: Column, name: str) -> Column:
        return F.array_sort(F.collect_set(F.when(where, F.col("word")))).alias(name)

    return (
        asked.select(*scope, "word")
        .distinct()
        .join(pairs, "word")
        .join(postings.hint("merge"), [*scope, "token"])
        .select(*record, "word", "in_title", (F.col("is_whole") & (F.col("token") == F.col("word"))).alias("is_whole"))
        .repartition(*scope, "id")  # lists grow after the shuffle only
        .groupBy(*scope, "id")
        .agg(
            F.max("popularity").alias("popularity"),
            F.max("quality_score").alias("quality_score"),
            found(F.col("in_title"), "titles"),
            found(~F.col("in_title"), "descs"),
            found(F.col("is_whole"), "wholes"),
        )
        .withColumn("static", F.col("popularity") * 0.2 + F.col("quality_score") * 0.1)
    )


def _postings(records: DataFrame) -> DataFrame:
    """A row for each record and asked word in it."""
    return records.withColumn("word", F.explode(F.array_union("titles", "descs"))).withColumns(
        {
            "in_title": F.array_contains("titles", F.col("word")),
            "in_desc": F.array_contains("descs", F.col("word")),
            "is_whole": F.array_contains("wholes", F.col("word")),
        }
    )


# What one word adds at most when all words of a query are in the title or the description, and what
# a title adds that holds or is the whole query.
IN_TITLE, IN_DESC, HOLDS_ALL, IS_ALL = 40.0, 10.0, 30.0, 50.0
# Bands of popularity and quality in which the records of a word are read, from the top down.
BANDS = 30
# Scores are compared by more than what the order of adding changes.
CLOSE = 1e-6


def _gain() -> Column:
    return F.col("in_title").cast("double") * IN_TITLE + F.col("in_desc").cast("double") * IN_DESC


def _band(static: Column) -> Column:
    return F.greatest(F.lit(0), F.least(F.lit(BANDS), F.floor(static).cast("int")))


def _undominated(records: DataFrame, scope: list[str], k: int) -> DataFrame:
    """The records that can be among the ``k`` best of a word or a text without the bonus for whole queries.

    Records with the same asked words in the title and in the description differ by popularity and
    quality only, for every text: those with less than the ``k``-th of them have are left out, but for
    what the limit of a score may make equal, and of those with equal popularity and quality the ``k`` first ids stay.
    """
    same = [*scope, "titles", "descs"]
    heads = top_n_per_group(records, same, [F.col("static").desc(), F.col("id")], k)
    # Fewer than k known values set no floor.
    floors = heads.groupBy(*same).agg(F.when(F.count("static") >= k, F.min("static")).alias("floor"))
    static = F.col("static")
    limited = static >= 100.0 - IN_TITLE - IN_DESC - CLOSE
    stays = static.isNull() | F.col("floor").isNull() | limited | (static >= F.col("floor") - CLOSE)
    known = {f"__{c}": F.when(static.isNotNull(), F.col(c)) for c in ("popularity", "quality_score")}
    near = sent_join(records, written(floors, "floors"), same).where(stays).withColumns(known)
    return top_n_per_group(near, [*same, *known], [F.col("id")], k).select(*records.columns)


def _placed_words(asked: DataFrame, matches: DataFrame, scope: list[str]) -> DataFrame:
    """The matched words of each text, commonest first, with what their records add at most.

    ``ranked`` holds them all in that order; ``whole`` says that each of the words, matched or not,
    lies in the title of some record.
    """
    stats = matches.groupBy(*scope, "word").agg(
        F.count("*").alias("spread"),
        F.max(_gain()).alias("gain"),
        F.max("static").alias("most"),
        F.bool_or("in_title").cast("int").alias("titled"),
    )
    order = Window.partitionBy(*scope, "text").orderBy(F.col("spread").desc(), "word")
    earlier = order.rowsBetween(Window.unboundedPreceding, -1)
    every = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return (
        asked.withColumn("n", F.size("words"))
        .drop("words")
        .join(stats, [*scope, "word"])
        .withColumn("place", F.row_number().over(order))
        .withColumn("before", F.coalesce(F.sum("gain").over(earlier), F.lit(0.0)))
        .withColumn("ranked", F.collect_list("word").over(every))
        .withColumn("whole", F.sum("titled").over(every) == F.col("n"))
        .drop("spread", "titled")
    )


def _ranked_score(bonus: Column) -> Column:
    """The score of a record with ``titles`` and ``descs`` for a text of ``n`` words, ``ranked`` those that any record has."""
    return hits_score(
        F.size(F.array_intersect("ranked", "titles")),
        F.size(F.array_intersect("ranked", "descs")),
        F.col("n"),
        bonus,
        F.col("popularity"),
        F.col("quality_score"),
    )


def _reaching(placed: DataFrame, bars: DataFrame, scope: list[str]) -> DataFrame:
    """The words of texts that have records within reach of the bar of the text: those need ``need`` by popularity,
    quality and that word, and at least ``lowest`` by popularity and quality.

    A record is looked at under the rarest of its words. It holds none but that and the commoner
    ones, so its score is at most what those add, its popularity and quality, and, if it holds all,
    the whole query.
    """
    whole = F.when(F.col("place") == F.col("n"), F.lit(IS_ALL)).otherwise(0.0)
    need = F.coalesce(F.col("bar"), F.lit(float("-inf"))) - F.lit(CLOSE)
    return (
        placed.join(bars, [*scope, "text"], "left")
        .withColumn("need", need - F.col("before") / F.col("n") - whole)
        .withColumn("lowest", F.col("need") - F.col("gain") / F.col("n"))
        .where(F.col("most").isNull() | (F.col("lowest") <= F.col("most")))
    )


def _reached() -> Column:
    return F.col("static") + _gain() / F.col("n") >= F.col("need")


def _within_reach(placed: DataFrame, bars: DataFrame, matches: DataFrame, scope: list[str]) -> DataFrame:
    """``(text, id, score)`` of the records that can still be among the best of a text, without the
    bonus for whole queries.

    Records that stay below the bar of the text are left out; those of a word are read by bands of
    popularity and quality, only as far down as the bar allows. The words of a record go along
    with it, so pairs are scored and left out where they are made, under the rarest word only.
    """
    asked = (
        _reaching(placed, bars, scope)
        # At most BANDS + 1 rows for each word of a text.
        .withColumn("band", F.explode(F.sequence(_band(F.greatest("lowest", F.lit(0.0))), F.lit(BANDS))))
        .select(*scope, "text", "ranked", "place", "word", "band", "n", "need", "known_bar")
    )
    banded = matches.where("static is not null").withColumn("band", _band(F.col("static")))
    pairs = sent_join(banded, written(asked, "asked"), [*scope, "word", "band"])
    rarer = F.slice("ranked", F.col("place") + 1, F.size("ranked"))
    rarest = ~(F.arrays_overlap(rarer, F.col("titles")) | F.arrays_overlap(rarer, F.col("descs")))
    scored = pairs.where(_reached() & rarest).withColumn("score", _ranked_score(F.lit(0.0)))
    below = F.coalesce(F.col("score") < F.col("known_bar"), F.lit(False))
    return scored.where(~below).select(*scope, "text", "id", "score")


def _with_whole(reaching: DataFrame, records: DataFrame, names: DataFrame, scope: list[str]) -> DataFrame:
    """``(text, id, score)`` of the records whose name or id holds the whole text, and so each of its words:
    they are looked up under the rarest of those."""
    asked = reaching.where(F.col("whole") & (F.col("place") == F.col("n")))
    asked = asked.select(*scope, "text", "ranked", "n", "need", "word")
    named = records.where("static is not null").join(names.hint("merge"), [*scope, "id"])
    named = named.withColumn("word", F.explode("titles")).withColumns(
        {"in_title": F.lit(True), "in_desc": F.array_contains("descs", F.col("word"))}
    )
    pairs = sent_join(named, written(asked, "whole"), [*scope, "word"]).where(_reached())
    bonus = whole_bonus(F.col("text"), F.col("name_l"), F.lower("id"))
    holding = pairs.where(F.size(F.array_intersect("ranked", "titles")) == F.col("n")).where(bonus > 0)
    return holding.select(*scope, "text", "id", _ranked_score(bonus).alias("score"))


def _scoped_hits(cat: DataFrame, texts: DataFrame, scope: list[str], k: int) -> DataFrame:
    """Scored records for every query text, among them its ``k`` best.

    The most popular records of every word are scored first; the ``k``-th of them sets the bar of a
    text. Then only records that can reach the bar are scored. Where fewer than ``k`` were found
    there is no bar: then no word has more records than were found. Scores come from the matched words
    of a record, and the best of a text are cut in the tasks that make its pairs: no pairs are shuffled but
    those of the best.
    """
    group, key = [*scope, "text"], [*scope, "word"]
    asked = texts.select(*group, words(F.col("text")).alias("words"))
    asked = asked.select("*", F.explode("words").alias("word"))
    # Read several times below.
    records = written(_matched_records(cat, asked, scope), "records")
    matches = _postings(records)
    placed = written(_placed_words(asked, matches, scope), "placed")
    # Small rows with much work each: they are not to be gathered in few tasks.
    tasks = int(cat.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    near = _postings(written(_undominated(records, scope, k), "near").repartition(tasks))
    order = [F.col("score").desc(), F.col("id")]
    is_text = F.col("word") == F.col("text")
    several = placed.where(~is_text)

    names = cat.select(*scope, "id", F.lower("name").alias("name_l"))
    best = [F.col("static").desc(), F.col("id")]
    heads = top_n_per_group(near, [*key, "in_title", "in_desc"], best, k)
    bonus = whole_bonus(F.col("text"), F.col("name_l"), F.lower("id"))
    opening = (
        several.select(*group, "ranked", "n", "word")
        .join(heads, key)
        .dropDuplicates([*group, "id"])
        .join(names.hint("merge"), [*scope, "id"])
        .select(*group, "id", "static", _ranked_score(bonus).alias("score"))
    )
    # A bar set by records of unknown popularity or quality is none for the scores of others.
    known_bar = F.when(F.bool_and(F.col("static").isNotNull()), F.min("score"))
    bars = top_n_per_group(opening, group, order, k).groupBy(*group)
    bars = bars.agg(F.count("*").alias("n"), F.min("score").alias("bar"), known_bar.alias("known_bar"))
    bars = written(bars.where(F.col("n") == k).drop("n"), "bars")
    hits = top_n_per_group(_within_reach(several, bars, near, scope), group, order, k)
    reaching = _reaching(several, bars, scope)
    if not several.where("whole").isEmpty():
        hits = hits.union(top_n_per_group(_with_whole(reaching, records, names, scope), group, order, k))
    # Records of unknown popularity or quality have the highest score under each word within reach.
    unknown = top_n_per_group(near.where("static is null"), key, [F.col("id")], k).select(*key, "id")
    hits = hits.union(reaching.join(unknown, key).select(*group, "id", F.lit(100.0).alias("score")))
    if not placed.where(is_text).isEmpty():
        # A text that is its only word scores by what is known of that word's records.
        whole = F.when(F.col("is_whole"), IS_ALL).when(F.col("in_title"), HOLDS_ALL).otherwise(0.0)
        hit, in_desc = F.col("in_title").cast("int"), F.col("in_desc").cast("int")
        alone = hits_score(hit, in_desc, F.lit(1), whole, F.col("popularity"), F.col("quality_score"))
        heads = top_n_per_group(matches.withColumn("score", alone), key, order, k)
        hits = hits.union(placed.where(is_text).select(*group, "word").join(heads, key).select(*group, "id", "score"))
    # A record found with and without the bonus for whole queries has it.
    return hits.groupBy(*group, "id").agg(F.max("score").alias("score"))


def search_batch(
    cat: DataFrame,
    queries: DataFrame,
    k: int = 10,
    min_score: float = 0.0,
    scope: list[str] | None = None,
) -> DataFrame:
    """The ``k`` best records for every query: ``(query_id, id, score, rank)``.

    ``queries`` holds ``query_id`` and ``query``; catalog ids are unique. Each distinct query
    text is worked out once. ``scope`` names columns both tables share (such as ``provider``)
    that must agree. With ``min_score`` 0 a query with fewer than ``k`` matches is filled up
    with score-0 records in id order, as one search does.

    Joins with the whole catalog or all queries are merge joins: their size would be guessed by that of
    compressed files, and tables far above the limit of broadcasts would go through the driver.
    """
    scope = scope or []
    group = [*scope, "text"]
    asked = queries.select("query_id", *scope, F.lower("query").alias("text"))
    texts = asked.select(*group).distinct()
    order = [F.col("score").desc(), F.col("id")]
    hits = _scoped_hits(cat, texts, scope, k)
    if min_score > 0:
        hits = hits.where(F.col("score") >= min_score)
    top = top_n_per_group(hits, group, order, k)
    if min_score <= 0:
        top = cut_lineage(top)  # read twice
        # Fewer than k matches stand before the filler, so the first 2k - 1 ids hold enough of it.
        head = top_n_per_group(cat.select(*scope, "id"), scope or [F.lit(0)], [F.col("id")], 2 * k - 1)
        head = head.groupBy(*scope).agg(F.collect_list("id").alias("ids")) if scope else _as_array(head)
        matched = top.groupBy(*group).agg(F.collect_list("id").alias("found"))
        short = (
            texts.join(matched, group, "left")
            .withColumn("found", F.coalesce("found", F.array().cast("array<string>")))
            .where(F.size("found") < k)
        )
        keys = scope or ["__one"]
        filler = (
            short.withColumn("__one", F.lit(1))
            .join(head.withColumn("__one", F.lit(1)), keys)
            .select(*group, F.explode(F.array_except("ids", "found")).alias("id"))
            .withColumn("score", F.lit(0.0))
        )
        top = top.unionByName(filler)
    ranked = top_n_per_group(top, group, order, k, rank="rank")
    return asked.hint("merge").join(ranked, group).select("query_id", *scope, "id", "score", "rank")


def _as_array(head: DataFrame) -> DataFrame:
    # 2k - 1 ids at most.
    return head.agg(F.collect_list("id").alias("ids"))


def alias_lookup(queries: DataFrame, aliases: DataFrame, limit: int = 10) -> DataFrame:
    """``(query_id, id, rank)``: aliases that contain the query or lie within it.

    ``aliases`` holds ``alias`` (lower case, not blank), ``id`` and ``pos`` (table order). An
    all-digit query without a match is taken as the id itself. A NULL query has no answer. Queries
    may be long texts: those longer than every alias lie in none, and all aliases are sought in
    one reading of a text.
    """
    asked = queries.select("query_id", F.lower("query").alias("text"))
    texts = asked.select("text").distinct()
    names = aliases.select("alias").distinct()
    longest = names.agg(F.max(F.char_length("alias")).alias("longest"))  # one row
    short = texts.join(F.broadcast(longest), F.char_length("text") <= F.col("longest")).where(F.col("text") != "")
    inside = substring_pairs(names, short.select("text"))
    around = needles_within(texts, names)
    # Only a text equal to its alias is found both ways.
    pairs = inside.select("text", "alias").union(around.where("text != alias").select("text", "alias"))
    found = pairs.join(aliases, "alias").select("text", "id", "pos")
    # A blank query lies within every alias; only the first of them can be returned.
    blank = aliases.orderBy("pos").limit(limit).select(F.lit("").alias("text"), "id", "pos")
    found = found.union(blank.join(texts, "text", "left_semi"))
    top = top_n_per_group(found, ["text"], [F.col("pos")], limit, rank="rank")
    literal = (
        texts.where(F.col("text").rlike("^[0-9]+$"))
        .join(found.select("text"), "text", "left_anti")
        .select("text", F.col("text").try_cast("bigint").alias("id"), F.lit(1).alias("rank"))
    )
    answers = top.select("text", F.col("id").cast("bigint").alias("id"), "rank").union(literal)
    return asked.hint("merge").join(answers, "text").select("query_id", "id", "rank")  # see search_batch


def resolve(requests: DataFrame, ledger: DataFrame) -> DataFrame:
    """First ledger row (by ``pos``) with the requested id, or that name in any case.

    The ledger is cut to one row per id and per name before the joins, so no request meets
    more than one row of either.
    """
    row = F.struct(*[F.col(f"`{c}`") for c in ledger.columns])

    def firsts(key: Column) -> DataFrame:
        return ledger.groupBy(key.alias("key")).agg(F.min_by(row, "pos").alias("hit"))

    by_id, by_name = firsts(F.col("id")), firsts(F.lower("name"))
    joined = (
        requests.join(by_id.select(F.col("key").alias("source"), F.col("hit").alias("a")), "source", "left")
        .withColumn("__name", F.lower("source"))
        .join(by_name.select(F.col("key").alias("__name"), F.col("hit").alias("b")), "__name", "left")
    )
    first = F.when(
        F.col("a").isNotNull() & (F.col("b").isNull() | (F.col("a.pos") <= F.col("b.pos"))), F.col("a")
    ).otherwise(F.col("b"))
    return (
        joined.withColumn("hit", first)
        .where(F.col("hit").isNotNull())
        .select(*requests.columns, "hit.*")
    )


def resolve_metadata(requests: DataFrame, cached: DataFrame, cat: DataFrame) -> DataFrame:
    """``(id, resolved_id, origin)`` for each distinct requested id.

    The persisted record wins. Without one, a ``uci`` id means the record of that very id; any
    other the best match of its last segment among the records of the provider that its first
    segment names.
    """
    ids = requests.select("id").distinct()
    known = ids.join(cached.select("id"), "id", "left_semi").select(
        "id", F.col("id").alias("resolved_id"), F.lit("cache").alias("origin")
    )
    parts = F.split("id", "/")
    prefix = F.element_at(parts, 1)
    provider = prefix
    for short, full in ID_PREFIX_PROVIDER.items():
        provider = F.when(prefix == short, full).otherwise(provider)
    uncached = ids.join(cached.select("id"), "id", "left_anti")
    exact = (
        uncached.where(prefix == "uci")
        .join(cat.where(F.col("provider") == "uci").select("id").distinct(), "id", "left_semi")
        .select("id", F.col("id").alias("resolved_id"), F.lit("provider").alias("origin"))
    )
    missing = uncached.where(prefix != "uci").select(
        F.col("id").alias("query_id"), F.element_at(parts, -1).alias("query"), provider.alias("provider")
    )
    fetched = search_batch(cat, missing, k=1, min_score=1e-9, scope=["provider"]).select(
        F.col("query_id").alias("id"), F.col("id").alias("resolved_id"), F.lit("provider").alias("origin")
    )
    return known.unionByName(exact).unionByName(fetched)


def limit_per_provider(cat: DataFrame, n: int = 15) -> DataFrame:
    return top_n_per_group(cat, ["provider"], [F.col("popularity").desc(), F.col("id")], n)
