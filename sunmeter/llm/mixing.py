"""Mixing sources to target weights: integer quotas of equal blocks, then seeded selection."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sunmeter.llm.common import WORD, fresh_names, held, settled

WEIGHTS = (1, 2, 3)  # of the sources in order, repeating
LIMIT = 3  # a source gives each of its words at most so often
BLOCK_WORDS = 64
SHARD_WORDS = 200_000
ROW_WORDS = 20  # a document counts as so many words at least when shards are cut
BUNDLE_SHARDS = 1_000
SEED = 20_240_115


def size_of(text: Column) -> Column:
    """Number of words; null counts as empty."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sources: DataFrame, weights: Sequence[int] = WEIGHTS, limit: int = LIMIT) -> DataFrame:
    """``sources`` (source, source_size, more) with ``place``, ``weight`` and ``target``.

    In order of code points, null last, sources weigh ``weights``, repeating, and
    share the whole size by weight.  No target exceeds ``limit`` times its
    source's size; the excess goes to the others by weight until none exceeds.
    That ends with the sources of least limit per weight at their limit, so one
    pass in that order finds the share of all: the first source whose limit per
    weight is not below what is left per weight still open.  The windows hold
    one row per source.
    """
    names = sources.columns
    order = Window.orderBy(F.col("source").isNull(), F.col("source").cast("binary"))
    place = F.row_number().over(order) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]),
                          (place % len(weights) + 1).cast("int"))
    most = F.col("source_size") * float(limit)
    by_ratio = Window.orderBy(F.col("most") / F.col("weight"), "place")
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    ranked = sources.select(
        *names, place.cast("long").alias("place"), weight.alias("weight"), most.alias("most"))
    left = (F.sum("source_size").over(Window.partitionBy()).cast("double")
            - F.coalesce(F.sum("most").over(before), F.lit(0.0)))
    open_weight = (F.sum("weight").over(Window.partitionBy())
                   - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    rates = ranked.withColumn("rate", left / open_weight)
    free = F.col("rate") * F.col("weight") <= F.col("most")
    rate = F.min(F.when(free, F.struct(F.col("most") / F.col("weight"), "place", "rate"))).over(
        Window.partitionBy())["rate"]
    return rates.select(
        *names, "place", "weight",
        F.least(F.col("most"), F.coalesce(rate * F.col("weight"), "most")).alias("target"))


def apportion(parties: DataFrame, votes: str, seats: Column, within: Sequence[str]) -> DataFrame:
    """Sainte-Laguë: ``parties`` with ``quota``, their seats by the highest quotients.

    A party with ``votes`` v has the quotients v / 1, v / 3, v / 5, ...; the
    ``seats`` highest of all parties ``within`` the same columns win, ties by the
    columns in order.  Seats that a party is sure of, and those it can't get,
    follow from a divisor: with n parties, the divisor for n / 2 seats fewer gives
    too few seats, that for n / 2 more too many.  So only about 2 n quotients are
    compared, whatever the number of seats.  No votes give no seats.
    """
    names = parties.columns
    group = Window.partitionBy(*within)
    n = F.count("*").over(group)
    total = F.sum(votes).over(group).cast("double")
    sized = parties.select(
        *names, seats.cast("long").alias("seats"), n.alias("n"), total.alias("total"))
    v = F.col(votes).cast("double")

    def rounded(divided_seats: Column) -> Column:
        share = F.when(F.col("total") > 0, v * divided_seats / F.col("total")).otherwise(0.0)
        return F.floor(share + 0.5)

    slack = F.col("n") / 2 + 1
    bounds = sized.select(
        *names, "seats", "total",
        rounded(F.greatest(F.col("seats") - slack, F.lit(0.0))).alias("sure"),
        rounded(F.col("seats") + slack).alias("most"))
    open_seats = F.col("seats") - F.sum("sure").over(group)
    wanted = bounds.withColumn("open", open_seats).withColumn(
        "seat", F.explode_outer(F.when(
            (F.col("most") > F.col("sure")) & (v > 0),
            F.sequence(F.col("sure") + 1, F.col("most")))))
    best = Window.partitionBy(*within).orderBy(
        F.desc_nulls_last(v / (2 * F.col("seat") - 1)), *names)
    won = F.col("seat").isNotNull() & (F.row_number().over(best) <= F.col("open"))
    chosen = wanted.select(*names, "sure", won.alias("won"))
    return chosen.groupBy(*names).agg(
        (F.first("sure") + F.count(F.when(F.col("won"), 1))).alias("quota"))


def plan(
    docs: DataFrame, id_column: str = "doc_id", text: str = "text", source: str = "source",
    *more: str, weights: Sequence[int] = WEIGHTS, limit: int = LIMIT,
    block_words: int = BLOCK_WORDS, shard_words: int = SHARD_WORDS, seed: int = SEED,
) -> DataFrame:
    """One row per document: what the mix takes of it.

    ``size``, ``source_size`` and ``target`` are as in ``targets``.  The document
    begins ``first`` words into its shard, which has ``shard_size`` words in
    ``n_blocks`` blocks; all blocks are taken ``copies`` times, and those that
    ``extra_blocks`` names once more.  ``taken`` is the sum of it in words.

    A source's documents are dealt by hash into shards of about ``shard_words``
    words and laid end to end there in seeded order, so no task holds more than
    shards of bounded size, however large the source and however many rows are
    equal: those are numbered and dealt by their numbers.  Sources get quotas of
    blocks of ``block_words`` words by Sainte-Laguë, then bundles of a source's
    shards, then the shards.  Which blocks a shard gives once more follows from
    the order of their seeded hashes.  As votes below a source are blocks, no block is taken more than
    ``limit`` times.  Null text has size 0, null sources are one source; repeated
    rows are documents of their own; rows without words take nothing; no rows
    give no rows.  The seed and the rows fix the result; ``more`` columns are kept.
    """
    rows = settled(docs.select(
        F.col(id_column).alias("id"), F.col(source).alias("source"), *more,
        size_of(F.col(text)).alias("size"), F.spark_partition_id().alias("task")), "sizes")
    sources = rows.groupBy("source").agg(
        F.sum("size").alias("source_size"), F.count("*").alias("n_rows"))
    shares = targets(sources, weights, limit)
    seats = F.round(F.sum("target").over(Window.partitionBy()) / block_words)
    by_source = settled(
        apportion(shares, "target", seats, []).withColumnRenamed("quota", "source_blocks")
        .withColumn("n_shards", F.greatest(F.lit(1), F.ceil(
            (F.col("source_size") + F.col("n_rows") * ROW_WORDS) / shard_words)).cast("long"))
        .withColumnRenamed("source", "named"), "sources")

    dealt = rows.join(by_source, F.col("source").eqNullSafe(F.col("named"))).withColumn(
        "order", F.xxhash64(F.lit(seed), "id", "size", *more))
    dealt = _numbered(dealt, ["place", "order"]).withColumn(
        "shard", F.pmod(F.xxhash64(F.lit(seed + 1), "order", "number"), "n_shards"))
    shard = Window.partitionBy("place", "shard")
    before = shard.orderBy("order", "id", "size", *more, "number").rowsBetween(
        Window.unboundedPreceding, -1)
    placed = settled(dealt.select(
        "id", "source", *more, "size", "source_size", "target", "source_blocks", "place", "shard",
        F.coalesce(F.sum("size").over(before), F.lit(0)).alias("first"),
        F.sum("size").over(shard).alias("shard_size")), "placed")

    def chance(block: Column) -> Column:
        return F.xxhash64(F.lit(seed + 2), "place", "shard", block)

    blocks = F.greatest("n_blocks", F.lit(1))
    quotas = _shard_quotas(placed, limit, block_words).withColumn(
        "copies", F.floor(F.col("quota") / blocks)).withColumn(
        "extra", F.col("quota") - F.col("copies") * F.col("n_blocks"))
    drawn = F.array_sort(F.transform(F.sequence(F.lit(0).cast("long"), blocks - 1), chance))
    quotas = settled(quotas.withColumn("last", F.when(F.col("extra") > 0, F.get(
        drawn, (F.col("extra") - 1).cast("int")))), "quotas")
    spread = placed.join(quotas, ["place", "shard"]).withColumn(
        "extra_blocks", _extra_blocks(chance))
    extra = F.aggregate("extra_blocks", F.lit(0).cast("long"), lambda total, block: (
        total + block["end"] - block["start"]))
    return spread.select(
        F.col("id").alias(id_column), F.col("source").alias(source), *more, "size", "source_size",
        "target", (F.col("copies") * F.col("size") + extra).alias("taken"), "first", "shard_size",
        "n_blocks", "copies", "extra_blocks")


def _numbered(rows: DataFrame, keys: list[str]) -> DataFrame:
    """``rows`` with ``number``: rows of equal keys count from 0, in any order.

    Rows are numbered within their ``task`` of before, behind those of the tasks before
    it, so equal rows are spread over as many tasks as they came from.
    """
    each = [*keys, "task"]
    sizes = rows.groupBy(*each).agg(F.count("*").alias("rows_of_task"))
    earlier = Window.partitionBy(*keys).orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    begins = sizes.select(*each, F.coalesce(
        F.sum("rows_of_task").over(earlier), F.lit(0)).alias("begin")).filter("begin > 0")
    own = F.row_number().over(Window.partitionBy(*each).orderBy(F.lit(0))) - 1
    return rows.withColumn("own", own).join(begins, each, "left").withColumn(
        "number", F.col("own") + F.coalesce("begin", F.lit(0))).drop("own", "begin", "task")


def _shard_quotas(placed: DataFrame, limit: int, block_words: int) -> DataFrame:
    """``n_blocks`` and ``quota`` of each shard: a source's blocks by bundle, then by shard."""
    shards = settled(placed.groupBy("place", "shard").agg(
        *[F.first(name).alias(name) for name in ("source_size", "source_blocks", "shard_size")]
    ).withColumn("n_blocks", F.when(F.col("shard_size") > 0, F.greatest(
        F.floor(F.col("shard_size") / block_words), F.lit(1))).otherwise(0)).withColumn(
        "bundle", F.floor(F.col("shard") / BUNDLE_SHARDS)), "shards")
    bundles = shards.groupBy("place", "bundle").agg(
        F.sum("n_blocks").alias("bundle_size"), F.first("source_size").alias("source_size"),
        F.first("source_blocks").alias("source_blocks"))
    # The source's quota in blocks of the mean length they have there.
    words = F.least(F.col("source_blocks") * block_words, F.col("source_size") * limit)
    have = F.sum("bundle_size").over(Window.partitionBy("place"))
    take = F.when(F.col("source_size") > 0, F.round(words * have / F.col("source_size")))
    bundles = bundles.withColumn("take", F.coalesce(take, F.lit(0)).cast("long"))
    given = apportion(bundles, "bundle_size", F.col("take"), ["place"]).select(
        "place", "bundle", F.col("quota").alias("bundle_quota"))
    parts = shards.join(given, ["place", "bundle"]).select(
        "place", "bundle", "shard", "n_blocks", "bundle_quota")
    return apportion(parts, "n_blocks", F.col("bundle_quota"), ["place", "bundle"]).select(
        "place", "shard", "n_blocks", "quota")


def _extra_blocks(chance: Callable[[Column], Column]) -> Column:
    """The document's parts of blocks that are taken once more, as words from its start.

    Those are the blocks of the least ``chance``, up to ``last``.  Block j of a shard of t words in n blocks begins at word j * t div n.
    """
    t, n, size = F.col("shard_size"), F.col("n_blocks"), F.col("size")
    begin, end = F.col("first"), F.col("first") + F.col("size")

    def holding(word: Column) -> Column:
        return F.floor(((word + 1) * n - 1) / t)

    def starts(block: Column) -> Column:
        return F.floor(block * t / n)

    met = F.sequence(holding(begin), holding(end - 1))
    won = F.filter(met, lambda j: chance(j) <= F.col("last"))
    parts = F.transform(won, lambda j: F.struct(
        (F.greatest(starts(j), begin) - begin).cast("long").alias("start"),
        (F.least(starts(j + 1), end) - begin).cast("long").alias("end")))
    none = F.array().cast("array<struct<start:bigint,end:bigint>>")
    return F.when((size > 0) & (F.col("extra") > 0), parts).otherwise(none)


def mixed(
    docs: DataFrame, id_column: str = "doc_id", text: str = "text", source: str = "source",
    **options: object,
) -> DataFrame:
    """The mix itself: ``docs`` with a row for each time a document is taken.

    Copies are the row as it is; what is taken once more is a row whose text has
    the words of the blocks taken, with the white space before each.  Documents
    that the mix does not take are gone.
    """
    names = docs.columns
    digest, id_, id_digest, takes, pieces = fresh_names(names, *[
        f"mixing_{name}" for name in ("digest", "id", "id_digest", "takes", "pieces")])
    docs = docs.withColumn(digest, F.xxhash64(*names))
    plans = plan(docs, id_column, text, source, digest, **options)
    taken = plans.filter("taken > 0").groupBy(id_column, digest).agg(
        F.collect_list(F.struct("copies", "extra_blocks")).alias(takes)).select(
        F.col(id_column).alias(id_), F.col(digest).alias(id_digest), takes)
    same = F.col(id_column).eqNullSafe(F.col(id_)) & (F.col(digest) == F.col(id_digest))
    found = docs.join(taken.hint("shuffle_hash"), same).select(*names, takes)
    once = found.filter(F.size(takes) == 1)
    equal = found.filter(F.size(takes) > 1).dropDuplicates(names)  # the takes are of all of them
    rows = once.union(equal).withColumn(takes, F.explode(takes))
    rows = held(rows, *names, takes, **{pieces: F.when(
        F.size(f"{takes}.extra_blocks") > 0,
        F.regexp_extract_all(text, F.lit(f"(?s).*?{WORD}"), F.lit(0)))})

    def words(part: Column) -> Column:
        return F.array_join(F.slice(pieces, (part["start"] + 1).cast("int"),
                                    (part["end"] - part["start"]).cast("int")), "")

    extra = F.array_join(F.transform(f"{takes}.extra_blocks", words), "")
    texts = F.concat(
        F.array_repeat(F.col(text), F.col(f"{takes}.copies").cast("int")),
        F.filter(F.array(extra), lambda part: part != ""))
    return rows.withColumn(text, F.explode(texts)).select(*names)
