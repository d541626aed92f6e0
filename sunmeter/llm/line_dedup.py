"""Repeated passages of lines: content-defined chunks, compared byte by byte, kept once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sunmeter.llm.common import WORD, fresh_key, fresh_names, held, settled

WINDOW_BASE = 131
WINDOW_MODULUS = 2_147_483_647
CHUNK_LINES = 2  # lines of a chunk on average
LONG_WORDS = 50  # a line of more words is a chunk by itself

SPAN = ("start", "lines", "begin")
RANGE = "array<struct<start:int,lines:int>>"


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def chunks(docs: DataFrame, id_column: str, text: str) -> DataFrame:
    """id, digest of the text, and ``chunks`` that may be removed, one row per document.

    Lines are hashed, and a rolling hash over each line and the one before ends a
    chunk where it is divisible by ``CHUNK_LINES``.  So the ends depend on the lines
    around them only, and lines put in or left out elsewhere move nothing.  A
    line of over ``LONG_WORDS`` words is a chunk by itself: it would fill several
    lines of a page.  What is compared of a chunk begins at its first line, or, where
    the chunk is one other line, at that of the chunk before, so a passage is
    followed line by line.  Chunks that may be removed have a long line, or two
    lines with words in what is compared.
    """
    rows = held(
        docs.select(F.col(id_column).alias("id"), F.col(text).alias("text")),
        "id", digest=F.xxhash64("text"), lines=_lines(F.coalesce("text", F.lit(""))))
    rows = held(
        rows, "id", "digest", "lines",
        words=F.transform("lines", lambda line: F.regexp_count(line, F.lit(WORD))),
        hashes=F.transform("lines", lambda line: F.conv(
            F.substring(F.md5(line), 1, 7), 16, 10).cast("long")))

    def at(name: str, place: Column) -> Column:
        return F.get(F.col(name), place - 1)

    def is_end(i: Column) -> Column:
        rolled = at("hashes", i) + WINDOW_BASE * F.when(i > 1, at("hashes", i - 1)).otherwise(0)
        return ((rolled % WINDOW_MODULUS % CHUNK_LINES == 0) | (i == F.size("lines"))
                | (at("words", i) > LONG_WORDS)
                | F.coalesce(at("words", i + 1) > LONG_WORDS, F.lit(False)))

    rows = held(
        rows, "id", "digest", "lines", "words",
        ends=F.filter(F.sequence(F.lit(1), F.size("lines")), is_end))

    def chunk(k: Column) -> Column:
        start = F.when(k > 1, at("ends", k - 1)).otherwise(0) + 1
        return F.struct(start.alias("start"), (at("ends", k) - start + 1).alias("lines"))

    rows = held(
        rows, "id", "digest", "lines", "words",
        spans=F.transform(F.sequence(F.lit(1), F.size("ends")), chunk))

    def compared(span: Column, k: Column) -> Column:
        before = F.get("spans", k - 1)["start"]
        alone = (k > 0) & (span["lines"] == 1) & (at("words", span["start"]) <= LONG_WORDS)
        return F.struct(
            span["start"].alias("start"), span["lines"].alias("lines"),
            F.when(alone, before).otherwise(span["start"]).alias("begin"))

    rows = held(rows, "id", "digest", "lines", "words", spans=F.transform("spans", compared))

    def removable(span: Column) -> Column:
        words = F.slice("words", span["begin"], _length(span))
        return ((F.size(F.filter(words, lambda n: n > 0)) >= 2)
                | (at("words", span["start"]) > LONG_WORDS))

    def keyed(span: Column) -> Column:
        return F.struct(*[span[name].alias(name) for name in SPAN], _text_of(span).alias("text"))

    rows = held(
        rows, "id", "digest", texts=F.transform(F.filter("spans", removable), keyed))
    return rows.select("id", "digest", F.transform("texts", lambda c: F.struct(
        *[c[name].alias(name) for name in SPAN], *_key(c["text"]))).alias("chunks"))


def windows(docs: DataFrame, id_column: str, text: str) -> DataFrame:
    """Like ``chunks``, for whole passages: each line with words and the next such line.

    What lies between the two belongs to them.  Such a window depends on no line
    around it, so all lines of a passage of two lines or more lie in windows that
    are repeated as often as the passage.  A line of over ``LONG_WORDS`` words is
    a window by itself as well.
    """
    rows = held(
        docs.select(F.col(id_column).alias("id"), F.col(text).alias("text")),
        "id", digest=F.xxhash64("text"), lines=_lines(F.coalesce("text", F.lit(""))))
    rows = held(
        rows, "id", "digest", "lines",
        words=F.transform("lines", lambda line: F.regexp_count(line, F.lit(WORD))))

    def with_words(least: int) -> Column:
        return F.filter(F.sequence(F.lit(1), F.size("lines")),
                        lambda i: F.get("words", i - 1) >= least)

    rows = held(
        rows, "id", "digest", "lines", filled=with_words(1), long=with_words(LONG_WORDS + 1))

    def span(start: Column, lines: Column) -> Column:
        return F.struct(start.alias("start"), lines.alias("lines"), start.alias("begin"))

    pairs = F.filter(
        F.transform("filled", lambda i, k: span(i, F.get("filled", k + 1) - i + 1)),
        lambda pair: pair["lines"].isNotNull())
    alone = F.transform("long", lambda i: span(i, F.lit(1)))
    rows = held(rows, "id", "digest", "lines", spans=F.concat(pairs, alone))
    rows = held(rows, "id", "digest", texts=F.transform("spans", lambda s: F.struct(
        *[s[name].alias(name) for name in SPAN], _text_of(s).alias("text"))))
    return rows.select("id", "digest", F.transform("texts", lambda c: F.struct(
        *[c[name].alias(name) for name in SPAN], *_key(c["text"]))).alias("chunks"))


def _length(span: Column) -> Column:
    """Lines of what is compared of a chunk."""
    return span["start"] + span["lines"] - span["begin"]


def _text_of(span: Column) -> Column:
    return F.array_join(F.slice("lines", span["begin"], _length(span)), "\n")


def _key(text: Column) -> tuple[Column, ...]:
    return (F.xxhash64(text).alias("key"), F.hash(text).alias("check"),
            F.octet_length(text).alias("bytes"))


def removals(
    docs: DataFrame, id_column: str = "doc_id", text: str = "text", whole: bool = False,
) -> DataFrame:
    """id, digest of the text, and the ``removed`` ranges of its lines, where there are any.

    Chunks are counted by hashes first; only texts of chunks that may be repeated
    are then brought together and compared as they are, byte by byte.  Hashes
    that stand for several texts remove nothing.  Of equal chunks the one of the
    smallest id, then digest, then line stays.  All counts are aggregated before the
    shuffle; hot chunks are joined by keys that adaptive execution can split.

    With ``whole`` these are ``windows``, whose ranges may overlap; a copy that
    overlaps the first one leaves it its lines.  Of a line that is removed a copy
    stays: it lies in an earlier window, and so on to the first that stays.
    """
    found = settled((windows if whole else chunks)(docs, id_column, text), "chunks")
    single = found.select("id", "digest", F.inline("chunks"))
    classes = single.groupBy("key", "check", "bytes").agg(
        F.count("*").alias("n"),
        F.min(F.struct("id", "digest", "start", *["lines"] * whole)).alias("first"))
    repeated = settled(classes.filter("n > 1"), "repeated")
    copies = settled(_joined(single, repeated), "copies")

    wanted = wanted_spans(copies)
    texts = _with_lines(docs, id_column, text).join(
        wanted.select(F.col("id").alias("wanted_id"), F.col("digest").alias("wanted_digest"),
                      "spans").hint("shuffle_hash"),
        F.col("id").eqNullSafe(F.col("wanted_id")) & (F.col("digest") == F.col("wanted_digest")))
    texts = held(texts, "spans", lines=_lines(F.col("text"))).select(
        F.explode(F.transform("spans", _text_of)).alias("text"))
    keyed = texts.distinct().select(*_key(F.col("text")), "text")
    verified = keyed.groupBy("key", "check", "bytes").count().filter("count = 1")
    removed = _joined(copies, settled(verified.select("key", "check", "bytes"), "verified")).filter(
        ~F.struct("id", "digest", "start", *["lines"] * whole).eqNullSafe(F.col("first")))
    if whole:
        own = (F.col("id").eqNullSafe(F.col("first.id"))
               & (F.col("digest") == F.col("first.digest")))
        begin = F.when(own, F.greatest("start", F.col("first.start") + F.col("first.lines")))
        removed = removed.withColumn("rest", F.coalesce(begin, "start")).select(
            "id", "digest", F.col("rest").alias("start"),
            (F.col("start") + F.col("lines") - F.col("rest")).alias("lines")).filter("lines > 0")
    return removed.groupBy("id", "digest").agg(
        F.array_sort(F.collect_set(F.struct("start", "lines"))).alias("removed"))


def wanted_spans(copies: DataFrame) -> DataFrame:
    """(id, digest, spans): what is to be compared of each document, once for all its equal rows."""
    return copies.groupBy("id", "digest").agg(F.collect_set(F.struct(*SPAN)).alias("spans"))


def _joined(single: DataFrame, classes: DataFrame) -> DataFrame:
    """The chunks of the given classes, with the classes' other columns."""
    more = [name for name in classes.columns if name not in ("key", "check", "bytes", "n")]
    right = classes.select(
        fresh_key("key").alias("class_key"), F.col("check").alias("class_check"),
        F.col("bytes").alias("class_bytes"), *more)
    same = ((fresh_key("key") == F.col("class_key")) & (F.col("check") == F.col("class_check"))
            & (F.col("bytes") == F.col("class_bytes")))
    return single.join(right, same).drop("class_key", "class_check", "class_bytes")


def _with_lines(docs: DataFrame, id_column: str, text: str) -> DataFrame:
    return docs.select(
        F.col(id_column).alias("id"), F.xxhash64(text).alias("digest"), F.col(text).alias("text"))


def dedup(
    docs: DataFrame, id_column: str = "doc_id", text: str = "text", report: str | None = None,
    whole: bool = False,
) -> DataFrame:
    """``docs`` without the repeated chunks of lines in ``text``; all rows and columns stay.

    With ``whole``, passages are followed by ``windows`` of two lines instead of chunks,
    so they go wholly wherever they stand, short ones too; reported ranges may overlap.

    ``report`` names a further column for what was removed, ranges of ``start`` and
    ``lines``, lines counted from 1.  A text of which nothing is left is empty, null
    stays null; rows equal in id and text are one document and keep the same
    lines; null ids come first in order; an empty table stays empty.
    """
    names = docs.columns
    digest, id_, id_digest, removed, lines = fresh_names((*names, report or ""), *[
        f"line_dedup_{name}" for name in ("digest", "id", "id_digest", "removed", "lines")])
    found = removals(docs, id_column, text, whole).select(
        F.col("id").alias(id_), F.col("digest").alias(id_digest),
        F.col("removed").alias(removed))
    marked = docs.withColumn(digest, F.xxhash64(text))
    same = (F.col(id_column).eqNullSafe(F.col(id_))
            & (F.col(digest) == F.col(id_digest)))
    joined = marked.join(found.hint("shuffle_hash"), same, "left")
    rows = held(
        joined, *names, removed,
        **{lines: F.when(F.col(removed).isNotNull(), _lines(F.col(text)))})
    n = F.size(removed)

    def between(k: Column) -> Column:
        """The lines between a removed range and the next."""
        last = F.get(removed, k - 1)
        begin = F.when(k > 0, last["start"] + last["lines"]).otherwise(1)
        end = F.when(k < n, F.get(removed, k)["start"]).otherwise(
            F.size(lines) + 1)
        length = end - begin
        return F.slice(lines, begin, F.greatest(F.lit(0), length) if whole else length)

    left = F.array_join(F.flatten(F.transform(F.sequence(F.lit(0), n), between)), "\n")
    cleaned = F.when(F.col(removed).isNull(), F.col(text)).otherwise(left)
    ranges = F.coalesce(removed, F.array().cast(RANGE))
    more = [ranges.alias(report)] if report else []
    return rows.select(*[cleaned.alias(name) if name == text else F.col(name) for name in names],
                       *more)
