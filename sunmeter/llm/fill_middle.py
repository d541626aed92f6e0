"""Fill-in-the-middle: texts cut at two ranks of their units, found in an indexable skip list."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from sunmeter.llm.common import held, small_batches

# The marks before prefix, suffix and middle, and the forms of a text.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
PLAIN, PSM, SPM = "plain", "psm", "spm"

SEED = "1"
PLAIN_FROM = 90  # of 100: the others stay plain
SPM_BELOW = 20  # of 100 that are cut: the suffix comes first
LANE_BITS = 4  # a lane has one in 2 ** LANE_BITS of the nodes of the lane below
BLOCK_CHARS = 1 << 20  # code points that are looked at at a time
CUTS = StructType([
    StructField(name, LongType()) for name in ("n", "prefix_chars", "middle_chars")])


def unit_widths(text: str) -> np.ndarray:
    """Code points of each unit: a run of A-Z and a-z, or any other code point."""
    starts, in_run = [], False
    for begin in range(0, len(text), BLOCK_CHARS):
        block = text[begin:begin + BLOCK_CHARS].encode("utf-32-le", "surrogatepass")
        codes = np.frombuffer(block, np.uint32)
        letter = ((codes | 32) - np.uint32(97)) < 26  # below "a" it wraps around
        goes_on = letter.copy()
        goes_on[1:] &= letter[:-1]
        goes_on[0] &= in_run
        in_run = bool(letter[-1])
        starts.append((np.flatnonzero(~goes_on) + begin).astype(np.int64))
    if not starts:
        return np.zeros(0, np.int32)
    return np.diff(np.concatenate(starts), append=len(text)).astype(np.int32)


def _heights(n: int) -> np.ndarray:
    """A number for each place whose low zero bits are geometrically distributed, always the same."""
    mixed = (np.arange(n, dtype=np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    mixed ^= mixed >> np.uint64(29)
    mixed *= np.uint64(0xBF58476D1CE4E5B9)
    return mixed ^ (mixed >> np.uint64(32))


class SkipList:
    """The units of a text, indexable by rank: where in the text does the k-th unit begin?

    The lowest lane has all units.  Each express lane has some of the nodes of the
    lane below, by the height of the unit, and always the first.  A node carries
    how many units and how many code points lie up to the next node of its lane, and
    its place in the lane below.  A search walks the highest lane as far as its
    rank allows, then goes on one lane lower: about ``2 ** LANE_BITS`` steps a lane,
    whatever the length.
    """

    def __init__(self, widths: np.ndarray):
        self.size = len(widths)
        heights = _heights(self.size)
        units, chars, below = np.ones(self.size, np.int32), widths, None
        self.lanes = [(units, chars, below)]
        while len(units) > 1 << LANE_BITS:
            kept = (heights & np.uint64((1 << LANE_BITS) - 1)) == 0
            kept[0] = True
            below = np.flatnonzero(kept)
            if len(below) == len(units):
                break
            heights = heights[below] >> np.uint64(LANE_BITS)
            units, chars = np.add.reduceat(units, below), np.add.reduceat(chars, below)
            self.lanes.append((units, chars, below))

    def offset(self, rank: int) -> int:
        """Code points before the unit of this rank; all of them from the last rank on."""
        passed = at = offset = 0
        for units, chars, below in reversed(self.lanes):
            n = len(units)
            while at < n and passed + units[at] <= rank:
                passed += int(units[at])
                offset += int(chars[at])
                at += 1
            if at == n:
                break
            at = at if below is None else int(below[at])
        return offset


def cut(text: str, first: int, second: int) -> tuple[int, int, int]:
    """Units of a text, and the code points before and between its two cuts.

    The cuts fall after ``first`` and ``second`` units, modulo one more than there are.
    """
    units = SkipList(unit_widths(text))
    low, high = sorted((first % (units.size + 1), second % (units.size + 1)))
    begin = units.offset(low)
    return units.size, begin, units.offset(high) - begin


@F.arrow_udf(CUTS)
def _cuts(batches: Iterator[tuple[pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    for batch in batches:
        found = [cut(*values) for values in zip(*(column.to_pylist() for column in batch))]
        columns = zip(*found) if found else ((), (), ())
        yield pa.StructArray.from_arrays(
            [pa.array(column, pa.int64()) for column in columns], CUTS.names)


def transform(
    docs: DataFrame, id_column: str = "doc_id", text: str = "text", seed: str = SEED,
    plain_from: int = PLAIN_FROM, spm_below: int = SPM_BELOW,
) -> DataFrame:
    """One row per document: id, ``n``, ``form``, ``prefix_chars``, ``middle_chars``, ``output``.

    A text is cut after two numbers of units, chosen by a hash of the seed and the id,
    and its parts change places: prefix, suffix, middle, or suffix, prefix, middle,
    each behind its mark.  It stays plain where the hash says so, where it is empty, or
    where it holds a mark itself, so every output can be undone (``restore``).  Only
    texts go to Python, and three numbers come back; the parts are put together in the JVM.

    Null texts count as empty, null ids as an empty id; equal ids have equal hashes,
    and repeated rows give repeated rows.  A text is taken whole, however long, its
    code points looked at block by block.  An empty table stays empty; other columns
    are not read.  An id column named like a result is refused.
    """
    results = ("n", "form", "prefix_chars", "middle_chars", "output")
    if id_column in results:
        raise ValueError(f"the id column must not be one of {results}")
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_column).alias("id"), F.col(text).alias("text"))
    digest = F.sha2(F.concat(
        F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))), 256)
    rows = held(rows, "id", text=F.coalesce("text", F.lit("")), digest=digest)

    def number(group: int) -> Column:
        """A group of eight digits of the hash."""
        return F.conv(F.substring("digest", 8 * group - 7, 8), 16, 10).cast("long")

    rows = rows.select(
        "id", "text", _cuts("text", number(1), number(2)).alias("cuts"),
        (number(3) % 100).alias("share"), (number(4) % 100).alias("order"))
    is_plain = F.col("text") == ""
    for mark in (PREFIX, SUFFIX, MIDDLE):
        is_plain = is_plain | F.contains("text", F.lit(mark))
    form = F.when(is_plain | (F.col("share") >= plain_from), PLAIN).when(
        F.col("order") < spm_below, SPM).otherwise(PSM)
    rows = rows.select("id", "text", form.alias("form"), "cuts.*")
    begin, length = F.col("prefix_chars"), F.col("middle_chars")

    def part(start: Column, chars: Column | None = None) -> Column:
        chars = F.length("text") if chars is None else chars
        return F.substring("text", (start + 1).cast("int"), chars.cast("int"))

    prefix = F.concat(F.lit(PREFIX), part(F.lit(0), begin))
    middle = F.concat(F.lit(MIDDLE), part(begin, length))
    suffix = F.concat(F.lit(SUFFIX), part(begin + length))
    output = (F.when(F.col("form") == PSM, F.concat(prefix, suffix, middle))
              .when(F.col("form") == SPM, F.concat(suffix, prefix, middle))
              .otherwise(F.col("text")))
    is_cut = F.col("form") != PLAIN
    return rows.select(
        F.col("id").alias(id_column), "n", "form", F.when(is_cut, begin).alias("prefix_chars"),
        F.when(is_cut, length).alias("middle_chars"), output.alias("output"))


def restored(output: Column, form: Column) -> Column:
    """The text that an output was made of, from output and form alone.

    A text that was cut holds no mark, so the marks in its output are where its
    parts begin.
    """
    parts = F.split(output, "|".join((PREFIX, SUFFIX, MIDDLE)), -1)

    def part(place: int) -> Column:
        return F.get(parts, F.lit(place))

    return (F.when(form == PSM, F.concat(part(1), part(3), part(2)))
            .when(form == SPM, F.concat(part(2), part(3), part(1)))
            .otherwise(output))
