"""Quality rules as a ledger of bits: measured and judged once, decided by any policy later."""

from __future__ import annotations

import re
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sunmeter.llm.common import WORD, map_rows

MEASUREMENTS = (
    "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines",
    "n_capital_words",
)

# Each rule by name: true where a text fails.  A rule's place is its bit and never
# changes; new rules are added at the end.
RULES: dict[str, Callable[[], Column]] = {
    "few_words": lambda: F.col("n_words") < 50,
    "repeated_windows": lambda: 100 * F.col("n_repeat_words") > 50 * F.col("n_words"),
    "symbols": lambda: 10 * F.col("n_symbols") > F.col("n_words"),
    "duplicate_lines": lambda: 2 * F.col("n_dup_lines") > F.col("n_lines"),
    "short_words": lambda: 2 * F.col("word_chars") < 5 * F.col("n_words"),
    "long_words": lambda: F.col("word_chars") > 12 * F.col("n_words"),
    "capitals": lambda: 2 * F.col("n_capital_words") > F.col("n_words"),
}
BITS = {name: 1 << place for place, name in enumerate(RULES)}

# Versions of the policy, each the rules that reject.
POLICIES: dict[str, tuple[str, ...]] = {
    "base": ("few_words", "repeated_windows"),
    "1": ("few_words", "repeated_windows", "symbols", "duplicate_lines"),
    "2": tuple(RULES),
}
LATEST = "2"


def mask(policy: str) -> int:
    return sum(BITS[name] for name in POLICIES[policy])


def measure_text(text: str | None) -> tuple[int, ...]:
    """The measurements of one text, in order of ``MEASUREMENTS``; null is an empty text."""
    text = text or ""
    words = _WORDS(text)
    lines = [line for line in text.split("\n") if _HAS_WORD(line)]
    capitals = sum(1 for word in words if _CAPITAL(word) and not _SMALL(word))
    symbols = len(text) - len(text.translate(_NO_SYMBOLS))
    return (len(words), sum(map(len, words)), symbols, len(lines) - len(set(lines)),
            repeated_words(words), len(lines), capitals)


_WORDS = re.compile(WORD).findall
_HAS_WORD = re.compile(WORD).search
_CAPITAL = re.compile("[A-Z]").search
_SMALL = re.compile("[a-z]").search
_NO_SYMBOLS = {ord(char): None for char in "#*$%&|<>"}


def repeated_words(words: list[str], size: int = 3) -> int:
    """Words that lie in a window of ``size`` words found twice or more, the first included."""
    n = len(words) - size + 1
    if n < 2:
        return 0
    numbers: dict[str, int] = {}
    codes = np.fromiter(
        (numbers.setdefault(word, len(numbers)) for word in words), np.int64, len(words))
    windows = codes[:n]
    for shift in range(1, size):  # numbers of windows of 2, 3, ... words; all stay below n²
        windows = windows * len(numbers) + codes[shift:n + shift]
        if shift < size - 1:
            windows = np.unique(windows, return_inverse=True)[1]
    _, place, count = np.unique(windows, return_inverse=True, return_counts=True)
    starts = np.flatnonzero(count[place] > 1)
    covered = np.zeros(len(words), bool)
    for shift in range(size):
        covered[starts + shift] = True
    return int(covered.sum())


def ledger(docs: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: the measurements and ``failed_bits``, one bit per failed rule.

    Every rule is evaluated once, whatever policies ask later.  A null text
    counts as empty and fails ``few_words`` only; repeated rows give repeated
    rows, a null id stays null, other columns of ``docs`` are not read.
    """
    kind = docs.schema[id_column].dataType.simpleString()
    ddl = f"`{id_column}` {kind}, " + ", ".join(f"{name} long" for name in MEASUREMENTS)
    measured = map_rows(
        docs.select(id_column, text), lambda: lambda key, value: (key, *measure_text(value)), ddl)
    bits = [F.when(rule(), BITS[name]).otherwise(0) for name, rule in RULES.items()]
    total = bits[0]
    for bit in bits[1:]:
        total = total.bitwiseOR(bit)
    return measured.withColumn("failed_bits", total.cast("long"))


def fails(policy: str = LATEST) -> Column:
    """Whether a ledger row fails any rule of ``policy``."""
    return F.col("failed_bits").bitwiseAND(F.lit(mask(policy))) != 0


def apply_policy(rows: DataFrame, policy: str = LATEST) -> DataFrame:
    """The ledger with the verdict of one version of the policy as ``kept``."""
    return rows.withColumn("kept", ~fails(policy))


def ablations(rows: DataFrame, policy: str = LATEST) -> DataFrame:
    """What each rule of a policy does: one row per rule.

    ``failed``: rows that fail it; ``failed_alone``: those that would be kept
    without it; ``kept`` and ``kept_without``: rows kept with all rules and
    without this one.  The ledger is first counted by its bits, of which there
    are at most 2 ** number of rules, so nothing but those counts is shuffled.
    No rows give counts of zero.
    """
    all_bits = mask(policy)
    counts = rows.groupBy(F.col("failed_bits").bitwiseAND(F.lit(all_bits)).alias("bits")).count()

    def total(condition: Column) -> Column:
        return F.coalesce(F.sum(F.when(condition, F.col("count"))), F.lit(0))

    figures = []
    for name in POLICIES[policy]:
        rest = F.col("bits").bitwiseAND(F.lit(all_bits & ~BITS[name]))
        figures.append(F.struct(
            F.lit(name).alias("rule"),
            total(F.col("bits").bitwiseAND(F.lit(BITS[name])) != 0).alias("failed"),
            total(F.col("bits") == BITS[name]).alias("failed_alone"),
            total(F.col("bits") == 0).alias("kept"),
            total(rest == 0).alias("kept_without"),
        ))
    return counts.agg(F.array(*figures).alias("rules")).select(F.inline("rules"))
