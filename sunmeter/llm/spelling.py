"""Spelling variants: words one edit apart, found by bitsets per position and letter."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sunmeter.llm.common import flat_map_rows, fresh_key, settled

# A run of letters, and the letters that have a small form here.
RUN = r"[A-Za-zÀ-ÿ]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

LEAST_CHARS = 7
LEAST_COUNT = 2
RATIO = 10  # a form is so many times as frequent
BLOCK_WORDS = 2_048
# Words that agree before place ``low`` and behind ``high`` of the shorter one.
RANGE = ("chars", "low", "high")


def runs(docs: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, word) of all runs of letters in whole texts, A-Z as a-z; null texts have none."""
    lowered = F.translate(F.col(text), UPPER, LOWER)
    return docs.select(
        F.col(id_column).alias("id"),
        F.explode(F.regexp_extract_all(lowered, F.lit(RUN), F.lit(0))).alias("word"))


def count_words(
    words: DataFrame, least_chars: int = LEAST_CHARS, least_count: int = LEAST_COUNT,
) -> DataFrame:
    """(word, n) of the words long and frequent enough; counted before the shuffle too."""
    long = words.filter(F.length("word") >= least_chars)
    return long.groupBy("word").agg(F.count("*").alias("n")).filter(F.col("n") >= least_count)


class Block:
    """Bitsets over the words of a block: for each place and letter the words that have it there.

    A word of the block is looked up by one walk over its letters.  All words at once
    are bits of an integer: ``same`` those that agree so far; ``other`` those with one
    other letter so far; ``longer`` those with one letter more, whose places are
    shifted by one.  A word that leaves ``same`` joins the other two, which hold
    what goes on to agree.  The place where it leaves is where the two words first
    differ; only places from ``low`` to before ``high`` count, so every two words
    meet in one block only.
    """

    def __init__(self, chars: int, low: int, high: int, words: list[str]):
        self.chars, self.low, self.high, self.words = chars, low, high, words
        self.at: list[dict[str, int]] = [{} for _ in range(chars + 1)]
        self.short = self.long = 0
        for number, word in enumerate(words):
            bit = 1 << number
            if len(word) == chars:
                self.short |= bit
            else:
                self.long |= bit
            for have, letter in zip(self.at, word):
                have[letter] = have.get(letter, 0) | bit

    def near(self, word: str) -> tuple[int, int]:
        """The words as long as ``word`` that are near it, and those one letter longer."""
        same, other, longer = self.short | self.long, 0, 0
        low, high, at = self.low, self.high, self.at
        for place, letter in enumerate(word):
            here = at[place].get(letter, 0)
            if place < low:
                same &= here
                continue
            shifted = at[place + 1].get(letter, 0)
            if place < high:
                left = same & ~here
                same &= here
                other = other & here | left
                longer = (longer | left) & shifted
            else:
                other &= here
                longer &= shifted
                if not other and not longer:
                    return 0, 0
        if high > self.chars:  # one letter more at the end
            longer |= same
        return other & self.short, longer & self.long

    def links(self, counts: list[int]) -> list[tuple[str, int, int, str]]:
        """(word, near words, count and word of the most frequent of them) within the block."""
        words = self.words
        n_near = [0] * len(words)
        best = [(0, "")] * len(words)  # less count, word: the least is the form

        def link(one: int, two: int) -> None:
            n_near[one] += 1
            best[one] = min(best[one], (-counts[two], words[two]))

        for number, word in enumerate(words):
            if len(word) != self.chars:
                continue
            same_length, longer = self.near(word)
            for other in _numbers(same_length):
                link(number, other)
            for other in _numbers(longer):
                link(number, other)
                link(other, number)
        return [(word, n, -least, form)
                for word, n, (least, form) in zip(words, n_near, best) if n]


def _numbers(bits: int) -> list[int]:
    found = []
    while bits:
        least = bits & -bits
        found.append(least.bit_length() - 1)
        bits ^= least
    return found


def _key(word: Column, low: Column, high: Column, chars: Column) -> Column:
    """What words have in common that agree before ``low`` and behind ``high``."""
    behind = F.greatest(chars - high, F.lit(0))
    return F.xxhash64(chars, low, high, F.substring(word, F.lit(1), low),
                      F.when(behind > 0, F.substring(word, -behind, behind)))


def _members(rows: DataFrame, ranges: Column) -> DataFrame:
    """A row for each range of a word, with its block's ``key``."""
    dealt = rows.select("word", "n", F.inline(ranges))
    key = _key(F.col("word"), F.col("low"), F.col("high"), F.col("chars"))
    return dealt.select(key.alias("key"), *RANGE, "word", "n")


def _range(chars: Column, low: Column, high: Column) -> Column:
    return F.struct(*[
        value.cast("int").alias(name) for value, name in zip((chars, low, high), RANGE)])


def memberships(vocabulary: DataFrame) -> DataFrame:
    """The blocks of each word: two near words of n and n, or n + 1, letters first differ
    in the former half of the n or in the latter, and agree in the other."""
    def halves(chars: Column) -> list[Column]:
        half = F.floor(chars / 2)
        return [_range(chars, F.lit(0), half), _range(chars, half, chars + 1)]

    n = F.length("word")
    return _members(vocabulary, F.array(*halves(n), *halves(n - 1)))


def blocks(vocabulary: DataFrame, most: int = BLOCK_WORDS) -> DataFrame:
    """Blocks of at most ``most`` words, or of one place: (chars, low, high, words, counts).

    A block with more words is divided: the two words of a pair first differ in the
    former half of its places or in the latter, so they agree in more letters.
    That ends with blocks of one place, whose words have at most two letters to choose.
    Blocks of one word hold no pair and are left out.  Sizes are counted before the
    shuffle; members of large blocks are joined by keys that can be split.
    """
    members, small = memberships(vocabulary), []
    while True:
        members = settled(members, "spelling-members")
        sizes = members.groupBy("key", *RANGE).agg(F.count("*").alias("size"))
        large = settled(sizes.filter(
            (F.col("size") > most) & (F.col("high") - F.col("low") > 1)
        ).select(fresh_key("key").alias("large"), *[
            F.col(name).alias(f"large_{name}") for name in RANGE]), "spelling-large")
        if large.isEmpty():
            break
        same = fresh_key("key") == F.col("large")
        for name in RANGE:
            same = same & (F.col(name) == F.col(f"large_{name}"))
        small.append(members.join(large, same, "left_anti"))
        middle = F.floor((F.col("low") + F.col("high")) / 2)
        members = _members(members.join(large, same, "left_semi"), F.array(
            _range(F.col("chars"), F.col("low"), middle),
            _range(F.col("chars"), middle, F.col("high"))))
    for rows in small:
        members = members.unionByName(rows)
    gathered = members.groupBy("key", *RANGE).agg(
        F.collect_list(F.struct("word", "n")).alias("members"))
    return gathered.filter(F.size("members") > 1).select(
        *RANGE, F.col("members.word").alias("words"), F.col("members.n").alias("counts"))


def near_words(vocabulary: DataFrame, most: int = BLOCK_WORDS) -> DataFrame:
    """(word, n_near, form_n, form): how many words are near, and the most frequent of them.

    Of equally frequent ones the form is the smallest.  Words without near ones are left out.
    """
    def links(chars, low, high, words, counts):
        return Block(chars, low, high, words).links(counts)

    found = flat_map_rows(
        blocks(vocabulary, most), lambda: links,
        "word string, n_near long, form_n long, form string")
    best = F.min(F.struct((-F.col("form_n")).alias("less"), "form"))
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("best")).select(
        "word", "n_near", (-F.col("best.less")).alias("form_n"), F.col("best.form").alias("form"))


def _roots(forms: DataFrame) -> DataFrame:
    """(word, root) of words with a form: where a walk from form to form ends.

    Each round doubles the length of the walks.  Forms are ever more frequent, by a factor, so a
    walk has a step for each digit of a count at most, and few rounds are needed.
    """
    walks = settled(forms.select("word", F.col("form").alias("root")), "spelling-walks")
    while True:
        further = walks.select(F.col("word").alias("via"), F.col("root").alias("next"))
        joined = settled(walks.join(further, F.col("root") == F.col("via"), "left").select(
            "word", "root", "next"), "spelling-walks")
        walks = joined.select("word", F.coalesce("next", "root").alias("root"))
        if joined.filter("next is not null").isEmpty():
            return walks


def variants(
    vocabulary: DataFrame, ratio: int = RATIO, most: int = BLOCK_WORDS,
) -> DataFrame:
    """One row per word of ``vocabulary`` (word, n): ``form``, ``root``, ``n``, ``n_near``, ``form_n``.

    Words are near if one inserted, deleted or replaced code point makes one of the
    other.  A word's form is its most frequent near word, the smallest of equally
    frequent ones, where that is ``ratio`` times as frequent; else null.  Its root is where
    a walk from form to form ends, the word itself if it has none.

    Words are the vocabulary's, each once, with counts of 1 or more; rows without a
    word are left out.  Words of any length are taken whole.  An empty vocabulary has no rows.
    """
    if ratio < 2:
        raise ValueError("a walk from form to form must end")
    known = settled(vocabulary.filter("word is not null").select("word", "n"), "spelling-words")
    near = near_words(known, most)
    is_form = F.col("form_n") >= ratio * F.col("n")
    rows = settled(known.join(near, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(is_form, F.col("form")).alias("form"),
        F.when(is_form, F.col("form_n")).alias("form_n")), "spelling-forms")
    roots = _roots(rows.filter("form is not null"))
    return rows.join(roots, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
