"""Near words, forms and roots against all pairs of words, compared one by one."""

import random
import re
import zlib
from collections import Counter

import pytest

from sunmeter.llm import spelling
from sunmeter.llm.queries import op12_spelling_variants


def edits(word, letters):
    """All that one inserted, deleted or replaced letter makes of a word."""
    for at in range(len(word) + 1):
        yield from (word[:at] + x + word[at:] for x in letters)
        if at < len(word):
            yield word[:at] + word[at + 1:]
            yield from (word[:at] + x + word[at + 1:] for x in letters)


def plainly(counts, ratio=10):
    """word -> form, root, n, n_near, form_n."""
    letters = sorted({letter for word in counts for letter in word})
    near = {word: {other for other in edits(word, letters) if other in counts} - {word}
            for word in counts}
    best = {word: min(others, key=lambda other: (-counts[other], other))
            for word, others in near.items() if others}
    form = {word: other for word, other in best.items() if counts[other] >= ratio * counts[word]}

    def root(word):
        while word in form:
            word = form[word]
        return word

    return {word: (form.get(word), root(word), n, len(near[word]), counts.get(form.get(word)))
            for word, n in counts.items()}


def words_of(seed, n, letters="abc", least=3, most=9):
    rnd = random.Random(seed)
    return {"".join(rnd.choice(letters) for _ in range(rnd.randint(least, most))):
            int(10 ** rnd.uniform(0, 5)) for _ in range(n)}


def found(spark, counts, **options):
    rows = spark.createDataFrame([*counts.items()], "word string, n long")
    got = spelling.variants(rows, **options).collect()
    assert len(got) == len(counts)
    return {r["word"]: tuple(r)[1:] for r in got}


def links_of(words, chars, low, high):
    block = spelling.Block(chars, low, high, words)
    return {(word, words[other]) for word in words if len(word) == chars
            for bits in block.near(word) for other in spelling._numbers(bits)}


def test_a_block_finds_what_first_differs_in_its_places():
    words = sorted(word for word in words_of(1, 3000, "ab", 5, 6))

    def first(one, two):
        return next((k for k, (x, y) in enumerate(zip(one, two)) if x != y), len(one))

    want = {(one, two) for one in words if len(one) == 5
            for two in set(edits(one, "ab")) & set(words) if two != one and len(two) >= 5}
    assert links_of(words, 5, 0, 6) == want
    for low, high in ((0, 2), (2, 6), (2, 3), (5, 6), (3, 5)):
        assert links_of(words, 5, low, high) == {
            (one, two) for one, two in want if low <= first(one, two) < high}


@pytest.mark.parametrize("most", (spelling.BLOCK_WORDS, 20, 1))
def test_variants_are_those_of_all_pairs(spark, most):
    counts = words_of(2, 500) | words_of(3, 200, "aàÿz", 7, 12)
    want = plainly(counts)
    got = found(spark, counts, most=most)
    assert got == want
    assert any(form for form, *_ in want.values())
    assert any(root not in (word, form) for word, (form, root, *_) in want.items())


def test_one_group_of_many_words_is_divided(spark):
    """All words agree but for two letters in the middle, or for one letter more."""
    letters = "abcdefghijklmnopqrstuvwxyz"
    counts = {f"begin{x}{y}endings": 1 + ord(x) * ord(y) for x in letters for y in letters}
    counts |= {f"begin{x}endings": 5 for x in letters}
    assert found(spark, counts, most=100) == plainly(counts)


def test_ties_go_to_the_smallest_word(spark):
    counts = {"aaaaaaa": 1, "aaaaaab": 10, "aaaaaac": 10, "aaaaaaaé": 10, "zaaaaaa": 10}
    got = found(spark, counts)
    assert got["aaaaaaa"] == ("aaaaaaaé", "aaaaaaaé", 1, 4, 10) == plainly(counts)["aaaaaaa"]


def test_walks_end_at_their_roots(spark):
    counts = {"abcdefg" + "z" * k: 10 ** k for k in range(12)}
    got = found(spark, counts)
    assert {root for _, root, *_ in got.values()} == {"abcdefg" + "z" * 11}
    assert got == plainly(counts)


def test_empty_very_long_and_short_words(spark):
    long = "xy" * 20_000
    counts = {long: 1, long[:-1]: 20, "a": 3, "b": 30, "": 300}
    assert found(spark, counts) == plainly(counts)
    empty = spark.createDataFrame([], "word string, n long")
    assert spelling.variants(empty).count() == 0
    assert spelling.variants(spark.createDataFrame([(None, 5)], "word string, n long")).count() == 0


def test_words_of_texts(spark):
    rows = [(1, "Straße ÀÉ x-ray naïve2day"), (None, "one"), (3, None), (4, ""), (4, "Tie tie")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = Counter((r["id"], r["word"]) for r in spelling.runs(docs).collect())
    assert got == Counter([(1, "straße"), (1, "ÀÉ"), (1, "x"), (1, "ray"), (1, "naïve"),
                           (1, "day"), (None, "one"), (4, "tie"), (4, "tie")])


def test_query_is_that_of_all_words(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()
    counts = Counter()
    small = str.maketrans(spelling.UPPER, spelling.LOWER)
    for row in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", row["text"] or ""):
            word = run.translate(small)
            h = zlib.crc32(f"{row['doc_id']}:{word}".encode())
            if h % 31 == 0:
                at = h % len(word)
                word = word[:at] + word[at + 1:]
            counts[word] += 1
    counts = {word: n for word, n in counts.items() if n >= 2 and len(word) >= 7}
    rows = op12_spelling_variants(spark, "/root/testdata/sf0.001")
    assert rows.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    assert {r["word"]: tuple(r)[1:] for r in rows.collect()} == plainly(counts)
