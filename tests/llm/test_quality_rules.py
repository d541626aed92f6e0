"""The ledger against plain Python, policies and ablations against plain counts."""

import random
import re
from collections import Counter

import pytest

from sunmeter.llm import quality


def plain(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = list(zip(words, words[1:], words[2:]))
    times = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if times[w] > 1 for k in range(3)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""),
            sum(x in lines[:i] for i, x in enumerate(lines)), len(covered), len(lines))


TEXTS = [None, "", " \n\t ", "a", "a b c a b c", "a a a a", "x\x0by\x85z w", "L\nL\n\nL \nL",
         "#*$%&|<>!", "ÀB É 中文 " * 30, "w " * 60, "SHOUT LOUD " * 40]


def test_texts_are_measured_as_in_plain_python():
    rnd = random.Random(3)
    random_texts = ["".join(rnd.choice("ab \n#") for _ in range(rnd.randint(0, 80)))
                    for _ in range(500)]
    for text in TEXTS + random_texts:
        assert quality.measure_text(text)[:6] == plain(text)


@pytest.fixture(scope="module")
def rows(spark):
    data = [(i, text) for i, text in enumerate(TEXTS)] + [(None, "one two"), (3, "a"), (3, "a")]
    data += [(100 + i, " ".join(f"word{j}" for j in range(60))) for i in range(5)]
    docs = spark.createDataFrame(data, "doc_id long, text string").selectExpr(
        "*", "7 as n_words", "true as kept")
    return quality.ledger(docs).cache()


def test_every_row_has_one_entry(rows):
    assert rows.count() == len(TEXTS) + 8
    assert rows.filter("doc_id = 3").count() == 3
    assert rows.filter("n_words = 0").select("failed_bits").distinct().collect()[0][0] == 1


def test_policies_only_read_bits(rows):
    for name, rules in quality.POLICIES.items():
        for row in quality.apply_policy(rows, name).collect():
            assert row["kept"] == all(not row["failed_bits"] & quality.BITS[r] for r in rules)


def test_ablations(rows):
    bits = [r["failed_bits"] for r in rows.collect()]
    for name, rules in quality.POLICIES.items():
        mask = quality.mask(name)
        for row in quality.ablations(rows, name).collect():
            bit = quality.BITS[row["rule"]]
            assert row["failed"] == sum(bool(b & bit) for b in bits)
            assert row["failed_alone"] == sum(b & mask == bit for b in bits)
            assert row["kept"] == sum(not b & mask for b in bits)
            assert row["kept_without"] == sum(not b & mask & ~bit for b in bits)


def test_nothing(rows):
    none = rows.limit(0)
    assert {r["kept"] for r in quality.ablations(none).collect()} == {0}
    assert quality.apply_policy(none).count() == 0


def test_bits_keep_their_places():
    assert list(quality.BITS.values()) == [1, 2, 4, 8, 16, 32, 64]
    assert [*quality.BITS][:2] == ["few_words", "repeated_windows"]
