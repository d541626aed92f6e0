"""Chunks of lines against plain Python; nothing but SQL functions in the plan."""

import hashlib
import random
import re

import pytest
from helpers import plan
from pyspark.sql import functions as F

from sunmeter.llm import line_dedup


def words(line):
    return len(re.findall(r"[^\x20\x09-\x0D]+", line))


def plain_chunks(text):
    lines = (text or "").split("\n")
    hashes = [int(hashlib.md5(line.encode()).hexdigest()[:7], 16) for line in lines]
    out, chunk = [], []
    for i, line in enumerate(lines):
        chunk.append(line)
        rolled = hashes[i] + line_dedup.WINDOW_BASE * (hashes[i - 1] if i else 0)
        last = i == len(lines) - 1
        if (last or words(line) > 50 or words(lines[i + 1]) > 50
                or rolled % line_dedup.WINDOW_MODULUS % line_dedup.CHUNK_LINES == 0):
            out.append(chunk)
            chunk = []
    return out


def compared(text):
    """(start, chunk, what is compared of it, whether it may be removed)."""
    out, before, start = [], None, 1
    for chunk in plain_chunks(text):
        alone = before is not None and len(chunk) == 1 and words(chunk[0]) <= 50
        region = before + chunk if alone else chunk
        may = sum(words(x) > 0 for x in region) >= 2 or words(chunk[0]) > 50
        out.append((start, chunk, "\n".join(region), may))
        before, start = chunk, start + len(chunk)
    return out


def plain_dedup(rows):
    first = {}
    for key, text in sorted(rows, key=lambda r: r[0]):
        for start, _, region, may in compared(text):
            if may:
                first.setdefault(region, (key, start))
    out = {}
    for key, text in rows:
        left = [line for start, chunk, region, may in compared(text)
                if not may or first[region] == (key, start) for line in chunk]
        out[key] = None if text is None else "\n".join(left)
    return out


@pytest.fixture(scope="module")
def rows():
    rnd = random.Random(5)
    short = [" ".join(rnd.choice(["red", "green", "blue", "old"]) for _ in range(rnd.randint(0, 5)))
             for _ in range(40)]
    long = [" ".join(f"p{i}w{j}" for j in range(60)) for i in range(4)]
    passage = [f"passage line {i} here" for i in range(40)]
    out = [(i, "\n".join(rnd.choice(short + long) for _ in range(rnd.randint(0, 12))))
           for i in range(150)]
    out += [(200 + i, "\n".join([f"own {i}", *passage, f"end {i}"])) for i in range(5)]
    out += [(300 + i, "same\ntext\nin many\ncopies") for i in range(30)]
    out += [(400, None), (401, ""), (402, "\n\n\n"), (403, "one line"), (404, "x\n" * 3000)]
    return out


def test_as_in_plain_python(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("removed", F.lit(1))
    got = line_dedup.dedup(docs)
    assert got.columns == docs.columns
    assert {r["doc_id"]: r["text"] for r in got.collect()} == plain_dedup(rows)


def test_a_passage_is_cut_out_wherever_it_stands(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["text"] for r in line_dedup.dedup(docs).collect()}
    for i in range(1, 5):
        left = got[200 + i].split("\n")
        assert f"own {i}" == left[0] and f"end {i}" == left[-1]
        assert len(left) <= 8
    assert "passage line 5 here" in got[200]
    assert got[301].count("\n") < 3


def test_long_lines_are_found_alone(spark):
    line = " ".join(f"w{j}" for j in range(51))
    docs = spark.createDataFrame(
        [(1, f"a\n{line}\nb"), (2, f"{line}\nc"), (3, line[:-4])], "doc_id long, text string")
    got = {r["doc_id"]: r["text"] for r in line_dedup.dedup(docs).collect()}
    assert got == {1: f"a\n{line}\nb", 2: "c", 3: line[:-4]}


def test_equal_hashes_of_other_texts_remove_nothing(spark, monkeypatch):
    same = (F.lit(1).cast("long").alias("key"), F.lit(1).alias("check"), F.lit(1).alias("bytes"))
    monkeypatch.setattr(line_dedup, "_key", lambda text: same)
    docs = spark.createDataFrame([(1, "a\nb"), (2, "c\nd")], "doc_id long, text string")
    assert {r["text"] for r in line_dedup.dedup(docs).collect()} == {"a\nb", "c\nd"}


def test_repeated_and_null_ids(spark):
    docs = spark.createDataFrame(
        [(None, "a\nb c"), (1, "a\nb c"), (1, "a\nb c"), (1, "x\ny"), (2, "x\ny")],
        "doc_id long, text string")
    got = sorted(map(str, line_dedup.dedup(docs, report="cut").select("doc_id", "text").collect()))
    kept = line_dedup.dedup(docs).filter("text <> ''").collect()
    assert len(got) == 5 and {r["doc_id"] for r in kept} >= {None, 1}
    assert line_dedup.dedup(docs.limit(0)).count() == 0


def test_only_sql_functions(spark, rows):
    docs = spark.createDataFrame(rows[:20], "doc_id long, text string")
    text = plan(line_dedup.chunks(docs, "doc_id", "text")) + plan(line_dedup.dedup(docs))
    assert not re.search("Python|Pandas|Arrow", text)


def test_short_passages_go_wholly(spark):
    """Passages of 2 to 6 short lines between foreign lines, blank lines in some of them."""
    docs, want = [], {}
    for i in range(60):
        passage = [f"line {i} {j} of it" for j in range(2 + i % 5)]
        if i % 3 == 0:
            passage.insert(1, "")
        for copy in range(2):
            around = [[f"own {i} {copy} {side} {j}" for j in range(3)] for side in "ab"]
            docs.append((2 * i + copy, "\n".join([*around[0], *passage, *around[1]])))
            want[2 * i + copy] = "\n".join(
                [*around[0], *(passage if copy == 0 else []), *around[1]])
    got = line_dedup.dedup(spark.createDataFrame(docs, "doc_id long, text string"), whole=True)
    assert {r["doc_id"]: r["text"] for r in got.collect()} == want
    assert not re.search("Python|Pandas|Arrow", plan(got))


def test_whole_passages_against_plain_python(spark, rows):
    def spans(text):
        lines = (text or "").split("\n")
        filled = [i for i, line in enumerate(lines) if words(line)]
        out = [(i, j + 1) for i, j in zip(filled, filled[1:])]
        return lines, out + [(i, i + 1) for i in filled if words(lines[i]) > 50]

    first = {}
    for key, text in sorted(rows, key=lambda r: r[0]):
        lines, found = spans(text)
        for i, j in sorted(found):
            first.setdefault("\n".join(lines[i:j]), (key, i, j))
    want = {}
    for key, text in rows:
        lines, found = spans(text)
        gone = set()
        for i, j in found:
            at, begin, end = first["\n".join(lines[i:j])]
            if (at, begin) != (key, i):
                gone |= set(range(max(i, end) if at == key else i, j))
        want[key] = None if text is None else "\n".join(
            line for i, line in enumerate(lines) if i not in gone)
    got = line_dedup.dedup(spark.createDataFrame(rows, "doc_id long, text string"), whole=True)
    assert {r["doc_id"]: r["text"] for r in got.collect()} == want


def test_equal_rows_are_compared_once(spark):
    """Rows of one id and text ask for the same spans, however many they are."""
    text = "\n".join(f"line {k} of some words" for k in range(40))

    def spans(n):
        docs = spark.createDataFrame([(None, text)] * n + [(1, text)], "doc_id long, text string")
        found = line_dedup.chunks(docs, "doc_id", "text")
        single = found.select("id", "digest", F.inline("chunks"))
        return sorted(F_size for F_size, in line_dedup.wanted_spans(single).select(
            F.size("spans")).collect())

    assert spans(2) == spans(200) and len(spans(200)) == 2


def test_thousands_of_equal_rows(spark):
    docs = spark.createDataFrame([(None, "one line here\nand one more\nthe end of it")] * 5000 + [
        (3, "one line here\nand one more\nthe end of it")], "doc_id long, text string")
    for whole in (False, True):
        rows = line_dedup.dedup(docs, whole=whole)
        assert rows.groupBy("doc_id", "text").count().count() == 2 and rows.count() == 5001


def test_columns_with_the_names_of_our_own(spark):
    docs = spark.createDataFrame(
        [(k, "some words\nsome more words\nend of them", "mine", "ours") for k in range(3)],
        "doc_id long, text string, line_dedup_digest string, line_dedup_removed string")
    rows = line_dedup.dedup(docs)
    assert rows.columns == docs.columns
    assert {(r["line_dedup_digest"], r["line_dedup_removed"]) for r in rows.collect()} == {
        ("mine", "ours")}
