"""Cuts against slices of a list of units; whole rows against a plain version."""

import hashlib
import random
import re

import numpy as np
import pytest

from sunmeter.llm import fill_middle
from sunmeter.llm.queries import op11_fill_middle

UNIT = re.compile("[A-Za-z]+|[^A-Za-z]")


def texts(n, longest, seed=0):
    rnd = random.Random(seed)
    parts = [*"abAZ z1\n\t<[@`{", "é", "😀", "ſ", "K", "word", "\x00", "́"]
    return ["".join(rnd.choice(parts) for _ in range(rnd.randint(0, longest))) for _ in range(n)]


def test_units_are_those_of_the_pattern():
    for text in texts(500, 60):
        assert fill_middle.unit_widths(text).tolist() == [len(u) for u in UNIT.findall(text)]


def test_runs_go_on_over_blocks(monkeypatch):
    want = [[len(u) for u in UNIT.findall(text)] for text in texts(200, 60)]
    monkeypatch.setattr(fill_middle, "BLOCK_CHARS", 3)
    assert [fill_middle.unit_widths(text).tolist() for text in texts(200, 60)] == want


@pytest.mark.parametrize("size", (0, 1, 15, 16, 17, 18, 300, 20_000))
def test_every_rank_is_reached(size):
    widths = np.random.default_rng(size).integers(1, 9, size).astype(np.int32)
    units, before = fill_middle.SkipList(widths), [0, *np.cumsum(widths).tolist()]
    for rank in {*range(0, size + 1, max(1, size // 500)), size}:
        assert units.offset(rank) == before[rank]
    assert units.offset(size + 5) == before[-1]


def test_lanes_are_thinner_and_as_wide():
    widths = np.full(100_000, 3, np.int32)
    lanes = fill_middle.SkipList(widths).lanes
    assert len(lanes) >= 4
    for units, chars, below in lanes:
        assert units.sum() == 100_000 and chars.sum() == 300_000
    for lower, upper in zip(lanes, lanes[1:]):
        assert len(upper[0]) < len(lower[0]) / 8


def plainly(key, text):
    """form, prefix, middle and output of a text, as the contract says it."""
    h = hashlib.sha256(f"1:{'' if key is None else key}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * k:8 * k + 8], 16) for k in range(4))
    units = UNIT.findall(text)
    a, b = sorted((h1 % (len(units) + 1), h2 % (len(units) + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(mark in text for mark in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return len(units), "plain", None, None, text
    if h4 % 100 < 20:
        return len(units), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return len(units), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def transformed(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = fill_middle.transform(docs)
    return found.withColumn("restored", fill_middle.restored(found["output"], found["form"]))


def test_rows_are_those_of_a_plain_version(spark):
    known = texts(300, 50, 1) + ["", "<P>", "x<S>y", "<M", "a<P", "<" * 9, "<<S<M"] * 5
    rows = list(enumerate(known))
    got = {r["doc_id"]: tuple(r)[1:] for r in transformed(spark, rows).collect()}
    assert got == {key: (*plainly(key, text), text) for key, text in rows}
    assert {form for _, form, *_ in got.values()} == {"plain", "psm", "spm"}


def test_nulls_repeats_and_long_texts(spark):
    long = "So, a längere 😀 text. " * 60_000
    rows = [(None, "one two"), (None, None), (3, None), (4, "same"), (4, "same"), (5, long)]
    got = sorted((tuple(r) for r in transformed(spark, rows).collect()), key=repr)
    want = [(k, *plainly(k, t or ""), t or "") for k, t in rows]
    assert got == sorted(want, key=repr)


def test_empty_table_and_clashing_names(spark):
    assert transformed(spark, []).count() == 0
    names = ("n", "form", "prefix_chars", "middle_chars", "output", "digest", "cuts", "share")
    docs = spark.createDataFrame(
        [(7, "some words here", *names)], f"doc_id long, text string, {' string, '.join(names)} string")
    assert [tuple(r) for r in fill_middle.transform(docs).collect()] == [
        (7, *plainly(7, "some words here"))]
    other = docs.select(docs["doc_id"].alias("n"), docs["text"].alias("output"))
    with pytest.raises(ValueError):
        fill_middle.transform(other, "n", "output")


def test_query_on_the_smallest_table(spark):
    rows = op11_fill_middle(spark, "/root/testdata/sf0.001")
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = {r["doc_id"]: (r["form"], r["output_sha256"], r["restored_sha256"]) for r in rows.collect()}
    sha = lambda text: hashlib.sha256(text.encode()).hexdigest()
    for row in docs.collect():
        _, form, _, _, output = plainly(row["doc_id"], row["text"] or "")
        assert got[row["doc_id"]] == (form, sha(output), sha(row["text"] or ""))
