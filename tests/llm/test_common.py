"""Drawing a bounded sample."""

from pyspark.sql import functions as F

from sunmeter.llm.common import drawn, fresh_names


def test_drawn_are_the_smallest_hashes(spark):
    rows = spark.range(5000)
    for n in (0, 1, 70, 5000, 9000):
        got = drawn(rows, "id", n, 3).collect()
        want = rows.orderBy(F.xxhash64(F.lit(3), "id"), "id").limit(n).collect()
        assert got == want
    assert drawn(rows.limit(0), "id", 5, 3).count() == 0


def test_fresh_names_are_free():
    assert fresh_names(["a", "B_", "c"], "a", "b", "b", "B") == ["a_", "b", "b__", "B___"]
    assert fresh_names([], "x") == ["x"]
