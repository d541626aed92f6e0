import pytest
from helpers import readings, rows, scans, windows
from pyspark.sql import functions as F
from sunmeter import session
from sunmeter.operators import lookup
from sunmeter.operators.quality import to_raw
from sunmeter.sinks import tables


def test_create_raw_table_once(spark):
    tables.create_raw_table(spark, "panelData")
    df = readings(spark, [("a", 390.2505, 1, "2024-01-15 12:00:00.5")])
    tables.with_day(to_raw(df)).write.insertInto("panelData")
    tables.create_raw_table(spark, "panelData")  # leaves the rows alone
    got = spark.table("panelData")
    assert [kind for _, kind in got.dtypes][1:] == ["decimal(20,3)", "int", "timestamp", "date"]
    assert [str(v) for v in got.first()] == [
        "a", "390.251", "1", "2024-01-15 12:00:00.500000", "2024-01-15"]


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    """Five days; one panel holds a third of the rows."""
    path = str(tmp_path_factory.mktemp("raw") / "t")
    panel = F.when(F.col("id") % 3 == 0, "hot").otherwise(
        F.concat(F.lit("p"), F.lpad((F.col("id") % 101).cast("string"), 3, "0")))
    df = spark.range(0, 108_000, 1, 4).select(
        panel.alias("Panel_id"), (F.col("id") % 400).cast("double").alias("power_panel"),
        F.lit(1).alias("current_status"),
        F.timestamp_seconds(F.lit(1705276800) + F.col("id") * 4).alias("time_data"))
    tables.write_clustered(to_raw(df), path)
    return df, path


def test_clustered_write_keeps_all_rows(spark, stored):
    df, path = stored
    back = spark.read.parquet(path)
    assert back.count() == 108_000
    assert rows(back.groupBy("Panel_id").count()) == rows(df.groupBy("Panel_id").count())
    assert rows(back.select("day").distinct().withColumn("day", F.col("day").cast("string"))) == [
        (f"2024-01-{day}",) for day in range(15, 20)]


def test_copies_of_one_row_are_spread(spark, tmp_path):
    coalesce = "spark.sql.adaptive.coalescePartitions.enabled"
    copies = spark.range(0, 20_000, 1, 8).select(
        F.lit("hot").alias("Panel_id"), F.lit(0.0).alias("power_panel"),
        F.lit(0).alias("current_status"),
        F.lit("1970-01-01 00:00:00").cast("timestamp").alias("time_data"))
    try:
        spark.conf.set(coalesce, "false")
        tables.write_clustered(to_raw(copies), str(tmp_path / "t"))
    finally:
        spark.conf.set(coalesce, "true")
    per_file = spark.read.parquet(str(tmp_path / "t")).groupBy(F.input_file_name()).count()
    sizes = [r["count"] for r in per_file.collect()]
    assert sum(sizes) == 20_000 and len(sizes) == 4 and max(sizes) < 10_000


def test_lookup_is_pushed_and_range_prunes_days(spark, stored):
    back = spark.read.parquet(stored[1])
    text = scans(lookup.panel_rows(back, "p007"))
    assert "EqualTo(Panel_id,p007)" in text and "ReadSchema: struct<Panel_id" in text
    near = lookup.around(back, "2024-01-17 12:00:00")
    assert near.count() == 4501  # five hours at one row per 4 s, both ends
    assert "PartitionFilters: [isnotnull(day" in scans(near)
    assert near.select("day").distinct().count() == 1


def test_window_range_keeps_the_window_that_ends_at_midnight(spark, tmp_path):
    path = str(tmp_path / "w")
    df = windows(spark, [("a", 1.0, "2024-01-14 23:59:30"), ("a", 2.0, "2024-01-15 00:00:00")])
    tables.write_clustered(df, path, "window_start")
    near = lookup.around(
        spark.read.parquet(path), "2024-01-15 00:00:00", "0 hours", time="window_end")
    assert rows(near, "total_power") == [(1.0,), (2.0,)]


def test_a_stored_table_is_not_written_over(spark, stored):
    with pytest.raises(Exception, match="(?i)already exists"):
        tables.write_clustered(to_raw(stored[0].limit(1)), stored[1])
    assert spark.read.parquet(stored[1]).count() == 108_000


def test_scratch_follows_the_sessions_folder(spark):
    root = spark.conf.get("spark.checkpoint.dir")
    one, two = session.scratch(spark, "x"), session.scratch(spark, "x")
    assert one.startswith(root + "/") and one != two


def test_scratch_without_a_checkpoint_folder_is_in_the_warehouse():
    class Session:
        class conf:
            @staticmethod
            def get(name, default=None):
                return {"spark.sql.warehouse.dir": "hdfs://n/w"}.get(name, default)

    assert session.scratch(Session, "x").startswith("hdfs://n/w/scratch/sunmeter/x-")
