"""Option builders; the topic and JDBC connectors themselves are not installed here."""

import pytest
from helpers import readings
from pyspark.errors import AnalysisException
from sunmeter.operators.quality import to_raw
from sunmeter.sinks import topics
from sunmeter.sources import jdbc
from sunmeter.sources import messages as source


def test_all_brokers_in_one_list():
    assert source.topic_options(["a:1", "b:2"], maxOffsetsPerTrigger=10) == {
        "kafka.bootstrap.servers": "a:1,b:2", "subscribe": "panelInfo",
        "startingOffsets": "earliest", "maxOffsetsPerTrigger": "10"}
    with pytest.raises(ValueError):
        source.topic_options([])


def test_sink_options():
    assert source.sink_options(["a:1", "b:2"], "t") == {
        "kafka.bootstrap.servers": "a:1,b:2", "topic": "t"}


def test_connector_is_the_only_thing_missing(spark):
    options = source.topic_options(["a:1"])
    for read in (True, False):
        with pytest.raises(AnalysisException, match="[Kk]afka"):
            source.read_topic(spark, options, stream=read)
    with pytest.raises(AnalysisException, match="[Kk]afka"):
        topics.publish(readings(spark, []), source.sink_options(["a:1"]))


def test_jdbc_options():
    options = jdbc.table_options("jdbc:x:y", "panelData", user="u", fetchsize=1000)
    assert options == {"url": "jdbc:x:y", "dbtable": "panelData", "user": "u", "fetchsize": "1000"}
    assert jdbc.ranged(options, "time_data", "2024-01-01", "2024-02-01", 31) == options | {
        "partitionColumn": "time_data", "lowerBound": "2024-01-01",
        "upperBound": "2024-02-01", "numPartitions": "31"}
    assert jdbc.RAW_COLUMN_TYPES == (
        "Panel_id VARCHAR(250), power_panel DECIMAL(20,3), current_status INT, time_data TIMESTAMP")


class Recorder:
    """Stands in for a batch and its writer."""

    def __init__(self):
        self.calls = []

    def __getattr__(self, name):
        if name == "write":
            return self

        def call(*args, **kwargs):
            self.calls.append((name, args[:1], kwargs))
            return self
        return call


def test_jdbc_appends_the_columns_of_the_declared_table(spark):
    raw = to_raw(readings(spark, [("a", 1.0, 1, "2024-01-15 12:00:00")]))
    declared = [part.split(" ") for part in jdbc.RAW_COLUMN_TYPES.split(", ")]
    assert raw.columns == [name for name, _ in declared]
    assert [kind for _, kind in raw.dtypes] == ["string", "decimal(20,3)", "int", "timestamp"]
    options = jdbc.raw_table_options("jdbc:x:y", user="u")
    assert options["createTableColumnTypes"] == jdbc.RAW_COLUMN_TYPES
    assert options["dbtable"] == "panelData" and options["user"] == "u"
    batch = Recorder()
    jdbc.append_batches(options)(batch, 7)
    assert batch.calls == [
        ("format", ("jdbc",), {}), ("options", (), options), ("mode", ("append",), {}),
        ("save", (), {})]


def test_jdbc_batches_may_carry_their_number(spark):
    batch = Recorder()
    jdbc.append_batches({"url": "jdbc:x:y", "dbtable": "t"}, "batch_id")(batch, 7)
    assert batch.calls == [
        ("withColumn", ("batch_id",), {}), ("format", ("jdbc",), {}),
        ("options", (), {"url": "jdbc:x:y", "dbtable": "t"}), ("mode", ("append",), {}),
        ("save", (), {})]
