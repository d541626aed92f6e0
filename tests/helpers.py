"""Small inputs and result helpers."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sunmeter.schema import MESSAGE_SCHEMA, READING_SCHEMA

WINDOW_DDL = "Panel_id string, total_power double, window_start string, window_end string"


def readings(spark: SparkSession, rows) -> DataFrame:
    """Rows of (panel, power, status, time text)."""
    ddl = "Panel_id string, power_panel double, current_status int, time_data string"
    return spark.createDataFrame(rows, ddl).withColumn(
        "time_data", F.col("time_data").cast("timestamp")).to(READING_SCHEMA)


def windows(spark: SparkSession, rows) -> DataFrame:
    """Rows of (panel, power, window start text); windows of 30 s."""
    ddl = "Panel_id string, total_power double, window_start string"
    start = F.col("window_start").cast("timestamp")
    return spark.createDataFrame(rows, ddl).withColumn("window_start", start).withColumn(
        "window_end", F.col("window_start") + F.expr("INTERVAL '30 seconds'"))


def messages(spark: SparkSession, texts, first_offset: int = 0) -> DataFrame:
    """Message values as text, in order of offset."""
    rows = [(text, first_offset + i) for i, text in enumerate(texts)]
    return spark.createDataFrame(rows, "value string, offset long").select(
        F.lit(None).cast("binary").alias("key"),
        F.col("value").cast("binary").alias("value"),
        F.lit("t").alias("topic"), F.lit(0).alias("partition"), "offset",
        F.timestamp_seconds(F.col("offset")).alias("timestamp"),
    ).to(MESSAGE_SCHEMA)


def wire(panel: str, power: float, time: str, status: int = 1) -> str:
    return (f'{{"Panel_id":"{panel}","power_panel":{power},'
            f'"current_status":{status},"time_data":"{time}"}}')


def rows(df: DataFrame, *columns: str) -> list[tuple]:
    """Sorted plain tuples; times as text."""
    df = df.select(*(columns or df.columns))
    text = [F.col(n).cast("string").alias(n) if k.startswith("timestamp") else F.col(n)
            for n, k in df.dtypes]
    return sorted((tuple(r) for r in df.select(*text).collect()), key=repr)


def plan(df: DataFrame) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def scans(df: DataFrame) -> str:
    """The formatted plan: unlike ``plan`` it spells out filters in full."""
    utils = df.sparkSession._jvm.org.apache.spark.sql.api.python.PythonSQLUtils
    return utils.explainString(df._jdf.queryExecution(), "formatted")
