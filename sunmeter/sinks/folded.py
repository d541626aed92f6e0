"""A stream's batches as a table: written one by one, folded by day now and then."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from datetime import date

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sunmeter.sinks.files import exists, names, remove

BATCH = "batch_id"
MANIFEST_SCHEMA = "day date, through long, version long"


class Folded:
    """Rows below ``path``: ``batches`` of a stream, and ``data`` folded from them by day.

    A batch is a folder, replaced when the batch is tried again.  ``fold`` merges
    settled batches into the days they touch, each as a new version, then says
    so in ``manifest``, one small file, and only then do readers turn to it: what
    they see is always whole.  ``clean`` removes what is folded.  So a read goes
    over the days' current versions and the batches since the last fold, however
    many there have been.

    Folded rows lie in order of ``order`` within a day.  Of ``looked_up`` columns every file
    has Bloom filters, so a lookup passes row groups by that lack the value, also in
    batches that are not folded yet and in no order.

    ``merge`` makes one table of rows that may say the same thing twice; they carry
    their ``batch_id``, and it must keep that column.  ``day`` gives a row's day.
    """

    def __init__(
        self, spark: SparkSession, path: str, schema: T.StructType, day: Column,
        merge: Callable[[DataFrame], DataFrame] = lambda rows: rows,
        order: Iterable[str | Column] = (), looked_up: Iterable[str] = (),
    ):
        self.spark, self.path, self.day, self.merge = spark, path.rstrip("/"), day, merge
        self.schema = T.StructType([*schema.fields, T.StructField(BATCH, T.LongType())])
        self.order = list(order)
        self.options = {f"parquet.bloom.filter.enabled#{name}": "true" for name in looked_up}

    def write(
        self, files: int | None = None,
        seen: Callable[[DataFrame], DataFrame] = lambda rows: rows,
    ) -> Callable[[DataFrame, int], None]:
        """The per-batch callback; ``files`` is the number of files of a batch.

        ``seen`` may observe the rows; it comes last, in the tasks that write, which
        count once however often tasks before them are run again.
        """
        def write(batch: DataFrame, batch_id: int) -> None:
            rows = batch if files is None else batch.repartition(files)
            seen(rows).write.mode("overwrite").options(**self.options).parquet(
                self.batch_folder(batch_id))

        return write

    def batch_folder(self, number: int) -> str:
        return f"{self.path}/batches/{BATCH}={number}"

    def read(self, days: Iterable[date] | None = None) -> DataFrame:
        """All rows, or those of the given days, merged; without ``batch_id``."""
        return self.merge(self.rows(days)).drop(BATCH)

    def rows(self, days: Iterable[date] | None = None) -> DataFrame:
        """The rows as they are stored; of folded ones only the files of the days are read."""
        folded, through = self._current()
        new = self._batches(through)
        if days is not None:
            wanted = set(days)
            folded = {day: version for day, version in folded.items() if day in wanted}
            new = new.filter(self.day.isin(*wanted) if wanted else F.lit(False))
        return self._data(folded).unionByName(new)

    def folded_rows(self, days: Iterable[date]) -> DataFrame:
        """The rows of these days as they are folded, without newer batches."""
        folded, wanted = self.versions(), set(days)
        return self._data({day: version for day, version in folded.items() if day in wanted})

    def versions(self) -> dict[date, int]:
        """The folded days, each with the number of the fold that wrote it last."""
        return self._current()[0]

    def new_days(self) -> set[date]:
        """The days that batches since the last fold touch."""
        days = self.unfolded().select(self.day.alias("day")).distinct().collect()
        return {row["day"] for row in days}

    def unfolded(self) -> DataFrame:
        """Rows of the batches since the last fold, as they came."""
        return self._batches(self._current()[1]).drop(BATCH)

    def fold(self, newest: bool = False) -> int:
        """Fold batches that are settled; how many.

        While the stream runs, its newest batch may still be written and stays out.
        """
        days, through = self._current()
        ids = [number for number in self._batch_ids() if number > through]
        upto = max(ids, default=through) if newest else max(ids, default=through + 1) - 1
        if upto <= through:
            return 0
        new = self._batches(through, upto)
        touched = {row["day"] for row in new.select(self.day.alias("day")).distinct().collect()}
        old = self._data({day: v for day, v in days.items() if day in touched})
        self._publish(self.merge(old.unionByName(new)), touched, upto)
        return sum(number <= upto for number in ids)

    def replace_days(self, rows: DataFrame, days: Iterable[date]) -> None:
        """Put ``rows`` in place of all that these days have; later batches still count.

        Rows of other days are refused, so no other day can lose anything.  They are
        counted by the tasks that write, before readers turn to what is written.
        """
        _, through = self._current()
        days, seen = set(days), Observation()
        stray = ~F.coalesce(F.col("day").isin(*days), F.lit(False))
        version = self._write_days(
            rows.withColumn(BATCH, F.lit(through).cast("long")),
            lambda dealt: dealt.observe(seen, F.count_if(stray).alias("strays")))
        if seen.get.get("strays"):
            remove(self.spark, f"{self.path}/data/version={version}")
            raise ValueError("rows of other days than those to be replaced")
        self._say(version, days, through)

    def clean(self) -> None:
        """Remove folded batches and superseded days; readers of before lose them."""
        days, through = self._current()
        for number in self._batch_ids():
            if number <= through:
                remove(self.spark, self.batch_folder(number))
        for row in self._manifest().collect():
            if row["day"] is not None and days.get(row["day"]) != row["version"]:
                remove(self.spark, self._folder(row["day"], row["version"]))

    def last_batch(self) -> int:
        """The last batch that is folded or wholly written, -1 if there is none.

        Batches behind it, begun but not finished, are removed: whoever asks will
        write other batches in their place.
        """
        last = self._current()[1]
        for number in self._batch_ids():
            folder = self.batch_folder(number)
            if exists(self.spark, f"{folder}/_SUCCESS"):
                last = max(last, number)
            elif number > last:
                remove(self.spark, folder)
        return last

    def _batch_ids(self) -> list[int]:
        return sorted(int(name.partition("=")[2])
                      for name in names(self.spark, f"{self.path}/batches") if "=" in name)

    def _manifest(self) -> DataFrame:
        path = f"{self.path}/manifest"
        if not exists(self.spark, path):
            return self.spark.createDataFrame([], MANIFEST_SCHEMA)
        return self.spark.read.schema(MANIFEST_SCHEMA).parquet(path)

    def _current(self) -> tuple[dict[date, int], int]:
        """The current version of each day, and the last folded batch; a row per day."""
        newest = self._manifest().groupBy("day").agg(
            F.max("version").alias("version"), F.max("through").alias("through")).collect()
        days = {row["day"]: row["version"] for row in newest if row["day"] is not None}
        return days, max((row["through"] for row in newest), default=-1)

    def _folder(self, day: date, version: int) -> str:
        return f"{self.path}/data/version={version}/day={day}"

    def _data(self, days: dict[date, int]) -> DataFrame:
        paths = [self._folder(day, version) for day, version in sorted(days.items())]
        paths = [path for path in paths if exists(self.spark, path)]  # a day may have no rows
        if not paths:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*paths)

    def _batches(self, after: int, upto: int | None = None) -> DataFrame:
        """Batches after one; the bounds are literals on the folders' own column."""
        if not exists(self.spark, f"{self.path}/batches"):
            return self.spark.createDataFrame([], self.schema)
        rows = self.spark.read.schema(self.schema).parquet(f"{self.path}/batches")
        rows = rows.filter(F.col(BATCH) > after)
        return rows if upto is None else rows.filter(F.col(BATCH) <= upto)

    def _dealt(
        self, rows: DataFrame, seen: Callable[[DataFrame], DataFrame] = lambda rows: rows,
    ) -> DataFrame:
        """Rows with their day, cut by size in the order of the days and sorted.

        Large days have many files, small ones share.  A sort computes an expression
        anew at each comparison, so those of ``order`` are columns before it.
        """
        order, computed = ["day"], {}
        for key in self.order:
            if isinstance(key, Column):
                name = f"order_{len(order)}"
                computed[name], key = key, name
            order.append(key)
        helpers = {**computed, "input": F.spark_partition_id()}
        dealt = rows.withColumn("day", self.day).withColumns(helpers)
        return (seen(dealt.repartitionByRange(*order, "input"))
                .sortWithinPartitions(*order).drop(*helpers))

    def _publish(self, rows: DataFrame, days: set[date], through: int) -> None:
        self._say(self._write_days(rows), days, through)

    def _write_days(
        self, rows: DataFrame, seen: Callable[[DataFrame], DataFrame] = lambda rows: rows,
    ) -> int:
        """Write a new version, which no reader turns to yet; its number."""
        known = self._manifest().agg(F.max("version")).first()[0]
        version = 0 if known is None else known + 1
        (self._dealt(rows, seen)
            .write.mode("overwrite").options(**self.options).partitionBy("day").parquet(
                f"{self.path}/data/version={version}"))
        return version

    def _say(self, version: int, days: set[date], through: int) -> None:
        done = [(day, through) for day in days] or [(None, through)]
        (self.spark.createDataFrame(done, "day date, through long").coalesce(1)
            .write.mode("overwrite").parquet(f"{self.path}/manifest/version={version}"))
