"""What the operators share: tables, rows through Python in small batches, cutting lineage."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from sunmeter.session import scratch

BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"
DEFAULT_BATCH_ROWS = "10000"
TEXT_BATCH_ROWS = "256"

# Fixed value: a word is a run of what is not ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Rows go to Python in batches that fit in memory even where each text has megabytes.

    Only Spark's own default is replaced; what the deployer has chosen stays.
    """
    if spark.conf.get(BATCH_ROWS) == DEFAULT_BATCH_ROWS:
        spark.conf.set(BATCH_ROWS, TEXT_BATCH_ROWS)


def flat_map_rows(
    rows: DataFrame, per_task: Callable[[], Callable[..., Iterable[tuple]]], ddl: str,
) -> DataFrame:
    """The tuples that a Python function makes of each row's columns, in any number.

    ``per_task`` makes the function once for each task, so what it compiles serves
    all rows of the task.
    """
    small_batches(rows.sparkSession)
    schema = to_arrow_schema(StructType.fromDDL(ddl))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fn = per_task()
        for batch in batches:
            out: list[tuple] = []
            for values in zip(*(column.to_pylist() for column in batch.columns)):
                out.extend(fn(*values))
            if out:
                columns = [pa.array(v, type=f.type) for v, f in zip(zip(*out), schema)]
                yield pa.RecordBatch.from_arrays(columns, schema=schema)

    return rows.mapInArrow(run, ddl)


def map_rows(rows: DataFrame, per_task: Callable[[], Callable[..., tuple]], ddl: str) -> DataFrame:
    """One row for each row; see ``flat_map_rows``."""
    def make() -> Callable[..., list[tuple]]:
        fn = per_task()
        return lambda *values: [fn(*values)]

    return flat_map_rows(rows, make, ddl)


def settled(rows: DataFrame, name: str) -> DataFrame:
    """``rows`` written to the shared folder and read back.

    Lineage ends there, so a lost executor costs no recomputation, and what is
    used twice is computed once.
    """
    path = scratch(rows.sparkSession, name)
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def drawn(rows: DataFrame, key: str, n: int, seed: int) -> DataFrame:
    """At most ``n`` rows, those of the smallest seeded hashes of ``key``, which is unique.

    Rows whose hash is far above the n-th of as many uniform ones are left out
    first, so the tasks together hand on about twice ``n`` rows, however many
    tasks there are.
    """
    order = F.xxhash64(F.lit(seed), key)
    share = min(1.0, (2 * n + 50) / max(1, rows.count()))
    highest = min((1 << 63) - 1, int(share * (1 << 64)) - (1 << 63))
    return rows.filter(order <= highest).orderBy(order, key).limit(n)


def held(rows: DataFrame, *names: str, **computed: Column) -> DataFrame:
    """Columns ``names`` of ``rows`` and further ones that are computed once.

    Arrays that a lambda looks into must not be merged into it, where each
    element would compute them again; Spark merges nothing across a generator.
    """
    values = F.struct(*[column.alias(name) for name, column in computed.items()])
    return rows.select(*names, F.inline(F.array(values)))


def fresh_names(taken: Iterable[str], *names: str) -> list[str]:
    """``names`` for columns of our own, lengthened until none of them is ``taken``."""
    used = {name.lower() for name in taken}  # names are compared without case
    found = []
    for name in names:
        while name.lower() in used:
            name += "_"
        used.add(name.lower())
        found.append(name)
    return found


def fresh_key(key: str) -> Column:
    """A key equal exactly where ``key`` (a long) is, which Spark takes for a new column.

    An aggregate is already dealt out by its key, and a join on that key would
    reuse the dealing: then adaptive execution can't split the other side's hot
    keys.  With this key both sides are dealt for the join and hot keys split.
    """
    return F.bitwise_not(F.col(key))
