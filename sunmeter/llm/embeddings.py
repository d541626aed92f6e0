"""Near-duplicate vectors by cosine: lattice hashing, then exact decisions."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sunmeter.llm.common import fresh_key, settled
from sunmeter.llm.components import components
from sunmeter.llm.lattice import Tables

COSINE = 0.95
TABLES = 10
BLOCKS = 2  # of eight dimensions, for each table; more for over some 1e9 vectors
SCALE = 0.8
NEIGHBOURS = 3  # cells asked beside the home cell, for each block
CLUSTER_TABLES = 2  # tables whose cells together make a cluster's cell
PASSES = 2
SEED = 8
VECTORS_AT_ONCE = 512
SAFE = 1e-6  # radians that bounds keep off the threshold
STEPS = 64  # classes of the angle between members and their leader

VECTOR = "array<double>"


def usable(vector: Column) -> Column:
    """Whether a vector can link: not null, all components finite, one not zero."""
    finite = F.forall(vector, lambda x: x.isNotNull() & (F.abs(x) < float("inf")))
    return vector.isNotNull() & F.coalesce(
        finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def _dot(left: Column, right: Column) -> Column:
    return F.aggregate(F.zip_with(left, right, lambda x, y: x * y), F.lit(0.0),
                       lambda total, x: total + x)


def _angle(cosine: Column) -> Column:
    return F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cosine)))


def cells(vectors: DataFrame, tables: int, blocks: int, scale: float, neighbours: int,
          seed: int) -> DataFrame:
    """uid, home keys of all tables, keys to ask for, and the cell for clustering."""
    schema = pa.schema([("uid", pa.int64()), ("home", pa.list_(pa.int64())),
                        ("asks", pa.list_(pa.int64())), ("cell", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made: dict[int, Tables] = {}
        for batch in batches:
            lengths = np.diff(batch.column(1).offsets.to_numpy())
            values = batch.column(1).flatten().to_numpy()
            ends = np.cumsum(lengths)
            uids = batch.column(0).to_numpy()
            for dimension in np.unique(lengths):
                if dimension not in made:
                    made[dimension] = Tables(int(dimension), tables, blocks, scale, seed)
                alike = np.flatnonzero(lengths == dimension)
                for at in range(0, len(alike), VECTORS_AT_ONCE):
                    rows = alike[at:at + VECTORS_AT_ONCE]
                    places = (ends[rows] - dimension)[:, None] + np.arange(dimension)
                    home, asks = made[dimension].keys(values[places], neighbours)
                    with np.errstate(over="ignore"):
                        cell = (home[:, :CLUSTER_TABLES] * np.arange(1, CLUSTER_TABLES + 1)).sum(
                            axis=1)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(uids[rows]), _lists(home), _lists(asks.reshape(len(rows), -1)),
                         pa.array(cell)], schema=schema)

    return vectors.select("uid", "unit").mapInArrow(
        run, "uid long, home array<long>, asks array<long>, cell long")


def _lists(rows: np.ndarray) -> pa.Array:
    offsets = np.arange(len(rows) + 1, dtype=np.int32) * rows.shape[1]
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(rows.reshape(-1)))


def _clusters(found: DataFrame, vectors: DataFrame, half: float) -> DataFrame:
    """uid, its cluster (the leader's uid) and ``angle`` to the leader, at most ``half``.

    The smallest uid of a cell leads it; who is too far off elects again, and who
    is left in the end leads itself.  Members of a cluster are all within twice
    ``half`` of each other, however many they are.
    """
    assigned = None
    open_rows = found.select("uid", "cell")
    for _ in range(PASSES):
        leaders = open_rows.groupBy("cell").agg(F.min("uid").alias("leader"))
        led = open_rows.join(
            leaders.select(fresh_key("cell").alias("cell_key"), "leader"),
            fresh_key("cell") == F.col("cell_key")).select("uid", "cell", "leader")
        led = _with_vector(_with_vector(led, "uid", vectors, "v"), "leader", vectors, "w")
        angle = F.when(F.col("uid") == F.col("leader"), 0.0).otherwise(
            F.when(F.size("v") == F.size("w"), _angle(_dot(F.col("v"), F.col("w")))))
        led = settled(led.select("uid", "cell", "leader", angle.alias("angle")), "led")
        near = led.filter(F.col("angle") <= half).select(
            "uid", F.col("leader").alias("cluster"), "angle")
        assigned = near if assigned is None else assigned.union(near)
        open_rows = led.filter(F.coalesce(F.col("angle") > half, F.lit(True))).select("uid", "cell")
    alone = open_rows.select("uid", F.col("uid").alias("cluster"), F.lit(0.0).alias("angle"))
    return assigned.union(alone)


def _with_vector(rows: DataFrame, key: str, vectors: DataFrame, name: str) -> DataFrame:
    right = vectors.select(fresh_key("uid").alias("vector_key"), F.col("unit").alias(name))
    return rows.join(right, fresh_key(key) == F.col("vector_key")).drop("vector_key")


def near_duplicates(
    rows: DataFrame, id_column: str = "vec_id", vector: str = "embedding",
    cosine: float = COSINE, tables: int = TABLES, blocks: int = BLOCKS, scale: float = SCALE,
    neighbours: int = NEIGHBOURS, seed: int = SEED,
) -> DataFrame:
    """One row per vector: id, ``n_links`` and ``component_id``.

    Two vectors are linked where their cosine, in double precision, is at least
    ``cosine``.  Equal vectors are put together first.  Random projections are
    decoded to points of the E8 lattice, ``blocks`` of them in each of ``tables``
    tables; a vector stands in its home cells and asks for those and for the
    ``neighbours`` closest cells of each block.  Vectors of one small cell that are
    all within half the threshold's angle of a leader form a cluster, and tables
    hold clusters, so a group of copies costs a few entries.

    Each vector of a cluster met by lookup is then compared with the other
    cluster's leader.  Members whose angle to the leader proves the link, by the
    triangle inequality, are counted without a look at them; those it can't
    decide are compared one by one.  No pair is missed within clusters that meet,
    none is linked below the threshold, and both ends get the link.  Vectors
    that are null, zero, of another length, or have null or infinite or NaN
    components link with nothing; a row without links is its own component.
    Null ids take part, a component's id is its smallest; repeated rows are
    vectors of their own and link; an empty table gives no rows.
    """
    limit = math.acos(cosine)
    v = F.col(vector).cast(VECTOR)
    good = rows.filter(usable(v)).select(F.col(id_column).alias("id"), v.alias("v"))
    classes = good.groupBy("v").agg(F.min("id").alias("first"), F.count("*").alias("n"))
    # Scaled by the largest component first, so that squares neither overflow nor vanish.
    most = F.array_max(F.transform("v", F.abs))
    scaled = classes.withColumn("most", most).withColumn(
        "scaled", F.transform("v", lambda x: x / F.col("most")))
    unit = F.transform("scaled", lambda x: x / F.col("norm"))
    vectors = settled(
        scaled.withColumn("norm", F.sqrt(_dot(F.col("scaled"), F.col("scaled"))))
        .select(F.monotonically_increasing_id().alias("uid"), "v", "first", "n",
                unit.alias("unit")), "vectors")
    found = settled(cells(vectors, tables, blocks, scale, neighbours, seed), "cells")
    step = limit / 2 / STEPS
    members = settled(
        _clusters(found, vectors, limit / 2 - SAFE)
        .join(vectors.select(F.col("uid").alias("u"), "n"), F.col("uid") == F.col("u")).select(
            "uid", "cluster", "n", F.floor(F.col("angle") / step).alias("step")), "members")
    pairs = settled(_meeting(found, members), "pairs")

    sums = members.groupBy("cluster", "step").agg(F.sum("n").alias("n")).groupBy("cluster").agg(
        F.collect_list(F.struct("step", "n")).alias("steps"))
    compared = _compared(pairs, members, sums, vectors)

    def upper(part: Column) -> Column:
        return (part["step"] + 1) * step

    sure = F.filter("steps", lambda part: F.col("gap") + upper(part) <= limit - SAFE)
    unsure = F.filter("steps", lambda part: (F.col("gap") + upper(part) > limit - SAFE)
                      & (F.col("gap") - upper(part) <= limit + SAFE))
    parts = settled(compared.select(
        "uid", "target",
        F.aggregate(sure, F.lit(0).cast("long"), lambda n, part: n + part["n"]).alias("n"),
        F.transform(unsure, lambda part: part["step"]).alias("unsure")).filter(
        (F.col("n") > 0) | (F.size("unsure") > 0)), "parts")
    exact = _exact(parts.select("uid", "target", F.explode("unsure").alias("step")),
                   members, vectors, cosine)
    counted = parts.select("uid", "n").union(exact.select("uid", "n"))
    totals = counted.groupBy("uid").agg(F.sum("n").alias("total"))
    edges = (members.filter("uid <> cluster").select(F.col("uid").alias("a"),
                                                      F.col("cluster").alias("b"))
             .union(parts.filter("n > 0").select("uid", "target"))
             .union(exact.select("uid", "other")))
    linked = components(edges)

    named = vectors.select("uid", "v", "first", "n").join(
        linked, F.col("uid") == F.col("node"), "left").withColumn(
        "component", F.coalesce("component", "uid"))
    smallest = named.groupBy("component").agg(F.min("first").alias("component_id")).select(
        fresh_key("component").alias("component_key"), "component_id")
    named = named.join(smallest, fresh_key("component") == F.col("component_key")).join(
        totals.select(fresh_key("uid").alias("total_key"), "total"),
        fresh_key("uid") == F.col("total_key"), "left")
    # A vector's own class is among what was counted, where its cluster was compared with itself.
    named = named.select("v", "component_id", (F.coalesce("total", "n") - 1).alias("n_links"))
    marked = rows.select(F.col(id_column), v.alias("v"))
    usable_rows = marked.filter(usable(F.col("v")))
    rest = marked.filter(~usable(F.col("v"))).select(
        id_column, F.lit(0).cast("long").alias("n_links"), F.col(id_column).alias("component_id"))
    key = F.xxhash64("v")
    named = named.select(key.alias("class_key"), F.col("v").alias("class"), "n_links",
                         "component_id")
    joined = usable_rows.withColumn("key", key).join(
        named, (F.col("key") == F.col("class_key")) & (F.col("v") == F.col("class")))
    return joined.select(id_column, "n_links", "component_id").union(rest)


def _meeting(found: DataFrame, members: DataFrame) -> DataFrame:
    """Pairs of clusters that meet in a table, in both directions, and each with itself."""
    of = members.select(F.col("uid").alias("u"), "cluster")
    placed = found.join(of, F.col("uid") == F.col("u"))
    entries = placed.select(F.explode("home").alias("key"), F.col("cluster").alias("b")).distinct()
    asked = placed.select(F.explode("asks").alias("key"), F.col("cluster").alias("a")).distinct()
    entries = entries.select(fresh_key("key").alias("key"), "b")
    asked = asked.select(fresh_key("key").alias("key"), "a")
    met = asked.join(entries, "key").filter("a <> b").select(
        F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    both = met.union(met.select(F.col("b").alias("a"), F.col("a").alias("b")))
    return both.union(members.select(F.col("cluster").alias("a"), F.col("cluster").alias("b"))
                      .distinct())


def _compared(pairs: DataFrame, members: DataFrame, sums: DataFrame,
              vectors: DataFrame) -> DataFrame:
    """Each member of a cluster with the leader of one that it meets: the angle ``gap``."""
    asking = pairs.select(fresh_key("a").alias("key"), F.col("b").alias("target")).join(
        members.select(fresh_key("cluster").alias("key"), "uid"), "key").drop("key")
    sums = sums.select(fresh_key("cluster").alias("sum_key"), "steps")
    leaders = vectors.select(fresh_key("uid").alias("leader_key"), F.col("unit").alias("w")).join(
        sums, F.col("leader_key") == F.col("sum_key")).drop("sum_key")
    rows = _with_vector(asking, "uid", vectors, "v").join(
        leaders.select(fresh_key("leader_key").alias("leader"), "w", "steps"),
        F.col("target") == F.col("leader"))
    return rows.filter(F.size("v") == F.size("w")).select(
        "uid", "target", "steps",
        F.when(F.col("uid") == F.col("target"), 0.0)
        .otherwise(_angle(_dot(F.col("v"), F.col("w")))).alias("gap"))


def _exact(parts: DataFrame, members: DataFrame, vectors: DataFrame, cosine: float) -> DataFrame:
    """Links between a vector and single members of a cluster: uid, other, n of the other."""
    mark = F.xxhash64("cluster", "step")
    held = members.select(mark.alias("mark"), F.col("cluster").alias("target"), "step",
                          F.col("uid").alias("other"), "n")
    asked = parts.withColumn("mark", F.xxhash64("target", "step"))
    pairs = asked.join(held, ["mark", "target", "step"]).select("uid", "other", "n")
    rows = _with_vector(_with_vector(pairs, "uid", vectors, "v"), "other", vectors, "w")
    near = (F.col("uid") == F.col("other")) | (_dot(F.col("v"), F.col("w")) >= cosine)
    return settled(rows.filter(near).select("uid", "other", "n"), "exact")
