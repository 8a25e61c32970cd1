"""Global and grouped positions, prefix sums and moving windows that no single task has to hold.

``row_number()`` without (or with a hot) ``partitionBy`` sends all rows of a group through one task.
Here rows are written once, range-partitioned on (group, order), written again with their place inside
the partition, and shifted by the totals of the partitions before them. Only one row per (partition,
group) ever meets in one place. The shift is broadcast: without groups it has one row per partition, with
groups it is a finished table, whose size decides. So rows are dealt once, by range, and not again.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window as W, functions as F
from pyspark.sql.types import LongType, StructField, StructType

from ..sources.scratch import is_stored, materialise

_PART, _PLACE, _LOCAL = "__part", "__place", "__local"
_LOCAL_BITS = (1 << 33) - 1


def _pieces(stored: DataFrame) -> int:
    """Ranges for a written table: as many as the scan has splits, which follow from its bytes."""
    spark = stored.sparkSession
    least = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    return max(least, stored.rdd.getNumPartitions())


def _sorted_ranges(df: DataFrame, order: Sequence[Column], groups: Sequence[str], pieces: int | None) -> DataFrame:
    """``df`` in ranges of (group, order). Ranges are sampled, so what is no written table yet is written first."""
    keys = [F.col(g).asc_nulls_first() for g in groups] + list(order)
    stored = df if is_stored(df) else materialise(df, "unordered")
    return stored.repartitionByRange(pieces or _pieces(stored), *keys).sortWithinPartitions(*keys)


def _placed(ranged: DataFrame) -> DataFrame:
    return ranged.withColumn(_PART, F.spark_partition_id()).withColumn(
        _PLACE, F.monotonically_increasing_id().bitwiseAND(F.lit(_LOCAL_BITS))
    )


def _shift(totals: DataFrame, groups: Sequence[str], names: Sequence[str]) -> DataFrame:
    """Per (partition, group): the sums of the group's earlier partitions. One row per partition and
    group, so the window is bounded by the number of partitions."""
    before = W.partitionBy(*groups).orderBy(_PART).rowsBetween(W.unboundedPreceding, -1)
    cols = [F.coalesce(F.sum(n).over(before), F.lit(0)).alias(f"__before_{n}") for n in names]
    kept = [c for c in ("__first", "__total") if c in totals.columns]
    return totals.select(
        F.col(_PART).alias("__p"), *[F.col(g).alias(f"__g_{g}") for g in groups], *kept, *cols)


def _join_shift(rows: DataFrame, shift: DataFrame, groups: Sequence[str]) -> DataFrame:
    """Without groups there is a row per partition; with groups the written table's size chooses the join."""
    small = materialise(shift, "shift") if groups else F.broadcast(shift)
    on = rows[_PART] == small["__p"]
    for g in groups:
        on = on & rows[g].eqNullSafe(small[f"__g_{g}"])
    return rows.join(small, on, "inner")


def positions(
    df: DataFrame,
    order: Sequence[Column],
    groups: Sequence[str] = (),
    name: str = "position",
    pieces: int | None = None,
) -> DataFrame:
    """1-based position of every row in ``order``, per group if ``groups`` are named.

    ``order`` must be total (end it with a unique key) for repeatable results.
    """
    rows = materialise(_placed(_sorted_ranges(df, order, groups, pieces)), "positions")
    totals = rows.groupBy(_PART, *groups).agg(F.count("*").alias("n"), F.min(_PLACE).alias("__first"))
    shifted = _join_shift(rows, _shift(totals, groups, ["n"]), groups)
    place = F.col("__before_n") + F.col(_PLACE) - F.col("__first") + 1
    return shifted.select(*df.columns, place.cast("bigint").alias(name))


def _running(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds partition, place and the running sum of the last column, which it replaces."""
    part, place, total = TaskContext.get().partitionId(), 0, 0
    for batch in batches:
        n = batch.num_rows
        sums = pc.add(pc.cumulative_sum_checked(batch.column(batch.num_columns - 1)), pa.scalar(total, pa.int64()))
        new = {_PART: pa.array([part] * n, pa.int64()), _PLACE: pa.array(range(place, place + n), pa.int64()), _LOCAL: sums}
        old = {f: batch.column(i) for i, f in enumerate(batch.schema.names[:-1])}
        yield pa.RecordBatch.from_pydict(old | new)
        place, total = place + n, sums[n - 1].as_py() if n else total


def prefix_sums(
    df: DataFrame,
    order: Sequence[Column],
    value: str,
    name: str = "running",
    position: str = "position",
    pieces: int | None = None,
) -> DataFrame:
    """Global inclusive running sum of an integer column (nulls count 0), with the position and the grand total.

    Adds ``name``, ``position`` and ``name + '_total'``. Sums inside a partition are carried along the sorted
    rows, batch by batch; a window would deal the rows once more.
    """
    added = [StructField(c, LongType()) for c in (_PART, _PLACE, _LOCAL)]
    ranged = _sorted_ranges(df, order, (), pieces).select("*", F.coalesce(F.col(value).cast("bigint"), F.lit(0)).alias(_LOCAL))
    rows = materialise(ranged.mapInArrow(_running, StructType([*df.schema.fields, *added])), "prefix")
    totals = rows.groupBy(_PART).agg(F.count("*").alias("n"), F.max_by(_LOCAL, _PLACE).alias("v"))
    totals = totals.withColumn("__total", F.sum("v").over(W.partitionBy()))  # one row per partition
    shift = _shift(totals, (), ["n", "v"])
    joined = _join_shift(rows, shift, ())
    return joined.select(
        *df.columns,
        (F.col("__before_n") + F.col(_PLACE) + 1).cast("bigint").alias(position),
        (F.col("__before_v") + F.col(_LOCAL)).cast("bigint").alias(name),
        F.col("__total").cast("bigint").alias(f"{name}_total"),
    )


def moving_frame(
    df: DataFrame,
    order: Sequence[Column],
    groups: Sequence[str],
    width: int,
    chunk_rows: int = 100_000,
) -> tuple[DataFrame, W]:
    """Rows prepared for a frame of the last ``width`` rows of a group, with a window to use on them.

    Groups are cut into chunks of ``chunk_rows`` rows; the last ``width - 1`` rows of a chunk are
    repeated at the head of the next one (``__halo``), so a hot group is spread over many tasks and
    every frame still sees all of its rows. Drop the halo rows after the window was applied.
    """
    chunk_rows = max(chunk_rows, width)
    numbered = positions(df, order, groups, "__pos")
    last = F.floor((F.col("__pos") - 1) / chunk_rows).cast("bigint")
    reach = F.floor((F.col("__pos") + (width - 2)) / chunk_rows).cast("bigint")
    copies = numbered.withColumn("__chunk", F.explode(F.sequence(last, F.greatest(last, reach))))
    marked = copies.withColumn("__halo", F.col("__chunk") != last)
    frame = W.partitionBy(*groups, "__chunk").orderBy("__pos")
    return marked, frame


def drop_halo(df: DataFrame) -> DataFrame:
    return df.filter(~F.col("__halo")).drop("__halo", "__chunk", "__pos")
