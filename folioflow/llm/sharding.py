"""Contiguous shards of near equal bytes.

Rows are range-partitioned by the order columns. Each partition's total of bytes and rows gives,
by a prefix sum over the partitions, where the partition starts in the whole; a running sum inside
the partition gives each row's own start. Row i belongs to the shard in whose equal share of all
bytes its middle byte lies, so shard boundaries fall at equal targets and a shard misses its share
by less than one row. Only DataFrame functions are used and no task sees more than one partition.

Ordered by a text's checksum first, equal texts stand together: a group of them lies in one shard, unless it is larger
than what is left of it. A group isn't moved as a whole, as one with a third of all rows would undo the equal sizes.

Defined results: null text has size 1 (no bytes plus 1) and the checksum of the empty text; rows
with equal order columns follow each other in any order, repeated rows one after the other; an empty table gives no rows. Other columns of the input are not touched and not needed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioflow.llm.common import cut


def contiguous_shards(df: DataFrame, n_shards: int, size: Column, order_by: list[str]) -> DataFrame:
    """``df`` with ``size`` long, ``shard`` int and ``slot`` long (gapless from 0 in each shard).

    ``df`` should hold only what the caller needs back: it is written to the checkpoint folder once
    (so that the input is scanned once) and shuffled twice.
    """
    if n_shards < 1:
        raise ValueError("n_shards must be positive")
    tie = "_tie"
    base = cut(df.withColumns({"size": size.cast("long"), tie: F.monotonically_increasing_id()}))
    keys = [*order_by, tie]
    # Which rows a range partition holds depends on a sample, so the numbering is fixed by a checkpoint.
    dealt = cut(base.repartitionByRange(*keys).withColumn("_part", F.spark_partition_id()))
    totals = dealt.groupBy("_part").agg(F.sum("size").alias("_bytes"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    # One row for each partition: their number bounds this window and the broadcast.
    totals = totals.select("_part", F.coalesce(F.sum("_bytes").over(before), F.lit(0)).alias("_start"),
                           F.sum("_bytes").over(Window.partitionBy()).alias("_all"))
    inside = Window.partitionBy("_part").orderBy(*keys)
    placed = dealt.withColumns({
        "_upto": F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, 0)),
        "_row": F.row_number().over(inside).cast("long"),
    }).join(F.broadcast(totals), "_part")
    middle = f"(_start + _upto - size + size div 2) * {int(n_shards)} div nullif(_all, 0)"
    placed = placed.withColumn("shard", F.least(F.expr(middle), F.lit(n_shards - 1)).cast("int"))
    # A shard's rows in earlier partitions: at most one row for each partition and each cut.
    pieces = placed.groupBy("_part", "shard").agg(F.count("*").alias("_n"), F.min("_row").alias("_first"))
    earlier = Window.partitionBy("shard").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    pieces = pieces.select("_part", "shard", "_first", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_skip"))
    return placed.join(F.broadcast(pieces), ["_part", "shard"]).withColumn(
        "slot", F.col("_skip") + F.col("_row") - F.col("_first")).drop("_part", "_start", "_all", "_upto", "_row", "_first", "_skip", tie)
