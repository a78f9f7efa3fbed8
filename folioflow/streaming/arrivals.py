"""Documents translated as they arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from folioflow.operators import requests
from folioflow.plans.staging import settled
from folioflow.sources.blocks import BLOCK
from folioflow.thresholds import DEFAULTS, Thresholds


def arriving_blocks(spark: SparkSession, path: str, files_at_once: int = 100) -> DataFrame:
    """A stream of blocks from lines of JSON, with ``doc_id``."""
    return spark.readStream.schema(f"doc_id string, ordinal long, {', '.join(f'{f.name} {f.dataType.simpleString()}' for f in BLOCK)}").option(
        "maxFilesPerTrigger", files_at_once).json(path)


def stats_stream(blocks: DataFrame, out: str, checkpoint: str, t: Thresholds = DEFAULTS) -> StreamingQuery:
    """Request sizes of each batch's pages, appended as Parquet; a batch that is repeated replaces its own rows."""

    def write(batch: DataFrame, number: int) -> None:
        requests.page_stats(settled(batch), t=t).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return blocks.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
