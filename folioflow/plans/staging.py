"""Where a plan is materialised: calls to a translator must not be repeated by a later read."""

from __future__ import annotations

import tempfile

from pyspark import cloudpickle
from pyspark.sql import DataFrame

import folioflow

# Executors need no copy of this package: its functions travel with the tasks.
cloudpickle.register_pickle_by_value(folioflow)


def settled(df: DataFrame) -> DataFrame:
    """``df`` written once to the checkpoint folder of the session (a temporary one only in a local session that names none)."""
    sc = df.sparkSession.sparkContext
    if not sc.getCheckpointDir():
        found = sc.getConf().get("spark.checkpoint.dir")
        if not found and not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(found or tempfile.mkdtemp(prefix="folioflow-"))
    return df.checkpoint(eager=True)
