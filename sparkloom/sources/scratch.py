"""Small results that two branches of a plan must read alike, pinned in the shared checkpoint folder."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The cluster's checkpoint folder; one of our own only where none is named (tests, laptops)."""
    sc = spark.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
        if not named and not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="sparkloom-checkpoint-"))
    return sc._jsc.sc().getCheckpointDir().get()


def pinned(df: DataFrame) -> DataFrame:
    """``df``, computed once: written to the shared folder and read back."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)
