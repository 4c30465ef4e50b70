"""Session settings and the shared scratch folder."""

from __future__ import annotations

import tempfile
import uuid
from functools import cache

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "wardlight", master: str | None = None, **conf) -> SparkSession:
    """A session with the settings the operators expect.

    AQE with skew-join splitting is left on; the shuffle partition count is only a
    starting point that AQE coalesces. Broadcasts are left to Catalyst, which checks
    the size of a side against `autoBroadcastJoinThreshold` before it picks one.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.ui.enabled": "false",
    }
    settings.update({k: str(v) for k, v in conf.items()})
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


@cache
def _local_root(app_id: str) -> str:
    """One temporary folder per local application."""
    return tempfile.mkdtemp(prefix="wardlight-")


def scratch_dir(spark: SparkSession, label: str) -> str:
    """A fresh folder for intermediate tables and stream checkpoints.

    It lies in the shared folder named by `spark.checkpoint.dir`. Only a local-mode
    session that names none gets a temporary folder on this machine.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
        root = _local_root(spark.sparkContext.applicationId)
    return f"{root.rstrip('/')}/{label}-{uuid.uuid4().hex[:12]}"


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write a narrow intermediate table to the shared scratch folder and read it back.

    For results that are costly to compute and read more than once. Unlike a cache the
    table survives the loss of executors.
    """
    path = scratch_dir(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def settle(summary: DataFrame, label: str) -> DataFrame:
    """Materialise an aggregate that is to be joined back to its fact.

    Catalyst guesses an aggregate to be about as large as its input and would shuffle the
    fact to join it. The written table has a known size: a small one is broadcast under
    `autoBroadcastJoinThreshold`, a large one is sorted and merged.
    """
    return materialize(summary, label)
