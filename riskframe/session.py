"""Spark session defaults for the library.

Everything runs through the DataFrame API; the session only pins the settings
the operators rely on: UTC time zone (month keys, date parsing), ANSI mode
(``try_*`` functions for coercion), adaptive execution with skew-join
splitting, and a shared checkpoint folder for cutting lineage.
"""

from __future__ import annotations

import os
import re
import tempfile

from pyspark.sql import SparkSession

# Settings every job of the library expects. They are applied to a session the
# library creates and re-applied (runtime-settable ones only) to a session the
# caller hands in.
RUNTIME_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # The JVM doesn't compile longer methods: the wide projections of the feature
    # tables would be interpreted as one method instead of many small ones.
    "spark.sql.codegen.hugeMethodLimit": "8000",
}


def get_session(
    master: str | None = None,
    shuffle_partitions: int | None = None,
    app_name: str = "riskframe",
) -> SparkSession:
    """Return a session configured for the library.

    Without arguments the active session, or one built from the environment's own
    configuration (``spark-submit``, ``spark-defaults.conf``), is used as it is: no
    master, memory or partition count is set here. ``master`` asks for a local test
    or bench session, which gets small-machine settings; there ``shuffle_partitions``
    defaults to the number of its cores.
    """
    if master is None:
        spark = SparkSession.getActiveSession() or SparkSession.builder.appName(app_name).getOrCreate()
        return configure(spark)
    if not master.startswith("local"):
        raise ValueError("only local test sessions name their master here")
    builder = (
        SparkSession.builder.master(master)
        .appName(app_name)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.scheduler.mode", "FAIR")
        .config("spark.driver.memory", os.environ.get("RISKFRAME_DRIVER_MEMORY", "16g"))
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions or os.cpu_count() or 8))
    )
    for k, v in RUNTIME_CONF.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return configure(spark)


def configure(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings and make sure a checkpoint folder exists."""
    for k, v in RUNTIME_CONF.items():
        spark.conf.set(k, v)
    checkpoint_dir(spark)
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for checkpoints and intermediate tables.

    A cluster names it in ``spark.checkpoint.dir``; that value is always used.
    Where it is unset, a local session (one process, one disk) gets a scratch
    folder; any other one is refused, since its machines share no local folder.
    """
    sc = spark.sparkContext
    current = sc._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    path = sc.getConf().get("spark.checkpoint.dir", None)
    if not path:
        if not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = tempfile.mkdtemp(prefix="riskframe-ckpt-", dir="/tmp")
    sc.setCheckpointDir(path)
    return sc._jsc.sc().getCheckpointDir().get()
