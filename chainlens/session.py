"""Session construction and object-store settings (inventory S8)."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

# Settings every job relies on.  Month keys are computed in UTC by arithmetic
# on epoch seconds, but text rendering of dates and timestamps still goes
# through the session zone, so it is pinned.
BASE_CONF: dict[str, str] = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Broadcast only sizes that are proven: explicit hints after a row-count
    # check, or AQE's switch on the measured size of a materialized shuffle.
    # Planning-time estimates (file size) do not trigger a broadcast.
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "64MB",
    "spark.sql.ansi.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    # Call sites in messages cost several driver calls for each Column operation.
    "spark.sql.dataFrameQueryContext.enabled": "false",
}


def s3a_conf(endpoint: str, *, path_style: bool = True, ssl: bool = False) -> dict[str, str]:
    """Hadoop S3A settings for an S3-compatible endpoint.

    Credentials are left to the S3A provider chain (environment, instance
    profile, ...), so no secret ever passes through job arguments.
    """
    return {
        "spark.hadoop.fs.s3a.endpoint": endpoint,
        "spark.hadoop.fs.s3a.path.style.access": str(path_style).lower(),
        "spark.hadoop.fs.s3a.connection.ssl.enabled": str(ssl).lower(),
    }


def build_session(
    app_name: str = "chainlens",
    master: str | None = None,
    conf: dict[str, str] | None = None,
) -> SparkSession:
    """Create (or reuse) a session with :data:`BASE_CONF` plus ``conf``."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in {**BASE_CONF, **(conf or {})}.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    # getOrCreate() ignores builder settings on an existing session; the
    # semantic ones must hold for every query, so set them at runtime too.
    for key in ("spark.sql.session.timeZone", "spark.sql.ansi.enabled"):
        spark.conf.set(key, BASE_CONF[key])
    return spark


def ensure_checkpoint_dir(spark: SparkSession, fallback: str | None = None) -> str:
    """Return the shared checkpoint folder the cluster names.

    ``spark.checkpoint.dir`` is read from the session.  Only when it is unset
    is a folder installed: ``fallback`` if given, else - in local mode only -
    a fresh temporary folder.  On a cluster a machine-local folder would be
    lost with its executor, so an unset setting is an error there.
    """
    current = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if current:
        if not spark.sparkContext.getCheckpointDir():
            spark.sparkContext.setCheckpointDir(current)
        return spark.sparkContext.getCheckpointDir() or current
    if fallback is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
        fallback = tempfile.mkdtemp(prefix="chainlens-ckpt-")
    if "://" not in fallback:
        os.makedirs(fallback, exist_ok=True)
    spark.sparkContext.setCheckpointDir(fallback)
    return spark.sparkContext.getCheckpointDir() or fallback
