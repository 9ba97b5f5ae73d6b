"""Session helpers.

The library never builds its own cluster settings into the operators: every
operator takes and returns DataFrames.  This module only gives tests, the
bench and the command line one place to start a session with sane defaults,
and one place to find the shared checkpoint folder.
"""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession

# Settings a session gets when this module starts it.  On a cluster the
# submitter's own configuration wins: ``getOrCreate`` keeps existing values.
DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # checkpoint files of materialised profiles and vectors are deleted once the
    # DataFrame that owns them is gone, so the shared folder does not fill up
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}


# Settings the plans assume on a large cluster (see README, "Running at 100 TB").
# Not applied by the library: the submitter's configuration decides.
CLUSTER_CONF = {
    **DEFAULT_CONF,
    "spark.sql.shuffle.partitions": "20000",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "256m",
    "spark.sql.files.maxPartitionBytes": "256m",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "64m",
}


def get_spark(master: str | None = None, shuffle_partitions: int | None = None, app: str = "peerpanel") -> SparkSession:
    """Return the active session, or start one with :data:`DEFAULT_CONF`."""
    active = SparkSession.getActiveSession()
    if active is not None:
        return active
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for k, v in DEFAULT_CONF.items():
        builder = builder.config(k, v)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def checkpoint_dir(spark: SparkSession) -> str | None:
    """The shared checkpoint folder the cluster names, if any."""
    value = spark.sparkContext.getCheckpointDir()
    if value:
        return value
    try:
        value = spark.conf.get("spark.checkpoint.dir", None)
    except Exception:  # pragma: no cover - conf lookups differ by deployment
        value = None
    return value or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Use the cluster's ``spark.checkpoint.dir``.  Only a local-mode session (tests) with
    no setting gets a scratch folder; on a cluster a machine-local folder would not be
    shared by the executors, so an unset setting is an error there."""
    value = checkpoint_dir(spark)
    if not value:
        master = spark.sparkContext.master or ""
        if not master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder shared by the cluster "
                               "(iterative fits and materialised profiles checkpoint there)")
        value = tempfile.mkdtemp(prefix="peerpanel-ckpt-")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(value)
    return value


def cut_lineage(df: DataFrame, eager: bool = True) -> DataFrame:
    """Reliable checkpoint into the shared folder, so lost executors do not force a recompute
    of a long lineage (used before iterative fits).  Never a local checkpoint."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=eager)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A path under the shared checkpoint folder for written intermediate tables."""
    base = ensure_checkpoint_dir(spark)
    return os.path.join(base, "peerpanel-tables", name)
