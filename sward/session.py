"""Session settings and lineage cuts shared by all operators."""

import os
import re
import tempfile
import uuid

# Runtime SQL settings the operators rely on.  Joins are broadcast by the planner's size checks only;
# beyond them a sort-merge join with skew splitting takes over.  Splitting is forced because several
# joins feed aggregations on the same key, where Spark would otherwise keep one hot key in one task.
# The small minimum partition size keeps stages that are short in bytes but long in work (geometry,
# exploding code lists) on all cores; large stages are still merged towards one task per core.
# Shuffles start with many partitions, which are merged by size, so that what a task sorts and groups does not
# grow with the input.
SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.minPartitionSize": "64k",
    "spark.sql.adaptive.coalescePartitions.initialPartitionNum": "400",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.session.timeZone": "UTC",
}

# Written stages of each application.
_STAGES = {}


def tune(spark):
    """Apply ``SETTINGS`` to a session and return it."""
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    return ship(spark)


def ship(spark):
    """Let Python workers import this package from where the driver did; returns the session.

    Where executors have the package installed elsewhere, the extra entry is ignored.
    """
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    environment = spark.sparkContext.environment
    paths = [p for p in environment.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in paths:
        environment["PYTHONPATH"] = os.pathsep.join([root, *paths])
    return spark


def shared_dir(spark):
    """Folder for written stages and scratch tables, as named by the cluster.

    Only a plain local session, as in tests, may name none: one is made for it.  On a cluster a
    machine's own folder would lose what other executors write, so there the setting is required.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        folder = spark.sparkContext.getCheckpointDir()
    if folder is None:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="sward-")
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


def scratch_path(spark, name):
    """A fresh path for a scratch table in the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def cut_lineage(df, compression="snappy"):
    """Write ``df`` to the shared folder once and go on from the written table.

    A columnar table rather than a checkpoint: readers prune columns and push filters into it,
    and its known size lets the planner choose joins before anything is shuffled.
    """
    spark = df.sparkSession
    path = scratch_path(spark, "stage")
    _STAGES.setdefault(spark.sparkContext.applicationId, []).append(path)
    df.write.option("compression", compression).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._stage_path = path
    return out


def drop_stage(table):
    """Delete a table of ``cut_lineage`` that no frame still to be run reads."""
    spark, path = table.sparkSession, table._stage_path
    _STAGES[spark.sparkContext.applicationId].remove(path)
    _delete(spark, path)


def drop_stages(spark):
    """Delete what ``cut_lineage`` has written for this session; call it when its results are stored."""
    for path in _STAGES.pop(spark.sparkContext.applicationId, []):
        _delete(spark, path)


def _delete(spark, path):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
