"""The shared folder that checkpoints and staged tables go to."""

from __future__ import annotations

import datetime as dt
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``.

    Only a local session may run without the setting; it gets a temporary folder.
    On a cluster a machine-local folder would be lost with its machine, so there a
    missing setting is an error.
    """
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named is None:
        if context.getCheckpointDir() is not None:
            return context.getCheckpointDir()
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        named = tempfile.mkdtemp(prefix="ledgerlens-")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(named)
    return named


def staging_path(spark: SparkSession, label: str) -> str:
    """A new path below the shared folder."""
    return f"{shared_folder(spark).rstrip('/')}/staged-{uuid.uuid4().hex}/{label}"


def clear_staged(spark: SparkSession, older_than: dt.timedelta) -> list[str]:
    """Delete staged results that were last written longer ago than this; their names. What a
    running job reads must be younger, so give it days on a shared cluster."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(shared_folder(spark))
    files = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    before = (dt.datetime.now(dt.UTC) - older_than).timestamp() * 1000
    gone = [
        s.getPath() for s in files.listStatus(folder) if s.getPath().getName().startswith("staged-") and s.getModificationTime() <= before
    ]
    for path in gone:
        files.delete(path, True)
    return sorted(p.getName() for p in gone)


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder and read from there, so that what
    follows sees the same rows in the same partitions, also after a lost executor."""
    shared_folder(df.sparkSession)
    return df.checkpoint()
