"""Session, and the shared folder that cuts of lineage are written to."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

from threadlake import storage

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}
#: Folders that this process has cut to, by application.
_written: dict[str, list[str]] = {}


def get_session(app: str = "threadlake", master: str | None = None, **conf: str) -> SparkSession:
    """A session in UTC with AQE and skew handling on. ``conf`` overrides these settings, and they override those of a submit command."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in (DEFAULTS | conf).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir.

    Only a session of a single machine may leave it unset: a folder of its own is then made and set. A cluster without
    it is an error, as a folder of one machine would lose the data with it.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        named = tempfile.mkdtemp(prefix="threadlake-")
        atexit.register(shutil.rmtree, named, ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", named)
    return named.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """The path of a new folder in the shared folder, which ``release`` deletes."""
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    _written.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def cut(df: DataFrame) -> DataFrame:
    """Cut lineage: the rows are written to the shared folder as a table and read from there, pruned by what is used of them.

    Unlike blocks kept on executors, the table survives their loss. ``release`` deletes what was cut.
    """
    spark = df.sparkSession
    path = scratch(spark, "cut")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> int:
    """Delete the tables that this process has cut to; frames that read them must no longer be used. Returns their number."""
    paths = _written.pop(spark.sparkContext.applicationId, [])
    for path in paths:
        storage.delete(spark, path)
    return len(paths)
