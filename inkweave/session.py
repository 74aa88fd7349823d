"""Session settings and lineage cuts shared by every operator."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import AbstractContextManager, contextmanager

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # Call-site capture costs several gateway calls per column expression.
    "spark.python.sql.dataFrameDebugging.enabled": "false",
}

_own_dirs: dict[str, str] = {}


def build_session(app: str = "inkweave", master: str | None = None, **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def prepare(spark: SparkSession) -> SparkSession:
    """Pin the runtime settings results depend on, on a session we did not build."""
    if spark.conf.get("spark.sql.session.timeZone") != "UTC":
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """Folder that survives executor loss: the cluster's own, or in local mode a scratch one that ends with the process."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    app = spark.sparkContext.applicationId
    if app not in _own_dirs:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        _own_dirs[app] = tempfile.mkdtemp(prefix="inkweave-")
        atexit.register(shutil.rmtree, _own_dirs[app], ignore_errors=True)
    return _own_dirs[app]


def width(spark: SparkSession) -> int:
    """Partitions for a written cut where the caller names no number: the session's shuffle setting."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


@contextmanager
def setting(spark: SparkSession, key: str, value: str) -> Iterator[None]:
    """A session setting for what runs inside the block; the session's own comes back after it."""
    before = spark.conf.get(key)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        spark.conf.set(key, before)


def sized(spark: SparkSession, partitions: int) -> AbstractContextManager[None]:
    """Shuffle partitions of what runs inside the block."""
    return setting(spark, "spark.sql.shuffle.partitions", str(partitions))


def _stages(spark: SparkSession) -> str:
    """This application's part of the shared folder."""
    return f"{shared_dir(spark)}/stage/{spark.sparkContext.applicationId}"


def stage(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage, keeps real statistics."""
    spark = df.sparkSession
    path = f"{_stages(spark)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def clear_stages(spark: SparkSession) -> None:
    """Remove all that this application has staged. Call it when no result of the session is read any more."""
    path = spark._jvm.org.apache.hadoop.fs.Path(_stages(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
