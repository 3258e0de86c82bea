"""Session settings and the shared work folder."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

# Settings the operators rely on.  A cluster normally sets its own sizes; these
# are about semantics (time zone, ANSI) and about letting AQE re-plan joins.
DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def build_session(app: str = "epilode", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings above; `conf` keys use `_` for `.`."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**DEFAULTS, **{k.replace("_", "."): v for k, v in conf.items()}}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def work_root(spark: SparkSession) -> str:
    """The shared folder for written intermediates.

    A cluster names it in `spark.checkpoint.dir`.  Where that is unset, a folder in the
    warehouse serves, which driver and executors share by definition.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    return (root or f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_work").rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path under the work root that no other run uses."""
    return f"{work_root(spark)}/{name}-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame, name: str = "cut") -> DataFrame:
    """Write `df` to the work root and read it back.

    The copy survives the loss of executors and is computed once, however many
    branches of a plan read it.  Its size is known before the next join is
    planned: a small copy is broadcast at once, without first shuffling the large
    side, and a large one is joined by shuffle.
    """
    path = fresh_path(df.sparkSession, name)
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def release(*copies: DataFrame) -> None:
    """Delete the copies of `cut_lineage` that the given frames read; no other plan may read them any more.

    What lies outside the work root stays.
    """
    for copy in copies:
        spark = copy.sparkSession
        jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
        root = jvm.org.apache.hadoop.fs.Path(work_root(spark))
        root = root.getFileSystem(conf).makeQualified(root)
        for folder in {jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI(file)).getParent().toString() for file in copy.inputFiles()}:
            folder = jvm.org.apache.hadoop.fs.Path(folder)
            files = folder.getFileSystem(conf)
            if files.makeQualified(folder).getParent().equals(root):
                files.delete(folder, True)


@contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Within, the shuffle files of a job are removed as it ends.

    Otherwise they stay until the driver happens to collect its garbage, and those of
    many steps add up.  A frame that is run again makes them again.
    """
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)
