"""Session helpers: where shared intermediates go, how tables are read."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


#: Whether Spark removes the shuffle files of a query once it has ended.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def local_session(app: str = "strandframe", cores: str = "*", partitions: int = 8) -> SparkSession:
    """A single-machine session for tests and benchmarks."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (``spark.checkpoint.dir``).

    Only a session of one machine (a local master), as in tests, may name none
    and gets a temporary one.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        if spark.sparkContext.getCheckpointDir() is None:
            spark.sparkContext.setCheckpointDir(named)
        return named.rstrip("/")
    if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    folder = tempfile.mkdtemp(prefix="strandframe-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    spark.conf.set("spark.checkpoint.dir", f"file://{folder}")
    spark.sparkContext.setCheckpointDir(f"file://{folder}")
    return f"file://{folder}"


def materialize(df: DataFrame, label: str = "t", compression: str | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends here,
    and a lost executor costs a reread of files, not a recomputation. The
    shuffle files of the step are no longer needed then and are removed.

    ``discard`` deletes the files once nothing reads them any more; what a
    returned lazy result still reads stays until the session's folder goes.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path, compression=compression)
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)
    table = spark.read.schema(df.schema).parquet(path)
    table._written = path
    return table


def dealt(df: DataFrame) -> DataFrame:
    """A side of a join that grows with the input: both sides are dealt by key and merged.

    Without this, Spark goes by the compressed size of the files, finds it small and gathers on the
    driver what takes many times as much memory.
    """
    return df.hint("merge")


def delete(spark: SparkSession, path: str) -> None:
    """Deletes a file or folder of any file system that Spark reaches."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def discard(*tables: DataFrame) -> None:
    """Deletes the files of tables that came from ``materialize`` and are read no more."""
    for table in tables:
        if path := getattr(table, "_written", None):
            delete(table.sparkSession, path)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
