"""Session construction and lineage cutting.

Iterative graph jobs cut their lineage every round with a *reliable*
checkpoint, written to the shared folder the cluster names in
``spark.checkpoint.dir``. A private folder is only created when that setting
is unset and the master is local (tests, benches on one machine).
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"   # not known to Spark before 4.1, and of no effect there


def build_session(app: str = "spindle", cpus: int | str = "*", shuffle_partitions: int | None = None,
                  driver_memory: str = "16g") -> SparkSession:
    """Session for tests and benches. On a cluster, use the cluster's own session."""
    parts = shuffle_partitions or (8 if cpus == "*" else max(int(cpus), 1) * 2)
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(parts))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", driver_memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    checkpoint_dir(spark)
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """Return the reliable checkpoint folder, taking it from the session.

    Order: an already set SparkContext folder, then ``spark.checkpoint.dir``.
    Only a local master may fall back to a private temporary folder; a cluster
    without a shared folder is an error, since executor-local storage does not
    survive executor loss.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if configured:
        sc.setCheckpointDir(configured)
        return sc.getCheckpointDir()
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a shared folder (HDFS/S3/ABFS) for iterative jobs")
    folder = tempfile.mkdtemp(prefix="spindle-ckpt-", dir=os.environ.get("TMPDIR", "/tmp"))
    sc.setCheckpointDir(folder)
    return sc.getCheckpointDir()


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise ``df`` into the reliable checkpoint folder (survives executor loss)."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def store(df: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back: lineage is cut as by
    :func:`cut_lineage`, and what follows is planned by the size of the files. (A checkpoint
    keeps the estimate of its plan; in a loop that joins a table with itself that estimate
    is squared round by round.) The shuffles of the write are deleted with its end, as nothing
    reads them again. The files go with :func:`discard`, or when the driver ends."""
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark)}/stored-{uuid.uuid4().hex}"
    before = spark.conf.get(SHUFFLE_CLEANUP, None)
    spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:  # the setting is taken up by frames that are made under it
        df.select("*").write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.unset(SHUFFLE_CLEANUP) if before is None else spark.conf.set(SHUFFLE_CLEANUP, before)
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(at)
    out = spark.read.schema(df.schema).parquet(path)
    out._stored = path
    return out


def like(df: DataFrame, stored: DataFrame) -> DataFrame:
    """``df``, which reads the table ``stored`` and no other, as a table of :func:`store`."""
    df._stored = getattr(stored, "_stored", None)
    return df


def discard(*frames: DataFrame) -> None:
    """Delete the files of tables of :func:`store` that no frame reads any more; other frames stay."""
    for f in frames:
        path = getattr(f, "_stored", None)
        if path is not None:
            spark = f.sparkSession
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
            f._stored = None
