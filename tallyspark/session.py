"""Spark session helpers.

The library never creates machine-local scratch space on a cluster: shared
scratch locations come from ``spark.checkpoint.dir`` (or
``tallyspark.scratch.dir``) as configured by the cluster.  Only when neither is
set (unit tests, local runs) do we create a private temporary directory.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

LOCAL_CONF = {
    "spark.sql.shuffle.partitions": "8",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def local_session(cores: int | str = "*", app: str = "tallyspark", memory: str = "16g") -> SparkSession:
    """A local session for tests and benchmarks (never used on a cluster)."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName(app)
    for k, v in LOCAL_CONF.items():
        builder = builder.config(k, v)
    builder = builder.config("spark.driver.memory", memory)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder; a private one is made only in local mode, where none is set.

    On a cluster the folder must be named by ``spark.checkpoint.dir``: a folder
    on the driver's own disk is invisible to the executors.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    conf_dir = spark.conf.get("spark.checkpoint.dir", None)
    if not conf_dir:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        conf_dir = "file://" + tempfile.mkdtemp(prefix="tallyspark-ckpt-")
    sc.setCheckpointDir(conf_dir)
    return sc.getCheckpointDir()


def scratch_dir(spark: SparkSession, name: str) -> str:
    """A fresh, unique path (with its scheme) under the shared scratch root for staging writes."""
    root = spark.conf.get("tallyspark.scratch.dir", None) or ensure_checkpoint_dir(spark)
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"


def drop_scratch(spark: SparkSession, path: str) -> None:
    """Delete a scratch folder whose readers have all finished."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def store(df, name: str = "stage") -> tuple:
    """Write ``df`` to shared scratch; the table read back, and its path for ``drop_scratch``."""
    path = scratch_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def materialize(df, name: str = "stage"):
    """Cut lineage by writing a table to the shared scratch folder and reading it back.

    Used where several downstream branches read the same expensive input (the
    way a pipeline materialises a model as a table).  One computation, stored
    durably, so it survives executor loss (unlike a local checkpoint or cache).
    """
    return store(df, name)[0]


def side_by_side(jobs: list) -> list:
    """Runs independent Spark actions at once and waits for all; their results, or the first error after all ended.

    Each runs in its own scheduler pool, so that with ``spark.scheduler.mode=FAIR``
    a long one does not hold up the others.
    """
    from concurrent.futures import ThreadPoolExecutor

    spark = SparkSession.getActiveSession()

    def run(i: int, job):
        if spark is not None:
            spark.sparkContext.setLocalProperty("spark.scheduler.pool", f"side_{i}")
        return job()

    with ThreadPoolExecutor(max_workers=max(1, min(len(jobs), 8))) as pool:
        futures = [pool.submit(run, i, job) for i, job in enumerate(jobs)]
    return [f.result() for f in futures]
