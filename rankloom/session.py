"""Session set-up shared by jobs, tests and the bench."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

# Runtime settings every job relies on; all can be set on a session that already runs.
JOB_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Split skewed join partitions even when that costs one more exchange downstream.
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def prepare(spark: SparkSession) -> SparkSession:
    """Apply the job settings to a running session and return it."""
    for key, value in JOB_CONF.items():
        spark.conf.set(key, value)
    return spark


def local_session(cores: str = "*", app: str = "rankloom") -> SparkSession:
    """A local session for tests and the bench; clusters bring their own."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        # Column expressions are built by the hundred; capturing a stack for each is slow.
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return prepare(spark)


def shared_folder(spark: SparkSession) -> str:
    """The shared folder for intermediate tables: what ``spark.checkpoint.dir`` names.

    Where that is unset, a local master uses a folder in the warehouse, which a session shares
    anyway; a cluster has to name one.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        configured = spark.conf.get("spark.checkpoint.dir", None)
        if configured:
            sc.setCheckpointDir(configured)
        elif sc.master.startswith("local"):
            sc.setCheckpointDir(f"{spark.conf.get('spark.sql.warehouse.dir')}/_staged")
        else:
            raise RuntimeError("set spark.checkpoint.dir to a shared folder")
    return sc.getCheckpointDir()


_FOLDERS: list[str] = []


def new_folder(spark: SparkSession, name: str) -> str:
    """A folder of its own in the shared one, for ``clear_folders`` to remove."""
    _FOLDERS.append(f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}")
    return _FOLDERS[-1]


def clear_folders(spark: SparkSession) -> None:
    """Remove what this process has staged; results that still read it must be written before."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    while _FOLDERS:
        path = hadoop.Path(_FOLDERS.pop())
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def stage(df: DataFrame) -> DataFrame:
    """Write a table once to the shared folder and read it back.

    Cuts the lineage like a checkpoint, but columnar: every later reader scans just the
    columns it needs, and losing executors costs no recomputation of what lies before.
    """
    spark = df.sparkSession
    path = new_folder(spark, "staged")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
