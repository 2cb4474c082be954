"""Session and checkpoint set-up."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def local_session(
    cores: str = "*", shuffle_partitions: int = 8, app: str = "paceline", settings: dict[str, str] | None = None
) -> SparkSession:
    """A local session for tests and benches; on a cluster pass your own session around."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
    )
    for name, value in (settings or {}).items():
        builder = builder.config(name, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder for intermediate tables that outlive an executor.

    It is the checkpoint folder the session names. Only a local master may fall back to a temporary
    folder: on a cluster that folder would vanish with the machine that holds it.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None and not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="paceline-checkpoint-"))
    return context.getCheckpointDir()


def cleanup(spark: SparkSession) -> None:
    """Delete what this application wrote to the shared folder; call it when its results are written.

    `DataFrame.checkpoint` also follows `spark.cleaner.referenceTracking.cleanCheckpoints`, which drops files that no
    table refers to any more.
    """
    root = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(shared_folder(spark))
    root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(root, True)


def checkpointed(df: DataFrame) -> DataFrame:
    """Write `df` to the shared folder and read it back."""
    shared_folder(df.sparkSession)
    return df.checkpoint()
