"""Session defaults and the shared scratch folder used for checkpoints and written tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(master: str = "local[*]", shuffle_partitions: int = 8, memory: str = "12g") -> SparkSession:
    """Local session for tests and the bench; clusters bring their own session."""
    return (
        SparkSession.builder.master(master)
        .appName("octroi")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.extraJavaOptions", "-Xss16m")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach: `spark.checkpoint.dir` where set.

    Only a local master may fall back to a temporary folder of this machine.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    known = spark.sparkContext._jsc.sc().getCheckpointDir()
    if known.isDefined():
        return known.get().rsplit("/", 1)[0]
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    folder = tempfile.mkdtemp(prefix="octroi-", dir="/tmp")
    spark.sparkContext.setCheckpointDir(folder)
    return folder


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the shared folder, so a lost executor never loses the loop state."""
    spark = df.sparkSession
    folder = shared_dir(spark)
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(folder)
    return df.checkpoint(eager=True)


def scratch_path(spark: SparkSession, name: str) -> str:
    """Fresh path below the shared folder for a table written by a job."""
    return f"{shared_dir(spark)}/octroi/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Writes a reused intermediate once as parquet in the shared folder and reads it back.

    Later plans scan only the columns they need and see its true size when they pick a join.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, name: str, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """Like `written`, in as many buckets by `keys` as shuffles have partitions: a join on them doesn't exchange it.

    Returns the frame that knows its buckets, and a plain one for unions: Spark may take a union of bucketed
    scans for bucketed and then not read it so. The table is registered only while it is written.
    """
    spark, path = df.sparkSession, scratch_path(df.sparkSession, name)
    table = f"octroi_{uuid.uuid4().hex}"
    writer = df.write.format("parquet").option("path", path)
    writer.bucketBy(int(spark.conf.get("spark.sql.shuffle.partitions")), *keys).saveAsTable(table)
    found = spark.table(table)
    spark.sql(f"DROP TABLE {table}")  # the files stay, as the table only points to them
    return found, spark.read.schema(df.schema).parquet(path)
