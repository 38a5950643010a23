"""A session for local use; on a cluster, use its own."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: int | str = "*", partitions: int = 8, **conf: str) -> SparkSession:
    builder = SparkSession.builder.master(f"local[{cpus}]").config("spark.sql.shuffle.partitions", str(partitions))
    base = {"spark.sql.session.timeZone": "UTC", "spark.ui.enabled": "false", "spark.driver.memory": os.environ.get("SPARK_DRIVER_MEMORY", "4g"), "spark.ui.showConsoleProgress": "false"}
    for k, v in (base | conf).items():
        builder = builder.config(k, v)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, named in spark.checkpoint.dir;
    a temporary one where it is unset and all is one process."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        named = tempfile.mkdtemp(prefix="spark-checkpoint-", dir="/tmp")
        spark.sparkContext.setCheckpointDir(named)
    return named.rstrip("/")


def work_folder(spark: SparkSession) -> str:
    """Where this application writes tables that its later steps read."""
    return f"{shared_folder(spark)}/work-{spark.sparkContext.applicationId}"


def written(df: DataFrame) -> DataFrame:
    """df as a table in the work folder: computed once, and read again if an executor is lost."""
    path = f"{work_folder(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def clear_work(spark: SparkSession) -> None:
    """Removes all that this application wrote for its own steps. Results that read it must be stored before."""
    path = spark._jvm.org.apache.hadoop.fs.Path(work_folder(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
