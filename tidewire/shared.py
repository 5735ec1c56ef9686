"""Tables between the steps of a job, in the folder that the driver and all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``. Only a local master may leave it unset."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = f"file://{tempfile.gettempdir()}/tidewire-checkpoints"
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def pinned(df: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back: lineage is cut and lost executors lose nothing.

    ``cleared`` deletes what an application pinned.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tidewire/{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"
    schema = df.schema
    df.write.parquet(path)
    return spark.read.schema(schema).parquet(path)


def cleared(spark: SparkSession) -> None:
    """Delete the tables that this application pinned, once no result that comes from them is needed any more."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/tidewire/{spark.sparkContext.applicationId}")
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
