"""Tables in the folder that driver and executors share: lineage ends there and survives lost executors."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_path(spark: SparkSession, label: str) -> str:
    """A fresh path. A local folder is taken only where driver and executors are one process and the session names none."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        named = "file:///tmp/filigrane-shared"
    return f"{named.rstrip('/')}/filigrane-{spark.sparkContext.applicationId}/{label}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write a table and read it back, so that nothing above it is computed again and its size is known to the planner."""
    spark = df.sparkSession
    path = shared_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_shared(spark: SparkSession) -> bool:
    """Remove all tables that this application wrote there; lazy results that read them are lost."""
    path = spark._jvm.org.apache.hadoop.fs.Path(shared_path(spark, "any")).getParent()
    return path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)
