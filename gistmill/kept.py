"""Tables written in between: they cut lineage, so a lost executor costs a read and not the work behind it."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors see: spark.checkpoint.dir, or one in the warehouse where that is unset."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    return where or f"{spark.conf.get('spark.sql.warehouse.dir')}/gistmill-intermediate"


def kept(df: DataFrame, name: str) -> DataFrame:
    """df, written as Parquet below the shared folder and read back."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.kept_at = path
    return out


def dropped(*tables: DataFrame) -> None:
    """Delete kept tables that no frame in use reads any more."""
    for t in tables:
        context = t.sparkSession.sparkContext
        path = context._jvm.org.apache.hadoop.fs.Path(t.kept_at)
        path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)
