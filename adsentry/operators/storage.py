"""Tables that a job writes in between, in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; in local mode, where it may be unset, a temporary folder."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        context = spark.sparkContext._jsc.sc()
        if context.getCheckpointDir().isEmpty():
            if not (spark.sparkContext.master == "local" or spark.sparkContext.master.startswith("local[")):
                raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-adsentry-"))
        found = context.getCheckpointDir().get()
    return found.rstrip("/")


def stored(df: DataFrame, schema: StructType | None = None) -> DataFrame:
    """`df` written and read back, which cuts its lineage; `schema` gives its columns other types of the same form."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/adsentry-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(schema or df.schema).parquet(path)
