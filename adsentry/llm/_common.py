"""Small helpers that the operators of this subpackage share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Only in local mode, where all run on one machine,
    a temporary folder is made if that is unset."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        context = spark.sparkContext._jsc.sc()
        if context.getCheckpointDir().isEmpty():
            master = spark.sparkContext.master
            if master != "local" and not master.startswith("local["):
                raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-adsentry-"))
        found = context.getCheckpointDir().get()
    return found.rstrip("/")


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder that `new_path` named."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def checkpoint(df: DataFrame) -> DataFrame:
    """`df` written to the shared folder and read from there; cuts the lineage and survives lost executors."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame, path: str | None = None) -> DataFrame:
    """`df` written as Parquet in the shared folder and read back."""
    path = path or new_path(df.sparkSession)
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def new_path(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/adsentry-{uuid.uuid4().hex}"


def whole_text(column: str | Column = "text") -> Column:
    """The text; the empty string for null."""
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(""))


def quoted(name: str) -> Column:
    """The column of this name, whatever signs are in it."""
    return F.col("`" + name.replace("`", "``") + "`")


def rows_kept(docs: DataFrame, choose: Callable[[pa.Array], np.ndarray]) -> DataFrame:
    """The rows of `docs`, with all their columns, for which `choose` says so: it gets the texts of a batch and gives booleans.
    Columns are numbered meanwhile, as Arrow functions fail on names with dots."""
    at = docs.columns.index("text")
    numbered = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array(choose(b.column(at))))

    return numbered.mapInArrow(run, numbered.schema).toDF(*docs.columns)
