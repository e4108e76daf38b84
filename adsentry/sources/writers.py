"""Writers. All write through Spark, partitioned, and never gather rows on the driver. The store of labelled listings is in
`sources.versions`."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_splits(rows: DataFrame, path: str) -> None:
    """JSON lines, a folder for each split."""
    rows.write.mode("overwrite").partitionBy("split").json(path)


def write_csv(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").option("header", True).csv(path)


def write_images(images: DataFrame, path: str) -> None:
    """Contents by their hash, each once. images: content."""
    images.withColumn("sha1", F.sha1("content")).dropDuplicates(["sha1"]).write.mode("overwrite").parquet(path)


def write_annotations(consensus: DataFrame, sentences: DataFrame, images: DataFrame, path: str) -> None:
    for name, rows in (("konsens", consensus), ("saetze", sentences), ("bilder", images)):
        rows.write.mode("overwrite").json(f"{path}/{name}")


def write_bundle(rows: DataFrame, path: str) -> DataFrame:
    """A team's bundle by person and section, without synthetic or hidden files, and its manifest of counts."""
    shared = rows.filter(~F.rlike("file", F.lit(r"(^|/)[._]|(^|/)synthetisch/")))
    shared.write.mode("overwrite").partitionBy("person", "section").parquet(f"{path}/files")
    manifest = rows.sparkSession.read.parquet(f"{path}/files").groupBy("person", "section").agg(F.count("*").alias("n"))
    manifest.write.mode("overwrite").json(f"{path}/manifest")
    return manifest


def append_report(metrics: DataFrame, path: str, version: str) -> None:
    metrics.withColumn("version", F.lit(version)).withColumn("at", F.current_timestamp()).write.mode("append").parquet(path)


def chat_format(rows: DataFrame, system: str) -> DataFrame:
    """split, value: conversations in the format of fine-tuning tools. rows: split, prompt, answer."""
    turn = lambda role, text: F.struct(F.lit(role).alias("role"), text.alias("content"))
    messages = F.array(turn("system", F.lit(system)), turn("user", F.col("prompt")), turn("assistant", F.col("answer")))
    return rows.select("split", F.to_json(F.struct(messages.alias("messages"))).alias("value"))


def write_finetune(rows: DataFrame, path: str, system: str) -> None:
    chat_format(rows, system).write.mode("overwrite").partitionBy("split").text(path)
