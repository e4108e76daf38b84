"""Building a data set: reasons for dropping rows, fingerprints, duplicates, splits, weights, labels."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import normalize as N


def union_sources(sources: dict[str, DataFrame], least: int = 10) -> DataFrame:
    """All sources with their name in `source`; at least `least` rows are needed."""
    every = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [df.withColumn("source", F.lit(name)) for name, df in sources.items()])
    if every.limit(least).count() < least:
        raise ValueError(f"fewer than {least} usable rows")
    return every


def drop_reason(empty: Column, no_label: Column, german: Column, german_only: Column | None = None) -> Column:
    """The first reason against a row, or null."""
    foreign = ~german if german_only is None else german_only & ~german
    return F.when(empty, "empty").when(no_label, "no_label").when(foreign, "not_german")


def load_report(rows: DataFrame) -> DataFrame:
    """Per source: rows, and how many each reason drops. rows: source, reason."""
    count = lambda r: F.count_if(F.col("reason") == r).alias(r)
    return rows.groupBy("source").agg(F.count("*").alias("n_rows"), count("empty"), count("no_label"), count("not_german"), F.count_if(F.col("reason").isNull()).alias("kept"))


def fingerprint(text: Column, images: Column | None = None) -> Column:
    """SHA-1 of the words of a (redacted) text; of the sorted image paths where there is no text."""
    norm = F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}_]+", " "))
    if images is None:
        return F.sha1(norm)
    other = F.array_join(F.array_sort(images), "|")
    return F.sha1(F.when(norm == "", other).otherwise(norm))


def first_by_priority(rows: DataFrame, key: str, *order: Column) -> DataFrame:
    """One row for each key, the first in `order`. One shuffle by key; ranks stay within Spark's group limit."""
    n = F.row_number().over(Window.partitionBy(key).orderBy(*order))
    return rows.withColumn("_n", n).filter("_n = 1").drop("_n")


def stratified_split(rows: DataFrame, label: str, order: Column, train_only: Column | None = None, val: float = 0.15, test: float = 0.15) -> DataFrame:
    """Adds `split`: exact shares per label by a hash order; train-only rows always train.

    Labels are few, so ranks are not taken in one window per label: rows are counted by label and a 12-bit prefix of the
    hash first, and ranked within these parts, so that no task needs all rows of a label."""
    free = rows if train_only is None else rows.filter(~train_only)
    part = F.conv(F.substring(order, 1, 3), 16, 10).cast("int")
    ranked = free.withColumn("_order", order).withColumn("_part", part)
    sizes = ranked.groupBy(label, "_part").agg(F.count("*").alias("_size"))
    before = Window.partitionBy(label).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select(label, "_part", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_before"), F.sum("_size").over(Window.partitionBy(label)).alias("_total"))
    inside = F.row_number().over(Window.partitionBy(label, "_part").orderBy("_order"))
    ranked = ranked.withColumn("_r", inside).join(sizes.withColumnRenamed(label, "_label"), (F.col(label).eqNullSafe(F.col("_label"))) & (ranked["_part"] == sizes["_part"])).drop(sizes["_part"])
    rank = F.col("_before") + F.col("_r")
    split = F.when(rank <= F.bround(F.col("_total") * test, 0), "test").when(rank <= F.bround(F.col("_total") * (test + val), 0), "val").otherwise("train")
    out = ranked.withColumn("split", split).select(*rows.columns, "split")
    return out if train_only is None else out.unionByName(rows.filter(train_only).withColumn("split", F.lit("train")))


def dataset_stats(rows: DataFrame, *dims: str) -> DataFrame:
    """n and fraud counts by each of `dims` and overall, in one pass."""
    sets = [F.array(*[F.struct(F.lit(d).alias("dim"), F.col(d).cast("string").alias("value")) for d in dims], F.struct(F.lit("total").alias("dim"), F.lit("").alias("value")))]
    return rows.select(F.explode(sets[0]).alias("k"), "label").groupBy("k.dim", "k.value").agg(F.count("*").alias("n"), F.count_if(F.col("label") == 1).alias("n_fraud"))


def balanced_weights(rows: DataFrame, label: str, source_weight: Column | None = None) -> DataFrame:
    """Adds `weight`: n / (2 * n of the class), times a weight of the source."""
    counts = rows.groupBy(label).agg(F.count("*").alias("_n"))
    counts = counts.select(label, "_n", F.sum("_n").over(Window.partitionBy(F.lit(1))).alias("_all"))
    weighted = rows.join(F.broadcast(counts), label)  # one row for each class
    weight = F.col("_all") / (2 * F.col("_n"))
    return weighted.withColumn("weight", weight if source_weight is None else weight * source_weight).drop("_n", "_all")


def upsert_labels(rows: DataFrame, arrival: str = "arrival") -> DataFrame:
    """A row stays if no later one has its URL or its fingerprint. rows: url, fingerprint, arrival, ..."""
    by_url = rows.filter("url IS NOT NULL").groupBy("url").agg(F.max(arrival).alias("_last"))
    by_print = rows.groupBy("fingerprint").agg(F.max(arrival).alias("_last_print"))
    kept = rows.join(by_print, "fingerprint").join(by_url, "url", "left")
    return kept.filter((F.col(arrival) == F.col("_last_print")) & (F.col("_last").isNull() | (F.col(arrival) == F.col("_last")))).select(rows.columns)


def store_key(url: Column, print_: Column) -> Column:
    return F.substring(F.sha1(F.coalesce(url, print_)), 1, 10)


def merge_reviewed(new: DataFrame, reviewed: DataFrame, key: str) -> DataFrame:
    """Newly collected rows keep the label given before; reviewed rows stay even if their source is gone. Columns: key, text, label."""
    a, b = new.alias("a"), reviewed.alias("b")
    return a.join(b, key, "full_outer").select(key, F.coalesce("a.text", "b.text").alias("text"), F.coalesce("b.label", "a.label").alias("label"), F.col("a.text").isNull().alias("source_gone"))


def unseen(new: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """Rows whose key isn't known yet."""
    return new.join(known.select(key).distinct(), key, "left_anti")


def open_text(title: str = "title", description: str = "description") -> Column:
    return N.full_text(F.col(title), F.col(description), F.array().cast("array<string>"))
