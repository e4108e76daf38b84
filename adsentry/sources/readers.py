"""Readers: heterogeneous files to one schema. All of them read through Spark, so any file system it knows will do."""

from __future__ import annotations

import csv
import re
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import normalize as N
from ..plans import dimensions as D

SNIFFED = 16_384
# The manifest of a listing's folder, and the files that belong to listings.
MANIFEST = "inserat.json"
LISTING_FILES = r"\.(jpg|jpeg|jfif|jpe|png|webp|html|htm|pdf|txt)$|^inserat\.json$"
LOG_NAME = r"(aufgaben|einstufungen|entscheidungen)_([a-z0-9]+)\.jsonl$"


@dataclass
class SourceSpec:
    """How to read a source: where, in which format, which columns, which labels."""

    name: str
    path: str
    kind: str  # csv, jsonl, parquet, images
    column_map: dict[str, str] = field(default_factory=dict)  # ours -> theirs; empty: by the usual names
    label_map: dict[str, int] = field(default_factory=dict)
    fixed_label: int | None = None
    category: str | None = None
    train_only: bool = False
    german_only: bool = True
    max_rows: int | None = None
    transform: Callable[[DataFrame], DataFrame] | None = None


def sniffed(spark: SparkSession, path: str) -> DataFrame:
    """path, delimiter and encoding of each file, from its first bytes only; a .tsv has tabs."""

    @F.udf("struct<delimiter:string,encoding:string>")
    def guess(name: str, head: bytes):
        try:
            text, encoding = bytes(head).decode("utf-8-sig"), "UTF-8"
        except UnicodeDecodeError as e:
            cut_character = e.start > len(head) - 4 and len(head) == SNIFFED
            text, encoding = (bytes(head)[: e.start].decode("utf-8-sig"), "UTF-8") if cut_character else (bytes(head).decode("cp1252", "replace"), "windows-1252")
        if name.endswith(".tsv"):
            return "\t", encoding
        try:
            return csv.Sniffer().sniff(text, ",;\t|").delimiter, encoding
        except csv.Error:
            return ",", encoding

    files = spark.read.format("binaryFile").load(path)
    return files.select("path", guess("path", F.substring("content", 1, SNIFFED)).alias("g")).select("path", "g.*")


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """CSV files of any mix of delimiters and encodings; files of the same kind are read together."""
    kinds: dict[tuple[str, str], list[str]] = {}
    for r in sniffed(spark, path).collect():  # one short row for each file
        kinds.setdefault((r.delimiter, r.encoding), []).append(r.path)
    out = None
    if any(encoding != "UTF-8" for _, encoding in kinds):
        spark.conf.set("spark.sql.legacy.javaCharsets", True)  # else only Unicode and Latin-1 may be read
    for (delimiter, encoding), paths in sorted(kinds.items()):
        df = spark.read.option("header", True).option("sep", delimiter).option("encoding", encoding).option("multiLine", True).csv(paths)
        df = df.toDF(*[c.lstrip("﻿") for c in df.columns])
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    if out is None:
        raise FileNotFoundError(path)
    return out


def read_jsonl(spark: SparkSession, path: str, schema: str | None = None, max_rows: int | None = None, tolerant: bool = False) -> DataFrame:
    """JSON lines; only \\n ends a line. tolerant: lines that are no JSON are skipped instead of failing."""
    reader = spark.read.option("lineSep", "\n").option("mode", "DROPMALFORMED" if tolerant else "FAILFAST")
    df = (reader.schema(schema) if schema else reader).json(path)
    return df if max_rows is None else df.limit(max_rows)


def read_parquet(spark: SparkSession, path: str, max_rows: int | None = None) -> DataFrame:
    df = spark.read.parquet(path)
    return df if max_rows is None else df.limit(max_rows)


def read_images(spark: SparkSession, path: str) -> DataFrame:
    """path, sha1 and label of the image files below a folder; the label comes from the folder's name, the kind from the first bytes."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return files.filter(is_image(F.col("content"))).select("path", F.sha1("content").alias("sha1"), label_of_path(F.col("path")).alias("label"))


def is_image(content: Column) -> Column:
    head = F.hex(F.substring(content, 1, 12))
    return F.rlike(head, F.lit("^(FFD8FF|89504E47|47494638|52494646.{8}57454250)"))


def label_of_path(path: Column) -> Column:
    folder = F.element_at(F.split(path, "/"), -2)
    return N.label_word(folder)


def listing_items(spark: SparkSession, root: str) -> DataFrame:
    """SRC-09: (label, item, files) of the listings below a folder of label folders, out of the paths alone; no file is read.

    In a label's folder each file is a listing, and so is each sub-folder with all that is below it; but of a sub-folder that holds folders with a
    manifest, and none itself, these are the listings. Hidden files, and files of other kinds, are none. The label comes from the folder's name."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("path")
    base = root.rstrip("/").split("://")[-1].replace("file:", "")
    below = F.split(F.regexp_replace("path", "^.*?" + re.escape(base) + "/", ""), "/")
    files = found.select("path", below.alias("p")).where(F.size("p") >= 2)
    name = F.element_at("p", -1)
    files = files.where(F.rlike(F.lower(name), F.lit(LISTING_FILES)) & ~F.exists("p", lambda x: F.rlike(x, F.lit("^[_.]"))))
    files = files.select("path", F.get("p", F.lit(0)).alias("label"), F.get("p", F.lit(1)).alias("entry"), F.get("p", F.lit(2)).alias("inner"), F.size("p").alias("depth"), (F.lower(name) == MANIFEST).alias("manifest"))
    marks = files.where("manifest")
    own = marks.where("depth = 3").select("label", "entry").distinct().withColumn("own", F.lit(True))
    nested = marks.where("depth = 4").select("label", "entry", "inner").distinct().withColumn("nested", F.lit(True))
    holds = nested.select("label", "entry").distinct().withColumn("holds", F.lit(True))
    each = files.join(own, ["label", "entry"], "left").join(holds, ["label", "entry"], "left").join(nested, ["label", "entry", "inner"], "left")
    apart = F.col("holds") & F.col("own").isNull()
    item = F.when((F.col("depth") == 2) & ~F.col("manifest"), F.col("entry")).when(F.col("depth") == 2, None).when(F.coalesce(apart, F.lit(False)), F.when(F.col("nested"), F.concat_ws("/", "entry", "inner"))).otherwise(F.col("entry"))
    rows = each.withColumn("item", item).where("item IS NOT NULL").groupBy("label", "item").agg(F.array_sort(F.collect_list("path")).alias("files"))
    return rows.select(N.label_word(F.col("label")).alias("label"), "item", "files")


def read_listing_folders(spark: SparkSession, path: str) -> DataFrame:
    """One row for each listing: label/category/item/files, with the texts of its files in order of their names."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    parts = F.split("path", "/")
    texts = files.filter(~is_image(F.col("content"))).select(
        F.element_at(parts, -4).alias("label_raw"), F.element_at(parts, -3).alias("category_raw"), F.element_at(parts, -2).alias("item"), F.element_at(parts, -1).alias("file"), F.decode("content", "UTF-8").alias("text")
    )
    rows = texts.groupBy("label_raw", "category_raw", "item").agg(F.array_sort(F.collect_list(F.struct("file", "text"))).alias("files"))
    return rows.select(N.label_word(F.col("label_raw")).alias("label"), N.normalize_category(F.col("category_raw")).alias("category"), "item", "files")


def read_person_logs(spark: SparkSession, folder: str, kind: str, schema: str) -> DataFrame:
    """The logs kind_<person>.jsonl of a folder with `person` from the name; other files and broken lines are skipped."""
    df = spark.read.schema(schema).option("lineSep", "\n").option("mode", "DROPMALFORMED").option("pathGlobFilter", f"{kind}_*.jsonl").json(folder)
    name = F.col("_metadata.file_name")
    return df.select("*", F.regexp_extract(name, LOG_NAME, 2).alias("person"), F.regexp_extract(name, LOG_NAME, 1).alias("kind")).filter((F.col("kind") == kind) & (F.col("person") != "")).drop("kind")


def harmonised(df: DataFrame, spec: SourceSpec | None = None) -> tuple[DataFrame | None, str | None]:
    """Our columns out of a source's, by its map or by usual names; or None and the reason why it can't be used."""
    spec = spec or SourceSpec("", "", "")
    plain = {c.strip().lower().replace(" ", "_").replace("-", "_"): c for c in df.columns}
    found = spec.column_map or {ours: plain[theirs] for ours, names in D.COLUMN_ALIASES.items() for theirs in names[::-1] if theirs in plain}
    label = next((plain[a] for a in D.LABEL_ALIASES if a in plain), None)
    if label is None and spec.fixed_label is None:
        return None, "no label column"
    if not {"title", "description", "messages"} & set(found):
        return None, "no text column"
    column = lambda ours: F.col(f"`{found[ours]}`") if ours in found else F.lit(None)
    raw = None if label is None else F.col(f"`{label}`").cast("string")
    given = N.resolve_label(raw, spec.label_map, spec.fixed_label) if spec.label_map or spec.fixed_label is not None else N.label_word(raw)
    rows = df.select(
        F.coalesce(column("title").cast("string"), F.lit("")).alias("title"), F.coalesce(column("description").cast("string"), F.lit("")).alias("description"), N.parse_price(column("price").cast("string")).alias("price"),
        (F.lit(spec.category) if spec.category else N.normalize_category(column("category").cast("string"))).alias("category"), N.as_list(column("messages").cast("string")).alias("messages"), given.alias("label"), F.lit(spec.name).alias("source"),
    )
    return rows, None


def read_source(spark: SparkSession, spec: SourceSpec) -> DataFrame:
    df = {"csv": read_csv, "jsonl": read_jsonl, "parquet": read_parquet, "images": read_images}[spec.kind](spark, spec.path)
    df = df if spec.max_rows is None else df.limit(spec.max_rows)
    df = df if spec.transform is None else spec.transform(df)
    rows, reason = harmonised(df, spec)
    if rows is None:
        raise ValueError(f"{spec.name}: {reason}")
    return rows
