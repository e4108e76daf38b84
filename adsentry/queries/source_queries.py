"""Unions of sources, lookups in dimensions, and small filters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import normalize as N
from ..operators import dataset as T
from ..plans import dimensions as D
from .base import cte, listings, tables
from .scalar_queries import BADGE_SQL



def src05_flt10_long_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts long enough to be a screenshot's rather than a photo's."""
    (docs,) = tables(spark, sf_dir, "documents")
    return docs.filter(F.length(F.trim("text")) >= 80).select("doc_id", "n_chars")


def set01_union_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, chats, items = tables(spark, sf_dir, "documents", "conversations", "benchmark")
    every = T.union_sources({"ads": docs.select("text"), "chats": chats.select("text", "role"), "held out": items.select("text")})
    return every.groupBy("source").agg(F.count("*").alias("n"), F.count("role").alias("with_role"))


def nrm08_label_meaning(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels of a source by its own meanings, joined from a dimension."""
    (docs,) = tables(spark, sf_dir, "documents")
    meaning = spark.createDataFrame([("en", 1), ("de", 0), ("fr", 0)], "lang string, label int")
    return docs.join(F.broadcast(meaning), "lang", "left").groupBy("label").agg(F.count("*").alias("n"))


def nrm27_display_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A code's name from the codebook, else the code itself."""
    names = spark.createDataFrame([(k, v) for k, v in D.BADGES.items() if k != "freundlich"], "badge string, name string")
    df = listings(spark, sf_dir).select("doc_id", N.badge_key(F.col("badge_raw")).alias("badge"))
    return df.join(F.broadcast(names), "badge", "left").select("doc_id", F.coalesce("name", "badge").alias("name"))


def agg04_with_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    images = F.when(F.col("doc_id") % 3 == 0, F.array("source")).otherwise(F.array())
    return listings(spark, sf_dir).select(images.alias("images"), "lang").groupBy("lang").agg(F.count_if(F.size("images") > 0).alias("n"))


def set07_labelled_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Own labels before others, first text wins, binary and empty texts out."""
    docs, labels = tables(spark, sf_dir, "documents", "labels")
    rows = docs.join(labels, "doc_id").filter(~N.looks_binary(F.col("text")) & (F.trim("text") != ""))
    keyed = rows.select("doc_id", "quality", T.fingerprint(F.col("text")).alias("fingerprint"), (F.col("source") != "src3").alias("other"))
    return T.first_by_priority(keyed, "fingerprint", F.col("other"), F.col("doc_id")).select("doc_id", "quality")


QUERIES = {f.__name__: f for f in (src05_flt10_long_texts, set01_union_sources, nrm08_label_meaning, nrm27_display_names, agg04_with_images, set07_labelled_pool)}
_NAMES = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in D.BADGES.items() if k != "freundlich")
ORACLE_SQL = {
    "src05_flt10_long_texts": "SELECT doc_id, n_chars FROM documents WHERE length(trim(text)) >= 80",
    "set01_union_sources": "SELECT 'ads' AS source, count(*) AS n, 0::BIGINT AS with_role FROM documents UNION ALL SELECT 'chats', count(*), count(role) FROM conversations UNION ALL SELECT 'held out', count(*), 0 FROM benchmark",
    "nrm08_label_meaning": "SELECT CASE lang WHEN 'en' THEN 1 WHEN 'de' THEN 0 WHEN 'fr' THEN 0 END AS label, count(*) AS n FROM documents GROUP BY ALL",
    "nrm27_display_names": cte(f"SELECT doc_id, CASE badge {_NAMES} ELSE badge END AS name FROM (SELECT doc_id, {BADGE_SQL} AS badge FROM listings)"),
    "agg04_with_images": "SELECT lang, count(*) FILTER (doc_id % 3 = 0) AS n FROM documents GROUP BY lang",
    "set07_labelled_pool": r"SELECT doc_id, quality FROM (SELECT doc_id, quality, row_number() OVER (PARTITION BY trim(regexp_replace(lower(text), '[^\p{L}\p{N}_]+', ' ', 'g')) ORDER BY source <> 'src3', doc_id) AS r FROM documents JOIN labels USING (doc_id) WHERE trim(text) <> '') WHERE r = 1",
}
