"""Filters with reasons, fingerprints, duplicates, splits, statistics, labels."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import normalize as N
from ..functions import wording as W
from ..functions.redact import redact
from ..operators import dataset as T
from .base import cte, listings, tables
from .scalar_queries import FULL_SQL, GERMAN_OK_SQL, LABEL_SQL, _category_sql

FINGERPRINT_SQL = r"sha1(trim(regexp_replace(lower(text), '[^\p{L}\p{N}_]+', ' ', 'g')))"
REASON_SQL = f"CASE WHEN {FULL_SQL} = '' THEN 'empty' WHEN {LABEL_SQL} IS NULL THEN 'no_label' WHEN doc_id % 10 <> 3 AND NOT {GERMAN_OK_SQL} THEN 'not_german' END"
REAL = "doc_id % 5 <> 0"


def _reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = T.open_text()
    reason = T.drop_reason(text == "", N.label_word(F.col("label_raw")).isNull(), W.looks_german(F.col("description")), F.col("doc_id") % 10 != 3)
    return listings(spark, sf_dir).withColumn("reason", reason)


def flt01_02_05_07_drop_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _reasons(spark, sf_dir).groupBy("source", "reason").agg(F.count("*").alias("n"))


def agg05_load_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.load_report(_reasons(spark, sf_dir).select("source", "reason"))


def flt06_for_annotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return listings(spark, sf_dir).filter((T.open_text() != "") & W.looks_german(F.col("description"))).select("doc_id")


def _prints(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = tables(spark, sf_dir, "documents", "labels")
    own = docs.select("doc_id", "source", "lang", T.fingerprint(F.col("text")).alias("fingerprint"))
    return own.join(labels.select("doc_id", F.col("toxic").alias("label")), "doc_id", "left").withColumn("train_only", F.col("doc_id") % 5 == 0)


def set02_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _prints(spark, sf_dir).select("doc_id", "fingerprint")


def set02_redacted_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fingerprint that data sets use: of the redacted text, so that other contact data make no other listing."""
    return listings(spark, sf_dir).select("doc_id", T.fingerprint(redact("description")).alias("fingerprint"))


def set08_task_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _prints(spark, sf_dir).select("doc_id", F.substring("fingerprint", 1, 16).alias("task_id"))


def _unique(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.first_by_priority(_prints(spark, sf_dir), "fingerprint", F.col("train_only"), F.col("source"), F.col("doc_id"))


def set03_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _unique(spark, sf_dir).select("doc_id", "source")


def _labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _unique(spark, sf_dir).filter("label IS NOT NULL")


def win09_set04_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.stratified_split(_labelled(spark, sf_dir), "label", F.sha1(F.concat_ws("|", F.lit("42"), "fingerprint")), F.col("train_only")).select("doc_id", "split")


def agg02_split_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    split = T.stratified_split(_labelled(spark, sf_dir), "label", F.sha1(F.concat_ws("|", F.lit("42"), "fingerprint")), F.col("train_only"))
    return split.groupBy("split").agg(F.count("*").alias("n"), F.sum("label").alias("fraud"))


def agg01_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _prints(spark, sf_dir)
    return rows.agg(F.count("*").alias("n_rows"), (F.count("*") - F.count_distinct("fingerprint")).alias("duplicates"), F.count_if("train_only").alias("train_only"))


def agg03_snk05_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = listings(spark, sf_dir).select("source", N.normalize_category(F.col("category_raw")).alias("category"), N.label_word(F.col("label_raw")).alias("label"))
    return T.dataset_stats(rows, "source", "category")


def agg03_grouping_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders, customer, nation = tables(spark, sf_dir, "orders", "customer", "nation")
    joined = orders.join(customer, orders.o_custkey == customer.c_custkey).join(nation, customer.c_nationkey == nation.n_nationkey)
    sets = joined.groupingSets([["n_name"], ["o_orderstatus"], []], "n_name", "o_orderstatus")
    return sets.agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 1).alias("total"))


def agg06_class_balance(spark: SparkSession, sf_dir: str) -> DataFrame:
    (labels,) = tables(spark, sf_dir, "labels")
    share = F.avg("toxic")
    return labels.agg(F.round(share, 9).alias("share"), F.when(~share.between(0.15, 0.85), "unausgewogen").alias("hint"))


def agg07_label_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _prints(spark, sf_dir).agg(F.count("label").alias("total"), F.count_if(F.col("label") == 1).alias("fraud"), F.count_if(F.col("label") == 0).alias("legit"), F.count_distinct(F.when(F.col("label").isNotNull(), F.col("fingerprint"))).alias("texts"))


def agg09_ml10_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _prints(spark, sf_dir).filter("label IS NOT NULL")
    weighted = T.balanced_weights(rows, "label", F.when(F.col("source") == "src1", 0.5).otherwise(1.0))
    return weighted.select("doc_id", F.round("weight", 9).alias("weight"))


def agg33_finetune_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    split = T.stratified_split(_labelled(spark, sf_dir), "label", F.sha1(F.concat_ws("|", F.lit("42"), "fingerprint")), F.col("train_only"))
    return split.groupBy("split", "label").agg(F.count("*").alias("n"))


def lab01_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _prints(spark, sf_dir).select("doc_id", F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("u"), (F.col("doc_id") % 101).cast("string"))).alias("url"), "fingerprint", F.col("doc_id").alias("arrival"))
    return T.upsert_labels(rows).select("doc_id", "url")


def lab02_store_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _prints(spark, sf_dir).select("doc_id", T.store_key(F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("u"), F.col("doc_id").cast("string"))), F.col("fingerprint")).alias("store_key"))


def set06_text_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    (docs,) = tables(spark, sf_dir, "documents")
    keyed = docs.select("doc_id", F.substring(N.text_key(F.col("text")), 1, 300).alias("text_key"))
    return T.first_by_priority(keyed, "text_key", F.col("doc_id")).select("doc_id")


def join04_06_unseen(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _prints(spark, sf_dir)
    return T.unseen(rows.filter("NOT train_only"), rows.filter("train_only"), "fingerprint").select("doc_id")


def join05_import_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of which no blog has the same content; what blogs have was imported before."""
    (pages,) = tables(spark, sf_dir, "pages")
    hashed = pages.select("page_id", F.sha1("html").alias("sha1"))
    return T.unseen(hashed, pages.filter("url LIKE '%//blog.%'").select(F.sha1("html").alias("sha1")), "sha1").select("page_id")


def join08_flt12_merge_reviewed(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = tables(spark, sf_dir, "documents", "labels")
    new = docs.filter("lang <> 'es'").select(  # sources in Spanish have vanished
        "doc_id", F.col("source").alias("text"), F.lit(None).cast("int").alias("label"))
    reviewed = labels.select("doc_id", F.lit("alt").alias("text"), F.col("quality").alias("label"))
    return T.merge_reviewed(new, reviewed, "doc_id")


def join07_bundle_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the same log in two bundles, the longer one wins."""
    (chats,) = tables(spark, sf_dir, "conversations")
    bundles = chats.groupBy("conv_id", (F.col("turn") % 2).alias("bundle")).agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("size"))
    return bundles.groupBy("conv_id").agg(F.max_by("bundle", F.struct("n", "size", -F.col("bundle"))).alias("bundle"))


def src16_reviewed_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = tables(spark, sf_dir, "documents", "labels")
    rows = docs.join(labels, "doc_id", "left").filter("quality IS NOT NULL").select("doc_id", F.sha1(N.text_key(F.col("text"))).alias("text_key"), "quality")
    return T.first_by_priority(rows, "text_key", F.col("doc_id")).select("text_key", "quality")


def src13_seed_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    (pages,) = tables(spark, sf_dir, "pages")
    host = F.regexp_extract("url", "^https?://([^/]+)", 1)
    seeds = pages.select(host.alias("host")).distinct().filter(F.col("host").like("blog.%"))
    return pages.withColumn("host", host).join(seeds, "host", "left_semi").select("page_id", "host")


def flt09_page_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first turn of a chat and the newest two others."""
    from pyspark.sql import Window

    (chats,) = tables(spark, sf_dir, "conversations")
    up, down = Window.partitionBy("conv_id").orderBy("turn"), Window.partitionBy("conv_id").orderBy(F.desc("turn"))
    return chats.withColumn("a", F.row_number().over(up)).withColumn("b", F.row_number().over(down)).filter("a = 1 OR b <= 2").select("conv_id", "turn")


def flt11_rating_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    (events,) = tables(spark, sf_dir, "events")
    known = events.select("event_type").distinct().filter("event_type <> 'error'").withColumnRenamed("event_type", "value")
    return events.select("event_id", F.col("event_type").alias("value")).join(F.broadcast(known), "value", "left_anti")


def flt13_fraud_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = listings(spark, sf_dir).withColumn("images", F.array(F.concat("source", F.lit("/a.jpg")), F.concat(F.lit("synthetisch/"), "source")))
    each = rows.filter(N.label_word(F.col("label_raw")) == 1).select("doc_id", F.explode("images").alias("path"))
    return each.filter(~F.startswith("path", F.lit("synthetisch/")))


PRINTS = f"SELECT d.doc_id, d.source, d.lang, {FINGERPRINT_SQL} AS fingerprint, l.toxic AS label, d.doc_id % 5 = 0 AS train_only FROM documents d LEFT JOIN labels l USING (doc_id)"
UNIQUE = "SELECT * EXCLUDE (n) FROM (SELECT *, row_number() OVER (PARTITION BY fingerprint ORDER BY train_only, source, doc_id) AS n FROM prints) WHERE n = 1"
SPLIT = """SELECT doc_id, label, CASE WHEN r <= round_even(n * 0.15, 0) THEN 'test' WHEN r <= round_even(n * 0.3, 0) THEN 'val' ELSE 'train' END AS split FROM
  (SELECT *, row_number() OVER (PARTITION BY label ORDER BY sha1('42|' || fingerprint)) AS r, count(*) OVER (PARTITION BY label) AS n FROM uniq WHERE label IS NOT NULL AND NOT train_only)
  UNION ALL SELECT doc_id, label, 'train' FROM uniq WHERE label IS NOT NULL AND train_only"""


def _sql(body: str) -> str:
    return f"WITH prints AS ({PRINTS}), uniq AS ({UNIQUE}), splits AS ({SPLIT}) {body}"


QUERIES = {f.__name__: f for f in (
    flt01_02_05_07_drop_reasons, agg05_load_report, flt06_for_annotation, set02_fingerprint, set02_redacted_fingerprint, set08_task_id, set03_dedupe, win09_set04_split, agg02_split_counts, agg01_totals, agg03_snk05_statistics, agg03_grouping_sets,
    agg06_class_balance, agg07_label_counts, agg09_ml10_weights, agg33_finetune_labels, lab01_upsert, lab02_store_key, set06_text_dedupe, join04_06_unseen, join05_import_ledger, join08_flt12_merge_reviewed,
    join07_bundle_merge, src16_reviewed_list, src13_seed_pages, flt09_page_sample, flt11_rating_problems, flt13_fraud_images,
)}
ORACLE_SQL = {
    "flt01_02_05_07_drop_reasons": cte(f"SELECT source, {REASON_SQL} AS reason, count(*) AS n FROM listings GROUP BY ALL"),
    "agg05_load_report": cte(f"SELECT source, count(*) AS n_rows, count(*) FILTER (reason = 'empty') AS empty, count(*) FILTER (reason = 'no_label') AS no_label, count(*) FILTER (reason = 'not_german') AS not_german, count(*) FILTER (reason IS NULL) AS kept FROM (SELECT source, {REASON_SQL} AS reason FROM listings) GROUP BY source"),
    "flt06_for_annotation": cte(f"SELECT doc_id FROM listings WHERE {FULL_SQL} <> '' AND {GERMAN_OK_SQL}"),
    "set02_fingerprint": _sql("SELECT doc_id, fingerprint FROM prints"),
    "set08_task_id": _sql("SELECT doc_id, left(fingerprint, 16) AS task_id FROM prints"),
    "set03_dedupe": _sql("SELECT doc_id, source FROM uniq"),
    "win09_set04_split": _sql("SELECT doc_id, split FROM splits"),
    "agg02_split_counts": _sql("SELECT split, count(*) AS n, sum(label)::BIGINT AS fraud FROM splits GROUP BY split"),
    "agg01_totals": _sql("SELECT count(*) AS n_rows, count(*) - count(DISTINCT fingerprint) AS duplicates, count(*) FILTER (train_only) AS train_only FROM prints"),
    "agg03_snk05_statistics": cte(f"SELECT k.dim AS dim, k.value AS value, count(*) AS n, count(*) FILTER (label = 1) AS n_fraud FROM (SELECT unnest([{{'dim': 'source', 'value': source}}, {{'dim': 'category', 'value': {_category_sql()}}}, {{'dim': 'total', 'value': ''}}]) AS k, {LABEL_SQL} AS label FROM listings) GROUP BY ALL"),
    "agg03_grouping_sets": "SELECT n_name, o_orderstatus, count(*) AS n, round(sum(o_totalprice), 1) AS total FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY GROUPING SETS ((n_name), (o_orderstatus), ())",
    "agg06_class_balance": "SELECT round(avg(toxic), 9) AS share, CASE WHEN avg(toxic) NOT BETWEEN 0.15 AND 0.85 THEN 'unausgewogen' END AS hint FROM labels",
    "agg07_label_counts": _sql("SELECT count(label) AS total, count(*) FILTER (label = 1) AS fraud, count(*) FILTER (label = 0) AS legit, count(DISTINCT fingerprint) FILTER (label IS NOT NULL) AS texts FROM prints"),
    "agg09_ml10_weights": _sql("SELECT doc_id, round(count(*) OVER () / (2.0 * count(*) OVER (PARTITION BY label)) * CASE WHEN source = 'src1' THEN 0.5 ELSE 1.0 END, 9)::DOUBLE AS weight FROM prints WHERE label IS NOT NULL"),
    "agg33_finetune_labels": _sql("SELECT split, label, count(*) AS n FROM splits GROUP BY ALL"),
    "lab01_upsert": _sql("SELECT doc_id, url FROM (SELECT doc_id, url, fingerprint, max(doc_id) OVER (PARTITION BY fingerprint) AS p, CASE WHEN url IS NOT NULL THEN max(doc_id) OVER (PARTITION BY url) END AS u FROM (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'u' || (doc_id % 101) END AS url, fingerprint FROM prints)) WHERE doc_id = p AND (u IS NULL OR doc_id = u)"),
    "lab02_store_key": _sql("SELECT doc_id, left(sha1(coalesce(CASE WHEN doc_id % 3 = 0 THEN 'u' || doc_id END, fingerprint)), 10) AS store_key FROM prints"),
    "set06_text_dedupe": r"SELECT min(doc_id) AS doc_id FROM documents GROUP BY left(regexp_replace(lower(text), '[^\p{L}\p{N}_]+', '', 'g'), 300)",
    "join04_06_unseen": _sql("SELECT doc_id FROM prints WHERE NOT train_only AND fingerprint NOT IN (SELECT fingerprint FROM prints WHERE train_only)"),
    "join05_import_ledger": "SELECT page_id FROM pages WHERE sha1(html) NOT IN (SELECT sha1(html) FROM pages WHERE url LIKE '%//blog.%')",
    "join08_flt12_merge_reviewed": "SELECT coalesce(d.doc_id, l.doc_id) AS doc_id, coalesce(d.source, 'alt') AS text, l.quality AS label, d.source IS NULL AS source_gone FROM (SELECT * FROM documents WHERE lang <> 'es') d FULL JOIN labels l ON d.doc_id = l.doc_id",
    "join07_bundle_merge": "SELECT conv_id, bundle FROM (SELECT conv_id, turn % 2 AS bundle, row_number() OVER (PARTITION BY conv_id ORDER BY count(*) DESC, sum(length(text)) DESC, turn % 2) AS r FROM conversations GROUP BY conv_id, turn % 2) WHERE r = 1",
    "src16_reviewed_list": r"SELECT text_key, quality FROM (SELECT sha1(regexp_replace(lower(text), '[^\p{L}\p{N}_]+', '', 'g')) AS text_key, quality, row_number() OVER (PARTITION BY regexp_replace(lower(text), '[^\p{L}\p{N}_]+', '', 'g') ORDER BY doc_id) AS r FROM documents JOIN labels USING (doc_id) WHERE quality IS NOT NULL) WHERE r = 1",
    "src13_seed_pages": "SELECT page_id, regexp_extract(url, '^https?://([^/]+)', 1) AS host FROM pages WHERE regexp_extract(url, '^https?://([^/]+)', 1) LIKE 'blog.%'",
    "flt09_page_sample": "SELECT conv_id, turn FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS a, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS b FROM conversations) WHERE a = 1 OR b <= 2",
    "flt11_rating_problems": "SELECT event_id, event_type AS value FROM events WHERE event_type = 'error'",
    "flt13_fraud_images": cte(f"SELECT doc_id, source || '/a.jpg' AS path FROM listings WHERE {LABEL_SQL} = 1"),
}
