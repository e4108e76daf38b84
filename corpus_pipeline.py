"""Raw documents to token ids: quality, near-duplicates, benchmark passages, secrets, encoding.

Each stage takes (spark, docs, sf_dir) and works on all rows its predecessor kept. All but the last return the columns of
`documents`, extra ones included; the last returns the ids of every document. An empty table passes all stages.

Hard rows: a null text counts as empty, so it has no words: the classifier rejects it, and the later stages, should one
reach them, keep it. Null doc_ids are passed on and come last where one document of a group stays. Of rows that occur
twice the near-duplicate stage keeps one. Texts are read whole by every stage, whatever their length.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from adsentry.llm import decontaminate, pieces, quality, secret_scan, simhash_dedup
from adsentry.llm._common import new_path, remove, stored, table


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go, those without words among them; repeated rows fare alike."""
    return quality.kept(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of texts of five-word similarity 0.8 or more stays, the one with the smallest doc_id; null
    ids come last, and of texts without words one stays."""
    return simhash_dedup.one_of_each(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold nearly a benchmark item go; with an empty benchmark all stay, and so do null texts."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by a mark, and n_chars is the new length; no document goes. Null texts stay null."""
    return secret_scan.clean(docs)


def piece_encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, the ids of the text, whether decoding gives the text back, and how many ids there are: none for null texts."""
    return pieces.encoded(docs).withColumn("n_ids", F.size("ids").cast("long"))


STAGES = [
    ("quality classifier", quality_classifier),
    ("SimHash near-dedup", near_duplicates),
    ("benchmark decontamination", benchmark_decontamination),
    ("secret scans", secret_scans),
    ("SentencePiece encoding", piece_encoding),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage. What a stage wrote is deleted when the next one has been written."""
    docs, before = table(spark, sf_dir, "documents"), None
    for _, stage in STAGES:
        path = new_path(spark)
        docs = stored(stage(spark, docs, sf_dir), path)
        if before:
            remove(spark, before)
        before = path
    return docs
