"""Feature tables, models and exports."""

from __future__ import annotations

import hashlib
import re
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import signals as S
from ..functions import wording as W
from ..operators import evaluation as E
from ..operators import models as M
from ..operators import text_features as X
from ..operators.storage import stored
from ..plans import dimensions as D
from ..sources.writers import chat_format
from .base import cte, listings, tables
from .scalar_queries import N_WORDS_SQL, lexicon_sql


def _features(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = listings(spark, sf_dir).withColumn("signals", W.lexicon_signals(F.col("description")))
    codes = ["OFFPLATFORM_PAYMENT", "FAKE_PAYMENT_LINK", "PARCEL_CUSTOMS"]
    return df.select("doc_id", F.size(W.words(F.col("description"))).alias("n_words"), F.coalesce("age", F.lit(-1)).alias("age"), F.lit(1).alias("constant"), *[S.highest(F.col("signals"), c).alias(f"signal_{c.lower()}") for c in codes])


def ml01_win10_feature_row(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _features(spark, sf_dir)


def ml02_useful_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = stored(_features(spark, sf_dir))  # numbers only, found once for the choice of columns and for the result
    return M.aligned(df, M.useful_columns(df, [c for c in df.columns if c != "doc_id"]) + ["unseen"], "doc_id")


def _fingerprints(text: pa.Array) -> pa.Array:
    return pa.array([None if t is None else hashlib.sha1(re.sub(r"\W+", " ", t.lower()).strip(" ").encode()).hexdigest() for t in text.to_pylist()], pa.string())


def _texts(spark: SparkSession, sf_dir: str, *labels: str) -> DataFrame:
    """doc_id, text, labels, test: labelled texts, found once; those of one fingerprint (`dataset.fingerprint`, in Arrow batches) are all in one part."""
    docs, table = tables(spark, sf_dir, "documents", "labels")
    test = F.pmod(F.xxhash64(F.arrow_udf(_fingerprints, "string")(F.col("text"))), F.lit(4)) == 0
    return stored(docs.select("doc_id", "text").join(table.select("doc_id", *labels), "doc_id").withColumn("test", test))


def ml06_07_text_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A model fitted on one part of the labelled texts and measured on the other."""
    rows = _texts(spark, sf_dir, "quality").withColumnRenamed("quality", "label")
    scored = M.TextModel(rows.filter("NOT test")).score(rows.filter("test"), "doc_id").join(rows.select("doc_id", "label"), "doc_id")
    return E.metrics(scored.withColumn("model", F.lit("text")), ["model"])


def ml11_retrain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text models of two labels on the same texts, one that fails, and one that is left out."""
    labels = ["quality", "toxic"]
    rows = _texts(spark, sf_dir, *labels)

    @cache
    def shared() -> DataFrame | None:
        """doc_id and the scores of all labels, if the same texts have them."""
        if not rows.filter("(quality IS NULL) <> (toxic IS NULL)").isEmpty():
            return None
        return M.TextModels(M.TextTable(rows.filter("NOT test"), labels), labels).score(rows.filter("test"), "doc_id")

    def text(label: str):
        def fit(train: DataFrame):
            scored = lambda df: shared().select("doc_id", F.col(label).alias("score")) if shared() else M.TextModel(train).score(df, "doc_id")
            return lambda df: scored(df).join(df.select("doc_id", "label"), "doc_id")

        return rows.withColumnRenamed(label, "label"), fit

    models = {"quality": text("quality"), "toxic": text("toxic"), "broken": (rows.withColumnRenamed("quality", "label"), lambda df: lambda test: test.select("missing")), "images": "no image model is installed"}
    return M.retrain(models, spark)


NUMBERS = ["n_words", "german_ratio", "english_ratio", "capitalized_ratio", "caps_ratio", "chars", "signs"]


def _numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, label and features of the wording of labelled texts."""
    docs, labels = tables(spark, sf_dir, "documents", "labels")
    text = F.coalesce("text", F.lit(""))
    wording = {k: v for k, v in W.language_features(text).items() if k in NUMBERS}
    signs = F.when(F.length(text) > 0, (F.length(text) - F.length(F.translate(text, "!*&%$#|", ""))) / F.length(text))
    own = {**wording, "chars": F.length(text), "signs": signs}
    return docs.join(labels, "doc_id").select("doc_id", F.col("quality").alias("label"), *[F.coalesce(own[c].cast("double"), F.lit(0.0)).alias(c) for c in NUMBERS])


def ml08_leaderboard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.leaderboard(_numbers(spark, sf_dir), NUMBERS, "doc_id")


def ml09_cascade_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A cascade fitted on one part of the labelled texts: how many layers it got, and its AUC on the other part."""
    rows = stored(_numbers(spark, sf_dir))  # found once for folds, training and scores
    test = F.pmod(F.xxhash64("doc_id"), F.lit(4)) == 0
    model = M.CascadeForest(rows.filter(~test), NUMBERS, "doc_id")
    scored = model.score(rows.filter(test), "doc_id").join(rows.select("doc_id", "label"), "doc_id")
    return E.metrics(scored.withColumn("layers", F.lit(len(model.layers))), ["layers"])


def ml04_text_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    (docs,) = tables(spark, sf_dir, "documents")
    return X.text_components(docs, "doc_id")[1]


def ml12_zero_shot(spark: SparkSession, sf_dir: str) -> DataFrame:
    (vectors,) = tables(spark, sf_dir, "embeddings")
    classes = vectors.filter("vec_id < 12").select(F.col("vec_id").alias("prompt"), F.col("label").alias("class"), "embedding")
    found = M.zero_shot(vectors, classes, 10.0)
    return found.select("vec_id", "class", F.round("p", 6).alias("p"))


def ml13_image_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    (vectors,) = tables(spark, sf_dir, "embeddings")
    model = F.when(F.col("vec_id") % 3 > 0, F.abs(F.element_at("embedding", 1).cast("double")) / 10)
    weight = F.when(F.col("label") == 1, 0.4).otherwise(0.0)
    return vectors.select("vec_id", F.round(1 - (1 - model) * (1 - weight), 6).alias("score"))


def snk11_ml16_finetune(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = listings(spark, sf_dir).select(F.when(F.col("doc_id") % 5 == 0, "test").otherwise("train").alias("split"), F.col("title").alias("prompt"), F.concat(F.lit("p="), F.when(F.col("doc_id") % 2 == 0, "0.9").otherwise("0.1")).alias("answer"))
    return chat_format(df, "Beurteile die Anzeige.")


QUERIES = {f.__name__: f for f in (ml01_win10_feature_row, ml02_useful_columns, ml06_07_text_model, ml04_text_components, ml08_leaderboard, ml09_cascade_forest, ml11_retrain, ml12_zero_shot, ml13_image_score, snk11_ml16_finetune)}
_W = {c: w for c, w, *_ in D.LEXICON}
_SIGNALS = ", ".join(f"CASE WHEN list_contains(codes, '{c}') THEN {_W[c]} ELSE 0 END::DOUBLE AS signal_{c.lower()}" for c in ("OFFPLATFORM_PAYMENT", "FAKE_PAYMENT_LINK", "PARCEL_CUSTOMS"))
_BASE = f"SELECT doc_id, {N_WORDS_SQL}::INT AS n_words, coalesce(age, -1) AS age, {lexicon_sql()} AS codes FROM listings"
ORACLE_SQL = {
    "ml01_win10_feature_row": cte(f"SELECT doc_id, n_words, age, 1 AS constant, {_SIGNALS} FROM b", ("b", _BASE)),
    "ml02_useful_columns": cte(f"SELECT doc_id, n_words::DOUBLE AS n_words, age::DOUBLE AS age, {_SIGNALS}, 0.0::DOUBLE AS unseen FROM b", ("b", _BASE)),
    "ml13_image_score": "SELECT vec_id, round(1 - (1 - CASE WHEN vec_id % 3 > 0 THEN abs(embedding[1]::DOUBLE) / 10 END) * (1 - CASE WHEN label = 1 THEN 0.4::DOUBLE ELSE 0.0 END), 6) AS score FROM embeddings",
    "ml12_zero_shot": "WITH c AS (SELECT vec_id AS prompt, label AS class, embedding::DOUBLE[] AS w FROM embeddings WHERE vec_id < 12), e AS (SELECT e.vec_id, class, exp(10 * (list_cosine_similarity(e.embedding::DOUBLE[], w) - 1)) AS e FROM embeddings e, c) SELECT vec_id, class, round(sum(e) / sum(sum(e)) OVER (PARTITION BY vec_id), 6) AS p FROM e GROUP BY vec_id, class",
    "snk11_ml16_finetune": cte("""SELECT CASE WHEN doc_id % 5 = 0 THEN 'test' ELSE 'train' END AS split, to_json({'messages': [{'role': 'system', 'content': 'Beurteile die Anzeige.'}, {'role': 'user', 'content': title}, {'role': 'assistant', 'content': 'p=' || CASE WHEN doc_id % 2 = 0 THEN '0.9' ELSE '0.1' END}]})::STRING AS value FROM listings"""),
}
