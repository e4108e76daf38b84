"""What is computed once, and what is not shuffled."""

from pyspark.sql import functions as F

from adsentry.functions import wording as W
from adsentry.queries import QUERIES

SF = "/root/testdata/sf0.001"


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_german_words_are_found_once(spark):
    texts = [("www.a.de/x und der und die das ist", True), ("the and the and of you are", False), (None, None), ("kurz", True), ("x.y" + "." * 2000 + " der die das und ist", True), ("aa.bb/ mail@x.de siehe the and of you", False)]
    df = spark.createDataFrame(texts, "text string, want boolean").repartition(2)
    rows = df.select("want", W.looks_german(F.col("text")).alias("got"))
    assert plan_of(rows).count("regexp_extract_all") == 1
    assert all(r.want == r.got for r in rows.collect())


def test_prompt_blocks_rank_without_texts(spark):
    """Of the windows, the widest ranks chosen cases only: texts meet them by a broadcast of the cases."""
    plan = plan_of(QUERIES["ml15_prompt_block"](spark, SF))
    assert plan.count("Window ") >= 2 and "BroadcastExchange" in plan
