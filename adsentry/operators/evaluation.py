"""Precision, recall, F1 and the exact AUC of scores."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def metrics(scored: DataFrame, keys: list[str], threshold: float = 0.5) -> DataFrame:
    """keys, n, precision, recall, f1, auc, failed out of (keys, label, score); a null score is a failure.

    The AUC is the rank sum with average ranks of ties. Rows are counted by distinct score first, so what is ordered is
    as long as there are scores, not rows."""
    hit = F.col("score") >= threshold
    count = lambda c: F.count_if(c)
    base = scored.groupBy(*keys).agg(
        F.count("score").alias("n"), count(F.col("score").isNull()).alias("failed"), count(hit & (F.col("label") == 1)).alias("tp"), count(hit & (F.col("label") == 0)).alias("fp"), count(~hit & (F.col("label") == 1)).alias("fn")
    )
    safe = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    base = base.select(*keys, "n", "failed", safe(tp, tp + fp).alias("precision"), safe(tp, tp + fn).alias("recall"), safe(2 * tp, 2 * tp + fp + fn).alias("f1"))
    by_score = scored.filter("score IS NOT NULL").groupBy(*keys, "score").agg(count(F.col("label") == 1).alias("p"), count(F.col("label") == 0).alias("q"))
    below = F.coalesce(F.sum(F.col("q")).over(Window.partitionBy(*keys).orderBy("score").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    wins = by_score.withColumn("wins", F.col("p") * (below + F.col("q") / 2)).groupBy(*keys).agg(F.sum("wins").alias("wins"), F.sum("p").alias("p"), F.sum("q").alias("q"))
    auc = wins.select(*keys, F.when((F.col("p") > 0) & (F.col("q") > 0), F.col("wins") / (F.col("p") * F.col("q"))).alias("auc"))
    return base.join(auc, keys, "left")
