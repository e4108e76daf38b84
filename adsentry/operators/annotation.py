"""Ratings of several people: newest ones, work queues, consensus and agreement."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.redact import redact
from .dataset import fingerprint


def latest(log: DataFrame, keys: list[str], *newest: Column) -> DataFrame:
    """The newest record of each key; later arrival on a tie."""
    n = F.row_number().over(Window.partitionBy(*keys).orderBy(*newest))
    return log.withColumn("_n", n).filter("_n = 1").drop("_n")


def hash_share(id_: Column) -> Column:
    """A number in 0..1 from the first eight hex digits of an id."""
    return F.conv(F.substring(id_, 1, 8), 16, 10).cast("double") / 4294967295.0


def queue(tasks: DataFrame, ratings: DataFrame, person: str, double: float = 0.25) -> DataFrame:
    """Open tasks of a person in their order: second opinions, then tasks nobody rated. tasks: task, id; ratings: task, person."""
    by = ratings.groupBy("task").agg(F.count_distinct("person").alias("n"), F.bool_or(F.col("person").cast("string") == person).alias("mine"))
    open_ = tasks.join(by, "task", "left").filter(~F.coalesce("mine", F.lit(False)))
    second = F.col("n").isNotNull() & (F.col("n") < 2) & (hash_share(F.col("id")) < double)
    rank = F.when(second, 0).when(F.col("n").isNull(), 1)
    return open_.withColumn("priority", rank).filter("priority IS NOT NULL").withColumn("place", F.sha1(F.concat_ws("|", F.lit(person), "id"))).select("task", "priority", "place")


def majority(votes: DataFrame, keys: list[str], value: str, order: Column | None = None) -> DataFrame:
    """keys, winner, is_unique: the most frequent value; ties by `order`, then by the value. Nulls don't count."""
    counts = votes.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("n"))
    by = Window.partitionBy(*keys).orderBy(F.desc("n"), *([] if order is None else [order]), value)
    ranked = counts.withColumn("r", F.row_number().over(by)).withColumn("next", F.lead("n").over(by)).filter("r = 1")
    return ranked.select(*keys, F.col(value).alias("winner"), (F.col("next").isNull() | (F.col("n") > F.col("next"))).alias("is_unique"))


def consensus(ratings: DataFrame, decisions: DataFrame | None = None, unsure: str = "unklar") -> DataFrame:
    """task, status, verdict out of the latest ratings (task, person, value) and decisions (task, value)."""
    sure = ratings.filter(F.col("value") != unsure)
    counts = sure.groupBy("task").agg(F.count("*").alias("votes"), F.count_distinct("value").alias("kinds"))
    out = ratings.select("task").distinct().join(counts, "task", "left").join(majority(sure, ["task"], "value"), "task", "left")
    if decisions is not None:
        out = out.join(decisions.select("task", F.col("value").alias("decided")), "task", "left")
    else:
        out = out.withColumn("decided", F.lit(None).cast("string"))
    status = (
        F.when(F.col("decided").isNotNull(), "entschieden")
        .when(F.col("votes").isNull(), "unklar")
        .when(F.col("votes") == 1, "einfach")
        .when(F.col("kinds") == 1, "einig")
        .when(F.col("is_unique"), "mehrheit")
        .otherwise("konflikt")
    )
    out = out.withColumn("status", status)
    verdict = F.when(F.col("decided") == unsure, None).when(F.col("decided").isNotNull(), F.col("decided")).when(F.col("status").isin("einfach", "einig", "mehrheit"), F.col("winner"))
    return out.select("task", "status", verdict.alias("verdict"))


def krippendorff(votes: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """keys, alpha, percent, shared out of (keys, unit, value): nominal alpha with missing values, the share of units on
    which all agree, and how many units several people rated. Null where it can't be computed."""
    keys = keys or []
    k = votes.filter(F.col("value").isNotNull()).groupBy(*keys, "unit", "value").agg(F.count("*").alias("_k"))
    units = k.groupBy(*keys, "unit").agg(F.sum("_k").alias("m"), F.count("*").alias("kinds"), F.sum(F.col("_k") * F.col("_k")).alias("squares")).filter("m >= 2")
    # of a unit: pairs of different values, over m - 1
    apart = units.groupBy(*keys).agg(F.sum((F.col("m") * F.col("m") - F.col("squares")) / (F.col("m") - 1)).alias("observed"), F.count("*").alias("shared"), F.avg((F.col("kinds") == 1).cast("double")).alias("percent"))
    each = k.join(units.select(*keys, "unit", "m"), [*keys, "unit"]).groupBy(*keys, "value").agg(F.sum("_k").cast("double").alias("n_c"))
    total = each.groupBy(*keys).agg(F.sum("n_c").alias("n"), F.sum(F.col("n_c") * F.col("n_c")).alias("n_c2"))
    both = apart.join(total, keys) if keys else apart.crossJoin(total)  # without keys both are one row
    expected = F.col("n") * F.col("n") - F.col("n_c2")
    alpha = F.when((F.col("n") > 1) & (expected > 1e-12), 1 - (F.col("n") - 1) * F.col("observed") / expected)
    return both.select(*keys, alpha.alias("alpha"), "percent", "shared")


def reading(alpha: Column) -> Column:
    return F.when(alpha.isNull(), "nicht berechenbar").when(alpha >= 0.8, "verlässlich").when(alpha >= 0.667, "vorläufig verwendbar").otherwise("zu gering")


def kappas(ratings: DataFrame) -> DataFrame:
    """a, b, n, kappa for each two people with common units. ratings: unit, person, value; one row per unit and person."""
    right = ratings.select("unit", F.col("person").alias("b"), F.col("value").alias("vb"))
    pairs = ratings.select("unit", F.col("person").alias("a"), F.col("value").alias("va")).join(right, "unit").filter("a < b")
    cells = pairs.groupBy("a", "b", "va", "vb").agg(F.count("*").alias("c"))
    total = cells.groupBy("a", "b").agg(F.sum("c").alias("n"), F.sum(F.when(F.col("va") == F.col("vb"), F.col("c")).otherwise(0)).alias("same"))
    left = cells.groupBy("a", "b", F.col("va").alias("v")).agg(F.sum("c").alias("l"))
    other = cells.groupBy("a", "b", F.col("vb").alias("v")).agg(F.sum("c").alias("r"))
    chance = left.join(other, ["a", "b", "v"]).groupBy("a", "b").agg(F.sum(F.col("l") * F.col("r")).alias("lr"))
    df = total.join(chance, ["a", "b"], "left")
    po, pe = F.col("same") / F.col("n"), F.coalesce("lr", F.lit(0)) / (F.col("n") * F.col("n"))
    return df.select("a", "b", "n", F.when(pe < 1 - 1e-12, (po - pe) / (1 - pe)).alias("kappa"))


def balanced_sample(rows: DataFrame, stratum: str, order: Column, size: int, values: list) -> DataFrame:
    """`size` rows: an equal share of each of the strata `values`, topped up from the rest, in a hash order. Each part is a top-k of Spark, which
    no task needs a whole stratum for: of a stratum at most `size` rows are taken, first those of its share."""
    share = size // max(len(values), 1)
    keyed, parts = rows.withColumn("_o", order), None
    for value in values:
        first = keyed.where(F.col(stratum).eqNullSafe(value)).orderBy("_o").limit(size)
        rank = F.row_number().over(Window.orderBy("_o"))  # over `size` rows
        part = first.withColumn("_rest", (rank > share).cast("int"))
        parts = part if parts is None else parts.unionByName(part)
    return rows.limit(0) if parts is None else parts.orderBy("_rest", "_o").limit(size).drop("_rest", "_o")


def quality_hint(duration: Column, n_chars: Column, verdict: Column, scheme: Column, marks: Column) -> Column:
    """What looks odd about a rating; the first that holds."""
    return (
        F.when((duration < 3) & (n_chars > 200), "sehr schnell")
        .when((verdict == "betrug") & scheme.isNull(), "Betrug ohne Masche")
        .when((verdict == "serioes") & (marks >= 2), "seriös mit Warnsignalen")
        .when((verdict == "betrug") & (marks == 0), "Betrug ohne Warnsignal")
    )


def normalized_rating(verdict: Column, scheme: Column, role: Column) -> list[Column]:
    """Only fraud has a scheme and a role."""
    return [F.when(verdict == "betrug", scheme).alias("scheme"), F.when(verdict == "betrug", role).alias("role")]


def image_verdict(flags: DataFrame, key: str) -> DataFrame:
    """Any suspicious image: fraud; all harmless: legitimate; else unclear. flags: key, flag."""
    verdict = F.when(F.coalesce(F.bool_or(F.col("flag") == "ja"), F.lit(False)), "betrug").when(F.bool_and(F.coalesce(F.col("flag") == "nein", F.lit(False))), "serioes").otherwise("unklar")
    return flags.groupBy(key).agg(verdict.alias("verdict"))


# What a listing loses before it is shared: who, where, and what is known of it.
IDENTIFYING = ("seller_name", "location", "url", "label", "scam_type", "source", "warnsignale")


def anonymised(listings: DataFrame) -> DataFrame:
    """RED-09: the listings with their texts redacted and identifying fields null; `task` is the start of the fingerprint
    of the redacted text, or of the image paths where there is no text, so that it depends on what is shared alone."""
    changed: dict[str, Column] = {c: redact(c) for c in ("title", "description") if c in listings.columns}
    if "messages" in listings.columns:
        changed["messages"] = F.transform("messages", redact)
    hidden = listings.withColumns(changed | {c: F.lit(None).cast(listings.schema[c].dataType) for c in IDENTIFYING if c in listings.columns})
    text = F.concat_ws("\n", *[F.col(c) for c in ("title", "description") if c in changed], *([F.array_join("messages", "\n")] if "messages" in changed else []))
    return hidden.withColumn("task", F.substring(fingerprint(text, F.col("image_paths") if "image_paths" in listings.columns else None), 1, 16))
