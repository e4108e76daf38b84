"""TXT-04: hosts parted by public-suffix rules."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans import dimensions as D


def suffix_rules(table: DataFrame) -> DataFrame:
    """(name, kind) of the lines of a rule list (column rule): `plain`, `wild` for `*.name`, `free` for `!name`; comments and empty lines
    are none."""
    rule = F.lower(F.trim(F.regexp_extract("rule", r"^\s*(\S*)", 1)))
    found = table.select(rule.alias("rule")).where("rule <> '' AND NOT startswith(rule, '//')")
    kind = F.when(F.startswith("rule", F.lit("*.")), "wild").when(F.startswith("rule", F.lit("!")), "free").otherwise("plain")
    return found.select(F.regexp_replace("rule", r"^(\*\.|!)", "").alias("name"), kind.alias("kind")).distinct()


def default_rules(spark) -> DataFrame:
    return suffix_rules(spark.createDataFrame([(r,) for r in D.SUFFIX_RULES], "rule string"))


def parted_hosts(hosts: DataFrame, rules: DataFrame) -> DataFrame:
    """(host, sub, domain, suffix) of the distinct hosts.

    Each ending of a host is looked up among the rules by an equality join, so any list will do. The longest rule counts: a plain rule is the
    suffix itself, a wild one takes one label more, and a free one is never a suffix, whatever is longer. Without a rule the last label
    is the suffix. A host that is a suffix, or an address, has no domain of its own: it stands as the domain."""
    labels = hosts.select("host").distinct().where("host IS NOT NULL AND host <> ''").withColumn("labels", F.split(F.lower("host"), r"\."))
    address = F.rlike("host", F.lit(r"^\d+(\.\d+){3}$"))
    endings = labels.where(~address).select("host", F.posexplode("labels").alias("i", "label"), "labels")
    endings = endings.select("host", "i", F.array_join(F.slice("labels", F.col("i") + 1, F.size("labels")), ".").alias("name"))
    hits = endings.join(rules, "name").select("host", F.when(F.col("kind") == "wild", F.greatest(F.col("i") - 1, F.lit(0))).when(F.col("kind") == "free", F.col("i") + 1).otherwise(F.col("i")).alias("at"), (F.col("kind") == "free").alias("free"))
    # a wild rule needs a label in place of its star: the ending itself is looked up as a plain rule only
    best = hits.groupBy("host").agg(F.min(F.when(F.col("free"), F.col("at"))).alias("free"), F.min("at").alias("at"))
    joined = labels.join(best, "host", "left").withColumn("n", F.size("labels"))
    at = F.when(address, 0).otherwise(F.coalesce("free", "at", F.col("n") - 1))
    rest = joined.withColumn("at", at)
    part = lambda a, b: F.array_join(F.slice("labels", a + 1, F.greatest(b - a, F.lit(0))), ".")
    whole = address | (F.col("at") == 0)
    return rest.select(
        "host",
        F.when(whole, "").otherwise(part(F.lit(0), F.col("at") - 1)).alias("sub"),
        F.when(whole, F.lower("host")).otherwise(part(F.col("at") - 1, F.col("at"))).alias("domain"),
        F.when(whole, "").otherwise(part(F.col("at"), F.col("n"))).alias("suffix"),
    )
