"""Signals: one explainable finding each, as structs in an array."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SIGNAL = "struct<code:string,weight:double,evidence:string,hard:boolean,info:boolean,target:string>"
SIGNALS = f"array<{SIGNAL}>"


def signal(code: str | Column, weight: float | Column, evidence: Column | None = None, hard: bool | Column = False, info: bool = False, target: str | None = None) -> Column:
    lit = lambda x: x if isinstance(x, Column) else F.lit(x)
    none = F.lit(None).cast("string")
    fields = (lit(code).alias("code"), lit(weight).cast("double").alias("weight"), (none if evidence is None else evidence).alias("evidence"), F.lit(hard).alias("hard"), F.lit(info).alias("info"), (F.lit(target) if target else none).alias("target"))
    return F.struct(*fields).cast(SIGNAL)


def when(condition: Column, one: Column) -> Column:
    return F.when(condition, one)


def found(*signals: Column) -> Column:
    """The signals that are there, in this order."""
    return F.array_compact(F.array(*signals)).cast(SIGNALS)


def noisy_or(signals: Column) -> Column:
    """1 minus the product of 1 - weight, weights clamped to 0..1."""
    return F.lit(1.0) - F.aggregate(signals, F.lit(1.0), lambda p, s: p * (F.lit(1.0) - F.least(F.greatest(s["weight"], F.lit(0.0)), F.lit(1.0))))


def strongest_first(signals: Column) -> Column:
    """By weight, descending; equal weights in the order they were found."""
    keyed = F.transform(signals, lambda s, i: F.struct((-s["weight"]).alias("w"), i.alias("i"), s.alias("s")))
    return F.transform(F.array_sort(keyed), lambda x: x["s"])


def codes(signals: Column) -> Column:
    return F.transform(signals, lambda s: s["code"])


def highest(signals: Column, code: str) -> Column:
    """The highest weight of a code, else 0."""
    return F.coalesce(F.array_max(F.transform(F.filter(signals, lambda s: s["code"] == code), lambda s: s["weight"])), F.lit(0.0))
