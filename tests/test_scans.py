"""Whole texts are gone through once: by plan, and with the results of plain loops."""

import re

import pytest
from pyspark.sql import functions as F

from adsentry.functions import redact as R
from adsentry.functions import wording as W
from adsentry.operators import sentences as Z
from adsentry.queries import QUERIES

SF = "/root/testdata/sf0.001"


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def udfs(df, name: str) -> int:
    """In how many places of a plan a function of ours runs."""
    return len(re.findall(rf"ArrowEvalPython \[[^\n]*\b{name}\(", plan(df)))


@pytest.mark.parametrize("query", ["rule_scan", "rule_scan_phrases", "fea01_feature_vector", "txt33_suggestions", "agg26_rules_by_sentence", "agg26_examples"])
def test_phrases_are_sought_once(spark, query):
    assert udfs(QUERIES[query](spark, SF), "_all_groups") == 1


def test_judgements_count_capitals_once(spark):
    found = plan(QUERIES["txt37_judgement_signals"](spark, SF))
    assert found.count("[A-Z]") == 1 and "[^A-Z]" not in found


def test_useful_columns_are_found_once(spark):
    assert not any("documents.parquet" in f for f in QUERIES["ml02_useful_columns"](spark, SF).inputFiles())


def test_word_counts_as_by_patterns(spark):
    texts = ["", None, "Das ist ein HAUS und the CAR fuer STRAßE ßß ßA ßAB!! !!! !", "éABC ABCé, ABC-DEF ÄÖÜ x1Y", "ẞTRASSE Kelvin İstanbul"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    own = W.language_features(F.col("t"))
    n = F.size(W.words(F.col("t")))
    share = lambda pattern: F.when(n == 0, 0.0).otherwise(F.regexp_count("t", F.lit(pattern)) / n)
    rows = df.select(own["n_words"].alias("a"), n.alias("b"), own["caps_ratio"].alias("c"), share(W.CAPS).alias("d"), own["capitalized_ratio"].alias("e"), share(W.CAPITALIZED).alias("f"), own["exclamations"].alias("g"), F.regexp_count("t", F.lit("!{2,}")).alias("h")).collect()
    for r in rows:
        assert (r.a, r.c, r.e, r.g) == (r.b, r.d, r.f, r.h)
    assert rows[2].c > 0 and rows[1].a is None


def test_phrases_as_by_spark_patterns(spark):
    """White space and word characters of other scripts, line ends and capitals, as Spark's own patterns have them."""
    texts = ["Klicke auf\u00a0den Link", "KLICKE\tAUF\x0bDEN LINK", "Ist der Artikel noch verfügbar?\r", "ist der artikel noch verfügbar? \nja", "schickéñ mir bitte jetzt sofort das geld", "in 48 stunden", "in ４８ stunden", "frist von ３ tagen", "Geld\u2028abholen", "\u212aurier holt"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    low = F.lower("t")
    want = F.array_compact(F.array(*[F.when(F.exists(F.array(*[F.regexp_extract(low, "(?smd)" + W.spaced(p), 0) for p in ps]), lambda h: h != ""), code) for code, _, _, _, ps in W.D.LEXICON]))
    rows = df.select(F.transform(W.groups_of(F.col("t")), lambda g: g["code"]).alias("got"), want.alias("want")).collect()
    assert [r.got for r in rows] == [r.want for r in rows] and sum(bool(r.got) for r in rows) >= 4


def test_gates_of_redaction_lose_nothing(spark):
    texts = ["Ruf +49 151 1234567 an", "0044 20 7946 0958", "Tel. 0151 23456789", "max (at) web (dot) de", "MAX[AT]web.de", "a@b.de und @handle", "https://x.de/abc", "nichts", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [r.r for r in df.select(R.redact("t").alias("r")).collect()]
    assert got == ["Ruf +49 111 1111111 an", "0044 11 1111 1111", "Tel. 0111 11111111", "anonym@web.de", "anonym@web.de", "anonym@b.de und @nutzer", "https://x.de/…", "nichts", None]


def test_examples_of_both_kinds_in_one_pass(spark):
    sentences = spark.createDataFrame([(t, n, "Wort" if t % 2 else "x") for t in range(40) for n in range(2)], "task int, nr int, sentence string")
    human = spark.createDataFrame([(t, 0, "zeit") for t in range(40)], "task int, nr int, signal string")
    rules = F.array_compact(F.array(F.when(F.contains("sentence", F.lit("Wort")), "zeit")))
    counts, examples = Z.rules_against_people(sentences, human, rules, ["zeit"])
    assert {(r.signal, r.tp, r.fp, r.fn) for r in counts.collect()} == {("zeit", 20, 20, 20), ("*", 20, 20, 20)}
    got = sorted((r.kind, r.task, r.nr, r.signal) for r in examples.collect())
    assert got == sorted([("missed", t, 0, "zeit") for t in range(0, 30, 2)] + [("false alarm", t, 1, "zeit") for t in range(1, 31, 2)])
