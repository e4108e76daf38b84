"""The prefilters lose nothing: what a pattern of the fixed values matches holds one of its stems."""

import re

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from adsentry.functions import offer as O
from adsentry.functions import wording as W
from adsentry.plans import dimensions as D

WORD = "[a-zäöüß0-9_]"
PHRASES = [(code, p, s) for code, _, _, _, patterns in D.LEXICON for p, s in zip(patterns, D.STEMS[code], strict=True)]
PRICES = [("PRICE", p, s) for (p, _, _), s in zip(D.PRICE_REFERENCE, D.PRICE_STEMS, strict=True)]


def plain(code, pattern):
    return (W.spaced(pattern).replace(r"[\p{L}\p{N}_]", WORD) if code != "PRICE" else pattern).replace(r"\b", "")


@pytest.mark.parametrize("code,pattern,stems", PHRASES + PRICES)
def test_stems_are_needed(code, pattern, stems):
    @settings(max_examples=25, deadline=None, database=None, derandomize=True, suppress_health_check=list(HealthCheck))
    @given(st.from_regex(re.compile(plain(code, pattern), re.ASCII), fullmatch=True))
    def holds(text):
        assert any(s in text for s in stems.split())

    assert stems.split()
    holds()


def test_groups_of_texts_as_by_plain_patterns(spark):
    """Each pattern's own words, alone and between others, give the groups that plain patterns give; so do null and ''."""
    words = [re.sub(r"\(([^()|]*)[^()]*\)\??", r"\1", re.sub(r"\(([^()|]*)[^()]*\)\??", r"\1", p)) for _, p, _ in PHRASES]
    words = [re.sub(r"\.\{0,\d+\}", " x ", re.sub(r"\\[wd][*+]?|\[[^]]*\][?+]?|\?", "", w)) for w in words]
    texts = [*words, *[f"Nun ja,\n{a.upper()}. {b}" for a, b in zip(words, words[1:])], "", "kein Wort davon", None]
    want = []
    for t in texts:
        groups = [code for code, _, _, _, ps in D.LEXICON if any(re.search("(?sm)" + plain(code, p), t.lower()) for p in ps)] if t else []
        want.append(groups)
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = {r.i: r.c for r in df.select("i", F.transform(W.lexicon_signals(F.col("t")), lambda s: s["code"]).alias("c")).collect()}
    assert [got[i] or [] for i in range(len(texts))] == want
    assert sum(map(bool, want)) > len(words)


def test_games_and_accessories(spark):
    titles = {"PS5 + 2 Spiele": 280.0, "PS5 mit Spiele": 280.0, "PS5 Spiele Paket": None, "Hülle für iPhone 15 Pro": None, "iPhone 15 Pro": 450.0, "Vermietete Nintendo Switch": None, "Nintendo Switch": 120.0, "": None}
    df = spark.createDataFrame(list(titles), "string").select("value", O.reference_min(F.col("value"), F.lit("")).alias("v"))
    assert {r.value: r.v for r in df.collect()} == titles
