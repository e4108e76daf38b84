"""Packed texts and the logistic regression on them, against dense numpy."""

from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from adsentry.operators import dataset, packed, text_features
from adsentry.operators import models as M

from .test_text_features import character_terms, tfidf, word_terms

SF = "/root/testdata/sf0.001"


def dense(texts, most):
    """TF-IDF of both kinds side by side: the rows of a matrix."""
    parts = []
    for plain in (character_terms, word_terms):
        weights, known = tfidf(texts, plain, most=most)
        place = {t: i for i, t in enumerate(known)}
        x = np.zeros((len(texts), most))
        for row, k in enumerate(texts):
            for t, w in weights[k].items():
                x[row, place[t]] = w
        parts.append(x)
    return np.hstack(parts)


@pytest.fixture(scope="module")
def train(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    odd = spark.createDataFrame([(-1, None, 1, 0), (-2, "", 0, 1), (-3, "Das Handy  😀 \xa0neu", 1, 1), (-4, "ab " * 70_000, 0, 0)], "doc_id long, text string, quality int, toxic int")
    return docs.join(labels, "doc_id").select("doc_id", "text", "quality", "toxic").unionByName(odd).orderBy("doc_id").coalesce(1).localCheckpoint()


@pytest.fixture(scope="module")
def table(train):
    return M.TextTable(train, ["quality", "toxic"], most=700)


def objective(x, y, beta, c):
    """The value per weight, and its slope."""
    w = np.where(y == 1, len(y) / (2 * (y == 1).sum()), len(y) / (2 * (y == 0).sum()))
    z = x @ beta[:-1] + beta[-1]
    m = w * (1 / (1 + np.exp(-z)) - y)
    value = (w * (np.logaddexp(0, z) - y * z)).sum() / w.sum() + beta[:-1] @ beta[:-1] / (2 * c * w.sum())
    return value, np.append(m @ x + beta[:-1] / c, m.sum()) / w.sum()


def test_loss_and_slope_of_packed_rows(train, table):
    rows = train.collect()
    x, y = dense({r.doc_id: r.text for r in rows}, 700), np.array([r.quality for r in rows])
    scaled = np.random.default_rng(1).standard_normal(1401)
    slices = packed.kept_slices(table.rows, "quality")
    loss, slope = packed.loss_and_slope(slices, (1.0, 3.0), scaled * np.append(table.words.idf, 1.0))
    z, w = x @ scaled[:-1] + scaled[-1], np.where(y == 1, 3.0, 1.0)
    assert loss == pytest.approx((w * (np.logaddexp(0, z) - y * z)).sum())
    m = w * (1 / (1 + np.exp(-z)) - y)
    assert slope * np.append(table.words.idf, 1.0) == pytest.approx(np.append(m @ x, m.sum()), abs=1e-9)


@pytest.mark.parametrize("label", ["quality", "toxic"])
def test_models_share_a_table_and_reach_the_minimum(train, table, label):
    """The slope is where scikit-learn stops; 100 steps over standardized features ended far above."""
    rows = train.collect()
    x, y = dense({r.doc_id: r.text for r in rows}, 700), np.array([r[label] for r in rows])
    model = M.TextModel(table, label=label)
    value, slope = objective(x, y, model.weights, 4.0)
    assert np.abs(slope).max() <= 1e-4 and model.steps < 100
    finer, steps = packed.logistic(table.rows, label, table.words, 4.0, 1000, 1e-8)
    assert np.abs(objective(x, y, finer, 4.0)[1]).max() <= 1e-7 and value - objective(x, y, finer, 4.0)[0] < 1e-3 and steps > model.steps
    got = {r.doc_id: r.score for r in model.score(train, "doc_id").collect()}
    p = 1 / (1 + np.exp(-(x @ model.weights[:-1] + model.weights[-1])))
    for r, want in zip(rows, p, strict=True):
        assert got[r.doc_id] == (pytest.approx(want) if (r.text or "").strip(" ") else None)


def test_counts_as_those_by_key(spark):
    odd = spark.createDataFrame([(1, "Das\x1cHandy \x85 neu\u2003neu"), (2, None), (3, "İx ΑΣ ß\u180e_1 ①"), (4, "ab cd ab")], "row_id long, text string")
    want = text_features.term_counts(odd, "row_id", ("char", "word"))
    assert sorted(packed.term_counts(odd).collect()) == sorted(want.collect())


def test_labels_of_a_table(spark):
    with pytest.raises(ValueError, match="0 or 1"):
        M.TextTable(spark.createDataFrame([("a", 2)], "text string, label int"), ["label"])
    few = spark.createDataFrame([("ein Text", 1), ("ein Wort", 0), ("kein Text", None), ("ein Wort", 0)], "text string, label int")
    assert M.TextTable(few, ["label"], most=50).rows.agg(F.sum("n")).first()[0] == 3


def test_minimum_of_a_bent_valley():
    rng = np.random.default_rng(2)
    a = np.diag(10.0 ** np.linspace(-2, 2, 12))
    goal = rng.standard_normal(12)
    found, steps = packed.minimum(lambda x: (float((x - goal) @ a @ (x - goal)) / 2, a @ (x - goal)), np.zeros(12), 1e-9, 500)
    assert np.abs(found - goal).max() < 1e-6 and steps < 400


def test_fingerprints_as_those_of_data_sets(spark):
    from adsentry.queries.model_queries import _fingerprints

    odd = spark.createDataFrame([(None,), ("",), (" \t!",), ("ÄÖ_ü ①ⅷ\xa0x ΑΣ İ ß😀",)], "text string")
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("text").unionByName(odd)
    own = F.arrow_udf(_fingerprints, "string")(F.col("text"))
    assert docs.where(~own.eqNullSafe(dataset.fingerprint(F.col("text")))).count() == 0


def test_labels_share_their_passes(train, table, monkeypatch):
    """Models fitted side by side are those fitted alone; all labels that are not done are asked for in one pass."""
    passes, own = [], packed.losses_and_slopes
    monkeypatch.setattr(packed, "losses_and_slopes", lambda slices, asked: passes.append([i for i, _, _ in asked]) or own(slices, asked))
    model = M.TextModels(table, ["quality", "toxic"])
    assert passes[0] == [0, 1] and len(passes) == max(sum(i in p for p in passes) for i in (0, 1))
    scores = {r.doc_id: r for r in model.score(train, "doc_id").collect()}
    for label in ("quality", "toxic"):
        alone = M.TextModel(table, label=label)
        assert model.fitted[label][0] == pytest.approx(alone.weights, abs=1e-6) and model.fitted[label][1] == alone.steps
        assert {k: r[label] for k, r in scores.items()} == pytest.approx({r.doc_id: r.score for r in alone.score(train, "doc_id").collect()}, abs=1e-6)


@pytest.mark.parametrize("chunk", [7, 1 << 16])
def test_entries_of_odd_texts(spark, monkeypatch, chunk):
    """Characters and words that the vocabulary does not have, more characters than a code holds, and chunks inside a text, against plain loops."""
    monkeypatch.setattr(packed, "CHUNK", chunk)
    many = " ".join(chr(0x4E00 + i) + chr(0x4E01 + i) + "x" for i in range(0, 9000, 2))
    texts = ["", "ab cd ab\x1ccd 😀😀😀", "abcde\xa0éabc ab", " a ", "ab " * 300, "x\0y\0", many, "zz cd ab cd"]
    for fitted in (texts[:4], texts[:-1]):
        plain = {"char": [Counter(character_terms(t)) for t in texts], "word": [Counter(word_terms(t)) for t in texts]}
        # \x1c is white space for Python only
        plain["char"][1] = Counter(w[i : i + n] for w in (" ab ", " cd ", " ab\x1ccd ", " 😀😀😀 ") for n in (3, 4, 5) for i in range(len(w) - n + 1))
        places, start = {}, 0
        for kind in packed.KINDS:
            terms = sorted(set().union(*plain[kind][: len(fitted)]))[::2]
            places[kind] = {t: start + i for i, t in enumerate(terms)}
            start += len(terms)
        known = packed.Known(places, np.ones(start))
        assert (known.names is not None) == (len(fitted) > 4)
        for kind in packed.KINDS:
            row, place, tf = getattr(known, kind)(texts)
            want = {(i, places[kind][t]): n for i, c in enumerate(plain[kind]) for t, n in c.items() if t in places[kind]}
            assert len(row) == len(want) and dict(zip(zip(row.tolist(), place.tolist(), strict=True), tf.tolist(), strict=True)) == want
            n, df = sum(plain[kind], Counter()), Counter(t for c in plain[kind] for t in c)
            found = Counter(), Counter()
            for terms, d, m in packed.COUNTS[kind](texts):
                for t, x, y in zip(terms.to_pylist(), d.tolist(), m.tolist(), strict=True):
                    found[0][t] += x
                    found[1][t] += y
            assert found == (df, n)


@pytest.mark.parametrize("texts", [["abcd", "abce"], ["abcd efgh", "efgh ijkl"], ["abcd", "xyz"], ["", None]])
def test_rare_terms_are_kept_where_there_are_no_others(spark, texts):
    counts = packed.term_counts(spark.createDataFrame(list(enumerate(texts)), "row_id long, text string"))
    found = [sorted(text_features.vocabulary_of(counts, len(texts), **x).collect()) for x in ({}, {"kinds": packed.KINDS})]
    assert found[0] == found[1] and {r.kind for r in found[0]} == (set(packed.KINDS) if texts[0] else set())


def test_terms_of_one_text_are_not_written(spark, monkeypatch):
    written, own = [], text_features.stored
    monkeypatch.setattr(text_features, "stored", lambda df: written.append(own(df)) or written[-1])
    M.TextTable(spark.createDataFrame([("ein Text", 1), ("ein Wort", 0), ("kein Text", 0)], "text string, label int"), ["label"], most=50)
    assert written[0].where("df < 2").isEmpty() and not written[0].isEmpty()
