"""Vocabulary, TF-IDF vectors, singular values and the models on them, against plain versions."""

import math
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from adsentry.operators import models as M
from adsentry.operators import text_features as T

SF = "/root/testdata/sf0.001"


def word_terms(text):
    w = re.findall(r"[^\W]{2,}", (text or "").lower())
    return w + [" ".join(p) for p in zip(w, w[1:])]


def character_terms(text):
    out = []
    for w in (text or "").lower().split():
        w = f" {w} "
        out += [w[i : i + n] for n in (3, 4, 5) for i in range(len(w) - n + 1)]
    return out


def tfidf(texts, terms_of, least=2, most=10**9):
    """{text: {term: weight}}, weights of length 1."""
    tf = {k: Counter(terms_of(t)) for k, t in texts.items()}
    df, n = Counter(), Counter()
    for c in tf.values():
        df.update(c.keys())
        n.update(c)
    least = min(least, max(df.values(), default=1))
    known = sorted((t for t in df if df[t] >= least), key=lambda t: (-n[t], t.encode()))[:most]
    idf = {t: math.log((1 + len(texts)) / (1 + df[t])) + 1 for t in known}
    out = {}
    for k, c in tf.items():
        raw = {t: (1 + math.log(f)) * idf[t] for t, f in c.items() if t in idf}
        norm = math.sqrt(sum(w * w for w in raw.values()))
        out[k] = {t: w / norm for t, w in raw.items()}
    return out, known


@pytest.fixture(scope="module")
def texts():
    return {0: "Das Handy ist neu, das Handy!", 1: None, 2: "", 3: "a b c", 4: "Geld zuerst, Geld zuerst überweisen", 5: "Das Handy zuerst", 6: "überweisen Sie das_Geld", 7: "Das Handy zuerst", 8: "x1 x1 x1"}


@pytest.mark.parametrize(("kind", "plain"), [("word", word_terms), ("char", character_terms)])
@pytest.mark.parametrize("most", [4, 20_000])
def test_weights(spark, texts, kind, plain, most):
    docs = spark.createDataFrame(list(texts.items()), "k long, text string")
    terms = T.term_table(docs, "k", (kind,))
    assert {(r.k, r.term): r.tf for r in terms.collect()} == {(k, t): n for k, x in texts.items() for t, n in Counter(plain(x)).items()}
    words = T.vocabulary(terms, len(texts), most=most)
    names = {r.place: r.term for r in words.collect()}
    want, known = tfidf(texts, plain, most=most)
    assert [names[i] for i in range(len(names))] == known
    got = defaultdict(dict)
    for r in T.weights(terms, words, "k").collect():
        got[r.k][names[r.place]] = r.w
    for k in texts:
        assert got[k] == pytest.approx(want[k], abs=1e-12)


def test_vectors_of_two_kinds(spark, texts):
    docs = spark.createDataFrame([(k, t, k * 2) for k, t in texts.items()], "k long, text string, more long")
    terms = T.term_table(docs, "k", ("char", "word"))
    words = T.vocabulary(terms, len(texts), most=500)
    rows = {r.k: r for r in T.vectors(docs, words, "k", ("char", "word"), 1000).collect()}
    names = {r.place: (r.kind, r.term) for r in words.collect()}
    plain = {"char": tfidf(texts, character_terms, most=500)[0], "word": tfidf(texts, word_terms, most=500)[0]}
    for k in texts:
        got = {names[int(i)]: w for i, w in zip(rows[k].features.indices, rows[k].features.values, strict=True)}
        assert got == pytest.approx({(kind, t): w for kind in plain for t, w in plain[kind][k].items()}, abs=1e-12)
        assert rows[k].features.size == 1000 and rows[k].more == 2 * k


def test_singular_values(spark):
    """Values as numpy gives them to 1e-6, vectors with a positive largest entry, and the same products."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    values, got = T.text_components(docs, "doc_id", k=12, most=900)
    weights, known = tfidf({r.doc_id: r.text for r in docs.collect()}, word_terms, most=900)
    place = {t: i for i, t in enumerate(known)}
    x = np.zeros((len(weights), len(known)))
    for row, k in enumerate(sorted(weights)):
        for t, w in weights[k].items():
            x[row, place[t]] = w
    _, s, vt = np.linalg.svd(x, full_matrices=False)
    assert np.abs(values - s[:12]).max() < 1e-6
    vt = vt[:12] * np.sign(vt[np.arange(12), np.abs(vt[:12]).argmax(1)])[:, None]
    found = np.array([r.components for r in got.orderBy("doc_id").collect()])
    apart = np.abs(np.diff(s[:13])) > 1e-4  # vectors of nearly equal values may turn into each other
    assert np.abs(found - x @ vt.T)[:, apart].max() < 1e-5


def test_components_of_few_texts(spark):
    one = spark.createDataFrame([(1, "ein Text")], "doc_id long, text string")
    values, rows = T.text_components(one, "doc_id")
    assert len(values) == 0 and rows.first().components == []
    two = spark.createDataFrame([(1, "ein Text"), (2, "zwei Worte Text"), (3, None)], "doc_id long, text string")
    values, rows = T.text_components(two, "doc_id")
    assert rows.count() == 3 and all(len(r.components) == len(values) for r in rows.collect())
    assert T.text_components(two.limit(0), "doc_id")[1].count() == 0


def labelled(spark, n=400):
    rng = np.random.default_rng(3)
    x = rng.standard_normal((n, 4))
    y = ((x[:, 0] * x[:, 1] > 0) ^ (rng.random(n) < 0.05)).astype(int)
    return spark.createDataFrame([(i, int(y[i]), *map(float, x[i])) for i in range(n)], "doc_id long, label int, a double, b double, c double, d double")


def test_folds_are_dealt_in_turn(spark):
    rows = spark.createDataFrame([(i, int(i % 10 == 0)) for i in range(1000)] + [(-1, 2), (-2, 2)], "doc_id long, label int")
    for n in (2, 3, 5):
        got = M.stratified_folds(rows, "doc_id", n).groupBy("label", "fold").count().collect()
        for label, size in ((0, 900), (1, 100), (2, 2)):
            sizes = [r["count"] for r in got if r.label == label]
            assert sum(sizes) == size and max(sizes) - min(sizes) <= 1
    assert M.fold_count(rows) == 2 and M.fold_count(rows.where("label < 2")) == 5


def test_cascade(spark):
    rows = labelled(spark)
    train, test = rows.where("doc_id < 300"), rows.where("doc_id >= 300")
    model = M.CascadeForest(train, ["a", "b", "c", "d"], "doc_id", trees=8)
    assert 1 <= len(model.layers) <= 5
    assert all(b > a + 1e-3 for a, b in zip(model.aucs, model.aucs[1:]))
    scores = {r.doc_id: r.score for r in model.score(test, "doc_id").collect()}
    label = {r.doc_id: r.label for r in test.collect()}
    good = [a > b for i, a in scores.items() for j, b in scores.items() if label[i] > label[j]]
    assert sum(good) / len(good) > 0.85
    assert len(M.CascadeForest(train, ["a", "b"], "doc_id", trees=4, gain=1.0).layers) == 1
    with pytest.raises(ValueError, match="both classes"):
        M.CascadeForest(train.where("label = 1"), ["a"], "doc_id")


def test_own_label_is_not_in_the_features(spark):
    """With one row's label turned, its probabilities of the first layer stay as they are."""
    rows = M.stratified_folds(labelled(spark, 150), "doc_id", 3)
    turned = rows.withColumn("label", F.when(F.col("doc_id") == 7, 1 - F.col("label")).otherwise(F.col("label")))
    found = []
    for table in (rows, turned):
        model = M.CascadeForest(table.coalesce(1).sortWithinPartitions("doc_id"), ["a", "b", "c", "d"], "doc_id", trees=4, most=1)
        found.append({r.doc_id: (r.p0_0, r.p0_1, r.p0_2, r.p0_3) for r in model.training.collect()})
    assert found[0][7] == pytest.approx(found[1][7])
    assert found[0] != found[1]


def test_terms_are_not_shuffled(spark, texts):
    """Texts are dealt by key; terms meet only as sums of a task."""
    docs = spark.createDataFrame(list(texts.items()), "k long, text string")
    plan = T.term_table(docs, "k", ("char", "word"))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "hashpartitioning(k" in plan


def test_term_counts_of_odd_texts(spark):
    """Repeated and null keys, characters outside the first plane, zeros, and more characters than a code holds, against plain loops."""
    many = " ".join(chr(0x4E00 + i) + chr(0x4E01 + i) + "x" for i in range(0, 9000, 2))
    rows = [(1, "ab cd"), (1, "cd ab"), (None, "ab"), (None, "x\0 \0\0\0"), (2, None), (3, "😀😀😀 ab😀"), (4, many), (5, "ab cd" * 50)]
    docs = spark.createDataFrame(rows, "k long, text string")
    for kind, plain in (("word", word_terms), ("char", character_terms)):
        n, by_key = Counter(), defaultdict(set)
        for k, t in rows:
            n.update(plain(t))
            by_key[k].update(plain(t))
        df = Counter(t for s in by_key.values() for t in s)
        assert {r.term: (r.df, r.n) for r in T.term_counts(docs, "k", (kind,)).collect()} == {t: (df[t], n[t]) for t in n}
        assert {(r.k, r.term) for r in T.term_table(docs, "k", (kind,)).collect()} == {(k, t) for k, s in by_key.items() for t in s}


def test_products_are_made_in_chunks(spark, monkeypatch):
    rng = np.random.default_rng(5)
    x = np.where(rng.random((40, 9)) < 0.3, rng.standard_normal((40, 9)), 0.0)
    rows = spark.createDataFrame([(i, [int(j) for j in np.flatnonzero(r)], [float(v) for v in r[r != 0]]) for i, r in enumerate(x)], "k long, place array<int>, w array<double>")
    dense = rng.standard_normal((9, 3))
    assert T.gram_product(rows, dense) == pytest.approx(x.T @ x @ dense)
    monkeypatch.setattr(T, "CHUNK", 7)
    got = [a for b in rows.repartition(1).sortWithinPartitions("k").toArrow().to_batches() for a in T._rows(b)]
    assert [a[0] for a in got][0] == 0 and sum(a[1] for a in got) == 40 and len(got) > 10
    assert np.array([r.components for r in T.projected(rows, dense).orderBy("k").collect()]) == pytest.approx(x @ dense)
