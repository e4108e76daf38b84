"""Feature tables and models: MLlib does the fitting."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import evaluation, packed, text_features
from .storage import stored


def useful_columns(train: DataFrame, columns: list[str]) -> list[str]:
    """Columns with more than one value, found in one pass."""
    row = train.agg(*[(F.min(c) < F.max(c)).alias(c) for c in columns]).first()
    return [c for c in columns if row[c]]


def aligned(df: DataFrame, columns: list[str], key: str) -> DataFrame:
    """The fitted columns, 0 where a column or value is missing."""
    return df.select(key, *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) if c in df.columns else F.lit(0.0).alias(c) for c in columns])


class TextTable:
    """Labelled texts as packed sparse rows: TF-IDF of words, pairs of words and characters inside words, over a vocabulary that is fitted
    on these texts: the `most` frequent terms of each kind that two texts have. Models of several labels can share one."""

    def __init__(self, train: DataFrame, labels: list[str], most: int = 1 << 17):
        """train: text, labels (0 or 1); rows without one of the labels are left out."""
        rows = stored(train.select("text", *labels).dropna(subset=labels).withColumn("row_id", F.monotonically_increasing_id()))
        odd = rows.filter(" OR ".join(f"`{c}` NOT IN (0, 1)" for c in labels))
        if not odd.isEmpty():
            raise ValueError("labels are 0 or 1")
        words = text_features.vocabulary_of(packed.term_counts(rows), rows.count(), most=most, kinds=packed.KINDS)
        self.words = packed.Vocabulary(words, 2 * most)
        self.rows = packed.packed(rows, self.words, labels)


class TextModel:
    """Logistic regression (C, balanced classes) on a table of texts, fitted until it no longer moves, or for `iterations` steps."""

    def __init__(self, train: DataFrame | TextTable, c: float = 4.0, most: int = 1 << 17, iterations: int = 100, label: str = "label"):
        self.table = train if isinstance(train, TextTable) else TextTable(train, [label], most)
        self.weights, self.steps = packed.logistic(self.table.rows, label, self.table.words, c, iterations)

    def score(self, df: DataFrame, key: str) -> DataFrame:
        """key, score; null for blank texts."""
        return packed.scores(df, key, self.table.words, {"score": self.weights})


class TextModels:
    """A `TextModel` for each of several labels, fitted side by side on one table of texts; scores are found side by side, too."""

    def __init__(self, table: TextTable, labels: list[str], c: float = 4.0, iterations: int = 100):
        self.table = table
        self.fitted = dict(zip(labels, packed.logistics(table.rows, labels, table.words, c, iterations), strict=True))

    def score(self, df: DataFrame, key: str) -> DataFrame:
        """key, and a score for each label; null for blank texts."""
        return packed.scores(df, key, self.table.words, {label: x for label, (x, _) in self.fitted.items()})


def folds(key: Column, n: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(n)).cast("int")


def stratified_folds(rows: DataFrame, key: str, n: int) -> DataFrame:
    """`rows` (key, label, ...) with `fold`: the rows of each label are dealt to the folds in turn, in the order of a hash. They are
    ranked in 256 parts of each label, and where a part begins is known from the counts of the parts before it."""
    parts = rows.withColumn("part", F.pmod(F.xxhash64(key), F.lit(256)))
    counts = parts.groupBy("label", "part").agg(F.count("*").alias("size"))
    before = F.sum("size").over(Window.partitionBy("label").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    counts = counts.select("label", "part", F.coalesce(before, F.lit(0)).alias("before"))
    rank = F.row_number().over(Window.partitionBy("label", "part").orderBy(F.xxhash64(key), key)) - 1
    dealt = parts.withColumn("rank", rank).join(F.broadcast(counts), ["label", "part"])  # 256 rows for each label
    return dealt.withColumn("fold", F.pmod(F.col("before") + F.col("rank"), F.lit(n)).cast("int")).drop("part", "rank", "before")


def fold_count(table: DataFrame, most: int = 5) -> int:
    """max(2, min(most, rows of the smallest class))."""
    least = table.groupBy("label").count().agg(F.min("count")).first()[0] or 0
    return max(2, min(most, least))


AT_ONCE = 4  # fits that run side by side: one alone leaves most cores waiting between its many short jobs


def out_of_fold(model, rows: DataFrame, n: int) -> DataFrame:
    """`rows` (features, label, fold, ...) with `score`, the probability by a model that was fitted on the other folds."""
    return _all_out_of_fold([model], rows, n)[0]


def _all_out_of_fold(models: list, rows: DataFrame, n: int) -> list[DataFrame]:
    """The same for several models."""

    def scored(model, f: int) -> DataFrame:
        return model.fit(rows.filter(F.col("fold") != f)).transform(rows.filter(F.col("fold") == f)).select(*rows.columns, vector_to_array("probability")[1].alias("score"))

    with ThreadPool(AT_ONCE) as pool:
        parts = pool.starmap(inheritable_thread_target(rows.sparkSession)(scored), [(m.copy(), f) for m in models for f in range(n)], chunksize=1)
    return [reduce(DataFrame.unionByName, parts[i : i + n]) for i in range(0, len(parts), n)]


def leaderboard(table: DataFrame, columns: list[str], key: str) -> DataFrame:
    """model, n, auc of a few models by stratified cross-validation, the best first. table: key, label, columns."""
    n = fold_count(table)
    rows = VectorAssembler(inputCols=columns, outputCol="features").transform(table).select(key, "label", "features")
    rows = stored(stratified_folds(rows, key, n))
    models = {
        **{f"logistic {reg:g}": LogisticRegression(regParam=reg) for reg in (0.001, 0.1)},
        **{f"forest {depth}": RandomForestClassifier(numTrees=20, maxDepth=depth, seed=1) for depth in (4, 8)},
        "boosted": GBTClassifier(maxIter=5, seed=1),
    }
    parts = [part.select(F.lit(name).alias("model"), "label", "score") for name, part in zip(models, _all_out_of_fold(list(models.values()), rows, n), strict=True)]
    scored = stored(reduce(DataFrame.unionByName, parts))  # the metrics read them twice
    return evaluation.metrics(scored, ["model"]).select("model", "n", "auc").orderBy(F.desc("auc"), "model")


class CascadeForest:
    """ML-09: layers of forests. The probabilities that a layer's forests give are further features of the next layer. For training they
    come from cross-validation, so that no row's own label is in its features; for new rows, from forests fitted on all rows. A
    layer is added while the AUC out of fold rises by more than `gain`.

    MLlib has no extra-trees: two forests try the usual number of features at a split, two a single one."""

    def __init__(self, train: DataFrame, columns: list[str], key: str, trees: int = 20, most: int = 5, gain: float = 1e-3, folds: int = 3):
        """train: key, label (0 or 1), columns, and optionally `fold` from 0."""
        if train.select("label").distinct().count() != 2:
            raise ValueError("a cascade needs rows of both classes")
        self.columns, self.layers, self.aucs = columns, [], []
        if "fold" not in train.columns:
            folds = max(2, min(folds, fold_count(train)))
            train = stratified_folds(train, key, folds)
        rows = stored(train.select(key, "label", "fold", *columns))
        for depth in range(most):
            layer = self._layer(depth, trees)
            out = self._assembled(rows, depth).select(key, "label", "fold", "features")
            for j, forest in enumerate(layer):
                scored = out_of_fold(forest, out, folds).select(key, F.col("score").alias(f"p{depth}_{j}"))
                rows = rows.join(scored, key)
            rows = stored(rows)
            mean = sum(F.col(f"p{depth}_{j}") for j in range(len(layer))) / len(layer)
            auc = evaluation.metrics(rows.select(F.lit(depth).alias("layer"), "label", mean.alias("score")), ["layer"]).first().auc
            if self.layers and auc <= self.aucs[-1] + gain:
                break
            self.layers.append([forest.fit(out) for forest in layer])
            self.aucs.append(auc)
        self.training = rows

    @staticmethod
    def _layer(depth: int, trees: int) -> list[RandomForestClassifier]:
        return [RandomForestClassifier(numTrees=trees, maxDepth=8, seed=42 + 4 * depth + j, featureSubsetStrategy="auto" if j < 2 else "1") for j in range(4)]

    def _features(self, depth: int) -> list[str]:
        return [*self.columns, *[f"p{depth - 1}_{j}" for j in range(4 if depth else 0)]]

    def _assembled(self, rows: DataFrame, depth: int) -> DataFrame:
        return VectorAssembler(inputCols=self._features(depth), outputCol="features").transform(rows)

    def score(self, df: DataFrame, key: str) -> DataFrame:
        """key, score: the mean probability of the last layer."""
        rows = df.select(key, *self.columns)
        for depth, layer in enumerate(self.layers):
            for j, model in enumerate(layer):
                found = model.transform(self._assembled(rows, depth))
                rows = found.select(*rows.columns, vector_to_array("probability")[1].alias(f"p{depth}_{j}"))
        last = len(self.layers) - 1
        return rows.select(key, (sum(F.col(f"p{last}_{j}") for j in range(4)) / 4).alias("score"))


def zero_shot(vectors: DataFrame, classes: DataFrame, scale: float = 100.0) -> DataFrame:
    """vec_id, class, p: softmax of scaled cosines over all prompts, summed per class. classes: prompt, class, embedding;
    a class list is short and goes to every task."""
    unit = lambda c: F.transform(c, lambda x: x / F.sqrt(F.aggregate(c, F.lit(0.0), lambda a, y: a + y * y)))
    a = vectors.select("vec_id", unit(F.col("embedding").cast("array<double>")).alias("v"))
    b = classes.select("prompt", "class", unit(F.col("embedding").cast("array<double>")).alias("w"))
    if b.limit(10_001).count() > 10_000:
        raise ValueError("more than 10,000 prompts")
    cosine = F.aggregate(F.zip_with("v", "w", lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    each = a.crossJoin(F.broadcast(b)).select("vec_id", "class", F.exp(scale * (cosine - 1)).alias("e"))
    sums = each.groupBy("vec_id", "class").agg(F.sum("e").alias("e"))
    total = sums.groupBy("vec_id").agg(F.sum("e").alias("t"))
    return sums.join(total, "vec_id").select("vec_id", "class", (F.col("e") / F.col("t")).alias("p"))


def retrain(models: dict[str, tuple[DataFrame, Callable[[DataFrame], Callable[[DataFrame], DataFrame]]] | str], spark: SparkSession, least: int = 5) -> DataFrame:
    """ML-11: fits and measures each model: (model, status, n_train, auc, message).

    A model is its table (label, test, ...) with a function that fits on the training part and gives a function from a
    table to (label, score); or the reason why it is left out. A model with fewer than `least` rows of a class, or one that
    fails, is reported and stops no other."""
    out = []
    for name, given in models.items():
        if isinstance(given, str):
            out.append((name, "left out", None, None, given))
            continue
        rows, fit = given
        n, good, bad = rows.filter("NOT test").agg(F.count("*"), F.count_if(F.col("label") == 1), F.count_if(F.col("label") == 0)).first()
        if min(good, bad) < least:
            out.append((name, "too few rows", n, None, f"{min(good, bad)} of {least}"))
            continue
        try:
            scored = fit(rows.filter("NOT test"))(rows.filter("test")).withColumn("model", F.lit(name))
            found = evaluation.metrics(scored, ["model"]).first()
            out.append((name, "trained", n, found.auc if found else None, None))
        except Exception as e:  # noqa: BLE001  one broken model must not stop the others
            out.append((name, "failed", n, None, type(e).__name__))
    return spark.createDataFrame(out, "model string, status string, n_train long, auc double, message string")
