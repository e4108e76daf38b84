"""Quality classifier by weak labels.

Heuristic labellers vote good, bad or nothing on each document. Their votes over all documents, counted by pattern,
give their accuracies by expectation-maximisation, and each pattern its posterior probability of being good. The
posteriors of a sample then train a linear scorer over hashed words and word shapes, which scores every document; a
document is kept from a score of 0.5 on. The sample has about ``SAMPLE`` documents and ``SAMPLE_BYTES`` bytes of text at
most, drawn by a hash of the row; it is dealt to ``SHARDS`` tasks, whose weights are averaged.

Nulls: a null text counts as empty; a text without words scores 0 and is not kept. Null and repeated ids are passed on,
and rows that occur twice are scored twice. An empty table gives an empty one, and a model that scores every text 0.5.
Texts are read in blocks of ``BLOCK`` bytes; a longer text is a block of its own and needs some 60 bytes of memory for
each of its bytes. `kept` leaves other columns as they are, whatever their names; `judged` ignores them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _repeats as R
from ._common import rows_kept, table, whole_text

SAMPLE = 20_000
SAMPLE_BYTES = 64 << 20
BLOCK = 256 << 10
SHARDS = 8
WIDTH = 1 << 15
STEPS = 80
RATE = 0.3
GOOD, BAD, NONE = 1, 0, 2
# Frequent function words of some languages.
FUNCTION_WORDS = "the of and to in is that it was for on are as with be by this from der die und das von zu den mit ist ein eine nicht auf für im des le la les et de un une est que pour dans qui sur au el los las en es por con una su para del se".split()
LABELLERS = ("symbols", "capitals", "exclamations", "repeated neighbours", "bare signs", "signs after words", "variety", "function words")

_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = _LETTER[128:] = True
_ALNUM = _LETTER.copy()
_ALNUM[48:58] = True
_USUAL = _ALNUM.copy()
_USUAL[list(b" \t\n\r\x0b\x0c.,;:!?'\"()-")] = True
_SHAPE = np.arange(256, dtype=np.uint64)
_SHAPE[97:123] = _SHAPE[128:] = 1
_SHAPE[65:91], _SHAPE[48:58] = 2, 3
_FUNCTION = np.unique(R.word_tokens([" ".join(FUNCTION_WORDS).encode()])[0])


class Block:
    """What the labellers and the scorer need of some texts."""

    def __init__(self, texts: list[bytes]):
        self.tokens, self.starts, self.ends, (self.data, self.begin, self.end) = R.word_tokens(texts)
        self.n = self.ends - self.starts
        self.doc = np.repeat(np.arange(len(texts)), self.n)
        self.lower = R.word_tokens([t.lower() for t in texts])[0]
        size = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
        self.stops = np.cumsum(size)
        self.size = size
        same = np.zeros(len(self.tokens), bool)
        same[1:] = (self.tokens[1:] == self.tokens[:-1]) & (self.doc[1:] == self.doc[:-1])
        self.same = same
        letters = np.r_[0, np.cumsum(_ALNUM[self.data])]
        self.bare = letters[self.end] == letters[self.begin]
        last, before = self.data[self.end - 1], self.data[np.maximum(self.end - 2, self.begin)]
        self.signs = ~_ALNUM[last] & ~_ALNUM[before] & ~self.bare

    def bytes_of(self, which: np.ndarray) -> np.ndarray:
        """How many bytes of each text are in the table `which`."""
        total = np.r_[0, np.cumsum(which[self.data])]
        return total[self.stops] - total[self.stops - self.size]

    def words_of(self, which: np.ndarray) -> np.ndarray:
        return np.bincount(self.doc[which], minlength=len(self.n))

    def votes(self) -> np.ndarray:
        """(labeller, document): GOOD, BAD or NONE."""
        n = np.maximum(self.n, 1)
        upper, lower = (np.zeros(256, bool) for _ in range(2))
        upper[65:91], lower[97:123] = True, True
        bang = np.zeros(256, bool)
        bang[33] = True
        capitals, small = self.bytes_of(upper), self.bytes_of(lower)
        key = np.sort(self.doc.astype(np.uint64) << np.uint64(44) | self.tokens >> np.uint64(20))
        kinds = np.bincount((key[np.r_[True, key[1:] != key[:-1]][: len(key)]] >> np.uint64(44)).astype(np.int64), minlength=len(self.n))
        rules = [
            (self.bytes_of(~_USUAL) / np.maximum(self.size - 1, 1), 0.01, 0.04, 1),
            (capitals / np.maximum(capitals + small, 1), 0.2, 0.5, 5),
            (self.bytes_of(bang) / n, 0.1, 0.3, 1),
            (self.words_of(self.same) / n, 0.05, 0.2, 10),
            (self.words_of(self.bare) / n, 0.03, 0.1, 5),
            (self.words_of(self.signs) / n, 0.05, 0.2, 1),
            (1 - kinds / n, 0.7, 0.85, 50),
            (1 - self.words_of(np.isin(self.lower, _FUNCTION)) / n, 0.95, 0.985, 20),
        ]
        out = np.full((len(rules), len(self.n)), NONE, np.int64)
        for row, (value, good, bad, least) in zip(out, rules, strict=True):
            row[value <= good], row[value >= bad] = GOOD, BAD
            row[self.n < least] = NONE
        return out

    def features(self) -> tuple[np.ndarray, np.ndarray]:
        """(document, feature) of three hashed features for each word: the word, how it ends, and what kind it is."""
        shape = _SHAPE[self.data]
        tail = sum(shape[np.maximum(self.end - k, self.begin)] << np.uint64(8 * k) for k in (1, 2, 3))
        kind = self.same.astype(np.uint64) + 2 * self.bare.astype(np.uint64) + 4 * self.signs.astype(np.uint64)
        kind = kind * np.uint64(256) + shape[self.begin] * np.uint64(8) + shape[(self.begin + self.end) // 2] % np.uint64(8)
        hashed = [R.mix(x + np.uint64(salt << 56)) % np.uint64(WIDTH) for salt, x in ((1, self.lower >> np.uint64(8)), (2, tail), (3, kind))]
        return np.tile(self.doc, 3), np.concatenate(hashed).astype(np.int64)


def pattern_of(votes: np.ndarray) -> np.ndarray:
    return (votes * 3 ** np.arange(len(votes))[:, None]).sum(axis=0)


def texts_in_blocks(batch: pa.RecordBatch) -> Iterator[tuple[int, int, list[bytes]]]:
    column = batch.column("text").cast(pa.binary())
    for at, stop in R.slices(column, BLOCK):
        yield at, stop, column.slice(at, stop - at).to_pylist()


def estimate(patterns: np.ndarray, counts: np.ndarray, rounds: int = 200) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Expectation-maximisation over vote patterns (labeller, pattern): each pattern's posterior of good, the labellers'
    tables [class, labeller, vote], and the shares of the classes. As each labeller knows one kind of junk only, it starts
    from the number of bad votes rather than from the majority."""
    given = patterns != NONE
    post = 0.95 * 0.3 ** (patterns == BAD).sum(axis=0)
    for _ in range(rounds):
        weight = np.stack([1 - post, post]) * counts
        prior = (weight.sum(axis=1) + 1) / (counts.sum() + 2)
        tables = np.stack([[[w[row == v].sum() + 0.5 for v in (BAD, GOOD, NONE)] for row in patterns] for w in weight])
        tables /= tables.sum(axis=2, keepdims=True)
        # whether a labeller abstains says nothing about the class
        said = tables[:, :, :2] / tables[:, :, :2].sum(axis=2, keepdims=True)
        logs = np.log(prior)[:, None] + np.stack([np.where(given, np.log(np.take_along_axis(said[c], np.minimum(patterns, 1), axis=1)), 0).sum(axis=0) for c in (0, 1)])
        new = 1 / (1 + np.exp(np.clip(logs[0] - logs[1], -50, 50)))
        if np.abs(new - post).max() < 1e-9:
            break
        post = new
    return post, tables, prior


def fit(blocks: list[tuple[np.ndarray, np.ndarray, np.ndarray]], target: np.ndarray) -> np.ndarray:
    """Weights of a logistic scorer over the mean of the words' features, and the constant last; full-batch Adam.

    blocks: (document, feature, value) of the documents, each block's documents numbered on from those before it."""
    doc, feature, value = (np.concatenate(x) for x in zip(*blocks, strict=True))
    del blocks
    n = len(target)
    w, m, v = (np.zeros(WIDTH + 1) for _ in range(3))
    for step in range(1, STEPS + 1):
        z = np.bincount(doc, weights=w[feature] * value, minlength=n) + w[-1]
        error = (1 / (1 + np.exp(-np.clip(z, -50, 50))) - target) / max(n, 1)
        g = np.append(np.bincount(feature, weights=error[doc] * value, minlength=WIDTH), error.sum()) + 1e-6 * w
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        w = w - RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-10)
    return w


def mean_features(block: Block, at: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, feature, share of the document's words) of a block whose first document has the number `at`."""
    doc, feature = block.features()
    key, count = np.unique(doc * WIDTH + feature, return_counts=True)
    doc, feature = key // WIDTH, key % WIDTH
    return (doc + at).astype(np.int32), feature.astype(np.int32), (count / np.maximum(block.n, 1)[doc]).astype(np.float32)


class Model:
    def __init__(self, posterior: np.ndarray, weights: np.ndarray):
        self.posterior, self.weights = posterior, weights

    def score(self, block: Block) -> np.ndarray:
        doc, feature = block.features()
        z = np.bincount(doc, weights=self.weights[feature], minlength=len(block.n)) / np.maximum(block.n, 1) + self.weights[-1]
        return np.where(block.n > 0, 1 / (1 + np.exp(-np.clip(z, -50, 50))), 0.0)


def learn(docs: DataFrame, sample: int = SAMPLE) -> Model:
    """Fits the labellers' accuracies on all documents and the scorer on a sample."""
    rows = docs.select(F.xxhash64("doc_id", "text").alias("h"), whole_text().alias("text"))

    def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found, size = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for _, _, texts in texts_in_blocks(b):
                block = Block(texts)
                found.append(pattern_of(block.votes()))
                size.append(block.size)
            kinds, which = np.unique(np.concatenate(found), return_inverse=True)
            size = np.bincount(which, weights=np.concatenate(size), minlength=len(kinds))
            yield pa.RecordBatch.from_arrays([pa.array(kinds), pa.array(np.bincount(which, minlength=len(kinds))), pa.array(size.astype(np.int64))], ["pattern", "n", "size"])

    size = 3 ** len(LABELLERS)  # as many patterns at most
    counted = rows.select("text").mapInArrow(vote, "pattern long, n long, size long").groupBy("pattern").agg(F.sum("n"), F.sum("size")).orderBy("pattern").collect()
    pattern, count, total = (np.array([r[i] for r in counted], np.int64) for i in range(3))
    votes = pattern[None] // 3 ** np.arange(len(LABELLERS))[:, None] % 3
    posterior = np.full(size, 0.5)
    if len(pattern):
        posterior[pattern] = estimate(votes, count)[0]

    def train(part: pa.Table) -> pa.Table:
        part = part.sort_by("h").select(["text"]).combine_chunks()
        blocks, target, at = [], [], 0
        for batch in part.to_batches():
            for _, _, texts in texts_in_blocks(batch):
                block = Block(texts)
                target.append(posterior[pattern_of(block.votes())])
                blocks.append(mean_features(block, at))
                at += len(texts)
        return pa.table({"weights": pa.array([fit(blocks, np.concatenate(target)).tobytes()], pa.binary())})

    every = max(1, int(count.sum()) // sample, -(-int(total.sum()) // SAMPLE_BYTES))
    drawn = rows.filter(F.pmod("h", F.lit(every)) == 0).withColumn("shard", F.pmod(F.xxhash64("h"), F.lit(SHARDS)))
    weights = [np.frombuffer(r.weights) for r in drawn.groupBy("shard").applyInArrow(train, "weights binary").collect()]
    return Model(posterior, np.mean(weights, axis=0) if weights else np.zeros(WIDTH + 1))


def judged(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """doc_id, text, p_good (of the labellers' votes), score and keep, for every document."""
    sent = docs.sparkSession.sparkContext.broadcast(model or learn(docs))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        for b in batches:
            for at, stop, texts in texts_in_blocks(b):
                block = Block(texts)
                score = model.score(block)
                part = b.slice(at, stop - at)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(model.posterior[pattern_of(block.votes())]), pa.array(score), pa.array(score >= 0.5)], [*part.schema.names, "p_good", "score", "keep"])

    return docs.select(F.col("doc_id").cast("long"), whole_text().alias("text")).mapInArrow(run, "doc_id long, text string, p_good double, score double, keep boolean")


def kept(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """The rows of `docs`, with all their columns, whose text scores 0.5 or more."""
    sent = docs.sparkSession.sparkContext.broadcast(model or learn(docs))

    def good(column: pa.Array) -> np.ndarray:
        text = pa.RecordBatch.from_arrays([pa.compute.fill_null(column, "")], ["text"])
        scores = [sent.value.score(Block(x)) for _, _, x in texts_in_blocks(text)]
        return np.concatenate([np.zeros(0), *scores]) >= 0.5

    return rows_kept(docs, good)


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged(table(spark, sf_dir, "documents")).drop("text")


QUERIES = {"op9_quality": op9_quality}
