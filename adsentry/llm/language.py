"""Language ID by language-bitmask n-gram filters.

The most frequent character n-grams of each language go into one Bloom filter whose slots are bit masks of languages: a
lookup takes the AND of a few slots, and so returns all languages that have the n-gram at once. A text's hits are
counted language by language. What a full filter would return by chance is taken off the share of hits, and the
language with the largest corrected share wins; that share is the score.

Filters are learnt from at most about `SAMPLE` documents of each language, drawn by a hash of the row. Nulls: a null text,
or one without letters, gives `und` with score 0; rows with a null doc_id are predicted but never learnt from. Without
any labelled row, all predictions are `und`. Languages may be many: masks have as many 64-bit words as they need, and
more than `MOST_LANGUAGES` different values of lang are an error. On a tie the more frequent language wins, and then the
first name; so a text with letters but without a known n-gram gets the most frequent language, with score 0. Repeated rows
are predicted alike, an empty table gives an empty one. Texts are read in blocks of `BLOCK_CHARS` characters; a longer
text is a block of its own and needs some 80 bytes of memory for each character. Other columns are ignored.

`GRAMS`, the n-grams of each language, is the size of the model: they are counted over the whole sample and the most
frequent ones kept, the smaller hash on a tie.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._anchors import join_hash, mix
from ._common import table

SAMPLE = 2_000
MOST_LANGUAGES = 4_096
GRAMS = 6_000
SIZES = (2, 3, 4)
SLOTS = 1 << 18
HASHES = 3
BLOCK_CHARS = 250_000


@cache
def letters() -> np.ndarray:
    return np.array([chr(i).isalpha() for i in range(0x110000)])


def grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, n-gram hash) of n-grams of letters, of which the ends may be a word's edge; and the documents' letters."""
    joined = "\0".join(x.lower() for x in texts)
    points = np.frombuffer(f"\0{joined}\0".encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = letters()[points]
    doc = np.cumsum(points == 0) - 1
    count = np.bincount(doc[letter], minlength=len(texts))
    h = mix(np.where(letter, points, 0).astype(np.uint64) + np.uint64(1))
    docs, hashes = [], []
    for n in SIZES:
        size = len(points) - n + 1
        if size < 1:
            continue
        ok = letter[:size] | letter[n - 1 :]
        for k in range(1, n - 1):
            ok &= letter[k : k + size]
        at = np.flatnonzero(ok)
        x = h[at]
        for k in range(1, n):
            x = join_hash(x, h[at + k])
        hashes.append(x)
        docs.append(doc[at + (0 if n == 1 else 1)] if n > 2 else np.where(letter[at], doc[at], doc[at + 1]))
    return np.concatenate(docs), np.concatenate(hashes), count[: len(texts)]


def text_blocks(texts: list[str | None]) -> Iterator[tuple[int, list[str]]]:
    at = 0
    while at < len(texts):
        stop, size = at, 0
        while stop < len(texts) and (size < BLOCK_CHARS or stop == at):
            size += len(texts[stop] or "")
            stop += 1
        yield at, [(t or "").replace("\0", " ") for t in texts[at:stop]]
        at = stop


class Filters:
    """Bit-sliced Bloom filters: `slots[i]` is the mask of the languages that set slot i."""

    def __init__(self, found: dict[str, np.ndarray], order: list[str]):
        self.languages = order
        self.words = max(1, -(-len(order) // 64))
        self.slots = np.zeros((SLOTS, self.words), np.uint64)
        for i, name in enumerate(order):
            for at in self.places(found.get(name, np.zeros(0, np.uint64))):
                self.slots[at, i // 64] |= np.uint64(1 << (i % 64))
        filled = [((self.slots[:, i // 64] >> np.uint64(i % 64)) & np.uint64(1)).mean() for i in range(len(order))]
        self.by_chance = np.array(filled) ** HASHES

    @staticmethod
    def places(hashes: np.ndarray) -> list[np.ndarray]:
        return [((hashes >> np.uint64(20 * k)) & np.uint64(SLOTS - 1)).astype(np.int64) for k in range(HASHES)]

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        doc, hashes, count = grams(texts)
        at = self.places(hashes)
        mask = self.slots[at[0]]
        for places in at[1:]:
            mask = mask & self.slots[places]
        total = np.maximum(np.bincount(doc, minlength=len(texts))[: len(texts)], 1)
        share = np.empty((len(self.languages), len(texts)))
        for i in range(len(self.languages)):
            has = (mask[:, i // 64] >> np.uint64(i % 64)) & np.uint64(1)
            hits = np.bincount(doc, weights=has, minlength=len(texts))[: len(texts)] / total
            share[i] = np.clip((hits - self.by_chance[i]) / max(1 - self.by_chance[i], 1e-9), 0, 1)
        if not self.languages:
            return ["und"] * len(texts), np.zeros(len(texts))
        best = share.argmax(axis=0)
        known = count > 0
        return [self.languages[b] if k else "und" for b, k in zip(best.tolist(), known.tolist(), strict=True)], np.where(known, share.max(axis=0), 0.0)


def held_out() -> F.Column:
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def learn(docs: DataFrame, sample: int = SAMPLE, kept: int = GRAMS) -> Filters:
    """Fits the filters on rows (doc_id, text, lang) that aren't held out."""
    rows = docs.filter(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & F.col("text").isNotNull() & ~held_out())
    counted = rows.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(MOST_LANGUAGES + 1).collect()
    if len(counted) > MOST_LANGUAGES:
        raise ValueError(f"the column lang has more than {MOST_LANGUAGES} different values")
    order = [r.lang for r in counted]
    if not order:
        return Filters({}, [])
    every = docs.sparkSession.createDataFrame([(r.lang, max(1, r.n // sample)) for r in counted], "lang string, every long")
    drawn = rows.join(F.broadcast(every), "lang").filter(F.pmod(F.xxhash64("doc_id", "text"), "every") == 0).select("lang", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lang = np.array(b.column("lang").to_pylist(), object)
            texts = b.column("text").to_pylist()
            for name in sorted(set(lang.tolist())):
                mine = [texts[i] for i in np.flatnonzero(lang == name)]
                for _, block in text_blocks(mine):
                    h, n = np.unique(grams(block)[1], return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array([name] * len(h)), pa.array(h.view(np.int64)), pa.array(n.astype(np.int64))], ["lang", "gram", "n"])

    totals = drawn.mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))
    top = totals.withColumn("rank", rank).filter(F.col("rank") <= kept).groupBy("lang").agg(F.collect_list("gram").alias("grams")).collect()
    return Filters({r.lang: np.array(r.grams, np.int64).view(np.uint64) for r in top}, order)


def identified(docs: DataFrame, filters: Filters | None = None) -> DataFrame:
    """doc_id, text, lang_pred and score of every document; reads only the text to predict."""
    sent = docs.sparkSession.sparkContext.broadcast(filters or learn(docs))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            names, scores = [], []
            for _, block in text_blocks(b.column("text").to_pylist()):
                x, y = sent.value.predict(block)
                names += x
                scores.append(y)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(names, pa.string()), pa.array(np.concatenate([np.zeros(0), *scores]))], [*b.schema.names, "lang_pred", "score"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, text string, lang_pred string, score double")


def op3_language_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identified(table(spark, sf_dir, "documents")).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


QUERIES = {"op3_language_filters": op3_language_filters}
