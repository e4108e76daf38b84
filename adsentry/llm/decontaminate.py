"""Benchmark decontamination: which documents hold a passage that is nearly a benchmark item.

A document is read in windows as long as an item. Each window gets a SimHash over its five-word shingles, weighted by how
often each occurs, from running sums of the shingles' bits. A multi-index gives all items of that length whose
fingerprints are at most `RADIUS` bits apart: of four blocks of 16 bits one differs in at most three bits, of which the
index holds two and a lookup tries the third. For these the exact weighted Jaccard similarity of the shingles decides.
Windows without any shingle of an item of their length have similarity 0 with all of them and are passed over.

Of pairs of similarity 0.8, some 97 in 100 are within 15 bits, and of the nearer ones more; see the README for what was
measured. Items go to the tasks in blocks of at most `ITEM_WORDS` words, each block a pass of its own, so what is
broadcast has a bound whatever the size of the benchmark.

Words are split at ASCII white space and lower-cased in A-Z. An item of fewer than five words is one shingle and matches
only as a whole; an item without words matches nothing; a document shorter than an item is one window. Nulls: a null
text counts as empty; null ids are passed on; repeated rows each give their own rows. Without documents or without items
nothing is found. Texts are read whole, in blocks of a megabyte or one longer text. Other columns are ignored by
`contaminated` and passed on by `clean`, whatever their names. The best window of a document and an item counts, the first
one on a tie.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _repeats as R
from ._anchors import gram_hash, mix
from ._common import rows_kept, table, whole_text

SHINGLE = 5
SIMILARITY = 0.8
RADIUS = 15
BLOCKS, WIDTH = 4, 16
ITEM_WORDS = 500_000
WINDOWS = 20_000  # as many windows are compared at once
MATCHES = "doc_id long, item_id long, similarity double, start_word long, n_words long"


def fingerprint(hashes: np.ndarray) -> np.uint64:
    """SimHash of shingles, each as often as it occurs."""
    bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return np.packbits(2 * bits > len(hashes), bitorder="little").view(np.uint64)[0]


def flips(most: int) -> np.ndarray:
    """All numbers of `WIDTH` bits of which at most `most` are set."""
    every = np.arange(1 << WIDTH, dtype=np.uint32)
    return every[np.bitwise_count(every) <= most]


class BlockIndex:
    """Fingerprints under each block of their bits, and under all values that differ from it in up to two bits."""

    def __init__(self, prints: np.ndarray):
        self.prints = prints
        near, n = flips(RADIUS // BLOCKS - 1), len(prints)
        keys = np.concatenate([(self.block(prints, j)[:, None] ^ near[None]).ravel() + np.uint32(j << WIDTH) for j in range(BLOCKS)])
        order = np.argsort(keys, kind="stable")
        self.items = (order % (n * len(near)) // len(near)).astype(np.int32)
        self.offsets = np.searchsorted(keys[order], np.arange((BLOCKS << WIDTH) + 1))

    @staticmethod
    def block(prints: np.ndarray, j: int) -> np.ndarray:
        return (prints >> np.uint64(WIDTH * j) & np.uint64((1 << WIDTH) - 1)).astype(np.uint32)

    def within(self, prints: np.ndarray, fits: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """(i, item) for all of `prints` and all items within the radius that `fits(i, item)` lets through."""
        found = [np.zeros((2, 0), np.int64)]
        for j in range(BLOCKS):
            value = self.block(prints, j).astype(np.int64) + (j << WIDTH)
            for flip in flips(1).tolist():
                low, high = self.offsets[value ^ flip], self.offsets[(value ^ flip) + 1]
                times = high - low
                i = np.repeat(np.arange(len(prints)), times)
                item = self.items[low[i] + np.arange(len(i)) - np.repeat(np.cumsum(times) - times, times)]
                good = np.bitwise_count(self.prints[item] ^ prints[i]) <= RADIUS
                good[good] = fits(i[good], item[good])
                found.append(np.stack([i[good], item[good]]))
        return tuple(np.unique(np.concatenate(found, axis=1), axis=1))


def weighted_jaccard(a: np.ndarray, b: np.ndarray) -> float:
    """Of two multisets of hashes."""
    (x, n), (y, m) = np.unique(a, return_counts=True), np.unique(b, return_counts=True)
    _, i, j = np.intersect1d(x, y, assume_unique=True, return_indices=True)
    both = np.minimum(n[i], m[j]).sum()
    return float(both / (len(a) + len(b) - both))


class Items:
    """A block of benchmark items, ready for lookup in tasks."""

    def __init__(self, ids: list[int | None], texts: list[str | None]):
        keep = [(i, t.encode().lower()) for i, t in zip(ids, texts, strict=True) if t and t.encode().split()]
        self.ids = [i for i, _ in keep]
        tokens, starts, ends, _ = R.word_tokens([t for _, t in keep]) if keep else (np.zeros(0, np.uint64),) + (np.zeros(0, np.int64),) * 3
        self.size = (ends - starts).astype(np.int64)
        self.gram = np.minimum(self.size, SHINGLE)
        self.shingles = [gram_hash(tokens[a:b], int(g)) for a, b, g in zip(starts, ends, self.gram, strict=True)]
        self.index = BlockIndex(np.array([fingerprint(x) for x in self.shingles], np.uint64))
        self.lookup = {}
        for g in np.unique(self.gram).tolist():
            mine = np.flatnonzero(self.gram == g)
            pairs = np.unique(np.array([(h, self.size[i]) for i in mine for h in self.shingles[i].tolist()], np.uint64).reshape(-1, 2), axis=0)
            table = np.zeros(1 << 22, bool)
            table[pairs[:, 0] & np.uint64((1 << 22) - 1)] = True
            self.lookup[g] = (pairs[:, 0], pairs[:, 1].astype(np.int64), table)

    def hits(self, shingles: np.ndarray, gram: int) -> tuple[np.ndarray, np.ndarray]:
        """Places and lengths of items, for all shingles that occur in items of this shingle size."""
        hashes, sizes, table = self.lookup[gram]
        at = np.flatnonzero(table[shingles & np.uint64(len(table) - 1)])
        low, high = np.searchsorted(hashes, shingles[at]), np.searchsorted(hashes, shingles[at], side="right")
        times = high - low
        of = np.repeat(np.arange(len(at)), times)
        return at[of], sizes[low[of] + np.arange(len(of)) - np.repeat(np.cumsum(times) - times, times)]

    def search(self, texts: list[bytes]) -> list[tuple[int, int, float, int, int]]:
        """(document, item, similarity, first word, words) of the best window of each pair that reaches the similarity."""
        tokens, starts, ends, _ = R.word_tokens([t.lower() for t in texts])
        best: dict[tuple[int, int], tuple[float, int, int]] = {}
        for gram in self.lookup:
            if len(tokens) < gram:
                continue
            shingles = gram_hash(tokens, gram)
            at, size = self.hits(shingles, gram)
            doc = np.searchsorted(starts, at, side="right") - 1
            # a shingle that crosses into the next document is none
            inside = at + gram <= ends[doc]
            at, size, doc = at[inside], size[inside], doc[inside]
            if not len(at):
                continue
            # all windows of the length that hold the shingle
            wide = np.minimum(size, ends[doc] - starts[doc])
            low, high = np.maximum(at + gram - wide, starts[doc]), np.minimum(at, ends[doc] - wide)
            group, low, high = R.merged(doc * (int(self.size.max()) + 1) + size, low, high + 1)
            times = high - low
            total = np.cumsum(times)
            for cut in range(0, int(total[-1]), WINDOWS):
                some = np.arange(cut, min(cut + WINDOWS, int(total[-1])))
                of = np.searchsorted(total, some, side="right")
                start = low[of] + some - (total - times)[of]
                doc, size = np.divmod(group[of], int(self.size.max()) + 1)
                self.compare(shingles, gram, start, np.minimum(size, ends[doc] - starts[doc]), doc, size, best)
        return [(d, k, like, s - int(starts[d]), w) for (d, k), (like, s, w) in best.items()]

    def compare(self, shingles: np.ndarray, gram: int, start: np.ndarray, wide: np.ndarray, doc: np.ndarray, size: np.ndarray, best: dict) -> None:
        """Compares windows, in the order of their document, length and start, with the items of the same length."""
        count = wide - gram + 1
        prints, content = window_prints(shingles, start, count)
        i, item = self.index.within(prints, lambda i, item: self.size[item] == size[i])
        # windows of a document with the same shingles count once, the first of them
        order = np.lexsort((start[i], content[i], item, doc[i]))
        i, item = i[order], item[order]
        new = np.ones(len(i), bool)
        new[1:] = (doc[i][1:] != doc[i][:-1]) | (item[1:] != item[:-1]) | (content[i][1:] != content[i][:-1])
        for i, k in zip(i[new].tolist(), item[new].tolist(), strict=True):
            d, s = int(doc[i]), int(start[i])
            like = weighted_jaccard(shingles[s : s + int(count[i])], self.shingles[k])
            if like >= SIMILARITY - 1e-12 and (-like, s) < ((old := best.get((d, k), (-1.0, 0, 0)))[0] * -1, old[1]):
                best[d, k] = (like, s, int(wide[i]))


def window_prints(shingles: np.ndarray, start: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The SimHash of each window of `count` shingles from `start` on, and a hash of its multiset of shingles.

    Windows that overlap share the running sums of their shingles' bits."""
    end = start + count
    # the shingles that are needed, each run of overlapping windows once
    new = np.r_[True, start[1:] > end[:-1]] | np.r_[True, start[1:] < start[:-1]]
    run = np.cumsum(new) - 1
    first = start[new]
    last = np.maximum.reduceat(end, np.flatnonzero(new))
    times = last - first
    shift = np.cumsum(times) - times
    need = np.arange(times.sum()) + np.repeat(first - shift, times)
    a, b = start - first[run] + shift[run], end - first[run] + shift[run]
    prints = np.zeros((len(start), 8), np.uint8)
    for k in range(8):  # eight bits at a time
        bits = np.unpackbits((shingles[need] >> np.uint64(8 * k)).astype(np.uint8)[:, None], axis=1, bitorder="little")
        total = np.concatenate([np.zeros((1, 8), np.int32), np.cumsum(bits, axis=0, dtype=np.int32)])
        prints[:, k] = np.packbits(2 * (total[b] - total[a]) > count[:, None], axis=1, bitorder="little")[:, 0]
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(shingles[need]), dtype=np.uint64)])
    return prints.view("<u8")[:, 0].astype(np.uint64), sums[b] - sums[a]


def item_blocks(items: DataFrame, words: int = ITEM_WORDS) -> Iterator[Items]:
    """The items, read one partition after another, in blocks of a bounded number of words."""
    ids, texts, size = [], [], 0
    for row in items.select("item_id", "text").toLocalIterator():
        n = len((row.text or "").split())
        if ids and size + n > words:
            yield Items(ids, texts)
            ids, texts, size = [], [], 0
        ids.append(row.item_id)
        texts.append(row.text)
        size += n
    yield Items(ids, texts)


def contaminated(docs: DataFrame, items: DataFrame) -> DataFrame:
    """One row for each document and item of which a window is similar enough."""
    rows = docs.select(F.col("doc_id").cast("long"), whole_text().alias("text"))
    found = None
    for block in item_blocks(items):
        sent = docs.sparkSession.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            block = sent.value
            for b in batches:
                ids, texts, out = b.column("doc_id").to_pylist(), b.column("text").cast(pa.binary()), []
                for at, stop in R.slices(texts):
                    out += [(ids[at + d], block.ids[k], like, s, n) for d, k, like, s, n in block.search(texts[at:stop].to_pylist())]
                kinds = (pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], kind) for i, kind in enumerate(kinds)], ["doc_id", "item_id", "similarity", "start_word", "n_words"])

        part = rows.mapInArrow(run, MATCHES)
        found = part if found is None else found.unionByName(part)
    return found


def clean(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The rows of `docs`, with all their columns, that hold no such window."""
    for block in item_blocks(items):
        sent = docs.sparkSession.sparkContext.broadcast(block)

        def good(column: pa.Array, sent=sent) -> np.ndarray:
            texts, free = column.cast(pa.binary()), np.ones(len(column), bool)
            for at, stop in R.slices(texts):
                found = sent.value.search([x or b"" for x in texts[at:stop].to_pylist()])
                free[[at + d for d, *_ in found]] = False
            return free

        docs = rows_kept(docs, good)
    return docs


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES = {"op7_decontaminate": op7_decontaminate}
