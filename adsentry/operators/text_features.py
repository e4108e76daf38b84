"""Texts as TF-IDF vectors over a fitted vocabulary, and their main components.

The vocabulary is a table (kind, term, place, idf), bounded by the corpus frequency of its terms. A text's terms are counted in
the task that has the text: 1 + ln(tf), times the smoothed idf, each kind with length 1. What is shuffled is texts, and
sums of a task. Weights become MLlib's sparse vectors by being written as the struct that such a vector is, and read as vectors.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from .storage import stored

WORD = r"[\p{L}\p{N}_]{2,}"
MOST = 20_000


def words_of(text: Column) -> Column:
    """Words of two or more characters, joined by a space."""
    return F.array_join(F.regexp_extract_all(F.lower(text), F.lit(f"({WORD})"), F.lit(1)), " ")


def parts_of(text: Column) -> Column:
    """What stands between white space, joined by a space."""
    return F.array_join(F.filter(F.split(F.lower(text), r"(?U)\s+"), lambda w: w != ""), " ")


Counts = tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]  # distinct terms, and row, term and tf of each pair of row and term
SLICE, CHARS, BITS = 500, 1 << 21, 12


def tallied(codes: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The distinct codes of some rows; then row, place among the distinct codes, and number of each code of a row."""
    own, times = [], []
    for c in codes:
        c = np.sort(c)
        at = np.flatnonzero(np.concatenate([c[:1] == c[:1], c[1:] != c[:-1]]))
        own.append(c[at])
        times.append(np.diff(at, append=len(c)))
    distinct, term = np.unique(np.concatenate(own), return_inverse=True)
    return distinct, np.repeat(np.arange(len(own)), [len(x) for x in own]), term, np.concatenate(times)


def word_terms(rows: list[list[str]]) -> Iterator[tuple[int, Counts]]:
    """Words, and pairs of neighbours. A word is coded as its number, a pair as two of them."""
    known: dict[str, int] = {}
    codes = []
    for texts in rows:
        parts = [np.zeros(0, np.int64)]
        for t in texts:
            w = np.array([known.setdefault(x, len(known)) for x in t.split(" ")] if t else [], np.int64)
            parts += [w, (w[:-1] + 1 << 32) | w[1:]]
        codes.append(np.concatenate(parts))
    distinct, row, term, tf = tallied(codes)
    names, first = np.array([*known, ""], object), distinct >> 32
    second = names[distinct & 0xFFFFFFFF]
    yield 0, (pa.array(np.where(first > 0, names[first - 1] + " " + second, second), pa.string()), row, term, tf)


def character_terms(rows: list[list[str]]) -> Iterator[tuple[int, Counts]]:
    """Runs of three to five characters inside words, which have a space before and after. A run is coded as the numbers of its characters among
    those of the rows; rows of too many different characters are taken in parts."""
    joined = [f" {' '.join(t for t in texts if t)} " for texts in rows]
    points = np.frombuffer(" ".join(joined).encode("utf-32-le"), np.uint32)
    alphabet, number = np.unique(points, return_inverse=True)
    if len(alphabet) >= 1 << BITS:
        if len(rows) > 1:
            half = len(rows) // 2
            yield from character_terms(rows[:half])
            yield from ((half + at, x) for at, x in character_terms(rows[half:]))
        else:
            yield 0, _counted_singly(joined[0].split())
        return
    number = number.astype(np.int64) + 1
    spaces = np.concatenate([[0], np.cumsum(points == 32)])
    runs = []
    for n in (3, 4, 5):
        code = np.zeros(max(len(points) - n + 1, 0), np.int64)
        for j in range(n):
            code |= number[j : j + len(code)] << BITS * (4 - j)
        inside = spaces[n - 1 : n - 1 + len(code)] == spaces[1 : 1 + len(code)]  # no space but the first and the last
        runs.append((n, np.where(inside, code, -1)))
    ends = np.cumsum([0, *[len(x) + 1 for x in joined]])
    own = [np.concatenate([c[a : max(a, b - n)] for n, c in runs]) for a, b in zip(ends, ends[1:], strict=False)]
    distinct, row, term, tf = tallied([x[x >= 0] for x in own])
    yield 0, (character_names(alphabet, distinct), row, term, tf)


def character_names(alphabet: np.ndarray, codes: np.ndarray) -> pa.Array:
    """What is coded as the numbers of its characters, from 1."""
    parts = np.stack([codes >> BITS * (4 - j) & (1 << BITS) - 1 for j in range(5)], 1)
    chars = alphabet[parts[parts > 0] - 1]
    sizes = np.zeros(parts.shape, np.int32)
    sizes[parts > 0] = 1 + (chars >= 0x80) + (chars >= 0x800) + (chars >= 0x10000)
    offsets = np.concatenate([[0], np.cumsum(sizes.sum(1))]).astype(np.int32)
    data = chars.astype("<u4").tobytes().decode("utf-32-le").encode()
    return pa.StringArray.from_buffers(len(codes), pa.py_buffer(offsets), pa.py_buffer(data))


def _counted_singly(words: list[str]) -> Counts:
    found = Counter(w[i : i + n] for w in (f" {w} " for w in words) for n in (3, 4, 5) for i in range(len(w) - n + 1))
    return pa.array(list(found), pa.string()), np.zeros(len(found), np.int64), np.arange(len(found)), np.array(list(found.values()), np.int64)


# kind: the words of a text, and what is counted in them
KINDS = {"word": (words_of, word_terms), "char": (parts_of, character_terms)}


def by_key(docs: DataFrame, key: str, kinds: tuple[str, ...], whole: bool = False) -> DataFrame:
    """(key, and for each kind the words of each text of this key), with `whole` the rows themselves too. Texts are shuffled, terms never."""
    # a fixed number of parts: Spark would merge them by the size of the texts, and what is made of these is larger
    parts = docs.repartition(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), key)
    words = [KINDS[k][0](F.coalesce("text", F.lit(""))).alias(k) for k in kinds]
    rows = parts.select(F.col(key).alias("key"), F.struct(*docs.columns).alias("rows"), *words)
    return rows.groupBy("key").agg(*[F.collect_list(c).alias(c) for c in (["rows"] if whole else []) + list(kinds)])


def _slices(batches: Iterator[pa.RecordBatch], kinds: tuple[str, ...]) -> Iterator[tuple[pa.RecordBatch, dict[str, list[list[str]]]]]:
    """Up to `SLICE` rows at a time, and of `CHARS` characters if there are several, with their words of each kind."""
    for b in batches:
        words = {k: b.column(k).to_pylist() for k in kinds}
        sizes = np.cumsum([0, *[sum(len(t) for k in kinds for t in words[k][i]) for i in range(b.num_rows)]])
        at = 0
        while at < b.num_rows:
            to = min(at + SLICE, max(at + 1, int(np.searchsorted(sizes, sizes[at] + CHARS, "right")) - 1))
            yield b.slice(at, to - at), {k: x[at:to] for k, x in words.items()}
            at = to


def term_table(docs: DataFrame, key: str, kinds: tuple[str, ...]) -> DataFrame:
    """(key, kind, term, tf). docs: key, text; a null text has no terms."""

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, words in _slices(batches, kinds):
            for k in kinds:
                for at, (terms, row, term, tf) in KINDS[k][1](words[k]):
                    yield pa.RecordBatch.from_arrays([b.column("key").take(pa.array(row + at)), pa.array([k] * len(row), pa.string()), terms.take(pa.array(term)), pa.array(tf)], ["key", "kind", "term", "tf"])

    fields = [StructField("key", docs.schema[key].dataType), *StructType.fromDDL("kind string, term string, tf long")]
    return by_key(docs.select(key, "text"), key, kinds).mapInArrow(part, StructType(fields)).withColumnRenamed("key", key)


def term_counts(docs: DataFrame, key: str, kinds: tuple[str, ...]) -> DataFrame:
    """(kind, term, df, n): how many keys have a term, and how often it occurs. Sums of some hundred texts are added up by Spark."""

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, words in _slices(batches, kinds):
            for k in kinds:
                for _, (terms, _, term, tf) in KINDS[k][1](words[k]):
                    n = np.bincount(term, tf, len(terms)).astype(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array([k] * len(terms), pa.string()), terms, pa.array(np.bincount(term, minlength=len(terms))), pa.array(n)], ["kind", "term", "df", "n"])

    found = by_key(docs.select(key, "text"), key, kinds).mapInArrow(part, "kind string, term string, df long, n long")
    return found.groupBy("kind", "term").agg(F.sum("df").alias("df"), F.sum("n").alias("n"))


def vocabulary(terms: DataFrame, n_docs: int, least: int = 2, most: int = MOST) -> DataFrame:
    """(kind, term, place, idf): terms of at least `least` documents, the `most` frequent ones of each kind. Where no term of a kind
    is in so many documents, one document is enough. terms: a term table."""
    return vocabulary_of(terms.groupBy("kind", "term").agg(F.count("*").alias("df"), F.sum("tf").alias("n")), n_docs, least, most)


def vocabulary_of(counts: DataFrame, n_docs: int, least: int = 2, most: int = MOST, kinds: tuple[str, ...] = ()) -> DataFrame:
    """The same from (kind, term, df, n). Most terms are in one document only, so these are kept only if one of the `kinds`, which a caller knows,
    has no others."""
    tops = lambda rows: sorted(map(tuple, rows.groupBy("kind").agg(F.max("df")).collect()))
    kept = stored(counts.where(F.col("df") >= least) if kinds else counts)
    found = tops(kept)
    if not {k for k, _ in found} >= set(kinds):
        kept = stored(counts)
        found = tops(kept)
    counts, parts, start = kept, [], 0
    for kind, top in found:
        # `most` rows at most are numbered
        own = counts.where((F.col("kind") == kind) & (F.col("df") >= min(least, top))).orderBy(F.desc("n"), "term").limit(most)
        parts.append(own.selectExpr("kind", "term", f"cast(row_number() over (order by n desc, term) - 1 + {start} as int) as place", f"ln({1 + n_docs}d / (1 + df)) + 1 as idf"))
        start += most
    if not parts:
        return counts.selectExpr("kind", "term", "0 as place", "0d as idf")
    every = parts[0]
    for part in parts[1:]:
        every = every.unionByName(part)
    return stored(every)


def weights(terms: DataFrame, words: DataFrame, key: str) -> DataFrame:
    """(key, kind, place, w): sublinear TF-IDF, with length 1 for each kind of a document."""
    raw = terms.join(words, ["kind", "term"]).withColumn("raw", (1 + F.log("tf")) * F.col("idf"))
    norm = raw.groupBy(key, "kind").agg(F.sqrt(F.sum(F.col("raw") * F.col("raw"))).alias("norm"))
    return raw.join(norm, [key, "kind"]).select(key, "kind", "place", (F.col("raw") / F.col("norm")).alias("w"))


def weighted(docs: DataFrame, words: DataFrame, key: str, kinds: tuple[str, ...], whole: bool = False) -> DataFrame:
    """(key, n, place, w): how many texts a key has, and their weights as two arrays, in the order of places; with `whole` also
    `rows`, the rows of `docs` of this key. The vocabulary, which is bounded, goes to every task."""
    known: dict[str, dict[str, tuple[int, float]]] = {k: {} for k in kinds}
    for r in words.where(F.col("kind").isin(*kinds)).toLocalIterator():
        known[r.kind][r.term] = (r.place, r.idf)
    sent = docs.sparkSession.sparkContext.broadcast(known)

    def entries(kind: str, rows: list[list[str]]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        for at, (terms, row, term, tf) in KINDS[kind][1](rows):
            found = [sent.value[kind].get(t, (-1, 0.0)) for t in terms.to_pylist()]
            place, idf = np.array([x[0] for x in found], np.int32)[term], np.array([x[1] for x in found])[term]
            row, place, raw = (x[place >= 0] for x in (row, place, (1 + np.log(tf)) * idf))
            norm = np.sqrt(np.bincount(row, raw * raw, len(rows)))
            yield row + at, place, raw / norm[row]

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, words in _slices(batches, kinds):
            every = [x for k in kinds for x in entries(k, words[k])]
            row, place, w = (np.concatenate(x) for x in zip(*every, strict=True))
            order = np.lexsort((place, row))
            ends = pa.array(np.concatenate([[0], np.cumsum(np.bincount(row, minlength=b.num_rows))]), pa.int32())
            kept = ["key", "rows"] if whole else ["key"]
            n = pa.array([len(x) for x in words[kinds[0]]], pa.int32())
            lists = [pa.ListArray.from_arrays(ends, pa.array(x[order])) for x in (place, w)]
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in kept], n, *lists], [*kept, "n", "place", "w"])

    rows = by_key(docs if whole else docs.select(key, "text"), key, kinds, whole)
    fields = [rows.schema["key"], *([rows.schema["rows"]] if whole else []), *StructType.fromDDL("n int, place array<int>, w array<double>")]
    return rows.mapInArrow(part, StructType(fields)).withColumnRenamed("key", key)


def vectors(docs: DataFrame, words: DataFrame, key: str, kinds: tuple[str, ...], size: int) -> DataFrame:
    """The rows of `docs` (key, text, ...) with `features`, a sparse vector; all zeros where no term is known."""
    found = weighted(docs, words, key, kinds, True)
    sparse = F.struct(F.lit(0).cast("byte").alias("type"), F.lit(size).alias("size"), F.col("place").alias("indices"), F.col("w").alias("values"))
    both = found.select(F.explode("rows").alias("row"), sparse.alias("features")).select("row.*", "features")
    return stored(both, StructType([StructField(f.name, VectorUDT(), True) if f.name == "features" else f for f in both.schema.fields]))


# truncated singular value decomposition


CHUNK = 1 << 17


def _rows(batch: pa.RecordBatch) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """Runs of rows of a batch of sparse rows, of some `CHUNK` entries: first row, how many, and row, column and weight of each entry."""
    lists = batch.column("place")
    ends = lists.offsets.to_numpy() - lists.offsets[0].as_py()
    column, w = lists.flatten().to_numpy(), batch.column("w").flatten().to_numpy()
    at = 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(ends, ends[at] + CHUNK, "right")) - 1)
        yield at, to - at, np.repeat(np.arange(to - at), np.diff(ends[at : to + 1])), column[ends[at] : ends[to]], w[ends[at] : ends[to]]
        at = to


def _times(size: int, row: np.ndarray, column: np.ndarray, w: np.ndarray, dense: np.ndarray) -> np.ndarray:
    """Sums by `row` of w times the rows `column` of a dense matrix; `size` rows."""
    return np.stack([np.bincount(row, w * dense[column, j], size) for j in range(dense.shape[1])], 1)


def gram_product(rows: DataFrame, dense: np.ndarray) -> np.ndarray:
    """Xᵀ X times a dense matrix, for the sparse rows (place, w) of a table. Each task adds up its own rows; the sums are as large as the
    matrix, which has a row for each term of the vocabulary."""
    sent = rows.sparkSession.sparkContext.broadcast(dense)

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, used = np.zeros(sent.value.shape), np.zeros(len(sent.value), bool)
        for b in batches:
            for _, n, row, column, w in _rows(b):
                total += _times(len(total), column, row, w, _times(n, row, column, w, sent.value))
                used[column] = True
        at = np.flatnonzero(used)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(list(total[at]), pa.list_(pa.float64()))], ["place", "v"])

    parts = rows.select("place", "w").mapInArrow(part, "place long, v array<double>")
    sums = parts.groupBy("place").agg(F.array(*[F.sum(F.col("v")[j]) for j in range(dense.shape[1])]).alias("v"))
    out = np.zeros(dense.shape)
    for r in sums.collect():  # a row for each term of the vocabulary
        out[r.place] = r.v
    sent.unpersist()
    return out


def principal_directions(rows: DataFrame, size: int, k: int, tolerance: float = 1e-9, most: int = 30) -> tuple[np.ndarray, np.ndarray]:
    """The k largest singular values of the sparse rows, and their right vectors as columns (size x k).

    Block Lanczos: each step multiplies the newest block by the Gram matrix, one job over the rows; what is small (size x block)
    is made orthogonal on the driver. It ends when the last step has changed no value by over `tolerance` of the largest.
    The largest entry of each vector is positive."""
    block = np.linalg.qr(np.random.default_rng(7).standard_normal((size, min(size, k + 4))))[0]
    basis, images, values = np.zeros((size, 0)), np.zeros((size, 0)), np.zeros(k)
    for _ in range(most):
        image = gram_product(rows, block)
        basis, images = np.hstack([basis, block]), np.hstack([images, image])
        small = basis.T @ images
        found, turn = np.linalg.eigh((small + small.T) / 2)
        found, turn = np.maximum(found[::-1][:k], 0), turn[:, ::-1][:, :k]
        done = len(found) == k and np.abs(found - values[: len(found)]).max() <= tolerance * max(found[0], 1e-300)
        values = np.pad(found, (0, k - len(found)))
        if done or basis.shape[1] >= size:
            break
        for _ in range(2):
            image = image - basis @ (basis.T @ image)
        left, scale, _ = np.linalg.svd(image, full_matrices=False)
        block = left[:, scale > 1e-12 * max(scale[0], 1e-300)][:, : size - basis.shape[1]]
        if not block.shape[1] or scale[0] <= 1e-12 * max(values[0], 1e-300):
            break
    directions = basis @ turn
    directions *= np.where(directions[np.abs(directions).argmax(0), np.arange(directions.shape[1])] < 0, -1.0, 1.0)
    return np.sqrt(values[: directions.shape[1]]), directions


def projected(rows: DataFrame, directions: np.ndarray) -> DataFrame:
    """The rows (key, place, w) with `components`, their product with the directions."""
    sent = rows.sparkSession.sparkContext.broadcast(directions)

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at, n, row, column, w in _rows(b):
                yield pa.RecordBatch.from_arrays([b.column(0).slice(at, n), pa.array(list(_times(n, row, column, w, sent.value)), pa.list_(pa.float64()))], ["key", "components"])

    key = next(c for c in rows.columns if c not in ("place", "w"))
    return rows.select(F.col(key).cast("long").alias("key"), "place", "w").mapInArrow(part, "key long, components array<double>").withColumnRenamed("key", key)


def text_components(docs: DataFrame, key: str, k: int = 20, most: int = MOST) -> tuple[np.ndarray, DataFrame]:
    """ML-04: singular values, and (key, components) of all texts: TF-IDF of words and pairs, truncated to at most `k` components, to one
    less than the terms and one less than the texts."""
    n = docs.count()
    words = vocabulary_of(term_counts(docs, key, ("word",)), n, most=most)
    size = words.count()
    k = min(k, size - 1, n - 1)
    rows = stored(weighted(docs, words, key, ("word",)).select(key, "place", "w", F.expr("explode(array_repeat(0, n))")).select(key, "place", "w"))
    if k < 1:
        return np.zeros(0), rows.select(key, F.array().cast("array<double>").alias("components"))
    values, directions = principal_directions(rows, size, k)
    return values, projected(rows, directions)
