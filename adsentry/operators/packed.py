"""Texts as packed sparse rows, and logistic regression on them.

A slice is some hundred texts, packed column by column: for each kind of terms the places of the vocabulary that occur, and row and count of each
entry, in two bytes each. TF-IDF weights follow from these, so a pass over the slices reads a tenth of what weights as doubles take. The
vocabulary bounds what the driver and each task hold beside a slice.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Callable, Generator, Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import RDD, StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import stored
from .text_features import BITS, CHARS, SLICE, character_names, character_terms

KINDS = ("char", "word")
WORD = re.compile(r"\w{2,}")
CONTROLS = re.compile("[\x1c-\x1f]")  # white space for Python only
BLANKS = re.compile(r"[\t-\r \x85\xa0  -     　]+")
CHUNK = 1 << 16  # what arrays of a step hold, so that they stay in a core's cache


def parted(text: str) -> str:
    """What stands between white space, joined by a space."""
    return " ".join(filter(None, BLANKS.split(text)) if CONTROLS.search(text) else text.split())


def _starts(ordered: np.ndarray) -> np.ndarray:
    """Where the values of an ordered array begin."""
    return np.flatnonzero(np.concatenate([ordered[:1] == ordered[:1], ordered[1:] != ordered[:-1]]))


def _points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of the texts' words, with a space before and after each word and one more between texts; and where each text ends."""
    joined = [f" {parted(t)} " for t in texts]
    return np.frombuffer(" ".join(joined).encode("utf-32-le"), np.uint32), np.cumsum([len(x) + 1 for x in joined])


def _character_codes(points: np.ndarray, ends: np.ndarray, number: np.ndarray) -> Iterator[np.ndarray]:
    """The ordered codes of each text, with repetitions: runs of three to five characters inside words, as the numbers of these."""
    row = 0
    while row < len(ends):
        begin = ends[row - 1] if row else 0
        to = max(row + 1, int(np.searchsorted(ends, begin + CHUNK, "right")))
        some = points[begin : ends[to - 1]]
        n, own, bounds = number[some].astype(np.int64), some != 32, ends[row:to] - begin
        runs, code, inside = [], n << BITS * 4 | np.append(n[1:], 0) << BITS * 3, np.ones(len(n), bool)
        for size in (3, 4, 5):
            left = max(len(n) - size + 1, 0)
            code, inside = code[:left] | n[size - 1 :] << BITS * (5 - size), inside[:left] & own[size - 2 : size - 2 + left]
            counts = np.concatenate([[0], np.cumsum(inside)])
            runs.append((code[inside], counts[np.minimum(np.concatenate([[0], bounds]), left)]))
        for i in range(to - row):
            yield np.sort(np.concatenate([c[at[i] : at[i + 1]] for c, at in runs]))
        row = to


def _counted(codes: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct codes of some rows, how many rows have each, and how often it occurs. Each row's codes are ordered."""
    every, once = np.sort(np.concatenate(codes)), np.sort(np.concatenate([c[_starts(c)] for c in codes]))
    at = _starts(every)
    return every[at], np.diff(_starts(once), append=len(once)), np.diff(at, append=len(every))


def _character_counts(texts: list[str]) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray]]:
    """(terms, df, n)."""
    points, ends = _points(texts)
    seen = np.zeros(0x110000, bool)
    seen[points] = True
    alphabet = np.flatnonzero(seen)
    if len(alphabet) >= 1 << BITS:  # too many for a code
        for _, (terms, _, term, tf) in character_terms([[parted(t)] for t in texts]):
            yield terms, np.bincount(term, minlength=len(terms)), np.bincount(term, tf, len(terms)).astype(np.int64)
        return
    number = np.zeros(0x110000, np.uint16)
    number[alphabet] = np.arange(1, len(alphabet) + 1)
    codes, df, n = _counted(list(_character_codes(points, ends, number)))
    yield character_names(alphabet, codes), df, n


def _word_counts(texts: list[str]) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray]]:
    """(terms, df, n) of words, and of pairs of neighbours. A word is coded as its number, a pair as two of them."""
    known: defaultdict[str, int] = defaultdict()
    known.default_factory = known.__len__
    codes = []
    for t in texts:
        w = np.fromiter(map(known.__getitem__, WORD.findall(t)), np.int64)
        codes.append(np.sort(np.concatenate([w, (w[:-1] + 1 << 32) | w[1:]])))
    found, df, n = _counted(codes)
    names, singles = pa.array(list(known), pa.string()), int(np.searchsorted(found, 1 << 32))
    first, second = pa.array((found[singles:] >> 32) - 1), pa.array(found[singles:] & 0xFFFFFFFF)
    pairs = pc.binary_join_element_wise(names.take(first), names.take(second), " ")
    yield pa.concat_arrays([names.take(pa.array(found[:singles])), pairs]), df, n


COUNTS: dict[str, Callable[[list[str]], Iterator[tuple[pa.Array, np.ndarray, np.ndarray]]]] = {"char": _character_counts, "word": _word_counts}


def _slices(batches: Iterator[pa.RecordBatch], times: int = 1) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Up to `times` `SLICE` rows at a time, and of as many times `CHARS` characters if there are several, with their texts in lower case; a null text is ''."""
    for b in batches:
        texts = [(t or "").lower() for t in b.column("text").to_pylist()]
        sizes = np.cumsum([0, *map(len, texts)])
        at = 0
        while at < b.num_rows:
            to = min(at + times * SLICE, max(at + 1, int(np.searchsorted(sizes, sizes[at] + times * CHARS, "right")) - 1))
            yield b.slice(at, to - at), texts[at:to]
            at = to


def dealt(docs: DataFrame) -> DataFrame:
    """Texts take long by their size, so they go to a fixed number of parts."""
    return docs.repartition(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), "row_id")


def term_counts(docs: DataFrame) -> DataFrame:
    """(kind, term, df, n) of all rows. docs: row_id, text."""

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, texts in _slices(batches, 3):  # the more texts, the fewer sums of the same term
            for k in KINDS:
                for terms, df, n in COUNTS[k](texts):
                    yield pa.RecordBatch.from_arrays([pa.array([k] * len(terms), pa.string()), terms, pa.array(df, pa.int64()), pa.array(n, pa.int64())], ["kind", "term", "df", "n"])

    found = dealt(docs.select("row_id", "text")).mapInArrow(part, "kind string, term string, df long, n long")
    return found.groupBy("kind", "term").agg(F.sum("df").alias("df"), F.sum("n").alias("n"))


class Known:
    """Where a vocabulary has its terms: by codes of characters and of pairs of words."""

    def __init__(self, places: dict[str, dict[str, int]], idf: np.ndarray):
        self.idf, self.names = idf, None
        chars, words = places["char"], places["word"]
        alphabet = sorted(set().union(*chars))
        if len(alphabet) + 2 > 1 << BITS:  # too many for a code
            self.names = chars
        else:
            self.number = np.full(0x110000, len(alphabet) + 1, np.uint16)  # of a character that no term has
            self.number[[ord(x) for x in alphabet]] = np.arange(1, len(alphabet) + 1)
            numbers = {x: i for i, x in enumerate(alphabet, 1)}
            self.chars = self._ordered([sum(numbers[x] << BITS * (4 - j) for j, x in enumerate(t)) for t in chars], chars)
        pairs = [t.split(" ") for t in words]
        self.words = {w: i for i, w in enumerate(dict.fromkeys(w for p in pairs for w in p))}
        self.pairs = self._ordered([self._pair(*[self.words[w] for w in p]) for p in pairs], words)

    @staticmethod
    def _pair(first, second=-1):
        """A word alone is a pair without a second word."""
        return first << 32 | second + 1

    @staticmethod
    def _ordered(codes: list[int], places: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
        found = np.array(codes, np.int64)
        order = np.argsort(found)
        return np.append(found[order], np.iinfo(np.int64).max), np.append(np.array(list(places.values()), np.int64)[order], -1)

    @staticmethod
    def _sought(ordered: tuple[np.ndarray, np.ndarray], codes: np.ndarray) -> np.ndarray:
        """Places of codes; -1 for those that the vocabulary does not have."""
        at = np.searchsorted(ordered[0], codes)
        return np.where(ordered[0][at] == codes, ordered[1][at], -1)

    def char(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Row, place and tf of the entries of some texts."""
        rows, places, times = [], [], []
        if self.names is not None:
            for at, (terms, row, term, tf) in character_terms([[parted(t)] for t in texts]):
                rows.append(row + at)
                places.append(np.array([self.names.get(t, -1) for t in terms.to_pylist()], np.int64)[term])
                times.append(tf)
        else:
            for row, codes in enumerate(_character_codes(*_points(texts), self.number)):
                at = _starts(codes)
                rows.append(np.full(len(at), row))
                places.append(self._sought(self.chars, codes[at]))
                times.append(np.diff(at, append=len(codes)))
        row, place, tf = (np.concatenate(x) for x in (rows, places, times))
        return row[place >= 0], place[place >= 0], tf[place >= 0]

    def word(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        own = [np.fromiter(map(self.words.get, WORD.findall(t), repeat(-1)), np.int64) for t in texts]
        words, row = np.concatenate(own), np.repeat(np.arange(len(own)), [len(x) for x in own])
        near = (row[1:] == row[:-1]) & (words[1:] >= 0) & (words[:-1] >= 0)
        codes = [self._pair(words[words >= 0]), self._pair(words[:-1][near], words[1:][near])]
        place = self._sought(self.pairs, np.concatenate(codes))
        row = np.concatenate([row[words >= 0], row[1:][near]])
        every = np.sort(row[place >= 0] << 32 | place[place >= 0])
        at = _starts(every)
        return every[at] >> 32, every[at] & 0xFFFFFFFF, np.diff(at, append=len(every))


class Vocabulary:
    """Places and idf of a fitted table (kind, term, place, idf), in every task."""

    def __init__(self, words: DataFrame, size: int):
        places: dict[str, dict[str, int]] = {k: {} for k in KINDS}
        self.idf, self.size = np.zeros(size), size
        for r in words.toLocalIterator():
            places[r.kind][r.term] = r.place
            self.idf[r.place] = r.idf
        self.sent = words.sparkSession.sparkContext.broadcast(Known(places, self.idf))


Columns = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]


def _columns(known: Known, kind: str, texts: list[str]) -> Columns:
    """Places that occur in order, how many entries each has, row and tf of the entries, and 1 / length of each row."""
    row, place, tf = getattr(known, kind)(texts)
    order = np.sort((place * len(texts) + row) << 32 | np.arange(len(row))) & 0xFFFFFFFF
    row, place, tf = row[order], place[order], tf[order]
    length = np.sqrt(np.bincount(row, ((1 + np.log(tf)) * known.idf[place]) ** 2, len(texts)))
    starts = _starts(place)
    return place[starts], np.diff(starts, append=len(place)), row, tf, 1 / np.where(length > 0, length, 1.0)


def _chunks(columns: Columns, logs: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Some `CHUNK` entries at a time: their places, how many entries each has and where they begin, row and 1 + ln(tf) of the entries."""
    places, times, row, tf, _ = columns
    ends = np.cumsum(times, dtype=np.int64)
    at = first = 0
    while at < len(places):
        to = max(at + 1, int(np.searchsorted(ends, first + CHUNK, "right")))
        last = int(ends[to - 1])
        yield places[at:to], times[at:to], ends[at:to] - times[at:to] - first, row[first:last].astype(np.intp), logs.take(tf[first:last])
        at, first = to, last


def _logs(columns: list[Columns]) -> np.ndarray:
    """1 + ln(tf) for each tf that occurs."""
    return np.concatenate([[0.0], 1 + np.log(np.arange(1.0, max(int(c[3].max(initial=0)) for c in columns) + 1))])


def _margins(n: int, columns: list[Columns], scaled: list[np.ndarray], logs: np.ndarray) -> list[np.ndarray]:
    """The products of the rows with each of some weights times idf (the last is the intercept)."""
    z = [np.full(n, x[-1]) for x in scaled]
    for c in columns:
        sums = [np.zeros(n) for _ in scaled]
        for places, times, _, row, log in _chunks(c, logs):
            for own, x in zip(sums, scaled, strict=True):
                own += np.bincount(row, np.repeat(x[places], times) * log, n)
        for own, total in zip(sums, z, strict=True):
            total += own * c[4]
    return z


TYPES = {"places": "<u4", "times": "<u2", "row": "<u2", "tf": None, "inverse": "<f8"}


def packed(docs: DataFrame, words: Vocabulary, labels: list[str]) -> DataFrame:
    """(n, labels, and for each kind the columns of a slice). docs: row_id, text and the labels, 0 or 1."""
    sent = words.sent
    names = ["n", *labels, *[f"{k}_{c}" for k in KINDS for c in TYPES]]

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, texts in _slices(batches, 2):
            values = [b.column(c).to_numpy(zero_copy_only=False).astype("u1").tobytes() for c in labels]
            for k in KINDS:
                for x, kind in zip(_columns(sent.value, k, texts), TYPES.values(), strict=True):
                    values.append(x.astype(kind or ("<u2" if x.max(initial=0) < 1 << 16 else "<u4")).tobytes())
            yield pa.RecordBatch.from_arrays([pa.array([len(texts)], pa.int32()), *[pa.array([x], pa.binary()) for x in values]], names)

    return stored(dealt(docs.select("row_id", "text", *labels)).mapInArrow(part, ", ".join(["n int", *[f"`{c}` binary" for c in names[1:]]])))


def _unpacked(row: dict, kind: str) -> tuple[np.ndarray, ...]:
    out = []
    for c, form in TYPES.items():
        data = row[f"{kind}_{c}"]
        out.append(np.frombuffer(data, form or f"<u{len(data) // max(1, len(row[f'{kind}_row']) // 2)}" if data else "<u2"))
    return tuple(out)


def kept_slices(table: DataFrame, *labels: str) -> RDD:
    """The slices as they go to Python, kept by the executors (on disk what memory does not hold); as many parts as cores."""
    columns = [f"{k}_{c}" for k in KINDS for c in TYPES]
    rows = table.select("n", F.array(*labels).alias("labels"), *columns).coalesce(table.sparkSession.sparkContext.defaultParallelism)
    return rows.rdd.map(lambda r: r.asDict()).persist(StorageLevel.MEMORY_AND_DISK)


def loss_and_slope(slices: RDD, weight: tuple[float, float], scaled: np.ndarray) -> tuple[float, np.ndarray]:
    """The weighted logistic loss of all rows by their first label, and its slope before idf."""
    return losses_and_slopes(slices, [(0, weight, scaled)])[0]


def losses_and_slopes(slices: RDD, asked: list[tuple[int, tuple[float, float], np.ndarray]]) -> list[tuple[float, np.ndarray]]:
    """Loss and slope for each (number of a label, weights of its classes, weights times idf), in one pass over the slices. Each task adds up its own
    slices, and gives a row as large as the vocabulary for each."""
    sent = slices.context.broadcast(asked)

    def part(rows: Iterator[dict]) -> Iterator[list[tuple[float, bytes]]]:
        scaled = [x for _, _, x in sent.value]
        losses, slopes = [0.0] * len(scaled), [np.zeros(len(x)) for x in scaled]
        for row in rows:
            columns = [_unpacked(row, k) for k in KINDS]
            logs = _logs(columns)
            ms = []
            for i, z in enumerate(_margins(row["n"], columns, scaled, logs)):
                label, weight, _ = sent.value[i]
                y = np.frombuffer(row["labels"][label], "u1").astype(float)
                w = np.where(y > 0, weight[1], weight[0])
                losses[i] += float((w * (np.logaddexp(0, z) - y * z)).sum())
                ms.append(w * (1 / (1 + np.exp(-np.clip(z, -700, 700))) - y))
                slopes[i][-1] += ms[i].sum()
            for c in columns:
                own = [m * c[4] for m in ms]
                for places, _, starts, at, log in _chunks(c, logs):
                    for slope, m in zip(slopes, own, strict=True):
                        slope[places] += np.add.reduceat(m.take(at) * log, starts)
        yield [(loss, slope.tobytes()) for loss, slope in zip(losses, slopes, strict=True)]

    found = slices.mapPartitions(part).collect()
    sent.destroy()
    return [(sum(x[i][0] for x in found), sum((np.frombuffer(x[i][1]) for x in found), np.zeros(len(own)))) for i, (_, _, own) in enumerate(asked)]


Asked = Generator[np.ndarray, tuple[float, np.ndarray], tuple[np.ndarray, int]]


def minimum(f: Callable[[np.ndarray], tuple[float, np.ndarray]], start: np.ndarray, tolerance: float, most: int, memory: int = 10) -> tuple[np.ndarray, int]:
    """L-BFGS for a convex function that gives value and slope: where no part of the slope is over `tolerance`, and the number of steps."""
    return minima(lambda points: {i: f(x) for i, x in points.items()}, [descent(start, tolerance, most, memory)])[0]


def minima(f: Callable[[dict[int, np.ndarray]], dict[int, tuple[float, np.ndarray]]], ways: list[Asked]) -> list[tuple[np.ndarray, int]]:
    """Several descents side by side: `f` gives what all of them that are not done ask for at once."""
    asked, done = {i: next(way) for i, way in enumerate(ways)}, {}
    while asked:
        told, asked = f(asked), {}
        for i, x in told.items():
            try:
                asked[i] = ways[i].send(x)
            except StopIteration as end:
                done[i] = end.value
    return [done[i] for i in range(len(ways))]


def descent(start: np.ndarray, tolerance: float, most: int, memory: int = 10) -> Asked:
    """L-BFGS that yields points, and is sent value and slope of each."""
    x, (value, slope) = start, (yield start)
    pairs: list[tuple[np.ndarray, np.ndarray]] = []
    for step in range(most):
        if np.abs(slope).max() <= tolerance:
            return x, step
        way, turned = slope.copy(), []
        for s, y in reversed(pairs):
            turned.append((s @ way) / (s @ y))
            way -= turned[-1] * y
        if pairs:
            s, y = pairs[-1]
            way *= (s @ y) / (y @ y)
        for (s, y), a in zip(pairs, reversed(turned), strict=True):
            way += (a - (y @ way) / (s @ y)) * s
        down, low, high, t = -(slope @ way), 0.0, np.inf, 1.0
        for _ in range(30):  # a step that goes down enough, and far enough
            at = x - t * way
            found, turn = yield at
            if not found <= value + 1e-4 * t * down:
                high = t
            elif -(turn @ way) < 0.9 * down:
                low = t
            else:
                break
            t = (low + high) / 2 if high < np.inf else 4 * t
        else:
            return (at, step + 1) if found < value else (x, step)
        pairs = [*pairs, (at - x, turn - slope)][-memory:]
        x, value, slope = at, found, turn
    return x, most


def logistic(table: DataFrame, label: str, words: Vocabulary, c: float, most: int, tolerance: float = 1e-4) -> tuple[np.ndarray, int]:
    """Weights (the last is the intercept) of the logistic regression with balanced classes whose penalty is |weights|² / 2 for a loss of c times
    the sum over the rows, and the number of steps."""
    return logistics(table, [label], words, c, most, tolerance)[0]


def logistics(table: DataFrame, labels: list[str], words: Vocabulary, c: float, most: int, tolerance: float = 1e-4) -> list[tuple[np.ndarray, int]]:
    """The same for several labels, whose steps share their passes over the rows."""
    data = table.select("n", *[F.length(F.replace(F.hex(x), F.lit("0"), F.lit(""))).alias(x) for x in labels])
    n, *goods = (x or 0 for x in data.agg(F.sum("n"), *[F.sum(x) for x in labels]).first())
    weights = [tuple(n / (2 * x) if x else 0.0 for x in (n - good, good)) for good in goods]
    totals = [(weight[0] * (n - good) + weight[1] * good) or 1.0 for weight, good in zip(weights, goods, strict=True)]
    idf = np.append(words.idf, 1.0)
    penalties = [np.append(np.full(words.size, 1 / (c * total)), 0.0) for total in totals]

    slices = kept_slices(table, *labels)

    def f(points: dict[int, np.ndarray]) -> dict[int, tuple[float, np.ndarray]]:
        found = losses_and_slopes(slices, [(i, weights[i], x * idf) for i, x in points.items()])
        return {i: (loss / totals[i] + float(penalties[i] @ (x * x)) / 2, slope * idf / totals[i] + penalties[i] * x) for (i, x), (loss, slope) in zip(points.items(), found, strict=True)}

    try:
        return minima(f, [descent(np.zeros(words.size + 1), tolerance, most) for _ in labels])
    finally:
        slices.unpersist()


def scores(df: DataFrame, key: str, words: Vocabulary, models: dict[str, np.ndarray]) -> DataFrame:
    """key, and a score by each model's weights; null for blank texts."""
    sent, own = words.sent, df.sparkSession.sparkContext.broadcast([x * np.append(words.idf, 1.0) for x in models.values()])

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, texts in _slices(batches):
            columns = [_columns(sent.value, k, texts) for k in KINDS]
            blank = ~b.column("some").to_numpy(zero_copy_only=False).astype(bool)
            found = [pa.array(1 / (1 + np.exp(-np.clip(z, -700, 700))), mask=blank) for z in _margins(len(texts), columns, own.value, _logs(columns))]
            yield pa.RecordBatch.from_arrays([b.column("key"), *found], ["key", *models])

    rows = df.select(F.col(key).alias("key"), "text", (F.trim(F.coalesce("text", F.lit(""))) != "").alias("some"), F.monotonically_increasing_id().alias("row_id"))
    kind = df.schema[key].dataType.simpleString()
    return stored(dealt(rows).mapInArrow(part, ", ".join([f"key {kind}", *[f"`{m}` double" for m in models]])).withColumnRenamed("key", key))
