"""SentencePiece encoding and decoding by suffix-array matching.

The texts of a batch are laid end to end and cut into units (spaces, then what follows them), which no piece crosses. The
distinct units that the task has not met yet are indexed by a suffix array; a binary search gives the range of suffixes
that start with each piece of the vocabulary, so all occurrences of all pieces come out at once. Sorted by position,
these are the edges of the lattice. A place that no edge covers parts a unit in two. Relaxing the edges gives the ids: of
the edges that join two neighbouring symbols, the one with the best score is taken, the leftmost on a tie, until none is
left. That is what the model's byte-pair merging prescribes, so ids equal those of the model's own library. Characters
without a piece become their UTF-8 bytes.

Decoding joins the pieces' bytes; it gives back every text that has no U+2581, which stands for the space. Units are
recognised by 64-bit hashes, so each batch is decoded and compared with its bytes; a text that differs is encoded again
without what was remembered, and `round_trip` says whether the second result decodes to the text.

Memory: a text longer than `PART_BYTES` is encoded part by part, cut between units; `CACHE_BYTES` bounds what a task
remembers. One unit without any uncovered place needs about 300 bytes of memory for each of its characters.

Nulls: a null text counts as empty and has no ids. Rows with null or repeated ids are encoded like any other, and an empty
table gives an empty one. The model file is read on the driver only. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import heapq
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _repeats as R
from ._common import table, whole_text

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
CACHE_BYTES = 24 << 20
PART_BYTES = 1 << 20
INDEX_CHARS = 250_000
LONG_RUN = 64
ENCODED = "doc_id long, ids array<int>, round_trip boolean"


class Vocabulary:
    """Pieces, scores and bytes of a model, to be sent to tasks."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        ids = range(model.get_piece_size())
        special = {i for i in ids if model.is_control(i) or model.is_unknown(i) or model.is_unused(i) or model.is_byte(i)}
        pieces = {model.id_to_piece(i): i for i in ids if i not in special}
        if any(SPACE in p.lstrip(SPACE) for p in pieces):
            raise ValueError("a piece of this model goes on after a space, so texts cannot be cut there")
        self.scores = np.array([model.get_score(i) for i in ids])
        self.rank = np.unique(-self.scores, return_inverse=True)[1]
        self.byte_ids = {int(model.id_to_piece(i)[1:-1], 16): i for i in ids if model.is_byte(i)}
        self.unknown = model.unk_id()
        raw = {i: bytes([b]) for b, i in self.byte_ids.items()} | {i: p.replace(SPACE, " ").encode() for p, i in pieces.items()}
        raw = [raw.get(i, b"") for i in ids]
        self.raw = np.frombuffer(b"".join(raw), np.uint8)
        self.raw_size = np.array([len(x) for x in raw], np.int32)
        self.raw_start = (np.cumsum(self.raw_size) - self.raw_size).astype(np.int32)
        self.width = max(map(len, pieces), default=2)
        self.width += -self.width % 8  # whole 8-byte keys
        single = sorted((ord(p), i) for p, i in pieces.items() if len(p) == 1)
        self.single, self.single_ids = (np.array(x) for x in zip(*single, strict=True))
        joined = set("".join(p for p in pieces if len(p) > 1))
        self.lone = np.zeros(256, bool)  # bytes that are units of their own
        self.lone[[ord(c) for c in "\0\t\n\r" if c not in joined]] = True
        if not self.lone[0]:
            raise ValueError("a piece of this model holds the character 0, which parts units in the index")
        by_length: dict[int, list] = {}
        for p, i in pieces.items():
            if len(p) > 1:
                by_length.setdefault(len(p), []).append(([ord(c) for c in p], i))
        self.by_length = {n: (np.array([p for p, _ in x], np.uint32), np.array([i for _, i in x], np.int32)) for n, x in sorted(by_length.items())}


def suffix_array(codes: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Places in the order of the `width` characters from there on, and these as byte strings."""
    codes = codes.astype(">u2" if len(codes) and codes.max() > 255 else np.uint8)
    raw = np.concatenate([codes, np.zeros(width, codes.dtype)]).view(np.uint8)
    step = codes.dtype.itemsize
    suffixes = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(raw, width * step)[: len(codes) * step : step])
    keys = suffixes.view(">u8").astype(np.uint64)
    order = np.lexsort(keys.T[::-1])
    return order, suffixes[order]


def occurrences(points: np.ndarray, vocabulary: Vocabulary) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(position, length, id) of every occurrence of every piece of two characters or more."""
    width = vocabulary.width
    alphabet, codes = np.unique(points, return_inverse=True)
    order, suffixes = suffix_array(codes, width)
    step = suffixes.shape[1] // width
    at, size, found = [], [], []
    for n, (pieces, ids) in vocabulary.by_length.items():
        code = np.searchsorted(alphabet, pieces).clip(0, len(alphabet) - 1)
        usable = (alphabet[code] == pieces).all(axis=1)
        if not usable.any():
            continue
        wanted = np.ascontiguousarray(code[usable].astype(">u2" if step == 2 else np.uint8)).view(f"S{n * step}").ravel()
        cut = np.ascontiguousarray(suffixes[:, : n * step]).view(f"S{n * step}").ravel()
        low, high = np.searchsorted(cut, wanted), np.searchsorted(cut, wanted, side="right")
        times = high - low
        of = np.repeat(np.arange(len(wanted)), times)
        at.append(order[low[of] + np.arange(len(of)) - np.repeat(np.cumsum(times) - times, times)])
        size.append(np.full(len(of), n, np.int64))
        found.append(ids[usable][of])
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *at]), np.concatenate([none, *size]), np.concatenate([none.astype(np.int32), *found])


class Edges:
    """The occurrences of all pieces in some units, each of which ends with a 0, sorted by position and then length."""

    def __init__(self, points: np.ndarray, vocabulary: Vocabulary):
        self.stride = vocabulary.width + 1
        keys, ids = [], []
        for a in range(0, len(points), INDEX_CHARS):
            at, size, found = occurrences(points[a : a + INDEX_CHARS + vocabulary.width], vocabulary)
            mine = at < INDEX_CHARS
            keys.append((at[mine] + a) * self.stride + size[mine])
            ids.append(found[mine])
        keys, ids = np.concatenate(keys), np.concatenate(ids)
        order = np.argsort(keys)
        self.keys, self.ids = keys[order], ids[order]

    def find(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """The ids of the edges from `start` to `end`; -1 where there is none."""
        size = end - start
        key = start * self.stride + np.minimum(size, self.stride - 1)
        place = np.searchsorted(self.keys, key).clip(0, max(len(self.keys) - 1, 0))
        if not len(self.keys):
            return np.full(len(start), -1, np.int32)
        return np.where((self.keys[place] == key) & (size < self.stride), self.ids[place], -1)

    def runs(self, points: np.ndarray) -> np.ndarray:
        """The number of the run that each position belongs to: no edge joins two runs."""
        at, size = self.keys // self.stride, self.keys % self.stride
        covered = np.bincount(at + 1, minlength=len(points) + 1) - np.bincount(at + size, minlength=len(points) + 1)
        return np.cumsum(np.cumsum(covered[:-1]) == 0)


def relax(start: np.ndarray, run: np.ndarray, edges: Edges, vocabulary: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """Where the symbols of all runs start and end after relaxing; one edge of each run is taken in each round."""
    end, scores = start + 1, vocabulary.scores
    done: list[tuple[np.ndarray, np.ndarray]] = [(start[:0], end[:0])]
    edge = np.full(len(start), -1, np.int32)
    near = np.flatnonzero(run[1:] == run[:-1])
    edge[near] = edges.find(start[near], end[near + 1])
    while len(start):
        score = np.where(edge >= 0, scores[edge], -np.inf)
        head = np.flatnonzero(np.r_[True, run[1:] != run[:-1]])
        best = np.maximum.reduceat(score, head)
        of = np.repeat(np.arange(len(head)), np.diff(np.r_[head, len(start)]))
        going = np.isfinite(best)[of]
        done.append((start[~going], end[~going]))
        place = np.flatnonzero(going & (score == best[of]))
        place = place[np.r_[True, of[place[1:]] != of[place[:-1]]]] if len(place) else place  # the leftmost of each run
        end[place] = end[place + 1]
        stale = np.zeros(len(start), bool)
        stale[place] = stale[np.maximum(place - 1, 0)] = True
        going[place + 1] = False
        start, end, run, edge, stale = start[going], end[going], run[going], edge[going], stale[going]
        edge[stale] = -1
        near = np.flatnonzero(stale[:-1] & (run[1:] == run[:-1]))
        edge[near] = edges.find(start[near], end[near + 1])
    start, end = (np.concatenate(x) for x in zip(*done, strict=True))
    order = np.argsort(start)
    return start[order], end[order]


def relax_long(first: int, last: int, edges: Edges, vocabulary: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """The same for one long run, with a heap instead of rounds."""
    n, stride, rank = last - first, edges.stride, vocabulary.rank
    after, before, alive = np.arange(1, n + 1, dtype=np.int32), np.arange(-1, n - 1, dtype=np.int32), np.ones(n, bool)
    low, high = np.searchsorted(edges.keys, [first * stride, last * stride])
    keys, ids = memoryview(edges.keys[low:high] - first * stride), edges.ids[low:high]
    nexts, befores = memoryview(after), memoryview(before)
    heap: list[int] = []

    def offer(a: int, b: int) -> None:
        if a >= 0 and b < n and (size := nexts[b] - a) < stride:
            key = a * stride + size
            i = bisect_left(keys, key)
            if i < len(keys) and keys[i] == key:
                heapq.heappush(heap, int(rank[ids[i]]) << 42 | a << 8 | size)

    for a in range(n - 1):
        offer(a, a + 1)
    while heap:
        top = heapq.heappop(heap)
        a, size = top >> 8 & ((1 << 34) - 1), top & 255
        b = nexts[a]
        if alive[a] and b < n and nexts[b] - a == size:
            alive[b], nexts[a] = False, a + size
            if a + size < n:
                befores[a + size] = a
            offer(befores[a], a)
            offer(a, a + size)
    start = np.flatnonzero(alive)
    return start + first, after[start].astype(np.int64) + first


class Encoder:
    """Encodes batches of texts; remembers the units of earlier batches, up to a bound.

    known: the sorted hashes of the units; the ids of unit i are the `count[i]` from `ids[first[i]]` on."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary
        self.forget()

    def forget(self) -> None:
        self.known, self.first, self.count, self.ids = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32)

    def symbol_ids(self, points: np.ndarray, edges: Edges, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of symbols, and how many each has: one, or for a character without a piece its bytes."""
        v = self.vocabulary
        ids = edges.find(start, end)
        one = np.flatnonzero(end - start == 1)
        c = points[start[one]]
        place = np.searchsorted(v.single, c).clip(0, len(v.single) - 1)
        ids[one] = np.where(v.single[place] == c, v.single_ids[place], -1)
        counts = np.ones(len(ids), np.int64)
        rare = np.flatnonzero(ids < 0)
        if len(rare):
            more = [[v.byte_ids.get(x, v.unknown) for x in chr(c).encode()] for c in points[start[rare]].tolist()]
            counts[rare] = [len(x) for x in more]
            ids = np.repeat(ids, counts)
            ids[ids < 0] = [i for x in more for i in x]
        return ids, counts

    def learn(self, hashes: np.ndarray, units: list[bytes]) -> None:
        """Takes in distinct units, in the order of their hashes."""
        points = np.frombuffer((b"\1".join(units) + b"\1").decode().replace(" ", SPACE).encode("utf-32-le"), np.uint32).copy()
        size = np.fromiter((len(u.decode()) for u in units), np.int64, len(units)) + 1
        stop = np.cumsum(size) - 1
        lone = np.flatnonzero((size == 2) & (points[stop - 1] == 0))  # the unit that is the character 0
        points[stop] = 0
        edges = Edges(points, self.vocabulary)
        run = edges.runs(points)
        inside = np.ones(len(points), bool)
        inside[stop] = False
        start = np.flatnonzero(inside)
        run = run[start]
        head = np.flatnonzero(np.r_[True, run[1:] != run[:-1]])
        length = np.diff(np.r_[head, len(run)])
        long = np.repeat(length > LONG_RUN, length)
        found = [relax(start[~long], run[~long], edges, self.vocabulary)]
        found += [relax_long(int(start[h]), int(start[h]) + int(n), edges, self.vocabulary) for h, n in zip(head[length > LONG_RUN], length[length > LONG_RUN], strict=True)]
        start, end = (np.concatenate(x) for x in zip(*found, strict=True))
        order = np.argsort(start)
        start, end = start[order], end[order]
        points[stop[lone] - 1] = 0
        ids, counts = self.symbol_ids(points, edges, start, end)
        count = np.add.reduceat(counts, np.searchsorted(start, stop - size + 1))
        place = np.searchsorted(self.known, hashes)
        self.known, self.count = np.insert(self.known, place, hashes), np.insert(self.count, place, count)
        self.first = np.insert(self.first, place, len(self.ids) + np.cumsum(count) - count)
        self.ids = np.concatenate([self.ids, ids.astype(np.int32)])

    def encode(self, data: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the texts that begin at `begins`, one after another, and how many each has."""
        if self.known.nbytes * 3 + self.ids.nbytes > CACHE_BYTES:
            self.forget()
        at = unit_starts(data, begins, self.vocabulary)
        hashes = R.span_hashes(data, at, np.r_[at[1:], len(data)])
        distinct, example, which = np.unique(hashes, return_index=True, return_inverse=True)
        place = np.searchsorted(self.known, distinct)
        missing = np.ones(len(distinct), bool)
        if len(self.known):
            missing = self.known[place.clip(0, len(self.known) - 1)] != distinct
        new = np.flatnonzero(missing)
        ends = np.r_[at[1:], len(data)]
        sizes = ends[example[new]] - at[example[new]]
        share = np.cumsum(sizes + 1) // INDEX_CHARS
        for part in np.split(new, np.flatnonzero(np.diff(share)) + 1) if len(new) else ():
            self.learn(distinct[part], [data[at[i] : ends[i]].tobytes() for i in example[part]])
        row = np.searchsorted(self.known, distinct)[which]
        count = self.count[row]
        total = np.r_[0, np.cumsum(count)]
        ids = self.ids[np.arange(total[-1]) + np.repeat(self.first[row] - total[:-1], count)]
        return ids, np.diff(total[np.r_[np.searchsorted(at, begins), len(at)]])


def unit_starts(data: np.ndarray, begins: np.ndarray, vocabulary: Vocabulary) -> np.ndarray:
    space, lone = data == 32, vocabulary.lone[data]
    start = space | lone
    start[1:] &= ~space[:-1] | lone[1:]
    start[1:] |= lone[:-1]
    start[begins] = True
    return np.flatnonzero(start)


def decoded_bytes(ids: np.ndarray, vocabulary: Vocabulary) -> np.ndarray:
    size = vocabulary.raw_size[ids].astype(np.int64)
    shift = np.cumsum(size) - size
    return vocabulary.raw[np.arange(size.sum()) + np.repeat(vocabulary.raw_start[ids] - shift, size)]


def encode_texts(texts: list[bytes], encoder: Encoder) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The ids of all texts, how many each has, and whether they decode to the text."""
    v, counts, same = encoder.vocabulary, np.zeros(len(texts), np.int64), np.ones(len(texts), bool)
    full = [i for i, t in enumerate(texts) if t]
    if not full:
        return np.zeros(0, np.int32), counts, same
    data = np.frombuffer(b"".join([b" " + texts[i] for i in full]), np.uint8)
    size = np.array([len(texts[i]) + 1 for i in full])
    ids, counts[full] = encoder.encode(data, np.cumsum(size) - size)
    if not np.array_equal(decoded_bytes(ids, v), data):
        parts = np.split(ids, np.cumsum(counts)[:-1])
        for i in full:
            if decoded_bytes(parts[i], v).tobytes() != b" " + texts[i]:
                own = np.frombuffer(b" " + texts[i], np.uint8)
                parts[i] = Encoder(v).encode(own, np.zeros(1, np.int64))[0]
                counts[i], same[i] = len(parts[i]), np.array_equal(decoded_bytes(parts[i], v), own)
        ids = np.concatenate(parts)
    return ids, counts, same


def parts_of(text: bytes) -> Iterator[bytes]:
    """A long text, cut before the space that ends a word; the space itself is left out, as every part is given one."""
    at = 0
    while len(text) - at > PART_BYTES:
        cut = at + PART_BYTES
        while (cut := text.find(b" ", cut)) >= 0 and (text[cut - 1] == 32 or text[cut + 1 : cut + 2] == b" "):
            cut += 1
        if cut < 0:
            break
        yield text[at:cut]
        at = cut + 1
    yield text[at:]


def encode_long(text: bytes, encoder: Encoder) -> tuple[np.ndarray, bool]:
    found, same = [], True
    for part in parts_of(text):
        if part:
            ids, _, ok = encode_texts([part], encoder)
        else:  # a last space of its own
            ids, ok = encoder.encode(np.array([32], np.uint8), np.zeros(1, np.int64))[0], np.ones(1, bool)
        found.append(ids)
        same = same and bool(ok.all())
    return np.concatenate(found), same


def encoded(docs: DataFrame, model: str = MODEL) -> DataFrame:
    """doc_id, ids, and whether decoding the ids gives the text again (with U+2581 as a space)."""
    sent = docs.sparkSession.sparkContext.broadcast(Vocabulary(model))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(sent.value)
        for b in batches:
            column = b.column("text").cast(pa.binary())
            for at, stop in R.slices(column, PART_BYTES):
                texts = [x.replace(SPACE.encode(), b" ") for x in column.slice(at, stop - at).to_pylist()]
                if len(texts) == 1 and len(texts[0]) > PART_BYTES:
                    ids, ok = encode_long(texts[0], encoder)
                    counts, same = np.array([len(ids)]), np.array([ok])
                else:
                    ids, counts, same = encode_texts(texts, encoder)
                lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(counts)].astype(np.int32)), pa.array(ids))
                yield pa.RecordBatch.from_arrays([b.column("doc_id").slice(at, stop - at), lists, pa.array(same)], ["doc_id", "ids", "round_trip"])

    return docs.select(F.col("doc_id").cast("long"), whole_text().alias("text")).mapInArrow(run, ENCODED)


def decoded(rows: DataFrame, model: str = MODEL) -> DataFrame:
    """doc_id and text of rows with doc_id and ids; null ids count as none."""
    sent = rows.sparkSession.sparkContext.broadcast(Vocabulary(model))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [decoded_bytes(np.array(ids or [], np.int64), sent.value).tobytes()[1:].decode("utf-8", "replace") for ids in b.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])

    return rows.select(F.col("doc_id").cast("long"), "ids").mapInArrow(run, "doc_id long, text string")


def op5_suffix_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoded(table(spark, sf_dir, "documents")).withColumn("n_ids", F.size("ids").cast("long"))


QUERIES = {"op5_suffix_pieces": op5_suffix_pieces}
