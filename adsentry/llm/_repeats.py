"""Finding repeated windows by anchors: the steps that the exact substring operators share.

Documents are dealt into chunks of some megabytes. Each chunk sends one entry for each distinct pair (anchor string,
tokens around it) to the bucket of the anchor string, never one for each window and never one for each copy. A bucket
thus sees a passage once for each chunk, however often it occurs. All arrays travel as Arrow binary columns.

A chunk sends a row to each bucket that it has entries for: one to a bucket and chunk at most, and never more than it has
entries, so the rows grow in proportion to the text. There are fewer buckets than chunks.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._anchors import Anchors, anchors, gram_hash, join_hash, mix
from ._common import whole_text

CHUNK_BYTES = 8 << 20
BLOCK = 1 << 20  # bytes of text hashed at once
CHUNKS_PER_BUCKET = 2
BLANK = re.compile(rb"[\t-\r ]")
LAST_ID = (1 << 63) - 1  # stands for a null doc_id: later than all others

ENTRIES = "bucket int, chunk int, gram binary, around binary, doc binary"
ANSWERS = "chunk int, bucket int, later binary, unclear binary"
RANGES = "chunk int, doc binary, start binary, stop binary"

_SEED = np.random.default_rng(20240501).integers(1, 1 << 63, 257, dtype=np.uint64)
_BYTE, _POWER = _SEED[:256], _SEED[256] | np.uint64(1)


def chunked(docs: DataFrame, chunk_bytes: int = CHUNK_BYTES) -> tuple[DataFrame, int]:
    """(chunk, id, text) and the number of chunks, which grows with the bytes of text."""
    own = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST_ID)).alias("id"), F.col("doc_id").isNull().alias("no_id"), whole_text().alias("text"))
    size = own.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(8, -(-size // chunk_bytes))
    key = F.when(F.col("no_id"), F.xxhash64("text")).otherwise(F.xxhash64("id"))
    return own.withColumn("chunk", F.pmod(key, F.lit(n)).cast("int")), n


def buckets_for(chunks: int) -> int:
    return max(8, -(-chunks // CHUNKS_PER_BUCKET))


class Chunk:
    """The documents of a chunk, ordered by id and then text, whatever order they came in."""

    def __init__(self, rows: pa.Table):
        ids, texts = rows["id"].to_numpy(), rows["text"].cast(pa.binary()).to_pylist()
        order = sorted(range(len(texts)), key=lambda i: (ids[i], texts[i]))
        self.texts = [texts[i] for i in order]
        self.ids = ids[order].astype(np.int64)
        self.no_id = rows["no_id"].to_numpy(zero_copy_only=False)[order]

    def blocks(self) -> Iterator[tuple[int, list[bytes]]]:
        """Texts of about `BLOCK` bytes together; a text that is longer stands alone."""
        at = 0
        while at < len(self.texts):
            stop, size = at + 1, len(self.texts[at])
            while stop < len(self.texts) and size + len(self.texts[stop]) <= BLOCK:
                size += len(self.texts[stop])
                stop += 1
            yield at, self.texts[at:stop]
            at = stop


def byte_tokens(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Tokens, where each text starts and ends, and the bytes: a token is a byte."""
    data = np.frombuffer(b"".join(texts), np.uint8)
    size = np.fromiter(map(len, texts), np.int64, len(texts))
    ends = np.cumsum(size)
    return _BYTE[data], ends - size, ends, data


_powers: list[np.ndarray] = [np.ones(1, np.uint64)] * 2


def powers(n: int) -> list[np.ndarray]:
    if len(_powers[0]) < n:
        inverse = pow(int(_POWER), -1, 1 << 64)
        for i, base in enumerate((_POWER, np.uint64(inverse))):
            steps = np.full(n, base, np.uint64)
            steps[0] = 1
            _powers[i] = np.multiply.accumulate(steps)
    return _powers


def span_hashes(data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of the bytes `data[begin[i]:end[i]]`."""
    up, down = powers(len(data) + 1)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[data] * up[: len(data)], out=total[1:])
    return mix((total[end] - total[begin]) * down[begin] + (end - begin).astype(np.uint64) * _SEED[0])


def slices(column: pa.Array, size: int = BLOCK) -> Iterator[tuple[int, int]]:
    """(from, to) of consecutive rows of a binary column that hold about `size` bytes; a longer value stands alone."""
    sizes = pa.compute.fill_null(pa.compute.binary_length(column), 0).to_numpy(zero_copy_only=False)
    at = 0
    while at < len(sizes):
        stop, total = at + 1, int(sizes[at])
        while stop < len(sizes) and total + sizes[stop] <= size:
            total += int(sizes[stop])
            stop += 1
        yield at, stop
        at = stop


def word_tokens(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """The same, with words `[^ \\t-\\r]+` as tokens, 64-bit hashes of their bytes; last, the bytes and where words begin and end."""
    data = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    blank = (data == 32) | ((data >= 9) & (data <= 13))
    edge = np.flatnonzero(np.diff(blank.view(np.int8), prepend=np.int8(1)))
    begin, end = edge[::2], edge[1::2]
    tokens = span_hashes(data, begin, end)
    size = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
    stop = np.cumsum(size)
    return tokens, np.searchsorted(begin, stop - size), np.searchsorted(begin, stop), (data, begin, end)


class Found(NamedTuple):
    """Anchors of a whole chunk; positions count from the start of their document."""

    doc: np.ndarray
    first: np.ndarray
    last: np.ndarray
    lo: np.ndarray
    hi: np.ndarray
    entry: np.ndarray  # index among the distinct entries
    gram: np.ndarray  # of each entry
    around: np.ndarray
    leader: np.ndarray  # the occurrence that stands for the entry: the first of the chunk
    bucket: np.ndarray


def cut_at_blanks(text: bytes) -> Iterator[bytes]:
    """A text in parts of about `BLOCK` bytes, cut where a word ends; a longer word stays whole."""
    at = 0
    while at < len(text):
        end = BLANK.search(text, at + BLOCK)
        stop = end.start() if end else len(text)
        yield text[at:stop]
        at = stop


def anchors_of_long(text: bytes, tokens_of: Callable, length: int, gram: int) -> Iterator[Anchors]:
    """The anchors of one long text, part by part; positions count from its start. The tokens of a part are looked at together with
    `margin` tokens before and after, on which an anchor and its surroundings may depend; each anchor counts in the part where
    its first window starts."""
    margin, base, core = 2 * length, 0, 0
    held = np.zeros(0, np.uint64)
    left = len(text)
    for part in cut_at_blanks(text):
        left -= len(part)
        held = np.concatenate([held, tokens_of([part])[0]])
        limit = base + len(held) - (margin if left else 0)
        if limit > core:
            a = anchors(held, np.zeros(1, np.int64), np.array([len(held)]), length, gram)
            own = (a.first + base >= core) & (a.first + base < limit)
            yield Anchors(*(x[own] + base if name in ("pos", "first", "last", "lo", "hi") else x[own] for name, x in zip(Anchors._fields, a, strict=True)))
            core = limit
        drop = max(0, core - margin - base)
        held, base = held[drop:], base + drop


def find(chunk: Chunk, tokens_of: Callable, length: int, gram: int, buckets: int) -> Found:
    parts: list[Anchors] = []
    for at, texts in chunk.blocks():
        if len(texts[0]) > BLOCK:
            parts += [a._replace(doc=a.doc + at) for a in anchors_of_long(texts[0], tokens_of, length, gram)]
            continue
        tokens, starts, ends, _ = tokens_of(texts)
        a = anchors(tokens, starts, ends, length, gram)
        base = starts[a.doc]
        parts.append(a._replace(doc=a.doc + at, first=a.first - base, last=a.last - base, lo=a.lo - base, hi=a.hi - base))
    a = Anchors(*(np.concatenate(x) for x in zip(*parts, strict=True)))
    _, leader, entry = np.unique(join_hash(a.gram, a.around), return_index=True, return_inverse=True)
    grams = a.gram[leader]
    return Found(a.doc, a.first, a.last, a.lo, a.hi, entry, grams, a.around[leader], leader, (grams % np.uint64(buckets)).astype(np.int64))


def by_group(values: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(value, its indexes in ascending order) for each distinct value."""
    order = np.argsort(values, kind="stable")
    cut = np.flatnonzero(np.diff(values[order])) + 1
    for part in np.split(order, cut):
        if len(part):
            yield int(values[part[0]]), part


def send_entries(rows: pa.Table, tokens_of: Callable, length: int, gram: int, buckets: int) -> pa.Table:
    """One row for each bucket: the chunk's distinct entries, each with the id of the first document that has it."""
    chunk = Chunk(rows)
    f = find(chunk, tokens_of, length, gram, buckets)
    ids = chunk.ids[f.doc[f.leader]]
    out = [[], [], [], []]
    for bucket, part in by_group(f.bucket):
        for column, value in zip(out, (bucket, (f.gram[part] >> np.uint64(32)).astype(np.uint32).tobytes(), f.around[part].tobytes(), packed(ids[part])), strict=True):
            column.append(value)
    number = rows["chunk"][0].as_py()
    return pa.table([pa.array(out[0], pa.int32()), pa.array([number] * len(out[0]), pa.int32()), *(pa.array(x, pa.binary()) for x in out[1:])], names=["bucket", "chunk", "gram", "around", "doc"])


def packed(ids: np.ndarray) -> bytes:
    """Whole numbers as eight byte planes, of which the shuffle's compression removes the constant ones."""
    return np.ascontiguousarray(ids.astype("<i8").view(np.uint8).reshape(-1, 8).T).tobytes()


def unpacked(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(8, -1).T).view("<i8").ravel()


def entries_of(rows: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """gram, around, doc and row of all entries of a bucket."""
    gram = [np.frombuffer(x, np.uint32) for x in rows["gram"].to_pylist()]
    around = [np.frombuffer(x, np.uint64) for x in rows["around"].to_pylist()]
    doc = [unpacked(x) for x in rows["doc"].to_pylist()]
    row = np.repeat(np.arange(len(gram)), [len(x) for x in gram])
    return np.concatenate(gram), np.concatenate(around), np.concatenate(doc), row


def judge(gram: np.ndarray, around: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of entries in the order (gram, around, doc): those whose windows all occur in an earlier document; those that have
    to be compared window by window, as their anchor also stands between other tokens; and between how many different ones."""
    n = len(gram)
    if not n:
        return np.zeros(0, bool), np.zeros(0, bool), np.zeros(0, np.int64)
    new_gram = np.r_[True, gram[1:] != gram[:-1]]
    new = new_gram | np.r_[True, around[1:] != around[:-1]]
    begin = np.flatnonzero(new_gram)
    kinds = np.repeat(np.add.reduceat(new.astype(np.int64), begin), np.diff(np.r_[begin, n]))
    later = doc > doc[np.maximum.accumulate(np.where(new, np.arange(n), 0))]
    return later, ~later & (kinds > 1), kinds


def answers(rows: pa.Table, row: np.ndarray, **bits: np.ndarray) -> pa.Table:
    """Named bits of the entries (in the order of `row`) back to the chunks that sent the rows."""
    cut = np.searchsorted(row, np.arange(1, rows.num_rows))
    columns = [pa.array([np.packbits(x).tobytes() for x in np.split(y, cut)], pa.binary()) for y in bits.values()]
    return pa.table([rows["chunk"].combine_chunks(), rows["bucket"].combine_chunks(), *columns], names=["chunk", "bucket", *bits])


def answered(f: Found, rows: pa.Table, *names: str) -> list[np.ndarray]:
    """The bits of all answers to a chunk, for each of its entries; answers of several rounds add up."""
    out = [np.zeros(len(f.gram), bool) for _ in names]
    parts = dict(by_group(f.bucket))
    for bucket, *bits in zip(rows["bucket"].to_pylist(), *(rows[x].to_pylist() for x in names), strict=True):
        part = parts[bucket]
        for sum_, x in zip(out, bits, strict=True):
            sum_[part] |= np.unpackbits(np.frombuffer(x, np.uint8), count=len(part)).astype(bool)
    return out


def merged(doc: np.ndarray, start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The union of ranges, sorted; touching ranges become one."""
    if not len(doc):
        return doc, start, stop
    order = np.lexsort((start, doc))
    doc, start, stop = doc[order].astype(np.int64), start[order].astype(np.int64), stop[order].astype(np.int64)
    span = int(stop.max()) + 2
    reach = np.maximum.accumulate(doc * span + stop)
    new = np.r_[True, (doc * span + start)[1:] > reach[:-1]]
    begin = np.flatnonzero(new)
    return doc[begin], start[begin], reach[np.r_[begin[1:], len(doc)] - 1] - doc[begin] * span


def ranges_table(chunk: int, doc: np.ndarray, start: np.ndarray, stop: np.ndarray) -> list:
    return [chunk, *(x.astype(np.int64).tobytes() for x in merged(doc, start, stop))]


def ranges_of(rows: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    read = lambda name: np.concatenate([np.zeros(0, np.int64), *(np.frombuffer(x, np.int64) for x in rows[name].to_pylist())])
    return merged(read("doc"), read("start"), read("stop"))


def per_document(n: int, ranges: tuple[np.ndarray, np.ndarray, np.ndarray]) -> list[list[tuple[int, int]]]:
    out: list[list[tuple[int, int]]] = [[] for _ in range(n)]
    for d, a, b in zip(*(x.tolist() for x in ranges), strict=True):
        out[d].append((a, b))
    return out


__all__ = [n for n in dir() if not n.startswith("__")] + ["gram_hash"]
