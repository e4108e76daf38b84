"""Byte-level BPE encoding and decoding as a tree reduction.

A text is halved until its parts are short, the parts are encoded by the tokenizer's library, and neighbours are joined up
the tree. Joining encodes a window around the boundary again, which grows on either side until the tokens outside it are
sure to stand in the whole text's encoding as well. A side is sure by one of two rules:

* A *cut* is a place between two neighbouring characters that no match of the pattern spans whatever stands around them: a
  letter, digit or other sign followed by a character of another class, but not an apostrophe followed by a letter. Matching
  has no memory, so beyond a cut all matches are those of the part alone.
* Within a long run of one class, which is one match, the window's outermost token has come out unchanged. A sequence of
  tokens is the encoding of its bytes exactly if each neighbouring pair is the encoding of its own bytes: the first merge over
  a border would also happen in the pair alone. All pairs outside the window are those of the part, so the tokens stay. At
  least `MARGIN` signs of the run lie further out, as an apostrophe before a run may take its first two letters.

Texts of one block are encoded where they are read. Longer ones are cut into blocks of `BLOCK` code points that are dealt to
all tasks, and their tokens are joined `FAN` at a time, level by level; only they are shuffled. Decoding concatenates the
bytes of the tokens in the same way.

The rules hold for `public_tokenizers.PATTERN` and for vocabularies all of whose tokens can be reached by merges. Classes of
characters are those of the library, which is asked for them. The vocabulary is read on the driver and broadcast; its size is
fixed, whatever the corpus.

Nulls: a null text counts as empty and has no ids. Rows with null or repeated ids are encoded like any other; other columns
are ignored, whatever their names; an empty table gives an empty one. Bytes that are no UTF-8 count as U+FFFD.
Memory: ids and text of one batch or document, some 20 bytes for each of its characters.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _repeats as R
from ._common import table, whole_text

RANKS = "byte_bpe_multi_50k.tiktoken"
LEAF = 2048  # code points that the library encodes at once
BLOCK = 1 << 16  # code points of a long text that a task encodes at once
FAN = 16
WINDOW = 6  # tokens on either side of a boundary, to begin with
MARGIN = 3
LONG_SPACE = 10_000  # a run of white space that the library's pattern might not survive
BATCH_BYTES = 1 << 20
LETTER, NUMBER, SPACE, OTHER = range(4)

ENCODED = "doc_id long, ids binary"


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}


def character_classes() -> np.ndarray:
    """The class of each code point, as the library's own patterns see it."""
    import tiktoken

    every = "".join(chr(i) for i in range(0x110000) if not 0xD800 <= i < 0xE000)
    alone = {bytes([i]): i for i in range(256)}
    found = np.full(0x110000, OTHER, np.uint8)
    for kind, pattern in ((LETTER, r"\p{L}"), (NUMBER, r"\p{N}"), (SPACE, r"\s")):
        own = tiktoken.Encoding("class", pat_str=pattern, mergeable_ranks=alone, special_tokens={})
        hits = own.decode_bytes(own.encode_ordinary(every)).decode()
        found[code_points(hits)] = kind
    return found


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), np.uint32)


class Coder:
    """Encodes texts, joins encodings and decodes."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, classes: np.ndarray):
        import tiktoken

        self.library = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.classes = classes
        self.tokens = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            self.tokens[rank] = token
        self.names = [b"%d" % i for i in range(len(self.tokens))]

    def leaf(self, text: str) -> np.ndarray:
        """The library's ids. Long runs of white space are matched here: all of them but the last sign, if anything follows."""
        if len(text) <= LONG_SPACE:
            return np.array(self.library.encode_ordinary(text), np.int32)
        space = np.diff((self.classes[code_points(text)] == SPACE).astype(np.int8), prepend=0, append=0)
        found, at = [], 0
        for begin, end in zip(np.flatnonzero(space == 1).tolist(), np.flatnonzero(space == -1).tolist(), strict=True):
            if end - begin > LONG_SPACE:
                stop = end - (end < len(text))
                found += [self.library.encode_ordinary(text[at:begin]), self.library._core_bpe.encode_single_piece(text[begin:stop].encode())]
                at = stop
        return np.array([i for part in [*found, self.library.encode_ordinary(text[at:])] for i in part], np.int32)

    def encode(self, text: str) -> np.ndarray:
        if len(text) <= LEAF:
            return self.leaf(text)
        half = len(text) // 2
        return self.join(self.encode(text[:half]), self.encode(text[half:]))

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join(b"".join([self.tokens[i] for i in ids[at : at + LEAF].tolist()]) for at in range(0, len(ids), LEAF))

    def join(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The encoding of the text of `left` followed by that of `right`."""
        wide = [WINDOW, WINDOW]
        while len(left) and len(right):
            first, last = self.whole_sign(left, len(left) - wide[0], -1), self.whole_sign(right, wide[1], 1)
            before, after = self.decode(left[first:]).decode(), self.decode(right[:last]).decode()
            points = code_points(before + after)
            kinds = self.classes[points]
            cuts = np.flatnonzero((kinds[:-1] != kinds[1:]) & (kinds[:-1] != SPACE) & ~((points[:-1] == ord("'")) & (kinds[1:] == LETTER))) + 1
            lower, upper = cuts[cuts <= len(before)], cuts[cuts >= len(before)]
            begin = int(lower[-1]) if len(lower) else 0
            end = int(upper[0]) if len(upper) else len(points)
            window = self.leaf((before + after)[begin:end])
            sure = [
                len(lower) > 0 or first == 0 or (window[0] == left[first] and self.in_run(self.signs(left, first, -1), self.sign_count(left[first : first + 1]), kinds)),
                len(upper) > 0 or last == len(right) or (window[-1] == right[last - 1] and self.in_run(self.signs(right, last, 1), self.sign_count(right[last - 1 : last]) + MARGIN, kinds[len(before) :][::-1])),
            ]
            if all(sure):
                head = len(left) - self.token_count(left[first:][::-1], len(before[begin:].encode()))
                tail = self.token_count(right, len((before + after)[len(before) : end].encode()))
                return np.concatenate([left[:head], window, right[tail:]])
            wide = [w if ok else 2 * w for w, ok in zip(wide, sure, strict=True)]
        return np.concatenate([left, right])

    def whole_sign(self, ids: np.ndarray, at: int, step: int) -> int:
        """`at`, moved by `step` until no character lies on both sides of it."""
        at = min(max(at, 0), len(ids))
        while 0 < at < len(ids) and self.tokens[ids[at]][0] & 0xC0 == 0x80:
            at += step
        return at

    def signs(self, ids: np.ndarray, at: int, step: int) -> np.ndarray:
        """Classes of at least `MARGIN` characters beyond `at` (fewer where the text ends), the nearest first."""
        near = self.decode(ids[max(0, at - 4 * MARGIN) : at] if step < 0 else ids[at : at + 4 * MARGIN]).decode(errors="ignore")
        return self.classes[code_points(near)][::step][:MARGIN]

    def sign_count(self, ids: np.ndarray) -> int:
        """How many characters begin in these tokens, and one more."""
        return sum(byte & 0xC0 != 0x80 for byte in self.decode(ids)) + 1

    def in_run(self, outside: np.ndarray, near: int, kinds: np.ndarray) -> bool:
        """Whether `MARGIN` characters outside and the first `near` of `kinds` are there and of one class."""
        run = np.concatenate([outside, kinds[:near]])
        return len(outside) == MARGIN and len(kinds) >= near and bool((run == run[0]).all())

    def token_count(self, ids: np.ndarray, size: int) -> int:
        """How many of the first tokens make up `size` bytes."""
        count = 0
        while size > 0:
            size -= len(self.tokens[ids[count]])
            count += 1
        return count


_coders: dict[str, Coder] = {}


def coder_maker(spark: SparkSession, ranks: str | None) -> Callable[[], Coder]:
    """A function that gives a Python worker its coder, made once."""
    import public_tokenizers

    sent = spark.sparkContext.broadcast((read_ranks(ranks or public_tokenizers.path(RANKS)), public_tokenizers.PATTERN, character_classes()))
    name = uuid.uuid4().hex

    def make() -> Coder:
        if name not in _coders:
            _coders.clear()
            _coders[name] = Coder(*sent.value)
        return _coders[name]

    return make


def text_of(value: bytes) -> str:
    return value.decode("utf-8", "replace")


def encoded_bytes(docs: DataFrame, ranks: str | None = None, block: int = BLOCK) -> DataFrame:
    """doc_id and ids as 32-bit whole numbers, lowest byte first."""
    make = coder_maker(docs.sparkSession, ranks)
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().cast("binary").alias("text"), F.length(whole_text()).alias("size"))

    def short(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = make()
        for b in batches:
            for at, stop in R.slices(b.column("text"), BATCH_BYTES):
                ids = [coder.encode(text_of(x)).tobytes() for x in b.column("text").slice(at, stop - at).to_pylist()]
                yield pa.RecordBatch.from_arrays([b.column("doc_id").slice(at, stop - at), pa.array(ids, pa.binary())], ["doc_id", "ids"])

    plain = own.where(F.col("size") <= block).select("doc_id", "text").mapInArrow(short, ENCODED)
    most = own.agg(F.max("size")).first()[0] or 0
    return plain if most <= block else plain.unionByName(long_texts(own.where(F.col("size") > block), make, block, -(-most // block)))


NODE = "doc_id long, digest string, at int, ids binary"


def long_texts(own: DataFrame, make: Callable[[], Coder], block: int, most: int) -> DataFrame:
    """doc_id and ids of texts of several blocks, `most` at most. A document is named by its id and digest, so equal rows share
    their blocks; they are counted, and the result has as many rows again."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, value in enumerate(b.column("text").to_pylist()):
                text = text_of(value)
                for at in range(0, len(text), block):
                    yield pa.RecordBatch.from_arrays([b.column("doc_id").slice(i, 1), b.column("digest").slice(i, 1), pa.array([at // block], pa.int32()), pa.array([text[at : at + block].encode()], pa.binary())], ["doc_id", "digest", "at", "ids"])

    def leaves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = make()
        for b in batches:
            for i in range(b.num_rows):
                ids = coder.encode(text_of(b.column("ids")[i].as_py())).tobytes()
                yield pa.RecordBatch.from_arrays([*(b.column(c).slice(i, 1) for c in ("doc_id", "digest", "at")), pa.array([ids], pa.binary())], ["doc_id", "digest", "at", "ids"])

    def reduce(rows: pa.Table) -> pa.Table:
        coder, order = make(), np.argsort(rows["at"].to_numpy())
        parts = [np.frombuffer(rows["ids"][int(i)].as_py(), np.int32) for i in order]
        while len(parts) > 1:
            parts = [coder.join(*parts[k : k + 2]) if k + 1 < len(parts) else parts[k] for k in range(0, len(parts), 2)]
        return pa.table([rows["doc_id"][:1], rows["digest"][:1], pa.array([int(rows["at"][0].as_py()) // FAN], pa.int32()), pa.array([parts[0].tobytes()], pa.binary())], names=["doc_id", "digest", "at", "ids"])

    named = own.withColumn("digest", F.sha2("text", 256))
    copies = named.groupBy("doc_id", "digest").agg(F.count("*").alias("copies"))
    once = named.groupBy("doc_id", "digest").agg(F.any_value("text").alias("text"))
    nodes = once.mapInArrow(cut, NODE).repartition("doc_id", "digest", "at").mapInArrow(leaves, NODE)
    while most > 1:
        nodes = nodes.groupBy("doc_id", "digest", F.expr(f"at div {FAN}")).applyInArrow(reduce, NODE)
        most = -(-most // FAN)
    whole = nodes.join(copies, (nodes.doc_id.eqNullSafe(copies.doc_id)) & (nodes.digest == copies.digest)).select(nodes.doc_id, "ids", "copies")
    return whole.select("doc_id", "ids", F.explode(F.expr("sequence(1L, copies)"))).select("doc_id", "ids")


def encoded(docs: DataFrame, ranks: str | None = None) -> DataFrame:
    """doc_id and ids, as the tokenizer's library gives them."""

    def lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = pa.array([np.frombuffer(x, np.int32) for x in b.column("ids").to_pylist()], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), ids], ["doc_id", "ids"])

    return encoded_bytes(docs, ranks).mapInArrow(lists, "doc_id long, ids array<int>")


def decoded(rows: DataFrame, ranks: str | None = None) -> DataFrame:
    """doc_id and the bytes of rows with doc_id and ids (array); null ids count as none."""
    make = coder_maker(rows.sparkSession, ranks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            text = [make().decode(np.array(x or [], np.int32)) for x in b.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(text, pa.binary())], ["doc_id", "bytes"])

    return rows.select(F.col("doc_id").cast("long").alias("doc_id"), "ids").mapInArrow(run, "doc_id long, bytes binary")


def digests(rows: DataFrame, ranks: str | None = None) -> DataFrame:
    """Of the rows of `encoded_bytes`: how many ids, the digest of the ids, and that of the bytes that they decode to."""
    make = coder_maker(rows.sparkSession, ranks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = make()
        for b in batches:
            out: list[tuple[int, str, str]] = []
            for value in b.column("ids").to_pylist():
                ids = np.frombuffer(value, np.int32)
                listed = b",".join([coder.names[i] for i in ids.tolist()])
                out.append((len(ids), hashlib.sha256(listed).hexdigest(), hashlib.sha256(coder.decode(ids)).hexdigest()))
            n, listed, text = zip(*out, strict=True) if out else ((), (), ())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n, pa.int64()), pa.array(listed, pa.string()), pa.array(text, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return rows.mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op11_byte_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(encoded_bytes(table(spark, sf_dir, "documents")))


QUERIES = {"op11_byte_pairs": op11_byte_pairs}
