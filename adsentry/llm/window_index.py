"""Substring dedup by a log-structured fingerprint index: word windows that occurred before go, batch by batch.

The index holds sorted immutable runs of fingerprints of the windows seen so far. A fingerprint is the hash of a
window's anchor string with the hash of the words around it (see ``_anchors``): equal windows always share the anchor,
so looking up anchors misses none, at a seventh of the size. `ingest` merge-joins one sorted batch with all runs of a
bucket, writes the new fingerprints as one more run, and notes which documents have to be compared window by window; every
`FANOUT` runs of a level are merged into one run of the next level. `resolve` verifies what was noted by the words
themselves, taken from the texts again, and returns the ranges of words that go. What was ingested first stays.

A manifest beside the runs is written last in each step. An index opened on a folder that has one goes on from there: it
takes its parameters from it, and chunks of a later batch are numbered from `chunks` on.

Surroundings count as equal if the anchor's hash (32 bits and the bucket) and a 64-bit hash of all words around it agree;
over 100 TB, any two are mistaken for one another with a probability of about 1e-11. Windows of anchors that stand between
different words are compared word by word.

Nulls: a null text has no words; rows with a null doc_id come last, in an order of their own, and rows with the same
doc_id follow one another in the order of their texts, so of repeated rows the second loses its windows. An empty table
gives an empty one. A long text is hashed in one go and needs some 60 bytes of memory for each of its bytes. Other columns
are ignored, whatever their names.
"""

from __future__ import annotations

import json

import numpy as np
import pyarrow as pa
import pyarrow.compute
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _repeats as R
from ._common import new_path, table, whole_text
from .substring_dedup import rows_table

LENGTH = 20
GRAM = 8
BATCHES = 3
FANOUT = 2
RUN = "bucket int, gram binary, around binary, owner binary"
STEP = "kind string, bucket int, chunk int, later binary, unclear binary, gram binary, around binary, owner binary"
ANSWER = "chunk int, bucket int, later binary, unclear binary, gram binary, around binary"
MOVED = "dest int, chunk int, doc binary, start binary, stop binary, id binary, size binary, words binary"
hash_of = xxhash.xxh3_64_intdigest


def batched(docs: DataFrame, batches: int, chunk_bytes: int = R.CHUNK_BYTES) -> tuple[DataFrame, int]:
    """(batch, chunk, id, no_id, text): batches are ranges of doc_id, and a chunk belongs to one batch."""
    own = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(R.LAST_ID)).alias("id"), F.col("doc_id").isNull().alias("no_id"), whole_text().alias("text"))
    cuts = [(i + 1) / batches for i in range(batches - 1)]
    size, bounds = own.agg(F.sum(F.octet_length("text")), F.percentile_approx("id", cuts or [0.5], 1000)).first()
    n = max(8, -(-(size or 0) // chunk_bytes // batches))
    batch = sum(((F.col("id") > b).cast("int") for b in (bounds or []) if cuts), F.lit(0))
    key = F.when(F.col("no_id"), F.xxhash64("text")).otherwise(F.xxhash64("id"))
    return own.withColumn("batch", batch).withColumn("chunk", (F.col("batch") * n + F.pmod(key, F.lit(n))).cast("int")), n * batches


class WindowIndex:
    """An index in a shared folder. `levels` lists the live runs, newest last."""

    def __init__(self, spark: SparkSession, path: str | None = None, buckets: int = 64, length: int = LENGTH, gram: int = GRAM):
        self.spark, self.path, self.buckets, self.length, self.gram = spark, path or new_path(spark), buckets, length, gram
        self.levels: list[list[int]] = []  # of each live run, its level and the step that wrote it
        self.steps = self.chunks = 0
        self.dealt = 2  # windows to verify are dealt to so many times the buckets
        if written := self.manifests():
            found = json.loads(spark.read.text(f"{self.path}/_manifest/{max(written)}").first().value)
            self.levels, self.steps, self.chunks, self.buckets, self.length, self.gram = (found[k] for k in ("levels", "steps", "chunks", "buckets", "length", "gram"))

    def folder(self, name: str):
        place = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return place.getFileSystem(self.spark._jsc.hadoopConfiguration()), place

    def manifests(self) -> list[int]:
        """The numbers of the manifests that were written to the end."""
        files, place = self.folder("_manifest")
        if not files.exists(place):
            return []
        return [int(x.getPath().getName()) for x in files.listStatus(place) if files.exists(self.folder(f"_manifest/{x.getPath().getName()}/_SUCCESS")[1])]

    def commit(self) -> None:
        state = json.dumps({k: getattr(self, k) for k in ("levels", "steps", "chunks", "buckets", "length", "gram")})
        self.spark.createDataFrame([(state,)], "value string").coalesce(1).write.mode("overwrite").text(f"{self.path}/_manifest/{self.steps}")

    def read(self, kind: str, schema: str, steps: list[int]) -> DataFrame:
        """The rows of a kind that some steps wrote; only their folders are read."""
        rows = self.spark.read.schema(f"{schema}, step int, kind string").parquet(self.path)
        return rows.filter((F.col("kind") == kind) & F.col("step").isin(steps)).drop("step", "kind")

    def write(self, rows: DataFrame) -> int:
        self.steps += 1
        rows.write.mode("overwrite").partitionBy("kind").parquet(f"{self.path}/step={self.steps}")
        return self.steps

    def runs(self) -> DataFrame:
        return self.read("run", RUN, [s for _, s in self.levels]) if self.levels else self.spark.createDataFrame([], RUN)

    def ingest(self, batch: DataFrame) -> None:
        """Merges a batch (chunk, id, no_id, text) with the runs; writes its new fingerprints and the answers."""
        length, gram, buckets = self.length, self.gram, self.buckets

        def entries(rows: pa.Table) -> pa.Table:
            return R.send_entries(rows, R.word_tokens, length, gram, buckets)

        sent = batch.groupBy("chunk").applyInArrow(entries, R.ENTRIES)
        merged = sent.groupBy("bucket").cogroup(self.runs().groupBy("bucket")).applyInArrow(merge_join, STEP)
        self.levels.append([0, self.write(merged)])
        self.chunks = max(self.chunks, 1 + (batch.agg(F.max("chunk")).first()[0] or 0))
        self.commit()
        self.compact()

    def compact(self) -> None:
        while len(self.levels) >= FANOUT and len({x for x, _ in self.levels[-FANOUT:]}) == 1:
            old, level = [s for _, s in self.levels[-FANOUT:]], self.levels[-1][0]
            merged = self.read("run", RUN, old).groupBy("bucket").applyInArrow(merge_runs, RUN)
            self.levels[-FANOUT:] = [[level + 1, self.write(merged.withColumn("kind", F.lit("run")))]]
            self.commit()
            for step in old:
                files, place = self.folder(f"step={step}/kind=run")
                files.delete(place, True)

    def unclear_windows(self, docs: DataFrame) -> DataFrame:
        """The ranges of words that go for sure, and the windows to verify, dealt by the hash of the whole window."""
        length, gram, buckets, dealt = self.length, self.gram, self.buckets, self.dealt * self.buckets
        said = self.read("answer", ANSWER, list(range(1, self.steps + 1)))

        def windows(rows: pa.Table, said: pa.Table) -> pa.Table:
            return windows_to_verify(rows, said, length, gram, buckets, dealt)

        return docs.groupBy("chunk").cogroup(said.groupBy("chunk")).applyInArrow(windows, MOVED)

    def resolve(self, docs: DataFrame) -> DataFrame:
        """chunk, doc, start, stop: the ranges of words that go, of all documents ingested."""
        length = self.length

        def verify(rows: pa.Table) -> pa.Table:
            return later_windows(rows, length)

        return self.unclear_windows(docs).groupBy("dest").applyInArrow(verify, R.RANGES)


def sort_keys(gram: np.ndarray, around: np.ndarray) -> np.ndarray:
    """Fingerprints as byte strings, which compare like (gram, around)."""
    out = np.empty((len(gram), 12), np.uint8)
    out[:, :4] = gram.astype(">u4").view(np.uint8).reshape(-1, 4)
    out[:, 4:] = around.astype(">u8").view(np.uint8).reshape(-1, 8)
    return out.view("S12").ravel()


def merge_order(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """The places of two sorted arrays, the second's counted on from the first's, in the order of both; on a tie the first
    one's stand before."""
    order = np.empty(len(first) + len(second), np.int64)
    place = np.searchsorted(first, second, side="right") + np.arange(len(second))
    of_first = np.ones(len(order), bool)
    of_first[place] = False
    order[place], order[of_first] = len(first) + np.arange(len(second)), np.arange(len(first))
    return order


def merged_runs(rows: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """gram, around and owner of the sorted runs of a bucket, merged two by two."""
    read = lambda name, kind: [np.frombuffer(x, kind) for x in rows[name].to_pylist()]
    runs = list(zip(read("gram", np.uint32), read("around", np.uint64), read("owner", np.int32), strict=True))
    while len(runs) > 1:
        a, b = runs.pop(0), runs.pop(0)
        order = merge_order(sort_keys(*a[:2]), sort_keys(*b[:2]))
        runs.append(tuple(np.concatenate(x)[order] for x in zip(a, b, strict=True)))
    return runs[0] if runs else (np.zeros(0, np.uint32), np.zeros(0, np.uint64), np.zeros(0, np.int32))


def merge_runs(rows: pa.Table) -> pa.Table:
    """Some sorted runs of a bucket as one."""
    return rows_table([[rows["bucket"][0].as_py(), *(x.tobytes() for x in merged_runs(rows))]], RUN)


def merge_join(new: pa.Table, runs: pa.Table) -> pa.Table:
    """A bucket's new entries against its runs: answers to the chunks that sent or own them, and the new run."""
    if not new.num_rows:
        return rows_table([], STEP)
    bucket = new["bucket"][0].as_py()
    gram, around, doc, row = R.entries_of(new)
    chunk = new["chunk"].to_numpy().astype(np.int32)[row]
    sort = np.lexsort((chunk, doc, around, gram))
    gram, around, chunk, row = gram[sort], around[sort], chunk[sort], row[sort]
    old_gram, old_around, old_chunk = merged_runs(runs)
    n, m = len(gram), len(old_gram)
    # in each group of equal fingerprints the old one stands first, then the smallest document
    order = (merge_order(sort_keys(old_gram, old_around), sort_keys(gram, around)) + n) % (n + m)
    every_gram, every_around, past = np.concatenate([gram, old_gram]), np.concatenate([around, old_around]), np.arange(n + m) >= n
    later, unclear = np.zeros(n + m, bool), np.zeros(n + m, bool)
    later[order], unclear[order], _ = R.judge(every_gram[order], every_around[order], np.arange(n + m))
    back = np.argsort(sort)
    said = R.answers(new, row[back], later=later[:n][back], unclear=unclear[:n][back])
    out = [["answer", bucket, c, a, b, None, None, None] for c, _, a, b in zip(*(x.to_pylist() for x in said.columns), strict=True)]
    fresh = order[~past[order] & ~later[order]]
    # old entries whose anchor now also stands between other words
    touched = np.isin(old_gram, gram[fresh[fresh < n]]) & unclear[n:]
    ask = np.flatnonzero(touched)
    for owner, part in R.by_group(old_chunk[ask]) if len(ask) else ():
        out.append(["answer", bucket, owner, None, None, old_gram[ask[part]].tobytes(), old_around[ask[part]].tobytes(), None])
    out.append(["run", bucket, None, None, None, gram[fresh].tobytes(), around[fresh].tobytes(), chunk[fresh].tobytes()])
    return rows_table(out, STEP)


def windows_to_verify(rows: pa.Table, said: pa.Table, length: int, gram: int, buckets: int, dealt: int) -> pa.Table:
    out: list[list] = []
    if not rows.num_rows:
        return rows_table(out, MOVED)
    chunk, number = R.Chunk(rows), rows["chunk"][0].as_py()
    f = R.find(chunk, R.word_tokens, length, gram, buckets)
    asked = pa.compute.is_valid(said["gram"])
    later, unclear = R.answered(f, said.filter(pa.compute.invert(asked)), "later", "unclear")
    parts = dict(R.by_group(f.bucket))
    high = (f.gram >> np.uint64(32)).astype(np.uint32)
    more = said.filter(asked)
    for bucket, g, around in zip(more["bucket"].to_pylist(), more["gram"].to_pylist(), more["around"].to_pylist(), strict=True):
        part = parts[bucket]
        both = [np.rec.fromarrays(x, names="g,a") for x in ((high[part], f.around[part]), (np.frombuffer(g, np.uint32), np.frombuffer(around, np.uint64)))]
        unclear[part] |= np.isin(both[0], both[1])
    # all occurrences but the entry's first, and that one too if it came later than another chunk's
    repeat = later[f.entry] | (np.arange(len(f.doc)) != f.leader[f.entry])
    ask = np.flatnonzero(unclear & ~later)
    o = f.leader[ask]
    times = f.last[o] - f.first[o] + 1
    of = np.repeat(np.arange(len(o)), times)
    start = f.first[o][of] + np.arange(len(of)) - np.repeat(np.cumsum(times) - times, times)
    doc = f.doc[o][of]
    # of equal windows only the chunk's first is sent; the others go
    seen: dict[bytes, int] = {}
    first, more = [], []
    at, words, place = -1, b"", np.zeros(1, np.int64)
    for i in np.lexsort((start, doc)).tolist():
        if doc[i] != at:
            at = int(doc[i])
            each = chunk.texts[at].split()
            words, place = b" ".join(each), np.r_[0, np.cumsum(np.fromiter(map(len, each), np.int64, len(each)) + 1)]
        content = words[place[start[i]] : place[start[i] + length] - 1]
        if seen.setdefault(content, i) == i:
            first.append(i)
        else:
            more.append(i)
    more = np.array(more, np.int64)
    head = R.ranges_table(number, np.r_[f.doc[repeat], doc[more]], np.r_[f.first[repeat], start[more]], np.r_[f.last[repeat], start[more]] + length)
    out.append([-1 - number, *head, None, None, None])
    # a hot anchor has many windows, which are dealt to as many buckets
    contents, first = list(seen), np.array(first, np.int64)
    to = np.fromiter((hash_of(x) % dealt for x in contents), np.int64, len(contents))
    for bucket, part in R.by_group(to) if len(first) else ():
        d, x = doc[first[part]], [contents[j] for j in part.tolist()]
        out.append([bucket, number, d.astype(np.int64).tobytes(), start[first[part]].astype(np.int64).tobytes(), None, chunk.ids[d].tobytes(), np.array([len(y) for y in x], np.int32).tobytes(), b"".join(x)])
    return rows_table(out, MOVED)


def later_windows(rows: pa.Table, length: int) -> pa.Table:
    """Of the windows of a bucket, all but the first of the same words."""
    if rows["dest"][0].as_py() < 0:
        return rows.select(["chunk", "doc", "start", "stop"])
    doc, start, ids = (np.concatenate([np.frombuffer(x, np.int64) for x in rows[k].to_pylist()]) for k in ("doc", "start", "id"))
    size = np.concatenate([np.frombuffer(x, np.int32) for x in rows["size"].to_pylist()]).astype(np.int64)
    words, stop = b"".join(rows["words"].to_pylist()), np.cumsum(size)
    row = np.repeat(np.arange(rows.num_rows), [len(x) // 8 for x in rows["doc"].to_pylist()])
    order = np.lexsort((start, doc, rows["chunk"].to_numpy()[row], ids))
    seen: set[bytes] = set()
    hit = []
    for i, a, b in zip(order.tolist(), (stop - size)[order].tolist(), stop[order].tolist(), strict=True):
        content = words[a:b]
        if content in seen:
            hit.append(i)
        seen.add(content)
    hit = np.array(hit, np.int64)
    out = [R.ranges_table(rows["chunk"][r].as_py(), doc[hit[i]], start[hit[i]], start[hit[i]] + length) for r, i in R.by_group(row[hit])] if len(hit) else []
    return rows_table(out, R.RANGES)


RESULT = "doc_id long, text string, n_words long, n_removed long, kept string"


def dedup_windows(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, batches: int = BATCHES) -> DataFrame:
    """doc_id, text, n_words, n_removed, kept (what stays, words joined by a space) of every document."""
    spark = docs.sparkSession
    base, n = batched(docs, batches)
    index = WindowIndex(spark, buckets=R.buckets_for(n), length=length, gram=gram)
    for b in range(batches):
        index.ingest(base.filter(F.col("batch") == b).drop("batch"))
    base = base.drop("batch")
    ranges = index.resolve(base)

    def cut(rows: pa.Table, found: pa.Table) -> pa.Table:
        out: list[list] = []
        if rows.num_rows:
            chunk = R.Chunk(rows)
            for i, (text, gone) in enumerate(zip(chunk.texts, R.per_document(len(chunk.texts), R.ranges_of(found)), strict=True)):
                words, at, kept = text.split(), 0, []
                for a, b in gone:
                    kept += words[at:a]
                    at = b
                kept += words[at:]
                out.append([None if chunk.no_id[i] else int(chunk.ids[i]), text.decode(), len(words), len(words) - len(kept), b" ".join(kept).decode()])
        return rows_table(out, RESULT)

    return base.groupBy("chunk").cogroup(ranges.groupBy("chunk")).applyInArrow(cut, RESULT)


def op8_window_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = dedup_windows(table(spark, sf_dir, "documents"))
    return done.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


QUERIES = {"op8_window_index": op8_window_index}
