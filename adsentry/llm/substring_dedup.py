"""Suffix-array dedup: later copies of long byte strings go, the first one stays.

Longest-previous-factor arrays say for each position how long a string starting there occurs in an earlier document.
In suffix order, the best earlier match of a suffix is the nearest neighbour above or below that belongs to a smaller
document: the previous and next smaller document number, each with the smallest common prefix on the way there. A position
is removed with the ``length`` bytes after it if that factor is at least ``length`` long.

One suffix array of a whole corpus fits no machine, so suffixes are dealt out by the anchor string of their first
``length`` bytes (see ``_anchors``): equal strings meet in one bucket. Copies whose surroundings are equal as well are
collapsed to their first document before that, so that a bucket holds distinct surroundings and not copies. Each bucket
sorts the suffixes of what is left, by their first ``length`` bytes. An anchor that stands between more than ``HOT``
different surroundings is split: its windows are dealt by the hash of all their ``length`` bytes.

Collapsing trusts hashes: surroundings count as equal if the anchor's hash (32 bits and the bucket, which takes some 20
more) and a 64-bit hash of all their bytes agree. Over 100 TB, some 5e12 distinct surroundings, any two of them are
mistaken for one another with a probability of about 1e-10. What is not collapsed is compared byte by byte.

Nulls: a null text counts as empty; rows with a null doc_id count as later than all others, and as equal among
themselves, as do repeated doc_ids: such rows don't remove each other's bytes. An empty table gives an empty one. A long
text is hashed in one go and needs some 60 bytes of memory for each of its bytes. Other columns are ignored, whatever
their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession

from . import _repeats as R
from ._common import table

LENGTH = 50
GRAM = 16
HOT = 4096
MOVED = "dest int, chunk int, doc binary, id binary, start binary, stop binary, first binary, last binary, copies binary, further binary, body binary"
ANSWERS = f"{R.ANSWERS}, hot binary"
hash_of = xxhash.xxh3_64_intdigest
SPANS = "doc_id long, text string, kept binary, removed array<struct<start:int,stop:int>>"


def suffix_order(data: np.ndarray, at: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """The suffixes starting at `at`, sorted by their first `length` bytes, and whether each has these in common with the
    one before it."""
    words = -(-length // 8)
    padded = np.concatenate([data, np.zeros(8 * words + 8, np.uint8)])
    spread = np.lib.stride_tricks.sliding_window_view(padded, 8)
    keys = []
    for k in range(words):
        key = np.ascontiguousarray(spread[at + 8 * k]).view(">u8").ravel().astype(np.uint64)
        keep = min(8, length - 8 * k)
        keys.append(key if keep == 8 else key >> np.uint64(8 * (8 - keep)))
    order = np.lexsort(keys[::-1])
    same = np.ones(len(at), bool)
    same[:1] = False
    for key in keys:
        key = key[order]
        same[1:] &= key[1:] == key[:-1]
    return order, same


def previous_smaller(values: np.ndarray, common: np.ndarray) -> np.ndarray:
    """For each place, the smallest `common` on the way to the nearest place before it with a smaller value; 0 if there is
    none. common[i] is what the places i - 1 and i have in common.

    All places jump at once, each to where its candidate would jump, so a row of n equal values takes log(n) rounds."""
    place, least = np.arange(len(values)) - 1, common.copy()
    while True:
        far = np.flatnonzero((place >= 0) & (least > 0))
        far = far[values[place[far]] >= values[far]]
        if not len(far):
            break
        least[far] = np.minimum(least[far], least[place[far]])
        place[far] = place[place[far]]
    least[place < 0] = 0
    return least


def longest_previous(data: np.ndarray, at: np.ndarray, doc: np.ndarray, length: int) -> np.ndarray:
    """Of the suffixes at `at`, the longest common prefix with one of a smaller document, up to `length` bytes; prefixes
    that are shorter count as 0."""
    order, same = suffix_order(data, at, length)
    # a suffix that shares `length` bytes with neither neighbour shares them with none
    near = np.flatnonzero(same | np.r_[same[1:], False][: len(same)])
    common, docs = np.where(same[near], length, 0), doc[order[near]]
    before = previous_smaller(docs, common)
    after = previous_smaller(docs[::-1], np.r_[0, common[:0:-1]][: len(common)])[::-1]
    out = np.zeros(len(at), np.int64)
    out[order[near]] = np.maximum(before, after)
    return out


def removed_ranges(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> tuple[DataFrame, DataFrame]:
    """The chunked documents, and for each chunk the byte ranges that go."""
    base, chunks = R.chunked(docs)
    n = R.buckets_for(chunks)

    def entries(rows: pa.Table) -> pa.Table:
        return R.send_entries(rows, R.byte_tokens, length, gram, n)

    def collapse(rows: pa.Table) -> pa.Table:
        g, around, doc, row = R.entries_of(rows)
        order = np.lexsort((doc, around, g))
        later, unclear, crowded = (np.zeros(len(g), bool) for _ in range(3))
        later[order], unclear[order], kinds = R.judge(g[order], around[order], doc[order])
        crowded[order] = kinds > HOT
        return R.answers(rows, row, later=later, unclear=unclear, hot=unclear & crowded)

    def contexts(rows: pa.Table, said: pa.Table) -> pa.Table:
        out: list[list] = []
        if rows.num_rows:
            chunk, number = R.Chunk(rows), rows["chunk"][0].as_py()
            f = R.find(chunk, R.byte_tokens, length, gram, n)
            later, unclear, hot = R.answered(f, said, "later", "unclear", "hot")
            ids = chunk.ids[f.doc]
            all_of_it = later[f.entry] | (ids > ids[f.leader][f.entry])
            gone = [f.doc[all_of_it], f.first[all_of_it], f.last[all_of_it] + length]
            # what the chunk itself doesn't decide, in the first document that has it
            open_, hot = unclear[f.entry] & ~hot[f.entry] & ~all_of_it, hot[f.entry] & ~all_of_it
            # a hot anchor's windows
            o = np.flatnonzero(hot)
            times = f.last[o] - f.first[o] + 1
            window = np.repeat(f.first[o] - np.cumsum(times) + times, times) + np.arange(times.sum())
            doc = np.repeat(f.doc[o], times)
            order = np.lexsort((window, doc))
            seen: dict[bytes, tuple[int, int]] = {}
            again, alone, same = [], [], []
            for i, d, x in zip(order.tolist(), doc[order].tolist(), window[order].tolist(), strict=True):
                first, number_of = seen.setdefault(chunk.texts[d][x : x + length], (d, len(seen)))
                if chunk.ids[d] > chunk.ids[first]:
                    again.append(i)
                else:
                    alone.append(i)
                    same.append(number_of)
            gone = [np.r_[a, b] for a, b in zip(gone, (doc[again], window[again], window[again] + length), strict=True)] if again else gone
            number, d, a, b = R.ranges_table(number, *gone)
            empty = b""
            if d:
                out.append([-1 - number, number, d, empty, a, b, *[empty] * 5])
            ask = np.flatnonzero(open_)
            parts = [((f.gram[f.entry[ask]] // np.uint64(n) % np.uint64(chunks)).astype(np.int64), f.entry[ask], f.doc[ask], f.lo[ask], f.hi[ask], f.first[ask], f.last[ask])]
            if alone:
                d, x = doc[alone], window[alone]
                key = np.fromiter((hash_of(chunk.texts[i][j : j + length]) % chunks for i, j in zip(d.tolist(), x.tolist(), strict=True)), np.int64, len(d))
                parts.append((key, len(f.gram) + np.array(same), d, x, x + length, x, x))
            bucket, kind, d, lo, hi, first, last = (np.concatenate(x) for x in zip(*parts, strict=True))
            # equal surroundings of one document go once, with how far on the others stand
            order = np.lexsort((lo, d, kind))
            bucket, kind, d, lo, hi, first, last = (x[order] for x in (bucket, kind, d, lo, hi, first, last))
            head = np.flatnonzero(np.r_[True, (kind[1:] != kind[:-1]) | (d[1:] != d[:-1])][: len(kind)])
            copies = np.diff(np.r_[head, len(kind)])
            on = lo - np.repeat(lo[head], copies)
            bucket, d, lo, hi, first, last = (x[head] for x in (bucket, d, lo, hi, first, last))
            for to, part in R.by_group(bucket) if len(bucket) else ():
                body = b"".join([chunk.texts[i][x:y] for i, x, y in zip(d[part].tolist(), lo[part].tolist(), hi[part].tolist(), strict=True)])
                further = np.concatenate([on[head[i] : head[i] + copies[i]] for i in part])
                out.append([to, number, *(x.astype(np.int64).tobytes() for x in (d[part], chunk.ids[d[part]], lo[part], hi[part], first[part], last[part], copies[part], further)), body])
        return rows_table(out, MOVED)

    def match(rows: pa.Table) -> pa.Table:
        dest = rows["dest"][0].as_py()
        if dest < 0:
            return rows.select(["chunk", "doc", "start", "stop"])
        cols = {k: [np.frombuffer(x, np.int64) for x in rows[k].to_pylist()] for k in ("doc", "id", "start", "stop", "first", "last")}
        row = np.repeat(np.arange(rows.num_rows), [len(x) for x in cols["doc"]])
        c = {k: np.concatenate(v) for k, v in cols.items()}
        data = np.frombuffer(b"".join(rows["body"].to_pylist()), np.uint8)
        base_at = np.cumsum(c["stop"] - c["start"]) - (c["stop"] - c["start"])
        times = c["last"] - c["first"] + 1
        of = np.repeat(np.arange(len(row)), times)
        shift = np.arange(len(of)) - np.repeat(np.cumsum(times) - times, times)
        at = base_at[of] + (c["first"] - c["start"])[of] + shift
        hit = longest_previous(data, at, c["id"][of], length) >= length
        of, shift = of[hit], shift[hit]
        if not len(of):
            return rows_table([], R.RANGES)
        # neighbouring windows are one range; it also goes at the further places of the same surroundings
        head = np.flatnonzero(np.r_[True, (of[1:] != of[:-1]) | (shift[1:] != shift[:-1] + 1)])
        end = np.r_[head[1:], len(of)] - 1
        of, begin, stop = of[head], c["first"][of[head]] + shift[head], c["first"][of[head]] + shift[end] + length
        copies, on = (np.concatenate([np.frombuffer(x, np.int64) for x in rows[k].to_pylist()]) for k in ("copies", "further"))
        from_ = np.cumsum(copies) - copies
        out = []
        for r, i in R.by_group(row[of]):
            times = copies[of[i]]
            each = np.repeat(i, times)
            on_ = on[np.repeat(from_[of[i]] - np.cumsum(times) + times, times) + np.arange(times.sum())]
            out.append(R.ranges_table(rows["chunk"][r].as_py(), c["doc"][of[each]], begin[each] + on_, stop[each] + on_))
        return rows_table(out, R.RANGES)

    sent = base.groupBy("chunk").applyInArrow(entries, R.ENTRIES)
    said = sent.groupBy("bucket").applyInArrow(collapse, ANSWERS)
    moved = base.groupBy("chunk").cogroup(said.groupBy("chunk")).applyInArrow(contexts, MOVED)
    return base, moved.groupBy("dest").applyInArrow(match, R.RANGES)


def rows_table(rows: list[list], ddl: str) -> pa.Table:
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "string": pa.string()}
    names = [x.split() for x in ddl.split(", ")]
    return pa.table([pa.array([r[i] for r in rows], kinds[k]) for i, (_, k) in enumerate(names)], names=[x for x, _ in names])


def dedup_substrings(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """doc_id, text, kept (the remaining bytes) and removed (maximal byte ranges) of every document."""
    base, ranges = removed_ranges(docs, length, gram)

    def cut(rows: pa.Table, found: pa.Table) -> pa.Table:
        if not rows.num_rows:
            return pa.table({"doc_id": pa.array([], pa.int64()), "text": pa.array([], pa.string()), "kept": pa.array([], pa.binary()), "removed": pa.array([], SPAN)})
        chunk = R.Chunk(rows)
        spans = R.per_document(len(chunk.texts), R.ranges_of(found))
        kept = []
        for text, gone in zip(chunk.texts, spans, strict=True):
            at, parts = 0, []
            for a, b in gone:
                parts.append(text[at:a])
                at = b
            kept.append(b"".join([*parts, text[at:]]))
        ids = pa.array(chunk.ids, pa.int64(), mask=chunk.no_id)
        return pa.table([ids, pa.array(chunk.texts, pa.binary()).cast(pa.string()), pa.array(kept, pa.binary()), pa.array([[{"start": a, "stop": b} for a, b in x] for x in spans], SPAN)], names=["doc_id", "text", "kept", "removed"])

    SPAN = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())]))
    return base.groupBy("chunk").cogroup(ranges.groupBy("chunk")).applyInArrow(cut, SPANS)


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    done = dedup_substrings(table(spark, sf_dir, "documents"))
    return done.select(
        "doc_id",
        F.octet_length("text").cast("long").alias("n_bytes"),
        (F.octet_length("text") - F.octet_length("kept")).cast("long").alias("n_removed"),
        F.size("removed").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


QUERIES = {"op2_suffix_dedup": op2_suffix_dedup}
