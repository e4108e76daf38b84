"""SimHash near-dedup by deletion variants.

A fingerprint of 64 bits is cut into so few segments that, of two fingerprints at most `radius` bits apart, one segment
differs in at most one bit (two segments for three bits). Each segment is indexed under all its one-wildcard variants:
the segment with one bit left out, and which bit that was. Two fingerprints within the radius meet in an equality join
on such a variant, where the exact number of differing bits is verified. Equal fingerprints count once, so that a group
of exact copies is one row of the index; inside a bucket only the links of a spanning forest come out, not all pairs. Two
fingerprints that agree in a whole segment meet under all of its wildcards, but are linked under the first one only.

`one_of_each`, the stage of a pipeline, looks for texts of a similarity instead of a number of bits. Such texts differ in
so many bits that short segments have to do. A variant then stands for its bucket together with the text's smallest
shingle under a hash of the segment's own, which similar texts share with the probability of their similarity; and two
texts link only if some more of these smallest shingles agree. So texts that are alike by chance don't meet, at any size.
With eight segments of eight bits, texts of similarity 0.8 meet in some bucket with a probability of 0.997.

Nulls: a null text counts as empty; the fingerprint of a text without words is 0 and links like any other. Rows with a
null doc_id take part, and never give a component its number. Repeated rows are in one component; an empty table gives an
empty one. A text is hashed whole, whatever its length. Other columns are ignored, and `one_of_each` passes them on,
whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._anchors import mix
from ._common import checkpoint, quoted, shared_folder, stored, table, whole_text

BITS = 64
RADIUS = 3
SHINGLE = 3
SEED = 42
# the near-duplicate stage of the pipeline
STAGE_SHINGLE = 5
STAGE_RADIUS = 15  # gives the number of segments: eight
STAGE_BITS = 20  # as many bits at most differ in linked texts; of similarity 0.8 some 10 do, 3 more or less
MINIMA = 8  # smallest shingles of a text under as many hashes
AGREE = 3  # so many of them at least agree in linked texts; of similarity 0.8, 999 in 1,000 do
STAGE_LEAST = 0.8
SEGMENT_AT, WILDCARD_AT = 52, 44  # where a variant holds the segment's and the wildcard's number
BLOCK = 512  # texts of a loose group that are compared in one go


def shingle_hashes(text: bytes, size: int, hash_of: Callable = xxhash.xxh64_intdigest) -> np.ndarray:
    """XXH64 of the shingles of a text, lower-cased in A-Z."""
    words = text.lower().split()
    line = b" ".join(words)
    if len(words) <= size:
        return np.array([hash_of(line, SEED)] if words else [], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    begins = np.r_[0, ends[:-1] + 1]
    return np.array([hash_of(line[a:b], SEED) for a, b in zip(begins[: 1 - size or None].tolist(), ends[size - 1 :].tolist(), strict=True)], np.uint64)


def simhash(hashes: np.ndarray) -> int:
    """Bit i is 1 if it is set in over half of the hashes; unsigned."""
    if not len(hashes):
        return 0
    bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    ones = np.concatenate([bits[i : i + 255].sum(axis=0, dtype=np.uint8)[None] for i in range(0, len(bits), 255)]).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes), bitorder="little").tobytes(), "little")


def smallest_shingles(hashes: np.ndarray) -> np.ndarray:
    """The smallest shingle under each of `MINIMA` hashes; zeros for a text without words."""
    if not len(hashes):
        return np.zeros(MINIMA, np.uint64)
    return np.array([mix(hashes + np.uint64(k + 1)).min() for k in range(MINIMA)])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, rank: Column | None = None, keyed: bool = False) -> DataFrame:
    """doc_id (or `rank`) and fp, the fingerprint as a signed long; if `keyed`, also key, a hash of the text's words, and
    minima, the smallest shingles."""
    given = F.col("doc_id").cast("long").alias("doc_id") if rank is None else rank.alias("rank")
    name, kind = docs.select(given).dtypes[0]
    signed = lambda x: pa.array(np.array(x, np.uint64).view(np.int64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            prints, keys, minima = [], [], []
            for x in b.column("text").cast(pa.binary()):
                text = x.as_buffer().to_pybytes()
                hashes = shingle_hashes(text, shingle)
                prints.append(simhash(hashes))
                if keyed:
                    keys.append(xxhash.xxh64_intdigest(b" ".join(text.lower().split()), SEED))
                    minima.append(smallest_shingles(hashes))
            columns = {name: b.column(name), "fp": signed(prints)}
            if keyed:
                flat = signed(np.concatenate([np.zeros(0, np.uint64), *minima]))
                columns |= {"key": signed(keys), "minima": pa.ListArray.from_arrays(pa.array(np.arange(len(prints) + 1, dtype=np.int32) * MINIMA), flat)}
            yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

    return docs.select(given, whole_text().alias("text")).mapInArrow(run, f"{name} {kind}, fp long" + ", key long, minima array<long>" * keyed)


def segments(radius: int) -> list[tuple[int, int]]:
    """(first bit, bits) of the segments, of which one differs in at most one bit."""
    n = radius // 2 + 1
    cuts = [BITS * i // n for i in range(n + 1)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:], strict=False)]


def variants(nodes: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(variant, small, fp, sig): each fingerprint under all one-wildcard variants of its segments.

    A variant is one number: the segment, the wildcard, and the segment's bits without that one. If the nodes have a
    column minima, small is the segment's smallest shingle and sig the low bytes of all; else both are 0."""
    cuts = F.array(*[F.struct(F.lit(i).cast("long").alias("s"), F.lit(a).alias("a"), F.lit(n).alias("n")) for i, (a, n) in enumerate(segments(radius))])
    small, sig = F.lit(0).cast("long"), F.lit(0).cast("long")
    if "minima" in nodes.columns:
        small = F.expr("minima[c.s]")
        sig = F.expr("aggregate(minima, 0L, (x, m) -> shiftleft(x, 8) | (m & 255))")
    each = nodes.withColumn("sig", sig).withColumn("c", F.explode(cuts)).select("fp", "sig", "c", small.alias("small"))
    each = each.select("fp", "sig", "small", F.col("c.s").alias("s"), F.expr("shiftrightunsigned(fp, c.a) & (shiftleft(1L, c.n) - 1)").alias("value"), F.explode(F.expr("sequence(0, c.n - 1)")).alias("w"))
    variant = F.expr(f"shiftleft(s, {SEGMENT_AT}) | shiftleft(CAST(w AS LONG), {WILDCARD_AT}) | (value & ~shiftleft(1L, w))")
    return each.select(variant.alias("variant"), "small", "fp", "sig")


def distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    # of a signed number, numpy counts the bits of the absolute value
    return np.bitwise_count((a ^ b).view(np.uint64))


def forest(fp: np.ndarray, sig: np.ndarray, half: np.ndarray | None, radius: int, block: int = 2048) -> tuple[np.ndarray, np.ndarray]:
    """Links that tie each fingerprint that pairs within `radius` connect to the smallest place of `fp` among them. With
    `half`, the links within each half are taken as known, and only those that are needed besides come out."""
    root = np.arange(len(fp))

    def join(known: bool) -> None:
        for at in range(0, len(fp), block):
            for to in range(at, len(fp), block):
                near = distance(fp[at : at + block, None], fp[None, to : to + block]) <= radius
                if known:
                    near &= half[at : at + block, None] == half[None, to : to + block]
                x, y = np.nonzero(near)
                x, y = x + at, y + to
                if sig.any():
                    agree = ((sig[x] ^ sig[y]).view(np.uint8).reshape(-1, 8) == 0).sum(axis=1) >= AGREE
                    x, y = x[agree], y[agree]
                # links between nodes of different roots pull both roots down to the smaller one, until there are none
                while len(x := x[apart := root[x] != root[y]]):
                    y = y[apart]
                    low = np.minimum(root[x], root[y])
                    np.minimum.at(root, np.maximum(root[x], root[y]), low)
                    while (root[root] != root).any():
                        root[:] = root[root]

    given = np.ones(len(fp), bool)
    if half is not None and half.any() and not half.all():
        join(True)
        given = root == np.arange(len(fp))
    elif half is not None:
        return fp[:0], fp[:0]
    join(False)
    tied = given & (root != np.arange(len(fp)))
    return fp[tied], fp[root[tied]]


def linked(nodes: DataFrame, radius: int = RADIUS, bits: int | None = None) -> DataFrame:
    """(a, b): verified links between distinct fingerprints, enough of them to keep all connections.

    Those up to `radius` bits apart are sure to meet; what meets is linked up to `bits`, or else `radius`."""
    first_bit = np.array([a for a, _ in segments(radius)])

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left: list[np.ndarray] = []  # of the bucket that may go on in the next batch
        for b in batches:
            t = np.vstack([c.to_numpy().astype(np.int64) for c in b.columns])
            if not t.shape[1]:
                continue
            if left and (left[-1][:2, -1] == t[:2, 0]).all():
                start = np.flatnonzero((t[:2] != t[:2, :1]).any(axis=0))[:1]
                left.append(t[:, : start[0]] if len(start) else t)
                if not len(start):
                    continue
                t = t[:, start[0] :]
            if left:
                whole = np.hstack(left)
                yield links(whole, np.array([0, whole.shape[1]]))
            new = np.flatnonzero(np.r_[True, (t[:2, 1:] != t[:2, :-1]).any(axis=0)])
            left = [t[:, new[-1] :]]
            yield links(t, new)
        if left:
            whole = np.hstack(left)
            yield links(whole, np.array([0, whole.shape[1]]))

    def links(t: np.ndarray, new: np.ndarray) -> pa.RecordBatch:
        found = []
        for i in np.flatnonzero(np.diff(new) > 1):
            variant, (_, _, fp, sig) = int(t[0, new[i]]), t[:, new[i] : new[i + 1]]
            wildcard = variant >> WILDCARD_AT & 255
            half = fp >> (first_bit[variant >> SEGMENT_AT] + wildcard) & 1 if wildcard else None
            found.append(forest(fp, sig, half, radius if bits is None else bits))
        pairs = [np.concatenate([np.zeros(0, np.int64), *(f[i] for f in found)]) for i in (0, 1)]
        return pa.RecordBatch.from_arrays([pa.array(x) for x in pairs], ["a", "b"])

    key = ["variant", "small"]
    return variants(nodes, radius).repartition(*key).sortWithinPartitions(*key).mapInArrow(verify, "a long, b long").filter("a != b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of all nodes of `edges` (a, b): the smallest node that can be reached.

    Alternates large-star and small-star steps until nothing changes, some log(n) rounds for a chain of n nodes; each step
    is one join with the smallest neighbour, and only edges travel."""
    edges = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a != b").distinct()
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a != b").distinct()
        small_least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(small_least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(small_least.select("a", F.col("m").alias("b")))
        edges = checkpoint(small.filter("a != b").distinct())
        now = edges.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("a", "b").cast("decimal(20,0)")), F.lit(0))).first()
        if before == now:
            break
        before = now
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """doc_id, fp, component_id: the smallest doc_id that links of at most `radius` bits reach."""
    shared_folder(docs.sparkSession)
    prints = stored(fingerprints(docs, shingle))
    nodes = prints.groupBy("fp").agg(F.min("doc_id").alias("least"))
    reach = components(checkpoint(linked(nodes, radius)))
    rooted = nodes.join(reach, nodes.fp == reach.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    smallest = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = rooted.join(smallest, "root").select("fp", "component_id")
    return prints.join(named, "fp")


def shared(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard similarity of two sorted arrays of distinct shingles."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / max(len(a) + len(b) - both, 1)


def similar_links(fp: np.ndarray, side: np.ndarray, sets: list[np.ndarray], radius: int, least: float) -> list[tuple[int, int]]:
    """Verified links (i, j), enough of them to keep all connections: of one block, or between the blocks 0 and 1."""
    root, out = np.arange(len(fp)), []
    for i in range(1, len(fp)):
        near = np.flatnonzero(distance(fp[:i], fp[i]) <= radius)
        if side.any():
            near = near[side[near] != side[i]]
        while len(near := near[root[near] != root[i]]):
            j, near = int(near[0]), near[1:]
            if shared(sets[i], sets[j]) >= least:
                out.append((i, j))
                root[root == root[i]] = root[j]
    return out


def compared_with_heads(nodes: DataFrame, shingle: int, radius: int, least: float) -> DataFrame:
    """(root, key, fp, text, head, near, border): each node of a root against its head, the node with the smallest key. `near`: they
    link. `border`: they do not, but a node near the head might be near this one as well; the distance 1 - similarity is a
    metric, so such a node is at most 2 * (1 - least) from the head, and all others are out of reach."""
    heads = nodes.groupBy("root").agg(F.min(F.struct("key", "fp", "text")).alias("h")).select("root", F.col("h.key").alias("head"), F.col("h.fp").alias("head_fp"), F.col("h.text").alias("head_text"))
    joined = nodes.join(heads, "root").where("key <> head").select("root", "key", "fp", "text", "head", "head_fp", "head_text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, own = None, np.zeros(0, np.uint64)
        for b in batches:
            texts, head_texts = (b.column(i).cast(pa.binary()) for i in (3, 6))
            near, border = np.zeros(b.num_rows, bool), np.zeros(b.num_rows, bool)
            close = distance(b.column("fp").to_numpy(), b.column("head_fp").to_numpy()) <= radius
            for i, (head, text) in enumerate(zip(b.column("head").to_pylist(), texts.to_pylist(), strict=True)):
                if head != known:
                    known, own = head, np.unique(shingle_hashes(head_texts[i].as_py(), shingle))
                like = shared(own, np.unique(shingle_hashes(text, shingle)))
                near[i] = close[i] and like >= least
                border[i] = not near[i] and like >= 2 * least - 1 - 1e-9
            yield pa.RecordBatch.from_arrays([*b.columns[:5], pa.array(near), pa.array(border)], [*b.schema.names[:5], "near", "border"])

    return stored(joined.mapInArrow(run, "root long, key long, fp long, text string, head long, near boolean, border boolean"))


def verified(nodes: DataFrame, shingle: int, radius: int, least: float) -> DataFrame:
    """(a, b): links between the nodes (root, key, fp, text) of a root that are within `radius` and similar.

    First all are compared with the root's head, which links the copies of a template in one pass. The nodes that are left are compared with each
    other, and those on the border with the ones near the head. For that a large group is cut into blocks, and two blocks meet
    in a group of their own."""
    told = compared_with_heads(nodes, shingle, radius, least)
    rest = told.where("not near").select("root", "key", "fp", "text")
    blocks = rest.groupBy("root").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("n"))
    placed = rest.join(blocks, "root").withColumn("block", F.pmod(F.xxhash64("key"), F.col("n")).cast("int"))
    placed = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    group = [F.col("root"), F.least("block", "other").alias("p"), F.greatest("block", "other").alias("q")]
    dealt = placed.select(*group, F.when(F.col("block") > F.col("other"), 1).otherwise(0).alias("side"), "key", "fp", "text")
    # blocks near the head have negative numbers
    sizes = told.groupBy("root").agg(F.ceil(F.count_if("near") / BLOCK).cast("int").alias("p_n"), F.ceil(F.count_if("border") / BLOCK).cast("int").alias("q_n")).where("p_n > 0 AND q_n > 0")
    across = told.where("near OR border").join(sizes, "root").withColumn("hash", F.xxhash64("key"))
    sides = [(0, "near", F.lit(-1) - F.pmod("hash", "p_n"), F.explode(F.sequence(F.lit(0), F.col("q_n") - 1))), (1, "border", None, F.pmod("hash", "q_n"))]
    for side, which, p, q in sides:
        own = across.where(which).withColumn("q", q)
        own = own.withColumn("p", p if p is not None else F.explode(F.sequence(-F.col("p_n"), F.lit(-1))))
        dealt = dealt.unionByName(own.select("root", F.col("p").cast("int"), F.col("q").cast("int"), F.lit(side).alias("side"), "key", "fp", "text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, rows = None, []
        for b in batches:
            for row in zip(*(b.column(i).to_pylist() for i in range(6)), b.column(6).cast(pa.binary()).to_pylist(), strict=True):
                if row[:3] != at:
                    yield links(rows)
                    at, rows = row[:3], []
                rows.append((*row[3:6], np.unique(shingle_hashes(row[6], shingle))))
        yield links(rows)

    def links(rows: list[tuple]) -> pa.RecordBatch:
        side, key, fp = (np.array([r[k] for r in rows], np.int64) for k in range(3))
        found = similar_links(fp, side, [r[3] for r in rows], radius, least)
        return pa.RecordBatch.from_arrays([pa.array(key[[x[k] for x in found]] if found else [], pa.int64()) for k in (0, 1)], ["a", "b"])

    key = ["root", "p", "q"]
    found = dealt.repartition(*key).sortWithinPartitions(*key, "key").mapInArrow(run, "a long, b long")
    return found.unionByName(told.where("near").select(F.col("head").alias("a"), F.col("key").alias("b")))


def one_of_each(docs: DataFrame, shingle: int = STAGE_SHINGLE, radius: int = STAGE_RADIUS, least: float = STAGE_LEAST, bits: int = STAGE_BITS) -> DataFrame:
    """The rows of `docs`, with all their columns, that stay: of each component the one with the smallest doc_id (null ones
    last), of several such rows one with the smallest hash of its text.

    Two texts link if their fingerprints are at most `bits` bits apart and their sets of shingles have at least the
    similarity `least`. Texts of the same words count once. Fingerprints and smallest shingles give loose groups; inside
    these the texts are compared."""
    rank = F.struct(F.col("doc_id").isNull().alias("no_id"), F.col("doc_id").cast("long").alias("id"), F.xxhash64(whole_text()).alias("hash"))
    prints = stored(fingerprints(docs, shingle, rank, keyed=True))
    texts = stored(prints.groupBy("fp", "key").agg(F.min("rank").alias("least"), F.any_value("minima").alias("minima")))
    reach = components(checkpoint(linked(texts.select("fp", "minima"), radius, bits)))
    rooted = texts.join(reach, texts.fp == reach.node, "left").select("fp", "key", "least", F.coalesce("root", "fp").alias("root"))
    crowded = rooted.groupBy("root").agg((F.count("*") > 1).alias("crowded"))
    ranked = docs.select(F.struct(*map(quoted, docs.columns)).alias("row"), rank.alias("rank")).join(rooted.join(crowded, "root"), F.col("rank") == F.col("least"))
    ranked = stored(ranked.select("row", "rank", "fp", "key", "root", "crowded"))
    unsure = ranked.filter("crowded")
    pairs = verified(unsure.select("root", "key", "fp", whole_text(F.col("row.text")).alias("text")), shingle, bits, least)
    tied = components(checkpoint(pairs))
    group = unsure.select("key", "rank").join(tied, F.col("key") == F.col("node"), "left").select("rank", F.coalesce("root", "key").alias("group"))
    stay = group.groupBy("group").agg(F.min("rank").alias("stay")).select("stay")
    kept = ranked.filter("NOT crowded").unionByName(unsure.join(stay, F.col("rank") == F.col("stay"), "left_semi"))
    # rows that are the same in doc_id and text
    kept = kept.select("row", "rank").withColumn("n", F.row_number().over(Window.partitionBy("rank").orderBy("rank")))
    return kept.filter("n = 1").select("row.*")


def op6_simhash_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


QUERIES = {"op6_simhash_variants": op6_simhash_variants}
