"""Canonical exact digests: texts that differ only in Unicode form, case or white space get the same fingerprint.

The canonical text is the NFKC form, case-folded (ß is ss, and ς is σ) and in NFKC form again, with runs of white space as
one space and none at the ends. Its digest is 128 bits of xxhash64 under two seeds. `exact_groups` groups by digest and compares the canonical texts inside equal
buckets byte by byte, so a collision of digests joins nothing. Everything is an SQL function; no Python runs on rows.

Nulls: a null text counts as empty. Rows with a null doc_id take part, and never give a group its number; in an order by
doc_id they come last (see `with_next`). Rows that repeat a doc_id are ordered by a hash of their text, and those of one
doc_id lie in one range. An empty table gives an empty one, and a single row is its own next one. Texts are taken whole,
whatever their length. Other columns are ignored, and `with_next` passes them on, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._common import checkpoint, quoted, table, whole_text

QUANTILES = 128
STEPS = 1024  # a quantile is cut into so many ranges at most
ROWS_PER_RANGE = 2000
BROADCAST_ROWS = 100_000  # at most so many rows of a few numbers, or of a digest, are broadcast


def canonical(text: Column) -> Column:
    """The text whose bytes are compared."""
    nfkc = lambda x: F.reflect(F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), x, F.lit(True))
    folded = F.reflect(F.lit("com.ibm.icu.lang.UCharacter"), F.lit("foldCase"), nfkc(text), F.lit(True))
    return F.trim(F.regexp_replace(nfkc(folded), r"(?U)\s+", " "))


def digest(text: Column) -> Column:
    """32 hex digits of a canonical text."""
    half = lambda x: F.lpad(F.hex(x), 16, "0")
    return F.lower(F.concat(half(F.xxhash64(text)), half(F.xxhash64(F.lit("second half"), text))))


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, canonical, digest."""
    return docs.select("doc_id", canonical(whole_text()).alias("canonical")).withColumn("digest", digest(F.col("canonical")))


def exact_groups(docs: DataFrame) -> DataFrame:
    """digest, content, group_id, n_copies: one row for each canonical text that several rows have.

    group_id is the smallest doc_id; content is the SHA-256 of the canonical text, for joins. Only rows of buckets with
    more than one row carry their text through a shuffle, pre-aggregated."""
    all_rows = digests(docs)
    shared = checkpoint(all_rows.groupBy("digest").agg(F.count("*").alias("n")).filter("n > 1").select("digest"))
    if shared.count() <= BROADCAST_ROWS:  # then unique texts need no shuffle; beyond, the join below shuffles them
        shared = F.broadcast(shared)
    same = all_rows.join(shared, "digest", "left_semi").groupBy("digest", "canonical").agg(F.min("doc_id").alias("group_id"), F.count("*").alias("n_copies"))
    return same.filter("n_copies > 1").select("digest", F.sha2("canonical", 256).alias("content"), "group_id", "n_copies")


def place(k: Column, coarse: Column, fine: Column, width: int) -> Column:
    """How many of the sorted numbers `fine` are at most k; `coarse` has every `width`-th of them, from the first on."""
    below = F.greatest(F.size(F.filter(coarse, lambda b: b <= k)) - 1, F.lit(0))
    return F.element_at(F.transform(F.array(below), lambda c: c * width + F.size(F.filter(F.slice(fine, c * width + 1, width), lambda b: b <= k))), 1)


def ranged(docs: DataFrame) -> DataFrame:
    """(row, k, tie, q, range): the rows of `docs` with an order (k, tie) and the range of k that each lies in.

    Ranges are quantiles of k, and within them quantiles again, so that each has some thousand rows however uneven the
    numbers are; the driver sees `QUANTILES` numbers, and `QUANTILES` * `STEPS` are broadcast at most. A null doc_id
    stands for a number under -2**62 drawn from the text, and these are cut evenly."""
    tie = F.xxhash64(whole_text())
    n, known, bounds = docs.agg(F.count("*"), F.count("doc_id"), F.percentile_approx(F.col("doc_id").cast("long"), [i / QUANTILES for i in range(1, QUANTILES)], 10_000)).first()
    low, parts = -(1 << 62) - (1 << 61), min(QUANTILES, -(-(n - known) // ROWS_PER_RANGE))
    bounds = [low + (1 << 61) * i // parts for i in range(parts)] + sorted(set(bounds or []))
    k = F.col("doc_id").cast("long")
    if known < n:
        k = F.coalesce(k, F.lit(-(1 << 62)) - F.abs(tie % (1 << 61)))
    keyed = docs.select(F.struct(*[quoted(c) for c in docs.columns]).alias("row"), k.alias("k"), tie.alias("tie"))
    fine, coarse = (F.array(*[F.lit(b) for b in x]) if x else F.array().cast("array<long>") for x in (bounds, bounds[::16]))
    keyed = keyed.withColumn("q", place(F.col("k"), coarse, fine, 16))
    steps = min(STEPS, -(-n // (QUANTILES * ROWS_PER_RANGE)))
    if steps <= 1:
        return keyed.withColumn("range", F.col("q").cast("long"))
    cuts = keyed.groupBy("q").agg(F.array_distinct(F.percentile_approx("k", [i / steps for i in range(1, steps)], 10_000)).alias("fine"))
    cuts = cuts.withColumn("coarse", F.expr("transform(sequence(0, (size(fine) - 1) div 32), i -> fine[i * 32])"))
    inner = place(F.col("k"), F.col("coarse"), F.col("fine"), 32)
    return keyed.join(F.broadcast(cuts), "q").withColumn("range", F.col("q").cast("long") * STEPS + inner).drop("fine", "coarse")


def with_next(docs: DataFrame, carry: list[str]) -> DataFrame:
    """Each row with `next_<c>` for c in `carry`: of the next row in descending order of doc_id (the last one's is the first).

    A range is sorted on its own; the head of the range below is put behind its last row, so no range needs another one."""
    keyed = ranged(docs)
    heads = checkpoint(keyed.groupBy("q", "range").agg(F.max(F.struct("k", "tie")).alias("head")))
    down = Window.partitionBy("q").orderBy(F.desc("range"))
    tops = heads.groupBy("q").agg(F.max("head").alias("top"))
    every = Window.orderBy(F.desc("q"))  # over at most 2 * QUANTILES rows
    tops = tops.select("q", F.coalesce(F.lead("top").over(every), F.first("top").over(every)).alias("below"))
    links = heads.join(F.broadcast(tops), "q").select("range", F.coalesce(F.lead("head").over(down), "below").alias("head"))
    links = links.select(F.col("range").alias("after"), F.col("head.k").alias("k"), F.col("head.tie").alias("tie"))
    if heads.count() <= BROADCAST_ROWS:
        links = F.broadcast(links)
    behind = keyed.join(links, ["k", "tie"]).withColumn("range", F.col("after")).drop("after").withColumn("extra", F.lit(True))
    order = Window.partitionBy("range").orderBy("extra", F.desc("k"), F.desc("tie"))
    rows = keyed.withColumn("extra", F.lit(False)).unionByName(behind)
    rows = rows.select("row", "extra", *[F.lead(f"row.{c}").over(order).alias(f"next_{c}") for c in carry])
    return rows.filter("NOT extra").select(*[F.col("row")[c].alias(c) for c in docs.columns if c not in {f"next_{x}" for x in carry}], *[f"next_{c}" for c in carry])


def op10_exact_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", whole_text().alias("text"))
    own = docs.withColumn("canonical", canonical(F.col("text")))
    own = own.select("doc_id", "text", digest(F.col("canonical")).alias("fingerprint"), F.sha2("canonical", 256).alias("content"))
    rows = with_next(own, ["text", "fingerprint"])
    size = F.length("text")
    half = F.floor(size / 2).cast("int")
    edited = F.concat(F.substring("text", 1, size - half), F.substring("next_text", F.lit(1), half))
    rows = rows.select("doc_id", size.cast("long").alias("n_chars"), edited.alias("edited"), "fingerprint", "next_fingerprint", "content")
    rows = rows.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "fingerprint", digest(canonical(F.col("edited"))).alias("edited_fingerprint"), "next_fingerprint", "content")
    like = lambda a, b: (F.col(a) == F.col(b)).cast("double")
    groups = exact_groups(docs)
    rows = rows.join(groups, (rows.fingerprint == groups.digest) & (rows.content == groups.content), "left")
    return rows.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        "fingerprint",
        "edited_fingerprint",
        like("fingerprint", "edited_fingerprint").alias("near_edited"),
        like("fingerprint", "next_fingerprint").alias("near_next"),
        F.coalesce("group_id", "doc_id").alias("group_id"),
        F.coalesce("n_copies", F.lit(1)).cast("long").alias("n_copies"),
    )


QUERIES = {"op10_exact_digest": op10_exact_digest}
