"""Spelling variants: words one edit apart, found by states that walk a trie level by level.

The words of the corpus are counted, then read as a trie: an edge (node, letter, ends) leads from a prefix to the prefix
with one more letter, and `ends` says that a word ends there. A state is (word, sought word, node, edits). Without an edit
it stands on the word's own path; at a node it takes its one edit: another letter than its own (replaced) or the letter
after its own (deleted; the other word has it inserted). From there on each level's join with the edges must find exactly
the letters that are left. A state that ends at the end of a word has found a neighbour.

One edit leaves half of a word as it was. So there are two tries, of the words and of the words reversed, and states enter
at the node of their own first half: edits in the second half are found in the first trie, all others in the second. Thus
no state branches near a root, where most letters have an edge. Each pair is found once: by the word whose letter is
smaller or that is longer, in the last place of a run of equal letters.

Words of more than `LONG` code points would need a level for each. They are compared by one-wildcard and one-deletion
hashes instead, which are rolled along the word, and equal hashes are verified on the words.

Size: a level sends each word's state and each distinct edge once. A node has as many edges as there are letters; a node
that many words share is a hot key of a plain join only, which adaptive execution splits. Nodes are 64-bit hashes of
prefixes; found words are joined with the words themselves, so that equal hashes of different prefixes add nothing.

Hard rows: a null text has no words; a null doc_id counts as the empty string; repeated rows count each time; other columns
are ignored. An empty table, or one without words that occur often enough, gives an empty result. Memory: the runs of one
text, some ten times its bytes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._anchors import mix
from ._common import new_path, remove, stored, table, whole_text

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LETTERS = "[A-Za-zÀ-ÿ]"
SHORTEST = 7
LEAST = 2
ONE_IN = 31
TIMES = 10
LONG = 64


def misspelt(docs: DataFrame, shortest: int = SHORTEST) -> DataFrame:
    """(word) for each run of at least `shortest` letters, lower-cased; of about one in `ONE_IN`, drawn by the hash of document
    and run, a letter is gone."""
    text = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), whole_text().alias("text"))
    runs = text.select("id", F.explode(F.regexp_extract_all("text", F.lit(f"({LETTERS}{{{shortest},}})"), F.lit(1))).alias("run"))
    runs = runs.select("id", F.translate("run", UPPER, LOWER).alias("run"))
    runs = runs.withColumn("h", F.crc32(F.concat("id", F.lit(":"), "run")))
    return runs.selectExpr(f"if(h % {ONE_IN} = 0, concat(left(run, cast(h % length(run) as int)), substring(run, cast(h % length(run) as int) + 2)), run) as word")


def counted(runs: DataFrame, shortest: int = SHORTEST, least: int = LEAST) -> DataFrame:
    """(word, n) of the words that are long and frequent enough."""
    return runs.where(F.length("word") >= shortest).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least)


def steps(words: DataFrame) -> DataFrame:
    """(depth, dir, x, half, size, node) for each word, forwards and backwards, and each depth at which its edit may lie."""
    both = words.selectExpr("explode(array(struct(0 as dir, word as x), struct(1 as dir, reverse(word) as x))) as path", "length(word) as size")
    both = both.selectExpr("path.dir", "path.x", "size", "(size + path.dir) div 2 as half")
    return both.selectExpr("*", "explode(sequence(cast(half as int), size - 1)) as depth").withColumn("node", F.expr("xxhash64(dir, left(x, depth))"))


def edges(step: DataFrame) -> DataFrame:
    """(node, letter, ends) of the trie between a depth and the next."""
    return step.selectExpr("node", "substring(x, depth + 1, 1) as letter", "size = depth + 1 as ends").groupBy("node", "letter").agg(F.max("ends").alias("ends"))


def unedited(step: DataFrame) -> DataFrame:
    """The states without an edit; `run` says that the letters from before the half to here are equal, so that the other trie
    finds the deletion, `last_run` that they are so up to the end."""
    run = "dir = 1 and substring(x, half, {n} - half + 1) = repeat(substring(x, {n}, 1), {n} - half + 1)"
    return step.selectExpr("depth", "dir", "x", "cast(null as string) as y", "node", f"{run.format(n='(depth + 1)')} as run", f"{run.format(n='size')} as last_run")


def level(states: DataFrame, edge: DataFrame) -> DataFrame:
    """(depth, dir, x, y, ends): the states after one edge; y is the word that a state seeks, found up to `depth`."""
    own, following = "substring(x, depth + 1, 1)", "substring(x, depth + 2, 1)"
    exact = "y is not null and letter = substring(y, depth + 1, 1)"
    replaced = f"letter > {own}"
    deleted = f"letter = {following} and letter <> {own} and not run"
    last = f"ends and length(x) = depth + 2 and letter = {own} and not last_run"
    found = states.join(edge, "node").where(f"({exact}) or (y is null and (({replaced}) or ({deleted}) or ({last})))")
    replace, delete = "concat(left(x, depth), letter, substring(x, depth + 2))", f"concat(left(x, depth), {following}, substring(x, depth + 3))"
    sought = f"if(y is not null, array(y), array(if({replaced}, {replace}, null), if({deleted}, {delete}, null), if({last}, left(x, depth + 1), null)))"
    return found.selectExpr("depth + 1 as depth", "dir", "x", "ends", f"explode({sought}) as y").where("y is not null and (length(y) > depth or ends)")


def trie_pairs(words: DataFrame, longest: int, shortest: int = SHORTEST) -> DataFrame:
    """(a, b): near words of at most `longest` code points, each pair once. The depth is a column, so that Spark compiles the
    same code for every level."""
    spark, folder = words.sparkSession, new_path(words.sparkSession)
    step = steps(words)
    step.write.partitionBy("depth").parquet(f"{folder}/steps")
    step, found, frontier = spark.read.schema(step.schema).parquet(f"{folder}/steps"), [], None
    for depth in range(shortest // 2, longest):
        here = step.where(F.col("depth") == depth)
        states = unedited(here)
        if frontier is not None:
            states = states.unionByName(frontier.selectExpr("depth", "dir", "x", "y", "xxhash64(dir, left(y, depth)) as node", "false as run", "false as last_run"))
        after = stored(level(states, edges(here)), f"{folder}/{depth}")
        found.append(after.where("length(y) = depth"))
        frontier = after.where("length(y) > depth")
    if not found:
        return words.selectExpr("word as a", "word as b").where("false")
    pairs = found[0]
    for part in found[1:]:
        pairs = pairs.unionByName(part)
    pairs = stored(pairs.selectExpr("if(dir = 0, x, reverse(x)) as a", "if(dir = 0, y, reverse(y)) as b"))
    remove(spark, folder)
    return pairs


def wildcard_hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, kind, id) for each word: its own hash, and the hash of what is left without each of its places."""
    base = np.uint64(0x9E3779B97F4A7C15)
    for batch in batches:
        for word, number, longer in zip(*(batch.column(c).to_pylist() for c in ("word", "id", "longer")), strict=True):
            points = mix(np.frombuffer(word.encode("utf-32-le"), np.uint32).astype(np.uint64) + np.uint64(1))
            power = np.full(len(points) + 1, base, np.uint64)
            power[0] = 1
            power = np.multiply.accumulate(power)
            total = np.zeros(len(points) + 1, np.uint64)
            total[1:] = np.cumsum(points * power[:-1])
            keys, kinds = [mix(total[-1:])], [np.zeros(1, np.int64)]
            if longer:
                rest = total[-1] - total[1:]  # what follows a place moves down by one power
                keys += [mix(total[:-1] + rest * np.uint64(pow(int(base), -1, 1 << 64)))]
                kinds += [np.arange(1, len(points) + 1)]
            key = np.concatenate(keys).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(np.concatenate(kinds)), pa.array(np.full(len(key), number))], ["key", "kind", "id"])


def long_pairs(words: DataFrame) -> DataFrame:
    """(a, b): near words of which one has more than `LONG` code points."""
    own = words.selectExpr("word", "xxhash64(word) as id", f"length(word) > {LONG} as longer")
    hashes = own.mapInArrow(wildcard_hashes, "key long, kind long, id long")
    whole, parts = hashes.where("kind = 0"), hashes.where("kind > 0")
    deleted = parts.alias("l").join(whole.alias("r"), F.expr("l.key = r.key")).selectExpr("l.id as left", "r.id as right")
    replaced = parts.alias("l").join(parts.alias("r"), F.expr("l.key = r.key and l.kind = r.kind and l.id < r.id")).selectExpr("l.id as left", "r.id as right")
    ids = deleted.unionByName(replaced).distinct()
    texts = own.select("id", "word")
    both = ids.join(texts.selectExpr("id as left", "word as a"), "left").join(texts.selectExpr("id as right", "word as b"), "right")
    return both.where("a <> b and levenshtein(a, b, 1) = 1").select("a", "b").distinct()


def near_words(words: DataFrame, shortest: int = SHORTEST) -> DataFrame:
    """(word, other, n): both directions of each pair of near words, n being how often `other` occurs. `words` has word and n."""
    longest = words.agg(F.max(F.length("word"))).first()[0] or 0
    pairs = trie_pairs(words.where(F.length("word") <= LONG), min(longest, LONG), shortest)
    if longest > LONG:
        pairs = pairs.unionByName(long_pairs(words.where(F.length("word") >= LONG)))
    both = pairs.selectExpr("explode(array(struct(a as word, b as other), struct(b as word, a as other))) as pair").select("pair.*")
    return both.join(words.selectExpr("word as other", "n"), "other").select("word", "other", "n")


def variants(words: DataFrame, times: int = TIMES, shortest: int = SHORTEST) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of `words` (word, n): the near word of which a word is a rarer spelling, and where
    following forms ends. A form occurs `times` as often, so a chain has at most log(n) links."""
    near = near_words(words, shortest).groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("n")).alias("n"), "other")).alias("best"))
    own = words.join(near, "word", "left").selectExpr("word", "n", "coalesce(n_near, 0L) as n_near", f"if(-best.n >= {times} * n, best.other, null) as form", f"if(-best.n >= {times} * n, -best.n, null) as form_n")
    own = stored(own)
    chain = own.where("form is not null").selectExpr("word", "form as root")
    most, links = own.agg(F.max("n")).first()[0] or 1, 1
    while most >= times:
        most, links = most // times, links + 1
    for _ in range(max(1, (links - 1).bit_length())):
        onward = chain.selectExpr("word as root", "root as further")
        chain = stored(chain.join(onward, "root", "left").selectExpr("word", "coalesce(further, root) as root"))
    return own.join(chain, "word", "left").selectExpr("word", "form", "coalesce(root, word) as root", "n", "n_near", "form_n")


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants(stored(counted(misspelt(table(spark, sf_dir, "documents")))))


QUERIES = {"op12_spelling_variants": op12_spelling_variants}


def _oracle() -> str:
    """The same in SQL: pairs from the words without one of their places."""
    table_ = "SELECT i, i AS v FROM range(256) t(i)"
    for _ in range(8):
        table_ = f"SELECT i, xor(v >> 1, 3988292384 * (v & 1)) AS v FROM ({table_})"
    octets = "[CAST('0x' || x AS BIGINT) FOR x IN regexp_extract_all(hex(encode(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run)), '..')]"
    crc = f"xor(4294967295, list_reduce(list_prepend(CAST(4294967295 AS BIGINT), {octets}), lambda c, x: xor(c >> 8, tab[(xor(c, x) & 255) + 1])))"
    return f"""
WITH RECURSIVE crc AS ({table_}), tab AS (SELECT list(v ORDER BY i) AS tab FROM crc),
runs AS (SELECT doc_id, translate(unnest(regexp_extract_all(text, '{LETTERS}{{{SHORTEST},}}')), '{UPPER}', '{LOWER}') AS run FROM documents),
hashed AS (SELECT run, {crc} AS h, length(run) AS size FROM runs, tab),
spelt AS (SELECT CASE WHEN h % {ONE_IN} = 0 THEN substring(run, 1, h % size) || substring(run, h % size + 2) ELSE run END AS word FROM hashed),
words AS (SELECT word, count(*) AS n FROM spelt WHERE length(word) >= {SHORTEST} GROUP BY word HAVING count(*) >= {LEAST}),
places AS (SELECT word, unnest(range(1, length(word) + 1)) AS p FROM words),
gone AS (SELECT word, p, substring(word, 1, p - 1) || substring(word, p + 1) AS rest FROM places),
pairs AS (SELECT a.word, b.word AS other FROM gone a JOIN gone b ON a.p = b.p AND a.rest = b.rest AND a.word <> b.word
  UNION SELECT a.word, b.word FROM gone a JOIN words b ON a.rest = b.word
  UNION SELECT b.word, a.word FROM gone a JOIN words b ON a.rest = b.word),
near AS (SELECT p.word, p.other, w.n, row_number() OVER (PARTITION BY p.word ORDER BY w.n DESC, p.other) AS k, count(*) OVER (PARTITION BY p.word) AS n_near FROM pairs p JOIN words w ON p.other = w.word),
forms AS (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN b.n >= {TIMES} * w.n THEN b.other END AS form, CASE WHEN b.n >= {TIMES} * w.n THEN b.n END AS form_n FROM words w LEFT JOIN near b ON b.word = w.word AND b.k = 1),
chain AS (SELECT word, word AS root, 0 AS steps FROM forms UNION ALL SELECT c.word, f.form, steps + 1 FROM chain c JOIN forms f ON f.word = c.root WHERE f.form IS NOT NULL)
SELECT f.word, form, c.root, n, n_near, form_n FROM forms f JOIN (SELECT word, arg_max(root, steps) AS root FROM chain GROUP BY word) c ON c.word = f.word"""


ORACLE_SQL = {"op12_spelling_variants": _oracle()}
