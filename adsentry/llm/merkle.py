"""Merkle manifest of a data set: a digest of each row, a root over all of them, and a proof for each.

A leaf's place is its rank among the doc_ids of its group. Ranks come from bitmaps: each (group, doc_id div 2^15) has a bitmap
of the ids that occur, and directories of the counts at steps of 2^15 buckets add up what lies before a bucket. The rank of an
id is the count before its bucket plus the bits set before its own. No rows are sorted, and a directory's window never
holds over 2^15 counts. Bitmaps are mostly zeros where ids are sparse; they travel and rest compressed.

A level is reduced by keyed slot arrays: nodes are grouped by (group, place div 8), and a run's digests, ordered by place, become
the parent's. A run keeps its children, so that paths go down again: the path of a node is, for each level above, what stands
before and after it in its run. Paths are kept for each run of eight leaves rather than for each leaf. Proofs and folded roots are
computed from the path at each leaf.

Ties: rows of one group with equal doc_ids are ordered by their leaf, equal rows stand side by side, and each row is returned. Rows
without doc_id come before all others of their group. Their ranks come from the same bitmaps, over the first bits of the leaf, so a
doc_id that a third of all rows share is no group that meets in one task. A null doc_id has no decimal form: such a row is not tampered
with. Nulls of other columns are part of the leaf as `-`. Other columns are ignored, whatever their names. An empty table
gives an empty result. Texts are digested whole where they are read, and never shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import new_path, stored, table, whole_text

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
RUN = 8
BITS = 15  # of a bucket's bitmap, and of a step of the directories


def leaf(columns: list[Column]) -> Column:
    """The digest of a row: each value with its length in bytes, `-` for null."""
    part = [F.coalesce(F.concat(F.octet_length(c.cast("string")).cast("string"), F.lit(":"), c.cast("string")), F.lit("-")) for c in columns]
    return F.sha2(F.concat(*part), 256)


def leaves(docs: DataFrame) -> DataFrame:
    """(group, doc_id, leaf, altered): the digest of each row, and that of the row as found again, which tampering may have changed."""
    own = [F.col(c) for c in COLUMNS]
    tampered = [*own[:-1], F.translate(whole_text(), UPPER, LOWER)]
    touched = F.col("text").isNotNull() & (F.crc32(F.col("doc_id").cast("string")) % 3 == 0)
    return docs.select(F.col("lang").cast("string").alias("group"), F.col("doc_id").cast("long").alias("doc_id"), leaf(own).alias("leaf"), F.when(touched, leaf(tampered)).alias("altered"))


def ranked(rows: DataFrame, keys: list[str], value: str, weight: str) -> DataFrame:
    """`rows` with `before`: the weights of those rows of the same `keys` (none null) whose `value` (long, not null, once in its
    keys) is smaller. A weight is 1 for most rows; others are listed beside their bitmap."""
    own = rows.selectExpr("*", f"shiftright({value}, {BITS}) as bucket", f"cast({value} & {(1 << BITS) - 1} as int) as place")
    at = [*keys, "bucket"]
    counts, lower, steps = stored(own.groupBy(*at).agg(F.sum(weight).alias("total"))), "bucket", []
    for upper in ("step1", "step2", "step3", None):
        inside = keys
        if upper:
            counts, inside = counts.withColumn(upper, F.expr(f"shiftright({lower}, {BITS})")), [*keys, upper]
        total = f"sum(total) over (partition by {', '.join(inside)} order by {lower} rows between unbounded preceding and 1 preceding)"
        steps.append((counts.selectExpr(*inside, lower, f"coalesce({total}, 0L) as before"), inside))
        counts, lower = counts.groupBy(*inside).agg(F.sum("total").alias("total")), upper
    offsets = steps[-1][0]
    for step, inside in reversed(steps[:-1]):
        offsets = step.join(offsets.withColumnRenamed("before", "further"), inside).withColumn("before", F.expr("before + further")).drop("further", inside[-1])
    heavy = f"collect_list(if({weight} > 1, struct(place, {weight} - 1 as more), null))"
    index = own.groupBy(*at).agg(F.expr("bitmap_construct_agg(place)").alias("bitmap"), F.expr(heavy).alias("heavy")).join(offsets, at)
    byte = "cast(conv(hex(substring(bitmap, place div 8 + 1, 1)), 16, 10) as int)"
    rank = f"bitmap_count(substring(bitmap, 1, cast(place div 8 as int))) + bit_count({byte} & (shiftleft(1, place % 8) - 1))"
    more = "aggregate(filter(heavy, h -> h.place < place), 0L, (s, h) -> s + h.more)"
    return own.join(index, at).withColumn("before", F.expr(f"before + {rank} + {more}")).drop("bucket", "place", "bitmap", "heavy")


def placed(found: DataFrame) -> DataFrame:
    """(set, place, doc_id, leaf, altered): the place of each leaf in its group, from 0. `set` names the group and is never null."""
    keys = ["set", "has_id", "id"]
    rows = found.selectExpr("coalesce(concat('=', group), '') as set", "doc_id is not null as has_id", "coalesce(doc_id, 0L) as id", "leaf", "altered")
    rows = stored(rows.groupBy(*keys, "leaf").agg(F.any_value("altered").alias("altered"), F.count("*").alias("copies")))
    ids = rows.groupBy(*keys).agg(F.sum("copies").alias("weight"), F.count("*").alias("kinds"))
    ids = stored(ranked(ids, ["set", "has_id"], "id", "weight"))
    nulls = ids.where("not has_id").selectExpr("set", "weight as shift")
    ids = ids.join(nulls, "set", "left").selectExpr(*keys, "kinds", "before + if(has_id, coalesce(shift, 0L), 0L) as before")
    # rows of one id that differ: their order is that of the leaf
    both = rows.join(ids, keys)
    tied = both.where("kinds > 1").withColumn("bits", F.expr("cast(conv(left(leaf, 15), 16, 10) as long)"))
    tied = ranked(tied.withColumnRenamed("before", "start"), keys, "bits", "copies").withColumn("before", F.expr("start + before"))
    columns = ["set", "before", "if(has_id, id, null) as doc_id", "leaf", "altered", "copies"]
    return both.where("kinds = 1").selectExpr(*columns).unionByName(tied.selectExpr(*columns)).selectExpr("set", "explode(sequence(before, before + copies - 1)) as place", "doc_id", "leaf", "altered")


def runs(nodes: DataFrame) -> DataFrame:
    """(set, size, parent, children): the nodes (set, size, place, digest, ...) of each run, in order."""
    kept = [c for c in nodes.columns if c not in ("set", "size", "place")]
    return nodes.groupBy("set", "size", F.expr(f"place div {RUN}").alias("parent")).agg(F.array_sort(F.collect_list(F.struct("place", *kept))).alias("children"))


def joined(children: str = "children") -> str:
    return f"sha2(array_join(transform({children}, c -> c.digest), ''), 256)"


def tree(nodes: DataFrame, folder: str) -> tuple[list[DataFrame], DataFrame]:
    """The runs of each level, and (set, digest, height) of what remains of each set of nodes (set, place, digest, ...)."""
    sizes = stored(nodes.groupBy("set").agg(F.count("*").alias("size")), f"{folder}/sizes")
    most = sizes.agg(F.max("size")).first()[0] or 0
    level = nodes.join(sizes, "set")
    levels: list[DataFrame] = []
    left = level.where("size = 1").select("set", "digest", F.lit(0).alias("height"))
    while most > 1:
        level = stored(runs(level.where("size > 1")), f"{folder}/{len(levels)}")
        levels.append(level)
        level = level.selectExpr("set", "parent as place", f"{joined()} as digest", f"(size + {RUN - 1}) div {RUN} as size")
        left = left.unionByName(level.where("size = 1").select("set", "digest", F.lit(len(levels)).alias("height")))
        most = -(-most // RUN)
    return levels, left


def with_paths(run: DataFrame, above: DataFrame, kept: list[str]) -> DataFrame:
    """The children of each run with their path: what stands before and after them, then the path of their parent. `above` has
    (set, place, path) and the columns `kept` of the parents."""
    both = run.join(above.withColumnRenamed("place", "parent"), ["set", "parent"])
    text = "array_join(transform(filter(children, s -> s.place {} c.place), s -> s.digest), '')"
    child = f"transform(children, c -> struct(c as child, concat(array(struct({text.format('<')} as before, {text.format('>')} as after)), path) as path))"
    return both.selectExpr("set", *kept, f"explode({child}) as both").selectExpr("set", *kept, "both.child.*", "both.path as path")


def down(levels: list[DataFrame], tops: DataFrame, leaves: DataFrame, kept: list[str], folder: str) -> DataFrame:
    """`leaves` with their path and the columns `kept` of their top: (set, height, path, ...)."""
    nodes = tops.where(F.col("height") == len(levels)).withColumn("place", F.lit(0))
    for k in range(len(levels) - 1, 0, -1):
        nodes = with_paths(levels[k], nodes, kept).unionByName(tops.where(F.col("height") == k).withColumn("place", F.lit(0)), allowMissingColumns=True)
        nodes = stored(nodes.select("set", "place", "path", *kept), f"{folder}/{k}")
    alone = leaves.join(tops.where("height = 0").select("set", "path", *kept), "set")
    return with_paths(levels[0], nodes, kept).unionByName(alone) if levels else alone


def manifest(found: DataFrame) -> DataFrame:
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified) of the rows of `leaves`."""
    folder = new_path(found.sparkSession)
    nodes = stored(placed(stored(found, f"{folder}/leaves")).withColumnRenamed("leaf", "digest"), f"{folder}/placed")
    levels, subroots = tree(nodes, f"{folder}/tree")
    # the tree of the groups: as many leaves as there are distinct groups
    order = stored(subroots.selectExpr("'' as set", "row_number() over (order by set) - 1L as place", "digest", "set as group", "height as own_height"), f"{folder}/order")
    top_levels, root = tree(order, f"{folder}/top")
    root = root.selectExpr("set", "height", "cast(array() as array<struct<before:string,after:string>>) as path", "digest as root")
    tops = down(top_levels, root, order, ["root"], f"{folder}/top-down")
    tops = stored(tops.selectExpr("group as set", "own_height as height", "path", "root", "digest as subroot"), f"{folder}/tops")
    out = down(levels, tops, nodes, ["root", "subroot"], f"{folder}/down")
    folded = "aggregate(path, coalesce(altered, digest), (d, p) -> sha2(concat(p.before, d, p.after), 256))"
    proof = "sha2(array_join(transform(path, p -> concat(p.before, p.after)), ''), 256)"
    out = out.selectExpr("doc_id", "digest as leaf", "subroot", "root", f"{proof} as proof_sha256", f"{folded} as folded_root")
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest(leaves(table(spark, sf_dir, "documents")))


QUERIES = {"op13_merkle_manifest": op13_merkle_manifest}


def _oracle(levels: int = 7, top_levels: int = 3) -> str:
    """The same in SQL, with places from a sort, for at most 8^7 rows of a group and 8^3 groups."""

    def climb(name: str, count: int) -> list[str]:
        parts = []
        for k in range(count):
            run = "OVER (PARTITION BY grp, place // 8 ORDER BY place ROWS BETWEEN {})"
            before, after = run.format("UNBOUNDED PRECEDING AND 1 PRECEDING"), run.format("1 FOLLOWING AND UNBOUNDED FOLLOWING")
            parts.append(f"{name}_path{k} AS (SELECT grp, place, size, coalesce(string_agg(digest, '') {before}, '') AS b, coalesce(string_agg(digest, '') {after}, '') AS a FROM {name}{k})")
            above = "CASE WHEN size = 1 THEN any_value(digest) ELSE sha256(string_agg(digest, '' ORDER BY place)) END"
            parts.append(f"{name}{k + 1} AS (SELECT grp, place // 8 AS place, {above} AS digest, (size + 7) // 8 AS size FROM {name}{k} GROUP BY grp, place // 8, size)")
        return parts

    def fold(name: str, count: int, source: str) -> tuple[list[str], str]:
        parts = []
        for k in range(count):
            join = f"JOIN {name}_path{k} p ON s.grp IS NOT DISTINCT FROM p.grp AND s.place // {8**k} = p.place"
            parts.append(f"{name}_fold{k} AS (SELECT s.* REPLACE (CASE WHEN p.size = 1 THEN d ELSE sha256(p.b || d || p.a) END AS d, CASE WHEN p.size = 1 THEN proof ELSE proof || p.b || p.a END AS proof) FROM {source} s {join})")
            source = f"{name}_fold{k}"
        return parts, source

    part = "coalesce(strlen(CAST({0} AS VARCHAR)) || ':' || CAST({0} AS VARCHAR), '-')"
    digest = lambda text: f"sha256({' || '.join(part.format(c) for c in COLUMNS[:-1])} || {part.format(text)})"
    step = "xor(v >> 1, 3988292384 * (v & 1))"
    table_ = "SELECT i, i AS v FROM range(256) t(i)"
    for _ in range(8):
        table_ = f"SELECT i, {step} AS v FROM ({table_})"
    crc = "xor(4294967295, list_reduce(list_prepend(CAST(4294967295 AS BIGINT), [CAST(ascii(x) AS BIGINT) FOR x IN string_split(CAST(doc_id AS VARCHAR), '')]), lambda c, x: xor(c >> 8, tab[(xor(c, x) & 255) + 1])))"
    lowered = f"translate(text, '{UPPER}', '{LOWER}')"
    leaves_ = f"SELECT doc_id, lang AS grp, {digest('text')} AS digest, CASE WHEN {crc} % 3 = 0 THEN {digest(lowered)} ELSE {digest('text')} END AS d FROM documents, (SELECT list(v ORDER BY i) AS tab FROM crc)"
    first = "SELECT *, row_number() OVER (PARTITION BY grp ORDER BY doc_id NULLS FIRST, digest) - 1 AS place, count(*) OVER (PARTITION BY grp) AS size FROM leaves"
    top = f"SELECT 0 AS grp, grp AS name, row_number() OVER (ORDER BY grp NULLS FIRST) - 1 AS place, digest, count(*) OVER () AS size FROM n{levels}"
    folds, last = fold("n", levels, "(SELECT *, '' AS proof FROM n0)")
    link = f"linked AS (SELECT f.* EXCLUDE (grp, place), f.digest AS leaf, t.grp, t.place, t.digest AS subroot FROM {last} f JOIN t0 t ON f.grp IS NOT DISTINCT FROM t.name)"
    top_folds, end = fold("t", top_levels, "linked")
    body = f"SELECT doc_id, leaf, subroot, r.digest AS root, sha256(proof) AS proof_sha256, d AS folded_root, d = r.digest AS verified FROM {end} CROSS JOIN (SELECT digest FROM t{top_levels}) r"
    return "WITH " + ", ".join([f"crc AS ({table_})", f"leaves AS ({leaves_})", f"n0 AS ({first})", *climb("n", levels), f"t0 AS ({top})", *climb("t", top_levels), *folds, link, *top_folds]) + " " + body


ORACLE_SQL = {"op13_merkle_manifest": _oracle()}
