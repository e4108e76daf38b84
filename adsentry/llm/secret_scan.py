"""Secret scans: fixed patterns, and strings of high entropy.

Patterns give the spans assign, access and hex. Besides, each long run of token characters is a candidate: a window
slides over it, and its Shannon entropy is kept up to date by the counts of the characters that enter and leave. The
span from the first to the last window that reaches its character class's threshold is added as entropy, unless the
candidate fits the allow-list or lies within a pattern's span. Everything is an SQL function; no Python runs on rows.

Work grows with the length of a text: the characters of a candidate are taken apart once, the counts of a window lie
packed in six numbers, and sums along an array of hits are taken in blocks of about the root of its length (`running`).

Nulls: a null text counts as empty and has no spans. Empty texts, repeated rows and null ids need nothing special, as
each row is judged alone; an empty table gives an empty one. Other columns are ignored by `scan`, whatever their names.
Offsets are code points, the end exclusive; `byte_start` and `byte_stop` are the same places in the UTF-8 bytes.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import quoted, table, whole_text

# The patterns, the group whose length counts, and the least length.
PATTERNS = {
    "assign": (r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    "access": (r"AKIA[A-Z0-9]+", 0, 16),
    "hex": (r"[0-9a-f]{32,}", 0, 32),  # runs of [0-9a-f]+ that are long enough are the same runs
}
KINDS = [*PATTERNS, "entropy"]
CANDIDATE = r"[A-Za-z0-9+/_=-]{24,}"
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
WINDOW = 20
# Bits of entropy for a window of each character class, tried in this order.
CLASSES = {"hex": (r"^[0-9a-fA-F]+$", 3.2), "letters": (r"^[A-Za-z]+$", 4.1), "any": (r"", 3.75)}
# Candidates that are no secrets: UUIDs, rules and words joined by signs.
ALLOW = (
    r"^[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$",
    r"^[a-z]([a-z_/=+-]*[a-z])?$",
    r"^[A-Z]([A-Z_/=+-]*[A-Z])?$",
)
# Parts of a candidate that are no secrets: what stands between / _ = - and holds a placeholder or counted-up characters.
# Only the part is let off, not what stands beside it.
PLACEHOLDER = r"(?i)[a-z0-9+]*(?:example|sample|dummy|placeholder|changeme|redacted|your[_-]|0123456789|1234567890|abcdefghij|qwertyuiop)[a-z0-9+]*"
FILLER = "."  # stands for the characters of such a part; no window with it counts
SPANS = "array<struct<kind:string,start:int,stop:int,byte_start:int,byte_stop:int>>"
HITS = "array<struct<start:int,stop:int,byte_start:int,byte_stop:int,value:string>>"
PACKED = 12  # counts of five bits in one number


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """`use(value)`, where the value is computed once however often it is named."""
    return F.element_at(F.transform(F.array(value), use), 1)


def running(rows: Column, zero: Column, step: Callable[[Column, Column], Column], show: Callable[[Column, Column], Column]) -> Column:
    """`show(x, state before x)` for each element x of an array, where `step(state, x)` gives the next state.

    The elements are taken in blocks of about the root of their number, so that no long array is built piece by piece:
    first each block's state at its end, then the states within the blocks."""

    def grouped(xs: Column) -> Column:
        width = F.ceil(F.sqrt(F.size(xs))).cast("int")
        blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(xs) - 1) / width).cast("int")), lambda k: F.slice(xs, k * width + 1, width))
        return F.when(F.size(xs) > 0, let(blocks, chained))

    def chained(blocks: Column) -> Column:
        def next_block(s: Column, block: Column) -> Column:
            return F.struct(F.aggregate(block, s["state"], step).alias("state"), F.concat(s["seen"], F.array(s["state"])).alias("seen"))

        first = F.struct(zero.alias("state"), F.slice(F.array(zero), 1, 0).alias("seen"))
        before = F.aggregate(blocks, first, next_block, lambda s: s["seen"])
        return F.flatten(F.zip_with(blocks, before, within))

    def within(block: Column, state: Column) -> Column:
        def next_row(s: Column, x: Column) -> Column:
            return F.struct(step(s["state"], x).alias("state"), F.concat(s["out"], F.array(show(x, s["state"]))).alias("out"))

        none = F.slice(F.transform(block, lambda x: show(x, state)), 1, 0)
        return F.aggregate(block, F.struct(state.alias("state"), none.alias("out")), next_row, lambda s: s["out"])

    return let(rows, grouped)


def located(text: Column, pattern: str, group: int = 0) -> Column:
    """(start, stop, byte_start, byte_stop, value) of all leftmost matches without overlaps: what lies between them tells
    where they are."""
    between = F.split(text, pattern, -1)
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    values = F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    pairs = F.zip_with(hits, values, lambda h, v: F.struct(F.length(h).alias("chars"), F.octet_length(h).alias("bytes"), v.alias("value")))
    rows = F.zip_with(F.slice(between, F.lit(1), F.size(hits)), pairs, lambda g, h: F.struct(F.length(g).alias("gap"), F.octet_length(g).alias("byte_gap"), h["chars"].alias("chars"), h["bytes"].alias("bytes"), h["value"].alias("value")))

    def step(at: Column, x: Column) -> Column:
        return F.struct((at["chars"] + x["gap"] + x["chars"]).alias("chars"), (at["bytes"] + x["byte_gap"] + x["bytes"]).alias("bytes"))

    def show(x: Column, at: Column) -> Column:
        start, byte_start = at["chars"] + x["gap"], at["bytes"] + x["byte_gap"]
        return F.struct(start.alias("start"), (start + x["chars"]).alias("stop"), byte_start.alias("byte_start"), (byte_start + x["bytes"]).alias("byte_stop"), x["value"].alias("value"))

    found = running(rows, F.struct(F.lit(0).alias("chars"), F.lit(0).alias("bytes")), step, show)
    return F.when(F.rlike(text, F.lit(pattern)), found.cast(HITS)).otherwise(F.array().cast(HITS))


def hot_part(value: Column, limit: Column) -> Column:
    """(first, stop): from the first to the last window of `value` whose entropy reaches `limit`; first is null if none.

    With counts c, a window of w characters has log2(w) - sum(c * log2(c)) / w bits; only the two counts that change
    enter the running sum. Counts are at most w < 32, so twelve of them fit into one number. Windows that touch a character
    outside the alphabet do not count."""
    plogp = F.array(*[F.lit(c * math.log2(c) if c else 0.0) for c in range(WINDOW + 2)])
    numbers = -(-(len(ALPHABET) + 1) // PACKED)
    # of each character: which number holds its count, one in its place there, and the place
    parted = F.array(*[F.struct(F.lit(c // PACKED).alias("of"), F.lit(1 << 5 * (c % PACKED)).cast("long").alias("one")) for c in range(len(ALPHABET) + 1)])

    def sliding(codes: Column, table: Column, part: Column) -> Column:
        def step(s: Column, i: Column) -> Column:
            came = codes[i]
            went = codes[F.greatest(i - WINDOW, F.lit(0))]
            return let(F.struct(part[came].alias("x"), part[went].alias("y"), (i >= WINDOW).alias("full")), lambda p: moved(s, i, p))

        def moved(s: Column, i: Column, p: Column) -> Column:
            count = lambda part: F.call_function("div", s["counts"][part["of"]], part["one"]) % 32
            taken = F.transform(s["counts"], lambda n, k: n + F.when(k == p["x"]["of"], p["x"]["one"]).otherwise(F.lit(0)) - F.when(p["full"] & (k == p["y"]["of"]), p["y"]["one"]).otherwise(F.lit(0)))
            x, y = count(p["x"]).cast("int"), count(p["y"]).cast("int")
            same = p["full"] & (p["x"]["of"] == p["y"]["of"]) & (p["x"]["one"] == p["y"]["one"])
            change = table[x + 1] - table[x] + F.when(p["full"], table[y - 1] - table[y]).otherwise(F.lit(0.0))
            return let(s["total"] + F.when(same, F.lit(0.0)).otherwise(change), lambda total: judged(s, i, taken, total))

        def judged(s: Column, i: Column, taken: Column, total: Column) -> Column:
            bad = F.when(codes_at(i) == 0, i).otherwise(s["bad"])
            hit = (i - bad >= WINDOW) & (F.lit(math.log2(WINDOW)) - total / WINDOW >= limit)
            first = F.when(s["first"].isNull() & hit, i - WINDOW + 1).otherwise(s["first"])
            return F.struct(taken.alias("counts"), total.alias("total"), first.alias("first"), F.when(hit, i + 1).otherwise(s["stop"]).alias("stop"), bad.alias("bad"))

        def codes_at(i: Column) -> Column:
            return codes[i]

        no = F.lit(None).cast("int")
        start = F.struct(F.array_repeat(F.lit(0).cast("long"), numbers).alias("counts"), F.lit(0.0).alias("total"), no.alias("first"), no.alias("stop"), F.lit(-1).alias("bad"))
        return F.aggregate(F.sequence(F.lit(0), F.size(codes) - 1), start, step, lambda s: F.struct(s["first"].alias("first"), s["stop"].alias("stop")))

    codes = F.transform(F.split(value, ""), lambda c: F.instr(F.lit(ALPHABET), c))
    return let(F.struct(codes.alias("codes"), plogp.alias("plogp"), parted.alias("parted")), lambda v: sliding(v["codes"], v["plogp"], v["parted"]))


def span(kind: Column, x: Column, first: Column | None = None, stop: Column | None = None) -> Column:
    """The span of a hit, or of the part of an ASCII hit from `first` to `stop`."""
    places = {"start": x["start"], "stop": x["stop"], "byte_start": x["byte_start"], "byte_stop": x["byte_stop"]}
    if first is not None:
        places = {"start": x["start"] + first, "stop": x["start"] + stop, "byte_start": x["byte_start"] + first, "byte_stop": x["byte_start"] + stop}
    return F.struct(kind.alias("kind"), *[c.alias(n) for n, c in places.items()])


def without_placeholders(value: Column) -> Column:
    """A candidate of the same length, in which `FILLER` stands for parts that hold a placeholder."""
    pattern = r"(?<![A-Za-z0-9+])" + PLACEHOLDER  # tried where a part begins only
    hits = F.transform(F.regexp_extract_all(value, F.lit(pattern), F.lit(0)), lambda h: F.repeat(F.lit(FILLER), F.length(h)))
    filled = F.array_join(F.zip_with(F.split(value, pattern, -1), hits, lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), "")
    return F.when(F.rlike(value, F.lit(pattern)), filled).otherwise(value)


def pattern_spans(text: Column, kind: str, pattern: str, group: int, least: int) -> Column:
    hits = F.filter(located(text, pattern, group), lambda x: F.length(x["value"]) >= least)
    return F.transform(hits, lambda x: span(F.lit(kind), x))


def spans(text: Column, allow: tuple[str, ...] = ALLOW) -> Column:
    """All spans of a text: by start, then in the order of KINDS."""
    base = F.concat(*[pattern_spans(text, kind, *rule) for kind, rule in PATTERNS.items()])

    def allowed(v: Column) -> Column:
        out = F.lit(False)
        for a in allow:
            out = out | F.rlike(v, F.lit(a))
        return out

    def limit(v: Column) -> Column:
        out = F.lit(None).cast("double")
        for pattern, bits in reversed(CLASSES.values()):
            out = F.when(F.rlike(v, F.lit(pattern)), F.lit(bits)).otherwise(out)
        return out

    candidates = F.filter(located(text, CANDIDATE), lambda x: ~allowed(x["value"]))
    hot = F.transform(candidates, lambda x: let(limit(x["value"]), lambda bits: F.struct(x.alias("x"), hot_part(without_placeholders(x["value"]), bits).alias("part"))))
    hot = F.transform(F.filter(hot, lambda h: h["part"]["first"].isNotNull()), lambda h: span(F.lit("entropy"), h["x"], h["part"]["first"], h["part"]["stop"]))
    rank = F.create_map(*[F.lit(v) for i, k in enumerate(KINDS) for v in (k, i)])
    keyed = F.array_sort(F.transform(F.concat(base, hot), lambda x: F.struct(x["start"].alias("start"), rank[x["kind"]].alias("rank"), x["stop"].alias("stop"), x.alias("span"))))

    # in this order, a pattern's span that holds an entropy span stands before it
    def reach(last: Column, x: Column) -> Column:
        return F.when(x["rank"] < len(PATTERNS), F.greatest(last, x["stop"])).otherwise(last)

    shown = running(keyed, F.lit(0), reach, lambda x, last: F.struct(x["span"].alias("span"), ((x["rank"] < len(PATTERNS)) | (last < x["stop"])).alias("stays")))
    found = F.transform(F.filter(shown, lambda x: x["stays"]), lambda x: x["span"])
    return F.coalesce(found, F.array()).cast(SPANS)


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, text and secrets, the spans, of every document."""
    return docs.select("doc_id", whole_text().alias("text")).withColumn("secrets", spans(F.col("text")))


def redacted(text: Column, secrets: Column, mark: str = "[SECRET]") -> Column:
    """The text with each span, or union of overlapping spans, replaced by `mark`."""

    def pieces(raw: Column) -> Column:
        gap = lambda x, last: F.concat(F.substring(raw, last + 1, x["byte_start"] - last), F.lit(mark).cast("binary"))
        parts = running(secrets, F.lit(0), lambda last, x: F.greatest(last, x["byte_stop"]), lambda x, last: F.when(x["byte_start"] >= last, gap(x, last)).otherwise(F.lit(b"")))
        end = F.array_max(F.transform(secrets, lambda x: x["byte_stop"]))
        tail = F.substring(raw, end + 1, F.octet_length(raw))
        return F.array_join(F.transform(F.concat(parts, F.array(tail)), lambda x: x.cast("string")), "")

    return F.when(F.size(secrets) == 0, text).otherwise(let(text.cast("binary"), pieces))


def clean(docs: DataFrame) -> DataFrame:
    """The rows of `docs`, with all their columns, whose secrets are replaced by a mark; the column n_chars, if there is
    one, gets the new length of a changed text. A text without secrets stays as it is, and so does null."""
    hide = let(spans(whole_text()), lambda found: F.struct((F.size(found) > 0).alias("changed"), redacted(F.col("text"), found).alias("text")))
    rows = docs.select(F.struct(*[quoted(c) for c in docs.columns]).alias("row"), hide.alias("new"))
    changed, own = F.col("new.changed"), {c: F.col("row")[c] for c in docs.columns}
    own["text"] = F.when(changed, F.col("new.text")).otherwise(own["text"])
    if "n_chars" in own:
        own["n_chars"] = F.when(changed, F.length("new.text").cast(docs.schema["n_chars"].dataType)).otherwise(own["n_chars"])
    return rows.select(*[own[c].alias(c) for c in docs.columns])


def written(secrets: Column) -> Column:
    return F.array_join(F.transform(secrets, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["stop"].cast("string"))), ",")


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(table(spark, sf_dir, "documents")).select("doc_id", "secrets")
    count = lambda kind: F.size(F.filter("secrets", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("secrets", lambda x: x["kind"] != "entropy")
    return found.select("doc_id", *map(count, PATTERNS), F.sha2(written(base), 256).alias("base_sha256"), written(F.col("secrets")).alias("spans"), count("entropy"))


def _quoted(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


def _located_sql(kind: str, rank: int, pattern: str, group: int, least: int) -> str:
    """The hits of a pattern as (doc_id, kind, rank, start, stop, value)."""
    p = _quoted(pattern)
    return f"""
        SELECT doc_id, '{kind}' AS kind, {rank} AS rank, start, start + length(hits[i]) AS stop, vals[i] AS value
        FROM (
            SELECT *, coalesce(list_sum(list_transform(gaps[1:i], lambda x: length(x))), 0) + coalesce(list_sum(list_transform(hits[1:i - 1], lambda x: length(x))), 0) AS start
            FROM (
                SELECT *, unnest(range(1, len(hits) + 1)) AS i
                FROM (SELECT doc_id, string_split_regex(text, {p}) AS gaps, regexp_extract_all(text, {p}, 0) AS hits, regexp_extract_all(text, {p}, {group}) AS vals FROM texts)
            )
        )
        WHERE length(vals[i]) >= {least}"""


def _oracle() -> str:
    base = " UNION ALL ".join(_located_sql(kind, rank, *rule) for rank, (kind, rule) in enumerate(PATTERNS.items()))
    allowed = " OR ".join(f"regexp_matches(value, {_quoted(a)})" for a in ALLOW)
    limit = " ".join(f"WHEN regexp_matches(value, {_quoted(p)}) THEN {bits}" for p, bits in CLASSES.values())
    return f"""
    WITH texts AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
    base AS ({base}),
    candidates AS (SELECT *, CASE {limit} END AS bits FROM ({_located_sql("entropy", len(PATTERNS), CANDIDATE, 0, 0)}) WHERE NOT ({allowed})),
    parted AS (SELECT * EXCLUDE (value), string_split_regex(value, {_quoted(PLACEHOLDER)}) AS parts, regexp_extract_all(value, {_quoted(PLACEHOLDER)}) AS hits FROM candidates),
    filled AS (SELECT * EXCLUDE (parts, hits), array_to_string([parts[i] || repeat('{FILLER}', coalesce(length(hits[i]), 0)::BIGINT) FOR i IN range(1, len(parts) + 1)], '') AS value FROM parted),
    windows AS (SELECT *, unnest(range(0, length(value) - {WINDOW} + 1)) AS w FROM filled),
    characters AS (SELECT doc_id, start, w, bits, substr(value, (w + 1 + unnest(range(0, {WINDOW})))::BIGINT, 1) AS c FROM windows),
    counts AS (SELECT doc_id, start, w, bits, c, count(*) AS n FROM characters GROUP BY ALL),
    hot AS (SELECT doc_id, start, w FROM counts GROUP BY doc_id, start, w, bits HAVING bool_and(c <> '{FILLER}') AND log2({WINDOW}) - sum(n * log2(n)) / {WINDOW} >= bits),
    more AS (SELECT doc_id, 'entropy' AS kind, {len(PATTERNS)} AS rank, start + min(w) AS start, start + max(w) + {WINDOW} AS stop FROM hot GROUP BY doc_id, hot.start),
    found AS (
        SELECT doc_id, kind, rank, start, stop FROM base
        UNION ALL SELECT * FROM more WHERE NOT EXISTS (SELECT 1 FROM base b WHERE b.doc_id = more.doc_id AND b.start <= more.start AND b.stop >= more.stop)
    ),
    written AS (SELECT *, kind || ':' || start::BIGINT || ':' || stop::BIGINT AS s FROM found)
    SELECT
        t.doc_id,
        {", ".join(f"count(*) FILTER (kind = '{k}') AS n_{k}" for k in KINDS)},
        sha256(coalesce(string_agg(s, ',' ORDER BY start, rank) FILTER (kind <> 'entropy'), '')) AS base_sha256,
        coalesce(string_agg(s, ',' ORDER BY start, rank), '') AS spans
    FROM texts t LEFT JOIN written USING (doc_id) GROUP BY t.doc_id"""


QUERIES = {"op1_secret_scan": op1_secret_scan}
ORACLE_SQL = {"op1_secret_scan": _oracle()}
