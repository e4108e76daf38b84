"""Sentences with their places, the passages that people mark in them, and how people and rules agree on them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.redact import LINE_END, SENTENCE_END
from . import annotation as A

MARK = "\ue000"  # put where a sentence ends without a line end
BUCKET = 256
UNMARKED = "keins"
EXAMPLES = 15


def sentence_table(texts: DataFrame, key: str = "task") -> DataFrame:
    """(key, nr, start, stop, sentence) of texts (key, text): TXT-26 with offsets in code points, the end exclusive; nr counts from 0.

    What separates two parts is either a character of the text or a mark that was put in; so offsets are running sums of lengths."""
    marked = F.regexp_replace(F.translate(F.coalesce("text", F.lit("")), MARK, " "), SENTENCE_END, "$1" + MARK)
    cut = LINE_END[:-1] + MARK + "]"
    parts = texts.select(key, F.split(marked, cut, -1).alias("p"), F.regexp_extract_all(marked, F.lit(f"({cut})"), F.lit(1)).alias("s"))
    parts = parts.select(key, F.posexplode(F.arrays_zip("p", "s")).alias("i", "x")).select(key, "i", F.col("x.p").alias("p"), F.length("x.p").alias("size"), ((F.col("x.s") != MARK) & F.col("x.s").isNotNull()).cast("int").alias("sep"))
    over = Window.partitionBy(key).orderBy("i")
    start = F.coalesce(F.sum(F.col("size") + F.col("sep")).over(over.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    lead = F.col("size") - F.length(F.regexp_replace("p", r"(?U)^\s+", ""))
    sentence = F.regexp_replace("p", r"(?U)^\s+|\s+$", "")
    placed = parts.select(key, "i", (start + lead).cast("int").alias("start"), sentence.alias("sentence")).where("sentence <> ''")
    nr = F.row_number().over(Window.partitionBy(key).orderBy("i")) - 1
    return placed.select(key, nr.alias("nr"), "start", (F.col("start") + F.length("sentence")).alias("stop"), "sentence")


def marked_sentences(sentences: DataFrame, marks: DataFrame, key: str = "task") -> DataFrame:
    """(key, person, nr, signal): which sentences a person's marks (key, person, start, stop, signal) touch.

    Both sides are cut into buckets of offsets, so that the intervals meet in an equality join. Of several marks of a person in a sentence the
    one that begins first counts."""
    buckets = lambda df: df.withColumn("bucket", F.explode(F.expr(f"sequence(start div {BUCKET}, greatest(start, stop - 1) div {BUCKET})")))
    s = buckets(sentences.select(key, "nr", "start", "stop")).alias("s")
    m = buckets(marks.where("stop > start")).alias("m")
    on = (F.col(f"s.{key}") == F.col(f"m.{key}")) & (F.col("s.bucket") == F.col("m.bucket")) & (F.col("s.start") < F.col("m.stop")) & (F.col("m.start") < F.col("s.stop"))
    met = m.join(s, on).select(F.col(f"s.{key}").alias(key), "m.person", "s.nr", F.struct("m.start", "m.signal").alias("x"))
    return met.groupBy(key, "person", "nr").agg(F.min("x")["signal"].alias("signal"))


def level_votes(ratings: DataFrame, sentences: DataFrame, marked: DataFrame, images: DataFrame) -> DataFrame:
    """(level, unit, value): the votes of AGG-17 at its six levels.

    ratings: task, person, verdict, scheme, the newest of each person. images: task, person, image, kind, flag. Sentences and images count
    where at least two people rated; whoever did not mark a sentence voted for `UNMARKED`."""
    several = ratings.groupBy("task").agg(F.count("*").alias("n")).where("n > 1").select("task")
    votes = lambda df, level, unit, value: df.select(F.lit(level).alias("level"), F.concat_ws("/", *unit).alias("unit"), value.alias("value")).where("value IS NOT NULL")
    each = ratings.select("task", "person").join(several, "task").join(sentences.select("task", "nr"), "task").join(marked, ["task", "person", "nr"], "left")
    signal = F.coalesce("signal", F.lit(UNMARKED))
    shown = images.join(several, "task")
    return (
        votes(ratings, "verdict", ["task"], F.when(F.col("verdict").isin("betrug", "serioes"), F.col("verdict")))
        .unionByName(votes(ratings, "scheme", ["task"], F.when(F.col("verdict") == "betrug", F.col("scheme"))))
        .unionByName(votes(each, "sentence_flag", ["task", "nr"], (signal != UNMARKED).cast("string")))
        .unionByName(votes(each, "sentence_kind", ["task", "nr"], signal))
        .unionByName(votes(shown, "image_kind", ["task", "image"], F.col("kind")))
        .unionByName(votes(shown, "image_flag", ["task", "image"], F.col("flag")))
    )


def consensus_sentences(ratings: DataFrame, marked: DataFrame) -> DataFrame:
    """(task, nr, signal): sentences that more than half of a task's people marked, with the signal that most of these gave."""
    people = ratings.groupBy("task").agg(F.count_distinct("person").alias("people"))
    counts = marked.groupBy("task", "nr").agg(F.count_distinct("person").alias("marks")).join(people, "task").where("2 * marks > people")
    return A.majority(marked, ["task", "nr"], "signal").join(counts.select("task", "nr"), ["task", "nr"]).select("task", "nr", F.col("winner").alias("signal"))


def rules_against_people(sentences: DataFrame, human: DataFrame, rules: Column, known: list[str]) -> tuple[DataFrame, DataFrame]:
    """AGG-26 by sentence. First (signal, tp, fp, fn, precision, recall): of each of the `known` signals, and of all together under `*`, where
    any signal of the rules meets any of people. Second (kind, task, nr, signal, sentence): up to `EXAMPLES` sentences that the rules
    missed, and as many false alarms, by task and place. `rules` gives the signals of column `sentence`."""
    each = sentences.select("task", "nr", "sentence", rules.alias("found")).join(human.withColumnRenamed("signal", "given"), ["task", "nr"], "left")
    hit, told = F.size("found") > 0, F.col("given").isNotNull()
    # all counts, and both kinds of examples, out of one pass over the sentences, whose rules are what takes time
    own = F.filter(F.array_union("found", F.array_compact(F.array("given"))), lambda s: s.isin(known))
    single = F.transform(own, lambda s: F.struct(s.alias("signal"), F.array_contains("found", s).alias("a"), F.coalesce(F.col("given") == s, F.lit(False)).alias("b")))
    every = each.select(F.explode(F.concat(single, F.array(F.struct(F.lit("*").alias("signal"), hit.alias("a"), told.alias("b"))))).alias("x")).select("x.*")
    a, b = F.col("a"), F.col("b")
    counts = every.groupBy("signal").agg(F.count_if(a & b).alias("tp"), F.count_if(a & ~b).alias("fp"), F.count_if(~a & b).alias("fn"))
    share = lambda other: F.when(F.col("tp") + F.col(other) > 0, F.col("tp") / (F.col("tp") + F.col(other)))
    shown = each.where(told != hit).select(F.when(told, "missed").otherwise("false alarm").alias("kind"), "task", "nr", F.when(told, F.col("given")).otherwise(F.array_join(F.array_sort("found"), ", ")).alias("signal"), "sentence")
    place = F.row_number().over(Window.partitionBy("kind").orderBy("task", "nr"))  # a task passes on as many rows of a kind as may be shown
    examples = shown.withColumn("place", place).where(F.col("place") <= EXAMPLES).drop("place")
    return counts.select("signal", "tp", "fp", "fn", share("fp").alias("precision"), share("fn").alias("recall")), examples
