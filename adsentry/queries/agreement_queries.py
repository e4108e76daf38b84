"""Ratings: `events` as the log of people (user_id) who give units (a key in props) a value (event_type)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import normalize as N
from ..operators import annotation as A
from ..operators import sentences as Z
from .base import tables


def _log(spark: SparkSession, sf_dir: str) -> DataFrame:
    (events,) = tables(spark, sf_dir, "events")
    return events.select(F.get_json_object("props", "$.k").cast("int").alias("task"), (F.col("user_id") % 7).alias("person"), F.col("event_type").alias("value"), F.col("value").alias("amount"), "ts", "event_id")


def _ratings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.latest(_log(spark, sf_dir), ["task", "person"], F.desc("ts"), F.desc("event_id"))


def _decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of an amount of 100 or more stand for decisions."""
    return A.latest(_log(spark, sf_dir).filter("amount >= 100"), ["task"], F.desc("ts"), F.desc("event_id"))


def _tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    (docs,) = tables(spark, sf_dir, "documents")
    return docs.select(F.col("doc_id").cast("int").alias("task"), F.sha1(F.col("doc_id").cast("string")).alias("id"))


def win01_latest_ratings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ratings(spark, sf_dir).select("task", "person", "value")


def win02_latest_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _decisions(spark, sf_dir).select("task", "value")


def win03_first_task(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.latest(_log(spark, sf_dir), ["task"], F.asc("ts"), F.asc("event_id")).select("task", "event_id")


def win04_last_ratings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ratings(spark, sf_dir).filter("person = 3").orderBy(F.desc("ts"), F.desc("event_id")).limit(5).select("task", "value")


def win05_join03_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tasks that person 3 may rate next, where the clicks are the ratings."""
    return A.queue(_tasks(spark, sf_dir), _ratings(spark, sf_dir).filter("value = 'click'"), "3")


def win06_hash_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tasks(spark, sf_dir).filter(A.hash_share(F.col("id")) < 0.25).select("task")


def win07_balanced_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    (labels,) = tables(spark, sf_dir, "labels")
    return A.balanced_sample(labels, "toxic", F.sha1(F.col("doc_id").cast("string")), 60, [0, 1]).select("doc_id", "toxic")


def join01_ratings_of_tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    tasks = _log(spark, sf_dir).filter("value = 'purchase'").select("task").distinct()  # the others' ratings are orphans
    return _ratings(spark, sf_dir).join(tasks, "task").groupBy("task").agg(F.count("*").alias("n"))


def agg18_majority(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.majority(_ratings(spark, sf_dir), ["task"], "value")


def agg19_join02_consensus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.consensus(_ratings(spark, sf_dir), _decisions(spark, sf_dir), unsure="error")


def agg22_scheme_of_fraud_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The majority among the votes of one verdict only; a decision overrides it."""
    votes = A.majority(_log(spark, sf_dir).filter("value = 'click'").withColumn("scheme", (F.col("event_id") % 3).cast("string")), ["task"], "scheme")
    decided = _decisions(spark, sf_dir).select("task", F.col("value").alias("decided"))
    return votes.join(decided, "task", "left").select("task", F.coalesce("decided", "winner").alias("scheme"))


def agg12_17_alpha(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Agreement at two levels at once."""
    ratings = _ratings(spark, sf_dir)
    levels = ratings.select(F.lit("value").alias("level"), F.col("task").alias("unit"), "value").unionByName(ratings.select(F.lit("is_click").alias("level"), F.col("task").alias("unit"), (F.col("value") == "click").cast("string").alias("value")))
    found = A.krippendorff(levels, ["level"])
    return found.select("level", F.round("alpha", 9).alias("alpha"), F.round("percent", 9).alias("percent"), "shared", A.reading(F.col("alpha")).alias("reading"))


def agg15_join09_kappa(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = A.kappas(_ratings(spark, sf_dir).select(F.col("task").alias("unit"), "person", "value"))
    return found.select("a", "b", "n", F.round("kappa", 9).alias("kappa"))


def agg20_marked_by_most(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values that more than half of a task's raters gave at any time."""
    log = _log(spark, sf_dir)
    raters = log.groupBy("task").agg(F.count_distinct("person").alias("raters"))
    marks = log.groupBy("task", "value").agg(F.count_distinct("person").alias("marks"))
    return marks.join(raters, "task").filter("marks * 2 > raters").select("task", "value")


def agg21_image_consensus(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = _log(spark, sf_dir).withColumn("image", F.col("event_id") % 4)
    return A.majority(log, ["task", "image"], "value").select("task", "image", F.col("winner").alias("kind"))


def agg23_contradictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = tables(spark, sf_dir, "documents", "labels")
    found = A.consensus(_ratings(spark, sf_dir)).join(labels.select(F.col("doc_id").alias("task"), "toxic"), "task").join(docs.select(F.col("doc_id").alias("task"), "source"), "task")
    return found.groupBy("source").agg(F.count("*").alias("n"), F.count_if((F.col("verdict") == "click") & (F.col("toxic") == 0)).alias("contradictions"))


def agg24_nrm23_quality_hints(spark: SparkSession, sf_dir: str) -> DataFrame:
    (events,) = tables(spark, sf_dir, "events")
    verdict = F.when(F.col("event_type") == "click", "betrug").otherwise("serioes")
    scheme, _ = A.normalized_rating(verdict, F.when(F.col("event_id") % 3 > 0, "vorkasse"), F.lit("kaeufer"))
    return events.select("event_id", A.quality_hint(F.col("event_id") % 7, F.col("user_id") * 4, verdict, scheme, F.col("event_id") % 4).alias("hint"))


def agg25_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = A.consensus(_ratings(spark, sf_dir), _decisions(spark, sf_dir), unsure="error")
    return found.groupBy("status", "verdict").agg(F.count("*").alias("n"))


def agg31_image_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = _log(spark, sf_dir)
    return A.image_verdict(log.select("task", F.when(F.col("value") == "click", "ja").when(F.col("value") == "error", None).otherwise("nein").alias("flag")), "task")


def agg26_rules_against_people(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per signal of the rules: hits, false alarms and misses against the ratings of sentences."""
    from ..functions import signals as S
    from ..functions import wording as W
    from .base import listings

    rows = listings(spark, sf_dir).select("doc_id", W.codebook_signals(S.codes(W.lexicon_signals(F.col("description")))).alias("found"), F.when(F.col("doc_id") % 15 < 12, F.array(F.lit("zahlungslink"), F.lit("zeitdruck"))).otherwise(F.array()).alias("given"))
    each = rows.select(F.explode(F.array_union("found", "given")).alias("signal"), "found", "given")
    has = lambda c: F.array_contains(c, F.col("signal"))
    return each.groupBy("signal").agg(F.count_if(has("found") & has("given")).alias("tp"), F.count_if(has("found") & ~has("given")).alias("fp"), F.count_if(~has("found") & has("given")).alias("fn"))


SIGNALS = {"click": "zahlungslink", "purchase": "zeitdruck", "view": "vorkasse", "search": "kontakt_extern"}


def _rated_texts(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Ratings (task, person, verdict, scheme), marks (task, person, start, stop, signal) and texts (task, text). Whoever rates a text marks
    the word in it that the number of the rating leads to."""
    (docs,) = tables(spark, sf_dir, "documents")
    texts = docs.select(F.col("doc_id").cast("int").alias("task"), "text")
    log = A.latest(_log(spark, sf_dir), ["task", "person"], F.desc("ts"), F.desc("event_id")).join(texts, "task")
    verdict = F.when(F.col("value") == "click", "betrug").when(F.col("value") == "error", "unklar").otherwise("serioes")
    ratings = log.select("task", "person", verdict.alias("verdict"), F.element_at(F.array(F.lit("vorkasse"), F.lit("phishing"), F.lit("fake")), (F.col("event_id") % 3 + 1).cast("int")).alias("scheme"))
    words = F.split("text", " ")
    at = (F.col("event_id") % F.least(F.size(words), F.lit(12))).cast("int")
    before = F.aggregate(F.slice(words, F.lit(1), at), F.lit(0), lambda n, w: n + F.length(w) + 1)
    lookup = F.create_map(*[F.lit(x) for kv in SIGNALS.items() for x in kv])
    signal = F.coalesce(F.try_element_at(lookup, F.col("value")), F.lit("druck"))
    marks = log.select("task", "person", before.alias("start"), (before + F.length(F.get(words, at))).alias("stop"), signal.alias("signal"))
    return ratings, marks, texts


def agg17_six_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Agreement on verdicts, schemes, sentences and images."""
    ratings, marks, texts = _rated_texts(spark, sf_dir)
    sentences = Z.sentence_table(texts.join(ratings.select("task").distinct(), "task"))
    images = _log(spark, sf_dir).select("task", "person", (F.col("event_id") % 4).alias("image"), F.col("value").alias("kind"), F.when(F.col("value") == "click", "ja").otherwise("nein").alias("flag"))
    found = A.krippendorff(Z.level_votes(ratings, sentences, Z.marked_sentences(sentences, marks), images), ["level"])
    return found.select("level", F.round("alpha", 9).alias("alpha"), F.round("percent", 9).alias("percent"), "shared", A.reading(F.col("alpha")).alias("reading"))


def _against(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    from ..functions import signals as S
    from ..functions import wording as W
    from ..plans import dimensions as D

    ratings, marks, texts = _rated_texts(spark, sf_dir)
    sentences = Z.sentence_table(texts)
    touched = Z.sentence_table(texts.join(marks.select("task").distinct(), "task", "left_semi"))  # marks touch no other texts' sentences
    human = Z.consensus_sentences(ratings, Z.marked_sentences(touched, marks))
    rules = W.codebook_signals(S.codes(W.lexicon_signals(F.col("sentence"))))
    return Z.rules_against_people(sentences, human, rules, sorted({s for _, _, _, s, _ in D.LEXICON if s}))


def agg26_rules_by_sentence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules against people's consensus, sentence by sentence of all texts."""
    return _against(spark, sf_dir)[0]


def agg26_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Up to 15 sentences that the rules missed, and as many false alarms."""
    return _against(spark, sf_dir)[1]


LOG = "SELECT CAST(json_extract_string(props, '$.k') AS INT) AS task, user_id % 7 AS person, event_type AS value, value AS amount, ts, event_id FROM events"
RATINGS = "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY task, person ORDER BY ts DESC, event_id DESC) AS r FROM log) WHERE r = 1"
DECISIONS = "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY task ORDER BY ts DESC, event_id DESC) AS r FROM log WHERE amount >= 100) WHERE r = 1"
TASKS = "SELECT doc_id::INT AS task, sha1(CAST(doc_id AS STRING)) AS id FROM documents"
MAJORITY = "SELECT task, value AS winner, next IS NULL OR n > next AS is_unique FROM (SELECT *, row_number() OVER (PARTITION BY task ORDER BY n DESC, value) AS r, lead(n) OVER (PARTITION BY task ORDER BY n DESC, value) AS next FROM (SELECT task, value, count(*) AS n FROM {0} GROUP BY ALL)) WHERE r = 1"


def _sql(body: str, **more: str) -> str:
    parts = {"log": LOG, "ratings": RATINGS, "decisions": DECISIONS, "tasks": TASKS} | more
    return "WITH " + ", ".join(f"{n} AS ({q})" for n, q in parts.items()) + " " + body


def _consensus(decided: str) -> dict[str, str]:
    return {
        "sure": "SELECT * FROM ratings WHERE value <> 'error'" if decided else "SELECT * FROM ratings WHERE value <> 'unklar'",
        "major": MAJORITY.format("sure"),
        "cons": f"""SELECT task, status, CASE WHEN status = 'entschieden' THEN nullif(decided, 'error') WHEN status IN ('einfach', 'einig', 'mehrheit') THEN winner END AS verdict FROM (
            SELECT t.task, winner, decided, CASE WHEN decided IS NOT NULL THEN 'entschieden' WHEN votes IS NULL THEN 'unklar' WHEN votes = 1 THEN 'einfach' WHEN kinds = 1 THEN 'einig' WHEN is_unique THEN 'mehrheit' ELSE 'konflikt' END AS status
            FROM (SELECT DISTINCT task FROM ratings) t LEFT JOIN (SELECT task, count(*) AS votes, count(DISTINCT value) AS kinds FROM sure GROUP BY task) c USING (task) LEFT JOIN major USING (task)
            LEFT JOIN (SELECT task, value AS decided FROM decisions {'' if decided else 'WHERE false'}) d USING (task))""",
    }


ALPHA = {
    "lv": "SELECT 'value' AS level, task AS unit, value FROM ratings UNION ALL SELECT 'is_click', task, CAST(value = 'click' AS STRING) FROM ratings",
    "k": "SELECT level, unit, value, count(*) AS k FROM lv GROUP BY ALL",
    "u": "SELECT level, unit, sum(k) AS m, count(*) AS kinds FROM k GROUP BY ALL HAVING sum(k) >= 2",
    "o": "SELECT a.level, a.value AS c, b.value AS d, sum(a.k * (b.k - CASE WHEN a.value = b.value THEN 1 ELSE 0 END) / (u.m - 1)) AS o FROM k a JOIN k b ON a.level = b.level AND a.unit = b.unit JOIN u ON u.level = a.level AND u.unit = a.unit GROUP BY ALL",
    "nc": "SELECT level, c, sum(o) AS n_c FROM o GROUP BY ALL",
    "t": "SELECT level, sum(n_c) AS n, sum(n_c * n_c) AS n2 FROM nc GROUP BY level",
    "al": "SELECT t.level, CASE WHEN n > 1 AND n * n - n2 > 1e-12 THEN 1 - (n - 1) * (SELECT sum(o) FROM o WHERE o.level = t.level AND c <> d) / (n * n - n2) END AS alpha FROM t",
}
KAPPA = {
    "p": "SELECT x.person AS a, y.person AS b, x.value AS va, y.value AS vb FROM ratings x JOIN ratings y ON x.task = y.task AND x.person < y.person",
    "n": "SELECT a, b, count(*) AS n, avg(CASE WHEN va = vb THEN 1.0 ELSE 0.0 END) AS po FROM p GROUP BY ALL",
    "ch": "SELECT l.a, l.b, sum(l.c * r.c) AS lr FROM (SELECT a, b, va AS v, count(*) AS c FROM p GROUP BY ALL) l JOIN (SELECT a, b, vb AS v, count(*) AS c FROM p GROUP BY ALL) r ON l.a = r.a AND l.b = r.b AND l.v = r.v GROUP BY l.a, l.b",
}
QUERIES = {f.__name__: f for f in (
    win01_latest_ratings, win02_latest_decisions, win03_first_task, win04_last_ratings, win05_join03_queue, win06_hash_share, win07_balanced_sample, join01_ratings_of_tasks, agg18_majority, agg19_join02_consensus, agg22_scheme_of_fraud_votes,
    agg12_17_alpha, agg15_join09_kappa, agg20_marked_by_most, agg21_image_consensus, agg23_contradictions, agg24_nrm23_quality_hints, agg25_report, agg31_image_verdict, agg26_rules_against_people, agg17_six_levels, agg26_rules_by_sentence, agg26_examples,
)}
ORACLE_SQL = {
    "win01_latest_ratings": _sql("SELECT task, person, value FROM ratings"),
    "win02_latest_decisions": _sql("SELECT task, value FROM decisions"),
    "win03_first_task": _sql("SELECT task, event_id FROM (SELECT *, row_number() OVER (PARTITION BY task ORDER BY ts, event_id) AS r FROM log) WHERE r = 1"),
    "win04_last_ratings": _sql("SELECT task, value FROM ratings WHERE person = 3 ORDER BY ts DESC, event_id DESC LIMIT 5"),
    "win05_join03_queue": _sql("SELECT task, CASE WHEN n IS NULL THEN 1 ELSE 0 END AS priority, sha1('3|' || id) AS place FROM tasks LEFT JOIN (SELECT task, count(DISTINCT person) AS n, bool_or(person = 3) AS mine FROM ratings WHERE value = 'click' GROUP BY task) USING (task) WHERE NOT coalesce(mine, false) AND (n IS NULL OR (n < 2 AND ('0x' || left(id, 8))::BIGINT / 4294967295.0 < 0.25))"),
    "win06_hash_share": _sql("SELECT task FROM tasks WHERE ('0x' || left(id, 8))::BIGINT / 4294967295.0 < 0.25"),
    "win07_balanced_sample": "SELECT doc_id, toxic FROM (SELECT *, row_number() OVER (PARTITION BY toxic ORDER BY sha1(CAST(doc_id AS STRING))) > 30 AS rest FROM labels) ORDER BY rest, sha1(CAST(doc_id AS STRING)) LIMIT 60",
    "join01_ratings_of_tasks": _sql("SELECT task, count(*) AS n FROM ratings WHERE task IN (SELECT task FROM log WHERE value = 'purchase') GROUP BY task"),
    "agg18_majority": _sql(MAJORITY.format("ratings")),
    "agg19_join02_consensus": _sql("SELECT * FROM cons", **_consensus("x")),
    "agg22_scheme_of_fraud_votes": _sql("SELECT m.task, coalesce(d.value, winner) AS scheme FROM (" + MAJORITY.format("(SELECT task, CAST(event_id % 3 AS STRING) AS value FROM log WHERE value = 'click')") + ") m LEFT JOIN decisions d ON m.task = d.task"),
    "agg12_17_alpha": _sql("SELECT level, round(alpha, 9) AS alpha, round(percent, 9) AS percent, shared, CASE WHEN alpha IS NULL THEN 'nicht berechenbar' WHEN alpha >= 0.8 THEN 'verlässlich' WHEN alpha >= 0.667 THEN 'vorläufig verwendbar' ELSE 'zu gering' END AS reading FROM al JOIN (SELECT level, avg(CASE WHEN kinds = 1 THEN 1.0 ELSE 0.0 END) AS percent, count(*) AS shared FROM u GROUP BY level) USING (level)", **ALPHA),
    "agg15_join09_kappa": _sql("SELECT n.a, n.b, n, round(CASE WHEN coalesce(lr, 0) / (n * n) < 1 - 1e-12 THEN (po - coalesce(lr, 0) / (n * n)) / (1 - coalesce(lr, 0) / (n * n)) END, 9) AS kappa FROM n LEFT JOIN ch ON n.a = ch.a AND n.b = ch.b", **KAPPA),
    "agg20_marked_by_most": _sql("SELECT task, value FROM (SELECT task, value, count(DISTINCT person) AS marks FROM log GROUP BY ALL) JOIN (SELECT task, count(DISTINCT person) AS raters FROM log GROUP BY task) USING (task) WHERE marks * 2 > raters"),
    "agg21_image_consensus": _sql("SELECT task, image, value AS kind FROM (SELECT task, image, value, row_number() OVER (PARTITION BY task, image ORDER BY count(*) DESC, value) AS r FROM (SELECT *, event_id % 4 AS image FROM log) GROUP BY task, image, value) WHERE r = 1"),
    "agg23_contradictions": _sql("SELECT source, count(*) AS n, count(*) FILTER (verdict = 'click' AND toxic = 0) AS contradictions FROM cons JOIN labels l ON l.doc_id = task JOIN documents d ON d.doc_id = task GROUP BY source", **_consensus("")),
    "agg24_nrm23_quality_hints": "SELECT event_id, CASE WHEN event_id % 7 < 3 AND user_id * 4 > 200 THEN 'sehr schnell' WHEN event_type = 'click' AND event_id % 3 = 0 THEN 'Betrug ohne Masche' WHEN event_type <> 'click' AND event_id % 4 >= 2 THEN 'seriös mit Warnsignalen' WHEN event_type = 'click' AND event_id % 4 = 0 THEN 'Betrug ohne Warnsignal' END AS hint FROM events",
    "agg25_report": _sql("SELECT status, verdict, count(*) AS n FROM cons GROUP BY ALL", **_consensus("x")),
    "agg31_image_verdict": _sql("SELECT task, CASE WHEN bool_or(value = 'click') THEN 'betrug' WHEN bool_and(value <> 'error') THEN 'serioes' ELSE 'unklar' END AS verdict FROM log GROUP BY task"),
}
