"""Phrase mining, TF-IDF, similar cases, hashes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import wording as W
from ..operators import mining as M
from ..operators import text_features as X
from ..plans import dimensions as D
from .base import quoted, tables
from .scalar_queries import group_pattern


def _texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = tables(spark, sf_dir, "documents", "labels")
    return docs.join(labels, "doc_id").select("doc_id", "text", F.col("toxic").alias("label"))


def txt29_agg10_log_odds(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = M.log_odds(M.gram_counts(_texts(spark, sf_dir)))
    return found.select("gram", F.round("z", 6).alias("z"), "y_s", "y_l")


def agg11_join12_14_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = M.candidates(M.log_odds(M.gram_counts(_texts(spark, sf_dir))).withColumn("z", F.round("z", 6)))
    return found.select("gram", "z", "y_s", "y_l", "covered_by")


def _named(df: DataFrame, key: str, name: str) -> DataFrame:
    return df.select(F.col(key).alias(name), "text")


def ml03_tfidf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The weights of all texts' words and pairs of words over the fitted vocabulary."""
    (docs,) = tables(spark, sf_dir, "documents")
    words = X.vocabulary_of(X.term_counts(docs, "doc_id", ("word",)), docs.count())
    found = X.weighted(docs, words, "doc_id", ("word",)).select("doc_id", F.explode(F.arrays_zip("place", "w")).alias("x")).select("doc_id", "x.place", "x.w")
    # as many rows as the vocabulary may have
    return found.join(F.broadcast(words), "place").select("doc_id", "term", F.round("w", 6).alias("w"))


def ml05_char_ngrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many texts have each run of three to five characters inside words, and how often; the runs that two texts have."""
    (docs,) = tables(spark, sf_dir, "documents")
    return X.term_counts(docs, "doc_id", ("char",)).filter("df >= 2").select("term", "df", "n")


def join13_ml14_similar(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Similar cases of all documents, without those of the query's own fingerprint; the tables hold no URLs to compare."""
    docs, items = tables(spark, sf_dir, "documents", "benchmark")
    found = M.similar_cases(_named(items, "item_id", "q"), _named(docs, "doc_id", "d"), docs.count())
    print_ = F.sha1(F.lower("text"))
    same = items.select(F.col("item_id").alias("q"), print_.alias("p")).join(docs.select(F.col("doc_id").alias("d"), print_.alias("p")), "p").select("q", "d")
    return found.join(same, ["q", "d"], "left_anti").select("q", "d", F.round("score", 6).alias("score"))


def win08_top_per_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, items, labels = tables(spark, sf_dir, "documents", "benchmark", "labels")
    cases = docs.join(labels, "doc_id")
    found = M.similar_cases(_named(items, "item_id", "q"), _named(cases, "doc_id", "d"), cases.count())
    named = found.join(labels.select(F.col("doc_id").alias("d"), F.col("toxic").alias("label")), "d").withColumn("score", F.round("score", 9))
    return M.top_per_class(named, 4).select("q", "label", "place", "d")


def join15_excluded_bank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cases whose text is evaluated stay out of the example bank."""
    docs, labels = tables(spark, sf_dir, "documents", "labels")
    print_ = F.sha1(F.lower("text"))
    return docs.withColumn("p", print_).join(docs.join(labels, "doc_id").select(print_.alias("p")).distinct(), "p", "left_anti").select("doc_id")


def join10_near_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hashes of the vectors against those of the vectors that were seen before, of which each was changed: some of the last numbers have the
    other sign, as many as the vector's label says."""
    (vectors,) = tables(spark, sf_dir, "embeddings")
    sign = lambda x: F.when(x > 0, F.expr("1L")).otherwise(F.expr("0L"))
    hash_ = lambda bits: F.aggregate(bits, F.expr("0L"), lambda a, b: a * 2 + b)
    changed = F.transform(F.slice("embedding", 1, 63), lambda x, i: F.when(i >= 63 - F.col("label"), 1 - sign(x)).otherwise(sign(x)))
    seen = vectors.select(F.col("vec_id").alias("b"), hash_(changed).alias("hash"))
    return M.near_hashes(vectors.select(F.col("vec_id").alias("a"), hash_(F.transform(F.slice("embedding", 1, 63), sign)).alias("hash")), seen, 6)


def agg30_schemes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .base import listings

    found = listings(spark, sf_dir).select(F.explode(W.schemes(F.col("description"))).alias("scheme")).groupBy("scheme").agg(F.count("*").alias("n"))
    return found.orderBy(F.desc("n"), "scheme").limit(12)


def ml15_prompt_block(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The most similar labelled cases of each item, as the text that a prompt takes."""
    docs, items, labels = tables(spark, sf_dir, "documents", "benchmark", "labels")
    cases = docs.join(labels, "doc_id")
    found = M.similar_cases(_named(items, "item_id", "q"), _named(cases, "doc_id", "d"), cases.count())
    # the best cases are found by their scores alone, and texts joined to these few; ids that occur twice are ranked once more with them
    named = found.join(labels.select(F.col("doc_id").alias("d"), F.col("toxic").alias("label")), "d").withColumn("score", F.round("score", 9))
    facts = docs.select(F.col("doc_id").alias("d"), F.lit("").alias("title"), F.array("lang", "source").alias("facts"), F.col("text").alias("description"))
    near = M.top_per_class(named, 4).drop("place")  # four cases of each item at most
    chosen = M.top_per_class(facts.join(F.broadcast(near), "d"), 4)
    return M.prompt_blocks(chosen).select("q", F.col("block"))


QUERIES = {f.__name__: f for f in (ml15_prompt_block, txt29_agg10_log_odds, agg11_join12_14_candidates, ml03_tfidf, ml05_char_ngrams, join13_ml14_similar, win08_top_per_class, join15_excluded_bank, join10_near_hashes, agg30_schemes)}

_FILLERS = quoted(sorted(set(D.GERMAN_WORDS) | set(D.PHRASE_FILLERS)))
_TOKENS = "list_transform(regexp_extract_all(text, '(?i)[a-zäöüßÄÖÜ0-9€]+(?:-[a-zäöüßÄÖÜ0-9]+)*'), lambda x: lower(x))"
GRAMS = f"""t AS (SELECT doc_id, toxic, {_TOKENS} AS tk FROM documents JOIN labels USING (doc_id)),
  g AS (SELECT DISTINCT doc_id, toxic, gram FROM (SELECT doc_id, toxic, unnest(list_concat(list_transform(range(1, len(tk) + 1), lambda i: list_slice(tk, i, i)), list_transform(range(1, len(tk)), lambda i: list_slice(tk, i, i + 1)), list_transform(range(1, len(tk) - 1), lambda i: list_slice(tk, i, i + 2)))) AS gl FROM t), LATERAL (SELECT array_to_string(gl, ' ') AS gram)
    WHERE len(list_filter(gl, lambda x: x NOT IN ({_FILLERS}))) > 0 AND len(list_filter(gl, lambda x: length(x) < 2)) = 0),
  c AS (SELECT gram, sum(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS y_s, sum(CASE WHEN toxic = 0 THEN 1 ELSE 0 END) AS y_l FROM g GROUP BY gram), n AS (SELECT sum(y_s)::DOUBLE AS n_s, sum(y_l)::DOUBLE AS n_l FROM c),
  lo AS (SELECT gram, y_s, y_l, 500 * (y_s + y_l) / (n_s + n_l) AS a, n_s, n_l FROM c, n WHERE y_s >= 3),
  z AS (SELECT gram, y_s::BIGINT AS y_s, y_l::BIGINT AS y_l, round((ln((y_s + a) / (n_s + 500 - y_s - a)) - ln((y_l + a) / (n_l + 500 - y_l - a))) / sqrt(1 / (y_s + a) + 1 / (y_l + a)), 6) AS z FROM lo)"""
_COVER = "CASE " + " ".join("WHEN regexp_matches(gram, '" + group_pattern(ps) + f"') THEN '{code}'" for code, _, _, _, ps in D.LEXICON) + " ELSE '' END"
_TERM = "unnest(list_filter(regexp_split_to_array(lower(text), '[^a-z]+'), lambda w: length(w) > 2 AND w NOT IN (" + quoted(D.ENGLISH_WORDS) + ")))"
SIMILAR = """bt AS (SELECT doc_id AS d, term, count(*) AS tf FROM (SELECT doc_id, {term} AS term FROM {bank}) GROUP BY ALL), nd AS (SELECT count(*) AS n FROM {bank}),
  idf AS (SELECT term, ln((1 + (SELECT n FROM nd))::DOUBLE / (1 + count(*))) + 1 AS idf FROM bt GROUP BY term), top AS (SELECT max(idf) AS top FROM idf),
  qt AS (SELECT item_id AS q, term, count(*) AS tf FROM (SELECT item_id, {term} AS term FROM benchmark) GROUP BY ALL),
  qw AS (SELECT q, term, (1 + ln(tf)) * coalesce(idf, top) AS w FROM qt LEFT JOIN idf USING (term), top), dw AS (SELECT d, term, (1 + ln(tf)) * idf AS w FROM bt JOIN idf USING (term)),
  qn AS (SELECT q, sqrt(sum(w * w)) AS n FROM qw GROUP BY q), dn AS (SELECT d, sqrt(sum(w * w)) AS n FROM dw GROUP BY d),
  sim AS (SELECT q, d, sum(qw.w / qn.n * dw.w / dn.n) AS score FROM qw JOIN qn USING (q) JOIN dw USING (term) JOIN dn USING (d) GROUP BY q, d HAVING count(*) >= 2)"""
ORACLE_SQL = {
    "txt29_agg10_log_odds": f"WITH {GRAMS} SELECT * FROM z",
    "agg11_join12_14_candidates": f"WITH {GRAMS}, p AS (SELECT * FROM z WHERE z > 0 ORDER BY z DESC, gram LIMIT 320) SELECT gram, z, y_s, y_l, {_COVER} AS covered_by FROM p WHERE NOT EXISTS (SELECT 1 FROM p o WHERE o.gram <> p.gram AND contains(' ' || o.gram || ' ', ' ' || p.gram || ' ') AND o.y_s >= 0.8 * p.y_s) ORDER BY z DESC, gram LIMIT 80",
    "ml03_tfidf": f"""WITH tk AS (SELECT doc_id, regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]{{2,}}') AS t FROM documents),
      c AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(list_concat(t, list_transform(range(1, len(t)), lambda i: t[i] || ' ' || t[i + 1]))) AS term FROM tk) GROUP BY ALL),
      f AS (SELECT term, count(*) AS df, sum(tf) AS n FROM c GROUP BY term HAVING count(*) >= 2 ORDER BY n DESC, term LIMIT {X.MOST}),
      r AS (SELECT doc_id, term, (1 + ln(tf)) * (ln((1 + (SELECT count(*) FROM documents))::DOUBLE / (1 + df)) + 1) AS raw FROM c JOIN f USING (term))
      SELECT doc_id, term, round(raw / sqrt(sum(raw * raw) OVER (PARTITION BY doc_id)), 6) AS w FROM r""",
    "ml05_char_ngrams": """WITH w AS (SELECT doc_id, ' ' || unnest(list_filter(regexp_split_to_array(lower(text), '\\s+'), lambda x: x <> '')) || ' ' AS w FROM documents),
      g AS (SELECT doc_id, unnest(list_concat(list_transform(range(1, length(w) - 1), lambda i: substring(w, i, 3)), list_transform(range(1, length(w) - 2), lambda i: substring(w, i, 4)), list_transform(range(1, length(w) - 3), lambda i: substring(w, i, 5)))) AS term FROM w)
      SELECT term, count(DISTINCT doc_id) AS df, count(*) AS n FROM g GROUP BY term HAVING count(DISTINCT doc_id) >= 2""",
    "join13_ml14_similar": f"WITH {SIMILAR.format(term=_TERM, bank='documents')} SELECT q, d, round(score, 6) AS score FROM sim JOIN documents ON doc_id = d JOIN benchmark ON item_id = q WHERE score >= 0.05 AND lower(documents.text) <> lower(benchmark.text)",
    "win08_top_per_class": f"WITH {SIMILAR.format(term=_TERM, bank='(SELECT * FROM documents JOIN labels USING (doc_id))')} SELECT q, label, place, d FROM (SELECT q, d, toxic AS label, row_number() OVER (PARTITION BY q, toxic ORDER BY round(score, 9) DESC, d)::INT AS place FROM sim JOIN labels ON doc_id = d WHERE score >= 0.05) WHERE place <= 2",
    "ml15_prompt_block": f"""WITH {SIMILAR.format(term=_TERM, bank='(SELECT * FROM documents JOIN labels USING (doc_id))')},
      c AS (SELECT q, score, d, toxic AS label, lang, source, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS t, row_number() OVER (PARTITION BY q, toxic ORDER BY round(score, 9) DESC, d) AS place FROM sim JOIN labels ON doc_id = d JOIN documents USING (doc_id) WHERE score >= 0.05),
      k AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY round(score, 9) DESC, d) AS n, CASE WHEN length(t) > {M.CASE_CHARS} THEN regexp_replace(substring(t, 1, {M.CASE_CHARS}), ' [^ ]*$', '') || ' …' ELSE t END AS short FROM c WHERE place <= 2)
      SELECT q, '<vergleichsfaelle>' || chr(10) || '{M.CASE_INTRO}' || chr(10) || string_agg('Fall ' || n || ' – ' || CASE WHEN label = 1 THEN 'BETRUG' ELSE 'SERIÖS' END || ': Chat (' || lang || ', ' || source || ') – ' || short, chr(10) ORDER BY n) || chr(10) || '</vergleichsfaelle>' AS block FROM k GROUP BY q""",
    "join15_excluded_bank": "SELECT doc_id FROM documents WHERE lower(text) NOT IN (SELECT lower(text) FROM documents JOIN labels USING (doc_id))",
    "join10_near_hashes": """WITH s AS (SELECT vec_id, label, list_transform(list_slice(embedding, 1, 63), lambda x: CASE WHEN x > 0 THEN 1 ELSE 0 END::HUGEINT) AS s FROM embeddings),
      h AS (SELECT vec_id, list_reduce(s, lambda a, b: a * 2 + b) AS hash, list_reduce([CASE WHEN i > 63 - label THEN 1 - s[i] ELSE s[i] END FOR i IN range(1, 64)], lambda a, b: a * 2 + b) AS changed FROM s)
      SELECT a.vec_id AS a, b.vec_id AS b, bit_count(xor(a.hash, b.changed))::INT AS distance FROM h a JOIN h b ON bit_count(xor(a.hash, b.changed)) <= 6""",
}
