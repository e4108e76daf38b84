"""Rule scores, fusion of detectors, and what explains a score."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import contact as C
from ..functions import normalize as N
from ..functions import offer as O
from ..functions import signals as S
from ..functions import wording as W
from ..plans import dimensions as D
from .storage import stored


def with_signals(listings: DataFrame, ibans: Column | None = None) -> DataFrame:
    """Adds the normalised fields, the feature columns and `signals`: phrases, contact, price, seller, language."""
    df = listings.withColumns(
        {
            "price": N.parse_price(F.col("price_raw")),
            "category": N.normalize_category(F.col("category_raw")),
            "seller_type": N.seller_type(F.col("type_raw")),
            "badges": N.badge_keys(F.array("badge_raw")),
            "full_text": N.full_text(F.col("title"), F.col("description"), F.array().cast("array<string>")),
        }
    )
    df = df.withColumns(C.contacts(F.col("full_text")))
    df = df.withColumns(W.language_features(F.col("full_text")))
    df = df.withColumns({"least_price": O.reference_min(F.col("title"), F.col("description")), "article_errors": W.article_errors(F.col("full_text"))})
    language = W.language_signals(*[F.col(x) for x in ("n_words", "german_ratio", "english_ratio", "capitalized_ratio", "caps_ratio", "umlaut_substitutes", "article_errors")])
    parts = [
        W.lexicon_signals(F.col("full_text")),
        C.contact_signals(_contacts(), ibans),
        O.price_signals(F.col("price"), F.col("least_price")),
        O.seller_signals(F.col("price"), F.col("age"), F.col("ratings"), F.col("seller_type"), F.col("badges"), F.col("legal_form")),
        language,
    ]
    found = O.business_adjusted(F.concat(*parts), O.commercial(F.col("seller_type"), F.col("legal_form")))
    return df.withColumn("signals", found)


def _contacts() -> dict[str, Column]:
    return {c: F.col(c) for c in ("urls", "emails", "numbers")}


def feature_vector(listings: DataFrame, key: str, ibans: Column | None = None, images: Column | None = None) -> DataFrame:
    """FEA-01: key and the numbers of all families: contact, language, price and seller, how many groups of phrases and how many images."""
    df = with_signals(listings, ibans)
    groups = F.filter(S.codes(F.col("signals")), lambda code: code.isin([c for c, *_ in D.LEXICON]))
    language = [F.col(c).cast("double").alias(c) for c in ("n_words", "german_ratio", "english_ratio", "capitalized_ratio", "caps_ratio", "umlaut_substitutes")]
    offer = [F.coalesce(F.col("price") / F.col("least_price"), F.lit(-1.0)).alias("price_share"), *[F.coalesce(F.col(c).cast("double"), F.lit(-1.0)).alias(c) for c in ("age", "ratings", "ads")], F.size("badges").cast("double").alias("n_badges")]
    counts = [F.size(F.array_distinct(groups)).cast("double").alias("n_phrase_groups"), (F.lit(0.0) if images is None else F.size(images).cast("double")).alias("n_images")]
    return df.select(key, *[c.cast("double") for c in C.contact_vector(_contacts(), F.col("signals"), ibans)], *language, *offer, *counts)


def suggestion(text: Column) -> tuple[Column, Column]:
    """TXT-33: the codes of a text's phrases and contact data, and what is suggested to a reviewer: `ja` where there is one, else `?`."""
    codes = S.codes(F.concat(W.lexicon_signals(text), C.contact_signals(C.contacts(text))))
    return codes, suggested(codes)


def suggested(codes: Column) -> Column:
    return F.when(F.size(codes) > 0, "ja").otherwise("?")


def rule_score(signals: Column) -> Column:
    return S.noisy_or(signals)


def verdict(score: Column) -> Column:
    return F.when(score >= D.HIGH_RISK, "hohes Risiko").when(score >= D.SUSPICIOUS, "verdächtig").otherwise("unauffällig")


def fuse(scores: DataFrame, key: str = "listing_id") -> DataFrame:
    """One row per listing out of (listing, model, score, available, hard): the weighted mean of the scores there are, at
    least the floor with a hard signal, and the verdict."""
    weight = F.lit(1.0)
    for model, w in D.FUSION_WEIGHTS.items():
        weight = F.when(F.col("model") == model, w).otherwise(weight)
    used = F.when(F.col("available") & F.col("score").isNotNull(), weight)
    mean = F.coalesce(F.sum(used * F.col("score")) / F.sum(used), F.lit(0.0))
    floor = F.when(F.bool_or(F.coalesce("hard", F.lit(False))), D.HARD_FLOOR).otherwise(0.0)
    fused = scores.groupBy(key).agg(F.bround(F.least(F.lit(1.0), F.greatest(mean, floor)), 4).alias("score"))
    return fused.withColumn("verdict", verdict(F.col("score")))


def score_listings(listings: DataFrame, key: str = "doc_id", ibans: Column | None = None) -> DataFrame:
    """Rules end to end: key, n_signals, score, verdict and the strongest signal."""
    df = with_signals(listings, ibans)
    score = F.greatest(rule_score(F.col("signals")), F.when(F.exists("signals", lambda s: s["hard"]), D.HARD_FLOOR).otherwise(0.0))
    df = df.select(key, F.size("signals").alias("n_signals"), F.bround(score, 4).alias("score"), F.try_element_at(S.strongest_first(F.col("signals")), F.lit(1))["code"].alias("strongest"))
    return df.withColumn("verdict", verdict(F.col("score")))


def only_new(listings: DataFrame, scored: DataFrame, content: Column) -> DataFrame:
    """Rows whose content hash has no score yet."""
    hashed = listings.withColumn("content", content)
    return hashed.join(scored.select("content").distinct(), "content", "left_anti")


def abstaining(scores: DataFrame, chat_only: Column, chats: DataFrame, least: int = 20) -> DataFrame:
    """A null score for chats until each class has `least` of them in training. chats: label."""
    counts = chats.agg(F.count_if(F.col("label") == 1).alias("_p"), F.count_if(F.col("label") == 0).alias("_n"))
    known = scores.crossJoin(F.broadcast(counts))  # the counts are one row
    return known.withColumn("score", F.when(~chat_only | (F.least("_p", "_n") >= least), F.col("score"))).drop("_p", "_n")


def linear_reasons(values: DataFrame, coefficients: DataFrame, key: str, most: int = 3, least: float = 0.05) -> DataFrame:
    """The terms that raise a linear score most. values: key, term, value; coefficients: term, coefficient."""
    each = values.join(coefficients, "term").withColumn("part", F.col("value") * F.col("coefficient")).filter(F.col("part") > least)
    n = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("part"), "term"))
    return each.withColumn("place", n).filter(F.col("place") <= most).select(key, "place", "term", "part")


def judgement_signals(score: Column, summary: Column, scheme: Column, language: Column, flags: Column, model: str) -> Column:
    """TXT-37: a model's judgement as signals: its summary first, then one for each flag (an array of code and evidence),
    all with the judgement's score, clamped to 0..1, as their weight."""
    weight = F.least(F.greatest(F.coalesce(score, F.lit(0.0)), F.lit(0.0)), F.lit(1.0))
    said = F.concat(summary, F.lit(" – Masche: "), scheme, F.lit(", Sprache: "), language, F.lit(f" ({model})"))

    def of(w: Column) -> Column:
        first = S.found(F.when(F.rlike(summary, F.lit(r"[^\p{Zs}]")), S.signal("LLM_SUMMARY", w, said)))
        each = F.transform(flags, lambda f: S.signal(F.concat(F.lit("LLM_"), F.upper(f["code"])), w, F.nullif(F.substring(f["evidence"], 1, 120), F.lit(""))))
        return F.concat(first, F.coalesce(each, F.array().cast(S.SIGNALS)))

    return C.let(weight, of)  # bound once, as each signal has it


def run_detectors(listings: DataFrame, key: str, detectors: dict[str, Callable[[DataFrame], Column] | str], reuse: DataFrame | None = None) -> DataFrame:
    """SCO-07: (key, model, score, available, error) of all detectors; a null score is no verdict.

    A detector is a function that builds its score from the listings, or the reason why it is not available. Each is run and its scores are
    written before the next one, so that one that cannot be built, or that fails on a row, stands with its error and stops no other.
    `reuse` (key, model, score) has results that exist, and is not run again."""
    out = reuse.select(key, "model", "score", F.lit(True).alias("available"), F.lit(None).cast("string").alias("error")) if reuse is not None else None
    for name, detector in detectors.items():
        rows = listings
        if reuse is not None:
            rows = rows.join(reuse.where(F.col("model") == name).select(key), key, "left_anti")
        error, available = (detector, False) if isinstance(detector, str) else (None, True)
        scored = None
        if available:
            try:
                scored = stored(rows.select(key, detector(rows).cast("double").alias("score")))
            except Exception as e:  # noqa: BLE001  a broken detector must not stop the scan
                error = type(e).__name__
        scored = rows.select(key, F.lit(None).cast("double").alias("score")) if scored is None else scored
        part = scored.select(key, F.lit(name).alias("model"), "score", F.lit(available).alias("available"), F.lit(error).cast("string").alias("error"))
        out = part if out is None else out.unionByName(part)
    return out


def attributions(rows: DataFrame, key: str, coefficients: dict[str, float], top: int = 3) -> DataFrame:
    """SCO-12: (key, place, feature, value, part, effect): the features that move a linear score most from its mean, by
    coefficient * (value - mean), and whether they raise or lower it."""
    means = rows.agg(*[F.avg(c).alias(c) for c in coefficients]).first()
    parts = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("value"), (F.lit(float(k)) * (F.col(c) - F.lit(means[c]))).alias("part")) for c, k in coefficients.items()])
    ranked = F.array_sort(F.transform(F.filter(parts, lambda p: p["part"] != 0), lambda p, i: F.struct((-F.abs(p["part"])).alias("by"), i.alias("i"), p.alias("p"))))
    each = rows.select(key, F.posexplode(F.slice(ranked, 1, top)).alias("place", "x"))
    return each.select(key, (F.col("place") + 1).alias("place"), "x.p.feature", "x.p.value", "x.p.part", F.when(F.col("x.p.part") > 0, "erhöht").otherwise("senkt").alias("effect"))
