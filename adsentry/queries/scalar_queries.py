"""One query for each function of a single row: doc_id and the function's value."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import contact as C
from ..functions import normalize as N
from ..functions import offer as O
from ..functions import signals as S
from ..functions import wording as W
from ..functions.redact import find_ibans, redact, sentences
from ..plans import dimensions as D
from .base import cte, listings, quoted, tables

AS_OF = "2026-01-01"
c = F.col


def _category_sql() -> str:
    plain = "replace(replace(replace(replace(replace(x, 'ä', 'ae'), 'ö', 'oe'), 'ü', 'ue'), 'ß', 'ss'), ' ', '')"
    cases = " ".join(f"WHEN {' OR '.join(f"contains(x, '{w}')" for w in words)} THEN '{name}'" for name, words in D.CATEGORY_KEYWORDS.items())
    segments = "list_filter(list_transform(regexp_split_to_array(lower(category_raw), '[>›»|]'), lambda x: trim(x)), lambda x: x <> '')"
    of = f"CASE WHEN {plain} IN ({quoted(D.CATEGORIES)}) THEN {plain} {cases} END"
    return f"CASE WHEN len(list_filter({segments}, lambda x: contains(x, 'dienstleistung'))) > 0 THEN 'dienstleistungen' ELSE coalesce(list_filter(list_transform(list_reverse({segments}), lambda x: {of}), lambda x: x IS NOT NULL)[1], 'sonstiges') END"


PRICE_SQL = r"CASE WHEN contains(lower(price_raw), 'verschenken') THEN 0.0 ELSE TRY_CAST(nullif(replace(regexp_replace(regexp_extract(lower(trim(price_raw)), '\d[\d.\s]*(?:,\d{1,2})?'), '[.\s]', '', 'g'), ',', '.'), '') AS DOUBLE) END"
TYPE_SQL = "CASE WHEN starts_with(lower(trim(type_raw)), 'gewerb') THEN 'gewerblich' WHEN starts_with(lower(trim(type_raw)), 'privat') THEN 'privat' END"
_BADGE = r"replace(lower(trim(regexp_replace(badge_raw, '\s+', ' ', 'g'))), 'ä', 'ae')"
BADGE_SQL = f"CASE WHEN {_BADGE} IN ({quoted(list(D.BADGES))}) THEN {_BADGE} WHEN contains({_BADGE}, 'zufriedenheit') THEN CASE WHEN contains({_BADGE}, 'top') THEN 'zufriedenheit_top' WHEN regexp_matches({_BADGE}, 'na ?ja') THEN 'zufriedenheit_naja' WHEN regexp_matches({_BADGE}, '\\bok\\b') THEN 'zufriedenheit_ok' END WHEN replace({_BADGE}, ' ', '_') IN ({quoted(list(D.BADGES)[3:])}) AND NOT contains({_BADGE}, '_') THEN replace({_BADGE}, ' ', '_') END"
_LABEL = "replace(lower(trim(label_raw)), '_', ' ')"
LABEL_SQL = f"CASE WHEN {_LABEL} IN ({quoted([k for k, v in D.LABEL_WORDS.items() if v])}) THEN 1 WHEN {_LABEL} IN ({quoted([k for k, v in D.LABEL_WORDS.items() if not v])}) THEN 0 END"
_TRANS = "replace(replace(replace(replace(lower({0}), 'ä', 'ae'), 'ö', 'oe'), 'ü', 'ue'), 'ß', 'ss')"
FULL_SQL = r"array_to_string(list_filter([regexp_replace(title, '^\s+|\s+$', '', 'g'), regexp_replace(description, '^\s+|\s+$', '', 'g')], lambda x: x <> ''), chr(10))"
WORDS_SQL = "regexp_extract_all({0}, '[A-Za-zÄÖÜäöüß]+')"


def share_sql(condition: str, text: str = "description") -> str:
    w = WORDS_SQL.format(text)
    return f"CASE WHEN len({w}) = 0 THEN 0.0 ELSE len(list_filter({w}, lambda x: {condition})) / len({w}) END"


GERMAN_SQL, ENGLISH_SQL = (share_sql(f"lower(x) IN ({quoted(t)})") for t in (D.GERMAN_WORDS, D.ENGLISH_WORDS))
UPPER_SQL = share_sql("regexp_matches(x, '^[A-ZÄÖÜ]')")
CAPS_SQL = share_sql("regexp_matches(x, '^[A-ZÄÖÜß]{3,}$') AND regexp_matches(x, '[A-ZÄÖÜ]')")
SUBSTITUTES_SQL = f"len(list_filter({WORDS_SQL.format('description')}, lambda x: lower(x) IN ({quoted(D.UMLAUT_SUBSTITUTES)})))"
N_WORDS_SQL = f"len({WORDS_SQL.format('description')})"
_LINK = r"(?i)\S*[./@]\S*\.[a-z]{2,}\S*|\S+\.[a-z]{2,}/\S*"
_LW = WORDS_SQL.format(f"regexp_replace(description, '{_LINK}', ' ', 'g')")
_LG, _LE = (f"(CASE WHEN len({_LW}) = 0 THEN 0.0 ELSE len(list_filter({_LW}, lambda x: lower(x) IN ({quoted(t)}))) / len({_LW}) END)" for t in (D.GERMAN_WORDS, D.ENGLISH_WORDS))
_LGU = f"({_LG} + CASE WHEN regexp_matches(description, '[äöüÄÖÜß]') THEN 0.05 ELSE 0.0 END)"
GERMAN_OK_SQL = f"(len({_LW}) < 5 OR ({_LGU} = 0 AND {_LE} = 0) OR ({_LGU} >= 0.05 AND {_LGU} >= {_LE}))"
EMAILS_SQL = f"list_sort(list_distinct(regexp_extract_all(description, '{C.EMAIL}')))"
URLS_SQL = rf"""list_sort(list_distinct(list_transform(regexp_extract_all(regexp_replace(description, '{C.EMAIL}', ' ', 'g'), '{C.URL.replace("'", "''")}'), lambda x: regexp_replace(x, '[.,;:!?]+$', ''))))"""
HOST_SQL = r"lower(regexp_extract(regexp_extract(regexp_extract(regexp_replace({0}, '(?i)^https?://', ''), '^([^/?#]*)', 1), '([^@]*)$', 1), '^([^:]*)', 1))"
_TWO = "array_to_string(list_slice(string_split({0}, '.'), -2, -1), '.')"
SUFFIX_SQL = "CASE WHEN NOT contains({0}, '.') THEN '' WHEN " + _TWO + f" IN ({quoted(D.LONG_SUFFIXES)}) AND len(string_split({{0}}, '.')) > 2 THEN " + _TWO + " ELSE string_split({0}, '.')[-1] END"
FOREIGN_SQL = rf"list_transform(list_filter(list_zip(regexp_extract_all(regexp_replace(regexp_replace(description, '{C.EMAIL}', ' ', 'g'), '{C.IBAN}', ' ', 'g'), '{C.INTL_PHONE}'), regexp_extract_all(regexp_replace(regexp_replace(description, '{C.EMAIL}', ' ', 'g'), '{C.IBAN}', ' ', 'g'), '{C.INTL_PHONE}', 1)), lambda x: NOT (starts_with(x[2], '49') OR starts_with(x[2], '43') OR starts_with(x[2], '41'))), lambda x: x[1])"
_DOMAIN = f"string_split(left(h, length(h) - length({SUFFIX_SQL.format('h')}) - 1), '.')[-1]"
_FOLD = "translate({0}, '013457@', 'oleasta')"
_BRANDS = " ".join(f"WHEN list_contains(regexp_split_to_array({_FOLD.format('h')}, '[.-]'), '{b}')" + (f" OR contains({_FOLD.format('h')}, '{b}') OR levenshtein({_FOLD.format(_DOMAIN)}, '{b}') BETWEEN 1 AND 2" if len(b) >= 5 else "") + f" THEN '{b}'" for b in D.BRANDS)
BRAND_SQL = f"array_to_string(list_filter(list_transform(list_transform({URLS_SQL}, lambda x: {HOST_SQL.format('x')}), lambda h: CASE WHEN {_DOMAIN} || '.' || {SUFFIX_SQL.format('h')} IN ({quoted(D.OFFICIAL_DOMAINS)}) THEN NULL {_BRANDS} END), lambda x: x IS NOT NULL), '|')"
JOINED = "array_to_string({0}, '|')"


def joined(x: Column) -> Column:
    return F.array_join(x, "|")


def group_pattern(patterns: list[str]) -> str:
    """One alternation of a group's patterns, quoted for SQL."""
    return "(?sm)" + "|".join(f"(?:{W.spaced(x)})" for x in patterns).replace("'", "''")


def lexicon_sql(column: str = "description", value: str = "code") -> str:
    """The codes (or evidence) of the lexicon groups in order, as a list."""
    out = []
    for code, weight, hard, _, patterns in D.LEXICON:
        p = group_pattern(patterns)
        shown = {"code": f"'{code}'", "weight": f"{weight}::DOUBLE", "hard": str(hard).lower()}[value]
        out.append(f"CASE WHEN regexp_matches(lower({column}), '{p}') THEN {shown} END")
    return f"list_filter([{', '.join(out)}], lambda x: x IS NOT NULL)"


def reference_sql() -> str:
    cases = lambda col: "CASE " + " ".join(f"WHEN regexp_matches(lower({col}), '{p}') THEN {least}::DOUBLE" for p, least, _ in D.PRICE_REFERENCE) + " END"
    words = "|".join(D.NOT_THE_ITEM) + "|(?:" + "|".join(D.NOT_THE_ITEM_STARTS) + r")[\p{L}\p{N}_]*"
    edge = r"(?:^|$|[^\p{L}\p{N}_])"
    plain = f"regexp_replace(lower(title), '(?:{'|'.join(D.BEFORE_GAMES)}){D.GAMES}', ' ', 'g')"
    other = f"(regexp_matches(lower(title), '{edge}(?:{words}){edge}') OR regexp_matches({plain}, '{edge}{D.GAMES}{edge}'))"
    return f"CASE WHEN NOT {other} THEN coalesce({cases('title')}, {cases('description')}) END"


SCHEMES_SQL = "list_filter([" + ", ".join(f"CASE WHEN regexp_matches(lower(description), '{p}') THEN '{n}' END" for n, p in D.SCHEMES) + "], lambda x: x IS NOT NULL)"
def no_chat() -> Column:
    return F.array().cast("array<string>")


# name: (expression, the same in SQL)
SCALARS: dict[str, tuple[Callable[[], Column], str | None]] = {
    "nrm01_parse_price": (lambda: N.parse_price(c("price_raw")), PRICE_SQL),
    "nrm02_normalize_category": (lambda: N.normalize_category(c("category_raw")), _category_sql()),
    "nrm03_nan_to_null": (lambda: N.nan_to_null(F.when(c("doc_id") % 4 == 0, F.lit("NaN").cast("double")).otherwise(c("age").cast("double"))), "CASE WHEN doc_id % 4 > 0 THEN age::DOUBLE END"),
    "nrm04_as_list": (lambda: joined(N.as_list(c("badge_raw"))), "coalesce(badge_raw, '')"),
    "nrm06_resolve_label": (lambda: N.resolve_label(c("label_raw"), {"ja": 1, "betrug": 1, "1": 1, "ham": 0, "0": 0}), "CASE lower(trim(label_raw)) WHEN 'ja' THEN 1 WHEN 'betrug' THEN 1 WHEN '1' THEN 1 WHEN 'ham' THEN 0 WHEN '0' THEN 0 END"),
    "nrm07_label_word": (lambda: N.label_word(c("label_raw")), LABEL_SQL),
    "nrm10_known_category": (lambda: N.known_category(c("category_raw")), f"CASE WHEN category_raw IN ({quoted(D.CATEGORIES)}) THEN category_raw ELSE 'sonstiges' END"),
    "nrm11_badge_key": (lambda: N.badge_key(c("badge_raw")), BADGE_SQL),
    "nrm12_legal_form": (lambda: N.legal_form(F.concat(F.lit("Muster "), F.col("source"), F.lit("  "), F.coalesce("legal_form", F.lit("und Söhne")))), "CASE WHEN legal_form IS NOT NULL THEN legal_form END"),
    "nrm13_seller_type": (lambda: N.seller_type(c("type_raw")), TYPE_SQL),
    "nrm14_chat_only": (lambda: N.chat_only(c("title"), F.when(c("doc_id") % 2 == 0, c("description")), F.when(c("doc_id") % 3 > 0, F.array("text"))), "doc_id % 3 > 0 AND trim(title) = '' AND doc_id % 2 = 1"),
    "nrm15_full_text": (lambda: F.sha1(N.full_text(c("title"), c("description"), no_chat())), f"sha1({FULL_SQL})"),
    "nrm16_account_age": (lambda: N.account_age(c("since_raw"), F.lit(AS_OF).cast("date")), f"greatest(0, date_diff('day', strptime(nullif(regexp_extract(lower(since_raw), 'aktiv seit (\\d+\\.\\d+\\.\\d+)', 1), ''), '%d.%m.%Y')::DATE, DATE '{AS_OF}'))::INT"),
    "nrm17_person_key": (lambda: N.person_key(F.concat(F.lit(" Jörg-Ä. "), c("source"))), f"left(regexp_replace({_TRANS.format("trim(' Jörg-Ä. ' || source)")}, '[^a-z0-9]+', '', 'g'), 30)"),
    "nrm18_title_slug": (lambda: N.title_slug(c("title")), f"CASE WHEN regexp_replace(left(regexp_replace(regexp_replace({_TRANS.format('title')}, '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), 50), '-+$', '') = '' THEN 'inserat' ELSE regexp_replace(left(regexp_replace(regexp_replace({_TRANS.format('title')}, '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), 50), '-+$', '') END"),
    "nrm19_text_key": (lambda: F.sha1(N.text_key(c("text"))), r"sha1(regexp_replace(lower(text), '[^\p{L}\p{N}_]+', '', 'g'))"),
    "nrm20_feature_value": (lambda: N.feature_value(F.when(c("doc_id") % 2 == 0, "has_shortener").otherwise("price"), F.when(c("doc_id") % 7 == 0, -1.0).when(c("doc_id") % 2 == 0, (c("doc_id") % 3).cast("double")).otherwise(c("doc_id") / 4)),
        "CASE WHEN doc_id % 7 = 0 THEN 'unbekannt' WHEN doc_id % 2 = 0 AND doc_id % 3 > 0 THEN 'ja' WHEN doc_id % 2 = 0 THEN 'nein' WHEN doc_id % 4 = 0 THEN CAST(doc_id // 4 AS STRING) ELSE printf('%.2f', doc_id / 4.0) END"),
    "nrm21_clip_words": (lambda: F.sha1(N.clip_words(c("text"), 300)), r"sha1(CASE WHEN length(text) <= 300 THEN text WHEN regexp_extract(left(text, 300), '(?s)^(.*)\s', 1) = '' THEN left(text, 300) || ' …' ELSE regexp_extract(left(text, 300), '(?s)^(.*)\s', 1) || ' …' END)"),
    "nrm24_item_kind": (lambda: N.item_kind(F.when(c("doc_id") % 2 == 0, c("title")), F.lit(None).cast("string"), F.when(c("doc_id") % 3 > 0, F.array_repeat("text", (c("doc_id") % 3).cast("int"))), F.when(c("doc_id") % 5 == 0, F.array("source"))),
        "CASE WHEN NOT (doc_id % 2 = 0 AND trim(title) <> '') THEN CASE WHEN doc_id % 3 = 0 AND doc_id % 5 = 0 THEN 'Bild' WHEN doc_id % 3 = 2 THEN 'Chat' WHEN doc_id % 3 = 1 THEN 'Nachricht' ELSE 'Inserat' END WHEN doc_id % 3 > 0 THEN 'Inserat mit Chat' ELSE 'Inserat' END"),
    "nrm25_chat_lines": (lambda: F.size(N.chat_lines(c("text"))), "len(list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: x <> ''))::INT"),
    "nrm26_post_date": (lambda: N.post_date(F.when(c("doc_id") % 3 == 0, F.lit("2024-05-06T07:08:09")).when(c("doc_id") % 3 == 1, F.concat(F.lit("am "), F.substring("since_raw", 12, 10)))).cast("string"), "CASE WHEN doc_id % 3 = 0 THEN '2024-05-06' WHEN doc_id % 3 = 1 THEN CAST(strptime(substring(since_raw, 12, 10), '%d.%m.%Y')::DATE AS STRING) END"),
    "flt03_looks_german": (lambda: W.looks_german(c("description")), GERMAN_OK_SQL),
    "flt04_looks_binary": (lambda: N.looks_binary(F.concat(c("title"), F.array_join(F.array_repeat(F.lit("\x01"), (c("doc_id") % 2).cast("int")), ""))), "doc_id % 2 > 0.02 * (length(title) + doc_id % 2)"),
    "flt08_url_keywords": (lambda: F.exists(C.urls(c("description")), lambda u: F.rlike(u, F.lit("(?i)betrug|phishing|warnung|zoll"))), f"len(list_filter({URLS_SQL}, lambda x: regexp_matches(x, '(?i)betrug|phishing|warnung|zoll'))) > 0"),
    "txt01_emails": (lambda: joined(C.emails(c("description"))), JOINED.format(EMAILS_SQL)),
    "txt02_urls": (lambda: joined(C.urls(c("description"))), JOINED.format(URLS_SQL)),
    "txt03_hosts": (lambda: joined(F.transform(C.urls(c("description")), C.host_of)), JOINED.format(f"list_transform({URLS_SQL}, lambda x: {HOST_SQL.format('x')})")),
    "txt04_suffixes": (lambda: joined(F.transform(C.urls(c("description")), lambda u: C.suffix_of(C.host_of(u)))), JOINED.format(f"list_transform(list_transform({URLS_SQL}, lambda x: {HOST_SQL.format('x')}), lambda h: {SUFFIX_SQL.format('h')})")),
    "txt05_homoglyphs": (lambda: joined(F.transform(C.urls(c("description")), lambda u: C.folded(C.host_of(u)))), JOINED.format(f"list_transform({URLS_SQL}, lambda x: translate({HOST_SQL.format('x')}, '013457@', 'oleasta'))")),
    "txt06_imitated_brand": (lambda: joined(F.transform(F.transform(C.urls(c("description")), C.host_of), C.imitated_brand)), BRAND_SQL),
    "txt07_iban_valid": (lambda: C.iban_valid(F.concat(F.lit("DE"), F.substring((c("doc_id") % 97 + 100).cast("string"), 2, 2), F.lit(" 3704 0044 0532 0130 00"))), "CAST(('370400440532013000' || '1314' || lpad(CAST(doc_id % 97 AS STRING), 2, '0')) AS HUGEINT) % 97 = 1"),
    "txt08_find_ibans": (lambda: joined(find_ibans(c("description"))), "CASE WHEN doc_id % 15 = 4 THEN 'DE89 3704 0044 0532 0130 00' ELSE '' END"),
    "txt09_foreign_phones": (lambda: joined(C.foreign_phones(c("description"))), JOINED.format(FOREIGN_SQL)),
    "txt10_phones": (lambda: joined(C.phones(c("description"))), None),
    "txt11_15_contact_signals": (lambda: joined(F.transform(C.contact_signals(C.contacts(c("description")), find_ibans(c("description"))), lambda s: F.concat_ws(":", s["code"], s["weight"].cast("string")))), None),
    "txt17_n_words": (lambda: F.size(W.words(c("description"))), f"{N_WORDS_SQL}::INT"),
    "txt18_german_ratio": (lambda: F.round(W.language_features(c("description"))["german_ratio"], 9), f"round({GERMAN_SQL}, 9)"),
    "txt18_english_ratio": (lambda: F.round(W.language_features(c("description"))["english_ratio"], 9), f"round({ENGLISH_SQL}, 9)"),
    "txt19_capitalized_ratio": (lambda: F.round(W.language_features(c("description"))["capitalized_ratio"], 9), f"round({UPPER_SQL}, 9)"),
    "txt19_caps_ratio": (lambda: F.round(W.language_features(c("description"))["caps_ratio"], 9), f"round({CAPS_SQL}, 9)"),
    "txt20_umlaut_substitutes": (lambda: W.language_features(c("description"))["umlaut_substitutes"], f"{SUBSTITUTES_SQL}::INT"),
    "txt20_exclamations": (lambda: W.language_features(c("description"))["exclamations"], "len(regexp_extract_all(description, '!{2,}'))::INT"),
    "txt21_article_errors": (lambda: joined(W.article_errors(c("description"))), None),
    "txt23_lexicon_codes": (lambda: joined(S.codes(W.lexicon_signals(c("description")))), JOINED.format(lexicon_sql())),
    "txt26_sentences": (lambda: F.size(sentences(c("description"))), None),
    "txt28_quotes": (lambda: F.size(F.array_distinct(F.filter(F.regexp_extract_all(F.concat(c("text"), F.lit(" „Bitte zahlen Sie den Betrag bis morgen.“")), F.lit("[„“\"]([^„“”\"]{20,400})[“”\"]"), F.lit(1)), lambda q: (F.size(F.split(q, r"\s+")) >= 4) & ~F.rlike(q, F.lit(r"^[\d. ]+$"))))), None),
    "txt29_ngrams": (lambda: F.size(W.ngrams(c("text"))), None),
    "txt31_own_experience": (lambda: W.own_experience(F.concat(F.lit("Ich habe hier gekauft und mir wurde nichts geschickt, das war Betrug. "), c("text"))), "length('Ich habe hier gekauft und mir wurde nichts geschickt, das war Betrug. ' || text) >= 150"),
    "win11_first_scheme": (lambda: O.first_match(F.lower(c("description")), D.SCHEMES), "CASE " + " ".join(f"WHEN regexp_matches(lower(description), '{p}') THEN '{n}'" for n, p in D.SCHEMES) + " END"),
    "txt32_schemes": (lambda: joined(W.schemes(c("description"))), JOINED.format(SCHEMES_SQL)),
    "txt34_codebook_signals": (lambda: joined(F.array_sort(W.codebook_signals(S.codes(W.lexicon_signals(c("description")))))),
        JOINED.format(f"list_sort(list_distinct(list_transform({lexicon_sql()}, lambda x: CASE x {' '.join(f"WHEN '{k}' THEN '{s}'" for k, _, _, s, _ in D.LEXICON)} END)))")),
    "txt35_excerpt": (lambda: F.sha1(N.excerpt(c("text"), 15)), r"sha1(array_to_string(list_slice(list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> ''), 1, 15), ' ') || CASE WHEN len(list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '')) > 15 THEN ' …' ELSE '' END)"),
    "txt38_marked_spans": (lambda: joined(F.transform(C.marked(c("description"), C.emails(c("description"))), lambda x: F.concat_ws(":", x["part"], x["at"].cast("string")))), JOINED.format(f"list_transform({EMAILS_SQL}, lambda x: x || ':' || CAST(instr(description, x) AS STRING))")),
    "red03_mails": (lambda: F.sha1(F.regexp_replace(c("description"), r"(?i)\b[a-z0-9._%+-]+@([a-z0-9.-]+\.[a-z]{2,24})\b", "anonym@$1")), r"sha1(regexp_replace(description, '(?i)\b[a-z0-9._%+-]+@([a-z0-9.-]+\.[a-z]{2,24})\b', 'anonym@\1', 'g'))"),
    "red08_redact": (lambda: F.sha1(redact(c("description"))), None),
    "prc01_reference_min": (lambda: O.reference_min(c("title"), c("description")), reference_sql()),
    "sel01_commercial": (lambda: O.commercial(N.seller_type(c("type_raw")), c("legal_form")), f"coalesce({TYPE_SQL} = 'gewerblich', legal_form IS NOT NULL)"),
    "sel08_seller_box": (lambda: F.concat_ws("|", *[x.cast("string") for k, x in O.seller_box(F.array(F.trim("type_raw"), F.col("badge_raw"), c("ads").cast("string"), F.lit("Anzeigen"))).items() if k != "seller_badges"]),
        f"concat_ws('|', {TYPE_SQL}, CAST(ads AS STRING))"),
}


def _query(build: Callable[[], Column]) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return listings(spark, sf_dir).select("doc_id", build().alias("value"))

    return run


def txt27_numbered_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentences of chats, numbered across messages, 80 at most."""
    from pyspark.sql import Window

    (chats,) = tables(spark, sf_dir, "conversations")
    each = chats.select("conv_id", "turn", F.posexplode(sentences("text")).alias("pos", "sentence"))
    n = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn", "pos"))
    return each.withColumn("nr", n).filter("nr <= 80").select("conv_id", "nr", F.concat(F.lit("Nachricht "), F.col("turn") + 1).alias("part"), "sentence")


def txt36_judgement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores out of a model's answers: think blocks go, the outermost braces count, percent become shares."""
    answer = F.concat(F.lit("<think>so {x}</think> Antwort: {\"score\": \""), (F.col("doc_id") % 150).cast("string"), F.lit(" %\", \"flags\": [\"Link\"]} Ende"))
    body = F.regexp_extract(F.regexp_replace(answer, "(?s)<think>.*?</think>", ""), r"(?s)(\{.*\})", 1)
    raw = F.regexp_extract(F.get_json_object(body, "$.score"), r"([\d.]+)", 1).try_cast("double")
    score = F.least(F.greatest(F.when(F.contains(F.get_json_object(body, "$.score"), F.lit("%")) | (raw > 1), raw / 100).otherwise(raw), F.lit(0.0)), F.lit(1.0))
    return listings(spark, sf_dir).select("doc_id", F.round(score, 6).alias("score"), F.get_json_object(body, "$.flags[0]").alias("flag"))


def nrm22_prompt(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = N.prompt_text(c("title"), c("description"), N.parse_price(c("price_raw")), N.normalize_category(c("category_raw")), F.when(c("doc_id") % 2 == 0, F.array("source")).otherwise(no_chat()))
    return listings(spark, sf_dir).select("doc_id", F.sha1(text).alias("value"))


QUERIES = {name: _query(build) for name, (build, _) in SCALARS.items()}
QUERIES |= {"txt27_numbered_sentences": txt27_numbered_sentences, "txt36_judgement": txt36_judgement, "nrm22_prompt": nrm22_prompt}
ORACLE_SQL = {name: cte(f"SELECT doc_id, {sql} AS value FROM listings") for name, (_, sql) in SCALARS.items() if sql}
ORACLE_SQL["txt36_judgement"] = "SELECT doc_id, round(least((doc_id % 150) / 100.0, 1.0), 6) AS score, 'Link' AS flag FROM documents"
