"""Normalisers: raw source values to the fields of a listing. Null in, null out, unless said otherwise."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..plans import dimensions as D


def nan_to_null(x: Column) -> Column:
    return F.when(~F.isnan(x), x)


def parse_price(raw: Column) -> Column:
    """'1.200,50 €' -> 1200.5, 'zu verschenken' -> 0; without digits null."""
    s = F.lower(F.trim(raw))
    digits = F.regexp_extract(s, r"\d[\d.\s]*(?:,\d{1,2})?", 0)
    number = F.translate(F.regexp_replace(digits, r"[.\s]", ""), ",", ".")
    return F.when(F.contains(s, F.lit("verschenken")), F.lit(0.0)).otherwise(F.nullif(number, F.lit("")).try_cast("double"))


def normalize_category(raw: Column) -> Column:
    """A category or breadcrumb path to one of ours; the most specific segment counts."""
    segments = F.filter(F.transform(F.split(F.lower(raw), "[>›»|]"), F.trim), lambda s: s != "")

    def of(s: Column) -> Column:
        plain = reduce(lambda x, r: F.replace(x, F.lit(r[0]), F.lit(r[1])), [("ä", "ae"), ("ö", "oe"), ("ü", "ue"), ("ß", "ss"), (" ", "")], s)
        out = F.when(plain.isin(D.CATEGORIES), plain)
        for name, words in D.CATEGORY_KEYWORDS.items():
            out = out.when(reduce(lambda a, b: a | b, [F.contains(s, F.lit(w)) for w in words]), F.lit(name))
        return out

    found = F.filter(F.transform(F.reverse(segments), of), lambda c: c.isNotNull())
    service = F.exists(segments, lambda s: F.contains(s, F.lit("dienstleistung")))
    return F.when(service, "dienstleistungen").otherwise(F.coalesce(F.try_element_at(found, F.lit(1)), F.lit("sonstiges")))


def known_category(c: Column) -> Column:
    return F.when(c.isin(D.CATEGORIES), c).otherwise("sonstiges")


def as_list(x: Column) -> Column:
    """A scalar as a list of one; null and '' as an empty list."""
    return F.filter(F.array(x.cast("string")), lambda v: v.isNotNull() & (v != ""))


def label_word(raw: Column) -> Column:
    """1 for fraud, 0 for legitimate, by the words people use."""
    key = F.replace(F.lower(F.trim(raw)), F.lit("_"), F.lit(" "))
    out = F.when(key.isin([k for k, v in D.LABEL_WORDS.items() if v]), 1)
    return out.when(key.isin([k for k, v in D.LABEL_WORDS.items() if not v]), 0)


def resolve_label(raw: Column, mapping: dict[str, int] | None = None, fixed: int | None = None) -> Column:
    """A fixed label, else the mapped one (exact, then trimmed and lower-cased), else 0 or 1 as given."""
    if fixed is not None:
        return F.lit(fixed)
    if mapping:
        table = F.create_map(*[F.lit(x) for kv in mapping.items() for x in kv])
        return F.coalesce(F.try_element_at(table, raw), F.try_element_at(table, F.lower(F.trim(raw))))
    number = raw.try_cast("int")
    return F.when(number.isin(0, 1), number)


def badge_key(raw: Column) -> Column:
    t = F.replace(F.lower(F.trim(F.regexp_replace(raw, r"\s+", " "))), F.lit("ä"), F.lit("ae"))
    happy = F.contains(t, F.lit("zufriedenheit"))
    level = F.when(F.contains(t, F.lit("top")), "zufriedenheit_top").when(F.rlike(t, F.lit("na ?ja")), "zufriedenheit_naja").when(F.rlike(t, F.lit(r"\bok\b")), "zufriedenheit_ok")
    words = F.replace(t, F.lit(" "), F.lit("_"))
    return F.when(t.isin(list(D.BADGES)), t).when(happy, level).when(words.isin(list(D.BADGES)[3:]) & ~F.contains(t, F.lit("_")), words)


def badge_keys(raw: Column) -> Column:
    return F.array_distinct(F.filter(F.transform(raw, badge_key), lambda k: k.isNotNull()))


def legal_form(name: Column) -> Column:
    """The legal form at the end of a name; the name itself is dropped."""
    head = F.substring(F.trim(F.regexp_replace(name, r"\s+", " ")), 1, 80)
    return F.nullif(F.regexp_extract(head, D.LEGAL_FORM, 1), F.lit(""))


def seller_type(raw: Column) -> Column:
    t = F.lower(F.trim(raw))
    return F.when(F.startswith(t, F.lit("gewerb")), "gewerblich").when(F.startswith(t, F.lit("privat")), "privat")


def blank(x: Column) -> Column:
    return F.trim(F.coalesce(x, F.lit(""))) == ""


def chat_only(title: Column, description: Column, messages: Column) -> Column:
    return (F.coalesce(F.size(messages), F.lit(0)) > 0) & blank(title) & blank(description)


def full_text(title: Column, description: Column, messages: Column) -> Column:
    parts = F.concat(F.array(title, description), F.coalesce(messages, F.array().cast("array<string>")))
    parts = F.transform(F.filter(parts, lambda p: p.isNotNull()), lambda p: F.regexp_replace(p, r"(?U)^\s+|\s+$", ""))
    return F.array_join(F.filter(parts, lambda p: p != ""), "\n")


def item_kind(title: Column, description: Column, messages: Column, images: Column) -> Column:
    n = F.coalesce(F.size(messages), F.lit(0))
    empty = blank(title) & blank(description)
    return (
        F.when(empty & (n == 0) & (F.coalesce(F.size(images), F.lit(0)) > 0), "Bild")
        .when(empty & (n > 1), "Chat")
        .when(empty & (n == 1), "Nachricht")
        .when(n > 0, "Inserat mit Chat")
        .otherwise("Inserat")
    )


def account_age(raw: Column, today: Column) -> Column:
    """Days since 'aktiv seit dd.mm.yyyy', at least 0; null for no or a bad date."""
    m = F.regexp_extract(F.lower(raw), r"aktiv seit (\d{1,2}\.\d{1,2}\.\d{4})", 1)
    return F.greatest(F.lit(0), F.datediff(today, F.try_to_timestamp(m, F.lit("d.M.yyyy")).cast("date")))


def post_date(raw: Column) -> Column:
    """An ISO prefix or a dd.mm.yyyy anywhere."""
    iso = F.nullif(F.regexp_extract(raw, r"^(\d{4}-\d{2}-\d{2})", 1), F.lit(""))
    german = F.nullif(F.regexp_extract(raw, r"(\d{2}\.\d{2}\.\d{4})", 1), F.lit(""))
    return F.coalesce(iso.try_cast("date"), F.try_to_timestamp(german, F.lit("dd.MM.yyyy")).cast("date"))


def transliterated(s: Column) -> Column:
    return reduce(lambda x, r: F.replace(x, F.lit(r[0]), F.lit(r[1])), [("ä", "ae"), ("ö", "oe"), ("ü", "ue"), ("ß", "ss")], s)


def person_key(name: Column) -> Column:
    return F.substring(F.regexp_replace(transliterated(F.lower(F.trim(name))), "[^a-z0-9]+", ""), 1, 30)


def title_slug(title: Column) -> Column:
    slug = F.regexp_replace(transliterated(F.lower(F.coalesce(title, F.lit("")))), "[^a-z0-9]+", "-")
    slug = F.regexp_replace(F.substring(F.regexp_replace(slug, "^-+|-+$", ""), 1, 50), "-+$", "")
    return F.when(slug == "", "inserat").otherwise(slug)


def text_key(text: Column) -> Column:
    return F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}_]+", "")


def chat_lines(pasted: Column) -> Column:
    return F.filter(F.transform(F.split(pasted, "\n"), F.trim), lambda s: s != "")


def clip_words(text: Column, most: int) -> Column:
    """At most `most` characters, cut at white space where the text is longer."""
    head = F.substring(text, 1, most)
    cut = F.regexp_extract(head, r"(?s)^(.*)\s", 1)
    return F.when(F.length(text) <= most, text).otherwise(F.concat(F.when(cut == "", head).otherwise(cut), F.lit(" …")))


def recent_messages(messages: Column, budget: int = D.MESSAGE_BUDGET) -> Column:
    """The newest messages, in their order, of `budget` characters together; the last that still fits in part is cut at a space."""

    def shortened(m: Column, room: Column) -> Column:
        return F.concat(F.regexp_replace(F.left(m, room), r"(?s) [^ ]*$", ""), F.lit(D.SHORTENED))

    def step(s: Column, m: Column) -> Column:
        room = F.lit(budget) - s["used"]
        text = F.when(F.length(m) <= room, m).otherwise(shortened(m, room))
        more = F.struct(F.concat(s["kept"], F.array(text)).alias("kept"), (s["used"] + F.length(text)).alias("used"))
        return F.when(s["used"] < budget, more).otherwise(s)

    start = F.struct(F.array().cast("array<string>").alias("kept"), F.lit(0).alias("used"))
    return F.aggregate(F.reverse(messages), start, step, lambda s: F.reverse(s["kept"]))


def excerpt(text: Column, words: int) -> Column:
    every = F.filter(F.split(text, r"\s+"), lambda w: w != "")
    return F.concat(F.array_join(F.slice(every, 1, words), " "), F.when(F.size(every) > words, " …").otherwise(""))


def feature_value(name: Column, value: Column) -> Column:
    """A feature's value for people: yes or no, unknown, a whole number, or two decimals."""
    flag = F.startswith(name, F.lit("has_")) | F.startswith(name, F.lit("signal_"))
    whole = value == F.floor(value)
    return (
        F.when(value == -1, "unbekannt").when(flag & (value > 0), "ja").when(flag, "nein").when(whole, value.cast("long").cast("string")).otherwise(F.format_string("%.2f", value))
    )


def prompt_text(title: Column, description: Column, price: Column, category: Column, messages: Column) -> Column:
    """A listing as text for a judge; without ad fields where there is only a chat; never the seller's name or place."""
    only = chat_only(title, description, messages)
    ad = lambda x: F.when(~only, x)
    chat = F.array_join(F.transform(messages, lambda m, i: F.concat(F.lit("["), (i + 1).cast("string"), F.lit("] "), m)), "\n")
    return F.concat_ws(
        "\n",
        ad(F.concat(F.lit("Titel: "), title)),
        ad(F.concat(F.lit("Preis: "), F.format_string("%.0f", price), F.lit(" EUR"))),
        ad(F.concat(F.lit("Kategorie: "), category)),
        ad(F.concat(F.lit("Beschreibung: "), clip_words(description, 4000))),
        F.when(F.size(messages) > 0, F.concat(F.lit("Chat:\n"), chat)),
    )


def looks_binary(text: Column, most: float = 0.02) -> Column:
    """Whether over 2 % of the first 20,000 characters are control or replacement characters."""
    head = F.substring(text, 1, 20_000)
    odd = F.length(head) - F.length(F.regexp_replace(head, "[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f�]", ""))
    return F.coalesce(odd > most * F.length(head), F.lit(False))
