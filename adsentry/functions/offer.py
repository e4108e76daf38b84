"""What price and seller say about an offer."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..plans import dimensions as D
from . import signals as S
from .contact import let
from .wording import any_of, stems_of

BUSINESS_CONTACT = ["PHONE_IN_TEXT", "EMAIL_IN_TEXT", "EXTERNAL_LINK", "OFFPLATFORM_CONTACT"]
HIGH_VALUE = 200


def reference_min(title: Column, description: Column) -> Column:
    """The least usual price of the first known item in the title, else in the description; null for accessories and the like."""

    def first(low: Column) -> Column:
        known = list(zip(D.PRICE_REFERENCE, D.PRICE_STEMS, strict=True))
        return let(stems_of(low, D.PRICE_STEMS), lambda found: F.coalesce(*[F.when(any_of(found, stems) & F.rlike(low, F.lit(p)), F.lit(least)) for (p, least, _), stems in known]))

    return F.when(~not_the_item(title), F.coalesce(let(F.lower(title), first), let(F.lower(description), first)))


def not_the_item(title: Column) -> Column:
    """Accessories, broken things, and adverts that seek, swap or let."""
    low = F.lower(F.coalesce(title, F.lit("")))
    words = "|".join(D.NOT_THE_ITEM) + "|(?:" + "|".join(D.NOT_THE_ITEM_STARTS) + r")\w*"
    games = "".join(f"(?<!{b})" for b in D.BEFORE_GAMES) + rf"\b{D.GAMES}\b"
    return F.rlike(low, F.lit(rf"(?U)\b(?:{words})\b|{games}"))


def price_ratio(price: Column, least: Column) -> Column:
    return F.coalesce(price / least, F.lit(1.0))


def price_signals(price: Column, least: Column) -> Column:
    ratio = F.when(price.isNotNull() & least.isNotNull(), price / least)
    return S.found(
        F.when((ratio > 0) & (ratio < 0.4), S.signal("PRICE_FAR_TOO_LOW", 0.55, F.format_string("%.0f €", price), target="price")),
        F.when((ratio >= 0.4) & (ratio < 0.65), S.signal("PRICE_LOW", 0.25, F.format_string("%.0f €", price), target="price")),
    )


def commercial(kind: Column, legal_form: Column) -> Column:
    return F.coalesce(kind == "gewerblich", legal_form.isNotNull())


def seller_signals(price: Column, age: Column, ratings: Column, kind: Column, badges: Column, legal_form: Column) -> Column:
    firm = commercial(kind, legal_form)
    dear = F.coalesce(price >= HIGH_VALUE, F.lit(False))
    rated = F.exists(badges, lambda b: F.startswith(b, F.lit("zufriedenheit_")))
    unrated = F.coalesce(ratings == 0, F.lit(False)) | (kind.isNotNull() & ~rated)
    days = F.concat(age.cast("string"), F.lit(" Tage"))
    account = (
        F.when((age <= 1) & ~firm & dear, S.signal("NEW_ACCOUNT", 0.45, days, target="seller"))
        .when(age < 7, S.signal("NEW_ACCOUNT", 0.3, days, target="seller"))
        .when(age < 30, S.signal("YOUNG_ACCOUNT", 0.1, days, target="seller"))
    )
    return S.found(
        account,
        F.when(unrated & ~firm & dear & (age.isNull() | (age < 365)), S.signal("NO_RATINGS_HIGH_VALUE", 0.15, target="seller")),
        F.when((kind == "privat") & legal_form.isNotNull(), S.signal("COMMERCIAL_AS_PRIVATE", 0.15, legal_form, target="seller")),
        F.when(F.array_contains(badges, "zufriedenheit_naja"), S.signal("LOW_SATISFACTION", 0.15, target="seller")),
    )


def seller_notes(price: Column, category: Column, kind: Column, legal_form: Column, summary: Column) -> Column:
    """Signals without weight, for information."""
    firm = commercial(kind, legal_form)
    return S.found(
        F.when(summary != "", S.signal("SELLER_PROFILE", 0.0, summary, info=True, target="seller")),
        F.when(firm, S.signal("COMMERCIAL_SELLER", 0.0, info=True, target="seller")),
        F.when((category == "dienstleistungen") | (firm & price.isNull()), S.signal("SERVICE_OR_AD", 0.0, info=True)),
    )


def profile_summary(age: Column, kind: Column, badges: Column, ads: Column, legal_form: Column) -> Column:
    form = F.coalesce(F.concat(F.lit(" ("), legal_form, F.lit(")")), F.lit(""))
    firm = commercial(kind, legal_form)
    months = F.floor(age / 30)
    years = F.floor(months / 12)
    many = lambda n, one, more: F.when(n == 1, one).otherwise(more)
    active = (
        F.when(age < 60, F.concat(F.lit("seit "), age.cast("string"), many(age, " Tag aktiv", " Tagen aktiv")))
        .when(years > 0, F.concat(F.lit("seit "), years.cast("string"), many(years, " Jahr aktiv", " Jahren aktiv")))
        .otherwise(F.concat(F.lit("seit "), months.cast("string"), F.lit(" Monaten aktiv")))
    )
    names = F.create_map(*[F.lit(x) for kv in D.BADGES.items() for x in kv])
    shown = F.when(F.size(badges) > 0, F.array_join(F.transform(badges, lambda b: names[b]), ", ")).when(kind.isNotNull(), "keine Bewertungs-Abzeichen")
    who = F.when(firm, F.concat(F.lit("Gewerblicher Anbieter"), form)).when(kind == "privat", F.concat(F.lit("Privater Nutzer"), form))
    return F.concat_ws(" · ", who, F.when(age.isNotNull(), active), shown, F.concat(ads.cast("string"), many(ads, " Anzeige", " Anzeigen")))


def business_adjusted(signals: Column, firm: Column) -> Column:
    """Soft contact signals count less for commercial sellers."""

    def adjust(s: Column) -> Column:
        weight = F.when(s["code"].isin(BUSINESS_CONTACT) & ~s["hard"] & ~s["info"], F.bround(s["weight"] * 0.3, 3)).otherwise(s["weight"])
        return F.struct(s["code"].alias("code"), weight.alias("weight"), s["evidence"].alias("evidence"), s["hard"].alias("hard"), s["info"].alias("info"), s["target"].alias("target"))

    return F.when(firm, F.transform(signals, adjust)).otherwise(signals)


def seller_box(rows: Column) -> dict[str, Column]:
    """Fields of a seller box's text rows; the count of ads may stand in the row before the word."""
    from . import normalize as N

    any_of = lambda f: F.try_element_at(F.filter(F.transform(rows, f), lambda x: x.isNotNull()), F.lit(1))
    same = any_of(lambda r: F.nullif(F.regexp_extract(r, r"^(\d+)\s+Anzeigen?(?: online)?$", 1), F.lit("")))
    before = F.transform(rows, lambda r, i: F.when(F.rlike(r, F.lit("^Anzeigen?(?: online)?$")) & (i > 0), F.regexp_extract(F.get(rows, i - 1), r"^(\d+)$", 1)))
    split = F.try_element_at(F.filter(before, lambda x: x.isNotNull() & (x != "")), F.lit(1))
    return {
        "seller_type": any_of(N.seller_type),
        "seller_badges": N.badge_keys(rows),
        "seller_num_ads": F.coalesce(same, split).cast("int"),
        "seller_legal_form": any_of(N.legal_form),
    }


def first_match(text: Column, table: list[tuple[str, str]]) -> Column:
    """The name of the first pattern of an ordered table that a text has."""
    return reduce(lambda rest, row: F.when(F.rlike(text, F.lit(row[1])), F.lit(row[0])).otherwise(rest), reversed(table), F.lit(None).cast("string"))
