"""Links, mail addresses, phone numbers and IBANs in a text, and what they say."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..plans import dimensions as D
from . import signals as S

# The patterns.
EMAIL = r"(?i)\b[a-z0-9._%+-]+@[a-z0-9.-]+\.[a-z]{2,24}\b"
TLDS = "|".join(D.COMMON_TLDS + sorted(D.SUSPICIOUS_TLDS))
URL = rf"""(?i)(?:https?://|www\.)[^\s<>"')\]]+|\b[a-z0-9][a-z0-9-]{{0,62}}(?:\.[a-z0-9-]{{1,63}})*\.(?:{TLDS})\b(?:/[^\s<>"')\]]*)?"""
MAYBE_URL = r"(?i)://|www\.|\.[a-z]"  # every link has one of these
MAYBE_IBAN = r"[A-Za-z]{2}\d{2}"
INTL_PHONE = r"(?:\+|\b00)(\d{1,3})[\s\-/.]?\(?\d{1,5}\)?(?:[\s\-/.]?\d{2,}){1,4}"
HOME_PHONE = r"(?=0)(?<![\w+])0\d{2,5}[\s\-/.]?\d{3,}(?:[\s\-/.]?\d{2,}){0,3}"
IBAN = r"(?i)\b[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,4})?\b"


def every(text: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def emails(text: Column) -> Column:
    return F.when(F.contains(text, F.lit("@")), F.array_sort(F.array_distinct(every(text, EMAIL)))).when(text.isNotNull(), F.array().cast("array<string>"))


def without_mails(text: Column) -> Column:
    return F.when(F.contains(text, F.lit("@")), F.regexp_replace(text, EMAIL, " ")).otherwise(text)


def urls(text: Column) -> Column:
    """Links and bare domains; mail addresses are blanked first."""
    found = every(without_mails(text), URL)
    ends = F.transform(found, lambda u: F.regexp_replace(u, r"[.,;:!?]+$", ""))
    return F.when(F.rlike(text, F.lit(MAYBE_URL)), F.array_sort(F.array_distinct(ends))).when(text.isNotNull(), F.array().cast("array<string>"))


def host_of(url: Column) -> Column:
    host = F.regexp_extract(F.regexp_replace(F.trim(url), "(?i)^https?://", ""), "^([^/?#]*)", 1)
    return F.lower(F.regexp_extract(F.regexp_extract(host, "([^@]*)$", 1), "^([^:]*)", 1))


def suffix_of(host: Column) -> Column:
    parts = F.split(host, r"\.")
    two = F.array_join(F.slice(parts, F.greatest(F.size(parts) - 1, F.lit(1)), 2), ".")
    return F.when(F.size(parts) < 2, "").when(two.isin(D.LONG_SUFFIXES) & (F.size(parts) > 2), two).otherwise(F.element_at(parts, -1))


def domain_of(host: Column) -> Column:
    """The label before the suffix."""
    rest = F.when(suffix_of(host) == "", host).otherwise(F.substring(host, F.lit(1), F.length(host) - F.length(suffix_of(host)) - 1))
    return F.element_at(F.split(rest, r"\."), -1)


def registered(host: Column) -> Column:
    return F.when(suffix_of(host) == "", domain_of(host)).otherwise(F.concat(domain_of(host), F.lit("."), suffix_of(host)))


def folded(host: Column) -> Column:
    return F.translate(host, *D.HOMOGLYPHS)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` of a value that is computed once, however often `body` names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def imitated_brand(host: Column) -> Column:
    """The first brand that a host imitates; null for official domains and others."""

    def hit(x: Column, brand: str) -> Column:
        own = F.array_contains(x["tokens"], brand)
        if len(brand) < 5:
            return own
        return own | F.contains(x["folded"], F.lit(brand)) | F.levenshtein(x["domain"], F.lit(brand), 2).between(1, 2)

    def judge(x: Column) -> Column:
        name = F.element_at(F.split(F.substring(x["host"], F.lit(1), F.length(x["host"]) - F.length(x["suffix"]) - 1), r"\."), -1)
        return F.struct(F.concat_ws(".", name, x["suffix"]).alias("registered"), F.translate(name, *D.HOMOGLYPHS).alias("domain"), x["folded"].alias("folded"), F.split(x["folded"], r"[.\-]").alias("tokens"))

    parts = F.struct(host.alias("host"), suffix_of(host).alias("suffix"), folded(host).alias("folded"))
    return let(let(parts, judge), lambda x: F.when(~x["registered"].isin(D.OFFICIAL_DOMAINS), F.coalesce(*[F.when(hit(x, b), b) for b in D.BRANDS])))


def url_signals(found: Column) -> Column:
    """All signals of all links, link after link."""

    def of(x: Column) -> Column:
        url, host, brand = x["url"], x["host"], x["brand"]
        return S.found(
            F.when(brand.isNotNull(), S.signal("LOOKALIKE_DOMAIN", 0.9, url, hard=True)),
            F.when(x["registered"].isin(D.SHORTENERS), S.signal("URL_SHORTENER", 0.45, url)),
            F.when(F.element_at(F.split(host, r"\."), -1).isin(D.SUSPICIOUS_TLDS), S.signal("SUSPICIOUS_TLD", 0.4, url)),
            F.when(F.rlike(host, F.lit(r"^\d{1,3}(\.\d{1,3}){3}$")), S.signal("IP_URL", 0.6, url)),
            F.when(F.contains(host, F.lit("xn--")), S.signal("PUNYCODE_URL", 0.6, url)),
            F.when(brand.isNull() & ~x["registered"].isin(D.OFFICIAL_DOMAINS), S.signal("EXTERNAL_LINK", 0.2, url)),
        )

    hosts = F.transform(found, lambda u: F.struct(u.alias("url"), host_of(u).alias("host")))
    branded = F.transform(hosts, lambda x: F.struct(x["url"].alias("url"), x["host"].alias("host"), registered(x["host"]).alias("registered"), imitated_brand(x["host"]).alias("brand")))
    return F.flatten(F.transform(branded, of))


def email_signals(found: Column) -> Column:
    def of(mail: Column) -> Column:
        local, host = F.substring_index(F.lower(mail), "@", 1), F.substring_index(F.lower(mail), "@", -1)
        named = reduce(lambda a, b: a | b, [F.contains(folded(local), F.lit(b)) for b in D.BRANDS if len(b) >= 5])
        fake = imitated_brand(host).isNotNull() | named
        return F.when(fake, S.signal("IMPERSONATION_EMAIL", 0.8, mail, hard=True)).otherwise(S.signal("EMAIL_IN_TEXT", 0.3, mail))

    return F.transform(found, of)


def without_ibans(text: Column) -> Column:
    rest = without_mails(text)
    return F.when(F.rlike(text, F.lit(MAYBE_IBAN)), F.regexp_replace(rest, IBAN, " ")).otherwise(rest)


def maybe_intl(text: Column) -> Column:
    return F.contains(text, F.lit("+")) | F.contains(text, F.lit("00"))


def numbers(text: Column) -> Column:
    """The international and the home numbers of a text, one for each occurrence. Texts without the digits that these begin with are not searched."""
    none = lambda rest: F.when(rest.isNotNull(), F.array().cast("array<string>"))

    def of(rest: Column) -> Column:
        intl = F.when(maybe_intl(rest), every(rest, INTL_PHONE)).otherwise(none(rest))
        home = F.when(F.contains(rest, F.lit("0")), every(rest, HOME_PHONE)).otherwise(none(rest))
        return F.struct(intl.alias("intl"), home.alias("home"))

    return let(without_ibans(text), of)


def phones(text: Column) -> Column:
    return let(numbers(text), distinct_phones)


def distinct_phones(found: Column) -> Column:
    return F.array_sort(F.array_distinct(F.concat(found["intl"], found["home"])))


def foreign_phones(text: Column) -> Column:
    """International numbers outside the home countries, one for each occurrence."""
    return _foreign(numbers(text))


def _foreign(found: Column) -> Column:
    code = lambda number: F.regexp_extract(number, INTL_PHONE, 1)
    home = lambda x: reduce(lambda a, b: a | b, [F.startswith(x, F.lit(c)) for c in D.HOME_PHONE_CODES])
    return F.filter(found["intl"], lambda number: ~home(code(number)))


def phone_signals(found: Column) -> Column:
    """Out of what `numbers` finds."""
    any_phone = lambda p: S.found(F.when(F.size(p) > 0, S.signal("PHONE_IN_TEXT", 0.15, F.try_element_at(p, F.lit(1)))))
    of = lambda x: F.concat(F.transform(_foreign(x), lambda n: S.signal("FOREIGN_PHONE", 0.45, n)), let(distinct_phones(x), any_phone))
    return let(found, of)


def iban_signals(ibans: Column) -> Column:
    shown = lambda x: F.concat(F.substring(x, 1, 8), F.lit("…"))
    return F.transform(ibans, lambda x: F.when(F.substring(x, 1, 2).isin(*D.HOME_IBAN_COUNTRIES), S.signal("IBAN_IN_TEXT", 0.3, shown(x))).otherwise(S.signal("FOREIGN_IBAN", 0.55, shown(x))))


def remainder(letters: Column) -> Column:
    """Of digits and letters, which count from A = 10 on, modulo 97."""
    digit = lambda c: F.instr(F.lit("0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"), c) - 1
    step = lambda r, c: F.when(digit(c) > 9, (r * 100 + digit(c)) % 97).otherwise((r * 10 + digit(c)) % 97)
    return F.aggregate(F.filter(F.split(letters, ""), lambda c: c != ""), F.lit(0), lambda r, c: step(r, c).cast("int"))


def iban_valid(iban: Column) -> Column:
    """Length 15 to 34 and remainder 1 modulo 97."""
    s = F.upper(F.replace(iban, F.lit(" "), F.lit("")))
    turned = F.concat(F.substring(s, F.lit(5), F.length(s)), F.substring(s, 1, 4))
    return F.length(s).between(15, 34) & F.rlike(s, F.lit("^[A-Z0-9]+$")) & (remainder(turned) == 1)


def contacts(text: Column) -> dict[str, Column]:
    """What the signals and the numbers of a text's contact data are made of, as columns that are found once."""
    return {"urls": urls(text), "emails": emails(text), "numbers": numbers(text)}


def contact_signals(found: dict[str, Column], ibans: Column | None = None) -> Column:
    """Links, mails, phones (see `contacts`), and IBANs where they were found before (see `redact.find_ibans`)."""
    parts = [url_signals(found["urls"]), email_signals(found["emails"]), phone_signals(found["numbers"])]
    return F.concat(*parts, *([] if ibans is None else [iban_signals(ibans)]))


def contact_vector(found: dict[str, Column], signals: Column, ibans: Column | None = None) -> list[Column]:
    has = lambda code: F.array_contains(S.codes(signals), code).cast("double")
    return [
        F.size(found["urls"]).alias("n_urls"),
        F.size(found["emails"]).alias("n_emails"),
        F.size(let(found["numbers"], distinct_phones)).alias("n_phones"),
        (F.lit(0) if ibans is None else F.size(ibans)).alias("n_ibans"),
        has("LOOKALIKE_DOMAIN").alias("has_lookalike_domain"),
        has("URL_SHORTENER").alias("has_shortener"),
        has("FOREIGN_PHONE").alias("has_foreign_phone"),
        has("FOREIGN_IBAN").alias("has_foreign_iban"),
    ]


def marked(text: Column, parts: Column) -> Column:
    """Where each part stands in the text: (part, first character from 1, or 0)."""
    return F.transform(parts, lambda p: F.struct(p.alias("part"), F.locate(p, text).alias("at")) if isinstance(p, str) else F.struct(p.alias("part"), F.instr(text, p).alias("at")))
