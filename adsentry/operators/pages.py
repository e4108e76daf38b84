"""Landed pages to rows: fields, posts, links, quotes, line boxes."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import normalize as N
from ..functions.contact import let
from ..plans import dimensions as D

QUOTE = r"(?s)(.{0,160})[„“\"]([^„“”\"]{25,1500})[“”\"]"
CUES = "(?i)schrieb|schreibt|nachricht|antwort|kam|mail|sms|stand"


def tag_texts(html: Column, tag: str) -> Column:
    """The texts of all elements of a simple tag, without markup."""
    inner = F.regexp_extract_all(html, F.lit(rf"(?s)<{tag}\b[^>]*>(.*?)</{tag}>"), F.lit(1))
    return F.transform(inner, lambda x: F.trim(F.regexp_replace(F.regexp_replace(x, "<[^>]*>", " "), r"\s+", " ")))


def ad_fields(pages: DataFrame) -> DataFrame:
    """page_id, url, title, n_lines, lang and where the breadcrumb leads, of an ad page."""
    crumbs = F.regexp_extract_all("html", F.lit('<a href="/([^"]*)"'), F.lit(1))
    lang = F.regexp_extract("html", '<html lang="([a-z]+)"', 1)
    return pages.select("page_id", "url", F.try_element_at(tag_texts(F.col("html"), "h1"), F.lit(1)).alias("title"), F.size(tag_texts(F.col("html"), "p")).alias("n_lines"), lang.alias("lang"), F.array_join(crumbs, " > ").alias("breadcrumb"))


def row_fields(rows: Column, today: Column) -> Column:
    """PAG-02: the fields of an advert out of the text rows of its page, from top to bottom.

    The price is the first row that is one; the title is the nearest row above it with words of its own; a row of several
    steps is the breadcrumb; the place starts at the postcode. The description goes from its heading to the first row that
    ends it; without a heading it is what is left."""
    phrases = r"(?U)(?<!\w)(?:" + "|".join(re.escape(x) for x in sorted(D.PAGE_PHRASES, key=len, reverse=True)) + r")(?!\w)"
    starts = lambda key, words: F.rlike(key, F.lit("^(?:" + "|".join(map(re.escape, words)) + ")"))

    def described(row: Column, i: Column) -> Column:
        key = F.regexp_replace(F.lower(row), r"(?U)^(?:[^\w\s€]+\s*|\w\s+(?=\w\w))+", "")
        return let(F.trim(key), lambda k: F.struct(row.alias("row"), i.alias("i"), k.alias("key"), words(k).alias("words"), crumb(k).alias("crumb")))

    def words(key: Column) -> Column:
        return F.size(F.regexp_extract_all(F.regexp_replace(key, phrases, " "), F.lit(r"\p{L}{3,}"), F.lit(0)))

    def crumb(key: Column) -> Column:
        steps = F.size(F.regexp_extract_all(key, F.lit("[›>»]"), F.lit(0)))
        return (steps >= 2) | F.contains(key, F.lit("kleinanzeigen")) & (steps > 0)

    def first(xs: Column, test) -> Column:
        return F.try_element_at(F.filter(xs, test), F.lit(1))

    def fields(xs: Column) -> Column:
        price = first(xs, lambda x: F.rlike(x["key"], F.lit(D.ROW_PRICE)))
        return let(F.struct(price.alias("price"), F.coalesce(price["i"], F.size(xs)).alias("end")), lambda p: with_title(xs, p))

    def with_title(xs: Column, p: Column) -> Column:
        named = F.filter(xs, lambda x: (x["i"] < p["end"]) & (x["words"] > 0) & ~x["crumb"] & ~F.rlike(x["key"], F.lit(D.ROW_COUNTER)))
        title = F.when(p["price"].isNull(), F.try_element_at(named, F.lit(1))).otherwise(F.try_element_at(named, F.lit(-1)))
        return let(title, lambda t: all_fields(xs, p, t))

    def all_fields(xs: Column, p: Column, title: Column) -> Column:
        name = F.trim(F.regexp_replace(title["row"], D.ROW_BADGES, ""))
        place = first(F.transform(xs, lambda x: F.regexp_extract(x["row"], D.ROW_POSTCODE, 0)), lambda m: m != "")
        age = first(xs, lambda x: F.rlike(x["row"], F.lit(D.ROW_AGE)))
        seller = first(xs, lambda x: starts(x["key"], D.SELLER_ROWS))
        return F.struct(
            name.alias("title"),
            N.parse_price(p["price"]["key"]).alias("price"),
            N.normalize_category(F.coalesce(first(xs, lambda x: x["crumb"])["row"], name)).alias("category"),
            F.regexp_replace(place, r"^[ ,-]+|[ ,-]+$", "").alias("location"),
            N.account_age(F.regexp_replace(age["row"], r"\s+", " "), today).alias("account_age_days"),
            N.seller_type(seller["key"]).alias("seller_type"),
            description(xs, p, title).alias("description"),
        )

    def description(xs: Column, p: Column, title: Column) -> Column:
        head = first(xs, lambda x: x["key"] == "beschreibung")["i"]
        stop = F.coalesce(first(xs, lambda x: starts(x["key"], D.PAGE_ENDS))["i"], F.size(xs))
        last = F.coalesce(first(xs, lambda x: (x["i"] > head) & starts(x["key"], D.DESCRIPTION_ENDS + D.PAGE_ENDS))["i"], F.size(xs))
        under = F.filter(xs, lambda x: (x["i"] > head) & (x["i"] < last))
        names = F.transform(F.filter(xs, lambda x: starts(x["key"], D.SELLER_ROWS)), lambda x: x["i"] - 1)
        other = lambda x: (x["i"] < stop) & ~x["i"].eqNullSafe(p["price"]["i"]) & ~x["i"].eqNullSafe(title["i"]) & ~F.array_contains(names, x["i"])
        plain = lambda x: (x["words"] >= 2) & ~x["crumb"] & ~starts(x["key"], D.DESCRIPTION_ENDS) & ~F.rlike(x["row"], F.lit(D.ROW_POSTCODE))
        left = F.filter(xs, lambda x: other(x) & plain(x))
        return F.array_join(F.transform(F.when(head.isNotNull(), under).otherwise(left), lambda x: x["row"]), "\n")

    clean = F.filter(F.transform(rows, lambda r: F.trim(r)), lambda r: r != "")
    return let(F.transform(clean, described), fields)


def posts(pages: DataFrame) -> DataFrame:
    """page_id, post_no, text: the paragraphs of a thread page."""
    return pages.select("page_id", F.posexplode(tag_texts(F.col("html"), "p")).alias("post_no", "text")).filter("text <> ''")


def links(pages: DataFrame, pattern: str = 'href="([^"]+)"') -> DataFrame:
    return pages.select("page_id", F.explode(F.regexp_extract_all("html", F.lit(pattern), F.lit(1))).alias("link"))


def received_messages(texts: DataFrame, key: str) -> DataFrame:
    """Quotes of some length that words for a message introduce."""
    both = F.arrays_zip(F.regexp_extract_all("text", F.lit(QUOTE), F.lit(1)).alias("before"), F.regexp_extract_all("text", F.lit(QUOTE), F.lit(2)).alias("quote"))
    each = texts.select(key, F.explode(both).alias("q")).select(key, "q.before", "q.quote")
    return each.filter(F.rlike("before", F.lit(CUES)) & (F.size(F.split("quote", r"\s+")) >= 4)).select(key, "quote")


def image_urls(posts_: DataFrame, key: str, hosts: list[str]) -> DataFrame:
    """Image links of a post's JSON, single or gallery, from known hosts."""
    parsed = F.from_json("json", "struct<url:string,gallery:array<string>>")
    each = posts_.select(key, F.explode(F.concat(F.array(parsed["url"]), F.coalesce(parsed["gallery"], F.array().cast("array<string>")))).alias("url"))
    return each.filter(F.regexp_extract("url", "^https?://([^/]+)", 1).isin(hosts)).distinct()


def without_overlap(lines: DataFrame) -> DataFrame:
    """Recognised lines of an image, without those that repeat a line above at a distance below its height."""
    before = Window.partitionBy("image", "text").orderBy("top")
    gap = F.col("top") - F.lag("top").over(before)
    return lines.withColumn("gap", gap).filter("gap IS NULL OR gap >= height").drop("gap")


def rows_of_boxes(lines: DataFrame) -> DataFrame:
    """Line boxes to text rows: boxes of nearly the same top stand side by side. lines: image, text, top, left, height."""
    up = Window.partitionBy("image").orderBy("top", "left")
    new = F.coalesce((F.col("top") - F.lag("top").over(up) > F.col("height") / 2).cast("int"), F.lit(1))
    numbered = lines.withColumn("new", new).withColumn("row", F.sum("new").over(up))
    texts = numbered.groupBy("image", "row").agg(F.array_sort(F.collect_list(F.struct("left", "text"))).alias("parts"))
    return texts.select("image", "row", F.array_join(F.transform("parts", lambda p: p["text"]), " ").alias("text"))


def merged_files(files: DataFrame) -> DataFrame:
    """Several files of a listing as one: the first page's fields win, chat parts become messages. files: item, file, title, message."""
    return files.groupBy("item").agg(F.min_by("title", F.when(F.col("title").isNotNull(), F.col("file"))).alias("title"), F.transform(F.array_sort(F.collect_list(F.when(F.col("message").isNotNull(), F.struct("file", "message")))), lambda x: x["message"]).alias("messages"))
