"""Elements and texts of HTML pages as tables, and what is read from them: threads, adverts, warnings.

A page is cut into tags and texts, numbered in order. Tags are matched without walking the page: counted over the tags of
one name, opening tags raise a level and closing ones lower it, and at one level an opening tag is followed by the tag that
closes it. So an element is a range of numbers, and what lies inside is an equality join on the page with a range. Elements
that are never closed reach to the end of the page; tags that close nothing change nothing.

Rows are grouped by page only, so a task never holds more than a few pages; no page needs another one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import normalize as N
from ..plans import dimensions as D
from .storage import stored

SKIPPED = r"(?is)<(script|style|noscript|svg|template)\b.*?</\1\s*>|<!--.*?-->|<!doctype[^>]*>"
PIECE = r"(?s)(</?[a-zA-Z][^>]*>|[^<]+|<)"
VOID = "area base br col embed hr img input link meta source track wbr".split()


def attribute(tag: Column, name: str) -> Column:
    """The value of an attribute of an opening tag; null without it, empty if it has no value."""
    start = rf"(?is)[\s\"']{name}(?=[\s=>/])"
    value = F.regexp_extract(tag, start + r"\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", 0)
    bare = F.regexp_replace(F.regexp_replace(value, start + r"\s*=\s*", ""), "^[\"']|[\"']$", "")
    return F.when(F.rlike(tag, F.lit(start)), decoded(bare))


def decoded(text: Column) -> Column:
    """Character references as characters; Spark brings the library for it."""
    return F.when(F.contains(text, F.lit("&")), F.reflect(F.lit("org.apache.commons.text.StringEscapeUtils"), F.lit("unescapeHtml4"), text)).otherwise(text)


def has_class(tag: Column, name: str) -> Column:
    return F.array_contains(F.split(F.coalesce(attribute(tag, "class"), F.lit("")), r"\s+"), name)


def pieces(pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(page_id, n, stop, tag, raw), the elements from their tag's number to the one of the tag that closes them, and (page_id, n,
    text), the texts; a line break is a text too. A null page has neither."""
    html = F.regexp_replace(F.coalesce("html", F.lit("")), SKIPPED, " ")
    each = pages.select("page_id", F.posexplode(F.regexp_extract_all(html, F.lit(PIECE), F.lit(1))).alias("n", "raw"))
    each = each.withColumn("tag", F.lower(F.regexp_extract("raw", "^</?([a-zA-Z][a-zA-Z0-9:-]*)", 1)))
    each = each.withColumn("opens", (F.col("tag") != "") & ~F.startswith("raw", F.lit("</"))).withColumn("single", F.col("tag").isin(VOID) | F.endswith("raw", F.lit("/>")))
    each = stored(each)
    texts = each.where("tag = '' OR tag = 'br'").select("page_id", "n", F.when(F.col("tag") == "br", "\n").otherwise(decoded(F.col("raw"))).alias("text"))
    tags = each.where("tag <> ''")
    over = Window.partitionBy("page_id", "tag").orderBy("n")
    level = F.sum(F.when(F.col("opens"), 1).otherwise(-1)).over(over) + F.when(F.col("opens"), 0).otherwise(1)
    paired = tags.where("NOT single").withColumn("level", level)
    paired = paired.withColumn("stop", F.coalesce(F.lead("n").over(Window.partitionBy("page_id", "tag", "level").orderBy("n")), F.lit(2**31 - 1)))
    single = tags.where("single AND opens").withColumn("stop", F.col("n"))
    columns = ["page_id", "n", "stop", "tag", "raw"]
    return stored(paired.where("opens").select(*columns).unionByName(single.select(*columns))), stored(texts)


def lines(text: Column) -> Column:
    """Text with single spaces, without spaces at line ends, and with one empty line at most."""
    spaced = F.regexp_replace(F.regexp_replace(text, r"[ \t\x{a0}]+", " "), r" ?\r?\n ?", "\n")
    return F.regexp_replace(F.regexp_replace(spaced, r"\n{3,}", "\n\n"), r"^\s+|\s+$", "")


def joined(order: str = "n") -> Column:
    """The texts of a group in their order."""
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, "text"))), lambda x: x["text"]), " ")


def inside(inner: DataFrame, outer: DataFrame, left: bool = False) -> DataFrame:
    """Rows of `inner` (page_id, n) with the columns of the elements of `outer` (page_id, o_n, o_stop, ...) that they are in."""
    on = (F.col("i.page_id") == F.col("o.page_id")) & (F.col("i.n") > F.col("o.o_n")) & (F.col("i.n") < F.col("o.o_stop"))
    return inner.alias("i").join(outer.alias("o"), on, "left" if left else "inner").drop(F.col("o.page_id"))


def named(elements: DataFrame, prefix: str, *more: str) -> DataFrame:
    return elements.select("page_id", F.col("n").alias(f"{prefix}_n"), F.col("stop").alias(f"{prefix}_stop"), *more)


def outer(elements: DataFrame) -> DataFrame:
    return named(elements, "o")


def text_in(texts: DataFrame, elements: DataFrame) -> DataFrame:
    """(page_id, o_n, text) of each element that has text."""
    return inside(texts, outer(elements)).groupBy("page_id", "o_n").agg(lines(joined()).alias("text"))


# threads


def thread_parts(elements: DataFrame) -> DataFrame:
    """(page_id, layout, part, n, stop, raw) of the elements that a layout names, of the first layout that the page has."""
    rules = [F.when((F.col("tag") == tag if tag else F.lit(True)) & (has_class(F.col("raw"), kind) if kind else F.lit(True)) & (attribute(F.col("raw"), name).isNotNull() if name else F.lit(True)), F.struct(F.lit(layout).alias("layout"), F.lit(part).alias("part"))) for layout, part, tag, kind, name in D.THREAD_PARTS]
    every = elements.select("page_id", "n", "stop", "raw", F.explode(F.array_distinct(F.filter(F.array(*rules), lambda x: x.isNotNull()))).alias("x"))
    every = stored(every.select("page_id", "x.layout", "x.part", "n", "stop", "raw"))
    known = every.groupBy("page_id", "layout").agg((F.max((F.col("part") == "post").cast("int")) + F.max((F.col("part") == "body").cast("int"))).alias("k")).where("k = 2")
    return every.join(known.groupBy("page_id").agg(F.min("layout").alias("layout")), ["page_id", "layout"])


def thread_posts(pages: DataFrame) -> DataFrame:
    """PAG-04: (page_id, post_no, text, external, date) of the posts of thread pages in three layouts.

    Quotes of members are left out; other texts that a post inserts stand in it as „…“, and in `external` with the `CUE_WINDOW`
    characters before them. Of quotes within quotes the outermost counts. Pages of other kinds have no posts."""
    elements, texts = pieces(pages)
    parts = stored(thread_parts(elements))
    part = lambda name: parts.where(F.col("part") == name)
    posts = part("post").select("page_id", F.col("n").alias("o_n"), F.col("stop").alias("o_stop"), "layout")
    bodies = inside(part("body").select("page_id", "n", "stop"), posts).groupBy("page_id", "o_n", "o_stop", "layout").agg(F.min(F.struct("n", "stop")).alias("b"))
    bodies = bodies.select("page_id", F.col("o_n").alias("post"), F.col("o_stop").alias("post_stop"), "layout", F.col("b.n").alias("o_n"), F.col("b.stop").alias("o_stop"))
    bodies = stored(bodies.withColumn("post_no", F.row_number().over(Window.partitionBy("page_id").orderBy("post")) - 1))

    quotes = stored(inside(part("quote").select("page_id", "n", "stop", "raw"), bodies.select("page_id", "o_n", "o_stop", "post_no")).select(F.col("i.page_id").alias("page_id"), "n", "stop", "post_no"))
    within = quotes.select("page_id", "n").alias("a").join(quotes.alias("b"), F.expr("a.page_id = b.page_id and a.n > b.n and a.n < b.stop")).select(F.col("a.page_id").alias("page_id"), F.col("a.n").alias("n")).distinct()
    quotes = quotes.join(within, ["page_id", "n"], "left_anti")
    titles = text_in(texts, part("heading")).where(F.contains("text", F.lit(D.MEMBER_HEADING))).select("page_id", F.col("o_n").alias("n"))
    marks = part("member").select("page_id", "n").unionByName(titles)
    member = marks.alias("m").join(quotes.alias("q"), F.expr("m.page_id = q.page_id and m.n > q.n and m.n < q.stop")).select(F.col("q.page_id").alias("page_id"), F.col("q.n").alias("n"))
    member = member.unionByName(part("own").select("page_id", "n")).distinct()
    content = inside(part("content").select("page_id", "n", "stop"), outer(quotes)).groupBy("page_id", "o_n").agg(F.min(F.struct("n", "stop")).alias("c"))
    content = content.select("page_id", F.col("o_n").alias("n"), "c")
    quotes = quotes.join(member.withColumn("member", F.lit(True)), ["page_id", "n"], "left").join(content, ["page_id", "n"], "left")
    quotes = stored(quotes.select("page_id", F.col("n").alias("o_n"), F.col("stop").alias("o_stop"), F.coalesce("member", F.lit(False)).alias("member"), "c"))

    own = inside(texts, bodies.select("page_id", "o_n", "o_stop", "post_no")).select(F.col("i.page_id").alias("page_id"), "n", "text", "post_no")
    junk = inside(own.select("page_id", "n"), outer(part("junk"))).select(F.col("i.page_id").alias("page_id"), "n").distinct()
    own = own.join(junk, ["page_id", "n"], "left_anti")
    told = inside(own, quotes, left=True).select(F.col("i.page_id").alias("page_id"), "n", "text", "post_no", F.col("o_n").alias("quote"), "member", "c")
    told = told.where("quote IS NULL OR (NOT member AND (c IS NULL OR (n > c.n AND n < c.stop)))")
    quoted = told.where("quote IS NOT NULL").groupBy("page_id", "post_no", "quote").agg(lines(joined()).alias("text")).select("page_id", "post_no", F.col("quote").alias("n"), "text", F.lit(True).alias("given"))
    pieces_ = told.where("quote IS NULL").select("page_id", "post_no", "n", "text", F.lit(False).alias("given")).unionByName(quoted)
    rows = pieces_.groupBy("page_id", "post_no").agg(F.array_sort(F.collect_list(F.struct("n", "text", "given"))).alias("p"))

    def text_of(p: Column) -> Column:
        return lines(F.array_join(F.transform(p, lambda x: F.when(x["given"], F.concat(F.lit("\n„"), x["text"], F.lit("“\n"))).otherwise(x["text"])), " "))

    given = F.filter("p", lambda x: x["given"])
    external = F.transform(given, lambda g: F.struct(F.right(text_of(F.filter("p", lambda x: x["n"] < g["n"])), F.lit(D.CUE_WINDOW)).alias("context"), g["text"].alias("quote")))
    rows = bodies.select("page_id", "post_no", "layout").join(rows, ["page_id", "post_no"], "left")
    rows = rows.select("page_id", "post_no", "layout", F.coalesce(text_of(F.col("p")), F.lit("")).alias("text"), F.coalesce(external, F.array().cast("array<struct<context:string,quote:string>>")).alias("external"))
    return rows.join(post_dates(elements, texts, bodies), ["page_id", "post_no"], "left").select("page_id", "post_no", "text", "external", F.to_date("date").alias("date"))


def post_dates(elements: DataFrame, texts: DataFrame, bodies: DataFrame) -> DataFrame:
    """(page_id, post_no, date): of a post's time element, else of an attribute `date`; in the third layout of its text of class date."""
    posts = bodies.select("page_id", F.col("post").alias("o_n"), F.col("post_stop").alias("o_stop"), "post_no", "layout")
    stamp = F.when(F.col("tag") == "time", attribute(F.col("raw"), "datetime"))
    marks = elements.select("page_id", "n", F.when(stamp.isNotNull(), 0).otherwise(1).alias("rank"), F.coalesce(stamp, attribute(F.col("raw"), "date")).alias("stamp")).where("stamp IS NOT NULL")
    first = inside(marks, posts.where("layout < 2")).select(F.col("i.page_id").alias("page_id"), "post_no", "rank", "n", F.left("stamp", F.lit(10)).alias("date"))
    dated = text_in(texts, elements.where(has_class(F.col("raw"), "date"))).select("page_id", F.col("o_n").alias("n"), "text")
    day = F.regexp_replace(F.regexp_extract("text", r"\d{2}\.\d{2}\.\d{4}", 0), r"(\d{2})\.(\d{2})\.(\d{4})", "$3-$2-$1")
    third = inside(dated, posts.where("layout = 2")).select(F.col("i.page_id").alias("page_id"), "post_no", F.lit(0).alias("rank"), "n", day.alias("date"))
    return first.unionByName(third).where("date <> ''").groupBy("page_id", "post_no").agg(F.min_by("date", F.struct("rank", "n")).alias("date"))


def received_messages(posts: DataFrame) -> DataFrame:
    """TXT-30 of posts: (page_id, post_no, message), texts that a post says were received: inserted ones, and quotes of the post's own
    text, that a word for a message comes before. Short or wordless ones are none."""
    n_words = F.size(F.filter(F.split("message", r"\s+"), lambda w: F.rlike(w, F.lit(r"\p{L}{2,}"))))
    clean = lambda c: F.trim(F.regexp_replace(c, r"[ \t\x{a0}]+", " "))
    given = posts.select("page_id", "post_no", F.explode("external").alias("x")).select("page_id", "post_no", "x.context", clean(F.col("x.quote")).alias("message"))
    quote = r"(?ms)(?:^|(?<=[\s(\[:/]))[„“\"»](?=\S)([^„“”\"»«]{15,1500}?)(?<=\S)[“”\"«](?=[\s.,;:!?)\]–-]|$)"
    found = posts.select("page_id", "post_no", "text", F.posexplode(F.regexp_extract_all("text", F.lit(quote), F.lit(1))).alias("k", "raw"), F.split("text", quote, -1).alias("between"), F.regexp_extract_all("text", F.lit(quote), F.lit(0)).alias("whole"))
    before = F.array_join(F.flatten(F.zip_with(F.slice("between", F.lit(1), F.col("k") + 1), F.slice(F.concat(F.array(F.lit("")), "whole"), F.lit(1), F.col("k") + 1), lambda a, b: F.array(b, a))), "")
    written = found.select("page_id", "post_no", F.right(before, F.lit(D.CUE_WINDOW)).alias("context"), clean(F.col("raw")).alias("message"))
    both = given.unionByName(written).where(F.rlike("context", F.lit(D.RECEIVED_CUES)) & F.length("message").between(*D.MESSAGE_CHARS) & (n_words >= D.MESSAGE_WORDS))
    return both.select("page_id", "post_no", "message").distinct()


def review_list(messages: DataFrame, reviewed: DataFrame, redact, signals) -> DataFrame:
    """PAG-05: (key, message, label, suggestion, signals, source): received messages, redacted, one of each key; the suggestion is `ja`
    where a rule fires, else `?`. What a person has labelled before keeps its label, and stays even if it is found no more.

    messages: message, source. reviewed: message, label, and what else is known. `redact` and `signals` are column functions."""
    own = messages.select(redact(F.col("message")).alias("message"), "source").withColumn("key", N.text_key(F.col("message")))
    own = own.groupBy("key").agg(F.min(F.struct("source", "message")).alias("x")).select("key", "x.message", "x.source").withColumn("signals", signals(F.col("message")))
    told = reviewed.where("trim(coalesce(label, '')) <> ''").withColumn("key", N.text_key(F.col("message"))).groupBy("key").agg(F.min(F.struct("label", "message", "source")).alias("r"))
    both = own.join(told, "key", "full")
    suggestion = F.when(F.size("signals") > 0, "ja").when(F.col("signals").isNotNull(), "?")
    return both.select("key", F.coalesce("message", "r.message").alias("message"), F.coalesce("r.label", F.lit("")).alias("label"), suggestion.alias("suggestion"), F.array_join("signals", " ").alias("signals"), F.coalesce("source", "r.source").alias("source"))


# warnings


def warning_quotes(text: Column, least: int = 15, words: int = 2) -> Column:
    """The distinct quotes of a text that have so many characters and words."""
    found = F.transform(F.regexp_extract_all(text, F.lit(D.WARNING_QUOTE), F.lit(1)), lambda q: F.trim(F.regexp_replace(q, r"[ \t\x{a0}]+", " ")))
    return F.array_distinct(F.filter(found, lambda q: (F.length(q) >= least) & (F.size(F.filter(F.split(q, r"\s+"), lambda w: F.rlike(w, F.lit(r"\p{L}{2,}")))) >= words) & ~F.rlike(q, F.lit(D.ONLY_DATE))))


def warnings(pages: DataFrame) -> DataFrame:
    """PAG-06: (page_id, kind, title, date, message): an alert's wording, one row for each dated section of a radar page with its quotes,
    one row for each whole sentence that a news article quotes. pages: page_id, kind (alert, radar, news), html."""
    elements, texts = pieces(pages)
    kinds = pages.select("page_id", "kind")
    titles = text_in(texts, elements.where("tag = 'h1'")).groupBy("page_id").agg(F.min_by("text", "o_n").alias("title"))
    # the last heading is carried forward, so each text has its section
    headings = text_in(texts, elements.where("tag IN ('h2', 'h3', 'strong')"))
    spans = elements.where("tag IN ('h2', 'h3', 'strong')").select("page_id", F.col("n").alias("o_n"), F.col("stop").alias("end"), "tag")
    headings = headings.join(spans, ["page_id", "o_n"]).join(kinds, "page_id").withColumn("text", F.regexp_replace("text", r"\s+", " "))
    starts = ((F.col("kind") == "alert") & (F.col("tag") != "strong") & F.contains("text", F.lit(D.ALERT_HEADING))) | ((F.col("kind") == "radar") & F.rlike("text", F.lit(D.DATED_HEADING)))
    headings = headings.where(starts).select("page_id", F.col("o_n").alias("n"), F.col("text").alias("heading"), "end")
    order = Window.partitionBy("page_id").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    stream = texts.select("page_id", "n", "text").unionByName(headings, allowMissingColumns=True)
    stream = stream.withColumn("x", F.last(F.when(F.col("heading").isNotNull(), F.struct("n", "heading", "end")), ignorenulls=True).over(order))
    sections = stream.where("heading IS NULL AND x IS NOT NULL AND n > x.end").select("page_id", F.col("x.n").alias("section"), F.col("x.heading").alias("heading"), "n", F.trim(F.regexp_replace("text", r"\s+", " ")).alias("text")).where("text <> ''")
    parts = sections.groupBy("page_id", "section", "heading").agg(F.array_sort(F.collect_list(F.struct("n", "text"))).alias("p")).withColumn("p", F.transform("p", lambda x: x["text"])).join(kinds, "page_id")

    first = parts.where("kind = 'alert'").withColumn("k", F.row_number().over(Window.partitionBy("page_id").orderBy("section"))).where("k = 1")
    ends = F.transform("p", lambda t: t.isin(D.ALERT_ENDS) | F.startswith(t, F.lit(D.ALERT_TIPS)))
    upto = F.when(F.array_contains(ends, True), F.array_position(ends, F.lit(True)).cast("int") - 1).otherwise(F.size("p"))
    alerts = first.withColumn("message", F.array_join(F.slice("p", F.lit(1), upto), "\n")).where("length(message) >= 20").select("page_id", "kind", F.lit(None).cast("string").alias("date"), F.lit(None).cast("string").alias("own"), "message")
    radar = parts.where("kind = 'radar'").withColumn("q", warning_quotes(F.array_join("p", " "))).where("size(q) > 0")
    day = F.concat(F.regexp_extract("heading", D.DATED_HEADING, 1), F.lit(". "), F.regexp_extract("heading", D.DATED_HEADING, 2), F.lit(" "), F.regexp_extract("heading", D.DATED_HEADING, 3))
    radar = radar.select("page_id", "kind", day.alias("date"), F.regexp_extract("heading", D.DATED_HEADING, 4).alias("own"), F.array_join("q", "\n").alias("message"))
    whole = kinds.where("kind = 'news'").select("page_id", F.lit(-1).alias("n"), F.lit(2**31 - 1).alias("stop"), F.lit("page").alias("tag"))
    body = elements.where("tag IN ('article', 'main')").join(kinds.where("kind = 'news'"), "page_id").select("page_id", "n", "stop", "tag").unionByName(whole)
    rank = F.when(F.col("tag") == "article", 0).when(F.col("tag") == "main", 1).otherwise(2)
    body = body.groupBy("page_id").agg(F.min(F.struct(rank.alias("rank"), "n", "stop")).alias("b")).select("page_id", "b.n", "b.stop")
    news = inside(texts, outer(body)).groupBy("page_id").agg(joined().alias("text")).select("page_id", F.lit("news").alias("kind"), F.lit(None).cast("string").alias("date"), F.lit(None).cast("string").alias("own"), F.explode(warning_quotes(F.col("text"), 40, 5)).alias("message"))
    every = alerts.unionByName(radar).unionByName(news).join(titles, "page_id", "left")
    message = F.when((F.col("kind") == "alert") & (F.coalesce("title", F.lit("")) != ""), F.concat("title", F.lit("\n"), "message")).otherwise(F.col("message"))
    return every.select("page_id", "kind", F.coalesce("own", "title").alias("title"), "date", message.alias("message"))


# adverts


def advert_fields(pages: DataFrame, today: Column) -> DataFrame:
    """PAG-01: (page_id, title, description, price, category, location, account_age_days, seller_type, n_ads, badges, url) of advert
    pages that mark these by element ids; pages without such ids have no row."""
    elements, texts = pieces(pages)
    ids = elements.withColumn("id", attribute(F.col("raw"), "id"))
    ids = stored(ids.where("id IS NOT NULL").groupBy("page_id", "id").agg(F.min(F.struct("n", "stop")).alias("e")).select("page_id", "id", "e.n", "e.stop"))
    own = inside(texts, named(ids, "o", "id")).select(F.col("i.page_id").alias("page_id"), "n", "text", "id", "o_n", "o_stop")
    # a title's own text lies in no further element
    spans = elements.select("page_id", F.col("n").alias("e_n"), F.col("stop").alias("e_stop")).where("e_stop > e_n")
    nested = own.where("id = 'viewad-title'").alias("t").join(spans.alias("s"), F.expr("t.page_id = s.page_id and s.e_n > t.o_n and s.e_stop < t.o_stop and t.n > s.e_n and t.n < s.e_stop")).select(F.col("t.page_id").alias("page_id"), "n").distinct()
    bare = own.where("id = 'viewad-title'").join(nested, ["page_id", "n"], "left_anti").groupBy("page_id").agg(F.trim(F.regexp_replace(joined(), r"\s+", " ")).alias("bare"))
    flat = own.groupBy("page_id", "id").agg(joined().alias("raw"), F.transform(F.array_sort(F.collect_list(F.struct("n", "text"))), lambda x: F.trim(F.regexp_replace(x["text"], r"\s+", " "))).alias("strings"))
    line = F.trim(F.regexp_replace("raw", r"\s+", " "))
    wanted = {"viewad-title": "title", "viewad-price": "price", "viewad-locality": "place", "viewad-contact": "contact"}
    fields = flat.groupBy("page_id").agg(
        *[F.max(F.when(F.col("id") == i, line)).alias(n) for i, n in wanted.items()],
        F.max(F.when(F.col("id") == "viewad-description-text", F.array_join(F.filter(F.transform(F.split("raw", "\n"), lambda x: F.trim(F.regexp_replace(x, r"[ \t\x{a0}]+", " "))), lambda x: x != ""), "\n"))).alias("description"),
        F.max(F.when(F.col("id") == "viewad-profile-box", F.col("strings"))).alias("profile"),
        F.max(F.when(F.col("id") == "viewad-contact", F.col("strings"))).alias("contact_strings"),
    )
    shop = ids.where("id IN ('viewad-imprint-section', 'viewad-bizteaser')").select("page_id").distinct().withColumn("shop", F.lit(True))
    crumb = (attribute(F.col("raw"), "itemprop") == "name") | has_class(F.col("raw"), "breadcrump-link")
    crumbs = inside(elements.where(crumb).select("page_id", "n", "stop"), outer(ids.where("id = 'vap-brdcrmb'"))).select(F.col("i.page_id").alias("page_id"), "n", "stop")
    crumbs = text_in(texts, crumbs).groupBy("page_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("o_n", "text"))), lambda x: x["text"]), " > ").alias("crumbs"))
    link = F.when((F.col("tag") == "link") & (attribute(F.col("raw"), "rel") == "canonical"), F.struct(F.lit(0).alias("k"), F.col("n"), attribute(F.col("raw"), "href").alias("url"))).when((F.col("tag") == "meta") & (attribute(F.col("raw"), "property") == "og:url"), F.struct(F.lit(1).alias("k"), F.col("n"), attribute(F.col("raw"), "content").alias("url")))
    urls = elements.select("page_id", link.alias("l")).where("l IS NOT NULL").groupBy("page_id").agg(F.min("l")["url"].alias("url")).where("url LIKE '%/s-anzeige/%'")
    found = fields.where("title IS NOT NULL OR description IS NOT NULL").join(bare, "page_id", "left").join(crumbs, "page_id", "left").join(shop, "page_id", "left").join(urls, "page_id", "left")
    seller = F.filter(F.coalesce("profile", "contact_strings", F.array().cast("array<string>")), lambda x: x != "")
    kind = F.try_element_at(F.filter(F.transform(seller, N.seller_type), lambda x: x.isNotNull()), F.lit(1))
    badges = F.array_distinct(F.filter(F.transform(F.filter(seller, lambda x: F.length(x) < 40), N.badge_key), lambda x: x.isNotNull()))
    count = F.filter(F.transform(seller, lambda x, i: F.when(F.contains(F.lower(x), F.lit("anzeigen")) | F.startswith(F.lower(F.coalesce(F.try_element_at(seller, i + 2), F.lit(""))), F.lit("anzeigen")), F.regexp_extract(x, r"^(\d+)", 1))), lambda x: x.isNotNull() & (x != ""))
    title = F.when(F.coalesce("bare", F.lit("")) != "", F.col("bare")).otherwise(F.trim(F.regexp_replace("title", D.ROW_BADGES, "")))
    return found.select(
        "page_id", title.alias("title"), "description", N.parse_price(F.col("price")).alias("price"), N.normalize_category(F.coalesce("crumbs", title)).alias("category"),
        F.col("place").alias("location"), N.account_age(F.regexp_extract("contact", D.ROW_AGE, 0), today).alias("account_age_days"),
        F.when(F.col("shop"), "gewerblich").otherwise(kind).alias("seller_type"), F.try_element_at(count, F.lit(1)).cast("int").alias("n_ads"), badges.alias("badges"), "url",
    )
