"""Pages and chats as collected sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import contact as C
from ..functions import redact as R
from ..functions import wording as W
from ..operators import annotation as A
from ..operators import hosts as H
from ..operators import layout as LO
from ..operators import markup as K
from ..operators import pages as P
from .base import cte, listings, tables


def pag01_ad_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.ad_fields(*tables(spark, sf_dir, "pages")).drop("url")


def pag02_row_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields out of the rows that the page of a listing would show."""
    rows = F.array(F.lit("1/12"), F.col("category_raw"), F.concat(F.lit("TOP • "), "title"), F.col("price_raw"), F.lit("68159 Mannheim"), F.lit("Max M."), F.col("type_raw"), F.lit("Beschreibung"), F.regexp_replace("description", r"\s+", " "), F.lit("Anzeige melden"), F.lit("Ähnliche Anzeigen"), F.lit("Noch ein Inserat"))
    found = listings(spark, sf_dir).select("doc_id", P.row_fields(F.filter(rows, lambda r: r.isNotNull()), F.lit("2026-01-01").cast("date")).alias("x"))
    return found.select("doc_id", "x.title", "x.price", "x.category", "x.location", "x.seller_type", F.sha1("x.description").alias("description_sha1"))


def red09_anonymised(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = A.anonymised(listings(spark, sf_dir).withColumn("location", F.lit("Mannheim")))
    return found.select("doc_id", "task", "source", "location", F.sha1("description").alias("description_sha1"))


def pag04_posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.posts(*tables(spark, sf_dir, "pages")).select("page_id", "post_no", F.sha1("text").alias("sha1"))


def pag07_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.links(*tables(spark, sf_dir, "pages")).groupBy("link").agg(F.count("*").alias("n"))


def pag08_image_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    (pages,) = tables(spark, sf_dir, "pages")
    host = F.regexp_extract("url", "^https?://([^/]+)", 1)
    json = F.to_json(F.struct(F.concat(F.lit("https://"), F.when(F.col("page_id") % 2 == 0, "i.example.org").otherwise(host), F.lit("/"), F.col("page_id")).alias("url"), F.array(F.lit("https://p.example.org/g.jpg")).alias("gallery")))
    return P.image_urls(pages.select("page_id", json.alias("json")), "page_id", ["i.example.org", "p.example.org"])


def txt30_received_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    (chats,) = tables(spark, sf_dir, "conversations")
    text = F.concat(F.lit("Dann kam diese Nachricht: „"), F.regexp_replace("text", '[„“”"]', ""), F.lit("“"))
    found = P.received_messages(chats.select("conv_id", "turn", text.alias("text")).withColumn("key", F.struct("conv_id", "turn")), "key")
    return found.select("key.conv_id", "key.turn", F.sha1("quote").alias("sha1"))


def pag10_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    (events,) = tables(spark, sf_dir, "events")
    lines = events.select((F.col("user_id")).alias("image"), F.col("event_type").alias("text"), F.col("event_id").alias("top"), F.lit(20).alias("height"))
    return P.without_overlap(lines).groupBy("image").agg(F.count("*").alias("n"))


def pag09_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    (events,) = tables(spark, sf_dir, "events")
    lines = events.select(F.col("user_id").alias("image"), F.col("event_type").alias("text"), (F.col("event_id") * 3).alias("top"), F.col("event_id").alias("left"), F.lit(100).alias("height"))
    return P.rows_of_boxes(lines).groupBy("image").agg(F.count("*").alias("n"))


def win12_pag03_merged_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    (chats,) = tables(spark, sf_dir, "conversations")
    files = chats.select(F.col("conv_id").alias("item"), F.col("turn").alias("file"), F.when(F.col("turn") % 2 == 1, F.col("role")).alias("title"), F.when(F.col("turn") % 2 == 0, F.col("text")).alias("message"))
    return P.merged_files(files).select("item", "title", F.size("messages").alias("n_messages"))


# Thread pages, warning pages and advert pages that hold the texts of the tables, in the marks of real ones.
_ESCAPED = "replace(replace(replace({}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')"
_THREADS = f"""
SELECT conv_id AS page_id, concat('<html><h1 class="p-title-value">x</h1>', array_join(transform(array_sort(collect_list(struct(turn, post))), p -> p.post), '\n'), '</html>') AS html
FROM (SELECT conv_id, turn, CASE conv_id % 3
    WHEN 0 THEN concat('<article class="message"><time datetime="2026-01-05T10:00"></time><div class="bbWrapper"><blockquote class="bbCodeBlock bbCodeBlock--quote" data-quote="Z"><div>', before, '</div></blockquote>Dann kam diese Nachricht:<br><blockquote class="bbCodeBlock--quote"><div class="bbCodeBlock-content">', body, '</div></blockquote></div></article>')
    WHEN 1 THEN concat('<article class="wbbPost"><i date="2026-01-05"></i><div class="messageText"><blockquote class="quoteBox"><div class="quoteBoxTitle">Zitat von Z</div>', before, '</blockquote><p>Dann kam diese Nachricht:</p><br><div class="codeBox"><pre>', body, '</pre></div></div></article>')
    ELSE concat('<div class="post"><span class="date">05.01.2026</span><div class="posttext">', body, '</div></div>') END AS post
  FROM (SELECT conv_id, turn, {_ESCAPED.format('text')} AS body, {_ESCAPED.format("coalesce(lag(text) OVER (PARTITION BY conv_id ORDER BY turn), '')")} AS before FROM {{conversations}}))
GROUP BY conv_id"""


def _threads(spark: SparkSession, sf_dir: str) -> DataFrame:
    (chats,) = tables(spark, sf_dir, "conversations")
    return K.thread_posts(spark.sql(_THREADS, conversations=chats))


def pag04_thread_posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The conversations as thread pages of three layouts, each post quoting the one before and inserting the turn's text."""
    found = _threads(spark, sf_dir)
    return found.select("page_id", "post_no", F.sha1("text").alias("text_sha1"), F.sha1(F.array_join(F.transform("external", lambda x: F.concat(x["context"], F.lit("|"), x["quote"])), "|")).alias("external_sha1"), F.col("date").cast("string").alias("date"))


def pag05_review_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The messages received in these threads as a review list; turns of a whole multiple of seven characters were reviewed before."""
    (chats,) = tables(spark, sf_dir, "conversations")
    messages = K.received_messages(_threads(spark, sf_dir)).select("message", F.concat_ws("/", "page_id", "post_no").alias("source"))
    reviewed = chats.where("length(text) % 7 = 0").select(R.redact(F.col("text")).alias("message"), F.when(F.col("role") == "user", "ja").otherwise("nein").alias("label"), F.lit("before").alias("source"))
    return K.review_list(messages, reviewed, R.redact, lambda m: F.transform(W.lexicon_signals(m), lambda s: s["code"]))


_QUOTABLE = r"""trim(regexp_replace(text, '[„“”«»"\\s]+', ' '))"""
_RADAR = f"""
SELECT conv_id AS page_id, 'radar' AS kind, concat('<h1>Radar</h1>', array_join(transform(array_sort(collect_list(struct(turn, part))), p -> p.part), '\n')) AS html
FROM (SELECT conv_id, turn, concat('<h2>', turn + 1, '. März 2026: Fall ', turn, '</h2><p>Im Umlauf ist „', {_ESCAPED.format(_QUOTABLE)}, '“, sagt man.</p>') AS part FROM {{conversations}})
GROUP BY conv_id"""


def pag06_warnings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The conversations as pages of dated sections, a turn in each."""
    (chats,) = tables(spark, sf_dir, "conversations")
    found = K.warnings(spark.sql(_RADAR, conversations=chats))
    return found.select("page_id", "title", "date", F.sha1("message").alias("message_sha1"))


_ADVERTS = f"""
SELECT doc_id AS page_id, concat('<head><link rel="canonical" href="https://x.test/s-anzeige/', doc_id, '"></head><h1 id="viewad-title"><i>Reserviert</i>', {_ESCAPED.format('title')}, '</h1><div id="vap-brdcrmb"><span itemprop="name">', {_ESCAPED.format("coalesce(category_raw, '')")},
  '</span></div><h2 id="viewad-price">', coalesce(price_raw, ''), '</h2><span id="viewad-locality">', source, '</span><p id="viewad-description-text">', regexp_replace({_ESCAPED.format('description')}, '[.] ', '.<br>'), '</p><div id="viewad-contact"><div id="viewad-profile-box"><b>', coalesce(type_raw, ''), '</b><b>', coalesce(CAST(ads AS STRING), ''), '</b><b>Anzeigen</b></div></div>') AS html
FROM {{listings}}"""


def pag01_advert_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The listings as advert pages, read again."""
    found = K.advert_fields(spark.sql(_ADVERTS, listings=listings(spark, sf_dir)), F.lit("2026-01-01").cast("date"))
    return found.select("page_id", "title", F.sha1("description").alias("description_sha1"), F.col("location"), "n_ads", "url")


def _boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events of a user as lines of a page: the kind of event and its value say where a line stands and how wide it is."""
    return spark.sql("""SELECT user_id AS image, event_type AS text, CAST(event_id AS DOUBLE) AS top, left, left + 40 + abs(value) * 3 AS right, 20D AS height, 1000D AS width
      FROM (SELECT *, CASE event_type WHEN 'click' THEN 620D WHEN 'purchase' THEN 600D WHEN 'view' THEN 20D ELSE 40D END + event_id % 3 AS left FROM {events})""", events=tables(spark, sf_dir, "events")[0])


def pag09_side_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return LO.side_columns(_boxes(spark, sf_dir))


def pag09_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    return LO.layout_rows(_boxes(spark, sf_dir))


def txt04_public_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The hosts of all listings' links, parted by the rules."""
    found = listings(spark, sf_dir).select(F.explode(F.transform(C.urls(F.col("description")), C.host_of)).alias("host"))
    return H.parted_hosts(found, H.default_rules(spark))


QUERIES = {f.__name__: f for f in (pag02_row_fields, red09_anonymised, pag01_ad_fields, pag04_posts, pag01_advert_page, pag09_side_columns, pag09_layout, txt04_public_suffixes, pag04_thread_posts, pag05_review_list, pag06_warnings, pag07_links, pag08_image_urls, txt30_received_messages, pag10_overlap, pag09_rows, win12_pag03_merged_files)}
_P = r"list_transform(regexp_extract_all(html, '(?s)<{0}\b[^>]*>(.*?)</{0}>', 1), lambda x: trim(regexp_replace(regexp_replace(x, '<[^>]*>', ' ', 'g'), '\s+', ' ', 'g')))"
_LINES = "regexp_replace(regexp_replace(regexp_replace(regexp_replace({}, '[ \\t\\x{{00a0}}]+', ' ', 'g'), ' ?\\r?\\n ?', chr(10), 'g'), '\\n{{3,}}', chr(10) || chr(10), 'g'), '^\\s+|\\s+$', '', 'g')"
_BOXES = """b AS (SELECT user_id AS image, l, l + 40 + abs(value) * 3 AS r FROM (SELECT *, (CASE event_type WHEN 'click' THEN 620 WHEN 'purchase' THEN 600 WHEN 'view' THEN 20 ELSE 40 END + event_id % 3)::DOUBLE AS l FROM events)),
  c AS (SELECT DISTINCT image, l AS s FROM b WHERE l BETWEEN 450 AND 850), k AS (SELECT c.image, s, count(*) FILTER (l + 10 < s) AS main, count(*) AS n, count(*) FILTER (l + 10 < s AND r - 10 > s) AS crossing FROM c JOIN b ON b.image = c.image GROUP BY ALL)"""
ORACLE_SQL = {
    "pag09_side_columns": f"WITH {_BOXES} SELECT image, max(s) - 10 AS start FROM k WHERE main >= 5 AND n - main >= 5 AND crossing <= 2 GROUP BY image",
    "pag04_thread_posts": f"""SELECT conv_id AS page_id, (row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1)::INT AS post_no, '2026-01-05' AS date,
      sha1(CASE WHEN conv_id % 3 = 2 THEN t ELSE 'Dann kam diese Nachricht:' || chr(10) || chr(10) || '„' || t || '“' END) AS text_sha1, sha1(CASE WHEN conv_id % 3 = 2 THEN '' ELSE 'Dann kam diese Nachricht:|' || t END) AS external_sha1
      FROM (SELECT *, {_LINES.format("text")} AS t FROM conversations)""",
    "pag06_warnings": """SELECT conv_id AS page_id, 'Fall ' || turn AS title, (turn + 1) || '. März 2026' AS date, sha1(q) AS message_sha1
      FROM (SELECT *, trim(regexp_replace(text, '[„“”«»"\\s]+', ' ', 'g')) AS q FROM conversations) WHERE length(q) BETWEEN 15 AND 600 AND len(list_filter(string_split(q, ' '), lambda w: regexp_matches(w, '\\p{L}{2,}'))) >= 2""",
    "pag01_advert_page": cte("""SELECT doc_id AS page_id, CASE WHEN t = '' THEN '' ELSE t END AS title, source AS location, ads AS n_ads, 'https://x.test/s-anzeige/' || doc_id AS url,
      sha1(array_to_string(list_filter(list_transform(string_split(regexp_replace(description, '[.] ', '.' || chr(10), 'g'), chr(10)), lambda x: trim(regexp_replace(x, '[ \\t]+', ' ', 'g'))), lambda x: x <> ''), chr(10))) AS description_sha1
      FROM (SELECT *, trim(regexp_replace(title, '\\s+', ' ', 'g')) AS t FROM listings)"""),
    "pag01_ad_fields": f"""SELECT page_id, ({_P.format('h1')})[1] AS title, len({_P.format('p')})::INT AS n_lines, regexp_extract(html, '<html lang="([a-z]+)"', 1) AS lang, array_to_string(regexp_extract_all(html, '<a href="/([^"]*)"', 1), ' > ') AS breadcrumb FROM pages""",
    "pag04_posts": f"SELECT page_id, (i - 1)::INT AS post_no, sha1(t) AS sha1 FROM (SELECT page_id, unnest({_P.format('p')}) AS t, generate_subscripts({_P.format('p')}, 1) AS i FROM pages) WHERE t <> ''",
    "pag07_links": """SELECT link, count(*) AS n FROM (SELECT unnest(regexp_extract_all(html, 'href="([^"]+)"', 1)) AS link FROM pages) GROUP BY link""",
    "pag08_image_urls": "SELECT page_id, 'https://p.example.org/g.jpg' AS url FROM pages UNION ALL SELECT page_id, 'https://i.example.org/' || page_id FROM pages WHERE page_id % 2 = 0",
    "pag10_overlap": "SELECT image, count(*) AS n FROM (SELECT user_id AS image, event_id - lag(event_id) OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS gap FROM events) WHERE gap IS NULL OR gap >= 20 GROUP BY image",
    "pag09_rows": "SELECT image, sum(CASE WHEN gap IS NULL OR gap > 50 THEN 1 ELSE 0 END)::BIGINT AS n FROM (SELECT user_id AS image, event_id * 3 - lag(event_id * 3) OVER (PARTITION BY user_id ORDER BY event_id) AS gap FROM events) GROUP BY image",
    "win12_pag03_merged_files": "SELECT conv_id AS item, arg_min(role, turn) FILTER (turn % 2 = 1) AS title, (count(*) FILTER (turn % 2 = 0))::INT AS n_messages FROM conversations GROUP BY conv_id",
}
