"""The listings that queries work on: `documents` with the other fields of a listing derived from its columns.

The derivation is one SQL text that Spark and the oracle both understand, so each query differs from its oracle only in
the operator it shows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

EXTRAS = [
    "Bitte zahlen Sie per PayPal Freunde und Familie.",
    "Schreib mir per WhatsApp unter +44 7700 900123.",
    "Klicke auf den Link https://paypa1-kaufschutz.xyz/pay?id=7 und bestätige.",
    "Mail an kleinanzeigen-support@example.com oder bit.ly/3abc, danke.",
    "IBAN DE89 3704 0044 0532 0130 00, nur Vorkasse.",
    "Tel. 0151 23456789, die Handy und das Kamera wie neu.",
    "Siehe http://192.168.10.5/login und www.ebay.de.sicher-kasse.top!",
    "Das Paket konnte nicht zugestellt werden: https://xn--dhl-paket-q2a.com/zoll",
    "NUR HEUTE!! fuer Selbstabholer, moechte, koennen, zurueck!!",
    "Schick mir bitte den Code. Viele Interessenten, nur heute.",
    "Kontakt: max.muster@gmail.com, Homepage www.amazon.de und shop.example.co.uk",
    "Ruf an: +49 151 1234567 oder 0044 20 7946 0958",
]

_CASES = " ".join(f"WHEN {i} THEN '{e}'" for i, e in enumerate(EXTRAS))
LISTINGS = f"""
SELECT doc_id, source, lang, text,
  CASE CAST(doc_id % 9 AS INT) WHEN 0 THEN 'iPhone 15 Pro wie neu' WHEN 1 THEN 'PS5 Controller' WHEN 2 THEN 'Waschmaschine von Bosch' WHEN 3 THEN 'Suche Thermomix'
    WHEN 4 THEN '' WHEN 5 THEN 'Golf Diesel, TÜV neu' ELSE substring(text, 1, 40) END AS title,
  text || ' ' || CASE CAST(doc_id % 15 AS INT) {_CASES} ELSE '' END AS description,
  CASE CAST(doc_id % 6 AS INT) WHEN 0 THEN CAST(doc_id % 900 + 1 AS STRING) || ' €' WHEN 1 THEN '1.' || substring(CAST(1000 + doc_id % 1000 AS STRING), 2, 3) || ',50 €'
    WHEN 2 THEN CAST(doc_id % 500 AS STRING) || ' VB' WHEN 3 THEN 'Zu verschenken' WHEN 4 THEN 'VB' END AS price_raw,
  CASE CAST(doc_id % 11 AS INT) WHEN 0 THEN 'Kleinanzeigen Mannheim > Elektronik > Haushaltsgeräte' WHEN 1 THEN 'Auto, Rad & Boot › Fahrräder' WHEN 2 THEN 'Möbel'
    WHEN 3 THEN 'Dienstleistungen > Auto, Rad & Boot' WHEN 4 THEN 'Haustiere | Hunde' WHEN 5 THEN 'Wohnung mieten' WHEN 6 THEN 'elektronik' WHEN 7 THEN 'Eintrittskarten & Tickets > Konzerte'
    WHEN 8 THEN ' > ' WHEN 9 THEN 'Mode & Beauty » Schuhe' END AS category_raw,
  CASE CAST(doc_id % 4 AS INT) WHEN 0 THEN ' Privater Nutzer' WHEN 1 THEN 'Gewerblicher Anbieter' WHEN 2 THEN 'Unbekannt' END AS type_raw,
  CASE CAST(doc_id % 8 AS INT) WHEN 0 THEN 'TOP  Zufriedenheit' WHEN 1 THEN 'Na ja Zufriedenheit' WHEN 2 THEN 'Besonders zuverlässig' WHEN 3 THEN 'sehr_freundlich' WHEN 4 THEN 'OK Zufriedenheit'
    WHEN 5 THEN 'Freundlich' WHEN 6 THEN 'Weltklasse' END AS badge_raw,
  CASE CAST(doc_id % 10 AS INT) WHEN 0 THEN 'ja' WHEN 1 THEN ' Betrug ' WHEN 2 THEN 'seriös' WHEN 3 THEN 'kein_betrug' WHEN 4 THEN '1' WHEN 5 THEN '0' WHEN 6 THEN 'TRUE' WHEN 7 THEN 'weiß nicht' WHEN 8 THEN 'ham' END AS label_raw,
  CASE WHEN doc_id % 5 > 0 THEN 'Aktiv seit ' || substring(CAST(101 + doc_id % 28 AS STRING), 2, 2) || '.' || substring(CAST(101 + doc_id % 12 AS STRING), 2, 2) || '.' || CAST(2019 + doc_id % 7 AS STRING) END AS since_raw,
  CASE WHEN doc_id % 5 > 0 THEN CAST((doc_id * 7) % 800 AS INT) END AS age,
  CASE WHEN doc_id % 3 > 0 THEN CAST(doc_id % 4 AS INT) END AS ratings,
  CASE WHEN doc_id % 6 > 0 THEN CAST(doc_id % 40 AS INT) END AS ads,
  CASE WHEN doc_id % 13 = 0 THEN 'GmbH' END AS legal_form
FROM documents"""

CHATS = """
SELECT conv_id, list_messages AS messages FROM (SELECT conv_id, {agg} AS list_messages FROM conversations GROUP BY conv_id)"""


def tables(spark: SparkSession, sf_dir: str, *names: str) -> list[DataFrame]:
    return [spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in names]


def listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    (documents,) = tables(spark, sf_dir, "documents")
    return spark.sql(LISTINGS.replace("FROM documents", "FROM {documents}"), documents=documents)


def cte(body: str, *more: tuple[str, str]) -> str:
    """An oracle query over `listings` and further named parts."""
    parts = [("listings", LISTINGS), *more]
    return "WITH " + ", ".join(f"{n} AS ({q})" for n, q in parts) + " " + body


def quoted(words: list[str]) -> str:
    return ", ".join(f"'{w}'" for w in words)
