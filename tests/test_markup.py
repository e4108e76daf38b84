"""Pages as tables of elements and texts: against a plain stack, and fixtures of each page kind."""

import datetime
import random
import re

import pytest
from pyspark.sql import functions as F

from adsentry.operators import markup as K
from adsentry.operators import pages as P


def page(spark, *html, **more):
    return spark.createDataFrame([(i, h, *[v[i] for v in more.values()]) for i, h in enumerate(html)], ", ".join(["page_id long, html string", *[f"{k} string" for k in more]]))


def plain_elements(html):
    """[(tag, number of its tag, number of the tag that closes it)] by a stack for each tag name."""
    html = re.sub(K.SKIPPED, " ", html)
    out, stacks = [], {}
    for n, raw in enumerate(re.findall(K.PIECE, html)):
        m = re.match("</?([a-zA-Z][a-zA-Z0-9:-]*)", raw)
        if not m:
            continue
        tag = m[1].lower()
        if raw.startswith("</"):
            if stacks.get(tag):
                out.append((tag, stacks[tag].pop(), n))
        elif tag in K.VOID or raw.endswith("/>"):
            out.append((tag, n, n))
        else:
            stacks.setdefault(tag, []).append(n)
    return sorted(out + [(t, n, 2**31 - 1) for t, ns in stacks.items() for n in ns])


def test_tags_are_matched_as_by_a_stack(spark):
    rng = random.Random(4)
    bits = ["<div>", "</div>", "<DIV class='a'>", "<p>", "</p>", "text & more", "<br>", "<br/>", "<img src=x>", "<b>", "</b>", "a < b", "<!-- <div> -->", "<script>if (a<b) '</p>'</script>", "</div >", "<x-y id=1>", "</x-y>"]
    html = ["", None] + ["".join(rng.choice(bits) for _ in range(rng.randrange(60))) for _ in range(60)]
    elements, texts = K.pieces(page(spark, *html))
    got = {}
    for r in elements.collect():
        got.setdefault(r.page_id, []).append((r.tag, r.n, r.stop))
    for i, h in enumerate(html):
        want = plain_elements(h or "")
        assert sorted(got.get(i, [])) == want, h
    assert texts.where("page_id < 2").count() == 0


def test_attributes(spark):
    tags = {"<a href='x y' class=\"b  c\">": ("x y", True), "<a HREF=z data-href=q>": ("z", False), "<a data-href=q>": (None, False), "<a href>": ("", False), "<a class=c href=\"?a=1&amp;b=2\"/>": ("?a=1&b=2", True)}
    frame = spark.createDataFrame([(t,) for t in tags], "t string")
    got = {r.t: (r.h, r.c) for r in frame.select("t", K.attribute(F.col("t"), "href").alias("h"), K.has_class(F.col("t"), "c").alias("c")).collect()}
    assert got == tags


FIRST = """<html><body><h1 class="p-title-value">Ist das   echt?</h1>
<article class="message js-x"><time datetime="2026-03-04T10:00:00+0100"></time><div class="message-body"><div class="bbWrapper">Vorhin kam diese Mail:<br>
<blockquote class="bbCodeBlock bbCodeBlock--quote"><div class="bbCodeBlock-content">Guten Tag, senden Sie mir <b>Ihre</b> Nummer, dann zahle ich sofort
<blockquote class="bbCodeBlock bbCodeBlock--quote" data-quote="Y">innen</blockquote></div><div class="bbCodeBlock-expandLink">mehr</div></blockquote>
Was meint ihr?<script>var x = "<div>";</script></div></div></article>
<article class="message"><time datetime="2026-03-05"></time><div class="bbWrapper"><blockquote class="bbCodeBlock--quote" data-quote="Otto">
<div class="bbCodeBlock-title">Otto schrieb:</div><div class="bbCodeBlock-content">Vorhin kam diese Mail</div></blockquote>Finger weg &amp; melden!</div></article>
<article class="message"><p>ohne Rumpf</p></article>
<div class="bbCodeBlock--code"><pre>außerhalb</pre></div></body></html>"""
SECOND = """<h1>Versuche</h1><article class="wbbPost"><x-date date="2025-12-24T08:00:00"></x-date><div class="messageText">
<blockquote class="quoteBox" cite="https://forum.test/p/1"><div class="quoteBoxContent">fremd</div></blockquote>
<blockquote class="quoteBox"><div class="quoteBoxTitle">Zitat von Z</div><div class="quoteBoxContent">auch fremd</div></blockquote>
<p>Er schrieb mir: "Schick mir deine Handynummer damit ich zahlen kann" und weg.</p>
<div class="codeBox"><pre>Ihr Paket kommt nicht an, bitte jetzt Gebühr zahlen</pre></div></div></article>"""
THIRD = """<div id="navbar">Forum &gt; Hilfe &gt; Alte Fälle</div><div class="post"><div class="posttop"><span class="date">03.11.2019, 12:00</span></div>
<div class="posttext">Erster<br /><br /><br />Text</div></div><div class="post"><div class="posttext">Zweiter</div></div>"""


def test_threads_of_three_layouts(spark):
    pages = page(spark, FIRST, SECOND, THIRD, "<article class='message'>kein Rumpf</article>", None)
    posts = K.thread_posts(pages)
    got = {(r.page_id, r.post_no): r for r in posts.collect()}
    assert sorted(got) == [(0, 0), (0, 1), (1, 0), (2, 0), (2, 1)]
    quoted = "Guten Tag, senden Sie mir Ihre Nummer, dann zahle ich sofort\ninnen"
    assert got[0, 0].text == f"Vorhin kam diese Mail:\n\n„{quoted}“\n\nWas meint ihr?"
    assert [tuple(x) for x in got[0, 0].external] == [("Vorhin kam diese Mail:", quoted)]
    assert (got[0, 1].text, got[0, 1].external) == ("Finger weg & melden!", [])
    assert got[1, 0].text.startswith('Er schrieb mir: "Schick mir')
    assert [x.quote for x in got[1, 0].external] == ["Ihr Paket kommt nicht an, bitte jetzt Gebühr zahlen"]
    assert "fremd" not in got[1, 0].text and "Zitat" not in got[1, 0].text
    assert (got[2, 0].text, got[2, 1].text) == ("Erster\n\nText", "Zweiter")
    assert [got[k].date for k in sorted(got)] == [datetime.date(2026, 3, 4), datetime.date(2026, 3, 5), datetime.date(2025, 12, 24), datetime.date(2019, 11, 3), None]
    messages = {tuple(r) for r in K.received_messages(posts).collect()}
    assert messages == {
        (0, 0, "Guten Tag, senden Sie mir Ihre Nummer, dann zahle ich sofort\ninnen"),
        (1, 0, "Schick mir deine Handynummer damit ich zahlen kann"),
        (1, 0, "Ihr Paket kommt nicht an, bitte jetzt Gebühr zahlen"),
    }


def test_review_list_keeps_labels(spark):
    messages = spark.createDataFrame([("Zahl per Vorkasse!", "a"), ("zahl PER vorkasse", "b"), ("Guten Tag allerseits", "c")], "message string, source string")
    reviewed = spark.createDataFrame([("Zahl per: Vorkasse", "ja", "alt"), ("früher gefunden", "nein", "alt"), ("unbeurteilt", " ", "alt")], "message string, label string, source string")
    signals = lambda m: F.when(F.contains(F.lower(m), F.lit("vorkasse")), F.array(F.lit("V"))).otherwise(F.array().cast("array<string>"))
    got = {r.message: (r.label, r.suggestion, r.signals) for r in K.review_list(messages, reviewed, lambda m: F.regexp_replace(m, "Tag", "[T]"), signals).collect()}
    assert got == {"Zahl per Vorkasse!": ("ja", "ja", "V"), "Guten [T] allerseits": ("", "?", ""), "früher gefunden": ("nein", None, None)}


ALERT = """<h1>Gefälschte Nachricht</h1><h2>Anderes</h2><p>nicht das</p><h3>Warnung vor dieser Nachricht</h3><p>Ihr Konto <b>ist</b> gesperrt.</p>
<p>Klicken Sie hier</p><h3>Tipp</h3><p>nie klicken</p>"""
RADAR = """<h1>Radar</h1><h2>3. März 2026: Bankenwelle</h2><p>Im Betreff „Ihr Konto wird gesperrt“ und "12.03.2026" sowie „kurz“.</p><strong>Hinweis</strong>
<p>Weiter »Bestätigen Sie Ihre Daten sofort« im Text</p><h2>1. März 2026</h2><p>ohne Zitat</p><h3>28. Februar 2026 Paketdienst</h3><p>„Ihr Paket liegt bereit“</p>"""
NEWS = """<h1>Neue Masche</h1><p>„Dieses Zitat steht nicht im Artikel, also zählt es auch nicht mit“</p>
<article><p>Die Täter schreiben „Bitte überweisen Sie den Betrag noch heute auf dieses Konto“ oder „kurzer Satz hier“.</p></article>"""


def test_warnings(spark):
    got = [tuple(r) for r in K.warnings(page(spark, ALERT, RADAR, NEWS, "<h1>leer</h1>", kind=["alert", "radar", "news", "alert"])).select("page_id", "title", "date", "message").collect()]
    assert sorted(got, key=str) == sorted(
        [
            (0, "Gefälschte Nachricht", None, "Gefälschte Nachricht\nIhr Konto\nist\ngesperrt.\nKlicken Sie hier"),
            (1, "Bankenwelle", "3. März 2026", "Ihr Konto wird gesperrt\nBestätigen Sie Ihre Daten sofort"),
            (1, "Paketdienst", "28. Februar 2026", "Ihr Paket liegt bereit"),
            (2, "Neue Masche", None, "Bitte überweisen Sie den Betrag noch heute auf dieses Konto"),
        ],
        key=str,
    )


ADVERT = """<head><link rel="canonical" href="https://x.test/s-anzeige/rad/1"></head><h1 id="viewad-title"><span>Reserviert</span> Rad  neu &amp; gut</h1>
<div id="vap-brdcrmb"><a itemprop="itemListElement"><span itemprop="name">Kleinanzeigen</span></a><a><span itemprop="name">Auto, Rad & Boot</span></a><a><span itemprop="name">Reifen</span></a></div>
<h2 id="viewad-price">1.200 € VB</h2><span id="viewad-locality">68159 Mannheim</span><p id="viewad-description-text"> Zeile eins<br>Zeile <b>zwei</b><br><br> drei </p>
<div id="viewad-contact"><div id="viewad-profile-box"><span>Max</span><span>Privater Nutzer</span><span>TOP Zufriedenheit</span><b>12</b><span>Anzeigen online</span></div>Aktiv seit 01.02.2024</div>"""


def test_advert_fields(spark):
    shop = '<div id="viewad-title">TOP • Nur Titel</div><div id="viewad-bizteaser"></div><meta property="og:url" content="https://x.test/andere/2">'
    got = {r.page_id: r for r in K.advert_fields(page(spark, ADVERT, shop, "<h1>keine Anzeige</h1>"), F.lit("2026-02-01").cast("date")).collect()}
    assert sorted(got) == [0, 1]
    r = got[0]
    assert (r.title, r.description, r.price, r.location, r.url) == ("Rad neu & gut", "Zeile eins\nZeile zwei\ndrei", 1200.0, "68159 Mannheim", "https://x.test/s-anzeige/rad/1")
    assert (r.account_age_days, r.seller_type, r.n_ads, r.category) == (731, "privat", 12, "auto")
    assert len(r.badges) == 1
    assert (got[1].title, got[1].seller_type, got[1].url, got[1].description) == ("TOP • Nur Titel", "gewerblich", None, None)
