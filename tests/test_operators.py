"""Golden values and properties of the operators."""

import random

import pytest
from pyspark.sql import functions as F

from adsentry.functions import contact as C
from adsentry.functions import normalize as N
from adsentry.functions import offer as O
from adsentry.functions import redact as R
from adsentry.functions import signals as S
from adsentry.functions import wording as W
from adsentry.operators import annotation as A
from adsentry.operators import dataset as T
from adsentry.operators import mining as M
from adsentry.operators import models as ML
from adsentry.operators import pages as P
from adsentry.operators import scoring as C2
from adsentry.sources import readers, versions, writers
from adsentry.streaming import live


def values(spark, expression, rows):
    """The expression's value for each text."""
    df = spark.createDataFrame(list(enumerate(rows)), "i int, x string")
    return [r.v for r in df.select("i", expression.alias("v")).orderBy("i").collect()]


def x_():
    return F.col("x")


def test_prices(spark):
    assert values(spark, N.parse_price(x_()), ["1.200 €", "1.200,50", "350 VB", "zu verschenken", "VB", None, "99"]) == [1200.0, 1200.5, 350.0, 0.0, None, None, 99.0]


def test_categories(spark):
    rows = ["Kleinanzeigen > Elektronik > Haushaltsgeräte", "Dienstleistungen > Auto, Rad & Boot", "Auto, Rad & Boot > Fahrräder", "Möbel", None, "xyz"]
    assert values(spark, N.normalize_category(x_()), rows) == ["haushaltsgeraete", "dienstleistungen", "sonstiges", "moebel", "sonstiges", "sonstiges"]


def test_labels_badges_forms(spark):
    assert values(spark, N.label_word(x_()), ["Ja", " scam ", "kein_betrug", "0", "?", None]) == [1, 1, 0, 0, None, None]
    assert values(spark, N.badge_key(x_()), ["TOP  Zufriedenheit", "NA JA Zufriedenheit", "Besonders zuverlässig", "neu"]) == ["zufriedenheit_top", "zufriedenheit_naja", "besonders_zuverlaessig", None]
    assert values(spark, N.legal_form(x_()), ["Deutsche Häuser AG", "Muster GmbH  & Co. KG", "Tag", "Anna e. K.", None]) == ["AG", "GmbH & Co. KG", None, "e. K.", None]


def test_lookalikes(spark):
    hosts = ["paypa1.com", "k1einanzeigen-pay.de", "paypal.com", "dhl.sicher.top", "schuhladhlen.de", "amazom.de", "example.org"]
    assert values(spark, C.imitated_brand(x_()), hosts) == ["paypal", "kleinanzeigen", None, "dhl", None, "amazon", None]


def test_phones(spark):
    rows = ["Teil 8U0807233A passt", "Ruf 0151 2345678 an", "+44 7700 900123", "+49 151 1234567"]
    assert [len(x) for x in values(spark, C.phones(x_()), rows)] == [0, 1, 1, 1]
    assert [len(x) for x in values(spark, C.foreign_phones(x_()), rows)] == [0, 0, 1, 0]


def test_ibans(spark):
    text = "DE89 3704 0044 0532 0130 00 oder GB82 WEST 1234 5698 7654 32 bitte"
    assert values(spark, R.find_ibans(x_()), [text, "DE00 3704 0044 0532 0130 00", None]) == [["DE89 3704 0044 0532 0130 00", "GB82 WEST 1234 5698 7654 32"], [], []]
    assert values(spark, C.iban_valid(x_()), ["DE89 3704 0044 0532 0130 00", "DE88 3704 0044 0532 0130 00", "GB82WEST12345698765432"]) == [True, False, True]


def test_redact(spark):
    texts = [
        "Mail max.m@web.de oder max [at] gmx (dot) de, IBAN GB82 WEST 1234 5698 7654 32, Tel. 0151 2345678, +44 7700 900123, https://pay.example.com/x?id=9 @someone",
        "GB82 WEST 1234 5698 7654 32 und DE89370400440532013000 noch 12",
        "DE00 1234 5678 GB82 WEST 1234 5698 7654 32",
        "a@my-x.com https://x.de/ http://y.de/p @ab x@abc 0049 151 2345678 (0170) 123",
        None,
        "",
    ]
    out = values(spark, R.redact(x_()), texts)
    for secret in ("max.m", "WEST", "2345678", "900123", "id=9", "someone"):
        assert secret not in out[0]
    assert "anonym@web.de" in out[0] and "anonym@gmx.de" in out[0] and "+44" in out[0]
    assert values(spark, F.size(R.find_ibans(x_())), out) == [1, 2, 1, 0, 0, 0]
    assert values(spark, R.find_ibans(x_()), texts)[1:3] == [["DE89370400440532013000", "GB82 WEST 1234 5698 7654 32"], ["GB82 WEST 1234 5698 7654 32"]]
    assert out[3] == "anonym@my-x.com https://x.de/ http://y.de/… @ab x@abc 0011 111 1111111 (0170) 123"
    assert values(spark, R.redact(x_()), out) == out and out[4:] == [None, ""]


def test_redact_takes_no_digits_in(spark):
    rng = random.Random(3)
    texts = ["".join(rng.choice("abc@.de 0123456789+-/\n") for _ in range(rng.randint(0, 60))) for _ in range(300)]
    out = values(spark, R.redact(x_()), texts)
    assert all(b.count("9") <= a.count("9") for a, b in zip(texts, out, strict=True))


def test_sentences(spark):
    texts = ["Baujahr 2019. Abholung am 3. Oktober, ca. 20 Min. vom Bahnhof.", "Hallo! Geht z. B. morgen?\nJa.", "Am 12. Mai. Um 100. Ende?! „Ja“ (nein.) Gut... Sehr... gut.", "  \n", None, "Ein Satz.“ Noch einer. und klein"]
    got = values(spark, R.sentences(x_()), texts)
    assert len(got[0]) == 2 and got[1] == ["Hallo!", "Geht z. B. morgen?", "Ja."]
    assert got[2] == ["Am 12. Mai.", "Um 100.", "Ende?!", "„Ja“ (nein.)", "Gut...", "Sehr... gut."]
    assert got[3:] == [[], [], ["Ein Satz.“", "Noch einer. und klein"]]


def test_row_fields(spark):
    top = ["1/12", "Kleinanzeigen Mannheim > Elektronik > Handy", "Anrufen", "TOP • iPhone 15 Pro wie neu", "350 € VB", "68159 Mannheim • 3 km", "Max M.", "Privater Nutzer", "Aktiv seit  03.02.2024"]
    pages = [
        [*top, "Beschreibung", " Sehr gut erhalten. ", "", "Mit Hülle.", "Anzeige melden", "Ähnliche Anzeigen", "PS5 Controller"],
        [*top, "Sehr gut erhalten und mit Hülle", "Merken", "Weitere Anzeigen", "Anderes tolles Inserat"],
        ["Nur ein Titel hier"],
        [],
        None,
    ]
    df = spark.createDataFrame(list(enumerate(pages)), "i int, x array<string>")
    got = [r.v for r in df.select("i", P.row_fields(F.col("x"), F.lit("2024-02-13").cast("date")).alias("v")).orderBy("i").collect()]
    for v in got[:2]:
        assert (v.title, v.price, v.category, v.location, v.account_age_days, v.seller_type) == ("iPhone 15 Pro wie neu", 350.0, "elektronik", "68159 Mannheim", 10, "privat")
    assert got[0].description == "Sehr gut erhalten.\nMit Hülle." and got[1].description == "Sehr gut erhalten und mit Hülle"
    assert (got[2].title, got[2].price, got[2].description) == ("Nur ein Titel hier", None, "")
    assert got[3].title is None and got[3].description == "" and (got[4] is None or got[4].title is None)


def test_anonymised(spark):
    schema = "title string, description string, messages array<string>, image_paths array<string>, seller_name string, location string, url string, label int, source string, price double"
    rows = [("Tel 0151 2345678", "Mail max@web.de", ["+44 7700 900123"], [], "Max", "Mannheim", "u", 1, "s", 5.0), ("", "", [], ["b", "a"], None, None, None, None, None, None), ("Tel 0151 9999999", "Mail tom@web.de", ["+44 7700 111111"], [], "Tom", "Köln", "v", 0, "t", 7.0)]
    a, b, c = A.anonymised(spark.createDataFrame(rows, schema)).collect()
    assert (a.title, a.description, a.messages) == ("Tel 0111 1111111", "Mail anonym@web.de", ["+44 1111 111111"])
    assert [a[x] for x in ("seller_name", "location", "url", "label", "source")] == [None] * 5 and a.price == 5.0
    assert a.task == c.task != b.task and len(b.task) == 16


def test_judgement_signals(spark):
    schema = "score double, summary string, flags array<struct<code:string,evidence:string>>"
    df = spark.createDataFrame([(1.7, "Kurz", [("link", "x" * 200), ("zahlung", "")]), (None, " ", None)], schema)
    got = [r.v for r in df.select(C2.judgement_signals(F.col("score"), F.col("summary"), F.lit("phishing"), F.lit("gut"), F.col("flags"), "m").alias("v")).collect()]
    assert [(s.code, s.weight, s.evidence) for s in got[0]] == [("LLM_SUMMARY", 1.0, "Kurz – Masche: phishing, Sprache: gut (m)"), ("LLM_LINK", 1.0, "x" * 120), ("LLM_ZAHLUNG", 1.0, None)]
    assert got[1] == []


def test_retrain(spark):
    rows = spark.createDataFrame([(i, i % 2, i % 4 == 3, i % 2 / 2 + 0.25) for i in range(40)], "doc_id long, label int, test boolean, x double")
    keep = lambda train: lambda test: test.select("label", F.col("x").alias("score"))
    got = {r.model: (r.status, r.auc, r.message) for r in ML.retrain({"a": (rows, keep), "b": (rows.filter("label = 1"), keep), "c": (rows, lambda df: lambda test: test.select("no")), "d": "not here"}, spark).collect()}
    assert got["b"][0] == "too few rows" and got["c"][0] == "failed" and got["d"] == ("left out", None, "not here") and got["a"][0] == "trained"


def test_article_errors(spark):
    assert values(spark, W.article_errors(x_()), ["Die Handy und das Kamera, der Laptop, die Handy-Hülle"]) == [["Die Handy", "das Kamera"]]


def test_price_signals(spark):
    df = spark.createDataFrame([("iPhone 15 Pro", p) for p in (120.0, 280.0, 600.0)] + [("Hülle für iPhone 15", 5.0), ("Suche iPhone 15", 5.0)], "t string, p double")
    got = [r.v for r in df.select(S.codes(O.price_signals(F.col("p"), O.reference_min(F.col("t"), F.lit("")))).alias("v")).collect()]
    assert got == [["PRICE_FAR_TOO_LOW"], ["PRICE_LOW"], [], [], []]


def test_fuse(spark):
    rows = [(1, "rules", 0.2, True, True), (1, "text", None, True, False), (2, "rules", 0.5, True, False), (2, "text", 0.9, False, False), (3, "llm", None, False, False), (4, "rules", 0.2, True, False), (4, "text", 0.8, True, False)]
    got = {r.listing_id: (r.score, r.verdict) for r in C2.fuse(spark.createDataFrame(rows, "listing_id int, model string, score double, available boolean, hard boolean")).collect()}
    assert got == {1: (0.75, "hohes Risiko"), 2: (0.5, "verdächtig"), 3: (0.0, "unauffällig"), 4: (0.56, "verdächtig")}


def test_krippendorff(spark):
    coders = ["123321412___", "1233224125_3", "_3332342251_", "12332441251_"]
    votes = [("k", u, v) for c in coders for u, v in enumerate(c) if v != "_"]
    two = [("t", u, v) for u, pair in enumerate(["11", "10", "00", "00"]) for v in pair]
    one = [("o", u, "1") for u in (1, 1, 2, 2)]
    got = {r.k: r.alpha for r in A.krippendorff(spark.createDataFrame(votes + two + one, "k string, unit int, value string"), ["k"]).collect()}
    assert got["k"] == pytest.approx(0.743, abs=5e-4) and got["t"] == pytest.approx(0.5333, abs=1e-4) and got["o"] is None


def test_kappa(spark):
    rows = [(u, p, v) for p, vs in (("a", "11001011"), ("b", "10001111")) for u, v in enumerate(vs)]
    (row,) = A.kappas(spark.createDataFrame(rows, "unit int, person string, value string")).collect()
    assert row.n == 8 and row.kappa == pytest.approx(0.46667, abs=1e-4)


def test_consensus(spark):
    rows = [("a", "x", "betrug"), ("b", "x", "betrug"), ("b", "y", "betrug"), ("c", "x", "betrug"), ("c", "y", "serioes"), ("d", "x", "unklar"), ("e", "x", "betrug"), ("e", "y", "betrug"), ("e", "z", "serioes"), ("f", "x", "betrug")]
    decisions = spark.createDataFrame([("f", "unklar")], "task string, value string")
    got = {r.task: (r.status, r.verdict) for r in A.consensus(spark.createDataFrame(rows, "task string, person string, value string"), decisions).collect()}
    assert got == {"a": ("einfach", "betrug"), "b": ("einig", "betrug"), "c": ("konflikt", None), "d": ("unklar", None), "e": ("mehrheit", "betrug"), "f": ("entschieden", None)}


def test_upsert_equals_the_sequential_rule(spark):
    rng = random.Random(2)
    rows = [(rng.choice([None, "u1", "u2", "u3"]), f"f{rng.randint(0, 6)}", i) for i in range(60)]
    kept = []
    for r in rows:
        kept = [k for k in kept if not (k[0] is not None and k[0] == r[0] or k[1] == r[1])] + [r]
    got = T.upsert_labels(spark.createDataFrame(rows, "url string, fingerprint string, arrival int")).collect()
    assert {tuple(r) for r in got} == set(kept)


def test_split(spark):
    rows = spark.createDataFrame([(i, int(i % 3 == 0), i % 10 == 9) for i in range(400)], "id int, label int, train_only boolean")
    split = T.stratified_split(rows, "label", F.sha1(F.col("id").cast("string")), F.col("train_only"))
    got = {(r.label, r.split): r.n for r in split.filter("NOT train_only").groupBy("label", "split").agg(F.count("*").alias("n")).collect()}
    n = {v: sum(1 for i in range(400) if int(i % 3 == 0) == v and i % 10 != 9) for v in (0, 1)}
    for v in (0, 1):
        assert got[v, "test"] == round(n[v] * 0.15) and got[v, "test"] + got[v, "val"] == round(n[v] * 0.3)
    assert split.count() == 400 and split.filter("train_only AND split <> 'train'").count() == 0


def test_log_odds(spark):
    rows = [("geld zuerst", 1)] * 10 + [("schöne lampe abholung", 0)] * 10
    ranked = M.log_odds(M.gram_counts(spark.createDataFrame(rows, "text string, label int")))
    assert {r.gram for r in ranked.collect()} == {"geld", "zuerst", "geld zuerst"}
    assert [r.gram for r in M.candidates(ranked).collect()] == ["geld zuerst"]


def test_near_hashes_equal_brute_force(spark):
    rng = random.Random(4)
    base = [rng.getrandbits(63) for _ in range(30)]
    hashes = base + [h ^ sum(1 << b for b in rng.sample(range(62), rng.randint(1, 9))) for h in base]
    df = spark.createDataFrame(list(enumerate(hashes)), "a int, hash long")
    got = {(r.a, r.b) for r in M.near_hashes(df, df.withColumnRenamed("a", "b"), 6).collect()}
    assert got == {(i, j) for i, x in enumerate(hashes) for j, y in enumerate(hashes) if (x ^ y).bit_count() <= 6}


def test_sources(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes("titel;beschreibung;preis;betrug\nTür;Schöne Tür;1.200 €;ja\n".encode("cp1252"))
    (tmp_path / "b.csv").write_text("Titel,Text,Betrug\nLampe,Gut,nein\n", encoding="utf-8")
    assert readers.read_csv(spark, str(tmp_path / "*.csv")).count() == 2
    one, reason = readers.harmonised(readers.read_csv(spark, str(tmp_path / "a.csv")))
    assert reason is None and [(r.title, r.price, r.label) for r in one.collect()] == [("Tür", 1200.0, 1)]
    none, reason = readers.harmonised(spark.createDataFrame([("x", "y")], "text string, preis string"))
    assert none is None and reason == "no label column"
    (tmp_path / "einstufungen_anna.jsonl").write_text('{"task": "a"}\n{"task": "b', encoding="utf-8")
    (tmp_path / "einstufungen_.jsonl").write_text('{"task": "c"}\n', encoding="utf-8")
    assert [(r.task, r.person) for r in readers.read_person_logs(spark, str(tmp_path), "einstufungen", "task string").collect()] == [("a", "anna")]
    folder = tmp_path / "listings/betrug/Elektronik/item1"
    folder.mkdir(parents=True)
    (folder / "text.txt").write_text("Hallo")
    (folder / "bild.jpg").write_bytes(b"\xff\xd8\xff\xe0abc")
    (row,) = readers.read_listing_folders(spark, str(tmp_path / "listings")).collect()
    assert (row.label, row.category, len(row.files)) == (1, "elektronik", 1)
    assert readers.read_images(spark, str(tmp_path / "listings")).count() == 1


def test_writers(spark, tmp_path):
    rows = spark.createDataFrame([("train", "p", "a"), ("test", "q", "b")], "split string, prompt string, answer string")
    writers.write_finetune(rows, str(tmp_path / "ft"), "s")
    assert spark.read.text(str(tmp_path / "ft")).count() == 2
    files = spark.createDataFrame([("anna", "log", "a.json"), ("anna", "log", "_x.json"), ("bob", "log", "synthetisch/y")], "person string, section string, file string")
    assert [tuple(r) for r in writers.write_bundle(files, str(tmp_path / "b")).collect()] == [("anna", "log", 1)]


def test_recent_messages(spark):
    rng = random.Random(3)
    chats = [[], ["a" * 7000], ["wort " * 2000], ["x", "y z"], [" "] * 3]
    chats += [["".join(rng.choice("ab  \n") for _ in range(rng.choice([1, 10, 2500]))) for _ in range(rng.randrange(9))] for _ in range(40)]

    def plain(messages, budget):
        kept, used = [], 0
        for m in reversed(messages):
            if used >= budget:
                break
            room = budget - used
            kept.append(m if len(m) <= room else m[:room].rsplit(" ", 1)[0] + " … [gekürzt]")
            used += len(kept[-1])
        return kept[::-1]

    frame = spark.createDataFrame(list(enumerate(chats)), "i int, m array<string>")
    for budget in (6000, 40, 3):
        got = {r.i: r.k for r in frame.select("i", N.recent_messages(F.col("m"), budget).alias("k")).collect()}
        assert got == {i: plain(m, budget) for i, m in enumerate(chats)}


def test_suggestions_vector_and_sample(spark):
    rows = spark.createDataFrame([(0, "Ein Tisch aus Holz"), (1, "Zahl per PayPal Freunde und Familie"), (2, "siehe https://bit.ly/3abc")], "i int, t string")
    codes, suggestion = C2.suggestion(F.col("t"))
    got = {r.i: (r.c, r.s) for r in rows.select("i", codes.alias("c"), suggestion.alias("s")).collect()}
    assert got[0] == ([], "?") and got[1][1] == "ja" and got[1][0] and got[2] == (["URL_SHORTENER", "EXTERNAL_LINK"], "ja")

    from adsentry.queries import QUERIES

    vector = QUERIES["fea01_feature_vector"](spark, "/root/testdata/sf0.001")
    assert len(vector.columns) == 22 and all(t == "double" for c, t in vector.dtypes if c != "doc_id")
    rows = {r.doc_id: r for r in vector.collect()}
    assert len(rows) == 200 and {r.n_images for r in rows.values()} == {0.0, 1.0, 2.0} and max(r.n_phrase_groups for r in rows.values()) > 0 and max(r.n_ibans for r in rows.values()) == 1.0

    strata = spark.createDataFrame([(i, "a" if i % 10 else "b") for i in range(200)], "i int, s string")
    sample = A.balanced_sample(strata, "s", F.sha1(F.col("i").cast("string")), 60, ["a", "b"]).groupBy("s").count().collect()
    assert {r.s: r["count"] for r in sample} == {"a": 40, "b": 20}


def test_redacted_fingerprints(spark):
    texts = ["Rad zu verkaufen, Mail: anna.muster@example.com", "Rad zu verkaufen, Mail: bernd.beispiel@example.com", "Rad zu verkaufen, Mail: keine"]
    got = [r.f for r in spark.createDataFrame([(t,) for t in texts], "t string").select(T.fingerprint(R.redact("t")).alias("f")).collect()]
    assert got[0] == got[1] != got[2]


def test_listing_items(spark, tmp_path):
    """One file, one sub-folder, folders with a manifest in a category's folder, and what is none."""
    names = ["betrug/a.txt", "betrug/b.html", "betrug/x.exe", "betrug/.c.txt", "betrug/_d/e.txt", "betrug/rad/1.jpg", "betrug/rad/tief/2.txt", "betrug/inserat.json",
             "serioes/auto/i1/inserat.json", "serioes/auto/i1/foto.PNG", "serioes/auto/i2/inserat.json", "serioes/auto/lose.txt", "serioes/auto/i3/nur.txt", "serioes/moebel/inserat.json", "serioes/moebel/j/inserat.json", "oben.txt"]
    for n in names:
        (tmp_path / "in" / n).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "in" / n).write_text("x")
    got = {(r.label, r.item): [p.split("/in/")[1] for p in r.files] for r in readers.listing_items(spark, str(tmp_path / "in")).collect()}
    assert got == {
        (1, "a.txt"): ["betrug/a.txt"], (1, "b.html"): ["betrug/b.html"], (1, "rad"): ["betrug/rad/1.jpg", "betrug/rad/tief/2.txt"],
        (0, "auto/i1"): ["serioes/auto/i1/foto.PNG", "serioes/auto/i1/inserat.json"], (0, "auto/i2"): ["serioes/auto/i2/inserat.json"],
        (0, "moebel"): ["serioes/moebel/inserat.json", "serioes/moebel/j/inserat.json"],
    }


def test_detectors_that_fail_on_a_row(spark):
    docs = spark.createDataFrame([(i, f"{i}") for i in range(5)] + [(9, "kein")], "doc_id long, text string")
    detectors = {"good": lambda df: F.length("text"), "fails": lambda df: F.col("text").cast("int") / 2 + F.raise_error(F.lit("no")).cast("int"), "unbuilt": lambda df: F.col("nothing"), "absent": "not installed"}
    got = {}
    for r in C2.run_detectors(docs, "doc_id", detectors, docs.where("doc_id = 3").select("doc_id", F.lit("good").alias("model"), F.lit(0.5).alias("score"))).collect():
        got.setdefault(r.model, {})[r.doc_id] = (r.score, r.available, r.error)
    assert got["good"] == {**{i: (float(len(t)), True, None) for i, t in [(0, "0"), (1, "1"), (2, "2"), (4, "4"), (9, "kein")]}, 3: (0.5, True, None)}
    assert set(got["absent"].values()) == {(None, False, "not installed")} and len(got["absent"]) == 6
    assert all(x[0] is None and x[1] and x[2] for k in ("fails", "unbuilt") for x in got[k].values())


def test_other_writers(spark, tmp_path):
    rows = spark.createDataFrame([("train", "a", b"1"), ("test", "b", b"1"), ("test", "c", b"2")], "split string, text string, content binary")
    writers.write_splits(rows.drop("content"), str(tmp_path / "s"))
    assert {(r.split, r.text) for r in spark.read.json(str(tmp_path / "s")).collect()} == {("train", "a"), ("test", "b"), ("test", "c")}
    writers.write_csv(rows.drop("content"), str(tmp_path / "c"))
    assert {(r.split, r.text) for r in spark.read.option("header", True).csv(str(tmp_path / "c")).collect()} == {("train", "a"), ("test", "b"), ("test", "c")}
    writers.write_images(rows.select("content"), str(tmp_path / "i"))
    assert sorted(bytes(r.content) for r in spark.read.parquet(str(tmp_path / "i")).collect()) == [b"1", b"2"]
    writers.write_annotations(rows.select("text"), rows.select("split"), rows.select("text").limit(1), str(tmp_path / "a"))
    assert [spark.read.json(str(tmp_path / "a" / n)).count() for n in ("konsens", "saetze", "bilder")] == [3, 3, 1]
    for v in ("1", "2"):
        writers.append_report(rows.select("text"), str(tmp_path / "r"), v)
    assert spark.read.parquet(str(tmp_path / "r")).groupBy("version").count().count() == 2


def test_streams(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    spark.createDataFrame([(1, 0, "nur vorkasse"), (1, 1, "hallo"), (2, 0, "nur heute")], "conv_id long, turn long, text string").coalesce(1).write.mode("overwrite").json(str(source / "a"))
    stream = live.inbox(spark, f"{source}/*", "conv_id long, turn long, text string")
    for mode, df, name in (("append", live.scored_messages(stream), "m1"), ("complete", live.conversation_scores(stream), "m2")):
        query = df.writeStream.format("memory").queryName(name).outputMode(mode).start()
        query.processAllAvailable()
        query.stop()
    assert {(r.conv_id, r.turn): round(r.score, 2) for r in spark.table("m1").collect()} == {(1, 0): 0.6, (1, 1): 0.0, (2, 0): 0.2}
    assert {r.conv_id: round(r.score, 2) for r in spark.table("m2").collect()} == {1: 0.6, 2: 0.2}
    (tmp_path / "log").mkdir()
    log = spark.readStream.schema("task string, ts long, v string").json(str(tmp_path / "log"))
    state = versions.newest_state(spark, str(tmp_path / "out"), log.schema)
    for i, v in enumerate(("a", "b")):
        spark.createDataFrame([("t", i, v)], "task string, ts long, v string").coalesce(1).write.mode("append").json(str(tmp_path / "log"))
        query = versions.keep_newest(log, state, str(tmp_path / "check"), ["task"], [F.col("ts")])
        query.processAllAvailable()
        query.stop()
    assert [r.v for r in state.read().collect()] == ["b"]


def test_similar_cases_of_all_documents(spark):
    """join13 against brute force: odd ids and scores from 0.05 on are there, equal texts are not."""
    import math
    import re
    from collections import Counter

    from adsentry.plans import dimensions as D
    from adsentry.queries import QUERIES

    sf = "/root/testdata/sf0.001"
    docs, items = ([tuple(r) for r in spark.read.parquet(f"{sf}/{t}.parquet").select(k, "text").collect()] for t, k in (("documents", "doc_id"), ("benchmark", "item_id")))
    terms = lambda rows: {k: Counter(w for w in re.split("[^a-z]+", t.lower()) if len(w) > 2 and w not in D.ENGLISH_WORDS) for k, t in rows}
    bank, asked = terms(docs), terms(items)
    idf = {w: math.log((1 + len(docs)) / (1 + n)) + 1 for w, n in Counter(w for c in bank.values() for w in c).items()}
    weigh = lambda c: {w: (1 + math.log(n)) * idf.get(w, max(idf.values())) for w, n in c.items()}
    unit = lambda v: {w: x / math.sqrt(sum(y * y for y in v.values())) for w, x in v.items()}
    cases, expected = {d: unit(weigh(c)) for d, c in bank.items()}, {}
    texts = dict(docs)
    for q, text in items:
        v = unit(weigh(asked[q]))
        for d, case in cases.items():
            both = v.keys() & case.keys()
            score = sum(v[w] * case[w] for w in both)
            if len(both) >= 2 and score >= 0.05 and texts[d].lower() != text.lower():
                expected[q, d] = score
    got = {(r.q, r.d): r.score for r in QUERIES["join13_ml14_similar"](spark, sf).collect()}
    assert got == pytest.approx(expected, abs=2e-6)
    assert any(d % 2 for _, d in got) and min(got.values()) < 0.3


def test_image_verdict_of_all_events(spark):
    import json

    from adsentry.queries import QUERIES

    sf, flags = "/root/testdata/sf0.001", {}
    for r in spark.read.parquet(f"{sf}/events.parquet").select("props", "event_type").collect():
        flags.setdefault(int(json.loads(r.props)["k"]), []).append({"click": "ja", "error": None}.get(r.event_type, "nein"))
    expected = {t: "betrug" if "ja" in x else "unklar" if None in x else "serioes" for t, x in flags.items()}
    assert {r.task: r.verdict for r in QUERIES["agg31_image_verdict"](spark, sf).collect()} == expected


def test_whole_messages_are_quoted(spark):
    import hashlib
    import re

    from adsentry.queries import QUERIES

    sf, expected = "/root/testdata/sf0.001", {}
    for r in spark.read.parquet(f"{sf}/conversations.parquet").collect():
        quote = re.sub('[„“”"]', "", r.text)
        if 25 <= len(quote) <= 1500 and len(re.split(r"\s+", quote)) >= 4:
            expected[r.conv_id, r.turn] = hashlib.sha1(quote.encode()).hexdigest(), len(quote)
    assert max(n for _, n in expected.values()) > 400
    got = {(r.conv_id, r.turn): r.sha1 for r in QUERIES["txt30_received_messages"](spark, sf).collect()}
    assert got == {k: h for k, (h, _) in expected.items()}
