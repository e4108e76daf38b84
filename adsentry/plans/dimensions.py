"""Word lists, tables and constants that results depend on, in their natural order."""

from __future__ import annotations

from .lexicon import LEXICON, STEMS  # noqa: F401

CATEGORIES = ["elektronik", "haushaltsgeraete", "auto", "moebel", "mode", "tiere", "immobilien", "tickets", "dienstleistungen", "sonstiges"]

# Category by the first list of which a word occurs in a path segment; the order counts.
CATEGORY_KEYWORDS = {
    "sonstiges": ["fahrrad", "fahrräder"],
    "haushaltsgeraete": ["haushalt", "waschmaschine", "kühlschrank", "küche", "staubsauger", "trockner", "spülmaschine", "geschirrspüler"],
    "elektronik": ["elektronik", "handy", "smartphone", "computer", "laptop", "notebook", "tablet", "konsole", "tv", "audio", "foto", "kamera"],
    "auto": ["auto", "kfz", "fahrzeug", "pkw", "motorrad", "wohnmobil", "reifen"],
    "moebel": ["möbel", "moebel", "sofa", "schrank", "einrichtung", "wohnen", "wohnzimmer", "schlafzimmer", "esszimmer"],
    "mode": ["mode", "kleidung", "schuhe", "taschen", "beauty"],
    "tiere": ["tier", "hund", "katze", "pferd"],
    "immobilien": ["wohnung", "immobilie", "häuser", "miete", "wg", "grundstück"],
    "tickets": ["ticket", "eintrittskarte", "konzert"],
}

BADGES = {
    "zufriedenheit_top": "TOP Zufriedenheit",
    "zufriedenheit_ok": "OK Zufriedenheit",
    "zufriedenheit_naja": "NA JA Zufriedenheit",
    "sehr_freundlich": "Sehr freundlich",
    "freundlich": "Freundlich",
    "besonders_zuverlaessig": "Besonders zuverlässig",
    "zuverlaessig": "Zuverlässig",
}

LEGAL_FORM = r"(?U)(?<![\w.])(GmbH\s*&\s*Co\.?\s*KG|gGmbH|GmbH|UG(?:\s*\(haftungsbeschränkt\))?|AG|SE|KGaA|KG|OHG|GbR|PartG(?:mbB)?|eG|e\.\s?K\.|e\.\s?Kfm\.|e\.\s?V\.|Ltd\.?|Inc\.?|LLC|S\.?à\s?r\.?l\.?)\s*$"

LABEL_WORDS = {
    "1": 1, "0": 0, "true": 1, "false": 0, "wahr": 1, "falsch": 0, "ja": 1, "nein": 0, "yes": 1, "no": 0, "j": 1, "n": 0,
    "betrug": 1, "scam": 1, "fake": 1, "spam": 1, "phishing": 1, "verdächtig": 1,
    "seriös": 0, "serioes": 0, "legit": 0, "legitim": 0, "echt": 0, "ham": 0, "ok": 0, "kein betrug": 0, "unauffällig": 0,
}

COLUMN_ALIASES = {
    "title": ["title", "titel", "überschrift", "ueberschrift", "headline"],
    "description": ["description", "beschreibung", "text", "inhalt", "anzeigentext", "body"],
    "price": ["price", "preis"],
    "category": ["category", "kategorie", "rubrik"],
    "messages": ["messages", "nachrichten", "nachricht", "chat", "message"],
    "scam_type": ["scam_type", "masche", "betrugsart"],
    "seller_account_age_days": ["seller_account_age_days", "kontoalter", "kontoalter_tage"],
    "image": ["image", "bild", "bildpfad", "image_path"],
}
LABEL_ALIASES = ["label", "betrug", "ist_betrug", "is_scam", "scam", "fake", "ist_fake", "klasse", "class"]

OFFICIAL_DOMAINS = (
    "kleinanzeigen.de ebay-kleinanzeigen.de ebay.de ebay.com paypal.com paypal.de paypal.me dhl.de dhl.com myhermes.de hermesworld.com hermes.com dpd.de dpd.com "
    "gls-pakete.de gls-group.eu ups.com mobile.de autoscout24.de klarna.com amazon.de amazon.com sparkasse.de commerzbank.de deutsche-bank.de"
).split()
BRANDS = "kleinanzeigen ebay paypal dhl hermes dpd gls ups autoscout klarna amazon".split()
SHORTENERS = "bit.ly tinyurl.com t.co goo.gl is.gd cutt.ly rebrand.ly shorturl.at t.ly ow.ly rb.gy s.id tiny.cc v.gd".split()
SUSPICIOUS_TLDS = "xyz top icu online site shop live click link tk ml ga cf gq pw cc buzz rest fit support help services cyou sbs cfd monster quest".split()
COMMON_TLDS = "de com net org info eu at ch io co me biz app store".split()
# Suffixes of more than one label that count as one.
LONG_SUFFIXES = "co.uk org.uk ac.uk com.au co.nz co.jp com.br com.tr co.at or.at".split()
HOMOGLYPHS = ("013457@", "oleasta")
HOME_PHONE_CODES = ("49", "43", "41")
HOME_IBAN_COUNTRIES = ("DE", "AT", "CH", "LI", "LU")

GERMAN_WORDS = (
    "der die das den dem des und ist nicht ich sie es ein eine einen einem einer eines mit für auf zu von im am um aus bei nach vor über unter ohne bis durch gegen in an "
    "zum zur vom beim ins auch noch wie nur schon mal sehr wird werden wurde sind war waren hat habe haben hatte kann können muss müssen soll sollte wollen möchte gibt "
    "aber oder wenn dass weil als dann denn doch da hier kein keine keinen mir mich mein meine meinen dir dich wir uns ihr ihnen euch er ihm ihn sich wer wo "
    "gerne gern bitte alle alles viel viele mehr wegen selbst gut neu inkl ca ab ja nein nichts dabei"
).split()
ENGLISH_WORDS = (
    "the and is are you your with for this that it of to on be have has were can my we not but or if at by from as very new used item please payment shipping condition available"
).split()
# Further words that say nothing about a phrase.
PHRASE_FILLERS = (
    "oder aber so als bin bist sein hast will du er wir ihr mich dich mir dir uns euch ihn ihm ihnen mein meine dein deine ihre sich ab da dann wenn dass ob kein keine ja nein "
    "hallo hi danke bitte gut doch was wer wo"
).split()
UMLAUT_SUBSTITUTES = (
    "fuer ueber moechte koennen koennte muessen waere haette schoen groesse zurueck kaeufer verkaeufer geraet zustaende natuerlich gruesse taeglich spaeter frueher pruefen gewaehrleistung"
).split()
NOUN_GENDER = {
    "n": "handy auto fahrzeug fahrrad iphone tablet notebook smartphone sofa bett gerät paket".split(),
    "m": "laptop fernseher kühlschrank trockner wagen computer monitor schrank tisch stuhl preis kinderwagen staubsauger herd artikel zustand".split(),
    "f": "waschmaschine spülmaschine kamera konsole uhr couch kommode mikrowelle kaffeemaschine rechnung lieferung zahlung garantie anzeige".split(),
}
WRONG_ARTICLES = {"n": ["der", "die", "eine"], "m": ["das", "eine"], "f": ["das", "ein"]}

# Sentence ends do not follow these.
ABBREVIATIONS = "bzw ca nr tel usw etc inkl zzgl ggf evtl vgl mio tsd std min dr hr fr str mfg lg vg bspw max mind abs geb gem".split()

FUSION_WEIGHTS = {"rules": 1.0, "text": 1.5, "image": 0.7, "automl": 1.0, "llm": 1.2}
HARD_FLOOR, SUSPICIOUS, HIGH_RISK = 0.75, 0.40, 0.70

# Codebook signals of the contact codes.
CONTACT_SIGNALS = {
    "IBAN_IN_TEXT": "zahlung_ausserhalb", "FOREIGN_IBAN": "zahlung_ausserhalb", "LOOKALIKE_DOMAIN": "zahlungslink", "URL_SHORTENER": "zahlungslink", "SUSPICIOUS_TLD": "zahlungslink",
    "PUNYCODE_URL": "zahlungslink", "IP_URL": "zahlungslink", "EXTERNAL_LINK": "zahlungslink", "EMAIL_IN_TEXT": "kontaktwechsel", "PHONE_IN_TEXT": "kontaktwechsel",
    "FOREIGN_PHONE": "kontaktwechsel", "IMPERSONATION_EMAIL": "andere_masche",
}

# What an item usually costs at least and at most, used; specific names before general ones.
PRICE_REFERENCE = [
    (r"iphone ?1[67] ?pro", 650.0, 1300.0),
    (r"iphone ?1[45] ?pro", 450.0, 950.0),
    (r"iphone ?1[3-7]", 300.0, 900.0),
    (r"iphone ?1[12]", 150.0, 450.0),
    (r"galaxy z ?(fold|flip) ?[4-7]", 300.0, 1500.0),
    (r"samsung galaxy s2[3-6]", 300.0, 1000.0),
    (r"pixel ?(8|9|10)", 200.0, 900.0),
    (r"ipad pro", 350.0, 1500.0),
    (r"ipad air", 250.0, 800.0),
    (r"apple watch (ultra|series ?(9|10|11))", 150.0, 700.0),
    (r"airpods ?max", 250.0, 500.0),
    (r"airpods ?pro", 80.0, 220.0),
    (r"(playstation ?5|ps ?5) ?pro", 500.0, 800.0),
    (r"playstation ?5|ps ?5", 280.0, 500.0),
    (r"xbox series x", 250.0, 450.0),
    (r"steam ?deck", 250.0, 600.0),
    (r"nintendo switch ?2", 300.0, 500.0),
    (r"nintendo switch", 120.0, 280.0),
    (r"meta quest ?3", 250.0, 500.0),
    (r"rtx ?(5090|4090)", 1300.0, 3000.0),
    (r"rtx ?(5080|4080)", 700.0, 1300.0),
    (r"rtx ?(50|40)70", 350.0, 800.0),
    (r"rtx ?30[89]0", 300.0, 800.0),
    (r"rx ?(7900|9070)", 400.0, 900.0),
    (r"macbook (air|pro)", 450.0, 2500.0),
    (r"sony (a7|alpha ?7)|canon eos r[5-8]|nikon z ?[5-9]", 600.0, 3000.0),
    (r"dji (mini|air|mavic) ?[2-5]", 250.0, 1500.0),
    (r"gopro hero ?1[1-3]", 150.0, 400.0),
    (r"thermomix|tm ?[67]", 500.0, 1400.0),
    (r"kitchenaid", 150.0, 600.0),
    (r"jura (e[468]|z10|ena|giga)", 250.0, 1500.0),
    (r"dyson (v1[0-5]|gen5|airwrap)", 150.0, 550.0),
    (r"roborock|dreame (l|x)\d", 150.0, 900.0),
    (r"(waschmaschine|trockner|geschirrspüler|spülmaschine)", 80.0, 700.0),
    (r"kühlschrank|kühl-gefrier", 60.0, 900.0),
    (r"e-?bike|pedelec", 500.0, 5000.0),
    (r"(vw|volkswagen) golf", 3000.0, 35000.0),
    (r"bmw [1-5]er|audi a[3-6]|mercedes (a|c|e)[- ]?klasse", 4000.0, 50000.0),
    (r"französische bulldogge|french bulldog", 800.0, 3000.0),
    (r"golden retriever|labrador", 800.0, 2500.0),
    (r"zwergspitz|pomeranian|yorkshire|chihuahua|malteser", 600.0, 3000.0),
    (r"maine coon", 600.0, 2000.0),
    (r"britisch kurzhaar|\bbkh\b|scottish fold|ragdoll", 400.0, 1500.0),
]
# Of each pattern above, in the same order: every text that matches holds one of these.
PRICE_STEMS = ["iphone", "iphone", "iphone", "iphone", "galaxy", "samsung", "pixel", "ipad", "ipad", "apple", "airpods", "airpods", "playstation ps", "playstation ps", "xbox", "steam", "nintendo", "nintendo", "quest", "4090 5090", "4080 5080", "rtx", "rtx", "7900 9070", "macbook", "canon nikon sony", "dji", "gopro", "thermomix tm", "kitchenaid", "jura", "dyson", "dreame roborock", "geschirrspüler spülmaschine trockner waschmaschine", "kühlschrank kühl-gefrier", "bike pedelec", "golf", "audi bmw mercedes", "bulldog", "labrador retriever", "chihuahua malteser pomeranian yorkshire zwergspitz", "maine", "bkh britisch ragdoll scottish"]
# Titles of accessories, of broken things, and of adverts that seek or let; "spiele" counts unless it stands after one of five words.
NOT_THE_ITEM = (
    "hülle case cover folie schutzfolie panzerglas schutzglas displayschutz kabel ladekabel ladegerät netzteil adapter akku controller fernbedienung halterung ständer tasche karton verpackung zubehör "
    "ersatzteil ersatzteile defekt kaputt bastler reparatur mainboard platine skin aufkleber spiel game suche gesucht tausch tausche vermiete verleih deckrüde deckkater tierschutz schutzgebühr"
).split()
NOT_THE_ITEM_STARTS = ["vermiete", "verleih"]
GAMES, BEFORE_GAMES = "spiele", [r"mit ", r"und ", r"inkl\. ", r"\+ ", r"\s\d "]

# Schemes that reports describe, name and pattern on lower case.
SCHEMES = [
    ("Fake „Sicher bezahlen“/„Direkt kaufen“", r"sicher(es)? bezahlen|direkt kaufen|sichere zahlung"),
    ("Phishing-Link/Fake-Seite", r"phishing|fake[- ]?(link|seite)|\blink\b.{0,40}(geschickt|bekommen|erhalten|klick)"),
    ("PayPal Freunde & Familie", r"freunde (und|&) familie|paypal[- ]?freunde|\bf ?& ?f\b"),
    ("Vorkasse/Überweisung", r"vorkasse|überwiesen|überweisung|anzahlung"),
    ("Kurier/Spedition/Ausland", r"kurier|spedit|im ausland|aus dem ausland"),
    ("Ware kam nicht oder falsch", r"nie angekommen|nicht (verschickt|versendet|angekommen)|leeres? paket|ziegel|\bsteine\b"),
    ("Käuferschutz/Rückbuchung", r"käuferschutz|rückbuchung|konfliktfall|chargeback|geld zurückgeholt"),
    ("Gehacktes Konto", r"gehackt|account übernommen|konto übernommen|fremde[nr]? (account|konto)"),
    ("Dreiecksbetrug", r"dreiecksbetrug|dreieck"),
    ("Ausweis/Identität", r"ausweis|perso\b|identität"),
    ("Kontakt außerhalb (WhatsApp, Mail)", r"whats ?app|telegram|per (e-)?mail (weiter|kontakt)"),
    ("Code-Weitergabe", r"(sms|bestätigungs|sicherheits)[- ]?code|code (geschickt|weitergegeben)"),
    ("Fake-Zahlungsbeleg/Screenshot", r"screenshot|zahlungsbeleg|fake[- ]?(beleg|bestätigung)"),
    ("Wohnung/Ferienwohnung", r"wohnung|kaution|vermieter"),
    ("Tiere", r"welpe|hundebaby|kätzchen|kitten"),
]

# How the text rows of an advert's page are told apart.
ROW_PRICE = r"^(?:ab\s+)?\d{1,3}(?:[.\s]\d{3})*(?:,\d{1,2})?\s*(?:€|eur)(?:\s*vb)?$|^vb$|^zu verschenken$"
ROW_POSTCODE = r"\b\d{5}\s+(?!(?i:km|kilometer|euro|eur|stück|stk|watt|mah)\b)[A-ZÄÖÜ][^\n•·|>›]*"
ROW_COUNTER = r"^\d+\s*/\s*\d+$"
ROW_BADGES = r"(?i)^(?:(?:reserviert|gelöscht|top)\s*[•·]?\s*)+"
ROW_AGE = r"(?i)aktiv seit\s+\d{1,2}\.\d{1,2}\.\d{4}"
DESCRIPTION_ENDS = ["anzeige melden", "nachricht schreiben", "rechtliche angaben", "sicherheitshinweise", "anzeigen-id", "anzeigennr", "privater nutzer", "gewerblicher nutzer", "aktiv seit"]
PAGE_ENDS = ["andere anzeigen des anbieters", "alle anzeigen dieses anbieters", "das könnte dich auch interessieren", "ähnliche anzeigen", "weitere anzeigen"]
SELLER_ROWS = ["privater nutzer", "gewerblicher nutzer"]
PAGE_PHRASES = [
    "kleinanzeigen", "was suchst du?", "alle kategorien", "plz oder ort", "registrieren", "einloggen", "oder", "registrieren oder einloggen", "folgen", "anrufen", "merken", "teilen", "anzeige teilen",
    "zur merkliste hinzufügen", "nachricht senden", "karte", "satellit", "karte satellit", "standort", "details", "ausstattung", "mehr anzeigen", "weniger anzeigen", "hallo!", "top",
    "zum inhalt springen", "startseite", "inserieren", "meins", "anzeige aufgeben",
]

# How three kinds of forum software mark the parts of a thread page (tag or "", class, attribute; each "" if free).
THREAD_PARTS = [
    # layout, part, tag, class, attribute
    (0, "post", "article", "message", ""),
    (0, "body", "", "bbWrapper", ""),
    (0, "quote", "blockquote", "bbCodeBlock--quote", ""),
    (0, "quote", "div", "bbCodeBlock--code", ""),
    (0, "own", "", "", "data-quote"),
    (0, "member", "", "bbCodeBlock-title", ""),
    (0, "content", "", "bbCodeBlock-content", ""),
    (0, "content", "", "bbCodeBlock-expandContent", ""),
    (0, "content", "pre", "", ""),
    (0, "junk", "", "bbCodeBlock-expandLink", ""),
    (0, "title", "h1", "p-title-value", ""),
    (0, "pages", "", "pageNav-page", ""),
    (1, "post", "", "wbbPost", ""),
    (1, "body", "", "messageText", ""),
    (1, "quote", "blockquote", "quoteBox", ""),
    (1, "quote", "", "codeBox", ""),
    (1, "own", "", "", "cite"),
    (1, "heading", "", "quoteBoxTitle", ""),
    (1, "content", "", "quoteBoxContent", ""),
    (1, "content", "pre", "", ""),
    (1, "title", "h1", "", ""),
    (2, "post", "div", "post", ""),
    (2, "body", "", "posttext", ""),
]
MEMBER_HEADING = "Zitat von"
CUE_WINDOW = 160
RECEIVED_CUES = r"(?i)nachricht|mail|sms|whatsapp|chat|schrieb|schreibt|geschrieben|bekam|bekomme|bekommen|erhalten|erhielt|folgende|folgendes|anfrage|antwort|antwortete|meinte|kam|wortlaut|text|zitat"
MESSAGE_CHARS = (25, 1500)
MESSAGE_WORDS = 4
# Where warning pages have the wording of a fraud.
ALERT_HEADING = "Warnung vor dieser Nachricht"
ALERT_ENDS = ["Warnung", "Tipp", "Type Information"]
ALERT_TIPS = "Allgemeine Tipps"
DATED_HEADING = r"(?U)^(\d{1,2})\. (\w+) (20\d\d):?\s*(.*)$"
WARNING_QUOTE = r"(?m)(?:^|(?<=[\s(\[:/]))[„“\"»«‚'](?=\S)([^„“”\"»«\n]{15,600}?)(?<=\S)[“”\"«»‘'](?=[\s.,;:!?)\]–-]|$)"
ONLY_DATE = r"(?U)^[\d.\s]*(\w+)?[\d.\s]*$"
# Public-suffix rules of the kinds that there are; a longer list can be given as a table.
SUFFIX_RULES = [*COMMON_TLDS, *SUSPICIOUS_TLDS, *LONG_SUFFIXES, "uk", "jp", "*.ck", "!www.ck", "*.kawasaki.jp", "!city.kawasaki.jp", "github.io", "blogspot.com"]
# What of a chat goes into a prompt, and the mark of a shortened text.
MESSAGE_BUDGET = 6000
SHORTENED = " … [gekürzt]"
