"""The phrase groups, with a prefilter for each pattern."""

# Group, weight, hard, codebook signal, and patterns in lower case; a space stands for any white space.
LEXICON: list[tuple[str, float, bool, str, list[str]]] = [
    ("FAKE_PAYMENT_LINK", 0.85, True, "zahlungslink", [
        r"zahlung (wurde )?(bereits )?(erhalten|getätigt|veranlasst).{0,60}(link|klick)",
        r"geld (abholen|empfangen|freischalten)",
        r"(klicke?n?|klicken sie) (auf|den) (den |diesen )?link",
        r"qr[- ]?code.{0,40}(scannen|scanne|einscannen)|(scanne|scannen sie|scannen) (bitte )?(den|diesen|folgenden) qr[- ]?code",
        r"(karten|kredit ?karten|bank)daten.{0,40}(eingeben|bestätigen|verifizieren)",
        r"bestätigungs ?code|sms[- ]?code|tan[- ]?nummer",
        r"(käuferschutz|verkäuferschutz)[- ]?(gebühr|aktivier)",
    ]),
    ("OFFPLATFORM_PAYMENT", 0.6, False, "zahlung_ausserhalb", [
        r"freunde (und|&) familie",
        r"friends (and|&) family",
        r"western ?union|money ?gram|ria ?money",
        r"paysafe ?card|amazon[- ]?gutschein|itunes|google ?play[- ]?karte|steam[- ]?karte",
        r"bitcoin|btc|krypto|usdt|ethereum",
        r"nur (per )?vorkasse|vorkasse (only|ausschließlich)",
        r"überweisung ins ausland",
    ]),
    ("SHIPPING_OR_ESCROW_STORY", 0.55, False, "versandgeschichte", [
        r"spedit(ion|eur)|transportunternehmen|kurierdienst holt",
        r"treuhand(service|konto|dienst)?",
        r"dhl[- ]?(treuhand|sicher|express-?zahlung)",
        r"(mein|ein) kurier (holt|kommt|wird)",
        r"versand (nur|ausschließlich) (per|mit) (spedition|kurier)",
    ]),
    ("SELLER_ABROAD", 0.45, False, "versandgeschichte", [
        r"(derzeit|momentan|zurzeit|gerade) im ausland",
        r"(auf|bei) (montage|bohrinsel|offshore)",
        r"(militär|soldat|bundeswehr)[^.]{0,40}(einsatz|stationiert|ausland)",
        r"(nach|in) (england|spanien|frankreich|italien|rumänien|polen|nigeria) (gezogen|umgezogen|versetzt)",
        r"kann (leider )?nicht (persönlich|vorbei|telefonieren)",
    ]),
    ("IDENTITY_PHISHING", 0.7, True, "datenabfrage", [
        r"(personal)?ausweis.{0,40}(schick|send|foto|kopie|bild)",
        r"selfie mit (dem |deinem |ihrem )?ausweis",
        r"video[- ]?ident",
        r"(führerschein|reisepass).{0,30}(schick|send|foto|kopie)",
    ]),
    ("OFFPLATFORM_CONTACT", 0.35, False, "kontaktwechsel", [
        r"whats ?app|telegram|signal[- ]?messenger|wickr",
        r"(nur|bitte) (per |über |via )?(e-?mail|mail) (kontaktieren|melden|schreiben)",
        r"schreib(en sie)? mir (per|eine) (e-?mail|mail)",
        r"(antworte|melde) (mich|dich) nicht (hier|über die (app|plattform))",
    ]),
    ("PRESSURE_URGENCY", 0.2, False, "zeitdruck", [
        r"nur (noch )?(bis )?heute",
        r"bis heute (abend|mittag|nachmittag|nacht|\d{1,2}([:.]\d\d)? ?uhr)",
        r"(angebot|preis|reservierung) gilt (nur )?(noch )?bis heute",
        r"wer zuerst (zahlt|überweist)",
        r"viele (andere )?(interessenten|anfragen)",
        r"sofort(ige)? (zahlung|überweisung)",
        r"schnell entscheiden|muss schnell weg",
        r"(innerhalb|in) (von )?(12|24|48|72) stunden|frist von \d+ (stunden|tagen)",
        r"sonst (ist )?(er |sie |es |das |der artikel |die ware |das angebot )?(bald |gleich |schnell |sofort |morgen )?(weg|vergeben|verkauft|nicht mehr (da|verfügbar|zu haben))",
        r"(habe|haben) (noch |schon )?(mehrere|einige|weitere|\d+) (andere )?(interessenten|anfragen|käufer)",
        r"(der|die|wer) (erste|schnellste).{0,30}(zahlt|überweist|bezahlt)",
        r"(heute|jetzt|sofort) noch (überweisen|zahlen|bezahlen|überweist|zahlst)",
        r"letzte (chance|gelegenheit)",
        r"(antworte|melde dich|melden sie sich|zahle|zahlen sie|überweise|überweisen sie) (bitte )?(sofort|umgehend|schnellstmöglich|asap|unverzüglich)",
        r"(schick|überweis|send)\w* (mir )?(bitte )?(jetzt )?(schnell|sofort|umgehend) (das )?geld",
    ]),
    ("OVERPAYMENT_REVERSE", 0.6, False, "geldumweg", [
        r"überzahl(ung|t)|zu viel (überwiesen|bezahlt)",
        r"differenz(betrag)? (zurück|überweisen|erstatten)",
        r"ich zahle (mehr|extra|zusätzlich) (für|wenn)",
    ]),
    ("TRIANGLE_FRAUD", 0.5, False, "geldumweg", [
        r"zahlung (erfolgt )?(durch|über) (einen )?(dritte|bekannte|kunden)",
        r"(für|an) einen (bekannten|kunden|freund) (überweisen|bezahlen)",
        r"konto (meines|meiner) (bruders|schwester|freundes|freundin|bekannten)",
    ]),
    ("TRANSLATED_PHRASING", 0.25, False, "vorlagen_sprache", [
        r"hallo (lieber|liebe) (käufer|kunde|herr|frau)",
        r"ich bin (der|die) (eigentümer|besitzer)(in)? (dieses|des) artikels",
        r"ist (der|die|das) artikel noch (verfügbar|erhältlich)\?\s*$",
        r"(ohne|keine) (fehler|kratzer|probleme) und (ohne|keine) (fehler|kratzer|probleme)",
        r"ich (würde|möchte) gerne (ihren|deinen) artikel kaufen",
        r"bitte (kontaktieren|kontaktiere) (sie )?mich per",
        r"sehr geehrte(r)? (kunde|kundin|nutzer|nutzerin|mitglied)",
    ]),
    ("ACCOUNT_PHISHING", 0.65, False, "datenabfrage", [
        r"(ihr|dein) (konto|account|zugang|profil) (wurde|wird|ist) (vorübergehend |vorläufig |aus sicherheitsgründen )?(gesperrt|eingeschränkt|deaktiviert|gelöscht|limitiert|eingefroren)",
        r"(verifizieren|bestätigen|aktualisieren) sie (bitte )?(jetzt |umgehend )?(ihr(e|en)?|ihre) (konto|kontozugriff|identität|daten|angaben|zugangsdaten|kontodaten)",
        r"(ungewöhnliche|verdächtige) (aktivität|anmeldung|anmeldeversuch)|neue anmeldung erkannt|anmeldeversuch (bemerkt|erkannt|festgestellt)",
        r"(sperrung|löschung|deaktivierung|einschränkung) (ihres|deines) (kontos|accounts|zugangs)",
        r"konto (jetzt )?(sichern|entsperren|reaktivieren|freischalten)",
        r"(geben|tragen) sie (hier |dort )?ihre (daten|bankdaten|zugangsdaten|kreditkarten(daten|nummer)|pin|tan|passwort) ein",
        r"klick(e|en sie)? (bitte )?hier,? um",
    ]),
    ("PARCEL_CUSTOMS", 0.55, False, "versandgeschichte", [
        r"(paket|sendung|lieferung).{0,60}(konnte nicht zugestellt|zustellung (ist )?(fehlgeschlagen|ausstehend)|angehalten|zurückgehalten)",
        r"(zoll|liefer|versand|zustell|nachporto)gebühr(en)?.{0,40}(zahlen|begleichen|überweisen|ausstehend|offen)",
        r"(neuen|bestätige[n]?) (zustell|liefer)(termin|adresse)",
    ]),
    ("CODE_REQUEST", 0.8, True, "datenabfrage", [
        r"(schick|send|nenn|gib|leite)\w* (mir|uns) (bitte )?(kurz )?(den|deinen|ihren|diesen) (\d-stelligen )?(code|zahlencode|bestätigungscode|sicherheitscode|pin)",
        r"(code|zahlencode|bestätigungscode),? (den|der) (du|sie) (gerade |eben )?(per sms )?(bekommen|erhalten)",
        r"versehentlich (einen |meinen )?code (an dich |an sie )?(geschickt|gesendet)",
    ]),
    ("PAYMENT_PENDING_STORY", 0.6, False, "zahlungslink", [
        r"zahlung (ist|wurde) (bereits )?(reserviert|blockiert|eingefroren|zurückgehalten|vorgemerkt)",
        r"(geld|betrag|zahlung) (wird|ist) (erst )?(freigegeben|gutgeschrieben|ausgezahlt),? (sobald|nachdem|wenn)",
        r"(kaufbestätigung|zahlungsbestätigung|zahlungseingang).{0,40}(e-?mail|mail|postfach|spam)",
        r'(über|mit|per) (die |der )?(funktion |option )?[„"]?(sicher bezahlen|direkt kaufen)[“"]? (bezahlt|gekauft|überwiesen|abgeschlossen)',
        r"um die zahlung .{0,60}zu erhalten,? (folgen|bestätigen|klicken|senden|geben)",
        r"(artikel|anzeige).{0,30}auf reserv(e|iert) (stellen|setzen)",
    ]),
    ("ADVANCE_FEE_SPAM", 0.5, False, "andere_masche", [
        r"(sie|du) (haben|hast) (gewonnen|einen gewinn)|herzlichen glückwunsch.{0,40}(gewonnen|gewinner|ausgewählt)",
        r"erbschaft|nachlass (eines|ihres)|verstorbene[nr]? (kunde|verwandte)",
        r"(garantierte?|hohe) rendite|passives einkommen|krypto[- ]?(gewinn|investment)",
        r"bearbeitungsgebühr|freischaltgebühr|aktivierungsgebühr",
        r"gewinnspiel.{0,60}(gewonnen|gewinner|ausgewählt)|(sie wurden|du wurdest) als gewinner",
        r"(schnell|einfach|leicht) (reich werden|geld verdienen)|geld verdienen von zu hause",
    ]),
    ("BUYER_NO_QUESTIONS", 0.3, False, "desinteresse", [
        r"(kaufe|nehme) (es|ihn|sie|den artikel) (auch )?ohne (zu )?(besichtig|anschau|ansehen)",
        r"(gib|nenn|schick) (mir )?(deine|ihre) (paypal|e-?mail)[- ]?(adresse)? (für die zahlung|damit ich (zahlen|bezahlen|überweisen))",
        r"zahle (den )?(vollen )?preis (plus|inklusive|inkl\.?) versand",
        r"(deine|ihre) (handynummer|telefonnummer|nummer) (für|damit) (die )?(zahlung|paypal|den kurier|den versand)",
    ]),
    ("PAYMENT_FIRST", 0.45, False, "zahlung_ausserhalb", [
        r"(erst|zuerst) (das )?geld,? (dann|danach|und dann) (die |der |das )?(ware|artikel|versand|schicke|verschicke|bekommst)",
        r"(geld|zahlung|bezahlung) (zuerst|vorab|im voraus)",
        r"(erst|zuerst) (zahlen|bezahlen|überweisen|die zahlung),? (dann|danach)",
        r"vorab (überweisen|zahlen|bezahlen|überweisung|zahlung)",
        r"reserv(iere|ieren|ierung).{0,30}(nur )?(gegen|mit|bei|nach) (anzahlung|vorkasse|überweisung)",
        r"anzahlung (von|in höhe)|\d+ ?(€|euro) anzahlung",
    ]),
    ("PICKUP_REFUSED", 0.35, False, "versandgeschichte", [
        r"(abholung|besichtigung|persönliche übergabe|selbstabholung|anschauen) (ist )?(leider )?(nicht|nicht mehr) möglich",
        r"keine (abholung|besichtigung|selbstabholung|persönliche übergabe)",
        r"kann (es |ihn |sie |das )?(leider )?nicht (persönlich )?(übergeben|vorbeibringen|zeigen)",
    ]),
    ("ANIMAL_TRANSPORT_FEE", 0.55, False, "versandgeschichte", [
        r"(transport|flug|impf|versicherungs|quarantäne|transportbox|tierarzt)[- ]?(kosten|gebühr|gebühren|versicherung).{0,60}(überweis|zahl|vorab|bezahl)",
        r"(welpe|welpen|kitten|kätzchen|hund|katze|tier)\w* (wird|werden|kommt|kommen) (per|mit) (flugzeug|flug|spedition|kurier|tiertransport)",
    ]),
    ("RENTAL_SCAM", 0.6, False, "andere_masche", [
        r"schlüssel(übergabe)?.{0,20}(per|mit der|über|via) (post|dhl|kurier|airbnb)",
        r"kaution.{0,40}(vorab|im voraus|vor der besichtigung|vor (der )?(übergabe|schlüsselübergabe))",
        r"(über|via) (airbnb|booking).{0,40}(abwickeln|buchen|bezahlen|zahlen|reservieren)",
        r"(wohnung|haus|zimmer|apartment).{0,80}(bin|lebe|wohne|arbeite) (derzeit |zurzeit |momentan |beruflich )?(im ausland|in (england|london|spanien|frankreich|italien|schottland|irland))",
        r"(bin|lebe|wohne|arbeite) (derzeit |zurzeit |momentan |beruflich )?(im ausland|in (england|london|spanien|frankreich|italien|schottland|irland)).{0,80}(wohnung|haus|zimmer|apartment|mieter)",
    ]),
    ("NEW_NUMBER_FAMILY", 0.6, False, "andere_masche", [
        r"(hallo|hi|hey) (mama|papa|mami|papi|mum|mutti).{0,80}(neue nummer|neues handy|handy (ist )?kaputt|alte nummer)",
        r"das ist meine neue (handy)?nummer",
        r"(handy|telefon) (ist )?(kaputt|ins wasser gefallen|verloren|gestohlen).{0,80}(neue nummer|überweis|rechnung)",
    ]),
    ("SAFE_ACCOUNT_SCAM", 0.8, True, "andere_masche", [
        r"(sicherungs|schutz)(konto|depot)",
        r"(bafin|europol|interpol|bundeskriminalamt|bka|polizei|staatsanwaltschaft).{0,80}(überweisen|überweisung|guthaben|vermögen) .{0,40}(konto|sichern)",
    ]),
    ("PAYMENT_CONTACT_REQUEST", 0.4, False, "datenabfrage", [
        r"(benötige|brauche|bräuchte|sende|senden sie|schick|schicken sie|gib|geben sie|nenn|nennen sie|teil|teilen sie)\w* (mir |uns )?(bitte )?(ihre|deine|eine|die) (gültige |aktuelle )?(e-?mail|mail|handy|telefon|tele)\w*.{0,60}(zahl|kauf|paypal|überweis|sicher)",
        r"(zahl|kauf|paypal|überweis)\w*.{0,40}(benötige|brauche|bräuchte|schick|gib|nenn|sende|teil)\w* (mir |uns )?(bitte )?(ihre|deine|eine|die) (gültige |aktuelle )?(e-?mail|mail|handy|telefon|tele)",
        r"((tele|handy)\w*nummer oder (e-?mail|mail)|(e-?mail|mail) oder (tele|handy)\w*nummer).{0,40}(zahl|kauf)",
        r"senden sie (ihre|deine) gültige (e-?mail|mail)",
    ]),
]

# Of each pattern above, in the same order: every text that matches holds one of these words or parts of words.
STEMS: dict[str, list[str]] = {
    "FAKE_PAYMENT_LINK": ["zahlung", "abholen empfangen freischalten", "klick", "scanne", "bestätigen eingeben verifizieren", "bestätigungs code nummer", "käuferschutz"],
    "OFFPLATFORM_PAYMENT": ["freunde", "friends", "money western", "google gutschein itunes paysafe steam", "bitcoin btc ethereum krypto usdt", "vorkasse", "überweisung"],
    "SHIPPING_OR_ESCROW_STORY": ["kurierdienst spedit transportunternehmen", "treuhand", "express sicher treuhand", "kurier", "versand"],
    "SELLER_ABROAD": ["ausland", "bohrinsel montage offshore", "ausland einsatz stationiert", "gezogen versetzt", "persönlich telefonieren vorbei"],
    "IDENTITY_PHISHING": ["ausweis", "ausweis", "video", "führerschein reisepass"],
    "OFFPLATFORM_CONTACT": ["messenger telegram whats wickr", "kontaktieren melden schreiben", "schreib", "nicht"],
    "PRESSURE_URGENCY": ["heute", "heute", "heute", "zuerst", "anfragen interessenten", "zahlung überweisung", "schnell", "frist stunden", "sonst", "anfragen interessenten käufer", "erste schnellste", "zahlen zahlst überweisen überweist", "letzte", "antworte melde zahle überweise", "schnell sofort umgehend"],
    "OVERPAYMENT_REVERSE": ["bezahlt überwiesen überzahl", "differenz", "zahle"],
    "TRIANGLE_FRAUD": ["zahlung", "bezahlen überweisen", "bekannten bruders freundes freundin schwester"],
    "TRANSLATED_PHRASING": ["hallo", "artikels", "artikel", "fehler kratzer probleme", "artikel", "kontaktiere", "geehrte"],
    "ACCOUNT_PHISHING": ["deaktiviert eingefroren eingeschränkt gelöscht gesperrt limitiert", "aktualisieren bestätigen verifizieren", "anmeldeversuch anmeldung ungewöhnliche verdächtige", "deaktivierung einschränkung löschung sperrung", "entsperren freischalten reaktivieren sichern", "geben tragen", "klick"],
    "PARCEL_CUSTOMS": ["angehalten zugestellt zurückgehalten zustellung", "gebühr", "liefer zustell"],
    "CODE_REQUEST": ["mir uns", "bekommen erhalten", "versehentlich"],
    "PAYMENT_PENDING_STORY": ["zahlung", "ausgezahlt freigegeben gutgeschrieben", "kaufbestätigung zahlungsbestätigung zahlungseingang", "abgeschlossen bezahlt gekauft überwiesen", "zahlung", "reserv"],
    "ADVANCE_FEE_SPAM": ["gewinn gewonnen herzlichen", "erbschaft nachlass verstorbene", "krypto passives rendite", "aktivierungsgebühr bearbeitungsgebühr freischaltgebühr", "gewinner gewinnspiel", "verdienen werden"],
    "BUYER_NO_QUESTIONS": ["anschau ansehen besichtig", "zahlen zahlung überweisen", "versand", "nummer"],
    "PAYMENT_FIRST": ["erst", "vorab voraus zuerst", "zahlen zahlung überweisen", "vorab", "anzahlung vorkasse überweisung", "anzahlung"],
    "PICKUP_REFUSED": ["möglich", "abholung besichtigung persönliche", "vorbeibringen zeigen übergeben"],
    "ANIMAL_TRANSPORT_FEE": ["gebühr kosten versicherung", "kommen kommt werden wird"],
    "RENTAL_SCAM": ["schlüssel", "kaution", "airbnb booking", "ausland england frankreich irland italien london schottland spanien", "ausland england frankreich irland italien london schottland spanien"],
    "NEW_NUMBER_FAMILY": ["kaputt neues nummer", "nummer", "nummer rechnung überweis"],
    "SAFE_ACCOUNT_SCAM": ["schutz sicherungs", "guthaben vermögen überweisen überweisung"],
    "PAYMENT_CONTACT_REQUEST": ["handy mail tele", "handy mail tele", "nummer", "gültige"],
}
