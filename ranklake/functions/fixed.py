"""Fixed values that results depend on: vocabularies, patterns and constants. Patterns are Java regular expressions."""

# --- fixed values -----------------------------------------------------------------------------

STATUSES = ("ok", "dnf", "dsq", "mp", "dns", "unknown")

API_STATUS = {
    "classified": "ok",
    "notClassified": "unknown",
    "didNotFinish": "dnf",
    "disqualified": "dsq",
    "missingPunch": "mp",
    "didNotStart": "dns",
    "overTime": "dsq",
}

#: Phrases of the result column, in order; keys of up to three characters must be whole tokens.
STATUS_PHRASES = {
    "aufg": "dnf", "aufgegeben": "dnf", "not finish": "dnf", "vzdal": "dnf",
    "nfb": "dnf", "n.i": "dns", "n.a": "dns", "nem indult": "dns", "hiba": "mp", "verletzt": "dnf",
    "techn. fehler": "dnf", "technischer fehler": "dnf",
    "fehlst": "mp", "ehlst": "mp", "fehlstempel": "mp", "nok": "mp",
    "missing punch": "mp", "posten fehlt": "mp", "posten fehlen": "mp", "posten falsch": "mp",
    "po fehlt": "mp", "po falsch": "mp", "falsche karte": "mp",
    "punz. errata": "mp", "punz. mancante": "mp", "po.f": "mp", "ziel fehlt": "mp",
    "dis": "dsq", "disq": "dsq", "disqu": "dsq", "disqualifiziert": "dsq", "dq": "dsq", "disk": "dsq",
    "n. angetr.": "dns", "n.angetr.": "dns", "nicht angetreten": "dns", "n ang": "dns", "n.ang": "dns",
    "nicht ang": "dns", "ang": "dns", "apng": "dns", "n.gest": "dns", "nicht gestartet": "dns", "omt": "dns",
    "non partito": "dns", "ritirato": "dnf", "incompleta": "dnf", "fuori tempo max": "dsq",
    "gut": "ok", "super gelaufen": "ok", "teilg": "ok", "teilgenommen": "ok",
    "zeitüb": "dsq", "zeit�b": "dsq", "zeitï¿½b": "dsq", "zeitüberschreitung": "dsq", "maximalzeit": "dsq",
    "keine zielzeit": "dnf", "keine e-card": "dns",
    "ohne wertung": "ok", "außer konkurrenz": "ok", "ausser konkurrenz": "ok", "wertungsfrei": "ok",
    "ak": "ok", "nc": "ok", "ok": "ok", "dnf": "dnf", "dns": "dns", "dsq": "dsq", "mp": "mp",
}

#: Whole raw values of older files, where nothing else gave a status.
LEGACY_STATUS = (
    (r"omt\.?", "dns"), (r"(?:n\.?\s*)?ang\.?", "dns"), (r"missing\s+punch", "mp"),
    (r"\d+\s+posten\s+fehl(?:t|en)", "mp"), (r"ziel\s+fehlt", "mp"), (r"not\s+finish(?:ed)?", "dnf"),
    (r"verletzt", "dnf"), (r"dis\.?", "dsq"), (r"teilgenommen", "ok"),
)

LIVE_STATUS = {0: "ok", 1: "dns", 2: "dnf", 3: "mp", 4: "dsq", 5: "dsq", 9: "dns", 10: "dns", 11: "dns"}

TEAM_STATUS_ORDER = ("unknown", "ok", "dns", "dnf", "mp", "dsq")

OOC_TEXT = r"(?iu)^(?:ak|au(?:ß|ss)er konkurrenz|ohne wertung|wertungsfrei)$"
OOC_ANYWHERE = r"(?iu)(?:^|\b)(?:A\.?\s*K\.?|NC|au(?:ß|ss)er konkurrenz|ohne wertung|wertungsfrei)(?:\b|$)"
OOC_TIME = r"^\(\s*\d{1,3}:\d{2}(?::\d{2})?\s*\)$"
CONTROL_NOTE = r"(?U)\b(?:nr\.?\s*\d+|posten\s*\d*)\s+(?:fehlt|falsch)\b"
QUALITATIVE = r"(?iu)(?:(?:sehr\s+)?gut|teilg|(?:erfolgreich\s+)?teilgenommen)\s*$"
QUALITATIVE_OK = r"(?iu)(?:(?:sehr\s+)?gut|super\s+gelaufen!?|ok|teilg\.?|(?:erfolgreich\s+)?teilgenommen)\s*$"

FAMILY = r"(?iu)(?:\bfam(?:ilie|ily|iliy)?\b|familien|rahmenbewerb\s+familie)"
AMBIGUOUS_FAMILY = r"(?iu)^(?:AT-)?F$"

CLUB_JUNK_PREFIX = r"(?iu)^(?:empty|leer|vacant|frei|\.)\s+"
CLUB_NUMBER_SUFFIX = r"^(.+)\s(\d+)$"
CLUB_CODE_PREFIX = r"^([A-Za-zÄÖÜäöüß]{2,6})\s+(.+)$"
CLUB_ABBREVIATED = r"^NF\s*(.+)$"
CORRUPT_CLUB = r"^\d{1,3}:\d{2}:\d{2}\s+\d+$"
POINTS_CLUB = r"(?iu)\b-?\d+\s*p\.\s*$"
RUN_LABEL = r"(?iu)\b\d+\.\s*Lauf\b"

NAME_FORBIDDEN = r"[<>={}\[\]|;#&%\\/?*]"
NAME_CHROME = r"(?iu)^(?:seite\s+\d+|sportsoftware(?:\s+\d+)?)$"
NAME_ANNOTATION = (
    r"(?iuU)(^&|^und\b|\bcup\b|\b(19|20)\d\d\b|"
    r"(staats|sprint|österr|öster|nieder|steir|kärnt|tirol|salzb|vorarl|burgenl|wr\.?|nö|wien|jugend|schüler)\w*\.?\s*(sprint)?meister)"
)
NAME_VACANT = r"(?iu)^(?:vakant|vacant|n\.?\s*n\.?)$"
RELAY_PLACEHOLDER = r"(?iu)^n\.?\s*n\.?(?:\s+(?:n\.?\s*n\.?|n\s*ang))?$"
SLAVIC_SURNAME = r"(?iu)ov[áa]$"

ELITE = r"(?iu)\belite\b|allgemeine\s*klasse|staatsmeisterschaft|(?<!\d)(1[6-9]|2[01])-?e(?![a-zäöü0-9])"
SPECIAL_OPEN = r"(?iu)^allgemein$|mixed\s+(jugend|masters)"
CATEGORY_NUMBER = r"(?<!\d)(\d{1,3})(?!\d)"
EXCLUDED_CATEGORY = (
    r"(?iuU)^cz-|\(cze\)|\bbahn\b|neuling|familie|ultimate|hobby|schnupper|mannschaft|\bak\b|gesamt(?!alter)|"
    r"anf[aä]nger|\bdirekt\b|ohne\s*wertung|training|einsteiger|jedermann|fun\b|\bkurz\b|\boffen\b|"
    r"viertelfinal|halbfinale|b-finale|\d-[kl]\b"
)
AGE_OVERLAP = r"(?iuU)(?<!\d)21\s*-?\s*(?:k(?:urz)?|l(?:ang)?)\b|(?<!\d)15\s*-\s*18\b|\bab\s*15\s*bis\s*18\b"
YOUTH_TITLE = r"(?iu)jugend"
FROM_AGE = r"(?iuU)\bab\s*\d+\b"
SENIOR_TITLE = r"(?iuU)\bsen(?:ioren)?\b"

TITLE_COMBINED = r"(?iu)ö\(st\)m"
TITLE_STATE = r"(?iu)ö[–-]?\(?st\)?m"
TITLE_OPEN = r"(?iu)(?<![a-zäöüß])ö[–-]?m(?![a-zäöüß])"
TITLE_STATE_SPELLED = r"(?iuU)\bstaats?meister|(?<![a-z0-9])oe?[–-]?stm(?![a-z0-9])"
TITLE_OPEN_SPELLED = r"(?iuU)\böster(?:r|reich\w*)?\.?\s*meister|(?<![a-z0-9])oe[–-]?m(?![a-z0-9])"
SLUG_STATE = r"(?iu)(?<![a-z0-9])ostm(?![a-z0-9])"
SLUG_OPEN = r"(?iu)(?<![a-z0-9])om(?![a-z0-9])"

CHAMPION_LEAD = r"(?iu)^(\d+)\.?(?:\s+\d+)*\s+(?:und|&)\s+(.+)$"
CHAMPION_ALONE = r"(?iuU)^(\d+)\.?\s+(öster(?:r|reich\w*)?\.?\s+(?:staats?)?meister(?:in(?:nen)?)?)\s*$"
CHAMPION_NAME_PREFIX = r"(?iuU)^(öster(?:r|reich\w*)?\.?\s+(?:staats?)?meister(?:in)?)\s+(?=\S)"
STATE_CHAMPION = r"(?iuU)\bstaats?meister"
OPEN_CHAMPION = r"(?iuU)\böster(?:r|reich\w*)?\.?\s*meister"
STATE_ABBREVIATION = r"(?iuU)\bö\(?st\)?m\b"
OPEN_ABBREVIATION = r"(?iu)(?<![a-zäöüß])öm(?![a-zäöüß])"

#: What a document's name, text or head (its first 4,000 characters) says about its kind, in order; a kind, whether a sole
#: document is exempt, and the alternatives, each a set of patterns that must all be found.
LIST_TYPE_RULES = (
    ("race", False, ((("head", r"(?iuU)\bPl\s+\w*\s*Name\s+.*\bVerein\s+Kat\s+Zeit\b"),), (("head", r"(?iuU)\bPl\s+(?:Stnr\s+)?Name\s+Verein\s+Zeit\b"),))),
    ("race", False, ((("head", r"(?iusU)ERGEBNISSE\s+SURPISE\s+MANNSCHAFT.*TEAMWERTUNG"),),)),
    ("overall", True, ((("name", r"(?iu)(?:^|[-_])si[-_]"),),)),
    ("overall", False, ((("name", r"(?iuU)(?:^|[-_ ])bericht(?:[-_ .]|$)|\breport\b"),),)),
    ("overall", False, ((("name", r"(?iu)(?:zwischen|zw)zeit|split|reszidos|erg(?:ebnis)?[-_]?bahnen"),), (("head", r"(?U)\bZwischenzeiten\b"),))),
    ("overall", False, ((("text", r"(?iuU)<th\b[^>]*>\s*N1\s*</th>"), ("text", r"(?iuU)<th\b[^>]*>\s*N2\s*</th>")),)),
    ("race", False, ((("name", r"(?iu)einzel|individual"),),)),
    ("race", False, ((("name", r"(?iu)wiener[-_ ]?wertung"),),)),
    ("race", False, ((("name", r"(?iuU)meisterschafts[-_ ]?wertung|(?:Ö|OE)[-_ ]?(?:ST)?M\b|österreich\w*\s+(?:staats)?meister"),),)),
    ("relay", False, ((("name", r"(?iu)staffel|relay"),),)),
    ("relay", False, ((("text", r"(?iuU)<th\b[^>]*>\s*Staffel\s*</th>"),), (("text", r"(?iuU)<th\b[^>]*>\s*Team\s*</th>"), ("text", r"(?iuU)<th\b[^>]*>\s*Leg\s*</th>")))),
    ("overall", True, ((("name", r"(?iu)gesamt|wertung|overall|endergebnis.*(?:lauf|läuf)"),), (("head", r"(?iuU)Gesamt(?:wertung|-Ergebnis)|Overall\s+results?|Endergebnis\s+nach\s+dem\s+\d+\.?\s*Lauf"),))),
)

#: How relay labels abbreviate clubs, after folding: pattern and what it becomes, in order.
RELAY_CLUB_FOLDS = (
    (r"\bnaturfreunde\b", "nf"), (r"\blaufklub\s+kompass\b", "lk"), (r"\basko\s+henndorf\s+orienteering\b", "ahdo"),
    (r"\bwiener\b", "wr"), (r"\bneustadt\b", "neust"), (r"\bkitzbuhl\b", "kitzbuhel"),
    (r"\borienteering\b|\boriente\b", ""), (r"\bol\b", ""), (r"\boc\s+furstenfeld\b", "ocff"),
)

#: Texts in a name's place that are page furniture or open places, besides those of digits and marks only.
JUNK_NAME_PATTERNS = (r"(?iuU)^Etappe\s+\d+\b", r"(?iuU)^Results\s*\(\s*stage\b", r"(?iu)^Bib\.?\s+Name$", r"(?iu)^mit\s+weniger$")
JUNK_NAME = r"^[\d\s:.,()/-]*$"
JUNK_NAMES = (
    "empty", "vacant", "leer", "frei", "orientierungslauf-club", "orientierungslauf club", "austria cup",
    "mittel ms", "nolv schulcup ternitz wed", "mtbo world cup", "sg mtbo 2019 - wre",
)

RANKING_ATTACHMENT = r"(?iu)meisterschafts[-_ ]?wertung"
RESULT_ATTACHMENT = r"(?iu)(?:ergebnis(?:se|liste)?|results?|gesamtwertung|(?:^|[-_ ])(?:oe|o|ö)(?:st)?m[-_ ].*[-_ ]erg(?:ebnis)?(?:[-_. ]|$))"
OTHER_ATTACHMENT = r"(?iu)(?:split|zwischenzeit|reszidos|bahndat|meldung|startlist|startzeit|einladung|ausschreibung|l[aä]uferinfo|wettkampfinfo|bulletin|protokoll)"
AUXILIARY_ATTACHMENT = (
    r"(?iuU)(?:^|[-_ ])bericht(?:[-_ .]|$)|\breport\b|(?:zwischen|zw)zeit|split|reszidos|erg(?:ebnis)?[-_]?bahnen|"
    r"\bbahn(?:en)?(?:daten|liste)?\b"
)
COURSE_LIST = r"(?iu)^bahn"
HEAT = r"(?iu)viertelfinale|halbfinale|b-finale"
JUNK_DOCUMENT = r"(?i)-split\.|results-after-e\d+"
COURSE_VIEW = r"(?i)(?:nach[\s._-]*bahnen|by[\s._-]*courses?)"
STAGE_TITLE = r"(?iuU)^(.*?)\s-\s*Ergebnis(?:\s+nach\s+\w+)?\b\s*-?\s*(.*)$"
DOCUMENT_NAME = r"^\d+-(?:club)?\d+\.json$"

REGIONS = {"WIEN": "Wien", "NOE": "Niederösterreich", "BGLD": "Burgenland", "STMK": "Steiermark", "OOE": "Oberösterreich", "SBG": "Salzburg", "TIR": "Tirol", "KTN": "Kärnten", "VBG": "Vorarlberg"}
REGION_PATTERNS = {
    "WIEN": r"(?iuU)\b(?:wien(?:er|erinnen)?|wr\.?)\b",
    "NOE": r"(?iuU)\b(?:n(?:ö|oe)\.?|niederösterreich(?:isch(?:e[rsn]?)?)?)\b",
    "BGLD": r"(?iuU)\b(?:bgld\.?|burgenländ(?:isch(?:e[rsn]?)?)?|burgenland)\b",
    "STMK": r"(?iuU)\b(?:stmk\.?|steir(?:isch(?:e[rsn]?)?)?|steiermark)\b",
    "OOE": r"(?iuU)\b(?:o(?:ö|oe)\.?|oberösterreich(?:isch(?:e[rsn]?)?)?)\b",
    "SBG": r"(?iuU)\b(?:sbg\.?|salzburg(?:er|isch(?:e[rsn]?)?)?)\b",
    "TIR": r"(?iuU)\b(?:tirol(?:er|erisch(?:e[rsn]?)?)?)\b",
    "KTN": r"(?iuU)\b(?:ktn\.?|kärnt(?:en|ner|nerisch(?:e[rsn]?)?))\b",
    "VBG": r"(?iuU)\b(?:vbg\.?|vorarlberg(?:er|isch(?:e[rsn]?)?)?)\b",
}
REGION_COMPACT = {"W": "WIEN", "N": "NOE", "B": "BGLD", "ST": "STMK", "O": "OOE", "S": "SBG", "T": "TIR", "K": "KTN", "V": "VBG"}
REGION_NATION_CODES = {"w": "WIEN", "nö": "NOE", "noe": "NOE", "b": "BGLD", "st": "STMK"}
REGIONAL_TITLE = r"(?iuU)(?:\b(?:lm|lms|ms|km)\b|meisterschaft|landesmeister|landes[- ]?ms)"
REGIONAL_FRAME = r"(?iu)(?:rahmen(?:bewerb)?|gäste?|offen|neu(?:ling(?:e)?)?|fam(?:il(?:ie|ien|y)|iliy)?|kids?|kinderfähnchen|bahn|lyceum)"
CITY_NOT_REGION = r"(?iu)wiener\s+neust(?:adt|ädter)"
#: What is no region's name or code in a title, and what it becomes: the city, national titles, disciplines, matches of regions, dotted codes.
REGION_NOISE = (
    (CITY_NOT_REGION, ""),
    (r"(?iuU)\b(?:Ö|OE)\s*\(\s*ST\s*\)\s*M\b|\b(?:Ö|OE)\s*ST\s*M\b|\b(?:Ö|OE)\s*M\b", ""),
    (r"(?iuU)\b(?:Ski|MTB)\s*[- ]\s*O\b", ""),
    (r"(?iuU)\bLänder(?:vergleich|kampf)\b[^,/;]*", ""),
    (r"(?iuU)\bN\s*\.\s*Ö\b", "NÖ"),
    (r"(?iuU)\bO\s*\.\s*Ö\b", "OÖ"),
)
REGION_CODE_ALONE = r"((?<![A-Za-z])(?:W|N|ST|O|S|T|K|V)(?![A-Za-z])|(?<![A-Za-z0-9])B(?![A-Za-z]))"
#: Where a code may stand in a class: before a gender, behind an age, or in brackets.
REGION_CODE_BEFORE = r"^\s*(ST|W|N|B|O|S|T|K|V)\s+(?=(?:D(?:AMEN)?|H(?:ERREN)?)(?:\b|[-\d]))"
REGION_CODE_BEHIND = r"(?:D(?:AMEN)?|H(?:ERREN)?)\s*-?\s*\d[^/]*?[-, ]\s*(ST|W|N|B|O|S|T|K|V)\s*$"
REGION_CODE_JOINED = r"(?:D(?:AMEN)?|H(?:ERREN)?)\s*-?\s*\d+\s*(ST|W|N|B|O|S|T|K|V)\s*$"
REGION_CODE_INSIDE = r"(?<![A-Z0-9])(ST|W|N|B|O|S|T|K|V)(?![A-Z])"
REGION_SEGMENT = r"(?iu)/(?=\s*(?:D(?:amen)?|H(?:erren)?)\s*-?\s*\d)"
#: What stands before and behind a code that a class drops; and the mark of a class that has no region.
REGION_CODE_AROUND = (
    (r"^\s*(?:", r")\s+(?=(?:D(?:amen)?|H(?:erren)?)(?:\b|[-\d]))"),
    (r"(?<![A-Za-z0-9])(?:", r")(?![A-Za-z])"),
    (r"(?<=\d)\s*-?\s*(?:", r")\s*$"),
)
REGION_RUNDEN = r"(?iu)(?<=\d)\s*-?\s*R\s*$"
COURSE_CLASS = r"(?i)^(?:bahn|course)\s+\d+\b"
CANCELLED_CLASS = r"(?i)\b(?:annulliert|annulled|cancelled|canceled)\b"
ROUND_NUMBERS = (r"(?i)(\d+)\.\s*(?:lauf|etappe|tag)", r"(?i)(?:etappe|stage|tag)\s*(\d+)", r"(?i)(?:^|[-_ ])e(\d)(?:[-_. ]|$)")
RELAY_HEAD_LINES = r"^(?:Pl(?:atz)?\b.*(?:Staffel|Team|Verein|Mannschaft).*(?:Zeit|Time)\b|Name\b.*(?:Zeit|Time|Jg)\b)"
REGION_DIVISION = r"(?iu)\d\s*-?\s*([AB])(?:\s*-|\s*$)"
REGION_GENDERS = (
    (r"(?iuU)^(?:Damen\s*\+?&?\s*Herren|Herren\s*\+?&?\s*Damen)\b", "DH"),
    (r"(?iu)^Damen(?=[\s\d-])", "D"),
    (r"(?iu)^Herren(?=[\s\d-])", "H"),
    (r"(?iuU)^(?:D\s*\+\s*H|H\s*\+\s*D)\b", "DH"),
)
REGION_DOCUMENT = {"WIEN": r"(?iu)wien(?:er)?[-_ ]?wertung|wr[-_ ]?wertung", "NOE": r"(?iu)n(?:ö|oe)[-_ ]?wertung|niederösterreich[-_ ]?wertung", "BGLD": r"(?iu)bgld[-_ ]?wertung|burgenland[-_ ]?wertung"}
REGION_FOREIGN = r"(?iu)(?:^|[-_/()\s])(?:SLO|SVN|CZE|CZ|SVK|HUN|GER|DEU|ITA|FIN|POL|CRO|HRV|SUI|CHE)(?:$|[-_/()\s])"
REGION_NO_STATE = r"(?iu)^\s*[MW]\s*-?\s*\d|^\s*N\s*$|^\s*AT-(?:N|F|OFF(?:-L)?)\s*$|^\s*R(?:\s|[-_])"
REGION_NO_TITLE = r"(?iu)Schul|Vereinsmeister"
NOT_CITY_TITLE = r"(?iu)Wiener\s+Neust(?:adt|ädter)|Schul|Vereinsmeister"
REGION_EAST_TITLE = r"(?iuU)\bLM\s+Nacht\s*\(?\s*Ost\s*\)?"
REGION_EAST = ("WIEN", "NOE", "BGLD", "STMK")
#: How a regional class is announced.
REGION_PREFIX = {"WIEN": "Wien", "NOE": "NÖ", "BGLD": "Burgenland", "STMK": "Steiermark", "OOE": "OÖ", "SBG": "Salzburg", "TIR": "Tirol", "KTN": "Kärnten", "VBG": "Vorarlberg"}
GUEST_CODE = r"^[0-9]{4} - "
GUEST_TEAM = r"(?iu)^AA "
GUEST_TEAM_HOME = r"(?iu)^AA .*(?:kärnten|steiermark)"
CLUBLESS = r"(?iu)vereins?los|verienslos|kein\s*verein|ohne\s*verein|no\s*club|club[- ]?less|individuals?\s*/\s*no\s*club"

EVIDENCE_ORDER = {"source_nat": 4, "document": 3, "category": 2, "event_title": 1}
IDENTITY_CONFIDENCE = {"registry_year": 0.99, "registry_club": 0.95, "with_year": 0.75, "without_year": 0.55, "direct": 1.0}
SEVERITY_WEIGHT = {"blocker": 10000, "warning": 100, "info": 1}
OWNER_WEIGHT = {"parser": 50, "rules": 30, "review": 5, "source": 2}
MEDALS = {1: "gold", 2: "silver", 3: "bronze"}
EVENT_STAGE_BASE, DATED_STAGE_BASE, MAPPED_STAGE_BASE = 10_000_000, 20_000_000, 30_000_000
SYNTHETIC_ID_BITS = 62
MAX_CORE_DROP = 0.02
BIRTH_YEAR_PIVOT = 26
SKI = "skiOrienteering"

# --- end of fixed values ----------------------------------------------------------------------
