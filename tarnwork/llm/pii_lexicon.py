"""Fixed word lists of the personal-information finder, and grammars built from them.

The lists are ordinary vocabulary: given names of several languages, common nouns and adjectives that form
code names, street words, function words that begin sentences. They only feed features and grammars; what
counts as personal is decided by the trained field.
"""

from __future__ import annotations

# Given names in use in Europe, the Americas, Africa and Asia.
GIVEN = set(
    """
    aaron abel adam adrian agnes ahmed aiko alan albert alejandro alexander alice amara amelie amina ana anders andrea andreas angela
    anna anneke antoine antonio arjun astrid audrey bashir beatriz ben bjorn bruno callum camille carla carlos carmen caroline chidi
    chloe clara claire corin daniel david diego dmitri elena elias elif emeka emil emily emma eric erik esther eva fatima felix finn
    florian francois freya gabriel george giulia greta gustav gwen hanna hanne hans hassan hazel helen henrik henry hiroshi ibrahim
    ida ilse ines ingrid isabel ivan jack jakob james jan jane javier jean jens joao johan john jonas joost jorge jose julia julie
    karim karin katarina kofi laila lars laura leif lena leo linnea lorcan louis lucas lucia luis lukas maja marco marek marguerite
    maria marie mark marta martin mary matteo max mei mia michael miguel mira mohamed nadia nils noah noor odile olga oliver olivia
    omar oskar owen pablo paloma pascal paul paula pedro peter petra philipp pierre priya rafael ravi rosa rowan ruben samuel sara
    saskia sofia solveig sophie stefan sunniva susan tariq teo thandi thomas tobias ulla vesna wanjiru yara yuki zoe
    """.split()
)

# Common English words that form names of projects, boards and releases.
CODE = set(
    """
    alpha amber anchor arrow atlas audit autumn beacon beta black blue board brass bridge bronze brook canyon capture case cases castle
    cedar cinder circle cloud comet compass copper coral core crown delta desk draft dragon dune eagle east echo ember engine falcon
    field fire first flame forest forge fox frost galaxy gamma garden gate glacier gold golden granite gray green grove hammer harbor
    harvest hawk horizon index iron island jade job juniper lake lantern last ledger light line lion long maple marble marl meadow
    merge mesa mill mirror mist moon morning mountain new night north note notes nova oak ocean office old olive open orbit orchid
    owl palm panel pass path pearl phoenix pilot pine plan point pool portal prairie project prune pulse quay queue quiet rain rank
    raven reader red reef release report ridge river road rock round ruby runner sage sand sapphire sea second session shadow
    shield signal silver sky slate snow solar south spark spring sprint star steel step storm stream summer summit sun sunset swift
    table team third thunder tide tiger titan torch tower trail tree tundra valley vault velvet wave west white wild willow window wind
    winter wolf wood yellow zenith carlo monte york city bay street station group works labs lab index
    """.split()
)

# Days of the week, which open dates rather than names.
DAYS = set("mon tue tues wed thu thur thurs fri sat sun monday tuesday wednesday thursday friday saturday sunday montag dienstag mittwoch donnerstag freitag samstag sonntag lundi mardi mercredi jeudi vendredi samedi dimanche lunes martes miercoles jueves viernes sabado domingo".split())

# Abbreviations of "number", which end labels rather than names.
NUMBER_WORDS = set("nr no num number nummer numero numéro".split())

# Those of the above that are family names as well.
SURNAME_NOUNS = set("ash banks beck bell brook bush castle cross day dean fields field flint flood ford forest fox frost garden green grove hill hunt lake lane love marsh moon north oak park pearl pond rain rivers rock rose sand snow spring stone street summer summers swift west winter winters white wolf wood woods young black brown gray".split())

# Words that often begin a sentence or a field without belonging to a name.
STARTERS = set(
    """
    a according after all also alle als am an and anschrift are as ask at auf aus because before bei bitte but by call can cc ce
    certains ces checksum com como con copy could dans das date de deliver delivered-to dem den der des deux di did die dies dos drei
    du each ein eine el elle els en er erst es esta est et every falta fax fehler few for forwarded from für gab gave get had hat has
    have he hello her here hi his how however i ich if il ils im in into is isn it its je la las le les livrer llame llámame looks los
    mail mais many may me merci mi mit more most my nach name new next nicht no non not nothing now nur of on one only open or our
    owner parcel pair pero pinned please por pour preguntar puis quand que qui rappeler redact reply-to reviewed-by row run
    sans see seit send session several she ship sie signed-off-by since so some sobre sur tel tests thanks that the their then there
    these they this those three ticket to todo tous two un una und une unless until user vom von vor was we were what when where
    which while who whatsapp why will wir with without would write écrire y yes you your zu zum zur
    """.split()
)

# Forms of address, which aren't part of a name.
TITLES = set("mr mrs ms miss dr prof professor sir herr frau mme mlle monsieur madame m sr sra don doña dra ing dipl".split())

# Particles inside family names.
PARTICLES = ["van der", "van den", "van de", "de la", "de las", "de los", "von der", "von und zu", "auf der", "van", "von", "vom", "zu", "zum", "zur", "de", "da", "del", "della", "dos", "das", "di", "du", "des", "der", "den", "la", "le", "ter", "ten", "af", "av", "al", "el", "bin", "ibn", "ben", "st."]

# Words that label numbers of a person's documents.
ID_LABELS = [
    r"ssn\b", r"social security", r"soc\. ?sec", r"passport", r"reisepass", r"passeport", r"pasaporte", r"steuer-?id", r"steuer-?identifikationsnummer", r"steuernummer", r"tax ?(?:id|number|no)", r"tin\b", r"\bnif\b", r"\bdni\b", r"\bnie\b",
    r"identity card", r"id card", r"identit(?:y|é|é)", r"identidad", r"personalausweis", r"ausweis", r"carte d.identit", r"national[_ ]?id", r"national insurance", r"ni number", r"licen[cs]e", r"führerschein", r"permis de conduire", r"permis\b", r"carn[eé]t? de conducir", r"permiso de conducir", r"numéro fiscal", r"num[eé]ro de s[eé]curit", r"n° de s[eé]curit", r"s[eé]curit[eé] sociale", r"seguridad social", r"sozialversicherung", r"\bnir\b", r"insee", r"id[_ ]?number", r"id no\b",
]

# Words near telephone numbers.
PHONE_LABELS = [r"\btel\b", r"phone", r"\bcall\b", r"mobile", r"handy", r"fax", r"whatsapp", r"\bsms\b", r"rappel", r"appel", r"ll[aá]m", r"nummer", r"numbers?\b", r"\bcell\b", r"rufnummer", r"anruf", r"teléfono", r"téléphone", r"telefon", r"reach", r"ring\b", r"text me", r"móvil", r"portable", r"\bat\b", r"office"]

# English street words, German endings and openings, French and Spanish openings.
STREET_EN = "Street|St|Road|Rd|Avenue|Ave|Lane|Ln|Drive|Dr|Court|Ct|Close|Boulevard|Blvd|Quay|Place|Pl|Way|Terrace|Crescent|Square|Sq|Row|Walk|Gardens|Parade|Highway|Hwy|Parkway|Pkwy|Circle|Cir|Mews|Alley|Trail|Grove|Hill"
STREET_DE = "straße|strasse|str\\.|gasse|platz|weg|allee|damm|ufer|ring|steig|markt|graben|chaussee|promenade"
STREET_DE_OPEN = "Am|An der|Auf der|Auf dem|Im|In der|Zum|Zur|Unter den|Hinter der|Alte|Neue"
STREET_FR = "rue|avenue|av\\.|boulevard|bd|place|chemin|impasse|quai|allée|allee|cours|square|passage|route|sentier|faubourg|villa"
STREET_ES = "Calle|C/|Avda\\.|Av\\.|Avenida|Plaza|Pza\\.|Paseo|Pº|Camino|Carretera|Ctra\\.|Ronda|Travesía|Glorieta|Callejón"
