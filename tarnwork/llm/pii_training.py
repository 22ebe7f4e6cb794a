"""Generated sentences with known personal items, on which the field is fitted.

Texts, families, streets and numbers are composed at random (fixed seed) from word lists and syllables; half
of the sentences hold look-alikes: versions, tickets, dates, job numbers, remotes, packages and code names.
"""

from __future__ import annotations

import base64
import os
import random
from functools import lru_cache

from tarnwork.llm import pii_lexicon as L
from tarnwork.llm.pii_field import LABELS, Field, fit
from tarnwork.llm.pii_lexer import candidates
from tarnwork.llm.tokens import DEFAULT_RANKS

SIZE = 4000
#: A vocabulary of many languages.
MANY_LANGUAGES = DEFAULT_RANKS.replace("byte_bpe_50k", "byte_bpe_multi_50k")
_SYLLABLES = "bar bel cor dan del dor eck fan gal gar hal han hol kar kel lan lor mar mel mon nor ost pel qui ran ros sel sor tal tor ul van ver wal wen yar zel".split()
_PLAIN = "loader export import renderer brief retrieval floor parser cache planner query build table column second nightly slow fast wants fewer more rows still needs runs keeps reads every value test tests wrong right empty long short left over twice again schnell langsam deutlich neue alte Zeilen läuft wieder schon fertig leer nouvelle vieille ligne lignes vide toujours encore lente prête nueva vieja línea tabla vacía siempre lenta lista sigue release names left review notes items fails failed waits counts".split()
_ENDS = "berg bury by dale dorf er feld ford gaard holm ier in ini is ley man mann mere moor nen o off ova quist ridge sen ska son stad stein strand ton vic ville worth".split()


class Maker:
    def __init__(self, seed: int) -> None:
        self.r = random.Random(seed)

    def pick(self, *options: str) -> str:
        return self.r.choice(options)

    def digits(self, n: int, first: str = "0123456789") -> str:
        return self.r.choice(first) + "".join(self.r.choice("0123456789") for _ in range(n - 1))

    def family(self) -> str:
        r = self.r
        if r.random() < 0.12:
            return r.choice(sorted(L.SURNAME_NOUNS)).capitalize()
        if r.random() < 0.04:
            return r.choice(_SYLLABLES).capitalize()
        word = "".join(r.choice(_SYLLABLES) for _ in range(r.choice((1, 1, 2)))).capitalize() + r.choice(_ENDS)
        if r.random() < 0.12:
            word += "-" + r.choice(_SYLLABLES).capitalize() + r.choice(_ENDS)
        return r.choice(("", "", "", "", "", "O'", "Mac", "Mc", "Ö", "Sz")) + word if r.random() < 0.2 else word

    def given(self) -> str:
        if self.r.random() < 0.35:
            return (self.pick("", "", self.r.choice(_SYLLABLES)) + self.r.choice(_SYLLABLES) + self.r.choice(("a", "o", "is", "ine", "el", "ya", "en", "an", "us", "ka", "win"))).capitalize()
        return self.r.choice(sorted(L.GIVEN)).capitalize()

    def name(self) -> tuple[str, str, str]:
        r, g, f = self.r, self.given(), self.family()
        full = f
        if r.random() < 0.15:
            full = self.pick("van der", "de la", "von", "da", "de", "van", "del", "dos", "di", "du") + " " + f
        style = r.random()
        if style < 0.1:
            text = f"{g[0]}. {full}"
        elif style < 0.2:
            text = f"{g} {r.choice('ABCDEFGHJKLMNPRST')}. {full}"
        elif style < 0.3:
            text = f"{full}, {g}"
        elif style < 0.38:
            text = f"{g} {full}".upper()
        elif style < 0.4:
            text = f"{g} {f}".lower()
        else:
            text = f"{g} {full}"
        return (text.lower() if r.random() < 0.2 else text), g, f

    def prose(self) -> str:
        """Neighbouring lower-case words that name nobody."""
        return " ".join(self.r.choice(_PLAIN) for _ in range(self.pick(2, 2, 3, 4))).lower()

    def code(self) -> str:
        words = sorted(L.CODE)
        objects = sorted(L.CODE - L.SURNAME_NOUNS)
        return (self.pick(self.r.choice(words), self.r.choice(words), self.r.choice(words), self.r.choice(_SYLLABLES) + self.r.choice(_ENDS), self.pick("rowan", "hazel", "olive", "ruby", "jade", "amber", "iris")) + " " + self.r.choice(objects)).title()

    def phone(self) -> str:
        d, p = self.digits, self.pick
        a, b = p(" ", "-", "."), p(" ", "-", ".")
        out = p(
            f"({d(3, '23456789')}) {d(3, '23456789')}-{d(4)}", f"{d(3, '23456789')}{a}{d(3, '23456789')}{a}{d(4)}", f"+1{a}{d(3, '23456789')}{a}{d(3)}{a}{d(4)}", f"1 ({d(3, '23456789')}) {d(3)} {d(4)}",
            f"+44 {d(4, '7')} {d(6)}", f"+44 (0){d(4, '7')} {d(3)} {d(3)}", f"0044 {d(4, '7')} {d(6)}", f"0{d(4, '7')} {d(6)}", f"0{d(10, '7')}", f"+44{d(10, '7')}",
            f"+49 {d(2)} {d(5)} {d(3)}", f"+49 (0){d(2)} {d(8)}", f"(0{d(2)}) {d(5)} {d(3)}", f"0{d(2)} / {d(5)}-{d(3)}", f"0049-{d(2)}-{d(5)}-{d(3)}", f"0{d(3)} {d(7)}",
            f"0{d(1)}{b}{d(2)}{b}{d(2)}{b}{d(2)}{b}{d(2)}", f"+33 {d(1, '123456789')} {d(2)} {d(2)} {d(2)} {d(2)}", f"+33{d(5)} {d(6)}", f"+33{d(9, '123456789')}",
            f"+34 {d(3)} {d(3)} {d(3)}", f"+34{d(9)}", f"{d(3, '06789')} {d(3)} {d(3)}", f"+34 {d(3)} {d(2)} {d(2)} {d(2)}",
        )
        return out + (p(" ext. ", " x", ", ext ") + d(p(2, 3))) if self.r.random() < 0.08 else out

    def id_number(self) -> tuple[str, str]:
        """Number and label."""
        d, p, up = self.digits, self.pick, lambda n: "".join(self.r.choice("ABCDEFGHJKLMNPRSTUVWXYZ") for _ in range(n))
        s = p("-", " ", "")
        return self.r.choice([
            (f"{d(3)}{s}{d(2)}{s}{d(4)}", p("SSN", "social security number", "SSN:", "soc. sec. no.", "social security #")),
            (f"{up(2)}{d(7)}", p("passport", "passport no.", "Reisepass Nr.", "n° de passeport", "pasaporte")), (f"{up(1)}{d(8)}", p("passport number", "Pasaporte n.º")),
            (f"{d(2)} {d(3)} {d(3)} {d(3)}", p("Steuer-ID", "Steuer-IdNr.", "tax ID")), (p(d(11), d(11), "00" + d(9)), p("Steuer-ID", "Steuer-IdNr.", "tax number")), (f"{d(2)}-{d(7)}", "tax ID"),
            (f"{d(8)}{p('-', '')}{up(1)}", p("DNI", "documento de identidad", "identity card", "NIF")), (f"{up(1)}{d(2)}{up(2)}{d(5)}", p("driver's licence", "Führerschein", "permis de conduire", "licence")),
            (f"{up(2)} {d(2)} {d(2)} {d(2)} A", "national insurance number"), (f"{d(1, '12')} {d(2)} {d(2)} {d(2)} {d(3)} {d(3)} {d(2)}", p("n° de sécurité sociale", "numéro de sécurité sociale")), (f"{up(1)}{d(7)}", p("licence no.", "carte d'identité")),
        ])

    def email(self, g: str, f: str) -> str:
        p = self.pick
        ascii_only = lambda w: "".join(c for c in w.lower() if c.isascii() and (c.isalnum() or c == "-"))
        g, f = ascii_only(g), ascii_only(f)
        local = p(f"{g}.{f}", f"{f}.{g}", f"{g[0]}{f}", f"{g}_{f}", f"{f}{self.digits(2)}", f"{g}-{f}", f"{g}.{f}+news", f"{g}.{f}".title())
        domain = [p("mail", "post", "uni", "web"), self.r.choice(_SYLLABLES) + self.r.choice(_ENDS), p("org", "example", "test", "net", "com", "de")][p(0, 1) :]
        if self.r.random() < 0.25:
            at, dot = p(" [at] ", "(at)", " (at) ", " at ", "[at]", " {at} "), p(" [dot] ", "(dot)", " dot ", ".")
            if at == " at ":
                dot = " dot "
            return local + at + dot.join(domain)
        return local + "@" + ".".join(domain)

    def town(self) -> str:
        return self.pick("", "", "", "Port ", "Bad ", "Saint-") + (self.r.choice(_SYLLABLES) + self.r.choice(_ENDS)).capitalize()

    def address(self) -> str:
        p, n = self.pick, self.digits(self.pick(1, 2, 3, 4), "123456789")
        w = (self.r.choice(_SYLLABLES) + self.r.choice(_ENDS)).capitalize()
        style, town, sep = self.r.random(), self.town(), p(", ", "\n", ", ")
        if style < 0.5:
            head = f"{n} {p('', '', 'Old ', 'St. ', 'Upper ')}{w} {p('Street', 'Road', 'Lane', 'Blvd', 'Ave', 'Close', 'Quay', 'Court', 'St', 'Rd')}" + p("", "", f", Apt {self.digits(2)}", f", #{self.digits(2)}", f", Flat {self.digits(1)}")
            return head + p("", sep + town, f"{sep}{town} {self.digits(5)}", f"{sep}{town}, {p('OH', 'TX', 'KS', 'NY')} {self.digits(5)}")
        if style < 0.7:
            head = p(f"{w}{p('straße', 'weg', 'gasse', 'platz', 'str.', 'allee')} {n[:3]}", f"Am Alten {w} {n[:3]}") + p("", "", "a", "c")
        elif style < 0.85:
            head = f"{n[:3]}{p('', ',', ' bis')} {p('rue', 'avenue', 'impasse', 'bd', 'place')} {p('de la ', 'du ', 'des ', '')}{w}"
        else:
            head = f"{p('Calle', 'Avda.', 'Plaza', 'C/', 'Paseo')} {p('de ', 'del ', 'de los ', '')}{w} {n[:3]}" + p("", ", bajo", ", 2.º B")
        return head + p("", f"{sep}{self.digits(5)} {town}", f"{sep}{self.digits(5)} {town}")

    def sentence(self) -> list[tuple[str, str]]:
        """Parts of text with their kind, `O` for none."""
        p, d = self.pick, self.digits
        name, g, f = self.name()
        kind = self.r.random()
        if kind < 0.2:
            before, after = self.r.choice([("Ask ", " about it."), ("", " wrote this."), ("Merci à ", " pour tout."), ("mit ", " gesprochen."), ("owner: ", "\n"), ("Signed-off-by: ", " <"), ("Dr. ", " signed it."), ("student ", ", second year"), ("If ", " is out, wait."), ("According to ", ", it is fine."), ("hat ", " das gesehen?"), ("Preguntar a ", " hoy."), ("", "'s notes are gone."), ("by ", " today."), ("name=", ";"), ("* ", " has 4 notes"), ("Mrs ", " and the others"), ("\n", "\n"), ("|", "|"), ("12,", ",,"), ("", " committed an hour ago"), ("", " asked for it."), ("@", " please look."), ('"', '"'), ("Reviewed-by: ", "\n"), ("Hi ", ","), ("Talk with ", " on Monday."), ("worked with ", " on it."), ("The slides are by ", ".")])
            return [(before, "O"), (name, "person_name"), (after, "O")]
        if kind < 0.3:
            return [(p("mail ", "rcpt=", "to ", "", "<", "cc ", "mailto:", "notify: ", "account "), "O"), (self.email(g, f), "email"), (p(" now", ">", "\n", ", please", ")", " ok", ";", "."), "O")]
        if kind < 0.36:
            return [(name, "person_name"), (p(" <", " (", ", ", " | ", "\n"), "O"), (self.email(g, f), "email"), (p(">", ")", "", "\n"), "O")]
        if kind < 0.46:
            return [(p("Call ", "Tel. ", "phone: ", "sms to ", "fax=", "", "my mobile: ", "Die Nummer ist ", "Rappeler le ", "llámame al ", "\t", "try Ann at ", "(", "contact_phone: ", '"tel": "', "WhatsApp ", "the office ("), "O"), (self.phone(), "phone"), (p(" if needed.", "\n", ")", ";", ".", " svp", '",', " queued"), "O")]
        if kind < 0.56:
            number, label = self.id_number()
            if self.r.random() < 0.3:
                return [(p("Take out ", "rejected ", "why is ", "", "Redact "), "O"), (number, "id_number"), (p(f" ({label})", f", it is somebody's {label}.", f" ({label}) in it"), "O")]
            return [(p("", "", "The form shows ", "copy of the ", "(") + label + p(" ", ": ", " = ", " "), "O"), (number, "id_number"), (p(".", "\n", ")", ", born 1990", " attached"), "O")]
        if kind < 0.57:
            return [("field national_id -> ", "O"), (self.id_number()[0], "id_number"), ("\n", "O")]
        if kind < 0.58:
            return [(f" full_name | phone | {p('national_id', 'ssn', 'passport_no')}\n-----+-----\n ", "O"), (name, "person_name"), (" | ", "O"), (self.phone(), "phone"), (" | ", "O"), (f"{d(3)}-{d(2)}-{d(4)}", "id_number"), ("\n(1 row)", "O")]
        if kind < 0.66:
            return [(p("Ship it to ", "from ", "", "I live at ", "Anschrift: ", "address;", "ship_to='", "Parcel for X, ", "Livrer au ", "vive en "), "O"), (self.address(), "street_address"), (p(".", ";ok", "'", " now.", ": two", ", tel."), "O")]
        if kind < 0.69:
            return [(self.r.choice([f'{{"id": {d(2)}, "name": "{self.prose()}"}}', f"The {self.prose()} is {self.prose()}.", f"mit {self.prose()} und {self.prose()}.", f"avec {self.prose()}, {self.prose()}.", f"con {self.prose()} y {self.prose()}", f"{p('e. g.', 'i. e.', 'z. b.', 'd. h.', 'p. ej.')} {self.prose()}", f"* {self.prose()}\n* {self.prose()}", f"see {self.prose()}, {self.prose()}"]), "O")]
        if kind < 0.70:
            return [(p("The slides are by ", "by ", "von ", ""), "O"), (name, "person_name"), (p(" and ", " und ", " et ", " y "), "O"), (self.name()[0], "person_name"), (p(".", " today.", "\n"), "O")]
        if kind < 0.72:
            return [(p("Dr. ", "", "Ask ", "Mrs "), "O"), (name, "person_name"), (f" {self.prose()}.", "O")]
        if kind < 0.85:
            return [(self.r.choice([f"{self.code()} is the code name, not {self.code()}.", f"The board {self.code()} lists {d(3)} cards.", f"See {self.code()} and {self.code()}.", f"Of the {self.code()} items {d(2)} moved to {self.code()}.", f"{self.code()} stays on version {d(2)}.{d(3)}.{d(2)} for now.", f"The {self.code()} is stuck, so the {self.code()} wait.", f"{self.code()} wrote {d(2)} bytes.", f"{self.given()} is the new runner.", f"{self.code()} and {self.code()} are release names.", f"The {self.code()} failed."]), "O")]
        return [(self.r.choice([f"job {d(3)}-{d(2)}-{d(2)}.", f"ids {d(p(3, 4, 5))}-{d(p(1, 2))}-{d(4)} onwards.", f"{d(4)}-{d(2)}-{d(4)} lock entries", f"Ticket {p('DK', 'C', 'T', 'PR')}{d(p(6, 7, 8, 9, 10))} and run {p('R', 'C', 'B')}{d(p(6, 8, 10))} say the same.", f"expected {d(p(8, 9, 10, 11, 12))} bytes.", f"build 3.{d(2)}.{d(3)}, window 2026-0{d(1, '123456789')}-1{d(1)} to 2026-0{d(1, '123456789')}-2{d(1)}", f"row {d(3)}.{d(3)}.{d(2)} of it", f"pulled from git@{self.family().lower()}.example:{d(2)}/x.git", f"Pinned tool-pack@{d(1)}.{d(2)}.{d(2)} again", f"pid={d(5)} id={d(8)}-12ab", f"order {d(9)} shipped", f"hash {d(10)} ok", f"port 192.0.{d(1)}.{d(2)}", f"epoch {d(10, '1')} seconds", f"chunk {d(8)} of {d(9)}", "@app.route and @cached look odd", f"{p('Reisepass Nr', 'Passport No', 'Identity Card', 'Steuer Nr', 'Social Security', 'Passport Number')}. is missing", f"Session Capture wrote {d(3)} bytes", f"Row 555-{d(2)} is odd, so is 0{d(2)}.{d(3)}.{d(2)}"]), "O")]


def sample(size: int = SIZE, seed: int = 7) -> tuple[list[str], list[list[tuple[int, int, str]]]]:
    """Documents with the spans and kinds of their items."""
    maker, texts, spans = Maker(seed), [], []
    for _ in range(size):
        text, marks = "", []
        for _ in range(maker.r.choice((1, 2, 3, 5))):
            for part, kind in maker.sentence():
                if kind != "O":
                    marks.append((len(text), len(text) + len(part), kind))
                text += part
            text += maker.pick(" ", "\n", " ")
        texts.append(text)
        spans.append(marks)
    return texts, spans


def common_words(*ranks_paths: str) -> frozenset[str]:
    """Ordinary words in lower case: those that a public tokenizer holds whole. None of files that aren't at hand."""
    out = set()
    for path in filter(os.path.exists, ranks_paths):
        with open(path, "rb") as lines:
            tokens = (base64.b64decode(line.split()[0]).decode("utf-8", "ignore") for line in lines if line.strip())
            out |= {t[1:] for t in tokens if t[:1] == " " and len(t) > 3 and t[1:].isalpha() and t[1:].islower()}
    return frozenset(out)


@lru_cache(maxsize=1)
def trained(size: int = SIZE, seed: int = 7, ranks_paths: tuple[str, ...] = (DEFAULT_RANKS, MANY_LANGUAGES)) -> Field:
    """The field fitted on `size` generated documents (a bounded sample; seconds on one core)."""
    texts, spans = sample(size, seed)
    common = common_words(*ranks_paths)
    found = [candidates(t, common) for t in texts]
    gold = []
    for cs, marks in zip(found, spans):
        by = {(a, b): k for a, b, k in marks}
        gold.append([LABELS.index(by.get((c.start, c.end), "O")) for c in cs])
    return fit(texts, found, gold, common=common)
