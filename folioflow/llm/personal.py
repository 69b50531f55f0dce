"""Finding personal data in free text and putting typed placeholders in its place.

A text first passes transducers that undo disguises: look-alike and full-width
characters, characters without width, written-out "at" and "dot", and digits
spelled as words. Each of them keeps, for every character it writes, the place in
the source it comes from. Detectors run over the normalised text; their spans are
mapped back, so what is reported and replaced are the characters of the source,
and the text around them stays as it was.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

KINDS = ("email", "address", "id_number", "phone", "name")


class Find(NamedTuple):
    kind: str
    begin: int
    end: int


# Letters of other scripts that look like Latin ones.
_LOOKALIKES = dict(zip("АВЕКМНОРСТУХаеорсухіјѕԁһӏΑΒΕΖΗΙΚΜΝΟΡΤΥΧο", "ABEKMHOPCTYXaeopcyxijsdhlABEZHIKMNOPTYXo"))
# Digits as words.
_DIGITS = {"zero": "0", "oh": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9"}
_DIGIT_WORDS = "|".join(_DIGITS)
_SPELLED = re.compile(rf"\b(?:(?:double|triple)[ -])?(?:{_DIGIT_WORDS})(?:[ ,-]+(?:(?:double|triple)[ -])?(?:{_DIGIT_WORDS})){{5,}}\b", re.I)
_ONE_SPELLED = re.compile(rf"(?:(double|triple)[ -])?({_DIGIT_WORDS})", re.I)
_MIXED = re.compile(r"[\w.+@-]*[A-Za-z][\w.+@-]*")
_ZERO_WIDTH = "​‌‍⁠﻿­"
# "at" in brackets; or between blanks, if a written-out dot follows in the host.
_AT = re.compile(r"(?<=[\w+-])\s?[\[({<]\s?(?:at|ät|arroba|@)\s?[\])}>]\s?(?=\w)|(?<=[\w+-]) (?:at|arroba) (?=[\w-]{1,63}(?: dot | punto | punkt |\s?[\[({]\s?dot\s?[\])}]\s?)\w)", re.I)
_DOT = re.compile(r"(?<=[\w-])\s?[\[({]\s?(?:dot|punto|punkt|\.)\s?[\])}]\s?(?=\w)|(?<=[\w-]) (?:dot|punto|punkt) (?=\w)", re.I)

# What every match of the rule above has in it, so that a text without it is passed by.
_AT_GATE = re.compile(r"[\[({<]\s?(?:[Aa][Tt]|[äÄ][Tt]|[Aa][Rr][Rr]|@)")
_DOT_GATE = re.compile(r"[\[({]\s?(?:[Dd][Oo][Tt]|[Pp][Uu][Nn]|\.)")
_DOT_WORDS = (" dot ", " punto ", " punkt ")


class Normal:
    """A text under edits, with the source's place of every character."""

    def __init__(self, text: str):
        self.text = text
        self._pieces: list[tuple[int, int, int]] = [(0, 0, len(text))]  # begin here, begin in source, length in source
        self._begins = [0]

    def _straight(self, i: int) -> bool:
        """Whether a piece's characters map one to one."""
        return self._end(i) - self._begins[i] == self._pieces[i][2]

    def _end(self, i: int) -> int:
        return self._begins[i + 1] if i + 1 < len(self._begins) else len(self.text)

    def edit(self, found: list[tuple[int, int, str]]) -> None:
        """Replace spans (begin, end, new text), in order and apart from each other; one pass over text and pieces."""
        if not found:
            return
        out, pieces, at, size, i = [], [], 0, 0, 0
        for b, e, new in [*found, (len(self.text), len(self.text), "")]:
            out.append(self.text[at:b])
            while at < b:
                while self._end(i) <= at:
                    i += 1
                begin, s, n = self._pieces[i]
                to = min(b, self._end(i))
                straight = self._straight(i)
                pieces.append((size, s + (at - begin) if straight else s, to - at if straight else n))
                size, at = size + to - at, to
            if new:
                s, t = self.source(b, e)
                pieces.append((size, s, t - s))
                out.append(new)
                size += len(new)
            at = max(at, e)
        self.text, self._pieces = "".join(out), pieces or [(0, 0, 0)]
        self._begins = [p[0] for p in self._pieces]

    def source(self, begin: int, end: int) -> tuple[int, int]:
        """The source's span of a span here."""
        i = bisect_right(self._begins, begin) - 1
        j = bisect_right(self._begins, max(begin, end - 1)) - 1
        b, s, n = self._pieces[i]
        first = s + (begin - b) if self._straight(i) else s
        b, s, n = self._pieces[j]
        last = s + (end - b) if self._straight(j) else s + n
        return first, max(first, last)


# Characters that may have to be changed: without width, look-alikes, full-width and other compatible forms.
_ODD = re.compile("[\xa0" + _ZERO_WIDTH + "\u0370-\U0010ffff]")
_ANY_LOOKALIKE = re.compile("[" + "".join(_LOOKALIKES) + "]")


@lru_cache(65_536)
def _plain(c: str) -> str:
    """What a character without regard to its neighbours becomes."""
    if c in _ZERO_WIDTH:
        return ""
    if c == "\xa0":
        return " "
    k = c if c in _LOOKALIKES else unicodedata.normalize("NFKC", c)
    return k if len(k) == 1 and k.isascii() else c


def normal(text: str) -> Normal:
    """The text with its disguises undone."""
    x = Normal(text)
    if not text.isascii():
        x.edit([(m.start(), m.end(), k) for m in _ODD.finditer(text) if (k := _plain(m.group())) != m.group()])
        edits = []
        if _ANY_LOOKALIKE.search(x.text):
            for m in _MIXED.finditer(x.text):  # look-alikes count in words that have Latin letters too
                word = m.group()
                if not word.isascii():
                    edits += [(m.start() + i, m.start() + i + 1, _LOOKALIKES[c]) for i, c in enumerate(word) if c in _LOOKALIKES]
        x.edit(edits)
    low = x.text.lower()  # the rules run only where a text has what they need
    dots = any(w in low for w in _DOT_WORDS) or _DOT_GATE.search(x.text) is not None
    if dots or _AT_GATE.search(x.text):
        x.edit([(m.start(), m.end(), "@") for m in _AT.finditer(x.text)])
    if dots:
        x.edit([(m.start(), m.end(), ".") for m in _DOT.finditer(x.text)])
    spelled = []
    for m in _SPELLED.finditer(x.text) if sum(low.count(w) for w in _DIGITS) >= 4 else ():
        digits = "".join(_DIGITS[d.lower()] * {"double": 2, "triple": 3}.get((t or "").lower(), 1) for t, d in _ONE_SPELLED.findall(m.group()))
        if len(digits) == 10:  # as numbers of ten digits are written
            digits = f"{digits[:3]}-{digits[3:6]}-{digits[6:]}"
        elif 11 <= len(digits) <= 15 and digits[0] != "0":
            digits = "+" + digits
        spelled.append((m.start(), m.end(), digits))
    x.edit(spelled)
    return x


_EMAIL = re.compile(r"(?<![\w.+%'-])[A-Za-z0-9_%+'À-ɏ-]{1,64}(?:\.[A-Za-z0-9_%+'À-ɏ-]{1,64}){0,8}@(?:[A-Za-z0-9](?:[A-Za-z0-9-]{0,61}[A-Za-z0-9])?\.){1,8}[A-Za-z]{2,24}(?![\w-]|\.\w|@)")

_EXT = r"(?:,?[ ](?:ext\.?|extension|x\.?|Durchwahl|Dw\.?|poste|int\.?)[ ]?\d{1,6})?"
_NOT_BEFORE = r"(?<![\w/])(?<![\d.,][-.:])(?<!\d )"
_NOT_AFTER = r"(?![\w])(?![-./:]\d)"
_PHONE = re.compile(
    _NOT_BEFORE
    + r"(?:"
    + r"(?:\+|00)[1-9]\d{0,2}(?:[ .\-/]{0,2}\(0\))?(?:[ .\-/]?\(?\d{1,5}\)?){2,7}"  # with a country code
    + r"|\+[1-9]\d{7,14}"
    + r"|\(\d{3}\)[ .-]?\d{3}[ .-]\d{4}|\d{3}[.-]\d{3}[.-]\d{4}|\d{3} \d{3}[ -]\d{4}"
    + r"|\(0[ ]?\d{1,4}(?:[ ]\d{1,2})?\)[ /-]?\d{1,5}(?:[ -]?\d{1,5}){1,4}"
    + r"|0\d{2,4}[ /-]\d{3,4}[ -]?\d{3,4}"
    + r")"
    + _EXT
    + _NOT_AFTER
)

# Labels of papers, tax, insurance and patient files.
_ID_LABEL = (
    r"(?:SSN|social security (?:number|no\.?)|passport(?: (?:no\.?|number|nr\.?))?|Reisepass(?:nummer|-Nr\.?)?|pasaporte(?: n[º°o]\.?)?|passeport(?: n[º°o]\.?)?|tax (?:ID|identification number|number|file number)|Steuer-?(?:ID|nummer|identifikationsnummer)|TIN|ITIN|MRN|medical record (?:number|no\.?)"
    r"|patient (?:ID|number|no\.?|file(?: no\.?)?)|DNI|NIE|NIF|CPF|CURP|BSN|PESEL|NI (?:number|no\.?)|NINO|national insurance (?:number|no\.?)|national (?:identity|identification|ID) (?:number|no\.?|card)|identity card(?: (?:no\.?|number))?|ID card(?: (?:no\.?|number))?"
    r"|Personalausweis(?:nummer|-Nr\.?)?|driving licen[cs]e(?: (?:no\.?|number))?|driver'?s licen[cs]e(?: (?:no\.?|number))?|(?:health )?insurance (?:number|no\.?|ID)|Versicherten?nummer|NHS (?:number|no\.?)|residence permit(?: (?:no\.?|number))?|SIN|Aadhaar(?: number)?)"
)
_ID_VALUE = r"[A-Z]{0,6}[ -]?\d(?:[ -]?[0-9A-Z]){3,20}"
_ID = re.compile(rf"(?<![\w-])(?i:{_ID_LABEL})\s{{0,2}}(?:[:#=]\s{{0,2}}|(?i:is|no\.|nr\.)\s)?({_ID_VALUE})(?![\w-])")
# A part of every label above but the short ones, which are parts of common words: these begin a word and a value, mark or blank follows.
_ID_SIGNS = (
    "ssn", "social sec", "passport", "passeport", "pasaporte", "reisepass", "tax id", "tax n", "tax f", "steuer", "mrn", "medical rec", "patient ", "dni", "cpf", "curp", "bsn", "pesel", "ni n", "nino", "national id", "national ins",
    "identity card", "id card", "ausweis", "driving", "driver", "insurance", "versichert", "nhs", "permit", "aadhaar",
)
_SHORT_LABEL = re.compile(r"(?<![\w-])(?i:nie|nif|sin|i?tin)(?:[\s:#=\-\dA-Z]|(?i:is|no\.|nr\.))")
# Letters that a rule without regard to case takes for Latin ones, but lower() doesn't.
_CASELESS = str.maketrans({"ſ": "s", "ı": "i", "İ": "i", "\u212a": "k"})


def _may_have_id(text: str) -> bool:
    """Whether a label of an identity number may be in the text."""
    low = (text if text.isascii() else text.translate(_CASELESS)).lower()
    return next(_signs().iter(low), None) is not None or _SHORT_LABEL.search(text) is not None


@lru_cache(1)
def _signs():
    """The signs as one automaton, so that a text is looked through once for all."""
    import ahocorasick

    signs = ahocorasick.Automaton()
    for k in _ID_SIGNS:
        signs.add_word(k, k)
    signs.make_automaton()
    return signs


_ID_SHAPE = re.compile(r"(?<![\w.,/-])(?:\d{3}-\d{2}-\d{4}|[A-CEGHJ-PR-TW-Z]{2} ?\d{2} ?\d{2} ?\d{2} ?[A-D])(?![\w/-])")

_UP = r"[A-ZÀ-ÖØ-ÞĀĂĄĆČĎĐĒĘĚĞĢĪĶŁŃŇŐŘŚŞŠŤŪŮŰŹŻŽ]"
_LOW = r"[^\W\d_]"
_TOWN = rf"{_UP}{_LOW}+(?:[-'’]{_LOW}+)*(?:[ ]{_UP}{_LOW}+(?=[,.;)\n<]|$))?"
_STREET = r"(?:Street|St\.?|Road|Rd\.?|Avenue|Ave\.?|Lane|Ln\.?|Drive|Dr\.?|Boulevard|Blvd\.?|Court|Ct\.?|Place|Pl\.?|Square|Sq\.?|Terrace|Way|Close|Crescent|Parkway|Pkwy\.?|Highway|Hwy\.?|Row|Walk|Gardens|Hill|Mews)"
_PROPER = rf"{_UP}{_LOW}+(?:[-'’]{_LOW}+)*"
_POST = r"(?:[A-Z]{1,3}-)?\d{4,6}(?:-\d{3,4})?"
_UNIT = r"(?:(?:Apt|Apartment|Suite|Ste|Unit|Flat|Floor|Room)\.?[ ]?#?\w{1,5}|#\w{1,5})"
_AFTER = rf"(?:{_TOWN},?[ ](?:[A-Z]{{2}}[ ])?{_POST}(?!\w)|{_POST}[ ]{_TOWN}|{_TOWN})"
_ADDRESS = re.compile(
    r"(?<![\w.-])(?:"
    + rf"(?:{_UNIT},[ ])?\d{{1,5}}[A-Za-z]?(?:-\d{{1,5}})?[ ](?:{_PROPER}[ ]){{1,3}}{_STREET},[ ](?:{_UNIT},[ ])?{_AFTER}"  # 12 Elm Street, Apt 3, Town 00000
    + rf"|(?:P\.?[ ]?O\.?[ ]?Box|PO Box|Postfach|Apartado|Casilla|BP)[ ]\d{{1,6}},[ ]{_AFTER}"
    + rf"|(?:Calle|Avenida|Avda\.?|Paseo|Plaza|Carrera|Rua|Travessa|Praça|Via|Viale|Piazza|Corso|Largo)[ ](?:(?:de|del|do|da|dos|das|la|los|las|di|della)[ ]){{0,2}}(?:{_PROPER}[ ]?){{1,3}},?[ ]\d{{1,5}}[A-Za-z]?(?:,[ ]\d{{1,3}}[ºª°][ ]?[A-Za-z0-9]{{0,3}}(?:[ ][A-Za-z0-9]{{1,3}})?)?,[ ]{_AFTER}"
    + rf"|\d{{1,5}}(?:[ ](?:bis|ter|quater)|[A-Za-z])?,?[ ](?:rue|avenue|boulevard|place|chemin|allée|impasse|quai|route|cours)[ ](?:(?:de|du|des|la|le|les)[ ]|l['’]|d['’]){{0,2}}(?:{_PROPER}[ ]?){{1,3}},[ ]{_AFTER}"
    + rf"|{_UP}{_LOW}+(?:-{_UP}?{_LOW}+)*(?:straße|strasse|str\.|weg|platz|allee|gasse|ring|damm|ufer|straat|laan|gatan|vej|veien)[ ]\d{{1,5}}[A-Za-z]?(?:[-/]\d{{1,4}})?,[ ]{_AFTER}"
    + rf"|(?:ul\.|ulica|al\.|pl\.|os\.)[ ](?:{_PROPER}[ ]){{1,3}}\d{{1,5}}[A-Za-z]?(?:/\d{{1,4}})?,[ ]{_AFTER}"
    + r")"
)

# Given names that are common in some country; one of several kinds of evidence.
_GIVEN = frozenset(
    """adam agnes ahmed aisha alan albert alexander alice ana andrea andrew anna anne anthony anton barbara benjamin brian carlos carol catherine charles christine christopher claire daniel david deborah diana dorothea edward
    elena elisabeth elizabeth emily emma eric eva felix fernanda florian frances francisco frank gabriel george giovanni grace hans hannah helen henry ibrahim ingrid ivan jack jacob james jan jana jane jean jennifer joan john
    jonathan jorge josé josephine juan julia karen karl katarina katherine kevin klaus laura linda lisa louis luc lucas luis manuel margaret maria marie mark martin mary matthew maximilian michael mohammed nancy nikolas oliver patricia
    paul pedro peter philippa rebecca richard robert ruben ruth samuel sandra sarah sofia stephen steven susan theresa thomas tobias ursula victor victoria wilhelmina william winston""".split()
)
_NAME_WORD = rf"{_UP}{_LOW}+(?:['’]{_UP}?{_LOW}+)*(?:-{_UP}{_LOW}+)*|{_UP}['’]{_UP}{_LOW}+|(?:El|Al|Mac|Mc|Ben)-?{_UP}{_LOW}+"
_PART = r"(?:(?:van|von|de|del|della|di|da|dos|du|der|den|la|le|ter|ten|bin|al|VAN|VON|DE|DEL|DI|DA|DOS|DU|DER|DEN|LA|LE)[ ]){0,3}"
_INITIALS = rf"(?:{_UP}\.[ ]?(?:-{_UP}\.[ ]?)?){{1,3}}"
_FAMILY = rf"{_PART}(?:{_NAME_WORD})"
# Shapes of a name. Evidence around it decides whether it is one.
_SHAPE = re.compile(
    rf"(?<![\w@.+'’-])(?<!\b(?i:box|sec|fig|tab|app) )(?:(?P<lead>{_INITIALS}){_FAMILY}"  # J. K. Roe
    rf"|(?:{_FAMILY}),[ ](?P<back>{_INITIALS}|(?:{_NAME_WORD})(?:[ ]{_UP}\.)*)(?![ ]{_UP}{_LOW}|[\w@-])"  # Roe, Jane K.
    rf"|(?P<first>{_NAME_WORD})(?:[ ]{_UP}\.)*[ ](?:{_FAMILY}))(?![\w@])"  # Jane K. Roe
)
# Words that persons' names follow. A colon, a form of "to be" or a form of address may stand between.
_ROLE = (
    "author|reviewer|referee|editor|participant|participant file|patient|applicant|candidate|employee|student|pupil|client|customer|nurse|physician|colleague|supervisor|advisor|secretary|assistant|coordinator|investigator"
    "|holder|recipient|sender|name|contact|contact person|kontakt|contacto|from|to|cc|bcc|attn|signed|undersigned|mother|father|wife|husband|son|daughter|sister|brother|widow|tenant|witness|speaker|chair"
)
_ROLE_BARE = "participant|participant file|patient|applicant|candidate|employee|student|client|nurse|physician|colleague|supervisor|advisor|secretary|investigator|recipient|sender|cc|bcc|attn|kontakt|contacto|mother|father|husband|daughter|sister|brother|widow"
_ACT = (
    "met|addressed to|letter for|next to|form lists|thank|thanks to|thanked|e-?mail|contacted|phone|invited|write to|wrote to|speak to|spoke to|on behalf of|care of|c/o|together with"
    "|(?:noted|written|signed|sent|reviewed|prepared|submitted|reported|told|said|approved|requested|visited|treated|seen|met|filed|collected|countersigned|completed|filled in) by"
    "|mentionne|constan|stehen|bitte an|escriba a|écrire à|contacter|teléfono de|número de|telefono di|telefone de|Nummer von"
)
_CUE = re.compile(
    rf"(?:\b(?:Dr|Prof|Mr|Mrs|Ms|Mx|Sra|Sr|Dott|Ing|Mme|Mlle|Herrn?|Frau|Professor|Doctor|Monsieur|Madame|Señora?|Miss|Sir|Dame)\.?|\b(?:[Dd]ear|Hi|Hello|Liebe[r]?|Estimad[oa]|Chère?)"
    r"|\b(?:(?:Best |Kind |Warm )?[Rr]egards|Sincerely|Yours(?: sincerely| faithfully| truly)?|Thanks|Cheers|Best wishes|Best|Mit freundlichen Grüßen|Viele Grüße|Saludos|Atentamente|Cordialement|Atenciosamente|Cordiali saluti)\s*,"
    rf"|(?<![\w-])(?i:{_ROLE})(?:\s(?:is|was|were)|\s?[:,])|(?<![\w-])(?i:{_ROLE_BARE})|(?<![\w-])(?:{_ACT})|联系人：|联系人:|連絡先[:：]|担当[:：]?|Контакт:)\s{{0,3}}\Z"
)
# Words that names follow, but common words too: half as much evidence.
_WEAK_CUE = re.compile(r"(?<![\w-])(?i:from|to|name|call|called|ask|asked|lists|son|chair|speaker|author|editor|holder|contact|by)\s{0,3}\Z")
# What follows the name of somebody who acts or can be reached.
_THEN = re.compile(
    r"\s?(?:<[^<>@\s]{1,64}[@(\[]|\([^()@\s]{1,64}@)|,?\s(?:can be (?:reached|contacted)|is (?:reachable|available) (?:at|on|under)|may be (?:reached|contacted)|est joignable|atende pelo|ist (?:erreichbar|zu erreichen)|atiende en"
    r"|(?:noted|wrote|writes|told|asked|called|phoned|signed|replied|emailed|confirmed)\b|will chair)|,?\s\(?(?i:SSN|passport|DNI|NINO|MRN|tax ID|social security|national identity|driving licen[cs]e)\b"
    r"|\s(?:aged?|born|geboren) \d|,\s(?:born|aged?) "
)
_AND = re.compile(r"(?:,| and| und| y| et| e| &|, and) (?:\w{2,4}\. )?\Z")
# Words that are no part of a person's name.
_NO_NAME = frozenset(
    """box street road avenue lane drive court square university institute department hospital laboratory labs lab college school faculty centre center museum library foundation society association committee council
    group team project network agency ministry office company press journal review conference workshop proceedings january february march april may june july august september october november december monday tuesday wednesday
    thursday friday saturday sunday the and for this that these those each future half code table figure section appendix equation theorem lemma algorithm part chapter version data dataset corpus model models method methods
    learning neural network networks deep study studies research analysis results we our they their it its in on at by to of from with as if when while however although because since after before where which who what how
    no not all some any most many few both either first second third north south east west new united states kingdom street platform system systems survey series rank test science sciences medicine technology""".split()
)
_TITLE = re.compile(r"^(?:(?:Dr|Prof|Mr|Mrs|Ms|Mx|Frau|Herrn?|Dear|Sra?|Mme)\.?\s+)+")
_LETTERS = re.compile(rf"{_LOW}+")
#: Characters ahead of a name in which a cue is looked for: more than the longest cue has.
_BEFORE = 48


def _evidence(text: str, m: re.Match, last: int) -> int:
    """How much speaks for a person's name: 2 is enough. last: the end of the name before, or -1."""
    b, e = m.span()
    before = text[max(0, b - _BEFORE) : b]
    said = 0
    if m["lead"] or (m["back"] and "." in m["back"][:3]):
        said += 2 if m["lead"] else 1
    first = (m["first"] or m["back"] or "").split(" ")[0].split("-")[0].lower()
    said += 2 * (first in _GIVEN)
    said += 2 if _CUE.search(before) else 1 if _WEAK_CUE.search(before) else 0
    if last >= 0 and last >= b - 12 and _AND.match(text[last:b]):
        said += 2
    if said < 2 and _THEN.match(text, e):
        said += 2
    if said < 2 and b and text[b - 1] == "\n" and (e == len(text) or text[e] == "\n"):  # a line of its own, as at the end of a letter
        said += 1
    if said == 1 and any(w.isupper() and len(w) > 2 for w in m.group().replace("-", " ").split()):
        said += 1
    return said


def _names(text: str) -> Iterator[tuple[int, int]]:
    at, last = 0, -1
    while (m := _SHAPE.search(text, at)) is not None:
        title = _TITLE.match(m.group())
        words = [w.lower() for w in _LETTERS.findall(m.group())]
        shaped = not title and len(words) >= 2 and _NO_NAME.isdisjoint(words)
        if shaped and _evidence(text, m, last) >= 2:
            yield m.span()
            at = last = m.end()
            continue
        # Not this one; the next may begin at its second word: "As Teodor Roe noted".
        step = re.compile(r"[ ,.]+").search(text, m.start(), m.end())
        at = step.end() if step else m.end()


def finds(text: str | None) -> list[Find]:
    """The personal data in a text, as spans of the text that don't overlap, in order.

    Null, empty and blank texts have none. Spans of kinds named earlier in KINDS
    go before others they overlap with; of one kind the first and longest stays.
    """
    if not text or text.isspace():
        return []
    x = normal(text)
    t = x.text
    found: list[tuple[int, int, int]] = []
    begins: list[int] = []  # of the spans taken so far, in order
    ends: list[int] = []

    def add(rank: int, b: int, e: int) -> None:
        i = bisect_left(begins, e)  # spans from here on begin behind it
        if e > b and (i == 0 or ends[i - 1] <= b):
            begins.insert(i, b)
            ends.insert(i, e)
            found.append((b, e, rank))

    for m in _EMAIL.finditer(t) if "@" in t else ():
        add(0, *m.span())
    for m in _ADDRESS.finditer(t):
        add(1, *m.span())
    for m in _ID.finditer(t) if _may_have_id(t) else ():
        if sum(c.isdigit() for c in m.group(1)) >= 5:
            add(2, *m.span(1))
    for m in _ID_SHAPE.finditer(t):
        add(2, *m.span())
    for m in _PHONE.finditer(t):
        digits = sum(c.isdigit() for c in re.split(r"(?i)\s?(?:ext|x|dw|durch|poste|int)", m.group())[0])
        if 8 <= digits <= 15:
            add(3, *m.span())
    for b, e in _names(t):
        add(4, b, e)
    return sorted(Find(KINDS[rank], *x.source(b, e)) for b, e, rank in found)


def redacted(text: str | None) -> str | None:
    """The text with [EMAIL], [PHONE], [ID_NUMBER], [ADDRESS] and [NAME] in place of its personal data; null for null."""
    if text is None:
        return None
    out, at = [], 0
    for f in sorted(finds(text), key=lambda f: f.begin):
        out.append(text[at : f.begin] + f"[{f.kind.upper()}]")
        at = f.end
    return "".join(out) + text[at:]


def find_personal(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, kind and found_text: the distinct finds of each row, found_text as it stands in the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, kinds, texts = [], [], []
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for kind, found in dict.fromkeys((f.kind, text[f.begin : f.end]) for f in finds(text)):
                    ids.append(i)
                    kinds.append(kind)
                    texts.append(found)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(kinds, pa.string()), pa.array(texts, pa.string())], names=["id", "kind", "found_text"])

    return df.select(F.col(id_col).cast("long"), F.col(text_col)).mapInArrow(run, "id long, kind string, found_text string")


def redact(df: DataFrame, text_col: str, out_col: str = "redacted") -> DataFrame:
    """df with a column of its texts without personal data; a column of that name is replaced."""
    kept = [c for c in df.columns if c != out_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = pa.array([redacted(t) for t in batch.column(batch.num_columns - 1).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], texts], names=[*kept, out_col])

    schema = T.StructType([*(df.schema[c] for c in kept), T.StructField(out_col, T.StringType())])
    return df.select(*[F.col(f"`{c}`") for c in kept], F.col(f"`{text_col}`").alias("__text")).mapInArrow(run, schema)
