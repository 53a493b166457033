"""Personal data in texts: located by an offset-preserving deobfuscation, and replaced.

Transducers rewrite a text one after the other, each keeping a map from what it writes back to
the characters it read: layout (line breaks, hyphenation, quotation marks of forwarded text, page
headers, invisible characters), letters and digits that only look like Latin ones, disguised
separators of email addresses ("[at]", " dot "), and numbers spelt digit by digit. Identifiers
are found in the result, and their spans mapped back through all the maps to the source. Work is
per document: no shuffle, nothing gathered.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tilewright.common import require
from tilewright.llm.words import LOOKALIKES

Edit = tuple[int, int, str]


class Tape:
    """A text and, for every character, the characters of the source that it stands for."""

    def __init__(self, text: str, under: Tape | None = None, edits: list[Edit] | None = None):
        """edits: (start, end, new) in the text of `under`, in order and without overlaps; a piece
        that is rewritten stands as a whole for what it replaces."""
        self.text, self.under = text, under
        self.starts, self.places, self.ends = [0], [0], [-1]  # end -1: the piece is a copy
        if edits:
            out: list[str] = []
            at = size = 0
            for a, b, new in edits:
                out += [text[at:a], new]
                size += a - at
                if new:
                    self._piece(size, a, b)
                    size += len(new)
                self._piece(size, b, -1)
                at = b
            self.text = "".join([*out, text[at:]])

    def _piece(self, start: int, place: int, end: int) -> None:
        if self.starts[-1] == start:
            self.places[-1], self.ends[-1] = place, end
        else:
            self.starts.append(start)
            self.places.append(place)
            self.ends.append(end)

    def source(self, a: int, b: int) -> tuple[int, int]:
        """The span of the source that the characters from a to b stand for."""
        i, j = bisect_right(self.starts, a) - 1, bisect_right(self.starts, b - 1) - 1
        first = self.places[i] + (a - self.starts[i] if self.ends[i] < 0 else 0)
        last = self.places[j] + b - self.starts[j] if self.ends[j] < 0 else self.ends[j]
        return self.under.source(first, last) if self.under else (first, last)

    def then(self, edits: list[Edit]) -> Tape:
        return Tape(self.text, self, edits) if edits else self


_PAGE = r"[ \t]*\r?\n\s*(?:[—–-] ?\d+ ?[—–-]|\d+\t[A-Z0-9-]+|[A-Z0-9-]+\t\d+|(?:[A-Z0-9-]+[ \t]{2,})?(?:Page|page|Seite) \d+ (?:of|von|sur|/) \d+)[ \t]*(?:\r?\n[\s>]*|$)"
_DROPPED = "\u00ad\u200b\u200c\u200d\u2060\ufeff"
#: Where the layout may have to be rewritten, and how: pieces by the group that matches.
_BROKEN = re.compile(rf"[^\S ]|  |[{_DROPPED}]")
_FOLD = re.compile(rf"(?P<hyphen>-(?:{_PAGE}|[ \t]*\r?\n[ \t>]*)(?=[^\W\d_]))|(?P<page>{_PAGE})|(?P<drop>[{_DROPPED}])|(?P<blank> *\r?\n[\s>]*|[^\S ]\s*| {{2,}}\s*)")


def _layout(text: str) -> list[Edit]:
    edits: list[Edit] = []
    done = 0
    for spot in _BROKEN.finditer(text):
        at = spot.start()
        if at < done:
            continue
        while at > done and text[at - 1] == " ":
            at -= 1
        if at - 1 > done and text[at - 1] == "-" and text[at - 2].isalpha():
            at -= 1
        m = _FOLD.match(text, at) or _FOLD.match(text, spot.start())
        if not m:
            continue
        kind = m.lastgroup
        if kind == "hyphen":  # a hyphen stays before a capital that follows a small letter
            new = "-" if text[m.end()].isupper() and text[at - 1].islower() else ""
        elif kind == "drop":
            new = ""
        else:
            new = "\n" if kind == "blank" and m[0].count("\n") > 1 else " "
        done = m.end()
        if m[0] != new:
            edits.append((m.start(), done, new))
    return edits


#: One character for one: look-alike letters, full-width forms and digits of other scripts.
_LATIN = {ord(a): b for a, b in LOOKALIKES.items() if len(b) == 1} | {c: chr(c - 0xFEE0) for c in range(0xFF01, 0xFF5F)}
_LATIN |= {zero + d: str(d) for zero in (0x660, 0x6F0, 0x966) for d in range(10)}
_FOREIGN = re.compile("[\u0250-\u02af\u0370-\u058f\u0660-\u096f\uff01-\uff5e]")

_TLD = r"[^\W\d_]{2,}"
_AT = r"(?: ?@ ?| ?&#64; ?| ?[\[({<] ?(?:at|AT|ät|arobase) ?[\])}>] ?)"
_DOT = r"(?:\.(?: (?=[a-z0-9-]+\.[a-z]))?| ?[\[({<] ?(?:dot|DOT|punkt|point) ?[\])}>] ?)"
_SPELT_DOT = r" (?:dot|DOT|punkt|point) "
#: Where a disguised "at" may stand; and an address from its "at" on, with its separators.
_MAYBE_AT = re.compile(r" ?@ | @|&#64;|@[\w-]+(?:[ \[({<]|\. )| ?[\[({<] ?(?:at|AT|ät|arobase) ?[\])}>]|@[\w.-]+ ?[\[({<]| (?:at|AT|arobase) (?=[\w-]+(?:\.[\w-]+)* (?:dot|DOT|punkt|point) )")
_TAIL = re.compile(
    rf"(?P<at>{_AT})[\w-]+(?:(?:{_DOT}|{_SPELT_DOT})[\w-]+)*(?:{_DOT}|{_SPELT_DOT}){_TLD}"
    rf"|(?P<spelt> (?:at|AT|arobase) )[\w-]+(?:(?:{_DOT}|{_SPELT_DOT})[\w-]+)*{_SPELT_DOT}{_TLD}"
)
_SEPARATOR = re.compile(rf"{_DOT}|{_SPELT_DOT}")


def _separators(text: str) -> list[Edit]:
    edits: list[Edit] = []
    done = 0
    for spot in _MAYBE_AT.finditer(text):
        if spot.start() < done or not (m := _TAIL.match(text, spot.start())):
            continue
        first = m.span("at") if m["at"] else m.span("spelt")
        for a, b, new in ((*first, "@"), *((*x.span(), ".") for x in _SEPARATOR.finditer(text, first[1], m.end()))):
            if text[a:b] != new:
                edits.append((a, b, new))
        done = m.end()
    return edits


# The digits as they are spelt.
_DIGIT_WORDS = {
    "zero": "0", "oh": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9",
    "null": "0", "eins": "1", "zwei": "2", "zwo": "2", "drei": "3", "vier": "4", "fünf": "5", "sechs": "6", "sieben": "7", "acht": "8", "neun": "9",
    "zéro": "0", "un": "1", "deux": "2", "trois": "3", "quatre": "4", "cinq": "5", "sept": "7", "huit": "8", "neuf": "9",
}
_SPELT = "(?:" + "|".join(sorted(_DIGIT_WORDS, key=len, reverse=True)) + ")"
_SPELT_RUN = re.compile(rf"\b{_SPELT}(?:(?:[ -]|, ?){_SPELT})+\b", re.I)
_SPELT_ONE = re.compile(_SPELT, re.I)


def _digits(text: str) -> list[Edit]:
    """Six or more digits spelt one after the other become figures; groups that commas part
    stay apart by a blank."""
    edits: list[Edit] = []
    for run in _SPELT_RUN.finditer(text):
        found = [*_SPELT_ONE.finditer(text, run.start(), run.end())]
        if len(found) < 6:
            continue
        for m, after in zip(found, [*found[1:], None]):
            gap = text[m.end() : after.start()] if after else ""
            edits.append((m.start(), m.end(), _DIGIT_WORDS[m[0].lower()]))
            if gap:
                edits.append((m.end(), after.start(), " " if "," in gap else ""))
    return edits


def normalised(text: str) -> Tape:
    """The text as identifiers are looked for in it."""
    tape = Tape(text).then(_layout(text))
    if not tape.text.isascii() and _FOREIGN.search(tape.text):
        tape.text = tape.text.translate(_LATIN)
    tape = tape.then(_separators(tape.text))
    return tape.then(_digits(tape.text))


_DOMAIN = re.compile(rf"@[\w-]+(?:\.[\w-]+)*\.{_TLD}")

_LABEL = re.compile(
    r"(?:\b(?:passport|social security|national insurance|insurance|tax identification|tax|identity card|identity|ID card|ID) ?(?:no\b\.?|number\b|nr\b\.?|ID\b)"
    r"|\b(?:Personal)?Ausweis(?:nummer\b|[- ]?Nr\b\.?)|\bReisepass(?:nummer\b|[- ]?Nr\b\.?)|\bSteuer(?:-?ID\b|-?(?:identifikations)?nummer\b|-?Nr\b\.?)|\b(?:Sozial)?versicherungs(?:nummer\b|-?nr\b\.?)"
    r"|\bcarte d.identité n[°ºo]|\bpasseport n[°ºo]|\bnuméro (?:de sécurité sociale|d.assurance(?: sociale)?|fiscal|d.identité|d.identification fiscale|de passeport)\b|\bNIR\b)",
    re.I,
)
_NUMBER = re.compile(r"[\s:(),]*(?:(?:as|is|was|le|est|lautet|ist|als|with|number|no\.?|n°) )?[\s:]*((?:[A-Z]{1,3}[ -]?)?\d[\d./-]*(?: \d[\d./-]*)*(?: ?[A-Z]\b)?)")
#: Where a number may stand: labels are looked for before these only.
_DIGITS = re.compile(r"\d[\d ./-]{3}")
#: What a label holds, in lower case.
_LABELLED = ("passport", "social", "insurance", "tax", "ident", "id", "ausweis", "reisepass", "steuer", "versicherung", "passeport", "num", "nir")
#: Numbers by their shape alone, should the label be damaged.
_SHAPE = re.compile(r"(?<![\w/.-])(?:QQ ?\d\d ?\d\d ?\d\d ?[A-D]|9\d\d([- ])\d\d\1\d{4}|\d{8}-\d{4}|00 \d{3} \d{3} \d{3}|[A-Z]{2}-\d{6}/\d)(?![\w/-])")

_PHONE = re.compile(
    r"(?<![\w/.,§-])(?!\d{4}-\d{4}-\d{4}\b)(?:\+\d{1,3}[ .-]?(?:\(0\) ?)?\(?\d{1,5}\)?(?:[ ./-]?\d{2,9}){1,5}|00[1-9]\d{0,2}[ .-](?:\(0\) ?)?\d{1,5}(?:[ ./-]\d{2,9}){1,5}"
    r"|\(0\d{1,4}\) ?\d{2,8}(?:[ .-]\d{2,8}){0,4}|0\d{1,4}[ ./-]\d{2,8}(?:[ .-]\d{2,8}){0,4}|\(?\d{3}\)?[ .-]\d{3}[ .-]\d{4}|555-0\d{3})(?![\w/]|[.-]\d)(?: (?:ext|Durchwahl|poste)\b\.? ?\d+)?"
)

_TYPES = "Street|St|Road|Rd|Lane|Ln|Row|Court|Ct|Close|Terrace|Avenue|Ave|Place|Square|Sq|Drive|Way|Hill|Gardens|Crescent"
_RUN = re.compile(r"[+(]?\d+")
_STREETS = ("straße", "strasse", "str", "gasse", "weg", "allee", "platz", "ring", "ufer", "damm", "steig", "chaussee")
_FLAT = re.compile(r"\b(?:Flat|Unit|Apartment|Apt\.?|Suite|FLAT|UNIT) \w{1,4},? ?$")
_NUMBERED = re.compile(rf"(?<![\w/.§-])\d{{1,4}} ?[A-Za-z]? (?:[A-ZÀ-Þ][\w'’-]+ ){{1,3}}(?:{_TYPES}|{_TYPES.upper()})\b(?! of\b| OF\b)")
_STREET_DE = re.compile(r"\b[A-ZÄÖÜ][\w-]*(?:[Ss]tra(?:ß|ss)e|STRA(?:ß|SS)E|[Ss]tr\.|[Gg]asse|GASSE|[Ww]eg|WEG|[Aa]llee|ALLEE|[Pp]latz|PLATZ|[Rr]ing|RING|ufer|UFER|damm|DAMM|steig|chaussee) \d{1,4} ?(?:[a-zA-Z]\b)?(?![./]\d)")
_NUMBERED_FR = re.compile(r"(?<![\w/.§-])\d{1,4} ?[a-zA-Z]?(?: (?:bis|ter|quater))?,? (?:rue|boulevard|bd|avenue|av\.|place|quai|chemin|impasse|allée|cours|route|passage|square|sentier|ruelle) (?:(?:de la|de l['’]|du|des|de|d['’]) ?)?[\w'’-]+", re.I)

_GIVEN = frozenset(
    """alban andré anselma bertil brita corvin cosima dagny detlev edda elske falko finja gerrit gunda hedda henrike håkon isolde ivo
    jannis jean-yorick jorun kaspian klara leontine lorenz maren marie-odette mathilde nils norwin odile oona pauline piet quirin
    rosalind rune severin sunniva søren thea tilde ulrika urs veit viggo wanda wilma xenia yorick zita zoë
    adam adrian alan albert alexander alice andrea andreas andrew angela anna anne anthony antoine arthur barbara benjamin bernard
    birgit brian camille caroline catherine charles charlotte christian christine christopher claire claude claudia daniel david
    denis dieter edward elisabeth elizabeth emily emma eric ernst eva felix florian françois françoise frank franz friedrich fritz
    gabriel george georg gerald gerhard günter hannah hans harald harry heinrich heinz helen helga helmut henri henry hugo ian
    ingrid isabelle jack jacques jakob james jan jane jean jennifer joachim johann johannes john jonathan joseph julia julie jürgen
    karen karin karl katharina kevin klaus kurt laura laurent leon linda louis louise lucas lucie ludwig luis manfred marc marcel
    margaret maria marie mark markus martin mary matthew matthias max michael michel michelle monique nathalie nicholas nicolas
    nicole olivier oliver otto patrick paul peter philip philippe pierre rachel rainer richard robert roger rudolf sabine samuel
    sandra sara sarah sebastian simon sophie stefan stephan stephen steven susan susanne sylvie thierry thomas ursula valérie
    victor vincent walter werner wilhelm william wolfgang xavier yves""".split()
)
#: Capitalised words that are no surname though they follow an initial, a title or a given name.
_STOP = frozenset(
    """the a an in on of at to by no and or for from with who whom whose that this these those it its he she his her their they we our if as
    when where while before after since until under upon between against according having secondly finally firstly order orders held
    headnote application appeal costs section case see court tribunal judge justice counsel neither either both para page part
    der die das den dem des ein eine einer und oder im am zum zur nach bei mit von für vor auf es sie er wir ihr wer wenn da ehe
    besetzung leitsatz tenor urteil beschluss vorinstanz herr frau richter richterin dagegen gleichwohl zudem insoweit
    le la les un une des du de et ou il elle on nous que qui si sur sous pour par avec sans entre voir composition dispositif attendu
    app rep rec val rev law reports mr mrs ms dr prof professor mme mlle me court v vs c name redacted email phone address withheld
    jr sr zeuge zeugin témoin messrs abs nr art ziff rn revised version lands high""".split()
)
_COMPANY = re.compile(r"\s(?:& \w|Ltd|LTD|plc|PLC|GmbH|GMBH|AG|SARL|SA|SE|KG|Inc|LLP|LLC|Co|(?:Holdings|Werke|Textiles|Freight|Estates|Shipping|Dredging|Timber|Power|Quarries|Mills|Vins|HOLDINGS|WERKE|TEXTILES|FREIGHT|ESTATES|SHIPPING|DREDGING|TIMBER|POWER|QUARRIES|MILLS|VINS))\b")

_CAP = r"[A-ZÀ-ÖØ-Þ][^\W\d_]*(?:['’-][^\W\d_]+)*"
_PART = r"(?:(?:van der|van den|van|von der|von dem|von|zu|de la|de|du|della|di|VAN DER|VAN DEN|VAN|VON DER|VON|DE LA|DE|DU|Van der|Van|Von|De)[ ])?"
_INIT = r"(?:[A-ZÀ-ÖØ-Þ]\.(?:-?[A-ZÀ-ÖØ-Þ]\.)*[ ]?)"
_TITLED = re.compile(
    r"\b(?:Mr|Mrs|Ms|Miss|Dr|Prof|Professor|Professeur|Judge|Justice|Herrn?|Frau|Mlle|Mme|Me|M|Monsieur|Madame|Mademoiselle|Maître|Richter|Richterin|Juge|Sir|Lady|Lord"
    r"|MR|MRS|MS|MISS|DR|PROF|PROFESSOR|JUDGE|HERRN?|FRAU|MLLE|MME|ME|RICHTER|RICHTERIN)\b\.?[ ]"
    rf"(?=(?P<name>(?P<first>(?!(?:VAN|Van|VON|Von|DE|De|DU)\b){_CAP})?(?P<mid>(?:(?<=\w)[ ])?{_INIT}*)[ ]?{_PART}(?P<last>{_CAP})?))"
)
_WORD = re.compile(r"(?<![\w'’-])[A-ZÀ-ÖØ-Þ][\w'’-]*\.?")
_GIVENS = re.compile(rf"(?P<first>{_CAP})[ ](?P<mid>{_INIT}*){_PART}(?P<last>{_CAP})")
_INITIAL = re.compile(rf"(?<![\w'’.-])(?P<mid>{_INIT}+){_PART}(?P<last>{_CAP})")
#: What stands before a given name that comes last.
_TURNED = re.compile(rf"(?<![\w'’-]){_PART}(?P<last>{_CAP}), $")
_FIRST = re.compile(_CAP)
_TURNED_END = re.compile(r"(?:[ ][A-ZÀ-Þ]\.)?(?![\w-])")
_TITLES = frozenset(
    """Mr Mrs Ms Miss Dr Prof Professor Professeur Judge Justice Herr Herrn Frau Mlle Mme Me M Monsieur Madame Mademoiselle Maître Richter Richterin
    Juge Sir Lady Lord MR MRS MS MISS DR PROF PROFESSOR JUDGE HERR HERRN FRAU MLLE MME ME RICHTER RICHTERIN""".split()
)
#: After these a lone "M." is an initial in French text too.
_NAMED = re.compile(r"(?:signifié à|[Tt]émoin|requérante?:|appellant:|[Aa]ccording to|selon|ging an|Zeugin|Zeuge) $")
#: Of these the ones within a sentence, where a name may go on in the next line.
_WITHIN = re.compile(r"(?:served on|signed by|put to|remise? par|chez|von|signifié à|[Tt]émoin|[Aa]ccording to|selon|ging an|Zeugin|Zeuge) $")
_FRENCH = re.compile(r"\b(?:le|la|les|que|une|est|été|du|au)\b")
_TITLE_BEFORE = re.compile(r"\b(?:Mr|Mrs|Ms|Mme|Mlle|Me|Dr|Herr|Frau)\b", re.I)


def _surname(word: str | None, whole: str, end: int) -> bool:
    """Whether a capitalised word that ends at `end` can be a surname."""
    return bool(word) and len(word) > 2 and word.lower() not in _STOP and not _COMPANY.match(whole, end)


def _title_m(t: str, at: int, end: int) -> bool:
    """Whether the "M." at `at` is the French title and no initial."""
    if _NAMED.search(t, max(0, at - 20), at):
        return False
    around = t[max(0, at - 200) : at + 200]
    if re.match(r"[^\n]{0,40}? (?:v|V|c|contre|\./\.)\.? ", t[end : end + 50]) or re.search(r" (?:v|V|\./\.)\.? $", t[max(0, at - 6) : at]):
        return bool(_TITLE_BEFORE.search(t[max(0, at - 40) : at] + " " + t[end : end + 40]))
    return len(_FRENCH.findall(around)) >= 4


def _titled(t: str, m: re.Match) -> tuple[int, int] | None:
    """The name after a title."""
    first, last, start = m["first"], m["last"], m.start("name")
    if m[0].strip(" .") == "M" and not _title_m(t, m.start(), m.end()):
        return None
    if first and first.lower() in _GIVEN:
        return (start, m.end("last")) if first.lower() not in _STOP and _surname(last, t, m.end("last")) else None
    if first and not m["mid"].strip() and len(first) > 2:
        return (start, m.end("first")) if _surname(first, t, m.end("first")) else None
    if (not first or m["mid"].strip()) and _surname(last, t, m.end("last")) and (not first or first.lower() not in _STOP):
        return start, m.end("last")
    return None


class _Found:
    """Spans of a normalised text, by what was found first where they overlap."""

    def __init__(self):
        self.taken: list[tuple[int, int, str]] = []

    def free(self, a: int, b: int) -> bool:
        return all(b <= x or y <= a for x, y, _ in self.taken)

    def take(self, kind: str, a: int, b: int) -> None:
        if self.free(a, b):
            self.taken.append((a, b, kind))


def _emails(t: str, found: _Found) -> None:
    at = t.find("@")
    while at >= 0:
        if m := _DOMAIN.match(t, at):
            a = at
            while a and (t[a - 1].isalnum() or t[a - 1] in "._+-"):
                a -= 1
            while a < at and not t[a].isalnum():
                a += 1
            if a < at:
                found.take("email", a, m.end())
        at = t.find("@", at + 1)


def _numbers(t: str, found: _Found) -> None:
    """Identity numbers by label and by shape, phone numbers, and addresses with the number first."""
    low = t.lower()
    low = low if len(low) == len(t) else t
    done = 0
    for d in _DIGITS.finditer(t):
        lo = max(done, d.start() - 60)
        window = low[lo : d.start()]
        if any(w in window for w in _LABELLED):
            for m in _LABEL.finditer(t, lo, d.start()):
                done = m.end()
                if (n := _NUMBER.match(t, m.end())) and sum(map(str.isdigit, n[1])) >= 6:
                    found.take("id_number", n.start(1), n.start(1) + len(n[1].rstrip(" .,/-")))
    runs = [m.span() for m in _RUN.finditer(t)]
    for at, end in runs:
        if end - at in (2, 3, 8) or (end - at == 6 and t[end : end + 1] == "/"):
            for start in (at, at - 2 if t[at - 2 : at].isupper() else -1, at - 3 if t[at - 3 : at - 1].isupper() else -1):
                if start >= 0 and (m := _SHAPE.match(t, start)):
                    found.take("id_number", m.start(), m.end())
    for at, end in runs:
        for start in (at, at + 1) if t[at] == "(" else (at,):
            digits = end - start - (t[start] in "+(")
            if (t[start] in "+(0" or (digits == 3 and t[end : end + 1] in (" ", ".", "-", ")"))) and (m := _PHONE.match(t, start)) and (9 <= sum(map(str.isdigit, m[0])) <= 20 or m[0].startswith("555-")):
                found.take("phone", m.start(), m.end())
    for at, end in runs:
        if end - at > 4 or t[at] in "+(" or not (t[end : end + 1] in (" ", ",") or t[end : end + 1].isalpha()):
            continue
        if m := _NUMBERED.match(t, at):
            flat = _FLAT.search(t, max(0, at - 20), at)
            found.take("address", flat.start() if flat else at, m.end())
        elif m := _NUMBERED_FR.match(t, at):
            found.take("address", at, m.end())


def _turned(t: str, at: int) -> tuple[int, int] | None:
    """The name whose given name begins at `at`, if a surname and a comma stand before it."""
    if t[at - 2 : at] != ", " or not (m := _TURNED.search(t, max(0, at - 48), at)) or not (first := _FIRST.match(t, at)):
        return None
    end = _TURNED_END.match(t, first.end())
    return (m.start(), end.end()) if end and m["last"].lower() not in _GIVEN and _surname(m["last"], t, m.end("last")) else None


def _words(t: str, found: _Found, one_line: Callable[[int, int], bool]) -> None:
    """Addresses with the street first, and names: all capitalised words are met once."""
    titles, given, initials = [], [], []
    for m in _WORD.finditer(t):
        at, word = m.start(), m[0].rstrip(".")
        if word in _TITLES:
            titles.append(at)
        if len(word) == 1:
            if m[0] != word:
                initials.append(at)
            continue
        low = word.lower()
        if low in _GIVEN:
            given.append(at)
        if low.endswith(_STREETS) and (street := _STREET_DE.match(t, at)):
            found.take("address", at, street.end())
    for at in titles:
        if (m := _TITLED.match(t, at)) and (span := _titled(t, m)):
            found.take("name", *span)
    turned = {at: span for at in given if (span := _turned(t, at))}
    done = 0
    for at in given:
        if at < done or not (m := _GIVENS.match(t, at)) or not _surname(m["last"], t, m.end("last")) or not found.free(at, m.end()):
            continue
        if at in turned and not one_line(at, m.end()) and found.free(*turned[at]):
            found.take("name", *turned[at])  # the next line is another matter
        else:
            done = m.end("last")
            found.take("name", at, done)
    for at in initials:
        if at and t[at - 1] in ".":
            continue
        m = _INITIAL.match(t, at)
        if not m or not found.free(at, m.end()) or not _surname(m["last"], t, m.end()):
            continue
        before = t[max(0, at - 20) : at]
        if one_line(at, m.end()):
            good = _NAMED.search(before) or (f" {m['last'].lower()} " not in t and not (re.match(r"\.? \d", t[m.end() : m.end() + 3]) and one_line(m.end(), m.end() + 2)))
        else:
            good = _WITHIN.search(before)
        if good:
            found.take("name", at, m.end())
    for span in turned.values():
        found.take("name", *span)


def spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the personal data in a text, in characters from 0, without overlaps."""
    tape = normalised(text)
    t, found = tape.text, _Found()

    def one_line(a: int, b: int) -> bool:
        x, y = tape.source(a, b)
        return "\n" not in text[x:y]

    _emails(t, found)
    _numbers(t, found)
    _words(t, found, one_line)
    return [(kind, *tape.source(a, b)) for a, b, kind in sorted(found.taken)]


def found(documents: DataFrame) -> DataFrame:
    """(doc_id, kind, start_pos): each piece of personal data in the texts.

    Documents without text or without id have no rows; an empty table gives none.
    """
    require(documents, "doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(d, k, a) for d, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) for k, a, _ in spans(t)]
            yield pa.record_batch([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.string()), pa.array([r[2] for r in rows], pa.int64())], names=["doc_id", "kind", "start_pos"])

    return documents.where("doc_id IS NOT NULL AND text IS NOT NULL").select("doc_id", "text").mapInArrow(run, "doc_id bigint, kind string, start_pos bigint")


def replaced(text: str) -> str:
    """The text with typed placeholders such as [EMAIL] for its personal data."""
    out, at = [], 0
    for kind, a, b in spans(text):
        out += [text[at:a], f"[{kind.upper()}]"]
        at = b
    return "".join(out) + text[at:]


def redacted(documents: DataFrame) -> DataFrame:
    """(doc_id, text): the texts with typed placeholders; null texts stay null."""
    require(documents, "doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.record_batch([batch.column(0), pa.array([t if t is None else replaced(t) for t in batch.column(1).to_pylist()], pa.string())], names=["doc_id", "text"])

    return documents.select(F.col("doc_id"), F.col("text")).mapInArrow(run, "doc_id bigint, text string")
