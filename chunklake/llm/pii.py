"""Personal information in free text: mail addresses, phone numbers, identity numbers, street addresses and names.

Candidates are found in few passes over a text: signs of a mail address, runs of digits, words for streets, and words with
capitals. Each is then judged by general features. Numbers: the forms of numbering plans and of identity schemes, or any long
number beside a word that announces one. Names: a score from classes of words beside them (titles, greetings, closings, field
labels, roles, verbs of persons, prepositions), other finds next to them, their shape, and a list of names with the endings that are
usual in it; words for things count against them. Finds are replaced by typed placeholders; numbers and dates by pseudonyms of
their own format (`pseudonyms`).
"""

from __future__ import annotations

import hashlib
import re
import secrets
import unicodedata
from bisect import bisect_left
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from chunklake.common import spread
from chunklake.llm.pseudonyms import DATE, canonical_phone, compact, link, pseudonym_date, pseudonym_identity, pseudonym_phone, scheme

KINDS = ("email", "phone", "identity", "address", "name")
Find = tuple[str, int, int]
Span = tuple[int, int]

U = r"A-ZÀ-ÖØ-ÞĀĂĄĆĈĊČĎĐĒĔĖĘĚĜĞĠĢĤĦĨĪĬĮİĴĶĹĻĽĿŁŃŅŇŊŌŎŐŒŔŖŘŚŜŞŠŢŤŦŨŪŬŮŰŲŴŶŸŹŻŽ"
LOW = "a-zß-öø-ÿāăąćĉċčďđēĕėęěĝğġģĥħĩīĭįıĵķĺļľłńņňŋōŏőœŕřśŝşšţťŧũūŭůűųŵŷźżž"
L = U + LOW
BLANK = r"[ \u00a0\u202f\u3000]"


def _set(words: str) -> frozenset[str]:
    return frozenset(words.split())


# ---------------------------------------------------------------- mail addresses

_SIGN = re.compile(r"[@＠]|[(\[\s](?:at|AT)[)\]\s]")
_LOCAL = re.compile(rf"(?<![{L}0-9._%+'\-/@])[{L}0-9](?:[{L}0-9._%+'\-]*[{L}0-9_+\-])?$")
_LABEL = rf"[{L}0-9](?:[{L}0-9\-]*[{L}0-9])?"
_DOT = r"(?:\.|\s?(?:\[dot\]|\(dot\)|\[DOT\]|\(DOT\))\s?)"
_HOST = re.compile(rf"{_LABEL}(?:{_DOT}{_LABEL})*{_DOT}[A-Za-z]{{2,}}(?![{L}0-9])")
_SPELT = re.compile(rf"{_LABEL}(?:\s(?:dot|DOT)\s{_LABEL})*\s(?:dot|DOT)\s[A-Za-z]{{2,}}(?![{L}0-9])")
_LONGEST_LOCAL = 128


def _mails(text: str) -> Iterator[Span]:
    spelt = " dot " in text or " DOT " in text
    if not (spelt or "@" in text or "＠" in text or "at)" in text or "at]" in text or "AT)" in text or "AT]" in text):
        return
    for m in _SIGN.finditer(text):
        word = m[0].strip() in ("at", "AT")
        if word and not spelt:
            continue
        a, b = m.span()
        if not word:  # a blank on either side
            a -= text[a - 1 : a].isspace()
            b += text[b : b + 1].isspace()
        if not (host := (_SPELT if word else _HOST).match(text, b)):
            continue
        if local := _LOCAL.search(text, max(0, a - _LONGEST_LOCAL), a):
            yield local.start(), host.end()


# ---------------------------------------------------------------- numbers

S = r"[ \u00a0\u202f.\-\u2011/]"  # what separates groups of digits

_PHONES = [
    # a country code: +, 00 or in brackets, then 8 to 13 digits in groups
    rf"\(\+\d{{1,3}}\){S}?\d(?:{S}?\d){{6,12}}",
    rf"\+\d{{1,3}}{S}?(?:\(0?\d{{0,4}}\){S}?)?\d(?:{S}?\d){{6,12}}",
    rf"00[1-9]\d(?:{S}?\d){{8,12}}",
    # North America: area and exchange begin with 2 to 9
    rf"\([2-9]\d\d\){S}?[2-9]\d\d{S}\d{{4}}(?: ext\.? ?\d{{1,5}})?",
    rf"(?:1{S})?[2-9]\d\d(?P<sep>{S})[2-9]\d\d(?P=sep)\d{{4}}(?: ext\.? ?\d{{1,5}})?",
    # trunk zero: mobile and geographic area codes
    rf"07\d{{3}}{S}?\d{{6}}",
    r"02\d \d{4} \d{4}",
    rf"\(0\d{{2,4}}\){S}?\d{{3,8}}(?:[ \-]\d{{3,4}})?",
    rf"0\d{{2,4}}[ \u00a0/\-]\d{{6,8}}",
    # five pairs of digits
    rf"0[1-9](?P<fr>{S})\d\d(?P=fr)\d\d(?P=fr)\d\d(?P=fr)\d\d",
    r"0[67]\d{8}",
    r"01\d\d \d{3} \d{4}|01\d{3} \d{6}|0[1-9]\d-\d{3,4}-\d{4}",
]
PHONE = re.compile(rf"(?<![\w.+/:\-])(?<!\d[ ,\u00a0\u202f])(?:{'|'.join(_PHONES)})(?![\w@]|[.\-/,:]\d)")

_IDENTITY = [
    r"\d{3}(?P<ss>[ \u00a0\-])\d\d(?P=ss)\d{4}",  # social security
    r"(?:QQ|[A-CEGHJ-PR-TW-Z]{2}) ?\d\d ?\d\d ?\d\d ?[A-D]",  # national insurance
    r"[A-Z]\d{8}",  # passports and cards
    r"[A-Z](?=[A-Z0-9]*\d[A-Z])[0-9A-Z]{8}\d",
    r"[XYZ][\-. ]?\d{7}[\-. ]?[A-Z]",  # residents of Spain
    r"\d\d\.\d{3}\.\d{3}-[A-Z]|\d{8}-?[A-Z]",
    r"\d{3}\.\d{3}\.\d{3}-\d\d",  # Brazil
    r"[12789] ?\d\d ?\d\d ?\d\d ?\d{3} ?\d{3} ?\d\d",  # France
    r"\d\d \d{3} \d{3} \d{3}",  # German tax
    r"[2-9]\d{3} \d{4} \d{4}",  # twelve digits with a check digit
    r"[A-Z]{6}\d\d[A-EHLMPRST]\d\d[A-Z]\d{3}[A-Z]",  # Italy
]
IDENTITY = re.compile(rf"(?<![\w.+\-/@=])(?:{'|'.join(_IDENTITY)})(?![\w=]|[.\-/]\w)")

#: a number without a form of its own: digits in groups, or letters and digits
_BARE = re.compile(rf"(?<![\w@#+/])(?=[A-Z(]{{0,2}}{S}?\d)\(?[A-Z0-9](?:[)(]?{S}?[(]?[A-Z0-9]){{5,18}}(?![\w@])")

#: where any of the three may begin
_ANCHOR = re.compile(r"[\d+(A-Z](?<![\w@#+/][\d+(A-Z])(?:(?<![A-Z])|(?=[A-Z]{0,5}[ \u00a0.\-]?\d))(?=(?:[)( +\u00a0\u202f.\-\u2011/]{0,2}[A-Z0-9]){5})")

_PHONE_WORDS = _set("""phone phones mobile cell cellphone tel telephone telefon telefonnummer teléfono telefone telemóvel tél téléphone telefono telefoon handy
    handynummer móvil celular portable cellulare number numbers call calling text fax whatsapp ring reach dial nummer rückruf unter rappelez llamad llame llamar appeler
    appelez anrufen chiamare ligue numéro 電話は 電話番号は 電話 电话 手机 携帯""")  # fmt: skip
_IDENTITY_WORDS = _set("""ssn social security insurance passport passport-no id id_no idno identity identification tax tax_id taxid tin steuer-id steuer-identifikationsnummer steuernummer
    ausweis ausweisnummer personalausweis personalausweisnummer reisepass reisepassnummer dni nie nif nss nir cni cpf aadhaar aadhar pan curp rut pesel bsn nino licence license
    sécurité sociale fiscal pasaporte passeport passaporte codice 身分証番号は 身分証番号 身份证 身份证号 マイナンバーは マイナンバー""")  # fmt: skip
#: words that announce a number of something else
_OTHER_WORDS = _set("""ticket job build offset row seq line lines order invoice block chunk layer port version offsets bytes seed step steps issue case account iban card auftrag zeile
    commit hash rev shard shards page tokens parameter parameters iso rfc isbn row: art sku""")  # fmt: skip
_WORDS_BEFORE = re.compile(r"[^\W\d](?:[^\W\d]|[_\-](?=\w))*")
#: words that may stand between such a word and its number
_FILLERS = _set("""no nr num number nummer number's n is lautet es est é è on me at bitte an al le am of was my mein meine ist to der die das el la under unter please number:
    the sur card fiscal insurance security passport sécurité sociale and his her or que von du de""")  # fmt: skip


def _announced(text: str, a: int) -> str:
    """What the words shortly before a place announce: phone, identity, other or nothing."""
    before = text[max(0, a - 48) : a]
    cut = max(before.rfind("\n"), before.rfind(";"), before.rfind("|"), before.rfind(". "))
    before = before[cut + 1 :]
    words = [w.lower() for w in _WORDS_BEFORE.findall(before)][-5:]
    for n, w in enumerate(reversed(words)):
        if w in _IDENTITY_WORDS and w not in ("insurance", "security", "fiscal", "social") or w in ("insurance", "security", "fiscal") and len(words) > n + 1 and words[-n - 2] in ("national", "social", "número", "numero"):
            return "identity"
        if w in _OTHER_WORDS:
            return "other"
        if w in _PHONE_WORDS and not (w in ("number", "numbers", "nummer", "numéro", "unter") and len(words) > n + 1 and words[-n - 2] in _IDENTITY_WORDS | _OTHER_WORDS):
            return "phone"
        if w not in _FILLERS:
            break
    return "phone" if before.endswith(("電話は", "电话", "電話")) else "identity" if before.endswith(("番号は", "身份证号")) else ""


_CODE_WORD = re.compile(r"([A-Z]{2,6})[ .:\-]+(?=\S*\d)")


def _twelve(text: str) -> bool:
    """Twelve digits in groups of four are an identity number only if their check digit is right."""
    return (s := scheme(compact(text))) is not None and s[0] == "aadhaar"


_TWELVE = re.compile(r"\d{4} \d{4} \d{4}")


def _numbers(text: str) -> Iterator[Find]:
    """Phone and identity numbers, those announced by words first."""
    after = {PHONE: 0, IDENTITY: 0, _BARE: 0}  # matches of one pattern don't overlap
    formed, bare = [], []
    for at in _ANCHOR.finditer(text):
        x = at.start()
        for p, end in after.items():
            if x >= end and (m := p.match(text, x)):
                after[p] = m.end()
                if p is PHONE:
                    formed.append(m.span())
                    yield "phone", *m.span()
                elif p is _BARE:
                    bare.append(m)
                elif not (_TWELVE.fullmatch(m[0]) and not _twelve(m[0])):
                    yield "identity", *m.span()
    for m in bare:
        a, b = m.span()
        digits = sum(map(str.isdigit, m[0]))
        if digits < 6 or text[a - 1 : a] in ("-", ".", ",") and text[a - 2 : a - 1].isalnum():
            continue
        what = _announced(text, a)
        if what == "identity":
            if (w := _CODE_WORD.match(m[0])) and w[1].lower() in _IDENTITY_WORDS:
                a += w.end()  # the word is part of the run
            yield "identity", a, b
        elif what == "phone" and all(b <= x or a >= y for x, y in formed) and 7 <= digits <= 15 and digits >= len(compact(m[0])) and not DATE.fullmatch(m[0]):
            if text[a] == "(" and ")" not in m[0]:
                a += 1
            yield "phone", a, b


_FIELD = re.compile(r"[^;]+")
_NUMBER_FIELD = re.compile(rf"[(+]{{0,2}}[A-Z0-9](?:[)(]?{S}?[(]?[A-Z0-9]){{5,18}}")


def _in_records(text: str, finds: list[Find]) -> Iterator[Find]:
    """Numbers that fill fields of a record: a line of three fields or more that begins with a name.

    A field that could be either or has no form of its own is an identity number if it is the record's first number, else a phone number."""
    if text.count(";") < 2:
        return
    at = 0
    for line in text.split("\n"):
        began, at = at, at + len(line) + 1
        if line.count(";") < 2:
            continue
        fields = [(m[0].strip(), began + m.start() + len(m[0]) - len(m[0].lstrip())) for m in _FIELD.finditer(line)]
        if not fields or not (first := _FIRST.search(fields[0][0][-64:])) or not first["n"]:
            continue
        numbers = [(v, a) for v, a in fields[1:] if _NUMBER_FIELD.fullmatch(v) and not DATE.fullmatch(v) and sum(map(str.isdigit, v)) >= 6]
        for i, (value, a) in enumerate(numbers):
            kinds = {k for k, x, y in finds if x == a and y == a + len(value)}
            if i == 0 and "identity" not in kinds and value[0] != "(" and (not kinds or len(numbers) > 1):
                yield "identity", a, a + len(value)
            elif not kinds and value[0] in "(0123456789" and not re.search(r"[A-Z]", value):
                yield "phone", a, a + len(value)


# ---------------------------------------------------------------- street addresses

_CAPS = r"(?:(?:St\. |de la |de los |de las |del |des |du |de |d'|von |van )?[A-ZÀ-Þ][\w'’\-]*[ ]?){1,3}"
_TOWN = r"[A-ZÀ-Þ][\w'’\-]+(?:(?: am| an der| la| de| upon| on)? [A-ZÀ-Þ][\w'’\-]+)?"
_END = r"(?=[,.;|\"\n\r<)]|\s*$|  | \|)"
#: what may follow the street, on the same line or the next: town and code, or code and town
_AFTER_EN = rf"(?:(?:, ?|\r?\n ?){_TOWN}(?: [A-Z]{{1,2}}\d[A-Z\d]? \d[A-Z]{{2}}|, [A-Z]{{2}} \d{{5}}|{_END}))?"
_AFTER = rf"(?:(?:, ?|\r?\n ?)(?:[A-Z]{{1,2}}-)?\d{{2}}-?\d{{2,3}} {_TOWN}| in {_TOWN}|, {_TOWN}{_END})?"
_EN_TYPES = "Street St Road Rd Lane Ln Avenue Ave Court Ct Blvd Boulevard Terrace Square Close Drive Dr Way Crescent Gardens Grove Mews Hill Place Parkway Highway Walk Row Circle Trail".split()
_FR_TYPES = "rue avenue place boulevard chemin impasse allée quai route cours av pl bd".split()
_ES_TYPES = "Calle Avda Avenida Paseo Plaza Pza Camino Travesía Ronda Rua Travessa Largo Praça C/ Via Viale Piazza Corso Vicolo Largo".split()
_NUMBER = r"\d{1,4} ?[A-Za-z]?(?![\w])"
_DE_ENDS = "straße strasse str\\. gasse weg allee platz ufer damm ring straat laan gracht plein gatan vägen".split()
_PL_TYPES = "ul al pl os".split()
_AM_TYPES = "Am,An der,An den,Im,In der,Zum,Zur,Unter den,Auf dem".split(",")


def _words(words: list[str]) -> str:
    """A pattern of words, parted by their first letters, so that a place in a text is given up at one letter."""
    by: dict[str, list[str]] = {}
    for w in words:
        by.setdefault(w[0], []).append(re.escape(w[1:]))
    return "|".join(f"{re.escape(c)}(?:{'|'.join(r)})" for c, r in by.items())


#: words of one of which an address has, all together and by pattern
_KINDS = {"en": _EN_TYPES, "fr": _FR_TYPES, "es": _ES_TYPES, "pl": [f"{t}." for t in _PL_TYPES], "am": _AM_TYPES}
_KIND_OF = {w: k for k, v in _KINDS.items() for w in v}
_ANY_SIGN = re.compile(rf"[\s.\"|(](?:{_words([w for v in _KINDS.values() for w in v])})(?![{L}])")
_DE_SIGN = re.compile(rf"(?:{'|'.join(_DE_ENDS)}) ?\d")
ADDRESSES = {
    "en": re.compile(rf"\b(?:(?:Flat|Apt\.?|Apartment|Unit|Suite) \d+[a-z]?,? )?\d{{1,4}}[A-Za-z]?,? {_CAPS}(?<=[ .])(?:{'|'.join(_EN_TYPES)})\b\.?(?!\w){_AFTER_EN}"),
    "de": re.compile(rf"\b[A-ZÄÖÜ][a-zäöüßåA-Z\-]+ ?(?:{'|'.join(_DE_ENDS)}) {_NUMBER}{_AFTER}"),
    "fr": re.compile(rf"\b\d{{1,4}}[a-z]?(?: (?:bis|ter|quater))?,? (?:{'|'.join(_FR_TYPES)})\b\.? (?:[dl]['’]|de la |de l['’]|de |du |des |le |la )?[A-ZÀ-Þ][\w'’\-]*{_AFTER}"),
    "es": re.compile(rf"(?:\bC/|\b(?:{'|'.join(_ES_TYPES)})\b\.?) (?:de la |de los |de las |del |de |do |da |das |dos |della |dei |di )?[A-ZÀ-Þ][\w\-]*(?: [A-ZÀ-Þ][\w\-]*)*,?(?: n\.?º)? {_NUMBER}(?:, \d+\.º [A-Z])?{_AFTER}"),
    "pl": re.compile(rf"\b(?:{'|'.join(_PL_TYPES)})\. [{U}][\w\-]+(?: [{U}][\w\-]+)? {_NUMBER}(?:/\d+)?{_AFTER}"),
    "am": re.compile(rf"\b(?:{'|'.join(_AM_TYPES)}) [{U}][\w\-]+ {_NUMBER}, \d{{5}} {_TOWN}"),
}


def _addresses(text: str) -> Iterator[Span]:
    for m in _ANY_SIGN.finditer(text):
        kind = _KIND_OF[m[0][1:]]
        whole = ADDRESSES[kind]
        if kind in ("en", "fr"):  # the number comes before the word
            if _HOUSE.search(text, max(0, m.start() - _BEFORE), m.end()):
                for w in whole.finditer(text, max(0, m.start() - _BEFORE), m.end() + _BEHIND):
                    yield w.span()
        elif w := whole.match(text, m.start() + 1):
            yield w.span()
    if text.startswith(_AT_START):
        for kind in ("es", "pl", "am"):
            if w := ADDRESSES[kind].match(text):
                yield w.span()
    for m in _DE_SIGN.finditer(text):
        for w in ADDRESSES["de"].finditer(text, max(0, m.start() - _BEFORE), m.end() + _BEHIND):
            yield w.span()


_HOUSE = re.compile(r"\d[A-Za-z]?,? [A-Za-zÀ-Þ]")
#: how far an address reaches before and behind its word for the street
_BEFORE, _BEHIND = 80, 200
_AT_START = tuple(_ES_TYPES) + tuple(f"{t}. " for t in _PL_TYPES) + tuple(f"{t} " for t in _AM_TYPES)


# ---------------------------------------------------------------- names

_WORD = rf"[{U}][{L}’']*(?:-[{U}][{L}’']*)*"
_INITIAL = rf"[{U}]\."
_PARTICLE = r"(?:van der|van den|van|von der|von|de la|del|de|du|af|zu|di|da|dos|bin|ibn|ter|ten)"
_GAP = rf"{BLANK}{{1,3}}"
#: words with capitals that follow each other: what may be a name, with titles, greetings and ordinary words around it
_RUN = re.compile(rf"(?<![{L}0-9/@._\-])(?:{_INITIAL}|{_WORD})(?:{_GAP}(?:{_PARTICLE}{_GAP})?(?:{_INITIAL}|{_WORD}))*(?![{L}0-9/@_])")
_TOKEN = re.compile(rf"{_INITIAL}|{_WORD}")
#: a field that is a name and nothing else, in any case of letters
_ANY = rf"(?:[{L}]\.|[{L}][{L}’'\-]*)"
_NAME_FIELD = re.compile(rf"{_ANY}(?:,?{_GAP}{_ANY}){{0,4}}")
_LOWER = re.compile(rf"[{LOW}]{{4,}}")
_SMALL_PAIR = re.compile(
    rf"(?<![{L}0-9/@._\-])(?=(?P<a>[{LOW}]{{2,}}(?:-[{LOW}]{{2,}})*){_GAP}(?:[{LOW}]\.{_GAP})?(?:{_PARTICLE}{_GAP})?(?P<b>[{LOW}]{{3,}}(?:-[{LOW}]+)*)(?![{L}0-9/@_]|\.[{L}]))"
)

TITLES = _set("""dr mr mrs ms miss mme mlle prof professor herr frau señora señor señorita sra sr srta monsieur madame mademoiselle m doña don sig signor signora dott senhor
    senhora sir lady doctor docteur doktor herrn pan pani""")  # fmt: skip
GREETINGS = _set("""hi hello hey dear hallo liebe lieber bonjour salut cher chère hola estimado estimada querido querida olá caro cara prezado prezada ciao gentile moin servus
    hej morning afternoon evening tag buenas buenos beste""")  # fmt: skip
CLOSINGS = _set("""regards best cheers thanks thank yours sincerely faithfully wishes gruß gruss grüße grüßen mfg vg lg saludo saludos cordialement vous obrigado obrigada
    amitiés saluti atentamente abraço abrazo respectfully love merci danke gracias""")  # fmt: skip
LABELS = _set("""from to cc bcc sender reply-to name full_name fullname full-name first-name surname lastname author owner contact contacts user username recipient customer
    client patient employee operator maintainer assignee reporter applicant signed nombre apellido apellidos nom prénom vorname nachname kunde kundin absender
    empfänger von an de à nome cliente signed-off-by reviewed-by reported-by tested-by acked-by co-authored-by approved-by written-by by editor manager attn holder""")  # fmt: skip
ROLES = _set("""patient doctor nurse operator manager colleague customer client author friend brother sister husband wife teacher lawyer director engineer applicant
    defendant minister president senator judge officer hausmeister nachbarn vizinha vizinho vicino vicina dottor dottoressa avvocato abogado abogada enfermera hija hijo figlio
    candidate employee student neighbour neighbor mother father son daughter boss uncle aunt cousin maintainer kollege kollegin nachbar nachbarin kunde kundin arzt ärztin patientin
    collègue voisin voisine cliente colega amigo amiga hermano hermana médico doctora tenant landlord driver witness""")  # fmt: skip
LONG_TITLES = _set("señora señor señorita doña don madame monsieur mademoiselle signora signor senhor senhora docteur doctor herr frau pan pani")
FRENCH = _set("garde a est habite vit vient dit et sera était tient nous vous demande")
#: verbs and nouns before a person, and the words that may stand between
ASKS = _set("""ask asks asked contact contacted meet met speak spoke talk talked phone phoned email emailed mail mailed visit visited thank thanked with named called
    name is heiße heiss heißt llamo llama appelle m'appelle chiamo kontaktieren contacter contacta contacte fragen wende demander preguntar reported signed written sent
    wife husband thanks request antrag demande meet interviewed hired told joined gemeldet signalé avisó firmado firmada unterzeichnet saw invited paid""")  # fmt: skip
JOINS = _set("for to with by from and von par por an à a de e und et y bei pour para with mit avec con is is: was ist est es são signé i'm i’m am bin soy suis per tot mio")
STRONG = _set("i'm i’m heiße llamo m'appelle chiamo named avisó signalé gemeldet appelle")
VERBS = _set("""wrote writes said says asked asks replied told reported mentioned presented founded forgot opened teaches teached pleaded thinks thought knows knew came went lives
    telefonou riceve answered signed born née né nacido nacida geboren schrieb écrit escribió dijo sagte lives
    lived wohnt habite vive works has had hat tiene garde keeps called met aged spoke explained escreveu disse tem a-dit scrive ha""")  # fmt: skip
#: things whose names are no persons'; a word of these right before or behind counts against
THINGS = _set("""machine machines maschine maschinen máquina máquinas release releases relay relais relé branch model models version server servers host hosts map street road lane
    ship project team company node tool library city town village river lake mount valley bay island port station bridge university school college hospital church hotel
    cluster rack board app package module view sensor switch switches gmbh ltd inc llc corp ag sa plc archive protocol theorem award prize edition party system engine
    disk drive cache queue file files format codec series festival album song book film movie game brand street-view museum park""")  # fmt: skip
ARTICLES = _set("the a an die der das den dem le la les el los las un una une il lo gli i l' this that our their its your my his her these those every each")
PLACES = _set("in at near bei aus en à nach near im am of")
#: what a name never begins, ends or consists of: ordinary words that open sentences, days, months, acronyms' company
STOP = _set("""the a an this that these those it its it's we you they he she i there here what when where why how who whose whoever which if and or but not no yes so as at by for
    from in into of on to up with without after before since until while because although once twice again also still just only even every each any all some both many most
    few one two three four five six seven eight nine ten first second third last next new old good best great please note notes update updated honestly seen today tomorrow
    yesterday now then later soon never always nobody somebody anybody everyone everybody everything nothing something let let's can could would should may might must will
    shall do does did don't is are was were be been being have has had having keep keeps set see ask tell try use using add remove open close call mail send sent receive
    received everyone's could there's that's what's world team folks guys friends welt monde mundo zusammen miteinander tous toutes todos todas tutti sirs madam concern
    ladies gentlemen customer support service services sales admin info help monday tuesday wednesday thursday friday saturday sunday january february march april june july
    september october november december mon tue wed thu fri sat sun jan feb mar apr jun jul aug sep oct nov dec street flat ship row ticket build job shard block blocks
    root chunk peer small files offset release warn error debug passport social security national insurance number numbers phone mobile tel fax email address identity
    tax date day week month year time subject re fwd fw cc bcc der die das den dem ein eine einer eines und oder aber nicht kein keine ich du er sie es wir ihr im mi me mein meine mon ma my ist sind war
    wer was wann wo warum wie wenn nach vor mit ohne bei seit von aus auf für noch etwas heute gestern morgen jetzt dann bitte könnte kann zur info auftrag stück quittungen
    le la les un une des et ou mais ne pas je tu il elle nous vous ils elles est sont était qui que quoi quand où pourquoi comment si après avant avec sans depuis pour
    entre rien quelqu'un mise jour sur dans el los las una unos unas y o pero no yo tú él ella nosotros es son era quién qué cuándo dónde si después antes con sin desde por
    entre nadie alguien os as um uma e mas não eu ele ela nós são quem quando onde se depois antes com sem desde por entre ninguém alguém hi hello hey dear regards thanks
    cheers sincerely yours kind warm thank you ok okay fyi asap ps p.s usa uk eu us gb mb kb tb gib mib kib am pm id ids url api cpu gpu ram sql json http https pdf
    server board good morning afternoon evening""")  # fmt: skip
#: as `STOP`, but whole: words that stand where names do, in greetings and fields
NOBODY = _set("all everyone team folks there you world both friends colleagues again none null nobody unknown anonymous admin root user users support sales n/a na various me us them him her it")


#: common given names that are no ordinary words of the languages above; they need less beside them than names of a list that may be words
COMMON = _set("""james john robert michael david william richard joseph thomas charles christopher daniel matthew anthony steven andrew paul joshua kevin brian george edward
    ronald jason jeffrey ryan jacob gary nicholas eric jonathan stephen larry justin scott brandon benjamin samuel gregory alexander patrick mary patricia jennifer linda
    elizabeth barbara susan jessica sarah karen lisa nancy betty sandra margaret ashley kimberly emily donna michelle carol amanda melissa deborah stephanie rebecca laura
    sharon cynthia kathleen amy angela anna emma olivia sophia sophie isabella julia marie maria peter hans klaus jürgen wolfgang stefan andreas markus martin michaela
    ursula monika petra sabine anneliese ingrid katharina pierre jean jacques michel philippe alain nicolas françois isabelle nathalie camille giovanni giuseppe marco paolo
    luca francesca giulia chiara josé juan carlos luis miguel javier antonio ignacio manuel carmen teresa lucía ana isabel joão pedro tiago beatriz mohammed ahmed fatima
    ali hassan yusuf ravi priya amit sanjay wei ming hiroshi yuki kwame""")  # fmt: skip


class Names:
    """A list of names and the endings that are usual in it."""

    def __init__(self, names: list[tuple[str, str]]):
        self.given = {fold(n) for n, r in names if r == "given"}
        self.family = {fold(n) for n, r in names if r == "family"}
        self.endings = {r: _endings({fold(n) for n, x in names if x == r}) for r in ("given", "family")}
        self.seen: dict[str, tuple[int, int]] = {}
        self.runs: dict[str, int] = {}  # words with capitals: 2 never a name, 1 like no name, 0 others
        self.plain: set[str] = set()  # those seen that are like no name

    def like(self, word: str) -> tuple[int, int]:
        """As a given and as a family name: 2 in the list, 1 has an ending of it, 0 neither."""
        if (known := self.seen.get(word)) is not None:
            return known
        w = fold(word)
        parts = w.split("-")
        out = (3, 0) if w in COMMON and word[:1].isupper() else tuple(
            2 if w in listed or any(p in listed for p in parts) else int(len(w) >= 4 and w.endswith(self.endings[role]))
            for role, listed in (("given", self.given), ("family", self.family))
        )
        if len(self.seen) >= 1 << 16:
            self.seen.clear()
            self.plain.clear()
        self.seen[word] = out
        if out == (0, 0):
            self.plain.add(word)
        return out


def fold(word: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFKD", word) if not unicodedata.combining(c)).casefold()


def _endings(words: set[str]) -> tuple[str, ...]:
    """Endings of three letters that at least 2 % of the words share."""
    n: dict[str, int] = {}
    for w in words:
        if len(w) > 4:
            n[w[-3:]] = n.get(w[-3:], 0) + 1
    return tuple(e for e, k in n.items() if k >= max(3, len(words) // 50))


_AFTER_WORD = re.compile(r"[^\w\n]{0,3}([^\W\d_][\w'’\-]*)?")
_DASH = re.compile(r"(?:^|\n|[.!?…]\s|\s)(?:—|–|--)\s?$")
_DAY = re.compile(r"\s{1,2}(?:on|am|el|le|em|il|dated|vom|du|del)\s(?=\d)")
THRESHOLD = 3
SENTENCE = (". ", "? ", "! ", ".\n", "\n\n", "")  # what stands before the first word of a sentence


def _lead(text: str, a: int) -> tuple[list[str], str]:
    """The three words before a place, in small letters, last first, and what stands between the last one and the place."""
    before = text[max(0, a - 44) : a]
    bare = before.rstrip(" \t\u00a0\u202f\r\n:,;=.\"'“„«<([|*>—–-")
    return [w.strip("\"'“„«([<,;|*") for w in bare.split()[:-4:-1]], before[len(bare) :]


def _judge(text: str, a: int, b: int, tokens: list[str], names: Names, starts: list[int], ends: list[int], lead: list[str] | None = None) -> int:
    """The score of the span as a name."""
    score = 0
    words = [t for t in tokens if not t.endswith(".")]
    kinds = [names.like(w) for w in words]
    given, family = max((k[0] for k in kinds), default=0), max((k[1] for k in kinds), default=0)
    if len(tokens) > 1:
        score += 1
        if len(words) > 1:
            first, last = kinds[0], kinds[-1]
            both = max(first[0] + last[1], first[1] + last[0])
            score += 2 if both >= 3 else 1 if both == 2 else 0
            score -= both == 3 and first[0] == 3 and words[-1].lower() in THINGS
            if both >= 2 and (first[0] and last[1] or first[1] and last[0]):
                score += 1
        else:
            score += 2 if given == 2 or family == 2 else 1  # an initial and a word
        if kinds and kinds[0][0] == 3:
            score += 1
    elif given >= 2 or family == 2:
        score += given if given == 3 else 1
        score -= given == 3  # a common name alone: 2
    before, gap = _lead(text, a)
    titled = bool(before) and (before[0][:1].isupper() or before[0] in LONG_TITLES)
    before = [w.lower() for w in before]
    if lead:
        titled = True
        before, gap = [*lead, *before][:3], " "
    one = before[0].rstrip(".") if before else ""
    two = before[1].rstrip(".,:") if len(before) > 1 else ""
    after = text[b : b + 20]
    m = _AFTER_WORD.match(after)
    follows = m[1].lower() if m and m[1] else ""
    stop = after[:1]
    if titled and one in TITLES and "\n" not in gap and ("." not in gap or gap.startswith(".")):
        score += 3
    elif one in GREETINGS and "\n" not in gap:
        score += 3 if stop in ",:!.;" or not stop or stop == "\n" else 1
    elif one in CLOSINGS and ("," in gap or "\n" in gap or not follows):
        score += 3
    elif one in LABELS and (":" in gap or "=" in gap or '"' in gap and ":" in gap):
        score += 3
    elif one in ROLES and ":" not in gap:
        score += 2
    elif one in STRONG:
        score += 3
    elif one in ASKS and "." not in gap and ":" not in gap:
        score += 2
    elif one in JOINS and "." not in gap:
        score += 3 if two in ASKS | CLOSINGS | ROLES else 1
    if _DASH.search(gap):
        score += 3 if not after.strip() or "\n" in after[:3] else 2
    if follows in VERBS:
        score += 2 if "," in after[: m.start(1)] or follows in ("wrote", "writes", "said", "says", "born", "geboren", "née", "né", "schrieb", "escribió") else 1
    if _DAY.match(after):
        score += 1
    i = bisect_left(starts, b)
    if i < len(starts) and starts[i] - b <= 18:
        between = text[b : starts[i]]
        if "\n\n" not in between and ". " not in between and not re.search(r"[!?{}]", between):
            score += 2 if not re.search(rf"[{L}]", between) else 1
    if i and a - ends[i - 1] <= 3 and "\n" not in text[ends[i - 1] : a] and text[ends[i - 1] : a].strip() in ("(", "<"):
        score += 2
    if one in THINGS and gap == " " or follows in THINGS and after[:1] == " " or two in THINGS and one in ("called", "named", "of"):
        score -= 4
    elif one in ARTICLES and one not in JOINS and gap == " " and not lead:
        score -= 3
    if '"' in gap and "=" not in gap and ":" not in gap:
        score -= 2
    return score


def _leads(token: str, more: bool) -> bool:
    """Whether a word with a capital leads to a name rather than being part of one."""
    w = token.lower()
    if w.endswith("."):
        return len(w) > 2 and w[:-1] in TITLES
    return w in STOP or w in GREETINGS or w in CLOSINGS or (w in TITLES and (more or len(w) > 1)) or (w in ASKS and len(w) > 3) or (more and (w in LABELS or w in ROLES))


def _segments(run: re.Match) -> Iterator[tuple[list[str], list[tuple[str, int, int]]]]:
    """The parts of a run of words with capitals that may be names, each with the words that lead to it (titles, greetings, ordinary words), last first."""
    a, end = run.start(), run.end()
    lead: list[str] = []
    tokens: list[tuple[str, int, int]] = []
    for m in _TOKEN.finditer(run[0]):
        if _leads(m[0], a + m.end() < end):
            if tokens:
                yield lead, tokens
                lead, tokens = [], []
            lead = [m[0].rstrip(".").lower(), *lead]
        else:
            tokens.append((m[0], a + m.start(), a + m.end()))
    if tokens:
        yield lead, tokens


_ENDS_SENTENCE = re.compile(r"\.\s*$")
_HONORIFIC = re.compile(r"(?<![一-鿿])([一-鿿]{2,5}|[ァ-ヺー]{2,8}(?:・[ァ-ヺー]{2,8})?)(?:さん|様|さま|氏|先生|くん|ちゃん)")
_FIRST = re.compile(rf"(?P<n>{_ANY}(?:{_GAP}{_ANY}){{0,4}})\s*$")
_VALUE = re.compile(
    rf"[:=]{BLANK}?\"?(?:(?:{'|'.join(sorted(t.capitalize() for t in TITLES))})\b\.?{BLANK})*(?P<n>{_ANY}(?:{_GAP}{_ANY}){{0,4}}(?:,{_GAP}?{_ANY}(?:{_GAP}{_ANY}){{0,2}})?)(?={BLANK}?[\"<;\n\r]|,{BLANK}|{BLANK}\w+=|{BLANK}*$)"
)
_LABEL_OF = re.compile(rf"(?P<label>[{L}][{L}_\-]*)\"?{BLANK}?$")
_AND = re.compile(rf"{BLANK}(?:and|und|et|y|e|&|en){BLANK}$")


def _names(text: str, names: Names, finds: list[Find]) -> Iterator[Span]:
    """Spans of names, each longer before shorter ones within it."""
    starts, ends = [f[1] for f in finds], [f[2] for f in finds]
    # values of fields that hold persons
    for m in _VALUE.finditer(text):
        label = _LABEL_OF.search(text, max(0, m.start() - 24), m.start())
        n = m["n"]
        if label and label["label"].lower() in LABELS and n.lower() not in NOBODY and not _stopped(n) and (n[0].isupper() or " " in n or 2 in names.like(n)):
            yield m.span("n")
    # a field that is a name, before another find in a line of fields or on the line above
    for kind, a, _ in finds:
        yield from _beside(text, kind, a)
    last, ordinary = -1, names.runs
    if len(ordinary) >= 1 << 16:
        ordinary.clear()
    for m in _RUN.finditer(text):
        run = m[0]
        plain = ordinary.get(run)
        if plain is None:
            plain = ordinary[run] = 0 if not run.isalpha() else 2 if run.lower() in STOP else int(names.like(run) == (0, 0))
        if plain:
            if plain == 2:
                continue
            x = m.start()
            if text[x - 2 : x] in SENTENCE and text[text.rfind(" ", max(0, x - 9), x - 2) + 1 : x - 2].lower() not in TITLES:
                # an ordinary word that opens a sentence
                if not ((w := _AFTER_WORD.match(text, m.end())) and w[1] in VERBS):
                    continue
        for lead, tokens in _segments(m):
            if len(tokens) > 1 and tokens[0][0] == "M." and (w := _AFTER_WORD.match(text, tokens[-1][2])) and w[1] and w[1].lower() in FRENCH:
                lead, tokens = ["monsieur", *lead], tokens[1:]
            if len(tokens) > 4 or all(t.endswith(".") for t, _, _ in tokens):
                continue
            a, b = tokens[0][1], tokens[-1][2]
            if len(tokens) == 1 and tokens[0][0].isupper() and len(tokens[0][0]) < 4 or tokens[-1][0].lower() in NOBODY:
                continue
            score = _judge(text, a, b, [t for t, _, _ in tokens], names, starts, ends, lead)
            if score >= THRESHOLD or score >= 1 and last >= 0 and a - last < 8 and _AND.fullmatch(text, last, a):
                yield a, b
                last = b
    # pairs of small letters of which one is like a name
    for word in set(_LOWER.findall(text)) - names.plain:
        if names.like(word) == (0, 0):
            continue
        for m in _pairs_with(text, word):
            x, y = names.like(m["a"]), names.like(m["b"])
            if (x[0] or y[1]) and m["a"] not in STOP and m["b"] not in STOP:
                a, b = m.start("a"), m.end("b")
                if _judge(text, a, b, [m["a"], m["b"]], names, starts, ends) >= THRESHOLD + 1:
                    yield a, b
    if "さん" in text or "様" in text or "氏" in text or "先生" in text:
        for m in _HONORIFIC.finditer(text):
            yield m.span(1)


def _pairs_with(text: str, word: str) -> Iterator[re.Match]:
    """The pairs of small words that begin at each place of the word or at one of the two words before it."""
    at = text.find(word)
    while at >= 0:
        p = at
        for _ in range(3):
            if m := _SMALL_PAIR.match(text, p):
                yield m
            p = max(text.rfind(" ", 0, p - 1), text.rfind("\n", 0, p - 1)) + 1 if p > 1 else 0
        at = text.find(word, at + len(word))


def _stopped(field: str) -> bool:
    words = [w.strip(".,").lower() for w in field.split()]
    return all(w in STOP for w in words) or any(w in THINGS for w in words) or len([w for w in words if w in STOP]) > 1


_CELL = re.compile(rf"(?:^|[\n;|\t])[ \t>]*(?P<n>{_ANY}(?:,?{_GAP}{_ANY}){{0,4}})[ \t]*[;|\t]\s*$")
_ABOVE = re.compile(rf"(?:^|\n)[ \t>]*(?P<n>{_ANY}(?:{_GAP}{_ANY}){{1,4}})[ \t]*\r?\n[ \t>]*$")
_INLINE = re.compile(rf"(?<![{L}0-9])(?P<n>{_ANY}(?:{_GAP}{_ANY}){{1,4}})(?:,? ?[(<]|, )$")


def _beside(text: str, kind: str, a: int) -> Iterator[Span]:
    """A name in the field or line right before a find; its letters may be of any case."""
    if a and text[a - 1] not in " \t|;\n":
        return
    before = text[max(0, a - 64) : a]
    at = a - len(before)
    for p in (_CELL, _ABOVE) if kind in ("address", "identity", "phone", "email") else ():
        m = p.search(before)
        if m and not _stopped(m["n"]) and (m["n"] == m["n"].lower() or m["n"][0].isupper()) and not m["n"].isdigit():
            yield at + m.start("n"), at + m.end("n")
            return


# ---------------------------------------------------------------- finding


def find(text: str | None, names: Names) -> list[Find]:
    """(kind, start, end) of each case in code points, in order and without overlaps. A null or blank text has none.

    Where finds overlap, addresses of mail come first, then numbers, streets and names; of one kind the longer find wins."""
    if not text or text.isspace():
        return []
    taken: list[Find] = []

    def add(found: list[Find]) -> None:
        for f in sorted(set(found), key=lambda f: (f[1] - f[2], f[1])):
            if all(f[2] <= x or f[1] >= y for _, x, y in taken):
                taken.append(f)

    add([("email", a, b) for a, b in _mails(text)])
    if re.search(r"\d", text):
        numbers = list(_numbers(text))
        add([f for f in numbers if f[0] == "identity" and _announced(text, f[1]) == "identity"])
        add(list(_in_records(text, numbers)))
        add([f for f in numbers if f[0] == "phone"])
        add([f for f in numbers if f[0] == "identity"])
        add([("address", a, b) for a, b in _addresses(text)])
    taken.sort(key=lambda f: f[1])
    add([("name", a, b) for a, b in _names(text, names, list(taken))])
    return sorted(taken, key=lambda f: f[1])


# ---------------------------------------------------------------- replacing


def placeholder(kind: str, text: str, key: bytes) -> str:
    """<kind:pseudonym>. Numbers keep their format and plan; of other kinds a keyed number links equal values, whatever their case and blanks."""
    if kind == "phone":
        return f"<phone:{pseudonym_phone(text, key)}>"
    if kind == "identity":
        return f"<identity:{pseudonym_identity(text, key)}>"
    return f"<{kind}:{link(key, kind, ''.join(fold(text).split()))}>"


def replacements(text: str | None, names: Names, key: bytes) -> list[tuple[str, int, int, str]]:
    """(kind, start, end, new) of everything that is replaced, in order: the finds, and valid dates outside them (kind `date`)."""
    finds = find(text, names)
    out = [(kind, a, b, placeholder(kind, text[a:b], key)) for kind, a, b in finds]
    i = 0
    for m in DATE.finditer(text or ""):
        a, b = m.span()
        while i < len(finds) and finds[i][2] <= a:
            i += 1
        if i == len(finds) or b <= finds[i][1]:
            new = pseudonym_date(m[0], key)
            if new != m[0]:
                out.append(("date", a, b, new))
    return sorted(out, key=lambda r: r[1])


def redact(text: str | None, names: Names, key: bytes) -> str | None:
    """The text with every find and every valid date replaced; the rest stays as it is. Null stays null."""
    if not text:
        return text
    out, at = [], 0
    for _, a, b, new in replacements(text, names, key):
        out += [text[at:a], new]
        at = b
    return "".join([*out, text[at:]])


# ---------------------------------------------------------------- on DataFrames


@lru_cache(maxsize=4)
def _cached(names: tuple[tuple[str, str], ...]) -> Names:
    return Names(list(names))


MOST_NAMES = 100_000
KEY_CONF = "spark.chunklake.pii.key"


def secret(spark: SparkSession) -> bytes:
    """The key of the pseudonyms: from the session's spark.chunklake.pii.key, so that runs share pseudonyms; where that is unset,
    a random one of this session, so that nobody can invert them and only this session's texts are linked."""
    given = spark.conf.get(KEY_CONF, None)
    if given:
        return hashlib.blake2b(given.encode(), digest_size=32).digest()
    sc = spark.sparkContext
    if not hasattr(sc, "_chunklake_pii_key"):
        sc._chunklake_pii_key = secrets.token_bytes(32)
    return sc._chunklake_pii_key


def name_rows(name_list: DataFrame) -> tuple[tuple[str, str], ...]:
    """The list of names (name, role) for the workers: a table of fixed size, refused above MOST_NAMES rows. Null names and roles are left out."""
    rows = name_list.select("name", "role").filter("name is not null and role is not null").distinct().limit(MOST_NAMES + 1).collect()
    if len(rows) > MOST_NAMES:
        raise ValueError(f"a list of more than {MOST_NAMES} names")
    return tuple(sorted((r[0], r[1]) for r in rows))


def replace_all(documents: DataFrame, name_list: DataFrame, key: bytes | None = None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, kind, start_at (0-based, code points), length and new of everything `redact` replaces, dates (kind `date`) included.

    Repeated documents give repeated rows; null, empty and blank texts none."""
    rows, key = name_rows(name_list), key or secret(documents.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = _cached(rows)
        for b in batches:
            out = [(d, kind, x, y - x, new) for d, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) for kind, x, y, new in replacements(t, names, key)]
            cols = list(zip(*out)) or [[]] * 5
            types = (pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], ["doc_id", "kind", "start_at", "length", "new"])

    two = spread(documents.selectExpr(f"cast(`{doc_id}` as bigint) as doc_id", f"`{text}` as text"))
    return two.mapInArrow(run, schema="doc_id long, kind string, start_at int, length int, new string")


def find_all(documents: DataFrame, name_list: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, kind, start_at and length of each case: the replacements without the dates."""
    return replace_all(documents, name_list, None, doc_id, text).filter("kind <> 'date'").drop("new")


def redact_all(documents: DataFrame, name_list: DataFrame, key: bytes | None = None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and text with typed placeholders for every case; null texts stay null."""
    rows, key = name_rows(name_list), key or secret(documents.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = _cached(rows)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([redact(t, names, key) for t in b.column(1).to_pylist()], pa.string())], ["doc_id", "text"])

    two = spread(documents.selectExpr(f"cast(`{doc_id}` as bigint) as doc_id", f"`{text}` as text"))
    return two.mapInArrow(run, schema="doc_id long, text string")
