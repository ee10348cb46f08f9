"""Format-preserving pseudonyms: keyed Feistel permutations of phone numbers, identity numbers and dates within their format.

A number is first brought to one form (a phone number to country code and national number, an identity number to its characters
without separators) and validated there; what the form fixes (country code, leading class digit, check characters, letters'
places) is kept or computed anew, the rest is permuted, and the result is written back into the original's own format. So equal
numbers in any spelling share a pseudonym, different numbers of a plan never do, a valid number becomes a valid number of the
same plan, and an invalid one stays invalid.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable
from datetime import date, timedelta
from functools import lru_cache

DIGITS = "0123456789"
LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


@lru_cache(maxsize=64)
def _keyed(key: bytes):
    return hashlib.blake2b(key=key, digest_size=16)


def round_value(key: bytes, i: int, tweak: bytes, half: str) -> int:
    h = _keyed(key).copy()
    h.update(b"%c%b\0%b" % (i, tweak, half.encode()))
    return int.from_bytes(h.digest(), "big")


def _size(shape: str) -> int:
    letters = shape.count("A")
    return 26**letters * 10 ** (len(shape) - letters)


def _number(chars: str, shape: str) -> int:
    if "A" not in shape:
        return int(chars)
    n = 0
    for c, s in zip(chars, shape):
        n = n * 26 + LETTERS.index(c) if s == "A" else n * 10 + int(c)
    return n


def _chars(n: int, shape: str) -> str:
    if "A" not in shape:
        return str(n).zfill(len(shape))
    out = []
    for s in reversed(shape):
        n, d = divmod(n, 26 if s == "A" else 10)
        out.append(LETTERS[d] if s == "A" else DIGITS[d])
    return "".join(reversed(out))


def permute(chars: str, key: bytes, tweak: bytes = b"", back: bool = False, rounds: int = 10) -> str:
    """A keyed permutation of all strings of digits and capital letters that have letters where `chars` has them: an alternating
    Feistel network over two halves of mixed radix. One character is shifted; the empty string stays."""
    shape = "".join("A" if c in LETTERS else "9" for c in chars)
    tweak = tweak + b"|" + shape.encode()
    n = len(chars)
    if n < 2:
        s = round_value(key, 0, tweak, "")
        return _chars((_number(chars, shape) + (-s if back else s)) % _size(shape), shape) if n else chars
    u = n // 2
    halves, shapes = [chars[:u], chars[u:]], [shape[:u], shape[u:]]
    for i in reversed(range(rounds)) if back else range(rounds):
        x = i % 2
        f = round_value(key, i, tweak, halves[1 - x])
        halves[x] = _chars((_number(halves[x], shapes[x]) + (-f if back else f)) % _size(shapes[x]), shapes[x])
    return halves[0] + halves[1]


def walk(chars: str, key: bytes, tweak: bytes, back: bool, ok: Callable[[str], bool]) -> str:
    """The permutation restricted to the strings that are ok, of which `chars` must be one: repeated until it names one again."""
    while True:
        chars = permute(chars, key, tweak, back)
        if ok(chars):
            return chars


def permute_digits(digits: str, key: bytes, tweak: bytes = b"", back: bool = False) -> str:
    return permute(digits, key, tweak, back)


# ---------------------------------------------------------------- phone numbers

#: The country codes of one and of two digits; all others have three.
CODES_1 = "1 7".split()
CODES_2 = "20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98".split()

#: national numbers (without trunk zero): the shape of a valid one and how many leading digits tell its class
PLANS = {
    "1": (re.compile(r"[2-9]\d\d[2-9]\d{6}"), 0),
    "33": (re.compile(r"[1-9]\d{8}"), 1),
    "34": (re.compile(r"[5-9]\d{8}"), 1),
    "44": (re.compile(r"[1-9]\d{8,9}"), 1),
    "49": (re.compile(r"[1-9]\d{5,11}"), 1),
    "86": (re.compile(r"1[3-9]\d{9}"), 2),
    "91": (re.compile(r"[6-9]\d{9}"), 1),
}
_ANY_PLAN = (re.compile(r"\d{4,14}"), 1)

#: national spellings that name their country: the trunk zero or the grouping
_NATIONAL = [
    ("44", re.compile(r"0(?=7\d{9}$)"), None),
    ("33", re.compile(r"0(?=[1-9]\d{8}$)"), re.compile(r"\(?0[1-9]\)?(?:\D?\d\d){4}")),
    ("44", re.compile(r"0(?=2\d{9}$)"), re.compile(r"\(?02\d\)?\W?\d{4}\W?\d{4}")),
    ("49", re.compile(r"0(?=[1-9]\d{5,11}$)"), None),
    ("1", re.compile(r"1?(?=[2-9]\d\d[2-9]\d{6}$)"), None),
    ("34", re.compile(r"(?=[5-9]\d{8}$)"), None),
    ("86", re.compile(r"(?=1[3-9]\d{9}$)"), None),
]


def country_code(digits: str) -> str:
    return digits[:1] if digits[:1] in CODES_1 else digits[:2] if digits[:2] in CODES_2 else digits[:3]


def phone_parts(text: str) -> tuple[str, int, int]:
    """(country code or "", where the national number begins, where it ends) among the ASCII digits of a phone number as written.

    An extension behind `ext` isn't part of it. A number whose country can't be told has the code ""."""
    main = re.split(r"(?i)\s*ext", text, maxsplit=1)[0]
    d = "".join(c for c in main if c in DIGITS)
    lead = 0
    if main.lstrip("( ").startswith("+"):
        pass
    elif d.startswith("00") and len(d) > 9:
        lead = 2
    else:
        for code, trunk, form in _NATIONAL:
            if (m := trunk.match(d)) and (form is None or form.fullmatch(main)):
                return code, m.end(), len(d)
        return "", 0, len(d)
    code = country_code(d[lead:])
    at = lead + len(code)
    if d[at : at + 1] == "0" and code != "39":  # +49 (0)30
        at += 1
    return code, at, len(d)


def canonical_phone(text: str) -> str:
    """Country code and national number, `+44 7700900779`: one form for all spellings."""
    code, a, b = phone_parts(text)
    d = "".join(c for c in text if c in DIGITS)
    return f"+{code} {d[a:b]}" if code else d[a:b]


def _put(text: str, new: str) -> str:
    """The text with its ASCII digits and letters of identity numbers replaced by `new`, one by one; case and separators stay."""
    it = iter(new)
    return "".join(next(it) if c in DIGITS else c for c in text)


def pseudonym_phone(text: str, key: bytes, back: bool = False) -> str:
    code, a, b = phone_parts(text)
    d = "".join(c for c in text if c in DIGITS)
    national = d[a:b]
    shape, kept = PLANS.get(code, _ANY_PLAN)
    head, rest = national[:kept], national[kept:]
    tweak = f"phone+{code}:{head}".encode()
    if shape.fullmatch(national):
        rest = walk(rest, key, tweak, back, lambda r: bool(shape.fullmatch(head + r)))
    elif rest:
        rest = walk(rest, key, tweak + b"?", back, lambda r: not shape.fullmatch(head + r))
    tail = permute(d[b:], key, b"extension", back)
    return _put(text, d[:a] + head + rest + tail)


# ---------------------------------------------------------------- identity numbers


def _mod11_10(p: str) -> str:
    x = 10
    for c in p:
        s = (int(c) + x) % 10 or 10
        x = s * 2 % 11
    return str((11 - x) % 10)


def _weighted(p: str, weights: list[int]) -> str:
    r = sum(int(c) * w for c, w in zip(p, weights)) % 11
    return str(0 if r < 2 else 11 - r)


def _cpf(p: str) -> str:
    one = _weighted(p, list(range(10, 1, -1)))
    return one + _weighted(p + one, list(range(11, 1, -1)))


def _verhoeff(p: str) -> str:
    def turn(j: int, k: int) -> int:  # the group of the five-sided figure's turns and flips
        if j < 5:
            return (j + k) % 5 if k < 5 else 5 + (j + k - 5) % 5
        return 5 + (j - 5 - k) % 5 if k < 5 else (j - k) % 5

    step = [1, 5, 7, 6, 2, 8, 3, 0, 9, 4]  # fixed value: the published permutation
    c = 0
    for i, ch in enumerate(reversed(p), 1):
        x = int(ch)
        for _ in range(i % 8):
            x = step[x]
        c = turn(c, x)
    return str(next(k for k in range(10) if turn(c, k) == 0))


def _my_number(p: str) -> str:
    r = sum(int(c) * (n + 1 if n <= 6 else n - 5) for n, c in enumerate(reversed(p), 1)) % 11
    return str(0 if r <= 1 else 11 - r)


#: Fixed value: the letters of the Spanish check character, by remainder.
_DNI = "TRWAGMYFPDXBNJZSQVHLCKE"

#: shapes of numbers with check characters: name, form, where the payload ends, the check from the payload
CHECKED = [
    ("dni", re.compile(r"\d{8}[A-Z]"), 8, lambda p: _DNI[int(p) % 23]),
    ("nie", re.compile(r"[XYZ]\d{7}[A-Z]"), 8, lambda p: _DNI[("XYZ".index(p[0]) * 10**7 + int(p[1:])) % 23] if p[0] in "XYZ" else ""),
    ("nir", re.compile(r"[12]\d{14}"), 13, lambda p: f"{97 - int(p) % 97:02}"),
    ("steuer", re.compile(r"[1-9]\d{10}"), 10, _mod11_10),
    ("cpf", re.compile(r"\d{11}"), 9, _cpf),
    ("aadhaar", re.compile(r"[2-9]\d{11}"), 11, _verhoeff),
    ("my_number", re.compile(r"\d{12}"), 11, _my_number),
    ("nif", re.compile(r"\d{9}"), 8, lambda p: _weighted(p, list(range(9, 1, -1)))),
]


def compact(text: str) -> str:
    """The capital letters and digits of an identity number, without separators: one form for all spellings."""
    return "".join(c for c in text.upper() if c in DIGITS or c in LETTERS)


def scheme(number: str) -> tuple[str, int, Callable[[str], str]] | None:
    """The first scheme whose check characters the compact number has right: (name, where the payload ends, check)."""
    for name, form, end, check in CHECKED:
        if form.fullmatch(number) and check(number[:end]) == number[end:]:
            return name, end, check
    return None


def pseudonym_identity(text: str, key: bytes, back: bool = False) -> str:
    """Valid numbers stay valid under the same scheme, others stay without one. Letters become letters, in the case they had."""
    number = compact(text)
    if s := scheme(number):
        name, end, check = s
        form = next(f for n, f, *_ in CHECKED if n == name)

        def ok(p: str) -> bool:
            full = p + check(p)
            return bool(form.fullmatch(full)) and scheme(full)[0] == name

        new = walk(number[:end], key, name.encode(), back, ok)
        new += check(new)
    else:
        new = walk(number, key, b"identity", back, lambda x: scheme(x) is None)
    it = iter(new)
    out = []
    for c in text:
        u = c.upper()
        if len(u) == 1 and (u in DIGITS or u in LETTERS):
            n = next(it)
            out.append(n.lower() if c != u else n)
        else:
            out.append(c)
    return "".join(out)


# ---------------------------------------------------------------- dates

FIRST_DAY, DAYS = date(1900, 1, 1), 73_049

#: The names of the months in several languages.
_LANGUAGES = [
    words.split()
    for words in (
        "january february march april may june july august september october november december",
        "jan feb mar apr may jun jul aug sep oct nov dec",
        "januar februar märz april mai juni juli august september oktober november dezember",
        "janvier février mars avril mai juin juillet août septembre octobre novembre décembre",
        "enero febrero marzo abril mayo junio julio agosto septiembre octubre noviembre diciembre",
    )
]
_MONTHS: dict[str, tuple[int, int]] = {}
for _i, _words in enumerate(_LANGUAGES):
    for _n, _w in enumerate(_words, 1):
        _MONTHS.setdefault(_w, (_i, _n))
_MONTH = "|".join(sorted(_MONTHS, key=len, reverse=True))

#: numeric dates, and day, month in words, year; not parts of longer numbers
DATE = re.compile(
    rf"\d(?<!\d\d)(?:\d{{3}}-\d\d-\d\d|\d(?<!\d[./]\d\d)([./])\d\d\1\d{{4}}(?!\1\d)|\d?\.? (?:de )?(?i:{_MONTH})(?: de)? \d{{4}})(?!\d)", re.A
)
_WORDED = re.compile(r"(\d\d?)(\.? (?:de )?)([^\W\d]+)((?: de)? )(\d{4})")


@lru_cache(maxsize=65536)
def permute_day(d: date, key: bytes, back: bool = False) -> date:
    """A keyed permutation of the days of 1900 to 2099: five digits, walked until they name a day again."""
    n = (d - FIRST_DAY).days
    if not 0 <= n < DAYS:
        return d
    return FIRST_DAY + timedelta(days=int(walk(f"{n:05}", key, b"day", back, lambda x: int(x) < DAYS)))


def pseudonym_date(text: str, key: bytes, back: bool = False) -> str:
    """A date (2025-02-28, 28.02.2025, 28/02/2025 or 28 Feb 2025) as another date in the same format; what is no valid date stays.

    A month in words is written in the language and length it had (May and names shared by languages: in the first of them)."""
    if m := re.fullmatch(r"(\d{4})-(\d\d)-(\d\d)", text):
        y, mo, d, form = int(m[1]), int(m[2]), int(m[3]), "%Y-%m-%d"
    elif m := re.fullmatch(r"(\d\d)([./])(\d\d)\2(\d{4})", text):
        y, mo, d, form = int(m[4]), int(m[3]), int(m[1]), f"%d{m[2]}%m{m[2]}%Y"
    elif (m := _WORDED.fullmatch(text)) and m[3].lower() in _MONTHS:
        y, mo, d, form = int(m[5]), _MONTHS[m[3].lower()][1], int(m[1]), ""
    else:
        return text
    try:
        new = permute_day(date(y, mo, d), key, back)
    except ValueError:
        return text
    if form:
        return new.strftime(form)
    word = _LANGUAGES[_MONTHS[m[3].lower()][0]][new.month - 1]
    word = word.upper() if m[3].isupper() else word.capitalize() if m[3][0].isupper() else word
    return f"{new.day:0{len(m[1])}}{m[2]}{word}{m[4]}{new.year}"


def link(key: bytes, kind: str, same: str) -> str:
    """16 hexadecimal digits that link equal values of a kind; two of 10^8 values share them with a probability below 0.0003."""
    return f"{round_value(key, 0, kind.encode(), same) >> 64:016x}"
