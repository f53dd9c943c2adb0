"""Surrogates for personal data: keyed, type-consistent, of the same format, and distinct for distinct entities.

An entity's value is read in canonical form, ranked within the strings of its format, and moved by a keyed permutation
of those ranks without fixed points. So equal entities get equal surrogates everywhere without any shared state, and
two entities of a format can never collide. Values that a format reserves (names from the lists) are walked over.
"""

from __future__ import annotations

import hashlib
import hmac
import ipaddress
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from oddsmith.llm.common import materialize, small_batches

ROUNDS = 8
#: Given names that stay within their gender, and titles that tell it.
MALE = ("james", "john", "robert", "michael", "david", "william", "thomas", "peter", "paul", "martin", "hans", "jean", "luis", "carlos", "ivan", "pierre")
FEMALE = ("mary", "anna", "linda", "susan", "karen", "laura", "julia", "emma", "marie", "sophie", "greta", "carmen", "elena", "olga", "ingrid", "claire")
TITLES = {
    "Mr": "m", "Herr": "m", "Monsieur": "m", "Sr": "m", "Señor": "m", "Г-н": "m",
    "Mrs": "f", "Ms": "f", "Miss": "f", "Frau": "f", "Mme": "f", "Mlle": "f", "Sra": "f", "Señora": "f", "Г-жа": "f",
    "Dr": "n", "Prof": "n",
}
#: Vowels and consonants of the scripts whose names are respelled; other letters move within their Unicode block.
ALPHABETS = ("aeiou", "bcdfghjklmnpqrstvwxyz", "аеиоуыэюя", "бвгджзклмнпрстфхцчшщ", "αεηιουω", "βγδζθκλμνξπρστφχψ")

_NUMBER_START = re.compile(r"[+(]?[0-9]")
_NUMBER = re.compile(
    r"(?P<ip>[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![\w]|\.[0-9]))"
    r"|(?P<card>[0-9]{4}(?P<s>[ -]?)[0-9]{4}(?P=s)[0-9]{4}(?P=s)[0-9]{4}(?:[0-9]{1,3})?(?!\w)|[0-9]{4}[ -][0-9]{6}[ -][0-9]{5}(?!\w)|3[47][0-9]{13}(?!\w))"
    r"|(?P<ssn>[0-9]{3}-[0-9]{2}-[0-9]{4}(?![\w-]))"
    r"|(?P<phone>(?:\+?1[ .-]?)?(?:\([0-9]{3}\)[ .-]?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?!\w)"
    r"|\+(?:[2-9][0-9]{0,2})[ .-]?(?:\([0-9]{1,4}\)[ .-]?)?[0-9]{2,4}(?:[ .-]?[0-9]{2,4}){1,3}(?!\w))"
)
_LOCAL = re.compile(r"(?<![\w.+%-])[\w.+%-]++@")
_DOMAIN = re.compile(r"(?:[^\W_](?:[\w-]*[^\W_])?\.)+[^\W\d_]{2,}")
_IPV6 = re.compile(r"(?<![\w:.])(?:[0-9A-Fa-f]{0,4}:){2,7}[0-9A-Fa-f]{0,4}(?![\w:.]*[\w:])")
_IBAN = re.compile(r"[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?!\w)")
_CLOUD_KEY = re.compile(r"(?:AKIA|ASIA)[A-Z0-9]{16}(?!\w)")
_KEYWORD = re.compile(r"(?i)(?:password|passwd|pwd|secret|token|api[_-]?key|access[_-]?key)[\"']?\s*+[=:]")
_SECRET = re.compile(r"\s*[\"']?([^\s\"',;<>]{6,})")
_TITLE = re.compile("(?:" + "|".join(sorted(map(re.escape, TITLES), key=len, reverse=True)) + r")\.?[  ](?=[^\W\d_])")
_NAME = re.compile(r"[^\W\d_]+(?:['’-][^\W\d_]+)*")
_PART = re.compile(r"[^\W\d_]+")
#: Verbs of people, which make the two capitalised words before them a name; labels whose value is a name.
VERBS = (
    "said", "says", "wrote", "writes", "told", "asked", "replied", "explained", "added", "met", "called", "lives", "lived",
    "sagte", "sagt", "schrieb", "fragte", "erklärte", "dijo", "dice", "escribió", "preguntó", "disse", "scrisse",
    "сказал", "сказала", "написал", "написала", "спросил", "спросила",
)
LABELS = ("name", "full name", "first name", "last name", "contact", "author", "patient", "customer", "client", "signed", "nombre", "nom", "autor", "auteur", "имя")
#: Capitalised words at the head of a sentence that begin no name.
HEADS = (
    "the", "a", "an", "this", "that", "these", "those", "in", "on", "at", "by", "for", "from", "of", "to", "and", "but", "or", "if", "when", "as", "my", "our", "your",
    "his", "her", "its", "their", "he", "she", "it", "we", "they", "you", "i", "who", "what", "no", "all", "some", "der", "die", "das", "ein", "eine", "und", "le", "la",
    "les", "un", "une", "el", "los", "las", "una", "et", "y",
)
#: Words of places, bodies and streets; they are no part of a person's name and end one.
PLACES = frozenset(
    (
        "north", "south", "east", "west", "northern", "southern", "eastern", "western", "new", "old", "upper", "lower", "great", "central", "united", "federal", "european", "national",
        "international", "royal", "supreme", "white", "wall", "saint", "san", "los", "las", "santa", "mount", "lake", "river", "cape", "fort", "port", "street", "road", "avenue", "lane",
        "square", "bridge", "park", "place", "drive", "boulevard", "station", "airport", "city", "county", "state", "states", "kingdom", "republic", "union", "island", "islands", "sea",
        "ocean", "valley", "hills", "beach", "york", "england", "korea", "africa", "america", "asia", "europe", "zealand", "reserve", "bank", "house", "court", "council", "congress",
        "senate", "parliament", "ministry", "department", "office", "agency", "commission", "committee", "party", "army", "police", "university", "college", "school", "hospital", "church",
        "museum", "company", "corporation", "group", "times", "post", "news", "press", "journal", "league", "club", "association", "institute", "foundation", "street.", "inc", "ltd", "gmbh",
    )
)
#: Names that are words of their own; a further mention counts only beside another part of a detected name.
AMBIGUOUS = frozenset(
    (
        "january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december", "monday", "tuesday", "wednesday", "thursday", "friday",
        "saturday", "sunday", "christian", "will", "mark", "grace", "hope", "faith", "rose", "bill", "frank", "grant", "rich", "page", "price", "king", "queen", "prince", "day", "summer",
        "winter", "spring", "autumn", "joy", "art", "paris", "victoria", "georgia", "virginia", "sydney", "florence", "china", "india",
    )
)
#: Small words inside names, which stay as they are.
PARTICLES = ("de", "del", "della", "di", "da", "dos", "das", "do", "la", "las", "los", "le", "van", "von", "der", "den", "zu", "y", "e", "bin", "ibn", "al", "el", "af", "av", "ter", "ten")
_PARTICLE = re.compile(r"(?:(?:" + "|".join(PARTICLES) + r")[ \u00a0]){1,3}")
_WORD = r"[^\W\d_]++(?:['’-][^\W\d_]++)*+"
_BEFORE_VERB = re.compile(r"(?:(?<![\w'’-])|(?<=[\s(]['’]))(" + _WORD + r")[ \u00a0](" + _WORD + r")[ \u00a0](?=(?:" + "|".join(VERBS) + r")(?!\w))")
_LABEL = re.compile(r"(?i:(?<!\w)(?:" + "|".join(LABELS) + r"))[  ]?:[  ]*(?=[^\W\d_])")
_GIVEN = re.compile(r"(?<!\w)(?:" + "|".join(n.capitalize() for n in MALE + FEMALE) + r")(?![\w])")
_SYMBOLS = frozenset("!@#$%^&*+=~|")
#: Country calling codes of one and of two digits; all others have three.
CODES = ("1", "7", *"20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98".split())
_POSSESSIVE = re.compile("['’][sS]$")


class Entity(NamedTuple):
    kind: str
    start: int
    end: int
    canonical: str
    gender: str = "n"


def luhn(digits: str) -> int:
    """What the last digit would have to be raised by for the checksum to be right."""
    total = sum(int(d) if i % 2 == 0 else (int(d) * 2) // 10 + (int(d) * 2) % 10 for i, d in enumerate(reversed(digits)))
    return -total % 10


def is_ipv6(value: str) -> bool:
    """An address of version 6 with a digit in it; words joined by colons and times of day are none."""
    if not any(c.isdigit() for c in value):
        return False
    try:
        return bool(ipaddress.IPv6Address(value))
    except ValueError:
        return False


def _numbers(text: str) -> Iterator[Entity]:
    at = 0
    while m := _NUMBER_START.search(text, at):
        at = m.end()
        before = text[m.start() - 1 : m.start()]
        if before and (before.isalnum() or before in "_.@"):
            while at < len(text) and text[at].isdigit():
                at += 1
            continue
        found = _NUMBER.match(text, m.start())
        if not found:
            while at < len(text) and text[at].isdigit():
                at += 1
            continue
        kind, value = found.lastgroup if found.lastgroup != "s" else "card", found.group()
        kind = next(k for k in ("ip", "card", "ssn", "phone") if found.group(k) is not None)
        digits = re.sub(r"\D", "", value)
        if kind == "ip" and any(int(o) > 255 or (len(o) > 1 and o[0] == "0") for o in value.split(".")):
            continue
        if kind == "phone" and not value.startswith("+") and len(digits) == 10:
            digits = "1" + digits
        yield Entity(kind, found.start(), found.end(), value if kind == "ip" else digits)
        at = found.end()


def _named(word: str) -> bool:
    return word[0].isupper() or not word[0].isascii() and unicodedata.category(word[0]) == "Lo"


def _mentions(text: str, genders: dict[str, str], known: dict[int, Entity]) -> Iterator[Entity]:
    """The known names, by where they start, and capitalised mentions of them anywhere: whole words, without a possessive, or parts of a compound.

    A name that is a word of its own counts only next to another detected name.
    """
    doubtful, last_end = None, -2
    for m in _NAME.finditer(text):
        start = m.start()
        if start in known:
            if doubtful and start - last_end == 1:
                yield doubtful
            yield known[start]
            doubtful, last_end = None, m.end()
            continue
        word = m.group()
        lower = _canonical(word)
        if lower in genders:
            hits = [(0, len(word))] if _named(word) else []
        elif word.isalpha():
            continue
        else:
            bare = _POSSESSIVE.sub("", word)
            spans = [(0, len(bare))] if _canonical(bare) in genders else [p.span() for p in _PART.finditer(word)]
            hits = [(i, j) for i, j in spans if _canonical(word[i:j]) in genders and _named(word[i:j])]
        own = [Entity("name", start + i, start + j, c := _canonical(word[i:j]), genders[c]) for i, j in hits]
        near = start - last_end == 1
        if not own:
            continue
        if len(own) == 1 and own[0].canonical in AMBIGUOUS and not near:
            doubtful, last_end = own[0], m.end()
            continue
        if near and doubtful:
            yield doubtful
        yield from own
        doubtful, last_end = None, m.end()


def _secretive(value: str) -> bool:
    """Whether a value after a keyword looks like a secret and not like a word: digits, mixed case, symbols, or great length."""
    bare = value.rstrip(".!?:)]}")
    mixed = any(c.islower() for c in bare) and any(c.isupper() for c in bare[1:])
    return len(bare) >= 6 and (mixed or len(bare) >= 24 or any(c.isdigit() or c in _SYMBOLS for c in bare))


def country_code(digits: str) -> int:
    """Digits of the country's calling code of an international number."""
    return 1 if digits[:1] in CODES else 2 if digits[:2] in CODES else 3


def _canonical(word: str) -> str:
    return word.lower().replace("’", "'")


def _run(text: str, at: int) -> tuple[list[tuple[int, int, str]], int]:
    """(start, end, word) of the words of a name from `at` on, single spaces between them, and where the search ended.

    A possessive, a title, and a word of a place end it; small words between two of a name are passed over.
    """
    out: list[tuple[int, int, str]] = []
    while (word := _NAME.match(text, at)) and _named(whole := word.group()):
        shown = whole if whole.isalpha() else _POSSESSIVE.sub("", whole)
        if whole in TITLES or shown.lower() in PLACES:
            break
        out.append((at, at + len(shown), shown))
        at = word.end()
        if shown != whole or text[at : at + 1] not in (" ", " "):
            break
        at += 1
        if small := _PARTICLE.match(text, at):
            at = small.end()
    return out, max(at, out[-1][1]) if out else at


def _names(text: str) -> list[tuple[int, int, str, str]]:
    """(start, end, word, gender) of names by context: after a title or a label, from a listed given name on, before a verb of people.

    A start inside a name that the same rule has taken is part of it, so each rule passes over a text once.
    """
    found = []
    for pattern in (_TITLE, _LABEL, _GIVEN):
        covered = 0
        for m in pattern.finditer(text):
            given = pattern is _GIVEN
            start = m.start() if given else m.end()
            if start < covered or pattern is _TITLE and text[m.start() - 1 : m.start()].isalnum():
                continue
            if given and text[m.end() : m.end() + 1] in ("'", "’", "-"):
                words, covered = [(m.start(), m.end(), m.group())], m.end()
            else:
                words, covered = _run(text, start)
            gender = TITLES[m.group().rstrip(" .\u00a0")] if pattern is _TITLE else "n" if not given else "m" if m.group().lower() in MALE else "f"
            found += [(a, b, w, gender) for a, b, w in words if pattern is _TITLE or w.lower() not in HEADS]
    for m in _BEFORE_VERB.finditer(text):
        pair = m.group(1), m.group(2)
        if all(_named(w) and w[1:].islower() and w.lower() not in PLACES for w in pair) and pair[0].lower() not in HEADS:
            found += [(m.start(i), m.end(i), m.group(i), "n") for i in (1, 2)]
    return found


def find_entities(text: str) -> list[Entity]:
    """Entities in order, without overlaps; of two that overlap the one that begins first (then the longer) counts.

    Kinds: email, phone, ip, ipv6, card, ssn, iban, secret (cloud keys, and values after a password or token keyword that do
    not look like words), name (see _names, and every further capitalised mention of such a word in the text, see
    _mentions). Each search passes over the text once, runs of names, labels and verbs included.
    """
    found = list(_numbers(text))
    for m in _LOCAL.finditer(text):
        if domain := _DOMAIN.match(text, m.end()):
            found.append(Entity("email", m.start(), domain.end(), text[m.start() : domain.end()].lower()))
    for m in _IPV6.finditer(text):
        if is_ipv6(m.group()):
            found.append(Entity("ipv6", m.start(), m.end(), ipaddress.IPv6Address(m.group()).exploded))
    for pattern, kind in ((_CLOUD_KEY, "secret"), (_IBAN, "iban")):
        found += [Entity(kind, m.start(), m.end(), m.group().replace(" ", "")) for m in pattern.finditer(text) if not text[m.start() - 1 : m.start()].isalnum()]
    for m in _KEYWORD.finditer(text):
        if (value := _SECRET.match(text, m.end())) and _secretive(value.group(1)):
            found.append(Entity("secret", value.start(1), value.end(1), value.group(1)))
    genders: dict[str, str] = {}
    known: dict[int, Entity] = {}
    for start, end, word, gender in _names(text):
        known.setdefault(start, Entity("name", start, end, _canonical(word), gender))
        genders.setdefault(known[start].canonical, gender)
    if genders:
        found += _mentions(text, genders, known)
    kept: list[Entity] = []
    for e in sorted(found, key=lambda e: (e.start, -e.end)):
        if not kept or e.start >= kept[-1].end:
            kept.append(e)
    return kept


class Surrogates:
    """Keyed permutations of the strings of a format."""

    def __init__(self, key: bytes):
        self.key = key
        self.of = lru_cache(1 << 16)(self._of)

    def _round(self, tweak: str, i: int, half: int, bits: int) -> int:
        mac = hmac.digest(self.key, f"{tweak}\0{i}\0{half:x}".encode(), hashlib.sha512)
        return int.from_bytes(mac, "big") & ((1 << bits) - 1)

    def _permuted(self, x: int, size: int, tweak: str, back: bool) -> int:
        """A Feistel network on the next even number of bits, walked until it is below size again."""
        bits = max(1, -(-(size - 1).bit_length() // 2))
        mask = (1 << bits) - 1
        while True:
            left, right = x >> bits, x & mask
            for i in reversed(range(ROUNDS)) if back else range(ROUNDS):
                if back:
                    left, right = right ^ self._round(tweak, i, left, bits), left
                else:
                    left, right = right, left ^ self._round(tweak, i, right, bits)
            x = left << bits | right
            if x < size:
                return x

    def moved(self, x: int, size: int, tweak: str) -> int:
        """A permutation of range(size) that moves everything: back(forth(x) + s) with a keyed s."""
        if size < 2:
            return x
        shift = 1 + self._round(tweak, -1, size, 64) % (size - 1)
        return self._permuted((self._permuted(x, size, tweak, False) + shift) % size, size, tweak, True)

    def respelled(self, value: str, alphabets: list[str], tweak: str) -> str:
        """value with each character moved within the alphabet of its place ("": it stays); parts of 64 moving characters."""
        free = [i for i, a in enumerate(alphabets) if len(a) > 1]
        out = list(value)
        for n, at in enumerate(range(0, len(free), 64)):
            places = free[at : at + 64]
            rank, size = 0, 1
            for i in places:
                rank, size = rank * len(alphabets[i]) + alphabets[i].index(value[i]), size * len(alphabets[i])
            rank = self.moved(rank, size, f"{tweak}\0{n}\0{'/'.join(alphabets[i] for i in places)}\0{','.join(map(str, places))}\0{len(value)}")
            for i in reversed(places):
                rank, digit = divmod(rank, len(alphabets[i]))
                out[i] = alphabets[i][digit]
        return "".join(out)

    def _of(self, kind: str, canonical: str, gender: str) -> str:
        if kind == "ip":
            octets = [int(o) for o in canonical.split(".")]
            first = range(1, 224) if 1 <= octets[0] <= 223 else [0, *range(224, 256)]
            x = list(first).index(octets[0]) << 24 | octets[1] << 16 | octets[2] << 8 | octets[3]
            y = self.moved(x, len(first) << 24, f"ip\0{len(first)}")
            return f"{list(first)[y >> 24]}.{ipaddress.IPv4Address(y & 0xFFFFFF).exploded.split('.', 1)[1]}"
        if kind == "ipv6":  # the first group tells the kind of network and stays
            return self.respelled(canonical, ["" if i < 4 or c == ":" else "0123456789abcdef" for i, c in enumerate(canonical)], f"ipv6\0{canonical[:4]}")
        if kind == "card":
            off = luhn(canonical)
            body = canonical[0] + self.respelled(canonical[1:-1], ["0123456789"] * (len(canonical) - 2), f"card\0{off}\0{canonical[0]}")
            return body + str((luhn(body + "0") - off) % 10)
        if kind == "phone":
            country = min(country_code(canonical), len(canonical) - 4)
            spots = {1, 4} if canonical[0] == "1" and len(canonical) == 11 else set()
            sets = ["" if i < country else ("23456789" if canonical[i] in "23456789" else "01") if i in spots else "0123456789" for i in range(len(canonical))]
            return self.respelled(canonical, sets, f"phone\0{canonical[:country]}")
        if kind == "email":
            keep = canonical.rfind(".")
            return self.respelled(canonical, ["" if i >= keep else _alphabet(c) for i, c in enumerate(canonical)], f"email\0{canonical[keep:]}")
        if kind == "name":
            return self._name(canonical, gender)
        keep = 4 if kind == "secret" and _CLOUD_KEY.fullmatch(canonical) else 2 if kind == "iban" else 0
        return self.respelled(canonical, ["" if i < keep else _alphabet(c) for i, c in enumerate(canonical)], f"{kind}\0{canonical[:keep]}")

    def _name(self, word: str, gender: str) -> str:
        for listed in (MALE, FEMALE):
            if word in listed:
                return listed[self.moved(listed.index(word), len(listed), f"names\0{listed[0]}")]
        # the last letter tells the gender of many family names and stays
        sets = ["" if i == len(word) - 1 and len(word) > 2 else _letters(c) for i, c in enumerate(word)]
        out = self.respelled(word, sets, "name")
        while out in MALE or out in FEMALE:  # stays a permutation of the names that are not listed
            out = self.respelled(out, sets, "name")
        return out


def _alphabet(c: str) -> str:
    if c.isascii():
        return "0123456789" if c.isdigit() else "abcdefghijklmnopqrstuvwxyz" if c.islower() else "ABCDEFGHIJKLMNOPQRSTUVWXYZ" if c.isupper() else ""
    return _letters(c)


@lru_cache(1 << 12)
def _letters(c: str) -> str:
    for own in ALPHABETS:
        if c in own:
            return own
    if not c.isalpha():
        return ""
    block = ord(c) & ~0x3F
    kind = unicodedata.category(c)
    found = "".join(chr(i) for i in range(block, block + 64) if unicodedata.category(chr(i)) == kind and chr(i).lower() == chr(i) and not any(chr(i) in a for a in ALPHABETS))
    return found if c in found else ""


def in_format(shown: str, surrogate: str) -> str:
    """The canonical surrogate in the mention's format: its separators and letter case."""
    if len(shown) == len(surrogate):
        cased = lambda c, s: s.upper() if c.isupper() and len(s.upper()) == 1 else s
        return "".join(cased(c, s) if s.isalnum() else c for c, s in zip(shown, surrogate, strict=True))
    alnum = sum(c.isalnum() for c in shown)
    if alnum == len(shown):  # a listed name of another length
        return surrogate.upper() if shown.isupper() else surrogate[:1].upper() + surrogate[1:]
    own = iter(surrogate[-alnum:])
    return "".join(next(own) if c.isalnum() else c for c in shown)


def pseudonymize(text: str | None, surrogates: Surrogates) -> tuple[str | None, list[tuple[Entity, str, str]]]:
    """The text with surrogates, and each entity with its surrogate as shown and in canonical form."""
    if not text:
        return text, []
    out, at, found = [], 0, []
    for e in find_entities(text):
        shown = text[e.start : e.end]
        made = surrogates.of(e.kind, e.canonical, e.gender)
        new = made if e.kind in ("ip", "ipv6") else in_format(shown, made)
        found.append((e, new, made))
        out += [text[at : e.start], new]
        at = e.end
    return ("".join([*out, text[at:]]) if found else text), found


SPANS = "array<struct<kind:string,start:bigint,end:bigint,canonical_sha256:string,surrogate_sha256:string,surrogate:string>>"


def with_surrogates(docs: DataFrame, key: bytes, text_col: str = "text", spans_col: str = "entities") -> DataFrame:
    """docs with surrogates in the text, and spans_col: the entities, by characters of the old text.

    Values are not returned, only a keyed digest of each canonical value and of each canonical surrogate. Null and empty
    texts stay as they are and have no entities.
    """
    at = docs.columns.index(text_col)

    def each(batches: Iterator) -> Iterator:
        import pyarrow as pa

        own = Surrogates(key)
        names = ("kind", "start", "end", "canonical_sha256", "surrogate_sha256", "surrogate")
        span = pa.list_(pa.struct([(n, pa.int64() if n in ("start", "end") else pa.string()) for n in names]))
        digest = lru_cache(1 << 16)(lambda kind, value: hmac.new(key, f"{kind}\0{value}".encode(), hashlib.sha256).hexdigest())
        for batch in batches:
            for part in small_batches(batch, at):
                out = [pseudonymize(t, own) for t in part.column(at).to_pylist()]
                spans = [[dict(zip(names, (e.kind, e.start, e.end, digest(e.kind, e.canonical), digest(e.kind, made), new), strict=True)) for e, new, made in found] for _, found in out]
                part = part.set_column(at, part.schema.field(at), pa.array([t for t, _ in out], part.column(at).type))
                yield part.append_column(spans_col, pa.array(spans, span))

    return docs.mapInArrow(each, T.StructType([*docs.schema, T.StructField(spans_col, T.DataType.fromDDL(SPANS))]))


def collisions(surrogated: DataFrame, spans_col: str = "entities") -> DataFrame:
    """(kind, surrogate_sha256) that two different entities share, over all rows of with_surrogates: empty if distinctness holds.

    Values and surrogates are compared in canonical form, so shown forms of one phone number are one. Minima and maxima
    are partial before the shuffle, so a frequent entity is no hot group.
    """
    one = surrogated.select(F.explode(spans_col).alias("e")).select("e.kind", "e.surrogate_sha256", "e.canonical_sha256")
    both = one.groupBy("kind", "surrogate_sha256").agg(F.min("canonical_sha256").alias("a"), F.max("canonical_sha256").alias("b"))
    return both.where("a <> b").select("kind", "surrogate_sha256")


def checked(surrogated: DataFrame, spans_col: str = "entities") -> DataFrame:
    """The rows of with_surrogates, written and read back, once no two entities share a surrogate; otherwise an error."""
    rows = materialize(surrogated, "surrogates")
    if shared := collisions(rows, spans_col).count():
        raise ValueError(f"{shared} surrogates stand for more than one entity")
    return rows


def surrogate_texts(docs: DataFrame, key: bytes, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text, entities) for every row, checked for collisions over all rows.

    Null stays null, empty stays empty; repeated rows and entities get the same surrogates; an empty table gives an empty
    result; other columns are dropped.
    """
    return checked(with_surrogates(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), key))


def replace_personal_data(docs: DataFrame, key: bytes, text_col: str = "text", length_col: str = "n_chars") -> DataFrame:
    """docs with surrogates in the text, checked for collisions, and all other columns as they are, but for the length in characters.

    Null and empty texts stay as they are; repeated rows stay and equal texts stay equal; a null length stays null; an
    empty table gives an empty result.
    """
    out = checked(with_surrogates(docs, key, text_col, "__entities"), "__entities").drop("__entities")
    if length_col in docs.columns:
        kind = docs.schema[length_col].dataType
        out = out.withColumn(length_col, F.when(F.col(length_col).isNotNull(), F.length(text_col)).cast(kind))
    return out
