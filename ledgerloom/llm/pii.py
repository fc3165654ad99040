"""Personal data: detection and keyed, type-consistent surrogates.

Every detected entity is replaced by another of its type, derived from a secret key and the entity's
normal form (digits without punctuation, names and addresses lower-cased). So equal entities get
equal surrogates in all documents and tasks; what the format carries (letter case, punctuation,
number of digits, check digits, country code, titles, particles, gender, script) is kept.

Names follow a title and have any number of capitalised words, initials and particles. Each word is
replaced by itself, as a given or a family name, so that full and short forms agree: a family name
keeps its surrogate with or without given name, in all documents. Once a document has named someone,
their names are replaced there without a title, too; what kind of name a word is and, after a title
without gender, which gender follows from the other mentions in the document. Scripts without
capitals have no sign of a name's end; there a name has two words at most.

Different entities keep different surrogates. Numbers go through a keyed permutation of all numbers
of their length, so they cannot collide. E-mail addresses and words of names are drawn by a keyed
hash. A first pass over all texts collects them; of those that share a surrogate all but one draw
again, with one syllable more, until none do. Those that drew again are a table, sent to the tasks if
it is small and joined to the texts they occur in if not.
"""

from __future__ import annotations

import hashlib
import hmac
import ipaddress
import math
import re
import unicodedata
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, stored

KEY = b"surrogates"

# Made-up names: consonants and vowels of a script, or letters of a script without capitals.
SOUNDS = {
    "latin": ("bcdfghjklmnprstvwz", "aeiou"),
    "cyrillic": ("бвгджзклмнпрстфх", "аеиоу"),
    "greek": ("βγδζθκλμνπρστφχ", "αεηιου"),
}
LETTERS = {
    "arabic": (0x628, 0x63A), "hebrew": (0x5D0, 0x5EA), "georgian": (0x10D0, 0x10F0), "thai": (0xE01, 0xE2E),
    "devanagari": (0x915, 0x939), "hiragana": (0x3042, 0x3093), "katakana": (0x30A2, 0x30F3),
    "hangul": (0xAC00, 0xD7A3), "cjk": (0x4E00, 0x9FA5),
}
SOUNDS |= {script: ("".join(map(chr, range(a, b + 1))), ("",)) for script, (a, b) in LETTERS.items()}
# Ends of given names by gender; each begins with a vowel.
ENDINGS = {
    ("f", "latin"): ("a", "ia", "ina", "ella", "ette"),
    ("m", "latin"): ("o", "us", "an", "in", "ert"),
    ("", "latin"): ("e", "i", "y", "is", "el"),
    ("f", "cyrillic"): ("а", "ия", "ина", "ела"),
    ("m", "cyrillic"): ("ан", "ин", "ей", "ор"),
    ("", "cyrillic"): ("о", "и", "е", "ю"),
    ("f", "greek"): ("α", "ια", "ινα", "ουλα"),
    ("m", "greek"): ("ος", "ης", "ας", "ιος"),
    ("", "greek"): ("ι", "ου", "ε", "ω"),
}
SYLLABLES = 6
TITLES = {
    "f": "Mrs Ms Miss Frau Madame Mme Mlle Señora Sra Doña Госпожа Κυρία السيدة".split(),
    "m": "Mr Sir Herr Monsieur Señor Sr Don Господин Κύριος السيد".split(),
    "": "Dr Prof".split(),
}
GENDER = {title: gender for gender, titles in TITLES.items() for title in titles}

PARTICLES = "von van der den de del della da dos di du la le ten ter zu y e bin ibn al el".split()
# Letters with case, from Unicode's properties; all others are caseless.
UPPER = "".join(c for c in map(chr, range(1 << 16)) if c.isalpha() and c.isupper())
LOWER = "".join(c for c in map(chr, range(1 << 16)) if c.isalpha() and c.islower())
TITLE = rf"(?:{'|'.join(sorted(GENDER))})(?:\.\x20?|\x20)"
CAPITALISED = rf"(?:d['’])?[{UPPER}](?:['’](?!s\b)(?=[^\W\d_])|-(?=[{UPPER}])|[^\W\d_])+"
INITIAL = rf"[{UPPER}]\.(?=\x20?[{UPPER}])"
CASELESS = rf"(?![{UPPER}{LOWER}])[^\W\d_]+"
PART = rf"(?:(?:{'|'.join(PARTICLES)})\x20)*(?:{INITIAL}|{CAPITALISED})"
HEX = "[0-9A-Fa-f]{1,4}"
PATTERNS = {
    "email": r"[^\W_][\w.+-]*@(?:[^\W_](?:[\w-]*[^\W_])?\.)+[^\W\d_]{2,}",
    "iban": r"\b[A-Z]{2}\d{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?\b",
    "ssn": r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])",
    "ipv6": rf"(?<![\w:.])(?=[0-9A-Fa-f:]*\d)(?:(?:{HEX}:){{7}}{HEX}|(?:{HEX}:){{1,6}}(?::{HEX}){{1,6}})(?![\w:])",
    "ip": r"(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?![\d.]*\d)",
    "card": r"(?<![\d-])\d{4}[\x20-]?\d{4}[\x20-]?\d{4}[\x20-]?\d{1,7}(?![\d-]*\d)",
    "phone": r"(?<![\w+])(?:\+\d{1,3}[\x20.-]?)?(?:\(\d{2,4}\)[\x20.-]?\d{3}[\x20.-]?\d{3,4}|\d{3}[.-]\d{3}[.-]\d{4})(?!\d)"
    r"|(?<![\w+])\+\d{1,3}(?:[\x20.-]?\d{2,4}){2,5}(?!\d)"
    r"|(?<![\w+./-])(?:\d{3}\x20\d{3}\x20\d{4}|0\d{2,4}(?:\x20/\x20|[\x20/-])\d{5,8}|0\d(?:[\x20.]\d{2}){4})(?![./-]?\d)",
    "name": rf"\b(?:{TITLE})+(?:{PART}(?:(?:\x20|(?<=\.)){PART})*|{CASELESS}(?:\x20{CASELESS})?)",
}
NUMBERS = ("iban", "ssn", "ip", "card", "phone")


@lru_cache
def pattern(kinds: tuple[str, ...]) -> re.Pattern:
    """All ``kinds`` as one pattern; where several fit, the first in the order of PATTERNS."""
    return re.compile("|".join(f"(?P<{k}>{p})" for k, p in PATTERNS.items() if k in kinds))


def possible(text: str) -> tuple[str, ...]:
    """The kinds of which the text has a mandatory character or word."""
    kinds = []
    if "@" in text:
        kinds.append("email")
    if any(digit in text for digit in "0123456789"):
        kinds += NUMBERS
        if text.count(":") > 1:
            kinds.append("ipv6")
    if any(title in text for title in GENDER):
        kinds.append("name")
    return tuple(kinds)


TITLES_OF = re.compile(rf"(?:{TITLE})+")
UNITS = re.compile(rf"[{UPPER}]\.|{CAPITALISED}|[^\W\d_]+")
WORDS = re.compile(r"[^\W\d_]+")
DOMAIN = "example"


def _number(key: bytes, *parts: str) -> int:
    """A keyed pseudo-random number of 128 bits."""
    text = "\x1f".join(parts).encode("utf-8", "surrogatepass")
    return int.from_bytes(hmac.new(key, text, hashlib.sha256).digest()[:16], "big")


def permuted(key: bytes, label: str, number: int, size: int) -> int:
    """A keyed permutation of the numbers below ``size``.

    Four Feistel rounds on the next larger square, walked on until the result is below ``size``.
    """
    if size < 2:
        return 0
    half = max(2, math.isqrt(size) + 1)
    while True:
        left, right = divmod(number, half)
        for turn in range(6):
            left, right = right, (left + _number(key, label, str(turn), str(right))) % half
        number = left * half + right
        if number < size:
            return number


def _digits(key: bytes, label: str, digits: str) -> str:
    """Another string of as many digits; different ones stay different."""
    size = 10 ** len(digits)
    return str(permuted(key, f"{label}{len(digits)}", int(digits), size)).zfill(len(digits))


def _refill(entity: str, digits: str) -> str:
    """The entity with its digits replaced one by one; punctuation stays."""
    left = iter(digits)
    return "".join(next(left) if c.isdigit() else c for c in entity)


def luhn_digit(digits: str) -> str:
    """The last digit that makes a card number valid."""
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = int(c) * (2 if i % 2 == 0 else 1)
        total += n - 9 if n > 9 else n
    return str(-total % 10)


def _email(key: bytes, entity: str, turn: int = 0) -> str:
    """A local part in the same style, at a reserved domain."""
    local = entity.rpartition("@")[0]
    number = _number(key, "email", entity.lower(), str(turn))
    letters = []
    for _ in range(15):
        number, rest = divmod(number, 26)
        letters.append(chr(97 + rest))
    cut = next((c for c in local if c in ".-_+"), "")
    made = f"{''.join(letters[:7])}{cut}{''.join(letters[7:])}"
    return f"{made.upper() if local.isupper() else made}@mail.{DOMAIN}"


def _ip(key: bytes, entity: str) -> str:
    """Another address of the same network, if it is in a reserved one, else of the others.

    Loopback addresses and 0.0.0.0/8 name no one and stay.
    """
    address = ipaddress.ip_address(".".join(str(int(p)) for p in entity.split(".")))
    if address in OWN_MACHINE[0] or address in OWN_MACHINE[1]:
        return entity
    for network in NETWORKS:
        if address in network:
            first, size = int(network.network_address), network.num_addresses
            return str(network[permuted(key, f"ip{network}", int(address) - first, size)])
    number = int(address)
    while True:
        number = permuted(key, "ip", number, 1 << 32)
        made = ipaddress.ip_address(number)
        if not any(made in network for network in (*NETWORKS, *OWN_MACHINE)):
            return str(made)


def _ipv6(key: bytes, entity: str) -> str:
    """Another address of the same network, written as the entity is; the own machine's stays."""
    address = ipaddress.IPv6Address(entity)
    if address.is_loopback or address.is_unspecified:
        return entity
    inside = next((n for n in NETWORKS_V6 if address in n), None)
    if inside:
        first = int(inside.network_address)
        made = inside[permuted(key, f"ip{inside}", int(address) - first, inside.num_addresses)]
    else:
        number = int(address)
        while True:
            number = permuted(key, "ipv6", number, 1 << 128)
            made = ipaddress.IPv6Address(number)
            if number > 1 and not any(made in n for n in NETWORKS_V6):
                break
    text = made.compressed if "::" in entity else made.exploded
    return text.upper() if entity.upper() == entity != entity.lower() else text


def _card(key: bytes, entity: str) -> str:
    digits = re.sub(r"\D", "", entity)
    made = _digits(key, "card", digits[:-1])
    valid = luhn_digit(digits[:-1]) == digits[-1]
    last = luhn_digit(made) if valid else str((int(luhn_digit(made)) + int(digits[-1]) - int(luhn_digit(digits[:-1]))) % 10)
    return _refill(entity, made + last)


def _ssn(key: bytes, entity: str) -> str:
    return _refill(entity, _digits(key, "ssn", re.sub(r"\D", "", entity)))


def _phone(key: bytes, entity: str) -> str:
    """The country code or first zero stays; all other digits change."""
    code = re.match(r"\+\d{1,3}(?=\D)|\+\d{2}|0", entity)
    head = code.group() if code else ""
    rest = entity[len(head) :]
    digits = re.sub(r"\D", "", rest)
    return head + _refill(rest, _digits(key, f"phone{head}", digits))


def _iban(key: bytes, entity: str) -> str:
    """Country, lengths and places of letters stay; the check digits fit the new number."""
    plain = entity.replace(" ", "")
    body = plain[4:]
    digits = "".join(c for c in body if c.isdigit())
    letters = "".join(c for c in body if c.isalpha())
    made_digits = iter(_digits(key, f"iban{plain[:2]}", digits) if digits else "")
    turn = _number(key, "iban letters", digits)
    made_letters = iter(chr(65 + (ord(c) - 65 + (turn >> 5 * i)) % 26) for i, c in enumerate(letters))
    made = "".join(next(made_digits) if c.isdigit() else next(made_letters) for c in body)
    check = 98 - int("".join(str(int(c, 36)) for c in made + plain[:2] + "00")) % 97
    spread = iter(f"{plain[:2]}{check:02d}{made}")
    return "".join(c if c == " " else next(spread) for c in entity)


MAKERS: dict[str, Callable[[bytes, str], str]] = {
    "iban": _iban, "ssn": _ssn, "ip": _ip, "ipv6": _ipv6, "card": _card, "phone": _phone,
}
# Address ranges that keep their addresses to themselves.
NETWORKS = [
    ipaddress.ip_network(n)
    for n in "10.0.0.0/8 100.64.0.0/10 169.254.0.0/16 172.16.0.0/12 192.168.0.0/16 224.0.0.0/3".split()
]
# Documentation, local and multicast addresses, then all others in use.
NETWORKS_V6 = [ipaddress.ip_network(n) for n in "2001:db8::/32 fc00::/7 fe80::/10 ff00::/8 2000::/3".split()]
OWN_MACHINE = [ipaddress.ip_network(n) for n in ("127.0.0.0/8", "0.0.0.0/8")]


def script_of(word: str) -> str:
    script = unicodedata.name(word[0], "").split(" ")[0].lower()
    return script if script in SOUNDS else "latin"


@dataclass(frozen=True, slots=True)
class Word:
    """A word of a name, as places in the text. Initials have the role ``initial``."""

    start: int
    end: int
    text: str
    role: str
    gender: str = ""

    def normal(self) -> str:
        gender = self.gender if self.role == "given" else ""
        return ":".join([self.role, gender, script_of(self.text), self.text.casefold()])


@dataclass(frozen=True, slots=True)
class Entity:
    start: int
    end: int
    kind: str
    text: str
    words: tuple[Word, ...] = ()

    def drawn(self) -> list[tuple[str, str]]:
        """``(kind, normal form)`` of what is drawn by hash and can collide."""
        if self.kind == "email":
            return [("email", self.text.lower())]
        return [("name", w.normal()) for w in self.words if w.role != "initial"]


def _made_word(key: bytes, normal: str, turn: int, syllables: int) -> str:
    """A made-up family name, or a given name with an ending of the gender; a syllable more each turn."""
    role, gender, script, _ = normal.split(":", 3)
    consonants, vowels = SOUNDS[script]
    ways = len(consonants) * len(vowels)
    ends = ENDINGS.get((gender, script), ()) if role == "given" else ()
    if ends:
        syllables = max(1, syllables // 2)
    # As many as make up for fewer or more ways than a Latin syllable has.
    syllables = max(1, round(syllables * math.log(90) / math.log(ways))) + turn
    number = _number(key, "name", normal, str(turn))
    made = ""
    for _ in range(syllables):
        number, rest = divmod(number, ways)
        made += consonants[rest // len(vowels)] + vowels[rest % len(vowels)]
    if ends:
        number, rest = divmod(number, len(consonants))
        made += consonants[rest] + ends[number % len(ends)]
    return made


class GivenNames:
    """The made-up given names of a gender and script."""

    def __init__(self, gender: str, script: str):
        consonants, vowels = SOUNDS[script]
        ends = "|".join(ENDINGS[gender, script])
        self.form = re.compile(f"(?:[{consonants}][{vowels}])+[{consonants}](?:{ends})")

    def __contains__(self, name: str) -> bool:
        return bool(self.form.fullmatch(name.lower()))


GIVEN = {kind: GivenNames(*kind) for kind in ENDINGS}


def _initial(key: bytes, letter: str) -> str:
    """Another initial of the script; different letters A-Z stay different."""
    if "A" <= letter <= "Z":
        return chr(65 + permuted(key, "initial", ord(letter) - 65, 26))
    consonants = SOUNDS[script_of(letter)][0]
    return consonants[_number(key, "initial", letter) % len(consonants)].upper()


def _titled(start: int, entity: str) -> tuple[str, list[tuple[int, str]]]:
    """Gender of the titles, and ``(place, unit)`` of the names and initials after them."""
    head = TITLES_OF.match(entity).end()
    genders = [GENDER[t] for t in WORDS.findall(entity[:head]) if GENDER.get(t)]
    units = [(start + m.start(), m.group()) for m in UNITS.finditer(entity, head) if m.group() not in PARTICLES]
    return genders[0] if genders else "", units


def _pieces(at: int, unit: str) -> Iterator[tuple[int, str]]:
    """The words of a unit; the single letters of O'Brien and d'Artagnan stay."""
    for m in WORDS.finditer(unit):
        if len(m.group()) > 1 or script_of(m.group()) in LETTERS:
            yield at + m.start(), m.group()


def _names(found: list[tuple[int, int, str]]) -> tuple[list[Entity], dict[str, tuple[str, str]]]:
    """The titled names of a document, and role and gender of each of their words.

    A word alone after its title is a given name if a longer name of the document has it as one.
    """
    parsed = [(start, end, text, *_titled(start, text)) for start, end, text in found]
    known: dict[str, tuple[str, str]] = {}
    for alone in (False, True):
        for _, _, _, gender, units in parsed:
            if (len(units) == 1) != alone:
                continue
            for i, (at, unit) in enumerate(units):
                role = "family" if i == len(units) - 1 else "given"
                for _, piece in () if unit.endswith(".") else _pieces(at, unit):
                    before = known.setdefault(piece.casefold(), (role, gender))
                    if not before[1]:
                        known[piece.casefold()] = (before[0], gender)
    names = []
    for start, end, text, gender, units in parsed:
        words = []
        for i, (at, unit) in enumerate(units):
            if unit.endswith("."):
                words.append(Word(at, at + 1, unit[0], "initial"))
                continue
            for place, piece in _pieces(at, unit):
                role = "family" if i == len(units) - 1 else "given"
                before, other = known[piece.casefold()]
                role = before if len(units) == 1 else role
                words.append(Word(place, place + len(piece), piece, role, gender or other))
        names.append(Entity(start, end, "name", text, tuple(words)))
    return names, known


def _mentions(text: str, known: dict[str, tuple[str, str]], taken: list[Entity]) -> Iterator[Entity]:
    """Where words of the document's names stand without a title, outside of other entities."""
    words: list[Word] = []
    later = iter([*taken, Entity(len(text), len(text), "", "")])
    nearest = next(later)
    for match in WORDS.finditer(text):
        start, end, word = match.start(), match.end(), match.group()
        while nearest.end <= start and nearest.kind:
            nearest = next(later)
        of = known.get(word.casefold())
        if of is None or word[0].islower() or start >= nearest.start:
            continue
        if words and text[words[-1].end : start] != " ":
            yield _mention(text, words)
            words = []
        words.append(Word(start, end, word, *of))
    if words:
        yield _mention(text, words)


def _mention(text: str, words: list[Word]) -> Entity:
    start, end = words[0].start, words[-1].end
    return Entity(start, end, "name", text[start:end], tuple(words))


def _is_ipv6(text: str) -> bool:
    """Addresses of three groups or more, or of a local network; ``a::1`` alone is none."""
    groups = [g for g in text.split(":") if g]
    try:
        address = ipaddress.IPv6Address(text)
    except ValueError:
        return False
    return len(groups) > 2 or address.is_link_local


def entities(text: str) -> list[Entity]:
    """All entities of a text from left to right; IBANs and cards need not have valid checks."""
    kinds = possible(text)
    found: list[Entity] = []
    titled: list[tuple[int, int, str]] = []
    for match in pattern(kinds).finditer(text) if kinds else ():
        kind = match.lastgroup
        if kind == "name":
            titled.append((match.start(), match.end(), match.group()))
        elif kind != "ipv6" or _is_ipv6(match.group()):
            found.append(Entity(match.start(), match.end(), kind, match.group()))
    if titled:
        names, known = _names(titled)
        found = sorted([*found, *names], key=lambda e: e.start)
        found = sorted([*found, *_mentions(text, known, found)], key=lambda e: e.start)
    return found


Turns = dict[tuple[str, str], int]


def surrogate(key: bytes, entity: Entity, turns: Turns, syllables: int = SYLLABLES) -> str:
    """What replaces an entity. ``turns``: how often its parts had to draw again."""
    if entity.kind == "email":
        return _email(key, entity.text, turns.get(entity.drawn()[0], 0))
    if entity.kind != "name":
        return MAKERS[entity.kind](key, entity.text)
    out, at = [], entity.start
    for word in entity.words:
        out.append(entity.text[at - entity.start : word.start - entity.start])
        at = word.end
        if word.role == "initial":
            out.append(_initial(key, word.text))
            continue
        normal = word.normal()
        made = _made_word(key, normal, turns.get(("name", normal), 0), syllables)
        out.append(made.upper() if word.text.isupper() and len(word.text) > 1 else made.capitalize())
    return "".join([*out, entity.text[at - entity.start :]])


def replaced(text: str, key: bytes, turns: Turns, syllables: int = SYLLABLES) -> tuple[str, list[str]]:
    """The text with surrogates, and ``kind:start:end`` of each entity in the original."""
    out, spans, at = [], [], 0
    for entity in entities(text):
        out += [text[at : entity.start], surrogate(key, entity, turns, syllables)]
        spans.append(f"{entity.kind}:{entity.start}:{entity.end}")
        at = entity.end
    return "".join([*out, text[at:]]), spans


def _draw(key: bytes, kind: str, normal: str, turn: int, syllables: int) -> str:
    """What must differ between different entities of a kind."""
    if kind == "email":
        return _email(key, normal, turn).lower()
    return f"{normal.split(':', 1)[0]}:{_made_word(key, normal, turn, syllables)}"


def collision_turns(docs: DataFrame, key: bytes = KEY, syllables: int = SYLLABLES) -> DataFrame:
    """``(kind, normal, turn)`` of all that must draw again so that no two of a kind share a surrogate.

    Of those that share one, the one that drew least often, then the smallest, keeps it.
    """

    def drawn(rows: list[tuple[str, str, int]]) -> pa.RecordBatch:
        full = [(*row, _draw(key, *row, syllables)) for row in rows]
        kinds = (pa.string(), pa.string(), pa.int32(), pa.string())
        columns = [pa.array([r[i] for r in full], kind) for i, kind in enumerate(kinds)]
        return pa.RecordBatch.from_arrays(columns, names=["kind", "normal", "turn", "drawn"])

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = (value.as_py() or "" for value in batch.column(0))
            yield drawn([(*d, 0) for d in sorted({d for t in texts for e in entities(t) for d in e.drawn()})])

    def again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield drawn(list(zip(*(column.to_pylist() for column in batch.columns), strict=True)))

    schema = "kind string, normal string, turn int, drawn string"
    table = stored(docs.select("text").mapInArrow(find, schema).distinct(), "entities")
    while True:
        keeps = F.min(F.struct("turn", "normal")).alias("keeps")
        shared = table.groupBy("kind", "drawn").agg(keeps, F.count(F.lit(1)).alias("n")).filter("n > 1")
        clash = (
            table.join(shared, ["kind", "drawn"])
            .filter((F.col("turn") != F.col("keeps.turn")) | (F.col("normal") != F.col("keeps.normal")))
            .select("kind", "normal", (F.col("turn") + 1).cast("int").alias("turn"))
        )
        clash = stored(clash, "clashes")
        if clash.isEmpty():
            return table.filter("turn > 0").select("kind", "normal", "turn")
        rest = table.join(clash.select("kind", "normal"), ["kind", "normal"], "left_anti")
        table = stored(rest.select("kind", "normal", "turn", "drawn").unionByName(clash.mapInArrow(again, schema)), "entities")


def collisions(docs: DataFrame, key: bytes = KEY, syllables: int = SYLLABLES) -> Turns:
    """``collision_turns`` of a small table as a dictionary."""
    return {(r.kind, r.normal): r.turn for r in collision_turns(docs, key, syllables).collect()}


def _turns_of_texts(wanted: DataFrame, turns: DataFrame) -> DataFrame:
    """``wanted`` with a column ``again``: the turns of what its text has, found by a join."""

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for place, value in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                rows = sorted({d for e in entities(value.as_py() or "") for d in e.drawn()})
                columns = [[place] * len(rows), [r[0] for r in rows], [r[1] for r in rows]]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, pa.string()) for c in columns], names=["text_key", "kind", "normal"]
                )

    keyed = wanted.withColumn("text_key", F.md5("text"))
    asked = keyed.select("text_key", "text").mapInArrow(ask, "text_key string, kind string, normal string")
    again = F.collect_list(F.struct("kind", "normal", "turn")).alias("again")
    found = asked.distinct().join(turns, ["kind", "normal"]).groupBy("text_key").agg(again)
    return keyed.join(stored(found, "turns"), "text_key", "left").select("doc_id", "text", "again")


def pseudonymise(docs: DataFrame, key: bytes = KEY, syllables: int = SYLLABLES) -> DataFrame:
    """Columns doc_id, text (with surrogates), n_entities and spans for every row of ``docs``.

    Spans are ``kind:start:end`` in code points of the original text, end exclusive, comma-joined.
    Null texts stay null, without entities; empty ones stay empty. Repeated rows get equal results,
    equal entities equal surrogates, also in other documents, partitions and runs. Texts are read
    whole, however long, in one pass each. Other columns of ``docs`` are not read, whatever their
    names. ``syllables`` of made-up names: fewer make more names draw again.
    """
    turns = stored(collision_turns(docs, key, syllables), "turns")
    wanted = docs.select("doc_id", "text")
    known: Turns = {}
    if turns.count() <= BROADCAST_ROWS:
        known = {(r.kind, r.normal): r.turn for r in turns.collect()}
        wanted = wanted.withColumn("again", F.lit(None).cast("array<struct<kind:string,normal:string,turn:int>>"))
    else:
        wanted = _turns_of_texts(wanted, turns)
    shared = docs.sparkSession.sparkContext.broadcast(known)

    def rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, counts, spans = [], [], []
            for value, again in zip(batch.column(1), batch.column(2), strict=True):
                text = value.as_py()
                own = {(r["kind"], r["normal"]): r["turn"] for r in again.as_py() or ()} or shared.value
                made, found = (None, []) if text is None else replaced(text, key, own, syllables)
                texts.append(made)
                counts.append(len(found))
                spans.append(",".join(found))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(texts, pa.string()), pa.array(counts, pa.int64()),
                 pa.array(spans, pa.string())],
                names=["doc_id", "text", "n_entities", "spans"],
            )

    kind = wanted.schema["doc_id"].dataType.simpleString()
    return wanted.mapInArrow(
        rewrite, f"doc_id {kind}, text string, n_entities bigint, spans string"
    )
