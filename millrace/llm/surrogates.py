"""PII surrogates: detected entities get keyed replacements of the same type and form.

A replacement is a keyed permutation of the strings of the entity's own form
(format-preserving encryption: a Feistel network numbers the strings of the form in a keyed
order, and the next valid one in that order is taken). It has no fixed point, so that no entity
keeps its value, different entities of a form
always get different replacements, and one entity gets the same one in
every document, whatever else stands there and without any table of entities; only where a form has a single valid string it stays. Kept as they are: a phone's country code, a card's
first digit and its check digit's validity, an address's being private, an
IBAN's country and validity, a secret's known prefix, letter case, a name's last a, o or e, and
every punctuation mark. Known given names map within names of the same
script and gender, and known surnames within surnames of the script; other
name letters map within their kind (vowels, consonants, accented letters, Cyrillic, Greek) or, in other scripts, within the
256 characters around them. Words of an e-mail address's local part map as names do, so that anna.smith@
follows Anna Smith.
A name found once by its title or full form is replaced wherever one of its
parts stands in the text, so that later mentions stay with it. In each
document a check goes over the replacements: two entities of a type with one replacement are an error.

The key is an argument, else the session's millrace.pii.key, else MILLRACE_PII_KEY in the driver's environment. Where none is set, a
random one holds as long as the driver process: set one to get the same replacements again.

Defined results: a null text stays null with 0 entities; a text with no entity
stays as it is, character for character; repeated rows get the same text.
Overlapping findings: the one that begins first, and of those the longest, holds. Digits that fail
the check digit of cards are no card, and four numbers after "version" or "release" are no address.
Input columns named like an added one are replaced by it.
"""

from __future__ import annotations

import functools
import hashlib
import hmac
import ipaddress
import os
import re
import secrets
import sys
from collections import Counter

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .columns import fresh_name, quoted, with_computed

TYPES = ("email", "phone", "ip", "card", "iban", "ssn", "secret", "name")

_LOWER, _UPPER, _DIGITS = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
_NAME_SETS = ("aeiou", "bcdfghjklmnpqrstvwxyz", "áéíóúàèìòùâêîôûäëïöüãõå", "çñšžčćřďťňłśźż", "аеёиоуыэюя", "бвгджзйклмнпрстфхцчшщ", "αεηιουω", "βγδζθκλμνξπρστφχψ")
_NAME_SETS += tuple(s.upper() for s in _NAME_SETS)

_GIVEN = {
    ("latin", "f"): "Mary Anna Laura Julia Sofia Emma Claire Marie Elena Lucia Carmen Ingrid Heidi Sabine Monika Camille Chloe Alice Sarah Emily Olivia Isabel Petra Ursula Katharina Susanne Andrea Birgit Martina Karin Angelika Johanna Lena Hannah Charlotte Amelie Nathalie Isabelle Sylvie Céline Amélie Hélène Véronique Juliette Margaux Patricia Jennifer Linda Elizabeth Barbara Susan Jessica Karen Margaret Ashley Michelle Amanda Melissa Stephanie Rebecca Rachel Catherine Victoria Ana Lucía María Sofía Pilar Dolores Raquel Beatriz Inés Rocío Teresa Cristina Silvia Giulia Chiara Francesca Joanna Agnieszka Fatima Aisha Sandra Nicole Diana Helen Ruth Sharon Michele Carol Donna Brenda Pamela Rosa Gabriela Daniela Paula Claudia Alejandra Mercedes Irene Marta Alicia Nadia Ingeborg Gisela Renate Brigitte Christine Gabriele Jutta Silke Anja Katja Tanja Nina Franziska Pauline Manon Audrey Valérie Sandrine Stéphanie Émilie Aurélie Zoé Mónica Verónica".split(),
    ("latin", "m"): "John James Robert Michael David Thomas Peter Paul Carlos Miguel Javier Diego Hans Klaus Stefan Jürgen Pierre Louis Antoine Jacques William Henry George Daniel Jürg Wolfgang Andreas Christian Matthias Markus Jörg Dieter Günter Helmut Uwe Bernd Florian Sebastian Tobias Felix Lukas Jonas Friedrich Alexander François Philippe Michel Nicolas Julien Olivier Thierry Étienne René Jérôme Mathieu Guillaume Richard Joseph Charles Christopher Matthew Anthony Steven Andrew Kenneth Joshua Kevin Brian Edward Ronald Timothy Jason Jeffrey José Juan Luis Antonio Manuel Francisco Jesús Alejandro Fernando Rafael Sergio Pablo Álvaro Andrés Raúl Marco Giuseppe Giovanni Piotr Krzysztof Mohammed Ahmed Mark Donald Gary Frank Raymond Dennis Jerry Walter Harold Douglas Carl Arthur Roger Detlef Heinz Horst Werner Gerhard Manfred Rainer Ralf Joachim Torsten Holger Sven Jens Lars Ulrich Norbert Ricardo Roberto Eduardo Alberto Jorge Mario Pascal Bruno Thibault Benoît Frédéric Sébastien Cédric Iñaki Joaquín Ramón Víctor".split(),
    ("cyrillic", "f"): "Анна Мария Елена Ольга Наталья Ирина Татьяна Светлана Екатерина Юлия".split(),
    ("cyrillic", "m"): "Иван Пётр Сергей Алексей Дмитрий Николай Михаил Андрей Владимир Павел".split(),
    ("greek", "f"): "Μαρία Ελένη Αικατερίνη Σοφία Άννα Βασιλική".split(),
    ("greek", "m"): "Γιώργος Ιωάννης Δημήτρης Νίκος Κώστας Παναγιώτης".split(),
}
_SURNAMES = {
    "latin": "Smith Johnson Williams Brown Jones Miller Davis Wilson Anderson Taylor Moore Martin Thompson Garcia Martinez Rodriguez Lopez Gonzalez Sanchez Müller Schmidt Schneider Fischer Weber Wagner Becker Hoffmann Dubois Durand Lefebvre Moreau Laurent Bernard Meyer Wolf Schulz Koch Bauer Richter Klein Schröder Neumann Schwarz Zimmermann Krause Lehmann Clark Lewis Robinson Walker Young Allen King Wright Scott Hill Green Adams Baker Nelson Carter Mitchell Perez Roberts Turner Phillips Campbell Parker Evans Edwards Collins Petit Leroy Roux Fournier Girard Bonnet Mercier Fernández González Hernández Jiménez Ruiz Díaz Moreno Álvarez Romero Navarro Torres Ramírez".split(),
    "cyrillic": "Иванов Петров Смирнов Кузнецов Попов Соколов Лебедев Козлов Новиков Морозов".split(),
    "greek": "Παπαδόπουλος Γεωργίου Δημητρίου Νικολάου Ιωάννου Βασιλείου".split(),
}
#: ASCII names map among themselves, as addresses are made of them.
_LIST_OF = {n: ("given", *k, n.isascii()) for k, names in _GIVEN.items() for n in names} | {n: ("family", k, n.isascii()) for k, names in _SURNAMES.items() for n in names}
_LISTS: dict[tuple, list[str]] = {}
for _n, _k in _LIST_OF.items():
    _LISTS.setdefault(_k, []).append(_n)

#: Every match of _TITLED holds one of these.
_TITLES = ("Mr", "Ms.", "Miss", "Dr.", "Prof.", "Herr", "Frau", "Señor", "Sr", "Monsieur", "Madame", "Mme", "господин", "госпожа")
_WORD = r"[^\W\d_][^\W\d_]*(?:[-'’][^\W\d_]+)*"


def _class_of(wanted) -> str:
    """The letters for which wanted holds, as ranges of a pattern's character class."""
    ranges: list[list[int]] = []
    for c in range(sys.maxunicode + 1):
        x = chr(c)
        if x.isalpha() and wanted(x):
            if ranges and ranges[-1][1] == c - 1:
                ranges[-1][1] = c
            else:
                ranges.append([c, c])
    return "".join(chr(a) if a == b else f"{chr(a)}-{chr(b)}" for a, b in ranges)


_CAPITAL = f"(?=[{_class_of(lambda x: x.isupper() or x.istitle())}])" + _WORD
#: After a title, letters of scripts without case count too.
_NAMED = f"(?=[{_class_of(lambda x: not x.islower())}])" + _WORD
_TITLED = re.compile(rf"(?<!\w)(?:Mrs?\.?|Ms\.|Miss|Dr\.|Prof\.|Herrn?|Frau|Señora?|Sra?\.|Monsieur|Madame|Mme|господин|госпожа)[ \t]+((?:{_NAMED})(?:[ \t]{_CAPITAL}){{0,2}})")
_FULL = re.compile(rf"(?<!\w)({'|'.join(sorted((n for n, k in _LIST_OF.items() if k[0] == 'given'), key=len, reverse=True))})[ \t]({_CAPITAL})")
_GIVEN_NAMES = tuple(n for n, k in _LIST_OF.items() if k[0] == "given")

#: Every match of _FIND holds a character of _HINT (a secret after its name has ':' or '=', an address of letters alone has ':') or one of _PREFIXES.
_HINT = re.compile(r"[0-9@:=]")
_PREFIXES = ("AKIA", "ASIA", "ghp", "gho", "ghs", "github_pat", "sk-", "sk_", "pk-", "pk_", "xox")
_FIND = re.compile(
    r"""(?P<email>(?<![\w.+\u0300-\u036f-])[^\W_](?:[\w\u0300-\u036f.%+-]*[\w\u0300-\u036f%+-])?@(?:[^\W_](?:[\w\u0300-\u036f-]*[^\W_]|[\u0300-\u036f])?\.)+[^\W\d_]{2,24}(?![\w-]))
    |(?P<secret>(?<![A-Za-z0-9])(?:AKIA|ASIA)[A-Z0-9]{16}(?![A-Za-z0-9])|(?<!\w)(?:ghp|gho|ghs|github_pat|sk|pk|xox[abp])[_-][A-Za-z0-9_-]{16,}(?![A-Za-z0-9])
      |(?i:(?<![A-Za-z0-9])(?:password|passwd|pwd|secret|token|api[_-]?key|access[_-]?key))["']?\s{0,3}[:=]\s{0,3}["']?(?P<value>[^\s"',;<>]{6,}))
    |(?P<iban>(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:[ ]?[A-Z0-9]{4}){2,7}(?:[ ]?[A-Z0-9]{1,3})?(?![A-Za-z0-9]))
    |(?P<ip>(?<![\w.:])(?<![Vv]ersion\ )(?<![Rr]elease\ )(?:(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])\.){3}(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])(?![\w:]|\.[0-9])
      |(?<![\w:.])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![\w:])
      |(?<![\w:.])(?=[0-9A-Fa-f:]*[0-9])[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){0,5}::(?:[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){0,5})?(?![\w:]))
    |(?P<ssn>(?<![\w-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![\w-]))
    |(?P<card>(?<![\w-])(?:[0-9]{4}[ -]){3}[0-9]{1,7}(?![\w-])|(?<![\w-])[0-9]{13,19}(?!\w))
    |(?P<phone>(?<![\w+.])\+1[ .-]?(?:\([0-9]{3}\)|[0-9]{3})[ .-]?[0-9]{3}[ .-]?[0-9]{4}(?![0-9])|(?<![\w+.])\+[0-9]{1,3}[ .-]?(?:\([0-9]{1,4}\)[ .-]?)?[0-9](?:[ .-]?[0-9]){5,12}(?![0-9])|(?<![\w(])\([2-9][0-9]{2}\)[ ]?[0-9]{3}[ .-][0-9]{4}(?!\w)|(?<![\w.-])[2-9][0-9]{2}(?P<sep>[-.\x20])[0-9]{3}(?P=sep)[0-9]{4}(?![\w-])
      |(?<![\w+.,/-])00[1-9](?:[ ./-]?[0-9]){8,13}(?!\w)
      |(?<![\w+.,/-])(?![0-3]?[0-9][./-][01]?[0-9][./-](?:19|20)[0-9]{2}(?![0-9]))(?:\(0[1-9][0-9]{0,4}\)|0[1-9])(?:[ ]?[./-]?[ ]?[0-9]){7,11}(?!\w))""",
    re.VERBOSE,
)


@functools.cache
def _like(c: str) -> str:
    """Letters that may stand for c: of its kind, else those of its case among the 256 around it."""
    known = next((s for s in _NAME_SETS if c in s), None)
    first = ord(c) & ~255
    return known or "".join(x for x in map(chr, range(first, first + 256)) if x.isalpha() and (x.islower(), x.isupper()) == (c.islower(), c.isupper()))


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        x = int(d) * (1 + i % 2)
        total += x - 9 * (x > 9)
    return total % 10 == 0


def iban_valid(compact: str) -> bool:
    return int("".join(str(int(c, 36)) for c in compact[4:] + compact[:4])) % 97 == 1


_RANDOM_KEY: list[bytes] = []


def default_key(conf=None) -> bytes:
    """The key that is set, else a random one for this process."""
    said = (conf.get("millrace.pii.key", None) if conf is not None else None) or os.environ.get("MILLRACE_PII_KEY")
    if said:
        return said.encode()
    if not _RANDOM_KEY:
        _RANDOM_KEY.append(secrets.token_bytes(32))
    return _RANDOM_KEY[0]


class Surrogates:
    """Replacements under one key."""

    def __init__(self, key: bytes | None = None):
        self.key = hashlib.sha256(key or default_key()).digest()
        self.known: dict[tuple[str, str], str] = {}

    def _random(self, tweak: str, *parts: int) -> int:
        said = f"{tweak}|{'|'.join(map(str, parts))}".encode()
        return int.from_bytes(hmac.digest(self.key, said, "sha256"), "big")

    def _place(self, x: int, size: int, tweak: str, back: bool) -> int:
        """The place of x in a keyed order of range(size), or what is at place x: Feistel rounds, walked into range."""
        half = (size - 1).bit_length() + 1 >> 1
        mask = (1 << half) - 1

        def of(r: int, v: int) -> int:
            made = b"".join(self._random(tweak, size, r, v, k).to_bytes(32, "big") for k in range(-(-half // 256)))
            return int.from_bytes(made, "big") & mask

        while True:
            a, b = x >> half, x & mask
            for r in range(8):
                a, b = (b ^ of(7 - r, a), a) if back else (b, a ^ of(r, b))
            x = a << half | b
            if x < size:
                return x

    def permute(self, x: int, size: int, tweak: str) -> int:
        """What follows x in a keyed cyclic order of range(size): a permutation without a fixed point."""
        return x if size < 2 else self._place((self._place(x, size, tweak, False) + 1) % size, size, tweak, True)

    def by_sets(self, text: str, sets: list[str | None], tweak: str, valid=None) -> str:
        """Each character of text permuted within its set (None: kept), going on to the next result that is valid, as text is."""
        places = [i for i, s in enumerate(sets) if s and len(s) > 1]
        size = 1
        for i in places:
            size *= len(sets[i])
        number = 0
        for i in places:
            number = number * len(sets[i]) + sets[i].index(text[i])
        # punctuation is no part of the form: one number written in several ways keeps one replacement
        form = tweak + "|" + "".join(f"[{s[0]}{len(s)}]" if s else c if c.isalnum() else "" for c, s in zip(text, sets))
        while True:  # the order is a cycle: text itself ends the walk at the latest
            number = rest = self.permute(number, size, form)
            out = list(text)
            for i in reversed(places):
                rest, at = divmod(rest, len(sets[i]))
                out[i] = sets[i][at]
            made = "".join(out)
            if made == text or valid is None or valid(made):
                return made

    @staticmethod
    def plain_sets(text: str) -> list[str | None]:
        return [_DIGITS if c in _DIGITS else _LOWER if c in _LOWER else _UPPER if c in _UPPER else None for c in text]

    @staticmethod
    def letter_sets(text: str) -> list[str | None]:
        """plain_sets, with letters of other alphabets and scripts within their kind."""
        return [s or (_like(c) if c.isalpha() else None) for s, c in zip(Surrogates.plain_sets(text), text)]

    def _email(self, text: str, tweak: str) -> str:
        name, _, domain = text.rpartition("@")
        host, dot, top = domain.rpartition(".")
        # the host alone decides its replacement, so that addresses of one domain stay together
        words = re.split(r"([^\W\d_]+)", name)  # its words at odd places
        words[1::2] = [self._word(w) for w in words[1::2]]
        rest = "".join(words[::2])
        moved = iter(self.by_sets(rest, self.plain_sets(rest), tweak + "name|" + "|".join(words[1::2])))
        words[::2] = ["".join(next(moved) for _ in w) for w in words[::2]]
        return "".join(words) + "@" + self.by_sets(host, self.letter_sets(host), tweak + "host") + dot + top

    def _word(self, text: str) -> str:
        """A word of an address, as the name it may be."""
        if text.islower() and text.capitalize().lower() == text:
            made = self.of("name", text.capitalize()).lower()
            return made if len(made) and made.capitalize().lower() == made else self.of("name", text)
        return self.of("name", text)

    def _phone(self, text: str, tweak: str) -> str:
        sets = self.plain_sets(text)
        code = re.match(r"\+[0-9]{1,3}", text)
        if code:  # without a separator the code's length isn't known: one digit for 1 and 7, else two
            end = code.end() if len(text) > code.end() and not text[code.end()].isdigit() else 2 if text[1] in "17" else 3
            sets[:end] = [None] * end
        trunk = re.match(r"00[1-9][0-9]{0,2}|\(?0", text)
        if trunk:  # a national number's leading 0, or 00 and the country code as above
            end = trunk.end() if trunk.end() < 3 or not text[trunk.end()].isdigit() else 3 if text[2] in "17" else 4
            sets[:end] = [None] * end
        first = next((i for i, s in enumerate(sets) if s), None)
        if first is not None and text[first] in "23456789":
            sets[first] = "23456789"
        elif trunk and first is not None and text[first] == "1":
            sets[first] = _DIGITS[1:]
        return self.by_sets(text, sets, tweak)

    def _ip(self, text: str, tweak: str) -> str:
        if ":" in text:
            return self.by_sets(text, ["0123456789abcdef" if c in "0123456789abcdef" else "ABCDEF" if c in "ABCDEF" else None for c in text], tweak)
        kind = lambda a: (a.is_private, a.is_loopback, a.is_multicast, a.is_reserved, a.is_global)
        address = ipaddress.ip_address(text)
        keep = 8 if int(address) >> 24 in (10, 127, 0) else 12 if address in ipaddress.ip_network("172.16.0.0/12") else 16 if address.is_private or address.is_link_local else 0
        size, x = 1 << 32 - keep, int(address) & (1 << 32 - keep) - 1
        high = int(address) - x
        while True:
            x = self.permute(x, size, f"{tweak}|{high}")
            made = ipaddress.ip_address(high + x)
            if made == address or keep or kind(made) == kind(address):
                return str(made)

    def _card(self, text: str, tweak: str) -> str:
        sets = self.plain_sets(text)
        sets[0] = None
        digits = lambda s: re.sub(r"\D", "", s)
        was = luhn(digits(text))
        return self.by_sets(text, sets, tweak, lambda s: luhn(digits(s)) == was)

    def _ssn(self, text: str, tweak: str) -> str:
        return self.by_sets(text, self.plain_sets(text), tweak, re.compile(r"(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}").fullmatch)

    def _iban(self, text: str, tweak: str) -> str:
        sets = self.plain_sets(text)
        sets[:2] = [None, None]
        was = iban_valid(text.replace(" ", ""))
        return self.by_sets(text, sets, tweak, lambda s: iban_valid(s.replace(" ", "")) == was)

    def _secret(self, text: str, tweak: str) -> str:
        known = re.match(r"AKIA|ASIA|(?:ghp|gho|ghs|github_pat|sk|pk|xox[abp])[_-]", text)
        if re.fullmatch(r"[0-9a-f]+", text):
            sets: list[str | None] = ["0123456789abcdef"] * len(text)
        else:
            sets = self.plain_sets(text)
            if known:
                sets[: known.end()] = [None] * known.end()
        return self.by_sets(text, sets, tweak)

    def _name(self, text: str, tweak: str) -> str:
        if text in _LIST_OF:
            names = _LISTS[_LIST_OF[text]]
            order = sorted(names, key=lambda n: self._random(tweak + "order" + n))
            return order[(order.index(text) + 1) % len(order)]
        if text.endswith("а") and _LIST_OF.get(text[:-1], ("",))[0] == "family":  # a feminine form
            return self._name(text[:-1], tweak) + "а"
        sets = [_like(c) if c.isalpha() else None for c in text]
        if len(text) > 2 and text[-1] in "aoeаоеяαοε":  # the ending may tell the gender
            sets[-1] = None
        return self.by_sets(text, sets, tweak, lambda s: s not in _LIST_OF and s.capitalize() not in _LIST_OF)

    def of(self, kind: str, text: str) -> str:
        """The replacement of an entity."""
        key = kind, text
        if key not in self.known:
            made = getattr(self, f"_{kind}")(text, f"{kind}|")
            if len(self.known) > 200_000:
                self.known.clear()
            self.known[key] = made
        return self.known[key]

    def rewrite(self, text: str | None) -> tuple[str | None, list[tuple[str, int, int]]]:
        """(text with replacements, [(type, start, end) in the original])."""
        found = find(text)
        if not found:
            return text, []
        taken: dict[tuple[str, str], str] = {}
        out, at = [], 0
        for kind, a, b in found:
            made = self.of(kind, text[a:b])
            if taken.setdefault((kind, made), text[a:b]) != text[a:b]:
                raise ValueError(f"two entities of type {kind} have one replacement")
            out += [text[at:a], made]
            at = b
        return "".join([*out, text[at:]]), found


@functools.cache
def _given_names() -> ahocorasick.Automaton:
    """Finds all listed given names in one pass."""
    built = ahocorasick.Automaton()
    for n in _GIVEN_NAMES:
        built.add_word(n, len(n))
    built.make_automaton()
    return built


def _may_match(text: str) -> bool:
    """False only where _FIND has no match."""
    return _HINT.search(text) is not None or any(p in text for p in _PREFIXES)


def _may_have_title(text: str) -> bool:
    """False only where _TITLED has no match."""
    return any(t in text for t in _TITLES)


def find(text: str | None) -> list[tuple[str, int, int]]:
    """(type, start, end) of the entities of text, in order, without overlaps."""
    if not text:
        return []
    found: list[tuple[int, int, str]] = []
    if _may_match(text):
        for m in _FIND.finditer(text):
            kind = m.lastgroup if m.lastgroup in TYPES else next(k for k in TYPES if k != "name" and m.group(k))
            a, b = m.span("value") if m.group("value") else m.span()
            if kind != "card" or luhn(re.sub(r"\D", "", m.group())):
                found.append((a, b, kind))
    parts: set[str] = set()
    if _may_have_title(text):
        for m in _TITLED.finditer(text):
            parts.update(m.group(1).split())
    for end, size in _given_names().iter(text):
        m = _FULL.match(text, end - size + 1)
        if m:
            parts.update(m.groups())
    if parts:
        for m in re.finditer(rf"(?<!\w)(?:{'|'.join(map(re.escape, sorted(parts, key=len, reverse=True)))})(?!\w)", text):
            found.append((*m.span(), "name"))
    kept: list[tuple[str, int, int]] = []
    for a, b, kind in sorted(found, key=lambda f: (f[0], -f[1])):
        if not kept or a >= kept[-1][2]:
            kept.append((kind, a, b))
    return kept


def with_surrogates(docs: DataFrame, key: bytes | None = None, in_place: bool = False) -> DataFrame:
    """docs with private data replaced in text, and n_entities and entity_types unless in_place."""
    key = key or default_key(docs.sparkSession.conf)
    by_key: dict[bytes, Surrogates] = {}

    def compute(texts: list[str | None]) -> list[pa.Array]:
        own = by_key.setdefault(key, Surrogates(key))
        made = [own.rewrite(t) for t in texts]
        columns = [pa.array([t for t, _ in made], pa.string())]
        if not in_place:
            columns.append(pa.array([len(f) for _, f in made], pa.int32()))
            columns.append(pa.array([sorted(Counter(k for k, _, _ in f).items()) for _, f in made], pa.map_(pa.string(), pa.int32())))
        return columns

    if in_place:  # the column stays where it is, under the name it has
        name = next(c for c in docs.columns if c.lower() == "text")
        other = fresh_name("surrogate_text", docs.columns)
        made = with_computed(docs, [T.StructField(other, T.StringType())], compute, name)
        return made.select(*[F.col(other).alias(c) if c == name else F.col(quoted(c)) for c in docs.columns])
    added = [T.StructField("surrogate_text", T.StringType()), T.StructField("n_entities", T.IntegerType()), T.StructField("entity_types", T.MapType(T.StringType(), T.IntegerType()))]
    return with_computed(docs, added, compute)
