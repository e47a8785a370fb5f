"""PII surrogates: keyed, type-consistent, the same for the same entity everywhere.

Entities are found in the whole text and replaced one for one.  All valid
values of a form (the numbers that an octet can be, letters by vowel and
consonant, all but the check digits of a card) stand in a keyed order, and each
is replaced by the one after it, the last by the first.  So a surrogate is
valid, is never the original, is the same for one entity in every document and
never shared by two, without a table of all entities.  ``with_collisions``
checks that over a whole table.
"""

from __future__ import annotations

import hashlib
import hmac
import re
from collections.abc import Iterator, Sequence
from math import prod

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, small_batches

# Given names whose gender is taken as known; the surrogate comes from the same list.
FEMALE = "Abigail Adriana Agnes Alexandra Alice Amanda Amelia Amy Ana Angela Angelika Anita Anna Anne Antonia Ashley Astrid Aurelie Aurélie Barbara Beatrice Betty Birgit Brenda Brigitte Camille Carla Carmen Carol Caroline Catherine Cecile Charlotte Chloe Chloé Christina Christine Claire Clara Claudia Cristina Cynthia Cécile Deborah Debra Diana Diane Donna Dorothy Elena Elisabeth Elizabeth Ella Ellen Emily Emma Erika Eva Florence Francoise Franziska Françoise Gabriele Gisela Gloria Hanna Hannah Heather Heike Helen Helena Helene Hélène Ines Ingrid Inés Irene Irma Isabel Isabella Jacqueline Jane Janet Janice Jennifer Jessica Joan Johanna Joyce Judith Julia Julie Juliette Karen Karin Katharina Kathleen Kelly Kimberly Laura Lea Lena Leonie Linda Lisa Louise Lucia Lucie Lucy Lucía Léa Magdalena Manon Margaret Margarita Maria Marie Marina Marta Martha Martina Mary María Mathilde Megan Melissa Mia Michelle Monika Mónica Nadia Nancy Natalia Nathalie Nicole Nina Olivia Pamela Patricia Paula Pauline Petra Pilar Rachel Rebecca Renate Rosa Rosario Ruth Sabine Samantha Sandra Sara Sarah Sharon Silvia Simone Sofia Sofía Sophie Stefanie Stephanie Susan Susanne Sylvie Teresa Theresa Ursula Ute Valerie Vanessa Veronica Victoria Virginia Virginie Yvonne Zoe Zoé".split()
MALE = "Aaron Adam Adrian Alain Alan Albert Alberto Alejandro Alexander Alfred Alfredo Andre Andreas Andrew André Andrés Anthony Antoine Antonio Arthur Axel Benjamin Bernard Bernd Björn Brian Bruno Carlos Charles Christian Christoph Christopher Claude Damien Daniel David Dennis Didier Diego Dieter Dirk Donald Douglas Eduardo Edward Emil Enrique Eric Erik Ernst Fabian Federico Felix Fernando Florian Francisco Francois Frank Franz François Friedrich Gary Georg George Gerald Gerard Gerhard Gregory Guillaume Guillermo Gustav Gérard Günter Günther Hans Harald Harold Heinrich Heinz Helmut Henri Henry Hermann Horst Hugo Ian Ignacio Jack Jacob Jacques James Jason Javier Jean Jeffrey Jens Jerome Jerry Jesus Jesús Joachim Joe Johann Johannes John Jonas Jonathan Jorge Jose Joseph Joshua José Juan Juergen Julien Justin Jérôme Jörg Jürgen Karl Keith Kenneth Kevin Klaus Kurt Larry Laurent Lawrence Leon Lorenzo Louis Lucas Luis Lukas Manfred Manuel Marc Marcel Marco Marcos Mario Mark Markus Martin Matthew Matthias Max Maxime Michael Miguel Mohamed Muhammad Nicholas Nicolas Noah Oliver Olivier Oscar Otto Pablo Pascal Patrick Paul Pedro Peter Philip Philipp Philippe Pierre Rafael Rainer Ralf Ramon Ramón Raul Raymond Raúl Rene René Ricardo Richard Robert Roberto Roger Roland Ronald Rudolf Ryan Samuel Scott Sebastian Sergio Simon Stefan Stephan Stephen Steven Sven Theodor Thierry Thomas Thorsten Timothy Tobias Tom Tomas Tomás Ulrich Uwe Victor Vincent Walter Werner Wilhelm William Wolfgang Xavier Yves".split()
FEMALE_CYRILLIC = "Александра Алина Алиса Анастасия Анна Валентина Валерия Вера Виктория Галина Дарья Евгения Екатерина Елена Елизавета Зоя Ирина Кристина Ксения Лариса Любовь Людмила Маргарита Марина Мария Надежда Наталья Нина Оксана Ольга Полина Светлана София Татьяна Юлия Яна".split()
MALE_CYRILLIC = "Александр Алексей Анатолий Андрей Антон Артём Борис Вадим Валентин Валерий Василий Виктор Виталий Владимир Вячеслав Геннадий Георгий Григорий Даниил Денис Дмитрий Евгений Иван Игорь Илья Кирилл Константин Леонид Максим Михаил Николай Олег Павел Пётр Роман Сергей Станислав Степан Фёдор Юрий Яков".split()
_LISTS = (FEMALE, MALE, FEMALE_CYRILLIC, MALE_CYRILLIC)
_GENDER = {n: g for names, g in zip(_LISTS, "fmfm", strict=True) for n in names}
_LISTED = {n: names for names in _LISTS for n in names}
_TITLES = {"Mr": "m", "Herr": "m", "Sr": "m", "Monsieur": "m", "Mrs": "f", "Ms": "f", "Miss": "f", "Frau": "f", "Sra": "f", "Madame": "f", "Mme": "f", "Dr": "", "Prof": "", "Doctor": "", "Professor": "", "Señor": "m", "Señora": "f", "Mlle": "f", "Mademoiselle": "f", "Господин": "m", "Госпожа": "f"}
_GIVEN = "|".join(sorted(_GENDER, key=lambda x: (-len(x), x)))
_CAP = r"[^\W\d_a-zß-öø-ÿ][^\W\d_]+(?:[-'’][^\W\d_]+)*"
_SURNAME = rf"(?![а-яё]){_CAP}"
#: Without a title or a listed given name, two or three capitalised words are a name after these words or before those.
_BEFORE = "Dear|Name|Author|Contact|Signed|[Ww]ritten by|[Ss]igned by|[Rr]egards,|Sincerely,|Liebe|Lieber|Cher|Chère|Querido|Querida|Estimado|Estimada|Уважаемый|Уважаемая"
_SPEAKS = "wrote|writes|said|says|asked|replied|told|added|explained|schrieb|sagte|fragte|antwortete|escribió|dijo|respondió|écrit|déclare|répond|написал|написала|сказал|сказала|ответил|ответила"
_NO_NAME = "The|A|An|In|On|At|But|And|As|So|If|When|Then|Yesterday|Today|Later|He|She|It|They|We|You|I|Das|Der|Die|Ein|Eine|Und|Aber|El|La|Los|Las|Y|Pero|Le|Les|Et|Mais|И|Но|А"
_FULL = rf"(?!(?:{_NO_NAME}) )(?:{_CAP}|[A-ZА-ЯЁ]\.)(?: (?:{_CAP}|[A-ZА-ЯЁ]\.)){{0,1}} {_CAP}"
_ARTICLE = re.compile(r"(?i:(?<!\w)(?:the|an?|das|der|die|eine?|el|la|los|las|les?) )$")
#: Digits that a number can have at most, with the country code; 15 in other countries.
_DIGITS_OF = {"1": 11, "7": 11, "33": 11, "34": 11, "44": 12, "49": 13}

#: In the order in which they win where two begin at one place.
PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]*[A-Za-z0-9_%+-]@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}",
    "secret": r"""(?i:\b(?:api[_-]?key|access[_-]?key|secret|token|passw(?:or)?d|auth)\b["']?\s*[:=]\s*["']?)(?P<secret>[A-Za-z0-9+/_=-]{8,}|(?=[A-Za-z+/_=-]*\d)[A-Za-z0-9+/_=-]{4,7})""",
    "ip": r"(?<![\w.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?![\w]|\.\d)",
    "ssn": r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])",
    "iban": r"(?<!\w)[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?!\w)",
    "card": r"(?<![\w-])\d(?:[ -]?\d){12,18}(?![\w-])",
    "phone": r"(?<![\w.])(?:\+\d{1,3}(?:[ .-]?(?:\(\d{1,4}\)|\d{1,12}(?!\d))){1,8}|\(\d{3,4}\)[ .-]?\d{3}[ .-]?\d{3,4}|\d{3}[ .-]\d{3}[ .-]\d{4}|(?<![/-])(?!\d\d(?P<date>[./-])\d\d(?P=date)(?:\d\d|\d{4})(?!\d|(?P=date)\d))(?:00?[1-9]\d{0,3}|\(0[1-9]\d{0,3}\))[ ./-]+\d{1,8}(?:[ .-]\d{1,8}){0,5})(?!\w|\.\d)",
    "person": rf"(?<!\w)(?:(?P<title>{'|'.join(_TITLES)})\.? (?P<titled>{_CAP}(?: {_CAP})?)|(?P<given>{_GIVEN})(?:-{_SURNAME})?(?: (?:{_GIVEN}|[A-ZА-ЯЁ]\.|{_SURNAME}(?<=вич|вна|чна)))* (?P<family>{_SURNAME})|(?:{_BEFORE}):? (?P<after>{_FULL})|(?P<before>{_FULL})(?= (?:{_SPEAKS})(?!\w)))(?!\w)",
}
_PLAIN_PHONE = re.compile(r"\+\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?\d{3}[ .-]?\d{3,4}|\d{2,4}(?:[ .-]?\d{2,4}){1,4})(?!\w|\.\d)")
_ALL = re.compile("|".join(f"(?P<k_{k}>{p})" for k, p in PATTERNS.items()))
#: Entities are looked for around these only: digits and @, words before secrets, titles and known names.
_DIGITS = re.compile(r"[\d@](?:[\d ().+@-]*[\d@])?")
_KEYWORDS = ("key", "secret", "token", "passw", "auth")
_KEYWORD = re.compile(rf"""(?i:{'|'.join(_KEYWORDS)})\w*["']?\s*[:=]\s*["']?\S*""")
_CONTEXT = re.compile(rf"(?<!\w)(?:(?:{_BEFORE})|(?:{_SPEAKS})(?!\w))")
_CAPITAL = re.compile(r"\b[A-ZÀ-ÖØ-ÞА-ЯЁ][^\W\d_]+")
_NAME = re.compile(_CAP)
_KNOWN = frozenset([*_GENDER, *_TITLES])
_AROUND = 90


def regions(text: str) -> Iterator[tuple[int, int]]:
    """Parts of a text outside of which no entity can lie; they begin and end at white space."""
    at = [m.span() for m in _DIGITS.finditer(text)]
    low = text.lower()
    if any(k in low for k in _KEYWORDS):
        at += [m.span() for m in _KEYWORD.finditer(text)]  # in the text itself: small letters can differ in length
    at += [m.span() for m in _CAPITAL.finditer(text) if m[0] in _KNOWN]
    at += [m.span() for m in _CONTEXT.finditer(text)]
    lo = hi = -1
    for start, end in sorted(at):
        if start > hi:
            if hi >= 0:
                yield lo, hi
            lo, hi = _edge(text, start - _AROUND, -1), -1
        hi = max(hi, _edge(text, end + _AROUND, 1))
    if hi >= 0:
        yield lo, hi


def _edge(text: str, at: int, step: int) -> int:
    while 0 < at < len(text) and not text[at].isspace():
        at += step
    return min(max(at, 0), len(text))


def phone_end(text: str, start: int, end: int) -> int:
    """Where the number that begins at ``start`` ends, without numbers that follow it; ``start`` if there is none."""
    abroad, national = text[start] == "+", text[start : start + 2].lstrip("(")[0] == "0"
    if not abroad and not national:
        return end
    most, least = 15 if abroad or text.startswith("00", start) else 12, 7 if abroad else 9
    if abroad:
        digits = re.sub(r"\D", "", text[start:end])
        most = next((_DIGITS_OF[c] for c in (digits[:1], digits[:2]) if c in _DIGITS_OF), most)
    count, best = 0, start
    for m in re.finditer(r"\d+\)?", text[start:end]):
        count += len(m[0].rstrip(")")) if m[0] != "0)" else 0  # (0) is the prefix of calls within the country
        if count > most:
            break
        at = start + m.end()
        if count >= least and not re.match(r"\w|\.\d", text[at : at + 2]):
            best = at
    plain = _PLAIN_PHONE.match(text, start) if abroad else None
    if national and best == start and re.fullmatch(r"\(\d{3,4}\)[ .-]?\d{3}[ .-]?\d{3,4}", text[start:end]):
        return end
    return max(best, plain.end() if plain else start)


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def _mod97(iban: str) -> int:
    return int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97


def mod97(iban: str) -> bool:
    """Check digits go from 02 to 98, so that each account has one."""
    return "02" <= iban[2:4] <= "98" and _mod97(iban) == 1


class Alphabet:
    """The values of one place, in a fixed order."""

    def __init__(self, values):
        self.values = list(values)
        self.index = {v: i for i, v in enumerate(self.values)}
        self.name = f"{len(self.values)}:{self.values[0]}"


def _spread(lo: int, n: int) -> str:
    return "".join(chr(lo + i) for i in range(n))


_DIGIT, _AREA_DIGIT = Alphabet("0123456789"), Alphabet("23456789")
_LETTERS = [Alphabet(x) for x in (_spread(97, 26), _spread(65, 26), _spread(0x430, 32), _spread(0x410, 32), _spread(0x3B1, 17), _spread(0x391, 17), _spread(0x4E00, 0x5000), _spread(0xAC00, 11172), _spread(0x3041, 86), _spread(0x30A1, 90), _spread(0x5D0, 27), _spread(0x621, 26))]
_LETTER = {c: x for x in reversed(_LETTERS) for c in x.values}
#: In names vowels stay vowels and consonants stay consonants, so that what comes out can be spoken.
_SOUNDS = [Alphabet(y) for x in ("aeiou", "bcdfghjklmnpqrstvwxyz", "àáâäèéêëìíîïòóôöùúûü", "çñ", "аеёиоуыэюя", "бвгджзклмнпрстфхцчшщ") for y in (x, x.upper())]
_SOUND = {c: x for x in _SOUNDS for c in x.values}
_OCTETS = {"first": [Alphabet(map(str, r)) for r in (range(1, 10), range(10, 100), range(100, 224), range(224, 256))], "other": [Alphabet(map(str, r)) for r in (range(10), range(10, 100), range(100, 256))]}
_SSN = [(Alphabet(f"{k:03}" for k in range(1, 1000) if k != 666), Alphabet(["000", "666"])), (Alphabet(f"{k:02}" for k in range(1, 100)), Alphabet(["00"])), (Alphabet(f"{k:04}" for k in range(1, 10_000)), Alphabet(["0000"]))]
#: None of them ends in another, so a name has one at most; it shows the gender and stays, and what stands before it is replaced alike for all of a family.
_ENDING = re.compile(r"(?<=\w\w)(?:ский|ская|ович|евич|овна|евна|ова|ева|ина|ов|ев|ин|ski|ska|cki|cka|dzki|dzka|ová|sdóttir|sson)$")


def _form(char: str) -> Alphabet | None:
    """The class that a character is replaced within; None: it stays."""
    return _DIGIT if char in _DIGIT.index else _LETTER.get(char)


class Permutation:
    """A keyed order of all values of a form (an alphabet for each place) and in it the value after each.

    The place of a value in the order comes from Feistel rounds over its
    mixed-radix number, and they are undone for the next place.  One place
    alone has its values sorted by a keyed hash.
    """

    def __init__(self, key: bytes, kind: str, form: tuple[Alphabet, ...]):
        self.key = hashlib.blake2b(repr((kind, [a.name for a in form])).encode(), key=key[:64], digest_size=32).digest()
        self.form = form
        sizes = [len(a.values) for a in form]
        half = next((k for k in range(1, len(sizes)) if prod(sizes[:k]) ** 2 >= prod(sizes)), len(sizes) - 1)
        self.left, self.right = prod(sizes[:half]), prod(sizes[half:])
        self.order = None
        if min(self.left, self.right) == 1:
            self.order = sorted(range(self.left * self.right), key=lambda k: self._round(0, k))
            self.place = {k: i for i, k in enumerate(self.order)}

    def _round(self, i: int, half: int) -> int:
        return int.from_bytes(hashlib.blake2b(half.to_bytes((half.bit_length() + 8) // 8, "big"), key=self.key, salt=bytes([i]), digest_size=32).digest(), "big")

    def _after(self, number: int) -> int:
        if self.order is not None:
            return self.order[(self.place[number] + 1) % len(self.order)]
        a, b = divmod(number, self.right)
        for i in range(8):
            if i % 2:
                b = (b + self._round(i, a)) % self.right
            else:
                a = (a + self._round(i, b)) % self.left
        a, b = divmod((a * self.right + b + 1) % (self.left * self.right), self.right)
        for i in reversed(range(8)):
            if i % 2:
                b = (b - self._round(i, a)) % self.right
            else:
                a = (a - self._round(i, b)) % self.left
        return a * self.right + b

    def __call__(self, values: Sequence[str]) -> list[str]:
        number, out = 0, []
        for v, a in zip(values, self.form, strict=True):
            number = number * len(a.values) + a.index[v]
        number = self._after(number)
        for a in reversed(self.form):
            number, d = divmod(number, len(a.values))
            out.append(a.values[d])
        return out[::-1]


class Surrogates:
    """Finds entities and replaces them; ``key`` decides all replacements."""

    def __init__(self, key: bytes):
        self.key = key
        self.known: dict[tuple[str, str], str] = {}
        self.orders: dict[tuple, Permutation] = {}
        self.turned: dict[str, str] = {}

    def _moved(self, kind: str, values: Sequence[str], forms: Sequence[Alphabet | None]) -> list[str]:
        """The values after these; those without an alphabet stay."""
        form = tuple(f for f in forms if f)
        if not form:
            return list(values)
        if (move := self.orders.get((kind, form))) is None:
            if len(self.orders) >= 4096:
                self.orders.clear()
            move = self.orders[kind, form] = Permutation(self.key, kind, form)
        rest = iter(move([v for v, f in zip(values, forms, strict=True) if f]))
        return [next(rest) if f else v for v, f in zip(values, forms, strict=True)]

    def _text(self, kind: str, text: str, fixed: int = 0) -> str:
        """Letters and digits of ``text`` after the first ``fixed`` characters, moved within their classes."""
        return "".join(self._moved(kind, text, [_form(c) if i >= fixed else None for i, c in enumerate(text)]))

    def _name(self, word: str, gender: str = "") -> str:
        if names := _LISTED.get(word):
            if word not in self.turned:
                order = sorted(names, key=lambda n: hmac.new(self.key, f"{_GENDER[n]}{n}".encode(), "sha256").digest())
                self.turned |= zip(order, order[1:] + order[:1], strict=True)  # one cycle: never itself, never shared
            return self.turned[word]
        ending = m[0] if (m := _ENDING.search(word)) else ""
        stem = word[: len(word) - len(ending)]
        while True:  # over names whose places belong to others: given names and, without an ending, names with one; the cycle leads back to this one at last
            stem = "".join(self._moved("name", stem, [_SOUND.get(c) or _LETTER.get(c) for c in stem]))
            if stem + ending not in _LISTED and (ending or not _ENDING.search(stem)):
                return stem + ending

    def replace(self, kind: str, text: str, gender: str = "") -> str:
        if (got := self.known.get((kind + gender, text))) is not None:
            return got
        if kind == "email":
            local, _, domain = text.rpartition("@")
            stem, _, top = domain.rpartition(".")
            new = f"{self._text('email', local)}@{self._text('domain', stem)}.{top}"  # a domain is replaced alike in all addresses
        elif kind == "ip":
            octets = text.split(".")
            forms = [next((a for a in _OCTETS["other" if k else "first"] if v in a.index), None) for k, v in enumerate(octets)]
            new = ".".join(self._moved("ip", octets, forms))
        elif kind == "ssn":
            parts = text.split("-")
            new = "-".join(self._moved("ssn", parts, [next(a for a in both if v in a.index) for v, both in zip(parts, _SSN, strict=True)]))
        elif kind == "card":
            *most, last = (i for i, c in enumerate(text) if c.isdigit())
            new = self._text("card", text[:last], fixed=1)
            new += next(d for d in "0123456789" if luhn(re.sub(r"\D", "", new) + d)) + text[last + 1 :]
        elif kind == "iban":
            new = self._text("iban", text, fixed=4)
            new = f"{new[:2]}{98 - _mod97(re.sub(' ', '', f'{new[:2]}00{new[4:]}')):02}{new[4:]}"
        elif kind == "phone":
            fixed = len(re.match(r"\+\d{0,3}|", text)[0])
            digits = [i for i, c in enumerate(text) if c.isdigit() and i >= fixed]
            first = next((i for i in digits if text[i] != "0"), len(text))  # zeros before it are the prefix
            forms = [None if i < first else _AREA_DIGIT if i == first and c in _AREA_DIGIT.index else None if i == first else _form(c) for i, c in enumerate(text)]
            new = "".join(self._moved("phone", text, forms))
        elif kind == "person":
            new = " ".join(self._name(w) for w in text.split(" "))
        else:
            new = self._text(kind, text)
        if len(self.known) < 1 << 16:
            self.known[kind + gender, text] = new
        return new

    def find(self, text: str) -> list[tuple[int, int, str, str]]:
        """(start, end, kind, gender) of the entities, in text order."""
        out, at = [], 0
        for lo, hi in regions(text):
            at = max(at, lo)
            while at < hi and (m := _ALL.search(text, at, hi)):
                if m.end() == hi < len(text):
                    m = _ALL.match(text, m.start()) or m  # it may go on beyond the region
                kind = next(k for k in PATTERNS if m[f"k_{k}"] is not None)
                start, end, gender, at = *m.span(), "", m.end()
                if kind == "secret":
                    start, end = m.span("secret")
                elif kind == "card":
                    digits = re.sub(r"\D", "", m[0])
                    if not luhn(digits) or len(set(digits)) < 3:
                        continue
                elif kind == "iban" and not mod97(m[0].replace(" ", "")):
                    continue
                elif kind == "phone":
                    end = at = phone_end(text, start, end)
                    if end == start:
                        at = start + 1
                        continue
                elif kind == "person":
                    if m["title"]:
                        start, end = m.span("titled")
                        gender = _TITLES[m["title"]] or self._gender(m["titled"].split(" ")[0])
                    elif own := next((x for x in ("after", "before") if m[x]), ""):
                        start, end = m.span(own)
                        if own == "before" and _ARTICLE.search(text[max(0, start - 6) : start]):  # a house, not a person
                            continue
                        gender = self._gender(text[start:end].split(" ")[0])
                    else:
                        gender = self._gender(m["given"])
                    if text[end - 2 : end] in ("'s", "’s"):
                        end -= 2
                out.append((start, end, kind, gender))
        return self._mentions(text, out)

    @staticmethod
    def _mentions(text: str, found: list[tuple[int, int, str, str]]) -> list[tuple[int, int, str, str]]:
        """With the other places at which a name of a person found in the text stands alone."""
        names: dict[str, str] = {}
        for start, end, kind, gender in found:
            if kind == "person":
                for word in text[start:end].split(" "):
                    if len(word) > 1 and word[-1] != ".":
                        names.setdefault(word, gender)
        if not names:
            return found
        more, ends, k = [], [(s, e) for s, e, _, _ in found], 0
        for m in _NAME.finditer(text):
            start, end = m.span()
            while k < len(ends) and ends[k][1] <= start:
                k += 1
            if (k < len(ends) and ends[k][0] < end) or re.match(r"[\w@]", text[max(0, start - 1) : start]) or re.match(r"[\w@]", text[end : end + 1]):
                continue
            if m[0] in names:
                more.append((start, end, "person", names[m[0]]))
            else:
                for part in re.finditer(r"[^-'’]+", m[0]):
                    if part[0] in names:
                        more.append((start + part.start(), start + part.end(), "person", names[part[0]]))
        return sorted([*found, *more])

    @staticmethod
    def _gender(word: str) -> str:
        return _GENDER.get(word.split("-")[0], "")


def surrogate_text(docs: DataFrame, key: bytes, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each row of ``docs``: doc_id, text with surrogates, entities.

    entities: array of (start, length, kind, gender, surrogate, entity), places
    in code points of the original text; ``entity`` is a keyed digest of the
    original, equal for equal entities.  A null text stays null and has none;
    repeated rows give equal results; an empty table gives no rows.  Other
    columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = Surrogates(key)
        for batch in batches:
            texts, found = [], []
            for value in batch.column(0).to_pylist():
                spans = made.find(value) if value else []
                out, at, rows = [], 0, []
                for start, end, kind, gender in spans:
                    old = value[start:end]
                    new = made.replace(kind, old, gender)
                    out += [value[at:start], new]
                    at = end
                    name = hmac.new(key, f"{kind}\x1f{old}".encode(), "sha256").hexdigest()[:16]
                    rows.append({"start": start, "length": end - start, "kind": kind, "gender": gender, "surrogate": new, "entity": name})
                texts.append("".join([*out, value[at:]]) if spans else value)
                found.append(rows)
            kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), *[(c, pa.string()) for c in ("kind", "gender", "surrogate", "entity")]]))
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(texts, pa.string()), pa.array(found, kind)], ["doc_id", "text", "entities"])

    small_batches(docs.sparkSession)
    rows = docs.select(F.col(text).cast("string").alias("text"), F.col(doc_id).alias("doc_id"))
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, text string, entities array<struct<start:bigint,length:bigint,kind:string,gender:string,surrogate:string,entity:string>>")


def with_collisions(replaced: DataFrame) -> DataFrame:
    """A row for each entity of the rows that ``surrogate_text`` returns: doc_id, the entity's fields, and ``collides``.

    collides: whether another entity of the kind has the same surrogate, or the
    entity another surrogate elsewhere: never, if all is well.  What is joined
    back are the colliding values alone; values that stand in very many rows
    are aggregated before they are shuffled.
    """
    rows = cut(replaced.select("doc_id", F.explode("entities").alias("e")).select("doc_id", "e.*"), "surrogates")
    both = None
    for own, other in (("surrogate", "entity"), ("entity", "surrogate")):
        found = rows.groupBy("kind", F.col(own).alias("value")).agg(F.min(other).alias("a"), F.max(other).alias("b")).where("a <> b").select(F.col("kind").alias("_kind"), F.lit(own).alias("_of"), F.col("value").alias("_value"))
        both = found if both is None else both.union(found)
    both = cut(both, "surrogate-collisions")
    if both.isEmpty():
        return rows.withColumn("collides", F.lit(False))
    for own in ("surrogate", "entity"):
        bad = both.where(F.col("_of") == own).select("_kind", F.col("_value").alias(f"_{own}"))
        rows = rows.join(bad, (F.col("kind") == F.col("_kind")) & (F.col(own) == F.col(f"_{own}")), "left").drop("_kind")
    return rows.withColumn("collides", F.col("_surrogate").isNotNull() | F.col("_entity").isNotNull()).drop("_surrogate", "_entity")


def collisions(replaced: DataFrame) -> DataFrame:
    """The rows of ``with_collisions`` that collide."""
    return with_collisions(replaced).where("collides")
