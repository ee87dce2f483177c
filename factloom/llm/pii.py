"""Surrogates for personal data.

Detected entities (e-mail, IPv4 and IPv6 addresses, phone numbers, payment cards, social security numbers, IBANs, and persons named
after a title or an introduction) are replaced by surrogates of the same type, script and format:

* Numbers and addresses keep their shape: punctuation, case, length, country codes, top-level domains. Their free characters
  are one number in a mixed radix, which a keyed Feistel network with cycle walking permutes. A permutation gives
  different surrogates to different entities of one shape, and shapes are kept, so distinctness holds without
  a table. Check digits (cards, IBANs) are computed anew.
* Names are built from syllables or characters of their script (Latin, Greek, Cyrillic, Han), with endings of the given name's gender.
  Surnames and given names are entities of their own, so that `Mr Smith` and `John Smith` keep referring to one person. Gender is no part of
  an entity: it is told once for each given name, by a vote of its titles over the corpus, else by the list of names.

Persons are found after titles, after phrases (`my name is`), after labels and closings whose line ends with the name, and by given names of a list that the caller
can extend (`names`), alone or before a surname; in upper case after titles. Once found, a person's given name and surname are replaced wherever the text has
them, also in upper case. Only a title is a sure cue: a word that was found by others isn't a name if as many documents have it in lower case, as a word, as have it as such a
name (`common_words`, two passes that combine in tasks). Names without any of these cues aren't found. Phone numbers are one entity with and without the
country code, if ten digits follow it; those of seven digits need a word like `call` in front.

The key alone decides a surrogate, so an entity has the same one in every document (coreference). Collisions are checked over
the corpus and over all kinds: a surrogate that another entity has drawn, or that is itself an entity of the corpus, is drawn anew, with
the attempt as part of the key, until none is left; a mail address that keeps colliding gets a longer name, as all of its shape may be taken. Only the attempts of such redrawn entities, and genders that the list doesn't tell, have
to travel; they go with the function while there are at most `most_exceptions`, else they are joined to the texts that hold them.

Defined results: text without an entity is returned as it is. A null text stays null, with 0 entities; repeated rows get equal results;
texts of any length are scanned whole; of overlapping finds, the first, then the longest counts; an empty table gives no rows. Other columns
are returned as they are, but for one that has the name of the count, which is replaced.
"""

from __future__ import annotations

import hmac
import ipaddress
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factloom.functions.names import unused
from factloom.llm.common import cut, join_hot

KINDS = ("email", "phone", "ipv4", "ipv6", "card", "ssn", "iban", "given", "surname")


@dataclass(frozen=True)
class Surrogates:
    key: bytes = b"replace this key in production"
    most_exceptions: int = 50_000
    most_common: int = 500_000  # words that weak cues found and that aren't names; they travel with the functions
    rounds: int = 30
    names: tuple = ()  # more given names, as (name, f, m or n)


# ---------------------------------------------------------------- detection

_EMAIL = re.compile(r"(?<![\w.%+-])[\w%+-](?:[\w.%+-]*[\w%+-])?@[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?(?:\.[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?)*\.[A-Za-z]{2,}(?![A-Za-z0-9-])")
_DIGITS = re.compile(r"[0-9][0-9. ()-]{4}")
_NUMBER = re.compile(
    r"(?P<ipv4>(?<![\w.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?!\.?\w))"
    r"|(?P<ssn>(?<![\w-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![\w-]))"
    r"|(?P<phone>(?<![\w+])(?:\+[0-9]{1,3}[ .-]?)?(?:\([0-9]{2,4}\)[ .-]?|[0-9]{2,4}[ .-])[0-9]{3}[ .-][0-9]{4}(?!\w)"
    r"|(?<![\w+])\+[0-9]{1,3}(?:[ .-]?\(?[0-9]{1,4}\)?){2,6}(?!\w)|(?<![\w+])\+[0-9]{8,15}(?!\w)"
    r"|(?<![\w.+-])0[0-9](?:[ .-][0-9]{2}){4}(?![ .-]?[0-9])(?!\w)|(?<![\w.+-])0[0-9]{2,4}[ /-][0-9]{5,8}(?![ .-]?[0-9])(?!\w)"
    r"|(?:(?<=[Pp]hone )|(?<=[Pp]hone: )|(?<=[Tt]el )|(?<=[Tt]el: )|(?<=[Tt]el\. )|(?<=[Cc]all )|(?<=[Mm]obile )|(?<=[Mm]obile: )|(?<=[Ff]ax )|(?<=[Ff]ax: ))(?:[0-9]{8,12}|[0-9]{3}[ .-][0-9]{4})(?!\w))"
    r"|(?P<card>(?<![\w.])(?:[0-9]{13,19}|[0-9]{4}(?P<gap>[ -])[0-9]{4}(?P=gap)[0-9]{4}(?P=gap)[0-9]{4}|[0-9]{4}[ -][0-9]{6}[ -][0-9]{5})(?!\w))"
)
_IPV6 = re.compile(r"(?<![\w:.])(?:[0-9A-Fa-f]{0,4}:){2,7}[0-9A-Fa-f]{0,4}(?![\w:])")
_IBAN = re.compile(r"(?<!\w)[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?!\w)")
_IBAN_HINT = re.compile(r"(?<!\w)[A-Z]{2}[0-9]{2}")
#: Titles by the gender that they tell: f, m or n (not told).
TITLES = {
    "Mr": "m", "Mrs": "f", "Ms": "f", "Miss": "f", "Sir": "m", "Dr": "n", "Prof": "n", "Mme": "f", "Mlle": "f", "Monsieur": "m",
    "Madame": "f", "Herr": "m", "Herrn": "m", "Frau": "f", "Señor": "m", "Señora": "f", "Señorita": "f", "Sra": "f", "Sr": "m",
    "г-н": "m", "г-жа": "f", "господин": "m", "госпожа": "f", "κύριος": "m", "κυρία": "f", "Κύριος": "m", "Κυρία": "f",
}
#: Titles that follow a Han name.
HAN_TITLES = {"先生": "m", "女士": "f", "小姐": "f"}
#: What a name follows: in a sentence; as a label, in its line; as a closing, in its line or the next one.
PHRASES = ("my name is", "je m'appelle", "ich heiße", "mein Name ist", "me llamo", "mi nombre es", "меня зовут", "με λένε")
LABELS = ("Contact:", "Name:", "Patient:", "Author:", "Customer:", "Employee:", "Signed:", "Signed by")
CLOSINGS = ("Sincerely,", "Kind regards,", "Best regards,")
HAN_INTRODUCTIONS = ("我叫", "我的名字是")
_INTRODUCTIONS_LOW = tuple(t.lower() for t in (*PHRASES, *LABELS, *CLOSINGS))
#: Given names whose gender is told by themselves.
GIVEN = {
    "f": "Anna Maria Mary Patricia Jennifer Linda Elizabeth Susan Jessica Sarah Karen Emma Sophie Marie Claire Camille Laura Lucía Carmen Julia Lena Monika Priya Fatima Aisha Анна Мария Елена Ольга Μαρία Ελένη".split(),
    "m": "John James Robert Michael William David Richard Thomas Peter Paul Hans Jürgen Klaus Stefan Pierre Jean Louis Antoine Carlos José Juan Miguel Mohammed Rahul Иван Пётр Сергей Дмитрий Γιώργος Νίκος".split(),
}
#: Common Han surnames, and characters that given names are made of.
HAN_SURNAMES = "赵钱孙李周吴郑王冯陈卫蒋沈韩杨朱秦许何吕施张孔曹严华金魏陶姜谢邹章苏潘葛范彭鲁韦马方任袁柳史唐薛雷贺汤罗郝安常于傅康顾孟黄萧尹姚邵汪毛戴宋熊纪董梁杜阮蓝季贾江童颜郭梅林钟徐高夏蔡田胡万管卢丁邓洪石崔程陆刘黎"
_HAN_GIVEN = {"f": "芳娜敏静秀娟英慧巧美淑惠珠翠雅芝玉萍红", "m": "伟刚勇毅俊峰强军平保东文辉力明永健世广", "n": "晨宁清安和思远新然同知乐"}
_UP, _LOW = "A-ZÀ-ÖØ-ÞŁŚŻŠŽČĐΑ-ΩΆΈΉΊΌΎΏА-ЯЁІЇЄ", "a-zß-öø-ÿĀ-ſα-ωάέήίόύώϊϋΐΰа-яёіїє"
_ONE = rf"(?:[{_UP}]['’])?[{_UP}][{_LOW}]+(?:[-'’][{_UP}][{_LOW}]+)*"
_PART = rf"(?:{_ONE}|(?:[{_UP}]['’])?[{_UP}]{{2,}}(?:[-'’][{_UP}]{{2,}})*)"
_ALL_TITLES = {**TITLES, **{t.upper(): g for t, g in TITLES.items()}}
_TITLED = re.compile(rf"(?<!\w)({'|'.join(sorted(_ALL_TITLES, key=len, reverse=True))})\.? ({_PART})(?: ({_PART}))?(?!\w)")
_ANY = lambda words: "|".join(map(re.escape, words))
_INTRODUCED = re.compile(
    rf"(?<!\w)(?:(?i:{_ANY(PHRASES)})[ \t]+({_ONE})(?: ({_ONE}))?(?!\w)"
    rf"|(?:(?i:{_ANY(LABELS)})[ \t]+|(?i:{_ANY(CLOSINGS)})[ \t]*\r?\n?[ \t]*)({_ONE})(?: ({_ONE}))?(?=[ \t]*(?:[\r\n,;(|<]|\Z)))"
)
_LOW_WORD = re.compile(rf"(?<!\w)[{_LOW}]+(?:[-'’][{_LOW}]+)*(?!\w)")
_HAN = re.compile(rf"(?:(?:{'|'.join(HAN_INTRODUCTIONS)})([{HAN_SURNAMES}])([一-龥]{{1,2}})(?![一-龥])|([{HAN_SURNAMES}])([一-龥]{{0,2}}?)({'|'.join(HAN_TITLES)}))")


@lru_cache(maxsize=8)
def _listed(names: tuple) -> tuple[dict, tuple, re.Pattern]:
    """Genders by lower-case name, the names, and the pattern of a listed given name, alone or before another name."""
    all_names = [(n, g) for g, own in GIVEN.items() for n in own] + list(names)
    shown = sorted({n for n, _ in all_names}, key=lambda n: (-len(n), n))
    return {n.lower(): g for n, g in all_names}, tuple(shown), re.compile(rf"(?<!\w)({'|'.join(map(re.escape, shown))})(?: ({_ONE}))?(?!\w)")


def _script(name: str) -> str:
    if re.search("[一-龥]", name):
        return "han"
    return "cyrillic" if re.search("[а-яёіїє]", name) else "greek" if re.search("[α-ωάέήίόύώ]", name) else "latin"


def _luhn(digits: str) -> int:
    """The Luhn sum's last digit; 0 for a valid number."""
    return sum(int(d) if i % 2 == 0 else sum(divmod(2 * int(d), 10)) for i, d in enumerate(reversed(digits))) % 10


def _mod97(iban: str) -> int:
    return int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97


def _phone(shown: str) -> str:
    digits = re.sub("[^0-9]", "", shown)
    # With a country code and ten digits, the ten are the number, as they are where the code isn't written.
    return digits[-10:] if shown[0] == "+" and 11 <= len(digits) <= 13 else ("+" if shown[0] == "+" else "") + digits


def detect(text: str, names: tuple = (), common: frozenset = frozenset()) -> list[tuple[int, int, str, str, str]]:
    """(start, end, kind, canonical, gender) without overlaps, by start. gender: what is told of a given name here. common: words that aren't names unless a title tells so."""
    found: list[tuple[int, int, str, str, str]] = []
    if "@" in text:
        found += [(m.start(), m.end(), "email", m[0].lower(), "n") for m in _EMAIL.finditer(text)]
    if _DIGITS.search(text):
        for m in _NUMBER.finditer(text):
            kind, s = next(k for k in ("ipv4", "ssn", "phone", "card") if m[k]), m[0]
            if kind == "ipv4" and any(int(x) > 255 or len(x) > 1 and x[0] == "0" for x in s.split(".")):
                continue
            if kind == "card" and (_luhn(re.sub("[ -]", "", s)) or len(set(s)) < 3):
                continue
            if kind == "phone" and not 7 <= sum(c.isdigit() for c in s) <= 15:
                continue
            found.append((m.start(), m.end(), kind, s if kind == "ipv4" else _phone(s) if kind == "phone" else re.sub("[^0-9]", "", s), "n"))
    if text.count(":") > 1:
        for m in _IPV6.finditer(text):
            try:
                if sum(c.isalnum() for c in m[0]) > 3:
                    found.append((m.start(), m.end(), "ipv6", ipaddress.IPv6Address(m[0]).exploded, "n"))
            except ValueError:
                continue
    if _IBAN_HINT.search(text):
        for m in _IBAN.finditer(text):
            plain = m[0].replace(" ", "")
            if 15 <= len(plain) <= 34 and _mod97(plain) == 1:
                found.append((m.start(), m.end(), "iban", plain, "n"))
    found += _people(text, names, common)
    found.sort(key=lambda x: (x[0], -x[1], x[2]))
    out, end = [], -1
    for x in found:
        if x[0] >= end:
            out.append(x)
            end = x[1]
    return out


def _weak(text: str, names: tuple) -> list[tuple[re.Match, int, str]]:
    """Finds of persons by cues other than titles: (match, group of the given name, gender)."""
    genders, shown, known = _listed(names)
    found: list[tuple[re.Match, int, str]] = []
    low = text.lower()
    if any(t in low for t in _INTRODUCTIONS_LOW):
        found += [(m, 1 if m[1] else 3, "n") for m in _INTRODUCED.finditer(text)]
    if any(t in text for t in shown):
        found += [(m, 1, genders[m[1].lower()]) for m in known.finditer(text)]
    return found


def _people(text: str, names: tuple, common: frozenset) -> list[tuple[int, int, str, str, str]]:
    people: list[tuple[int, int, str, str, str]] = []
    if any(t in text for t in _ALL_TITLES):
        for m in _TITLED.finditer(text):
            people += _person(m, 2, _ALL_TITLES[m[1]], m[3] is None)
    for m, at, gender in _weak(text, names):
        person = _person(m, at, gender, False)
        if person[0][3] not in common:
            people += [p for p in person if p[3] not in common]
    han = _han(text) if any(t in text for t in (*HAN_TITLES, *HAN_INTRODUCTIONS)) else []
    if people:
        # Later mentions of a person by either name alone, also in upper case, refer to the same person.
        later = sorted({(text[a:b], kind, canonical) for a, b, kind, canonical, _ in people}, key=lambda x: (x[0], x[1] != "surname"))
        by_name = {}
        for name, kind, canonical in later:
            by_name.setdefault(name, (kind, canonical))
        for name, kind, canonical in later:
            if len(name) > 1:
                by_name.setdefault(name.upper(), (kind, canonical))
        pattern = re.compile(rf"(?<!\w)(?:{'|'.join(map(re.escape, sorted(by_name, key=len, reverse=True)))})(?!\w)")
        at = {p[0] for p in people}
        people += [(m.start(), m.end(), *by_name[m[0]], "n") for m in pattern.finditer(text) if m.start() not in at]
    return people + han


def _person(m: re.Match, at: int, gender: str, surname_only: bool) -> list[tuple[int, int, str, str, str]]:
    """A given name, and a surname if there is one; a single name after a title is a surname."""
    parts = [(m.start(k), m.end(k), m[k].lower().replace("’", "'")) for k in (at, at + 1) if k <= m.re.groups and m[k] is not None]
    return [(a, b, "given", name, gender) if i == 0 and not surname_only else (a, b, "surname", name, "n") for i, (a, b, name) in enumerate(parts)]


def _han(text: str) -> list[tuple[int, int, str, str, str]]:
    """Surname and given name, which aren't parted by a space; whole names count again wherever they stand."""
    out, whole = [], {}
    for m in _HAN.finditer(text):
        k = 1 if m[1] else 3
        out.append((m.start(k), m.end(k), "surname", m[k], "n"))
        if m[k + 1]:
            out.append((m.start(k + 1), m.end(k + 1), "given", m[k + 1], HAN_TITLES.get(m[5], "n")))
            whole[m[k] + m[k + 1]] = (m[k], m[k + 1])
    at = {x[0] for x in out}
    for name, (surname, given) in sorted(whole.items()):
        for m in re.finditer(name, text):
            if m.start() not in at:
                out += [(m.start(), m.start() + 1, "surname", surname, "n"), (m.start() + 1, m.end(), "given", given, "n")]
    return out


# ---------------------------------------------------------------- surrogates


def _number(key: bytes, *parts: str) -> int:
    return int.from_bytes(hmac.digest(key, "\x1f".join(parts).encode(), "sha256"), "big")


def permute(value: int, size: int, key: bytes, label: str) -> int:
    """A keyed permutation of range(size): a balanced Feistel network, walked until it lands inside."""
    if size < 2:
        return value
    half = max(1, ((size - 1).bit_length() + 1) // 2)
    mask = (1 << half) - 1
    while True:
        left, right = value >> half, value & mask
        for r in range(6):
            left, right = right, left ^ (_number(key, label, str(r), str(right)) & mask)
        value = left << half | right
        if value < size:
            return value


#: Classes of characters that are replaced within their class; all others stay.
_ALPHABETS = ("0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "àáâãäåæçèéêëìíîïñòóôõöøùúûüýÿß", "абвгдежзийклмнопрстуфхцчшщъыьэюя", "αβγδεζηθικλμνξοπρστυφχψω")
_ALPHABET_OF = {c: a for a in _ALPHABETS for c in a}


def reshape(text: str, key: bytes, label: str) -> str:
    """Replace letters and digits by others of their class: one permutation for each shape."""
    alphabets = [_ALPHABET_OF.get(c) for c in text]
    value, size = 0, 1
    for c, a in zip(text, alphabets):
        if a:
            value, size = value * len(a) + a.index(c), size * len(a)
    shape = "".join(c if a is None else a[0] for c, a in zip(text, alphabets))
    value = permute(value, size, key, f"{label}:{shape}")
    out = []
    for c, a in zip(reversed(text), reversed(alphabets)):
        if a:
            value, k = divmod(value, len(a))
            c = a[k]
        out.append(c)
    return "".join(reversed(out))


# Syllables and endings that names are built from.
_SYLLABLES = {
    "latin": ["ba", "be", "bo", "da", "de", "do", "fa", "fe", "ga", "ha", "ja", "jo", "ka", "ke", "la", "le", "li", "lo", "ma", "me", "mi", "na", "ne", "ni", "no", "pa", "pe", "ra", "re", "ri", "ro", "sa", "se", "ta", "te", "ti", "to", "va", "ve", "vi"],
    "greek": ["βα", "γε", "δα", "δη", "ζω", "θε", "κα", "κο", "λα", "λε", "μα", "με", "νι", "νο", "πα", "πε", "ρα", "ρι", "σα", "σε", "τα", "τη", "φα", "φι"],
    "cyrillic": ["ба", "бе", "во", "ва", "га", "да", "де", "до", "жа", "за", "ка", "ко", "ла", "ле", "ли", "ло", "ма", "ме", "ми", "на", "не", "ни", "но", "па", "по", "ра", "ре", "ри", "ро", "са", "се", "та", "те", "ти", "то", "фа"],
}
_ENDINGS = {
    ("given", "latin", "f"): ["na", "lia", "ra", "tine"], ("given", "latin", "m"): ["ton", "rick", "las", "ner"], ("given", "latin", "n"): ["ri", "lyn", "my", "ry"],
    ("given", "cyrillic", "f"): ["на", "лия", "рина"], ("given", "cyrillic", "m"): ["мир", "слав", "дан"], ("given", "cyrillic", "n"): ["ша", "ня"],
    ("given", "greek", "f"): ["να", "λία", "ρα"], ("given", "greek", "m"): ["νος", "ρης", "λος"], ("given", "greek", "n"): ["ρι", "λι"],
    ("surname", "greek", "n"): ["άκης", "ίδης", "πουλος"],
    ("surname", "latin", "n"): ["son", "mann", "well", "berg", "rez", "let", "ford", "ster"], ("surname", "cyrillic", "n"): ["енко", "ук", "ко", "ич"],
}


def _name(kind: str, canonical: str, gender: str, key: bytes, attempt: int) -> str:
    script = _script(canonical)
    n = _number(key, kind, canonical, str(attempt))
    if script == "han":
        letters = HAN_SURNAMES if kind == "surname" else _HAN_GIVEN[gender]
        out = ""
        for _ in range(len(canonical) + attempt // 4):
            n, k = divmod(n, len(letters))
            out += letters[k]
        return out
    syllables, endings = _SYLLABLES[script], _ENDINGS[kind, script, gender]
    out = ""
    for _ in range(2 + attempt // 4):  # more attempts draw from a larger space
        n, k = divmod(n, len(syllables))
        out += syllables[k]
    return (out + endings[n % len(endings)]).capitalize()


@lru_cache(maxsize=50_000)
def surrogate(kind: str, canonical: str, gender: str, key: bytes, attempt: int = 0) -> str:
    """The canonical form of an entity's surrogate; gender matters to given names only."""
    label = f"{kind}#{attempt}"
    if kind in ("given", "surname"):
        return _name(kind, canonical, gender, key, attempt)
    if kind == "email":
        local, domain = canonical.rsplit("@", 1)
        local += "a" * max(0, (attempt - 4) // 2)  # a larger space, for a shape of which all may be taken
        labels = domain.split(".")
        return reshape(f"{local}@{'.'.join(labels[:-1])}", key, f"{label}.{labels[-1]}") + "." + labels[-1]
    if kind == "ipv4":
        a, b, c, d = map(int, canonical.split("."))
        x = permute((a << 24) + (b << 16) + (c << 8) + d, 1 << 32, key, label)
        return ".".join(str(x >> s & 255) for s in (24, 16, 8, 0))
    if kind == "ipv6":
        return ipaddress.IPv6Address(permute(int(ipaddress.IPv6Address(canonical)), 1 << 128, key, label)).exploded
    if kind == "phone":
        code = re.match(r"\+[0-9]{1,3}(?=[0-9]{10}$)|\+[0-9]{1,2}|0|", canonical)[0]
        return code + reshape(canonical[len(code) :], key, label + code)
    if kind == "card":
        body = canonical[0] + reshape(canonical[1:-1], key, label + canonical[0])
        return body + str(-_luhn(body + "0") % 10)
    if kind == "iban":
        body = canonical[:2] + "00" + reshape(canonical[4:], key, label + canonical[:2])
        return f"{body[:2]}{98 - _mod97(body):02d}{body[4:]}"
    return reshape(canonical, key, label)


def formatted(shown: str, kind: str, new: str) -> str:
    """A canonical surrogate in the format in which the entity was written."""
    if kind == "ipv4":
        return new
    if kind == "ipv6":
        new = new if len(shown) == 39 else str(ipaddress.IPv6Address(new))
        return new.upper() if shown.isupper() else new
    if kind in ("given", "surname"):
        return new.upper() if shown.isupper() else new
    if kind == "email":  # of the same length: take the case of each letter
        return "".join(n.upper() if s.isupper() else n for s, n in zip(shown, new)) if len(shown) == len(new) else new
    if kind == "phone":  # a country code that is no part of the entity stays
        fresh, kept = iter(new.lstrip("+")), sum(c.isdigit() for c in shown) - sum(c.isdigit() for c in new)
        out = []
        for c in shown:
            if c.isdigit():
                c, kept = (c, kept - 1) if kept > 0 else (next(fresh), kept)
            out.append(c)
        return "".join(out)
    fresh = iter(new)
    return "".join(next(fresh) if c.isalnum() else c for c in shown)


def default_gender(kind: str, canonical: str, names: tuple) -> str:
    return _listed(names)[0].get(canonical, "n") if kind == "given" else "n"


def replace(text: str, conf: Surrogates, exceptions: dict, common: frozenset = frozenset()) -> tuple[str, int]:
    """exceptions: (kind, canonical) -> (gender, attempt) of entities that aren't drawn as the first attempt by the list's gender."""
    found = detect(text, conf.names, common)
    if not found:
        return text, 0
    out, at = [], 0
    for start, end, kind, canonical, _ in found:
        gender, attempt = exceptions.get((kind, canonical)) or (default_gender(kind, canonical, conf.names), 0)
        out += [text[at:start], formatted(text[start:end], kind, surrogate(kind, canonical, gender, conf.key, attempt))]
        at = end
    return "".join(out) + text[at:], len(found)


# ---------------------------------------------------------------- frames


def _counted(docs: DataFrame, words_of) -> DataFrame:
    """word, n: in how many documents words_of(text) has the word. Tasks count in tables that are written out when full."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()
        for b in batches:
            for t in b.column(0):
                if t.is_valid:
                    held.update(words_of(t.as_py()))
            if len(held) > 300_000:
                yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], names=["word", "n"])
                held.clear()
        yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], names=["word", "n"])

    return docs.mapInArrow(run, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


def common_words(docs: DataFrame, conf: Surrogates | None = None, text: str = "text") -> frozenset:
    """Words that cues other than titles take for names, but that as many documents have in lower case, as ordinary words."""
    conf = conf or Surrogates()
    texts = docs.select(text)
    found = cut(_counted(texts, lambda t: {p[3] for m, at, g in _weak(t, conf.names) for p in _person(m, at, g, False)}))
    n = found.count()
    if not n:
        return frozenset()
    if n <= conf.most_exceptions:
        asked = frozenset(r.word for r in found.select("word").collect())
        low = _counted(texts, lambda t: asked.intersection(_LOW_WORD.findall(t)))
    else:
        low = _counted(texts, lambda t: set(_LOW_WORD.findall(t)))
    told = found.join(low.withColumnRenamed("n", "low"), "word").where("low >= n").select("word").limit(conf.most_common + 1).collect()
    if len(told) > conf.most_common:
        raise ValueError(f"more than {conf.most_common} words that cues take for names aren't names")
    return frozenset(r.word for r in told)


def entities(docs: DataFrame, conf: Surrogates | None = None, text: str = "text", common: frozenset = frozenset()) -> DataFrame:
    """The corpus's distinct (kind, canonical), with the gender that most titles tell, else the list's, and whether that differs."""
    names = (conf or Surrogates()).names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            seen = Counter(x[2:] for t in b.column(0) if t.is_valid for x in detect(t.as_py(), names, common))
            own = sorted(seen)
            votes = [[seen[x] if x[2] == g else 0 for x in own] for g in "fm"]
            listed = [default_gender(x[0], x[1], names) for x in own]
            columns = [pa.array([x[k] for x in own], pa.string()) for k in range(2)] + [pa.array(v, pa.int64()) for v in votes]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(listed, pa.string())], names=["kind", "canonical", "f", "m", "listed"])

    seen = docs.select(text).mapInArrow(run, "kind string, canonical string, f bigint, m bigint, listed string")
    votes = seen.groupBy("kind", "canonical", "listed").agg(F.sum("f").alias("f"), F.sum("m").alias("m"))
    gender = F.when(F.col("f") > F.col("m"), "f").when(F.col("m") > F.col("f"), "m").otherwise(F.col("listed"))
    return votes.select("kind", "canonical", gender.alias("gender"), (gender != F.col("listed")).alias("told"))


def collisions(found: DataFrame, conf: Surrogates) -> DataFrame:
    """(kind, canonical, gender, attempt) of the entities that aren't drawn as the first attempt by the list's gender. `found` should
    be materialised."""

    def draw(df: DataFrame) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                new = [surrogate(r["kind"], r["canonical"], r["gender"], conf.key, r["attempt"]).lower() for r in b.to_pylist()]
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(new, pa.string())], names=[*b.schema.names, "drawn"])

        return df.mapInArrow(run, "kind string, canonical string, gender string, told boolean, attempt int, drawn string")

    drawn = cut(draw(found.withColumn("attempt", F.lit(0))))
    for _ in range(conf.rounds):
        # Of the entities that drew one surrogate, of whatever kinds, the one with the fewest attempts, then the first, keeps it.
        nth = F.row_number().over(Window.partitionBy("drawn").orderBy("attempt", "canonical", "kind"))
        taken = found.select(F.lower("canonical").alias("drawn"), F.lit(True).alias("real")).distinct()
        judged = drawn.withColumn("nth", nth).join(taken, "drawn", "left")
        judged = cut(judged.select("kind", "canonical", "gender", "told", "attempt", "drawn", ((F.col("nth") > 1) | F.col("real").isNotNull()).alias("again")))
        again = judged.where("again")
        if again.isEmpty():
            return drawn.where("attempt > 0 OR told").select("kind", "canonical", "gender", "attempt")
        redrawn = draw(again.select("kind", "canonical", "gender", "told", (F.col("attempt") + 1).alias("attempt")))
        drawn = cut(judged.where("NOT again").drop("again").unionByName(redrawn))
    raise RuntimeError("surrogates didn't settle")


def pseudonymise(docs: DataFrame, conf: Surrogates | None = None, text: str = "text", count: str = "n_entities") -> DataFrame:
    """`docs` with the text replaced, and the number of entities in `count`."""
    conf = conf or Surrogates()
    docs = docs.drop(count)
    common = common_words(docs, conf, text)
    redrawn = cut(collisions(cut(entities(docs, conf, text, common)), conf))
    kept = docs.columns
    names = [*kept, count]
    schema = T.StructType([*docs.schema.fields, T.StructField(count, T.IntegerType())])

    def told(b: pa.RecordBatch, exceptions) -> pa.RecordBatch:
        new = [(None, 0) if t is None else replace(t, conf, e, common) for t, e in zip(b.column(text).to_pylist(), exceptions)]
        columns = [pa.array([n[0] for n in new], pa.string()) if c == text else b.column(c) for c in kept]
        return pa.RecordBatch.from_arrays([*columns, pa.array([n[1] for n in new], pa.int32())], names=names)

    if redrawn.count() <= conf.most_exceptions:
        known = {(r.kind, r.canonical): (r.gender, r.attempt) for r in redrawn.collect()}

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                yield told(b, [known] * b.num_rows)

        return docs.mapInArrow(run, schema)

    # Too many to travel with the function: each text gets its own. Texts are told apart by their digest.
    sha, mine, n = unused(docs.columns, "sha", "own", "n")

    def per_text(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = sorted({(s, *x[2:4]) for s, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) if t is not None for x in detect(t, conf.names, common)})
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in rows], pa.string()) for k in range(3)], names=[sha, "kind", "canonical"])

    keyed = docs.withColumn(sha, F.coalesce(F.sha2(F.col(text).cast("binary"), 256), F.lit("")))
    held = keyed.select(sha, text).mapInArrow(per_text, f"{sha} string, kind string, canonical string").distinct()
    own = held.join(redrawn, ["kind", "canonical"]).groupBy(sha).agg(F.collect_list(F.struct("kind", "canonical", "gender", "attempt")).alias(mine))
    sizes = keyed.groupBy(sha).agg(F.count("*").alias(n))
    own = cut(sizes.join(own, sha, "left"))

    def run_joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield told(b, [{(x["kind"], x["canonical"]): (x["gender"], x["attempt"]) for x in own or ()} for own in b.column(mine).to_pylist()])

    return join_hot(keyed, own, sha, n).select(*docs.columns, mine).mapInArrow(run_joined, schema)


def pseudonymised_documents(docs: DataFrame) -> DataFrame:
    """The thin result: doc_id, text with surrogates, n_entities, changed."""
    out = pseudonymise(docs.select("doc_id", "text"))
    return out.select("doc_id", "text", "n_entities", (F.col("n_entities") > 0).alias("changed"))
