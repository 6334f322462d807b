"""Personal data and secrets replaced by keyed surrogates of the same kind.

Entities are e-mail and IPv4 addresses, phone, card and social security numbers, bank
accounts, names after a form of address, and secrets. Each is brought into a normal
form, so that spellings of one entity share a surrogate, and is drawn anew by a keyed
permutation of all values of its format: places of digits, cases, scripts, vowels and
consonants, a name's last letter (which marks gender, and is drawn where nothing else
can be), a number's country code and check digit stay. An entity whose format has no
other value becomes keyed letters. A permutation maps different entities to different surrogates, in
every text, without a table; it is built to have no fixed point. The draw is checked
all the same: over all distinct entities of the input, surrogates that more than one
entity shares are counted in a grouped aggregate, and any stops the job.

Each word of a name is drawn by itself, and words of a found name are replaced wherever
the same text has them with a capital: mentions of one person stay together.

The surrogate takes the spelling (cases, separators) of the place it goes to. Texts
without entities, null and empty texts stay as they are. Whole texts are read;
repeated rows get equal surrogates.
"""

from __future__ import annotations

import hashlib
import re
import sys
import unicodedata
from collections.abc import Callable
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from offerlens.llm.arrow import map_batches

DEFAULT_KEY = b"set a secret of your own"
ROUNDS = 6

# Detection -------------------------------------------------------------------
_EMAIL = re.compile(r"[\w.+-]*[\w+-]@[^\W_](?:[\w-]*[^\W_])?(?:\.[^\W_](?:[\w-]*[^\W_])?)+")
_SECRET = re.compile(
    r"""(?i)\b(?:token|password|passwd|pwd|secret|api[_-]?key|access[_-]?key|auth)["']?\s*[=:]\s*["']?(?P<v>(?=[^\s"']*[0-9])[A-Za-z0-9+/_.=-]{8,}[A-Za-z0-9+/=])"""
)
_KEY_ID = re.compile(r"\b(?:AKIA|ASIA)(?P<v>[A-Z0-9]{16})\b|\b(?:gh[pousr]_|sk-|xox[abp]-)(?P<w>[A-Za-z0-9_-]{16,})")
_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
_IPV4 = re.compile(rf"(?<![\d.]){_OCTET}(?:\.{_OCTET}){{3}}(?!\.?\d)")
_SSN = re.compile(r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])")
_PHONE = re.compile(r"(?<![\w+.-])(?:\+\d{1,3}[ .-]?)?(?:\(\d{3}\)[ .-]?|\d{3}[ .-])\d{3}[ .-]\d{4}(?![\d-])|(?<![\w+])\+\d{1,3}(?:[ .-]?\d{2,4}){2,5}(?!\d)")
_CARD = re.compile(r"(?<![\w.-])\d{4}(?:[ -]?\d{4}){2}[ -]?\d{1,7}(?![\w-])")
_IBAN = re.compile(r"\b[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?\b")
# Forms of address by the gender they tell, or none. They stay in place; what
# is drawn doesn't depend on them, as a name keeps one surrogate under every title.
_TITLES = {"Mr": "m", "Mrs": "f", "Ms": "f", "Miss": "f", "Herr": "m", "Frau": "f", "Monsieur": "m", "Madame": "f", "Mme": "f", "Señor": "m", "Señora": "f",
           "Sr": "m", "Sra": "f", "Dr": "", "Prof": "", "Господин": "m", "Госпожа": "f", "Κύριος": "m", "Κυρία": "f"}
_WORD, _INITIAL = r"[^\W\d_]\w*(?:['’-]\w+)*", r"[^\W\d_]\."
_NAME = re.compile(
    r"\b(?:" + "|".join(sorted(map(re.escape, _TITLES), key=len, reverse=True)) + rf")\.? (?P<v>(?:{_INITIAL} ?)*{_WORD}(?:(?: {_INITIAL})* {_WORD})?)"
)
_NAME_WORD, _NAME_PART, _POSSESSIVE = re.compile(_WORD), re.compile(r"[^ .]+"), re.compile(r"['’]s$")
_TITLE_SEEN = re.compile(r"\b(?:" + "|".join(map(re.escape, _TITLES)) + r")\b")
_DIGIT = re.compile(r"\d")

Span = tuple[int, int, str]


def find(text: str) -> list[Span]:
    """(start, end, kind) of the entities, apart and in order; of two that overlap the
    one that starts first, then the longer one."""
    found: list[Span] = []
    add = lambda m, kind, group=0: found.append((*m.span(group), kind))
    if "@" in text:
        for m in _EMAIL.finditer(text):
            add(m, "email")
    if _DIGIT.search(text):
        for m in _SECRET.finditer(text):
            add(m, "secret", "v")
        for m in _KEY_ID.finditer(text):
            add(m, "secret", "v" if m.group("v") else "w")
        for kind, pattern in (("ipv4", _IPV4), ("ssn", _SSN), ("phone", _PHONE), ("card", _CARD), ("iban", _IBAN)):
            for m in pattern.finditer(text):
                add(m, kind)
    if _TITLE_SEEN.search(text):
        for m in _NAME.finditer(text):
            end = m.start("v")
            for w in _NAME_WORD.finditer(text, *m.span("v")):
                if not (w.group()[0].isupper() or unicodedata.category(w.group()[0]) == "Lo"):  # a script without capitals
                    break
                end = w.end()
            end = m.start("v") + len(_POSSESSIVE.sub("", text[m.start("v") : end]))
            if end > m.start("v"):
                found.append((m.start("v"), end, "name"))
        found += _mentions(text, {w for s, e, kind in found if kind == "name" for w in _NAME_PART.findall(text[s:e]) if len(w) > 1})
    out: list[Span] = []
    for start, end, kind in sorted(found, key=lambda s: (s[0], -s[1])):
        if not out or start >= out[-1][1]:
            out.append((start, end, kind))
    return out


def _mentions(text: str, parts: set[str]) -> list[Span]:
    """Where the text has words of its found names, also in capitals."""
    out: list[Span] = []
    known = parts | {w.upper() for w in parts}
    for m in _NAME_WORD.finditer(text) if parts else ():
        word = _POSSESSIVE.sub("", m.group())
        if word in known:
            spans = [(m.start(), m.start() + len(word))]
        else:
            spans = [w.span() for w in re.finditer(r"\w+", text[m.start() : m.end()]) if w.group() in known] if len(word) > 1 else []
            spans = [(m.start() + s, m.start() + e) for s, e in spans]
        for start, end in spans:
            if out and text[out[-1][1] : start] == " ":
                start = out.pop()[0]
            out.append((start, end, "name"))
    return out


# Formats -----------------------------------------------------------------------
_LOWER, _UPPER, _DIGITS = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
_LATIN = "".join(chr(c) for c in range(0xE0, 0x100) if c != 0xF7)
_CYRILLIC, _GREEK = "".join(map(chr, range(0x430, 0x450))), "".join(chr(c) for c in range(0x3B1, 0x3CA) if c != 0x3C2)
_VOWELS = set("aeiouy") | set("àáâãäåæèéêëìíîïòóôõöøùúûüýÿ") | set("аеиоуыэюя") | set("αεηιουω")


def _split(letters: str) -> list[str]:
    return ["".join(c for c in letters if c in _VOWELS), "".join(c for c in letters if c not in _VOWELS)]


_NAME_CLASSES = [c for letters in (_LOWER, _LATIN, _CYRILLIC, _GREEK) for c in _split(letters)]
_TEXT_CLASSES = [_LOWER, _UPPER, _DIGITS, _LATIN, _LATIN.upper(), _CYRILLIC, _GREEK]
_OCTETS = [[str(i) for i in range(10)], [str(i) for i in range(10, 100)], [str(i) for i in range(100, 256)]]


@cache
def _scripts() -> dict[tuple[str, str, int], str]:
    """Letters and digits of no class above by script (first word of their names),
    category and block of 1024. Those that don't come back from capitals stay out."""
    known = set("".join([*_NAME_CLASSES, *_TEXT_CLASSES]))
    out: dict[tuple[str, str, int], list[str]] = {}
    for ch in map(chr, range(0x80, sys.maxunicode + 1)):
        if ch.isalnum() and ch not in known and ch.lower() == ch and ch.upper().lower() == ch and (name := unicodedata.name(ch, "")):
            out.setdefault((name.split()[0].split("-")[0], unicodedata.category(ch), ord(ch) >> 10), []).append(ch)
    return {k: "".join(v) for k, v in out.items()}


def _of_script(ch: str) -> str:
    if ch < "\x80" or not ch.isalnum():
        return ch
    found = _scripts().get((unicodedata.name(ch, " ").split(" ")[0].split("-")[0], unicodedata.category(ch), ord(ch) >> 10), ch)
    return found if ch in found else ch


def _by_class(value: str, classes: list[str]) -> list[str | list[str]]:
    """For each character the alphabet it is drawn from, or itself."""
    return [next((c for c in classes if ch in c), None) or _of_script(ch) for ch in value]


def normal(kind: str, spelled: str) -> str:
    """What spellings of one entity have in common."""
    if kind in ("email", "name"):
        return spelled.lower()
    if kind == "phone":
        return ("+" if spelled.startswith("+") else "") + re.sub(r"\D", "", spelled)
    if kind in ("card", "ssn"):
        return re.sub(r"\D", "", spelled)
    return spelled.replace(" ", "") if kind == "iban" else spelled


def parts(kind: str, value: str) -> list[str]:
    """What is drawn by itself of a value in normal form: each word of a name, so that a
    surname is the same with and without a given name."""
    return _NAME_PART.findall(value) if kind == "name" else [value]


def _layout(kind: str, value: str, country: int = 0) -> list[str | list[str]]:
    """The value as places, each with its alphabet; one string alone stays."""
    if kind == "ipv4":
        out: list = []
        for octet in value.split("."):
            out += [_OCTETS[len(octet) - 1], "."]
        return out[:-1]
    if kind == "email":
        local, domain = value.rsplit("@", 1)
        head, top = domain.rsplit(".", 1)
        return [*_by_class(local, _TEXT_CLASSES), "@", *_by_class(head, _TEXT_CLASSES), ".", *top]
    if kind == "name":
        places = _by_class(value, _NAME_CLASSES)
        # A word's last letter marks gender and stays, unless it is all that can change.
        return [*places[:-1], value[-1]] if any(len(p) > 1 for p in places[:-1]) else places
    if kind == "phone":
        kept = len(value) - 10 if value.startswith("+") and len(value) > 11 else 2 if value.startswith("+") else 0
        rest = value[kept:]
        return [*value[:kept], "23456789" if rest[:1] in set("23456789") else "01", *[_DIGITS] * (len(rest) - 1)]
    if kind == "iban":
        return [*value[:2], *_by_class(value[2:], [_DIGITS, _UPPER])]
    if kind == "secret":
        for base in ("0123456789abcdef", "0123456789ABCDEF"):
            if all(c in base for c in value):
                return [base] * len(value)
        return _by_class(value, _TEXT_CLASSES)
    return [_DIGITS] * len(value)


def _luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


class Surrogates:
    """Keyed, distinct, type-consistent replacements."""

    def __init__(self, key: bytes, most: int = 200_000):
        self._key, self._most = hashlib.blake2b(key, digest_size=32).digest(), most
        self._known: dict[tuple[str, str], str] = {}

    def _round(self, tweak: bytes, turn: int, half: int, bits: int) -> int:
        size = max(8, (bits + 7) // 8)
        data = tweak + bytes([turn]) + half.to_bytes(size, "big")
        out, block = b"", 0
        while len(out) < size:
            out += hashlib.blake2b(data + block.to_bytes(4, "big"), key=self._key, digest_size=min(64, size - len(out) + 8)).digest()
            block += 1
        return int.from_bytes(out[:size], "big") & ((1 << bits) - 1)

    def _permute(self, tweak: bytes, x: int, size: int, forward: bool) -> int:
        """A Feistel network over the next even number of bits; results beyond the
        range are put through again."""
        bits = max(1, ((size - 1).bit_length() + 1) // 2)
        mask = (1 << bits) - 1
        while True:
            left, right = x >> bits, x & mask
            if forward:
                for turn in range(ROUNDS):
                    left, right = right, left ^ self._round(tweak, turn, right, bits)
            else:
                for turn in reversed(range(ROUNDS)):
                    left, right = right ^ self._round(tweak, turn, left, bits), left
            x = left << bits | right
            if x < size:
                return x

    def _next(self, kind: str, layout: list[str | list[str]], value: str) -> str:
        """The value's successor on one keyed cycle through all values of its format."""
        places = [p for p in layout if len(p) > 1]
        size = 1
        for p in places:
            size *= len(p)
        if size < 2:  # no other value looks like it: letters, too many to meet another draw
            drawn = hashlib.blake2b(repr((kind, value)).encode(), key=self._key, digest_size=16).digest()
            made = "".join(_LOWER[b % 26] for b in drawn)
            return made + "@" + made + ".example" if kind == "email" else made
        tweak = hashlib.blake2b(repr((kind, layout)).encode(), digest_size=16).digest()
        parts = value.split(".") if kind == "ipv4" else list(value)
        number, at = 0, 0
        for p in layout:
            if kind == "ipv4" and p == ".":
                continue
            if len(p) > 1:
                number = number * len(p) + p.index(parts[at])
            at += 1
        # One step on the cycle that the permutation lays through the numbers.
        number = self._permute(tweak, (self._permute(tweak, number, size, True) + 1) % size, size, False)
        drawn = []
        for p in reversed(places):
            number, index = divmod(number, len(p))
            drawn.append(p[index])
        return "".join(drawn.pop() if len(p) > 1 else p for p in layout)

    def of(self, kind: str, value: str) -> str:
        """The surrogate of a value in normal form."""
        if kind == "name" and _NAME_PART.fullmatch(value) is None:
            return _NAME_PART.sub(lambda m: self.of(kind, m.group()), value)
        if (kind, value) not in self._known:
            if len(self._known) >= self._most:
                self._known.clear()
            layout = _layout(kind, value)
            made = self._next(kind, layout, value)
            if kind == "card":  # numbers with a valid check digit keep one, others none
                while _luhn(made) != _luhn(value):
                    made = self._next(kind, layout, made)
            self._known[kind, value] = made
        return self._known[kind, value]

    def spelled(self, kind: str, as_found: str) -> str:
        """The surrogate in the spelling of the place it goes to."""
        made = self.of(kind, normal(kind, as_found))
        if kind in ("email", "name"):
            if len(made) != len(as_found):
                return made
            return "".join(m.upper() if c.isupper() and len(m.upper()) == 1 else m for m, c in zip(made, as_found))
        if kind in ("phone", "card", "ssn"):
            digits = iter(made.lstrip("+"))
            return "".join(next(digits) if c.isdigit() else c for c in as_found)
        if kind == "iban":
            chars = iter(made)
            return "".join(c if c == " " else next(chars) for c in as_found)
        return made

    def replace(self, text: str) -> tuple[str, list[str]]:
        spans = find(text)
        if not spans:
            return text, []
        out, done = [], 0
        for start, end, kind in spans:
            out += [text[done:start], self.spelled(kind, text[start:end])]
            done = end
        return "".join([*out, text[done:]]), [kind for _, _, kind in spans]


# Tables ------------------------------------------------------------------------
def entities(df: DataFrame, key: bytes = DEFAULT_KEY, text: str = "text") -> DataFrame:
    """Distinct (kind, value, surrogate) of all texts; of names, of each word."""

    def make() -> Callable[[pa.RecordBatch], pa.RecordBatch]:
        draw = Surrogates(key)

        def apply(batch: pa.RecordBatch) -> pa.RecordBatch:
            found = {(kind, p) for t in batch.column(0).to_pylist() if t for s, e, kind in find(t) for p in parts(kind, normal(kind, t[s:e]))}
            rows = [(k, v, draw.of(k, v)) for k, v in sorted(found)]
            columns = list(zip(*rows)) or [(), (), ()]
            return pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in columns], ["kind", "value", "surrogate"])

        return apply

    return map_batches(df.select(text), make, "kind string, value string, surrogate string").distinct()


def collisions(found: DataFrame) -> DataFrame:
    """Surrogates that several entities share, and entities that are their own."""
    return found.groupBy("kind", "surrogate").agg(F.count("*").alias("entities"), F.max(F.col("value") == F.col("surrogate")).alias("own")).filter(
        (F.col("entities") > 1) | F.col("own")
    )


def pseudonymize(df: DataFrame, key: bytes = DEFAULT_KEY, text: str = "text", counts: bool = False, check: bool = True) -> DataFrame:
    """``df`` with surrogates in its texts, and with ``counts`` the columns
    ``n_entities`` and ``kinds``. A column ``n_chars`` follows the text."""
    if check:
        bad = collisions(entities(df, key, text)).limit(5).collect()
        if bad:
            raise ValueError(f"surrogates are not distinct for {sorted({r['kind'] for r in bad})}")
    columns, schema = df.columns, df.schema
    at = columns.index(text)
    more = [T.StructField("n_entities", T.IntegerType()), T.StructField("kinds", T.ArrayType(T.StringType()))]
    out_schema = T.StructType([*schema.fields, *more]) if counts else schema
    names = [*columns, "n_entities", "kinds"] if counts else columns

    def make() -> Callable[[pa.RecordBatch], pa.RecordBatch]:
        draw = Surrogates(key)

        def apply(batch: pa.RecordBatch) -> pa.RecordBatch:
            done = [draw.replace(t) if t else (t, []) for t in batch.column(at).to_pylist()]
            out = list(batch.columns)
            out[at] = pa.array([t for t, _ in done], out[at].type)
            if "n_chars" in columns and pa.types.is_integer(out[columns.index("n_chars")].type):
                c = columns.index("n_chars")
                out[c] = pa.array([len(t) if k else old for (t, k), old in zip(done, out[c].to_pylist())], out[c].type)
            if counts:
                out += [pa.array([len(k) for _, k in done], pa.int32()), pa.array([sorted(set(k)) for _, k in done], pa.list_(pa.string()))]
            return pa.RecordBatch.from_arrays(out, names)

        return apply

    return map_batches(df, make, out_schema)
