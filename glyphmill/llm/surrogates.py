"""Personal data replaced by keyed surrogates of the same type and format.

Detected: e-mail addresses, telephone numbers, payment cards (Luhn), social security numbers, IBANs, IPv4 addresses, access keys and
assigned secrets, and persons (a title or a known first name before a surname).

A surrogate is a keyed permutation of all strings of the original's format:
digits become digits, letters letters of the same script and case, and what
gives a type its form (separators, country code, check digits, key prefix, top
domain) stays right.  Known first names are permuted among names of the same
gender and script; vowels of other names stay vowels.  A permutation never maps
two entities to one surrogate, and maps an entity to the same one in every
document, so distinctness and coreference need no table and no shuffle.  Names
of a text's persons are replaced where they stand alone, too.  No entity is its
own surrogate.  ``replace_checked`` looks for collisions over all texts first.

Not found: persons without a title or a known first name, names in scripts other
than Latin, Cyrillic and Greek, assigned secrets of fewer than six characters.

Defined results: a null text stays null; an empty text, or one without entities,
stays as it is, byte by byte.  Very long texts are searched whole and entities
have any length.  Where kinds overlap the more specific one wins, then the
earlier span.  Repeated rows and equal texts get equal results.  Empty tables
stay empty.  Columns named like outputs (in any case) are replaced.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import quoted, without

#: For tests and examples; production passes its own secret.
DEMO_KEY = b"glyphmill demonstration key"
ROUNDS = 8
OUTPUTS = ("n_entities", "kinds")


# ---------------------------------------------------------------- permutations


class Permutation:
    """Keyed permutations of the numbers below n, and of strings of one format."""

    def __init__(self, key: bytes):
        self.key = hashlib.blake2b(key, digest_size=32).digest()
        self.text = lru_cache(maxsize=100_000)(self._text)

    def _round(self, tweak: bytes, r: int, value: int, bits: int) -> int:
        size = bits // 8 + 1
        seed = b"%d|%d|%s" % (r, bits, tweak)
        h = hashlib.shake_256 if size > 64 else None
        raw = value.to_bytes(size, "little")
        if h:
            out = h(self.key + seed + raw).digest(size)
        else:
            out = hashlib.blake2b(seed + raw, key=self.key, digest_size=size).digest()
        return int.from_bytes(out, "little") & ((1 << bits) - 1)

    def _feistel(self, tweak: bytes, x: int, half: int, back: bool) -> int:
        left, right = x >> half, x & ((1 << half) - 1)
        for r in range(ROUNDS)[:: -1 if back else 1]:
            if back:
                left, right = right ^ self._round(tweak, r, left, half), left
            else:
                left, right = right, left ^ self._round(tweak, r, right, half)
        return left << half | right

    def number(self, tweak: bytes, x: int, n: int) -> int:
        """Another number below n: a permutation without fixed points, for n > 1."""
        if n < 2:
            return x
        half = ((n - 1).bit_length() + 1) // 2

        def walk(y: int, back: bool) -> int:
            y = self._feistel(tweak, y, half, back)
            while y >= n:
                y = self._feistel(tweak, y, half, back)
            return y

        return walk((walk(x, False) + 1) % n, True)

    def _text(self, tweak: str, text: str, spoken: bool = False) -> str:
        """Another string of the same format; a hexadecimal number stays one, and nothing else becomes one.

        ``spoken``: vowels stay vowels.  A string without letters or digits
        becomes another one of marks.
        """
        is_hex = _IS_HEX.fullmatch(text) is not None
        classes = [_SPOKEN.get(c) or _CLASS.get(c) if spoken else _HEX if is_hex else _CLASS.get(c) for c in text]
        if not any(classes):
            classes = [_SIGNS if c in _SIGNS else None for c in text]
        n, x = 1, 0
        for c, own in zip(text, classes):
            if own:
                x = x * len(own) + own.index(c)
                n *= len(own)
        form = "".join(own[-1] if own else c for c, own in zip(text, classes))
        tag = f"{tweak}|{form}".encode("utf-8", "surrogatepass")
        # the permutation is one cycle, so walking on stays one on the strings that are, or aren't, hexadecimal
        while True:
            x = self.number(tag, x, n)
            new = self._spell(x, text, classes)
            if (_IS_HEX.fullmatch(new) is not None) == is_hex:
                return new

    @staticmethod
    def _spell(x: int, text: str, classes: list) -> str:
        out = []
        for c, own in zip(reversed(text), reversed(classes)):
            if own:
                x, k = divmod(x, len(own))
                out.append(own[k])
            else:
                out.append(c)
        return "".join(reversed(out))


_ALPHABETS = [
    "0123456789",
    "abcdefghijklmnopqrstuvwxyz",
    "ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "àáâãäåæçèéêëìíîïñòóôõöøùúûüýß",
    "ÀÁÂÃÄÅÆÇÈÉÊËÌÍÎÏÑÒÓÔÕÖØÙÚÛÜÝ",
    "абвгдежзийклмнопрстуфхцчшщъыьэюяё",
    "АБВГДЕЖЗИЙКЛМНОПРСТУФХЦЧШЩЭЮЯЁ",
    "αβγδεζηθικλμνξοπρστυφχψω",
    "ΑΒΓΔΕΖΗΘΙΚΛΜΝΞΟΠΡΣΤΥΦΧΨΩ",
]
_ALPHABETS += ["".join(map(chr, range(a, z + 1))) for a, z in ((0x05D0, 0x05EA), (0x0621, 0x063A), (0x0641, 0x064A), (0x0905, 0x0939), (0x3041, 0x3096), (0x30A1, 0x30FA), (0x4E00, 0x9FA5), (0xAC00, 0xD7A3))]
_SIGNS = "!#$%&()*+-./:=?@[]^_`{|}~"
_HEX = "0123456789abcdef"
_IS_HEX = re.compile(r"(?=[a-f]*\d)(?=\d*[a-f])[0-9a-f]{8,}")
_CLASS = {c: a for a in _ALPHABETS for c in a}
#: Vowels and consonants of names apart, so that made names can be spoken.
_VOWELS = set("aeiouyàáâãäåæèéêëìíîïòóôõöøùúûüýаеёиоуыэюяαεηιουω")
_SPOKEN = {c: "".join(x for x in a if (x.lower() in _VOWELS) == (c.lower() in _VOWELS)) for a in _ALPHABETS[1:9] for c in a}

# ---------------------------------------------------------------- names

#: First names by script and gender; each list is a pool that is permuted.
FIRST_NAMES = {
    ("latin", "f"): "Mary Patricia Jennifer Linda Elizabeth Barbara Susan Jessica Sarah Karen Nancy Lisa Margaret Sandra Ashley "
    "Emily Anna Laura Julia Sophie Marie Claire Camille Juliette Hélène Ingrid Ursula Katharina Sabine Monika Carmen Lucía Sofía "
    "Isabel Ana María Elena Marta Pilar Rosa",
    ("latin", "m"): "James John Robert Michael William David Richard Joseph Thomas Charles Christopher Daniel Matthew Anthony Mark "
    "Peter Paul Steven Andrew Kevin Pierre Jean Jacques Louis Henri Antoine Hans Jürgen Klaus Wolfgang Stefan Dieter Carlos José "
    "Juan Luis Javier Miguel Antonio Pedro",
    ("cyrillic", "f"): "Анна Мария Елена Ольга Наталья Татьяна Ирина Светлана Екатерина Юлия",
    ("cyrillic", "m"): "Иван Александр Дмитрий Сергей Андрей Алексей Михаил Николай Владимир Павел",
    ("greek", "f"): "Μαρία Ελένη Αικατερίνη Βασιλική Σοφία Γεωργία Άννα Ιωάννα",
    ("greek", "m"): "Γεώργιος Δημήτριος Κωνσταντίνος Ιωάννης Νικόλαος Παναγιώτης Βασίλειος Χρήστος",
}
_POOLS = {k: tuple(v.split()) for k, v in FIRST_NAMES.items()}
_POOL_OF = {name: k for k, pool in _POOLS.items() for name in pool}
TITLES = ("Mr", "Mrs", "Ms", "Miss", "Mx", "Dr", "Prof", "Professor", "Herr", "Frau", "Monsieur", "Madame", "Mme", "Señor", "Señora", "Sr", "Sra")
_CAP = r"[A-ZÀ-ÖØ-ÝА-ЯЁΑ-Ω][a-zß-öø-ÿа-яёά-ώ]+(?:-[A-ZÀ-ÖØ-ÝА-ЯЁΑ-Ω][a-zß-öø-ÿа-яёά-ώ]+)?"
_FIRST = "|".join(sorted(_POOL_OF, key=len, reverse=True))
_NAME = re.compile(
    rf"\b(?:(?P<title>{'|'.join(TITLES)})\.?[ ](?:(?P<given>{_CAP})[ ])?(?P<family>{_CAP})"
    rf"|(?P<first>(?:{_FIRST})(?:-(?:{_FIRST}))?)[ ](?P<last>{_CAP}))\b"
)
#: A person's span begins with one of these, as a whole run of word characters.
_NAME_STARTS = frozenset([*_POOL_OF, *TITLES])
_RUN = re.compile(r"\w+")

# ---------------------------------------------------------------- detection

_EMAIL = re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]+@(?:[A-Za-z0-9-]+\.)+[A-Za-z]{2,}(?![A-Za-z0-9-])")
_SECRET = re.compile(
    r"(?i)\b(?:password|passwd|pwd|passphrase|token|secret|api[_-]?key|access[_-]?key|auth[_-]?key)\b[\"']?\s{0,3}[=:]\s{0,3}[\"']?(?P<v>[^\s\"'<>,;]{6,})"
)
_ACCESS = re.compile(r"(?a)\b(?:(?:AKIA|ASIA)[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36,}|sk-[A-Za-z0-9_-]{20,}|xox[abprs]-[A-Za-z0-9-]{10,}|eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,})")
#: What every access key holds.
_KEY_MARKS = ("AKIA", "ASIA", "ghp_", "gho_", "ghu_", "ghs_", "ghr_", "sk-", "xox", "eyJ")
_IBAN = re.compile(r"(?a)\b[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?\b")
_NUMBER = re.compile(
    r"(?a)(?P<ssn>(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-]))"
    r"|(?P<card>(?<![\d.,+-])\d{4}(?:[ -]?\d{4}){2}[ -]?\d{1,7}(?![\d]))"
    r"|(?P<phone>(?<![\d\w])\+\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d{1,4}(?:[ .-]?\d{2,4}){1,4}(?!\d)"
    r"|(?<![\d\w])\(\d{3}\)[ ]?\d{3}[ .-]\d{4}(?!\d)|(?<![\d\w.-])\d{3}[.-]\d{3}[.-]\d{4}(?![\d.-]))"
    r"|(?P<ip>(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?![\d]|\.\d))"
)
_DIGIT = re.compile(r"[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def _mod97(iban: str) -> int:
    moved = iban[4:] + iban[:4]
    return int("".join(str(int(c, 36)) for c in moved)) % 97


def find_entities(text: str) -> list[tuple[int, int, str]]:
    """Spans (start, end, kind) of a text, in order and disjoint; the more specific kind wins."""
    found: list[tuple[int, int, int, str]] = []
    digits = _DIGIT.search(text) is not None
    if "=" in text or ":" in text:
        found += [(*m.span("v"), 0, "secret") for m in _SECRET.finditer(text)]
    if any(mark in text for mark in _KEY_MARKS):
        found += [(*m.span(), 1, "access_key") for m in _ACCESS.finditer(text)]
    if digits:
        for m in _IBAN.finditer(text):
            if 15 <= len(flat := m[0].replace(" ", "")) <= 34 and _mod97(flat) == 1:
                found.append((*m.span(), 2, "iban"))
        for m in _NUMBER.finditer(text):
            kind = m.lastgroup
            if kind == "card":
                if not luhn(re.sub(r"\D", "", m[0])):
                    continue
            found.append((*m.span(), 4, kind))
    if "@" in text:
        found += [(*m.span(), 3, "email") for m in _EMAIL.finditer(text)]
    if not _NAME_STARTS.isdisjoint(_RUN.findall(text)):
        alone: set[str] = set()
        for m in _NAME.finditer(text):
            found.append((*m.span(), 5, "person"))
            alone.update(m[g] for g in ("family", "last") if m[g])
            alone.update(m[g] for g in ("given", "first") if m[g] in _POOL_OF)
        # names of the persons of this text, where they stand alone
        if alone:
            again = re.compile(rf"\b(?:{'|'.join(sorted(map(re.escape, alone), key=len, reverse=True))})\b")
            found += [(*m.span(), 6, "person") for m in again.finditer(text)]
    # disjoint spans in order of their places: only the neighbours can overlap
    out: list[tuple[int, int, str]] = []
    for start, end, _, kind in sorted(found, key=lambda f: (f[2], f[0])):
        at = bisect_left(out, (start,))
        if (not at or out[at - 1][1] <= start) and (at == len(out) or end <= out[at][0]):
            out.insert(at, (start, end, kind))
    return out


# ---------------------------------------------------------------- surrogates


class Surrogates:
    """Surrogates under one key."""

    def __init__(self, key: bytes):
        self.by = Permutation(key)

    def _digits(self, kind: str, text: str, keep: int = 0, check: bool = False) -> str:
        """Permutes the digits after the first ``keep``; the last one is made to fit Luhn if ``check``."""
        at = [k for k, c in enumerate(text) if c.isdigit()]
        old = "".join(text[k] for k in at)
        body = old[keep : len(old) - check]
        new = old[:keep] + self.by.text(f"{kind}|{old[:keep]}", body)
        if check:
            new += next(d for d in "0123456789" if luhn(new + d))
        out = list(text)
        for k, d in zip(at, new):
            out[k] = d
        return "".join(out)

    def first_name(self, name: str) -> str:
        """A known first name becomes one of the same gender and script, any other name another one that can be spoken."""
        return "-".join(map(self._pooled, name.split("-"))) if all(part in _POOL_OF for part in name.split("-")) else self._made(name)

    def _pooled(self, name: str) -> str:
        pool = _POOLS[_POOL_OF[name]]
        return pool[self.by.number(b"first|%d|%s" % (len(pool), pool[0].encode()), pool.index(name), len(pool))]

    def _made(self, name: str) -> str:
        other = self.by.text("name", name, True)
        while all(part in _POOL_OF for part in other.split("-")):
            other = self.by.text("name", other, True)
        return other

    def of(self, kind: str, text: str) -> str:
        if kind == "email":
            local, _, domain = text.partition("@")
            name, _, top = domain.lower().rpartition(".")
            return f"{self.by.text('local|' + domain.lower(), local.lower())}@{self.by.text('domain', name)}.{top}"
        if kind == "card":
            return self._digits(kind, text, keep=1, check=True)
        if kind == "phone":
            country = re.match(r"\+(\d{1,3})(?=\D)", text)
            return self._digits(kind, text, keep=len(country[1]) if country else 0)
        if kind == "ip":
            n = int.from_bytes(bytes(map(int, text.split("."))), "big")
            return ".".join(map(str, self.by.number(b"ip", n, 1 << 32).to_bytes(4, "big")))
        if kind == "iban":
            flat = text.replace(" ", "")
            body = self.by.text("iban|" + flat[:2], flat[4:])
            new = f"{flat[:2]}{98 - _mod97(flat[:2] + '00' + body):02d}{body}"
            places = iter(new)
            return "".join(c if c == " " else next(places) for c in text)
        if kind == "access_key":
            keep = next(n for p, n in (("AKIA", 4), ("ASIA", 4), ("gh", 4), ("sk-", 3), ("xox", 5), ("eyJ", 3)) if text.startswith(p))
            return text[:keep] + self.by.text(kind, text[keep:])
        if kind == "person":
            m = _NAME.fullmatch(text)
            if m is None:  # a name that stands alone
                return self.first_name(text)
            out, last = [], 0
            for group in ("given", "family", "first", "last"):
                if m[group]:
                    out += [text[last : m.start(group)], self.first_name(m[group])]
                    last = m.end(group)
            return "".join([*out, text[last:]])
        return self._digits(kind, text) if kind == "ssn" else self.by.text(kind, text)

    def rewrite(self, text: str) -> tuple[str, list[tuple[str, str, str]]]:
        """The text with surrogates, and (kind, original, surrogate) of each entity in order."""
        out, last, found = [], 0, []
        for start, end, kind in find_entities(text):
            new = self.of(kind, text[start:end])
            found.append((kind, text[start:end], new))
            out += [text[last:start], new]
            last = end
        return ("".join([*out, text[last:]]), found) if found else (text, found)


# ---------------------------------------------------------------- Spark


def replace_entities(docs: DataFrame, key: bytes = DEMO_KEY, text_col: str = "text") -> DataFrame:
    """``docs`` with entities in the text replaced, n_entities and kinds (sorted, comma-joined)."""

    @F.pandas_udf("t string, n long, kinds string")
    def rewrite(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        make = Surrogates(key)
        for batch in texts:
            rows = []
            for text in batch:
                new, found = (None, []) if text is None else make.rewrite(text)
                rows.append((new, len(found), ",".join(sorted({f[0] for f in found}))))
            yield pd.DataFrame(rows, columns=["t", "n", "kinds"])

    found = docs.withColumn("__gm_s", rewrite(quoted(text_col)))
    rest = without(found, [c for c in OUTPUTS if c.lower() != text_col.lower()])
    return rest.select(
        *[F.col("__gm_s.t").alias(c) if c == text_col else quoted(c) for c in rest.columns if c != "__gm_s"],
        F.col("__gm_s.n").alias("n_entities"),
        F.col("__gm_s.kinds").alias("kinds"),
    )


def entities(docs: DataFrame, key: bytes = DEMO_KEY, text_col: str = "text") -> DataFrame:
    """The distinct entities of all texts: kind, original, surrogate, and how often they occur.

    Counted in each batch before the shuffle, so a frequent entity is no burden.
    """

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        make = Surrogates(key)
        for batch in batches:
            seen: dict[tuple, int] = {}
            for text in batch.text:
                for entity in make.rewrite(text)[1] if text is not None else ():
                    seen[entity] = seen.get(entity, 0) + 1
            yield pd.DataFrame([(*k, n) for k, n in seen.items()], columns=["kind", "original", "surrogate", "n"])

    counted = docs.select(quoted(text_col).alias("text")).mapInPandas(
        count, "kind string, original string, surrogate string, n long"
    )
    return counted.groupBy("kind", "original", "surrogate").agg(F.sum("n").alias("n"))


def replace_checked(docs: DataFrame, key: bytes = DEMO_KEY, text_col: str = "text") -> DataFrame:
    """``replace_entities`` after the entities of all texts were looked through for collisions; raises if there is one."""
    wrong = collisions(entities(docs, key, text_col)).limit(3).collect()
    if wrong:
        raise ValueError(f"surrogates that don't keep entities apart: {[(r.kind, r.surrogate, r.originals) for r in wrong]}")
    return replace_entities(docs, key, text_col)


def collisions(found: DataFrame) -> DataFrame:
    """Surrogates that stand for several originals, or originals that kept their form; empty if all is well.

    E-mail addresses count without regard to case, as their surrogates do.
    """
    original = F.when(F.col("kind") == "email", F.lower("original")).otherwise(F.col("original"))
    several = found.groupBy("kind", "surrogate").agg(F.countDistinct(original).alias("originals"), F.min(original).alias("original"))
    return several.filter((F.col("originals") > 1) | (F.col("original") == F.col("surrogate")))
