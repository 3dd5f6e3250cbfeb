"""PII: surrogate generation.

Detected entities are replaced by keyed surrogates of the same type and form.  A surrogate is made
by a keyed permutation (a Feistel network over mixed radixes) of the strings of one form: digits
stay digits, letters stay letters of their case, script and kind (vowel or consonant), separators
stay where they are, Luhn-valid card numbers stay valid and others invalid.  So the same entity has the
same surrogate in every document (coreference), and two entities of a form never share one (distinctness).

Names of persons are replaced part by part.  A given name of the list moves along a keyed cycle through
the names of its gender and script; another one after a title becomes a compound of two or more of them,
of the title's gender and its own script; after a title of no gender, or in a script without a list, it is
spelled anew like a surname.  A part that the corpus has as a surname too is that surname everywhere.

Collision check: a surrogate that equals an entity of the corpus, or that two entities of a type
share, is re-keyed for all of them but the least, until none collides (parts of names, given and surnames
together, likewise; names of the list aside, whose cycle has no fixed point but ends on names in use); from round MAX_ROUNDS on, and at
once where a form has no free character, by a longer form that grows by a character a round, so that a
full form runs out of collisions and not of rounds.  The corpus-wide check is a
pre-aggregated grouping of the distinct entities, held in the shared folder.  Re-keyed
entities reach the texts by a join on the document that is only run when there are any.

Types: email, phone, card, ip, ip6, secret (hexadecimal or mixed keys), iban, ssn, person.  All patterns take time in proportion
to the text, whatever it holds.  Names are found after a title, or after a given name of the list (about 90), in
usual spelling or capitals, with hyphens and apostrophes; after an abbreviated title also in small letters.  A full name
whose given name is not listed and that has no title stays.
Defined results: null text stays null; an empty one stays empty, with 0 entities; entities inside
longer words or numbers are left alone; overlapping matches go to the leftmost, then longest; a mention
by surname alone ("Ms. Stone") has the surrogate surname of the full name; a listed given name alone
("Ms. Anna") is a given name unless its gender is not the title's or the corpus has it as a surname.  Input columns
named ``n_entities`` or ``kinds`` are replaced; all others pass through, whatever their names.
"""

from __future__ import annotations

import hashlib
import hmac
import ipaddress
import re
import unicodedata
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewater.llm.shared import col, columns, map_arrow, scratch, table

MAX_ROUNDS = 20
#: Given names by gender and script.
GIVEN = {
    ("f", "latin"): "Anna Maria Sophie Laura Julia Emma Claire Camille Isabel Carmen Lucia Elena Sarah Emily Jessica Alice Marie Nina Clara Helen Rosa Marta Ingrid Greta Louise Jane Mary Linda Susan Karen".split(),
    ("m", "latin"): "John James Robert Michael David Thomas Peter Paul Pierre Jean Louis Hans Karl Jürgen Stefan Carlos José Juan Miguel Pablo Luis Antonio Mark Daniel Simon Felix Martin George Henry Walter".split(),
    ("f", "cyrillic"): "Анна Мария Елена Ольга Наталья Ирина Татьяна Светлана Екатерина Юлия".split(),
    ("m", "cyrillic"): "Иван Пётр Алексей Сергей Дмитрий Николай Андрей Михаил Павел Юрий".split(),
    ("f", "greek"): "Μαρία Ελένη Κατερίνα Σοφία Άννα Δήμητρα".split(),
    ("m", "greek"): "Γιώργος Νίκος Δημήτρης Κώστας Παύλος Γιάννης".split(),
}
#: Titles that come before a name, by gender ("" for either).
TITLES = {
    "f": ["Mrs.", "Ms.", "Miss", "Frau", "Mme", "Madame", "Mlle", "Señora", "Sra.", "Doña", "Госпожа", "Κυρία"],
    "m": ["Mr.", "Herr", "Herrn", "Monsieur", "Señor", "Sr.", "Don", "Господин", "Κύριος"],
    "": ["Dr.", "Prof."],
}
_GENDER = {n: k for k, names in GIVEN.items() for n in names}
_NAME = r"(?:[A-ZÀ-Þ]['’])?[^\W\d_a-zà-öø-ÿа-яα-ω][^\W\d_]*[a-zà-öø-ÿа-яёα-ωά-ώ](?:-[^\W\d_]+)?"
_TITLE = "|".join(sorted((re.escape(t) for ts in TITLES.values() for t in ts), key=len, reverse=True))
_GIVEN = "|".join(sorted(_GENDER, key=len, reverse=True))
_PERSON = re.compile(rf"(?<!\w)(?:(?P<title>{_TITLE})[  ](?P<names>{_NAME}(?:[  ]{_NAME}){{0,2}})|(?P<full>(?:{_GIVEN})(?:-{_NAME})?(?:[  ]{_NAME}){{1,2}}))(?!\w)")
#: Names in capitals, after a title or a given name of the list; in small letters, after the abbreviation of a title.
_CAPITALS = re.compile(r"(?<!\w)(?:(?P<title>[^\W\d_a-z]{2,}\.?|(?:Mrs?|Ms|Dr|Prof|Herr|Frau)\.?)[  ])?(?P<names>(?P<first>[^\W\d_a-zà-öø-ÿа-яα-ω]{2,})(?:[  ](?:[^\W\d_a-z]['’])?[^\W\d_a-zà-öø-ÿа-яα-ω]{2,}){0,2})(?!\w)")
_SMALL = re.compile(r"(?<!\w)(?P<title>(?:[Mm]rs?|[Mm]s|[Dd]r|[Pp]rof|[Ss]ra?)\.)[  ](?P<first>[^\W\d_A-Z]{2,})(?!\w)(?:(?=[  ](?P<second>[^\W\d_A-Z]{2,})(?!\w))|)")
#: What must be in a text for these two to be tried.
_HAS_CAPITALS = re.compile("[A-ZÀ-ÖØ-ÞΑ-ΩЀ-Я]{2}")
_HAS_TITLE = [t + "." for t in "mr Mr mrs Mrs ms Ms dr Dr prof Prof sr Sr sra Sra".split()]
#: Words that follow an abbreviated title and are no name.
_NO_NAME = frozenset("a an and are as at be but by de der die das du el en for from had has have in is it la le mit o of on or said says that the to und was were who will with y".split())
_BY_TITLE = {t.rstrip(".").lower(): t for ts in TITLES.values() for t in ts}
#: What must be in a text for a pattern to be tried.
_HAS_DIGIT = re.compile(r"\d")
_DIGITS = re.compile(
    r"(?P<card>(?<![\w.+-])\d{4}(?P<sep>[ -]?)\d{4}(?P=sep)\d{4}(?P=sep)\d{1,7}(?![\w-]))"
    r"|(?P<iban>(?<!\w)[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,4})?(?!\w))"
    r"|(?P<ssn>(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-]))"
    r"|(?P<ip>(?<![\w.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?![\w]|\.\d))"
    r"|(?P<phone>(?<![\w+])(?:\+\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d{1,4}(?:[ .-]?\d{2,4}){1,4}|\(\d{3}\)[ .-]?\d{3}[ .-]?\d{4}|\d{3}[.-]\d{3}[.-]\d{4}|0\d{2,4}[ /-]\d{3,}+(?:[ -]\d{2,}+)*)(?!\w))"
    r"|(?P<secret>(?<!\w)(?:(?=[0-9a-f]*\d)(?=[0-9a-f]*[a-f])[0-9a-f]{24,}|(?:sk|pk|ghp|gho|xox[abp]|AKIA|eyJ)[-_]?(?=\w*\d)[A-Za-z0-9_-]{16,})(?!\w))"
    r"|(?P<ip6>(?<![\w:.])(?:(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}|(?:[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){0,6})?::(?:[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){0,6})?)(?![\w:]|\.\d))"
)
_KEY = re.compile(r"[A-Za-z0-9_-]{28,}+")
_CASES = re.compile(r"(?=[^A-Z]*[A-Z])[^a-z]*[a-z]")
_LAST_DIGIT = re.compile(r".*[0-9]", re.DOTALL)
_EMAIL = re.compile(r"(?<![\w.+-])[\w.+-]*[\w+-]@(?:[^\W_](?:[\w-]*[^\W_])?\.)+[^\W\d_]{2,}(?![\w-])")
_VOWELS = {"latin": "aeiou", "cyrillic": "аеёиоуыэюя", "greek": "αεηιουω"}


def _keys(text: str) -> list[tuple[int, int, str]]:
    """Runs of 28 characters or more of an alphabet of keys, from the first part between dashes on that has letters of both cases, with a
    digit behind its beginning.  Each run is gone through once."""
    out = []
    for m in _KEY.finditer(text):
        start, end = m.span()
        if end < len(text) and (text[end].isalnum() or text[end] == "_"):
            end = text.rfind("-", start, end)  # what a letter follows belongs to a word
        digit = _LAST_DIGIT.match(text, start, m.end())
        last = min(end - 28, digit.end() - 1 if digit else -1)
        at = start
        if at and (text[at - 1].isalnum() or text[at - 1] == "_"):
            at = text.find("-", start, end) + 1 or end
        while at <= last:
            stop = text.find("-", at, m.end())
            stop = m.end() if stop < 0 else stop
            if _CASES.match(text, at, stop):
                out.append((at, end, "secret"))
                break
            at = stop + 1
    return out


def find(text: str) -> list[tuple[int, int, str]]:
    """(start, end, type) of the entities, left to right, without overlap."""
    spans = []
    if "@" in text:
        spans += [(m.start(), m.end(), "email") for m in _EMAIL.finditer(text)]
    if _HAS_DIGIT.search(text):
        for m in _DIGITS.finditer(text):
            if m.lastgroup != "ip6" or _is_ip6(m[0]):
                spans.append((m.start(), m.end(), m.lastgroup if m.lastgroup != "sep" else "card"))
        spans += _keys(text)
    for m in _PERSON.finditer(text):
        g = "names" if m["names"] else "full"
        spans.append((m.start(g), m.end(g), "person" + _gender_of(m["title"])))
    spans += _odd_names(text)
    spans.sort(key=lambda s: (s[0], -s[1]))
    out, end = [], 0
    for s in spans:
        if s[0] >= end:
            out.append(s)
            end = s[1]
    return out


def _odd_names(text: str) -> list[tuple[int, int, str]]:
    """Names in capitals or, after a title, in small letters."""
    out = []
    titled = any(t in text for t in _HAS_TITLE)
    for m in _CAPITALS.finditer(text) if titled or _HAS_CAPITALS.search(text) else ():
        title = _BY_TITLE.get((m["title"] or "").rstrip(".").lower())
        words = re.split("[  ]", m["names"])
        if title or m["first"].capitalize() in _GENDER and len(words) > 1:
            out.append((*m.span("names"), "person" + _gender_of(title)))
        elif m["title"] and m["title"].capitalize() in _GENDER:  # the first word taken for a title is the given name
            out.append((m.start("title"), m.end("names"), "person"))
    for m in _SMALL.finditer(text) if titled else ():
        if m["first"] in _NO_NAME:
            continue
        end = m.end("second") if m["second"] and m["first"].capitalize() in _GENDER and m["second"] not in _NO_NAME else m.end("first")
        out.append((m.start("first"), end, "person" + _gender_of(_BY_TITLE.get(m["title"].rstrip(".").lower()))))
    return out


def _is_ip6(s: str) -> bool:
    try:
        ipaddress.IPv6Address(s)
    except ValueError:
        return False
    # Names in programs look like short ones (a::b).
    return len(re.findall("[0-9A-Fa-f]", s)) >= 4 and any(c.isdigit() for c in s)


def _gender_of(title: str | None) -> str:
    return next((":" + g for g, ts in TITLES.items() if g and title in ts), "")


# ---- the keyed permutation -------------------------------------------------------------------


def permute(x: int, size: int, key: bytes, tweak: str) -> int:
    """A keyed permutation of range(size)."""
    if size < 2:
        return x
    a = 1
    while a * a < size:
        a *= 2
    b = -(-size // a)
    while True:  # cycle walking: a * b may be a little larger than size
        left, right = divmod(x, b)
        for r in range(8):
            h = hmac.new(key, f"{tweak}|{size}|{r}|{right if r % 2 == 0 else left}".encode(), hashlib.sha256).digest()
            v = int.from_bytes(h[:16], "big")
            if r % 2 == 0:
                left = (left + v) % a
            else:
                right = (right + v) % b
        x = left * b + right
        if x < size:
            return x


@lru_cache(maxsize=65536)
def _alphabet(c: str, hexa: bool, listed: bool = False) -> str:
    """The characters that may stand for c: of its script, case and kind; ``listed``: "" for a letter outside the alphabets below."""
    if hexa and c in "0123456789abcdef":
        return "0123456789abcdef"
    if c.isdecimal():
        zero = ord(c) - unicodedata.decimal(c)
        return "".join(map(chr, range(zero, zero + 10)))
    if not c.isalpha() or c == "ς":  # which only ends words
        return c
    name = unicodedata.name(c, "")
    script = name.split(" ")[0].lower()
    if script in _VOWELS:
        letters = {"latin": "abcdefghijklmnopqrstuvwxyz", "cyrillic": "абвгдеёжзийклмнопрстуфхцчшщъыьэюя", "greek": "αβγδεζηθικλμνξοπρστυφχψω"}[script]
        low = c.lower()
        if low in letters:
            vowel = low in _VOWELS[script]
            got = "".join(x for x in letters if (x in _VOWELS[script]) == vowel)
        else:  # accented letters among themselves
            got = {"latin": "àâäáãéèêëíìîïóòôöõúùûüýÿ" if unicodedata.normalize("NFD", low)[0] in "aeiouy" else "çñßšžćčłńśźż", "greek": "άέήίόύώ", "cyrillic": low}[script]
        if not c.islower():
            got = "".join(x for x in (y.upper() for y in got) if len(x) == 1)
        return got if c in got else "" if listed else _others(c)
    code = ord(c)
    for lo, hi in ((0x4E00, 0x9FA5), (0x3041, 0x3096), (0x30A1, 0x30FA), (0xAC00, 0xD7A3), (0x0621, 0x064A), (0x05D0, 0x05EA)):
        if lo <= code <= hi:
            return "".join(map(chr, range(lo, hi + 1)))
    return "" if listed else _others(c)


def _others(c: str) -> str:
    """The letters of c's script and category in its 4096 code points that have no alphabet of their own above."""
    return _block(ord(c) >> 12, unicodedata.name(c, "").split(" ")[0], unicodedata.category(c)) or c


@lru_cache(maxsize=4096)
def _block(at: int, script: str, category: str) -> str:
    near = map(chr, range(at << 12, (at + 1) << 12))
    same = (x for x in near if x.isalpha() and unicodedata.category(x) == category and unicodedata.name(x, "").split(" ")[0] == script)
    return "".join(x for x in same if not _alphabet(x, False, True))


def _spell(value: str, key: bytes, tweak: str, hexa: bool = False) -> str:
    """The permuted string of the same form."""
    abc = [_alphabet(c, hexa) for c in value]
    x = size = 0
    size = 1
    for c, a in zip(value, abc, strict=True):
        x, size = x * len(a) + a.index(c), size * len(a)
    form = "".join(a[0] if len(a) > 1 else c for c, a in zip(value, abc, strict=True))
    x = permute(x, size, key, f"{tweak}|{form}")
    out = []
    for a in reversed(abc):
        x, i = divmod(x, len(a))
        out.append(a[i])
    return "".join(reversed(out))


def _walk(value: str, key: bytes, tweak: str, ok, hexa: bool = False) -> str:
    """Permuted until it is of the wanted sort again, as the original is: still one to one."""
    out = _spell(value, key, tweak, hexa)
    while not ok(out):
        out = _spell(out, key, tweak, hexa)
    return out


def _luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _longer(value: str, attempt: int, hexa: bool = False, filler: str = "x") -> str:
    """``value`` with as many characters more as the attempt asks for, of the sort of its last free one."""
    free = [c for c in value if len(_alphabet(c, hexa)) > 1]
    return value + (free or [filler])[-1] * max(attempt - MAX_ROUNDS + 1, 0 if free else attempt)


def surrogate(kind: str, value: str, key: bytes, attempt: int = 0) -> str:
    t = f"{kind.partition(':')[0]}|{attempt}"
    more = max(attempt - MAX_ROUNDS + 1, 0)
    if kind == "email":
        local, _, domain = value.rpartition("@")
        host, _, tld = domain.rpartition(".")
        return f"{_spell(_longer(local, attempt), key, t)}@{_spell(host, key, t + '|host')}.{tld}"
    if kind == "card":
        only = re.compile(r"\D")
        valid = _luhn(only.sub("", value))
        lead = value[0] == "0"
        ok = lambda s: _luhn(only.sub("", s)) == valid and (s[0] == "0") == lead
        if more:
            value = next(v for d in "0123456789" if ok(v := value + "0" * (more - 1) + d))
        return _walk(value, key, t, ok)
    if kind == "ip":
        n = int.from_bytes(bytes(map(int, value.split("."))), "big")
        if more:  # IPv4 has no longer form: an IPv6 address of the documentation range
            return "2001:db8:" + ":".join(re.findall("....", f"{permute(n, 1 << 96, key, t):024x}"))
        return ".".join(map(str, permute(n, 1 << 32, key, t).to_bytes(4, "big")))
    if kind == "ip6":
        n = permute(int(ipaddress.IPv6Address(value)), 1 << 128, key, t)
        return ipaddress.IPv6Address(n).exploded if more == 0 else f"{ipaddress.IPv6Address(n).exploded}%{more}"
    if kind == "phone":
        m = re.match(r"\+\d{1,3}(?=[ .(-])|\+\d\d?", value)
        head = m[0] if m else ""
        rest = value[len(head) :]
        zero = rest.lstrip(" (.-")[:1] == "0"
        return head + _walk(_longer(rest, attempt), key, t + head, lambda s: (s.lstrip(" (.-")[:1] == "0") == zero)
    if kind in ("secret", "iban", "ssn"):
        head = value[:2] if kind == "iban" else (re.match(r"(?:sk|pk|ghp|gho|xox[abp]|AKIA|eyJ)[-_]?", value) or [""])[0] if kind == "secret" else ""
        rest = value[len(head) :]
        hexa = kind == "secret" and re.fullmatch(r"[0-9a-f]+", rest) is not None
        return head + _spell(_longer(rest, attempt, hexa), key, t, hexa=hexa)
    # A part of a name.
    if kind in ("listed", "alone"):
        if value not in _GENDER:  # in capitals or small letters
            new = surrogate(kind, value.capitalize(), key, attempt)
            return new.upper() if value.isupper() else new.lower()
        names = GIVEN[_GENDER[value]]
        cycle = [names[permute(i, len(names), key, f"given|{_GENDER[value]}")] for i in range(len(names))]
        return cycle[(cycle.index(value) + 1) % len(names)]
    if kind.startswith("given:"):
        names = GIVEN[tuple(kind.split(":")[1:])]
        x = int.from_bytes(hmac.new(key, f"{kind}|{attempt}|{value}".encode(), hashlib.sha256).digest(), "big")
        out = []
        for _ in range(2 + attempt // 3):
            x, i = divmod(x, len(names))
            out.append(names[i])
        return "-".join(out)
    return _spell(_longer(value, attempt), key, f"{kind}|{attempt}")


def pieces(kind: str, value: str) -> list[tuple[str, str]]:
    """The parts of an entity that have surrogates of their own: (kind, value); kind "" for what stays."""
    if not kind.startswith("person"):
        return [(kind, value)]
    gender = kind.partition(":")[2]
    parts = re.split(r"([  ])", value)
    out, last = [], len(parts) - 1
    for i, p in enumerate(parts):
        if i % 2:
            out.append(("", p))
        elif (p in _GENDER or (p.isupper() or p.islower()) and p.capitalize() in _GENDER) and i < last:
            out.append(("listed", p))
        elif p in _GENDER and last == 0:
            out.append(("alone" if gender in ("", _GENDER[p][0]) else "surname", p))
        elif i == 0 < last:
            script = unicodedata.name(p[0], "").split(" ")[0].lower()
            out.append((f"given:{gender}:{script}" if (gender, script) in GIVEN else "given", p))
        else:
            out.append(("surname", p))
    return out


def _canonical(kind: str) -> str:
    return kind.partition(":")[0]


# ---- the corpus ------------------------------------------------------------------------------------


def mentions(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(h, kind, value): the entities of every text, by its hash; persons by their parts.  Each text is searched once for it."""

    def run(batches):
        for b in batches:
            rows = set()
            for h, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if t:
                    rows.update((h, *x) for s, e, k in find(t) for x in pieces(k, t[s:e]) if x[0] not in ("", "listed"))
            rows = sorted(rows)
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), *[pa.array([r[i] for r in rows], pa.string()) for i in (1, 2)]], names=["h", "kind", "value"])

    return docs.select(F.xxhash64(col(text_col)).alias("h"), col(text_col).alias("text")).mapInArrow(run, "h long, kind string, value string")


def entities(found: DataFrame, key: bytes) -> DataFrame:
    """(kind, value, attempt, surrogate): the distinct entities of ``mentions`` with their first surrogate."""
    return _keyed(found.select("kind", "value").distinct().withColumn("attempt", F.lit(0)), key)


def _keyed(rows: DataFrame, key: bytes) -> DataFrame:
    def run(batches):
        for b in batches:
            k, v, a = (b.column(i).to_pylist() for i in range(3))
            made = [surrogate(x, y, key, z) for x, y, z in zip(k, v, a, strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(made, pa.string())], names=["kind", "value", "attempt", "surrogate"])

    return rows.select("kind", "value", "attempt").mapInArrow(run, "kind string, value string, attempt int, surrogate string")


def settle(found: DataFrame, key: bytes) -> DataFrame:
    """The entities whose surrogate is not the first one: (kind, value, surrogate)."""
    cur = table(found, "pii")
    changed = None
    listed = found.sparkSession.createDataFrame([("name", n, n, 1) for n in sorted(_GENDER)], "sort string, s string, least string, real int")
    given = F.col("kind").startswith("given")
    while True:
        rows = cur.where("kind <> 'alone'").withColumns(
            {"sort": F.when(given | (F.col("kind") == "surname"), "name").otherwise(F.col("kind")), "who": F.concat_ws("\n", "value", "kind")}
        )
        taken = rows.select("sort", F.col("surrogate").alias("s"), F.col("who").alias("least"), F.lit(0).alias("real")).unionByName(
            rows.select("sort", F.col("value").alias("s"), F.col("who").alias("least"), F.lit(1).alias("real"))
        )
        clash = taken.unionByName(listed).groupBy("sort", "s").agg(F.count("*").alias("n"), F.max("real").alias("real"), F.min("least").alias("least")).where("n > 1")
        clash = table(clash, "pii")
        bad = rows.join(clash.withColumnRenamed("s", "surrogate"), ["sort", "surrogate"]).where("real = 1 or who <> least")
        bad = table(_keyed(bad.select("kind", "value", (F.col("attempt") + 1).alias("attempt")), key), "pii")
        if not bad.head(1):
            break
        keep = cur.join(bad.select("kind", "value"), ["kind", "value"], "left_anti")
        cur = table(keep.unionByName(bad), "pii")
        changed = True
    # Parts that the corpus has as surnames too are those surnames.
    surnames = cur.where("kind = 'surname'").select("value", F.col("surrogate").alias("s"))
    same = table(cur.where(given | (F.col("kind") == "alone")).join(surnames, "value").select("kind", "value", F.col("s").alias("surrogate")), "pii")
    rest = (cur if changed else cur.limit(0)).where("attempt > 0").join(same.select("kind", "value"), ["kind", "value"], "left_anti")
    return table(rest.select("kind", "value", "surrogate").unionByName(same), "pii")


def replace(docs: DataFrame, key: bytes, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with the entities in ``text_col`` replaced; adds n_entities and kinds (a sorted list)."""
    cols = [c for c in docs.columns if c not in ("n_entities", "kinds")]
    src = docs.select(*columns(docs, "n_entities", "kinds"))
    with scratch() as keep:
        found = table(mentions(docs, text_col), "pii")
        special = settle(entities(found, key), key)
        if special.head(1):
            # Only rows whose text holds a re-keyed entity get a map of exceptions.
            maps = found.distinct().join(special, ["kind", "value"]).groupBy(F.col("h").alias("__pii_d")).agg(F.map_from_entries(F.collect_set(F.struct(F.concat("kind", F.lit("\n"), "value"), "surrogate"))).alias("__pii_m"))
            maps = keep(table(maps, "pii"))
            src = src.withColumn("__pii_h", F.xxhash64(col(text_col))).join(maps, F.col("__pii_h") == F.col("__pii_d"), "left").drop("__pii_h", "__pii_d")
        else:
            src = src.withColumn("__pii_m", F.lit(None).cast("map<string,string>"))
    at = cols.index(text_col)

    def run(batches):
        made: dict = {}
        for b in batches:
            texts, counts, kinds = [], [], []
            for t, m in zip(b.column(at).to_pylist(), b.column(len(cols)).to_pylist(), strict=True):
                spans = find(t) if t else []
                out, end = [], 0
                other = dict(m) if m else {}
                for s, e, k in spans:
                    out.append(t[end:s])
                    for kind, v in pieces(k, t[s:e]):
                        new = other.get(f"{kind}\n{v}") if kind else v
                        if new is None:
                            if len(made) > 100_000:
                                made.clear()
                            new = made.get((kind, v))
                            if new is None:
                                new = made[kind, v] = surrogate(kind, v, key)
                        out.append(new)
                    end = e
                texts.append("".join([*out, t[end:]]) if spans else t)
                counts.append(len(spans))
                kinds.append(sorted({_canonical(k) for _, _, k in spans}))
            arrays = [pa.array(texts, pa.string()) if i == at else b.column(i) for i in range(len(cols))]
            yield pa.RecordBatch.from_arrays([*arrays, pa.array(counts, pa.int64()), pa.array(kinds, pa.list_(pa.string()))], names=[*cols, "n_entities", "kinds"])

    more = [T.StructField("n_entities", T.LongType()), T.StructField("kinds", T.ArrayType(T.StringType()))]
    return map_arrow(src, run, T.StructType([docs.schema[c] for c in cols] + more))


#: The query's key; a real run takes its own from configuration.
DEMO_KEY = b"replace this key"


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return replace(docs, DEMO_KEY).select("doc_id", "n_entities", F.array_join("kinds", ",").alias("kinds"), "text")
