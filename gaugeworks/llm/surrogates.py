"""Personal data: surrogate generation.

Detected entities (e-mail addresses, telephone, card, account and social security
numbers, IP and hardware addresses, access keys, stated passwords, titled person
names) are replaced by keyed surrogates of the same kind and format.

* Coded entities.  The letters and digits of the canonical form (case, blanks and
  punctuation aside), each in its class (digits, small or capital letters of its
  script), are permuted by a keyed Feistel network over two interleaved halves, whose
  keystream is as long as the half.  So every character depends on all others, the
  same entity has the same surrogate everywhere, in whatever spelling, and two
  entities cannot share one.  Valid card and account numbers stay valid, invalid ones
  invalid; addresses stay public or private; case and punctuation follow each spelling.
* Names.  Given and family names are replaced word by word, so "Mr. John Smith" and
  "Mr. Smith" stay one person: a name of the same script, of the title's gender, with
  the same letter case, spelled from keyed syllables; in a script without a list of
  syllables here, from letters of its own.
* Collision checks.  All distinct entities form one table with their surrogates.
  Where entities share a surrogate, or a surrogate is itself an entity of the corpus,
  all but the first get the surrogate of the next attempt, until nothing collides.
  Names, secrets, keys and e-mail addresses get longer with the attempts, so they do
  not run out.  The other kinds have formats of fixed length: one that is still not
  settled after `Params.attempts` is too full to avoid its own entities.  Its entities
  all take their first surrogates, which differ from each other and, after an exchange
  of those that are their own, from the entity.  Anything left raises an error.
  These exceptions are broadcast up to `Params.exceptions` rows, and beyond that
  joined to the documents that they occur in.

Rows: null text stays null, text without entities is unchanged, and so are all other
columns.  Entities do not span lines.  A line or an entity of any length is taken
whole.  A stated password without a letter or digit (a mask) is no entity.  Letter
case is folded character by character.  Repeated rows and null ids are
treated like any other row.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

from . import common


@dataclass(frozen=True)
class Params:
    key: bytes = b"gaugeworks"  #: the secret that surrogates depend on
    attempts: int = 12
    exceptions: int = 100_000  #: largest table of exceptions that is broadcast


#: Titles before a person's name, by gender.
TITLES = {
    "m": ("Mr", "Mister", "Sir", "Herr", "Herrn", "Monsieur", "Señor", "Don", "Signor", "Господин", "г-н"),
    "f": ("Mrs", "Ms", "Miss", "Madam", "Frau", "Madame", "Mme", "Mlle", "Señora", "Señorita", "Doña", "Signora", "Госпожа", "г-жа"),
    "n": ("Dr", "Prof", "Professor", "Doctor"),
}
_GENDER = {t: g for g, ts in TITLES.items() for t in ts}
_TITLE = "|".join(sorted(_GENDER, key=len, reverse=True))
_NAME = r"[^\W\d_a-zà-öø-ÿа-яё][^\W\d_]*(?:[-'’][^\W\d_]+)*"
_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"

#: The kinds in order of precedence; of each, the group x is what is replaced.
PATTERNS = {
    "email": r"(?<![\w.%+-])(?P<x>[\w.%+-]*[\w%+-]@[\w-]+(?:\.[\w-]+)+)",
    "secret": r"(?i:pass(?:word|wd)?|pwd|secret|token|api[_-]?key)\s*[=:]\s*[\"']?(?P<x>(?=[^\s\"',;]*[^\W_])[^\s\"',;]{4,})",
    "key": r"(?<!\w)(?P<x>(?:AKIA|ASIA)[A-Z0-9]{16}|gh[pousr]_[A-Za-z0-9]{30,}|sk[-_][A-Za-z0-9_-]{20,}|xox[abp]-[A-Za-z0-9-]{10,})(?!\w)",
    "iban": r"(?<!\w)(?P<x>[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?)(?!\w)",
    "mac": r"(?<![\w:])(?P<x>[0-9A-Fa-f]{2}(?:[:-][0-9A-Fa-f]{2}){5})(?![\w:])",
    "ip": rf"(?<![\w.])(?P<x>{_OCTET}(?:\.{_OCTET}){{3}})(?!\w|\.\d)",
    "phone": r"(?<![\w+])(?P<x>\+\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d{2,4}(?:[ .-]?\d{2,4}){1,4}|\(\d{3}\) ?\d{3}[-. ]\d{4}|\d{3}[-.]\d{3}[-.]\d{4})(?!\w)",
    "ssn": r"(?<![\w-])(?P<x>\d{3}-\d{2}-\d{4})(?![\w-])",
    "card": r"(?<![\w.])(?P<x>\d(?:[ -]?\d){12,18})(?!\w)",
    "person": rf"(?<!\w)(?P<t>{_TITLE})(?!\w)\.? +(?P<x>{_NAME}(?: +{_NAME}){{0,2}})",
}
_ONE = {k: re.compile(v) for k, v in PATTERNS.items()}
_LINE = re.compile(rf"[\d@]|(?i:pass|pwd|secret|token|api[_-]?key)\w*\s*[=:]|(?:{_TITLE})\.? ")
_DIGIT = re.compile(r"\d")
_NUMBERED = ("mac", "ip", "phone", "ssn", "card", "iban")


@dataclass(frozen=True)
class Found:
    start: int
    end: int
    kind: str
    canonical: str  #: what the surrogate depends on


def fold(x: str) -> str:
    """Small letters, of as many characters as `x` has."""
    low = x.lower()
    return low if len(low) == len(x) else "".join(c.lower()[0] for c in x)


def _capital(c: str) -> str:
    up = c.upper()
    return up if len(up) == 1 else c


def canonical(kind: str, x: str) -> str:
    """One form for all spellings of an entity."""
    if kind == "phone":
        digits = re.sub(r"\D", "", x)
        return digits[1:] if len(digits) == 11 and digits[0] == "1" else digits
    if kind in ("card", "ssn", "mac", "iban"):
        return fold(re.sub(r"\W", "", x))
    return fold(x) if kind in ("email", "person") else x


def _names(x: str, at: int, gender: str) -> Iterator[Found]:
    """Each word of a person's name: family name last, given names by gender."""
    words = list(re.finditer(r"[^\s'’-]+", x))
    last = max(m.start() for m in re.finditer(r"\S+", x))
    for m in words:
        kind = "family" if m.start() >= last else f"given-{gender}"
        yield Found(at + m.start(), at + m.end(), kind, fold(m.group()))


def detect(text: str) -> list[Found]:
    """The entities of a text, from left to right, without overlaps."""
    out: list[Found] = []
    if not _LINE.search(text):
        return out
    at = 0
    for line in text.split("\n"):
        if _LINE.search(line):
            taken, numbered = bytearray(len(line)), _DIGIT.search(line)
            for kind, pattern in _ONE.items():
                if kind in _NUMBERED and not numbered or kind == "email" and "@" not in line:
                    continue
                for m in pattern.finditer(line):
                    a, b = m.span("x")
                    if any(taken[a:b]):
                        continue
                    taken[a:b] = b"\1" * (b - a)
                    if kind == "person":
                        out += _names(m["x"], at + a, _GENDER[m["t"]])
                    else:
                        out.append(Found(at + a, at + b, kind, canonical(kind, m["x"])))
        at += len(line) + 1
    return sorted(out, key=lambda f: f.start)


def _hash(key: bytes, *parts: object) -> int:
    said = "\0".join(map(str, parts)).encode("utf-8", "surrogatepass")
    return int.from_bytes(hashlib.blake2b(said, key=key[:64], digest_size=16).digest(), "big")


def permute(key: bytes, tweak: str, value: int, size: int) -> int:
    """A keyed permutation of 0 .. size - 1, size up to 2**256: Feistel rounds, walked
    until in range."""
    half = max(1, (max(size - 1, 1).bit_length() + 1) // 2)
    mask = (1 << half) - 1
    while True:
        a, b = value >> half, value & mask
        for r in range(8):
            a, b = b, a ^ (_hash(key, tweak, half, r, b) & mask)
        value = a << half | b
        if value < size:
            return value


_DIGITS, _SMALL, _CAPITAL = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_HEX = _DIGITS + "abcdef"
_ROUNDS = 10


@lru_cache(4096)
def _alphabet(c: str) -> str:
    """The class of a character: digits, small or capital letters; beyond ASCII those of
    its script among the 256 code points around it.  Empty for all others."""
    if c < "\x80":
        return next((a for a in (_DIGITS, _SMALL, _CAPITAL) if c in a), "")
    kind = unicodedata.category(c)
    if kind not in ("Lu", "Ll", "Lt", "Lo", "Nd"):
        return ""
    of = lambda x: unicodedata.name(x, " ").split()[0]
    near = (chr(k) for k in range(ord(c) & ~255, (ord(c) | 255) + 1))
    return "".join(x for x in near if unicodedata.category(x) == kind and of(x) == of(c) and len(x.lower()) == len(x.upper()) == 1)


def coded(key: bytes, tweak: str, text: str, alphabet=_alphabet) -> str:
    """A permutation of the texts of one format: each character stays in its class,
    those without a class (of two or more) stay as they are."""
    of = [a if c in (a := alphabet(c)) and len(a) > 1 else "" for c in text]
    free = [k for k, a in enumerate(of) if a]
    if not free:
        return text
    form = hashlib.blake2b("\0".join(a[0] if a else f"={c}" for c, a in zip(text, of, strict=True)).encode("utf-8", "surrogatepass"), digest_size=16).digest()
    sides = [[of[k].index(text[k]) for k in free[s::2]] for s in (0, 1)]
    sizes = [[len(of[k]) for k in free[s::2]] for s in (0, 1)]
    for r in range(_ROUNDS):
        this, other = sides[r % 2], sides[1 - r % 2]
        said = b"".join(x.to_bytes(2, "big") for x in other)
        seed = hashlib.blake2b(b"%d|%b|%b|%b" % (r, tweak.encode("utf-8", "surrogatepass"), form, said), key=key[:64]).digest()
        stream = seed if 4 * len(this) <= len(seed) else hashlib.shake_256(seed).digest(4 * len(this))
        sides[r % 2] = [(x + int.from_bytes(stream[4 * k : 4 * k + 4], "big")) % n for k, (x, n) in enumerate(zip(this, sizes[r % 2], strict=True))]
    out = list(text)
    for s in (0, 1):
        for k, x in zip(free[s::2], sides[s], strict=True):
            out[k] = of[k][x]
    return "".join(out)


def _walk(step, start: str, keeps) -> str:
    """The next text on the permutation's cycle that has the property of the first."""
    x = step(start)
    while keeps(x) != keeps(start):
        x = step(x)
    return x


def luhn(digits: str) -> bool:
    total = sum(int(d) if k % 2 == 0 else sum(divmod(2 * int(d), 10)) for k, d in enumerate(reversed(digits)))
    return total % 10 == 0


def _iban_number(bban: str, country: str) -> int:
    return int("".join(str(int(c, 36)) for c in f"{bban}{country}00"))


def _address(ip: str) -> tuple:
    """What an address keeps: private, loopback and the like, or public."""
    a, b = (int(x) for x in ip.split(".")[:2])
    special = a in (0, 10, 127) or a >= 224 or (a == 172 and 16 <= b < 32) or (a, b) in ((192, 168), (169, 254))
    return (a if a in (10, 127, 0) else (a, b) if special and a < 224 else 224 if special else -1,)


#: By script, syllables of names, and the endings of male and female given names.
_SYLLABLES = {
    "LATIN": ("ba be bi bo da de di do fa fe ga ge ha he ja jo ka ke ki ko la le li lo ma me mi mo na ne ni no pa pe ra re ri ro sa se si so ta te ti to va ve vi wa wi za", "n l r s", "a"),
    "CYRILLIC": ("ба бе би бо ва ве ви во га да де ди до за зе ка ке ки ко ла ле ли ло ма ме ми мо на не ни но па пе ра ре ри ро са се си со та те ти то фа ха", "н л р с", "а"),
    "GREEK": ("βα βε βι βο γα δα δε δι δο ζα θα θε κα κε κι κο λα λε λι λο μα με μι μο να νε νι νο πα πε ρα ρε ρι ρο σα σε σι σο τα τε τι το φα φι χα", "ν λ ρ ς", "α"),
    "HEBREW": ("בא בי גו גל דו די הד חי טל יו כר לי לו מא מי נו נע סי עו פי צו קו רו רי שי תו", "ן ל ם ר", "ה"),
    "ARABIC": ("با بي جا حا خا دا را زا سا سي شا صا طا عا فا كا لا ما مي نا ني ها وا يا", "ن ل ر د", "ة"),
    "DEVANAGARI": ("का कि गा गी चा जा जि ता ति दा दि ना नि पा पि बा मा मि या रा रि ला लि वा वि शा सा सि हा", "न ल र श", "ी"),
    "GEORGIAN": ("ბა გა გი და დი ვა ზა თა კა ლა ლი მა მი ნა ნი პა რა რი სა სი ტა ფა შა ჩა ხა", "ძე ლ ნ რ", "ო"),
    "ARMENIAN": ("բա գա դա դի զա թա կա կի լա լի մա մի նա նի պա ռա սա սի տա տի փա շա", "ն կ մ ր", "ա"),
    "CJK": ("王 李 张 刘 陈 杨 赵 黄 周 吴 徐 孙 胡 朱 高 林 何 郭 马 罗 梁 宋 郑 谢 韩 唐 冯 于 董 萧 程 曹 袁 邓 许 傅 沈 曾 彭 吕", "伟 强 军 勇 涛 杰 明 刚", "芳 娜 静 丽 艳 娟 霞 敏"),
    "HANGUL": ("김 이 박 최 정 강 조 윤 장 임 한 오 서 신 권 황 안 송 류 홍 민 지 현 도 하 유 은 수", "준 호 훈 석", "희 영 미 아"),
    "HIRAGANA": ("あ い う え お か き く こ さ し す た ち な の は ひ ま み も や ゆ よ ら り る わ", "た ろ と お", "こ み か え"),
    "KATAKANA": ("ア イ エ オ カ キ ク コ サ シ ス タ チ ナ ノ ハ ヒ マ ミ モ ヤ ユ ヨ ラ リ ル ワ", "ト ロ ス ン", "コ ミ カ ナ"),
}
#: Scripts in which a syllable is a character: a name has as many as the entity.
_CHARACTERS = ("CJK", "HANGUL", "HIRAGANA", "KATAKANA")

#: Attempts after which a name gets one syllable more, and a text of free length eight letters.
_LONGER_NAME, _LONGER = 2, 2


def script(word: str) -> str:
    return unicodedata.name(max(word, default="a"), " ").split()[0]


def name(key: bytes, attempt: int, kind: str, word: str) -> str:
    """A lower-case name of the word's script; a given name ends as its gender asks."""
    where, tweak, longer = script(word), f"{kind}|{attempt}", attempt // _LONGER_NAME
    if where not in _SYLLABLES:
        return coded(key, tweak, word + word[-1:] * longer)
    syllables, male, female = (x.split() for x in _SYLLABLES[where])
    h, out = _hash(key, tweak, "given" if kind[:5] == "given" else kind, word), ""
    gendered, by_character = kind in ("given-m", "given-f"), where in _CHARACTERS
    ending = {"given-f": female, "given-n": [""], "family": [""] if by_character else male}.get(kind, male)
    for _ in range((max(1, len(word) - gendered) if by_character else 3 if len(word) < 8 else 4) + longer):
        h, k = divmod(h, len(syllables))
        out += syllables[k]
    if kind == "given-f" and not by_character:
        out = out[:-1]
    return out + ending[h % len(ending)]


def surrogate(key: bytes, kind: str, x: str, attempt: int = 0) -> str:
    """The surrogate of a canonical entity."""
    tweak = f"{kind}|{attempt}"
    # a text of free length without a letter or digit of its own gets some at once
    bare = kind in ("secret", "key", "email") and not any(map(_alphabet, x.partition("@")[0] if kind == "email" else x))
    more = "a" * (8 * (attempt // _LONGER + bare))
    if kind == "family" or kind.startswith("given"):
        return name(key, attempt, kind, x)
    if kind == "card":
        return _walk(lambda s: s[0] + coded(key, tweak, s[1:]), x, luhn)
    if kind == "ip":

        def step(s: str) -> str:
            value = permute(key, tweak, int.from_bytes(bytes(map(int, s.split("."))), "big"), 1 << 32)
            return ".".join(map(str, value.to_bytes(4, "big")))

        # within a small special range only the free bytes are permuted
        return _walk(step, x, _address) if _address(x) == (-1,) else _low(key, tweak, x)
    if kind == "iban":
        country, check, bban = x[:2].upper(), x[2:4], x[4:].upper()
        out = coded(key, tweak + country, bban)
        valid = (_iban_number(bban, country) + int(check)) % 97 == 1
        return (country + (f"{98 - _iban_number(out, country) % 97:02d}" if valid else coded(key, tweak, check)) + out).lower()
    if kind == "phone":
        return _walk(lambda s: coded(key, tweak, s), x, lambda s: s[0] in "01")
    if kind == "mac":
        return coded(key, tweak, x, lambda c: _HEX)
    if kind == "email":
        local, _, domain = x.partition("@")
        head, _, top = domain.rpartition(".")
        return f"{coded(key, tweak, f'{local}{more}@{head}')}.{top}"
    if kind == "key":
        n = len(re.match(r"AKIA|ASIA|gh[pousr]_|sk[-_]|xox[abp]-", x).group())
        return x[:n] + coded(key, tweak, x[n:] + more)
    return coded(key, tweak, x + more if kind == "secret" else x)


def _low(key: bytes, tweak: str, ip: str) -> str:
    """A special address with its free bytes permuted: three behind 0, 10 and 127, else two."""
    octets = list(map(int, ip.split(".")))
    n = 1 if octets[0] in (0, 10, 127) else 2
    value = permute(key, f"{tweak}|{octets[:n]}", int.from_bytes(bytes(octets[n:]), "big"), 1 << (8 * (4 - n)))
    return ".".join(map(str, octets[:n] + list(value.to_bytes(4 - n, "big"))))


def dressed(kind: str, spelled: str, form: str, given: str) -> str:
    """The surrogate `given` of the canonical `form` in the spelling of the entity."""
    if kind == "family" or kind.startswith("given"):
        return given.upper() if spelled.isupper() and len(spelled) > 1 else given[:1].upper() + given[1:] if spelled[:1].isupper() else given
    if kind == "ip" or len(given) != len(form):
        return given
    if kind == "phone":
        skip = sum(c.isdigit() for c in spelled) - len(form)
        source = iter(given)
        return "".join(c if not c.isdigit() or (skip := skip - 1) >= 0 else next(source) for c in spelled)
    if kind in ("card", "ssn", "mac", "iban"):
        source = iter(given)
        return "".join((_capital(y) if c.isupper() or (kind == "iban") else y) if c.isalnum() and (y := next(source)) else c for c in spelled)
    return "".join(_capital(y) if c.isupper() else y for c, y in zip(spelled, given, strict=True)) if kind == "email" else given


_ENTITY = "kind string, entity string"


def _list(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in common.slices(batches, "text"):
        found = {(f.kind, f.canonical) for t in batch.column("text") for f in detect(t.as_py() or "")}
        rows = sorted(found)
        yield pa.record_batch([pa.array([r[k] for r in rows], pa.string()) for k in (0, 1)], names=["kind", "entity"])


def _give(batches: Iterator[pa.RecordBatch], key: bytes) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = batch.to_pylist()
        given = [surrogate(key, r["kind"], r["entity"], r["attempt"]) for r in rows]
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(given, pa.string())], names=[*batch.schema.names, "surrogate"])


#: Kinds with formats of fixed length, within which surrogates are permutations.
_FIXED = ("iban", "mac", "ip", "phone", "ssn", "card")


def format_of(kind: str, x: str) -> str:
    """What the surrogates of an entity of a fixed format have in common with it."""
    if kind == "mac":
        return kind
    return str(_address(x)) if kind == "ip" else re.sub("[a-z]", "a", re.sub("[0-9]", "0", x))


def _formats(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        form = [format_of(k, x) if k in _FIXED else "" for k, x in zip(*(batch.column(n).to_pylist() for n in ("kind", "entity")), strict=True)]
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(form, pa.string())], names=[*batch.schema.names, "form"])


def _full(table: DataFrame, clash: DataFrame, give, attempt: int) -> DataFrame:
    """`table` with the formats of `clash` settled: distinct surrogates, none its own
    entity.  `attempt` marks the rows that are not of the first attempt."""
    formed = lambda df: df.mapInArrow(_formats, f"{_ENTITY}, form string")
    full = formed(clash.select("kind", "entity")).where(F.col("kind").isin(*_FIXED)).select("kind", "form").distinct()
    inside = formed(table.select("kind", "entity")).join(full, ["kind", "form"])
    inside = common.stored(inside, "full")
    again = common.stored(give(inside.select("kind", "entity", F.lit(0).alias("attempt"))).join(inside, ["kind", "entity"]), "again")
    # entities that are their own surrogates exchange them, a single one with another entity
    own = again.where("entity = surrogate")
    rest = again.where("entity <> surrogate").groupBy("kind", "form").agg(F.min("entity").alias("entity"))
    single = own.groupBy("kind", "form").agg(F.count("*").alias("n")).where("n = 1").select("kind", "form")
    ring = own.select("kind", "form", "entity", "surrogate").unionByName(rest.join(single, ["kind", "form"]).join(again, ["kind", "form", "entity"]).select("kind", "form", "entity", "surrogate"))
    by = W.partitionBy("kind", "form").orderBy("entity")
    following = F.coalesce(F.lead("surrogate").over(by), F.first("surrogate").over(by))
    ring = ring.select("kind", "entity", following.alias("turned"))
    settled = again.join(ring, ["kind", "entity"], "left").select(
        "kind", "entity", F.when(F.col("turned").isNull(), 0).otherwise(attempt).alias("attempt"), F.coalesce("turned", "surrogate").alias("surrogate")
    )
    return table.join(inside.select("kind", "entity"), ["kind", "entity"], "left_anti").unionByName(settled)


def _class():
    """Kinds within which surrogates must differ: all given names are one."""
    return F.when(F.col("kind").startswith("given"), "given").otherwise(F.col("kind"))


def assign(docs: DataFrame, p: Params) -> DataFrame:
    """kind, entity, attempt, surrogate of every distinct entity, without collisions."""
    key = p.key
    entities = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(_list, _ENTITY).distinct()
    schema = f"{_ENTITY}, attempt int, surrogate string"
    give = lambda df: df.mapInArrow(lambda b: _give(b, key), schema)
    table = common.stored(give(entities.withColumn("attempt", F.lit(0))), "surrogates")
    real = common.stored(table.select(_class().alias("c"), F.col("entity").alias("surrogate")).distinct(), "entities")

    def clashes(table: DataFrame) -> tuple[DataFrame, DataFrame]:
        """The rows that share a surrogate with an earlier one, and whose surrogate is an entity."""
        named = table.withColumn("c", _class())
        shared = named.groupBy("c", "surrogate").agg(F.count("*").alias("n"), F.min(F.struct("attempt", "entity", "kind")).alias("first")).where("n > 1")
        shared = named.join(shared, ["c", "surrogate"]).where(F.struct("attempt", "entity", "kind") != F.col("first"))
        own = named.join(real, ["c", "surrogate"], "left_semi")
        return shared.select("kind", "entity", "attempt"), own.select("kind", "entity", "attempt")

    for k in range(p.attempts + 1):
        shared, own = clashes(table)
        clash = common.stored(shared.unionByName(own).distinct(), "clashes")
        if clash.isEmpty():
            return table
        if k < p.attempts:
            again = give(clash.withColumn("attempt", F.col("attempt") + 1))
            before, table = table, common.stored(table.join(clash.select("kind", "entity"), ["kind", "entity"], "left_anti").unionByName(again), "surrogates")
            common.forget(before)
    table = common.stored(_full(table, clash, give, p.attempts + 1), "surrogates")
    shared, own = clashes(table)
    left = shared.unionByName(own.where(~F.col("kind").isin(*_FIXED))).unionByName(table.where("entity = surrogate").select("kind", "entity", "attempt"))
    if not left.isEmpty():
        raise RuntimeError(f"surrogates collide after {p.attempts} attempts")
    return table


def _rewrite(batches: Iterator[pa.RecordBatch], key: bytes, sent, names: list[str], own_column: str) -> Iterator[pa.RecordBatch]:
    exceptions = sent.value
    known: dict[tuple, str] = {}

    def given(f: Found, own: dict) -> str:
        at = (f.kind, f.canonical)
        other = own.get(at) or exceptions.get(at)
        if other is not None:
            return other
        if at not in known:
            if len(known) > 100_000:
                known.clear()
            known[at] = surrogate(key, *at)
        return known[at]

    for batch in common.slices(batches, "text"):
        texts, counts, kinds = [], [], []
        others = batch.column(own_column).to_pylist() if own_column in batch.schema.names else [None] * batch.num_rows
        for text, own in zip((t.as_py() for t in batch.column("text")), others, strict=True):
            found = detect(text or "")
            if found:
                mine = {(o["kind"], o["entity"]): o["surrogate"] for o in own or []}
                parts, at = [], 0
                for f in found:
                    parts += [text[at : f.start], dressed(f.kind, text[f.start : f.end], f.canonical, given(f, mine))]
                    at = f.end
                text = "".join([*parts, text[at:]])
            texts.append(text)
            counts.append(len(found))
            kinds.append(" ".join(f"{k}:{n}" for k, n in sorted(Counter(f.kind for f in found).items())))
        columns = {c: batch.column(c) for c in batch.schema.names} | {"text": pa.array(texts, pa.string())}
        columns |= {"n_entities": pa.array(counts, pa.int64()), "entity_kinds": pa.array(kinds, pa.string())}
        yield pa.RecordBatch.from_arrays([columns[n] for n in names], names=names)


def _mentions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in common.slices(batches, "text"):
        rows = [(i.as_py(), *e) for i, t in zip(batch.column("row"), batch.column("text"), strict=True) for e in {(f.kind, f.canonical) for f in detect(t.as_py() or "")}]
        yield pa.record_batch([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.binary(), pa.string(), pa.string()))], names=["row", "kind", "entity"])


def replace(docs: DataFrame, p: Params = Params()) -> DataFrame:
    """All columns of `docs`, text with surrogates, and n_entities and entity_kinds
    (same-named columns of `docs` are replaced)."""
    spark, key = docs.sparkSession, p.key
    docs = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c.lower() not in ("n_entities", "entity_kinds")])
    docs = docs.withColumn("text", F.col("text").cast("string"))
    again = common.stored(assign(docs, p).where("attempt > 0").select("kind", "entity", "surrogate"), "exceptions")
    names = [*docs.columns, "n_entities", "entity_kinds"]
    schema = T.StructType([*docs.schema.fields, T.StructField("n_entities", T.LongType()), T.StructField("entity_kinds", T.StringType())])
    few = again.limit(p.exceptions + 1).toArrow().to_pylist()
    row, own_column = (common.unused(docs, c) for c in ("row", "own"))
    if len(few) > p.exceptions:
        docs = docs.withColumn(row, F.sha2(F.col("text").cast("binary"), 256).cast("binary"))
        own = docs.select(F.col(row).alias("row"), "text").mapInArrow(_mentions, f"row binary, {_ENTITY}").join(again, ["kind", "entity"])
        own = own.groupBy(F.col("row").alias(row)).agg(F.collect_set(F.struct("kind", "entity", "surrogate")).alias(own_column))
        docs, few = docs.join(own, row, "left").drop(row), []
    sent = spark.sparkContext.broadcast({(r["kind"], r["entity"]): r["surrogate"] for r in few})
    return docs.mapInArrow(lambda b: _rewrite(b, key, sent, names, own_column), schema)


def op8_pii_surrogates(spark, sf_dir: str) -> DataFrame:
    """The texts of `documents` with surrogates for personal data."""
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    return replace(docs).select("doc_id", "n_entities", "entity_kinds", "text")
