"""Surrogates for personal data: keyed replacements of the same type, gender, script and format.

A replacement is a keyed permutation within the entity's type and shape, so equal entities get equal surrogates in every
document and different ones stay different: digits become digits, letters become letters of the same script and case, vowels in
names become vowels, card numbers keep their check sum, addresses stay valid, names known as female or male become
other names of the same gender and script. A distributed check over all distinct entities proves that no two share a surrogate.
"""

from __future__ import annotations

import functools
import hashlib
import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches

# Given names by script and gender; a surrogate comes from the same list.
GIVEN = {
    ("latin", "f"): "Alice Anna Clara Diana Elena Emma Eva Grace Julia Laura Lucia Maria Nina Olivia Rosa Sarah Sofia Teresa".split(),
    ("latin", "m"): "Adam Carlos Daniel David Felix George Hans James John Luis Martin Michael Oscar Paul Peter Robert Simon Thomas".split(),
    ("cyrillic", "f"): "Анна Вера Дарья Елена Ирина Мария Нина Ольга Софья Татьяна".split(),
    ("cyrillic", "m"): "Антон Борис Виктор Иван Максим Николай Олег Павел Роман Сергей".split(),
    ("greek", "f"): "Αννα Ελενη Ειρηνη Μαρια Νικη Σοφια".split(),
    ("greek", "m"): "Αλεξης Γιωργος Ιωαννης Κωστας Νικος Πετρος".split(),
}
# Forms of address and honorifics before a name.
TITLES = "Mr Mrs Ms Miss Dr Prof Herr Frau Mme Mlle Monsieur Madame Señor Señora Sr Sra Don Doña".split()
# Alphabets whose letters stand for each other; in names, vowels and consonants keep apart.
VOWELS = ("aeiou", "AEIOU", "аеиоуыэюя", "АЕИОУЫЭЮЯ", "αεηιουω", "ΑΕΗΙΟΥΩ")
ALPHABETS = ("0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "абвгдежзийклмнопрстуфхцчшщъыьэюя", "АБВГДЕЖЗИЙКЛМНОПРСТУФХЦЧШЩЪЫЬЭЮЯ", "αβγδεζηθικλμνξοπρστυφχψω", "ΑΒΓΔΕΖΗΘΙΚΛΜΝΞΟΠΡΣΤΥΦΧΨΩ")
# Letters of further scripts, first and last: their words have no case and stand for each other letter by letter.
BLOCKS = ("\u05d0\u05ea", "\u0621\u063a", "\u0641\u064a", "\u0904\u0939", "\u0e01\u0e2e", "\u3041\u3096", "\u30a1\u30fa", "\u4e00\u9fa5", "\uac00\ud7a3")
ROUNDS = 10

_NAMES = "|".join(sorted((n for names in GIVEN.values() for n in names), key=len, reverse=True))
_WORD = r"[^\W\d_a-zа-яα-ω][^\W\d_]+(?:[-'’][^\W\d_]+)?"
ENTITY = re.compile(
    r"(?P<email>[\w.+%-]+@[\w-]+(?:\.[\w-]+)+)"
    r"|(?i:\b(?:token|secret|password|passwd|api[_-]?key|access[_-]?key)\b[\"']?\s*[=:]\s*[\"']?)(?P<secret>[\w/+-]{8,})"
    r"|(?P<hex>\b(?=[0-9a-fA-F]*[a-fA-F])(?=[0-9a-fA-F]*\d)[0-9a-fA-F]{32,}\b)"
    r"|(?P<ip>(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)\.){3}(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)(?!\d|\.\d))"
    r"|(?P<ssn>(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-]))"
    r"|(?P<phone>(?<![\w+])\+\d{1,3}(?:[ .-]?\(?\d{2,4}\)?){2,4}(?!\d)|(?<![\w.-])\(\d{2,4}\)[ .-]?\d{3,4}[ .-]?\d{3,4}(?!\d)|(?<![\w.-])\d{3}[.-]\d{3}[.-]\d{4}(?!\d))"
    r"|(?P<card>(?<![\d.-])\d(?:[ -]?\d){12,18}(?!\d))"
    rf"|(?P<name>\b(?:{'|'.join(TITLES)})\b\.? {_WORD}(?: {_WORD})?|\b(?:{_NAMES}) {_WORD})"
)
MAYBE = re.compile(rf"[\d@]|\b(?:{'|'.join(TITLES)})\b|\b(?:{_NAMES})\b|(?i:token|secret|passw|key)")


def shuffled(symbols: list[int], sizes: list[int], key: bytes, tweak: str) -> list[int]:
    """A keyed permutation of the strings whose symbol i is below ``sizes[i]``: halves take turns to shift each other."""
    n = len(symbols)
    if not n:
        return []
    half = n // 2
    s = list(symbols)
    for r in range(ROUNDS):
        mine, other = (range(half), range(half, n)) if r % 2 else (range(half, n), range(half))
        seed = f"{tweak}|{r}|{n}|{','.join(str(s[i]) for i in other)}".encode()
        stream = hashlib.shake_256(key + seed).digest(4 * len(mine))
        for j, i in enumerate(mine):
            s[i] = (s[i] + int.from_bytes(stream[4 * j : 4 * j + 4], "big")) % sizes[i]
    return s


@functools.cache
def _letters(block: str) -> str:
    return "".join(map(chr, range(ord(block[0]), ord(block[1]) + 1)))


def _block(c: str) -> str:
    return next((_letters(b) for b in BLOCKS if b[0] <= c <= b[1]), "")


def same_shape(text: str, alphabets: tuple[str, ...], key: bytes, kind: str) -> str:
    """``text`` with every character of an alphabet replaced by one of the same alphabet; the rest stays."""
    where = [next((a for a in alphabets if c in a), "") or (_block(c) if kind.startswith("name") else "") for c in text]
    mask = "".join("\0" if a else c for c, a in zip(text, where, strict=True)) + "|" + ",".join(a[:1] for a in where)
    at = [i for i, a in enumerate(where) if a]
    new = shuffled([where[i].index(text[i]) for i in at], [len(where[i]) for i in at], key, f"{kind}|{mask}")
    out = list(text)
    for i, x in zip(at, new, strict=True):
        out[i] = where[i][x]
    return "".join(out)


def _refill(text: str, digits: str) -> str:
    """``text`` with its digits, of whatever script, replaced by these in the same script."""
    left = iter(digits)
    return "".join(chr(ord(c) - unicodedata.decimal(c) + int(next(left))) if c.isdecimal() else c for c in text)


def _digits(text: str) -> str:
    return "".join(str(unicodedata.decimal(c)) for c in text if c.isdecimal())


def _check_digit(digits: str) -> int:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (2 if i % 2 == 0 else 1)
        total += d - 9 if d > 9 else d
    return -total % 10


NAME_ALPHABETS = tuple(x for a in ALPHABETS[1:] for x in ("".join(c for c in a if any(c in v for v in VOWELS)), "".join(c for c in a if not any(c in v for v in VOWELS))))
HEX = ("0123456789abcdef",)


def _given(word: str, key: bytes) -> str | None:
    for (script, gender), names in GIVEN.items():
        if word in names:
            order = sorted(names, key=lambda n: hashlib.blake2b(f"{script}|{gender}|{n}".encode(), key=key[:64]).digest())
            return order[(order.index(word) + 1) % len(order)]
    return None


def _name_part(word: str, key: bytes) -> str:
    """A known given name's successor in a keyed order of its list; else other letters, the last one kept as it often tells the gender."""
    return _given(word, key) or same_shape(word[:-1], NAME_ALPHABETS, key, f"name|{word[-1]}") + word[-1]


def canonical(kind: str, text: str) -> str:
    """What two mentions of one entity have in common: digits of numbers, lower case of mail addresses, the name without its title."""
    if kind in ("phone", "card", "ssn"):
        return ("+" if text.startswith("+") else "") + _digits(text)
    if kind == "email":
        return text.lower()
    if kind == "name":
        return " ".join(w for w in text.split() if w.rstrip(".") not in TITLES)
    return text


def surrogate(kind: str, text: str, key: bytes) -> str:
    if kind == "ip":
        return ".".join(map(str, shuffled([int(x) for x in text.split(".")], [256] * 4, key, "ip")))
    if kind == "card":
        d = _digits(text)
        body = same_shape(d[:-1], ALPHABETS[:1], key, f"card|{len(d)}")
        off = (int(d[-1]) - _check_digit(d[:-1])) % 10
        return _refill(text, body + str((_check_digit(body) + off) % 10))
    if kind in ("phone", "ssn"):
        d = _digits(text)
        kept = (1 if d[0] in "17" else 2) if text.startswith("+") else 0  # the country's code, however the rest is grouped
        return _refill(text, d[:kept] + same_shape(d[kept:], ALPHABETS[:1], key, f"{kind}|{d[:kept]}|{text.startswith('+')}"))
    if kind == "email":
        head, _, top = text.lower().rpartition(".")
        new = same_shape(head, ALPHABETS, key, f"email|{top}") + "." + top
        return "".join(n.upper() if o.isupper() and len(n.upper()) == 1 else n for o, n in zip(text, new, strict=True)) if len(new) == len(text) else new
    if kind == "name":
        return " ".join(w if w.rstrip(".") in TITLES else _name_part(w, key) for w in text.split(" "))
    lower = text == text.lower() and all(c in HEX[0] for c in text)
    return same_shape(text, HEX if lower else ALPHABETS, key, f"secret|{lower}")


def entities(text: str) -> Iterator[tuple[str, int, int, str]]:
    """(kind, start, end, entity) of each mention, left to right, without overlap."""
    if not MAYBE.search(text):
        return
    for m in ENTITY.finditer(text):
        kind = m.lastgroup
        start, end = m.span(kind)
        yield "secret" if kind == "hex" else kind, start, end, text[start:end]


class Surrogates:
    """Surrogates of mentions, kept for later ones; the number kept is bounded."""

    def __init__(self, key: bytes):
        self.key, self.known = key, {}

    def __call__(self, kind: str, text: str) -> str:
        if len(self.known) > 200_000:
            self.known.clear()
        if (found := self.known.get((kind, text))) is None:
            found = self.known[kind, text] = surrogate(kind, text, self.key)
        return found


def colliding(docs: DataFrame, key: bytes, text_col: str = "text") -> DataFrame:
    """(kind, surrogate, n): surrogates that stand for more than one entity; permutations leave none.

    Mentions are counted by keyed digests of entity and surrogate, distinct within each batch before they are shuffled.
    """

    def start():
        made = Surrogates(key)

        def digest(kind: str, text: str) -> bytes:
            return hashlib.blake2b(f"{kind}|{canonical(kind, text)}".encode(), key=key[:64], digest_size=16).digest()

        def found(batch: pa.RecordBatch) -> dict:
            rows = {(kind, digest(kind, e), digest(kind, made(kind, e))) for t in batch.column(text_col).to_pylist() if t for kind, _, _, e in entities(t)}
            return {"kind": [r[0] for r in rows], "entity": [r[1] for r in rows], "surrogate": [r[2] for r in rows]}

        return found

    pairs = map_batches(docs.select(text_col), "kind string, entity binary, surrogate binary", start)
    low, high = F.min("entity"), F.max("entity")
    return pairs.groupBy("kind", "surrogate").agg(low.alias("_low"), high.alias("_high")).where("_low <> _high").select("kind", "surrogate")


def replace_personal_data(docs: DataFrame, key: bytes, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = (), check: bool = True) -> DataFrame:
    """(id, *keep, text, n_entities, entities) for every row, entities as (kind, start, end, surrogate) on the input's code points.

    A null text stays null and an empty one empty, with no entity. Texts without an entity come out unchanged. Equal rows get
    equal results; columns outside of ``keep`` are not read. An empty table gives an empty result. With ``check`` all distinct entities
    are checked first, and a surrogate shared by two of them raises an error before any text is returned.
    """
    if check:
        shared = colliding(docs, key, text_col).limit(10).collect()
        if shared:
            raise ValueError(f"surrogates stand for several entities: {sorted({r.kind for r in shared})}")

    def start():
        made = Surrogates(key)

        def one(text: str | None) -> tuple[str | None, list[dict]]:
            if not text:
                return text, []
            found, parts, at = [], [], 0
            for kind, begin, end, e in entities(text):
                new = made(kind, e)
                found.append({"kind": kind, "start": begin, "end": end, "surrogate": new})
                parts += (text[at:begin], new)
                at = end
            return "".join([*parts, text[at:]]) if found else text, found

        def replaced(batch: pa.RecordBatch) -> dict:
            rows = [one(t) for t in batch.column("_text").to_pylist()]
            out = {"_id": batch.column("_id")} | {f"_k{i}": batch.column(f"_k{i}") for i in range(len(keep))}
            return out | {"_text": [t for t, _ in rows], "n_entities": [len(e) for _, e in rows], "entities": [e for _, e in rows]}

        return replaced

    source = docs.select(F.col(id_col).alias("_id"), *[F.col(c).alias(f"_k{i}") for i, c in enumerate(keep)], F.col(text_col).alias("_text"))
    carried = "".join(f"{f.name} {f.dataType.simpleString()}, " for f in source.schema if f.name != "_text")
    rows = map_batches(source, f"{carried}_text string, n_entities int, entities array<struct<kind:string,start:int,end:int,surrogate:string>>", start)
    return rows.select(F.col("_id").alias(id_col), *[F.col(f"_k{i}").alias(c) for i, c in enumerate(keep)], F.col("_text").alias(text_col), "n_entities", "entities")
