"""Language identification with hyperdimensional profiles.

Every letter has a random vector of +1 and -1. A letter n-gram is the product (binding) of its letters' vectors, each
rotated by its place in the n-gram; a text is the sum (bundle) of its n-grams. A language's prototype is the bundle of its training
texts, each scaled to equal weight; prototypes are centred on their mean, so that what all languages share does not count. A text's
language is the prototype with the largest cosine.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches, texts_of

DIMS = 1024
SLOTS = 256
SHARPNESS = 12.0
KNOWN_MAX = 24_000
SCALE = 1 << 20


def letter_slots() -> np.ndarray:
    """Vector number of each code point: letters share 255 of them, everything else is the word boundary 0."""
    slots = np.zeros(0x110000, np.uint8)
    letters = np.array([c for c in range(0x110000) if not 0xD800 <= c < 0xE000 and chr(c).isalpha()], np.int64)
    slots[letters] = letters % 255 + 1
    return slots


class Trigrams:
    """Vectors of letter trigrams, bound when first met and kept in a table of bounded size."""

    def __init__(self, dims: int, seed: int):
        self.slots = letter_slots()
        signs = np.random.default_rng(seed).integers(0, 2, (SLOTS, dims), dtype=np.int8) * 2 - 1
        self.first, self.second, self.third = np.roll(signs, 2, 1), np.roll(signs, 1, 1), signs
        self.row = np.full(SLOTS**3, -1, np.int32)
        self.vectors = np.zeros((KNOWN_MAX, dims), np.float32)
        self.n = 0

    def codes(self, text: str) -> np.ndarray:
        """Codes of the text's trigrams, runs of other characters taken as one boundary; none if it has no letter."""
        s = self.slots[np.frombuffer(text.lower().encode("utf-32-le"), np.uint32)]
        if not s.any():
            return np.zeros(0, np.int64)
        s = np.concatenate(([0], s, [0])).astype(np.int64)
        s = s[np.concatenate(([True], (s[1:] != 0) | (s[:-1] != 0)))]
        return (s[:-2] << 16) | (s[1:-1] << 8) | s[2:]

    def _learn(self, codes: np.ndarray) -> None:
        new = np.unique(codes[self.row[codes] < 0])
        for a in range(0, len(new), 1024):
            c = new[a : a + 1024]
            self.vectors[self.n : self.n + len(c)] = self.first[c >> 16] * self.second[c >> 8 & 255] * self.third[c & 255]
            self.row[c] = np.arange(self.n, self.n + len(c))
            self.n += len(c)

    def counts(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """(rows of the vector table, how often): forgets all vectors first when the table would overflow."""
        codes = self.codes(text)
        rows = self.row[codes]
        if len(rows) and rows.min() < 0:
            if self.n + len(np.unique(codes[rows < 0])) > KNOWN_MAX:
                self.row.fill(-1)
                self.n = 0
            self._learn(codes)
            rows = self.row[codes]
        n = np.bincount(rows, minlength=1) if len(rows) else np.zeros(0, np.int64)
        found = np.flatnonzero(n)
        return found, n[found].astype(np.float32)

    def bundle(self, text: str) -> np.ndarray | None:
        """The text's unit vector; None without letters. More distinct trigrams than the table holds are bundled in parts."""
        codes = self.codes(text)
        if not len(codes):
            return None
        if len(codes) <= KNOWN_MAX:
            found, n = self.counts(text)
            v = n @ self.vectors[found]
        else:
            distinct, n = np.unique(codes, return_counts=True)
            v = np.zeros(self.vectors.shape[1], np.float32)
            for a in range(0, len(distinct), KNOWN_MAX // 2):
                part, times = distinct[a : a + KNOWN_MAX // 2], n[a : a + KNOWN_MAX // 2]
                if self.n + len(part) > KNOWN_MAX:
                    self.row.fill(-1)
                    self.n = 0
                self._learn(part)
                v += times.astype(np.float32) @ self.vectors[self.row[part]]
        norm = float(np.linalg.norm(v))
        return v / norm if norm else v


def train_profiles(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", dims: int = DIMS, seed: int = 7) -> tuple[list[str], np.ndarray]:
    """(languages in order, centred unit prototypes) from all rows with a language and a text with letters.

    Each task sums its texts per language; what the driver gets has one number per language and dimension.
    """

    def start():
        trigrams, sums = Trigrams(dims, seed), {}

        def bundle(batch: pa.RecordBatch | None) -> dict:
            if batch is None:
                return {"lang": list(sums), "sums": [np.rint(v * SCALE).astype(np.int64) for v in sums.values()]}
            for text, lang in zip(texts_of(batch, text_col), batch.column(lang_col).to_pylist(), strict=True):
                v = trigrams.bundle(text)
                if v is not None:
                    sums[lang] = sums.get(lang, 0) + v.astype(np.float64)
            return {"lang": [], "sums": []}

        return bundle

    labelled = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(text_col, lang_col)
    parts = map_batches(labelled, "lang string, sums array<long>", start, finish=True)
    totals = parts.select("lang", F.posexplode("sums").alias("dim", "v")).groupBy("lang", "dim").agg(F.sum("v").alias("v"))
    by_lang: dict[str, np.ndarray] = {}
    for r in totals.collect():
        by_lang.setdefault(r.lang, np.zeros(dims))[r.dim] = r.v
    langs = sorted(by_lang)
    if not langs:
        return [], np.zeros((0, dims), np.float32)
    p = np.stack([by_lang[x] / (np.linalg.norm(by_lang[x]) or 1) for x in langs])
    if len(langs) > 1:
        p = p - p.mean(0)
    return langs, (p / np.maximum(np.linalg.norm(p, axis=1, keepdims=True), 1e-12)).astype(np.float32)


def identify(docs: DataFrame, profiles: tuple[list[str], np.ndarray], id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = (), seed: int = 7) -> DataFrame:
    """(id, *keep, lang_pred, score, cosine) for every row; ``keep`` names further columns to carry.

    A null text, one without letters, or no profile at all gives ``und`` with score 0 and cosine 0. Equal cosines go to the first
    language in alphabetical order. Equal rows get equal answers; very long texts are read whole. An empty table gives an empty result.
    """
    langs, prototypes = profiles
    dims = prototypes.shape[1]

    def start():
        trigrams = Trigrams(dims, seed)

        def one(text: str) -> tuple[str, float, float]:
            v = trigrams.bundle(text) if langs else None
            if v is None:
                return "und", 0.0, 0.0
            cosines = prototypes @ v
            best = int(cosines.argmax())
            e = np.exp(SHARPNESS * (cosines - cosines[best]))
            return langs[best], float(1 / e.sum()), float(cosines[best])

        def predicted(batch: pa.RecordBatch) -> dict:
            found = [one(t) for t in texts_of(batch, text_col)]
            out = {"_id": batch.column(id_col)} | {f"_k{i}": batch.column(c) for i, c in enumerate(keep)}
            return out | {"lang_pred": [f[0] for f in found], "score": [f[1] for f in found], "cosine": [f[2] for f in found]}

        return predicted

    source = docs.select(F.col(id_col), *[F.col(c) for c in keep if c not in (id_col, text_col)], F.col(text_col))
    fields = [("_id", id_col), *[(f"_k{i}", c) for i, c in enumerate(keep)]]
    struct = ", ".join(f"{name} {docs.schema[c].dataType.simpleString()}" for name, c in fields)
    rows = map_batches(source, f"{struct}, lang_pred string, score double, cosine double", start)
    for i, c in enumerate(keep):
        rows = rows.withColumnRenamed(f"_k{i}", c)
    return rows.withColumnRenamed("_id", id_col) if id_col not in keep else rows.drop("_id")
