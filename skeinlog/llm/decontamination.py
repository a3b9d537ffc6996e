"""Benchmark decontamination: rare seeds find passages, local alignment scores edited and paraphrased copies.

Texts and items are sequences of lower-case words. The rarer words of each item, by the number of texts that hold them, are its seeds; so
many that a copy over the threshold must hold some of them close to each other. There the words of the text are aligned with the item
(Smith-Waterman), and the best score, as a share of the item's perfect score, decides.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches, texts_of, written

WORD = re.compile(r"\w+")
# share of an item's words that are seeds beyond those of which a copy holds one at least
MORE = 0.125
BLOCK_ITEMS = 5000
# words that are searched at once
PLACES = 1_000_000
# of a row of alignments that are made at once
CELLS = 50_000
MATCH, MISMATCH, GAP = 2, -1, -1
THRESHOLD = 0.5


class Items:
    """A block of benchmark items as word numbers, and the items that hold each word; small enough to be sent to every task."""

    def __init__(self, rows: list[tuple[object, str]]):
        words = [WORD.findall((t or "").lower()) for _, t in rows]
        self.ids = [i for i, w in zip((i for i, _ in rows), words, strict=True) if w]
        words = [w for w in words if w]
        self.number = {w: k + 1 for k, w in enumerate(sorted({w for x in words for w in x}))}
        self.words = [np.array([self.number[w] for w in x], np.uint32) for x in words]

    def numbers(self, text: str) -> np.ndarray:
        get = self.number.get
        words = WORD.findall(text.lower())
        return np.fromiter((get(w, 0) for w in words), np.uint32, len(words))


class Seeds:
    """The rarer words of every item, by the number of texts that hold them, and how many of them a copy must hold.

    A score of ``threshold`` needs ``least`` matched words within ``span`` words of a text. So of any ``len - least + 1 + more`` words of the item the copy
    holds ``1 + more`` there, however its edits are spread: no text over the threshold is without its seeds.
    """

    def __init__(self, items: Items, texts_with: np.ndarray, threshold: float):
        size = np.array([len(w) for w in items.words])
        self.least = np.maximum(1, np.ceil(threshold * size - 1e-9)).astype(np.int64)
        self.span = np.floor((MATCH + 1 - MATCH * threshold) * size + 1e-9).astype(np.int64)
        more = np.minimum(self.least - 1, (MORE * size).astype(np.int64))
        self.need = 1 + more
        chosen = [np.unique(w[np.argsort(texts_with[w], kind="stable")[: n]]) for w, n in zip(items.words, size - self.least + self.need, strict=True)]
        item, word = np.repeat(np.arange(len(chosen)), [len(c) for c in chosen]), np.concatenate(chosen)
        order = np.argsort(word, kind="stable")
        self.items = item[order]
        self.first = np.searchsorted(word[order], np.arange(len(items.number) + 2))

    def places(self, texts: list[np.ndarray]) -> Iterator[tuple[int, int, np.ndarray]]:
        """(text, item, word positions) where an item's seeds are dense enough in a text."""
        apart = int(self.span.max())
        starts = np.cumsum([0, *(len(t) + apart for t in texts)])
        words = np.concatenate(texts)
        at = np.flatnonzero(self.first[words + 1] > self.first[words])
        of_text = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
        low, n = self.first[words[at]], self.first[words[at] + 1] - self.first[words[at]]
        item = self.items[np.repeat(low - np.cumsum(n) + n, n) + np.arange(n.sum())]
        keys = np.sort(item * starts[-1] + np.repeat(at + apart * of_text[at], n))
        item = keys // starts[-1]
        last = np.arange(len(keys)) + self.need[item] - 1
        found = last < len(keys)
        found[found] = keys[last[found]] - keys[found] < self.span[item[found]]
        found[found] = item[last[found]] == item[found]
        # a window's first place stands for the window
        item, place = item[found], keys[found] % starts[-1]
        text = np.searchsorted(starts, place, side="right") - 1
        edges = np.flatnonzero(np.diff(text, prepend=-1) | np.diff(item, prepend=-1))
        for i, j in zip(edges.tolist(), np.append(edges, len(item))[1:].tolist(), strict=True):
            yield int(text[i]), int(item[i]), place[i:j] - starts[text[i]]


def align(item: np.ndarray, text: np.ndarray) -> tuple[int, int]:
    """(best local alignment score, end in the text) of two word sequences."""
    m = len(text)
    steps = np.arange(m + 1) * GAP
    above, best, end = np.zeros(m + 1, np.int64), 0, 0
    for word in item:
        row = np.zeros(m + 1, np.int64)
        row[1:] = np.maximum(above[:-1] + np.where(text == word, MATCH, MISMATCH), above[1:] + GAP)
        np.maximum(row, 0, out=row)
        row = np.maximum.accumulate(row - steps) + steps
        k = int(row.argmax())
        if row[k] > best:
            best, end = int(row[k]), k
        above = row
    return best, end


def best_scores(pairs: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """The best local alignment score of each (item, text), many pairs at once."""
    out = np.zeros(len(pairs), np.int64)
    order = sorted(range(len(pairs)), key=lambda i: len(pairs[i][1]))
    low = 0
    while low < len(order):
        high = low + 1
        while high < len(order) and (high + 1 - low) * len(pairs[order[high]][1]) <= CELLS:
            high += 1
        chosen = [pairs[i] for i in order[low:high]]
        width, height = len(chosen[-1][1]), max(len(a) for a, _ in chosen)
        kind = np.int16 if width + MATCH * height < 2**15 else np.int32
        # numbers start at 1: neither padding is like any word, nor like the other one
        text, item = np.zeros((width, len(chosen)), np.uint32), np.full((height, len(chosen)), 2**32 - 1, np.uint32)
        for i, (a, b) in enumerate(chosen):
            item[: len(a), i], text[: len(b), i] = a, b
        steps = (np.arange(width + 1) * GAP).astype(kind)[:, None]
        above, best = np.zeros((width + 1, len(chosen)), kind), np.zeros(len(chosen), kind)
        for word in item:
            row = np.zeros_like(above)
            np.add(above[:-1], (text == word).view(np.int8) * np.int8(MATCH - MISMATCH) + np.int8(MISMATCH), out=row[1:])
            np.maximum(row, above + kind(GAP), out=row)
            np.maximum(row, 0, out=row)
            row -= steps
            np.maximum.accumulate(row, axis=0, out=row)
            row += steps
            np.maximum(best, row.max(0), out=best)
            above = row
        out[order[low:high]] = best
        low = high
    return out


def aligned(item: np.ndarray, text: np.ndarray) -> tuple[float, int, int]:
    """(score as a share of the perfect one, start, end) of the best local alignment."""
    best, end = align(item, text)
    _, back = align(item[::-1], text[:end][::-1])
    return best / (MATCH * len(item)), end - back, end


def contaminated(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", block_items: int = BLOCK_ITEMS) -> DataFrame:
    """(id, item, score, start_word, end_word): the best alignment of each row with each item that reaches ``threshold``.

    Null and empty texts and items without a word match nothing. Equal items each get their rows; equal documents too. Null ids
    are carried. Other columns are not read. An empty table on either side gives an empty result. Texts are read whole,
    whatever their length. A large benchmark is taken in blocks of about ``block_items``, each sent to all tasks in turn.
    """
    id_type, item_type = docs.schema[id_col].dataType.simpleString(), benchmark.schema[item_col].dataType.simpleString()
    schema = f"_id {id_type}, _item {item_type}, score double, start_word int, end_word int"
    spark = docs.sparkSession
    source = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    listed = benchmark.select(F.col(item_col).alias("_item"), F.col(item_text_col).alias("_text"))
    blocks = max(1, -(-listed.count() // block_items))
    out = spark.createDataFrame([], schema)
    for b in range(blocks):
        rows = listed.where(F.pmod(F.xxhash64("_item", "_text"), F.lit(blocks)) == b).collect()
        items = Items(sorted(((r._item, r._text) for r in rows), key=lambda x: (x[0] is None, str(x[0]), x[1] or "")))
        if items.ids:
            out = out.unionByName(_block(source, items, threshold, id_type, schema))
    return out.withColumnsRenamed({"_id": id_col, "_item": item_col})


def _block(source: DataFrame, items: Items, threshold: float, id_type: str, schema: str) -> DataFrame:
    spark = source.sparkSession
    sent = spark.sparkContext.broadcast(items)

    def number():
        known, press = sent.value, zstandard.ZstdCompressor(level=3).compress

        def numbered(batch: pa.RecordBatch) -> dict:
            rows: list[list] = [[], []]
            for doc, text in zip(batch.column("_id").to_pylist(), texts_of(batch, "_text"), strict=True):
                numbers = known.numbers(text)
                if numbers.any():
                    for column, value in zip(rows, (doc, press(numbers.tobytes())), strict=True):
                        column.append(value)
            return dict(zip(("_id", "_numbers"), rows, strict=True))

        return numbered

    def texts(batch: pa.RecordBatch) -> list[np.ndarray]:
        unpress = zstandard.ZstdDecompressor().decompress
        return [np.frombuffer(unpress(data), np.uint32) for data in batch.column("_numbers").to_pylist()]

    found = written(map_batches(source, f"_id {id_type}, _numbers binary", number), "numbers")

    def tally():
        total = np.zeros(len(sent.value.number) + 1, np.int64)

        def tallied(batch: pa.RecordBatch | None) -> dict:
            if batch is None:
                held = np.flatnonzero(total)
                return {"word": held, "n": total[held]}
            for numbers in texts(batch):
                total[np.unique(numbers)] += 1
            return {"word": [], "n": []}

        return tallied

    counts = map_batches(found.select("_numbers"), "word int, n long", tally, finish=True).groupBy("word").agg(F.sum("n").alias("n"))
    texts_with = np.zeros(len(items.number) + 1, np.int64)
    for r in counts.collect():
        texts_with[r.word] = r.n
    seeds = spark.sparkContext.broadcast(Seeds(items, texts_with, threshold))

    def check():
        known, sown = sent.value, seeds.value

        def windows(k: int, at: np.ndarray, n: int) -> Iterator[tuple[int, int]]:
            span = int(sown.span[k])
            # a copy may begin up to a span before its first seed
            for run in np.split(at, np.flatnonzero(np.diff(at) > 2 * span) + 1) if at[-1] - at[0] > 2 * span else [at]:
                yield max(0, int(run[0]) - span), min(n, int(run[-1]) + span)

        def scored(batch: pa.RecordBatch) -> dict:
            ids, numbers, rows = batch.column("_id").to_pylist(), texts(batch), []
            low = 0
            while low < len(numbers):
                high, n = low, 0
                while high < len(numbers) and n < PLACES:
                    n += len(numbers[high])
                    high += 1
                found = [(low + i, k, s, e) for i, k, at in sown.places(numbers[low:high]) for s, e in windows(k, at, len(numbers[low + i]))]
                scores = best_scores([(known.words[k], numbers[i][s:e]) for i, k, s, e in found])
                best: dict[tuple[int, int], tuple] = {}
                for (i, k, s, e), score in zip(found, scores.tolist(), strict=True):
                    share = score / (MATCH * len(known.words[k]))
                    if share >= threshold and share > best.get((i, k), (0.0,))[0]:
                        best[i, k] = share, s, e
                for (i, k), (_, s, e) in best.items():
                    score, start, end = aligned(known.words[k], numbers[i][s:e])
                    rows.append((ids[i], known.ids[k], score, s + start, s + end))
                low = high
            return {name: [r[i] for r in rows] for i, name in enumerate(("_id", "_item", "score", "start_word", "end_word"))}

        return scored

    return map_batches(found, schema, check)
