"""Repeated substrings by a distributed difference cover.

Suffixes that start at the places of a difference cover are sampled: for any two places of the corpus some shift below the period brings
both to sampled ones. The sampled suffixes are sorted by a prefix that is short enough to lie within every repeat of the wanted length
after the shift; equal neighbours get one name. A name whose occurrences agree in all the bytes that a repeat can reach on both
sides settles these bytes at once. Where they differ, the suffixes between the samples are merged in by two steps. The places before such a sample
are dealt into four runs, and each run gets a longer name, of the bytes that all its wanted substrings hold; most of these names occur once. Where
one repeats with different bytes around it, every place of the run is named by its whole substring, sorted and compared with its neighbours.

With period 3 the cover is that of the triples of the classic construction; a perfect cover of period 133 samples 12 of 133 places
instead of two of three. Names are 64-bit digests, with 64 bits of surroundings; whole substrings have 96 bits.

The names are dealt into shares that are shuffled one after the other, and each step is written before the next one shuffles: the disk holds
the shuffles of one step, and the tables, at a time.
"""

from __future__ import annotations

import hashlib
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import map_batches, mix, numbered, release, written

PERIOD = 133
MIN_LENGTH = 200
# parts of a period whose strings are named by what all of them hold, before any string is named as a whole
PARTS = 4
# texts whose samples are held at once, and bytes that are digested at once (a longer text by itself)
SLICE = 500
BLOCK = 1 << 17
# shares of the names that are shuffled one after the other, so that the disk holds the samples of one
PASSES = 2
SAMPLE = "_ref long, name long, around long, place int"
BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)


def difference_cover(period: int) -> list[int]:
    """Residues whose differences are all residues of the period.

    For a period q*q + q + 1 with q prime the cover is perfect, q + 1 residues: the powers of a generator of the cubic extension of the field of q
    elements whose leading coefficient is zero. Else the first r residues and the multiples of r, about the root of the period, do.
    """
    q = int(np.sqrt(period))
    if q * q + q + 1 == period and q > 1 and all(q % d for d in range(2, q)):
        for a in range(q):
            for b in range(q):
                for c in range(1, q):
                    x, chosen = (1, 0, 0), []  # 1, then times t each step, where t**3 = a*t*t + b*t + c
                    for i in range(period):
                        if x[2] == 0:
                            chosen.append(i)
                        x = (x[2] * c % q, (x[0] + x[2] * b) % q, (x[1] + x[2] * a) % q)
                    if len(chosen) == q + 1 and len({(i - j) % period for i in chosen for j in chosen}) == period:
                        return chosen
    r = int(np.ceil(np.sqrt(period)))
    return sorted({*range(min(r, period)), *range(0, period, r)})


class Digests:
    """Digests of substrings of one text, from running sums of its 8-byte words."""

    def __init__(self, data: bytes, base: int):
        n = len(data)
        padded = np.frombuffer(data + bytes(16), np.uint8)
        words = np.ndarray((n + 8,), "<u8", padded, 0, (1,))
        rows = -(-(n + 8) // 8)
        h = np.zeros(rows * 8, np.uint64)
        h[: n + 8] = mix(words + np.uint64(base))
        self.power = np.cumprod(np.full(rows + 1, base | 1, np.uint64))
        inverse = pow(base | 1, -1, 1 << 64)
        self.inverse = np.cumprod(np.full(rows + 1, inverse, np.uint64))
        sums = np.zeros((rows + 1, 8), np.uint64)
        np.cumsum(h.reshape(rows, 8) * self.power[:rows, None], axis=0, out=sums[1:])
        self.sums = sums

    def _whole(self, start: np.ndarray, words: np.ndarray | int) -> np.ndarray:
        row, column = start >> 3, start & 7
        return (self.sums[row + words, column] - self.sums[row, column]) * self.inverse[row]

    def of(self, start: np.ndarray, length: np.ndarray | int) -> np.ndarray:
        """Digests of ``length`` >= 8 bytes from each start."""
        words = length >> 3
        first = self._whole(start, words)
        return mix(first * np.uint64(3) + mix(self._whole(start + length - (words << 3), words) + np.asarray(length).astype(np.uint64)))


def covered(n: int, runs: list[tuple[int, int]]) -> np.ndarray:
    """Which of n places lie in one of the (start, end) runs."""
    step = np.zeros(n + 1, np.int64)
    for s, e in runs:
        step[s] += 1
        step[e] -= 1
    return np.cumsum(step[:n]) > 0


def cover_places(n: int, period: int, cover: np.ndarray) -> np.ndarray:
    return (np.arange(0, n, period)[:, None] + cover).ravel()


def sampler(length: int, min_length: int, places_of, part: int = 0, parts: int = 1, block: int = BLOCK):
    """Names and surroundings of the substrings of ``length`` bytes at chosen places of every text, of the names whose remainder is ``part`` of ``parts``.

    A string of ``min_length`` bytes that holds such a substring reaches ``min_length - length`` bytes to the left of its place. Texts are digested
    together until they have ``block`` bytes.
    """
    reach = min_length - length

    def of_block(refs: list[int], texts: list[bytes], places: list[np.ndarray]) -> tuple[np.ndarray, ...]:
        sizes, counts = np.array([len(t) for t in texts]), [len(p) for p in places]
        digests, p = Digests(b"".join(texts), BASES[0]), np.concatenate(places)
        ref, start, n = (np.repeat(x, counts) for x in (np.array(refs), np.cumsum(sizes) - sizes, sizes))
        name = digests.of(start + p, length)
        if parts > 1:
            mine = np.flatnonzero(name % np.uint64(parts) == part)
            ref, start, n, p, name = ref[mine], start[mine], n[mine], p[mine], name[mine]
        low, high = np.maximum(p - reach, 0), np.minimum(p + min_length, n)
        return ref, name.view(np.int64), (digests.of(start + low, high - low) ^ mix((p - low).astype(np.uint64))).view(np.int64), p

    def sampled(batch: pa.RecordBatch) -> dict:
        none = np.zeros(0, np.int64)
        blocks, open_block, size = [(none,) * 4], ([], [], []), 0
        given = batch.column("places").to_pylist() if "places" in batch.schema.names else [()] * batch.num_rows
        for ref, text, places in zip(batch.column("_ref").to_pylist(), batch.column("_text").to_pylist(), given, strict=True):
            data = text.encode()
            n = len(data)
            if n < min_length:
                continue
            p = places_of(n, np.array(places, np.int64))
            for rows, value in zip(open_block, (ref, data, p[(p >= 0) & (p <= n - length)]), strict=True):
                rows.append(value)
            size += n
            if size >= block:
                blocks.append(of_block(*open_block))
                open_block, size = ([], [], []), 0
        if size:
            blocks.append(of_block(*open_block))
        return {c: np.concatenate(x) for c, x in zip(("_ref", "name", "around", "place"), zip(*blocks, strict=True), strict=True)}

    return sampled


def named(samples: DataFrame) -> DataFrame:
    """(_ref, place, settled, open) of the samples whose name occurs again.

    Settled ones have the same surroundings as another; where a name has different surroundings, one sample of each kind is open.
    """
    same, sides = Window.partitionBy("name"), Window.partitionBy("name", "around").orderBy("_ref", "place")
    whole = sides.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return (
        samples.repartition("name")
        # most names occur once and go before the longer order is made
        .withColumns({"n": F.count(F.lit(1)).over(same), "low": F.min("around").over(same), "high": F.max("around").over(same)})
        .where("n > 1")
        .withColumns({"alike": F.count(F.lit(1)).over(whole), "nth": F.row_number().over(sides)})
        .select("_ref", "place", (F.col("alike") > 1).alias("settled"), ((F.col("low") != F.col("high")) & (F.col("nth") == 1)).alias("open"))
        .where("settled OR open")
    )


def repeated_spans(docs: DataFrame, min_length: int = MIN_LENGTH, period: int = PERIOD, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(id, n_bytes, n_removed, n_spans, kept_sha256, spans) for every row; spans are the (start, end) byte runs that repeat.

    A run is the union of ``min_length``-byte strings that start anywhere else too, in another row or in the same one. A null text is empty; texts
    shorter than ``min_length`` keep all their bytes. Rows with equal or null ids are separate documents, so a repeated row loses what it shares with
    its copy. Other columns are not read. Rows are numbered once, in a
    written table. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    cover = np.array(difference_cover(period))
    prefix = min_length - period + 1
    if prefix < 8:
        raise ValueError("the period must be at least 7 below the length")
    kind = docs.schema[id_col].dataType.simpleString()
    source = numbered(docs, F.col(id_col).alias("_id"), F.coalesce(text_col, F.lit("")).alias("_text"))
    reach, inner = period - 1, -(-period // PARTS) - 1

    def sampled_in(part: int) -> DataFrame:
        samples = map_batches(source.select("_ref", "_text"), SAMPLE, lambda: sampler(prefix, min_length, lambda n, _: cover_places(n, period, cover), part, PASSES), rows=SLICE)
        return written(named(samples), "samples")

    shares = []
    for part in range(PASSES):
        shares.append(sampled_in(part))
        release(spark)
    found = reduce(DataFrame.unionByName, shares)

    def texts_at(places: DataFrame) -> DataFrame:
        # joined in the same way at every size: what is broadcast on small tables would not be on large ones
        grouped = places.groupBy("_ref").agg(F.collect_list("place").alias("places"))
        return source.select("_ref", "_text").join(grouped.hint("merge"), "_ref").select("_ref", "_text", "places")

    def narrower(n: int, places: np.ndarray) -> np.ndarray:
        return np.unique(places[:, None] - (inner + 1) * np.arange(PARTS))

    cores = map_batches(texts_at(found.where("open")), SAMPLE, lambda: sampler(min_length - inner, min_length, narrower), rows=SLICE)
    closer = written(named(cores), "cores")
    del cores
    release(spark)

    def merge():
        def merged(batch: pa.RecordBatch) -> dict:
            refs, first, second = [], [], []
            for ref, text, places in zip(batch.column("_ref").to_pylist(), batch.column("_text").to_pylist(), batch.column("places").to_pylist(), strict=True):
                data = text.encode()
                last = len(data) - min_length
                i = np.flatnonzero(covered(last + 1, [(max(0, p - inner), min(p, last) + 1) for p in places if p - inner <= last]))
                first.append(Digests(data, BASES[0]).of(i, min_length))
                # one number holds the start and 32 bits of a second digest
                second.append((i << 32) | (Digests(data, BASES[1]).of(i, min_length) & np.uint64(0xFFFFFFFF)).astype(np.int64))
                refs.append(np.full(len(i), ref))
            return {"_ref": np.concatenate(refs), "x": np.concatenate(first).view(np.int64), "place": np.concatenate(second)}

        return merged

    substrings = map_batches(texts_at(closer.where("open")), "_ref long, x long, place long", merge, rows=SLICE)
    equal = Window.partitionBy("x", F.col("place").bitwiseAND(F.lit(0xFFFFFFFF)))
    # written, so that the shuffles of its texts and substrings are gone before the texts are shuffled for the cut
    repeated = written(substrings.repartition("x").withColumn("n", F.count(F.lit(1)).over(equal)).where("n > 1").select("_ref", F.shiftright("place", 32).alias("place")), "repeats")
    del substrings
    release(spark)
    # a mark is a place times three, plus the position of its reach to the left in this list
    reaches = (reach, inner, 0)
    whole = [found.where("settled"), closer.where("settled"), repeated]
    marked = [rows.select("_ref", (F.col("place") * 3 + i).alias("mark")) for i, rows in enumerate(whole)]
    marks = marked[0].unionByName(marked[1]).unionByName(marked[2]).groupBy("_ref").agg(F.collect_list("mark").alias("marks"))

    def cut():
        def removed(batch: pa.RecordBatch) -> dict:
            rows: list[list] = [[], [], [], [], []]
            for text, marks in zip(batch.column("_text").to_pylist(), batch.column("marks").to_pylist(), strict=True):
                data = text.encode()
                n = len(data)
                bounds = [(max(0, m // 3 - reaches[m % 3]), min(n, m // 3 + min_length)) for m in marks or ()]
                gone = covered(n, [(s, e) for s, e in bounds if e - s >= min_length])
                edges = np.flatnonzero(np.diff(np.concatenate(([False], gone, [False])).astype(np.int8)))
                spans = edges.reshape(-1, 2)
                kept = np.frombuffer(data, np.uint8)[~gone].tobytes()
                for column, value in zip(rows, (n, int(gone.sum()), len(spans), hashlib.sha256(kept).hexdigest(), [{"start": int(s), "end": int(e)} for s, e in spans]), strict=True):
                    column.append(value)
            return {"_id": batch.column("_id")} | dict(zip(("n_bytes", "n_removed", "n_spans", "kept_sha256", "spans"), rows, strict=True))

        return removed

    joined = source.join(marks.hint("merge"), "_ref", "left").select("_id", "_text", "marks")
    return map_batches(joined, f"_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<start:long,end:long>>", cut).withColumnRenamed("_id", id_col)
