"""Document fingerprints from spot signatures.

A spot starts at an anchor, a very common word, and is the chain of the content words that follow it; common words in between are
skipped. A text's fingerprint is the set of its spots' hashes. Two fingerprints are as alike as the Jaccard similarity of their sets;
sets whose sizes differ too much can't reach a threshold, so near duplicates are sought among sets of like length only.
"""

from __future__ import annotations

import base64
import hashlib
import re

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WordHashes, gram_hashes, map_batches, written

# Common words of English, German, French and Spanish that serve as anchors.
ANCHORS = frozenset(
    "a an and are as at be by for from in is it of on or that the this to was with "
    "als auf aus das dem den der des die ein eine für ich im ist mit nicht sich sie und von zu "
    "au avec ce dans de des du elle en est et la le les par pas pour que qui sur un une "
    "al como con de del el en es la las lo los no para por que se su un una y".split()
)
CHAIN = 3
MIN_SPOTS = 4
WORD = re.compile(r"\w+")


class Spots:
    """Sorted distinct 32-bit spot hashes of texts. With under ``MIN_SPOTS`` anchors each word starts a spot, so no text with a word has none."""

    def __init__(self):
        self.hashes = WordHashes()

    def of(self, text: str) -> np.ndarray:
        words = WORD.findall(text.lower())
        content: list[str] = []
        at: list[int] = []
        for w in words:
            if w in ANCHORS:
                at.append(len(content))
            else:
                content.append(w)
        chains = gram_hashes(self.hashes.of(content), CHAIN)
        starts = np.array(at, np.int64)
        starts = starts[starts < len(chains)] if len(starts) else starts
        if len(starts) < MIN_SPOTS:
            every = self.hashes.of(words)
            spots = np.concatenate([gram_hashes(every, min(CHAIN, max(1, len(every)))), chains[starts]])
        else:
            spots = chains[starts]
        return np.unique((spots >> np.uint64(32)).astype("<u4"))


def packed(spots: np.ndarray) -> str:
    return base64.b64encode(spots.tobytes()).decode()


def unpacked(fingerprint: str) -> np.ndarray:
    return np.frombuffer(base64.b64decode(fingerprint), "<u4")


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard similarity of two sorted sets; two empty ones are equal."""
    if not len(a) and not len(b):
        return 1.0
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fingerprint, n_spots) of every row. Null and empty texts have the empty fingerprint; other columns are not read."""

    def start():
        spots = Spots()

        def made(batch: pa.RecordBatch) -> dict:
            found = [spots.of(t or "") for t in batch.column(text_col).to_pylist()]
            return {"_id": batch.column(id_col), "fingerprint": [packed(s) for s in found], "n_spots": [len(s) for s in found]}

        return made

    kind = docs.schema[id_col].dataType.simpleString()
    return map_batches(docs.select(id_col, text_col), f"_id {kind}, fingerprint string, n_spots int", start).withColumnRenamed("_id", id_col)


def near_duplicates(prints: DataFrame, threshold: float = 0.8, id_col: str = "doc_id") -> DataFrame:
    """(fingerprint_a, fingerprint_b, likeness) of different nonempty fingerprints with likeness >= threshold, each pair once.

    Fingerprints are first made distinct, so copies form no pairs; membership is the fingerprint itself. They are partitioned by set length in bands of ratio
    ``threshold``, and each is held against its own and the next band. Within a band only sets that share one of the few
    rarest-hash spots that any pair over the threshold must share meet; pairs are pruned by length before the exact comparison.
    """
    distinct = prints.where(F.col("n_spots") > 0).select(F.col("fingerprint").alias("f"), F.col("n_spots").alias("n")).distinct()

    def start():
        def prefix(batch: pa.RecordBatch) -> dict:
            rows: dict[str, list] = {"f": [], "n": [], "band": [], "spot": [], "own": []}
            for f, n in zip(batch.column("f").to_pylist(), batch.column("n").to_pylist(), strict=True):
                spots = unpacked(f)
                keep = n - int(np.ceil(threshold * n - 1e-9)) + 1
                band = int(np.floor(np.log(n) / -np.log(threshold) + 1e-9)) if threshold < 1 else n
                for spot in spots[:keep].tolist():
                    for b, own in ((band, True), (band + 1, False)):
                        for name, value in (("f", f), ("n", n), ("band", b), ("spot", spot), ("own", own)):
                            rows[name].append(value)
            return rows

        return prefix

    keyed = map_batches(distinct, "f string, n int, band int, spot long, own boolean", start)
    a, b = keyed.where("own").drop("own"), keyed
    pairs = a.alias("a").join(b.alias("b"), (F.col("a.band") == F.col("b.band")) & (F.col("a.spot") == F.col("b.spot")) & (F.col("b.n") <= F.col("a.n")) & (F.col("b.n") >= threshold * F.col("a.n")) & ((F.col("b.n") < F.col("a.n")) | (F.col("b.f") < F.col("a.f"))))
    pairs = pairs.select(F.col("a.f").alias("fingerprint_a"), F.col("b.f").alias("fingerprint_b")).distinct()

    def compare():
        def compared(batch: pa.RecordBatch) -> dict:
            x, y = batch.column("fingerprint_a").to_pylist(), batch.column("fingerprint_b").to_pylist()
            return {"fingerprint_a": x, "fingerprint_b": y, "likeness": [likeness(unpacked(p), unpacked(q)) for p, q in zip(x, y, strict=True)]}

        return compared

    return map_batches(pairs, "fingerprint_a string, fingerprint_b string, likeness double", compare).where(F.col("likeness") >= threshold)


def edited(text: str, following: str) -> str:
    """The text with its last quarter replaced by as many first code points of the following text, or all it has."""
    n = len(text) // 4
    return text[: len(text) - n] + following[:n]


def compare_with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) for every row.

    The next document has the next larger id (null ids first, equal ids in order of a hash of their texts); after the last comes the first. A
    single document is its own next one. Null texts are empty. Other columns are not read; an empty table gives an empty result.

    Texts, each compressed, are range-partitioned by id and read in order. What a partition's last document needs is the first one of the next
    partition: these two rows per partition are joined afterwards.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    fields = ["n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    schema = f"_id {kind}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    source = docs.select(F.col(id_col).alias("_id"), F.xxhash64(F.coalesce(text_col, F.lit(""))).alias("_tie"), F.coalesce(text_col, F.lit("")).alias("_text"))

    def shrink():
        press = zstandard.ZstdCompressor(level=3).compress

        def pressed(batch: pa.RecordBatch) -> dict:
            return {"_id": batch.column("_id"), "_tie": batch.column("_tie"), "_text": [press(t.encode()) for t in batch.column("_text").to_pylist()]}

        return pressed

    pressed = map_batches(source, f"_id {kind}, _tie long, _text binary", shrink)
    ordered = pressed.repartitionByRange("_id", "_tie").sortWithinPartitions("_id", "_tie").withColumn("_part", F.spark_partition_id())

    def row(spots: Spots, text: str, own: np.ndarray, following: str, next_spots: np.ndarray) -> list:
        changed = edited(text, following)
        new = spots.of(changed)
        return [len(text), hashlib.sha256(changed.encode()).hexdigest(), packed(own), packed(new), likeness(own, new), likeness(own, next_spots)]

    def start():
        spots, held, unpress = Spots(), None, zstandard.ZstdDecompressor().decompress

        def made(batch: pa.RecordBatch | None) -> dict:
            nonlocal held
            out: dict[str, list] = {name: [] for name in ["_id", *fields, "_part", "_role", "_text"]}

            def add(doc, values: list, part, role, text) -> None:
                for name, value in zip(out, [doc, *values, part, role, text], strict=True):
                    out[name].append(value)

            if batch is None:
                if held:
                    add(held[0], [None] * 6, held[3], "last", held[1])
                return out
            for doc, data, part in zip(batch.column("_id").to_pylist(), batch.column("_text").to_pylist(), batch.column("_part").to_pylist(), strict=True):
                text = unpress(data).decode()
                own = spots.of(text)
                if held is None:
                    add(None, [None] * 6, part, "first", text)
                else:
                    add(held[0], row(spots, held[1], held[2], text, own), part, None, None)
                held = doc, text, own, part
            return out

        return made

    made = written(map_batches(ordered, schema + ", _part int, _role string, _text string", start, finish=True), "spots")
    edges = made.where("_role IS NOT NULL")
    parts = sorted(r._part for r in edges.where("_role = 'last'").select("_part").collect())
    following = dict(zip(parts, parts[1:] + parts[:1], strict=True))
    spark = docs.sparkSession
    links = spark.createDataFrame(list(following.items()), "_part int, _next int")
    firsts = edges.where("_role = 'first'").select(F.col("_part").alias("_next"), F.col("_text").alias("_following"))
    lasts = edges.where("_role = 'last'").select("_id", "_text", "_part").join(links, "_part").join(firsts, "_next")

    def finish():
        spots = Spots()

        def completed(batch: pa.RecordBatch) -> dict:
            rows = [row(spots, t, spots.of(t), f, spots.of(f)) for t, f in zip(batch.column("_text").to_pylist(), batch.column("_following").to_pylist(), strict=True)]
            return {"_id": batch.column("_id")} | {name: [r[i] for r in rows] for i, name in enumerate(fields)}

        return completed

    last = map_batches(lasts.select("_id", "_text", "_following"), schema, finish)
    return made.where("_role IS NULL").select("_id", *fields).unionByName(last).withColumnRenamed("_id", id_col)
