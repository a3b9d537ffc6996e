"""Repeated word spans from a compacted de Bruijn graph.

The k-mers of k consecutive words are the edges of the graph. A run of edges that share their minimizer, the gram with the smallest hash in
each of them, is one compacted path; every k-mer lies in exactly one, and equal k-mers share the minimizer, so equal paths meet under it. Paths
under a minimizer that all agree are unbranched and settled by one comparison. Where paths under a minimizer differ, the graph branches: there
the paths are opened into their k-mers again, which are compared one by one. The coordinates of the sources then say which words go.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WordHashes, map_batches, mix, numbered, release, run_hashes, written
from .suffixes import covered

WORD = re.compile(r"[^\x20\x09-\x0D]+")
K = 13
GRAM = 5


def split_words(text: str) -> list[str]:
    return WORD.findall(text)


def paths(words: np.ndarray, k: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(minimizer, first k-mer, number of k-mers, digest) of each compacted path of a word sequence."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    grams = run_hashes(words, gram)
    width = k - gram + 1
    at = np.lib.stride_tricks.sliding_window_view(grams, width).argmin(1) + np.arange(n)
    first = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))
    count = np.diff(np.append(first, n))
    mers = run_hashes(words, k, seed=1)
    digest = mix(mers[first] * np.uint64(3) + mers[first + count - 1]) + count.astype(np.uint64)
    return grams[at[first]], first, count, digest


def repeated_words(docs: DataFrame, k: int = K, gram: int = GRAM, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_words, n_removed, kept_sha256, spans) for every row; spans are the (start, end) word runs that go.

    A word goes if a run of k words that covers it also starts in a row with a smaller id. A null text has no word. Rows with equal ids don't take words from
    each other; a row with a null id has no place in the order: it keeps its words and takes none. Texts are split at ASCII white space, else
    unchanged. Other columns are not read. Rows are numbered once, in a written table. An empty
    table gives an empty result.
    """
    spark = docs.sparkSession
    kind = docs.schema[id_col].dataType.simpleString()
    source = numbered(docs, F.col(id_col).alias("_id"), F.coalesce(text_col, F.lit("")).alias("_text"))

    def compact():
        hashes = WordHashes()

        def compacted(batch: pa.RecordBatch) -> dict:
            names, digests, places = [], [], []
            for text in batch.column("_text").to_pylist():
                name, first, count, digest = paths(hashes.of(split_words(text)), k, gram)
                names.append(name)
                digests.append(digest)
                places.append((first << 8) | count)
            row = np.repeat(np.arange(batch.num_rows), [len(x) for x in names])
            return {"_ref": batch.column("_ref").take(row), "_id": batch.column("_id").take(row), "name": np.concatenate(names).view(np.int64), "path": np.concatenate(digests).view(np.int64), "place": np.concatenate(places)}

        return compacted

    ordered = source.where(F.col("_id").isNotNull())
    edges = map_batches(ordered, f"_ref long, _id {kind}, name long, path long, place long", compact)
    equal, under = Window.partitionBy("name", "path"), Window.partitionBy("name")
    joined = (
        edges.repartition("name")
        .withColumns({"least": F.min("_id").over(equal), "low": F.min("path").over(under), "high": F.max("path").over(under)})
        .select("_ref", "place", (F.col("least") < F.col("_id")).alias("repeated"), (F.col("low") != F.col("high")).alias("branched"))
        .where("repeated OR branched")
    )
    found = written(joined, "paths")
    del joined, edges
    release(spark)

    # the filter, which an inner join would add by itself, makes both joins read the same exchange
    texts = source.where("_ref IS NOT NULL").repartition("_ref")
    branches = found.where("branched AND NOT repeated").groupBy("_ref").agg(F.collect_list("place").alias("places"))

    def reopen():
        hashes = WordHashes()

        def opened(batch: pa.RecordBatch) -> dict:
            x, y, starts = [], [], []
            for text, places in zip(batch.column("_text").to_pylist(), batch.column("places").to_pylist(), strict=True):
                words = hashes.of(split_words(text))
                at = np.flatnonzero(covered(len(words) - k + 1, [(p >> 8, (p >> 8) + (p & 255)) for p in places]))
                x.append(run_hashes(words, k, seed=1)[at])
                y.append(run_hashes(words, k, seed=2)[at])
                starts.append(at)
            row = np.repeat(np.arange(batch.num_rows), [len(s) for s in starts])
            return {"_ref": batch.column("_ref").take(row), "_id": batch.column("_id").take(row), "x": np.concatenate(x).view(np.int64), "y": np.concatenate(y).view(np.int64), "start": np.concatenate(starts)}

        return opened

    mers = map_batches(texts.join(branches, "_ref"), f"_ref long, _id {kind}, x long, y long, start int", reopen)
    again = mers.withColumn("least", F.min("_id").over(Window.partitionBy("x", "y"))).where("least < _id")
    runs = found.where("repeated").select("_ref", "place").unionByName(again.select("_ref", (F.col("start").cast("long") * 256 + 1).alias("place")))
    marks = runs.groupBy("_ref").agg(F.collect_list("place").alias("places"))

    def cut():
        def removed(batch: pa.RecordBatch) -> dict:
            rows: list[list] = [[], [], [], []]
            for text, places in zip(batch.column("_text").to_pylist(), batch.column("places").to_pylist(), strict=True):
                words = split_words(text)
                gone = covered(len(words), [(p >> 8, (p >> 8) + (p & 255) + k - 1) for p in places or ()])
                spans = np.flatnonzero(np.diff(np.concatenate(([False], gone, [False])).astype(np.int8))).reshape(-1, 2)
                kept = " ".join([w for w, g in zip(words, gone.tolist(), strict=True) if not g]) if len(spans) else " ".join(words)
                for column, value in zip(rows, (len(words), int(gone.sum()), hashlib.sha256(kept.encode()).hexdigest(), [{"start": int(s), "end": int(e)} for s, e in spans]), strict=True):
                    column.append(value)
            return {"_id": batch.column("_id")} | dict(zip(("n_words", "n_removed", "kept_sha256", "spans"), rows, strict=True))

        return removed

    whole = texts.join(marks, "_ref", "left").select("_id", "_text", "places")
    return map_batches(whole, f"_id {kind}, n_words long, n_removed long, kept_sha256 string, spans array<struct<start:long,end:long>>", cut).withColumnRenamed("_id", id_col)
