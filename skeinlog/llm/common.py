"""Helpers of the document operators: batch functions over Arrow, written tables, word hashes."""

from __future__ import annotations

import gc
import time
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from skeinlog.session import cut_lineage, scratch_path


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def map_batches(df: DataFrame, schema: str, start: Callable[[], Callable[[pa.RecordBatch], dict]], finish: bool = False, rows: int | None = None) -> DataFrame:
    """Apply ``start()``, called once per task, to every Arrow batch; it returns the columns of ``schema`` by name.

    With ``finish`` the function is called once more, with None, after the last batch of the task. ``rows`` cuts batches into slices of so many, for functions that
    return many rows for one.
    """
    struct = T._parse_datatype_string(schema)
    arrow = to_arrow_schema(struct)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = start()

        def made(columns: dict) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(columns[x.name], x.type) for x in arrow], schema=arrow)

        for batch in batches:
            step = rows or max(1, batch.num_rows)
            for at in range(0, batch.num_rows, step):
                yield made(f(batch.slice(at, step)))
        if finish:
            yield made(f(None))

    return df.mapInArrow(run, struct)


def texts_of(batch: pa.RecordBatch, name: str) -> list[str]:
    """The texts of a batch; null counts as empty."""
    return [t or "" for t in batch.column(name).to_pylist()]


def fold(id_col: str, n: int) -> Column:
    """crc32 of the id as text, modulo n."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % n


class WordHashes(dict):
    """64-bit hashes of words, kept for later texts; the number kept is bounded."""

    LIMIT = 400_000

    def __missing__(self, word: str) -> int:
        if len(self) >= self.LIMIT:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h

    def of(self, words: list[str]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit numbers."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def gram_hashes(words: np.ndarray, n: int, seed: int = 0) -> np.ndarray:
    """Hash of every run of n consecutive word hashes."""
    m = len(words) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint64)
    out = np.full(m, 0x9E3779B97F4A7C15 ^ seed, np.uint64)
    for i in range(n):
        out = mix(out * np.uint64(3) + words[i : i + m])
    return out


def run_hashes(words: np.ndarray, n: int, seed: int = 0) -> np.ndarray:
    """Hash of every run of n consecutive word hashes, put together from those of runs of 1, 2, 4, ... words."""
    m = len(words) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint64)
    power, length, out, done = mix(words ^ np.uint64(0x9E3779B97F4A7C15 + seed)), 1, None, 0
    while True:
        if n & length:
            out = power[:m] if out is None else mix(out * np.uint64(3) + power[done : done + m])
            done += length
        if 2 * length > n:
            return out
        power = mix(power[:-length] * np.uint64(3) + power[length:])
        length *= 2


def signed(x: np.ndarray) -> np.ndarray:
    """64-bit hashes as Spark's signed longs."""
    return x.view(np.int64)


def written(df: DataFrame, label: str) -> DataFrame:
    """``df`` as a table in the shared folder, so that it is computed once and survives lost executors."""
    return cut_lineage(df, f"llm-{label}")


def numbered(docs: DataFrame, *columns: Column) -> DataFrame:
    """``columns`` of every row and _ref, its number, as a table in the shared folder: a row has one number in all later jobs.

    Numbers that each job would make again differ when its input splits do, as with executors lost or added between two jobs.
    """
    rows = docs.select(F.monotonically_increasing_id().alias("_ref"), *columns)
    path = scratch_path(docs.sparkSession, "llm-numbered")
    rows.write.option("compression", "zstd").parquet(path)
    return docs.sparkSession.read.schema(rows.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Let Spark remove shuffle files whose tables are no longer referenced; it does so only when the driver's JVM collects garbage.

    Python's proxies of these tables must be gone first, and both clean up in the background, so it is asked for more than once.
    """
    for _ in range(3):
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.5)
