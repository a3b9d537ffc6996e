"""Token counts of whole texts by a two-tier lookup on the map side.

A compact table of the most frequent pre-tokens and their lengths in tokens is broadcast; its number of
entries is a parameter, so its size is bounded whatever the corpus. A pre-token outside of it is encoded once per
worker and kept in a bounded cache. No pre-token is shuffled: the frequencies come from one bounded summary per task.
"""

from __future__ import annotations

from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import ChunkCache, chunk_runs, fast_encoder, library, specials
from .common import map_batches, texts_of

TABLE_SIZE = 16_384


def _splitter():
    import public_tokenizers
    import regex

    return regex.compile(public_tokenizers.PATTERN).findall


def frequent_pretokens(docs: DataFrame, text_col: str = "text", size: int = TABLE_SIZE) -> DataFrame:
    """(pretoken, n): the pre-tokens that most tasks found frequent, over all texts; at most ``size`` rows.

    Each task keeps counts of its chunks, drops the rarest when it holds over 16 x size, and reports its top ``size``.
    The choice only decides which lengths are looked up in the table, never a count.
    """

    def start():
        pretokens, chunks = _splitter(), Counter()

        def fold(batch: pa.RecordBatch | None) -> dict:
            nonlocal chunks
            if batch is None:
                found: Counter = Counter()
                for chunk, n in chunks.items():
                    for p in pretokens(chunk):
                        found[p] += n
                top = found.most_common(size)
                return {"pretoken": [p for p, _ in top], "n": [n for _, n in top]}
            for text in texts_of(batch, text_col):
                for head, tail, _ in chunk_runs(text):
                    chunks[head] += 1
                    chunks.update(" " + x for x in tail) if len(tail) < 64 else chunks.update({" " + x: n for x, n in Counter(tail).items()})
                if len(chunks) > 16 * size:
                    chunks = Counter(dict(chunks.most_common(8 * size)))
            return {"pretoken": [], "n": []}

        return fold

    found = map_batches(docs.select(text_col), "pretoken string, n long", start, finish=True)
    return found.groupBy("pretoken").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "pretoken").limit(size)


def token_counts(docs: DataFrame, json_path: str, ranks_path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 1024, table_size: int = TABLE_SIZE) -> DataFrame:
    """(id, n_bytes, n_tokens, over_limit) for every row.

    A null text counts as empty, with no token. Rows with equal or null ids stay separate rows. Other columns of ``docs``, whatever
    their names, are not read. A text that holds a special token's string is encoded whole by the library. An empty table
    gives an empty result.
    """
    spark = docs.sparkSession
    encoder = fast_encoder(ranks_path)
    top = [r.pretoken for r in frequent_pretokens(docs, text_col, table_size).collect()]
    table = spark.sparkContext.broadcast({p: len(encoder.encode_ordinary(p)) for p in top})

    def start():
        tokenizer = library(json_path)
        special, pretokens, encode, frequent = specials(tokenizer), _splitter(), fast_encoder(ranks_path).encode_ordinary, table.value
        rare = ChunkCache(lambda p: len(encode(p)))

        def length(chunk: str) -> int:
            return sum(frequent.get(p) or rare[p] for p in pretokens(chunk))

        heads, tails = ChunkCache(length), ChunkCache(length, " ")
        newline = len(encode("\n"))

        def count(text: str) -> int:
            if any(s in text for s in special):
                return len(tokenizer.encode(text, add_special_tokens=False).ids)
            n = 0
            for head, tail, breaks in chunk_runs(text):
                n += heads[head] + sum(map(tails.__getitem__, tail)) + breaks * newline
            return n

        def counted(batch: pa.RecordBatch) -> dict:
            texts = texts_of(batch, text_col)
            n = [count(t) for t in texts]
            return {"_id": batch.column(id_col), "n_bytes": [len(t.encode()) for t in texts], "n_tokens": n, "over_limit": [x > limit for x in n]}

        return counted

    kind = docs.schema[id_col].dataType.simpleString()
    rows = map_batches(docs.select(id_col, text_col), f"_id {kind}, n_bytes long, n_tokens long, over_limit boolean", start)
    return rows.withColumnRenamed("_id", id_col)
