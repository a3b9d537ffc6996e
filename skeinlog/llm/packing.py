"""Best-fit packing of documents into token sequences of a fixed length.

Bounded-space online best-fit: a packer holds a fixed number of open sequences, found through a bitset keyed by free
space. A piece goes to the open sequence with the least free space that still holds it; when a new sequence would exceed the
fixed number, the fullest is closed. Pieces are narrow rows; Spark deals them to many packers by a hash.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import Ids
from .common import map_batches, texts_of, written

OPEN_SEQUENCES = 1024
PIECES_PER_PACKER = 20_000


class BestFit:
    """The open sequences of one packer. ``place`` gives (sequence number, offset)."""

    def __init__(self, capacity: int, open_max: int = OPEN_SEQUENCES):
        self.capacity, self.open_max = capacity, open_max
        self.by_free: dict[int, list[int]] = {}
        self.bits = 0
        self.n_open = self.n_made = 0

    def _put(self, sequence: int, free: int) -> None:
        if free:
            self.by_free.setdefault(free, []).append(sequence)
            self.bits |= 1 << free
            self.n_open += 1

    def _take(self, free: int) -> int:
        sequences = self.by_free[free]
        sequence = sequences.pop()
        self.n_open -= 1
        if not sequences:
            self.bits &= ~(1 << free)
        return sequence

    def place(self, length: int) -> tuple[int, int]:
        fitting = self.bits >> length << length if length else self.bits >> 1 << 1
        if fitting:
            free = (fitting & -fitting).bit_length() - 1
            sequence = self._take(free)
        else:
            if self.n_open >= self.open_max:
                self._take((self.bits & -self.bits).bit_length() - 1)
            sequence, free = self.n_made, self.capacity
            self.n_made += 1
        self._put(sequence, free - length)
        return sequence, self.capacity - free


def document_pieces(docs: DataFrame, json_path: str, ranks_path: str, end_id: int, capacity: int = 1024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, piece, start, length, ids_crc32): ids of each text, then ``end_id``; longer ones cut so that only the first piece may be shorter."""

    def start():
        ids, end = Ids(json_path, ranks_path), np.array([end_id], "<u4").tobytes()

        def cut(batch: pa.RecordBatch) -> dict:
            rows: list[list] = [[], [], [], [], []]
            for doc, text in zip(batch.column(id_col).to_pylist(), texts_of(batch, text_col), strict=True):
                data = ids(text) + end
                n = len(data) // 4
                pieces = -(-n // capacity)
                begin = 0
                for piece in range(pieces):
                    stop = n - (pieces - 1 - piece) * capacity
                    for column, value in zip(rows, (doc, piece, begin, stop - begin, zlib.crc32(data[4 * begin : 4 * stop])), strict=True):
                        column.append(value)
                    begin = stop
            return dict(zip(("_id", "piece", "start", "length", "ids_crc32"), rows, strict=True))

        return cut

    kind = docs.schema[id_col].dataType.simpleString()
    return map_batches(docs.select(id_col, text_col), f"_id {kind}, piece int, start long, length long, ids_crc32 long", start).withColumnRenamed("_id", id_col)


def pack(pieces: DataFrame, capacity: int = 1024, open_max: int = OPEN_SEQUENCES, per_packer: int = PIECES_PER_PACKER) -> DataFrame:
    """``pieces`` (with ``length``, ``ids_crc32``) and their sequence_id and offset.

    The pieces are written once: their number decides how many packers there are, and a lost task packs the same rows in the same
    order again, because a packer's pieces are sorted. Full pieces need no packer; each is a sequence of its own.
    """
    table = written(pieces, "pieces")
    full = table.where(F.col("length") == capacity).withColumns({"sequence_id": 2 * F.monotonically_increasing_id(), "offset": F.lit(0).cast("long")})
    part = table.where(F.col("length") < capacity)
    n = max(1, -(-part.count() // per_packer))
    columns = pieces.columns
    key = F.xxhash64(*columns)
    dealt = part.withColumn("_key", key).repartition(n, "_key").sortWithinPartitions("_key", *columns).drop("_key").withColumn("_packer", F.spark_partition_id())
    struct = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema)

    def start():
        packer = BestFit(capacity, open_max)

        def placed(batch: pa.RecordBatch) -> dict:
            spots = [packer.place(x) for x in batch.column("length").to_pylist()]
            base = 2 * (batch.column("_packer")[0].as_py() << 33) + 1
            out = {name: batch.column(name) for name in columns}
            return out | {"sequence_id": [base + 2 * s for s, _ in spots], "offset": [o for _, o in spots]}

        return placed

    return full.unionByName(map_batches(dealt, f"{struct}, sequence_id long, offset long", start))


def pack_documents(docs: DataFrame, json_path: str, ranks_path: str, end_id: int = 2, capacity: int = 1024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every document's pieces and their places: (id, piece, start, length, ids_crc32, sequence_id, offset).

    A null or empty text is one piece of one id. Rows with equal ids are separate documents; a null id stays null. Other columns
    are not read. An empty table gives an empty result.
    """
    return pack(document_pieces(docs, json_path, ranks_path, end_id, capacity, id_col, text_col), capacity)
