"""Jaccard self-join of texts as sets of word shingles, by the chosen-path method.

Each run splits the sets recursively on sampled shared tokens: a set stays together under a path with the sets that chose the same tokens,
and it chooses 1 / threshold tokens on average at every step, by a hash that depends on the path alone. Small buckets are compared by brute force;
only larger ones are split again. Runs are repeated until the chance to miss a pair at the threshold is below 1 - recall.

Splits don't separate near copies. So every set of a large bucket is first compared with a few pivots of the bucket: a set that is similar to one of them is
settled there, since whatever is similar to the set is similar enough to that pivot to be connected with it. Only the others are split.

Buckets are compared by small sketches first, which connects sets that may reach the threshold; the connected sets are then compared
whole with each other, by 40-bit shingle hashes in blocks, so that a large group is spread over many tasks and only counts and one link per set leave them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WordHashes, map_batches, mix, numbered, release, run_hashes, written

THRESHOLD = 0.8
SHINGLE = 5
RECALL = 0.999
DEPTH = 4
BUCKET = 200
SKETCH = 32
BLOCK = 256
PIVOTS = 16


def runs_needed(threshold: float, recall: float, depth: int) -> int:
    """Runs until a pair at the threshold is together in a last bucket at every depth up to ``depth`` with chance ``recall``.

    Two equal-sized sets at the threshold share 2t / (1 + t) of a set's tokens; each chosen with chance 1 / (t size).
    """
    shared = 2 / (1 + threshold)
    together = 1.0
    for _ in range(depth):
        together = 1 - np.exp(-shared * together)
    return int(np.ceil(np.log(1 - recall) / np.log(1 - together)))


def shingles(words: np.ndarray, n: int) -> np.ndarray:
    """Sorted distinct shingle hashes; a shorter text is one shingle, one without words none."""
    return np.unique(run_hashes(words, min(n, len(words)))) if len(words) else np.zeros(0, np.uint64)


def chosen(tokens: np.ndarray, paths: np.ndarray, threshold: float) -> np.ndarray:
    """The paths that continue each of ``paths`` with the tokens a set chooses there."""
    h = mix(tokens ^ mix(paths)[:, None])
    share = 1 / (threshold * max(1, len(tokens)))
    return mix(h[h <= np.uint64(min(share, 1.0) * (2**64 - 2**12))])


def sketch(tokens: np.ndarray) -> bytes:
    return np.sort(mix(tokens) >> np.uint64(32)).astype("<u4")[:SKETCH].tobytes()


def narrow(tokens: np.ndarray) -> bytes:
    """Sorted distinct 40-bit parts of tokens, 5 bytes each; in two sets of n tokens about n * n / 2**40 differ unseen."""
    return np.unique(tokens >> np.uint64(24)).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5].tobytes()


def widened(data: bytes) -> np.ndarray:
    parts = np.frombuffer(data, np.uint8).reshape(-1, 5)
    out = np.zeros((len(parts), 8), np.uint8)
    out[:, :5] = parts
    return out.view("<u8").ravel()


def may_reach(a: np.ndarray, b: np.ndarray, threshold: float) -> bool:
    """Whether two bottom sketches leave a similarity over the threshold possible, by four standard deviations."""
    top = min(a[-1], b[-1]) if len(a) == SKETCH and len(b) == SKETCH else a[-1] if len(a) == SKETCH else b[-1] if len(b) == SKETCH else 2**32 - 1
    x, y = a[a <= top], b[b <= top]
    both = len(np.intersect1d(x, y, assume_unique=True))
    union = len(x) + len(y) - both
    return both >= (threshold - 4 * np.sqrt(threshold * (1 - threshold) / max(1, union))) * union


def likeness(sketches: list[bytes], pivot: bytes) -> tuple[np.ndarray, np.ndarray]:
    """For every sketch: its common hashes with that of a pivot, and the hashes of both, up to the place that both reach."""
    size = np.array([len(s) // 4 for s in sketches])
    data = np.full((len(sketches), SKETCH), 2**33, np.int64)
    data[np.arange(SKETCH) < size[:, None]] = np.frombuffer(b"".join(sketches), "<u4")
    of = np.frombuffer(pivot, "<u4").astype(np.int64)
    ends = np.where(size == SKETCH, data[:, -1], 2**32 - 1)
    top = np.minimum(ends, of[-1] if len(of) == SKETCH else 2**32 - 1)
    seen = data <= top[:, None]
    both = (np.isin(data, of) & seen).sum(1)
    return both, seen.sum(1) + np.searchsorted(of, top, "right") - both


class Links:
    """Union-find over a few members."""

    def __init__(self, n: int):
        self.parent = list(range(n))

    def root(self, i: int) -> int:
        while self.parent[i] != i:
            self.parent[i] = self.parent[self.parent[i]]
            i = self.parent[i]
        return i

    def join(self, i: int, j: int) -> None:
        i, j = self.root(i), self.root(j)
        self.parent[max(i, j)] = min(i, j)


def groups(df: DataFrame, key: list[str], schema: str, f) -> DataFrame:
    """``f(rows)`` for the rows of every key, which must be few; Spark deals and sorts the keys, one task reads one key after another."""
    from pyspark.sql import types as T
    from pyspark.sql.pandas.types import to_arrow_schema

    struct = T._parse_datatype_string(schema)
    arrow = to_arrow_schema(struct)
    names = df.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[list] = [[] for _ in arrow]
        held, rows = None, []

        def done() -> pa.RecordBatch:
            made = pa.RecordBatch.from_arrays([pa.array(c, x.type) for c, x in zip(out, arrow, strict=True)], schema=arrow)
            for c in out:
                c.clear()
            return made

        def close() -> None:
            for row in f(rows):
                for c, v in zip(out, row, strict=True):
                    c.append(v)

        for batch in batches:
            for row in zip(*(batch.column(n).to_pylist() for n in names), strict=True):
                k = row[: len(key)]
                if k != held and rows:
                    close()
                    rows = []
                held = k
                rows.append(row)
            if len(out[0]) > 20_000:
                yield done()
        if rows:
            close()
        yield done()

    return df.repartition(*key).sortWithinPartitions(*key).select(*key, *[c for c in names if c not in key]).mapInArrow(run, struct)


def components(edges: DataFrame, label: str) -> DataFrame:
    """(k, root): the least member that each end of the edges is connected with.

    Every member takes the least of its neighbours, follows their choices to the end, and each set of members that end at one becomes that one. Only edges between
    different ones are kept, so a round reads what the last one left open.
    """
    edges = written(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct(), f"{label}-edges")
    roots, step = None, 0
    while not edges.isEmpty():
        step += 1
        ends = edges.select(F.col("b").alias("k"), F.col("a").alias("root")).unionByName(edges.select(F.col("a").alias("k"), F.col("a").alias("root")))
        ends = ends.unionByName(edges.select(F.col("a").alias("k"), F.col("b").alias("root"))).groupBy("k").agg(F.min("root").alias("root"))
        found, jump = written(ends, f"{label}-{step}"), 0
        while True:
            jump += 1
            over = found.select(F.col("k").alias("root"), F.col("root").alias("over"))
            new = written(found.join(over, "root").select("k", F.col("over").alias("root"), (F.col("over") != F.col("root")).alias("moved")), f"{label}-{step}-{jump}")
            found = new.select("k", "root")
            if not new.where("moved").limit(1).count():
                break
        if roots is None:
            roots = found
        else:
            later = found.select(F.col("k").alias("root"), F.col("root").alias("over"))
            roots = written(roots.join(later, "root", "left").select("k", F.coalesce("over", "root").alias("root")), f"{label}-roots-{step}")
        low, high = found.select(F.col("k").alias("a"), F.col("root").alias("x")), found.select(F.col("k").alias("b"), F.col("root").alias("y"))
        open_edges = edges.join(low, "a").join(high, "b").where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
        edges = written(open_edges.distinct(), f"{label}-edges-{step}")
    return edges.select(F.col("a").alias("k"), F.col("b").alias("root")) if roots is None else roots


def settled(hot: DataFrame, sketches: DataFrame, threshold: float) -> DataFrame:
    """(path, a, b) from the members (path, ref) of large buckets: a connection of a and b, or a set a that stays in its bucket, where b is null.

    A set stays unless it is a pivot or its sketch says that it is similar to one. It is connected with all pivots that may be similar to it, so a set that leaves
    loses none of its links: J(y, p) >= J(y, a) + J(a, p) - 1. Connections that follow from others of the same batch are left out.
    """
    dealt = hot.select("path", "ref", F.pmod(F.xxhash64("path", "ref"), F.lit(PIVOTS)).alias("slot"))
    pivots = dealt.groupBy("path", "slot").agg(F.min("ref").alias("ref")).join(sketches, "ref")
    pivots = pivots.groupBy("path").agg(F.sort_array(F.collect_list(F.struct("ref", "sketch"))).alias("pivots"))
    # a copy of the pivots for every slot, so that the members of one bucket are read by several tasks
    pivots = pivots.withColumn("slot", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(PIVOTS - 1).cast("bigint"))))
    rows = dealt.join(sketches, "ref").join(pivots, ["path", "slot"]).select("path", "ref", "sketch", "pivots")

    def compare(batch: pa.RecordBatch) -> dict:
        path, ref, sketch = batch.column("path").to_numpy(), batch.column("ref").to_numpy(), batch.column("sketch").to_pylist()
        numbers: dict[int, int] = {}
        stay, pairs = [], []
        order = np.argsort(path, kind="stable")
        for at in np.split(order, np.flatnonzero(np.diff(path[order])) + 1):
            some, leaves = [sketch[i] for i in at], np.zeros(len(at), bool)
            for pivot in batch.column("pivots")[int(at[0])].as_py():
                both, union = likeness(some, pivot["sketch"])
                leaves |= (both >= threshold * union) | (ref[at] == pivot["ref"])
                may = both >= (threshold - 4 * np.sqrt(threshold * (1 - threshold) / np.maximum(1, union))) * union
                pairs += [(int(a), pivot["ref"]) for a in ref[at[may]] if a != pivot["ref"]]
            stay.append(at[~leaves])
        for pair in pairs:
            for x in pair:
                numbers.setdefault(x, len(numbers))
        links, kept = Links(len(numbers)), []
        for a, b in pairs:
            if links.root(numbers[a]) != links.root(numbers[b]):
                links.join(numbers[a], numbers[b])
                kept.append((a, b))
        open_rows = np.concatenate(stay)
        return {
            "path": [*path[open_rows].tolist(), *[None] * len(kept)],
            "a": [*ref[open_rows].tolist(), *[a for a, _ in kept]],
            "b": [*[None] * len(open_rows), *[b for _, b in kept]],
        }

    return map_batches(rows, "path long, a long, b long", lambda: compare)


def overlaps(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """Numbers of common tokens of each set of a and each of b."""
    tokens, at = np.unique(np.concatenate(a + b), return_inverse=True)
    sizes = [len(x) for x in a + b]
    row = np.repeat(np.arange(len(sizes)), sizes)
    out = np.zeros((len(a), len(b)), np.float32)
    order = np.argsort(at, kind="stable")
    at, row = at[order], row[order]
    for low in range(0, len(tokens), 8192):
        s, e = np.searchsorted(at, (low, low + 8192))
        m = np.zeros((len(sizes), min(8192, len(tokens) - low)), np.float32)
        m[row[s:e], at[s:e] - low] = 1
        out += m[: len(a)] @ m[len(a) :].T
    return out


def joined(source: DataFrame, threshold: float = THRESHOLD, shingle: int = SHINGLE, recall: float = RECALL, bucket: int = BUCKET, depth: int = DEPTH) -> DataFrame:
    """(_ref, id, k, group, n_links): one row per row of ``source``, a table (_ref, _id, _text) of numbered rows; k is the text's digest.
    """
    seeds = mix(np.arange(1, runs_needed(threshold, recall, depth) + 1).astype(np.uint64))
    keyed = source.withColumn("k", F.unhex(F.md5("_text")))

    def first():
        hashes = WordHashes()

        def split(batch: pa.RecordBatch) -> dict:
            paths, sketches = [], []
            for text in batch.column("_text").to_pylist():
                tokens = shingles(hashes.of(text.split()), shingle)
                paths.append(np.unique(chosen(tokens, seeds, threshold)).view(np.int64))
                sketches.append(sketch(tokens))
            return {"k": batch.column("k"), "ref": batch.column("_ref"), "paths": paths, "sketch": sketches}

        return split

    # one row per text: equal texts choose equal paths, and the least of their rows stands for them from here on
    unique = written(map_batches(keyed.select("k", "_ref", "_text"), "k binary, ref long, paths array<long>, sketch binary", first).groupBy("k").agg(F.min("ref").alias("ref"), F.first("paths").alias("paths"), F.first("sketch").alias("sketch")), "paths-1")
    sketches = unique.select("ref", "sketch")
    nodes = unique.select(F.explode("paths").alias("path"), "ref")
    shared = written(nodes.join(nodes.groupBy("path").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "path"), "shared-1")
    pivoted = written(settled(shared.where(F.col("n") > bucket), sketches, threshold), "pivoted")
    stay = pivoted.where("b IS NULL").select("path", F.col("a").alias("ref"))
    left = stay.join(stay.groupBy("path").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "path")
    left = written(shared.where(F.col("n") <= bucket).select("path", "ref", "n").unionByName(left), "left-1")
    # a set has few paths, so the list of those that are split again is short
    again = left.where(F.col("n") > bucket).groupBy("ref").agg(F.collect_list("path").alias("large"))
    active = shared.select("ref").distinct().join(again, "ref", "left").withColumn("large", F.coalesce("large", F.array().cast("array<long>")))

    def shrink():
        press = zstandard.ZstdCompressor(level=3).compress
        return lambda batch: {"_ref": batch.column("_ref"), "_text": [press(t.encode()) for t in batch.column("_text").to_pylist()]}

    def sets_of():
        hashes, unpress = WordHashes(), zstandard.ZstdDecompressor().decompress

        def made(batch: pa.RecordBatch) -> dict:
            tokens, deeper = [], []
            for data, large in zip(batch.column("_text").to_pylist(), batch.column("large").to_pylist(), strict=True):
                found = shingles(hashes.of(unpress(data).decode().split()), shingle)
                tokens.append(narrow(found))
                paths, rows = large, []
                for level in range(2, depth + 1):
                    split = [(p, q) for p in paths for q in chosen(found, np.array([p]).view(np.uint64), threshold).view(np.int64).tolist()]
                    rows += [{"level": level, "parent": p, "path": q} for p, q in split]
                    paths = [q for _, q in split]
                deeper.append(rows)
            return {"ref": batch.column("_ref"), "tokens": tokens, "deeper": deeper}

        return made

    # joined in the same way at every size: what is broadcast on small tables would not be on large ones
    pressed = map_batches(source.select("_ref", "_text"), "_ref long, _text binary", shrink)
    texts = pressed.join(active.withColumnRenamed("ref", "_ref").hint("merge"), "_ref").select("_ref", "_text", "large")
    sets = written(map_batches(texts, "ref long, tokens binary, deeper array<struct<level: int, parent: long, path: long>>", sets_of), "sets")
    del nodes, pressed, texts, active
    release(source.sparkSession)

    # the paths of all deeper splits were made while the tokens were at hand; a level counts where its parent is still large. That is settled by one row per
    # path, so the members of large buckets are not read again at every level
    splits = sets.select("ref", F.explode("deeper").alias("d")).select("d.level", "d.parent", "d.path", "ref")
    sizes = written(splits.groupBy("level", "parent", "path").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "sizes")
    leaves = left.where(F.col("n") <= bucket).select("path", "ref")
    large = left.where(F.col("n") > bucket).select("path", "ref")
    if depth > 1:
        # a bucket holds all sets of the buckets it is split into, so where it is large, those above it are as well
        above = sizes.where(F.col("n") > bucket).select((F.col("level") + 1).alias("level"), F.col("path").alias("parent"))
        few = sizes.where(F.col("n") <= bucket)
        few = few.where("level = 2").unionByName(few.where("level > 2").join(above, ["level", "parent"], "left_semi")).select("level", "path")
        leaves = leaves.unionByName(splits.join(few, ["level", "path"]).select("path", "ref"))
        last = sizes.where((F.col("n") > bucket) & (F.col("level") == depth)).select("level", "path")
        large = splits.join(last, ["level", "path"]).select("path", "ref")

    def connect(rows: list[tuple]) -> Iterator[tuple]:
        sketches, links = [np.frombuffer(r[2], "<u4") for r in rows], Links(len(rows))
        for i in range(len(rows)):
            for j in range(i):
                if links.root(i) != links.root(j) and may_reach(sketches[i], sketches[j], threshold):
                    links.join(i, j)
        return ((r[1], rows[links.root(i)][1]) for i, r in enumerate(rows) if links.root(i) != i)

    maybe = groups(leaves.join(sketches, "ref").select("path", "ref", "sketch"), ["path"], "a long, b long", connect)
    # what still is large after the last split is compared exactly as a whole, in blocks
    rest = large.join(large.groupBy("path").agg(F.min("ref").alias("b")), "path").where("ref <> b").select(F.col("ref").alias("a"), "b")
    near = components(maybe.unionByName(rest).unionByName(pivoted.where("b IS NOT NULL").select("a", "b")).distinct(), "maybe").withColumnRenamed("k", "ref")
    release(source.sparkSession)

    blocks = near.groupBy("root").agg(F.ceil(F.count(F.lit(1)) / F.lit(BLOCK)).cast("int").alias("blocks"))
    placed = near.join(blocks, "root").withColumn("own", F.pmod(F.xxhash64("ref"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = placed.select("root", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "ref").join(sets.select("ref", "tokens").hint("merge"), "ref").select("root", "i", "j", "own", "ref", "tokens")

    def exact(rows: list[tuple]) -> Iterator[tuple]:
        tokens = [widened(r[5]) for r in rows]
        low = [n for n, r in enumerate(rows) if r[3] == r[1]]
        high = [n for n, r in enumerate(rows) if r[3] == r[2]]
        if not low or not high:
            return
        both = overlaps([tokens[n] for n in low], [tokens[n] for n in high])
        sizes = np.array([len(t) for t in tokens], np.float64)
        similar = both / (sizes[low][:, None] + sizes[high][None, :] - both) >= threshold - 1e-9
        links, count = Links(len(rows)), np.zeros(len(rows), np.int64)
        for a, b in zip(*(x.tolist() for x in np.nonzero(similar)), strict=True):
            a, b = low[a], high[b]
            if a < b or (a > b and rows[0][1] != rows[0][2]):
                links.join(a, b)
                count[a] += 1
                count[b] += 1
        for n, r in enumerate(rows):
            if count[n]:
                yield r[4], rows[links.root(n)][4], int(count[n])

    linked = written(groups(dealt, ["root", "i", "j"], "a long, b long, n long", exact), "links")
    number = linked.groupBy(F.col("a").alias("ref")).agg(F.sum("n").alias("n_links"))
    group = components(linked.select("a", "b").distinct(), "links").select(F.col("k").alias("ref"), F.col("root").alias("group"))
    of_text = unique.select("k", "ref").join(number.join(group, "ref", "left"), "ref", "left")
    of_text = of_text.select("k", F.coalesce("group", "ref").alias("group"), F.coalesce("n_links", F.lit(0)).alias("n_links"))
    return keyed.select("_ref", "_id", "k").join(of_text, "k").select("_ref", "_id", "k", "group", "n_links")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **settings) -> DataFrame:
    """(id, class_id, text_id, n_links) for every row.

    class_id is the least id of the rows connected by links, text_id that of the rows with the same text, and n_links the number of other texts whose shingle sets
    have a Jaccard similarity of ``threshold`` or more. A null text is empty; texts without a word are alike only when equal; a text of fewer words
    than a shingle is one shingle. Rows with equal ids are separate rows; null ids are ignored for the least id, which is null if there
    is no other. Words are split at white space. Other columns are not read. An empty table gives an empty result.
    """
    found = written(joined(numbered(docs, F.col(id_col).alias("_id"), F.coalesce(text_col, F.lit("")).alias("_text")), **settings), "classes")
    classes = found.groupBy("group").agg(F.min("_id").alias("class_id"))
    texts = found.groupBy("k").agg(F.min("_id").alias("text_id"))
    return found.join(classes, "group").join(texts, "k").select(F.col("_id").alias(id_col), "class_id", "text_id", "n_links")


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **settings) -> DataFrame:
    """The rows of ``docs``, all columns, that have the least id of their class (null ids last; of equal ids the first row read)."""
    rows = numbered(docs, F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"))
    of_row = F.col("_row")
    found = joined(rows.select("_ref", of_row[id_col].alias("_id"), F.coalesce(of_row[text_col], F.lit("")).alias("_text")), **settings)
    order = F.struct(F.col("_id").isNull().alias("none"), F.col("_id").alias("id"), F.col("_ref").alias("ref"))
    kept = found.groupBy("group").agg(F.min(order).alias("first")).select(F.col("first.ref").alias("_ref"))
    return rows.join(kept, "_ref", "left_semi").select("_row.*")
