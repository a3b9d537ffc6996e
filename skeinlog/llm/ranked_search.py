"""Ranked lexical search by reading impact-sorted lists in rounds, with no random access (NRA).

``impact_lists`` cuts the documents into shards of bounded size and stores for every term of a shard its documents by falling impact. ``search`` takes
the queries in blocks of bounded size, sends a block to all tasks and brings the lists of its terms together by shard. There every query reads
its lists from the front, twice as far each round. What a document has collected is its lower bound; its upper bound adds the last impact
read of every list in which it was not met yet. Reading ends when all documents that could still be among the best have equal bounds, and no
unseen document can reach them: then membership, ties and scores are final. The best of all shards are merged by a window of at most
``k`` rows a shard and query.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from string import ascii_lowercase, ascii_uppercase

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .common import written

PATTERN = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
TERM = re.compile(PATTERN)
LOWER = str.maketrans(ascii_uppercase, ascii_lowercase)
# A shard ends with the document that brings it to so many terms or documents.
SHARD_TERMS, SHARD_DOCS = 1 << 21, 1 << 15
# Terms of queries a block holds, about 40 bytes each.
BLOCK_TERMS = 200_000
FIRST_READ = 64
NUMBERS = T.ArrayType(T.IntegerType())
LISTS = T.StructType().add("shard", T.LongType()).add("term", T.StringType()).add("n", T.IntegerType()).add("docs", NUMBERS).add("impacts", NUMBERS).add("ids", T.ArrayType(T.LongType()))
HITS = T.StructType().add("query", T.LongType()).add("doc_id", T.LongType()).add("score", T.LongType())


def shard_rows(shard: int, ids: list, words: np.ndarray, lengths: np.ndarray, terms: list[str], n_docs: int, n_terms: int) -> pa.RecordBatch:
    """The lists of one shard. Documents are numbered by id, those without one last; the row without a term holds the ids."""
    order = np.array(sorted(range(len(ids)), key=lambda i: (ids[i] is None, ids[i] or 0)), np.int64)
    number = np.empty(len(ids), np.int64)
    number[order] = np.arange(len(ids))
    doc = np.repeat(number, lengths)
    key, tf = np.unique(words * len(ids) + doc, return_counts=True)
    term, doc = np.divmod(key, len(ids))
    m = 75 + (25 * lengths[order] * n_docs) // max(n_terms, 1)
    impact = (1_000_000_000 * tf) // (1000 * tf + 12 * m[doc])
    by = np.lexsort((doc, -impact, term))
    term, doc, impact = term[by], doc[by], impact[by]
    starts = np.flatnonzero(np.concatenate(([True], term[1:] != term[:-1]))) if len(term) else np.zeros(0, np.int64)
    offsets = pa.array(np.concatenate(([0], starts, [len(term)])).astype(np.int32))
    sizes = np.diff(offsets.to_numpy())
    sizes[0] = len(ids)
    lists = lambda values: pa.ListArray.from_arrays(offsets, pa.array(values.astype(np.int32)))
    names = pa.array([None, *(terms[t] for t in term[starts].tolist())], pa.string())
    head = pa.array([[ids[i] for i in order.tolist()], *[None] * len(starts)], pa.list_(pa.int64()))
    schema = to_arrow_schema(LISTS)
    columns = [pa.array(np.full(len(names), shard)), names, pa.array(sizes), lists(doc), lists(impact), head]
    return pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, schema)], schema=schema)


def impact_lists(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(shard, term, n, docs, impacts, ids): the documents of every term by falling impact, in shards; written to the shared folder.

    The impact of a term in a document is (1000000000 * tf) div (1000 * tf + 12 * m) with m = 75 + (25 * n * N) div L; tf counts the term, n all terms of the document, N
    the documents with a term and L their terms. Terms are ASCII letters and digits and all other characters, A-Z as a-z. A null or empty text
    holds no term. Ids are whole numbers or null; rows with equal ids are documents of their own. An empty table gives no list.
    """
    spark = docs.sparkSession
    n = F.regexp_count(F.col(text_col), F.lit(PATTERN)).cast("long")
    # no filter on the count: it would be pushed below and count every text twice
    totals = docs.select(n.alias("n")).agg(F.count_if(F.col("n") > 0).alias("docs"), F.coalesce(F.sum("n"), F.lit(0)).alias("terms")).first()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        shard, held = TaskContext.get().partitionId() << 32, 0
        known: defaultdict = defaultdict()
        known.default_factory = known.__len__
        ids, parts, lengths = [], [], []

        def made() -> pa.RecordBatch:
            return shard_rows(shard, ids, np.concatenate(parts), np.array(lengths, np.int64), list(known), totals.docs, totals.terms)

        for batch in batches:
            for i, text in zip(batch.column("_id").to_pylist(), batch.column("_text")):
                words = TERM.findall((text.as_py() or "").translate(LOWER))
                if not words:
                    continue
                ids.append(i)
                parts.append(np.fromiter(map(known.__getitem__, words), np.int64, len(words)))
                lengths.append(len(words))
                held += len(words)
                if held >= SHARD_TERMS or len(ids) >= SHARD_DOCS:
                    yield made()
                    shard, held = shard + 1, 0
                    known.clear()
                    ids, parts, lengths = [], [], []
        if ids:
            yield made()

    rows = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).alias("_text"))
    return written(rows.mapInArrow(run, LISTS), "impact-lists")


def nra(lists: list[tuple[np.ndarray, np.ndarray, int]], n_docs: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(documents, scores) of the ``k`` highest sums of weighted impacts over 0, by falling sum and rising number.

    A list is (documents, impacts by falling impact, weight); a document stands in it once.
    """
    lists = [x for x in lists if len(x[0]) and x[1][0] > 0 and x[2] > 0]
    if not lists:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    # sums stay below 2 ** 53, so they are exact
    lower, met = np.zeros(n_docs), np.zeros(n_docs, bool)
    at, reach = 0, FIRST_READ
    while True:
        bounds = []
        for docs, impacts, weight in lists:
            read = docs[at:reach]
            lower[read] += impacts[at:reach] * float(weight)
            met[read] = True
            bounds.append(int(impacts[reach - 1]) * weight if reach < len(docs) else 0)
        unread = float(sum(bounds))
        seen = np.flatnonzero(met)
        low = lower[seen]
        floor = np.partition(low, len(low) - k)[len(low) - k] if len(low) >= k else 0.0
        if unread < floor or unread == 0:
            known = np.zeros(n_docs)
            for (docs, _, _), bound in zip(lists, bounds):
                if bound:
                    known[docs[:reach]] += bound
            upper = low + (unread - known[seen])
            best = upper >= floor
            if (upper[best] == low[best]).all():
                docs, scores = seen[best], low[best]
                order = np.lexsort((docs, -scores))[:k]
                order = order[scores[order] > 0]
                return docs[order], scores[order].astype(np.int64)
        at, reach = reach, 2 * reach


def flat(lists: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(values, offsets) of a list column."""
    whole = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
    return whole.flatten().to_numpy(zero_copy_only=False), np.concatenate(([0], np.cumsum(whole.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)))).astype(np.int64)


def answer(asked: dict[int, list[tuple[str, int]]], k: int):
    """A function from the lists of one shard to its best documents for every query."""

    def f(table: pa.Table) -> pa.Table:
        terms = table.column("term").to_pylist()
        docs, ends = flat(table.column("docs"))
        impacts, _ = flat(table.column("impacts"))
        ids = next(x.as_py() for x in table.column("ids") if x.is_valid)
        place = {t: i for i, t in enumerate(terms) if t is not None}
        found: tuple[list, list, list] = ([], [], [])
        for query, wanted in asked.items():
            own = [(docs[ends[i] : ends[i + 1]], impacts[ends[i] : ends[i + 1]], w) for t, w in wanted if (i := place.get(t)) is not None]
            best, scores = nra(own, len(ids), k)
            found[0].extend([query] * len(best))
            found[1].extend(ids[d] for d in best.tolist())
            found[2].extend(scores.tolist())
        return pa.table([pa.array(x, pa.int64()) for x in found], schema=to_arrow_schema(HITS))

    return f


def search(lists: DataFrame, queries: DataFrame, k: int = 20, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(id, rank, doc_id, score): the ``k`` highest-scoring documents of ``impact_lists`` for every row of ``queries``, equal scores by rising id.

    A document's score is the sum of weight * impact over the query's terms, repeats included; the weight of a term that df of N documents hold is
    floor(1000 * ln((2 * N + 2) / (2 * df + 1))). Documents with a score of 0 and queries without a known term give no row; rows of ``queries`` with equal
    or null ids are queries of their own, with ranks of their own. Documents without an id come after others of equal score.
    A block of queries holds about ``BLOCK_TERMS`` terms and is what every task gets; only lists of its terms travel, by shard.
    """
    spark = lists.sparkSession
    words = F.regexp_extract_all(F.translate(F.col(text_col), ascii_uppercase, ascii_lowercase), F.lit(PATTERN), F.lit(0))
    asked = written(queries.select(F.monotonically_increasing_id().alias("query"), F.col(id_col).alias("_item"), words.alias("terms")), "queries")
    heads, bodies = lists.where("term IS NULL"), lists.where("term IS NOT NULL")
    total = heads.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first().n
    known = bodies.groupBy("term").agg(F.sum("n").alias("df"))
    weight = F.floor(1000 * F.ln(F.lit(float(2 * total + 2)) / (2 * F.col("df") + 1)))
    terms = asked.select("query", F.explode("terms").alias("term")).groupBy("query", "term").agg(F.count("*").alias("times"))
    terms = written(terms.join(known, "term").select("query", "term", (F.col("times") * weight).alias("weight")).where("weight > 0"), "query-terms")

    blocks = -(-terms.count() // BLOCK_TERMS)
    hits = spark.createDataFrame([], HITS)
    for b in range(blocks):
        own = terms.where(F.pmod(F.xxhash64("query"), F.lit(blocks)) == b)
        block: dict[int, list[tuple[str, int]]] = defaultdict(list)
        for row in own.toLocalIterator():
            block[row.query].append((row.term, row.weight))
        wanted = bodies.join(F.broadcast(own.select("term").distinct()), "term", "left_semi").select(*lists.columns)
        best = wanted.unionAll(heads).groupBy("shard").applyInArrow(answer(dict(block), k), HITS)
        hits = hits.unionAll(written(best, "hits") if blocks > 1 else best)
    ranked = hits.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last()))).where(F.col("rank") <= k)
    return ranked.join(asked.select("query", "_item"), "query").select(F.col("_item").alias(id_col), "rank", "doc_id", "score")


def search_sql(k: int = 20) -> str:
    """The same over ``benchmark`` and ``documents`` in DuckDB, with every document scored in full."""
    terms = lambda t: f"regexp_extract_all(translate({t}, '{ascii_uppercase}', '{ascii_lowercase}'), '{PATTERN}')"
    return f"""
WITH held AS (SELECT doc_id, terms, len(terms) AS n FROM (SELECT doc_id, {terms("text")} AS terms FROM documents WHERE text IS NOT NULL) WHERE len(terms) > 0),
totals AS (SELECT count(*)::BIGINT AS n_docs, sum(n)::BIGINT AS n_terms FROM held),
tf AS (SELECT doc_id, n, term, count(*)::BIGINT AS tf FROM (SELECT doc_id, n, unnest(terms) AS term FROM held) GROUP BY ALL),
w AS (SELECT term, floor(1000 * ln((2 * any_value(n_docs) + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM tf, totals GROUP BY term),
impacts AS (SELECT doc_id, term, w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * n_docs) // n_terms))) AS impact FROM tf JOIN w USING (term), totals),
asked AS (SELECT item_id, unnest({terms("text")}) AS term FROM benchmark WHERE text IS NOT NULL),
scores AS (SELECT item_id, doc_id, sum(impact)::BIGINT AS score FROM asked JOIN impacts USING (term) GROUP BY ALL HAVING sum(impact) > 0),
ranked AS (SELECT item_id, (row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id))::INTEGER AS rank, doc_id, score FROM scores)
SELECT * FROM ranked WHERE rank <= {k}
"""
