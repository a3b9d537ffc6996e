"""Runs of repeated periods in word sequences, found by minimizers of several scales.

A run is a longest stretch of words with smallest period q that holds at least four periods. Scale m (16, 32, 64, ...) is answerable for the periods
q of m/2 < q <= m: among every m/2 neighbouring grams of m words the one with the smallest hash is kept. Inside a run the window one period
on holds the same grams, so a kept gram is kept again q words on; grams of m >= q words differ within a period, so no equal one lies between, and
neighbouring places of one kept gram give the period. m + m/2 + q - 1 words are needed for that, which four periods hold. Each pair is a seed:
words at that lag are compared outwards from it until they differ. Periods up to 8 are too short for a scale; there all words are compared with
those at the lag.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import map_batches, mix

SHORT = 8
# Texts are taken together up to so many bytes, and a long text is split into words in slices of as many.
SLICE = 1 << 22
BLANK = re.compile(rb"[\x20\x09-\x0D]")
RUNS = "array<struct<start: bigint, length: bigint, period: bigint>>"


def slices(text: bytes, size: int = SLICE) -> Iterator[bytes]:
    """The text in pieces that end at a blank."""
    at = 0
    while at < len(text):
        end = BLANK.search(text, at + size)
        stop = end.start() if end else len(text)
        yield text[at:stop]
        at = stop


def word_ids(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """(ids, first place of every text and the end, words by id). After each text stands a number of its own, so nothing repeats across texts."""
    known: defaultdict = defaultdict()
    known.default_factory = known.__len__
    parts, ends, at = [], [0], 0
    for k, text in enumerate(texts):
        for piece in slices(text):
            words = piece.split()
            parts.append(np.fromiter(map(known.__getitem__, words), np.int64, len(words)))
            at += len(words)
        parts.append(np.array([-1 - k]))
        at += 1
        ends.append(at)
    return np.concatenate(parts), np.array(ends), list(known)


def lag_stretches(w: np.ndarray, q: int, least: int) -> tuple[np.ndarray, np.ndarray]:
    """(start, length) of the longest stretches with period q and at least ``least`` words."""
    if len(w) <= q:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    other = np.flatnonzero(w[q:] != w[:-q])
    edges = np.concatenate(([-1], other, [len(w) - q]))
    same = np.diff(edges) - 1
    long = same >= least - q
    return edges[:-1][long] + 1, same[long] + q


def agreeing(a: np.ndarray, b: np.ndarray) -> int:
    """How many numbers agree from the front of both."""
    n, at, step = min(len(a), len(b)), 0, 64
    while at < n:
        differs = a[at : at + step] != b[at : at + step]
        k = int(differs.argmax())
        if differs[k]:
            return at + k
        at, step = at + step, step * 2
    return n


def window_minima(h: np.ndarray, width: int) -> np.ndarray:
    """Places that hold the smallest value of some ``width`` (a power of two) neighbouring ones."""
    low, w = h, 1
    while w < width:
        low = np.minimum(low[:-w], low[w:])
        w *= 2
    high = np.concatenate((np.zeros(width - 1, h.dtype), low, np.zeros(width - 1, h.dtype)))
    w = 1
    while w < width:
        high = np.maximum(high[:-w], high[w:])
        w *= 2
    return np.flatnonzero(high == h)


def primes(q: int) -> list[int]:
    out, f = [], 2
    while f * f <= q:
        if q % f == 0:
            out.append(f)
            while q % f == 0:
                q //= f
        f += 1
    return out + [q] * (q > 1)


def find_runs(w: np.ndarray, longest: int, min_length: int, min_exponent: int) -> np.ndarray:
    """Rows (start, length, period) of all runs by start, then period; ``longest`` bounds the words of one text."""
    found = []

    def keep(start: int, length: int, q: int) -> None:
        run = w[start : start + length]
        if not any((run[q // f :] == run[: -(q // f)]).all() for f in primes(q)):
            found.append((start, length, q))

    for q in range(1, SHORT + 1):
        for s, n in zip(*lag_stretches(w, q, max(min_length, min_exponent * q))):
            keep(int(s), int(n), q)
    h, m = mix(w.astype(np.uint64)), 1
    while m // 2 * min_exponent < longest and len(h) > m:
        h, m = mix(h[:-m] * np.uint64(3) + h[m:]), 2 * m
        if m <= SHORT or len(h) < m:
            continue
        at = window_minima(h, m // 2)
        order = np.argsort(h[at], kind="stable")
        at = at[order]
        q = np.diff(at)
        pairs = np.flatnonzero((h[at[1:]] == h[at[:-1]]) & (q > m // 2) & (q <= m))
        pairs = pairs[np.lexsort((at[pairs], q[pairs]))]
        lag, done = 0, 0
        for p, d in zip(at[pairs].tolist(), q[pairs].tolist()):
            if d != lag:
                lag, done = d, 0
            if p < done:  # inside the stretch of an earlier seed
                continue
            ahead = agreeing(w[p : len(w) - d], w[p + d :])
            back = agreeing(w[:p][::-1], w[d : p + d][::-1])
            done = p + ahead
            length = back + ahead + d
            if ahead and length >= max(min_length, min_exponent * d):
                keep(p - back, length, d)
    return np.array(sorted(found, key=lambda r: (r[0], r[2])), np.int64).reshape(-1, 3)


def periodic_runs(docs: DataFrame, min_length: int = 6, min_exponent: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_words, runs, collapsed) for every row: its runs by start, then period, and the words outside of repeated periods.

    Words are the stretches without ASCII white space. A run is kept whose length is at least ``min_length`` and ``min_exponent`` periods; ``collapsed``
    are the words, joined by one blank, that no run holds after its first period. A null or empty text has no word, no run and an empty
    ``collapsed``; repeated rows and rows with equal or null ids are answered one by one; other columns are not read; an empty table
    gives an empty result. Nothing is shuffled. Memory of a task grows with its longest text, as some 60 bytes a word.
    """
    if min_exponent < 4:
        raise ValueError("seeds are sure for four periods or more")
    kind = docs.schema[id_col].dataType.simpleString()

    def start():
        def f(batch: pa.RecordBatch) -> dict:
            texts = [x or b"" for x in batch.column("_text").to_pylist()]
            n_words, collapsed = [0] * len(texts), [""] * len(texts)
            runs: list[list] = [[] for _ in texts]
            left = sorted(range(len(texts)), key=lambda i: -len(texts[i]))
            while left:
                # texts of similar length together: short ones need no long scales
                part, size = [], 0
                for i in left:
                    if part and (size + len(texts[i]) > SLICE or 4 * len(texts[i]) + 1000 < len(texts[part[0]])):
                        break
                    part.append(i)
                    size += len(texts[i])
                left = left[len(part) :]
                w, ends, known = word_ids([texts[i] for i in part])
                rows = find_runs(w, int(np.diff(ends).max()) - 1, min_length, min_exponent)
                change = np.zeros(len(w) + 1, np.int64)
                np.add.at(change, rows[:, 0] + rows[:, 2], 1)
                np.add.at(change, rows[:, 0] + rows[:, 1], -1)
                kept = (np.cumsum(change)[:-1] == 0) & (w >= 0)
                bounds = np.searchsorted(rows[:, 0], ends)
                for k, i in enumerate(part):
                    a, b = int(ends[k]), int(ends[k + 1]) - 1
                    n_words[i] = b - a
                    own = rows[bounds[k] : bounds[k + 1]] - [a, 0, 0]
                    runs[i] = [dict(zip(("start", "length", "period"), r)) for r in own.tolist()]
                    collapsed[i] = b" ".join(map(known.__getitem__, w[a:b][kept[a:b]].tolist())).decode()
            return {"_id": batch.column("_id"), "n_words": n_words, "runs": runs, "collapsed": collapsed}

        return f

    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("binary").alias("_text"))
    found = map_batches(rows, f"_id {kind}, n_words bigint, runs {RUNS}, collapsed string", start)
    return found.withColumnRenamed("_id", id_col)


def densest(runs: Column) -> Column:
    """The run with the greatest length / period, compared as integers; of equal ones the first."""
    denser = lambda a, r: r["length"] * a["period"] > a["length"] * r["period"]
    return F.when(F.size(runs) > 0, F.reduce(runs, F.get(runs, F.lit(0)), lambda a, r: F.when(denser(a, r), r).otherwise(a)))


def listed(runs: Column) -> Column:
    """``start,length,period`` of every run, each on a line."""
    return F.array_join(F.transform(runs, lambda r: F.concat(r["start"], F.lit(","), r["length"], F.lit(","), r["period"], F.lit("\n"))), "")


def runs_sql() -> str:
    """Runs of the contract's texts over ``documents`` in DuckDB: equal words at every lag, joined to stretches; of equal stretches the smallest lag is the period."""
    crc = "list_reduce([xor(c, b)] || range(8), lambda x, i: CASE WHEN x % 2 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)"
    return rf"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
  xor(4294967295, list_reduce([4294967295::BIGINT] || list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT), lambda c, b: {crc})) AS h FROM documents),
p AS (SELECT *, len(w) AS n, (h // 10) % greatest(len(w), 1) AS a FROM d),
q AS (SELECT *, 1 + (n - a) // (3 + (h // 10) % 8) AS p FROM p),
words AS (SELECT doc_id, n, i, CASE WHEN h % 10 = 0 AND i >= a THEN w[a + (i - a) % p + 1] ELSE w[i + 1] END AS word FROM (SELECT *, unnest(range(n)) AS i FROM q)),
same AS (SELECT x.doc_id, x.i, y.i - x.i AS lag FROM words x JOIN words y ON x.doc_id = y.doc_id AND x.word = y.word AND y.i > x.i AND 4 * (y.i - x.i) <= x.n),
stretches AS (SELECT doc_id, lag, min(i) AS start, count(*) + lag AS length FROM (SELECT *, i - row_number() OVER (PARTITION BY doc_id, lag ORDER BY i) AS island FROM same)
  GROUP BY doc_id, lag, island HAVING count(*) + lag >= greatest(6, 4 * lag)),
runs AS (SELECT doc_id, start, length, min(lag) AS period FROM stretches GROUP BY ALL),
best AS (SELECT * FROM runs QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY length / period DESC, start, period) = 1),
listed AS (SELECT doc_id, count(*) AS n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS runs FROM runs GROUP BY doc_id),
dropped AS (SELECT DISTINCT doc_id, unnest(range(start + period, start + length)) AS i FROM runs),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS text FROM words ANTI JOIN dropped USING (doc_id, i) GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_runs, 0)::BIGINT AS n_runs, start::BIGINT AS start, length::BIGINT AS length, period::BIGINT AS period, (1000 * length // period)::BIGINT AS exponent_milli,
  sha256(coalesce(runs, '')) AS runs_sha256, sha256(coalesce(kept.text, '')) AS collapsed_sha256
FROM d LEFT JOIN best USING (doc_id) LEFT JOIN listed USING (doc_id) LEFT JOIN kept USING (doc_id)
"""
