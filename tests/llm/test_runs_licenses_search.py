"""Periodic runs, license scans and ranked search against brute force written apart from them."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pytest

from skeinlog.llm import license_scan, periodic_runs, queries, ranked_search
from workload.compare import compare, connect

SMALL = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, n long, words string, _ref long, query long, runs string, template long"
LONG = " ".join(f"word{i % 97} of the {i}" for i in range(30000))
CYCLE = "a b c d e " * 2000
TEXTS = [None, "", " \n\t ", "a", "a a a a a a", LONG, CYCLE, CYCLE, "MIT License mit  license MIT\nLICENSE", "é 中文 ٤٤ Ünder the MIT license", "x y x y x y x y x y x y"]


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(i if i != 4 else None, t, "en", 1, "clash", 7, 8, "r", 9) for i, t in enumerate(TEXTS)]
    return spark.createDataFrame([*rows, rows[6], rows[8]], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


# --- runs ----------------------------------------------------------------------------------------------


def brute_runs(w, least=6, periods=4):
    """Every run by trying all lags and keeping those that no smaller lag explains."""
    out, n = [], len(w)
    for q in range(1, n // periods + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            if j > i:
                run = w[i : j + q]
                if len(run) >= max(least, periods * q) and not any(run[d:] == run[:-d] for d in range(1, q)):
                    out.append((i, len(run), q))
            i = j + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def collapsed(w, runs):
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return " ".join(x for i, x in enumerate(w) if i not in gone)


@pytest.mark.parametrize("seed", range(4))
def test_runs_equal_brute_force(seed):
    rng = random.Random(seed)
    for _ in range(120):
        n = rng.randrange(0, 260)
        w = [rng.randrange(rng.choice((1, 2, 3, 5, 50))) for _ in range(n)]
        for _ in range(rng.randrange(4)):
            if n > 12:
                a = rng.randrange(n)
                p = 1 + (n - a) // rng.randrange(3, 11)
                b = rng.randrange(a, n)
                w[a:b] = [w[a + (i - a) % p] for i in range(a, b)]
        assert [tuple(r) for r in periodic_runs.find_runs(np.array(w, np.int64), n, 6, 4).tolist()] == brute_runs(w)


@pytest.mark.parametrize("period", [7, 8, 9, 16, 17, 32, 33, 100, 511, 512, 513])
def test_runs_of_every_scale_at_the_least_length(period):
    rng = np.random.default_rng(period)
    unit = rng.permutation(period) + 10
    for extra in (-1, 0, 1, period // 2):
        w = np.concatenate(([1, 2, 3], np.resize(unit, max(4 * period, 6) + extra), [4, 5]))
        want = [(3, 4 * period + extra, period)] if extra >= 0 else []
        assert [tuple(r) for r in periodic_runs.find_runs(w, len(w), 6, 4).tolist()] == want


def test_runs_never_cross_texts_and_slices_keep_words(monkeypatch):
    monkeypatch.setattr(periodic_runs.slices, "__defaults__", (64,))
    assert b"".join(periodic_runs.slices(CYCLE.encode(), 64)) == CYCLE.encode()
    w, ends, known = periodic_runs.word_ids([b"a b a b a b", b"a b a b a b", CYCLE.encode()])
    assert [known[i] for i in w[ends[2] : ends[3] - 1]] == CYCLE.encode().split()
    assert [tuple(r) for r in periodic_runs.find_runs(w, 10_000, 6, 4).tolist()] == [(int(ends[2]), 10_000, 5)]


def test_runs_on_odd_rows(odd, none):
    got = Counter((r.doc_id, r.n_words, tuple(map(tuple, r.runs)), r.collapsed) for r in periodic_runs.periodic_runs(odd).collect())
    want = Counter()
    for i, t in [*enumerate(TEXTS), (6, CYCLE), (8, TEXTS[8])]:
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        runs = [(0, 10_000, 5)] if t == CYCLE else [] if t == LONG else brute_runs(w)
        want[(i if i != 4 else None, len(w), tuple(runs), collapsed(w, runs))] += 1
    assert got == want
    assert periodic_runs.periodic_runs(none).count() == 0


def test_the_runs_query_equals_brute_force(spark):
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    rows = {r.doc_id: r for r in queries.op11_periodic_runs(spark, SMALL).collect()}
    assert rows.keys() == texts.keys()
    for i, text in texts.items():
        w = re.findall(r"[^\x20\x09-\x0D]+", text)
        h, n = zlib.crc32(str(i).encode()), len(w)
        if h % 10 == 0 and n:
            a, g = h // 10 % n, h // 10
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[j if j < a else a + (j - a) % p] for j in range(n)]
        elif n > 1500:
            continue
        runs = brute_runs(w) if n <= 1500 else [tuple(r) for r in periodic_runs.find_runs(np.unique(w, return_inverse=True)[1], n, 6, 4).tolist()]
        best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=(None, None, None))
        r = rows[i]
        assert (r.n_runs, r.start, r.length, r.period) == (len(runs), *best)
        assert r.exponent_milli == (1000 * best[1] // best[2] if runs else None)
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        assert r.runs_sha256 == sha("".join(f"{s},{m},{q}\n" for s, m, q in runs)) and r.collapsed_sha256 == sha(collapsed(w, runs))


@pytest.mark.parametrize("name", ["op11_periodic_runs", "op12_license_scan", "op13_nra_search"])
def test_queries_match_their_statements(spark, name):
    rows, problems = compare(spark, connect(SMALL), name, queries.QUERIES[name], queries.ORACLES[name], SMALL)
    assert rows and not problems, problems


# --- licenses ------------------------------------------------------------------------------------------


def lowered(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def scan(df):
    return {(r.doc_id, r.n_words): r for r in license_scan.license_scan(df).collect()}


def test_license_places_on_odd_rows(odd, none):
    rows = license_scan.license_scan(odd).collect()
    assert len(rows) == len(TEXTS) + 2
    for r in rows:
        if r.doc_id is None:
            continue
        w = lowered(TEXTS[r.doc_id])
        places = [i for p in ("mit license", "apache license", "general public license") for i in range(len(w)) if w[i : i + len(p.split())] == p.split()]
        assert (r.n_words, r.n_base, r.first_word, r.last_word) == (len(w), len(places), min(places, default=None), max(places, default=None))
        assert r.base_labels == ("mit" if places else "") and (r.score == 1.0) == bool(places)
    assert sum(r.n_base for r in rows if r.doc_id == 8) == 6
    assert license_scan.license_scan(none).count() == 0


def test_edited_and_repeated_notices_are_found_and_clean_text_is_not(spark):
    bsd = next(t for n, t in license_scan.NOTICES if n == "bsd").split()
    mit = license_scan.NOTICES[1][1].split()
    filler = "the quick brown fox of the hill and the river in the morning".split()
    inserted = [x for i, w in enumerate(bsd) for x in ([w, "NEW"] if i % 15 == 7 else [w])]
    deleted = [w for i, w in enumerate(mit) if i % 20 != 9]
    docs = {0: filler * 5 + inserted + filler, 1: deleted, 2: filler * 50, 3: bsd[: len(bsd) // 2], 4: (mit + filler) * 40, 5: mit + ["x"] * 3 + bsd, 6: "software is provided to any person under the".split()}
    rows = scan(spark.createDataFrame([(i, " ".join(w)) for i, w in docs.items()], "doc_id long, text string"))
    got = {i: r for (i, _), r in rows.items()}
    assert {i: r.labels for i, r in got.items()} == {0: "bsd", 1: "mit", 2: "", 3: "", 4: "mit", 5: "bsd,mit", 6: ""}
    span = got[0].spans[0]
    assert span.start == len(filler) * 5 and span.end == len(filler) * 5 + len(inserted) and span.score == 1.0
    assert 0.75 <= got[1].spans[0].score < 1
    assert len(got[4].spans) == 40 and all(s.score == 1.0 for s in got[4].spans)
    assert [(s.label, s.start) for s in got[5].spans] == [("mit", 0), ("bsd", len(lowered(" ".join(mit))) + 3)]
    assert 0.4 < got[3].score < 0.75 and got[2].score < 0.3


def test_license_scan_is_native(spark):
    plan = license_scan.license_scan(spark.read.parquet(f"{SMALL}/documents.parquet"))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas|CartesianProduct|NestedLoop", plan) and "BroadcastHashJoin" in plan


# --- search --------------------------------------------------------------------------------------------


def terms_of(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute_search(docs, items, k):
    held = [(i, Counter(terms_of(t)), len(terms_of(t))) for i, t in docs if terms_of(t)]
    n_docs, n_terms = len(held), sum(n for *_, n in held)
    df = Counter(t for _, c, _ in held for t in c)
    out = []
    for item, text in items:
        scored = []
        for i, c, n in held:
            m = 75 + 25 * n * n_docs // n_terms
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 12 * m)) for t in terms_of(text) if t in c)
            if score > 0:
                scored.append((-score, i is None, i or 0, i))
        out += [(item, rank, s[3], -s[0]) for rank, s in enumerate(sorted(scored)[:k], 1)]
    return sorted(out, key=str)


@pytest.mark.parametrize("first, shard", [(1, 40), (4, 300), (64, 1 << 21)])
def test_search_equals_brute_force(spark, monkeypatch, first, shard):
    monkeypatch.setattr(ranked_search, "FIRST_READ", first)
    monkeypatch.setattr(ranked_search, "SHARD_TERMS", shard)
    monkeypatch.setattr(ranked_search, "BLOCK_TERMS", 30 if first == 1 else 200_000)
    rng = random.Random(first)
    zipf = [f"w{int(rng.paretovariate(0.7)) % 60}" for _ in range(4000)]
    docs = [(i, " ".join(rng.sample(zipf, rng.randrange(0, 30)))) for i in range(150)]
    docs += [(200 + i, docs[3][1]) for i in range(40)] + [(7, "W1 w2 w2"), (None, docs[3][1]), (None, None), (500, ""), (501, "!!"), (502, "é É w1")]
    items = [(0, docs[3][1]), (1, "w1 w1 w2 unseen"), (2, "unseen only"), (3, None), (4, " ".join(f"w{i}" for i in range(60))), (5, "É"), (5, "W1, w2; w1"), (None, "w3")]
    lists = ranked_search.impact_lists(spark.createDataFrame(docs, "doc_id long, text string").repartition(3))
    got = sorted(((r.item_id, r.rank, r.doc_id, r.score) for r in ranked_search.search(lists, spark.createDataFrame(items, "item_id long, text string"), 20).collect()), key=str)
    assert got == brute_search(docs, items, 20)


def test_nra_stops_before_the_lists_end():
    """With one clear winner per list the tails are not read, and ties at the edge are."""
    reads = []

    class Counted(np.ndarray):
        def __getitem__(self, key):
            if isinstance(key, slice) and key.start is not None:
                reads.append(key.stop)
            return super().__getitem__(key)

    n = 50_000
    docs = np.arange(n)
    impacts = np.concatenate((np.arange(10_000, 9_900, -1), np.full(n - 100, 5)))
    best, scores = ranked_search.nra([(docs.view(Counted), impacts, 3), (docs.view(Counted), impacts, 1)], n, 20)
    assert best.tolist() == list(range(20)) and scores.tolist() == [4 * (10_000 - i) for i in range(20)] and max(reads) < 1000
    tied, _ = ranked_search.nra([(docs[::-1].copy(), np.full(n, 7), 1)], n, 3)
    assert tied.tolist() == [0, 1, 2]


def test_search_on_odd_and_empty_tables(spark, odd, none):
    lists = ranked_search.impact_lists(odd)
    heads = lists.where("term IS NULL").collect()
    assert sorted(str(i) for h in heads for i in h.ids) == sorted(str(i if i != 4 else None) for i, t in [*enumerate(TEXTS), (6, 1), (8, 1)] if t is None or t == 1 or t.strip() if t)
    per_list = defaultdict(list)
    for r in lists.where("term IS NOT NULL").collect():
        per_list[r.term].append(r.impacts)
        assert r.n == len(r.docs) == len(set(r.docs)) and r.impacts == sorted(r.impacts, reverse=True)
    items = spark.createDataFrame([(1, "mit license")], "item_id long, text string")
    assert [r.doc_id for r in ranked_search.search(lists, items, 2).collect()] == [8, 8]
    assert ranked_search.search(ranked_search.impact_lists(none), items).count() == 0
    assert ranked_search.search(lists, items.where("false")).count() == 0
