import hashlib
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from skeinlog.llm import chosen_path, debruijn, decontamination, language_id, packing, quality, queries, spotsigs, suffixes, surrogates, token_counts
from skeinlog.llm.common import mix, run_hashes, written

SMALL = "/root/testdata/sf0.001"
KEY = b"test"
LONG = " ".join(f"word{i % 97} of the {i}" for i in range(3000))
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n_tokens long, score double, _ref long, name string"
TEXTS = [None, "", "  \n\n ", "a", "one two", LONG, LONG, LONG + " end", "x  y\r\n\tz <|endoftext|> é 中文   q", "Mr. John Smith of a.b@c.example.com, +1 (212) 555-0100, 10.0.0.1."]


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(i if i != 3 else None, t, None, None, None, None, None, None, None) for i, t in enumerate(TEXTS)]
    return written(spark.createDataFrame([*rows, rows[5], rows[5]], SCHEMA).repartition(3), "odd")


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def small(spark):
    return sorted((r.doc_id, r.text or "") for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect())


def covered(n, starts, length):
    out = np.zeros(n, bool)
    for s in starts:
        out[s : s + length] = True
    return out


def test_token_counts_equal_the_library(odd, none):
    tok = Tokenizer.from_file(queries.VOCABULARY)
    got = sorted((r.n_bytes, r.n_tokens) for r in token_counts.token_counts(odd, queries.VOCABULARY, queries.RANKS, table_size=8).collect())
    texts = [t or "" for t in [*TEXTS, LONG, LONG]]
    assert got == sorted((len(t.encode()), len(tok.encode(t, add_special_tokens=False).ids)) for t in texts)
    assert token_counts.token_counts(none, queries.VOCABULARY, queries.RANKS).count() == 0


def test_packing_is_gapless_and_whole(odd, none):
    tok = Tokenizer.from_file(queries.VOCABULARY)
    rows = packing.pack_documents(odd, queries.VOCABULARY, queries.RANKS).collect()
    places = defaultdict(list)
    for r in rows:
        places[r.sequence_id].append((r.offset, r.length))
    for p in places.values():
        end = 0
        for offset, length in sorted(p):
            assert offset == end
            end += length
        assert end <= 1024
    ids = np.array([*tok.encode(TEXTS[8], add_special_tokens=False).ids, 2], "<u4")
    assert [(r.start, r.length, r.ids_crc32) for r in rows if r.doc_id == 8] == [(0, len(ids), zlib.crc32(ids.tobytes()))]
    assert packing.pack_documents(none, queries.VOCABULARY, queries.RANKS).count() == 0


def test_best_fit_takes_the_tightest_open_sequence():
    p = packing.BestFit(10, open_max=2)
    assert [p.place(x) for x in (6, 7, 3, 4, 9, 8)] == [(0, 0), (1, 0), (1, 7), (0, 6), (2, 0), (3, 0)]


def test_language_profiles_predict_held_out_documents(spark, odd, none):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang")
    found = queries.op3_language_id(spark, "/root/testdata/sf0.01").join(docs, "doc_id").where("held_out").collect()
    assert np.mean([r.lang == r.lang_pred for r in found]) > 0.97
    assert all(0 <= r.score <= 1 for r in found)
    profiles = language_id.train_profiles(none)
    assert {r.lang_pred for r in language_id.identify(odd, profiles).collect()} == {"und"}
    assert language_id.identify(none, profiles).count() == 0


def test_forward_backward_equals_enumeration():
    rng = np.random.default_rng(3)
    emit, pair = rng.normal(size=(4, 2)), rng.normal(size=(2, 2))
    weight = {y: np.exp(sum(emit[t, (y >> t) & 1] for t in range(4)) + sum(pair[(y >> t) & 1, (y >> t + 1) & 1] for t in range(3))) for y in range(16)}
    want = [[sum(w for y, w in weight.items() if (y >> t) & 1 == k) / sum(weight.values()) for k in (0, 1)] for t in range(4)]
    got, _ = quality.forward_backward(emit[None], pair, np.ones((1, 4), bool))
    assert np.allclose(got[0], want) and np.allclose(quality._long_chain(emit, pair), want)


def test_quality_separates_held_out_labels(spark, odd, none):
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    found = queries.op7_quality_crf(spark, "/root/testdata/sf0.01").where("held_out").join(labels, "doc_id").where("quality IS NOT NULL").collect()
    assert np.mean([r.predicted == r.quality for r in found]) > 0.95
    model = quality.train(none, labels.limit(0))
    assert all(abs(r.score - 0.5) < 1e-9 for r in quality.score(odd, model).collect())
    assert quality.score(none, model).count() == 0


def test_surrogates_keep_type_and_distinctness(odd, none):
    r = next(r for r in surrogates.replace_personal_data(odd, KEY).collect() if r.doc_id == 9)
    assert [e.kind for e in r.entities] == ["name", "email", "phone", "ip"]
    assert not any(x in r.text for x in ("John", "Smith", "a.b@c", "555-0100", "10.0.0.1")) and r.text.startswith("Mr. ")
    assert surrogates._given("John", KEY) in surrogates.GIVEN["latin", "m"]
    assert len({surrogates.surrogate("ssn", f"{i:03d}-12-3456", KEY) for i in range(1000)}) == 1000
    card = surrogates.surrogate("card", "4539 1488 0343 6467", KEY)
    assert card[4] == " " and surrogates._check_digit(surrogates._digits(card)[:-1]) == int(card[-1])
    assert surrogates._digits(surrogates.surrogate("phone", "+1 212 555 0100", KEY)) == surrogates._digits(surrogates.surrogate("phone", "+1 (212) 555-0100", KEY))
    assert surrogates.replace_personal_data(none, KEY).count() == 0 and surrogates.colliding(odd, KEY).count() == 0


@pytest.mark.parametrize(
    "text, kept",
    [
        ("call +٤٤ ٢٠ ٧٩٤٦ ٠٩٥٨ now", r"call \+٤٤ [٠-٩]{2} [٠-٩]{4} [٠-٩]{4} now"),
        ("card １２３４５６７８９０１２３４５６７ end", r"card [０-９]{17} end"),
        ("id १२३-४५-६७८९.", r"id [०-९]{3}-[०-९]{2}-[०-९]{4}\."),
        ("Mr 王小明 came", r"Mr [\u4e00-\u9fa5]{2}明 came"),
        ("Dr محمد and Mr יעקב", r"Dr \S{4} and Mr \S{4}"),
    ],
)
def test_surrogates_of_other_scripts_keep_the_script(spark, text, kept):
    import re

    row = surrogates.replace_personal_data(spark.createDataFrame([(1, text)], "doc_id long, text string"), KEY).first()
    assert row.n_entities >= 1 and row.text != text and re.fullmatch(kept, row.text)


def test_numbers_in_other_digits_are_the_same_number():
    ascii_, arabic = surrogates.surrogate("phone", "+44 20 7946 0958", KEY), surrogates.surrogate("phone", "+٤٤ ٢٠ ٧٩٤٦ ٠٩٥٨", KEY)
    assert surrogates._digits(ascii_) == surrogates._digits(arabic) and surrogates.canonical("phone", "+٤٤ ٢٠") == "+4420"


def test_decontamination_finds_exact_and_edited_items_only(spark, odd, none):
    item = "the quick brown fox jumps over one lazy dog while seven clever cats watch from a warm red roof"
    edited = item.replace("brown", "dark").replace("clever", "very clever").replace("warm ", "")
    docs = spark.createDataFrame([(1, "before " + item + " after"), (2, edited.upper()), (3, "the cats watch from a warm place"), (4, None)], "doc_id long, text string")
    bench = spark.createDataFrame([(7, item), (8, None), (9, "")], "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.score for r in decontamination.contaminated(docs, bench, block_items=1).collect()}
    assert set(got) == {(1, 7), (2, 7)} and got[1, 7] == 1.0 > got[2, 7] > 0.7
    assert decontamination.contaminated(odd, bench).count() == 0
    assert decontamination.contaminated(none, bench).count() == decontamination.contaminated(docs, bench.limit(0)).count() == 0


@pytest.mark.parametrize("edit", ["1 in 4", "1 in 6", "inserted"])
@pytest.mark.parametrize("beside_exact", [False, True])
def test_decontamination_loses_no_edited_copy(spark, beside_exact, edit):
    rng = np.random.default_rng(11)
    common = [f"c{i}" for i in range(30)]
    word = lambda i: common[rng.integers(30)] if rng.random() < 0.5 else f"r{i}-{rng.integers(500)}"
    bench = [(i, [word(i) for _ in range(40 + i)]) for i in range(12)]
    around = lambda: [common[k] for k in rng.integers(0, 30, 60)]
    texts = []
    for _, w in bench:
        if edit == "inserted":  # no two words in a row stay together
            changed = [x for k, v in enumerate(w) for x in ((v, f"y{k}") if k % 2 else (v,))]
        else:
            n = int(edit[-1])
            changed = [f"x{k}" if k % n == n - 1 else v for k, v in enumerate(w)]
        texts.append([*around(), *changed, *around()])
        texts += [around() + w] if beside_exact else []
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string").repartition(3)
    items = spark.createDataFrame([(i, " ".join(w)) for i, w in bench], "item_id long, text string")
    number = {w: k + 1 for k, w in enumerate(sorted({x for t in [*texts, *(w for _, w in bench)] for x in decontamination.WORD.findall(" ".join(t))}))}
    coded = lambda w: np.array([number[x] for x in decontamination.WORD.findall(" ".join(w))], np.uint32)
    want = {}
    for d, t in enumerate(texts):
        for i, w in bench:
            share = decontamination.align(coded(w), coded(t))[0] / (2 * len(coded(w)))
            if share >= 0.5:
                want[d, i] = share
    got = {(r.doc_id, r.item_id): r.score for r in decontamination.contaminated(docs, items).collect()}
    assert got == pytest.approx(want) and len(want) >= 12 * (1 + beside_exact)


@pytest.mark.parametrize("period", [3, 13, 133])
def test_repeated_bytes_equal_brute_force(spark, small, period):
    docs, count = [(d, t.encode()) for d, t in small], defaultdict(int)
    for _, b in docs:
        for i in range(len(b) - 199):
            count[b[i : i + 200]] += 1
    want = {}
    for d, b in docs:
        gone = covered(len(b), [i for i in range(len(b) - 199) if count[b[i : i + 200]] > 1], 200)
        want[d] = (len(b), int(gone.sum()), hashlib.sha256(np.frombuffer(b, np.uint8)[~gone].tobytes()).hexdigest())
    got = suffixes.repeated_spans(queries.documents(spark, SMALL), period=period).collect()
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.kept_sha256) for r in got} == want


def test_repeated_words_equal_brute_force(spark, small):
    first, want = {}, {}
    docs = [(d, debruijn.split_words(t)) for d, t in small]
    for d, w in docs:
        for i in range(len(w) - 12):
            first.setdefault(tuple(w[i : i + 13]), d)
    for d, w in docs:
        gone = covered(len(w), [i for i in range(len(w) - 12) if first[tuple(w[i : i + 13])] < d], 13)
        want[d] = (len(w), int(gone.sum()), hashlib.sha256(" ".join(x for x, g in zip(w, gone, strict=True) if not g).encode()).hexdigest())
    got = queries.op10_debruijn_dedup(spark, SMALL).collect()
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in got} == want


def test_texts_with_many_samples_are_taken_in_slices(spark):
    from skeinlog.llm.common import map_batches

    rows = spark.range(0, 1203, 1, 1)
    lengths = lambda: lambda batch: {"n": [batch.num_rows], "least": [batch.column("id")[0].as_py()]}
    got = map_batches(rows, "n long, least long", lengths, rows=suffixes.SLICE).collect()
    assert [(r.n, r.least) for r in got] == [(500, 0), (500, 500), (203, 1000)]
    assert [r.n for r in map_batches(rows, "n long, least long", lengths).collect()] == [1203]


def test_samples_are_shuffled_in_shares(spark, monkeypatch):
    steps, named = [], suffixes.named
    monkeypatch.setattr(suffixes, "named", lambda samples: steps.append(written(samples, "share")) or named(steps[-1]))
    last = suffixes.repeated_spans(queries.documents(spark, SMALL))
    *shares, _ = steps
    names = [{r.name for r in x.select("name").distinct().collect()} for x in shares]
    every, sizes = set().union(*names), [x.count() for x in shares]
    # a share is about a half of the names, none is in two, and all places of the cover are there
    assert max(sizes) < 0.6 * sum(sizes) and sum(map(len, names)) == len(every)
    cover = np.array(suffixes.difference_cover(suffixes.PERIOD))
    lengths = [len((r.text or "").encode()) for r in queries.documents(spark, SMALL).select("text").collect()]
    assert sum(sizes) == sum(int((suffixes.cover_places(n, suffixes.PERIOD, cover) <= n - 68).sum()) for n in lengths if n >= 200)
    # the last step shuffles texts for the cut alone
    assert last._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1


def test_samples_do_not_depend_on_blocks():
    import pyarrow as pa

    texts = ["", "ab" * 150, LONG[:199], LONG, "é" * 400, LONG[5:] + "x", "q" * 1000]
    batch = pa.RecordBatch.from_arrays([pa.array(range(10, 17), pa.int64()), pa.array(texts)], names=["_ref", "_text"])
    cover = np.array(suffixes.difference_cover(133))

    def rows(part=0, parts=1, block=1 << 17):
        found = suffixes.sampler(68, 200, lambda n, _: suffixes.cover_places(n, 133, cover), part, parts, block)(batch)
        return list(zip(*(found[c].tolist() for c in ("_ref", "name", "around", "place")), strict=True))

    every = rows()
    assert rows(block=1) == rows(block=2000) == every and sorted(rows(0, 2) + rows(1, 2)) == sorted(every)
    bytes_of, kinds = {10 + i: t.encode() for i, t in enumerate(texts)}, defaultdict(set)
    for ref, name, around, p in every:
        kinds[bytes_of[ref][p : p + 68]].add(name)
        kinds[bytes_of[ref][max(p - 132, 0) : p + 200], min(p, 132)].add((name, around))
    assert all(len(x) == 1 for x in kinds.values()) and len({r[1] for r in every}) == sum(isinstance(k, bytes) for k in kinds)


def test_repeats_on_odd_rows(odd, none):
    by_bytes = suffixes.repeated_spans(odd).collect()
    assert sorted(r.n_bytes - r.n_removed for r in by_bytes if r.n_bytes > 300)[:4] == [0, 0, 0, 0]
    assert len(by_bytes) == 12 and suffixes.repeated_spans(none).count() == 0
    by_words = debruijn.repeated_words(odd).collect()
    assert sorted(r.n_removed > 0 for r in by_words if r.doc_id == 5) == [False] * 3
    assert all(r.n_removed == r.n_words for r in by_words if r.doc_id == 6)
    assert debruijn.repeated_words(none).count() == 0


@pytest.mark.parametrize("module, query", [(suffixes, suffixes.repeated_spans), (debruijn, debruijn.repeated_words), (chosen_path, chosen_path.near_duplicates), (chosen_path, chosen_path.one_of_each)])
def test_rows_keep_their_number_when_splits_change(spark, monkeypatch, module, query):
    def found():
        return sorted(map(str, query(queries.documents(spark, SMALL)).collect()))

    want, before = found(), spark.conf.get("spark.sql.files.maxPartitionBytes")
    # between two jobs, as with other executors than before
    monkeypatch.setattr(module, "release", lambda s: s.conf.set("spark.sql.files.maxPartitionBytes", "20000"))
    try:
        assert found() == want
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_join_equals_brute_force_with_large_groups(spark):
    rng = np.random.default_rng(5)
    base = [f"w{i}" for i in range(120)]
    texts = []
    for i in range(300):
        w = list(base)
        for at in rng.integers(0, 120, rng.integers(0, 3)):
            w[at] = f"e{i}"
        texts.append(" ".join(w))
    texts += [" ".join([*(f"p{j}" for j in range(12)), *(f"q{i}-{j}" for j in range(40))]) for i in range(60)] + texts[:5]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    docs = written(docs, "groups")
    hashes = chosen_path.WordHashes()
    distinct = sorted(set(texts))
    sets = [chosen_path.shingles(hashes.of(t.split()), 5) for t in distinct]
    both, n = chosen_path.overlaps(sets, sets), np.array([len(s) for s in sets])
    links = dict(zip(distinct, ((both / (n[:, None] + n - both)) >= 0.8).sum(1) - 1, strict=True))
    got = chosen_path.near_duplicates(docs, bucket=40).collect()
    assert sum(r.n_links == links[texts[r.doc_id]] for r in got) >= 0.99 * len(got)
    assert chosen_path.one_of_each(docs, bucket=40).where("doc_id >= 300").count() == 60


def test_components_equal_union_find_and_drop_joined_edges(spark, monkeypatch):
    rng = np.random.default_rng(11)
    pairs = [(1, i) for i in range(2, 60)] + [(i, i + 1) for i in range(100, 160)] + [(i + 1, i) for i in range(200, 230)]
    pairs += [tuple(p) for p in rng.integers(300, 420, (90, 2)).tolist()] + [(7, 7), (900, 900)]
    links = chosen_path.Links(1000)
    for a, b in pairs:
        links.join(a, b)
    sizes, plain = {}, chosen_path.written
    monkeypatch.setattr(chosen_path, "written", lambda df, label: sizes.__setitem__(label, (made := plain(df, label)).count()) or made)
    got = {r.k: r.root for r in chosen_path.components(spark.createDataFrame(pairs, "a long, b long"), "c").collect()}
    assert got == {k: links.root(k) for k in {x for a, b in pairs if a != b for x in (a, b)}}
    # edges within what is joined already are not read again
    assert sizes["c-edges-1"] < sizes["c-edges"] / 5


def test_likeness_to_a_pivot_equals_sets():
    rng = np.random.default_rng(3)
    sets = [np.unique(rng.integers(0, 60, n).astype(np.uint64)) for n in (1, 5, 20, 60, 90, 200)]
    sketches = [chosen_path.sketch(s) for s in sets]
    for pivot in sketches:
        p = np.frombuffer(pivot, "<u4")
        both, union = chosen_path.likeness(sketches, pivot)
        for i, s in enumerate(sketches):
            x = np.frombuffer(s, "<u4")
            top = min([v[-1] for v in (x, p) if len(v) == chosen_path.SKETCH], default=2**32 - 1)
            a, b = set(x[x <= top].tolist()), set(p[p <= top].tolist())
            assert (both[i], union[i]) == (len(a & b), len(a | b))


def test_run_hashes_depend_on_the_run_alone():
    words = mix(np.arange(40).astype(np.uint64))
    for n in (1, 2, 3, 5, 8, 13):
        whole = run_hashes(words, n)
        assert len(whole) == 41 - n == len(set(whole.tolist())) and not set(whole.tolist()) & set(run_hashes(words, n, seed=1).tolist())
        assert all(run_hashes(words[i : i + n], n)[0] == whole[i] for i in range(41 - n))
    assert len(run_hashes(words[:4], 5)) == 0


def test_join_on_odd_rows(odd, none):
    got = chosen_path.near_duplicates(odd).collect()
    assert len(got) == 12 and {r.class_id for r in got if r.doc_id in (5, 6, 7)} == {5} and {r.n_links for r in got if r.doc_id in (5, 6, 7)} == {1}
    assert chosen_path.near_duplicates(none).count() == 0 and chosen_path.one_of_each(odd).columns == odd.columns


def test_spot_signatures_of_texts_and_their_edits(spark, small, odd, none):
    got = {r.doc_id: r for r in queries.op9_spotsigs_fingerprints(spark, SMALL).collect()}
    spots = spotsigs.Spots()
    for i, (d, t) in enumerate(small):
        changed = spotsigs.edited(t, small[(i + 1) % len(small)][1])
        assert got[d].edited_sha256 == hashlib.sha256(changed.encode()).hexdigest() and got[d].n_chars == len(t)
        assert got[d].fingerprint == spotsigs.packed(spots.of(t)) and got[d].edited_fingerprint == spotsigs.packed(spots.of(changed))
    assert spotsigs.compare_with_next(odd).count() == 12 and spotsigs.compare_with_next(none).count() == 0
    prints = spotsigs.fingerprints(spark.createDataFrame([(1, LONG), (2, LONG), (3, LONG + " the brand new words here"), (4, "of other things entirely")], "doc_id long, text string"))
    assert [round(r.likeness, 1) for r in spotsigs.near_duplicates(prints).collect()] == [1.0]


def test_pipeline_equals_its_stages(spark, odd):
    import corpus_pipeline

    assert [name for name, _ in corpus_pipeline.STAGES] == ["language", "near duplicates", "decontamination", "personal data", "packing"]
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    kept = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, kept, SMALL)
        assert kept.columns == docs.columns
    ids = {r.doc_id for r in corpus_pipeline.run(spark, SMALL).select("doc_id").collect()}
    assert ids == {r.doc_id for r in kept.select("doc_id").collect()} and len(ids) > 150
    for _, stage in corpus_pipeline.STAGES:
        stage(spark, odd.select(docs.columns), SMALL).count()


def test_pipeline_carries_columns_with_clashing_names(spark):
    import corpus_pipeline

    names = ["score", "cosine", "entities", "n_entities", "lang_pred", "row", "key", "_row", "_id", "_k0", "_ref", "a b"]
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("*", *[F.concat(F.lit(f"{n} "), F.col("doc_id").cast("string")).alias(n) for n in names])
    kept = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        if name != "near duplicates":
            kept = written(stage(spark, kept, SMALL), "stage")
            assert kept.columns == docs.columns
    rows = kept.collect()
    assert len(rows) > 150 and all(r[n] == f"{n} {r.doc_id}" for r in rows for n in names)
    assert corpus_pipeline.STAGES[1][1](spark, docs, SMALL).columns == docs.columns
