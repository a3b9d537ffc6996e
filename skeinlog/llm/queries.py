"""The registered queries of the document operators; each applies one to its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chosen_path, debruijn, decontamination, language_id, license_scan, packing, periodic_runs, quality, ranked_search, spotsigs, suffixes, surrogates, token_counts
from .common import documents, fold

VOCABULARY, RANKS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(documents(spark, sf_dir), VOCABULARY, RANKS, limit=1024)


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text", "lang", (fold("doc_id", 4) == 2).alias("held_out"))
    profiles = language_id.train_profiles(docs.where(~F.coalesce("held_out", F.lit(False))))
    found = language_id.identify(docs, profiles, keep=("held_out",))
    return found.select("doc_id", F.coalesce("held_out", F.lit(False)).alias("held_out"), "lang_pred", "score", "cosine")


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(documents(spark, sf_dir), VOCABULARY, RANKS, end_id=2, capacity=1024)


def op7_quality_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet")
    learn = labels.where(F.col("quality").isNotNull() & F.coalesce(fold("doc_id", 3) != 1, F.lit(False))).select("doc_id", "quality")
    model = quality.train(docs, learn)
    found = quality.score(docs, model)
    return found.select("doc_id", F.coalesce(fold("doc_id", 3) == 1, F.lit(False)).alias("held_out"), "score", "predicted", "n_lines")


def op9_spotsigs_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spotsigs.compare_with_next(documents(spark, sf_dir))


# The key of the registered query; a deployment passes its own secret.
KEY = b"registered query"


def op1_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return surrogates.replace_personal_data(documents(spark, sf_dir), KEY)


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contaminated(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op5_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.repeated_spans(documents(spark, sf_dir), min_length=200).drop("spans")


def op8_chosen_path_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chosen_path.near_duplicates(documents(spark, sf_dir), threshold=0.8, shingle=5)


def op10_debruijn_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return debruijn.repeated_words(documents(spark, sf_dir), k=13).drop("spans")


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of the words of every text; of one id in ten, by crc32, the words from a place on are first made to repeat, as the contract says.

    A null text has no word and no run; a null id leaves its text as it is. Other columns are not read.
    """
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    words = F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))
    docs = documents(spark, sf_dir).select("doc_id", "text", F.when(h % 10 == 0, words).alias("words"), F.floor(h / 10).alias("g"))
    docs = docs.withColumn("n", F.size("words")).withColumn("a", F.when(F.col("n") > 0, F.col("g") % F.col("n")))
    period = F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8)) + 1
    place = lambda i: F.when(i >= F.col("a"), F.col("a") + (i - F.col("a")) % F.col("period")).otherwise(i)
    repeated = F.transform("words", lambda w, i: F.get("words", place(i).cast("int")))
    docs = docs.withColumn("period", period).select("doc_id", F.when(F.col("n") > 0, F.array_join(repeated, " ")).otherwise(F.col("text")).alias("text"))
    found = periodic_runs.periodic_runs(docs).withColumn("best", periodic_runs.densest(F.col("runs")))
    return found.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        "best.start",
        "best.length",
        "best.period",
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(periodic_runs.listed(F.col("runs")), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def op12_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licenses of every text. A null text has no word; rows are answered one by one; other columns are not read."""
    return license_scan.license_scan(documents(spark, sf_dir)).drop("spans")


def op13_nra_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 best documents of every benchmark item. Null texts hold no term, so they neither ask nor answer; other columns are not read."""
    return ranked_search.search(ranked_search.impact_lists(documents(spark, sf_dir)), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), k=20)


QUERIES = {f.__name__: f for f in (op1_pii_surrogates, op2_token_counts, op3_language_id, op4_decontamination, op5_suffix_array_dedup, op6_best_fit_packing, op7_quality_crf, op8_chosen_path_join, op9_spotsigs_fingerprints, op10_debruijn_dedup, op11_periodic_runs, op12_license_scan, op13_nra_search)}
ORACLES: dict[str, str] = {"op11_periodic_runs": periodic_runs.runs_sql(), "op12_license_scan": license_scan.scan_sql(), "op13_nra_search": ranked_search.search_sql(k=20)}
