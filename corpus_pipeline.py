"""A training corpus from ``documents``: language, near duplicates, benchmark passages, personal data, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written and read again as the next stage's docs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skeinlog.llm import chosen_path, decontamination, language_id, packing, surrogates
from skeinlog.llm.common import written
from skeinlog.llm.queries import KEY, RANKS, VOCABULARY


def _rows(docs: DataFrame) -> DataFrame:
    """(doc_id, text, row): the other columns in one, so that none of them meets a column that an operator adds."""
    others = [F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(docs.columns) if c not in ("doc_id", "text")]
    return docs.select("doc_id", "text", F.struct(*(others or [F.lit(0).alias("none")])).alias("row"))


def _again(found: DataFrame, columns: list[str], **changed: Column) -> DataFrame:
    """The columns that ``_rows`` took, some of them changed."""
    own = {c: F.col(c) if c in ("doc_id", "text") else F.col("row")[f"c{i}"] for i, c in enumerate(columns)}
    return found.select(*[changed.get(c, own[c]).alias(c) for c in columns])


def identified_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the rows whose text has letters in a language that the table's labels teach; ``lang`` becomes the predicted language.

    Null and empty texts have no letter and go; rows with equal or null ids are decided one by one; an empty table stays empty.
    """
    profiles = language_id.train_profiles(docs)
    found = language_id.identify(_rows(docs), profiles, keep=("text", "row")).where("lang_pred <> 'und'")
    return _again(found, docs.columns, lang=F.col("lang_pred"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one row of each group of near duplicates, that with the least id (null ids last; of equal ids the first row read); a null text counts as empty."""
    return chosen_path.one_of_each(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the rows that hold a benchmark item or an edited copy of one; null and empty texts hold none, rows with equal or null ids are told apart by their text."""
    key = F.to_json(F.struct(F.col("doc_id"), F.xxhash64("text").alias("h")))
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    rows = _rows(docs).withColumn("key", key)
    hit = decontamination.contaminated(rows.select("key", "text"), benchmark, id_col="key")
    leaks = written(hit.select("key").distinct(), "leaks")
    return _again(rows.join(leaks, "key", "left_anti"), docs.columns)


def without_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace personal data; ``n_chars`` follows the new text. Null texts stay null, every row stays."""
    found = surrogates.replace_personal_data(_rows(docs), KEY, keep=("row",))
    length = F.coalesce(F.when(F.col("n_entities") > 0, F.length("text").cast("long")), F.col("row")[f"c{docs.columns.index('n_chars')}"]) if "n_chars" in docs.columns else F.lit(None)
    return _again(found, docs.columns, n_chars=length)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all texts in sequences of 1024 tokens; a null text counts as empty, an empty table gives no piece."""
    return packing.pack_documents(docs, VOCABULARY, RANKS, end_id=2, capacity=1024)


STAGES = [
    ("language", identified_language),
    ("near duplicates", near_duplicates),
    ("decontamination", decontaminated),
    ("personal data", without_personal_data),
    ("packing", packed),
]

# Profiles, sampled paths, alignment and tokenisation have no counterpart in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
