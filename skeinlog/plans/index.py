"""The search index: whole texts of every session, and postings of their distinct tokens.

``docs(session_key, source, session_id, archive_name, project_path, agent_title, first_prompt, modified)``,
``texts(session_key, unit, seq, kind, text)``.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skeinlog.functions import strings
from skeinlog.functions.text import tokens
from skeinlog.session import cut_lineage, scratch_path

def kind_code(kind: Column | str) -> Column:
    """content 0 (also for unknown kinds), tool 1, reasoning 2."""
    k = F.col(kind) if isinstance(kind, str) else kind
    return F.when(k == "tool", 1).when(k == "reasoning", 2).otherwise(0)


def session_texts(texts: DataFrame, order: tuple[str, ...] = ("unit", "seq")) -> DataFrame:
    """Every text of every session that is not blank, whole."""
    return texts.where(strings.trim("text") != "").select("session_key", *order, kind_code("kind").alias("code"), "text")


def index_tokens(docs: DataFrame, texts: DataFrame) -> DataFrame:
    """Distinct (token, code, session_key), in partitions sorted by (token, session_key); path, id, prompt and title count as content.

    Few tokens of a text come again in another one of its session, so nothing is aggregated before the shuffle; the sort that the
    stored postings need anyway puts equal rows side by side.
    """
    fields = ["project_path", "session_id", "first_prompt", "agent_title"]
    meta = docs.select("session_key", F.lit(0).alias("code"), F.explode(F.array(*fields)).alias("text"))
    parts = meta.unionByName(texts.select("session_key", "code", "text"))
    rows = parts.select(F.explode(F.array_distinct(tokens(F.col("text")))).alias("token"), "code", "session_key").repartition("token", "session_key")
    nth = F.row_number().over(Window.partitionBy("token", "session_key", "code").orderBy("code"))
    return rows.withColumn("__nth", nth).where("__nth = 1").drop("__nth")


# --- persisted index ---------------------------------------------------------------------------------


@dataclass(frozen=True)
class Index:
    docs: DataFrame
    texts: DataFrame
    postings: DataFrame


def write_texts(texts: DataFrame, path: str) -> None:
    """Texts clustered by session."""
    # written before they are ranged: finding the range bounds samples its input, which must not mean parsing twice
    kept = cut_lineage(session_texts(texts), "texts")
    order = ["session_key", "unit", "seq"]
    kept.repartitionByRange(*order).sortWithinPartitions(*order).write.parquet(f"{path}/texts")


def write_postings(docs: DataFrame, path: str) -> None:
    """Documents, and the postings of their fields and of the texts that are stored already.

    Postings are dealt by (token, session) in one shuffle and sorted by them within files: a token look-up reads the pages of every file that
    hold it, and a token found in most sessions is spread over all files.
    """
    read = docs.sparkSession.read.parquet
    docs.write.parquet(f"{path}/docs")
    index_tokens(read(f"{path}/docs"), read(f"{path}/texts")).sortWithinPartitions("token", "session_key").write.parquet(f"{path}/postings")


def write_index(docs: DataFrame, texts: DataFrame, path: str | None = None) -> str:
    """Build and write the index tables."""
    path = path or scratch_path(docs.sparkSession, "index")
    write_texts(texts, path)
    write_postings(docs, path)
    return path


def read_index(spark: SparkSession, path: str) -> Index:
    return Index(*[spark.read.parquet(f"{path}/{t}") for t in ("docs", "texts", "postings")])


def status(index: Index) -> DataFrame:
    """Sessions and distinct tokens of an index."""
    sessions = index.docs.select(F.lit("sessions").alias("measure"))
    distinct = index.postings.select("token").distinct().select(F.lit("tokens").alias("measure"))
    return sessions.unionByName(distinct).groupBy("measure").agg(F.count("*").alias("n"))


def token_frequencies(postings: DataFrame) -> DataFrame:
    return postings.groupBy("token").agg(F.count("*").alias("postings"), F.count_if(F.col("code") == 0).alias("in_content"))


def violations(index: Index) -> DataFrame:
    """Checks of a stored index, one row per check: things checked and things broken, which should be none."""

    def check(rows: DataFrame, name: str, broken: Column) -> DataFrame:
        return rows.agg(F.count_if(broken).alias("broken"), F.count("*").alias("checked")).select(F.lit(name).alias("bound"), "broken", "checked")

    known = index.docs.select("session_key", F.lit(True).alias("known"))
    posted = index.postings.select("session_key").distinct().join(known, "session_key", "left")
    return check(index.postings, "token_form", ~F.col("token").rlike(r"[\p{L}\p{N}]")).unionByName(check(posted, "known_session", F.col("known").isNull()))
