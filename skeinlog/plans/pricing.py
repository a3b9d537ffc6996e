"""Price look-up, cost estimates and the price refresh report."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skeinlog.functions import pricing as P
from skeinlog.plans import usage

PRICE_SCHEMA = "match string, input double, output double"


def price_table(spark: SparkSession, rows: list[tuple[str, float, float]] | None = None) -> DataFrame:
    """Price rows with their table position."""
    rows = P.DEFAULT_PRICES if rows is None else rows
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], f"pos int, {PRICE_SCHEMA}")


def match_prices(models: DataFrame, prices: DataFrame) -> DataFrame:
    """(model, input, output): the most specific price row whose match is a prefix of the model.

    The longest raw match wins, ties go to the earlier row. The prefix test is an equi join on exploded
    prefixes of the distinct models, so neither side has to be small.
    """
    c = F.col("c")
    distinct = models.select("model").distinct().withColumn("c", P.qualified_id(F.col("model")))

    def prefixes(text, of_full: bool):
        cuts = F.transform(F.sequence(F.lit(0), F.length(text)), lambda i: F.substring(text, F.lit(1), i))
        return F.transform(cuts, lambda p: F.struct(p.alias("prefix"), F.lit(of_full).alias("of_full")))

    # a bare match may also be a prefix of the whole qualified id
    both = F.concat(prefixes(c["model"], False), F.when(c["provider"].isNotNull(), prefixes(c["full"], True)).otherwise(F.slice(prefixes(c["full"], True), 1, 0)))
    keyed = distinct.select("model", c["provider"].alias("provider"), F.explode(both).alias("k")).select("model", "provider", "k.*")
    rows = prices.where(F.trim("match") != "").withColumn("m", P.qualified_id(F.col("match"))).select(
        "pos", "match", "input", "output", F.col("m.model").alias("prefix"), F.col("m.provider").alias("row_provider")
    )
    fits = F.when(F.col("row_provider").isNull(), F.lit(True)).otherwise(
        ~F.col("of_full") & (F.col("provider").isNull() | (F.col("provider") == F.col("row_provider")))
    )
    best = F.struct(F.length("match").alias("len"), (-F.col("pos")).alias("rank"))
    return (
        keyed.join(rows, "prefix")
        .where(fits)
        .groupBy("model")
        .agg(F.max_by(F.struct("match", "input", "output"), best).alias("p"))
        .select("model", F.col("p.match").alias("matched"), F.col("p.input").alias("input"), F.col("p.output").alias("output"))
    )


def cost_by_model(sessions: DataFrame, prices: DataFrame) -> DataFrame:
    buckets = usage.by_model(sessions).withColumnRenamed("key", "model")
    priced = buckets.join(match_prices(buckets, prices), "model", "left")
    estimate = P.cost(F.col("input_tokens"), F.col("cache_tokens"), F.col("output_tokens"), F.col("input"), F.col("output"))
    return priced.select("model", "matched", "sessions", "input_tokens", "output_tokens", "cache_tokens", "total_tokens", estimate.alias("cost"))


def cost_total(sessions: DataFrame, prices: DataFrame) -> DataFrame:
    """Total estimate, flagged when a model with tokens has no price."""
    rows = cost_by_model(sessions, prices)
    return rows.agg(
        F.coalesce(F.sum("cost"), F.lit(0.0)).alias("cost"),
        F.coalesce(F.bool_or(F.col("cost").isNull() & (F.col("total_tokens") > 0)), F.lit(False)).alias("has_unknown"),
    )


def catalog_index(catalog: DataFrame) -> DataFrame:
    """One catalog entry per normalised id; variants are skipped, aliases (``~``) lose to real ids.

    ``catalog(pos, id, canonical_slug, prompt, completion)``, ``pos`` being the catalog order.
    """
    rows = catalog.where(~F.col("id").contains(":")).select(
        "pos", "id", "prompt", "completion", F.explode(F.array_compact(F.array("id", "canonical_slug"))).alias("name")
    )
    preferred = F.struct(F.col("id").startswith("~").alias("alias"), F.col("pos"))
    return (
        rows.groupBy(P.normalized_id(F.col("name")).alias("normalized"))
        .agg(F.min_by(F.struct("id", "prompt", "completion"), preferred).alias("e"))
        .select("normalized", F.col("e.id").alias("matched_model"), P.per_million(F.col("e.prompt")).alias("input"), P.per_million(F.col("e.completion")).alias("output"))
    )


def refresh_report(models: DataFrame, catalog: DataFrame) -> DataFrame:
    """Every discovered model with its catalog price; unmatched models keep nulls."""
    keyed = models.withColumn("normalized", P.normalized_id(F.col("model")))
    return keyed.join(catalog_index(catalog), "normalized", "left").select("model", "input", "output", "matched_model")


def fallback_report(models: DataFrame) -> DataFrame:
    """Offline report: exact built-in prices, plus built-in models nobody has used yet."""
    spark = models.sparkSession
    built_in = spark.createDataFrame(P.FALLBACK_PRICES, "matched_model string, input double, output double")
    keyed = models.withColumn("normalized", P.normalized_id(F.col("model")))
    known = keyed.join(built_in, F.col("normalized") == F.col("matched_model"), "left").select("model", "input", "output", "matched_model")
    unseen = built_in.join(keyed, F.col("matched_model") == F.col("normalized"), "left_anti").select(
        F.col("matched_model").alias("model"), "input", "output", "matched_model"
    )
    return known.unionByName(unseen)


def read_catalog(spark: SparkSession, path: str) -> DataFrame:
    """Catalog file ``{"data": [{id, canonical_slug, pricing: {prompt, completion}}]}``."""
    schema = "data array<struct<id:string,canonical_slug:string,pricing:struct<prompt:string,completion:string>>>"
    rows = spark.read.schema(schema).json(path, multiLine=True)
    return rows.select(F.posexplode("data").alias("pos", "e")).select(
        "pos", "e.id", "e.canonical_slug", F.col("e.pricing.prompt").alias("prompt"), F.col("e.pricing.completion").alias("completion")
    )
