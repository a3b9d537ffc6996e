"""Model contexts: the ordered distinct (provider, model, thinking level) triples of a session."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FIELDS = ["provider", "model", "thinking_level"]


def distinct_contexts(turns: DataFrame, key: str = "session_id") -> DataFrame:
    """First position of each triple; triples without any value are dropped. Folds map-side."""
    named = turns.where("provider is not null or model is not null or thinking_level is not null")
    return named.groupBy(key, *FIELDS).agg(F.min("off").alias("off"))


def context_arrays(turns: DataFrame, key: str = "session_id") -> DataFrame:
    """One ordered array per session. Its length is the number of distinct triples, not of turns."""
    entry = F.struct("off", *FIELDS)
    strip = F.transform(F.array_sort(F.collect_list(entry)), lambda e: F.struct(*[e[f].alias(f) for f in FIELDS]))
    return distinct_contexts(turns, key).groupBy(key).agg(strip.alias("model_contexts"))


def context_text(contexts: Column | str) -> Column:
    """Readable form used for comparisons: provider/model/level joined by a comma."""
    return F.array_join(
        F.transform(contexts, lambda c: F.concat_ws("/", *[F.coalesce(c[f], F.lit("-")) for f in FIELDS])), ","
    )
