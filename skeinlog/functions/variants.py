"""Column helpers over VARIANT values.

A transcript line is parsed once with ``try_parse_json``; every later access is a path lookup in the
binary value, so no field costs a second JSON parse.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from skeinlog.functions import strings


def parse(line: Column | str) -> Column:
    return F.try_parse_json(line)


def with_parsed(rows: DataFrame, column: str = "line", counts: Observation | None = None) -> DataFrame:
    """Replace a JSON text column by its variant ``v``; rows that are not JSON drop out.

    ``counts`` observes in the same pass how many rows there were (``lines``) and how many dropped out (``failed``). The value passes through a generator before the null test: a filter directly on the parsed value
    would be pushed below the projection and parse every line a second time.
    """
    keep = [c for c in rows.columns if c != column]
    made = rows.select(*keep, F.explode(F.array(parse(F.col(column)))).alias("v"))
    if counts is not None:
        made = made.observe(counts, F.count(F.lit(1)).alias("lines"), F.count_if(F.col("v").isNull()).alias("failed"))
    return made.where("v is not null")


def expand(rows: DataFrame, keep: list[Column | str], *entries: Column) -> DataFrame:
    """One output row per non-null entry struct, next to the kept columns.

    The entries are computed once, in a projection that stays inside generated code; generation and null
    test follow on their attributes.
    """
    names = [f"__e{i}" for i in range(len(entries))]
    staged = rows.select(*keep, *[e.alias(n) for e, n in zip(entries, names, strict=True)])
    kept = [c for c in staged.columns if c not in names]
    tagged = F.array(*[F.struct(F.col(n).isNotNull().alias("__ok"), F.col(n).alias("__v")) for n in names])
    return staged.select(*kept, F.inline(tagged)).where("__ok").select(*kept, "__v.*")


def get(v: Column, path: str, kind: str = "string") -> Column:
    return F.try_variant_get(v, path, kind)


def sub(v: Column, path: str) -> Column:
    return F.try_variant_get(v, path, "variant")


def text(v: Column, path: str) -> Column:
    """The value only when it is a JSON string; numbers, booleans and containers give null."""
    return F.when(F.schema_of_variant(sub(v, path)) == "STRING", get(v, path))


def number(v: Column, path: str, signed: bool = False) -> Column:
    """Whole number, 0 when missing, of another type, or negative where only counts make sense."""
    value = F.when(F.schema_of_variant(sub(v, path)) == "BIGINT", get(v, path, "bigint"))
    kept = value if signed else F.when(value >= 0, value)
    return F.coalesce(kept, F.lit(0).cast("bigint"))


def array(v: Column, path: str) -> Column:
    return F.try_variant_get(v, path, "array<variant>")


def as_json(v: Column) -> Column:
    """Compact JSON text of a variant; null stays null."""
    return F.to_json(v)


def text_or_json(v: Column, path: str) -> Column:
    """A string as it is, any other present value as compact JSON, a missing value as ''."""
    return F.coalesce(get(v, path), F.lit(""))


def blank_to_null(c: Column) -> Column:
    trimmed = strings.trim(c)
    return F.when(trimmed != "", trimmed)


def first_of(arr: Column) -> Column:
    """First element, or null for an empty or null array."""
    return F.get(arr, F.lit(0))
