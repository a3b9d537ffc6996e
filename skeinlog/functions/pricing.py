"""Model ids and prices. Prices are USD per one million tokens."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from skeinlog.functions import strings

# fixed values: default price rows (match, input, output)
DEFAULT_PRICES = [
    ("claude-opus", 15.0, 75.0),
    ("claude-sonnet", 3.0, 15.0),
    ("claude-haiku", 0.8, 4.0),
    ("claude-fable-5", 10.0, 50.0),
    ("claude-haiku-4-5", 1.0, 5.0),
    ("claude-opus-4-6", 5.0, 25.0),
    ("claude-opus-4-7", 5.0, 25.0),
    ("claude-opus-4-8", 5.0, 25.0),
    ("claude-sonnet-4-6", 3.0, 15.0),
    ("gpt-5", 1.25, 10.0),
    ("gpt-5.4", 2.5, 15.0),
    ("gpt-5.4-mini", 0.75, 4.5),
    ("gpt-5.4-pro", 30.0, 180.0),
    ("gpt-5.5", 5.0, 30.0),
    ("gpt-5.6-sol", 5.0, 30.0),
    ("gpt-4o", 2.5, 10.0),
    ("gpt-4", 2.5, 10.0),
    ("gemini", 1.25, 5.0),
]

# fixed values: offline prices by exact normalised id
FALLBACK_PRICES = [
    ("claude-fable-5", 10.0, 50.0),
    ("claude-haiku-4-5", 1.0, 5.0),
    ("claude-opus-4-6", 5.0, 25.0),
    ("claude-opus-4-7", 5.0, 25.0),
    ("claude-opus-4-8", 5.0, 25.0),
    ("claude-sonnet-4-6", 3.0, 15.0),
    ("gpt-5-4", 2.5, 15.0),
    ("gpt-5-4-mini", 0.75, 4.5),
    ("gpt-5-4-pro", 30.0, 180.0),
    ("gpt-5-5", 5.0, 30.0),
    ("gpt-5-6-luna", 0.1, 0.6),
    ("gpt-5-6-sol", 5.0, 30.0),
    ("gpt-5-6-terra", 1.0, 6.0),
]

# fixed value: cached tokens are charged at this share of the input price
CACHE_SHARE = 0.1


def normalized_id(model: Column) -> Column:
    """Bare lower-case id: no ``~``, no variant after ``:``, last path segment, dots as dashes."""
    bare = F.regexp_replace(F.lower(strings.trim(model)), "^~", "")
    return F.replace(F.substring_index(F.substring_index(bare, ":", 1), "/", -1), F.lit("."), F.lit("-"))


def qualified_id(model: Column) -> Column:
    """(full, provider, model) of a possibly provider-qualified id."""
    full = F.replace(F.lower(strings.trim(model)), F.lit("."), F.lit("-"))
    provider = F.regexp_extract(full, r"^(.*)/[^/]*$", 1)
    return F.struct(
        full.alias("full"),
        F.nullif(provider, F.lit("")).alias("provider"),
        F.substring_index(full, "/", -1).alias("model"),
    )


def per_million(raw: Column) -> Column:
    """Catalog price (per token, text or number) to price per million; negative or unreadable gives null."""
    x = raw.try_cast("double")
    return F.when((x >= 0) & (x < F.lit(float("inf"))), x * 1_000_000)


def cost(input_tokens: Column, cache_tokens: Column, output_tokens: Column, price_in: Column, price_out: Column) -> Column:
    mio = F.lit(1e6)
    return input_tokens / mio * price_in + cache_tokens / mio * price_in * CACHE_SHARE + output_tokens / mio * price_out
