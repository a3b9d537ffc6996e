"""Ordered operators that stay parallel inside one session.

A window partitioned by session sends a whole session to one task. Transcripts are skewed (one session
may hold a third of all rows), so ordered state is computed in two levels instead: inside a bounded
``chunk`` of the session, then over one summary row per chunk, and the carried-in state is joined back.
Only the summary rows of a session ever meet in one task.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skeinlog.session import cut_lineage

CHUNK_ROWS = 65_536
# slices of one key at most: their bounds are searched for every row, so they must not grow with the key
SLICES = 1024
BLOCK = 32


def with_chunk(df: DataFrame, position: str, width: int = CHUNK_ROWS) -> DataFrame:
    """Slice an order position into bounded chunks."""
    return df.withColumn("chunk", F.floor(F.col(position) / F.lit(width)).cast("bigint"))


@dataclass(frozen=True)
class RunningSum:
    out: str
    value: Column
    inclusive: bool = True


@dataclass(frozen=True)
class LastValue:
    """Most recent non-null ``value``."""

    out: str
    value: Column
    inclusive: bool = True


@dataclass(frozen=True)
class SumSince:
    """Sum of ``value`` over the rows before this one, back to the last earlier row for which ``event`` holds."""

    out: str
    value: Column
    event: Column


@dataclass(frozen=True)
class Total:
    """Sum of ``value`` over the whole key."""

    out: str
    value: Column


def ordered_scan(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    specs: Sequence[RunningSum | LastValue | SumSince | Total],
    chunk: str = "chunk",
) -> DataFrame:
    """Append running sums, carried-forward values, sums since an event and totals in ``order`` within ``keys``.

    ``keys`` and ``chunk`` must not be null and ``chunk`` must grow with ``order``.
    """
    keys = list(keys)
    full = keys + [chunk]
    inputs = {f"__in{i}": s.value for i, s in enumerate(specs)}
    inputs |= {f"__ev{i}": s.event for i, s in enumerate(specs) if isinstance(s, SumSince)}
    staged = df.withColumns(inputs)

    ordered = Window.partitionBy(*full).orderBy(*order)
    position = F.struct(*[F.col(c) for c in order])
    here, past = (ordered.rowsBetween(Window.unboundedPreceding, end) for end in (0, -1))
    zero = F.lit(0).cast("bigint")
    first, second, summary, running = {}, {}, [], {}
    for i, spec in enumerate(specs):
        value, total = F.col(f"__in{i}"), F.sum(f"__in{i}").alias(f"__tot{i}")
        if isinstance(spec, SumSince):
            # the running sum at the last event, counted from the start of the chunk; the summary needs it as well
            running[f"__run{i}"] = F.sum(value).over(here)
            at_event = F.when(F.col(f"__ev{i}"), F.col(f"__run{i}"))
            second[f"__loc{i}"] = F.coalesce(F.col(f"__run{i}") - value, zero)
            second[f"__at{i}"] = F.last(at_event, ignorenulls=True).over(past)
            summary += [total, F.max_by(f"__run{i}", F.when(F.col(f"__ev{i}"), position)).alias(f"__evt{i}")]
        elif isinstance(spec, Total):
            summary.append(total)
        elif isinstance(spec, RunningSum):
            first[f"__loc{i}"] = F.sum(value).over(here if spec.inclusive else past)
            summary.append(total)
        else:
            first[f"__loc{i}"] = F.last(value, ignorenulls=True).over(here if spec.inclusive else past)
            summary.append(F.max_by(value, F.when(value.isNotNull(), position)).alias(f"__tot{i}"))
    summed = staged.withColumns(running) if running else staged
    inside = summed.withColumns(first) if first else summed
    inside = inside.withColumns(second) if second else inside

    whole = Window.partitionBy(*keys)
    before = whole.orderBy(chunk).rowsBetween(Window.unboundedPreceding, -1)
    carried = summed.groupBy(*full).agg(*summary)
    sums = {f"__car{i}": F.sum(f"__tot{i}").over(whole if isinstance(s, Total) else before) for i, s in enumerate(specs) if not isinstance(s, LastValue)}
    lasts = {f"__car{i}": F.last(f"__tot{i}", ignorenulls=True).over(before) for i, s in enumerate(specs) if isinstance(s, LastValue)}
    carried = carried.withColumns(sums | lasts)
    since = [i for i, s in enumerate(specs) if isinstance(s, SumSince)]
    if since:
        events = {f"__abs{i}": F.last(F.coalesce(F.col(f"__car{i}"), zero) + F.col(f"__evt{i}"), ignorenulls=True).over(before) for i in since}
        carried = carried.withColumns(events)
        carried = carried.withColumns({f"__car{i}": F.coalesce(F.col(f"__car{i}"), zero) - F.coalesce(F.col(f"__abs{i}"), zero) for i in since})
    joined = inside.join(carried.select(*full, *[f"__car{i}" for i in range(len(specs))]), full)
    result = {}
    for i, spec in enumerate(specs):
        car, loc = F.col(f"__car{i}"), F.col(f"__loc{i}")
        if isinstance(spec, SumSince):
            result[spec.out] = F.coalesce(loc - F.col(f"__at{i}"), loc + car)
        elif isinstance(spec, Total):
            result[spec.out] = F.coalesce(car, zero)
        elif isinstance(spec, RunningSum):
            result[spec.out] = F.coalesce(car, zero) + F.coalesce(loc, zero)
        else:
            result[spec.out] = F.coalesce(loc, car)
    return joined.withColumns(result).select(*df.columns, *[s.out for s in specs])


def row_position(df: DataFrame, keys: Sequence[str], order: Sequence[str], out: str, chunk: str = "chunk") -> DataFrame:
    """Zero-based position of every row in its session."""
    return ordered_scan(df, keys, order, [RunningSum(out, F.lit(1).cast("bigint"), inclusive=False)], chunk)


def equal_depth_chunk(df: DataFrame, keys: Sequence[str], position: str, rows: int = CHUNK_ROWS, label: str = "depth") -> DataFrame:
    """Add ``chunk``: slices of about ``rows`` rows in the order of the number ``position``; a key with fewer rows is one slice, the longest key has ``SLICES`` larger ones.

    Slices of equal width follow the values, not the rows: a session with all rows on one day would be one slice. Here the bounds are quantiles
    of the key's own positions, from sketches that every task builds and Spark merges. A sketch may be merged in any order and the bounds
    are used by several branches of a plan, so they are written once. Rows of equal position share a slice.
    """
    keys = list(keys)
    counts = df.groupBy(*keys).agg(F.count("*").alias("__n"))
    most = counts.agg(F.max("__n")).first()[0] or 0
    if most <= rows:
        return df.withColumn("chunk", F.lit(0).cast("bigint"))
    hot = cut_lineage(counts.where(F.col("__n") > rows), f"{label}-counts")
    slices = min(int(-(-most // rows)), SLICES)
    marks = [k / slices for k in range(1, slices)]
    some = df.select(*keys, position).join(hot.select(*keys), keys, "left_semi")
    sketches = some.groupBy(*keys).agg(F.percentile_approx(position, marks, max(10_000, 20 * slices)).alias("__all"))
    # in blocks: the one a row falls into is found by their first bounds
    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size("__all") - 1) / BLOCK).cast("int")), lambda k: F.slice("__all", k * BLOCK + 1, BLOCK))
    bounds = sketches.join(hot, keys).select(*keys, F.array_distinct("__all").alias("__all")).select(*keys, blocks.alias("__bounds"))
    bounds = cut_lineage(bounds.withColumn("__first", F.transform("__bounds", lambda b: b[0])), f"{label}-bounds")

    def below(sorted_bounds: Column) -> Column:
        return F.size(F.filter(sorted_bounds, lambda b: b < F.col(position)))

    marked = df.join(bounds, keys, "left").withColumn("__block", below(F.col("__first")) - 1)
    found = F.col("__block") * BLOCK + below(F.get("__bounds", F.col("__block")))
    chunk = F.when(F.col("__block") >= 0, found).otherwise(0).cast("bigint")
    return marked.withColumn("chunk", chunk).drop("__bounds", "__first", "__block")


def first_per_group(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], n: int, rank: str) -> DataFrame:
    """First ``n`` rows per group.

    Spark prunes each map task to ``n`` rows per group before the shuffle (window group limit), so a hot
    group moves at most ``n`` rows per task. Used with ``n`` up to that rule's default bound of 1000.
    """
    spec = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(spec)).where(F.col(rank) <= n)
