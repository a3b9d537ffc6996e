"""Continuous refresh of the search index: every micro-batch of file notices becomes one segment."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skeinlog.plans import segments as G
from skeinlog.plans.documents import Parser


def refresh_into(store: G.Store, parser: Callable[[], Parser], merge_every: int | None = None):
    """foreachBatch writer of notices ``(source, session_id, version, seen)``; version null for a file that is gone.

    Of several notices about a session the one seen last counts. Batch n is segment 2n; merged segments take the odd numbers. A batch that is delivered
    again after its commit does nothing, before it it overwrites what it had written. ``parser()`` gives the parser over
    the lines as they are now; only changed sessions are parsed.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        last = batch.groupBy(*G.KEY).agg(F.max_by("version", "seen").alias("version"))
        G.refresh(store, 2 * batch_id, last, parser())
        if merge_every and (batch_id + 1) % merge_every == 0:
            G.merge(store, 2 * batch_id + 1)

    return write
