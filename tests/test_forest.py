"""The stored thread forest equals one that is resolved from nothing, whatever comes, changes or goes."""

import random

import pytest

from skeinlog.plans import forest
from skeinlog.session import scratch_path
from skeinlog.sources import dialect_b as B


def row(rng, n, names):
    """A file of thread t<n>; it names threads that may come later, never, or lead into a cycle."""
    some = lambda p: rng.choice(names) if rng.random() < p else None
    sub = rng.random() < 0.8
    thread = rng.choice(names) if rng.random() < 0.1 else f"t{n}"
    return (f"f{n:02d}", thread, some(0.3), some(0.9) if sub else None, sub, "/w", f"2026-01-01 00:{n:02d}", "p", None, None, None)


def state(rows):
    return sorted((r.session_id, r.thread_id, r.root_id) for r in rows.collect())


@pytest.mark.parametrize("seed", [2])
def test_updates_equal_a_rebuild(spark, seed):
    rng = random.Random(seed)
    names = [f"t{i}" for i in range(24)]
    store = forest.open_forest(spark, scratch_path(spark, "forest"))
    held: dict[str, tuple] = {}
    for step in range(4):
        fresh = {r[0]: r for r in (row(rng, n, names) for n in rng.sample(range(24), 9))}
        gone = [s for s in rng.sample(sorted(held), min(len(held), 3)) if s not in fresh] if step else []
        held = {k: v for k, v in held.items() if k not in gone} | fresh
        batch = spark.createDataFrame(list(fresh.values()), forest.IDENTITY)
        forest.update(store, 2 * step, batch, spark.createDataFrame([(g,) for g in gone], "session_id string"))
        want = state(B.threads(spark.createDataFrame(list(held.values()), forest.IDENTITY)))
        assert state(forest.tree(store)) == want
        if step == 2:
            forest.merge(store, 5)
            assert store.committed() == [5] and state(forest.tree(store)) == want
    # what is delivered again changes nothing
    forest.update(store, 6, spark.createDataFrame([row(rng, 1, names)], forest.IDENTITY))
    assert state(forest.tree(store)) == want


def test_only_touched_groups_are_written(spark):
    flat = lambda n, parent, sub: (f"f{n}", f"t{n}", None, parent, sub, "/w", f"2026-01-01 00:0{n}", "p", None, None, None)
    store = forest.open_forest(spark, scratch_path(spark, "forest"))
    forest.update(store, 0, spark.createDataFrame([flat(1, None, False), flat(2, "t1", True), flat(3, None, False), flat(4, "t3", True), flat(5, "t9", True)], forest.IDENTITY))
    forest.update(store, 2, spark.createDataFrame([flat(6, "t2", True), flat(9, "t1", True)], forest.IDENTITY))
    written = {r.session_id for r in store.table("threads").where("segment = 2").collect()}
    # t5 waited for t9; the group of t3 and the threads t1 and t2 that the new ones hang below stay as they are
    assert written == {"f5", "f6", "f9"}
    assert dict((r.session_id, r.root_id) for r in forest.tree(store).collect()) == {"f1": "t1", "f2": "t1", "f3": "t3", "f4": "t3", "f5": "t1", "f6": "t1", "f9": "t1"}
