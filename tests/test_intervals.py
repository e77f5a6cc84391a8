"""Intervals of keys that a task takes at once are solved in one pass; those of larger keys along orbits, with the same rows."""

import random

from seqloom.operators import designer


def test_small_and_large_keys_have_the_same_rows(spark, monkeypatch):
    rng = random.Random(5)
    rows = [(k, s, s + rng.randint(1, 40)) for k in range(6) for s in [rng.randint(0, 300) for _ in range(20 * k + 1)]]
    rows = [(k, s, e, i) for i, (k, s, e) in enumerate(rng.sample(rows, len(rows)))] + [(None, 1, 2, 999)]
    table = spark.createDataFrame(rows, "gene_id long, start int, end int, place int")
    found = lambda: (sorted(tuple(r) for r in designer.disjoint_intervals(table, "gene_id").collect()), sorted(tuple(r) for r in designer.scheduled_intervals(table, "gene_id", "place").collect()))
    once = found()
    for held in (0, 50):
        monkeypatch.setattr(designer, "_HELD", held)
        assert found() == once
    assert {k for k, *_ in once[0]} == set(range(6)) and len(once[1]) == len(rows) - 1


def test_small_keys_are_shuffled_once(spark):
    table = spark.createDataFrame([(1, 0, 5, 1), (1, 3, 8, 2)], "gene_id long, start int, end int, place int")
    for df in (designer.disjoint_intervals(table, "gene_id"), designer.scheduled_intervals(table, "gene_id", "place")):
        assert df._jdf.queryExecution().executedPlan().toString().count("Exchange") <= 1
