"""Tables that grow with the requests are not sent through the driver to be broadcast."""

import glob

import pytest
from pyspark.sql import functions as F

from seqloom.operators import batch, hits, offtarget, resolution
from seqloom.plans import catalog
from seqloom.sources import derived, writers


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_requests_meet_libraries_and_sets_in_merge_joins(spark, sf_dir):
    coding, transcript, reference = derived.libraries(spark, sf_dir)
    asked = derived.batch(spark, sf_dir).filter("substr(task, 2) % 50 = 0").selectExpr("*", "upper(gene_id) AS locus")
    for df in (resolution.exact(asked, coding, transcript, reference), batch.kept_oligos(catalog._resolved(spark, sf_dir).filter("substr(task, 2) % 50 = 0"), derived.bridge(spark, sf_dir))):
        text = plan(df)
        assert "SortMergeJoin" in text and not any("BroadcastHashJoin" in line and "Left" in line or "BroadcastHashJoin" in line and "set_id" in line for line in text.splitlines())


def test_a_locus_is_resolved_once_for_all_its_requests(spark):
    rows = [("a", "L1"), ("b", "l1"), ("c", "SYM1"), ("d", "L2"), ("e", None), ("f", "zz"), ("g", "L1")]
    requests = spark.createDataFrame(rows, "task string, gene_id string")
    aliases = spark.createDataFrame([("SYM1", "L1")], "symbol string, locus string")
    lib = lambda *r: spark.createDataFrame(list(r), "id string, seq string, ord int")
    found = resolution.resolve(requests, aliases, lib(("L1", "AC", 1), ("L1", "AG", 1)), lib(("L9", "T", 1)), lib(("L2.1", "GG", 2), ("L1.1", "TT", 1)))
    got = sorted((r.task, r.locus, r.seq, r.source) for r in found.collect())
    want = [(t, "L1", s, 1) for t in "abcg" for s in ("AC", "AG")] + [("d", "L2", "GG", 4), ("e", None, None, None), ("f", "ZZ", None, None)]
    assert got == sorted(want)


def test_seeds_meet_places_in_a_merge_join(spark):
    """A probe's seeds are far more than its file's size tells."""
    probes = spark.createDataFrame([("ACGTTGCAACGTGGCATTAC",)], "probe_seq string")
    subjects = spark.createDataFrame([(1, "+", "TTACGTTGCAACGTGGCATTACGG")], "subject_id long, strand string, seq string")
    found = offtarget.search(probes, subjects)
    assert "SortMergeJoin" in plan(found) and "Broadcast" not in plan(found)
    assert [tuple(r) for r in found.collect()] == [("ACGTTGCAACGTGGCATTAC", 1, "+", 2, 0)]


def test_scores_of_sets_meet_in_merge_joins(spark):
    sets = spark.createDataFrame([(1, 1, "ACGT", "CCGT"), (1, 2, "ACGT", "GGGG")], "gene_id long, set_id int, left_seq string, right_seq string")
    hits = spark.createDataFrame([("ACGT", 0), ("ACGT", 2), ("CCGT", 1)], "probe_seq string, mm int")
    probes = sets.select(F.explode(F.array("left_seq", "right_seq")).alias("probe_seq"))
    scored = offtarget.set_scores(sets, offtarget.evidence(probes, hits), ["left_seq", "right_seq"])
    assert "Broadcast" not in plan(scored)
    assert sorted((r.set_id, r.score, r.specificity) for r in scored.collect()) == [(1, 15, 12), (2, 5, 10)]


def test_sets_meet_their_selection_in_merge_joins(spark, tmp_path):
    sets = spark.createDataFrame([(1, 1, 0, 15, 15, 30, "A" * 15, "C" * 15), (1, 2, 9, 24, 24, 39, "A" * 15, "C" * 15)], "gene_id long, set_id int, start int, left_end int, right_start int, right_end int, left_seq string, right_seq string").withColumn("gc_junction", F.lit(False))
    chosen = spark.createDataFrame([(1, 1, True, "x"), (1, 2, False, "y")], "gene_id long, set_id int, keep boolean, reason string")
    seen = []
    file, writers.set_json = writers.set_json, lambda df, path: seen.append(df)
    try:
        writers.filtered_json(sets, chosen, str(tmp_path))
    finally:
        writers.set_json = file
    for df in (*seen, writers.filtered_rows(sets, chosen)):
        assert "SortMergeJoin" in plan(df) and "Broadcast" not in plan(df)


def test_documents_of_genes_share_files(spark, sf_dir, tmp_path, monkeypatch):
    monkeypatch.setattr(catalog, "_file", lambda spark: f"{tmp_path}/documents")
    genes = catalog.io_probe_sets(spark, sf_dir).select("gene_id").distinct().count()
    assert genes > 1 == len(glob.glob(f"{tmp_path}/documents/*/part-*"))


@pytest.mark.parametrize("kept", [False, True])
def test_words_about_halves_meet_places_in_a_merge_join(spark, tmp_path, kept):
    probes = spark.createDataFrame([("ACGTTGCAACGTGGCATTAC",)], "probe_seq string")
    subjects = spark.createDataFrame([(1, "+", "TTACGTTGCAACCTGGCATTACGG")], "subject_id long, strand string, seq string")
    index = (lambda k, reach: hits.kept_index(spark, subjects, k, reach, str(tmp_path))) if kept else None
    found = hits.detailed(probes, subjects, index=index)
    assert "SortMergeJoin" in plan(found) and "Broadcast" not in plan(found)
    assert [(r.start, r.mm) for r in found.collect()] == [(2, 1)]
