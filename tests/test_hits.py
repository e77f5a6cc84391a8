"""Gapped, trimmed and detailed hits against enumeration."""

import random

import numpy as np
import pytest

from seqloom.operators import hits, offtarget

S = hits.Scores()


def enumerated(probe, window, band):
    """The best of all alignments with one gap at most, by trying all of them."""
    size, width, best = len(probe), 2 * band + 1, None

    def stretches(j):
        for a in range(size):
            m = x = 0
            for b in range(a, size):
                if window[b + j] == hits.OUTSIDE:
                    break
                m, x = m + (window[b + j] == probe[b]), x + (window[b + j] != probe[b])
                yield a, b + 1, m, x

    each = [list(stretches(j)) for j in range(width)]
    for j in range(width):
        for a, b, m, x in each[j]:
            tries = [(m - 3 * x, 0, 0, -x, -a, -j, -b, -j)]
            for k in range(width):
                if k != j:
                    tries += [(m + n - 3 * (x + y) - 5 - 2 * abs(k - j), -1, -abs(k - j), -(x + y), -a, -j, -d, -k) for c, d, n, y in each[k] if c == b + max(j - k, 0)]
            best = max([best, *tries] if best else tries)
    score, opened, gaps, mm, a, j, b, k = (best[0], *(-v for v in best[1:]))
    return score, opened, gaps, mm, a, b, a + j, b + k


def changed(rng, probe):
    q, r = list(probe), rng.random()
    at = rng.randint(4, len(q) - 5)
    if r < 0.4:
        del q[at : at + rng.randint(1, 3)]
    elif r < 0.8:
        q[at:at] = [rng.choice("ACGT") for _ in range(rng.randint(1, 3))]
    for _ in range(rng.randint(0, 2)):
        q[rng.randrange(len(q))] = rng.choice("ACGT")
    return "".join(q)


@pytest.mark.parametrize("band", [0, 1, 3])
def test_banded_finds_the_best_alignment(band):
    rng, probes, windows = random.Random(band), [], []
    for t in range(150):
        p = "".join(rng.choice("ACGT") for _ in range(20))
        w = ("".join(rng.choice("ACGT") for _ in range(band)) + changed(rng, p) + "ACGT" * 4)[: 20 + 2 * band]
        probes.append(p)
        windows.append("...." + w[4:] if t % 7 == 0 else w[:-5] + "....." if t % 11 == 0 else w)
    letters = lambda x: np.array([list(v.encode()) for v in x], np.uint8)
    got = hits.banded(letters(probes), np.full(len(probes), 20), letters(windows), band, S)
    names = ("score", "gapopen", "gaps", "mm", "q_start", "q_end", "s_start", "s_end")
    found = [tuple(int(got[k][i]) for k in names) for i in range(len(probes))]
    assert found == [enumerated(p, w, band) for p, w in zip(probes, windows, strict=True)]
    assert (sum(f[1] for f in found) > 1) == (band > 0)


def world(spark, seed=3):
    rng = random.Random(seed)
    genes = ["".join(rng.choice("ACGT") for _ in range(n)) for n in (300, 1500, 40, 9)]
    probes = [g[a : a + n] for g, a, n in ((genes[0], 30, 20), (genes[1], 1010, 20), (genes[1], 0, 25), (genes[2], 20, 20), (genes[0], 280, 20))] + ["A" * 20]
    genes += [genes[1][:1000] + changed(rng, genes[1][1000:1040]) + genes[1][1040:], "".join(changed(rng, genes[0][k : k + 30]) for k in range(0, 300, 30)), "A" * 60]
    return probes, genes, spark.createDataFrame([(p,) for p in probes], "probe_seq string"), spark.createDataFrame([(i, "+", g) for i, g in enumerate(genes)], "subject_id long, strand string, seq string")


@pytest.mark.parametrize("most", [0, 1, 2, 3, 4])
def test_detailed_is_all_places(spark, most):
    probes, genes, p, s = world(spark)
    want = set()
    for q in probes:
        for i, g in enumerate(genes):
            for a in range(len(g) - len(q) + 1):
                w = g[a : a + len(q)]
                mm = sum(x != y for x, y in zip(q, w, strict=True))
                if mm <= most:
                    want.add((q, i, "+", a, mm, f"Query:  {q}\nSubject: {w}"))
    got = [tuple(r) for r in hits.detailed(p, s, most).collect()]
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 40


def test_local_is_best_of_each_seeded_diagonal(spark):
    probes, genes, p, s = world(spark)
    for band in (0, 3):
        want = set()
        for q in set(probes):
            for i, g in enumerate(genes):
                seeded = {b - a for a in range(len(q) - 9) for b in range(len(g) - 9) if q[a : a + 10] == g[b : b + 10]}
                for d in seeded:
                    window = "".join(g[x] if 0 <= x < len(g) else hits.OUTSIDE for x in range(d - band, d + len(q) + band))
                    if len(q) > 20 and band:
                        continue  # two gaps are possible there
                    score, opened, gaps, mm, a, b, c, e = enumerated(q, window, band)
                    want.add((q, i, a, b, d - band + c, d - band + e, score, mm, opened, gaps))
        got = {(r.probe_seq, r.subject_id, r.q_start, r.q_end, r.start, r.end, r.score, r.mm, r.gapopen, r.gaps) for r in hits.local(p, s, band=band).collect() if band == 0 or len(r.probe_seq) == 20}
        assert got == want and len(want) > 30


def test_local_alignments_are_found_once_and_not_moved(spark, monkeypatch):
    """No row comes twice, though seeds and diagonals lead to it several times, and nothing is shuffled behind the join of seeds."""
    _, genes, p, s = world(spark)
    for band in (0, 3):
        found = hits.local(p, s, band=band)
        got = [tuple(r) for r in found.collect()]
        assert len(got) == len(set(got)) > 30
        plan = found._jdf.queryExecution().optimizedPlan().toString()
        assert "Distinct" not in plan and "Aggregate" not in plan
        with monkeypatch.context() as m:
            m.setattr(hits, "_CARRIED", 0)  # as long probes are found
            assert sorted(tuple(r) for r in hits.local(p, s, band=band).collect()) == sorted(got)
        twice = s.union(spark.createDataFrame([(1, "+", genes[1][900:1100])], s.schema))
        both = [tuple(r) for r in hits.local(p, twice, band=band).collect()]
        assert len(both) == len(set(both)) and set(got) < set(both)


def test_gapped_hits_count_in_the_scores_of_sets(spark):
    """A base that the subject lacks: 20 columns, one opening."""
    p = "ACGTTGCAAGCTTCAGGACT"
    s = spark.createDataFrame([(1, "+", "GG" + p[:9] + p[10:] + "CC"), (2, "+", p), (3, "+", p[:-1] + "A")], "subject_id long, strand string, seq string")
    probes = spark.createDataFrame([(p,)], "probe_seq string")
    found = hits.gapped(probes, s)
    rows = {(r.subject_id, r.start, r.mm, r.mismatches, r.gapopen) for r in found.collect()}
    assert rows == {(1, 2, 1, 0, 1), (2, 0, 0, 0, 0)}
    sets = spark.createDataFrame([(p, p)], "left_seq string, right_seq string")
    one = offtarget.set_scores(sets, offtarget.evidence(probes, found), ["left_seq", "right_seq"]).first()
    assert (one.score, one.specificity) == (10, 24)


def test_a_kept_index_is_built_once_and_not_moved(spark, tmp_path):
    _, _, p, s = world(spark)
    kept = lambda k, reach: hits.kept_index(spark, s, k, reach, str(tmp_path))
    first = hits.detailed(p, s, 1, index=kept)
    tables = [t.name for t in spark.catalog.listTables() if t.name.startswith("seeds_")]
    files = sorted(str(f) for f in tmp_path.rglob("*.parquet"))
    assert {tuple(r) for r in first.collect()} == {tuple(r) for r in hits.detailed(p, s, 1).collect()}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        again = hits.detailed(p.limit(3), s.orderBy("seq"), 1, index=kept)
        plan = again._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    joins = [plan[i:] for i in range(len(plan)) if plan.startswith("SortMergeJoin", i)]
    assert joins and all(j[: j.index("Scan parquet spark_catalog")].count("Exchange") <= 1 for j in joins)
    assert sorted(str(f) for f in tmp_path.rglob("*.parquet")) == files and [t.name for t in spark.catalog.listTables() if t.name.startswith("seeds_")] == tables
    # another session knows the folder alone
    for t in tables:
        spark.sql(f"DROP TABLE {t}")
    assert {tuple(r) for r in hits.detailed(p, s, 1, index=kept).collect()} == {tuple(r) for r in first.collect()}
    assert hits.content_digest(s) == hits.content_digest(s.repartition(3)) != hits.content_digest(s.limit(2))
    for t in tables:
        spark.sql(f"DROP TABLE {t}")


def test_problems_of_subjects(spark):
    rows = [("a", "ACGT"), ("b", "ACgT"), ("c", "ACNT"), ("d", ""), ("e", "AC"), ("e", "AC"), ("f", "nn")]
    got = {tuple(r) for r in hits.problems(spark.createDataFrame(rows, "subject_id string, seq string")).collect()}
    assert got == {("b", "lower case"), ("c", "letters other than ATCG"), ("d", "empty sequence"), ("e", "repeated id"), ("f", "lower case"), ("f", "letters other than ATCG")}
