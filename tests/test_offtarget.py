"""Ungapped hits against enumeration: probes of several lengths, several seeds on a diagonal, ends of subjects and blocks."""

import random

from seqloom.operators import offtarget


def test_search_is_all_seeded_diagonals_once(spark):
    rng = random.Random(8)
    text = lambda n: "".join(rng.choice("ACGT") for _ in range(n))
    subjects = [text(n) for n in (2100, 60, 9, 1024)] + ["A" * 40, "ACGTACGTAC" * 8]
    probes = {subjects[0][a : a + n] for a, n in ((0, 20), (1010, 45), (1020, 20), (2080, 20), (500, 15), (700, 80), (300, 10))} | {"A" * 20, "ACGTACGTAC", subjects[1][:33], text(20), "ACG"}
    for p in sorted(probes):
        q = list(p)
        for _ in range(len(q) // 8):
            q[rng.randrange(len(q))] = rng.choice("ACGT")
        subjects.append(text(rng.randint(0, 40)) + "".join(q) + text(rng.randint(0, 40)))
    want = set()
    for p in probes:
        for i, s in enumerate(subjects):
            for a in range(len(s) - len(p) + 1):
                same = "".join("=" if x == y else "." for x, y in zip(p, s[a : a + len(p)], strict=True))
                if "=" * 10 in same and same.count(".") <= int(len(p) * 0.2 + 1e-9):
                    want.add((p, i, "+", a, same.count(".")))
    found = offtarget.search(spark.createDataFrame([(p,) for p in probes], "probe_seq string"), spark.createDataFrame([(i, "+", s) for i, s in enumerate(subjects)], "subject_id long, strand string, seq string"))
    got = [tuple(r) for r in found.collect()]
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 40
    # what is found is not moved again
    assert "Distinct" not in (plan := found._jdf.queryExecution().optimizedPlan().toString()) and "Aggregate" not in plan


def test_detailed_seeds_are_few_and_miss_no_place():
    """The candidates of a probe in random bases, and every placing of the mismatches."""
    import itertools

    from seqloom.operators import hits

    for n, most in ((20, 4), (9, 3), (5, 4), (8, 0)):
        for places in itertools.combinations(range(n), most):
            assert any(sum(a <= p < a + size for p in places) <= m for a, size, m in hits.halves(n, most))
    words = [w for a, size, m in hits.halves(20, 4) for w in hits.variants("ACGTTGCAAG"[:size], m, "ACGT")]
    assert len(words) == 436 + 31 and sum(4.0 ** -len(w) for w in words) < 5e-4


def test_detailed_takes_other_letters_for_mismatches(spark):
    from seqloom.operators import hits

    p, n = "ACGTTGCAAGCTTCAGGACT", "ANGTTGCAAGCTTCNGGACT"
    subjects = spark.createDataFrame([(1, "+", "GG" + n + "T"), (2, "+", n.replace("N", "a")), (3, "+", p)], "subject_id long, strand string, seq string")
    got = {(r.subject_id, r.start, r.mm) for r in hits.detailed(spark.createDataFrame([(p,)], "probe_seq string"), subjects, 2).collect()}
    assert got == {(1, 2, 2), (2, 0, 2), (3, 0, 0)}
