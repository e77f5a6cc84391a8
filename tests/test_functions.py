from pyspark.sql import functions as F

from seqloom.functions import sequence as S
from seqloom.functions.thermo import NN3, is_valid_probe, tm


def value(spark, *columns):
    return tuple(spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(columns)]).first())


def test_complementary(spark):
    pairs = [("AT", "TA", True), ("GC", "CG", True), ("ATGC", "TACG", True), ("AAAA", "TTTT", True), ("ATGC", "GCAT", False), ("AT", "AT", False), ("AT", "TG", False), ("AT", "T", False)]
    assert list(value(spark, *[S.is_complementary(F.lit(a), F.lit(b)) for a, b, _ in pairs])) == [x for *_, x in pairs]


def test_hairpin(spark):
    cases = [("ATGCGCAT", 4, True), ("ATGC", 4, False), ("ATATATAT", 4, True), ("ATCGCGAT", 3, True), ("ATCGCGAT", 5, False)]
    assert list(value(spark, *[S.has_hairpin(F.lit(s), k) for s, k, _ in cases])) == [x for *_, x in cases]


def test_dimer(spark):
    cases = [(["ATGCGCAT"], 4, True), (["ATGC", "GCAT"], 4, True), (["AAAA", "TTTT"], 4, True), ([], 4, False), (["ATG", "CAT"], 3, True), (["ATG", "CAT"], 4, False)]
    assert list(value(spark, *[S.has_dimer([F.lit(s) for s in seqs], m) for seqs, m, _ in cases])) == [x for *_, x in cases]


def test_runs_and_junction(spark):
    assert value(spark, *[S.poly_n_ok(F.lit(s), 4) for s in ("ATGC", "AAAA", "ATAAAG", "ATGGGG")]) == (True, False, True, False)
    assert value(spark, *[S.gc_junction(F.lit(s)) for s in ("GA", "CA", "AC", "TG", "")]) == (True, True, False, False, False)


def test_melting_temperature(spark):
    s = F.lit("CGTTCCAAAGATGTGGGCATGAGCTTAC")
    a, b = value(spark, F.round(tm(s, NN3), 2), F.round(tm(S.reverse_complement(s), NN3), 2))
    assert a == b == 60.32


def test_validity(spark):
    assert value(spark, *[is_valid_probe(F.lit(s)) for s in ("ATGC", "A" * 22, "AT" * 8 + "A", "GC" * 8 + "G", "ATGCAAAAATGCATGCA")]) == (False,) * 5


def test_types_and_ids(spark):
    got = value(spark, S.sequence_type(F.lit("ACGTACGTNN")), S.sequence_type(F.lit("MKLV")), S.sequence_type(F.lit("")), S.base_gene_id(F.lit("AT1G.2")), S.base_gene_id(F.lit("AT1G-x")), S.invalid_characters(F.lit("AC#?#"), F.lit("NT")), F.size(S.kmers(F.lit("AC"), 3)))
    assert got == ("NT", "AA", "AA", "AT1G", "AT1G-x", "#?", 0)


def test_sql_functions_are_inlined(spark):
    from seqloom.functions import sequence as S
    from seqloom.functions import sql, thermo

    sql.register(spark)
    rows = ["ACGTTGCAAGCTTCAGGA", "GGGGCCCCATATATATGC", "A", "", "ATATATAT", "acgt", None, "GCGCGCATGCAAGTCCAT"]
    spark.createDataFrame([(r,) for r in rows], "s string").createOrReplaceTempView("seqs")
    asked = "reverse_complement(s) a, gc_percent(s) b, gc_fraction(s) c, has_poly_n(s, 4) d, is_dna(s) e, has_hairpin(s, 4) f, has_complementarity(s, 'TTGCAACG', 4) g, gc_junction(s) h, is_valid_probe(s) i, base_gene_id('x.y-12') j, probe_count(49.9) k, header_id('a b c') l"
    got = spark.sql(f"SELECT s, {asked}, CASE WHEN length(s) > 1 AND is_dna(s) THEN tm_nn4(s) END t FROM seqs")
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
    table = spark.table("seqs")
    want = table.select("s", S.reverse_complement("s"), S.gc_percent("s"), S.gc_fraction("s"), S.has_poly_n("s", 4), S.is_dna("s"), S.has_hairpin("s", 4), S.has_complementarity("s", F.lit("TTGCAACG"), 4), S.gc_junction("s"), thermo.is_valid_probe("s"), F.lit("x.y"), F.lit(5), F.lit("a"), F.when((F.length("s") > 1) & S.is_dna("s"), thermo.tm("s")))
    plain = lambda r: tuple(round(x, 9) if isinstance(x, float) else x for x in r)
    known = lambda frame: {plain(r) for r in frame.collect() if r.s and S}
    assert known(got) == known(want) and len(known(got)) == 6
