"""Column functions over nucleotide sequences. All are built-in expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

BASES = "ATGC"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def complement(s: Column | str) -> Column:
    """Base by base, not reversed; other characters pass through."""
    return F.translate(col(s), "ACGT", "TGCA")


def reverse_complement(s: Column | str) -> Column:
    return F.reverse(complement(s))


def count_of(s: Column, part: str) -> Column:
    """Non-overlapping occurrences of a literal."""
    return ((F.length(s) - F.length(F.replace(s, F.lit(part), F.lit("")))) / len(part)).cast("int")


def gc_count(s: Column | str) -> Column:
    s = col(s)
    return F.length(s) - F.length(F.replace(F.replace(s, F.lit("G"), F.lit("")), F.lit("C"), F.lit("")))


def gc_fraction(s: Column | str) -> Column:
    """0..1; 0 for the empty sequence."""
    return F.when(F.length(col(s)) > 0, gc_count(s) / F.length(col(s))).otherwise(F.lit(0.0))


def gc_percent(s: Column | str) -> Column:
    """0..100; 0 for the empty sequence."""
    return F.when(F.length(col(s)) > 0, gc_count(s) * F.lit(100.0) / F.length(col(s))).otherwise(F.lit(0.0))


def gc_percent_upper(s: Column | str) -> Column:
    return gc_percent(F.upper(col(s)))


def poly_n_ok(s: Column | str, n: int = 4) -> Column:
    """No run of n or more of one base."""
    return ~has_poly_n(s, n)


def has_poly_n(s: Column | str, n: int = 4) -> Column:
    return reduce(lambda a, b: a | b, [F.contains(col(s), F.lit(base * n)) for base in BASES])


def is_dna(s: Column | str) -> Column:
    return col(s).rlike("^[ATCG]+$")


def is_complementary(a: Column | str, b: Column | str) -> Column:
    """Equal length and position-wise A-T / C-G; any other character fails."""
    return (F.length(col(a)) == F.length(col(b))) & col(a).rlike("^[ATCG]*$") & (complement(a) == col(b))


def let(value: Column, body) -> Column:
    """Bind ``value`` once for an inner loop."""
    return F.transform(F.array(value), body)[0]


def kmers(s: Column | str, k: int) -> Column:
    """All k-mers in order; none when the sequence is shorter.

    Cut from bytes, where a piece is found at once; in a string each would be searched for from its start, which
    makes long sequences quadratic.  Sequences are ASCII."""
    s = col(s)
    cut = lambda b: F.transform(F.sequence(F.lit(1), F.octet_length(b) - k + 1), lambda i: F.substring(b, i, F.lit(k)).cast("string"))
    return F.when(F.length(s) >= k, let(s.cast("binary"), cut)).otherwise(F.array().cast("array<string>"))


def once(value: Column, name: str) -> Column:
    """A computed column that later filters use by value: without it, the optimizer would copy its
    expression into every filter above it."""
    return F.explode(F.array(value)).alias(name)


def distinct_kmers(s: Column | str, k: int) -> Column:
    return F.array_distinct(kmers(s, k))


def has_hairpin(s: Column | str, stem: int = 4) -> Column:
    """Some stem-mer is followed, without overlap, by its reverse complement (no least loop)."""
    s = col(s)
    starts = F.sequence(F.lit(1), F.length(s) - 2 * stem + 1)
    hit = F.exists(starts, lambda i: F.instr(F.substring(s, i + stem, F.length(s)), reverse_complement(F.substring(s, i, F.lit(stem)))) > 0)
    return F.when(F.length(s) >= 2 * stem, hit).otherwise(F.lit(False))


def end_matches(s: Column | str, n: int = 4) -> Column:
    """Positions at which the first n bases equal the reverse complement of the last n."""
    s = col(s)
    back = reverse_complement(F.right(s, F.lit(n)))
    return reduce(lambda a, b: a + b, [(F.substring(s, i + 1, 1) == F.substring(back, i + 1, 1)).cast("int") for i in range(n)])


def has_hairpin_ends(s: Column | str, n: int = 4, least: int = 3) -> Column:
    return end_matches(s, n) >= least


def has_complementarity(a: Column | str, b: Column | str, m: int = 4) -> Column:
    """Some m-mer of a is the reverse complement of an m-mer of b."""
    return F.arrays_overlap(kmers(a, m), kmers(reverse_complement(b), m))


def has_end_complementarity(a: Column | str, b: Column | str, m: int = 4) -> Column:
    """3' ends pair over min(5, m) bases; only where no inner m-mer pairs."""
    n = F.lit(min(5, m))
    return ~has_complementarity(a, b, m) & is_complementary(F.right(col(a), n), F.reverse(F.right(col(b), n)))


def has_self_dimer(s: Column | str, m: int = 4) -> Column:
    s = col(s)
    half = F.floor(F.length(s) / 2).cast("int")
    return (F.length(s) >= 2 * m) & has_complementarity(F.substring(s, F.lit(1), half), F.substring(s, half + 1, F.length(s)), m)


def has_dimer(seqs: list[Column | str], m: int = 4) -> Column:
    """A self dimer of one, or complementarity of two of the sequences; no sequences have none."""
    tests = [has_self_dimer(s, m) for s in seqs] + [has_complementarity(a, b, m) for i, a in enumerate(seqs) for b in seqs[i + 1 :]]
    return reduce(lambda a, b: a | b, tests) if tests else F.lit(False)


def gc_junction(s: Column | str) -> Column:
    """The first base is G or C; false for the empty sequence."""
    return F.coalesce(F.substring(col(s), 1, 1).isin("G", "C"), F.lit(False))


def has_low_complexity(s: Column | str, repeated: Column | str, k: int) -> Column:
    return F.coalesce(F.arrays_overlap(kmers(s, k), col(repeated)), F.lit(False))


def bp_number(bp_id: Column | str) -> Column:
    """``BP_0123`` -> 123; null for other ids."""
    return F.when(F.startswith(col(bp_id), F.lit("BP_")), F.expr("try_cast(substring({0}, 4) AS INT)".format(bp_id if isinstance(bp_id, str) else bp_id._jc.toString())))


def base_gene_id(gene_id: Column | str) -> Column:
    """Without a trailing ``.n`` or ``-n``."""
    return F.regexp_replace(col(gene_id), r"^(.+?)[.-][0-9]+$", "$1")


def header_id(header: Column | str) -> Column:
    return F.split(col(header), " ")[0]


def sequence_type(s: Column | str) -> Column:
    """NT or AA: letters that no nucleotide has decide, then a share of 70 % of ATCGU."""
    s = F.upper(col(s))
    share = F.length(F.regexp_replace(s, "[^ATCGU]", "")) / F.length(s)
    return F.when(F.length(s) == 0, "AA").when(s.rlike("[DEFHIKLMPQRSVWY]"), "AA").when(share >= 0.70, "NT").otherwise("AA")


# Alphabets with ambiguity codes.
NT_ALPHABET = "ATCGURYSWKMBDHVN"
AA_ALPHABET = "ACDEFGHIKLMNPQRSTVWYXZ*"


def invalid_characters(s: Column | str, kind: Column | str) -> Column:
    """Sorted distinct characters outside the alphabet of the type, joined."""
    s = F.trim(F.upper(col(s)))
    left = F.when(col(kind) == "NT", F.regexp_replace(s, f"[{NT_ALPHABET}]", "")).otherwise(F.regexp_replace(s, r"[ACDEFGHIKLMNPQRSTVWYXZ*]", ""))
    return F.array_join(F.array_sort(F.array_distinct(F.split(left, ""))), "")


def probe_count(tpm: Column | str) -> Column:
    """Recommended number of probes by expression."""
    t = col(tpm)
    return F.when(t < 1, 10).when(t < 10, 8).when(t < 50, 5).when(t < 150, 4).otherwise(3)
