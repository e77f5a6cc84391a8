"""Nearest-neighbour melting temperature as column expressions.

The values of neighbouring pairs are integers, added and divided once, so that other engines get the same bits.
Windows of one sequence share the values of its pairs (:func:`pair_values`, once for each position).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from .sequence import col, gc_percent, let, poly_n_ok


@dataclass(frozen=True)
class Table:
    """Tenths of kcal/mol and cal/(mol K): start, ends and pairs (also of their reverse complements)."""

    start: tuple[int, int]
    end_at: tuple[int, int]
    end_gc: tuple[int, int]
    pairs: dict[str, tuple[int, int]]


# Published nearest-neighbour parameters (Allawi & SantaLucia 1997; SantaLucia & Hicks 2004).
NN3 = Table((0, 0), (23, 41), (1, -28), {"AA": (-79, -222), "AT": (-72, -204), "TA": (-72, -213), "CA": (-85, -227), "GT": (-84, -224), "CT": (-78, -210), "GA": (-82, -222), "CG": (-106, -272), "GC": (-98, -244), "GG": (-80, -199)})
NN4 = Table((2, -57), (22, 69), (0, 0), {"AA": (-76, -213), "AT": (-72, -204), "TA": (-72, -204), "CA": (-85, -227), "GT": (-84, -224), "CT": (-78, -210), "GA": (-82, -222), "CG": (-106, -272), "GC": (-98, -244), "GG": (-80, -190)})
#: 50 mM monovalent salt; 25 nM of either strand; the gas constant.
SALT, STRANDS, GAS = 0.05, 12.5e-9, 1.987


def _partner(pair: str) -> str:
    return pair[::-1].translate(str.maketrans("ACGT", "TGCA"))


def _pack(v: tuple[int, int]) -> int:
    """Both sums in one integer, enthalpy * 65536 + entropy, so that sequences are walked once."""
    return v[0] * 65536 + v[1]


def _pair_value(pair: Column, table: Table) -> Column:
    known = dict(table.pairs) | {_partner(p): v for p, v in table.pairs.items()}
    names = sorted(known)
    return F.element_at(F.array(*[F.lit(_pack(known[p])) for p in names]), ((F.instr(F.lit(" ".join(names)), pair) + 2) / 3).cast("int"))


def pair_values(data: Column, table: Table = NN4) -> Column:
    """Packed value of each pair of neighbours of an ACGT sequence, given as bytes."""
    return let(data, lambda b: F.transform(F.sequence(F.lit(1), F.octet_length(b) - 1), lambda i: _pair_value(F.substring(b, i, F.lit(2)).cast("string"), table)))


def tm_of_pairs(pairs: Column, first: Column, last: Column, n: Column, table: Table = NN4) -> Column:
    """Temperature of n bases from the packed values of their pairs and their ends."""
    end = lambda c: F.when(c.isin("A", "T"), _pack(table.end_at)).otherwise(_pack(table.end_gc))
    packed = F.aggregate(pairs, F.lit(_pack(table.start)), lambda a, v: a + v) + end(first) + end(last)
    # the entropy sum is negative and above -65536
    salted = lambda p: (p.bitwiseAND(F.lit(65535)) - 65536) / F.lit(10.0) + F.lit(0.368) * (n - 1) * F.log(F.lit(SALT))
    return let(packed, lambda p: F.lit(1000.0) * ((F.shiftright(p, 16) + 1) / F.lit(10.0)) / (salted(p) + F.lit(GAS) * F.log(F.lit(STRANDS))) - F.lit(273.15))


def tm(s: Column | str, table: Table = NN4) -> Column:
    """Melting temperature in degrees Celsius of an ACGT sequence of two bases or more."""
    s = col(s)
    return tm_of_pairs(pair_values(s.cast("binary"), table), F.substring(s, 1, 1), F.right(s, F.lit(1)), F.length(s), table)


def tm_between(s: Column | str, low: float, high: float, table: Table = NN4) -> Column:
    """Inclusive, with one evaluation of the temperature."""
    return F.abs(tm(s, table) - F.lit((low + high) / 2)) <= F.lit((high - low) / 2)


def is_valid_probe(s: Column | str, min_length: int = 17, max_length: int = 20, gc_min: float = 40.0, gc_max: float = 60.0, tm_min: float = 47.0, tm_max: float = 53.0, poly_n: int = 4, table: Table = NN4) -> Column:
    """Inclusive bounds; ``when`` keeps the melting temperature behind the cheap tests."""
    s = col(s)
    cheap = F.length(s).between(min_length, max_length) & s.rlike("^[ACGT]+$") & gc_percent(s).between(gc_min, gc_max) & poly_n_ok(s, poly_n)
    return F.when(cheap, tm_between(s, tm_min, tm_max, table)).otherwise(F.lit(False))
