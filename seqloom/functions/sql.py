"""The sequence functions in SQL: temporary functions whose bodies are expressions, which Catalyst inlines.

``register(spark)`` makes them known to a session; ``spark.sql`` and ``F.expr`` then take them like built-in ones.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

from .sequence import BASES
from .thermo import GAS, NN3, NN4, SALT, STRANDS, Table, _partner


def _sum(table: Table, which: int) -> str:
    known = dict(table.pairs) | {_partner(p): v for p, v in table.pairs.items()}
    pairs = ", ".join(f"'{p}', {v[which]}" for p, v in sorted(known.items()))
    end = lambda c: f"if({c} IN ('A', 'T'), {table.end_at[which]}, {table.end_gc[which]})"
    each = f"aggregate(sequence(1, length(s) - 1), 0, (total, i) -> total + element_at(map({pairs}), substring(s, i, 2)))"
    return f"({table.start[which]} + {end('left(s, 1)')} + {end('right(s, 1)')} + {each})"


def _tm(table: Table) -> str:
    entropy = f"{_sum(table, 1)} / 10.0D + 0.368D * (length(s) - 1) * ln({SALT}D) + {GAS}D * ln({STRANDS!r}D)"
    return f"CASE WHEN length(s) >= 2 THEN 1000.0D * ({_sum(table, 0)} / 10.0D) / ({entropy}) - 273.15D END"


_GC = "length(s) - length(replace(replace(s, 'G', ''), 'C', ''))"
_RUN = " OR ".join(f"contains(s, repeat('{b}', n))" for b in BASES)

#: name -> parameters, type, body.
FUNCTIONS: dict[str, tuple[str, str, str]] = {
    "complement": ("s STRING", "STRING", "translate(s, 'ACGT', 'TGCA')"),
    "reverse_complement": ("s STRING", "STRING", "reverse(translate(s, 'ACGT', 'TGCA'))"),
    "gc_percent": ("s STRING", "DOUBLE", f"if(length(s) > 0, ({_GC}) * 100.0D / length(s), 0.0D)"),
    "gc_fraction": ("s STRING", "DOUBLE", f"if(length(s) > 0, ({_GC}) * 1.0D / length(s), 0.0D)"),
    "has_poly_n": ("s STRING, n INT", "BOOLEAN", _RUN),
    "poly_n_ok": ("s STRING, n INT", "BOOLEAN", f"NOT ({_RUN})"),
    "is_dna": ("s STRING", "BOOLEAN", "s RLIKE '^[ATCG]+$'"),
    "gc_junction": ("s STRING", "BOOLEAN", "coalesce(left(s, 1) IN ('G', 'C'), false)"),
    "is_complementary": ("a STRING, b STRING", "BOOLEAN", "length(a) = length(b) AND a RLIKE '^[ATCG]*$' AND translate(a, 'ACGT', 'TGCA') = b"),
    "has_complementarity": ("a STRING, b STRING, m INT", "BOOLEAN", "length(a) >= m AND length(b) >= m AND exists(sequence(1, greatest(length(a) - m + 1, 1)), i -> contains(reverse(translate(b, 'ACGT', 'TGCA')), substring(a, i, m)))"),
    "has_hairpin": ("s STRING, stem INT", "BOOLEAN", "length(s) >= 2 * stem AND exists(sequence(1, greatest(length(s) - 2 * stem + 1, 1)), i -> contains(substring(s, i + stem), reverse(translate(substring(s, i, stem), 'ACGT', 'TGCA'))))"),
    "tm_nn3": ("s STRING", "DOUBLE", _tm(NN3)),
    "tm_nn4": ("s STRING", "DOUBLE", _tm(NN4)),
    "is_valid_probe": ("s STRING", "BOOLEAN", "CASE WHEN length(s) BETWEEN 17 AND 20 AND s RLIKE '^[ACGT]+$' AND gc_percent(s) BETWEEN 40 AND 60 AND poly_n_ok(s, 4) THEN abs(tm_nn4(s) - 50.0D) <= 3.0D ELSE false END"),
    "bp_number": ("id STRING", "INT", "CASE WHEN startswith(id, 'BP_') THEN try_cast(substring(id, 4) AS INT) END"),
    "base_gene_id": ("id STRING", "STRING", r"regexp_replace(id, r'^(.+?)[.-][0-9]+$', '$1')"),
    "header_id": ("header STRING", "STRING", "split_part(header, ' ', 1)"),
    "probe_count": ("tpm DOUBLE", "INT", "CASE WHEN tpm < 1 THEN 10 WHEN tpm < 10 THEN 8 WHEN tpm < 50 THEN 5 WHEN tpm < 150 THEN 4 ELSE 3 END"),
}


def register(spark: SparkSession) -> None:
    for name, (parameters, kind, body) in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS {kind} RETURN {body}")
