"""The stateless operators on streams: what is a projection in batch is one here."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..operators.bridge import strand_kmers
from ..operators.generator import screen


def screen_stream(sequences: DataFrame, **limits) -> DataFrame:
    """A stream of ``seq`` with the first failing test."""
    return screen(sequences, **limits)


def conflict_stream(sequences: DataFrame, library: DataFrame, k: int = 9) -> DataFrame:
    """A stream of (bp_id, seq) joined with a static library on shared k-mers: a row for each shared one."""
    return strand_kmers(sequences, k).join(strand_kmers(library, k).withColumnRenamed("bp_id", "other"), "kmer")
