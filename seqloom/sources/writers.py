"""Writers: every sink is a Spark writer over a projection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fasta(df: DataFrame, path: str, header: str = "id", seq: str = "seq", width: int = 60, annotate: Column | None = None) -> None:
    """Records wrapped at ``width``."""
    body = F.regexp_replace(F.regexp_replace(seq, f"(.{{{width}}})", "$1\n"), "\n$", "")
    head = F.col(header) if annotate is None else F.concat_ws(" ", F.col(header), annotate)
    df.select(F.concat(F.lit(">"), head, F.lit("\n"), body)).write.text(path)


def annotation(seq: str = "seq") -> Column:
    """The header note of a sequence: GC and melting temperature."""
    from ..functions.sequence import gc_percent_upper
    from ..functions.thermo import tm

    return F.format_string("GC=%.2f%% Tm=%.2f°C", gc_percent_upper(seq), tm(F.upper(seq)))


def _probes(sets: DataFrame) -> DataFrame:
    """task, set_id, side, start, end, seq: a row for each probe. ``sets`` has start, *_end and *_seq columns."""
    triple = "middle_seq" in sets.columns
    probe = lambda side, start, end: F.struct(F.lit(side).alias("side"), F.col(start).alias("start"), F.col(end).alias("end"), F.col({"L": "left_seq", "M": "middle_seq", "R": "right_seq"}[side]).alias("seq"))
    parts = [probe("L", "start", "left_end"), *([probe("M", "left_end", "middle_end")] if triple else []), probe("R", "right_start", "right_end")]
    return sets.select("gene_id", "set_id", F.explode(F.array(*parts)).alias("p")).select("gene_id", "set_id", "p.*")


def bed(sets: DataFrame, path: str) -> None:
    """Six columns, 0-based half-open."""
    _probes(sets).select("gene_id", "start", "end", F.concat_ws("-", "side", F.col("set_id").cast("string")), F.lit(0), F.lit("+")).write.option("sep", "\t").csv(path)


def probe_rows(sets: DataFrame, one_based: bool = True) -> DataFrame:
    """The rows of the probe CSV; positions from 1, or as in the filtered file from 0."""
    from ..functions.sequence import gc_percent
    from ..functions.thermo import tm

    start = F.col("start") + (1 if one_based else 0)
    return _probes(sets).select("gene_id", "set_id", F.col("side").alias("type"), "seq", start.alias("start"), "end", F.length("seq").alias("length"), F.format_string("%.1f", gc_percent("seq")).alias("gc"), F.format_string("%.1f", tm("seq")).alias("tm"))


def probe_csv(sets: DataFrame, path: str, one_based: bool = True) -> None:
    probe_rows(sets, one_based).write.option("header", True).csv(path)


def oligo_rows(oligos: DataFrame) -> DataFrame:
    """name, oligo of assembled dual or triple sets (task, bp_id)."""
    triple = "middle_oligo" in oligos.columns
    named = lambda end, c, bp: F.struct(F.concat(F.col("task"), F.lit(f"-{end}"), F.concat(F.lit("_" if triple else "-"), F.col("bp_id")) if bp else F.lit("")).alias("name"), F.col(c).alias("oligo"))
    parts = [named("L", "left_oligo", triple), *([named("M", "middle_oligo", False)] if triple else []), named("R", "right_oligo", not triple)]
    return oligos.select(F.explode(F.array(*parts)).alias("o")).select("o.*")


def oligo_csv(oligos: DataFrame, path: str) -> None:
    oligo_rows(oligos).write.option("header", True).csv(path)


def _document(sets: DataFrame) -> list[Column]:
    """The parts of a set's document: id, probes (positions from 1), evaluation, and keep and reason of a selected set.
    Figures are texts of one decimal; ``score``, where there is one, is the quality."""
    from ..functions.sequence import gc_percent
    from ..functions.thermo import tm

    triple = "middle_seq" in sets.columns
    spans = {"left": ("start", "left_end"), **({"middle": ("left_end", "middle_end")} if triple else {}), "right": ("right_start", "right_end")}
    one = lambda x: F.format_string("%.1f", x)
    mean = lambda f: one(sum((f(f"{p}_seq") for p in spans), F.lit(0.0)) / len(spans))
    probes = [
        F.struct(F.col(f"{p}_seq").alias("sequence"), F.struct((F.col(a) + 1).alias("start"), F.col(b).alias("end")).alias("position"), F.length(f"{p}_seq").alias("length"), one(gc_percent(f"{p}_seq")).alias("gc_content"), one(tm(f"{p}_seq")).alias("tm")).alias(f"{p}_probe")
        for p, (a, b) in spans.items()
    ]
    gaps = F.struct(F.lit(0).alias("left_to_middle"), (F.col("right_start") - F.col("middle_end")).alias("middle_to_right")).alias("gaps") if triple else (F.col("right_start") - F.col("left_end")).alias("gap")
    judged = [gaps, (F.col("right_end") - F.col("start")).alias("total_span"), mean(tm).alias("average_tm"), mean(gc_percent).alias("average_gc_content")]
    judged += [] if triple else [F.col("gc_junction").alias("has_gc_junction")]
    judged += [one(F.col("score").cast("double")).alias("quality_score")] if "score" in sets.columns else []
    return [F.col("set_id").alias("id"), *probes, F.struct(*judged).alias("evaluation"), *[F.col(c) for c in ("keep", "reason") if c in sets.columns]]


def set_documents(sets: DataFrame) -> DataFrame:
    """gene_id and one nested document per dual or triple set, as a JSON text."""
    return sets.select("gene_id", F.to_json(F.struct(*_document(sets))).alias("document"))


def set_json(sets: DataFrame, path: str) -> None:
    """A line for each set: its document and its gene."""
    sets.select("gene_id", *_document(sets)).write.json(path)


def filtered_json(sets: DataFrame, selected: DataFrame, path: str) -> None:
    """The documents of all sets with ``keep`` and ``reason``."""
    set_json(sets.join(selected.hint("merge"), ["gene_id", "set_id"]), path)


def tpm_csv(rows: DataFrame, path: str) -> None:
    rows.write.option("header", True).csv(path)


def pool_tsv(rows: DataFrame, path: str) -> None:
    rows.select("seq", F.format_string("%.2f", "tm"), F.format_string("%.2f", "gc")).write.option("sep", "\t").csv(path)


def filtered_rows(sets: DataFrame, selected: DataFrame) -> DataFrame:
    """The rows of the filtered probe file, with ``keep`` and ``reason`` of the set; positions from 0."""
    return probe_rows(sets, one_based=False).join(selected.hint("merge"), ["gene_id", "set_id"])


def filtered_csv(sets: DataFrame, selected: DataFrame, path: str) -> None:
    filtered_rows(sets, selected).write.option("header", True).csv(path)


def filtered_bed(sets: DataFrame, selected: DataFrame, path: str) -> None:
    """The BED file of the kept sets alone."""
    bed(sets.join(selected.filter("keep").hint("merge"), ["gene_id", "set_id"], "left_semi"), path)
