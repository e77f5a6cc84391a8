"""Windows and sets found block by block against DuckDB, on genes of one block and of several."""

import dataclasses
import random

import duckdb
import pytest

from seqloom.operators import designer
from seqloom.plans import sql as Q

from .test_oracles import rows


@pytest.fixture(scope="module")
def genes(spark):
    """Short ones, of a block exactly and one more, and long ones with passages that come again, turned too, across blocks."""
    rng = random.Random(5)
    text = lambda n: "".join(rng.choice("ACGT") for _ in range(n))
    part, other = text(30), str.maketrans("ACGT", "TGCA")
    made = [text(n) for n in (0, 7, 14, 15, 60, 640, 1023, 1024, 1025)] + [text(1010) + part + text(900) + part + text(1200), text(40) + part + text(2010) + part + text(500) + part.translate(other)[::-1] + text(60)]
    db = duckdb.connect()
    db.execute("CREATE TABLE genes (gene_id BIGINT, seq VARCHAR)")
    db.executemany("INSERT INTO genes VALUES (?, ?)", list(enumerate(made)))
    return spark.createDataFrame(list(enumerate(made)), "gene_id long, seq string"), db


@pytest.mark.parametrize("config", [designer.DUAL, designer.TRIPLE, dataclasses.replace(designer.DUAL, inner_gap=7)], ids=["dual", "triple", "gap"])
def test_blocks_hold_all_windows_and_sets(genes, config):
    frame, db = genes
    found = designer.feasible(frame, config)
    for got, sql in (
        (designer.candidates(frame, config).selectExpr("gene_id", "start", "len", "w", "round(tm, 4) tm"), f"{Q.candidates(config)} SELECT gene_id, start, len, w, round(tm, 4) tm FROM candidates"),
        (designer.first_valid(frame, config), f'{Q.candidates(config)} SELECT gene_id, start, "end" - start AS len FROM firsts'),
        (found, f"{Q.feasible(config)} SELECT {', '.join(found.columns)} FROM feasible"),
    ):
        got, want = got.toPandas(), db.execute("WITH " + sql).df()
        assert rows(got, sorted(want.columns)) == rows(want, sorted(want.columns)) and len(want) > 20
        assert want.gene_id.max() == 10


def test_windows_are_not_shuffled(genes):
    for found in (designer.candidates(genes[0]), designer.feasible(genes[0])):
        plan = found._jdf.queryExecution().optimizedPlan().toString()
        assert "start" not in "".join(line for line in plan.split("\n") if "Join" in line or "Aggregate" in line)
