import glob
import os

import duckdb
import pytest

from seqloom.llm import queries

from ..test_oracles import rows


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query(spark, sf_dir, name):
    db = duckdb.connect()
    for f in glob.glob(f"{sf_dir}/*.parquet"):
        db.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    got, want = queries.queries()[name](spark, sf_dir).toPandas(), db.execute(queries.ORACLES[name]).df()
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns and rows(got, columns) == rows(want, columns)


#: The runs of op13 in SQL: equal windows of 16 words, stretches of them at one distance, no smaller period over the same words.
RUNS = f"""WITH docs AS (SELECT doc_id, {queries._WORDS} ws, cast(doc_id AS varchar) s FROM documents),
 summed AS (SELECT doc_id, ws, len(ws) n, xor(list_reduce(list_prepend(4294967295::bigint, list_transform(range(1, length(s) + 1), lambda i: ascii(substr(s, i, 1))::bigint)), lambda c, b: list_reduce(list_prepend(xor(c, b), [0, 0, 0, 0, 0, 0, 0, 0]::bigint[]), lambda x, z: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384::bigint) ELSE x // 2 END)), 4294967295::bigint) h FROM docs),
 loops AS (SELECT *, CASE WHEN h % 10 = 0 AND n > 0 THEN (h // 10) % n END AS a FROM summed), spans AS (SELECT *, 1 + (n - a) // (3 + (h // 10) % 8) AS p FROM loops),
 looped AS (SELECT doc_id, n, CASE WHEN a IS NULL THEN ws ELSE list_transform(range(0, n), lambda i: ws[1 + CASE WHEN i >= a THEN a + (i - a) % p ELSE i END]) END AS ws FROM spans),
 windows AS (SELECT doc_id, n, i, ws[i + 1 : i + 16] w FROM (SELECT *, unnest(range(0, n - 15)) i FROM looped WHERE n >= 24)),
 pairs AS (SELECT x.doc_id, x.i, y.i - x.i AS d FROM windows x JOIN windows y ON x.doc_id = y.doc_id AND x.w = y.w AND y.i > x.i AND 3 * (y.i - x.i) <= x.n),
 islands AS (SELECT doc_id, d, min(i) s, count(*) + 15 + d AS size FROM (SELECT *, i - row_number() OVER (PARTITION BY doc_id, d ORDER BY i) k FROM pairs) GROUP BY doc_id, d, k HAVING count(*) + 15 + d >= greatest(24, 3 * d)),
 runs AS (SELECT * FROM islands r WHERE NOT EXISTS (SELECT 1 FROM islands q WHERE q.doc_id = r.doc_id AND q.d < r.d AND q.s <= r.s AND q.s + q.size >= r.s + r.size)),
 best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY size::double / d DESC, s, d) r FROM runs) WHERE r = 1),
 listed AS (SELECT doc_id, count(*) n_runs, string_agg(s || ',' || size || ',' || d || chr(10), '' ORDER BY s, d) said FROM runs GROUP BY 1),
 gone AS (SELECT DISTINCT doc_id, unnest(range(s + d, s + size)) i FROM runs), placed AS (SELECT doc_id, i, ws[i + 1] word FROM (SELECT *, unnest(range(0, n)) i FROM looped)),
 kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY i) said FROM placed ANTI JOIN gone USING (doc_id, i) GROUP BY 1)
 SELECT o.doc_id, coalesce(l.n_runs, 0)::bigint n_runs, b.s AS start, b.size AS length, b.d AS period, 1000 * b.size // b.d AS exponent_milli, sha256(coalesce(l.said, '')) runs_sha256, sha256(coalesce(k.said, '')) collapsed_sha256
 FROM looped o LEFT JOIN listed l USING (doc_id) LEFT JOIN best b ON b.doc_id = o.doc_id LEFT JOIN kept k ON k.doc_id = o.doc_id"""


def test_runs_are_those_of_sql(spark, sf_dir):
    """Row by row, as the columns of a text without runs are null integers."""
    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf_dir}/documents.parquet'")
    want = sorted(map(str, db.execute(RUNS).fetchall()))
    got = sorted(str(tuple(r)) for r in queries.op13_find_runs(spark, sf_dir).select("doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256").collect())
    assert got == want and sum("None" not in r for r in got) > 10
