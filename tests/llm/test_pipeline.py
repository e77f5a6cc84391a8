from collections import Counter

from pyspark.sql import functions as F

import corpus_pipeline
from seqloom.llm import quality
from seqloom.llm.common import table

from .helpers import documents, least, plain_words
from .test_operators import copies, jaccard_classes, kept_by


def contaminated(text, windows):
    w, hit = plain_words(text), set()
    for n in {len(x) for x in windows}:
        for k in range(len(w) - n + 1):
            if tuple(w[k : k + n]) in windows:
                hit.update(range(k, k + n))
    return bool(hit) and 20 * len(hit) >= len(w)


def test_stages(spark, sf_dir):
    """Each stage's rows, from its own input, by plain Python."""
    docs = table(spark, sf_dir, "documents")
    labels, bench = table(spark, sf_dir, "labels"), table(spark, sf_dir, "benchmark").collect()
    windows = set()
    for r in bench:
        w = plain_words(r.text)
        windows.update(tuple(w[k : k + 13]) for k in range(max(1, len(w) - 12)) if w)
    rows = docs.collect()
    for name, stage in corpus_pipeline.STAGES[:3]:
        out = stage(spark, docs, sf_dir).cache()
        assert out.columns == docs.columns
        if name == "quality_rules":
            rules = quality.fit(docs, labels)
            want = [r for r in rows if kept_by(rules, r.text)]
        elif name == "near_dedup":
            first = set(jaccard_classes(rows).values())
            want = [r for r in rows if r.doc_id in first]
        else:
            want = [r for r in rows if not contaminated(r.text, windows)]
        assert Counter(out.collect()) == Counter(want) and len(want) < len(rows)
        docs, rows = out, want
    mixed = corpus_pipeline.STAGES[3][1](spark, docs, sf_dir).cache()
    got = mixed.collect()
    assert mixed.columns == docs.columns and [(r.doc_id, r.text) for r in got] == [x[1:] for x in copies(rows)]
    shards = corpus_pipeline.STAGES[4][1](spark, mixed, sf_dir)
    assert Counter((r.doc_id, r.size) for r in shards.collect()) == Counter((r.doc_id, len((r.text or "").encode()) + 16) for r in got)
    assert shards.groupBy("shard").agg((F.max("slot") + 1 - F.count("*")).alias("x")).filter("x <> 0").count() == 0


def test_stages_keep_rows_apart_that_share_an_id(spark, sf_dir):
    docs = documents(spark).cache()
    rows = docs.collect()
    near = corpus_pipeline.near_dedup(spark, docs, sf_dir)
    numbers = sorted(range(len(rows)), key=lambda k: (least(rows[k].doc_id), rows[k].text or ""))

    class Row:
        def __init__(self, doc_id, text):
            self.doc_id, self.text = doc_id, text

    first = set(jaccard_classes([Row(n, rows[k].text) for n, k in enumerate(numbers)]).values())
    assert near.columns == docs.columns
    assert Counter((r.doc_id, r.text) for r in near.collect()) == Counter((rows[k].doc_id, rows[k].text) for n, k in enumerate(numbers) if n in first)
    passage = spark.read.parquet(f"{sf_dir}/benchmark.parquet").filter("length(text) > 100").first().text
    frame = spark.createDataFrame([(1, passage, 5), (1, "clean " * 30, 5), (None, passage, 5), (None, "also clean", 5)], "doc_id long, text string, row int")
    kept = corpus_pipeline.decontaminate(spark, frame, sf_dir).collect()
    assert {(r.doc_id, r.text, r.row) for r in kept} == {(1, "clean " * 30, 5), (None, "also clean", 5)}


def test_stages_keep_columns_with_awkward_names(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").limit(60).selectExpr("*", "doc_id AS `x.y`", "'a' AS `b``c`", "1 AS size").cache()
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf_dir)
        assert out.count() > 0
        if name != "shard":
            assert out.columns == docs.columns and all(r["doc_id"] == r["x.y"] for r in out.collect())
