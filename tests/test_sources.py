import gzip
import json
import random

from pyspark.sql import functions as F

from seqloom.operators import assembly, designer, generator, kmers
from seqloom.sources import derived, readers, writers
from seqloom.streaming import screen


def test_fasta_round_trip(spark, tmp_path):
    frame = spark.createDataFrame([("a", "ACGT" * 40), ("b", "GG"), ("c", "T" * 60)], "id string, seq string")
    writers.fasta(frame.coalesce(1), str(tmp_path / "f"))
    got = {r.id: r.seq for r in readers.fasta(spark, str(tmp_path / "f")).collect()}
    assert got == {"a": "ACGT" * 40, "b": "GG", "c": "T" * 60}


def test_fasta_duplicates_and_gzip(spark, tmp_path):
    with gzip.open(tmp_path / "x.fa.gz", "wt") as f:
        f.write(">a one\nAC\nGT\n>b\nTT\n>a two\nCC\n")
    rows = readers.fasta(spark, str(tmp_path / "x.fa.gz")).orderBy("ord").collect()
    assert [(r.id, r.seq) for r in rows] == [("a", "CC"), ("b", "TT")]


def literal_fasta(text):
    """Headers at a line's start; of equal ids the last sequence at the first one's place."""
    out, name = {}, None
    for line in text.replace("\r\n", "\n").replace("\r", "\n").split("\n"):
        if line.startswith(">"):
            header = line[1:].strip("\r ")
            name = header.split()[0] if header.split() else ""
            out[name] = [header, ""]
        elif name is not None:
            out[name][1] += "".join(line.split())
    return [(k, *v) for k, v in out.items()]


def test_fasta_line_by_line(spark, tmp_path):
    """Ranges of a few bytes: headers and sequences lie across them."""
    rng = random.Random(5)
    text = "ACGT before any header\n"
    for i in range(60):
        text += f">g{i % 50} A->B >not a header {i}" + rng.choice(["\n", "\r\n"])
        for _ in range(rng.randint(0, 6)):
            text += "".join(rng.choice("ACGT") for _ in range(rng.randint(0, 90))) + rng.choice(["\n", "\r\n", "\n\n", "  \n"])
    text += ">last\n" + "ACGTT" * 2000 + "\nACG>T"
    (tmp_path / "x.fa").write_bytes(text.encode())
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    for size in ("200b", "3k", before):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        try:
            rows = readers.fasta(spark, str(tmp_path / "x.fa")).orderBy("ord").collect()
            pieces = readers.fasta_pieces(spark, str(tmp_path / "x.fa")).collect()
        finally:
            spark.conf.set("spark.sql.files.maxPartitionBytes", before)
        assert [(r.id, r.header, r.seq) for r in rows] == literal_fasta(text)
        assert max(len(r.piece) for r in pieces) <= readers.PIECE
        for name, _, seq in literal_fasta(text):
            mine = sorted((r.offset, r.piece) for r in pieces if r.id == name)
            assert "".join(p for _, p in mine) == seq and [o for o, _ in mine] == [sum(len(p) for _, p in mine[:k]) for k in range(len(mine))]


def test_piece_blocks_are_blocks(spark):
    rng = random.Random(6)
    seqs = [(i, "".join(rng.choice("ACGT") for _ in range(n))) for i, n in enumerate((0, 5, 1023, 1024, 1035, 5000))]
    pieces = []
    for i, s in seqs:
        at = 0
        while at < len(s):
            n = rng.choice([1, 7, 60, 3000])
            pieces.append((i, at, s[at : at + n]))
            at += n
    whole = spark.createDataFrame(seqs, "id int, seq string")
    for reach in (1, 12, 1500):
        want = {(r.id, r.offset, bytes(r.b)) for r in kmers.blocks(whole, reach, "id", least=3).collect()}
        got = {(r.id, r.offset, bytes(r.b)) for r in kmers.piece_blocks(spark.createDataFrame(pieces, "id int, offset long, piece string"), reach, "id", least=3).collect()}
        assert got == want


def test_tables(spark, tmp_path):
    (tmp_path / "b.txt").write_text("BP_0001  ACG\n\nBP_0002\tTTT extra\n# no\n")
    assert [(r.bp_id, r.seq) for r in readers.bridge(spark, str(tmp_path / "b.txt")).orderBy("ord").collect()][:2] == [("BP_0001", "ACG"), ("BP_0002", "TTT")]
    assert [r.seq for r in readers.existing_probes(spark, str(tmp_path / "b.txt")).collect()] == ["BP_0001", "BP_0002"]
    (tmp_path / "r.csv").write_text("t1,BP_1,G1\nt2,BP_2,G2,7\nt3,BP_3,G3,many\n")
    assert sorted((r.task, r.max_selected) for r in readers.batch_requests(spark, str(tmp_path / "r.csv")).collect()) == [("t1", 5), ("t2", 7), ("t3", 5)]
    (tmp_path / "p.csv").write_text("name,sequence\nx, ACGT \n")
    assert [tuple(r) for r in readers.probe_csv(spark, str(tmp_path / "p.csv")).collect()] == [("x", "ACGT")]
    (tmp_path / "c.txt").write_text("g1 5\ng2 x\ng1 7.5\n")
    assert [tuple(r) for r in readers.expression_counts(spark, str(tmp_path / "c.txt")).collect()] == [("g1", 7.5)]
    (tmp_path / "a.tsv").write_bytes("l1\tsym\nl2\tSYM\n".encode("latin-1"))
    assert [tuple(r) for r in readers.gene_alias(spark, str(tmp_path / "a.tsv")).collect()] == [("SYM", "L2")]
    assert [r.id for r in readers.id_list(spark, None, "b, a,b").orderBy("ord").collect()] == ["b", "a"]


def test_probe_sets(spark, tmp_path):
    probe = lambda a, b: {"sequence": "ACGT", "position": {"start": a, "end": b}}
    (tmp_path / "s.json").write_text(json.dumps({"probe_sets": [{"id": 1, "left_probe": probe(0, 4), "right_probe": probe(4, 8), "evaluation": {"quality_score": "2.5"}}]}, indent=1))
    row = readers.probe_sets(spark, str(tmp_path / "s.json")).first()
    assert row.score == 2.5 and [(x.start, x.end) for x in row.intervals] == [(0, 4), (4, 8)]


def test_set_writers(spark, sf_dir, tmp_path):
    sets = designer.design(derived.genes(spark, sf_dir)).cache()
    n = sets.count()
    writers.bed(sets, str(tmp_path / "bed"))
    writers.probe_csv(sets, str(tmp_path / "csv"))
    assert spark.read.csv(str(tmp_path / "bed"), sep="\t").count() == 2 * n == spark.read.csv(str(tmp_path / "csv"), header=True).count()
    assert json.loads(writers.set_documents(sets).first().document)["left_probe"]["position"]["end"] > 0
    oligos = assembly.dual_oligos(sets.withColumn("bridge", F.lit("ACGTACGTACGTACGTACG")).withColumn("task", F.lit("T")).withColumn("bp_id", F.lit("BP_1")), F.lit("A"))
    writers.oligo_csv(oligos, str(tmp_path / "oligos"))
    names = {r.name for r in spark.read.csv(str(tmp_path / "oligos"), header=True).collect()}
    assert names == {"T-L", "T-R-BP_1"}


def test_generator_is_repeatable(spark):
    a, b = (sorted(r.seq for r in generator.generate(spark, 5, factor=300).collect()) for _ in range(2))
    assert a == b and len(a) == 5 and all(len(s) == 25 for s in a)


def test_screen_on_a_stream(spark, tmp_path):
    generator.random_sequences(spark, 200).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("seq string").parquet(str(tmp_path / "in"))
    query = screen.screen_stream(stream).writeStream.format("memory").queryName("screened").start()
    try:
        query.processAllAvailable()
    finally:
        query.stop()
    got = sorted(map(tuple, spark.sql("SELECT seq, stage FROM screened").collect()))
    assert got == sorted(map(tuple, generator.screen(spark.read.parquet(str(tmp_path / "in"))).collect()))
