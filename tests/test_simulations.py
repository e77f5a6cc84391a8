"""Set-based plans against literal simulations."""

import random

import pytest
from pyspark.sql import functions as F

from seqloom.operators import bridge, curation, designer, orbits, selection


def scan(feasible, n, least):
    """The walk over positions, as a loop."""
    out, used, pos = [], set(), 0
    while pos < n - 3 * least:
        start = pos
        while start in used:
            start += 1
        hit = feasible.get(start)
        if hit is None:
            pos += 1
            continue
        left_end, right_end = hit
        out.append(start)
        used.update(range(start, right_end))
        pos = left_end
    return out


def test_accept_follows_the_walk(spark):
    rng, rows, want = random.Random(3), [], {}
    for gene in range(60):
        n = rng.randint(60, 200)
        feasible = {}
        for s in range(n - 30):
            if rng.random() < 0.4:
                left = s + rng.randint(15, 20)
                right = left + rng.randint(15, 20)
                if left < n - 15 and right <= n:
                    feasible[s] = (left, right)
        rows += [(gene, n, s, e, e, r) for s, (e, r) in feasible.items()]
        want[gene] = scan(feasible, n, 15)
    sets = spark.createDataFrame(rows, "gene_id long, n int, start int, left_end int, right_start int, right_end int")
    got = {g: [] for g in want}
    for r in designer.accept(sets).orderBy("gene_id", "set_id").collect():
        got[r.gene_id].append(r.start)
    assert got == want


def nested_scan(window, n, gap, triple, low=15, reach=20):
    """The walk with its set of used positions, as a loop."""
    used, out, pos = set(), [], 0

    def find(p):
        while p <= n - low:
            if not used.intersection(range(p, p + reach)):
                return (p, window[p]) if p in window else None
            p += 1
        return None

    while pos < n - 3 * low:
        left = find(pos)
        middle = left and triple and (find(left[1]) if not used.intersection(range(left[1], left[1] + reach)) else None)
        last = middle if triple else left
        right = find(last[1] + gap) if last and last[1] + gap < n - low else None
        if not right:
            pos += 1
            continue
        out.append((left[0], left[1], last[1], *right))
        for a, b in (left, *([middle] if triple else []), right):
            used.update(range(a, b))
        pos = left[1]
    return out


@pytest.mark.parametrize("triple", [False, True])
def test_nested_scan_follows_the_walk(spark, triple):
    rng = random.Random(8 + triple)
    for gap in (0, 7, 19, 20, 25, 33, 40):
        windows, genes, want = [], [], {}
        for gene in range(25):
            n = rng.randint(60, 400)
            seq = "A" * n  # no dimers
            found = {p: p + rng.randint(15, 20) for p in range(n - 20) if rng.random() < 0.6}
            windows += [(gene, p, e, seq[p:e]) for p, e in found.items()]
            genes.append((gene, seq))
            want[gene] = nested_scan(found, n, gap, triple)
        config = designer.Config(inner_gap=gap, arity=3 if triple else 2)
        rows = designer.accept_nested(spark.createDataFrame(windows, "gene_id long, start int, end int, w string"), spark.createDataFrame(genes, "gene_id long, seq string"), config).orderBy("gene_id", "set_id").collect()
        got = {g: [] for g in want}
        for r in rows:
            got[r.gene_id].append((r.start, r.left_end, r.middle_end if triple else r.left_end, r.right_start, r.right_end))
        assert got == want
        if gap > 25 and not triple:
            assert any(b[0] < a[3] for v in want.values() for a, b in zip(v, v[1:]))  # sets start inside others


def test_orbits_over_many_tiles(spark, monkeypatch):
    monkeypatch.setattr(orbits, "TILE", 16)
    rng, nodes, first, want = random.Random(4), [], [], set()
    for key in "abc":
        at = sorted(rng.sample(range(3000), 900 if key != "c" else 3))
        jump = {p: next((q for q in at if q >= p + rng.choice([1, 5, 90])), None) for p in at}
        nodes += [(key, p, q) for p, q in jump.items()]
        p = at[rng.randrange(3)]
        first.append((key, p))
        while p is not None:
            want.add((key, p))
            p = jump[p]
    got = orbits.orbit(spark.createDataFrame(nodes, "key string, pos long, next long"), spark.createDataFrame(first, "key string, pos long"))
    rows = [tuple(r) for r in got.collect()]
    assert len(rows) == len(set(rows)) and set(rows) == want and len(want) > 150


def scheduled(rows):
    """The dynamic program with its table, search and way back. rows: (start, end, place)."""
    rows = sorted(rows, key=lambda r: (r[1], r[2]))
    before = [sum(e < s for _, e, _ in rows) for s, _, _ in rows]
    best = []
    for i, b in enumerate(before):
        best.append(max(best[i - 1] if i else 0, 1 + (best[b - 1] if b else 0)))
    i, taken = len(rows) - 1, set()
    while i >= 0:
        if i == 0 or best[i] != best[i - 1]:
            taken.add(i)
            i = before[i] - 1
        else:
            i -= 1
    return [(*r, best[i], before[i], i in taken) for i, r in enumerate(rows)]


def test_schedules_follow_the_dynamic_program(spark):
    rng, rows, want = random.Random(12), [], []
    for key in range(30):
        mine = [(s, s + rng.randint(0, 9), i) for i, s in enumerate(rng.choices(range(60), k=rng.randint(1, 50)))]
        rows += [(key, *r) for r in mine]
        want += [(key, *r) for r in scheduled(mine)]
    got = designer.scheduled_intervals(spark.createDataFrame(rows, "gene_id long, start int, end int, place int"), "gene_id", "place")
    assert sorted(map(tuple, got.collect())) == sorted(want)


def close(a, b, d=15):
    return any(not (x[1] < y[0] - d or y[1] < x[0] - d) for x in a for y in b)


def even(chain):
    if len(chain) == 1:
        return 1.0
    spans = [(c[1][0][0], c[1][-1][1]) for c in chain]
    ideal = (max(s[1] for s in spans) - min(s[0] for s in spans)) / (len(spans) - 1)
    gaps = [b[0] - a[1] for a, b in zip(spans, spans[1:])]
    return 1 / (1 + sum((g - ideal) ** 2 for g in gaps) / len(gaps) / 10000)


def choose(sets, wanted):
    """sets: (id, intervals, score) sorted by start."""
    best = None
    for i in range(len(sets)):
        chain = []
        for s in sets[i:]:
            if len(chain) < wanted and not any(close(s[1], t[1]) for t in chain):
                chain.append(s)
        if len(chain) == wanted:
            key = (even(chain), -sum(s[2] for s in chain), -i)
            if best is None or key > best[0]:
                best = (key, chain)
    if best:
        return [s[0] for s in best[1]]
    chain = []
    for s in sorted(sets, key=lambda s: (s[2], s[1][0][0], s[0])):
        if len(chain) < wanted and not any(close(s[1], t[1]) for t in chain):
            chain.append(s)
    return [s[0] for s in chain]


@pytest.mark.parametrize("gap", [5, 90])
def test_selection_follows_the_loop(spark, gap):
    """Sets apart from each other, and sets that lie in each other's gaps."""
    rng, rows, want = random.Random(gap), [], {}
    for gene in range(40):
        sets = []
        for i in range(rng.randint(1, 14)):
            a = rng.randint(0, 500)
            b = a + rng.randint(15, 20)
            c = b + rng.randint(0, gap if gene % 2 else 5)
            sets.append((i + 1, [(a, b), (c, c + rng.randint(15, 20))], float(rng.randint(0, 9))))
        sets.sort(key=lambda s: (s[1][0][0], s[0]))
        want[gene] = sorted(choose(sets, 4))
        rows += [(gene, i, s, iv) for i, iv, s in sets]
    frame = spark.createDataFrame(rows, "gene_id long, set_id int, score double, intervals array<struct<start:int,end:int>>")
    got = {g: [] for g in want}
    for r in selection.select_sets(frame, wanted=4).filter("keep").collect():
        got[r.gene_id].append(r.set_id)
    assert {g: sorted(v) for g, v in got.items()} == want


def test_drop_after_invalid_alternates(spark):
    rng = random.Random(1)
    flags = [rng.random() < 0.5 for _ in range(300)]
    want, dropped = [], False
    for i, bad in enumerate(flags):
        dropped = i > 0 and flags[i - 1] and not dropped
        if not dropped:
            want.append(i)
    frame = spark.createDataFrame(list(enumerate(flags)), "ord long, invalid boolean")
    assert sorted(r.ord for r in curation.drop_after_invalid(frame).collect()) == want


def test_independent_set_is_greedy(spark):
    rng = random.Random(2)
    probes = [(f"BP_{i:05d}", "".join(rng.choice("ACGT") for _ in range(8)), i) for i in range(80)]
    other = str.maketrans("ACGT", "TGCA")
    words = lambda s: {x[j : j + 4] for x in (s, s.translate(other)[::-1]) for j in range(len(x) - 3)}
    taken, want = set(words(probes[0][1])), []
    for name, seq, _ in probes:
        if not words(seq) & taken:
            want.append(name)
            taken |= words(seq)
    frame = spark.createDataFrame(probes, "bp_id string, seq string, ord long")
    got = bridge.independent_set(frame, frame.filter(F.col("ord") == 0), k=4)
    assert sorted(r.bp_id for r in got.collect()) == want


def test_formatted_records_keep_the_order_of_first_mention(spark):
    """Of equal ids the last sequence at the first place; of a base id's the longest where the base id is first met."""
    rng = random.Random(15)
    rows = [(f"{rng.choice('ABCDEF')}{rng.choice(['', '.1', '.2', '-3'])} note", "".join(rng.choice("ACGT") for _ in range(rng.randint(3, 9))), i) for i in range(60)]
    last, groups = {}, {}
    for header, seq, _ in rows:
        last[header.split(" ")[0]] = seq
    for name, seq in last.items():
        groups.setdefault(name.split(".")[0].split("-")[0], []).append((name, seq))
    want = [(base, max(v, key=lambda x: len(x[1]))[1]) for base, v in groups.items()]
    kept, stats = curation.format_records(spark.createDataFrame(rows, "header string, seq string, ord long"))
    assert [(r.id, r.seq) for r in kept.orderBy("ord").collect()] == want
    assert stats.first().removed == len(last) - len(groups)
    plain, _ = curation.format_records(spark.createDataFrame(rows, "header string, seq string, ord long"), deduplicate=False)
    assert [(r.id, r.seq) for r in plain.orderBy("ord").collect()] == list(last.items())


def test_names_of_any_length_meet_the_first_id_that_contains_them(spark):
    from seqloom.operators import resolution

    rng = random.Random(16)
    ids = [("".join(rng.choice("AB1.") for _ in range(rng.randint(1, 12))), f"seq{i}", i) for i in range(150)]
    names = sorted({"".join(rng.choice("AB1.") for _ in range(rng.randint(1, 6))) for _ in range(120)} | {"", "A" * 40})
    want = {n: next((i, s) for i, s, _ in ids if n in i) for n in names if any(n in i for i, _, _ in ids)}
    found = resolution.fuzzy(spark.createDataFrame([(n, None) for n in names] + [("B", "known"), (None, None)], "locus string, seq string"), spark.createDataFrame(ids, "id string, seq string, ord long"))
    assert "NestedLoop" not in found._jdf.queryExecution().executedPlan().toString()
    assert {r.locus: (r.ref_id, r.seq) for r in found.collect()} == want and {len(n) for n in want} >= {0, 1, 2, 3}
