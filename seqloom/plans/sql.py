"""DuckDB fragments that the reference queries share. They restate the semantics on their own terms
(lists, regular expressions, folds) rather than the way the Spark plans compute them."""

from __future__ import annotations

from ..functions.thermo import GAS, NN3, NN4, SALT, STRANDS, Table, _partner

_HEX = "'0123456789abcdef','ACGTACGTACGTACGT'"


def dna(text: str) -> str:
    return f"translate(md5({text}),{_HEX})"


def rc(s: str) -> str:
    return f"reverse(translate({s},'ACGT','TGCA'))"


def kmers(s: str, k: int) -> str:
    return f"list_transform(range(1, length({s}) - {k} + 2), lambda i: substr({s}, i, {k}))"


def gc(s: str, scale: str = "100.0") -> str:
    return f"(length(regexp_replace({s},'[^GC]','','g')) * {scale}::double / length({s}))"


def tm(s: str, table: Table = NN4) -> str:
    def total(which: int) -> str:
        pairs = {p: v[which] for p, v in table.pairs.items()}
        pairs |= {_partner(p): v for p, v in pairs.items()}
        mapped = "MAP {" + ", ".join(f"'{p}': {v}" for p, v in sorted(pairs.items())) + "}"
        end = lambda c: f"CASE WHEN {c} IN ('A','T') THEN {table.end_at[which]} ELSE {table.end_gc[which]} END"
        first, last = f"substr({s},1,1)", f"substr({s},length({s}),1)"
        return f"({table.start[which]} + ({end(first)}) + ({end(last)}) + list_sum(list_transform(range(1, length({s})), lambda i: {mapped}[substr({s}, i, 2)])))"

    entropy = f"({total(1)} / 10.0::double + 0.368::double * (length({s}) - 1) * ln({SALT}::double))"
    return f"(1000.0::double * ({total(0)} / 10.0::double) / ({entropy} + {GAS}::double * ln({STRANDS!r}::double)) - 273.15::double)"


def runs(n: int) -> str:
    return "|".join(f"{b}{{{n}}}" for b in "ATGC")


def poly_ok(s: str, n: int) -> str:
    return f"NOT regexp_matches({s}, '{runs(n)}')"


def comp_local(a: str, b: str, m: int) -> str:
    return f"list_has_any({kmers(a, m)}, {kmers(rc(b), m)})"


def dimer(seqs: list[str], m: int) -> str:
    halves = [f"(length({s}) >= {2 * m} AND {comp_local(f'substr({s},1,length({s})//2)', f'substr({s},length({s})//2+1)', m)})" for s in seqs]
    pairs = [comp_local(a, b, m) for i, a in enumerate(seqs) for b in seqs[i + 1 :]]
    return "(" + " OR ".join(halves + pairs) + ")"


GENES = f"genes AS (SELECT s_suppkey gene_id, array_to_string(list_transform(range(0,20), lambda i: {dna("concat(cast(s_suppkey AS varchar),'-',cast(i AS varchar))")}),'') seq FROM supplier)"
BRIDGE = f"bridge AS (SELECT 'BP_' || lpad(cast(p_partkey AS varchar),5,'0') bp_id, substr({dna('cast(p_partkey AS varchar)')},1,19) seq, p_partkey ord FROM part)"
ISOFORMS = f"isoforms AS (SELECT 'G' || c_nationkey || '.' || c_custkey id, substr({dna('cast(c_custkey AS varchar)')},1,cast(10 + c_custkey % 20 AS int)) seq, c_custkey ord FROM customer)"
COUNTS = "counts AS (SELECT user_id % (SELECT count(*) + count(*) // 10 FROM supplier) gene_id, cast(sum(cast(round(value,2) AS decimal(18,2))) AS double) AS count FROM events GROUP BY 1)"
_FLIP = "array_to_string(list_transform(range(1, length(seq) + 1), lambda i: CASE WHEN (i + gene_id) % 13 = 0 THEN translate(substr(seq,i,1),'ACGT','TGCA') ELSE substr(seq,i,1) END),'')"
SUBJECTS = f"forward AS (SELECT gene_id subject_id, '+' strand, {_FLIP} seq FROM genes), subjects AS (SELECT * FROM forward UNION ALL SELECT subject_id, '-', {rc('seq')} FROM forward)"
_GAPS = "array_to_string(list_transform(range(1, length(seq) + 1), lambda i: CASE WHEN (i + gene_id) % 41 = 0 THEN '' WHEN (i + gene_id) % 43 = 0 THEN substr(seq,i,1) || 'T' ELSE substr(seq,i,1) END),'')"
GAPPED_SUBJECTS = f"forward AS (SELECT gene_id subject_id, '+' strand, {_GAPS} seq FROM genes), subjects AS (SELECT * FROM forward UNION ALL SELECT subject_id, '-', {rc('seq')} FROM forward)"
_PIECE = f"substr({dna('cast(c_custkey AS varchar)')},1,cast(8 + c_custkey % 24 AS int))"
RECORDS = f"""records AS (SELECT 'G' || c_nationkey || CASE WHEN c_custkey % 2 = 0 THEN '.' ELSE '-' END || (c_custkey % 5) || ' from customer ' || c_custkey AS header,
 CASE WHEN c_custkey % 11 = 0 THEN {_PIECE} || '#?' WHEN c_custkey % 7 = 0 THEN translate({_PIECE},'ACGT','MKLV') WHEN c_custkey % 5 = 0 THEN lower({_PIECE})
 WHEN c_custkey % 13 = 0 THEN {_PIECE} || 'NNNN' WHEN c_custkey % 17 = 0 THEN '' ELSE {_PIECE} END AS seq, c_custkey ord FROM customer)"""
_KIND = "CASE WHEN length(u) = 0 THEN 'AA' WHEN regexp_matches(u, '[DEFHIKLMPQRSVWY]') THEN 'AA' WHEN length(regexp_replace(u,'[^ATCGU]','','g'))::double / length(u) >= 0.70 THEN 'NT' ELSE 'AA' END"
_BAD = "array_to_string(list_sort(list_distinct(string_split(CASE WHEN kind = 'NT' THEN regexp_replace(u,'[ATCGURYSWKMBDHVN]','','g') ELSE regexp_replace(u,'[ACDEFGHIKLMNPQRSTVWYXZ*]','','g') END, ''))),'')"
CHECKED = f"typed AS (SELECT split_part(header,' ',1) id, upper(seq) seq, upper(seq) u, ord, {_KIND} AS kind FROM (SELECT *, upper(seq) u FROM records)), checked AS (SELECT id, seq, ord, kind, {_BAD} AS bad FROM typed)"
BASE_ID = r"regexp_replace(id,'^(.+?)[.-][0-9]+$','\1')"
LIBRARIES = """named AS (SELECT 'L' || gene_id id, seq, gene_id ord FROM genes),
 coding AS (SELECT id, substr(seq,1,120) seq, ord FROM named WHERE ord % 2 = 0), transcript AS (SELECT id, substr(seq,1,240) seq, ord FROM named WHERE ord % 5 <> 1),
 ref AS (SELECT id || '.' || (ord % 3 + 1) id, seq, ord FROM named), alias AS (SELECT 'SYM' || gene_id symbol, 'L' || gene_id locus FROM genes WHERE gene_id % 3 = 0)"""
BATCH = """batch AS (SELECT 'T' || o_orderkey task, 'BP_' || lpad(cast(o_orderkey % 2500 AS varchar),5,'0') bp_id,
 CASE WHEN o_orderkey % 4 = 0 THEN 'SYM' WHEN o_orderkey % 9 = 0 THEN 'l' ELSE 'L' END || (o_orderkey % (SELECT count(*) + 3 FROM supplier)) gene_id,
 CASE WHEN o_orderkey % 3 = 0 THEN cast(o_orderkey % 7 + 1 AS varchar) WHEN o_orderkey % 3 = 1 THEN 'many' END max_selected FROM orders)"""
RESOLVED = """located AS (SELECT b.*, coalesce(a.locus, upper(b.gene_id)) locus FROM batch b LEFT JOIN alias a ON upper(b.gene_id) = a.symbol),
 exact AS (SELECT l.*, coalesce(c.seq,t.seq,r.seq) seq, CASE WHEN c.seq IS NOT NULL THEN 1 WHEN t.seq IS NOT NULL THEN 2 WHEN r.seq IS NOT NULL THEN 3 END source
 FROM located l LEFT JOIN coding c ON c.id = l.locus LEFT JOIN transcript t ON t.id = l.locus LEFT JOIN ref r ON r.id = l.locus),
 loose AS (SELECT e.locus, arg_min(r.id, r.ord) ref_id, arg_min(r.seq, r.ord) seq FROM (SELECT DISTINCT locus FROM exact WHERE seq IS NULL) e JOIN ref r ON contains(r.id, e.locus) GROUP BY 1),
 resolved AS (SELECT e.task, e.bp_id, e.gene_id, e.max_selected, e.locus, coalesce(e.seq, x.seq) seq, coalesce(e.source, CASE WHEN x.seq IS NOT NULL THEN 4 END) source FROM exact e LEFT JOIN loose x USING (locus))"""


def strand_kmers(table: str, k: int = 9) -> str:
    return f"{table}_kmers AS (SELECT DISTINCT bp_id, unnest(list_concat({kmers('seq', k)}, {kmers(rc('seq'), k)})) kmer FROM {table})"


def conflicts(k: int = 9) -> str:
    return strand_kmers("bridge", k) + ", conflicts AS (SELECT a.bp_id, b.bp_id other, count(*) n_shared, array_to_string(list_sort(list(a.kmer))[1:3],',') examples FROM bridge_kmers a JOIN bridge_kmers b ON a.kmer = b.kmer AND a.bp_id <> b.bp_id GROUP BY 1, 2)"


def candidates(config) -> str:
    """CTEs repeats, candidates and firsts for a configuration."""
    k = config.kmer_size
    return f"""gene_kmers AS (SELECT gene_id, i - 1 AS pos, substr(seq, i, {k}) kmer FROM (SELECT gene_id, seq, unnest(range(1, length(seq) - {k} + 2)) i FROM genes)),
 often AS (SELECT gene_id, kmer FROM gene_kmers GROUP BY 1, 2 HAVING count(*) >= {config.min_kmer_count}),
 repeats AS (SELECT gene_id, kmer FROM often UNION SELECT gene_id, {rc('kmer')} FROM often),
 repeated_at AS (SELECT gene_id, list(pos) places FROM gene_kmers SEMI JOIN repeats USING (gene_id, kmer) GROUP BY 1),
 windows AS (SELECT gene_id, start, len, substr(seq, start + 1, len) w FROM (SELECT gene_id, seq, start, unnest(range({config.min_length}, {config.max_length} + 1)) len FROM (SELECT gene_id, seq, unnest(range(0, length(seq) - {config.min_length} + 1)) start FROM genes)) WHERE start + len <= length(seq)),
 cheap AS (SELECT * FROM windows WHERE {gc('w')} BETWEEN {config.gc_min} AND {config.gc_max} AND {poly_ok('w', config.poly_n)}),
 warm AS (SELECT *, {tm('w', config.table)} tm FROM cheap),
 candidates AS (SELECT w.gene_id, w.start, w.len, w.w, w.tm FROM warm w LEFT JOIN repeated_at r USING (gene_id) WHERE w.tm BETWEEN {config.tm_min} AND {config.tm_max} AND len(list_filter(coalesce(r.places, []), lambda p: p >= w.start AND p + {k} <= w.start + w.len)) = 0),
 firsts AS (SELECT gene_id, start, start + min(len) AS "end" FROM candidates GROUP BY 1, 2)"""


def feasible(config) -> str:
    probe = lambda a, b: rc(f"substr(g.seq, CAST({a} + 1 AS int), CAST({b} - {a} AS int))")
    triple = config.arity == 3
    inner = 'm."end"' if triple else 'l."end"'
    seqs = [("left_seq", probe("l.start", 'l."end"'))] + ([("middle_seq", probe("m.start", 'm."end"'))] if triple else []) + [("right_seq", probe("r.start", 'r."end"'))]
    return f"""{candidates(config)}, chained AS (SELECT l.gene_id, length(g.seq) n, l.start, l."end" left_end, {'m."end" middle_end,' if triple else ''} r.start right_start, r."end" right_end, {', '.join(f'{c} {k}' for k, c in seqs)}
 FROM firsts l {'JOIN firsts m ON m.gene_id = l.gene_id AND m.start = l."end"' if triple else ''} JOIN firsts r ON r.gene_id = l.gene_id AND r.start = {inner} + {config.inner_gap} JOIN genes g ON g.gene_id = l.gene_id WHERE r.start < length(g.seq) - {config.min_length}),
 feasible AS (SELECT * FROM chained WHERE NOT {dimer([k for k, _ in seqs], config.min_complementary_length)})"""


def designed(config) -> str:
    """A literal walk: the next start by recursion."""
    bound = f"f.n - 3 * {config.min_length}"
    return f"""{feasible(config)}, walk AS (SELECT gene_id, 0::bigint AS i, 0::bigint AS after, -1::bigint AS prev, -1::bigint AS start FROM (SELECT DISTINCT gene_id FROM feasible)
 UNION ALL SELECT gene_id, i + 1, right_end, left_end, start FROM (SELECT w.gene_id, w.i, f.right_end, f.left_end, f.start, row_number() OVER (PARTITION BY w.gene_id ORDER BY f.start) r
 FROM walk w JOIN feasible f ON f.gene_id = w.gene_id AND f.start >= w.after AND (f.start < {bound} OR (f.start = w.after AND w.i > 0 AND w.prev < {bound}))) WHERE r = 1),
 designed AS (SELECT f.*, w.i set_id FROM walk w JOIN feasible f ON f.gene_id = w.gene_id AND f.start = w.start WHERE w.i > 0)"""


def designed_nested(config) -> str:
    """CTE designed: a literal walk over the positions of each gene with the list of bases in use, for gaps that hold sets."""
    triple, gap, low, reach = config.arity == 3, config.inner_gap, config.min_length, config.max_length
    free = lambda p: f"list_reduce(list_prepend({p}, used), lambda p, u: CASE WHEN u // 1000000 < p + {reach} AND p < u % 1000000 THEN u % 1000000 ELSE p END)"
    inner = 'm."end"' if triple else 'l."end"'
    probe = lambda t: rc(f"{t}.w")
    together = dimer([probe("l"), *([probe("m")] if triple else []), probe("r")], config.min_complementary_length)
    middle = f"""LEFT JOIN named m ON m.gene_id = k.gene_id AND m.start = l."end" AND {free('l."end"')} = l."end" AND NOT {dimer([probe("l"), probe("m")], config.min_complementary_length)}""" if triple else ""
    return f"""{candidates(config)}, named AS (SELECT f.*, substr(g.seq, CAST(f.start + 1 AS int), CAST(f."end" - f.start AS int)) w FROM firsts f JOIN genes g USING (gene_id)),
 walk AS (SELECT gene_id, length(seq)::bigint n, 0::bigint AS pos, []::bigint[] AS used, 0::bigint AS number, -1::bigint AS start, -1::bigint AS left_end, -1::bigint AS middle_end, -1::bigint AS right_start, -1::bigint AS right_end FROM genes
 UNION ALL SELECT gene_id, n, CASE WHEN ok THEN left_end ELSE pos + 1 END, CASE WHEN ok THEN list_sort(list_filter(list_concat(used, [start * 1000000 + middle_end, right_start * 1000000 + right_end]), lambda u: u % 1000000 > left_end)) ELSE used END,
  number + CASE WHEN ok THEN 1 ELSE 0 END, CASE WHEN ok THEN start ELSE -1 END, left_end, middle_end, right_start, right_end
  FROM (SELECT k.gene_id, k.n, k.pos, k.used, k.number, l.start, l."end" left_end, {inner} middle_end, r.start right_start, r."end" right_end, coalesce(r.start IS NOT NULL AND NOT {together}, false) ok
   FROM walk k LEFT JOIN named l ON l.gene_id = k.gene_id AND l.start = {free('k.pos')} {middle}
   LEFT JOIN named r ON r.gene_id = k.gene_id AND {inner} + {gap} < k.n - {low} AND r.start = {free(f'{inner} + {gap}')} WHERE k.pos < k.n - 3 * {low})),
 designed AS (SELECT w.gene_id, w.number set_id, w.start, w.left_end, {'w.middle_end,' if triple else ''} w.right_start, w.right_end, {probe('l')} left_seq, {probe('r')} right_seq FROM walk w JOIN named l ON l.gene_id = w.gene_id AND l.start = w.start JOIN named r ON r.gene_id = w.gene_id AND r.start = w.right_start WHERE w.start >= 0)"""


def hits(probes: str) -> str:
    """CTE hits for a CTE ``probes`` (probe_seq)."""
    return f"""seeds AS (SELECT probe_seq, i - 1 AS p, substr(probe_seq, i, 10) k FROM (SELECT DISTINCT probe_seq, unnest(range(1, length(probe_seq) - 8)) i FROM {probes})),
 places AS (SELECT subject_id, strand, i - 1 AS p, substr(seq, i, 10) k FROM (SELECT subject_id, strand, seq, unnest(range(1, length(seq) - 8)) i FROM subjects)),
 diagonals AS (SELECT DISTINCT probe_seq, subject_id, strand, places.p - seeds.p AS start FROM seeds JOIN places USING (k) WHERE places.p >= seeds.p),
 aligned AS (SELECT d.*, substr(s.seq, CAST(d.start + 1 AS int), length(d.probe_seq)) w FROM diagonals d JOIN subjects s USING (subject_id, strand)),
 hits AS (SELECT probe_seq, subject_id, strand, start, hamming(probe_seq, w) mm FROM aligned WHERE length(w) = length(probe_seq) AND hamming(probe_seq, w) <= floor(length(probe_seq) * 0.2::double + 1e-9))"""


def local_hits(probes: str, band: int) -> str:
    """CTE aligned: of every seeded diagonal the best of all ungapped stretches, and of all pairs of them around one gap, in
    the band.  Probes of 20 bases have no better alignment with two gaps: each of three stretches would need 7 matches."""
    cand, order = "probe_seq, subject_id, strand, d", "score DESC, gapopen, gaps, mm, q_start, j_start, q_end, j_end"
    return f"""seeds AS (SELECT probe_seq, i - 1 AS p, substr(probe_seq, i, 10) k FROM (SELECT DISTINCT probe_seq, unnest(range(1, length(probe_seq) - 8)) i FROM {probes})),
 places AS (SELECT subject_id, strand, i - 1 AS p, substr(seq, i, 10) k FROM (SELECT subject_id, strand, seq, unnest(range(1, length(seq) - 8)) i FROM subjects)),
 diagonals AS (SELECT DISTINCT probe_seq, subject_id, strand, places.p - seeds.p AS d FROM seeds JOIN places USING (k)),
 cells AS (SELECT {cand}, j, i, CASE WHEN substr(probe_seq, CAST(i + 1 AS int), 1) = substr(seq, CAST(d + j + i + 1 AS int), 1) THEN 1 ELSE 0 END AS same
  FROM (SELECT d.*, s.seq, unnest(range({-band}, {band + 1})) j FROM diagonals d JOIN subjects s USING (subject_id, strand)), range(0, 20) r(i) WHERE d + j + i >= 0 AND d + j + i < length(seq)),
 sums AS (SELECT *, CAST(sum(same) OVER w AS bigint) n_same, count(*) OVER w AS n FROM cells WINDOW w AS (PARTITION BY {cand}, j ORDER BY i)),
 stretches AS (SELECT probe_seq, subject_id, strand, d, j, a.i q_start, b.i + 1 AS q_end, b.n_same - a.n_same + a.same AS matches, (b.n - a.n + 1) - (b.n_same - a.n_same + a.same) AS mm FROM sums a JOIN sums b USING (probe_seq, subject_id, strand, d, j) WHERE b.i >= a.i),
 scored AS (SELECT *, matches - 3 * mm AS score FROM stretches),
 ahead AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {cand}, j, q_end ORDER BY score DESC, mm, q_start) r FROM scored) WHERE r = 1),
 behind AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {cand}, j, q_start ORDER BY score DESC, mm, q_end) r FROM scored) WHERE r = 1),
 tried AS (SELECT {cand}, score, 0 AS gapopen, 0 AS gaps, matches, mm, q_start, j AS j_start, q_end, j AS j_end FROM ahead UNION ALL
  SELECT a.probe_seq, a.subject_id, a.strand, a.d, a.score + b.score - 5 - 2 * abs(b.j - a.j), 1, abs(b.j - a.j), a.matches + b.matches, a.mm + b.mm, a.q_start, a.j, b.q_end, b.j
  FROM ahead a JOIN behind b ON a.probe_seq = b.probe_seq AND a.subject_id = b.subject_id AND a.strand = b.strand AND a.d = b.d AND a.j <> b.j AND b.q_start = a.q_end + greatest(a.j - b.j, 0)),
 aligned AS (SELECT DISTINCT probe_seq, subject_id, strand, q_start, q_end, d + j_start + q_start AS start, d + j_end + q_end AS "end", score, matches + mm + gaps AS columns, matches, mm, gapopen, gaps
  FROM (SELECT *, row_number() OVER (PARTITION BY {cand} ORDER BY {order}) r FROM tried) WHERE r = 1 AND score >= 10)"""


def evidence() -> str:
    return "per AS (SELECT probe_seq, count(*) n_hits, min(mm) min_mm, count(*) FILTER (mm = 0) exact_n, count(*) FILTER (mm = 1) one_n FROM hits GROUP BY 1)"


def arms(size: int, arm: int, gc_low: float, gc_high: float, tm_low: float, tm_high: float, poly: int) -> str:
    """CTE arms: disjoint windows whose two arms pass, numbered per gene."""
    ok = lambda s: f"{gc(s)} BETWEEN {gc_low} AND {gc_high} AND {poly_ok(s, poly)} AND {tm(s, NN3)} BETWEEN {tm_low} AND {tm_high}"
    return f"""spans AS (SELECT gene_id, start, substr(seq, CAST(start + 1 AS int), {size}) w FROM (SELECT gene_id, seq, unnest(range(0, length(seq) - {size} + 1)) start FROM genes)),
 good AS (SELECT gene_id, start FROM spans WHERE {ok(f'substr(w,1,{arm})')} AND {ok(f'substr(w,{size - arm + 1},{arm})')}),
 walk AS (SELECT gene_id, 0::bigint AS number, -1::bigint AS last, -1::bigint AS start FROM (SELECT DISTINCT gene_id FROM good)
 UNION ALL SELECT gene_id, number + 1, start + {size}, start FROM (SELECT w.gene_id, w.number, g.start, row_number() OVER (PARTITION BY w.gene_id ORDER BY g.start) r FROM walk w JOIN good g ON g.gene_id = w.gene_id AND g.start > w.last) WHERE r = 1),
 arms AS (SELECT k.gene_id, k.number, k.start, s.w FROM walk k JOIN spans s ON s.gene_id = k.gene_id AND s.start = k.start WHERE k.number > 0)"""


def selected(score: str, too_close: str, wanted: int | str = 5) -> str:
    """CTE kept: the selection among ``ranked`` sets, as walks over places; ``too_close`` compares the sets a and b,
    and ``wanted`` may be a column of the sets x."""
    from ..operators.selection import DROPPED, KEPT

    grow = f"CASE WHEN len(c.taken) < {wanted} AND NOT list_has_any(x.near, c.taken) THEN list_append(c.taken, x.p) ELSE c.taken END"
    return f"""placed AS (SELECT *, CAST({score} AS double) score, row_number() OVER (PARTITION BY gene_id ORDER BY start, set_id) p FROM ranked),
 pairs AS (SELECT a.gene_id, a.p, b.p other FROM placed a JOIN placed b ON a.gene_id = b.gene_id AND a.p <> b.p WHERE {too_close}),
 sets AS (SELECT s.*, coalesce(n.near, []) near, row_number() OVER (PARTITION BY s.gene_id ORDER BY s.score, s.start, s.set_id) place, count(*) OVER (PARTITION BY s.gene_id) n_sets FROM placed s LEFT JOIN (SELECT gene_id, p, list(other) near FROM pairs GROUP BY 1, 2) n USING (gene_id, p)),
 chains AS (SELECT gene_id, p first, p AS "at", [p] taken FROM sets UNION ALL SELECT c.gene_id, c.first, x.p, {grow} FROM chains c JOIN sets x ON x.gene_id = c.gene_id AND x.p = c."at" + 1),
 whole AS (SELECT c.* FROM chains c JOIN (SELECT DISTINCT gene_id, n_sets FROM sets) s ON s.gene_id = c.gene_id AND c."at" = s.n_sets JOIN sets x ON x.gene_id = c.gene_id AND x.p = c.first WHERE len(taken) = {wanted}),
 links AS (SELECT w.gene_id, w.first, s.p, s.score, s.start, s.right_end, s.start - lag(s.right_end) OVER (PARTITION BY w.gene_id, w.first ORDER BY s.p) gap FROM (SELECT gene_id, first, unnest(taken) p FROM whole) w JOIN sets s USING (gene_id, p)),
 ideals AS (SELECT gene_id, first, (max(right_end) - min(start))::double / (count(*) - 1) ideal, sum(score) score FROM links GROUP BY 1, 2),
 evens AS (SELECT gene_id, first, any_value(i.score) score, 1.0::double / (1.0::double + list_sum(list((gap - ideal) * (gap - ideal) ORDER BY p) FILTER (gap IS NOT NULL)) / (count(*) - 1) / 10000.0::double) even FROM links JOIN ideals i USING (gene_id, first) GROUP BY 1, 2),
 best AS (SELECT gene_id, arg_min(first, r) first FROM (SELECT gene_id, first, row_number() OVER (PARTITION BY gene_id ORDER BY even DESC, score, first) r FROM evens) GROUP BY 1),
 greedy AS (SELECT gene_id, place, [p] taken FROM sets WHERE place = 1 UNION ALL SELECT c.gene_id, x.place, {grow} FROM greedy c JOIN sets x ON x.gene_id = c.gene_id AND x.place = c.place + 1),
 chosen AS (SELECT g.gene_id, coalesce(w.taken, g.taken) taken FROM greedy g JOIN sets s ON s.gene_id = g.gene_id AND s.place = g.place AND s.place = s.n_sets LEFT JOIN best b ON b.gene_id = g.gene_id LEFT JOIN whole w ON w.gene_id = b.gene_id AND w.first = b.first),
 judged AS (SELECT s.gene_id, s.set_id, list_contains(c.taken, s.p) keep, list_filter(c.taken, lambda t: list_contains(s.near, t))[1] blocker FROM sets s JOIN chosen c USING (gene_id)),
 kept AS (SELECT j.gene_id, j.set_id, j.keep, CASE WHEN j.keep THEN '{KEPT}' WHEN b.set_id IS NOT NULL THEN printf('Too close to selected set %d.', b.set_id) ELSE '{DROPPED}' END reason FROM judged j LEFT JOIN sets b ON b.gene_id = j.gene_id AND b.p = j.blocker)"""
