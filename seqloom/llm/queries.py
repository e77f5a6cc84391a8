"""The opN queries, each over the whole table it is meant for, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import alignment, chat, decontam, extraction, lines, mixing, neardup, quality, runs, sharding, spans, toxicity, url_rules
from .common import table


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = mixing.assign(table(spark, sf_dir, "documents"))
    first = F.get("positions", F.lit(0)).alias("position")
    out = rows.select("doc_id", "size", "source_size", "target", "taken", "n_copies", first)
    return out.repartitionByRange(F.col("position").asc_nulls_last(), "doc_id").sortWithinPartitions(F.col("position").asc_nulls_last(), "doc_id")


def op2_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.classes(table(spark, sf_dir, "documents"))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.dedup_lines(table(spark, sf_dir, "documents"), with_text=False)


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_extract_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extraction.extract(table(spark, sf_dir, "pages"))


def op7_shard_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(table(spark, sf_dir, "documents"))


def op8_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_rules.judge(table(spark, sf_dir, "pages"), url_rules.rule_table(spark))


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spans.dedup_spans(table(spark, sf_dir, "documents"), with_text=False)


def op10_format_chats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.format_chats(table(spark, sf_dir, "conversations"))


def op11_align_tokenizers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align(table(spark, sf_dir, "documents"))


def op12_score_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op13_find_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.find_runs(table(spark, sf_dir, "documents"), loops=True).drop("collapsed")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: v for k, v in globals().items() if k.startswith("op") and callable(v)}


_WORDS = r"list_filter(regexp_split_to_array(coalesce(text,''), '[\x20\x09-\x0D]+'), lambda w: w <> '')"
_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_PLAIN = r"list_filter(regexp_split_to_array(" + _LOWER.format("coalesce(text,'')") + r", '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '')"


def _phases(rates: str) -> str:
    """Time at which four phases of rates have spent ``f`` of their whole."""
    out, left = "0.0::double", f"f * ({rates}[1] + {rates}[2] + {rates}[3] + {rates}[4])"
    for k in range(1, 5):
        out = f"({out} + least(greatest({left}, 0.0::double), {rates}[{k}]) / {rates}[{k}])"
        left = f"({left} - {rates}[{k}])"
    return f"{out} / 4"


ORACLES: dict[str, str] = {
    "op1_mix_sources": f"""WITH sized AS (SELECT doc_id, source, len({_WORDS})::bigint size, md5(coalesce(cast(doc_id AS varchar), '-' || md5(coalesce(text, '')))) key FROM documents),
 ranked AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS rank FROM (SELECT source, sum(size)::bigint source_size FROM sized GROUP BY 1)),
 weighed AS (SELECT *, [5,2,1][rank % 3 + 1] weight, [[4.0,3.0,2.0,1.0],[1.0,2.0,3.0,4.0],[1.0,1.0,1.0,1.0]][rank % 3 + 1]::double[] rates FROM ranked),
 ratios AS (SELECT *, (source_size * 3)::double / weight ratio, (sum(source_size) OVER ())::double total FROM weighed),
 levels AS (SELECT *, coalesce(sum(source_size * 3) OVER (ORDER BY ratio, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::double full_before, (sum(weight) OVER (ORDER BY ratio, rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::double weight_from FROM ratios),
 filled AS (SELECT *, ratio * weight_from <= total - full_before AS "full" FROM levels),
 level AS (SELECT (any_value(total) - coalesce(sum(source_size * 3) FILTER ("full"), 0)::double) / nullif(coalesce(sum(weight) FILTER (NOT "full"), 0), 0)::double AS "level" FROM filled),
 targets AS (SELECT source, source_size, rates, CASE WHEN "full" THEN (source_size * 3)::double ELSE (SELECT "level" FROM level) * weight END target FROM filled),
 placed AS (SELECT *, coalesce(sum(size) OVER (PARTITION BY source ORDER BY key, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::bigint AS "at" FROM sized),
 counted AS (SELECT p.doc_id, p.size, t.source_size, t.target, t.rates, p."at", CASE WHEN p.size > 0 THEN least(greatest(ceil((2 * t.target - p.size - 2 * p."at") / (2 * t.source_size)), 0), 3) ELSE 0 END::bigint n_copies FROM placed p JOIN targets t ON p.source IS NOT DISTINCT FROM t.source),
 timed AS (SELECT *, CASE WHEN n_copies > 0 THEN ("at" + size::double / 2) / target END f FROM counted)
 SELECT doc_id, size, source_size, target, n_copies * size AS taken, n_copies, CASE WHEN f IS NOT NULL THEN {_phases('rates')} END AS "position" FROM timed""",
    "op4_line_dedup": rf"""WITH lines AS (SELECT doc_id, i, split[i] line, {_LOWER.format(r"regexp_replace(split[i], '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g')")} AS key FROM (SELECT doc_id, split, unnest(range(1, len(split) + 1)) i FROM (SELECT doc_id, string_split(coalesce(text,''), chr(10)) split FROM documents))),
 common AS (SELECT key, max(doc_id) holder FROM lines WHERE length(key) >= 20 GROUP BY 1 HAVING count(DISTINCT doc_id) >= 3),
 judged AS (SELECT l.*, c.holder IS NOT NULL AND c.holder <> doc_id AS gone FROM lines l LEFT JOIN common c USING (key))
 SELECT doc_id, count(*) n_lines, count(*) FILTER (gone) n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) kept_sha256 FROM judged GROUP BY 1""",
    "op5_decontaminate": f"""WITH items AS (SELECT cast(item_id AS varchar) item_id, {_PLAIN} ws FROM benchmark), windows AS (SELECT DISTINCT item_id, ws[i : i + least(len(ws), 13) - 1] w FROM (SELECT item_id, ws, unnest(range(1, greatest(len(ws) - 12, 1) + 1)) i FROM items WHERE len(ws) > 0)),
 docs AS (SELECT doc_id, {_PLAIN} ws FROM documents), lens AS (SELECT DISTINCT len(w) n FROM windows),
 places AS (SELECT doc_id, ws, n, unnest(range(1, len(ws) - n + 2)) i FROM docs, lens WHERE len(ws) >= n),
 found AS (SELECT p.doc_id, p.i, p.n, w.item_id FROM places p JOIN windows w ON w.w = p.ws[p.i : p.i + p.n - 1]),
 hit AS (SELECT doc_id, count(DISTINCT place) n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS place FROM (SELECT DISTINCT doc_id, i, n FROM found)) GROUP BY 1),
 named AS (SELECT doc_id, count(item_id) n_items, string_agg(item_id, ',' ORDER BY item_id) items FROM (SELECT DISTINCT doc_id, item_id FROM found) GROUP BY 1)
 SELECT d.doc_id, len(d.ws)::bigint n_words, coalesce(h.n_hit, 0)::bigint n_hit, coalesce(n.n_items, 0)::bigint n_items, sha256(coalesce(n.items, '')) items_sha256, coalesce(h.n_hit, 0) > 0 AND 20 * coalesce(h.n_hit, 0) >= len(d.ws) AS contaminated FROM docs d LEFT JOIN hit h USING (doc_id) LEFT JOIN named n USING (doc_id)""",
    # for pages that mark their article as such, as those of the test tables do
    "op6_extract_html": r"""WITH plain AS (SELECT page_id, url, regexp_replace(regexp_replace(regexp_extract(coalesce(html, ''), '(?s)<article>(.*?)(</article>|$)', 1), '</?b>', '', 'g'), '<[^>]*>', ' ', 'g') body FROM pages),
 decoded AS (SELECT page_id, url, trim(regexp_replace(regexp_replace(replace(replace(replace(replace(body, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', chr(39)), '&amp;?', '&', 'g'), '\s+', ' ', 'g')) "text" FROM plain)
 SELECT page_id, url, "text", length("text") n_chars FROM decoded""",
    "op8_url_filters": rf"""WITH urls AS (SELECT page_id, {_LOWER.format(r"coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), '')")} host, coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') path FROM pages),
 rules(verdict, host, path) AS (VALUES {', '.join(str(r) for r in url_rules.RULES)}),
 fits AS (SELECT u.page_id, r.host || r.path AS rule, r.verdict, row_number() OVER (PARTITION BY u.page_id ORDER BY length(r.host || r.path) DESC, r.host || r.path DESC, r.verdict DESC) k FROM urls u JOIN rules r ON (u.host = r.host OR ends_with(u.host, '.' || r.host)) AND starts_with(u.path, r.path))
 SELECT u.page_id, u.host, u.path, f.rule, coalesce(f.verdict, 'allow') verdict FROM urls u LEFT JOIN fits f ON f.page_id = u.page_id AND f.k = 1""",
    # for tables without tool traffic, as the test tables are
    "op10_format_chats": """SELECT conv_id, turn, 0 AS seq, 'message' AS kind, 'plain' AS status, CAST(NULL AS varchar) AS fault, turn AS "at", 0 AS "level", '{"content":' || coalesce(to_json(text)::varchar, 'null') || ',"role":' || to_json(coalesce(role, ''))::varchar || '}' AS message FROM conversations""",
    "op9_substring_dedup": f"""WITH docs AS (SELECT doc_id, {_WORDS} ws FROM documents), windows AS (SELECT doc_id, i, hash(ws[i : i + 12]) || md5(array_to_string(ws[i : i + 12], ' ')) w FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 11)) i FROM docs WHERE len(ws) >= 13)),
 firsts AS (SELECT w, min(doc_id) holder FROM windows GROUP BY 1), hits AS (SELECT doc_id, i FROM windows JOIN firsts USING (w) WHERE holder < doc_id),
 gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) i FROM hits), placed AS (SELECT doc_id, i, ws[i] word FROM (SELECT doc_id, ws, unnest(range(1, len(ws) + 1)) i FROM docs)),
 kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY i) text FROM placed ANTI JOIN gone USING (doc_id, i) GROUP BY 1), removed AS (SELECT doc_id, count(*) n FROM gone GROUP BY 1)
 SELECT d.doc_id, len(d.ws)::bigint n_words, coalesce(r.n, 0)::bigint n_removed, sha256(coalesce(k.text, '')) kept_sha256 FROM docs d LEFT JOIN removed r USING (doc_id) LEFT JOIN kept k USING (doc_id)""",
}
