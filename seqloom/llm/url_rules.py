"""URL filters as a sort-merge range join (DataFrame functions only).

Canonical key of a host: its labels reversed, each followed by a dot
(``blog.example.org`` -> ``org.example.blog.``), so that a rule's host and its
subdomains are the interval of keys that start with the rule's key.  Such
intervals nest.  Distinct hosts and rule hosts are laid out in key order over
ranges; one sweep carries the stack of rules opened last, and rules whose
interval has ended are popped by the prefix test.  The stack of the host then
decides the url by path.

A range boundary is a deterministic function of the key, and every range starts
with the stack that is open at its boundary, so ranges are swept independently.
A host that holds a third of all urls is one row in the sweep; only the join
back to the urls meets it, as an ordinary (splittable) equi-join.

Edge cases: a null url, or one without ``://``, has empty host and path and no
rule; an empty table gives no rows; repeated rows are judged alike; without
rules the default verdict holds; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import LOWER, UPPER

RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"))
#: Ranges of the sweep are cut at hosts drawn by hash, this many at most.
MAX_CUTS = 256

_URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, _URL, 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, _URL, 2), F.lit(""))


def host_key(host: Column) -> Column:
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.")), "."), F.lit("."))


def rule_table(spark, rules: Sequence[tuple[str, str, str]] = RULES) -> DataFrame:
    quoted = lambda x: "'" + x.replace("\\", "\\\\").replace("'", "\\'") + "'"
    values = ", ".join("(" + ", ".join(map(quoted, r)) + ")" for r in rules)
    return spark.sql(f"SELECT * FROM VALUES {values or '(NULL, NULL, NULL)'} AS t(verdict, host, path)").filter("host is not null").select(*[F.col(c).cast("string").alias(c) for c in ("verdict", "host", "path")])


def _rule_stacks(rules: DataFrame) -> DataFrame:
    """Per rule host: key and the rules of that host and of every host around it."""
    named = rules.select(host_key(F.col("host")).alias("key"), F.struct(F.concat("host", "path").alias("rule"), F.col("path"), F.col("verdict")).alias("entry"))
    own = named.groupBy("key").agg(F.collect_set("entry").alias("own"))
    labels = F.split("key", r"\.")
    around = own.select("key", F.explode(F.transform(F.sequence(F.lit(1), F.size(labels) - 1), lambda n: F.concat(F.array_join(F.slice(labels, 1, n), "."), F.lit(".")))).alias("outer"))
    outer = own.select(F.col("key").alias("outer"), F.col("own"))
    return around.join(outer, "outer").groupBy("key").agg(F.array_sort(F.collect_list(F.struct(F.col("outer").alias("at"), F.col("own").alias("rules")))).alias("stack"))


def active_stacks(hosts: DataFrame, rules: DataFrame) -> DataFrame:
    """The sweep: distinct ``host`` -> ``active`` rules whose interval holds it."""
    keyed = hosts.select("host", host_key(F.col("host")).alias("key"))
    drawn = keyed.orderBy(F.xxhash64("key"), "key").limit(MAX_CUTS)
    cuts = drawn.groupBy().agg(F.array_sort(F.collect_set("key")).alias("cuts"))
    stacks = _rule_stacks(rules)
    events = keyed.select("key", F.lit(1).alias("kind"), "host", F.lit(None).cast(stacks.schema["stack"].dataType).alias("stack")).unionByName(stacks.select("key", F.lit(0).alias("kind"), F.lit(None).cast("string").alias("host"), "stack"))
    placed = events.join(F.broadcast(cuts)).select("key", "kind", "host", "stack", F.size(F.filter("cuts", lambda c: c <= F.col("key"))).alias("range"))
    # each range starts with the stack of the last rule before it: a running maximum over at most MAX_CUTS + 1 rows
    last = placed.filter("kind = 0").groupBy("range").agg(F.max(F.struct("key", "stack")).alias("last"))
    ranges = cuts.select(F.explode(F.sequence(F.lit(0), F.size("cuts"))).alias("range"))
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    opened = ranges.join(last, "range", "left").select("range", F.max("last").over(before).alias("last")).filter("last is not null")
    carried = opened.select(F.lit("").alias("key"), F.lit(0).alias("kind"), F.lit(None).cast("string").alias("host"), F.col("last.stack").alias("stack"), "range")
    sweep = Window.partitionBy("range").orderBy("key", "kind").rowsBetween(Window.unboundedPreceding, 0)
    swept = placed.unionByName(carried).withColumn("stack", F.last("stack", ignorenulls=True).over(sweep)).filter("kind = 1 and stack is not null")
    popped = F.filter("stack", lambda s: F.startswith(F.col("key"), s["at"]))
    return swept.select("host", F.flatten(F.transform(popped, lambda s: s["rules"])).alias("active")).filter(F.size("active") > 0)


def judge(pages: DataFrame, rules: DataFrame, default: str = "allow") -> DataFrame:
    """page_id, host, path, rule, verdict for every row. The longest fitting rule wins."""
    urls = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    active = active_stacks(urls.select("host").distinct(), rules)
    fits = F.filter("active", lambda r: F.startswith(F.col("path"), r["path"]))
    best = F.array_max(F.transform(fits, lambda r: F.struct(F.length(r["rule"]).alias("n"), r["rule"].alias("rule"), r["verdict"].alias("verdict"))))
    return urls.join(active, "host", "left").withColumn("best", best).select("page_id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"))
