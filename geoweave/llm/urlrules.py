"""URL filters: sort-merge range join of reversed-host keys with nested rules.

A host with its labels reversed (`com.example.www.`) turns "this host and all its
subdomains" into one interval of keys. The intervals of the rules' hosts are nested
or apart, so a sweep in key order keeps a stack of the hosts that are open: each
interval edge carries the stack that holds from there on, and every page takes the
last stack before it, which has no more entries than its host has labels. A second
sweep of the same kind finds each open host's longest path rule: a path prefix is an
interval of paths, and its edges carry the innermost rule that is open. So a page
never meets the rules of its host one by one, however many there are. Of the rules
found for a page the longest wins.

Sweeps are running windows for each group of sites and for each rule host. Groups
with over a thousandth of all pages are dealt to parts by a hash, and only those
groups' edges are repeated, once for each part; edges of hosts of one label, a few
for each top-level domain, go to every group of sites.

Defined results: a null url or one without `://` has empty host and path, no rule
and the default verdict. Repeated pages give repeated rows. With no rules every
page has the default verdict. Rules without host or path are ignored; of equal
rules the first by verdict stays; of rules of equal length the last by name wins.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from geoweave.operators import skew
from geoweave.scratch import materialize

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

# Host, path and verdict of the production rules.
RULES = (
    ("com", "/en/", "block"),
    ("example.com", "/en/7", "allow"),
    ("net", "/de/", "allow"),
    ("example.net", "/de/8", "block"),
    ("org", "/es/", "block"),
)
DEFAULT_VERDICT = "allow"
#: Groups of sites (the last two labels of a host) that are swept by themselves.
SITES = 4096


def rules_table(spark: SparkSession, rules=RULES) -> DataFrame:
    return spark.range(1).select(F.inline(F.array(*[F.struct(F.lit(h).alias("host"), F.lit(p).alias("path"), F.lit(v).alias("verdict")) for h, p, v in rules]))) if rules else spark.sql("SELECT '' host, '' path, '' verdict WHERE false")


def host_and_path(url: str = "url") -> tuple:
    rest = F.expr(f"CASE WHEN instr(`{url}`, '://') > 0 THEN substring(`{url}`, instr(`{url}`, '://') + 3) ELSE '' END")
    return F.translate(F.regexp_extract(rest, "^([^/?#]*)", 1), UPPER, LOWER), F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def reversed_key(host: str = "host", end: str = "."):
    return F.concat(F.array_join(F.reverse(F.split(host, "\\.")), "."), F.lit(end))


def site(host: str = "host"):
    return F.pmod(F.xxhash64(F.substring_index(host, ".", -2)), F.lit(SITES)).cast("int")


def host_edges(rules: DataFrame) -> DataFrame:
    """(site, key, kind, open): the rule hosts that are open from each edge of a host's interval on."""
    hosts = rules.select("host").distinct()
    labels = F.split("host", "\\.")
    above = hosts.select("host", F.explode(F.transform(F.sequence(F.lit(1), F.size(labels)), lambda k: F.array_join(F.slice(labels, k, F.size(labels)), "."))).alias("upper"))
    stacks = above.join(hosts.select(F.col("host").alias("upper")), "upper").groupBy("host").agg(F.collect_set("upper").alias("inside"))
    opens = F.struct(reversed_key().alias("key"), F.lit(1).alias("kind"), F.col("inside").alias("open"))
    # "/" comes right after "."
    closes = F.struct(reversed_key(end="/").alias("key"), F.lit(0).alias("kind"), F.array_remove("inside", F.col("host")).alias("open"))
    sites = F.when(F.size(labels) == 1, F.sequence(F.lit(0), F.lit(SITES - 1))).otherwise(F.array(site()))
    return stacks.select(F.explode(sites).alias("site"), F.array(opens, closes).alias("edges")).select("site", F.inline("edges"))


def path_edges(rules: DataFrame) -> DataFrame:
    """(upper, key, kind, open): the longest rule of a host that is open from each edge of a path's interval on."""
    rule = F.struct(F.length(F.concat("host", "path")).alias("size"), F.concat("host", "path").alias("rule"), "verdict")
    own = rules.select("host", "path", rule.alias("own"))
    shorter = own.select("host", "path", F.explode(F.transform(F.sequence(F.lit(0), F.length("path") - 1), lambda k: F.substring("path", F.lit(1), k))).alias("prefix"))
    around = shorter.join(own.select("host", F.col("path").alias("prefix"), F.col("own").alias("upper")), ["host", "prefix"]).groupBy("host", "path").agg(F.max("upper").alias("around"))
    nothing = F.expr("named_struct('size', cast(null as int), 'rule', cast(null as string), 'verdict', cast(null as string))")
    key = F.col("path").cast("binary")
    opens = F.struct(key.alias("key"), F.lit(1).alias("kind"), F.col("own").alias("open"))
    # no text has a byte 255, so this comes after every path with the prefix
    closes = F.struct(F.concat(key, F.expr("X'FF'")).alias("key"), F.lit(0).alias("kind"), F.coalesce("around", nothing).alias("open"))
    return own.join(around, ["host", "path"], "left").select(F.col("host").alias("upper"), F.inline(F.array(opens, closes)))


def sweep(rows: DataFrame, edges: DataFrame, group: str, by: list[str]) -> DataFrame:
    """``rows`` with `open` of the last of the group's ``edges`` before their key; heavy groups are swept in parts."""
    heavy = F.broadcast(skew.heavy_keys(rows, group))
    parts = F.coalesce("parts", F.lit(1))
    dealt = rows.join(heavy, group, "left").withColumn("part", F.pmod(F.xxhash64(*by), parts).cast("int")).drop("parts")
    marks = edges.join(heavy, group, "left").withColumn("part", F.explode(F.sequence(F.lit(0), parts - 1))).drop("parts")
    running = Window.partitionBy(group, "part").orderBy("key", "kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    both = dealt.withColumn("kind", F.lit(2)).unionByName(marks, allowMissingColumns=True)
    return both.withColumn("open", F.last("open", ignorenulls=True).over(running)).filter("kind = 2").drop("kind", "part", "key", group)


def judge(pages: DataFrame, rules: DataFrame | None = None, default: str = DEFAULT_VERDICT) -> DataFrame:
    """page_id, host, path, rule and verdict of every page."""
    rules = rules_table(pages.sparkSession) if rules is None else rules
    rules = rules.filter("host <> '' AND path <> ''").groupBy("host", "path").agg(F.min("verdict").alias("verdict"))
    host, path = host_and_path()
    # repeated rows of one part of the input travel as one row and a count
    each = ["page_id", "host", "path", "origin"]
    rows = pages.select("page_id", host.alias("host"), path.alias("path"), F.spark_partition_id().alias("origin")).groupBy(*each).agg(F.count("*").cast("int").alias("n"))
    rows = materialize(rows.select(*each, "n", site().alias("site"), reversed_key().alias("key")), "urls")
    stacks = materialize(sweep(rows, host_edges(rules), "site", each), "stacks")
    candidates = stacks.select(*each, "n", F.explode("open").alias("upper"), F.col("path").cast("binary").alias("key"))
    found = sweep(candidates, path_edges(rules), "upper", each).filter("open.rule IS NOT NULL")
    every = stacks.withColumn("open", F.lit(None)).unionByName(found)
    best = every.groupBy(*each, "n").agg(F.max("open").alias("best"))
    best = best.select("page_id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"), F.explode(F.sequence(F.lit(1), F.col("n"))).alias("copy"))
    return best.drop("copy")


def oracle(rules=RULES, default: str = DEFAULT_VERDICT) -> str:
    fits = [(h + p, v, f"(host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}')") for h, p, v in sorted(rules, key=lambda r: (-len(r[0] + r[1]), r[0] + r[1]))]
    case = lambda k: " ".join(f"WHEN {f[2]} THEN '{f[k]}'" for f in fits)
    return f"""
WITH rest AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
parts AS (SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), '{UPPER}', '{LOWER}') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM rest)
SELECT page_id, host, path, CASE {case(0)} END AS rule, CASE {case(1)} ELSE '{default}' END AS verdict FROM parts"""
