"""Secret scans with an incremental blob ledger.

Every version of a path is addressed by the SHA-256 of its content. The ledger
holds one row for each blob and rule version that was scanned; only pairs that
it does not hold are scanned, once each however many paths share the blob, and
the findings are joined back to all paths.

Matches are found with built-in regular expressions. A text's pieces between
matches (split) and the matches (extract all) alternate, so running sums of
their lengths give positions in code points; the sums run in a window for each
blob and kind, and only blobs with a match get there.

Defined results: a null text counts as empty and has no spans. Repeated rows are
paths of one blob. Spans are ordered by start, then by the order of the kinds.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from geoweave.scratch import shared_folder


@dataclass(frozen=True)
class Kind:
    name: str
    pattern: str  # the same in Java and in RE2
    group: int = 0
    least: int = 1  # characters of that group
    base: bool = False


# The kinds of secrets and their patterns. Letter pairs stand for either case.
KINDS = (
    Kind("assign", r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8, True),
    Kind("access", r"AKIA[A-Z0-9]+", 0, 16, True),
    Kind("hex", r"[0-9a-f]{32,}", 0, 32, True),
    Kind("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Kind("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Kind("pem", r"-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----"),
)
RULE_VERSION = "secrets-1"

LEDGER_SCHEMA = "blob string, rule_version string, spans array<struct<start:bigint,rank:int,kind:string,end:bigint>>"


def address(text: str = "text"):
    return F.sha2(F.coalesce(F.col(text), F.lit("")), 256)


def scan(blobs: DataFrame, kinds=KINDS) -> DataFrame:
    """(blob, spans) of every row of blobs(blob, text) with a match."""
    pieces = F.array(*[
        F.when(F.col("text").rlike(k.pattern), F.struct(
            F.lit(i).alias("rank"), F.lit(k.name).alias("kind"), F.lit(k.least).alias("least"),
            F.transform(F.split("text", k.pattern, -1), F.length).alias("gaps"),
            F.transform(F.regexp_extract_all("text", F.lit(k.pattern), F.lit(0)), F.length).alias("sizes"),
            F.transform(F.regexp_extract_all("text", F.lit(k.pattern), F.lit(k.group)), F.length).alias("values"),
        ))
        for i, k in enumerate(kinds)
    ])
    hits = blobs.select("blob", F.explode(F.array_compact(pieces)).alias("hit"))
    hits = hits.select("blob", "hit.rank", "hit.kind", "hit.least", F.posexplode(F.arrays_zip(F.col("hit.gaps").alias("gap"), F.col("hit.sizes").alias("size"), F.col("hit.values").alias("value"))).alias("pos", "m"))
    running = Window.partitionBy("blob", "rank").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    end = F.sum(F.col("m.gap") + F.coalesce("m.size", F.lit(0))).over(running)
    spans = hits.withColumn("end", end.cast("long")).filter("m.size IS NOT NULL AND m.value >= least")
    span = F.struct((F.col("end") - F.col("m.size")).cast("long").alias("start"), "rank", "kind", "end")
    return spans.groupBy("blob").agg(F.sort_array(F.collect_list(span)).alias("spans"))


def unseen_entries(documents: DataFrame, ledger: DataFrame | None, rule_version: str = RULE_VERSION, kinds=KINDS) -> DataFrame:
    """Ledger rows of every blob of ``documents`` that ``ledger`` does not hold under this rule version."""
    versions = documents.select(address().alias("blob"), F.coalesce("text", F.lit("")).alias("text"))
    if ledger is not None:
        versions = versions.join(ledger.filter(F.col("rule_version") == rule_version).select("blob"), "blob", "left_anti")
    unseen = versions.groupBy("blob").agg(F.first("text").alias("text"))
    found = scan(unseen, kinds)
    # blobs without a finding are entered too, so that they are not scanned again
    seen = versions.select("blob").distinct()
    return seen.join(found, "blob", "left").select("blob", F.lit(rule_version).alias("rule_version"), "spans")


def scan_unseen(documents: DataFrame, ledger: DataFrame | None = None, rule_version: str = RULE_VERSION, kinds=KINDS) -> DataFrame:
    """The ledger after ``documents``: its own rows and one for every blob it had not seen under this rule version."""
    entered = unseen_entries(documents, ledger, rule_version, kinds)
    return entered if ledger is None else ledger.select("blob", "rule_version", "spans").unionByName(entered)


def read_ledger(spark: SparkSession, path: str) -> DataFrame | None:
    """The ledger kept at ``path``; None before its first run."""
    try:
        return spark.read.schema(LEDGER_SCHEMA).parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def update_ledger(documents: DataFrame, path: str, rule_version: str = RULE_VERSION, kinds=KINDS) -> DataFrame:
    """Appends to the ledger at ``path`` what it has not seen of ``documents``; the ledger with it."""
    spark = documents.sparkSession
    unseen_entries(documents, read_ledger(spark, path), rule_version, kinds).write.mode("append").parquet(path)
    return read_ledger(spark, path)


def findings_by_path(documents: DataFrame, ledger: DataFrame, rule_version: str = RULE_VERSION, keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keys`` (path and version, say) and spans of every row; null where its blob has none."""
    found = ledger.filter((F.col("rule_version") == rule_version) & F.col("spans").isNotNull()).select("blob", "spans")
    return documents.select(*keys, address().alias("blob")).join(found, "blob", "left").select(*keys, "spans")


def secret_scan(documents: DataFrame, ledger_path: str | None = None, rule_version: str = RULE_VERSION, kinds=KINDS, keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Counts, digest and spans of every row; without ``ledger_path`` a ledger is begun in the scratch folder."""
    path = ledger_path or f"{shared_folder(documents.sparkSession)}/ledger-{uuid.uuid4().hex}"
    now = update_ledger(documents, path, rule_version, kinds)
    paths = findings_by_path(documents, now, rule_version, keys).withColumn("spans", F.coalesce("spans", F.expr("cast(array() as array<struct<start:bigint,rank:int,kind:string,end:bigint>>)")))
    last_base = sum(k.base for k in kinds) - 1
    shown = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    of_rank = lambda i: F.size(F.filter("spans", lambda s: s["rank"] == i)).cast("long")
    counts = [of_rank(i).alias(f"n_{k.name}") for i, k in enumerate(kinds) if k.base]
    return paths.select(*keys, *counts, F.sha2(shown(F.filter("spans", lambda s: s["rank"] <= last_base)), 256).alias("base_sha256"), shown(F.col("spans")).alias("spans"))


def oracle(kinds=KINDS) -> str:
    quoted = lambda p: "'" + p.replace("'", "''") + "'"
    each = " UNION ALL ".join(
        f"SELECT doc_id, {i} AS rank, '{k.name}' AS kind, {k.least} AS least, unnest(string_split_regex(text, {quoted(k.pattern)})) AS gap, unnest(regexp_extract_all(text, {quoted(k.pattern)}, 0)) AS hit, unnest(regexp_extract_all(text, {quoted(k.pattern)}, {k.group})) AS val, generate_subscripts(string_split_regex(text, {quoted(k.pattern)}), 1) AS pos FROM t WHERE regexp_matches(text, {quoted(k.pattern)})"
        for i, k in enumerate(kinds)
    )
    last_base = sum(k.base for k in kinds) - 1
    counts = ", ".join(f"count(*) FILTER (WHERE rank = {i}) AS n_{k.name}" for i, k in enumerate(kinds) if k.base)
    named = ", ".join(f"coalesce(n_{k.name}, 0)::BIGINT AS n_{k.name}" for k in kinds if k.base)
    return f"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
pieces AS ({each}),
placed AS (SELECT *, (sum(length(gap) + coalesce(length(hit), 0)) OVER (PARTITION BY doc_id, rank ORDER BY pos))::BIGINT AS stop FROM pieces),
spans AS (SELECT *, stop - length(hit) AS start, kind || ':' || (stop - length(hit)) || ':' || stop AS shown FROM placed WHERE hit IS NOT NULL AND length(val) >= least),
joined AS (SELECT doc_id, {counts}, string_agg(shown, ',' ORDER BY start, rank) FILTER (WHERE rank <= {last_base}) AS base, string_agg(shown, ',' ORDER BY start, rank) AS spans FROM spans GROUP BY doc_id)
SELECT doc_id, {named}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM t LEFT JOIN joined USING (doc_id)"""
