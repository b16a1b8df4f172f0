"""Line dedup across documents: lines that several documents share stay in one of them.

Texts are cut at line feeds; a line's key is the line without white space at its ends and with
A-Z lower-cased. Lines whose key has enough code points are exploded and hashed (128
bits, equal hashes being taken as equal); documents are counted for each hash, a document that
repeats a line once. Keys over the threshold are written, lines meet them by a join, and the
places of dropped lines come back to their text, which is put together again from the lines
that stay, in their order.

The texts themselves are shuffled once, in the last join; until then lines travel as
hashes. A line that a large part of all lines are has its counts pre-aggregated; in the
join such keys, of which there are fewer than ``HEAVY``, are broadcast, and all others meet by
a shuffle.

Defined results: a null or empty text is one empty line, and a null stays null. Rows of one id are
one document; rows without an id count as one more document, which never keeps a line that
others hold. Several equal lines of the document that keeps them all stay. Repeated rows
all get the same result. Very long texts are one array of their own lines. Further
columns are kept whatever their names: where one is called `n_lines` or `n_dropped`, ours gets an
underscore behind it. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geoweave.llm.names import free
from geoweave.scratch import materialize

LEAST_CHARS, LEAST_DOCUMENTS = 20, 3
#: A key with more than one of so many of the repeated lines is broadcast: there are fewer of them than this.
HEAVY = 1000

WHITE = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
HASH = ["h1", "h2"]


def split_lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def lowered(text: Column) -> Column:
    """A-Z lower-cased and no other letter; ASCII texts take the quick way."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def mark(text: Column) -> Column:
    """What tells the texts of one id apart."""
    return F.unhex(F.md5(text.cast("binary")))


def long_lines(documents: DataFrame, least_chars: int) -> DataFrame:
    """doc_id, mark, place and the key's hash of every line whose key has ``least_chars`` code points."""
    rows = documents.filter(F.octet_length("text") >= least_chars).select("doc_id", mark(F.col("text")).alias("mark"), lowered(F.col("text")).alias("text"))
    rows = rows.select("doc_id", "mark", F.posexplode(split_lines(F.col("text"))).alias("place", "line"))
    rows = rows.select("doc_id", "mark", "place", F.btrim("line", F.lit(WHITE)).alias("key")).filter(F.char_length("key") >= least_chars)
    return rows.select("doc_id", "mark", "place", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), "key").alias("h2"))


def repeated_keys(lines: DataFrame, least_documents: int) -> DataFrame:
    """(h1, h2, keeper, lines): keys of at least ``least_documents`` documents, the largest id that holds them, and their lines."""
    by_document = lines.groupBy(*HASH, "doc_id").agg(F.count("*").alias("n"))
    by_key = by_document.groupBy(*HASH).agg(F.count("*").alias("documents"), F.max("doc_id").alias("keeper"), F.sum("n").alias("lines"))
    return by_key.filter(F.col("documents") >= least_documents).select(*HASH, "keeper", "lines")


def dropped_places(lines: DataFrame, repeated: DataFrame) -> DataFrame:
    """(doc_id, mark, places): the lines that go, for every text that loses any; ``repeated`` is a written table."""
    most = F.lit((repeated.agg(F.sum("lines")).first()[0] or 0) // HEAVY)
    heavy = F.broadcast(repeated.filter(F.col("lines") > most).select(*HASH, F.col("keeper").alias("heavy_keeper"), F.lit(True).alias("heavy")))
    met = lines.join(heavy, HASH, "left")
    others = repeated.filter(F.col("lines") <= most).select(*HASH, "keeper")
    cold = met.filter("heavy IS NULL").drop("heavy", "heavy_keeper").join(others.hint("merge"), HASH)
    hot = met.filter("heavy").select(*cold.columns[:-1], F.col("heavy_keeper").alias("keeper"))
    gone = hot.unionByName(cold).filter(~F.col("doc_id").eqNullSafe(F.col("keeper")))
    # a set, as repeated rows of one id and text name the same places
    return gone.groupBy("doc_id", "mark").agg(F.collect_set("place").alias("places"))


def dedup_lines(documents: DataFrame, least_chars: int = LEAST_CHARS, least_documents: int = LEAST_DOCUMENTS) -> DataFrame:
    """All columns of ``documents`` with the lines that stay as ``text``, and ``n_lines`` (before) and ``n_dropped``."""
    n_lines, n_dropped = free(documents.columns, "n_lines"), free(documents.columns, "n_dropped")
    lines = long_lines(documents, least_chars)
    repeated = materialize(repeated_keys(lines, least_documents), "repeated")
    gone = dropped_places(lines, repeated).select(F.col("doc_id").alias("id"), F.col("mark").alias("of"), "places")
    rows = documents.select(F.struct(*(F.col(f"`{c}`") for c in documents.columns)).alias("row"))
    met = rows.join(gone.hint("merge"), F.col("row.doc_id").eqNullSafe(F.col("id")) & (mark(F.col("row.text")) == F.col("of")), "left")
    met = met.select("row", "places", split_lines(F.col("row.text")).alias("lines"))
    stay = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), "places")
    kept = F.array_join(F.transform(stay, lambda p: F.get("lines", p)), "\n")
    text = F.when(F.col("places").isNull(), F.col("row.text")).otherwise(kept)
    columns = [text.alias(c) if c.lower() == "text" else F.col(f"row.`{c}`") for c in documents.columns]
    counts = F.size("lines").cast("long").alias(n_lines), F.coalesce(F.size("places"), F.lit(0)).cast("long").alias(n_dropped)
    return met.select(*columns, *counts)


def digests(documents: DataFrame) -> DataFrame:
    """doc_id, n_lines, n_dropped and the digest of what stays, for every row."""
    kept = dedup_lines(documents.select("doc_id", "text"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))


def oracle() -> str:
    return f"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
cut AS (SELECT r, doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) AS place FROM docs),
keyed AS (SELECT *, trim(translate(line, '{UPPER}', '{LOWER}'), ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS key FROM cut),
held AS (SELECT key, max(doc_id) AS keeper FROM keyed WHERE length(key) >= {LEAST_CHARS} GROUP BY key
  HAVING count(DISTINCT doc_id) + max((doc_id IS NULL)::INT) >= {LEAST_DOCUMENTS}),
judged AS (SELECT k.*, h.key IS NOT NULL AND k.doc_id IS DISTINCT FROM h.keeper AS gone FROM keyed k LEFT JOIN held h USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY place) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM judged GROUP BY r, doc_id"""
