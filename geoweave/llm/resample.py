"""Importance resampling towards a target distribution, by hashed n-grams.

Runs of one and two words fall into buckets by the CRC32 of their bytes. A bucket's gain
is the log ratio of its share in the target (all benchmark texts) to its share in the
corpus; a document's weight is the mean gain of its features, and a Gumbel draw by id added
to it makes the highest scores a sample without replacement in proportion to the ratios.

Every task keeps a trie of the words it has seen: a node for each word and, below it, one
for each word that followed it. A node holds its feature's count and the CRC state
after its bytes, so a successor's checksum goes on from its parent's state. Bucket
totals of all tasks are summed by a shuffle; at most ``BUCKETS`` of them reach the
driver and return to the tasks as gains. The second walk attaches each node's gain when
the node is made. A trie of ``NODES`` nodes is emptied into totals, which changes no count, so
memory is bounded whatever a task reads.

Words are told apart by 64-bit hashes. Defined results: null and empty texts have no features,
weight 0, and are not drawn. A row without an id has no score, is not drawn and is not
among the N. Repeated rows count and are drawn one by one, as rows of equal score and id
may follow each other in any order. Ties go to the smaller id. Very long texts are read whole. An
empty table gives no rows, and an empty target makes every gain follow the corpus alone.
Carried columns may have any names.
"""

from __future__ import annotations

import math
import sys
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from geoweave.llm import text as tx
from geoweave.llm.manifest import crc32_sql
from geoweave.llm.names import free
from geoweave.llm.ranks import places
from geoweave.scratch import materialize

cloudpickle.register_pickle_by_value(sys.modules[__name__])

BUCKETS = 10000
PERCENT, LEAST_WORDS, SEED = 25, 20, 7
#: Nodes of a trie before it is emptied, and bytes of a slice of texts, which bounds what one walk can add.
NODES = 1 << 20
#: Longer words go through zlib one by one.
LONG_WORD = 64

_CRC = np.arange(256, dtype=np.uint32)
for _ in range(8):
    _CRC = np.where(_CRC & 1, (_CRC >> 1) ^ np.uint32(0xEDB88320), _CRC >> 1).astype(np.uint32)


def crc_from(states: np.ndarray, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """CRC states after the spans of ``data``, each going on from its own state."""
    c, size = ~states, end - start
    live, at = np.flatnonzero((size > 0) & (size <= LONG_WORD)), 0
    while len(live):
        c[live] = _CRC[(c[live] ^ data[start[live] + at]) & 0xFF] ^ (c[live] >> 8)
        at += 1
        live = live[size[live] > at]
    c = ~c
    for i in np.flatnonzero(size > LONG_WORD):
        c[i] = zlib.crc32(data[start[i] : end[i]].tobytes(), int(states[i]))
    return c


def after_space(states: np.ndarray) -> np.ndarray:
    c = ~states
    return ~(_CRC[(c ^ np.uint32(0x20)) & 0xFF] ^ (c >> 8))


class Level:
    """Nodes of one depth: ``keys`` in order with the node ``ids``; by id the CRC state, count and gain."""

    def __init__(self):
        self.keys, self.ids = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.crc, self.count, self.gain = np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def visit(self, keys: np.ndarray, states, gains: np.ndarray | None) -> np.ndarray:
        """Node ids of ``keys``; ``states`` gives the CRC states of new nodes from the places where they first stand."""
        seen, first, inverse, times = np.unique(keys, return_index=True, return_inverse=True, return_counts=True)
        at = np.searchsorted(self.keys, seen)
        known = np.zeros(len(seen), bool)
        inside = at < len(self.keys)
        known[inside] = self.keys[at[inside]] == seen[inside]
        ids = np.empty(len(seen), np.int64)
        ids[known] = self.ids[at[known]]
        new = ~known
        ids[new] = len(self.crc) + np.arange(int(new.sum()))
        crc = states(first[new])
        self.keys, self.ids = np.insert(self.keys, at[new], seen[new]), np.insert(self.ids, at[new], ids[new])
        self.crc = np.concatenate([self.crc, crc])
        self.count = np.concatenate([self.count, np.zeros(len(crc), np.int64)])
        if gains is not None:
            self.gain = np.concatenate([self.gain, gains[crc % len(gains)]])
        self.count[ids] += times
        return ids[inverse]


class Trie:
    """Words and the words that follow them, as seen by one task."""

    def __init__(self, gains: np.ndarray | None = None):
        self.gains, self.words, self.pairs = gains, Level(), Level()

    def __len__(self) -> int:
        return len(self.words.crc) + len(self.pairs.crc)

    def walk(self, w: tx.Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Nodes of all words, the words that another follows in their text, and the nodes of those pairs."""
        fresh = lambda at: crc_from(np.zeros(len(at), np.uint32), w.bytes, w.start[at], w.end[at])
        node = self.words.visit(w.hash, fresh, self.gains)
        head = np.flatnonzero(w.doc[:-1] == w.doc[1:])
        onward = lambda at: crc_from(after_space(self.words.crc[node[head[at]]]), w.bytes, w.start[head[at] + 1], w.end[head[at] + 1])
        keys = node[head].astype(np.uint64) << np.uint64(32) | node[head + 1].astype(np.uint64)
        return node, head, self.pairs.visit(keys, onward, self.gains)

    def totals(self, buckets: int) -> np.ndarray:
        out = np.zeros(buckets, np.int64)
        for level in (self.words, self.pairs):
            np.add.at(out, level.crc % buckets, level.count)
        return out


def bucket_totals(texts: DataFrame, buckets: int = BUCKETS, nodes: int = NODES) -> DataFrame:
    """(bucket, n): occurrences of features in the ``text`` column of all rows, by bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie, total = Trie(), np.zeros(buckets, np.int64)
        for b in batches:
            for _, _, data, offsets in tx.slices(b.column(0)):
                trie.walk(tx.Words(data, offsets, tx.ALNUM, True))
                if len(trie) > nodes:
                    total += trie.totals(buckets)
                    trie = Trie()
        total += trie.totals(buckets)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["bucket", "n"])

    found = texts.select(F.col("text").cast("string")).mapInArrow(run, "bucket long, n long")
    return found.groupBy("bucket").agg(F.sum("n").alias("n"))


def gains_of(corpus: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """Gain of every bucket from (bucket, n) of both; ``buckets`` rows of each reach the driver."""
    counts = []
    for found in (corpus, target):
        got = found.toArrow()
        n = np.zeros(buckets, np.int64)
        n[got.column("bucket").to_numpy()] = got.column("n").to_numpy()
        counts.append(n.tolist())
    s, t = counts
    of_s, of_t = float(sum(s) + buckets), float(sum(t) + buckets)
    ratio = lambda a, b: (b + 1.0) * of_s / ((a + 1.0) * of_t)
    return np.array([math.floor(1000 * math.log(ratio(a, b))) for a, b in zip(s, t, strict=True)], np.int64)


def gumbel(doc_id: Column, seed: int = SEED) -> Column:
    """The draw of an id: floor(-1000 ln(-ln u)), u from the first 32 bits of a digest."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), doc_id.cast("string")).cast("binary"), 256), 1, 8), 16, 10)
    return F.floor(-1000 * F.ln(-F.ln((h.cast("double") + 0.5) / 4294967296))).cast("long")


def weigh(documents: DataFrame, gains: np.ndarray, carry: bool = False, nodes: int = NODES) -> DataFrame:
    """doc_id, n_features and weight of every row; with ``carry`` also all its columns as ``row``."""
    whole = [F.struct(*(F.col(f"`{c}`") for c in documents.columns)).alias("row")] if carry else []
    rows = documents.select("doc_id", F.col("text").cast("string"), *whole)
    fields = rows.schema.fields
    schema = StructType([fields[0], StructField("n_features", LongType()), StructField("weight", LongType()), *fields[2:]])
    names = schema.names
    shared = documents.sparkSession.sparkContext.broadcast(gains)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = Trie(shared.value)
        for b in batches:
            features, weights = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for _, _, data, offsets in tx.slices(b.column(1)):
                w = tx.Words(data, offsets, tx.ALNUM, True)
                node, head, pair = trie.walk(w)
                # sums of whole numbers below 2^53 are exact
                total = np.bincount(w.doc, weights=trie.words.gain[node], minlength=w.rows)
                total += np.bincount(w.doc[head], weights=trie.pairs.gain[pair], minlength=w.rows)
                n = w.counts + np.maximum(w.counts - 1, 0)
                features.append(n)
                weights.append(total.astype(np.int64) // np.maximum(n, 1))
                if len(trie) > nodes:
                    trie = Trie(shared.value)
            found = [pa.array(np.concatenate(x).astype(np.int64)) for x in (features, weights)]
            yield pa.RecordBatch.from_arrays([b.column(0), *found, *b.columns[2:]], names)

    return rows.mapInArrow(run, schema)


def resample(documents: DataFrame, target: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS, seed: int = SEED, carry: bool = False) -> DataFrame:
    """doc_id, n_features, weight, score and rank of every row, rank null where it is not drawn; with ``carry`` also ``row``."""
    gains = gains_of(bucket_totals(documents), bucket_totals(target))
    scored = weigh(documents, gains, carry).withColumn("score", F.col("weight") + gumbel(F.col("doc_id"), seed))
    # n words have 2 n - 1 features
    able = (F.col("n_features") >= 2 * least_words - 1) & F.col("score").isNotNull()
    scored = materialize(scored.withColumn("able", able).withColumn("spread", F.rand(seed)), "scored")
    order = [F.col("score").desc(), F.col("doc_id"), F.col("n_features"), F.col("weight"), F.col("spread")]
    ranked = places(scored.filter("able").withColumn("group", F.lit(0)), "group", *order)
    drawn = F.expr(f"CASE WHEN place < ({percent} * total) div 100 THEN place + 1 END").alias("rank")
    whole = ["row"] if carry else []
    shown = ["doc_id", "n_features", "weight", "score", *whole]
    rest = scored.filter("NOT able").select(*shown, F.lit(None).cast("long").alias("rank"))
    return ranked.select(*shown, drawn).union(rest).select("doc_id", "n_features", "weight", "score", "rank", *whole)


def drawn_documents(documents: DataFrame, target: DataFrame, **how) -> DataFrame:
    """The drawn rows of ``documents`` with all their columns and their rank."""
    name = free(documents.columns, "rank")
    return resample(documents, target, carry=True, **how).filter("rank IS NOT NULL").select("row.*", F.col("rank").alias(name))


def oracle() -> str:
    words = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
    code = crc32_sql("list_transform(range(0, octet_length(encode(feature))), lambda i: ('0x' || substr(hex(encode(feature)), 2 * i + 1, 2))::BIGINT)")
    return f"""
WITH texts AS (SELECT row_number() OVER () AS r, 1 AS kind, doc_id, {words} AS w FROM documents
  UNION ALL SELECT -row_number() OVER (), 2, NULL, {words} FROM benchmark),
pieces AS (SELECT r, kind, unnest(w) AS feature FROM texts
  UNION ALL SELECT r, kind, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) FROM texts WHERE len(w) > 1),
counted AS (SELECT r, kind, feature, count(*) AS n FROM pieces GROUP BY ALL),
coded AS (SELECT feature, {code} % {BUCKETS} AS bucket FROM (SELECT DISTINCT feature FROM counted)),
featured AS (SELECT r, kind, bucket, n FROM counted JOIN coded USING (feature)),
totals AS (SELECT bucket, coalesce(sum(n) FILTER (WHERE kind = 1), 0) AS s, coalesce(sum(n) FILTER (WHERE kind = 2), 0) AS t FROM featured GROUP BY bucket),
gains AS (SELECT bucket, floor(1000 * ln((t + 1)::DOUBLE * (sum(s) OVER () + {BUCKETS})::DOUBLE / ((s + 1)::DOUBLE * (sum(t) OVER () + {BUCKETS})::DOUBLE)))::BIGINT AS gain FROM totals),
weights AS (SELECT r, sum(n)::BIGINT AS n_features, floor(sum(n * gain)::DOUBLE / sum(n)::DOUBLE)::BIGINT AS weight FROM featured JOIN gains USING (bucket) WHERE kind = 1 GROUP BY r),
scored AS (SELECT doc_id, coalesce(n_features, 0)::BIGINT AS n_features, coalesce(weight, 0)::BIGINT AS weight,
  coalesce(weight, 0)::BIGINT + floor(-1000 * ln(-ln((('0x' || substr(sha256('{SEED}:' || doc_id), 1, 8))::BIGINT + 0.5) / 4294967296)))::BIGINT AS score
  FROM texts LEFT JOIN weights USING (r) WHERE kind = 1),
able AS (SELECT *, n_features >= {2 * LEAST_WORDS - 1} AND score IS NOT NULL AS able FROM scored)
SELECT doc_id, n_features, weight, score, CASE WHEN able AND place <= {PERCENT} * total // 100 THEN place END AS rank
FROM (SELECT *, row_number() OVER (PARTITION BY able ORDER BY score DESC, doc_id, n_features, weight) AS place, count(*) OVER (PARTITION BY able) AS total FROM able)"""
