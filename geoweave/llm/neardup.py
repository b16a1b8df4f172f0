"""MinHash near-duplicates with odd sketches, confirmed on full shingle sets.

1. Each text becomes its set of distinct word shingles (64-bit hashes), a digest
   of the set (BLAKE2), MinHash values in bands, and an odd sketch: every (hash
   function, value) pair of the MinHash sample flips one bit of a bitmap, so two
   bitmaps' XOR counts how much two samples differ, most precisely where they are
   alike. A second bitmap is flipped by every shingle: its XOR never counts more than
   the sets differ by, so it drops pairs without loss, and short texts' pairs sharply.
2. Equal sets are one class: only its smallest doc_id takes part in what follows,
   however many copies there are.
3. In every band bucket all members are compared with one hub, not with each other;
   likewise in every bucket of two neighbouring bands, which parts groups of near
   copies that share a single band. Sketches drop what is clearly unlike; the rest is
   confirmed on the full sets. This joins large groups with few pairs for each member.
4. Members of a bucket that are still in different components are compared in tiles:
   sizes within reach of each other, ``TILE`` members of a part, so that a bucket is
   dealt to many tasks and no pair of texts that could be alike is left out. Pairs
   within a component cannot change the result.
5. Components are found by large-star and small-star rounds over the links, then
   once more over the links between those components.

A pair at the threshold misses all bands with a probability of at most ``MISSED``; the
sketch threshold lies five standard deviations beyond the mean of such pairs (3e-7).
Both follow from ``percent``. A hub with a large part of all pairs has them dealt to
several tasks.

Defined results: a null or empty text, or one without words, has an empty set
and is linked with nothing; a text with fewer words than a shingle has one
shingle. Rows with one doc_id count as one document; rows without doc_id are
linked with nothing, their component_id is null and they are kept. Very long texts
have large sets and no other treatment. Columns besides doc_id and text are not
looked at, whatever their names. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import math
import sys
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geoweave.llm import text as tx
from geoweave.operators import skew
from geoweave.operators.graphs import components
from geoweave.scratch import materialize

cloudpickle.register_pickle_by_value(sys.modules[__name__])

PERCENT = 80
#: Probability that a pair at the threshold has no band in common.
MISSED = 2.1e-6
SKETCH_WORDS = 16  # of 64 bits
#: Members of one part of a bucket; every pair of parts is one unit of work.
TILE = 512


@dataclass(frozen=True)
class Shape:
    """How many bands of how many MinHash values, and the XOR bits that a pair at the threshold stays under."""

    bands: int
    rows: int
    sketch_bits: int

    @staticmethod
    def of(percent: int) -> Shape:
        if not 50 <= percent <= 100:
            raise ValueError("similarities from 50 to 100 percent can be found")
        s = percent / 100
        rows = 5 if percent >= 80 else 4 if percent >= 70 else 3 if percent >= 60 else 2
        bands = math.ceil(math.log(MISSED) / math.log(1 - s**rows)) if percent < 100 else 4
        k, bits = bands * rows, 64 * SKETCH_WORDS
        # each entry that differs flips two bits; flips fold where they meet
        flips = 2 * k * (1 - s)
        folded = bits / 2 * (1 - math.exp(-2 * flips / bits))
        spread = (2 * math.sqrt(k * s * (1 - s)) * math.exp(-2 * flips / bits)) ** 2 + max(0.0, bits / 4 * (1 - math.exp(-4 * flips / bits)) - flips * math.exp(-4 * flips / bits))
        return Shape(bands, rows, math.ceil(folded + 5 * math.sqrt(spread)))


def factors(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Odd factors and terms of the n hash functions, the same in every run."""
    rng = np.random.RandomState(20240301)
    return (rng.randint(0, 2**31, n).astype(np.uint32) << np.uint32(1)) | np.uint32(1), rng.randint(0, 2**31, n).astype(np.uint32) * np.uint32(2)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes, sorted within each text, and where each text's begin."""
    w = tx.Words(data, offsets, tx.SPACED, True)
    at, h = w.grams(size)
    doc = w.doc[at]
    few = np.flatnonzero((w.counts > 0) & (w.counts < size))
    if len(few):
        lone = tx.mix(w.counts[few].astype(np.uint64))
        for k in range(size - 1):  # the whole sequence as one, word by word
            more = w.counts[few] > k
            lone[more] = tx.mix(lone[more] * np.uint64(0x9DDFEA08EB382D69) + w.hash[w.first[few[more]] + k])
        doc, h = np.concatenate([doc, few]), np.concatenate([h, lone])
        order = np.argsort(doc, kind="stable")
        doc, h = doc[order], h[order]
    first = np.searchsorted(doc, np.arange(w.rows + 1))
    for a, b in zip(first[:-1], first[1:]):
        h[a:b].sort()
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    return h[new], np.searchsorted(doc[new], np.arange(w.rows + 1))


def signatures(h: np.ndarray, first: np.ndarray, shape: Shape) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For texts with shingles: two digest words, odd sketches, band keys."""
    begin = first[:-1]
    hashes = shape.bands * shape.rows
    digest = np.frombuffer(b"".join(hashlib.blake2b(h[a:z].tobytes(), digest_size=16).digest() for a, z in zip(begin, first[1:])), np.uint64).reshape(-1, 2)
    factor, term = factors(hashes)
    x = (h >> np.uint64(32)).astype(np.uint32)
    least = np.empty((hashes, len(begin)), np.uint32)
    y = np.empty_like(x)
    for k in range(hashes):
        np.multiply(x, factor[k], out=y)
        y += term[k]
        least[k] = np.minimum.reduceat(y, begin)
    entry = tx.mix(least.astype(np.uint64) + (np.arange(hashes, dtype=np.uint64) << np.uint64(32))[:, None])
    bit = (entry >> np.uint64(54)) % np.uint64(64 * SKETCH_WORDS)
    sketch = np.zeros((len(begin), SKETCH_WORDS), np.uint64)
    rows = np.arange(len(begin))
    for k in range(hashes):
        sketch[rows, (bit[k] >> np.uint64(6)).astype(np.int64)] ^= np.uint64(1) << (bit[k] & np.uint64(63))
    whole = np.zeros_like(sketch)
    bit = tx.mix(h ^ np.uint64(0xC3C3)) >> np.uint64(64 - 10)
    flip = np.uint64(1) << (bit & np.uint64(63))
    for k in range(SKETCH_WORDS):
        whole[:, k] = np.bitwise_xor.reduceat(np.where(bit >> np.uint64(6) == k, flip, np.uint64(0)), begin)
    sketch = np.concatenate([sketch, whole], axis=1)
    keys = np.zeros((shape.bands, len(begin)), np.uint64)
    for r in range(shape.rows):
        keys = tx.mix(keys * np.uint64(0x9DDFEA08EB382D69) + entry[r :: shape.rows])
    return digest, sketch, keys.T


def sign(documents: DataFrame, size: int, shape: Shape) -> DataFrame:
    """doc_id, n_shingles, digest, sketch and bands of every row; the last three are null for an empty set."""
    kind = dict(documents.dtypes)["doc_id"]
    names = ["doc_id", "n_shingles", "digest", "sketch", "bands"]

    def rows_of(values: np.ndarray, some: np.ndarray, n: int) -> pa.Array:
        """A list for each text in ``some``, null elsewhere."""
        width = values.shape[1]
        offsets = pa.array(np.concatenate([[0], np.cumsum(np.where(some, width, 0))]).astype(np.int32))
        return pa.ListArray.from_arrays(offsets, pa.array(np.ascontiguousarray(values).view(np.int64).ravel()), mask=pa.array(~some))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, j, data, offsets in tx.slices(b.column(0)):
                h, first = shingle_sets(data, offsets, size)
                count = np.diff(first)
                some = count > 0
                if some.any():
                    starts = np.append(first[:-1][some], first[-1])
                    values = signatures(h, starts, shape)
                else:
                    values = (np.zeros((0, 2), np.uint64), np.zeros((0, 2 * SKETCH_WORDS), np.uint64), np.zeros((0, shape.bands), np.uint64))
                yield pa.RecordBatch.from_arrays([b.column(1).slice(i, j - i), pa.array(count.astype(np.int64)), *(rows_of(v, some, j - i) for v in values)], names)

    return documents.select("text", "doc_id").mapInArrow(run, f"doc_id {kind}, n_shingles long, digest array<long>, sketch array<long>, bands array<long>")


def set_table(documents: DataFrame, size: int) -> DataFrame:
    """(doc_id, items): the sorted shingle hashes of every row as bytes."""
    kind = dict(documents.dtypes)["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, j, data, offsets in tx.slices(b.column(0)):
                h, first = shingle_sets(data, offsets, size)
                yield pa.RecordBatch.from_arrays([b.column(1).slice(i, j - i), pa.array([h[a:z].tobytes() for a, z in zip(first[:-1], first[1:])], pa.binary())], ["doc_id", "items"])

    return documents.select("text", "doc_id").mapInArrow(run, f"doc_id {kind}, items binary")


def with_both(pairs: DataFrame, rows: DataFrame, value: str, heavy: DataFrame) -> DataFrame:
    """The pairs (a, b, ...) with x and y: the ``value`` of a and of b in rows(doc_id, value)."""
    left = rows.select(F.col("doc_id").alias("a"), F.col(value).alias("x"))
    right = rows.select(F.col("doc_id").alias("b"), F.col(value).alias("y")).hint("merge")
    return skew.spread_join(pairs, left, "a", "b", heavy).join(right, "b")


def confirm(pairs: DataFrame, sets: DataFrame, percent: int, heavy: DataFrame) -> DataFrame:
    """The pairs (a, b, ...) whose full sets have 100 * intersection >= percent * union; all columns stay."""
    columns = pairs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = np.zeros(batch.num_rows, bool)
            for k, (x, y) in enumerate(zip(batch.column(0), batch.column(1))):
                x, y = np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)
                both = np.concatenate([x, y])
                both.sort()
                same = int((both[1:] == both[:-1]).sum())
                good[k] = 100 * same >= percent * (len(x) + len(y) - same)
            yield pa.RecordBatch.from_arrays([c.filter(pa.array(good)) for c in batch.columns[2:]], columns)

    both = with_both(pairs, sets, "items", heavy).select("x", "y", *columns)
    return materialize(both.mapInArrow(run, pairs.schema), "confirmed")


def same_id_links(known: DataFrame, heads: DataFrame) -> DataFrame:
    """Links between the classes of texts that share a doc_id; there are none where doc_id is unique."""
    repeated = known.groupBy("doc_id").agg(F.count_distinct("digest", "n_shingles").alias("n")).filter("n > 1").select("doc_id")
    classes = known.join(repeated, "doc_id", "left_semi").select(F.col("doc_id").alias("row_id"), "digest", "n_shingles").join(heads.select("digest", "n_shingles", "doc_id"), ["digest", "n_shingles"])
    return classes.select(F.col("row_id").alias("a"), F.col("doc_id").alias("b")).filter("a <> b")


def unlike_bits(first: int = 0):
    """XOR bits of the bitmaps x.sketch and y.sketch that begin at word ``first``."""
    bits = [F.bit_count(F.col("x.sketch")[i].bitwiseXOR(F.col("y.sketch")[i])) for i in range(first, first + SKETCH_WORDS)]
    return sum(bits[1:], bits[0])


def may_link(percent: int, shape: Shape):
    """Whether texts x and y can be alike enough: by their sizes, by all shingles, by the MinHash sample."""
    n, m = F.col("x.n_shingles"), F.col("y.n_shingles")
    sizes = 100 * F.least(n, m) >= percent * F.greatest(n, m)
    return sizes & (unlike_bits(SKETCH_WORDS) * (100 + percent) <= (n + m) * (100 - percent)) & (unlike_bits() <= shape.sketch_bits)


def star_pairs(heads: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Members (bucket, doc_id) of the buckets that hold several texts, and their distinct pairs (a, b) with hubs."""
    n = F.size("bands")
    banded = heads.select("doc_id", F.inline(F.transform("bands", lambda key, i: F.struct(key.alias("bucket"), F.get("bands", (i + 1) % n).alias("next")))))
    hubs = banded.groupBy("bucket").agg(F.min("doc_id").alias("hub"), F.count("*").alias("n")).filter("n > 1").select("bucket", "hub")
    shared = materialize(banded.join(hubs.hint("merge"), "bucket"), "buckets")
    closer = shared.groupBy("bucket", "next").agg(F.min("doc_id").alias("closer"), F.count("*").alias("n")).filter("n > 1").select("bucket", "next", "closer")
    pairs = shared.select(F.col("hub").alias("a"), F.col("doc_id").alias("b")).union(shared.join(closer.hint("merge"), ["bucket", "next"]).select("closer", "doc_id"))
    return shared.select("bucket", "doc_id"), materialize(pairs.filter("a <> b").distinct(), "stars")


def tile_pairs(shared: DataFrame, whole: DataFrame, sketches: DataFrame, percent: int, shape: Shape, tile: int = TILE) -> DataFrame:
    """(a, b, c, d): pairs of one bucket that may be alike and are in the components c and d, of which c <> d.

    Sizes are put into classes so wide that alike texts are in one class or in
    neighbouring ones. A class's members are dealt to parts; each part meets the
    parts of its class from its own on, and all of the next class.
    """
    placed = shared.join(whole.withColumnRenamed("node", "doc_id"), "doc_id", "left").withColumn("component", F.coalesce("component", "doc_id"))
    mixed = placed.groupBy("bucket").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).filter("lo <> hi").select("bucket")
    step = max(math.log(100 / percent) * 1.000001, 1e-6)
    open_ = materialize(placed.join(mixed, "bucket", "left_semi").join(sketches, "doc_id").withColumn("cls", F.floor(F.log(F.col("s.n_shingles")) / step)), "open")
    counted = open_.groupBy("bucket", "cls").agg(F.ceil(F.count("*") / tile).cast("int").alias("parts"))
    # a bucket has as many classes as sizes differ by powers of the step: some tens
    sizes = counted.groupBy("bucket").agg(F.map_from_entries(F.collect_list(F.struct("cls", "parts"))).alias("parts"))
    own, after, before = (F.coalesce(F.element_at("parts", F.col("cls") + k), F.lit(0)) for k in (0, 1, -1))
    dealt = open_.join(sizes, "bucket").select("*", own.alias("n"), after.alias("after"), before.alias("before")).withColumn("part", F.pmod(F.xxhash64("doc_id"), "n").cast("int"))
    span = lambda lo, hi: F.when(hi >= lo, F.sequence(lo, hi)).otherwise(F.array().cast("array<int>"))
    key = lambda cls, p, up, q: F.struct(cls.alias("cls"), p.alias("p"), F.lit(up).alias("up"), q.alias("q"))
    cls, part = F.col("cls"), F.col("part")
    left = F.concat(F.transform(span(part, F.col("n") - 1), lambda q: key(cls, part, 0, q)), F.transform(span(F.lit(0), F.col("after") - 1), lambda q: key(cls, part, 1, q)))
    right = F.concat(F.transform(span(F.lit(0), part), lambda p: key(cls, p, 0, part)), F.transform(span(F.lit(0), F.col("before") - 1), lambda p: key(cls - 1, p, 1, part)))
    one = dealt.select("bucket", F.explode(left).alias("tile"), F.col("doc_id").alias("a"), F.col("component").alias("c"), F.col("s").alias("x"))
    two = dealt.select("bucket", F.explode(right).alias("tile"), F.col("doc_id").alias("b"), F.col("component").alias("d"), F.col("s").alias("y"))
    met = one.join(two.hint("merge"), ["bucket", "tile"]).filter((F.col("c") != F.col("d")) & ((F.col("tile.up") == 1) | (F.col("tile.p") != F.col("tile.q")) | (F.col("a") < F.col("b"))) & may_link(percent, shape))
    return met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), F.least("c", "d").alias("c"), F.greatest("c", "d").alias("d")).distinct()


def near_duplicates(documents: DataFrame, size: int = 5, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every row of documents(doc_id, text)."""
    shape = Shape.of(percent)
    documents = documents.select("doc_id", "text")
    signed = materialize(sign(documents, size, shape), "signatures")
    known = signed.filter("doc_id IS NOT NULL AND n_shingles > 0")
    # equal sets have equal sketches and bands, so any row of a class will do
    heads = known.groupBy("digest", "n_shingles").agg(F.min("doc_id").alias("doc_id"), F.first(F.struct("sketch", "bands")).alias("s"))
    heads = materialize(heads.select("digest", "n_shingles", "doc_id", "s.sketch", "s.bands"), "heads")
    sketches = heads.select("doc_id", F.struct("n_shingles", "sketch").alias("s"))

    shared, stars = star_pairs(heads)
    needed = shared.select("doc_id").distinct().hint("shuffle_hash")
    sets = materialize(set_table(documents.join(needed, "doc_id", "left_semi"), size), "shingles")
    heavy = skew.heavy_keys(stars, "a")
    tried = materialize(with_both(stars, sketches, "s", heavy).filter(may_link(percent, shape)).select("a", "b"), "pairs")
    whole = components(confirm(tried, sets, percent, heavy).union(same_id_links(known, heads)))

    # links between components, found and joined likewise
    rest = materialize(tile_pairs(shared, whole, sketches, percent, shape).join(tried, ["a", "b"], "left_anti"), "pairs")
    found = confirm(rest, sets, percent, skew.heavy_keys(rest, "a"))
    merged = components(found.select(F.col("c").alias("a"), F.col("d").alias("b")))
    class_of = heads.select("digest", "n_shingles", "doc_id").join(whole.withColumnRenamed("node", "doc_id"), "doc_id", "left").select("digest", "n_shingles", F.coalesce("component", "doc_id").alias("node"))
    by_class = class_of.join(merged, "node", "left").select("digest", "n_shingles", F.coalesce("component", "node").alias("component"))
    rows = signed.select("doc_id", "n_shingles", "digest").join(by_class, ["digest", "n_shingles"], "left")
    # rows with one doc_id are one document
    per_doc = rows.filter("doc_id IS NOT NULL").groupBy("doc_id").agg(F.min(F.coalesce("component", "doc_id")).alias("component_id"))
    return signed.select("doc_id", "n_shingles").join(per_doc, "doc_id", "left").select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def keep_one_of_each(documents: DataFrame, size: int = 5, percent: int = PERCENT) -> DataFrame:
    """The documents without those that a smaller doc_id of their component stands for."""
    dropped = near_duplicates(documents, size, percent).filter("NOT kept").select("doc_id").distinct()
    return documents.join(dropped, "doc_id", "left_anti").select(*[F.col(f"`{c}`") for c in documents.columns])
