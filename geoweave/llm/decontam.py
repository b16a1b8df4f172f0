"""Benchmark decontamination: CGK embeddings, bit-sampling LSH, exact edit check.

The CGK random walk reads a window of words from left to right; at each step it
writes the current word and, by a random bit of (step, word), stays or goes on.
Windows at a small edit distance then agree at most steps, so edit distance
becomes Hamming distance, and a few sampled steps agree with good probability.

1. Items are put into size classes; a class's windows have the size of its
   shortest item. All windows of every item are walked and indexed under
   ``WALKS`` walks with ``SAMPLES`` samples of ``STEPS`` steps each.
2. All windows of a class's size of every text are walked likewise, except those
   that hold fewer of the items' words and word pairs than a window within the
   edit limit must (an edit takes away one word and two pairs at most): those
   cannot be near any item of the class.
3. Windows that agree with an item's window in any sample are candidates; the
   least word edit distance of the whole item against the text around it is computed
   exactly, and the item is found if that is at most ``PERCENT`` of its words.

Every item is looked for anywhere in every text, and confirmed as a whole, whatever
its length. Of an item of more than ``LONGEST`` words the candidates come from its
parts: one part at least is within the limit itself. An item of fewer than
``SHORTEST`` words is too short for walks: cut into one piece more than edits are
allowed, one piece must stand in the text word for word, and the same exact check follows.

Items are indexed in blocks of bounded size, dealt by id and text, as many of them in one pass
over the texts as ``PASS_BYTES`` of index hold. Where one pass does not do, what each finds is
written and its broadcast is freed before the next begins.

Defined results: null and empty texts and items have no words and no leaks, and an empty
table of either leaves no leaks and all rows clean. Repeated rows are each reported; an item
found more than once in a text is reported once, with its least distance and, of those, its
first place: the least word at which an alignment with so few edits may begin. Items of one
id, or without one, count as one item, of which the text nearest to the document is
reported; repeated items count once. Very long texts are looked at whole; a very long
item costs about twice its words squared for each place it may stand at. Columns other
than id and text are not looked at, whatever their names; ``clean`` keeps them.
"""

from __future__ import annotations

import pickle
import sys
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geoweave.llm import text as tx
from geoweave.scratch import forget, materialize

cloudpickle.register_pickle_by_value(sys.modules[__name__])

PERCENT = 20
SHORTEST, LONGEST = 8, 256
WALKS, SAMPLES, STEPS = 6, 6, 4
#: Bytes of items that one index is built of, and of the indexes that one pass over the texts looks at.
BLOCK_BYTES, PASS_BYTES = 2 << 20, 256 << 20
#: An edit outweighs any place in a window: costs carry the place where their alignment begins.
EDIT = np.int64(1) << np.int64(32)
#: Equal findings of repeated rows that are written out as one array.
COPIES = 1 << 16
TABLE_BITS, PAIR_BITS = 22, 20


def class_size(n: int) -> int:
    size = SHORTEST
    while size * 5 // 4 <= n:
        size = size * 5 // 4
    return size


def allowed(n: int, percent: int) -> int:
    return n * percent // 100


def walk(bits: np.ndarray, at: np.ndarray, stop: np.ndarray, steps: np.ndarray, hashes: np.ndarray) -> list[np.ndarray]:
    """Words written at ``steps`` (ascending) by the walks that begin at ``at`` and write padding from ``stop`` on.

    ``bits`` and ``hashes`` have one entry more than there are words: the padding.
    """
    pad = np.int32(len(hashes) - 1)
    pos = at.copy()
    written = []
    wanted = set(steps.tolist())
    for t in range(int(steps[-1]) + 1):
        here = np.where(pos < stop, pos, pad)
        if t in wanted:
            written.append(hashes[here])
        pos += ((bits[here] >> np.uint64(t % 61)) & np.uint64(1)).astype(pos.dtype)
    return written


class Plan:
    """For a window size: the steps that each sample of each walk looks at."""

    def __init__(self, size: int):
        rng = np.random.RandomState(size * 7919 + 17)
        self.samples = [[np.sort(rng.choice(2 * size, STEPS, replace=False)) for _ in range(SAMPLES)] for _ in range(WALKS)]
        self.steps = [np.unique(np.concatenate(s)) for s in self.samples]

    def keys(self, hashes: np.ndarray, bits: list[np.ndarray], at: np.ndarray, stop: np.ndarray) -> Iterator[np.ndarray]:
        for k in range(WALKS):
            written = dict(zip(self.steps[k].tolist(), walk(bits[k], at, stop, self.steps[k], hashes)))
            for j, sample in enumerate(self.samples[k]):
                key = np.full(len(at), np.uint64(k * SAMPLES + j + 1))
                for t in sample:
                    key = tx.mix(key * np.uint64(0x9DDFEA08EB382D69) + written[int(t)])
                yield key


def pair_hash(hashes: np.ndarray) -> np.ndarray:
    return tx.mix(hashes[:-1] * np.uint64(0x9DDFEA08EB382D69) + hashes[1:])


def joined(words: list[np.ndarray]) -> np.ndarray:
    """Hashes of words at several places, in order."""
    key = np.full(len(words[0]), np.uint64(len(words)))
    for h in words:
        key = tx.mix(key * np.uint64(0x9DDFEA08EB382D69) + h)
    return key


def walk_bits(hashes: np.ndarray) -> list[np.ndarray]:
    return [tx.mix(hashes ^ np.uint64(0x1234567 * (2 * k + 1))) for k in range(WALKS)]


class Index:
    """Signatures of the windows of a block of items."""

    def __init__(self, items: list[tuple[object, str]], percent: int):
        self.percent = percent
        self.ids: list[object] = []
        self.words: list[np.ndarray] = []
        short: list[int] = []
        parts: dict[int, list[tuple[int, int, np.ndarray]]] = {}  # by class: item, place in the item, words
        self.vocabulary = np.zeros(1 << TABLE_BITS, bool)
        shift = np.uint64(64 - TABLE_BITS)
        for item_id, text in items:
            data = np.frombuffer((text or "").encode(), np.uint8)
            h = tx.Words(data, np.array([0, len(data)]), tx.ALNUM, True).hash
            if not len(h):
                continue
            k, place = len(self.ids), 0
            self.ids.append(item_id)
            self.words.append(h)
            if len(h) < SHORTEST:
                short.append(k)
                continue
            self.vocabulary[(h >> shift).astype(np.int64)] = True
            for part in np.array_split(h, -(-len(h) // LONGEST)):
                parts.setdefault(class_size(len(part)), []).append((k, place, part))
                place += len(part)
        self.short = self.pieces(short)
        self.classes = []
        for size, members in sorted(parts.items()):
            plan = Plan(size)
            words = np.concatenate([*(part for _, _, part in members), np.zeros(1, np.uint64)])
            first = np.concatenate([[0], np.cumsum([len(part) for _, _, part in members])])
            starts = [np.arange(f, f + len(part) - size + 1) for (_, _, part), f in zip(members, first)]
            counts = [len(s) for s in starts]
            at = np.concatenate(starts)
            item = np.repeat([k for k, _, _ in members], counts).astype(np.int32)
            offset = (at - np.repeat(first[:-1], counts) + np.repeat([place for _, place, _ in members], counts)).astype(np.int32)
            keys = np.concatenate(list(plan.keys(words, walk_bits(words), at, at + size)))
            order = np.argsort(keys, kind="stable")
            table = np.zeros(1 << TABLE_BITS, bool)
            table[(keys >> shift).astype(np.int64)] = True
            pairs = np.zeros(1 << PAIR_BITS, bool)
            for _, _, part in members:
                pairs[(pair_hash(part) >> np.uint64(64 - PAIR_BITS)).astype(np.int64)] = True
            longest = max(len(part) for _, _, part in members)
            repeat = WALKS * SAMPLES
            self.classes.append((size, plan, pairs, allowed(longest, percent), keys[order], np.tile(item, repeat)[order], np.tile(offset, repeat)[order], table))

    def pieces(self, short: list[int]) -> list[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """(words, sorted hashes, items, places in the item) of the pieces of short items, by number of words."""
        made: dict[int, list[tuple[int, int, int]]] = {}
        for k in short:
            place = 0
            for piece in np.array_split(self.words[k], allowed(len(self.words[k]), self.percent) + 1):
                if len(piece):
                    made.setdefault(len(piece), []).append((int(joined(piece[:, None])[0]), k, place))
                place += len(piece)
        return [(size, *(np.array(x, t) for x, t in zip(zip(*sorted(rows)), (np.uint64, np.int64, np.int64)))) for size, rows in sorted(made.items())]

    def short_candidates(self, w: tx.Words) -> Iterator[tuple[int, int, int]]:
        """Short items, where they may begin, and in which text."""
        for size, hashes, items, places in self.short:
            at = np.arange(max(0, len(w.hash) - size + 1))
            at = at[w.doc[at] == w.doc[at + size - 1]]
            h = joined([w.hash[at + q] for q in range(size)])
            lo, hi = np.searchsorted(hashes, h), np.searchsorted(hashes, h, side="right")
            for i in np.flatnonzero(hi > lo):
                for e in range(lo[i], hi[i]):
                    yield int(items[e]), int(at[i]) - int(places[e]), int(w.doc[at[i]])

    def candidates(self, w: tx.Words, hashes: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """Other items, where they may begin, and in which text."""
        shift = np.uint64(64 - TABLE_BITS)
        known = np.zeros(len(w.hash) + 1, np.int32)
        np.cumsum(self.vocabulary[(w.hash >> shift).astype(np.int64)], out=known[1:])
        paired = np.zeros(len(w.hash) + 1, np.int32)  # pairs that begin before a word
        pair = (pair_hash(w.hash) >> np.uint64(64 - PAIR_BITS)).astype(np.int32)
        end = w.first[1:].astype(np.int32)[w.doc]
        every = np.arange(len(w.hash), dtype=np.int32)
        bits = None
        for size, plan, pairs, edits, keys, items, places, table in self.classes:
            np.cumsum(pairs[pair], out=paired[1:-1])
            paired[-1] = paired[-2]
            stop = np.minimum(every + np.int32(size), end)
            at = np.flatnonzero((paired[stop - 1] - paired[:-1] >= size - 1 - 2 * edits) & (known[stop] - known[:-1] >= size - edits) & (stop - every >= size - edits)).astype(np.int32)
            if not len(at):
                continue
            bits = walk_bits(hashes) if bits is None else bits
            for key in plan.keys(hashes, bits, at, stop[at]):
                maybe = np.flatnonzero(table[(key >> shift).astype(np.int64)])
                lo, hi = np.searchsorted(keys, key[maybe]), np.searchsorted(keys, key[maybe], side="right")
                for i in np.flatnonzero(hi > lo):
                    p = int(at[maybe[i]])
                    for e in range(lo[i], hi[i]):
                        yield int(items[e]), p - int(places[e]), int(w.doc[p])

    def find(self, data: np.ndarray, offsets: np.ndarray) -> list[tuple[int, int, int, int]]:
        """(row, item, edits, first word) of a slice, one for each row and item."""
        w = tx.Words(data, offsets, tx.ALNUM, True)
        if not len(w.hash):
            return []
        hashes = np.append(w.hash, np.uint64(0))
        places: dict[int, set[tuple[int, int]]] = {}
        for some in (self.short_candidates(w), self.candidates(w, hashes)):
            for k, start, d in some:
                places.setdefault(k, set()).add((d, start))
        found: dict[tuple[int, object], tuple[int, int, int, int]] = {}
        for k, at in places.items():
            for d, dist, place in self.check(k, sorted(at), w, hashes):
                key, new = (d, self.ids[k]), (dist, place, len(self.words[k]), k)
                found[key] = min(new, found.get(key, new))
        return [(d, k, dist, place) for (d, _), (dist, place, _, k) in sorted(found.items(), key=lambda x: (x[0][0], x[1][3]))]

    def check(self, k: int, at: list[tuple[int, int]], w: tx.Words, hashes: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """(row, edits, first word) where item k is within the limit of the text around one of the places (row, start)."""
        item = self.words[k]
        n, limit = len(item), allowed(len(item), self.percent)
        apart: list[tuple[int, int]] = []  # one place stands for those up to ``limit`` behind it
        for d, start in at:
            if not apart or apart[-1][0] != d or start > apart[-1][1] + limit:
                apart.append((d, start))
        wide = n + 4 * limit
        own = np.zeros(1 << 12, bool)
        own[(item >> np.uint64(52)).astype(np.int64)] = True
        block = max(1, min(512, (1 << 20) // wide))
        for a in range(0, len(apart), block):
            d, s = (np.array(x) for x in zip(*apart[a : a + block]))
            where = s[:, None] - limit + np.arange(wide)
            inside = (where >= w.first[d][:, None]) & (where < w.first[d + 1][:, None])
            window = np.where(inside, hashes[np.clip(where, 0, len(w.hash))], np.uint64(0))
            # a text within the limit holds at least n - limit words of the item; the table may count some too many
            near = np.flatnonzero((own[(window >> np.uint64(52)).astype(np.int64)] & inside).sum(axis=1) >= n - limit)
            if not len(near):
                continue
            d, where, window = d[near], where[near], window[near]
            row = np.tile(np.arange(wide + 1, dtype=np.int64), (len(near), 1))  # the item may begin anywhere
            step = np.arange(wide + 1) * EDIT
            for word in item:
                best = row + EDIT
                np.minimum(best[:, 1:], row[:, :-1] + (window != word) * EDIT, out=best[:, 1:])
                row = np.minimum.accumulate(best - step, axis=1) + step
            best = row.min(axis=1)
            dist, begins = best // EDIT, best % EDIT
            for j in np.flatnonzero(dist <= limit):
                yield int(d[j]), int(dist[j]), max(0, int(where[j, 0] + begins[j] - w.first[d[j]]))


def passes(benchmark: DataFrame, percent: int, block_bytes: int = BLOCK_BYTES, pass_bytes: int = PASS_BYTES) -> Iterator[list[bytes]]:
    """Pickled indexes, for one pass each; the items of one index take about ``block_bytes``, whatever their ids.

    A pass takes indexes up to ``pass_bytes``, and one at least. They are pickled by value:
    executors need numpy and pyarrow, not this repository.
    """
    items = benchmark.select("item_id", "text").filter("text IS NOT NULL").distinct()
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    count = -(-total // block_bytes)
    blocks = items.withColumn("block", F.pmod(F.xxhash64("item_id", "text"), F.lit(count)))
    if count > 1:  # a block is read from its own part of the table
        blocks = materialize(blocks.repartitionByRange("block").sortWithinPartitions("block"), "items")
    taken: list[bytes] = []
    for k in range(count):
        part = blocks.filter(F.col("block") == k).collect()
        if not part:
            continue
        index = cloudpickle.dumps(Index(sorted(((r["item_id"], r["text"]) for r in part), key=lambda x: (str(x[0]), x[1])), percent))
        if taken and sum(map(len, taken)) + len(index) > pass_bytes:
            yield taken
            taken = []
        taken.append(index)
    if taken:
        yield taken
    if count > 1:
        forget(blocks)


def nearest(indexes: list[Index], data: np.ndarray, offsets: np.ndarray) -> list[tuple[int, int, int, int, int]]:
    """(row, number of the item among all, its words, edits, first word) of a slice, one for each row and id."""
    best: dict[tuple[int, object], tuple[int, int, int, int]] = {}
    base = 0
    for index in indexes:
        for d, k, dist, place in index.find(data, offsets):
            new = (dist, place, len(index.words[k]), base + k)
            key = (d, index.ids[k])
            best[key] = min(new, best.get(key, new))
        base += len(index.ids)
    return [(d, k, n, dist, place) for (d, _), (dist, place, n, k) in best.items()]


def leaks(documents: DataFrame, benchmark: DataFrame, percent: int = PERCENT, block_bytes: int = BLOCK_BYTES, pass_bytes: int = PASS_BYTES) -> DataFrame:
    """(doc_id, item_id, n_item_words, edits, first_word): the items found in each text, and how far from the item."""
    kind, item_kind = dict(documents.dtypes)["doc_id"], dict(benchmark.dtypes)["item_id"]
    schema = f"doc_id {kind}, item_id {item_kind}, n_item_words long, edits long, first_word long, text_key long"
    names = ["doc_id", "item_id", "n_item_words", "edits", "first_word", "text_key"]
    spark = documents.sparkSession
    texts = documents.select("text", "doc_id", F.xxhash64("text").alias("text_key"))

    def search(shared) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            indexes = [pickle.loads(x) for x in shared.value]
            ids = pa.array([x for index in indexes for x in index.ids])
            for b in batches:
                for i, _, data, offsets in tx.slices(b.column(0)):
                    got = nearest(indexes, data, offsets)
                    if got:
                        row, item, *rest = (pa.array(x, pa.int64()) for x in zip(*got))
                        row = pc.add(row, i)
                        yield pa.RecordBatch.from_arrays([b.column(1).take(row), ids.take(item), *rest, b.column(2).take(row)], names)

        return texts.mapInArrow(run, schema)

    payloads = passes(benchmark, percent, block_bytes, pass_bytes)
    payload, done = next(payloads, None), []
    while payload is not None:
        following = next(payloads, None)
        shared = spark.sparkContext.broadcast(payload)
        if following is None and not done:
            return search(shared).drop("text_key")
        done.append(materialize(search(shared).withColumn("pass", F.lit(len(done))), "leaks"))
        shared.destroy()
        payload = following
    if not done:
        return spark.createDataFrame([], schema).drop("text_key")
    return merged(reduce(DataFrame.unionByName, done))


def merged(found: DataFrame) -> DataFrame:
    """The nearest finding of all passes for each row and id; repeated rows of one text found the same in each pass."""
    row = ["doc_id", "text_key", "item_id"]
    each = found.groupBy(*row, "pass").agg(F.min(F.struct("edits", "first_word", "n_item_words")).alias("best"), F.count("*").alias("n"))
    best = each.groupBy(*row).agg(F.min("best").alias("best"), F.max("n").alias("n"))
    parts = best.select(*row, "best", F.explode(F.expr(f"transform(sequence(0, (n - 1) div {COPIES}), k -> least({COPIES}, n - k * {COPIES}))")).alias("n"))
    copies = parts.select(*row, "best", F.explode(F.sequence(F.lit(1).cast("long"), "n")))
    return copies.select("doc_id", "item_id", "best.n_item_words", "best.edits", "best.first_word")


def clean(documents: DataFrame, benchmark: DataFrame, percent: int = PERCENT, block_bytes: int = BLOCK_BYTES, pass_bytes: int = PASS_BYTES) -> DataFrame:
    """The rows of ``documents`` in whose text no item is found; all columns stay as they are."""
    column = documents.columns.index("text")

    def without(rows: DataFrame, shared) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            indexes = [pickle.loads(x) for x in shared.value]
            for b in batches:
                keep = np.ones(b.num_rows, bool)
                for i, _, data, offsets in tx.slices(b.column(column)):
                    for index in indexes:
                        for row, *_ in index.find(data, offsets):
                            keep[i + row] = False
                yield b.filter(pa.array(keep))

        return rows.mapInArrow(run, rows.schema)

    payloads = passes(benchmark, percent, block_bytes, pass_bytes)
    payload, rows = next(payloads, None), documents
    while payload is not None:
        following = next(payloads, None)
        shared = documents.sparkSession.sparkContext.broadcast(payload)
        left = without(rows, shared)
        if following is None:
            return left
        left = materialize(left, "clean")
        shared.destroy()
        if rows is not documents:
            forget(rows)
        payload, rows = following, left
    return rows
