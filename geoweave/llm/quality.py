"""Quality rules: hashed n-gram log-likelihood ratio of trusted against raw text.

Two multinomials over hashed word unigrams and bigrams are counted: the raw one
over all documents, the trusted one over documents that are labelled good. A
document's score is the mean of log(trusted / raw) over its n-grams; documents
under a threshold that is fixed beforehand are rejected, with no random choice.

A few toxic words hardly move the mean of a long text, so a second ratio is taken
over single words: for each hashed word, the labelled documents that hold it, toxic
against trusted. Only words that speak for toxic count; a document's low score is
the least sum over any ``WINDOW`` words in a row, divided by ``WINDOW``. The floor
parts toxic from trusted best over all labelled documents, each of them scored
without its own part in the counts.

Defined results: a null or empty text has no words, fails the base rules and
scores 0. With no trusted documents every score is 0 and only the base rules
decide; with no toxic ones there is no floor. Repeated rows are scored like any other row. Rows keep their number.
Very long texts are counted and scored whole. Of several labels of one doc_id all must
be good; labels without a doc_id are left out, and rows without one have no label.
Columns besides doc_id and text are not looked at. An empty table gives no rows.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geoweave.llm import text as tx
from geoweave.scratch import materialize

cloudpickle.register_pickle_by_value(sys.modules[__name__])

BUCKETS = 1 << 14
#: This share of trusted documents may fall under the threshold.
TRUSTED_LOSS = 0.005
#: Hashed words of the toxic ratio, words in a window, and documents of the prior.
WORD_BITS, WINDOW, PRIOR = 20, 16, 10

SYMBOLS = np.isin(np.arange(256), np.frombuffer(b"#*$%&|<>", np.uint8))
BASE_SCHEMA = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"


def repeats(doc: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Flags, in the order given: has an equal in its text; has an earlier equal in its text."""
    key = tx.mix(h ^ (doc.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))
    order = np.argsort(key, kind="stable")
    same = key[order][1:] == key[order][:-1]
    some, later = np.zeros(len(h), bool), np.zeros(len(h), bool)
    later[order[1:][same]] = True
    some[order[1:][same]] = True
    some[order[:-1][same]] = True
    return some, later


def base_counts(w: tx.Words) -> dict[str, np.ndarray]:
    data, rows = w.data, w.rows
    n = len(data)
    ends = np.flatnonzero(data == 0x0A)
    start = np.unique(np.concatenate([w.offsets[:-1], ends + 1]))
    start = start[start < n]
    stop = np.append(start[1:], n)
    stop = stop - ((stop > start) & (data[np.maximum(stop, 1) - 1] == 0x0A)) if n else stop
    with_word = np.searchsorted(w.start, stop) > np.searchsorted(w.start, start)
    start, stop = start[with_word], stop[with_word]
    line_doc = np.searchsorted(w.offsets, start, side="right") - 1
    _, later = repeats(line_doc, w.span_hash(start, stop))
    at, h = w.grams(5)
    some, _ = repeats(w.doc[at], h)
    cover = np.zeros(len(w.hash) + 1, np.int64)
    np.add.at(cover, at[some], 1)
    np.add.at(cover, np.minimum(at[some] + 5, len(w.hash)), -1)
    covered = np.cumsum(cover)[:-1] > 0
    return {
        "n_words": w.counts.astype(np.int64),
        "word_chars": w.per_text(w.inside & ((data & 0xC0) != 0x80)),
        "n_symbols": w.per_text(SYMBOLS[data]),
        "n_dup_lines": np.bincount(line_doc[later], minlength=rows).astype(np.int64),
        "n_repeat_words": np.bincount(w.doc[covered], minlength=rows).astype(np.int64),
    }


def gram_buckets(w: tx.Words, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and bucket of every unigram and bigram."""
    shift = np.uint64(64 - int(buckets).bit_length() + 1)
    at, h = w.grams(2)
    return np.concatenate([w.doc, w.doc[at]]), (np.concatenate([tx.mix(w.hash), h]) >> shift).astype(np.int64)


def word_buckets(w: tx.Words) -> np.ndarray:
    return (tx.mix(w.hash) >> np.uint64(64 - WORD_BITS)).astype(np.int64)


def gram_counts(docs: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """(word, bucket, raw, trusted, toxic) over all rows of docs(text, trusted, toxic), read once.

    Where word is false: n-grams of all and of trusted rows. Where it is true:
    trusted and toxic rows with a word of the bucket. Each task sends one row per
    bucket at most.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams, words = np.zeros((3, buckets), np.int64), np.zeros((3, 1 << WORD_BITS), np.int64)
        for b in batches:
            good, bad = (np.asarray(b.column(k).to_numpy(zero_copy_only=False), bool) for k in (1, 2))
            for i, j, data, offsets in tx.slices(b.column(0)):
                doc, bucket = gram_buckets(tx.Words(data, offsets, tx.SPACED, False), buckets)
                grams[0] += np.bincount(bucket, minlength=buckets)
                grams[1] += np.bincount(bucket[good[i:j][doc]], minlength=buckets)
            some = np.flatnonzero(good | bad)
            for i, j, data, offsets in tx.slices(b.column(0).take(pa.array(some))):
                w = tx.Words(data, offsets, tx.ALNUM, True)
                key = np.unique(w.doc << WORD_BITS | word_buckets(w))
                doc, bucket = key >> WORD_BITS, key & ((1 << WORD_BITS) - 1)
                for k, flag in ((1, good), (2, bad)):
                    np.add.at(words[k], bucket[flag[some[i:j]][doc]], 1)
        for word, table in ((False, grams), (True, words)):
            held = np.flatnonzero(table.any(axis=0))
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(held), word)), pa.array(held), *(pa.array(x[held]) for x in table)], ["word", "bucket", "raw", "trusted", "toxic"])

    counts = docs.select("text", "trusted", "toxic").mapInArrow(count, "word boolean, bucket long, raw long, trusted long, toxic long")
    return counts.groupBy("word", "bucket").agg(*(F.sum(c).alias(c) for c in ("raw", "trusted", "toxic")))


def log_ratios(counts: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """log(trusted / raw) by bucket, one added to every count. At most ``buckets`` rows reach the driver."""
    raw, trusted = np.ones(buckets), np.ones(buckets)
    for r in counts.collect():
        raw[r["bucket"]] += r["raw"]
        trusted[r["bucket"]] += r["trusted"]
    return np.log(trusted / trusted.sum()) - np.log(raw / raw.sum()) if trusted.sum() > buckets else np.zeros(buckets)


def toxic_ratios(counts: DataFrame) -> np.ndarray | None:
    """min(0, log(trusted / toxic)) by word bucket, of all documents and of all but one trusted or one toxic that has the word.

    At most 2^``WORD_BITS`` rows reach the driver. None where a class has no words.
    """
    totals = counts.agg(F.sum("trusted"), F.sum("toxic")).first()
    if not totals[0] or not totals[1]:
        return None
    got = counts.filter("toxic > 0").select("bucket", "trusted", "toxic").toArrow()
    bucket, trusted, toxic = (got.column(k).to_numpy() for k in range(3))
    ratios = np.zeros((3, 1 << WORD_BITS), np.float32)
    share = totals[0] / (totals[0] + totals[1])
    for k, (a, b) in enumerate(((trusted, toxic), (np.maximum(trusted - 1, 0), toxic), (trusted, toxic - 1))):
        ratios[k, bucket] = np.minimum(0, np.log((a + PRIOR * share) / totals[0]) - np.log((b + PRIOR * (1 - share)) / totals[1]))
    return ratios


def lowest_window(w: tx.Words, values: np.ndarray) -> np.ndarray:
    """The least mean of ``WINDOW`` words in a row of each text; what lacks in a short text counts as 0."""
    low = np.zeros(w.rows)
    sums = np.concatenate([[0.0], np.cumsum(values, dtype=np.float64)])
    at = np.arange(len(values))
    stop = np.minimum(at + WINDOW, w.first[1:][w.doc])
    np.minimum.at(low, w.doc, (sums[stop] - sums[at]) / WINDOW)
    return low


def floor_of(scores: DataFrame, marked: DataFrame) -> float | None:
    """The low score that parts toxic from trusted documents best: the greatest difference of the shares below it."""
    own = scores.join(marked.filter("trusted OR toxic"), "doc_id")
    step = F.round(1000 * F.when(F.col("toxic"), F.col("low_toxic")).otherwise(F.col("low_trusted"))).cast("int")
    # ratios are bounded, and with them the number of steps
    rows = sorted(own.groupBy(step.alias("step")).agg(F.count_if("toxic").alias("toxic"), F.count_if("trusted").alias("trusted")).collect(), key=lambda r: r["step"])
    toxic, trusted = (np.cumsum([0, *(r[c] for r in rows)]) for c in ("toxic", "trusted"))
    if not toxic[-1] or not trusted[-1]:
        return None
    gain = toxic / toxic[-1] - trusted / trusted[-1]
    best = int(gain.argmax())
    return rows[best - 1]["step"] / 1000 + 0.0005 if best else None


def score(docs: DataFrame, ratios: np.ndarray, carry: list[str], toxic: np.ndarray | None = None) -> DataFrame:
    """The ``carry`` columns of every row with its base counts, its mean log ratio and its low scores."""
    types = dict(docs.dtypes)
    lows = ["low", "low_trusted", "low_toxic"]
    names = [*carry, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "llr", *lows]
    shared = docs.sparkSession.sparkContext.broadcast(toxic)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            parts = []
            for _, _, data, offsets in tx.slices(b.column(0)):
                w = tx.Words(data, offsets, tx.SPACED, False)
                doc, bucket = gram_buckets(w, len(ratios))
                total = np.bincount(doc, weights=ratios[bucket], minlength=w.rows)
                base = base_counts(w)
                low = [np.zeros(w.rows)] * len(lows)
                if shared.value is not None:
                    words = tx.Words(data, offsets, tx.ALNUM, True)
                    bucket = word_buckets(words)
                    low = [lowest_window(words, r[bucket]) for r in shared.value]
                parts.append([*base.values(), total / np.maximum(np.bincount(doc, minlength=w.rows), 1), *low])
            if parts:
                yield pa.RecordBatch.from_arrays([*b.columns[1:], *(pa.array(np.concatenate(x)) for x in zip(*parts))], names)

    return docs.select("text", *carry).mapInArrow(run, ", ".join([*(f"`{c}` {types[c]}" for c in carry), BASE_SCHEMA, "llr double", *(f"{c} double" for c in lows)]))


def marks(labels: DataFrame) -> DataFrame:
    """(doc_id, trusted, toxic) of every labelled document: trusted if all its labels are good and none is toxic."""
    one = labels.filter("doc_id IS NOT NULL").groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("toxic").alias("toxic"))
    return one.select("doc_id", F.expr("coalesce(quality = 1 AND coalesce(toxic, 0) = 0, false)").alias("trusted"), F.expr("coalesce(toxic = 1, false)").alias("toxic"))


def marked_texts(docs: DataFrame, marked: DataFrame) -> DataFrame:
    """text, trusted and toxic of every row. Rows without an id have no label; a salt keeps them from one task."""
    salt = F.when(F.col("doc_id").isNull(), F.crc32(F.coalesce("text", F.lit("")).cast("binary"))).otherwise(0)
    both = docs.withColumn("__salt", salt).join(marked.withColumn("__salt", F.lit(0).cast("long")).hint("merge"), ["doc_id", "__salt"], "left")
    return both.select("text", *(F.coalesce(c, F.lit(False)).alias(c) for c in ("trusted", "toxic")))


def quantile(scores: DataFrame, share: float, steps: int = 1000) -> float:
    """The greatest multiple of 1 / ``steps``, less a half step, that at most ``share`` of the scores lie under; 0 without scores.

    Scores are counted by step, so the result does not depend on any order; log
    ratios are bounded, and with them the number of steps that reach the driver.
    """
    counted = scores.groupBy(F.round(F.col("llr") * steps).cast("int").alias("step")).count().collect()
    rows = sorted((r["step"], r["count"]) for r in counted)
    total, below, found = sum(n for _, n in rows), 0, 0.0
    for step, n in rows:
        if below > share * total:
            break
        found = (step - 0.5) / steps
        below += n
    return found


def quality_filter(documents: DataFrame, labels: DataFrame, buckets: int = BUCKETS, trusted_loss: float = TRUSTED_LOSS, threshold: float | None = None) -> DataFrame:
    """doc_id, base counts, base_failed, llr and kept of every document.

    ``threshold`` is the least score kept. Left out, it is the ``trusted_loss``
    quantile of the scores of all trusted documents.
    """
    docs = documents.select("doc_id", "text")
    marked = marks(labels)
    counts = materialize(gram_counts(marked_texts(docs, marked), buckets), "counts")
    ratios = log_ratios(counts.filter("NOT word"), buckets)
    toxic = toxic_ratios(counts.filter("word"))
    scores = materialize(score(docs, ratios, ["doc_id"], toxic), "scores")
    floor = None if toxic is None else floor_of(scores, marked)
    if threshold is None:
        threshold = quantile(scores.join(marked.filter("trusted"), "doc_id", "left_semi").filter("n_words >= 10"), trusted_loss)
    failed = F.expr("n_words < 10 OR 100 * n_repeat_words > 20 * n_words")
    good = (F.col("llr") >= F.lit(float(threshold))) & (F.lit(True) if floor is None else F.col("low") >= F.lit(floor))
    return scores.withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & good).drop("low", "low_trusted", "low_toxic")
