"""Language identification by a byte convolutional network.

Texts are cut into windows of a fixed number of bytes. Filters of several widths
run over the embedded bytes of a window, each filter's largest response is kept,
and a softmax layer gives the languages' probabilities; a text's probability is
the mean over its windows, weighted by their bytes. The network is trained in
numpy with Adam on a bounded, documented sample of labelled rows; windows of
every whole text are then classified inside the tasks.

Defined results: `und` with score 0 where the text is null or has no letter, or
where there was nothing to learn from; ties go to the language that sorts first.
A null doc_id counts as not held out and is not learned from. Very long texts are
classified whole, window by window. Repeated rows are predicted like others. Columns
that the network does not need are carried along whatever their names. An empty table
gives no rows.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geoweave.llm import text as tx
from geoweave.llm.names import free
from geoweave.llm.sample import hash_sample

cloudpickle.register_pickle_by_value(sys.modules[__name__])

WINDOW = 256
WIDTHS = (2, 3, 4)
FILTERS = 16
EMBEDDING = 8
#: Bound of the training sample: documents, and windows of each.
SAMPLE_DOCS, SAMPLE_WINDOWS = 6_000, 2
EPOCHS = 6

ASCII_LETTER = ((np.arange(256) | 0x20) >= 0x61) & ((np.arange(256) | 0x20) <= 0x7A) & (np.arange(256) < 0x80)


@dataclass
class Network:
    languages: list[str]
    embedding: np.ndarray  # (256, EMBEDDING)
    filters: dict[int, np.ndarray]  # width: (width, EMBEDDING, FILTERS)
    bias: np.ndarray  # (len(WIDTHS) * FILTERS,)
    out: np.ndarray
    out_bias: np.ndarray


def held_out(doc_id: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def training_sample(documents: DataFrame, docs: int = SAMPLE_DOCS, windows: int = SAMPLE_WINDOWS) -> list[tuple[bytes, str]]:
    """At most ``docs`` times ``windows`` pieces of labelled texts outside the held-out fold, chosen by a hash."""
    usable = documents.filter("doc_id IS NOT NULL AND lang IS NOT NULL").filter(~held_out())
    rows = usable.select("doc_id", "text", "lang").filter("text IS NOT NULL")
    pieces = [F.expr(f"substring(text, 1 + cast(pmod(xxhash64(doc_id, {k}), greatest(length(text) - {WINDOW}, 1)) as int), {WINDOW})").alias(f"p{k}") for k in range(windows)]
    # narrow rows reach the sort: pieces and the language, never whole texts
    taken = hash_sample(rows.select("doc_id", "lang", *pieces), docs, usable.select("doc_id", "lang"))
    return [(r[f"p{k}"].encode()[:WINDOW], r["lang"]) for r in taken for k in range(windows) if any(c.isalpha() for c in r[f"p{k}"])]


def train(sample: list[tuple[bytes, str]], epochs: int = EPOCHS, seed: int = 7, batch: int = 64) -> Network | None:
    languages = sorted({lang for _, lang in sample})
    if not languages:
        return None
    rng = np.random.RandomState(seed)
    number = {lang: i for i, lang in enumerate(languages)}
    x = np.zeros((len(sample), WINDOW), np.uint8)
    for i, (piece, _) in enumerate(sample):
        x[i, : len(piece)] = np.frombuffer(piece, np.uint8)
    y = np.array([number[lang] for _, lang in sample])
    par = {"e": rng.normal(0, 0.5, (256, EMBEDDING)), "b": np.zeros(len(WIDTHS) * FILTERS), "o": rng.normal(0, 0.1, (len(WIDTHS) * FILTERS, len(languages))), "c": np.zeros(len(languages))}
    par |= {f"f{w}": rng.normal(0, 1 / np.sqrt(w * EMBEDDING), (w * EMBEDDING, FILTERS)) for w in WIDTHS}
    par = {k: v.astype(np.float32) for k, v in par.items()}
    mean, square = ({k: np.zeros_like(v) for k, v in par.items()} for _ in range(2))
    step = 0
    for _ in range(epochs):
        order = rng.permutation(len(x))
        for at in range(0, len(x), batch):
            rows = order[at : at + batch]
            xb, yb = x[rows], y[rows]
            n = len(rows)
            emb = par["e"][xb]
            pooled, where = [], []
            for w in WIDTHS:
                wide = np.concatenate([emb[:, k : WINDOW - w + 1 + k] for k in range(w)], axis=2)
                r = wide @ par[f"f{w}"]
                top = r.argmax(axis=1)
                where.append(top)
                pooled.append(np.take_along_axis(r, top[:, None], 1)[:, 0])
            pre = np.concatenate(pooled, 1) + par["b"]
            hidden = np.maximum(pre, 0)
            logits = hidden @ par["o"] + par["c"]
            p = np.exp(logits - logits.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            p[np.arange(n), yb] -= 1
            p /= n
            grad = {"o": hidden.T @ p, "c": p.sum(0), "e": np.zeros_like(par["e"])}
            back = (p @ par["o"].T) * (pre > 0)
            grad["b"] = back.sum(0)
            for i, w in enumerate(WIDTHS):
                g = back[:, i * FILTERS : (i + 1) * FILTERS]
                at_bytes = xb[np.arange(n)[:, None, None], where[i][:, :, None] + np.arange(w)]  # (n, FILTERS, w)
                seen = par["e"][at_bytes].reshape(n, FILTERS, w * EMBEDDING)
                grad[f"f{w}"] = np.einsum("nf,nfk->kf", g, seen)
                to = (g[:, :, None] * par[f"f{w}"].T[None]).reshape(n, FILTERS, w, EMBEDDING)
                np.add.at(grad["e"], at_bytes, to)
            step += 1
            for k, g in grad.items():
                mean[k] = 0.9 * mean[k] + 0.1 * g
                square[k] = 0.999 * square[k] + 0.001 * g * g
                par[k] -= (0.004 * (mean[k] / (1 - 0.9**step)) / (np.sqrt(square[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    return Network(languages, par["e"], {w: par[f"f{w}"].reshape(w, EMBEDDING, FILTERS) for w in WIDTHS}, par["b"], par["o"], par["c"])


class Classifier:
    """The trained filters as tables over byte pairs: a response is two table rows added, the embedding and product are done beforehand."""

    def __init__(self, net: Network):
        self.net = net
        single = {w: [net.embedding @ net.filters[w][k] for k in range(w)] for w in WIDTHS}
        pair = lambda w, k: (single[w][k][:, None] + single[w][k + 1][None]).reshape(65536, FILTERS)
        self.first = np.ascontiguousarray(np.concatenate([pair(w, 0) for w in WIDTHS], 1), np.float32)
        third = np.repeat(single[3][2], 256, axis=0)
        self.second = np.ascontiguousarray(np.concatenate([third, pair(4, 2)], 1), np.float32)

    def windows(self, x: np.ndarray, block: int = 32) -> np.ndarray:
        """Probabilities by window; x: (windows, WINDOW) bytes."""
        pooled = np.empty((len(x), self.first.shape[1]), np.float32)
        for i in range(0, len(x), block):
            b = x[i : i + block].astype(np.int32)
            pairs = b[:, :-1] * 256 + b[:, 1:]
            r = np.take(self.first, pairs, axis=0)
            r[:, :-2, FILTERS:] += np.take(self.second, pairs[:, 2:], axis=0)
            r[:, -2:, 2 * FILTERS :] = -np.inf  # width 4 doesn't fit here
            r[:, -1, FILTERS:] = -np.inf
            # the last place of width 3 has no pair behind it: its third byte is the window's last
            r[:, -2, FILTERS : 2 * FILTERS] += self.second[b[:, -1] * 256, :FILTERS]
            pooled[i : i + block] = r.max(axis=1)
        logits = np.maximum(pooled + self.net.bias, 0) @ self.net.out + self.net.out_bias
        p = np.exp(logits - logits.max(1, keepdims=True))
        return p / p.sum(1, keepdims=True)

    def texts(self, data: np.ndarray, offsets: np.ndarray) -> tuple[list[str], np.ndarray]:
        size = np.diff(offsets)
        count = -(-size // WINDOW)
        first = np.concatenate([[0], np.cumsum(count)])
        x = np.zeros(int(first[-1]) * WINDOW, np.uint8)
        for d in np.flatnonzero(size):
            x[first[d] * WINDOW : first[d] * WINDOW + size[d]] = data[offsets[d] : offsets[d + 1]]
        names, scores = ["und"] * len(size), np.zeros(len(size))
        if not len(x):
            return names, scores
        p = self.windows(x.reshape(-1, WINDOW))
        weight = np.full(len(p), WINDOW)
        full = np.flatnonzero(count)
        weight[first[full + 1] - 1] = size[full] - (count[full] - 1) * WINDOW
        mean = np.add.reduceat(p * weight[:, None], first[full]) / size[full, None]
        ascii_letters = np.add.reduceat(ASCII_LETTER[data], offsets[full].clip(max=max(len(data) - 1, 0)), dtype=np.int64)
        for k, d in enumerate(full):
            if ascii_letters[k] or any(c.isalpha() for c in data[offsets[d] : offsets[d + 1]].tobytes().decode()):
                best = int(mean[k].argmax())
                names[d], scores[d] = self.net.languages[best], min(1.0, float(mean[k][best]))
        return names, scores


def predict(documents: DataFrame, net: Network | None, carry: list[str]) -> DataFrame:
    """The ``carry`` columns of every row and, last, its language and score; only the text is looked at."""
    types = dict(documents.dtypes)
    lang, certainty = free(carry, "lang_pred"), free(carry, "score")
    names = [*carry, lang, certainty]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Classifier(net) if net else None
        for b in batches:
            langs: list[str] = []
            scores: list[np.ndarray] = []
            for i, j, data, offsets in tx.slices(b.column(0)):
                got, s = model.texts(data, offsets) if model else (["und"] * (j - i), np.zeros(j - i))
                langs += got
                scores.append(s)
            if langs:
                yield pa.RecordBatch.from_arrays([*b.columns[1:], pa.array(langs), pa.array(np.concatenate(scores))], names)

    source = documents.select(F.col("text").alias(free(carry, "text")), *[F.col(f"`{c}`") for c in carry])
    return source.mapInArrow(run, ", ".join([*(f"`{c}` {types[c]}" for c in carry), f"`{lang}` string, `{certainty}` double"]))


def identify(documents: DataFrame, docs: int = SAMPLE_DOCS) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every document."""
    net = train(training_sample(documents, docs))
    return predict(documents, net, ["doc_id"]).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


def keep_identified(documents: DataFrame, least_score: float = 0.4, docs: int = SAMPLE_DOCS) -> DataFrame:
    """The documents whose language was identified with at least ``least_score``; all columns stay as they are."""
    net = train(training_sample(documents, docs))
    columns = documents.columns
    found = predict(documents, net, columns)
    lang, certainty = found.columns[-2:]
    return found.filter((F.col(f"`{lang}`") != "und") & (F.col(f"`{certainty}`") >= least_score)).select(*[F.col(f"`{c}`") for c in columns])
