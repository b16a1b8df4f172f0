"""Mixing sources to target weights by temperature.

A source's natural share p of all tokens becomes a weight p^a / sum(p^a). The
exponent a between 0 (equal weights) and 1 (natural weights) is bisected to meet
a target entropy of the weights, or the largest exponent reduction under which no
source is repeated more than a limit; each step of the search is one aggregation
over the table of sources, which stays distributed.

The weights are realised as block permutations under a token budget. A source's
documents are dealt into blocks by a hash; in every epoch the blocks have a new
order, and documents are taken in that order until the source's budget is used
up: all blocks in whole epochs, and in the last one the blocks before a cut. The
cut is at a whole block, so a source misses its budget by under one block.

Defined results: null sources are one source; null and empty texts have no
tokens and are taken as often as their block. Sources without tokens have weight
0 and none of their documents is taken. Repeated rows are taken alike. Where even the
natural weights would repeat a source more often than the limit allows, the exponent is
1, no source is taken more often than the limit, and the budget is missed: the plan's
`missed` column says by how many tokens each source falls short. Very long texts count
with all their words. A document's columns are carried whatever their names. An empty
table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from geoweave.scratch import materialize

#: Entropy to meet, as a part of the way from the natural entropy to that of equal weights.
ENTROPY_GAIN = 0.5
MAX_EPOCHS = 4.0
BLOCKS = 256
#: Up to so many sources are broadcast (about 100 bytes each); beyond, they are joined by a shuffle.
BROADCAST_SOURCES = 20_000
WORD = r"[^\x20\x09-\x0D]+"


def tokens(text: str = "text"):
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def source_name():
    return F.coalesce(F.col("source").cast("string"), F.lit(""))


def measures(sources: DataFrame, exponents: list[float], budget: float) -> dict[float, tuple[float, float]]:
    """Entropy of the weights and the largest repetition, by exponent."""
    a = F.explode(F.array(*[F.lit(x) for x in exponents])).alias("a")
    each = sources.select("n", "p", a).select("a", "n", F.pow("p", F.col("a")).alias("w"), F.log("p").alias("logp"))
    z = F.sum("w")
    rows = each.groupBy("a").agg((F.log(z) - F.sum(F.col("w") * F.col("a") * F.col("logp")) / z).alias("h"), (F.max(F.col("w") / F.col("n")) * budget / z).alias("r")).collect()
    return {r["a"]: (r["h"], r["r"]) for r in rows}


def fit_exponent(sources: DataFrame, budget: float, entropy_gain: float, max_epochs: float, rounds: int = 4, parts: int = 32) -> float:
    """The least exponent in [0, 1] whose entropy is at most the target and whose repetitions are within the limit.

    Entropy and repetitions fall as the exponent grows, so the fitting exponents
    are those above a bound; each round tries ``parts`` exponents at once.
    """
    ends = measures(sources, [0.0, 1.0], budget)
    target = ends[1.0][0] + entropy_gain * (ends[0.0][0] - ends[1.0][0])
    fits = lambda m: m[0] <= target + 1e-12 and m[1] <= max_epochs + 1e-12
    lo, hi = 0.0, 1.0
    if fits(ends[0.0]):
        return 0.0
    for _ in range(rounds):
        tried = [lo + (hi - lo) * k / parts for k in range(parts + 1)]
        got = measures(sources, tried, budget)
        first = next((k for k in range(1, parts + 1) if fits(got[tried[k]])), parts)
        lo, hi = tried[first - 1], tried[first]
    return hi


def order_key(seed: int, epoch, source, block):
    """A block's place in its source's permutation of an epoch, from 0 to 1."""
    return F.pmod(F.xxhash64(F.lit(seed), epoch, source, block), F.lit(1 << 50)) / float(1 << 50)


def plan(documents: DataFrame, budget: float | None = None, entropy_gain: float = ENTROPY_GAIN, max_epochs: float = MAX_EPOCHS, blocks: int = BLOCKS, seed: int = 11) -> DataFrame:
    """(source, n, weight, missed, epochs, cut): whole epochs of each source, the cut of the epoch after them, and tokens missed for the repetition limit."""
    named = documents.select(source_name().alias("source"), tokens().alias("n"), block_of(seed, blocks).alias("block"))
    per_block = materialize(named.groupBy("source", "block").agg(F.sum("n").alias("n")), "blocks")
    counted = per_block.groupBy("source").agg(F.sum("n").alias("n")).filter("n > 0")
    total = counted.agg(F.sum("n")).first()[0] or 0
    if not total:
        return documents.sparkSession.createDataFrame([], "source string, n long, weight double, missed double, epochs int, cut double")
    sources = materialize(counted.withColumn("p", F.col("n") / F.lit(float(total))), "sources")
    budget = float(total if budget is None else budget)
    a = fit_exponent(sources, budget, entropy_gain, max_epochs)
    z = sources.agg(F.sum(F.pow("p", F.lit(a)))).first()[0]
    wanted = sources.select("source", "n", (F.pow("p", F.lit(a)) / F.lit(z)).alias("weight")).withColumn("asked", F.col("weight") * budget / F.col("n"))
    wanted = wanted.withColumn("share", F.least("asked", F.lit(float(max_epochs)))).withColumn("missed", (F.col("asked") - F.col("share")) * F.col("n")).withColumn("epochs", F.floor("share").cast("int"))
    # the last epoch: blocks in their order until the rest of the budget is used up
    last = per_block.join(wanted, "source").select("source", per_block["n"].alias("m"), "epochs", ((F.col("share") - F.col("epochs")) * wanted["n"]).alias("rest"), order_key(seed, F.col("epochs"), F.col("source"), F.col("block")).alias("key"))
    run = Window.partitionBy("source").orderBy("key").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    cuts = last.withColumn("used", F.sum("m").over(run)).filter("used <= rest").groupBy("source").agg(F.max("key").alias("cut"))
    return wanted.select("source", "n", "weight", "missed", "epochs").join(cuts, "source", "left").withColumn("cut", F.coalesce("cut", F.lit(-1.0)))


def block_of(seed: int, blocks: int):
    return F.pmod(F.xxhash64(F.lit(seed), F.col("doc_id"), F.col("text")), F.lit(blocks)).cast("int")


def mix(documents: DataFrame, seed: int = 11, blocks: int = BLOCKS, **limits) -> DataFrame:
    """(row, source, weight, block, epoch, place): every row, as a struct, as often as it is taken; place is its block's in that epoch."""
    sources = materialize(plan(documents, blocks=blocks, seed=seed, **limits), "plan").select("source", "weight", "epochs", "cut")
    small = sources.limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES
    rows = documents.select(source_name().alias("source"), block_of(seed, blocks).alias("block"), F.struct(*[F.col(f"`{c}`") for c in documents.columns]).alias("row"))
    taken = rows.join(F.broadcast(sources) if small else sources, "source")
    last = order_key(seed, F.col("epochs"), F.col("source"), F.col("block")) <= F.col("cut")
    taken = taken.withColumn("copies", F.col("epochs") + last.cast("int")).filter("copies > 0").withColumn("epoch", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)))
    return taken.select("row", "source", "weight", "block", "epoch", order_key(seed, F.col("epoch"), F.col("source"), F.col("block")).alias("place"))


def mixed_ids(documents: DataFrame, **limits) -> DataFrame:
    """doc_id, source, n_tokens, weight, block, epoch and place of every row, as often as it is taken."""
    narrow = mix(documents.select("doc_id", "text", "source"), **limits)
    return narrow.select("row.doc_id", "source", tokens("row.text").alias("n_tokens"), "weight", "block", "epoch", "place")


def mixed_documents(documents: DataFrame, **limits) -> DataFrame:
    """The columns of ``documents``, every row as often as it is taken."""
    return mix(documents, **limits).select("row.*")
