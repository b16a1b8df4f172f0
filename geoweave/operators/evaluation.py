"""Results against ground truth."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def outcomes(found: DataFrame, truth: DataFrame) -> DataFrame:
    """(map_id, text, outcome): tp, fp or fn; both inputs hold map_id and text, each pair counts once."""
    a = found.select("map_id", "text", F.lit(True).alias("f")).distinct()
    b = truth.select("map_id", "text", F.lit(True).alias("t")).distinct()
    return a.join(b, ["map_id", "text"], "full_outer").select("map_id", "text", F.when(F.col("f") & F.col("t"), "tp").when(F.col("f"), "fp").otherwise("fn").alias("outcome"))


def counts(outcome: DataFrame) -> DataFrame:
    """tp, fp and fn by map, and of all maps in the row whose map_id is null."""
    n = lambda k: F.count_if(F.col("outcome") == k).alias(k)
    return outcome.rollup("map_id").agg(n("tp"), n("fp"), n("fn"))


def differences(outcome: DataFrame) -> DataFrame:
    """By map the sorted lists of missed and surplus texts."""
    texts = lambda k: F.array_join(F.array_sort(F.collect_list(F.when(F.col("outcome") == k, F.col("text")))), ",")
    return outcome.groupBy("map_id").agg(texts("fn").alias("missed"), texts("fp").alias("surplus"))


def totals(outcome: DataFrame, timings: DataFrame, known: DataFrame) -> DataFrame:
    """(variant, seconds, verdict): a variant's reading time, and PASS if it missed nothing and found nothing new that is wrong.

    outcome has `variant`; timings: variant, map_id, seconds; known: map_id and text of what is known to be found wrongly.
    """
    bad = outcome.filter("outcome <> 'tp'").join(known.withColumn("known", F.lit(True)), ["map_id", "text"], "left").filter("outcome = 'fn' OR known IS NULL")
    failed = bad.groupBy("variant").agg(F.lit(True).alias("failed"))
    spent = timings.groupBy("variant").agg(F.sum("seconds").alias("seconds"))
    return spent.join(failed, "variant", "left").select("variant", F.round("seconds", 1).alias("seconds"), F.when(F.col("failed"), "FAIL").otherwise("PASS").alias("verdict"))


def variants(outcome: DataFrame) -> DataFrame:
    """By variant: counts, precision, recall, and whether all maps are perfect; outcome also has `variant`."""
    n = lambda k: F.count_if(F.col("outcome") == k)
    return outcome.groupBy("variant").agg(n("tp").alias("tp"), n("fp").alias("fp"), n("fn").alias("fn"), F.round(n("tp") / F.nullif(n("tp") + n("fp"), F.lit(0)), 6).alias("precision"), F.round(n("tp") / F.nullif(n("tp") + n("fn"), F.lit(0)), 6).alias("recall"), F.bool_and(F.col("outcome") == "tp").alias("perfect"))
