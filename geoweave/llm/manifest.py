"""Merkle manifest of a dataset: every row is a leaf, every language a tree, all of them one root.

Leaves of a tree are ordered by id and cut into blocks of ``FANOUT`` ** ``LEVELS`` leaves. A
block is one array: its levels are collapsed by sequence, slice and transform inside an
aggregate over the level numbers, and block roots are the leaves of the next pass, until
each tree is one block. Roots of the trees, ordered by language, go through the same passes.
Coming back down, each block root hands its way to the top to the members of its block, by
a join with one row for each block on either side; no task sees more than one block at a
time, however large a tree is.

A proof is the siblings of a leaf's way to the root, level by level, left to right. ``folded_root``
is the root that a reader finds who has a row's content and its proof: it is recomputed from
a tampered copy of the row where there is one.

Defined results: nulls are written as `-`, so a null differs from an empty text. Leaves with
one id are ordered by their digests; rows without an id come first; a repeated row is a
leaf of its own with its own proof. A tree with one leaf is that leaf, and one tree
alone is the root. Very long texts are hashed whole. Columns that are not part of
the leaf do not matter, whatever their names. An empty table has no leaves and gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geoweave.llm.ranks import places
from geoweave.scratch import materialize

#: Children of a node, and levels that are collapsed inside one block.
FANOUT, LEVELS = 8, 3
#: Columns of a leaf in their order.
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def leaf_of(columns: dict[str, Column]) -> Column:
    """Digest (hex) of the named columns: `-` for a null, else byte count, colon, value."""
    parts = [F.col(f"`{f}`") if f not in columns else columns[f] for f in FIELDS]
    texts = [p.cast("string") for p in parts]
    shown = [F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]
    return F.sha2(F.concat(*shown).cast("binary"), 256)


def lowered() -> Column:
    """The text with A-Z lower-cased; ASCII texts take the quick way."""
    other = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.when(F.octet_length("text") == F.char_length("text"), F.lower("text")).otherwise(other)


def tampered_rows() -> Column:
    """Rows whose text is tampered with: three divides the checksum of the id."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0


def leaves(documents: DataFrame) -> DataFrame:
    """tree (the language), doc_id, digest, and the digest of the tampered row, where it is another."""
    own = leaf_of({})
    # the text is lower-cased and hashed again only where it is tampered with
    tampered = F.when(tampered_rows() & F.col("text").isNotNull(), leaf_of({"text": lowered()}))
    return documents.select(
        F.col("lang").cast("string").alias("tree"), F.col("doc_id"),
        F.unhex(own).alias("digest"), F.unhex(tampered).alias("tampered"), F.rand(11).alias("spread"),
    )


def height(total: Column) -> Column:
    """Levels to collapse in a block of a tree of ``total`` nodes: until one is left, ``LEVELS`` at most."""
    steps = F.lit(LEVELS)
    for k in reversed(range(LEVELS)):
        steps = F.when(total <= FANOUT**k, k).otherwise(steps)
    return steps


def collapsed(nodes: Column) -> Column:
    """The level above ``nodes``: every run of ``FANOUT`` becomes its digest."""
    runs = F.sequence(F.lit(0), F.floor((F.size(nodes) - 1) / FANOUT).cast("int"))
    return F.transform(runs, lambda r: F.sha2(F.array_join(F.slice(nodes, r * FANOUT + 1, FANOUT), "").cast("binary"), 256))


def level_numbers(high: Column) -> Column:
    return F.slice(F.sequence(F.lit(0), F.lit(LEVELS - 1)), F.lit(1), high)


def blocks_of(nodes: DataFrame, carried: list[str]) -> DataFrame:
    """Blocks (tree, block, total, high, members, levels) of nodes (tree, place, total, digest and ``carried``)."""
    size = FANOUT**LEVELS
    member = F.struct((F.col("place") % size).cast("int").alias("at"), "digest", *carried)
    found = nodes.groupBy("tree", "total", F.floor(F.col("place") / size).alias("block")).agg(F.sort_array(F.collect_list(member)).alias("members"))
    found = found.withColumn("high", height(F.col("total")))
    bottom = F.array(F.transform("members", lambda m: F.lower(F.hex(m["digest"]))))
    step = lambda levels, _: F.concat(levels, F.array(collapsed(F.element_at(levels, -1))))
    return found.withColumn("levels", F.aggregate(level_numbers(F.col("high")), bottom, step))


def passes(nodes: DataFrame, carried: list[str]) -> list[DataFrame]:
    """Written blocks of every pass: of the nodes, of the roots of their blocks, and so on, until each tree is one block."""
    found, size = [], FANOUT**LEVELS
    while True:
        found.append(materialize(blocks_of(nodes, carried), "blocks"))
        if not found[-1].filter(F.col("total") > size).take(1):
            return found
        digest = F.unhex(F.element_at(F.element_at("levels", -1), 1)).alias("digest")
        total = F.ceil(F.col("total") / size).alias("total")
        nodes = found[-1].filter(F.col("total") > size).select("tree", F.col("block").alias("place"), total, digest)
        carried = []


def tops(found: list[DataFrame]) -> DataFrame:
    """(tree, digest): the root of every tree, from the pass in which it is one block."""
    root = F.element_at(F.element_at("levels", -1), 1)
    rows = [blocks.filter(F.col("total") <= FANOUT**LEVELS).select("tree", F.unhex(root).alias("digest")) for blocks in found]
    every = rows[0]
    for more in rows[1:]:
        every = every.union(more)
    return every


def way(i: Column) -> Column:
    """Siblings to the left and to the right of member ``i`` and of its ancestors in the block, level by level."""

    def siblings(level: Column) -> Column:
        at = F.floor(i / F.pow(F.lit(FANOUT), level)).cast("int")
        first = at - at % FANOUT
        run = F.slice(F.element_at("levels", level + 1), first + 1, F.lit(FANOUT))
        left, right = F.slice(run, F.lit(1), at - first), F.slice(run, at - first + 2, F.lit(FANOUT))
        return F.struct(F.array_join(left, "").alias("left"), F.array_join(right, "").alias("right"))

    return F.transform(level_numbers(F.col("high")), siblings)


def descend(found: list[DataFrame], crowns: DataFrame, handed: list[str], carried: list[str]) -> DataFrame:
    """tree, digest, ``carried``, path and ``handed`` of every node, from the top pass down.

    ``crowns`` has, for each tree, the path from its root on and the columns that are handed down.
    """
    above = None
    for k in reversed(range(len(found))):
        whole = found[k].filter(F.col("total") <= FANOUT**LEVELS).select("tree", "block")
        own = whole.join(crowns.withColumnRenamed("tree", "of"), F.col("tree").eqNullSafe(F.col("of"))).drop("of")
        above = own if above is None else above.unionByName(own)
        above = above.select(F.col("tree").alias("of"), F.col("block").alias("number"), F.col("path").alias("onward"), *handed)
        met = found[k].join(above, F.col("tree").eqNullSafe(F.col("of")) & (F.col("block") == F.col("number")))
        inside = F.transform("members", lambda m: F.struct(*(m[c].alias(c) for c in ("at", "digest", *(carried if k == 0 else []))), way(m["at"]).alias("inside")))
        rows = met.select("tree", "block", "onward", *handed, F.inline(inside))
        place = F.col("block") * FANOUT**LEVELS + F.col("at")
        rows = rows.select("tree", place.alias("block"), "digest", *(carried if k == 0 else []), F.concat("inside", "onward").alias("path"), *handed)
        above = rows.select("tree", "block", "path", *handed) if k else rows
    return above


def manifest(documents: DataFrame) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root and verified of every row, and lang, path and place in its tree."""
    rows = materialize(leaves(documents), "leaves")
    carried = ["doc_id", "tampered"]
    placed = places(rows, "tree", F.col("doc_id").asc_nulls_first(), F.col("digest"), F.col("spread"))
    trees = passes(placed, carried)
    # the trees' roots are the leaves of one more tree
    roots = materialize(tops(trees).withColumn("all", F.lit(0)), "subroots")
    laid = places(roots, "all", F.col("tree").asc_nulls_first())
    crown = passes(laid.select(F.col("all").cast("string").alias("tree"), "place", "total", "digest", F.col("tree").alias("lang")), ["lang"])
    none = F.expr("cast(array() as array<struct<left: string, right: string>>)")
    peak = tops(crown).select("tree", F.lower(F.hex("digest")).alias("root"), none.alias("path"))
    crowns = descend(crown, peak, ["root"], ["lang"])
    crowns = crowns.select(F.col("lang").alias("tree"), "path", F.lower(F.hex("digest")).alias("subroot"), "root")
    ways = descend(trees, materialize(crowns, "crowns"), ["subroot", "root"], carried)
    leaf, start = F.lower(F.hex("digest")), F.lower(F.hex(F.coalesce("tampered", "digest")))
    siblings = F.array_join(F.transform("path", lambda s: F.concat(s["left"], s["right"])), "")
    folded = F.aggregate("path", start, lambda a, s: F.sha2(F.concat(s["left"], a, s["right"]).cast("binary"), 256))
    shown = ways.select(
        "doc_id", leaf.alias("leaf"), "subroot", "root", F.sha2(siblings.cast("binary"), 256).alias("proof_sha256"),
        folded.alias("folded_root"), F.col("tree").alias("lang"), F.col("block").alias("place"), "path",
    )
    return shown.withColumn("verified", F.col("folded_root") == F.col("root"))


def crc32_sql(bytes_of: str) -> str:
    """The checksum of a list of byte values, in SQL without such a function."""
    bit = "lambda c, k: xor(c >> 1, (c & 1) * 3988292384)"
    step = f"lambda c, b: list_reduce(range(8), {bit}, xor(c, b))"
    return f"xor(list_reduce({bytes_of}, {step}, 4294967295::BIGINT), 4294967295::BIGINT)"


def oracle() -> str:
    """Levels by a recursion that collapses all trees at once; siblings of a node by a join with its run."""
    shown = lambda texts: "sha256(concat(" + ", ".join(f"coalesce(strlen({t}) || ':' || {t}, '-')" for t in texts) + "))"
    own = ["doc_id::VARCHAR", "source", "lang", "n_chars::VARCHAR", "text"]
    low = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    crc = crc32_sql("list_transform(range(1, strlen(doc_id::VARCHAR) + 1), lambda i: ord((doc_id::VARCHAR)[i])::BIGINT)")
    climb = f"""SELECT tree, level + 1, place // {FANOUT}, (total + {FANOUT - 1}) // {FANOUT}, sha256(string_agg(digest, '' ORDER BY place))
  FROM {{0}} WHERE total > 1 GROUP BY tree, level, place // {FANOUT}, total"""
    beside = f"""SELECT a.tree, a.level, a.place,
    coalesce(string_agg(b.digest, '' ORDER BY b.place) FILTER (WHERE b.place < a.place), '') AS l,
    coalesce(string_agg(b.digest, '' ORDER BY b.place) FILTER (WHERE b.place > a.place), '') AS r
  FROM {{0}} a JOIN {{0}} b ON a.tree = b.tree AND a.level = b.level AND a.place // {FANOUT} = b.place // {FANOUT}
  WHERE a.total > 1 GROUP BY a.tree, a.level, a.place"""
    return f"""
WITH RECURSIVE docs AS (SELECT doc_id, lang, {shown(own)} AS leaf, {shown([*own[:-1], low])} AS changed, {crc} % 3 = 0 AS hit FROM documents),
rows AS (SELECT *, dense_rank() OVER (ORDER BY lang NULLS FIRST) - 1 AS tree,
  row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS place, count(*) OVER (PARTITION BY lang) AS total FROM docs),
low(tree, level, place, total, digest) AS (SELECT tree, 0, place, total, leaf FROM rows UNION ALL {climb.format('low')}),
subroots AS (SELECT tree AS place, digest, count(*) OVER () AS total FROM low WHERE total = 1),
high(tree, level, place, total, digest) AS (SELECT 0, 0, place, total, digest FROM subroots UNION ALL {climb.format('high')}),
low_beside AS ({beside.format('low')}),
high_beside AS ({beside.format('high')}),
walk(doc_id, tree, leaf, place, level, upper, proof, folded) AS (
  SELECT doc_id, tree, leaf, place, 0, 0, '', CASE WHEN hit AND changed IS NOT NULL THEN changed ELSE leaf END FROM rows
  UNION ALL
  SELECT w.doc_id, w.tree, w.leaf, CASE WHEN s.l IS NULL THEN w.tree ELSE w.place // {FANOUT} END, CASE WHEN s.l IS NULL THEN 0 ELSE w.level + 1 END,
    CASE WHEN w.upper = 0 AND s.l IS NULL THEN 1 WHEN w.upper = 1 AND s.l IS NULL THEN 2 ELSE w.upper END,
    w.proof || coalesce(s.l || s.r, ''), CASE WHEN s.l IS NULL THEN w.folded ELSE sha256(s.l || w.folded || s.r) END
  FROM walk w LEFT JOIN (SELECT 0 AS upper, * FROM low_beside UNION ALL SELECT 1, * FROM high_beside) s
    ON s.upper = w.upper AND s.tree = CASE WHEN w.upper = 0 THEN w.tree ELSE 0 END AND s.level = w.level AND s.place = w.place
  WHERE w.upper < 2)
SELECT w.doc_id, w.leaf, r.digest AS subroot, t.digest AS root, sha256(w.proof) AS proof_sha256, w.folded AS folded_root, w.folded = t.digest AS verified
FROM walk w JOIN subroots r ON r.place = w.tree CROSS JOIN (SELECT digest FROM high WHERE total = 1) t WHERE w.upper = 2"""
