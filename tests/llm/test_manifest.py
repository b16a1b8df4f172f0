"""Merkle manifest, importance resampling and line dedup against plain Python and against their SQL."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from geoweave.llm import lines, manifest, ranks, resample
from geoweave.llm import text as tx

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
ROW = "doc_id long, text string, lang string, source string, n_chars long"


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def leaf(doc_id, text, lang, source, n):
    shown = [None if v is None else str(v) for v in (doc_id, source, lang, n, text)]
    return sha("".join("-" if v is None else f"{len(v.encode())}:{v}" for v in shown))


def tree(nodes):
    """Levels from the leaves to the one root."""
    levels = [nodes]
    while len(levels[-1]) > 1:
        last = levels[-1]
        levels.append([sha("".join(last[i : i + 8])) for i in range(0, len(last), 8)])
    return levels


def way(levels, i):
    for level in levels[:-1]:
        first = i - i % 8
        yield "".join(level[first:i]), "".join(level[i + 1 : first + 8])
        i //= 8


def manifest_by_hand(rows):
    key = lambda v: (v is not None, v if isinstance(v, int) else (v or "").encode())
    by_lang = defaultdict(list)
    for r in rows:
        by_lang[r[2]].append((key(r[0]), leaf(*r), r))
    langs = sorted(by_lang, key=key)
    trees = {g: tree([x for _, x, _ in sorted(by_lang[g], key=lambda m: m[:2])]) for g in langs}
    top = tree([trees[g][-1][0] for g in langs])
    root, out = top[-1][0], []
    for k, g in enumerate(langs):
        for i, (_, own, r) in enumerate(sorted(by_lang[g], key=lambda m: m[:2])):
            path = [*way(trees[g], i), *way(top, k)]
            hit = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0 and r[1] is not None
            now = leaf(r[0], r[1].translate(LOWER), *r[2:]) if hit else own
            for left, right in path:
                now = sha(left + now + right)
            out.append((r[0], own, trees[g][-1][0], root, sha("".join(a + b for a, b in path)), now, now == root))
    return out


COLUMNS = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]


def order(rows):
    return sorted(rows, key=str)


def corpus(seed, n, langs):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abÉßcDE") for _ in range(rng.randrange(1, 7)))
    return [(i, " ".join(word() for _ in range(rng.randrange(1, 12))), rng.choice(langs), rng.choice(["a", "b", None]), rng.randrange(90)) for i in range(n)]


@pytest.mark.parametrize("langs", [["en"], ["en", "en", "en", "de", None, "", "zh", "é", *(f"l{k}" for k in range(9))]])
def test_manifest_equals_brute_force(spark, langs):
    rows = corpus(3, 700, langs)
    rows += [(None, "No id", "en", None, None), (5, None, "de", None, 1), (5, "", None, "", 0), rows[9], rows[9], (1, "X" * 50_000, "en", "a", 2), (2, "tie", langs[0], "a", 1), (2, "TIE", langs[0], "a", 1)]
    rows.append((10**6, "alone", "alone", "s", 5))
    got = manifest.manifest(spark.createDataFrame(rows, ROW).repartition(5)).select(COLUMNS)
    assert order(map(tuple, got.collect())) == order(manifest_by_hand(rows))


def test_small_trees(spark):
    """Trees of one leaf, of whole runs and of one leaf more."""
    rows = [(100 * n + k, f"T {k}", f"l{n}", None, k) for n in (1, 2, 8, 9, 64, 65) for k in range(n)]
    got = manifest.manifest(spark.createDataFrame(rows, ROW)).select(COLUMNS)
    assert order(map(tuple, got.collect())) == order(manifest_by_hand(rows))


def test_trees_of_several_passes(spark, monkeypatch):
    """Blocks of one level: larger trees need three passes, and trees end in different ones."""
    rows = corpus(4, 100, ["en", "en", "en", "de", "fr"])
    want = {r[0]: r[1:] for r in manifest_by_hand(rows)}
    monkeypatch.setattr(manifest, "LEVELS", 1)
    got = manifest.manifest(spark.createDataFrame(rows, ROW)).select(COLUMNS).collect()
    assert {r[0]: tuple(r[1:]) for r in got} == want


def test_manifest_of_nothing_and_clashing_columns(spark):
    assert manifest.manifest(spark.createDataFrame([], ROW)).count() == 0
    rows = corpus(6, 30, ["en", "de"])
    wide = spark.createDataFrame(rows, ROW).withColumns({c: F.lit(1) for c in ("tree", "digest", "place", "total", "path", "root", "__seq")})
    assert order(map(tuple, manifest.manifest(wide).select(COLUMNS).collect())) == order(manifest_by_hand(rows))


def test_places_of_heavy_groups(spark):
    rng = random.Random(2)
    rows = [("a" if k % 3 else rng.choice(["b", None, "c"]), rng.randrange(40), k) for k in range(3000)]
    got = ranks.places(spark.createDataFrame(rows, "g string, v int, k int").repartition(7), "g", F.col("v"), F.col("k")).collect()
    want = {}
    for g in {r[0] for r in rows}:
        mine = sorted((v, k) for h, v, k in rows if h == g)
        want |= {k: (i, len(mine)) for i, (_, k) in enumerate(mine)}
    assert {r["k"]: (r["place"], r["total"]) for r in got} == want


# -- importance resampling


WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def features(t):
    w = WORD.findall((t or "").translate(LOWER))
    return w + [f"{a} {b}" for a, b in zip(w, w[1:])]


def resample_by_hand(rows, target, percent=25, least=20):
    bucket = lambda f: zlib.crc32(f.encode()) % 10000
    s, t = Counter(bucket(f) for _, x in rows for f in features(x)), Counter(bucket(f) for x in target for f in features(x))
    ns, nt = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (ns + 10000) / ((s[b] + 1) * (nt + 10000))))
    out = []
    for i, x in rows:
        f = features(x)
        weight = sum(gain(bucket(g)) for g in f) // len(f) if f else 0
        score = None
        if i is not None:
            h = int(sha(f"7:{i}")[:8], 16)
            score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out.append([i, len(f), weight, score, None])
    able = sorted((r for r in out if r[3] is not None and r[1] >= 2 * least - 1), key=lambda r: (-r[3], r[0], r[1], r[2]))
    for k, r in enumerate(able[: percent * len(able) // 100]):
        r[4] = k + 1
    return [tuple(r) for r in out]


def word_texts(seed, n):
    rng = random.Random(seed)
    vocab = [*(f"w{k}" for k in range(60)), "Éa", "ßß", "x" * 90, "A1", "日本"]
    return [" ".join(rng.choices(vocab, k=rng.choice([1, 5, 19, 20, 40, 90]))) for _ in range(n)]


def test_resampling_equals_brute_force(spark):
    rows = list(enumerate(word_texts(1, 300)))
    rows += [(None, rows[3][1]), (400, None), (401, ""), (402, "\x00--- \n"), (403, " ".join(word_texts(5, 900))), (404, "y" * 70_000)]
    rows += [rows[8]] * 40 + [(9, rows[10][1])]
    target = [*word_texts(2, 20), None, "", "w1 w2 w3 " * 30]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    items = spark.createDataFrame([(k, x) for k, x in enumerate(target)], "item_id long, text string")
    got = resample.resample(docs, items)
    assert order(map(tuple, got.collect())) == order(resample_by_hand(rows, target))


def test_emptied_tries_change_nothing(spark):
    rows = list(enumerate(word_texts(7, 80)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    whole = {r["bucket"]: r["n"] for r in resample.bucket_totals(docs).collect()}
    assert whole == {r["bucket"]: r["n"] for r in resample.bucket_totals(docs, nodes=1).collect()}
    assert whole == dict(Counter(zlib.crc32(f.encode()) % 10000 for _, x in rows for f in features(x)))
    gains = np.arange(10000) - 5000
    assert order(resample.weigh(docs, gains).collect()) == order(resample.weigh(docs, gains, nodes=1).collect())


def test_crc_states_go_on():
    texts = ["a b", "long " + "z" * 300 + " tail", "é ß日", "one"]
    data = "".join(texts).encode()
    offsets = np.cumsum([0, *(len(x.encode()) for x in texts)])
    w = tx.Words(np.frombuffer(data, np.uint8), offsets, tx.ALNUM, True)
    trie = resample.Trie()
    node, head, pair = trie.walk(w)
    spans = [bytes(w.bytes[a:b]) for a, b in zip(w.start, w.end)]
    assert [int(trie.words.crc[k]) for k in node] == [zlib.crc32(x) for x in spans]
    assert [int(trie.pairs.crc[k]) for k in pair] == [zlib.crc32(spans[h] + b" " + spans[h + 1]) for h in head]


def test_resampling_of_nothing_and_carried_columns(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    items = spark.createDataFrame([(1, "w1 w2")], "item_id long, text string")
    assert resample.resample(none, items).count() == 0
    rows = [(i, x, i % 5, f"n{i}") for i, x in enumerate(word_texts(3, 60))]
    docs = spark.createDataFrame(rows, "doc_id long, text string, rank int, score string")
    drawn = resample.drawn_documents(docs, none.withColumnRenamed("doc_id", "item_id"))
    assert drawn.columns == ["doc_id", "text", "rank", "score", "rank_"]
    want = {r[0]: r[4] for r in resample_by_hand([r[:2] for r in rows], []) if r[4]}
    assert {r["doc_id"]: r["rank_"] for r in drawn.collect()} == want
    assert all(tuple(r)[:4] == rows[r["doc_id"]] for r in drawn.collect())


# -- line dedup


def key_of(line):
    return line.strip(" \t\n\x0b\x0c\r").translate(LOWER)


def dedup_by_hand(rows, least=20, copies=3):
    holders = defaultdict(set)
    for i, x in rows:
        for line in (x or "").split("\n"):
            if len(key_of(line)) >= least:
                holders[key_of(line)].add(i)
    out = []
    for i, x in rows:
        cut = (x or "").split("\n")
        kept = [
            line for line in cut
            if len(holders.get(key_of(line), ())) < copies or i == max(h for h in holders[key_of(line)] if h is not None)
        ]
        out.append((i, len(cut), len(cut) - len(kept), "\n".join(kept)))
    return out


def line_texts(seed, n):
    rng = random.Random(seed)
    shared = [f"This line number {k} is shared by many" for k in range(12)]
    shared += ["\tÀ line with accents, long enough \r", "short", "", "  ", "exactly twenty chars", "nineteen characters"]
    fresh = lambda i: f"only document {i} has line {rng.random()}"
    return [(i, "\n".join(rng.choice([rng.choice(shared), rng.choice(shared).upper(), "  " + rng.choice(shared), fresh(i)]) for _ in range(rng.randrange(1, 14)))) for i in range(n)]


def test_line_dedup_equals_brute_force(spark):
    rows = line_texts(1, 120)
    long = "\n".join(["this line number 3 is shared by many", "once only, once only"] * 3000)
    rows += [(None, rows[4][1]), (None, rows[5][1]), (200, None), (201, ""), (202, "\n"), (203, long), (7, rows[8][1]), rows[9], rows[9]]
    rows += [(300 + k, "two holders of this line") for k in range(2)] + [(None, "two and a row without an id")] + [(310 + k, "two and a row without an id") for k in range(2)]
    rows += [(None, "rows without an id alone " * 2)] * 5
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = lines.digests(docs).collect()
    assert order(map(tuple, got)) == order((i, n, d, sha(x)) for i, n, d, x in dedup_by_hand(rows))


def test_heavy_lines_meet_by_both_joins(spark, monkeypatch):
    """A line in every document, against the rest; with a share of one no key is heavy, with many all are."""
    rows = [(i, f"everybody has this very line\nand some have line number {i % 40}") for i in range(400)]
    want = order((i, n, d, sha(x)) for i, n, d, x in dedup_by_hand(rows))
    for share in (1, 30, 10**6):
        monkeypatch.setattr(lines, "HEAVY", share)
        assert order(map(tuple, lines.digests(spark.createDataFrame(rows, "doc_id long, text string")).collect())) == want


def test_line_dedup_of_nothing_and_clashing_columns(spark):
    assert lines.digests(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    rows = line_texts(2, 40)
    docs = spark.createDataFrame([(*r, 5, "p", "m") for r in rows] + [(99, None, 1, None, "m")], "doc_id long, text string, n_lines int, places string, mark string")
    got = lines.dedup_lines(docs)
    assert got.columns == ["doc_id", "text", "n_lines", "places", "mark", "n_lines_", "n_dropped"]
    want = {i: (x, n, d) for i, n, d, x in dedup_by_hand(rows)} | {99: (None, 1, 0)}
    assert {r["doc_id"]: (r["text"], r["n_lines_"], r["n_dropped"]) for r in got.collect()} == want


@pytest.mark.parametrize("name", ["op11_merkle_manifest", "op12_importance_resampling", "op13_line_dedup"])
def test_queries_equal_sql(spark, name):
    from geoweave.llm import queries

    data = "/root/testdata/sf0.001"
    c = duckdb.connect()
    for t in ("documents", "benchmark"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{data}/{t}.parquet'")
    found = c.execute(queries.ORACLE[name])
    names = [d[0] for d in found.description]
    got = queries.QUERIES[name](spark, data)
    assert sorted(got.columns) == sorted(names)
    assert order(map(tuple, got.select(names).collect())) == order(found.fetchall())
