"""Quality rules, license scans, language ID and decontamination against plain Python."""

import os
import pickle
import random
import re
import subprocess
import sys
import tempfile
import zlib
from collections import Counter
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest

from geoweave.llm import decontam, langid, licenses, quality
from geoweave.llm import text as tx

SPACED = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
ODD = [None, "", " ", "\n\n", "a", "a a a a a a a a a a a a", "x\ny\nx\n \nx", "é ß 漢字 #$%&|<>*", "a b c d e f a b c d e g\na b c d e f", "line one here\nline one here\n\nline one here", " nbsp ", "AKIA" * 3, "under the MIT license", "z" * 5000, "w " * 4000]


def texts(seed=1, n=60):
    rng = random.Random(seed)
    words = ["the", "of", "Ünd", "mit", "under", "license", "cc", "by", "nc", "apache", "version", "2", "x#y", "ab,", "çe"]
    return ODD + [rng.choice([" ", "\n"]).join(rng.choices(words, k=rng.randint(1, 90))) for _ in range(n)]


def base_of(t):
    t = t or ""
    w = SPACED.findall(t)
    grams = {}
    for i in range(len(w) - 4):
        grams.setdefault(tuple(w[i : i + 5]), []).append(i)
    covered = {i + k for at in grams.values() if len(at) > 1 for i in at for k in range(5)}
    seen, dup = set(), 0
    for line in t.split("\n"):
        if SPACED.search(line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), dup, len(covered)


def docs(spark, rows, schema="doc_id long, text string"):
    return spark.createDataFrame(rows, schema)


@pytest.mark.parametrize("limit", [1, 64, 1 << 19])
def test_words_of_slices(limit):
    rows = texts(3)
    for table, fold, pattern in ((tx.SPACED, False, SPACED), (tx.ALNUM, True, ALNUM)):
        seen = {}
        for i, j, data, offsets in tx.slices(pa.array(rows), limit):
            w = tx.Words(data, offsets, table, fold)
            for d in range(j - i):
                want = pattern.findall((rows[i + d] or "").translate(LOWER) if fold else rows[i + d] or "")
                assert w.counts[d] == len(want)
                for word, h in zip(want, w.hash[w.first[d] : w.first[d + 1]]):
                    assert seen.setdefault(word, h) == h
        assert len(set(seen.values())) == len(seen)


def test_base_counts(spark):
    rows = list(enumerate(texts()))
    labels = spark.createDataFrame([(i, 1, 0) for i in range(20, 60)] + [(None, 1, 0), (20, 1, 0)], "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r for r in quality.quality_filter(docs(spark, rows), labels, buckets=1 << 10).collect()}
    assert len(got) == len(rows)
    for i, t in rows:
        r = got[i]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == base_of(t), t
        assert r["base_failed"] == (r["n_words"] < 10 or 100 * r["n_repeat_words"] > 20 * r["n_words"])
        assert not (r["kept"] and r["base_failed"])


def test_log_ratios_equal_brute_force(spark):
    good = ["alpha beta gamma delta epsilon zeta eta theta iota kappa %d" % (i % 7) for i in range(40)]
    junk = ["junk !! spam !! %d noise !! junk more !! stuff here too" % i for i in range(40)]
    rows = list(enumerate(good + junk))
    labels = spark.createDataFrame([(i, 1, 0) for i in range(40)] + [(i, 0, 0) for i in range(40, 60)], "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r for r in quality.quality_filter(docs(spark, rows), labels, buckets=64).collect()}
    assert all(got[i]["kept"] for i in range(40)) and not any(got[i]["kept"] for i in range(40, 80))
    raw, trusted = np.ones(64), np.ones(64)
    each = {}
    for i, t in rows:
        data = np.frombuffer(t.encode(), np.uint8)
        _, b = quality.gram_buckets(tx.Words(data, np.array([0, len(data)]), tx.SPACED, False), 64)
        each[i] = b
        for k in b:
            raw[k] += 1
            trusted[k] += i < 40
    lam = np.log(trusted / trusted.sum()) - np.log(raw / raw.sum())
    for i, b in each.items():
        assert abs(got[i]["llr"] - lam[b].mean()) < 1e-9


def test_repetitive_lines_are_told_apart(spark):
    """Two Thue-Morse lines, and lines longer than any that is hashed in one piece."""
    a = "ab"
    for _ in range(11):
        a += a.translate(str.maketrans("ab", "ba"))
    b = a.translate(str.maketrans("ab", "ba"))
    rows = [(1, a + "\n" + b), (2, a + "\n" + b + "\n" + a), (3, a[:2048] + "\n" + b[:2048]), (4, "\n".join("x" * n for n in (255, 256, 257, 256, 257))), (5, " ".join([a, b, a, b, a] * 2)), (6, "é " * 300_000)]
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r for r in quality.quality_filter(docs(spark, rows), none).collect()}
    for i, t in rows:
        assert (got[i]["n_words"], got[i]["word_chars"], got[i]["n_symbols"], got[i]["n_dup_lines"], got[i]["n_repeat_words"]) == base_of(t)


def test_threshold_is_the_quantile(spark):
    rng = random.Random(5)
    values = [rng.gauss(0, 1) for _ in range(2000)]
    df = spark.createDataFrame([(v,) for v in values], "llr double")
    for share in (0.005, 0.3):
        t = quality.quantile(df, share)
        below = sum(v < t for v in values)
        assert below <= share * len(values) < sum(v < t + 0.002 for v in values) + 2
    assert quality.quantile(df.limit(0), 0.1) == 0


def test_quality_without_labels_or_rows(spark):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert quality.quality_filter(docs(spark, []), none).count() == 0
    r = quality.quality_filter(docs(spark, [(1, "one two three four five six seven eight nine ten")]), none).first()
    assert r["kept"] and r["llr"] == 0


def test_toxic_words_in_long_texts(spark):
    """Three toxic words among 300 and more clean ones; half of the toxic documents have no label."""
    rng = random.Random(21)
    vocab, toxic = [f"w{k}" for k in range(300)], [f"bad{k}" for k in range(8)]
    rows = []
    for i in range(400):
        w = rng.choices(vocab, k=rng.randint(300, 900))
        if i % 4 == 0:
            k = rng.randrange(len(w))
            w[k:k] = rng.choices(toxic, k=3)
        rows.append((i, " ".join(w)))
    labels = spark.createDataFrame([(i, 1, int(i % 4 == 0)) for i in range(400) if i % 8 < 4], "doc_id long, quality int, toxic int")
    kept = {r["doc_id"] for r in quality.quality_filter(docs(spark, rows), labels, threshold=-9.0).filter("kept").collect()}
    assert not any(i in kept for i in range(0, 400, 4))
    assert sum(i in kept for i in range(400) if i % 4) >= 0.9 * 300


def test_all_trusted_documents_count(spark):
    """No sample: beyond 20 000 trusted documents each one still is in the counts and under the quantile."""
    n = 20_400
    rows = spark.range(n).selectExpr("id doc_id", "concat('only', id, ' one two three four five six seven eight nine ten') text")
    labels = spark.range(n).selectExpr("id doc_id", "1 quality", "0 toxic")
    marked = quality.marked_texts(rows.unionByName(docs(spark, [(None, "x y"), (None, None)])), quality.marks(labels))
    assert marked.count() == n + 2 and marked.filter("trusted").count() == n
    # all rows are trusted, so both multinomials are one
    assert quality.quality_filter(rows, labels).filter("abs(llr) > 1e-9 OR NOT kept").count() == 0


def test_base_phrases(spark):
    rows = list(enumerate(texts(5, 150)))
    got = {r["doc_id"]: r for r in licenses.license_scan(docs(spark, rows)).collect()}
    for i, t in rows:
        w = ALNUM.findall((t or "").translate(LOWER))
        at, labels = [], set()
        for phrase, label in licenses.BASE_PHRASES:
            p = phrase.split()
            found = [k for k in range(len(w)) if w[k : k + len(p)] == p]
            at += found
            labels |= {label} if found else set()
        r = got[i]
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == (len(w), len(at), min(at, default=None), max(at, default=None), ",".join(sorted(labels)))
        assert set(filter(None, r["base_labels"].split(","))) <= set(filter(None, r["labels"].split(",")))
        assert 0 <= r["score"] <= 1


@pytest.mark.parametrize("words,accepted", [("a b c d", 4), ("a b d", 3), ("a b x d", 0), ("a b c x y d", 6), ("a b c x y z d", 0), ("a b", 0)])
def test_automaton(words, accepted):
    a = licenses.Automaton("t", "a b [[c <<free:0,2>>]] d")
    assert a.run(w.encode() for w in words.split())[0] == accepted


def test_template_needs_a_mandatory_head():
    for bad in ("<<x:1,2>> a b", "[[a]]", "[[<<x:0,1>>]] a b", "<<x:0,1>>"):
        with pytest.raises(ValueError):
            licenses.Automaton("t", bad)
    a = licenses.Automaton("t", "[[x [[y]]]] b c")
    assert a.heads == {(b"x", b"y"), (b"x", b"b"), (b"b", b"c")}


def as_regex(template):
    """The template as a regular expression over words with a space behind each."""
    out = ""
    for part in re.findall(r"\[\[|\]\]|<<[^>]*>>|[^\s\[\]<>]+", template):
        if part == "[[":
            out += "(?:"
        elif part == "]]":
            out += ")?"
        elif part.startswith("<<"):
            least, most = part[2:-2].split(":")[1].split(",")
            out += r"(?:\S+ ){%s,%s}" % (least, most)
        else:
            out += re.escape(part) + " "
    return re.compile(out)


def instance(rng, template):
    """A text that the template accepts, with a random choice for every region."""
    out, skip = [], 0
    for part in re.findall(r"\[\[|\]\]|<<[^>]*>>|[^\s\[\]<>]+", template):
        if part == "[[":
            skip += bool(skip or rng.random() < 0.5)
        elif part == "]]":
            skip -= bool(skip)
        elif skip:
            continue
        elif part.startswith("<<"):
            least, most = map(int, part[2:-2].split(":")[1].split(","))
            out += [f"n{rng.randrange(99)}" for _ in range(rng.randint(least, most))]
        else:
            out.append(part)
    return out


def test_whole_licenses_equal_brute_force(spark):
    """Instances of all templates, whole and with a word changed, dropped or added, against regular expressions."""
    rng = random.Random(17)
    rows = []
    for label, template in licenses.TEMPLATES:
        for kind in range(8):
            w = instance(rng, template)
            at = rng.randrange(len(w))
            if kind == 1:
                w[at] = "other"
            elif kind == 2:
                del w[at]
            elif kind == 3:
                w.insert(at, "more")
            elif kind == 4:
                del w[len(w) // 2 :]
            rows.append((len(rows), " ".join(["some", "words", *w, "after", "it"])))
    rows += [(9000, None), (9001, ""), (9002, "x " * 50_000 + rows[-8][1].upper()), (0, rows[0][1]), (None, rows[0][1])]
    got = licenses.license_scan(docs(spark, rows)).collect()
    assert len(got) == len(rows)
    patterns = [(label, as_regex(t)) for label, t in licenses.TEMPLATES]
    wanted = {}
    for i, t in rows:
        flat = "".join(x + " " for x in ALNUM.findall((t or "").translate(LOWER)))
        wanted[i] = sorted({label for label, p in patterns if p.search(flat)} | {label for phrase, label in licenses.BASE_PHRASES if f" {phrase} " in " " + flat})
    for r in got:
        assert r["labels"] == ",".join(wanted[r["doc_id"]]), (r["doc_id"], r["labels"])
        assert (r["score"] == 1) == bool(r["labels"])
    assert sum(bool(x) for x in wanted.values()) >= 4 * len(licenses.TEMPLATES)


def test_partial_license(spark):
    text = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to something else"
    r = licenses.license_scan(docs(spark, [(1, text)])).first()
    assert r["labels"] == "" and 0.1 < r["score"] < 1


def languages(n, seed=2):
    rng = random.Random(seed)
    parts = {"aa": ["wh", "th", "er", "ing"], "bb": ["ß", "sch", "ung", "keit"], "cc": ["ño", "ción", "rr", "ll"]}
    out = []
    for i in range(n):
        lang = ["aa", "bb", "cc"][i % 3]
        out.append((i, " ".join("".join(rng.choices(parts[lang], k=2)) for _ in range(rng.randint(3, 120))), lang))
    return out


def test_language_id(spark):
    rows = languages(240) + [(1000, None, "aa"), (1001, "", "aa"), (1002, "123 456 !!", "bb"), (None, "wher thing", "aa"), (1003, "whth" * 2000, None), (5, "thwh erwh", "aa"), (5, "thwh erwh", "aa")]
    got = langid.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()
    assert len(got) == len(rows)
    lang = {i: x for i, _, x in rows}
    by = {}
    for r in got:
        by.setdefault(r["doc_id"], r)
        assert 0 <= r["score"] <= 1
    for i in (1000, 1001, 1002):
        assert by[i]["lang_pred"] == "und" and by[i]["score"] == 0
    assert by[1003]["lang_pred"] == "aa" and not by[None]["held_out"]
    held = [r for r in got if r["held_out"] and r["doc_id"] < 240]
    assert held and sum(r["lang_pred"] == lang[r["doc_id"]] for r in held) >= 0.9 * len(held)
    empty = langid.identify(spark.createDataFrame([], "doc_id long, text string, lang string"))
    assert empty.count() == 0


def test_classifier_equals_plain_convolution():
    net = langid.train([(t.encode()[:256], lang) for _, t, lang in languages(60)], epochs=1)
    c = langid.Classifier(net)
    x = np.random.RandomState(0).randint(0, 256, (5, langid.WINDOW)).astype(np.uint8)
    emb, pooled = net.embedding[x], []
    for w in langid.WIDTHS:
        pooled.append(np.stack([np.einsum("nke,kef->nf", emb[:, t : t + w], net.filters[w]) for t in range(langid.WINDOW - w + 1)]).max(0))
    logits = np.maximum(np.concatenate(pooled, 1) + net.bias, 0) @ net.out + net.out_bias
    p = np.exp(logits - logits.max(1, keepdims=True))
    assert np.allclose(c.windows(x), p / p.sum(1, keepdims=True), atol=1e-5)


def test_sample_of_repeated_ids(spark):
    """One doc_id for all rows, and rows that are all equal: there is something to learn from."""
    free = next(i for i in range(99) if zlib.crc32(str(i).encode()) % 5)
    rows = [(free, t, lang) for _, t, lang in languages(40)]
    net = langid.training_sample(spark.createDataFrame(rows, "doc_id long, text string, lang string"), 10, 1)
    assert 9 <= len(net) <= 10
    same = langid.training_sample(spark.createDataFrame(rows[:1] * 40, "doc_id long, text string, lang string"), 10, 1)
    assert len(same) == 10


def test_keep_identified_keeps_columns(spark):
    rows = [(*r, "s", 1) for r in languages(60)] + [(999, None, "aa", "s", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, lang_pred string, SCORE int")
    kept = langid.keep_identified(df)
    assert kept.columns == df.columns
    assert {r["doc_id"] for r in kept.collect()} >= {i for i in range(60)} - {i for i in range(60) if len(rows[i][1]) < 20} and 999 not in {r["doc_id"] for r in kept.collect()}


def nearest(a, b):
    """Least edits of a against any part of b, and the first word at which such a part may begin."""
    row = [(0, j) for j in range(len(b) + 1)]
    for x in a:
        new = [(row[0][0] + 1, row[0][1])]
        for j, y in enumerate(b):
            ways = ((row[j][0] + (x != y), row[j][1]), (row[j + 1][0] + 1, row[j + 1][1]), (new[-1][0] + 1, new[-1][1]))
            new.append(min(ways))
        row = new
    return min(row)


def leaks_by_hand(rows, items, percent=20):
    want = {}
    for i, t in rows:
        w = ALNUM.findall((t or "").lower())
        for k, item in items:
            p = ALNUM.findall((item or "").lower())
            e = nearest(p, w)
            if p and e[0] <= len(p) * percent // 100:
                want[i, k] = min((*e, len(p)), want.get((i, k), (*e, len(p))))
    return want


def found(got):
    return {(r["doc_id"], r["item_id"]): (r["edits"], r["first_word"], r["n_item_words"]) for r in got}


def changed(rng, words, n, vocab):
    """The words after n edits."""
    w = list(words)
    for _ in range(n):
        at, how = rng.randrange(len(w)), rng.random()
        if how < 0.2:
            w.insert(at, rng.choice(vocab))
        elif how < 0.4 and len(w) > 1:
            del w[at]
        else:
            w[at] = rng.choice(vocab)
    return w


def test_leaks_equal_brute_force(spark):
    """Items of 1 to 600 words, whole, edited and halved, inside texts."""
    rng = random.Random(4)
    vocab = [f"w{k}" for k in range(400)]
    sizes = [1, 2, 5, 7, 8, 9, 12, 30, 60, 255, 256, 257, 300, 513, 600]
    items = [(k, " ".join([f"item{k}", *rng.choices(vocab, k=n - 1)])) for k, n in enumerate(sizes)] + [(100, "Only four words, really"), (101, None), (102, " -- ")]
    rows = []
    for i in range(60):
        item = items[i % len(sizes)][1].split()
        item = changed(rng, item, rng.randint(0, len(item) // 12), vocab) if i < 45 else item[: len(item) // 2]
        w = rng.choices(vocab, k=rng.randint(0, 120))
        k = rng.randint(0, len(w))
        w[k:k] = item
        rows.append((i, " ".join(w)))
    rows += [(500, None), (501, ""), (502, "so only FOUR words -- really! that"), (503, "only four words"), (1, rows[1][1]), (None, items[8][1]), (504, "x " * 20_000 + items[7][1])]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontam.leaks(docs(spark, rows), bench, block_bytes=2000).collect()
    want = leaks_by_hand(rows, items)
    assert found(got) == want and (504, 7) in want
    assert sum(r["doc_id"] == 1 for r in got) == 2 * sum(i == 1 for i, _ in want)
    extra = docs(spark, [(i, t, 1, "x") for i, t in rows], "doc_id long, text string, item_id int, edits string")
    kept = decontam.clean(extra, bench)
    assert kept.columns == extra.columns
    leaky = {i for i, _ in want}
    assert sorted((r["doc_id"] for r in kept.collect()), key=str) == sorted((i for i, _ in rows if i not in leaky), key=str)
    assert decontam.leaks(docs(spark, rows), bench.limit(0)).count() == 0 and decontam.leaks(docs(spark, []), bench).count() == 0


@pytest.mark.parametrize("edit,least", [("delete", 3), ("insert", 3), ("replace", 3)])
def test_places_of_edited_items(spark, edit, least):
    """The place is where the item begins, whatever was put in or left out inside it."""
    item = [f"i{k}" for k in range(20)]
    inside = {"delete": item[:5] + item[8:], "insert": item[:5] + ["x", "y", "z"] + item[5:], "replace": item[:5] + ["x", "y", "z"] + item[8:]}[edit]
    text = " ".join(["a", "b", "c", *inside, "d", "e"])
    (row,) = decontam.leaks(docs(spark, [(1, text)]), spark.createDataFrame([(7, " ".join(item))], "item_id long, text string")).collect()
    assert (row["edits"], row["first_word"]) == (3, least)


def test_items_of_one_id_make_many_blocks(spark):
    """All items have one id: blocks stay small, passes are many, and each row has one finding for the id."""
    rng = random.Random(12)
    items = [(7, " ".join(f"p{k}w{j}" for j in range(rng.randint(9, 30)))) for k in range(200)]
    rows = [(i, " ".join(["z"] * (i % 5) + changed(rng, items[i][1].split(), i % 2, ["q"]))) for i in range(40)]
    rows += [(100, f"{items[3][1]} and {items[4][1]}"), (101, "none of them"), (102, None)] + [rows[0]] * 3 + [(None, items[9][1])] * 2
    bench = spark.createDataFrame(items + items[:50], "item_id long, text string")
    payloads = list(decontam.passes(bench, 20, 4000, 1))
    size = sum(len(t) for _, t in items)
    assert len(payloads) >= size // 4000 and all(len(p) == 1 for p in payloads)
    assert max(sum(len(w) for w in pickle.loads(p[0]).words) for p in payloads) < 2000
    got = decontam.leaks(docs(spark, rows), bench, block_bytes=4000, pass_bytes=1).collect()
    want = leaks_by_hand(rows, items)
    assert found(got) == want
    assert Counter(r["doc_id"] for r in got) == Counter(i for i, _ in rows if (i, 7) in want)
    kept = decontam.clean(docs(spark, rows), bench, block_bytes=4000, pass_bytes=1).collect()
    assert sorted(r["doc_id"] for r in kept) == [101, 102]


@pytest.mark.parametrize("percent", [0, 20, 35])
def test_short_items_inside_texts(spark, percent):
    """Every item of under 8 words against every part of every text."""
    rng = random.Random(31)
    vocab = [f"w{k}" for k in range(12)]
    items = [(k, " ".join(rng.choices(vocab, k=k % 7 + 1))) for k in range(28)] + [(50, "Zq yx."), (51, None)]
    rows = [(i, " ".join(rng.choices(vocab + ["zz"] * 30, k=rng.randint(0, 25)))) for i in range(60)] + [(i + 60, " ".join(["zz", *rng.choice(items[:28])[1].split()[i % 2 :], "zz"][i % 3 :])) for i in range(60)]
    rows += [(200, "zz zz ZQ, yx zz"), (201, "zq"), (202, "yx zq"), (203, None), (200, "zz zz ZQ, yx zz")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = found(decontam.leaks(docs(spark, rows), bench, percent).collect())
    want = leaks_by_hand(rows, items, percent)
    assert got == want and (200, 50) in got and (202, 50) not in got
    kept = decontam.clean(docs(spark, rows), bench, percent).collect()
    assert sorted(r["doc_id"] for r in kept) == sorted(i for i, _ in rows if i not in {i for i, _ in want})


@pytest.mark.parametrize("percent,least", [(5, 0.99), (10, 0.99), (15, 0.97), (20, 0.93)])
def test_recall_of_the_bit_sampling(percent, least):
    rng = random.Random(9)
    vocab = [f"v{k}" for k in range(3000)]
    items = [(k, " ".join(rng.choices(vocab, k=rng.randint(12, 60) if k % 5 else rng.randint(257, 300)))) for k in range(150)]
    index = decontam.Index(items, 20)
    hit = total = 0
    for k, item in items:
        w = item.split()
        t = changed(rng, w, len(w) * percent // 100, vocab)
        data = np.frombuffer(" ".join(rng.choices(vocab, k=50) + t + rng.choices(vocab, k=50)).encode(), np.uint8)
        total += 1
        hit += any(index.ids[f[1]] == k for f in index.find(data, np.array([0, len(data)])))
    assert hit >= least * total, hit / total


def test_workers_without_the_repository():
    """Tasks of a session whose Python workers cannot import the package."""
    script = """
import sys
sys.path.insert(0, %r)
from geoweave.llm import decontam, langid, licenses, neardup, quality
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
def lacking(_):
    try:
        import geoweave
    except ImportError:
        return [1]
    return [0]
assert spark.sparkContext.parallelize([1], 1).mapPartitions(lacking).collect() == [1]
docs = spark.createDataFrame([(1, "one two three four five six seven eight nine ten"), (2, "other")], "doc_id long, text string")
bench = spark.createDataFrame([(7, "two three four five six seven eight nine"), (8, "other")], "item_id long, text string")
assert decontam.leaks(docs, bench).count() == 2
assert decontam.clean(docs, bench).count() == 0
assert licenses.license_scan(docs).count() == 2
assert neardup.near_duplicates(docs).count() == 2
print("worked")
""" % str(Path(decontam.__file__).resolve().parents[2])
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    with tempfile.TemporaryDirectory() as away:
        done = subprocess.run([sys.executable, "-c", script], env=env, cwd=away, capture_output=True, text=True, timeout=300)
    assert "worked" in done.stdout, done.stderr[-2000:]
