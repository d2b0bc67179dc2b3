"""Dedup, mixing, licences, language ID and near copies against brute force, and on hard rows."""

import hashlib
import math
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from cadastra.llm import exact_dedup, jaccard, langid, license_scan, mixing

FOLD = {i: i + 32 for i in range(65, 91)}
WORD = re.compile("[^\x20\x09-\x0d]+")


# -- exact dedup -------------------------------------------------------------------------------------------------------


def brute_copies(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[(t or "").translate(FOLD)].append(i)
    out = {}
    for t, ids in groups.items():
        for i in ids:
            out[i] = (max(ids), len(ids), i == max(ids), hashlib.sha256(t.encode()).hexdigest())
    return out


@pytest.mark.parametrize("budget", [exact_dedup.TABLE_BYTES, 3000])
def test_copies(documents, budget):
    want = brute_copies(documents.select("doc_id", "text").collect())
    got = {r[0]: tuple(r)[1:] for r in exact_dedup.find_copies(documents, budget).collect()}
    assert got == want


def test_copies_of_hard_rows(hard, empty):
    rows = exact_dedup.find_copies(hard).collect()
    assert len(rows) == 14
    seven = [r for r in rows if r["group_size"] == 4]
    assert len(seven) == 4 and {r["keep_id"] for r in seven} == {7} and sum(r["kept"] for r in seven) == 1
    nothing = [r for r in rows if r["text_sha256"] == hashlib.sha256(b"").hexdigest()]
    assert len(nothing) == 3 and {r["keep_id"] for r in nothing} == {1}
    assert exact_dedup.find_copies(empty).count() == 0


def test_dedup_keeps_columns(hard, documents):
    kept = exact_dedup.dedup(hard.withColumn("sha", F.lit("mine")))
    assert kept.columns == [*hard.columns, "sha"]
    assert kept.count() == len({(r["text"] or "").translate(FOLD) for r in hard.collect()})
    assert exact_dedup.dedup(documents).count() == len(set(x[3] for x in brute_copies(documents.select("doc_id", "text").collect()).values()))


def test_dedup_keeps_one_of_many_repeats(make_docs):
    docs = make_docs(["same"] * 40 + ["Same", "other"], ids=[None] * 40 + [None, 3]).repartition(5)
    clashing = docs.withColumns({c: F.lit(7) for c in ("_sha", "_nth", "_row", "_id", "group_size", "times", "keep_id")})
    kept = exact_dedup.dedup(clashing).collect()
    assert sorted(str(r["doc_id"]) for r in kept) == ["3", "None"] and all(r["_sha"] == r["times"] == 7 for r in kept)
    rows = exact_dedup.find_copies(clashing).collect()
    assert len(rows) == 42 and sum(r["kept"] for r in rows) == 2 and {r["group_size"] for r in rows} == {1, 41}


def test_grace_splits_whatever_does_not_fit(tmp_path):
    records = [(b"%d" % (i % 700) * 20, i, 1) for i in range(3000)]
    got = list(exact_dedup.grace(iter(records), 2000, tmp_path))
    assert len(got) == 700 and sum(n for _, _, n in got) == 3000
    assert {k: t for k, t, _ in got} == {b"%d" % k * 20: max(i for i in range(3000) if i % 700 == k) for k in range(700)}
    assert not [p for p in tmp_path.rglob("*") if p.is_file()]


# -- mixing ------------------------------------------------------------------------------------------------------------


def brute_targets(sizes, most=3.0):
    """Shares by weight, excess over the cap shared again until none is above."""
    order = sorted([s for s in sizes if s is not None]) + [None] * (None in sizes)
    weight = {s: k % 3 + 1 for k, s in enumerate(order)}
    free, left, out = set(order), float(sum(sizes.values())), {}
    while free:
        total = sum(weight[s] for s in free)
        over = [s for s in free if left * weight[s] / total > most * sizes[s]]
        if not over:
            return out | {s: left * weight[s] / total for s in free}
        for s in over:
            out[s] = most * sizes[s]
        left -= sum(out[s] for s in over)
        free -= set(over)
    return out


def test_targets(spark):
    sizes = {"a": 1000, "b": 10, "c": 500, "d": 7, None: 300, "é": 0}
    rows = [(s, n) for s, n in sizes.items()]
    got = {r["_skey"]: r for r in mixing.targets(spark.createDataFrame(rows, "source string, size bigint")).collect()}
    want = brute_targets(sizes)
    for s, n in sizes.items():
        r = got["n" if s is None else f"s{s}"]
        assert r["source_size"] == n and r["target"] == pytest.approx(want[s]) and 0 <= r["offset"] < 1


def test_mix(documents):
    rows = mixing.mix(documents).join(documents.select("doc_id", "source", "text"), "doc_id").collect()
    again = {r["doc_id"]: r["taken"] for r in mixing.mix(documents).collect()}
    by = defaultdict(list)
    for r in rows:
        assert r["size"] == len(WORD.findall(r["text"] or "")) and r["taken"] <= 3 * r["size"] and again[r["doc_id"]] == r["taken"]
        by[r["source"]].append(r)
    want = brute_targets({s: sum(r["size"] for r in rs) for s, rs in by.items()})
    for s, rs in by.items():
        assert rs[0]["target"] == pytest.approx(want[s])
        # two per cent, or a document that is more than that
        assert abs(sum(r["taken"] for r in rs) - want[s]) <= max(0.02 * want[s], max(r["size"] for r in rs))


def test_words_meet_targets_beside_a_very_long_document(make_docs):
    rng = np.random.default_rng(3)
    long, short = ["w " * 20_000], ["w " * int(n) for n in rng.integers(20, 300, 600)]
    docs = make_docs([*long, *short, *short], sources=["a"] * 601 + ["b"] * 600)
    for seed in range(4):
        rows = mixing.mix(docs, seed=seed).join(docs.select("doc_id", "source"), "doc_id").groupBy("source").agg(F.sum("taken").alias("taken"), F.first("target").alias("target")).collect()
        assert all(abs(r["taken"] - r["target"]) <= 0.005 * r["target"] for r in rows)


def test_copies_cross_each_integer_once(make_docs):
    docs = make_docs(["w w"] * 1000, sources=["a"] * 600 + ["b"] * 400)
    got = mixing.mix(docs).groupBy("target").agg(F.sum("copies").alias("n"), F.max("copies").alias("most"), F.min("copies").alias("least")).collect()
    assert sum(r["n"] for r in got) in (999, 1000, 1001)
    assert all(r["most"] - r["least"] <= 1 for r in got)


def test_copies_follow_the_offset_of_the_source(spark, make_docs):
    docs = make_docs(["w " * k for k in range(1, 91)], sources=["a", "b", "c"] * 30)
    sizes = spark.createDataFrame([("abc"[k % 3], k + 1) for k in range(90)], "source string, size bigint")
    by = {r["_skey"][1:]: r for r in mixing.targets(sizes).collect()}
    got = {r["size"]: r["copies"] for r in mixing.mix(docs).collect()}
    for s in "abc":
        e, u = by[s]["expected"], by[s]["offset"]
        of_source = sorted((k + 1 for k in range(90) if "abc"[k % 3] == s), reverse=True)
        small = lambda n: sum(m for m in of_source if m.bit_length() < n.bit_length())
        first = [n for n in of_source if small(n) * min(e, 3 - e) >= 2 ** of_source[0].bit_length()]
        want = [math.floor(e * k + u) - math.floor(e * (k - 1) + u) for k in range(1, len(first) + 1)]
        left = by[s]["target"] - sum(n * c for n, c in zip(first, want, strict=True))
        step, base = left / sum(of_source[len(first) :]), e * len(first)
        want += [math.floor(base + step * k + u) - math.floor(base + step * (k - 1) + u) for k in range(1, 31 - len(first))]
        assert [got[n] for n in of_source] == want


def test_mixed_rows(hard, empty):
    rows = mixing.mix(hard).collect()
    assert len(rows) == 14 and all(r["taken"] == 0 for r in rows if r["size"] == 0)
    out = mixing.mixed(hard)
    assert out.columns == hard.columns and out.count() == sum(r["copies"] for r in rows)
    assert mixing.mix(empty).count() == 0


# -- licences ----------------------------------------------------------------------------------------------------------


def test_licenses(make_docs, hard, empty):
    mit = license_scan.LICENSES["MIT"]
    texts = [
        "Copyright (c) 2020 Someone\n\n" + mit.upper(),
        mit.replace("sublicense", "sub-licence").replace('"', "“").replace(" ", "  \n"),
        mit + " and more",
        "© 1999 X. All rights reserved.\n" + license_scan.LICENSES["ISC"],
        "Licensed under the Apache Licence, version 2.0",
        "no licence",
        None,
    ]
    got = [r["license"] for r in license_scan.scan(make_docs(texts)).orderBy("doc_id").collect()]
    assert got == ["MIT", "MIT", None, "ISC", "Apache-2.0-line", None, None]
    assert license_scan.scan(hard).where("license is not null").count() == 0 and license_scan.scan(hard).count() == 14
    assert license_scan.scan(empty).count() == 0
    assert license_scan.scan(make_docs(["x"]), {}).first()["license"] is None


def test_whole_and_titled_licenses(make_docs):
    mit = license_scan.LICENSES["MIT"]
    texts = ["MIT License\n\nCopyright Jane Doe\n\n" + mit, "Copyright Jane Doe\n" + mit, *(license_scan.LICENSES.get(k) for k in ("Apache-2.0", "GPL-3.0", "CC0-1.0")), "copyright notice"]
    rows = license_scan.scan(make_docs(texts)).orderBy("doc_id").collect()
    assert [r["license"] for r in rows] == ["MIT-titled", "MIT", "Apache-2.0", "GPL-3.0", "CC0-1.0", None]
    assert rows[-1]["digest"] == hashlib.sha256(b"copyright notice").hexdigest()


# -- language ID -------------------------------------------------------------------------------------------------------


def test_language_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = langid.identify(docs).join(docs.select("doc_id", "lang"), "doc_id")
    right, n, least, most = got.where("held_out").agg(F.sum((F.col("lang") == F.col("lang_pred")).cast("int")), F.count("*"), F.min("score"), F.max("score")).first()
    assert n > 200 and right / n > 0.97 and 0 <= least <= most <= 1


def test_bundles_are_sums_of_bound_vectors():
    texts = pa.array(["Ab", "ab c"])
    a, b, c = 1, 2, 3
    tri = lambda *s: (s[0] * langid.SYMBOLS + s[1]) * langid.SYMBOLS + s[2]
    ids = [[tri(0, a, b), tri(a, b, 0)], [tri(0, a, b), tri(a, b, 0), tri(0, c, 0)]]
    want = [langid.trigram_vectors(np.array(i)).sum(0) for i in ids]
    (_, _, got), = langid.profiles(texts)
    for g, w in zip(got, want, strict=True):
        assert np.allclose(g, w / np.linalg.norm(w), atol=1e-6)
    once = langid._letters(langid.DIM)
    assert np.array_equal(langid.trigram_vectors(np.array([tri(a, b, c)]))[0], np.roll(once[a], 2) * np.roll(once[b], 1) * once[c])


def test_letters_outside_a_to_z_have_their_own_vectors(make_docs):
    rng = np.random.default_rng(5)
    # each pair of alphabets has the same letters modulo 37, and the same words
    pairs = {"l1": 0x4E00, "l2": 0x4E00 + 37, "l3": 0x430, "l4": 0x1100, "l5": 0x5D0}
    words = [rng.integers(0, 12, 5) for _ in range(30)]
    texts, langs = [], []
    for _ in range(16):
        for lang, first in pairs.items():
            texts.append(" ".join("".join(chr(first + int(k)) for k in words[w]) for w in rng.integers(0, 30, 20)))
            langs.append(lang)
    docs = make_docs(texts, langs=langs)
    got = {r["doc_id"]: r["lang_pred"] for r in docs.select("doc_id", langid.predict(docs, *langid.fit(docs.where("doc_id < 40")))["lang_pred"].alias("lang_pred")).collect()}
    assert all(got[i] == langs[i] for i in range(40, 80))


def test_languages_of_hard_rows(hard, empty):
    got = langid.identify(hard).collect()
    assert len(got) == 14
    assert all((r["lang_pred"] == "und") == (r["score"] == 0) for r in got)
    assert sum(r["lang_pred"] == "und" for r in got) == 5
    assert langid.identify(empty).count() == 0
    assert {r["lang_pred"] for r in langid.identify(hard.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}
    kept = langid.accepted(hard)
    assert kept.columns == hard.columns and kept.count() == 9


def test_language_ignores_other_columns(documents):
    a = langid.fit(documents)
    b = langid.fit(documents.withColumns({"source": F.lit("x"), "doc_id": F.lit(1).cast("bigint")}).repartition(3))
    assert a[0] == b[0] and np.array_equal(a[1], b[1])


# -- near copies -------------------------------------------------------------------------------------------------------


def brute_components(rows):
    sets = {}
    for i, t in rows:
        w = WORD.findall((t or "").translate(FOLD))
        sets[i] = frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset()
    lists = defaultdict(list)
    for i, s in sets.items():
        for x in s:
            lists[x].append(i)
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, s in sets.items():
        for j, n in Counter(j for x in s for j in lists[x] if j < i).items():
            if 100 * n >= 80 * (len(s) + len(sets[j]) - n):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {i: (len(s), find(i)) for i, s in sets.items()}


def test_components(documents):
    want = brute_components(documents.select("doc_id", "text").collect())
    assert {r[0]: (r[1], r[2]) for r in jaccard.search(documents).collect()} == want
    kept = jaccard.representatives(documents)
    assert {r[0] for r in kept.select("doc_id").collect()} == {c for _, c in want.values()}


def test_chains_and_big_groups(make_docs, monkeypatch):
    rng = np.random.default_rng(1)
    base = [f"w{k}" for k in range(120)]

    def edited(n):
        words = list(base)
        for k in rng.choice(120, n, replace=False):
            words[k] = f"e{rng.integers(1 << 40)}"
        return " ".join(words)

    texts = [edited(int(rng.integers(0, 4))) for _ in range(150)] + [" ".join(base)] * 40
    # a passage that many share, not alike otherwise
    texts += [" ".join(base[:30] + [f"u{i}_{k}" for k in range(60)]) for i in range(60)]
    docs = make_docs(texts)
    want = brute_components(list(enumerate(texts)))
    assert {r[0]: (r[1], r[2]) for r in jaccard.search(docs).collect()} == want
    # lists and neighbourhoods dealt out over many pieces and blocks, in all rounds
    monkeypatch.setattr(jaccard, "PIECE", 8)
    monkeypatch.setattr(jaccard, "BLOCK", 600)
    assert {r[0]: (r[1], r[2]) for r in jaccard.search(docs).collect()} == want


def test_near_copies_of_hard_rows(hard, empty):
    got = jaccard.search(hard.withColumn("n", F.lit(1)))
    rows = {(r["doc_id"], r["n_shingles"]): r["component_id"] for r in got.collect()}
    assert got.count() == 14
    assert rows[(0, 0)] == 0 and rows[(2, 0)] == 2 and rows[(4, 1)] == rows[(5, 1)] == 4 and rows[(7, 3)] == 6 and rows[(None, 3)] == 6 and rows[(None, 0)] is None
    assert jaccard.search(empty).count() == 0
    assert jaccard.representatives(hard).where("doc_id is null").count() == 2


def test_divide_skip_is_counting():
    rng = np.random.default_rng(5)
    q = np.unique(rng.integers(0, 400, 200).astype(np.uint64))
    sets = [np.unique(np.concatenate([rng.choice(q, int(rng.integers(1, len(q))), replace=False), rng.integers(0, 400, int(rng.integers(0, 60))).astype(np.uint64)])) for _ in range(80)]
    want = [k for k, s in enumerate(sets) if 100 * len(np.intersect1d(q, s)) >= 80 * len(np.union1d(q, s))]
    index = jaccard.Index([*sets, q])
    found = index.find(80, np.arange(81) < 80)
    assert found.tolist() == want and 0 < len(want) < 80
    assert index.find(80, np.arange(81) < 40).tolist() == [k for k in want if k < 40]


@pytest.mark.parametrize("seed", range(4))
def test_links_of_a_block(seed):
    rng = np.random.default_rng(seed)
    base = rng.integers(0, 1 << 62, (3, 60)).astype(np.uint64)
    sets = []
    for _ in range(60):
        s = base[rng.integers(3)].copy()
        s[rng.choice(60, int(rng.integers(0, 12)), replace=False)] = rng.integers(0, 1 << 62, 1)[0]
        sets.append(np.unique(s[: int(rng.integers(40, 61))]))
    sets.append(np.array([5], np.uint64))
    comps = [k // 2 for k in range(61)]

    def joined(pairs):
        label = dict(enumerate(comps))
        for a, b in pairs:
            old, new = label[a], label[b]
            label = {k: new if v == old else v for k, v in label.items()}
        return {frozenset(k for k in label if label[k] == v) for v in label.values()}

    links = [(a, b) for a in range(61) for b in range(a) if 100 * len(np.intersect1d(sets[a], sets[b])) >= 80 * len(np.union1d(sets[a], sets[b]))]
    assert joined(jaccard.links(sets, comps, [True] * 61)) == joined(links)
    asking = [k < 20 for k in range(61)]
    assert joined(jaccard.links(sets, comps, asking)) == joined([(a, b) for a, b in links if asking[a] or asking[b]])


def test_bitmaps_never_rule_out_a_link():
    rng = np.random.default_rng(6)
    for n in (1, 5, 60, 300):
        a = np.unique(rng.integers(0, 1 << 62, n).astype(np.uint64))
        b = np.unique(np.concatenate([a[: int(0.9 * n)], rng.integers(0, 1 << 62, n // 10).astype(np.uint64)]))
        if len(b):
            assert jaccard.differ_at_least(jaccard._bitmap(a), jaccard._bitmap(b)) <= len(np.setxor1d(a, b))
