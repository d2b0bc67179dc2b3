"""WARC, packing, scoring, URL filters, fingerprints and the pipeline."""

import base64
import hashlib
import io
import math
import re
import struct
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from cadastra.llm import langid, minhash, packing, ppm, queries, textbytes, urlfilter, warc

FOLD = {i: i + 32 for i in range(65, 91)}
WORD = re.compile("[^\x20\x09-\x0d]+")
PAGES = "page_id bigint, url string, html string"


def shingles(text):
    w = WORD.findall((text or "").translate(FOLD))
    return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()


# -- kernels -----------------------------------------------------------------------------------------------------------


def test_shingle_counts(documents, make_docs):
    texts = [r[0] for r in documents.select("text").collect()] + [None, "", "a", "A b", "x" * 9000 + " y z w v u", "é à   b c d e"]
    got = []
    for first, last, h, b in textbytes.shingle_runs(pa.array(texts)):
        got += [len(np.unique(h[b[k] : b[k + 1]])) for k in range(last - first)]
    assert got == [len(shingles(t)) for t in texts]


def test_equal_words_hash_alike_wherever_they_stand():
    words = ["a", "ab", "abcdefgh", "abcdefghi", "x" * 5000, "abcdefghij" * 3]
    data = np.frombuffer((" ".join(words * 2)).encode(), np.uint8)
    s, e, _ = textbytes.words(data, np.array([0, len(data)]))
    h = textbytes.word_hashes(data, s, e)
    assert np.array_equal(h[:6], h[6:]) and len(set(h.tolist())) == 6


# -- WARC --------------------------------------------------------------------------------------------------------------


def test_warc_round_trip(spark):
    rows = [(1, "http://x/1", "same"), (2, "http://x/2", "same"), (9, None, "same"), (3, "a\nb", None), (4, "http://x/4", ""), (5, "u", "é" * 70_000), (5, "u", "é" * 70_000), (None, "n", "alone")]
    pages = spark.createDataFrame(rows, PAGES).withColumn("sha", F.lit("clash"))
    got = warc.round_trip(spark, pages).collect()
    assert len(got) == len(rows)
    by = {r["page_id"]: r for r in got}
    digest = lambda t: base64.b32encode(hashlib.sha1(t.encode()).digest()).decode()
    assert [(by[i]["record_type"], by[i]["refers_to"]) for i in (1, 2, 9, 3, 4, 5, None)] == [("revisit", 9), ("revisit", 9), ("response", None), ("revisit", 4), ("response", None), ("response", None), ("response", None)]
    assert (by[1]["payload_bytes"], by[1]["payload_digest"]) == (4, digest("same")) and by[5]["payload_bytes"] == 140_000
    assert warc.round_trip(spark, spark.createDataFrame([], PAGES)).count() == 0


@pytest.mark.parametrize("split", [50, 999, 1 << 20])
def test_ranges_own_what_starts_in_them(split):
    payloads = [bytes([i % 251]) * (i * 37 % 900) + warc._MAGIC * (i % 3) for i in range(120)]
    data = b"".join(warc.record(i, f"http://x/{i}", p, None, level=i % 3) for i, p in enumerate(payloads))
    file = io.BytesIO(data)
    got = [r for s in range(0, len(data), split) for r in warc.scan(file, s, min(s + split, len(data)), len(data))]
    assert [r["page_id"] for r in got] == list(range(120)) and [r["payload"] for r in got] == payloads


def test_least_payload(spark, tmp_path):
    pages = spark.createDataFrame([(1, "u", "abc"), (2, "u", "abc")], PAGES)
    got = warc.read(warc.write(pages, f"file://{tmp_path}/w", least=10))
    assert {r["record_type"] for r in got.collect()} == {"response"}
    assert got.first()["payload"] == b"abc"


def test_damaged_records_are_errors():
    bad = warc.record(1, "u", b"abc", None)
    raw = zlib.decompress(bad, 31).replace(b"abc\r\n", b"abd\r\n")
    with pytest.raises(ValueError):
        warc.parse(raw)


# -- packing -----------------------------------------------------------------------------------------------------------


def check_packing(spark, docs, rows):
    from tokenizers import Tokenizer

    tk = Tokenizer.from_file(queries.tokenizer_path())
    pieces = {}
    for r in rows:
        pieces.setdefault(r["doc_id"], []).append(r)
    texts = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    assert set(pieces) == set(texts)
    for doc, text in texts.items():
        ids = tk.encode(text, add_special_tokens=False).ids + [1]
        at = 0
        for r in sorted(pieces[doc], key=lambda r: r["start"]):
            assert r["start"] == at and r["doc_tokens"] == len(ids)
            assert r["ids_crc32"] == zlib.crc32(struct.pack(f"<{r['length']}I", *ids[at : at + r["length"]]))
            at += r["length"]
        assert at == len(ids)
    seqs = {}
    for r in rows:
        seqs.setdefault(r["sequence_id"], []).append(r)
    padding = total = 0
    for s in seqs.values():
        at = 0
        for r in sorted(s, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 2048
        padding += 0 if at & (at - 1) == 0 else 2048 - at
        total += at
    return padding / total


def test_packing(spark, documents):
    docs = documents.select("doc_id", "text")
    assert check_packing(spark, docs, packing.pack(docs, queries.tokenizer_path()).collect()) < 0.02


def test_packing_of_hard_texts(spark, make_docs, empty):
    docs = make_docs([None, "", " \n ", "don't <|endoftext|>x\u00a0y\u2003z É ǅ", "a\u0301 \u0301b", "no end " * 4000, "x" * 9000, "1234 5.6! what? yes."]).select("doc_id", "text")
    check_packing(spark, docs, packing.pack(docs, queries.tokenizer_path()).collect())
    assert packing.pack(empty, queries.tokenizer_path()).count() == 0
    ids = packing.pack(docs.where("doc_id = 7"), queries.tokenizer_path(), with_ids=True).collect()
    assert sum(len(r["ids"]) for r in ids) == ids[0]["doc_tokens"]


def test_words_give_the_ids_of_whole_texts():
    from tokenizers import Tokenizer

    tk = Tokenizer.from_file(queries.tokenizer_path())
    rng = np.random.default_rng(9)
    signs = list("aZéßÉÀ×÷ÿŉİıǅɏʰ019 \n\t\x0b\x1c\x85\u00a0\u2003'\"!?.,;-<|>№²日\u0301ΣςſK") + ["'s", "'LL", "don't", "'re", "<|endoftext|>", "e\u0301", ". ", "! "]
    texts = ["".join(rng.choice(signs, int(rng.integers(1, 25)))) for _ in range(4000)]
    encoder = packing.Encoder(queries.tokenizer_path(), 50)
    for k in range(0, len(texts), 400):
        ids, _, counts = encoder.encode([t.encode() for t in texts[k : k + 400]])
        for t, got in zip(texts[k : k + 400], np.split(ids, np.cumsum(counts)[:-1]), strict=True):
            assert got.tolist() == [*tk.encode(t, add_special_tokens=False).ids, 1], t
    assert len(encoder.words.place) == len(encoder.pieces.place) == 50


def test_every_sentence_end_may_be_a_cut():
    stops = np.arange(7, 3500, 7)
    at, cost = packing.candidates(np.array([3500]), stops, 3500)
    assert set(stops.tolist()) <= set(at.tolist())
    fine = cost < packing.INNER_COST
    few = packing.plan(at[fine], cost[fine])
    assert all(c % 7 == 0 for c in few) and len(few) <= 4


def test_plans_are_the_cheapest():
    rng = np.random.default_rng(2)
    for _ in range(30):
        total = int(rng.integers(5, 60))
        at = np.unique(np.concatenate([[0, total], rng.integers(0, total, 25), np.arange(0, total, 7)]))
        cost = rng.choice([0, 8, 48], len(at)).astype(int)
        cost[[0, -1]] = 0
        w = 16

        def price(cuts, at=at, cost=cost, w=w):
            pen = dict(zip(at.tolist(), cost.tolist(), strict=True))
            gaps = [b - a for a, b in zip(cuts, cuts[1:], strict=False)]
            return sum((0 if g & (g - 1) == 0 else w - g) + packing.WINDOW_COST for g in gaps) + sum(pen[c] for c in cuts[1:]) if all(g <= w for g in gaps) else math.inf

        best = {0: 0.0}
        for k, p in enumerate(at[1:].tolist(), 1):
            best[p] = min(best[q] + (0 if (p - q) & (p - q - 1) == 0 else w - (p - q)) + packing.WINDOW_COST + cost[k] for q in at[:k].tolist() if p - q <= w)
        got = price(packing.plan(at, cost, w))
        assert got == best[total] < math.inf


# -- scoring -----------------------------------------------------------------------------------------------------------


def brute_ppm(train, text, order):
    """Method D with exclusion, byte by byte, over dicts; a shorter gram counts once for each longer one."""
    grams = Counter()
    for t in train:
        s = b"\n" * order + t
        grams.update(s[i - order : i + 1] for i in range(order, len(s)))
    counts = {}
    while grams:
        for g, n in grams.items():
            counts.setdefault(g[:-1], Counter())[g[-1]] += n
        grams = Counter(g[1:] for g in grams if len(g) > 1)
    s, total = b"\n" * order + text, 0.0
    for i in range(order, len(s)):
        known: set = set()
        for m in range(order, -1, -1):
            node = counts.get(s[i - m : i])
            if node is None:
                continue
            rest = {b: c for b, c in node.items() if b not in known}
            if s[i] in rest:
                total += math.log10((rest[s[i]] - 0.5) / sum(rest.values()))
                break
            if rest:
                total += math.log10(len(rest) / (2 * sum(rest.values())))
            known |= set(node)
        else:
            total -= math.log10(256 - len(known))
    return total


def as_scored(text):
    return b" ".join(WORD.findall(text.translate(FOLD).encode().decode()) and [w.encode() for w in WORD.findall(text.translate(FOLD))]) + b"\n"


@pytest.mark.parametrize("head", [1 << 20, 50])
def test_scores(make_docs, documents, head):
    docs = documents.where("doc_id < 60")
    rows = docs.select("doc_id", "text").collect()
    held = {i: zlib.crc32(str(i).encode()) % 10 == 0 for i, _ in rows}
    train = [t for i, t in rows if not held[i]]
    got = {r["doc_id"]: r for r in ppm.score(docs, *ppm.train(docs.where(~ppm.held_out()), order=3, max_head=head)).collect()}
    c = Counter(w for t in train for w in [*WORD.findall(t.translate(FOLD)), "\n"])
    n, v = sum(c.values()), len(c)
    for i, t in rows:
        toks = [*WORD.findall(t.translate(FOLD)), "\n"]
        r = got[i]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held[i], len(toks), sum(w in c for w in toks), n)
        assert r["base_score"] == pytest.approx(sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in toks))
    for i, t in rows[:12]:
        assert got[i]["score"] == pytest.approx(brute_ppm([as_scored(x) for x in train], as_scored(t), 3))


def test_probabilities_sum_to_one():
    rng = np.random.default_rng(3)
    keys = rng.choice(np.frombuffer(b"abc \n", np.uint8), (4000, 4)).astype(np.uint64)
    packed = (keys[:, 0] << np.uint64(24)) | (keys[:, 1] << np.uint64(16)) | (keys[:, 2] << np.uint64(8)) | keys[:, 3]
    k, c = np.unique(packed, return_counts=True)
    trie = ppm.Trie([(k, c)], 3)
    for ctx in (b"abc", b"\n\n\n", b"zzz", b"zza"):
        every = np.array([int.from_bytes(ctx + bytes([b]), "big") for b in range(256)], np.uint64)
        assert (10 ** trie.score(every)).sum() == pytest.approx(1)


def test_pruned_tries_are_still_probabilities(documents):
    model, _ = ppm.train(documents, order=3, max_grams=300)
    assert len(model.trie.count) < 2000
    for ctx in (b"the", b" th", b"zq!"):
        every = np.array([int.from_bytes(ctx + bytes([b]), "big") for b in range(256)], np.uint64)
        assert (10 ** model.trie.score(every)).sum() == pytest.approx(1)


@pytest.mark.parametrize("order,grams", [(3, 300), (5, 2000), (5, 0)])
def test_scores_do_not_depend_on_what_is_broadcast(make_docs, documents, order, grams):
    strange = make_docs(["zq zq zq the zq", "日本語 é the", None, "the\x01the"], ids=[1000, 1001, 1002, 1003])
    docs = documents.where("doc_id < 60").unionByName(strange)
    learned = documents.where("doc_id < 60").where(~ppm.held_out())
    whole, cut = ({r["doc_id"]: r for r in ppm.score(docs, *ppm.train(learned, order=order, max_grams=n)).collect()} for n in (1 << 21, grams))
    assert len(cut) == len(whole) == 64
    for i, r in whole.items():
        assert cut[i]["score"] == pytest.approx(r["score"], rel=1e-6)
        assert (cut[i]["n_tokens"], cut[i]["n_known"], cut[i]["base_score"]) == (r["n_tokens"], r["n_known"], pytest.approx(r["base_score"]))


def test_better_than_words_on_held_out(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = ppm.score_held_out(docs).where("held_out").agg(F.sum("score"), F.sum("base_score")).first()
    assert got[0] > got[1]


def test_scores_of_hard_rows(hard, empty):
    got = ppm.score_held_out(hard).collect()
    assert len(got) == 14 and all(r["n_tokens"] >= 1 and r["score"] < 0 for r in got)
    assert ppm.score_held_out(empty).count() == 0
    alone = ppm.score(hard, *ppm.train(empty)).where("doc_id = 4").first()
    assert alone["train_tokens"] == 0 and alone["score"] == pytest.approx(-2 * math.log10(256))


# -- URL filters -------------------------------------------------------------------------------------------------------


def brute_rule(url):
    url = url or ""
    host = path = ""
    if "://" in url:
        rest = url.split("://", 1)[1]
        k = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
        host, rest = rest[:k].translate(FOLD), rest[k:]
        path = re.split("[?#]", rest, maxsplit=1)[0]
    best = None
    for act, rule in urlfilter.RULES:
        h, _, p = rule.partition("/")
        if (host == h or host.endswith("." + h)) and path.startswith("/" + p) and (best is None or len(rule) > len(best[1])):
            best = (act, rule)
    return host, path, best


def test_rules(spark):
    urls = [None, "", "no scheme", "http://A.Example.org/es/1", "http://example.org/en/17", "http://org", "http://org/", "http://borg/x", "x://b.com/de/?q", "http://b.com/fr/a://c", "http://n.net/en/1#x/y", "a://b.com#x", "http://x.com/en/12/", "http://x.com/en/12/", "http://[::1]:80/a\nb/%zz?"]
    got = {r["page_id"]: r for r in urlfilter.judge(spark.createDataFrame([(i, u, "") for i, u in enumerate(urls)], PAGES)).collect()}
    assert len(got) == len(urls)
    for i, u in enumerate(urls):
        host, path, best = brute_rule(u)
        r = got[i]
        assert (r["host"], r["path"], r["rule"]) == (host, path, best and best[1])
        assert r["verdict"] == best[0] if best else r["verdict"] in ("allow", "block")
    assert urlfilter.judge(spark.createDataFrame([], PAGES)).count() == 0


def test_templates_learn_from_labels(spark):
    rows = [(f"http://a.com/de/{i}",) for i in range(40)] + [(f"http://a.com/fr/{i}",) for i in range(40)] + [(f"http://b.net/{k}/{i}",) for k in ("de", "fr") for i in range(20)] + [(f"http://c.net/s{i}",) for i in range(100)]
    pages = spark.createDataFrame(rows, "url string").withColumn("page_id", F.monotonically_increasing_id())
    got = {(r["host"], r["template"], r["verdict"]) for r in urlfilter.judge(pages).select("host", "template", "verdict").distinct().collect()}
    assert ("b.net", "de/{n}", "block") in got and ("b.net", "fr/{n}", "allow") in got
    assert {t for h, t, _ in got if h == "c.net"} == {"*"}


def test_templates_below_wildcards(spark):
    urls = [f"http://a.net/u/user{u}x/album{u}{a}x/photo{u}{a}{p}x" for u in range(40) for a in range(3) for p in range(2)]
    pages = spark.createDataFrame([(i, u, "") for i, u in enumerate(urls)], PAGES)
    assert {r[0] for r in urlfilter.judge(pages).select("template").distinct().collect()} == {"u/*/*/*"}


def test_inner_branches_are_merged(spark):
    urls = [f"http://m.com/bad/x/{i}" for i in range(10)] + [f"http://m.com/good/x/{i}" for i in range(30)] + ["http://m.com/bad/y/q", "http://m.com/good/y/q"]
    rules = [("block", "m.com/bad/x/"), ("allow", "m.com/good/x/")]
    got = urlfilter.judge(spark.createDataFrame([(i, u, "") for i, u in enumerate(urls)], PAGES), rules).where("rule IS NULL")
    assert {r["path"]: r["verdict"] for r in got.collect()} == {"/bad/y/q": "block", "/good/y/q": "allow"}


def test_deep_branches_part(spark):
    deep = "a/b/c/d/e/f/g"
    urls = [f"http://{h}.com/{deep}/{k}/{i}" for h in "mn" for k in ("bad", "good") for i in range(30)]
    rules = [("block", f"m.com/{deep}/bad/"), ("allow", f"m.com/{deep}/good/")]
    got = urlfilter.judge(spark.createDataFrame([(i, u, "") for i, u in enumerate(urls)], PAGES), rules).where("host = 'n.com'")
    assert {(r["template"], r["verdict"]) for r in got.collect()} == {(f"{deep}/bad/{{n}}", "block"), (f"{deep}/good/{{n}}", "allow")}


# -- fingerprints ------------------------------------------------------------------------------------------------------


def jaccard(a, b):
    a, b = shingles(a), shingles(b)
    return len(a & b) / len(a | b) if a | b else 1.0


@pytest.mark.parametrize("runs", [1, 5])
def test_compare_with_next(documents, runs):
    docs = sorted(((r["doc_id"], r["text"]) for r in documents.collect()), reverse=True)
    got = {r["doc_id"]: r for r in minhash.compare_with_next(documents, runs).collect()}
    off = []
    for k, (i, t) in enumerate(docs):
        nxt = docs[(k + 1) % len(docs)][1]
        n = len(t) // 3
        edited = t[: len(t) - n] + nxt[:n]
        r = got[i]
        assert (r["n_chars"], r["edited_sha256"]) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        off += [abs(r["near_edited"] - jaccard(t, edited)), abs(r["near_next"] - jaccard(t, nxt))]
    assert np.mean(off) < 0.03 and len(got) == len(docs)


def test_fingerprints_of_hard_rows(hard, empty):
    got = minhash.compare_with_next(hard, 3).collect()
    assert len(got) == 14
    same = {r["fingerprint"] for r in got if r["n_chars"] == 13}
    assert len(same) == 1
    assert all(r["fingerprint"] == "" for r in got if r["n_chars"] == 0)
    assert minhash.compare_with_next(empty).count() == 0
    assert minhash.fingerprint(hard).count() == 14
    again = minhash.fingerprint(hard.withColumn("fingerprint", F.lit("mine")))
    assert again.columns[-2:] == ["fingerprint", "fingerprint_"] and {r["fingerprint"] for r in again.collect()} == {"mine"}


def test_densified_estimate_is_unbiased():
    rng = np.random.default_rng(9)
    off = []
    for _ in range(150):
        common, extra = rng.integers(0, 1 << 63, 90).astype(np.uint64), rng.integers(0, 1 << 63, (2, 30)).astype(np.uint64)
        h = textbytes.mix(np.concatenate([common, extra[0], common, extra[1]]))
        values, _ = minhash.sketches(h, np.array([0, 120, 240]))
        a, b = (bytes(x) for x in minhash.packed(values))
        off.append(minhash.likeness(a, b) - 90 / 150)
    assert abs(np.mean(off)) < 0.02


# -- pipeline ----------------------------------------------------------------------------------------------------------


def test_pipeline(spark):
    import corpus_pipeline as cp

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    names = docs.columns
    for name, stage in cp.STAGES[:-1]:
        after = cp.materialize(stage(spark, docs, sf), f"test-{name}")
        assert after.columns == names
        if name != "mix":
            assert after.count() <= docs.count() and after.exceptAll(docs).count() == 0
        docs = after
    rows = cp.STAGES[-1][1](spark, docs, sf)
    assert rows.agg(F.sum("length")).first()[0] > 0
    assert {r[0] for r in rows.select("doc_id").distinct().collect()} == {r[0] for r in docs.select("doc_id").distinct().collect()}


def test_language_stage_with_nothing_to_learn_from(make_docs):
    docs = make_docs(["plain words", None, "12 34 ...", "日本語"], langs=[None] * 4)
    docs = docs.withColumn("lang", F.lit(None).cast("string"))
    assert sorted(r["doc_id"] for r in langid.accepted(docs).collect()) == [0, 3]
