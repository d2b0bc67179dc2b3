"""Language-model scoring by prediction by partial matching.

A text is scored as the tokens of its base model are written: words (A-Z
lower-cased) with one space between them and one end after the last. The model
predicts each byte from the ORDER bytes before it (method D): a byte seen c
times after a context seen T times with D different bytes has probability
(c - 1/2) / T; an escape, D / 2T, leads to the context without its first byte,
where the bytes that the longer context knows are excluded; below the empty
context all bytes that are left are equally likely.

The model is pretrained: one pass counts (ORDER + 1)-grams of bytes and words
of all training texts; a shorter gram counts once for each longer one that ends
with it (update exclusion). All grams count, however many there are. Up to
MAX_GRAMS of the longest kind, their trie is laid out in hash tables and
broadcast; a prediction depends on the last bytes only, so all bytes of a batch
are scored at once, level by level. Above that only the most frequent grams are
broadcast, each with its probability in the whole model; the others of each
document are joined to theirs, and for those that no training text has, grams
and contexts of each length are joined on the way down. Grams and contexts of at
most SHORT bytes are joined by broadcast, as their number does not grow with the
corpus. Both ways give the same scores.

The base model's word counts grow with the corpus. The most frequent words, at
most MAX_HEAD, are broadcast; the others of each document are joined to
their counts.

Defined results: null text counts as empty, which is one end; rows with null
doc_id are held out; repeated rows count one by one; with nothing to
learn from the model is uniform over bytes, and the base score is 0 per token
where its formula has no value; extra columns are ignored; an empty table gives
an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize
from .textbytes import chunks, fold, mix, release, word_hashes, words

ORDER = 5
#: Most (ORDER + 1)-grams and most words that are broadcast; the others are joined.
MAX_GRAMS, MAX_HEAD = 1 << 19, 1 << 19
#: Bytes of grams and contexts that are few in any corpus.
SHORT = 3
_END, _SPACE = 10, 32
_WORD, _GRAM = 0, 1
#: The word hash that stands for the end.
_END_HASH = np.int64(-1)
_BATCH = 1 << 20


def _stream(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, bounds: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All texts as they are scored, each after ``order`` ends; the places of the bytes to predict; bounds of those by text."""
    count = np.diff(bounds)
    size = np.concatenate([[0], np.cumsum(ends - starts + 1)])
    length = np.maximum(size[bounds[1:]] - size[bounds[:-1]], 1)
    begin = np.concatenate([[0], np.cumsum(length + order)])
    out = np.full(begin[-1], _END, np.uint8)
    row = np.repeat(np.arange(len(count)), count)
    to = begin[row] + order + size[:-1] - size[bounds[row]]
    # each word with the byte after it, which is then overwritten
    width = ends - starts + 1
    within = np.arange(width.sum()) - np.repeat(size[:-1], width)
    source = np.minimum(np.repeat(starts, width) + within, max(len(data) - 1, 0))
    place = np.repeat(to, width) + within
    if len(source):
        out[place] = data[source]
    after = to + ends - starts
    out[after] = _SPACE
    last = bounds[1:][count > 0] - 1
    out[after[last]] = _END
    keep = np.ones(len(out), bool)
    keep[(begin[:-1, None] + np.arange(order)).ravel()] = False
    return out, np.flatnonzero(keep), np.concatenate([[0], np.cumsum(length)])


def _keys(stream: np.ndarray, places: np.ndarray, order: int) -> np.ndarray:
    """The last order + 1 bytes up to each place, the last one lowest."""
    n = len(stream) - order
    key = np.zeros(n, np.uint64)
    for k in range(order + 1):
        key = (key << np.uint64(8)) | stream[k : k + n]
    return key[places - order]


def _merge(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    keys, counts = np.concatenate([k for k, _ in parts]), np.concatenate([c for _, c in parts])
    by = np.argsort(keys, kind="stable")
    keys, counts = keys[by], counts[by]
    first = np.ones(len(keys), bool)
    first[1:] = keys[1:] != keys[:-1]
    return keys[first], np.add.reduceat(counts, np.flatnonzero(first)) if len(keys) else counts


class _Counter:
    """Counts of 64-bit keys; sent on when there are many."""

    def __init__(self, kind: int, limit: int = 1 << 20):
        self.kind, self.limit, self.parts, self.size = kind, limit, [], 0

    def add(self, keys: np.ndarray) -> Iterator[pa.RecordBatch]:
        keys = np.sort(keys)
        first = np.ones(len(keys), bool)
        first[1:] = keys[1:] != keys[:-1]
        at = np.flatnonzero(first)
        self.parts.append((keys[at], np.diff(at, append=len(keys))))
        self.size += len(at)
        if self.size > 2 * self.limit:
            self.parts = [_merge(self.parts)]
            self.size = len(self.parts[0][0])
            if self.size > self.limit:
                yield from self.flush()

    def flush(self) -> Iterator[pa.RecordBatch]:
        if self.parts:
            keys, counts = _merge(self.parts)
            self.parts, self.size = [], 0
            for k in range(0, len(keys), 100_000):
                part = keys[k : k + 100_000]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(part), self.kind, np.int8)), pa.array(part.view(np.int64)), pa.array(counts[k : k + 100_000].astype(np.int64))], names=["kind", "key", "n"])


def _count(batches: Iterator[pa.RecordBatch], order: int) -> Iterator[pa.RecordBatch]:
    of_words, of_grams = _Counter(_WORD), _Counter(_GRAM)
    for b in batches:
        for first, last, data, offsets in chunks(b.column(0), _BATCH):
            data = fold(data)
            starts, ends, bounds = words(data, offsets)
            yield from of_words.add(np.concatenate([word_hashes(data, starts, ends), np.full(last - first, _END_HASH).view(np.uint64)]))
            stream, places, _ = _stream(data, starts, ends, bounds, order)
            yield from of_grams.add(_keys(stream, places, order))
    yield from of_words.flush()
    yield from of_grams.flush()
    release()


class Lookup:
    """An open-addressing table from distinct 64-bit keys to their places."""

    def __init__(self, keys: np.ndarray):
        bits = max(4, int(2 * len(keys)).bit_length())
        self.mask = np.uint64((1 << bits) - 1)
        self.keys = np.zeros(1 << bits, np.uint64)
        self.at = np.full(1 << bits, -1, np.int32)
        left = np.arange(len(keys), dtype=np.int32)
        slot = mix(keys) & self.mask
        while len(left):
            free = self.at[slot] < 0
            self.at[slot[free]] = left[free]  # of several for a slot one stays
            placed = self.at[slot] == left
            self.keys[slot[placed]] = keys[left[placed]]
            left, slot = left[~placed], (slot[~placed] + np.uint64(1)) & self.mask

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The places of keys, -1 where there are none."""
        slot = mix(keys) & self.mask
        at = self.at[slot]
        other = np.flatnonzero((at >= 0) & (self.keys[slot] != keys))
        while len(other):
            slot[other] = (slot[other] + np.uint64(1)) & self.mask
            at[other] = self.at[slot[other]]
            other = other[(at[other] >= 0) & (self.keys[slot[other]] != keys[other])]
        return at


def _tag(keys: np.ndarray, length: int) -> np.ndarray:
    """The last ``length`` bytes of keys, marked with that length."""
    return (keys & np.uint64((1 << (8 * length)) - 1)) | np.uint64(length << 56)


class Trie:
    """Contexts of 0 to ``order`` bytes and what follows them."""

    def __init__(self, kept: list[tuple[np.ndarray, np.ndarray]], order: int = ORDER):
        """kept: grams and their counts, the longest kind first; of shorter kinds those that no longer one here ends with, too."""
        self.order = order
        grams, gram_counts, contexts, totals, kinds = [], [], [], [], []
        levels: list[tuple[np.ndarray, np.ndarray]] = []
        for m in range(order + 1, 0, -1):
            k, c = kept[order + 1 - m] if order + 1 - m < len(kept) else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
            longer = levels[-1][0] if levels else np.zeros(0, np.uint64)
            levels.append(_merge([(_tag(k, m), c.astype(np.int64)), (_tag(longer, m), np.ones(len(longer), np.int64))]))
        keys = levels[0][0]
        for m in range(1, order + 2):
            k, c = levels[order + 1 - m]
            grams.append(k)
            gram_counts.append(c)
            owner, first = np.unique(_tag(k >> np.uint64(8), m - 1), return_index=True) if len(k) else (k, k)
            contexts.append(owner)
            totals.append(np.add.reduceat(c, first) if len(k) else c)
            kinds.append(np.diff(first, append=len(k)) if len(k) else c)
        self.grams, self.nodes = Lookup(np.concatenate(grams)), Lookup(np.concatenate(contexts))
        self.count = np.concatenate(gram_counts).astype(np.float64)
        self.total, self.kind = np.concatenate(totals).astype(np.float64), np.concatenate(kinds).astype(np.float64)
        # what is left at the parent (the context without its first byte) when a node's own bytes are excluded
        self.rest, self.rest_kind = np.zeros(len(self.total)), np.zeros(len(self.total))
        for m in range(2, order + 2):
            owner = self.nodes.find(_tag(grams[m - 1] >> np.uint64(8), m - 1))
            shorter = self.grams.find(_tag(grams[m - 1], m - 1))
            node = self.nodes.find(contexts[m - 1])
            parent = self.nodes.find(_tag(contexts[m - 1], m - 2))
            known = np.bincount(owner, self.count[shorter], len(self.total))
            self.rest[node] = self.total[parent] - known[node]
            self.rest_kind[node] = self.kind[parent] - self.kind[node]
        # most bytes are known after their longest context
        top = len(self.count) - len(grams[order])
        node = self.nodes.find(_tag(grams[order] >> np.uint64(8), order)) if len(keys) else np.zeros(0, np.int64)
        self.known = np.full(len(self.count), 0.0, np.float32)
        self.known[top:] = np.log10((self.count[top:] - 0.5) / self.total[node]) if len(keys) else 0

        # what is found nowhere (-1) is the last of each
        self.count, self.total, self.known = np.append(self.count, 1.0), np.append(self.total, 1.0), np.append(self.known, np.float32(0))
        self.kind, self.rest, self.rest_kind = np.append(self.kind, 0.0), np.append(self.rest, 1.0), np.append(self.rest_kind, 0.0)

    def score(self, keys: np.ndarray) -> np.ndarray:
        """log10 of the probability of each last byte after those before it."""
        found = self.grams.find(_tag(keys, self.order + 1))
        out = np.where(found >= 0, self.known[np.maximum(found, 0)], 0.0).astype(np.float64)
        left = np.flatnonzero(found < 0)
        above = np.full(len(left), -1, np.int64)  # the node that was escaped from
        for length in range(self.order, -1, -1):
            if not len(left):
                return out
            key = keys[left]
            if length < self.order:
                gram = self.grams.find(_tag(key, length + 1))
                node = self.nodes.find(_tag(key >> np.uint64(8), length))
                total = np.where(above >= 0, self.rest[above], self.total[node])
                hit = gram >= 0
                out[left[hit]] += np.log10((self.count[gram[hit]] - 0.5) / total[hit])
                left, node, above, total = left[~hit], node[~hit], above[~hit], total[~hit]
                kind = np.where(above >= 0, self.rest_kind[above], self.kind[node])
            else:
                node = self.nodes.find(_tag(key >> np.uint64(8), length))
                total, kind = self.total[node], self.kind[node]
            met = (node >= 0) & (kind > 0)  # an escape is certain where nothing is left to predict
            out[left[met]] += np.log10(kind[met] / (2 * total[met]))
            above = np.where(node >= 0, node, -1)
        root = self.nodes.find(np.zeros(1, np.uint64))[0]
        out[left] -= math.log10(256 - (self.kind[root] if root >= 0 else 0)) if len(left) else 0.0
        return out


class Model:
    """The trie and the base model."""

    def __init__(self, trie: Trie, head: np.ndarray, head_counts: np.ndarray, tokens: int, kinds: int, head_is_all: bool, frequent: tuple[np.ndarray, np.ndarray] | None = None):
        """frequent: where the trie has not all grams, those it has of the longest kind, and log10 of their probabilities among all."""
        self.trie, self.order, self.tokens, self.kinds, self.head_is_all = trie, trie.order, tokens, kinds, head_is_all
        self.words, self.word_counts = Lookup(head), np.append(head_counts, 0)
        self.trie_is_all = frequent is None
        if frequent is not None:
            self.frequent, self.frequent_known = Lookup(frequent[0]), np.append(frequent[1], 0.0)

    def __getstate__(self) -> dict:
        """Workers score by a trie that has all grams, or by the frequent grams alone."""
        return self.__dict__ if self.trie_is_all else self.__dict__ | {"trie": None}

    def base(self, counts: np.ndarray) -> np.ndarray:
        return np.log10((counts + 0.1) / (self.tokens + 0.1 * (self.kinds + 1)))

    def _score_grams(self, keys: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Score of each text by what is broadcast; of the grams left: how many distinct ones each text has, the grams, their times there."""
        n = len(bounds) - 1
        if self.trie_is_all:
            each, left = self.trie.score(keys), np.zeros(0, np.int64)
        else:
            at = self.frequent.find(keys)
            each, left = self.frequent_known[at], np.flatnonzero(at < 0)
        row, key = np.searchsorted(bounds, left, "right") - 1, keys[left]
        by = np.lexsort((key, row))
        row, key = row[by], key[by]
        first = np.ones(len(key), bool)
        first[1:] = (key[1:] != key[:-1]) | (row[1:] != row[:-1])
        at = np.flatnonzero(first)
        return np.add.reduceat(each, bounds[:-1]), (np.bincount(row[at], minlength=n), key[at].view(np.int64), np.diff(at, append=len(key)))

    def score(self, texts: pa.Array) -> Iterator[tuple[int, int, tuple[np.ndarray, ...], list[np.ndarray], tuple[np.ndarray, np.ndarray, np.ndarray]]]:
        """First and last row of runs of texts; tokens, known tokens and base score of what the head has, and score; hashes of the other words; grams that are left."""
        for first, last, data, offsets in chunks(texts, _BATCH):
            data = fold(data)
            starts, ends, bounds = words(data, offsets)
            h = word_hashes(data, starts, ends)
            at = self.words.find(h)
            counts = self.word_counts[at]
            in_head = (at >= 0) | self.head_is_all
            row = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
            n = len(bounds) - 1
            end = self.words.find(np.array([_END_HASH]).view(np.uint64))[0]
            end_count = self.word_counts[end]
            base = np.bincount(row, np.where(in_head, self.base(counts), 0.0), n) + self.base(np.float64(end_count))
            known = np.bincount(row, counts > 0, n).astype(np.int64) + int(end_count > 0)
            rest = np.flatnonzero(~in_head)
            tail = np.split(h[rest].view(np.int64), np.searchsorted(rest, bounds[1:-1]))
            stream, places, where = _stream(data, starts, ends, bounds, self.order)
            scores, left = self._score_grams(_keys(stream, places, self.order), where)
            yield first, last, (np.diff(bounds) + 1, known, base, scores), tail, left


def _at_least(counts: DataFrame, most: int) -> int:
    """The least count that at most ``most`` keys reach."""
    steps = counts.groupBy((F.floor(F.log2("n") * 8) / 8).alias("step")).agg(F.count(F.lit(1)).alias("keys"), F.min("n").alias("least")).orderBy(F.desc("step")).collect()
    total, least = 0, 1 << 62
    for s in steps:  # eight steps for each doubling
        total += s["keys"]
        if total > most:
            return least
        least = s["least"]
    return 1


def _arrays(rows: DataFrame, value: str = "n") -> tuple[np.ndarray, np.ndarray]:
    found = rows.select("key", value).toArrow()
    keys = found.column("key").to_numpy().view(np.uint64)
    by = np.argsort(keys)
    return keys[by], found.column(value).to_numpy()[by]


class Tail(NamedTuple):
    """What is joined to texts: counts of the words that are not broadcast; all grams, the longest kind first, if not all are broadcast."""

    words: DataFrame
    grams: list[DataFrame]
    least: int


def _ends(length: int, key: str = "key") -> Column:
    return F.col(key).bitwiseAND(F.lit((1 << (8 * length)) - 1))


def train(docs: DataFrame, order: int = ORDER, max_grams: int = MAX_GRAMS, max_head: int = MAX_HEAD) -> tuple[Model, Tail]:
    """The model of docs' texts, and what of it is not broadcast."""
    partial = docs.select("text").mapInArrow(lambda it: _count(it, order), "kind tinyint, key bigint, n bigint")
    counts = materialize(partial.groupBy("kind", "key").agg(F.sum("n").alias("n")), "lm-counts")
    grams, found = counts.where(F.col("kind") == _GRAM).select("key", "n"), counts.where(F.col("kind") == _WORD)
    tokens, kinds = found.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    limit = _at_least(grams, max_grams)
    frequent, levels = None, []
    if limit > 1:
        total = F.sum("n").over(Window.partitionBy(F.shiftright("key", 8)))  # at most 256 grams have one context
        levels = [materialize(grams.withColumn("known", F.log10((F.col("n") - 0.5) / total)), "lm-grams")]
        for length in range(order, 0, -1):
            levels.append(materialize(levels[-1].groupBy(_ends(length).alias("key")).agg(F.count(F.lit(1)).alias("n")), "lm-ends"))
        frequent = _arrays(levels[0].where(F.col("n") >= limit), "known")
    trie = Trie([_arrays(grams.where(F.col("n") >= limit))], order)
    least = _at_least(found, max_head)
    is_end = F.col("key") == int(_END_HASH)
    head, head_n = _arrays(found.where((F.col("n") >= least) | is_end))
    model = Model(trie, head, head_n, tokens, kinds, least <= 1, frequent)
    return model, Tail(found.where((F.col("n") < least) & ~is_end).select("key", "n"), levels, limit)


def _few(rows: DataFrame, length: int) -> DataFrame:
    return F.broadcast(rows) if length <= SHORT else rows


def _escaped(keys: DataFrame, grams: list[DataFrame]) -> DataFrame:
    """key, known: log10 of the probabilities of grams that are not among those of the longest kind, from the counts of all kinds."""
    order = len(grams) - 1
    out = keys.select("key", F.shiftright("key", 8).alias("_up"), F.lit(0.0).alias("known"), F.lit(False).alias("hit"), F.lit(0).cast("bigint").alias("above"), F.lit(0).cast("bigint").alias("above_kind"))
    for length in range(order, -1, -1):
        level = grams[order - length].select("key", "n")
        if length:  # what a context's bytes count after the context without its first byte is left out there
            shorter = grams[order - length + 1].select(F.col("key").alias("_end"), F.col("n").alias("_n"))
            level = level.join(_few(shorter, length), _ends(length) == F.col("_end"))
        nodes = level.groupBy(F.shiftright("key", 8).alias("_ctx")).agg(F.sum("n").alias("_total"), F.count(F.lit(1)).alias("_kind"), (F.sum("_n") if length else F.lit(0)).alias("_above"))
        out = out.join(_few(nodes, length), _ends(length, "_up") == F.col("_ctx"), "left")
        if length < order:
            own = grams[order - length].select(F.col("key").alias("_gram"), F.col("n").alias("_count"))
            out = out.join(_few(own, length + 1), _ends(length + 1) == F.col("_gram"), "left")
        else:
            out = out.withColumn("_count", F.lit(None).cast("bigint"))
        total, kind = F.col("_total") - F.col("above"), F.col("_kind") - F.col("above_kind")
        step = F.when(F.col("hit"), 0.0).when(F.col("_count").isNotNull(), F.log10((F.col("_count") - 0.5) / total)).when(kind > 0, F.log10(kind / (2 * total))).otherwise(0.0)
        out = out.select(
            "key",
            "_up",
            (F.col("known") + step).alias("known"),
            (F.col("hit") | F.col("_count").isNotNull()).alias("hit"),
            F.coalesce("_above", F.lit(0)).alias("above"),
            F.coalesce("_kind", F.lit(0)).alias("above_kind"),
        )
    # after the empty context, bytes that it does not know
    return out.select("key", (F.col("known") - F.when(F.col("hit"), 0.0).otherwise(F.log10(256 - F.col("above_kind")))).alias("known"))


def score(docs: DataFrame, model: Model, tail: Tail) -> DataFrame:
    """uid, doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score: a row for each row of docs."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for first, last, cols, words_left, (per, keys, times) in held.value.score(b.column(2)):
                items = pa.StructArray.from_arrays([pa.array(keys, pa.int64()), pa.array(times, pa.int64())], names=["key", "times"])
                grams_left = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(per)]), pa.int32()), items)
                own = [c.slice(first, last - first) for c in (b.column(0), b.column(1))]
                yield pa.RecordBatch.from_arrays([*own, *(pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.float64(), pa.float64()), strict=True)), pa.array(words_left, pa.list_(pa.int64())), grams_left], names=["doc_id", "held_out", "n_tokens", "n_known", "base_score", "score", "tail", "grams"])

    rows = docs.select(F.col("doc_id").cast("bigint"), held_out().alias("held_out"), "text")
    rows = rows.mapInArrow(work, "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, base_score double, score double, tail array<bigint>, grams array<struct<key:bigint,times:bigint>>")
    base = lambda c: F.log10((c + 0.1) / (model.tokens + 0.1 * (model.kinds + 1)))
    out = ["doc_id", "held_out", "n_tokens", "n_known", F.lit(model.tokens).cast("bigint").alias("train_tokens"), "base_score", "score"]
    if model.head_is_all and model.trie_is_all:
        return rows.select(*out)
    scored = rows = materialize(rows.withColumn("uid", F.monotonically_increasing_id()), "lm-scores")
    rows = rows.drop("tail", "grams")
    if not model.head_is_all:
        rest = scored.select("uid", F.explode("tail").alias("key")).join(tail.words, "key", "left")
        rest = rest.groupBy("uid").agg(F.sum(base(F.coalesce("n", F.lit(0)))).alias("more"), F.count("n").alias("more_known"))
        rows = rows.join(rest, "uid", "left")
        rows = rows.withColumns({"n_known": F.col("n_known") + F.coalesce("more_known", F.lit(0)), "base_score": F.col("base_score") + F.coalesce("more", F.lit(0.0))})
    if not model.trie_is_all:
        left = scored.select("uid", F.inline("grams"))
        rare = tail.grams[0].where(F.col("n") < tail.least).select("key", "known")
        unseen = left.select("key").distinct().join(rare, "key", "left_anti")
        known = rare.unionByName(_escaped(unseen, tail.grams))
        more = left.join(known, "key").groupBy("uid").agg(F.sum(F.col("known") * F.col("times")).alias("more_score"))
        rows = rows.join(more, "uid", "left").withColumn("score", F.col("score") + F.coalesce("more_score", F.lit(0.0)))
    return rows.select(*out)


def held_out(mod: int = 10):
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(0)) % mod == 0


def score_held_out(docs: DataFrame) -> DataFrame:
    """All rows of docs, scored by a model of those that are not held out."""
    return score(docs, *train(docs.where(~held_out())))
