"""N-gram Jaccard join: all links between texts whose shingle sets are alike, exactly.

A document's set holds the hashes (64 bits) of its runs of five words. Two
documents link when 100 * common >= 80 * united. Documents with equal sets form
a class; one stands for all. The T-occurrence search:

1. All sets are put in one order, frequent shingles last. Two linked sets must
   share a shingle among the first floor(n / 5) + 1 of their order (that is
   the T-occurrence bound turned round: of the lists of a query all but the
   T - 1 longest must hold a result). Only those short lists are written:
   postings are dealt out by shingle, lists with one member go, and of lists
   with the same members one stays.
2. A parity bitmap of each set, two to four bits a shingle, bounds from below
   how much two sets differ. In each list members of fitting size whose
   bitmaps allow a link are joined, by a forest of such pairs; what is joined
   through any list is a neighbourhood, which no link leaves. First each member
   is compared in its longest list alone, then in all lists whose members are
   still apart. Lists above PIECE members are dealt into pieces anew in each
   round, then those of their pieces that are still apart meet two by two.
3. The texts of a neighbourhood meet in a block with an inverted index of all
   their shingles. Each document asks it, by DivideSkip: its short lists are
   merged by a heap, and documents that occur there often enough are probed for
   in the long lists by binary search while they can still reach the required
   overlap; those that reach it link. What is linked already is not asked for
   again, so a group of near copies does not make all pairs. A neighbourhood
   above BLOCK shingles or BLOCK_DOCS documents is dealt into blocks, anew in each
   round; then the documents outside its largest component visit all its blocks.

Components are found by label propagation with pointer jumping; every round is
written to the shared folder, and removed when the next one is there.

Defined results: null and empty texts, and texts without words, have an
empty set (size 0) and are linked with nothing; a row's component_id is its own
doc_id if it has no links, and null if it has neither doc_id nor copies with
one; texts whose smallest doc_id is the same count as one; an empty table
gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, join_groups, materialize
from .textbytes import release, shingle_runs

WIDTH, PERCENT = 5, 80
#: So many of the most frequent shingles are known to the order of all sets; any number gives the same result.
FREQUENT = 1 << 16
#: A shingle is counted where a run of texts has it so often.
LOCAL_COUNT = 3
#: Bytes of texts that are cut into shingles at once.
RUN = 2 << 20
#: Members of a list that are compared in one place; most shingles and most documents of a block of the index.
PIECE, BLOCK, BLOCK_DOCS = 1024, 1 << 19, 2048
#: Rounds in which pieces and blocks are dealt anew before those that are still apart meet.
ROUNDS = 2
#: Most bits of a bitmap, and most rows that are broadcast to find the texts of a round (beyond that they are joined).
MAX_BITS, MAX_ASKED = 1 << 16, 500_000
#: DivideSkip's weight of probing a long list against merging it, and lists probed at a time.
_MU, _PROBES = 0.001, 64
_DOC, _SHINGLE = 0, 1


def _sets(texts: pa.Array) -> Iterator[tuple[int, list[np.ndarray]]]:
    """First row and sorted sets of runs of texts."""
    for first, last, hashes, bounds in shingle_runs(texts, WIDTH, RUN):
        b = bounds.tolist()
        yield first, [np.unique(hashes[b[k] : b[k + 1]]) for k in range(last - first)]


def _digest(s: np.ndarray) -> bytes:
    return hashlib.blake2b(s.tobytes(), digest_size=16).digest()


def _short(digest: bytes) -> int:
    """Eight bytes of a digest, by which postings know a set; two sets that share them are only compared once more."""
    return int.from_bytes(digest[:8], "little", signed=True)


def _bitmap(s: np.ndarray) -> bytes:
    """Parity of the number of shingles by their low bits."""
    bits = max(8, min(MAX_BITS, 2 << (len(s) - 1).bit_length()))
    odd = np.bincount((s & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def differ_at_least(a: bytes, b: bytes) -> int:
    """A lower bound of the shingles that only one of two sets has; the longer bitmap is folded."""
    x, y = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
    while len(x) != len(y):
        if len(x) > len(y):
            x = x[: len(x) // 2] ^ x[len(x) // 2 :]
        else:
            y = y[: len(y) // 2] ^ y[len(y) // 2 :]
    return int(np.bitwise_count(x ^ y).sum())


def prefix_length(n: int, percent: int = PERCENT) -> int:
    return n - (percent * n + 99) // 100 + 1


def required(n, m, percent: int = PERCENT):
    """The least overlap of linked sets of sizes n and m."""
    return -(-percent * (n + m) // (100 + percent))


# -- short lists -------------------------------------------------------------------------------------------------------


def _survey(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["kind", "id", "n", "digest", "h", "bits"]
    for b in batches:
        ids = b.column(0)
        for first, sets in _sets(b.column(1)):
            k = len(sets)
            digests = [_digest(s) if len(s) else None for s in sets]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(k, _DOC, np.int8)), ids.slice(first, k), pa.array([len(s) for s in sets], pa.int64()), pa.array(digests, pa.binary()), pa.array([_short(d) if d else None for d in digests], pa.int64()), pa.array([_bitmap(s) if len(s) else None for s in sets], pa.binary())], names=names)
            distinct = {d: s for d, s in zip(digests, sets, strict=True) if d is not None}
            if distinct:
                found, count = np.unique(np.concatenate(list(distinct.values())), return_counts=True)
                often = count >= LOCAL_COUNT
                if often.any():
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(int(often.sum()), _SHINGLE, np.int8)), pa.array(found[often].view(np.int64)), pa.array(count[often].astype(np.int64)), pa.nulls(int(often.sum()), pa.binary()), pa.nulls(int(often.sum()), pa.int64()), pa.nulls(int(often.sum()), pa.binary())], names=names)
    release()


def _postings(batches: Iterator[pa.RecordBatch], frequent: np.ndarray, rank: np.ndarray) -> Iterator[pa.RecordBatch]:
    """The shingles of each set that come first in the order of all sets."""
    seen: set[int] = set()
    for b in batches:
        known = np.asarray(b.column(0).is_valid())
        for first, sets in _sets(b.column(1)):
            tokens, docs, sizes = [], [], []
            for k, s in enumerate(sets):
                if not len(s) or not known[first + k]:
                    continue
                h = _short(_digest(s))
                if h in seen:
                    continue
                seen.add(h)
                p, n = prefix_length(len(s)), len(s)
                if len(frequent):
                    at = np.minimum(np.searchsorted(frequent, s), len(frequent) - 1)
                    hot = frequent[at] == s
                    if hot.any():
                        rare = s[~hot]
                        s = np.concatenate([rare, s[hot][np.argsort(rank[at[hot]])]]) if len(rare) < p else rare
                tokens.append(s[:p])
                docs.append(h)
                sizes.append(n)
            if tokens:
                per = [len(t) for t in tokens]
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(tokens).view(np.int64)), pa.array(np.repeat(np.array(docs, np.int64), per)), pa.array(np.repeat(np.array(sizes, np.int32), per))], names=["token", "h", "n"])
    release()


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in the order of token and set: each set once, of tokens with several sets. Nothing is held but the last row."""
    last: tuple | None = None  # token, h, n, sent
    for b in batches:
        token, h, n = (b.column(k).to_numpy(zero_copy_only=False) for k in range(3))
        if not len(token):
            continue
        if last is not None:
            token, h, n = np.append(last[0], token), np.append(last[1], h), np.append(last[2], n).astype(np.int32)
        new = np.ones(len(token), bool)
        new[1:] = (token[1:] != token[:-1]) | (h[1:] != h[:-1])
        token, h, n = token[new], h[new], n[new]
        same = token[1:] == token[:-1]
        keep = np.zeros(len(token), bool)
        keep[1:] |= same
        keep[:-1] |= same
        sent = bool(keep[-1])
        if last is not None and last[3]:
            keep[0] = False
            sent |= len(token) == 1
        last = (token[-1], h[-1], n[-1], sent)
        if keep.any():
            yield pa.RecordBatch.from_arrays([pa.array(token[keep]), pa.array(h[keep]), pa.array(n[keep])], names=["token", "h", "n"])


# -- neighbourhoods ----------------------------------------------------------------------------------------------------


class _Shelf:
    """Members of a list with bitmaps of one length, in order of size."""

    def __init__(self, width: int):
        self.n, self.ids, self.sizes, self.comps, self.sides = 0, *(np.zeros(4, np.int64) for _ in range(4))
        self.bits = np.zeros((4, width), np.uint8)

    def add(self, i: int, size: int, comp: int, side: int, bits: np.ndarray) -> None:
        if self.n == len(self.ids):
            self.ids, self.sizes, self.comps, self.sides = (np.concatenate([x, np.zeros_like(x)]) for x in (self.ids, self.sizes, self.comps, self.sides))
            self.bits = np.concatenate([self.bits, np.zeros_like(self.bits)])
        k = self.n
        self.ids[k], self.sizes[k], self.comps[k], self.sides[k], self.bits[k] = i, size, comp, side, bits
        self.n = k + 1


def _likely(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in the order of their piece and n: a forest of the pairs of each piece whose bitmaps allow a link.

    Members of one comp are joined already; where a piece has two sides, only pairs across count.
    """
    key, shelves, place = None, {}, {}
    for b in batches:
        a_side: list[int] = []
        b_side: list[int] = []
        for token, i_piece, j_piece, n, i, comp, side, bits in zip(*(b.column(k).to_pylist() for k in range(8)), strict=True):
            if key != (token, i_piece, j_piece):
                key, shelves, place = (token, i_piece, j_piece), {}, {}
            # what is joined shares a mark: place leads from a comp to it
            mine = place.setdefault(comp, len(place))
            own = np.frombuffer(bits, np.uint8)
            # smaller sets came before: they have as many bits, or half as many
            for width in {len(own), len(own) // 2} & shelves.keys():
                shelf = shelves[width]
                first = int(np.searchsorted(shelf.sizes[: shelf.n], -(-PERCENT * n // 100)))
                ok = shelf.comps[first : shelf.n] != mine
                if i_piece != j_piece:
                    ok &= shelf.sides[first : shelf.n] != side
                at = np.flatnonzero(ok) + first
                if not len(at):
                    continue
                folded = own if width == len(own) else own[:width] ^ own[width:]
                apart = np.bitwise_count(shelf.bits[at] ^ folded).sum(1, dtype=np.int64)
                sizes = shelf.sizes[at]
                for k in at[apart <= n + sizes - 2 * required(n, sizes)].tolist():
                    theirs = int(shelf.comps[k])
                    if theirs == mine:
                        continue
                    a_side.append(int(shelf.ids[k]))
                    b_side.append(i)
                    for s in shelves.values():
                        s.comps[: s.n][s.comps[: s.n] == theirs] = mine
                    for c in [c for c, m in place.items() if m == theirs]:
                        place[c] = mine
            if len(own) not in shelves:
                shelves[len(own)] = _Shelf(len(own))
            shelves[len(own)].add(i, n, mine, side, own)
        if a_side:
            yield pa.RecordBatch.from_arrays([pa.array(a_side, pa.int64()), pa.array(b_side, pa.int64())], names=["a", "b"])


def _deal(parts: Column, turn: int, last: bool) -> Column:
    """The pieces (i, j) that a member goes to, and its side there: one piece, or in the last round each pair with its own."""
    own = F.pmod(F.xxhash64("id", F.lit(turn)), parts)
    if not last:
        return F.array(F.struct(own.alias("i"), own.alias("j"), own.alias("side")))
    return F.transform(F.sequence(F.lit(0).cast("bigint"), parts - 1), lambda q: F.struct(F.least(own, q).alias("i"), F.greatest(own, q).alias("j"), own.alias("side")))


def neighbourhoods(members: DataFrame, bits: DataFrame) -> DataFrame:
    """node, comp: of the members (token, m, n, h, id) of lists those that a chain of likely pairs joins."""
    labels: DataFrame | None = None
    # first each member in its longest list alone, which joins most of a group of copies
    rows = members.groupBy("h", "id", "n").agg(F.max(F.struct("m", "token")).alias("at")).select("at.token", "at.m", "n", "h", "id", F.col("id").alias("comp"))
    for turn in range(-1, ROUNDS + 1):
        if turn >= 0:
            rows = members if turn == 0 else members.where(F.col("m") > PIECE)
            rows = rows.join(labels.select(F.col("node").alias("id"), "comp"), "id", "left").withColumn("comp", F.coalesce("comp", "id"))
            apart = rows.groupBy("token").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi").select("token")
            rows = materialize(rows.join(apart, "token"), "jac-open")
            if rows.isEmpty():
                break
        parts = F.ceil(F.col("m") / PIECE)
        dealt = rows.join(bits, "h").withColumn("at", F.explode(_deal(parts, turn, turn == ROUNDS)))
        dealt = dealt.select("token", "at.i", "at.j", "n", "id", "comp", "at.side", "bits").repartition("token", "i", "j").sortWithinPartitions("token", "i", "j", "n", "id")
        joined = dealt.mapInArrow(_likely, "a bigint, b bigint").distinct()
        labels = _with(joined, labels)
    return labels


# -- the search --------------------------------------------------------------------------------------------------------


class Index:
    """Inverted lists of the shingles of some sets, one after the other, each in the order of the sets."""

    def __init__(self, sets: list[np.ndarray]):
        self.size = np.array([len(s) for s in sets], np.int64)
        self.stop = np.cumsum(self.size)
        owner, tokens = np.repeat(np.arange(len(sets)), self.size), np.concatenate(sets)
        by = np.argsort(tokens, kind="stable")
        first = np.ones(len(by), bool)
        first[1:] = tokens[by][1:] != tokens[by][:-1]
        self.members = owner[by]
        self.begin = np.append(np.flatnonzero(first), len(by))
        self.lists = np.empty(len(by), np.int64)  # of each shingle of each set in turn
        self.lists[by] = np.cumsum(first) - 1
        #: Lists and members as one sorted key, to probe many lists at once.
        self.key = self.lists[by] * len(sets) + self.members

    def find(self, k: int, among: np.ndarray, percent: int = PERCENT) -> np.ndarray:
        """Those sets ``among`` that reach the overlap that a link with set k takes, by DivideSkip."""
        n = int(self.size[k])
        mine = self.lists[self.stop[k] - n : self.stop[k]]
        length = self.begin[mine + 1] - self.begin[mine]
        least = -(-percent * n // 100)  # the overlap with the smallest set that fits
        n_long = max(0, min(least - 1, int(least / (_MU * math.log2(int(length.max()) + 1) + 1))))
        by_length = mine[np.argsort(length, kind="stable")]
        short, long = by_length[: n - n_long], by_length[n - n_long :]
        # occurrences of each set in the short lists; a list of one has k alone
        short = short[self.begin[short + 1] - self.begin[short] > 1]
        rows = [self.members[self.begin[x] : self.begin[x + 1]] for x in short]
        merged = heapq.merge(*[row[among[row]].tolist() for row in rows])
        stream = np.fromiter(merged, np.int64)
        start = np.flatnonzero(np.append(True, stream[1:] != stream[:-1])) if len(stream) else stream
        alive, count = stream[start], np.diff(np.append(start, len(stream)))
        need = required(n, self.size[alive], percent)
        fits = percent * np.maximum(n, self.size[alive]) <= 100 * np.minimum(n, self.size[alive])
        left = n_long
        ok = fits & (count + left >= need)
        alive, count, need = alive[ok], count[ok], need[ok]
        for s in range(0, n_long, _PROBES):
            if not len(alive):
                break
            wanted = long[s : s + _PROBES, None] * len(self.size) + alive
            at = np.minimum(np.searchsorted(self.key, wanted), len(self.key) - 1)
            count = count + (self.key[at] == wanted).sum(0)
            left = max(0, left - _PROBES)
            ok = count + left >= need
            alive, count, need = alive[ok], count[ok], need[ok]
        return alive[count >= need]


def links(sets: list[np.ndarray], comps: list, asking: list[bool]) -> Iterator[tuple[int, int]]:
    """Pairs of linked sets that join all comps which links of asking sets join; sets of one comp are joined already."""
    index = Index(sets)
    comp = np.unique(np.array(comps, np.int64), return_inverse=True)[1]
    left = np.array(asking)
    everyone = bool(left.all())
    while left.any():
        # where all ask, the largest comp waits: its links to others are found by them
        waits = int(np.bincount(comp).argmax()) if everyone else -1
        turn = np.flatnonzero(left & (comp != waits))
        if not len(turn):
            return
        k = int(turn[0])
        left[k] = False
        for j in index.find(k, comp != comp[k]).tolist():
            if comp[j] != comp[k]:
                yield k, j
                comp[comp == comp[j]] = comp[k]


def _search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (comp, piece, id, h, label, asking, text) in the order of their block: links that join the labels of a block."""
    key, ids, sets, labels, asking = None, [], [], [], []

    def found() -> Iterator[pa.RecordBatch]:
        if len(sets) > 1:
            pairs = [(ids[a], ids[b]) for a, b in links(sets, labels, asking)]
            if pairs:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*pairs, strict=True)], names=["a", "b"])

    for b in batches:
        head = list(zip(*(b.column(k).to_pylist() for k in range(6)), strict=True))
        for first, some in _sets(b.column(6)):
            for (comp, piece, i, h, label, asks), s in zip(head[first : first + len(some)], some, strict=True):
                if not len(s) or _short(_digest(s)) != h:
                    continue  # another text of the same id
                if key != (comp, piece):
                    yield from found()
                    key, ids, sets, labels, asking = (comp, piece), [], [], [], []
                ids.append(i)
                sets.append(s)
                labels.append(label)
                asking.append(asks)
    yield from found()
    release()


def _ask(asked: DataFrame, rows: DataFrame) -> DataFrame:
    """Links found in the blocks of asked (comp, piece, id, h, label, asking), with the texts of rows."""
    asked = materialize(asked.select("comp", "piece", F.col("id").alias("doc_id"), "h", "label", "asking"), "jac-asked")
    few = asked.count() <= MAX_ASKED
    texts = rows.join(F.broadcast(asked) if few else asked, "doc_id")
    texts = texts.select("comp", "piece", F.col("doc_id").alias("id"), "h", "label", "asking", "text").repartition("comp", "piece").sortWithinPartitions("comp", "piece", "id")
    return texts.mapInArrow(_search, "a bigint, b bigint").distinct()


def _with(edges: DataFrame, labels: DataFrame | None) -> DataFrame:
    """Components of edges and of what is joined already."""
    old = labels.select(F.col("node").alias("a"), F.col("comp").alias("b")).where("a <> b") if labels is not None else None
    return components(edges if old is None else edges.unionByName(old))


def linked(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """node, comp: the components of links among docs (id, h, n, comp), whose comp no link leaves."""
    docs = materialize(docs.withColumn("ck", F.col("comp").cast("string")), "jac-joined")
    big = docs.groupBy("ck").agg(F.count(F.lit(1)).alias("cnt"), F.greatest(F.ceil(F.sum("n") / BLOCK), F.ceil(F.count(F.lit(1)) / BLOCK_DOCS)).alias("parts"))
    dealt = join_groups(docs, "ck", big.where("parts > 1"), "cnt", docs.count())
    dealt = materialize(dealt.select("id", "h", "comp", F.coalesce("parts", F.lit(1)).alias("parts")), "jac-near")
    discard(docs)
    labels: DataFrame | None = None
    rest = dealt.withColumn("label", F.col("id"))
    for turn in range(ROUNDS + 1):
        if turn:
            rest = dealt.where("parts > 1").join(labels.select(F.col("node").alias("id"), F.col("comp").alias("label")), "id", "left").withColumn("label", F.coalesce("label", "id"))
            rest = materialize(rest, "jac-rest")
            sizes = rest.groupBy("comp", "label").agg(F.count(F.lit(1)).alias("cnt"))
            apart = sizes.groupBy("comp").agg(F.max_by("label", F.struct("cnt", "label")).alias("main"), F.count(F.lit(1)).alias("labels")).where("labels > 1").select("comp", "main")
            rest = rest.join(apart, "comp")
            if rest.isEmpty():
                break
        own = F.pmod(F.xxhash64("id", F.lit(turn)), F.col("parts"))
        if turn < ROUNDS:
            asked = rest.withColumns({"piece": own, "asking": F.lit(True)})
        else:  # what is not in the largest component visits all blocks
            visits = rest.where("label <> main").withColumn("piece", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("parts") - 1)))
            asked = rest.withColumns({"piece": own, "asking": F.lit(False)}).unionByName(visits.withColumn("asking", F.lit(True)))
        labels = _with(_ask(asked, rows), labels)
    return labels


def components(edges: DataFrame) -> DataFrame:
    """node, comp: the smallest node reachable from each node of edges (a, b)."""
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct()
    both = materialize(both, "cc-edges")
    most = both.count()  # there are no more nodes than ends of edges
    labels = materialize(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("a"), F.min("b")).alias("comp")), "cc-labels", most)
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), "comp"), "b").groupBy(F.col("a").alias("node")).agg(F.min("comp").alias("seen"))
        step = labels.join(near, "node").select("node", F.col("comp").alias("was"), F.least("comp", "seen").alias("comp"))
        # jump: the label of one's label
        jump = labels.select(F.col("node").alias("comp"), F.col("comp").alias("beyond"))
        step = materialize(step.join(jump, "comp", "left").select("node", "was", F.least("comp", F.coalesce("beyond", "comp")).alias("comp")), "cc-labels", most)
        discard(labels)
        labels = step
        if step.where("comp <> was").isEmpty():
            discard(both)
            return step.select("node", "comp")


def search(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id: one row for each row of docs."""
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    found = materialize(rows.mapInArrow(_survey, "kind tinyint, id bigint, n bigint, digest binary, h bigint, bits binary"), "jac-survey")
    of_docs = found.where(F.col("kind") == _DOC).select(F.col("id").alias("doc_id"), "n", F.hex("digest").alias("digest"))
    often = found.where(F.col("kind") == _SHINGLE).groupBy("id").agg(F.sum("n").alias("n"))
    often = often.orderBy(F.desc("n"), "id").limit(FREQUENT).toPandas()
    tokens = often["id"].to_numpy().view(np.uint64) if len(often) else np.zeros(0, np.uint64)
    by = np.argsort(tokens)
    # the more frequent, the later
    ranked = docs.sparkSession.sparkContext.broadcast((tokens[by], (len(tokens) - np.arange(len(tokens)))[by]))

    postings = rows.mapInArrow(lambda it: _postings(it, *ranked.value), "token bigint, h bigint, n int")
    lists = materialize(postings.repartition("token").sortWithinPartitions("token", "h").mapInArrow(_shared, "token bigint, h bigint, n int"), "jac-lists")
    # of lists with the same members one stays
    marks = lists.groupBy("token").agg(F.count(F.lit(1)).alias("m"), *[F.bit_xor(F.xxhash64("h", F.lit(k))).alias(f"x{k}") for k in (0, 1)])
    kept = marks.groupBy("m", "x0", "x1").agg(F.min("token").alias("token")).select("token", "m")
    lists_kept = materialize(lists.join(kept, "token"), "jac-kept")
    discard(lists)

    # one document stands for all with its set
    classes = found.where((F.col("kind") == _DOC) & F.col("digest").isNotNull()).groupBy("digest").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("copies"), F.first("h").alias("h"), F.first("bits").alias("bits"))
    classes = materialize(classes, "jac-classes")
    some = classes.where("copies > 1").select(F.hex("digest").alias("digest"), F.col("id").alias("first_id"), "copies")
    total = some.agg(F.coalesce(F.sum("copies"), F.lit(0))).first()[0]
    mapped = join_groups(of_docs, "digest", some, "copies", total)
    mapped = materialize(mapped.select("doc_id", "n", F.coalesce("first_id", "doc_id").alias("rep"), F.coalesce("copies", F.lit(1)).alias("copies")), "jac-docs")

    members = materialize(lists_kept.join(classes.where("id is not null").select("h", "id"), "h"), "jac-members")
    near = neighbourhoods(members, classes.select("h", "bits"))
    in_lists = members.select("id", "h", "n").distinct()
    labels = linked(in_lists.join(near.select(F.col("node").alias("id"), "comp"), "id"), rows)

    comps = labels.where("node <> comp").select(F.col("node").alias("rep"), "comp")
    sizes = mapped.where("rep is not null").groupBy("rep").agg(F.max("copies").alias("copies"))
    named = comps.join(sizes, "rep").select(F.col("rep").cast("string").alias("rk"), "comp", "copies")
    every = named.agg(F.coalesce(F.sum("copies"), F.lit(0))).first()[0]
    out = join_groups(mapped.select("doc_id", "n", "rep", F.col("rep").cast("string").alias("rk")), "rk", named, "copies", every)
    discard(found, lists_kept, classes, members)
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("comp", "rep").alias("component_id"))


def representatives(docs: DataFrame) -> DataFrame:
    """docs without the rows that have a linked document with a smaller doc_id; rows without doc_id stay."""
    drop = search(docs).where("component_id is not null and doc_id <> component_id").select("doc_id").distinct()
    return docs.join(drop, "doc_id", "left_anti").select(*docs.columns)
