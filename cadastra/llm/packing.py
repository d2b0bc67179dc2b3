"""Order-preserving packing of documents into sequences, by dynamic programming.

The token streams of a task's documents follow each other; a plan cuts the
stream into windows of at most WINDOW tokens. A cut at a document's end is free,
one at a sentence's end costs SENTENCE_COST padding tokens, one elsewhere
INNER_COST; a window costs its padding (none where its length is a power of two)
and WINDOW_COST. The cheapest plan up to each candidate cut is the minimum, over
earlier cuts at most WINDOW tokens back, of their plans plus the padding between;
as the padding is linear in the distance, a monotone queue finds it in constant
time. Windows of a power of two, which have none, are looked up one by one.

The stream is planned in stretches of about STRETCH tokens, whatever a task's
size; the last window of a stretch is planned again with the next one.

Words are told apart by 64-bit hashes: a worker remembers MAX_WORDS of them, so one word in some 10^13 might be mistaken.

Nothing is shuffled: a task packs the documents it reads, in their order.
sequence_id is the task's partition number * 2^32 + a running number.

Defined results: null text counts as empty, a document of its end token alone;
repeated rows are packed one by one; null doc_id is kept; an empty table gives
an empty result; extra columns are ignored.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator
from functools import cache
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textbytes import release, strings, word_hashes, words

WINDOW = 2048
END_ID = 1
SENTENCE_COST, INNER_COST, WINDOW_COST = 8, 48, 16
#: All sentence ends are candidate cuts; besides, there is one every GRID tokens.
GRID = 64
STRETCH = 1 << 19
#: Distinct words, and pieces of words, whose ids a worker remembers.
MAX_WORDS = 300_000
_BATCH = 1 << 20


@cache
def _tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


@cache
def _ends_word(tokenizer) -> np.ndarray:
    """Which ids end a piece."""
    ids = tokenizer.get_vocab()
    out = np.zeros(max(ids.values()) + 1, bool)
    out[[i for token, i in ids.items() if token.endswith("</w>")]] = True
    return out


#: Signs whose lower case and kind (letter, digit, other) are plain: ASCII and precomposed Latin letters; others are odd.
_ODD = re.compile("[^\t-\r -~\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u024f]|<[|]")
# Fixed value: how the vocabulary's tokenizer splits a word in lower case.
_LETTERS = "a-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f"
_PIECES = re.compile(f"[{_LETTERS}]+|[0-9]|'(?:s|t|re|ve|m|ll|d)|[^0-9\n{_LETTERS}]+|\n")


def _stops(of: list[bytes]) -> list[bool]:
    return [w.endswith((b".", b"!", b"?")) for w in of]


class _Table:
    """Ids by place; the first ``most`` keys are remembered, others until ``forget``."""

    def __init__(self, most: int):
        self.most, self.count = most, 0
        self.begin, self.length, self.stop = (np.zeros(1 << 16, t) for t in (np.int64, np.int32, bool))
        self.ids, self.used = np.zeros(1 << 18, np.uint32), 0

    def add(self, keys, ids: np.ndarray, length: np.ndarray, stop: list | bool = False) -> None:
        at, to, used = self.count, self.count + len(keys), self.used + len(ids)
        while to > len(self.begin):
            self.begin, self.length, self.stop = (np.resize(x, 2 * len(x)) for x in (self.begin, self.length, self.stop))
        while used > len(self.ids):
            self.ids = np.resize(self.ids, 2 * len(self.ids))
        self.ids[self.used : used] = ids
        self.begin[at:to] = self.used + np.cumsum(length) - length
        self.length[at:to], self.stop[at:to] = length, stop
        self.count, self.used = to, used
        self._put(keys, at)

    def gather(self, at: np.ndarray, shift: np.ndarray | int = 0, out: np.ndarray | None = None) -> np.ndarray:
        """The ids at places, one after the other, or into ``out`` with so many more before those of each."""
        length = self.length[at].astype(np.int64)
        begin = np.cumsum(length) - length
        within = np.arange(int(length.sum())) - np.repeat(begin, length)
        found = self.ids[np.repeat(self.begin[at], length) + within]
        if out is None:
            return found
        out[np.repeat(begin + shift, length) + within] = found
        return out

    def forget(self) -> None:
        if self.count > self.most:  # the last ones in go
            self._drop(self.most)
            self.count, self.used = self.most, int(self.begin[self.most])


class _Pieces(_Table):
    """Places of pieces of words."""

    def __init__(self, most: int):
        super().__init__(max(1, most))
        self.place: dict[str, int] = {}

    def _put(self, keys: list[str], at: int) -> None:
        self.place.update(zip(keys, range(at, at + len(keys)), strict=True))

    def _drop(self, most: int) -> None:
        while len(self.place) > most:
            self.place.popitem()

    def find(self, keys: list[str], learn) -> np.ndarray:
        """Places of keys; ``learn`` adds the distinct ones that are not here."""
        at = np.fromiter(map(self.place.get, keys, repeat(-1)), np.int64, len(keys))
        unknown = np.flatnonzero(at < 0)
        if len(unknown):
            new = [keys[k] for k in unknown]
            learn(list(dict.fromkeys(new)))
            at[unknown] = np.fromiter(map(self.place.__getitem__, new), np.int64, len(new))
        return at


class _Words(_Table):
    """Places of words by their 64-bit hashes, looked up many at a time: open addressing, linear probing."""

    def __init__(self, most: int):
        super().__init__(most)
        self._room(1 << 16)

    @property
    def place(self) -> np.ndarray:
        """The slots of what is remembered."""
        return self.slot[: self.count]

    def _room(self, slots: int) -> None:
        self.hash, self.owner = np.zeros(slots, np.uint64), np.full(slots, -1, np.int32)
        self.slot = np.zeros(slots // 2, np.int64)  # of each place

    def _put(self, keys: np.ndarray, at: int) -> None:
        if 2 * (at + len(keys)) > len(self.hash):
            old = self.hash[self.slot[:at]]
            self._room(1 << (4 * (at + len(keys))).bit_length())
            self._put(old, 0)
        mask = len(self.hash) - 1
        slot, left = (keys & np.uint64(mask)).astype(np.int64), np.arange(len(keys))
        while len(left):
            free = left[self.owner[slot[left]] < 0]
            self.owner[slot[free]] = at + free  # of several that want a slot one gets it
            self.hash[slot[free]] = keys[free]
            left = left[self.owner[slot[left]] != at + left]
            slot[left] = (slot[left] + 1) & mask
        self.slot[at : at + len(keys)] = slot

    def _drop(self, most: int) -> None:
        # a key that came together with these may not be met then, and is learned again
        self.owner[self.slot[most : self.count]] = -1

    def _seek(self, keys: np.ndarray) -> np.ndarray:
        mask = len(self.hash) - 1
        slot = (keys & np.uint64(mask)).astype(np.int64)
        out = self.owner[slot]
        left = np.flatnonzero((out >= 0) & (self.hash[slot] != keys))
        while len(left):
            slot[left] = (slot[left] + 1) & mask
            out[left] = self.owner[slot[left]]
            left = left[(out[left] >= 0) & (self.hash[slot[left]] != keys[left])]
        return out

    def find(self, keys: np.ndarray, learn) -> np.ndarray:
        """Places of keys; ``learn`` adds the distinct ones that are not here, whose first places among keys it gets."""
        at = self._seek(keys)
        unknown = np.flatnonzero(at < 0)
        if len(unknown):
            new, first = np.unique(keys[unknown], return_index=True)
            learn(new, unknown[first])
            at[unknown] = self._seek(keys[unknown])
        return at


class Encoder:
    """Ids of texts, word by word, as tokens never reach over white space; a new word's from the pieces that the tokenizer splits it into."""

    def __init__(self, path: str, max_words: int = MAX_WORDS):
        self.tokenizer, self.words, self.pieces = _tokenizer(path), _Words(max_words), _Pieces(max_words)
        self.pieces.add(["\n"], np.zeros(0, np.uint32), np.zeros(1, np.int64))  # place 0, without ids: the end of a word

    def _ids(self, new: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of pieces, and how many each has. Many are one text for the tokenizer: each ends with a token that ends a word."""
        whole = self.tokenizer.encode_batch_fast([" ".join(new[k : k + 500]) for k in range(0, len(new), 500)], add_special_tokens=False)
        ids = np.fromiter(chain.from_iterable(e.ids for e in whole), np.uint32)
        ends = np.flatnonzero(_ends_word(self.tokenizer)[ids])
        if len(ends) == len(new) and ends[-1] == len(ids) - 1:
            return ids, np.diff(ends, prepend=-1)
        return self._ids_one_by_one(new)

    def _ids_one_by_one(self, new: list[str]) -> tuple[np.ndarray, np.ndarray]:
        each = [e.ids for e in self.tokenizer.encode_batch_fast(new, add_special_tokens=False)]
        return np.fromiter(chain.from_iterable(each), np.uint32), np.fromiter(map(len, each), np.int64, len(each))

    def _learn_pieces(self, new: list[str]) -> None:
        for k in range(0, len(new), 20_000):
            part = new[k : k + 20_000]
            self.pieces.add(part, *self._ids(part))

    def _learn(self, keys: np.ndarray, new: list[bytes]) -> None:
        whole = b"\n".join(new).decode()
        if _ODD.search(whole):  # words with odd signs or with one of the tokenizer's marks
            odd = np.array([bool(_ODD.search(w)) for w in whole.split("\n")])
            some = [new[k] for k in np.flatnonzero(odd)]
            self.words.add(keys[odd], *self._ids_one_by_one([w.decode() for w in some]), _stops(some))
            keys, new = keys[~odd], [new[k] for k in np.flatnonzero(~odd)]
            whole = b"\n".join(new).decode()
        if new:
            at = self.pieces.find(_PIECES.findall(whole.lower() + "\n"), self._learn_pieces)
            ends = np.cumsum(self.pieces.length[at], dtype=np.int64)[at == 0]
            self.words.add(keys, self.pieces.gather(at), np.diff(ends, prepend=0), _stops(new))

    def encode(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All ids, each text's with the end id after them; the ids at which sentences end; the number of ids of each text."""
        raw = b"".join(texts)
        data = np.frombuffer(raw, np.uint8)
        begins, ends, bounds = words(data, np.append(0, np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)))))

        def learn(keys: np.ndarray, first: np.ndarray) -> None:
            self._learn(keys, [raw[lo:hi] for lo, hi in zip(begins[first].tolist(), ends[first].tolist(), strict=True)])

        at = self.words.find(word_hashes(data, begins, ends), learn)
        # an end after the words of each text
        row = np.repeat(np.arange(len(texts)), np.diff(bounds))
        length = self.words.length[at].astype(np.int64)
        counts = np.bincount(row, length, len(texts)).astype(np.int64) + 1
        out = self.words.gather(at, row, np.full(int(counts.sum()), END_ID, np.uint32))
        stops = (np.cumsum(length) + row)[self.words.stop[at]]
        self.words.forget()
        self.pieces.forget()
        return out, stops, counts


@cache
def _encoder(path: str) -> Encoder:
    """One for all tasks of a worker, so that few words are tokenized twice."""
    return Encoder(path)


def candidates(doc_ends: np.ndarray, stops: np.ndarray, total: int) -> tuple[np.ndarray, np.ndarray]:
    """Places where a cut may be, 0 first and ``total`` last, and what it costs there."""
    cost = np.full(total + 1, -1, np.int32)
    cost[::GRID] = INNER_COST
    cost[stops[stops <= total]] = SENTENCE_COST
    cost[doc_ends] = 0
    cost[[0, total]] = 0
    at = np.flatnonzero(cost >= 0)
    return at, cost[at]


def plan(at: np.ndarray, cost: np.ndarray, window: int = WINDOW) -> list[int]:
    """The cheapest cuts, 0 first and the last place last."""
    n = len(at)
    pos, pen = at.tolist(), cost.tolist()
    best, back = [0] * n, [0] * n
    queue_at, queue_key = [0] * n, [0] * n
    head, tail = 0, 1  # the queue holds candidate 0: key best + position = 0
    powers = [1 << k for k in range(window.bit_length()) if 1 << k < window]
    index: dict[int, int] = {0: 0}
    for c in range(1, n):
        p = pos[c]
        least = p - window
        while pos[queue_at[head]] < least:
            head += 1
        b = queue_at[head]
        gap = p - pos[b]
        value = best[b] + (0 if gap & (gap - 1) == 0 else window - gap)
        for power in powers:
            e = index.get(p - power)
            if e is not None and best[e] < value:
                value, b = best[e], e
        value += pen[c] + WINDOW_COST
        best[c], back[c] = value, b
        index[p] = c
        key = value + p
        while tail > head and queue_key[tail - 1] >= key:
            tail -= 1
        queue_at[tail], queue_key[tail] = c, key
        tail += 1
    cuts, c = [], n - 1
    while c:
        cuts.append(pos[c])
        c = back[c]
    return [0, *cuts[::-1]]


class _Stretch:
    """Documents that wait to be cut."""

    def __init__(self, window: int):
        self.window = window
        self.ids, self.stops = np.zeros(0, np.uint32), np.zeros(0, np.int64)
        self.docs: list[tuple] = []  # doc_id, tokens, first of them in this stretch; in order
        self.sequence = 0

    def add(self, doc_ids: list, ids: np.ndarray, stops: np.ndarray, counts: np.ndarray) -> None:
        self.stops = np.concatenate([self.stops, stops + len(self.ids)])
        self.ids = np.concatenate([self.ids, ids])
        self.docs += [(i, int(n), 0) for i, n in zip(doc_ids, counts, strict=True)]

    def cut(self, whole: bool) -> Iterator[tuple]:
        """Pieces of all windows; unless ``whole``, the last window stays."""
        if not self.docs:
            return
        sizes = np.array([n - s for _, n, s in self.docs], np.int64)
        ends = np.cumsum(sizes)
        total = int(ends[-1])
        cuts = plan(*candidates(ends, self.stops, total), self.window)
        if not whole and len(cuts) > 2:
            cuts = cuts[:-1]
        bounds = np.unique(np.concatenate([cuts, ends[ends < cuts[-1]]]))
        which = np.searchsorted(ends, bounds[:-1], "right")
        seq = np.searchsorted(cuts, bounds[:-1], "right") - 1
        begins = ends - sizes
        raw = self.ids.astype("<u4").tobytes()
        for lo, hi, d, s in zip(bounds[:-1].tolist(), bounds[1:].tolist(), which.tolist(), seq.tolist(), strict=True):
            doc, tokens, skipped = self.docs[d]
            yield doc, lo - int(begins[d]) + skipped, hi - lo, zlib.crc32(raw[4 * lo : 4 * hi]), tokens, self.sequence + s, lo - cuts[s], lo, hi
        self.sequence += len(cuts) - 1
        used = cuts[-1]
        d = int(np.searchsorted(ends, used, "right"))
        left = self.docs[d:]
        if left:
            doc, tokens, skipped = left[0]
            left[0] = (doc, tokens, skipped + used - int(begins[d]))
        self.docs, self.ids = left, self.ids[used:]
        self.stops = self.stops[self.stops > used] - used


_OUT = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint"
_NAMES = [f.strip().split(" ")[0] for f in _OUT.split(",")]


def pack(docs: DataFrame, tokenizer: str, window: int = WINDOW, with_ids: bool = False) -> DataFrame:
    """One row per piece of a document in a sequence; with ``with_ids``, its ids too."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, stretch = _encoder(tokenizer), _Stretch(window)
        base = TaskContext.get().partitionId() << 32

        def out(whole: bool) -> Iterator[pa.RecordBatch]:
            ids = stretch.ids
            rows = list(stretch.cut(whole))
            if rows:
                cols = [pa.array(c, pa.int64()) for c in zip(*[r[:7] for r in rows], strict=True)]
                cols[5] = pa.array([r[5] + base for r in rows], pa.int64())
                if with_ids:
                    cols.append(pa.array([ids[r[7] : r[8]].astype(np.int64) for r in rows], pa.list_(pa.int64())))
                yield pa.RecordBatch.from_arrays(cols, names=[*_NAMES, *["ids"] * with_ids])

        for b in batches:
            data, offsets = strings(b.column(1))
            doc_ids = b.column(0).to_pylist()
            first = 0
            while first < len(doc_ids):
                last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + _BATCH, "right")) - 1)
                raw, at = data[offsets[first] : offsets[last]].tobytes(), (offsets[first : last + 1] - offsets[first]).tolist()
                texts = [raw[lo:hi] for lo, hi in zip(at, at[1:], strict=False)]
                stretch.add(doc_ids[first:last], *encoder.encode(texts))
                first = last
                if len(stretch.ids) >= STRETCH:
                    yield from out(False)
        yield from out(True)
        release()

    rows = docs.select(F.col("doc_id").cast("bigint"), "text")
    return rows.mapInArrow(work, _OUT + ", ids array<bigint>" * with_ids)
