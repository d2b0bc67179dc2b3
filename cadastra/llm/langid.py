"""Language ID by hyperdimensional profiles.

Every letter has a vector of +1 and -1 of its own, random for a to z and from a
hash of the code point for others. A trigram's vector binds those of
its letters, permuted by their places, by multiplication; a document's bundles
its trigrams' by addition; a language's prototype bundles the unit vectors of its
documents. A document gets the language whose prototype has the largest cosine
with it; prototypes are taken relative to their mean, which they share. The
score is the softmax of the cosines.

Letters are Unicode letters in lower case; a run of anything else is one
boundary. The bundles of a batch are matrix products, of counts of its trigrams
and their vectors, a block of trigrams at a time.

Defined results: null text and text without letters give ``und`` and score 0,
as does everything if there is nothing to learn from; rows with null lang are
predicted but not learned from; a null doc_id counts as learned from; repeated
rows count one by one; an empty table gives an empty result. More than
MAX_LANGS languages are an error, as the prototypes are broadcast.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .textbytes import chunks, mix, release

DIM = 512
MAX_LANGS = 4096
TEMPERATURE = 0.05
#: Symbols: 0 is a boundary, 1 to 26 are a to z, others are code points; three of them fit 63 bits.
SYMBOLS = 1 << 21
_SUM_UNIT = 1 << 24
_BATCH = 1 << 20
#: Trigrams, and counts of them, in a matrix product.
_BLOCK, _CELLS = 1 << 12, 1 << 22


def _symbol(cp: int) -> int:
    ch = chr(cp)
    if not unicodedata.category(ch).startswith("L"):
        return 0
    low = ch.lower()[0]
    return ord(low) - 96 if "a" <= low <= "z" else ord(low)


@cache
def _table() -> np.ndarray:
    return np.array([_symbol(c) for c in range(0x600)], np.int64)


def symbols(cps: np.ndarray) -> np.ndarray:
    table = _table()
    out = table[np.minimum(cps, len(table) - 1)]
    rare = np.flatnonzero(cps >= len(table))
    if len(rare):
        kinds, which = np.unique(cps[rare], return_inverse=True)
        out[rare] = np.array([_symbol(int(c)) for c in kinds], np.int64)[which]
    return out


@cache
def _letters(dim: int) -> np.ndarray:
    return np.random.default_rng(4).choice(np.array([-1, 1], np.int8), (64, dim))[:27]


def _vectors(syms: np.ndarray, dim: int) -> np.ndarray:
    out = _letters(dim)[np.minimum(syms, 26)]
    other = syms > 26
    if other.any():
        words = mix(syms[other].astype(np.uint64)[:, None] << np.uint64(32) | np.arange(1, -(-dim // 64) + 1, dtype=np.uint64))
        bits = np.unpackbits(words.astype("<u8").view(np.uint8), axis=1)[:, :dim]
        out[other] = 2 * bits.astype(np.int8) - 1
    return out


def trigram_vectors(ids: np.ndarray, dim: int = DIM) -> np.ndarray:
    """Bound vectors of trigrams numbered first * SYMBOLS**2 + second * SYMBOLS + third."""
    used, at = np.unique(np.stack([ids // SYMBOLS**2, ids // SYMBOLS % SYMBOLS, ids % SYMBOLS]), return_inverse=True)
    first, second, third = at.reshape(3, -1)
    base = _vectors(used, dim)
    once, twice = np.roll(base, 1, axis=1), np.roll(base, 2, axis=1)
    return (twice[first] * once[second] * base[third]).astype(np.float32)


def profiles(texts: pa.Array, dim: int = DIM) -> Iterator[tuple[int, int, np.ndarray]]:
    """First and last row, and their unit vectors (zero without letters)."""
    for first, last, data, offsets in chunks(texts, _BATCH):
        cps = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
        ends = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])[offsets]
        sym = symbols(cps)
        # texts one after the other, a boundary between them
        n = last - first
        row = np.repeat(np.arange(n), np.diff(ends))
        flow = np.zeros(len(sym) + n + 1, np.int64)
        flow[np.arange(len(sym)) + row + 1] = sym
        owner = np.zeros(len(flow), np.int64)
        owner[np.arange(len(sym)) + row + 1] = row
        keep = np.ones(len(flow), bool)
        keep[1:] = (flow[1:] != 0) | (flow[:-1] != 0)
        flow, owner = flow[keep], owner[keep]
        middle = np.flatnonzero(flow[1:-1] != 0) + 1
        tri = (flow[middle - 1] * SYMBOLS + flow[middle]) * SYMBOLS + flow[middle + 1]
        kinds, column = np.unique(tri, return_inverse=True)
        pair, count = np.unique(column * n + owner[middle], return_counts=True)
        column, owner = pair // n, pair % n
        vectors = np.zeros((n, dim), np.float32)
        block = max(1, min(_BLOCK, _CELLS // n))
        for k in range(0, len(kinds), block):
            some = slice(*np.searchsorted(column, [k, k + block]))
            part = kinds[k : k + block]
            counts = np.zeros((n, len(part)), np.float32)
            counts[owner[some], column[some] - k] = count[some]
            vectors += counts @ trigram_vectors(part, dim)
        norm = np.linalg.norm(vectors, axis=1, keepdims=True)
        yield first, last, vectors / np.where(norm > 0, norm, 1)


def _sums(batches: Iterator[pa.RecordBatch], dim: int) -> Iterator[pa.RecordBatch]:
    found: dict[str, np.ndarray] = {}
    rows: dict[str, int] = {}
    for b in batches:
        langs = np.array(b.column(1).to_pylist(), object)
        for first, last, vectors in profiles(b.column(0), dim):
            for lang in set(langs[first:last]):
                mine = vectors[langs[first:last] == lang]
                found[lang] = found.get(lang, 0) + np.rint(mine.astype(np.float64) * _SUM_UNIT).astype(np.int64).sum(0)
                rows[lang] = rows.get(lang, 0) + len(mine)
    for lang, total in found.items():
        yield pa.RecordBatch.from_arrays([pa.array([lang] * dim, pa.string()), pa.array(np.arange(dim), pa.int32()), pa.array(total, pa.int64())], names=["lang", "at", "total"])
    release()


def fit(docs: DataFrame, dim: int = DIM) -> tuple[list[str], np.ndarray]:
    """Languages and their prototypes, from all of docs with a lang."""
    rows = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull()).select("text", "lang")
    sums = rows.mapInArrow(lambda it: _sums(it, dim), "lang string, at int, total bigint").groupBy("lang", "at").agg(F.sum("total").alias("total"))
    found = sums.orderBy("lang", "at").limit(MAX_LANGS * dim + 1).toPandas()  # a row per language and dimension
    if len(found) > MAX_LANGS * dim:
        raise ValueError(f"more than {MAX_LANGS} languages")
    langs = sorted(found["lang"].unique())
    proto = np.zeros((len(langs), dim))
    if langs:
        proto[np.searchsorted(np.array(langs, object), found["lang"]), found["at"]] = found["total"]
    norm = np.linalg.norm(proto, axis=1, keepdims=True)
    proto /= np.where(norm > 0, norm, 1)
    if len(langs) > 1:
        proto -= proto.mean(0)
        norm = np.linalg.norm(proto, axis=1, keepdims=True)
        proto /= np.where(norm > 0, norm, 1)
    return langs, proto


def _predict(texts: pa.Array, langs: list[str], proto: np.ndarray) -> tuple[list[str], np.ndarray]:
    names, scores = [], np.zeros(len(texts))
    for first, last, vectors in profiles(texts, proto.shape[1]):
        has = np.any(vectors != 0, axis=1)
        if not langs:
            names += ["und"] * (last - first)
            continue
        cosine = vectors.astype(np.float64) @ proto.T
        best = cosine.argmax(1)
        soft = np.exp((cosine - cosine.max(1, keepdims=True)) / TEMPERATURE)
        scores[first:last] = np.where(has, np.round(1 / soft.sum(1), 6), 0)
        names += [langs[k] if h else "und" for k, h in zip(best, has, strict=True)]
    return names, scores


def predict(docs: DataFrame, langs: list[str], proto: np.ndarray) -> Column:
    """A struct of lang_pred and score of docs' texts; only the texts go through Python."""
    model = docs.sparkSession.sparkContext.broadcast((langs, proto))

    def work(texts: pa.Array) -> pa.Array:
        names, scores = _predict(texts, *model.value)
        release()
        return pa.StructArray.from_arrays([pa.array(names, pa.string()), pa.array(scores)], names=["lang_pred", "score"])

    return F.arrow_udf(work, "struct<lang_pred:string,score:double>")(F.col("text"))


def held_out(mod: int = 4, rest: int = 2):
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(0)) % mod == rest


def identify(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score: learned from the rows that are not held out, for all rows."""
    langs, proto = fit(docs.where(~held_out()))
    rows = docs.select("doc_id", held_out().alias("held_out"), predict(docs, langs, proto).alias("p"))
    return rows.select("doc_id", "held_out", "p.lang_pred", "p.score")


def accepted(docs: DataFrame) -> DataFrame:
    """docs without the rows that are in no language: null texts and texts without letters."""
    langs, proto = fit(docs)
    if not langs:  # nothing can be told apart, so clean documents stay
        return docs.where(F.col("text").rlike(r"\p{L}"))
    return docs.where(predict(docs, langs, proto)["lang_pred"] != "und")
