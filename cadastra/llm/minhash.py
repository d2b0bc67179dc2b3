"""Document fingerprints by one-permutation MinHash.

Every shingle of five words (A-Z lower-cased) is hashed once; the high bits
choose one of BINS bins, the least rest in a bin is kept. An empty bin borrows
from the first filled one in its own random order of the other bins (optimal
densification). Of each bin the lowest BITS bits are packed. Two fingerprints
that agree in a share m of bins estimate a similarity of
(m - 2^-BITS) / (1 - 2^-BITS), at least 0.

Defined results: null text counts as empty; texts without words have the
fingerprint of nothing, an empty string, which is like itself (1.0) and unlike
all others (0.0); equal texts have equal fingerprints; an empty table gives an
empty result; extra columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import math
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .textbytes import CHUNK, mix, shingle_runs

BINS, BITS, WIDTH = 512, 4, 5
#: Documents of a run, about; there are as many runs as shuffle partitions at least.
RUN_ROWS = 20_000


@cache
def _orders(bins: int) -> np.ndarray:
    """Row b: the order in which the empty bin b asks the others."""
    rng = np.random.default_rng(88)
    return np.stack([rng.permutation(bins) for _ in range(bins)]).astype(np.int32)


def sketches(hashes: np.ndarray, bounds: np.ndarray, bins: int = BINS) -> tuple[np.ndarray, np.ndarray]:
    """A row of ``bins`` 32-bit values for each text, and whether it has shingles."""
    n = len(bounds) - 1
    out = np.zeros((n, bins), np.uint32)
    filled = np.zeros((n, bins), bool)
    count = np.diff(bounds)
    row = np.repeat(np.arange(n, dtype=np.uint64), count)
    shift = np.uint64(64 - int(bins).bit_length() + 1)
    cell = row * np.uint64(bins) + (hashes >> shift)
    key = np.sort((cell << np.uint64(32)) | (hashes & np.uint64(0xFFFFFFFF)))
    cells = key >> np.uint64(32)
    first = np.ones(len(key), bool)
    first[1:] = cells[1:] != cells[:-1]
    at = cells[first].astype(np.int64)
    out.ravel()[at] = (key[first] & np.uint64(0xFFFFFFFF)).astype(np.uint32)
    filled.ravel()[at] = True
    has = count > 0
    orders = _orders(bins)
    r, b = np.nonzero(~filled & has[:, None])
    for step in range(bins):
        if not len(r):
            break
        ask = orders[b, step]
        ok = filled[r, ask]
        out[r[ok], b[ok]] = out[r[ok], ask[ok]]
        r, b = r[~ok], b[~ok]
    return out, has


def packed(values: np.ndarray, bits: int = BITS) -> np.ndarray:
    """The lowest bits of each value, as rows of bytes."""
    low = (values & np.uint32((1 << bits) - 1)).astype(np.uint8)
    return np.packbits(np.unpackbits(low[:, :, None], axis=2)[:, :, 8 - bits :].reshape(len(values), -1), axis=1)


def likeness(a: bytes, b: bytes, bins: int = BINS, bits: int = BITS) -> float:
    """The similarity that two packed fingerprints estimate, 0 to 1."""
    if not a or not b:
        return 1.0 if a == b else 0.0
    differ = np.unpackbits(np.frombuffer(a, np.uint8) ^ np.frombuffer(b, np.uint8)).reshape(bins, bits).any(1)
    chance = 2.0**-bits
    return float(max(0.0, (1 - differ.mean() - chance) / (1 - chance)))


def fingerprints(texts: pa.Array, bins: int = BINS, bits: int = BITS) -> list[bytes]:
    out: list[bytes] = []
    for _, _, hashes, bounds in shingle_runs(texts, WIDTH):
        for k in range(0, len(bounds) - 1, 1024):
            part = bounds[k : k + 1025]
            values, has = sketches(hashes[part[0] : part[-1]], part - part[0], bins)
            out += [bytes(p) if h else b"" for p, h in zip(packed(values, bits), has, strict=True)]
    return out


def fingerprint(docs: DataFrame, name: str = "fingerprint") -> DataFrame:
    """docs with one more column, their fingerprints in base64; where docs has one of that name, an underscore follows the name."""
    names = docs.columns
    while name in names:
        name += "_"

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [base64.b64encode(f).decode() for f in fingerprints(b.column(names.index("text")))]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(found, pa.string())], names=[*names, name])

    return docs.mapInArrow(add, T.StructType([*docs.schema.fields, T.StructField(name, T.StringType())]))


# -- the query: each document against an edited text and the next document -------------------------------------------

_OUT = "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
_NAMES = [f.strip().split(" ")[0] for f in _OUT.split(",")]


def _edited(text: str, following: str) -> str:
    n = len(text) // 3
    return text[: len(text) - n] + following[:n]


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come in order; the last of a run is a guest from the next run, which only lends its text."""
    held: list[tuple] = []  # id, text, guest
    size = 0
    carried: tuple[str, bytes] | None = None

    def out(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
        """All rows but the last have their next one here."""
        nonlocal carried
        texts = [r[1] for r in rows]
        prints = ([carried[1]] + fingerprints(pa.array(texts[1:], pa.large_string()))) if carried is not None and carried[0] == texts[0] else fingerprints(pa.array(texts, pa.large_string()))
        edits = [_edited(a, b) for a, b in zip(texts, texts[1:], strict=False)]
        eprints = fingerprints(pa.array(edits, pa.large_string()))
        found = [
            (rows[i][0], len(texts[i]), hashlib.sha256(edits[i].encode()).hexdigest(), base64.b64encode(prints[i]).decode(), base64.b64encode(eprints[i]).decode(), likeness(prints[i], eprints[i]), likeness(prints[i], prints[i + 1]))
            for i in range(len(rows) - 1)
            if not rows[i][2]
        ]
        carried = (texts[-1], prints[-1])
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found, strict=True), (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()), strict=True)], names=_NAMES)

    for b in batches:
        for part in range(0, b.num_rows, 200):
            s = b.slice(part, 200)
            for i, t, g in zip(s.column("doc_id").to_pylist(), s.column("text").to_pylist(), s.column("guest").to_pylist(), strict=True):
                held.append((i, t or "", g))
                size += len(held[-1][1])
                if size > CHUNK and len(held) > 1:
                    yield from out(held)
                    held = held[-1:]
                    size = len(held[0][1])
    if len(held) > 1:
        yield from out(held)


def _larger_cuts(cuts: list[int], x: Column) -> Column:
    """How many of the descending cuts are above x: a step over their square root many groups, then one inside a group."""
    step = max(1, math.isqrt(len(cuts)))
    groups = [cuts[k : k + step] for k in range(0, len(cuts), step)]
    count = lambda values: F.size(F.filter(values, lambda c: c > x))
    if len(groups) <= 1:
        return count(F.array(*[F.lit(c) for c in cuts])) if cuts else F.lit(0)
    whole = count(F.array(*[F.lit(g[-1]) for g in groups]))
    inside = F.get(F.array(*[F.array(*[F.lit(c) for c in g]) for g in groups]), whole)
    return (whole * step + F.coalesce(count(inside), F.lit(0))).cast("int")


def compare_with_next(docs: DataFrame, runs: int | None = None) -> DataFrame:
    """Each row's fingerprint, that of its edited text, and its likeness to that and to the next row's.

    The next row is that with the next smaller doc_id (rows of one doc_id by
    their text; null last), after the last the first. Rows are dealt into runs
    between quantiles of doc_id; the first row of a run also visits the run
    before it as a guest, so that every row meets its next one in one task.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    runs = runs or max(int(spark.conf.get("spark.sql.shuffle.partitions")), rows.select("doc_id").count() // RUN_ROWS + 1)
    cuts = rows.agg(F.percentile_approx("doc_id", [k / runs for k in range(1, runs)], max(10_000, 4 * runs)) if runs > 1 else F.array()).first()[0] or []
    cuts = sorted(set(cuts), reverse=True)
    # run 0 has the largest ids; a run ends with its cut
    rows = rows.withColumn("run", F.when(F.col("doc_id").isNull(), len(cuts)).otherwise(_larger_cuts(cuts, F.col("doc_id"))))
    order = F.struct(F.coalesce(F.col("doc_id"), F.lit(-(1 << 63))).alias("i"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("h"))
    heads = rows.groupBy("run").agg(F.max(order).alias("head"), F.count(F.lit(1)).alias("n")).orderBy("run").collect()  # one row per run
    if not heads:
        return spark.createDataFrame([], _OUT)
    # the next run that has rows; the last run's guest is the first row of all
    before = {h["run"]: heads[k - 1]["run"] for k, h in enumerate(heads)}
    lit_heads = [F.struct(F.lit(h["head"]["i"]).alias("i"), F.lit(h["head"]["h"]).alias("h"), F.lit(before[h["run"]]).alias("to"), F.lit(h["run"]).alias("run")) for h in heads]
    rows = rows.withColumn("o", order)
    by_run = F.create_map(*[x for h, s in zip(heads, lit_heads, strict=True) for x in (F.lit(h["run"]), s)])
    mine = F.element_at(by_run, F.col("run"))
    is_head = (mine["i"] == F.col("o.i")) & (mine["h"] == F.col("o.h"))
    stay = F.struct(F.col("run").alias("run"), F.lit(False).alias("guest"))
    visit = F.struct(mine["to"].alias("run"), F.lit(True).alias("guest"))
    rows = rows.withColumn("at", F.explode(F.when(is_head, F.array(stay, visit)).otherwise(F.array(stay))))
    rows = rows.select("doc_id", "text", F.col("at.run").alias("at"), F.col("at.guest").alias("guest"), "o")
    dealt = rows.repartitionById(max(len(cuts) + 1, 1), F.col("at")).sortWithinPartitions("at", "guest", F.col("o").desc())
    return dealt.select("doc_id", "text", "guest", "at").mapInArrow(_runs, _OUT)


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A task may hold several runs, one after the other."""

    def pieces() -> Iterator[tuple[int, pa.RecordBatch]]:
        for b in batches:
            at = np.asarray(b.column("at").to_numpy(zero_copy_only=False))
            edges = [0, *(np.flatnonzero(at[1:] != at[:-1]) + 1).tolist(), len(at)]
            for lo, hi in zip(edges, edges[1:], strict=False):
                if hi > lo:
                    yield int(at[lo]), b.slice(lo, hi - lo)

    flow = pieces()
    nxt = next(flow, None)
    while nxt is not None:
        run = nxt[0]

        def one() -> Iterator[pa.RecordBatch]:
            nonlocal nxt
            while nxt is not None and nxt[0] == run:  # noqa: B023
                yield nxt[1]
                nxt = next(flow, None)

        yield from _compare(one())
