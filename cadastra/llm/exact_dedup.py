"""Exact dedup by Grace hashing.

Each task first folds its own equal texts together, so that a group of copies
sends one row per task and not one per copy. Those rows are partitioned by
digest into the shuffle's files, the first level of spill files. A bucket whose
distinct texts outgrow the memory budget is partitioned again by further bits
of a salted hash into scratch files of the task (removed when it ends), and so
on until each piece fits. The table of a piece is a dict, which is an
open-addressing hash table that compares complete keys; the keys are the
complete normalised texts.

Defined results: null text counts as empty; null doc_id ranks below all others;
of rows repeated with the same doc_id and text one stays; an empty table gives
an empty result; extra columns, whatever their names, are ignored here and kept
by ``dedup``.
"""

from __future__ import annotations

import hashlib
import pickle
import tempfile
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import join_groups, lower_ascii, materialize, text_of

#: Bytes of distinct texts that one table may hold before its bucket is split.
TABLE_BYTES = 64 << 20
FANOUT = 16
#: Most rows that go for their keys to be broadcast; beyond that they are joined.
MAX_GONE = 200_000
MAX_DEPTH = 8

_PARTS = pa.schema([("sha", pa.string()), ("norm", pa.binary()), ("top", pa.int64()), ("n", pa.int64())])
_PARTS_DDL = "sha string, norm binary, top bigint, n bigint"
_GROUPS = pa.schema([("sha", pa.string()), ("keep_id", pa.int64()), ("group_size", pa.int64())])
_GROUPS_DDL = "sha string, keep_id bigint, group_size bigint"
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def _larger(a, b):
    return b if a is None else a if b is None else max(a, b)


class Table:
    """Content -> [largest id, rows], up to a budget of bytes."""

    def __init__(self):
        self.slots: dict[bytes, list] = {}
        self.bytes = 0

    def add(self, norm: bytes, top, n: int) -> None:
        slot = self.slots.get(norm)
        if slot is None:
            self.slots[norm] = [top, n]
            self.bytes += len(norm) + 200
        else:
            slot[0] = _larger(slot[0], top)
            slot[1] += n


def _local(batches: Iterator[pa.RecordBatch], budget: int) -> Iterator[pa.RecordBatch]:
    """Fold the equal texts of one task; a full table is sent on and begun anew."""

    def out(held: Table) -> Iterator[pa.RecordBatch]:
        rows = list(held.slots.items())
        for i in range(0, len(rows), 2000):
            part = rows[i : i + 2000]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([hashlib.sha256(k).hexdigest() for k, _ in part], pa.string()),
                    pa.array([k for k, _ in part], pa.binary()),
                    pa.array([v[0] for _, v in part], pa.int64()),
                    pa.array([v[1] for _, v in part], pa.int64()),
                ],
                schema=_PARTS,
            )

    held = Table()
    for batch in batches:
        ids, texts = batch.column(0).to_pylist(), batch.column(1).cast(pa.large_binary()).to_pylist()
        for i, text in zip(ids, texts, strict=True):
            held.add((text or b"").translate(_FOLD), i, 1)
        if held.bytes > budget:
            yield from out(held)
            held = Table()
    yield from out(held)


def _bucket(content: bytes, depth: int) -> int:
    return hashlib.blake2b(content, digest_size=2, salt=bytes([depth])).digest()[0] % FANOUT


def grace(records: Iterator[tuple[bytes, int | None, int]], budget: int, scratch: Path, depth: int = 0) -> Iterator[tuple[bytes, int | None, int]]:
    """One record per distinct content, whatever the size of the input, within the budget."""
    held, files = Table(), None
    for norm, top, n in records:
        if files is not None and norm not in held.slots:
            pickle.dump((norm, top, n), files[_bucket(norm, depth)])
            continue
        held.add(norm, top, n)
        if held.bytes > budget and depth < MAX_DEPTH and files is None:
            scratch.mkdir(parents=True, exist_ok=True)
            files = [(scratch / f"{depth}-{k}").open("wb") for k in range(FANOUT)]
    # what the table holds is whole: once splitting begins, only equal contents still join it
    for norm, (top, n) in held.slots.items():
        yield norm, top, n
    held = None
    for k, f in enumerate(files or []):
        f.close()
        path = Path(f.name)
        if path.stat().st_size:
            yield from grace(_read(path), budget, scratch / f"{depth}-{k}.d", depth + 1)
        path.unlink()


def _read(path: Path) -> Iterator[tuple[bytes, int | None, int]]:
    with path.open("rb") as f:
        while True:
            try:
                yield pickle.load(f)
            except EOFError:
                return


def _final(batches: Iterator[pa.RecordBatch], budget: int) -> Iterator[pa.RecordBatch]:
    def records():
        for b in batches:
            for part in range(0, b.num_rows, 500):
                s = b.slice(part, 500)
                yield from zip(s.column(0).to_pylist(), s.column(1).to_pylist(), s.column(2).to_pylist(), strict=True)

    with tempfile.TemporaryDirectory() as scratch:
        held: list[tuple] = []
        for norm, top, n in grace(records(), budget, Path(scratch)):
            held.append((hashlib.sha256(norm).hexdigest(), top, n))
            if len(held) >= 20_000:
                yield pa.RecordBatch.from_pylist([dict(zip(_GROUPS.names, h, strict=True)) for h in held], schema=_GROUPS)
                held = []
        yield pa.RecordBatch.from_pylist([dict(zip(_GROUPS.names, h, strict=True)) for h in held], schema=_GROUPS)


def text_groups(docs: DataFrame, budget: int = TABLE_BYTES) -> DataFrame:
    """sha, keep_id, group_size: one row per distinct normalised text."""
    parts = docs.select(F.col("doc_id").cast("bigint"), F.col("text")).mapInArrow(lambda it: _local(it, budget), _PARTS_DDL)
    dealt = parts.repartition(F.col("sha")).select("norm", "top", "n")
    return dealt.mapInArrow(lambda it: _final(it, budget), _GROUPS_DDL)


def _one_of_repeats(rows: DataFrame, key: str) -> DataFrame:
    """rows with _first, true for one of the rows of each key. One of each task is found first, so a key with many rows is no hot task."""
    here = F.row_number().over(Window.partitionBy(key, "_task").orderBy(F.lit(0)))
    rows = rows.withColumn("_task", F.spark_partition_id()).withColumn("_here", here)
    # the others of a task are keys of their own
    alone = F.when(F.col("_here") == 1, F.lit(-1).cast("bigint")).otherwise(F.monotonically_increasing_id())
    rows = rows.withColumn("_alone", alone)
    first = (F.col("_here") == 1) & (F.row_number().over(Window.partitionBy(key, "_alone").orderBy(F.lit(0))) == 1)
    return rows.withColumn("_first", first).drop("_task", "_here", "_alone")


def _digest() -> Column:
    return F.sha2(lower_ascii(text_of()).cast("binary"), 256)


def find_copies(docs: DataFrame, budget: int = TABLE_BYTES) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256: one row for each row of docs."""
    groups = materialize(text_groups(docs, budget), "exact-groups")
    total = groups.agg(F.coalesce(F.sum("group_size"), F.lit(0))).first()[0]
    rows = materialize(docs.select(F.col("doc_id").cast("bigint"), _digest().alias("sha")), "exact-rows")
    rows = join_groups(rows, "sha", groups.where("group_size > 1"), "group_size", total)
    single = F.col("group_size").isNull()
    rows = rows.withColumn("stays", single | F.col("keep_id").eqNullSafe(F.col("doc_id")))
    # of rows repeated with the doc_id and the text of the one that stays, one is kept
    repeated = materialize(rows.where("stays and group_size is not null").groupBy("sha").agg(F.count(F.lit(1)).alias("times")).where("times > 1"), "exact-repeats")
    rows = rows.withColumn("_first", F.lit(True))
    if not repeated.isEmpty():
        marked = join_groups(rows, "sha", repeated, "times", total)
        again = F.col("times").isNotNull() & F.col("stays")
        rows = marked.where(~again).drop("times").unionByName(_one_of_repeats(marked.where(again).drop("times", "_first"), "sha"))
    return rows.select(
        "doc_id",
        F.when(single, F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1).cast("bigint")).alias("group_size"),
        (F.col("stays") & F.col("_first")).alias("kept"),
        F.col("sha").alias("text_sha256"),
    )


def dedup(docs: DataFrame, budget: int = TABLE_BYTES) -> DataFrame:
    """docs without the rows whose text a row with a larger doc_id has too."""
    groups = materialize(text_groups(docs, budget).where("group_size > 1"), "exact-groups")
    total = groups.agg(F.coalesce(F.sum("group_size"), F.lit(0))).first()[0]
    # the row as one column: its names cannot clash with those made here
    rows = docs.select(F.struct(*docs.columns).alias("_row"), F.col("doc_id").cast("bigint").alias("_id"), _digest().alias("_sha"))
    # only the narrow keys of copies are dealt out by digest; the texts stay where they are read if few rows go
    ids = join_groups(rows.select("_id", "_sha"), "_sha", groups.withColumnRenamed("sha", "_sha"), "group_size", total)
    ids = materialize(ids.where("group_size is not null").groupBy("_id", "_sha", "keep_id").agg(F.count(F.lit(1)).alias("times")), "exact-ids")
    stays = F.col("_id").eqNullSafe(F.col("keep_id"))
    gone = ids.where(~stays).select(F.col("_id").alias("_d"), F.col("_sha").alias("_s"))
    kept = rows.join(F.broadcast(gone) if gone.count() <= MAX_GONE else gone, F.col("_id").eqNullSafe(F.col("_d")) & (F.col("_sha") == F.col("_s")), "left_anti")
    repeated = ids.where(stays & (F.col("times") > 1)).select("_sha", "times")
    if not repeated.isEmpty():
        marked = join_groups(kept, "_sha", repeated, "times", total)
        once = _one_of_repeats(marked.where("times is not null").drop("times"), "_sha").where("_first").drop("_first")
        kept = marked.where("times is null").drop("times").unionByName(once)
    return kept.select("_row.*")
