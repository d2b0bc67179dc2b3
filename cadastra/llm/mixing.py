"""Mixing sources to target weights by systematic sampling.

Sources in code-point order, null last, weigh 1, 2, 3, 1, 2, 3, ... and share
the words of the whole corpus by weight; no target exceeds ``max_repeat`` times
its source's words, and what exceeds it is shared again by weight (water
filling, solved in closed form by running sums over the sources). Each document
of a source expects target / words copies. Its place in the running sum of
those expectations, plus one random offset per source, tells its copies: one
for each integer that the sum crosses. Within a source documents run from large
to small. The large ones come first; the others, which have words enough to
make up for what the largest one may miss or exceed, then expect what those have
left of the target, so that words, not documents, meet it. As the large ones
are drawn by the same expectation, the others expect target / words copies on
the average over offsets, too.

The running sum is built in two levels, blocks and rows in a block, so no task
gets a whole source: a block is a source, a power of two of the size and a hash
of doc_id.

Defined results: null text has size 0 and is never worth a word; null source is
a source of its own; rows repeated with one doc_id count one by one; an empty
table gives an empty result. Only DataFrame operations are used.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, materialize, text_of

#: Rows of a block of the running sum, about.
BLOCK_ROWS = 2_500
MAX_REPEAT = 3
SEED = 20260


def _skey(name: str = "source"):
    return F.when(F.col(name).isNull(), F.lit("n")).otherwise(F.concat(F.lit("s"), F.col(name)))


def targets(sizes: DataFrame, max_repeat: float = MAX_REPEAT, seed: int = SEED) -> DataFrame:
    """_skey, source_size, target, expected, offset: one row per source of (source, size)."""
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    per = per.withColumn("weight", (F.row_number().over(by_name) - 1) % 3 + 1)
    everything = Window.partitionBy()
    by_cap = Window.orderBy("cap_ratio", "weight", "source")
    before = by_cap.rowsBetween(Window.unboundedPreceding, -1)
    cap = F.col("source_size") * F.lit(max_repeat)
    per = per.withColumn("cap", cap.cast("double")).withColumn("cap_ratio", F.col("cap") / F.col("weight"))
    capped, capped_w = (F.coalesce(F.sum(c).over(before), F.lit(0)) for c in ("cap", "weight"))
    level = F.try_divide(F.sum("source_size").over(everything) - capped, F.sum("weight").over(everything) - capped_w)
    per = per.withColumn("level", level)
    # the first source that is not capped sets the level of all that are not
    final = F.min(F.when(F.col("cap_ratio") >= F.col("level"), F.struct("cap_ratio", "level"))).over(everything)["level"]
    target = F.least(F.col("cap"), F.col("weight") * final)
    unit = F.pmod(F.xxhash64(_skey(), F.lit(seed)), F.lit(1 << 52)).cast("double") / float(1 << 52)
    return per.withColumn("target", F.coalesce(target, F.lit(0.0))).select(
        _skey().alias("_skey"),
        "source_size",
        "target",
        F.coalesce(F.try_divide("target", "source_size"), F.lit(0.0)).alias("expected"),
        unit.alias("offset"),
    )


def size_of(text: str = "text"):
    return F.regexp_count(text_of(text), F.lit(WORD)).cast("bigint")


def mix(docs: DataFrame, max_repeat: float = MAX_REPEAT, seed: int = SEED, keep: bool = False) -> DataFrame:
    """docs' doc_id with size, source_size, target, taken and copies; with ``keep``, docs' row as the struct _row, and copies."""
    sizes = materialize(docs.select("doc_id", "source", size_of().alias("size")), "sizes")
    total = sizes.count()
    blocks_n = max(1, total // max(BLOCK_ROWS, math.isqrt(total)))

    def blocked(df: DataFrame) -> DataFrame:
        return df.withColumns({"_skey": _skey(), "_cls": F.length(F.bin("size")), "_hb": F.pmod(F.xxhash64("doc_id", "size"), F.lit(blocks_n))})

    keys = ["_skey", "_cls", "_hb"]
    counts = blocked(sizes).groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), F.sum("size").alias("_w"))
    in_source = Window.partitionBy("_skey").orderBy(F.col("_cls").desc(), "_hb").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("_skey")
    counts = counts.withColumn("_before", F.coalesce(F.sum("_n").over(in_source), F.lit(0))).join(targets(sizes, max_repeat, seed), "_skey")
    # a class is drawn first if the words of those below it can make up for what the largest documents miss or exceed
    below = F.coalesce(F.sum("_w").over(whole.orderBy("_cls").rangeBetween(Window.unboundedPreceding, -1)), F.lit(0))
    give = F.least(F.col("expected"), F.lit(float(max_repeat)) - F.col("expected"))
    counts = counts.withColumn("_large", below * give >= F.pow(F.lit(2.0), F.max("_cls").over(whole)))
    counts = counts.withColumns({"_large_n": F.sum(F.when(F.col("_large"), F.col("_n")).otherwise(0)).over(whole), "_large_w": F.sum(F.when(F.col("_large"), F.col("_w")).otherwise(0)).over(whole)})
    counts = materialize(counts.drop("_n", "_w"), "mix-blocks")

    in_block = Window.partitionBy(*keys).orderBy(F.col("size").desc(), F.col("doc_id"))

    def crossed(rows: DataFrame, starts: DataFrame) -> DataFrame:
        """rows with the integers that the running sum crosses at each; starts has what it is before a block, and its step."""
        rows = rows.withColumn("_rank", F.row_number().over(in_block)).join(starts, keys)
        at = lambda rank: F.floor(F.col("_base") + F.col("_step") * rank + F.col("offset"))
        return rows.withColumn("copies", F.least(at(F.col("_rank")) - at(F.col("_rank") - 1), F.lit(int(max_repeat))))

    plain = counts.withColumns({"_base": F.col("expected") * F.col("_before"), "_step": F.col("expected")})
    in_large = blocked(sizes).join(counts.where("_large").select("_skey", "_cls").distinct(), ["_skey", "_cls"], "left_semi")
    some = crossed(in_large, plain.where("_large").select(*keys, "offset", "_base", "_step"))
    taken = some.groupBy("_skey").agg(F.sum(F.col("copies") * F.col("size")).alias("_taken"))
    # what the large ones leave of the target is for the others
    rest = F.try_divide(F.col("target") - F.coalesce("_taken", F.lit(0)), F.col("source_size") - F.col("_large_w"))
    rest = F.greatest(F.lit(0.0), F.least(F.lit(float(max_repeat)), F.coalesce(rest, F.col("expected"))))
    starts = plain.join(taken, "_skey", "left").withColumn("_rest", rest)
    starts = starts.withColumns(
        {
            "_step": F.when(F.col("_large"), F.col("expected")).otherwise(F.col("_rest")),
            "_base": F.when(F.col("_large"), F.col("_base")).otherwise(F.col("expected") * F.col("_large_n") + F.col("_rest") * (F.col("_before") - F.col("_large_n"))),
        }
    ).select(*keys, "source_size", "target", "offset", "_base", "_step")
    # the row as one column: its names cannot clash with those made here
    rows = crossed(blocked(docs.select(F.struct(*docs.columns).alias("_row"), "doc_id", "source", size_of().alias("size")) if keep else sizes), starts)
    if keep:
        return rows.select("_row", "copies")
    return rows.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies")


def mixed(docs: DataFrame, max_repeat: float = MAX_REPEAT, seed: int = SEED) -> DataFrame:
    """The mix itself: each row of docs as often as it is taken."""
    rows = mix(docs, max_repeat, seed, keep=True).where("copies > 0")
    return rows.select("_row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("_row.*")
