"""What the operators of this subpackage share: tables, the shared folder, skew-safe joins."""

from __future__ import annotations

import re
import tempfile
import uuid
from weakref import WeakKeyDictionary

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"
WORD = r"[^\x20\x09-\x0D]+"

#: Frames that ``materialize`` gave, and where they are.
_WRITTEN: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()

#: Groups with more than total / HOT_SHARE rows are joined by broadcast; there are fewer than HOT_SHARE of them.
HOT_SHARE = 1000
#: Narrow rows of a file where their number is known beforehand.
ROWS_A_FILE = 1 << 18


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; where that is unset a local one, which only a local master may use."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir names no folder that all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='cadastra-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def materialize(df: DataFrame, tag: str, rows: int | None = None) -> DataFrame:
    """Write df to the shared folder and read it back: cuts lineage, survives lost executors.

    rows: how many there are at most; few rows then make few files, whatever the number of shuffle partitions.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    if rows is not None:
        df = df.coalesce(max(1, -(-rows // ROWS_A_FILE)))
    df.write.parquet(path)
    found = spark.read.schema(df.schema).parquet(path)
    _WRITTEN[found] = path
    return found


def discard(*frames: DataFrame) -> None:
    """Remove what ``materialize`` wrote for frames that nothing reads any more."""
    for df in frames:
        path = _WRITTEN.pop(df, None)
        if path:
            spark = df.sparkSession
            there = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            there.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(there, True)


def lower_ascii(col: Column) -> Column:
    """Lower-case A-Z and nothing else."""
    return F.translate(col, UPPER, LOWER)


def text_of(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def join_groups(rows: DataFrame, key: str, groups: DataFrame, size: str, total: int) -> DataFrame:
    """Left join rows to groups (one row per key, with its number of rows) without a hot task.

    Groups above total / HOT_SHARE rows number at most HOT_SHARE, so they are
    broadcast; their rows then shuffle under keys of their own, not the hot one.
    """
    values = [c for c in groups.columns if c != key]
    hot = groups.where(F.col(size) * HOT_SHARE > total)
    cold = groups.where(F.col(size) * HOT_SHARE <= total)
    hot = F.broadcast(hot.select(F.col(key).alias("_hk"), *[F.col(c).alias(f"_h_{c}") for c in values]))
    rows = rows.join(hot, F.col(key) == F.col("_hk"), "left")
    spread = F.concat(F.lit("~"), F.monotonically_increasing_id().cast("string"))
    rows = rows.withColumn("_ck", F.when(F.col("_hk").isNotNull() | F.col(key).isNull(), spread).otherwise(F.col(key)))
    cold = cold.select(F.col(key).alias("_ck"), *[F.col(c).alias(f"_c_{c}") for c in values])
    rows = rows.join(cold, "_ck", "left")
    out = [F.coalesce(F.col(f"_h_{c}"), F.col(f"_c_{c}")).alias(c) for c in values]
    return rows.select(*[c for c in rows.columns if not c.startswith(("_h_", "_c_")) and c not in ("_hk", "_ck")], *out)
