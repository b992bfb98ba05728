"""Sharding in a globally random order, by a two-pass external shuffle.

Pass one scatters the rows uniformly into buckets that fit a task's memory, by a
seeded hash.  Pass two puts each bucket into a canonical order, applies a seeded
Fisher-Yates shuffle, and writes it.  Buckets one after another are then a random
order of all rows; shard k takes the k-th of ``n_shards`` equal runs of it, so row
counts differ by one at most (the law is ``rows``).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from foldwise.llm.common import materialise, table
from foldwise.llm.registry import query
from foldwise.session import bounded

BUCKET_BYTES = 16 << 20
SHARDS = 40


def fisher_yates(n: int, rng: np.random.Generator) -> np.ndarray:
    """A random order of 0 to n-1: each place, from the last, swaps with one at or before it."""
    order = list(range(n))
    picks = rng.integers(0, np.arange(n, 0, -1)).tolist()
    for i, j in zip(range(n - 1, 0, -1), picks, strict=False):
        order[i], order[j] = order[j], order[i]
    return np.array(order, dtype=np.int64)


def _shuffle_bucket(seed: int):
    def run(rows: pa.Table) -> pa.Table:
        bucket = rows.column("__bucket")[0].as_py()
        canonical = rows.take(pc.sort_indices(rows, [("__h", "ascending"), ("__h2", "ascending")]))
        order = fisher_yates(len(rows), np.random.default_rng([seed, bucket]))
        mixed = canonical.take(pa.array(order)).drop_columns(["__h", "__h2"])
        return mixed.append_column("__local", pa.array(np.arange(len(rows)), pa.int64()))

    return run


def _numbered(df: DataFrame, size: int, bucket_bytes: int) -> DataFrame:
    """``row`` and ``__n``: 0, but a number from 0 on for rows equal in everything that would fill a bucket.

    Equal rows cannot be told apart, so instead of numbering many of them where they lie, one of
    them is taken as often as they are.
    """
    own = F.struct(*[F.col(f"`{c}`") for c in df.columns])
    packed = df.select(own.alias("row")).withColumns({"__h": F.xxhash64("row"), "__h2": F.hash("row")})
    counts = packed.groupBy("__h", "__h2").agg(F.count(F.lit(1)).alias("__times")).where(F.col("__times") * F.lit(size) > bucket_bytes // 4)
    hot = materialise(counts.select("__h", "__h2"))
    if not hot.limit(1).count():
        return packed.select("row", F.lit(0).cast("long").alias("__n"))
    hot = bounded(hot)  # a few hashes: each has many rows
    keys = ["__h", "__h2"]
    rest = packed.join(hot, keys, "left_anti").select("row", F.lit(0).cast("long").alias("__n"))
    equal = packed.join(hot, keys, "left_semi").groupBy("row").agg(F.count(F.lit(1)).alias("__times"))
    return rest.unionByName(equal.select("row", F.explode(F.sequence(F.lit(0).cast("long"), F.col("__times") - 1)).alias("__n")))


def shuffled(df: DataFrame, text: str = "text", seed: int = 11, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """Both passes, written to the shared folder: ``row`` (the input row), ``__bucket`` and its place ``__local`` there.

    The hash covers all columns, so rows that share an id or a text scatter; rows that are equal in
    everything scatter by a number of their own once they are many.  The order depends on the
    rows and the seed only, not on the files they lie in or the tasks that read them.
    """
    size = df.agg(F.sum(F.octet_length(f"`{text}`")), F.count(F.lit(1))).first()
    buckets = max(SHARDS, -(-((size[0] or 0) + 64 * size[1]) // bucket_bytes))
    rows = _numbered(df, 64 + (size[0] or 0) // max(size[1], 1), bucket_bytes)
    hashed = rows.select(
        "row", F.pmod(F.xxhash64(F.lit(seed), "__n", "row"), F.lit(buckets)).cast("int").alias("__bucket"),
        F.xxhash64(F.lit(seed + 1), "row").alias("__h"), F.hash(F.lit(seed + 2), "row").alias("__h2"))
    out = rows.select("row").limit(0).withColumns({"__bucket": F.lit(0), "__local": F.lit(0).cast("long")}).schema
    return materialise(hashed.groupBy("__bucket").applyInArrow(_shuffle_bucket(seed), out))


def sharded(df: DataFrame, n_shards: int = SHARDS, text: str = "text", seed: int = 11, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """``row, shard, slot`` of every row: its shard from 0 on and its gapless place there.

    Defined cases: a null text or id is scattered like any other; repeated rows each
    have a slot; an empty table has no shards; extra columns stay inside ``row``,
    so their names cannot clash.
    """
    mixed = shuffled(df, text, seed, bucket_bytes)
    sizes = materialise(mixed.groupBy("__bucket").agg(F.count(F.lit(1)).alias("n")))
    total = sizes.agg(F.sum("n")).first()[0] or 0
    # Where each bucket begins: first within blocks of a thousand buckets, then over the blocks.
    block = F.floor(F.col("__bucket") / 1000).alias("block")
    earlier = lambda *by: Window.partitionBy(*by).rowsBetween(Window.unboundedPreceding, -1)
    blocks = sizes.groupBy(block).agg(F.sum("n").alias("n")).withColumn("all", F.lit(0))
    blocks = blocks.select("block", F.coalesce(F.sum("n").over(earlier("all").orderBy("block")), F.lit(0)).alias("before"))
    inner = sizes.select("__bucket", "n", block).withColumn("within", F.coalesce(F.sum("n").over(earlier("block").orderBy("__bucket")), F.lit(0)))
    begins = inner.join(blocks, "block").select("__bucket", (F.col("before") + F.col("within")).alias("begin"))
    placed = mixed.join(begins, "__bucket").withColumn("__at", F.col("begin") + F.col("__local"))
    # The first `more` shards have one row more than the others.
    each, more = divmod(total, n_shards)
    at, cut = F.col("__at"), more * (each + 1)
    shard = F.when(at < cut, F.floor(at / (each + 1))).otherwise(more + F.floor((at - cut) / max(each, 1))).cast("int")
    slot = F.when(at < cut, at % (each + 1)).otherwise((at - cut) % max(each, 1)).cast("long")
    return placed.select("row", shard.alias("shard"), slot.alias("slot"))


def write_shards(df: DataFrame, path: str, n_shards: int = SHARDS, text: str = "text", seed: int = 11) -> None:
    """Write every shard's rows to ``path/shard=K``, with their slots; a reader orders by slot."""
    sharded(df, n_shards, text, seed).select("row.*", F.col("shard").alias("shard"), F.col("slot").alias("slot")).write.partitionBy("shard").parquet(path)


@query()
def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shard and slot of every document among 40 shards of equal counts."""
    found = sharded(table(spark, sf_dir, "documents").select("doc_id", "text"))
    text = F.col("row.text")
    return found.select(
        F.col("row.doc_id").alias("doc_id"), (F.coalesce(F.octet_length(text), F.lit(0)) + 16).cast("long").alias("size"),
        F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("text_crc32"), F.lit("rows").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"))
