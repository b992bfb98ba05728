"""Exact deduplication by an extendible-hash index on shared files.

A text is keyed by a 64-bit hash of its normal form (every run of white space is one
space).  A bucket holds the index entries of one range of keys, named by the
leading bits of the key.  The directory begins with as many bits as the data's size
asks for and doubles while some bucket is overfull; only overfull buckets split, so
each has its own depth.  A bucket that one single key fills cannot split further: its
entries form a chain.

Before anything moves, every task folds the equal texts it holds into one entry, each time
it has read ``FOLD_BYTES`` of distinct texts: a text costs one entry for each fold, however
many copies that has.  An owner task then reads its buckets in key order, row by row: entries
of one key are compared byte by byte with the chain of distinct texts of that key, so two
texts whose hashes collide stay apart.  It holds one chain at a time.  The index is
written to the shared folder as one table, a row for each distinct text; documents find their
group in it by the digest of their normal text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foldwise.llm.common import WS, materialise, table, text_of
from foldwise.llm.registry import query

BUCKET_BYTES = 8 << 20
FOLD_BYTES = 32 << 20  # texts a task holds before it passes its entries on
MAX_DEPTH = 40


def normal_text(text: str = "text") -> Column:
    return F.regexp_replace(text_of(text), WS, " ")


def _fold(id_kind: pa.DataType):
    schema = pa.schema([("key", pa.int64()), ("norm", pa.binary()), ("id", id_kind), ("n", pa.int64())])

    def entries(held: dict) -> Iterator[pa.RecordBatch]:
        norms = list(held)
        for a in range(0, len(norms), 2000):
            some = norms[a : a + 2000]
            columns = list(zip(*[held[x] for x in some], strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), pa.array(some, pa.binary()), pa.array(columns[1], id_kind), pa.array(columns[2], pa.int64())], schema=schema)
        held.clear()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bytes, list] = {}
        size = 0
        for batch in batches:
            keys, norms, ids = (batch.column(i).to_pylist() for i in range(3))
            for key, norm, i in zip(keys, norms, ids, strict=True):
                entry = held.get(norm)
                if entry is None:
                    held[norm] = [key, i, 1]
                    size += len(norm)
                else:
                    entry[1] = i if entry[1] is None else entry[1] if i is None else min(entry[1], i)
                    entry[2] += 1
            if size > FOLD_BYTES:
                yield from entries(held)
                size = 0
        if held:
            yield from entries(held)

    return run


def _own(id_kind: pa.DataType):
    """Entries in key order to one index row for each distinct text."""
    schema = pa.schema([("key", pa.int64()), ("sha256", pa.string()), ("keep_id", id_kind), ("group_size", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, chain, done = None, [], []

        def settled() -> pa.RecordBatch:
            rows = [(k, hashlib.sha256(norm).hexdigest(), i, n) for k, norm, i, n in done]
            done.clear()
            return pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], f.type) for c, f in enumerate(schema)], schema=schema)

        for batch in batches:
            for key, norm, i, n in zip(*(batch.column(c).to_pylist() for c in range(4)), strict=True):
                if key != now:
                    done.extend(chain)
                    now, chain = key, []
                for link in chain:
                    if link[1] == norm:
                        link[2] = i if link[2] is None else link[2] if i is None else min(link[2], i)
                        link[3] += n
                        break
                else:
                    chain.append([key, norm, i, n])
            if done:
                yield settled()
        done.extend(chain)
        if done:
            yield settled()

    return run


def directory(entries: DataFrame, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """``depth, prefix, n_bytes`` of every bucket: doubled until none is overfull that can split.

    ``entries`` has ``key`` and ``n_bytes``.  The first depth suits the total size; at
    each doubling only the keys of overfull buckets are looked at again.
    """
    sizes = materialise(entries.groupBy("key").agg(F.sum("n_bytes").alias("n_bytes")))
    total = sizes.agg(F.sum("n_bytes")).first()[0] or 0
    depth = max(1, (total // bucket_bytes).bit_length())
    leaves, rest = None, sizes
    while True:
        level = rest.groupBy(F.shiftrightunsigned("key", 64 - depth).alias("prefix")).agg(
            F.sum("n_bytes").alias("n_bytes"), F.max("n_bytes").alias("widest"))
        level = materialise(level.withColumn("depth", F.lit(depth)))
        # A bucket splits when it is overfull by more than its widest key, which no split makes smaller.
        overfull = (F.col("n_bytes") - F.col("widest") > bucket_bytes) & F.lit(depth < MAX_DEPTH)
        kept = level.where(~overfull).select("depth", "prefix", "n_bytes")
        leaves = kept if leaves is None else leaves.unionByName(kept)
        split = level.where(overfull).select(F.col("prefix").alias("p"))
        if not split.limit(1).count():
            return materialise(leaves)
        rest = rest.join(split, F.shiftrightunsigned("key", 64 - depth) == F.col("p"), "left_semi")
        depth += 1


def build_index(documents: DataFrame, id_column: str = "doc_id", text: str = "text", bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """The index, one row for each distinct normal text: ``key, sha256, keep_id, group_size``, in the shared folder."""
    kind = documents.schema[id_column].dataType
    id_kind = documents.select(id_column).limit(0).toArrow().schema.field(0).type
    norm = normal_text(text)
    keyed = documents.select(F.xxhash64(norm).alias("key"), norm.cast("binary").alias("norm"), F.col(id_column).alias("id"))
    entries = materialise(keyed.mapInArrow(_fold(id_kind), f"key long, norm binary, id {kind.simpleString()}, n long"))
    weight = F.octet_length("norm") + 32
    buckets = directory(entries.select("key", weight.alias("n_bytes")), bucket_bytes)
    depths = [r[0] for r in buckets.select("depth").distinct().collect()]  # at most MAX_DEPTH numbers
    at = [F.struct(F.lit(d).alias("depth"), F.shiftrightunsigned("key", 64 - d).alias("prefix")) for d in depths]
    if len(at) == 1:  # no bucket split further: the leading bits are the address
        placed = entries.withColumn("bucket", at[0])
    else:  # look each key up in the directory, under every depth in use
        tries = entries.select(F.col("key").alias("k")).distinct().withColumn("at", F.explode(F.array(*at) if at else F.array().cast("array<struct<depth:int,prefix:bigint>>")))
        own = tries.join(buckets, (F.col("at.depth") == F.col("depth")) & (F.col("at.prefix") == F.col("prefix"))).select("k", F.col("at").alias("bucket"))
        placed = entries.join(own, F.col("key") == F.col("k"))
    owned = placed.repartition("bucket").sortWithinPartitions("bucket", "key").select("key", "norm", "id", "n")
    return materialise(owned.mapInArrow(_own(id_kind), f"key long, sha256 string, keep_id {kind.simpleString()}, group_size long"))


def exact_groups(documents: DataFrame, id_column: str = "doc_id", text: str = "text", bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """``id, keep_id, group_size, kept, text_sha256`` for every row, dropped ones too.

    Defined cases: a null text counts as empty; of equal texts the row with the least
    id stays; rows repeated with the same id and text are one group whose rows are all
    marked as kept, for nothing tells them apart; a null id is kept only in a group
    without any other id; other columns are ignored.
    """
    index = build_index(documents, id_column, text, bucket_bytes).where("group_size > 1").select(
        F.col("sha256").alias("h"), "keep_id", "group_size")
    rows = documents.select(F.col(id_column).alias("id"), F.sha2(normal_text(text).cast("binary"), 256).alias("text_sha256"))
    found = rows.join(index, F.col("text_sha256") == F.col("h"), "left").drop("h")
    single = F.col("group_size").isNull()
    keep = F.when(single, F.col("id")).otherwise(F.col("keep_id"))
    return found.select("id", keep.alias("keep_id"), F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"), F.col("id").eqNullSafe(keep).alias("kept"), "text_sha256")


@query(r"""
WITH d AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents),
g AS (SELECT *, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size FROM d WINDOW w AS (PARTITION BY text_sha256))
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM g
""")
def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Group, size and surviving row of every document under equal normal texts."""
    return exact_groups(table(spark, sf_dir, "documents").select("doc_id", "text")).withColumnRenamed("id", "doc_id")
