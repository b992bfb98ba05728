import zlib
from collections import Counter

import numpy as np
import pytest

from foldwise.llm import sharding
from foldwise.llm.registry import QUERIES
from tests.llm.conftest import odd_documents


def test_fisher_yates():
    """Every order of four is about as likely."""
    seen = Counter(tuple(sharding.fisher_yates(4, np.random.default_rng([1, k])).tolist()) for k in range(4800))
    assert len(seen) == 24 and max(seen.values()) < 270 and min(seen.values()) > 140
    assert sharding.fisher_yates(0, np.random.default_rng(1)).tolist() == []


def test_query(spark, sf_dir, texts):
    rows = QUERIES["op4_sharding"](spark, sf_dir).collect()
    assert sorted(r.doc_id for r in rows) == sorted(texts)
    for r in rows:
        data = texts[r.doc_id].encode()
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(data) + 16, zlib.crc32(data), "rows", None)
    slots = {}
    for r in rows:
        slots.setdefault(r.shard, []).append(r.slot)
    assert sorted(slots) == list(range(40))
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(map(len, slots.values())) - min(map(len, slots.values())) <= 1
    ids = [r.doc_id for r in sorted(rows, key=lambda r: (r.shard, r.slot))]
    assert abs(np.corrcoef(ids, np.arange(len(ids)))[0, 1]) < 0.25  # not the order of the table


def test_same_seed_same_order(odd):
    key = lambda r: (r.shard, r.slot)
    one, two = ([(key(r), r.row.doc_id, r.row.text) for r in sharding.sharded(odd, 5).collect()] for _ in range(2))
    assert sorted(one, key=repr) == sorted(two, key=repr)
    other = sharding.sharded(odd, 5, seed=12).collect()
    assert sorted(((key(r), r.row.doc_id, r.row.text) for r in other), key=repr) != sorted(one, key=repr)


def test_odd_rows(odd, empty, tmp_path, spark):
    rows = sharding.sharded(odd, 7, bucket_bytes=20_000).collect()
    assert sorted(((r.row.doc_id, r.row.text) for r in rows), key=repr) == sorted(odd_documents(), key=repr)
    assert max(Counter(r.shard for r in rows).values()) - min(Counter(r.shard for r in rows).values()) <= 1
    assert sharding.sharded(empty).count() == 0
    sharding.write_shards(odd.select("doc_id", "text"), f"{tmp_path}/out", 3)
    back = spark.read.parquet(f"{tmp_path}/out")
    assert back.count() == odd.count() and {r.shard for r in back.select("shard").distinct().collect()} == {0, 1, 2}


@pytest.mark.parametrize("n", [1, 3, 39, 41])
def test_few_rows(spark, n):
    rows = sharding.sharded(spark.range(n).selectExpr("id AS doc_id", "'x' AS text")).collect()
    assert len(rows) == n and len({(r.shard, r.slot) for r in rows}) == n and max(r.slot for r in rows) == (n - 1) // 40


def test_order_does_not_depend_on_the_layout(odd, spark):
    """The same rows in 1, 7 and 211 partitions, with many equal ones among them."""
    same = spark.range(4000).selectExpr("77L AS doc_id", "'the same in everything' AS text")
    rows = odd.select("doc_id", "text").unionByName(same).unionByName(spark.range(500).selectExpr("id AS doc_id", "concat('text ', id) AS text"))
    got = [sorted(((r.shard, r.slot), r.row.doc_id, r.row.text) for r in sharding.sharded(rows.na.fill({"doc_id": -1, "text": ""}).repartition(n), 5, bucket_bytes=1000).collect()) for n in (1, 7, 211)]
    assert got[0] == got[1] == got[2] and len(got[0]) == 4500 + len(odd_documents())


def test_many_equal_rows_fill_many_buckets(spark):
    rows = sharding.shuffled(spark.range(4000).selectExpr("1L AS doc_id", "'equal' AS text"), bucket_bytes=1000).collect()
    sizes = Counter(r["__bucket"] for r in rows)
    assert len(rows) == 4000 and len(sizes) > 100 and max(sizes.values()) < 60
