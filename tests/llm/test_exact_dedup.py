import hashlib
import re

import pytest

from foldwise.llm import exact_dedup
from tests.llm.conftest import odd_documents


def expected(rows):
    norm = [re.sub(r"[\x20\x09-\x0D]+", " ", t or "") for _, t in rows]
    groups = {}
    for (i, _), t in zip(rows, norm, strict=True):
        groups.setdefault(t, []).append(i)
    least = lambda ids: min((x for x in ids if x is not None), default=None)
    return sorted(((i, least(groups[t]), len(groups[t]), i == least(groups[t]), hashlib.sha256(t.encode()).hexdigest()) for (i, _), t in zip(rows, norm, strict=True)), key=repr)


@pytest.mark.parametrize("bucket", [exact_dedup.BUCKET_BYTES, 200])
def test_odd_rows(odd, bucket):
    got = exact_dedup.exact_groups(odd, bucket_bytes=bucket).collect()
    assert sorted(((r.id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in got), key=repr) == expected(odd_documents())


def test_empty(empty):
    assert exact_dedup.exact_groups(empty).count() == 0


def test_directory_splits_only_overfull_buckets(spark):
    keys = [(k << 56, 10) for k in range(100)] + [((5 << 56) + (k << 40), 10) for k in range(200)] + [(7 << 56, 900)]
    found = exact_dedup.directory(spark.createDataFrame(keys, "key long, n_bytes long"), 200).collect()
    depths = {r.depth for r in found}
    assert len(depths) > 2 and max(depths) > 12
    assert sum(r.n_bytes for r in found) == sum(b for _, b in keys)
    covered = [(r.prefix << (64 - r.depth), (r.prefix + 1) << (64 - r.depth)) for r in found]
    assert all(sum(lo <= k < hi for lo, hi in covered) == 1 for k, _ in keys)


def test_colliding_keys_stay_apart():
    import pyarrow as pa

    batch = pa.record_batch({"key": pa.array([1, 1, 1, 2], pa.int64()), "norm": pa.array([b"a", b"b", b"a", b"a"]), "id": pa.array([5, 6, 4, 9], pa.int64()), "n": pa.array([1, 2, 3, 4], pa.int64())})
    rows = [r for out in exact_dedup._own(pa.int64())(iter([batch])) for r in out.to_pylist()]
    assert sorted((r["key"], r["keep_id"], r["group_size"]) for r in rows) == [(1, 4, 4), (1, 6, 2), (2, 9, 4)]
