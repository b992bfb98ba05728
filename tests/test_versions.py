"""Versioned tables and resumable runs, stopped where it hurts."""

import os

import pytest
from pyspark.sql import functions as F

from foldwise.sources import versioned
from foldwise.sources.resumable import ResumableRun
from foldwise.sources.versioned import BucketTable, VersionTaken


def rows(df, *order):
    return sorted((tuple(r) for r in df.collect()), key=lambda r: tuple((v is None, v) for v in r))


def files(path, n, table):
    content = table.manifest(n)
    return {b: sorted(f for folder in held for f in os.listdir(os.path.join(path, folder)) if f.endswith(".parquet")) for b, held in content["buckets"].items()}


def many(spark, ids, value):
    return spark.createDataFrame([(k, value) for k in ids], "k long, v string")


def test_only_touched_buckets_are_written(spark, tmp_path):
    path = str(tmp_path / "t")
    table = BucketTable(spark, path, ["k"], 8)
    assert table.read() is None and table.versions() == []
    table.upsert(many(spark, range(200), "a"))
    table.upsert(many(spark, [3], "b"))
    first, second = files(path, 1, table), files(path, 2, table)
    assert len(first) == 8 and sum(first[b] != second[b] for b in first) == 1
    assert rows(table.read()) == [(k, "b" if k == 3 else "a") for k in range(200)]
    assert rows(table.read(1)) == [(k, "a") for k in range(200)]


@pytest.mark.parametrize("where", ["files", "pointer", "half a pointer"])
def test_killed_write_leaves_the_old_version(spark, tmp_path, monkeypatch, where):
    path = str(tmp_path / "t")
    BucketTable(spark, path, ["k"]).upsert(many(spark, range(50), "a"))
    table = BucketTable(spark, path, ["k"])

    def die(self, version, content):
        if where == "half a pointer":
            fs, at = self._at("versions", f"{version:012d}.json")
            stream = fs.create(at, False)
            stream.write(bytearray(b'{"version": 2, "buck'))
            stream.close()
        raise KeyboardInterrupt

    monkeypatch.setattr(BucketTable, "_commit", die)
    if where == "files":
        monkeypatch.setattr(BucketTable, "_last_complete", lambda self: die(self, 0, {}))
    with pytest.raises(KeyboardInterrupt):
        table.upsert(many(spark, range(40, 60), "b"))
    monkeypatch.undo()
    again = BucketTable(spark, path, ["k"])
    assert rows(again.read()) == [(k, "a") for k in range(50)]
    again.upsert(many(spark, range(40, 60), "c"))
    assert rows(again.read()) == [(k, "c" if k >= 40 else "a") for k in range(60)]


def test_writers_that_meet(spark, tmp_path, monkeypatch):
    """A writer that finds its version taken begins again from the other's, and both updates stay."""
    path = str(tmp_path / "t")
    table = BucketTable(spark, path, ["k"])
    table.upsert(many(spark, range(5), "a"))
    commit, met = BucketTable._commit, []

    def other_first(self, version, content):
        if not met:
            met.append(version)
            BucketTable(spark, path, ["k"]).upsert(many(spark, [100], "other"))
        commit(self, version, content)

    monkeypatch.setattr(BucketTable, "_commit", other_first)
    table.upsert(many(spark, [1], "mine"))
    assert (100, "other") in rows(table.read()) and (1, "mine") in rows(table.read())
    monkeypatch.setattr(BucketTable, "_commit", lambda *a: (_ for _ in ()).throw(VersionTaken("always")))
    with pytest.raises(VersionTaken):
        table.upsert(many(spark, [2], "late"))


def test_odd_rows(spark, tmp_path):
    path = str(tmp_path / "t")
    table = BucketTable(spark, path, ["a", "b"], 4)
    schema = "a string, b long, v double, _x int"
    table.upsert(spark.createDataFrame([(None, 1, 1.0, 1), (None, None, 2.0, 1), ("x", 1, None, 1)], schema))
    table.upsert(spark.createDataFrame([(None, 1, 5.0, 1), (None, 1, 4.0, 9), ("y", 2, 7.0, None)], schema))
    assert rows(table.read()) == rows(spark.createDataFrame([(None, 1, 5.0, 1), (None, None, 2.0, 1), ("x", 1, None, 1), ("y", 2, 7.0, None)], schema))
    before = rows(table.read())
    table.upsert(table.read().where("false"))
    assert rows(table.read()) == before
    table.upsert(spark.createDataFrame([("z", 1, "more")], "a string, b long, w string"))
    assert sorted(table.read().columns) == ["_x", "a", "b", "v", "w"] and table.read().where("w = 'more' AND v IS NULL").count() == 1
    with pytest.raises(ValueError):
        BucketTable(spark, path, ["a"]).upsert(many(spark, [1], "a").toDF("a", "v"))


def test_vacuum(spark, tmp_path):
    path = str(tmp_path / "t")
    table = BucketTable(spark, path, ["k"], 4)
    for step in range(4):
        table.upsert(many(spark, range(step * 10, step * 10 + 15), str(step)))
    want = rows(table.read())
    assert table.vacuum(keep=1) > 0 and table.versions() == [4]
    assert rows(table.read()) == want
    assert len(os.listdir(os.path.join(path, "data"))) <= 4
    assert versioned.BUCKETS > 1


class Stopped(Exception):
    pass


def test_a_stopped_run_goes_on(spark, tmp_path):
    grid = spark.createDataFrame([(g, t) for g in "abcd" for t in range(3)], "g string, t int")
    computed = []

    def compute(some, stop_at=None):
        keys = sorted(tuple(r) for r in some.collect())
        if stop_at is not None and len(computed) + len(keys) > stop_at:
            raise Stopped
        computed.extend(keys)
        # a comparison without rows, and several rows for the others
        return some.where("NOT (g = 'b' AND t = 1)").select("g", "t", F.explode(F.sequence(F.lit(1), F.col("t") + 1)).alias("x"))

    path = str(tmp_path / "run")
    run = ResumableRun(spark, path, ["g", "t"], batch=5)
    assert run.results() is None
    with pytest.raises(Stopped):
        run.run(grid, lambda some: compute(some, 7))
    assert len(computed) == 5
    # a second run dies between its folders and the ledger
    later = ResumableRun(spark, path, ["g", "t"], batch=5)
    later.write(compute(later.open(grid, 4)))
    before = len(computed)
    assert ResumableRun(spark, path, ["g", "t"], batch=5).run(grid, compute) == 7
    assert len(computed) - before == 7 and set(computed[:5]).isdisjoint(computed[before:])
    assert ResumableRun(spark, path, ["g", "t"]).run(grid, compute) == 0
    whole = ResumableRun(spark, str(tmp_path / "whole"), ["g", "t"])
    whole.run(grid, compute)
    assert rows(whole.results().select("g", "t", "x")) == rows(ResumableRun(spark, path, ["g", "t"]).results().select("g", "t", "x"))
    assert rows(whole.ledger.read().where("n_rows = 0").select("g", "t")) == [("b", 1)]
    assert ResumableRun(spark, str(tmp_path / "capped"), ["g", "t"], batch=5).run(grid, compute, cap=7) == 7
