"""A keyed table in versions: rows in buckets of files, and a small file that names the buckets of each version.

An update reads and writes only the buckets that its keys fall into, under new names, and then
creates the next version file.  That last step is the commit: a run that stops before it leaves the
version before as it was, and readers of an older version are not disturbed.  The version file
is created exclusively, so of two writers with the same start one finds its version taken and begins
again from the other's.  Files that no kept version names go with ``vacuum``.
"""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Sequence

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from foldwise.operators.joins import latest_per_key
from foldwise.session import materialise

BUCKETS = 16
ATTEMPTS = 5
_BUCKET = "_bucket"


class VersionTaken(RuntimeError):
    """Another writer has committed the version that this one was to become."""


class BucketTable:
    """Rows by key below ``path``; ``keys`` and ``n_buckets`` hold from the first write on."""

    def __init__(self, spark: SparkSession, path: str, keys: Sequence[str], n_buckets: int = BUCKETS):
        self.spark, self.path, self.keys, self.n_buckets = spark, path, list(keys), n_buckets

    # ---- files -----------------------------------------------------------------------------

    def _at(self, *parts: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(os.path.join(self.path, *parts))
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def _names(self, *parts: str) -> list[str]:
        fs, path = self._at(*parts)
        return [f.getPath().getName() for f in fs.listStatus(path)] if fs.exists(path) else []

    def versions(self) -> list[int]:
        """Numbers of all version files, complete or not."""
        return sorted(int(n[:-5]) for n in self._names("versions") if n.endswith(".json") and n[:-5].isdigit())

    def manifest(self, version: int | None = None) -> dict | None:
        """The version file's content; of the last complete version by default, None before the first."""
        for v in reversed(self.versions()) if version is None else [version]:
            fs, path = self._at("versions", f"{v:012d}.json")
            stream = fs.open(path)
            text = self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
            stream.close()
            try:
                return json.loads(text)
            except json.JSONDecodeError:  # its writer was stopped: it was never committed
                continue
        return None

    def _commit(self, version: int, content: dict) -> None:
        fs, path = self._at("versions", f"{version:012d}.json")
        try:
            stream = fs.create(path, False)
        except Exception as error:
            if fs.exists(path):
                raise VersionTaken(f"version {version} of {self.path}") from error
            raise
        stream.write(bytearray(json.dumps(content).encode()))
        stream.close()

    # ---- rows ------------------------------------------------------------------------------

    def _bucket(self, n: int):
        return F.pmod(F.xxhash64(*[F.col(k) for k in self.keys]), F.lit(n)).cast("int")

    def _rows(self, content: dict, buckets: Sequence[str] | None = None) -> DataFrame:
        schema = StructType.fromJson(content["schema"])
        folders = [os.path.join(self.path, f) for b, held in sorted(content["buckets"].items()) if buckets is None or b in buckets for f in held]
        return self.spark.read.schema(schema).parquet(*folders) if folders else self.spark.createDataFrame([], schema)

    def read(self, version: int | None = None) -> DataFrame | None:
        """All rows of a version, the last one by default; None before the first write."""
        content = self.manifest(version)
        return None if content is None else self._rows(content)

    def upsert(self, new: DataFrame) -> DataFrame:
        """Put ``new`` in: its rows replace those of their keys; a missing key is a key.

        Of several new rows of one key that with the greatest other columns stays.  A column that one
        side lacks is null there.  Returns the rows of the committed version.
        """
        new = materialise(new)
        for _ in range(ATTEMPTS):
            before = self.manifest()
            try:
                return self._rows(self._next(new, before))
            except VersionTaken:
                continue
        raise VersionTaken(f"{self.path}: other writers were first {ATTEMPTS} times")

    def _next(self, new: DataFrame, before: dict | None) -> dict:
        n = before["n_buckets"] if before else self.n_buckets
        if before and before["keys"] != self.keys:
            raise ValueError(f"{self.path} is keyed by {before['keys']}")
        placed = new.withColumn(_BUCKET, self._bucket(n))
        touched = sorted(str(r[0]) for r in placed.select(_BUCKET).distinct().collect())  # at most n numbers
        rows = placed.withColumn("_new", F.lit(1))
        if before:
            held = self._rows(before, touched)
            rows = held.withColumn(_BUCKET, self._bucket(n)).withColumn("_new", F.lit(0)).unionByName(rows, allowMissingColumns=True)
        others = [F.col(c) for c in rows.columns if c not in (*self.keys, _BUCKET, "_new")]
        last = latest_per_key(rows, self.keys, F.struct("_new", *others)).drop("_new")
        folder = os.path.join("data", uuid.uuid4().hex)
        # A bucket larger than a task's share is split over several files.
        last.hint("rebalance", _BUCKET).write.partitionBy(_BUCKET).parquet(os.path.join(self.path, folder))
        schema = StructType([f for f in last.schema if f.name != _BUCKET])
        buckets = dict(before["buckets"]) if before else {}
        buckets |= {b: [f"{folder}/{_BUCKET}={b}"] for b in touched}
        version = (self.versions() or [0])[-1] + 1
        if before and before["version"] != self._last_complete():
            raise VersionTaken(f"{self.path}: version {before['version']} is not the last any more")
        content = {"version": version, "keys": self.keys, "n_buckets": n, "schema": json.loads(schema.json()), "buckets": buckets}
        self._commit(version, content)
        return content

    def _last_complete(self) -> int:
        content = self.manifest()
        return content["version"] if content else 0

    def vacuum(self, keep: int = 2) -> int:
        """Delete all but the last ``keep`` complete versions and the files that none of these name; the number of folders gone.

        Only while nobody writes: files of an update that is not committed yet count as unnamed.
        """
        kept, old = [], []
        for v in reversed(self.versions()):
            try:
                content = self.manifest(v)
            except PySparkException:
                content = None
            (kept if content and len(kept) < keep else old).append((v, content))
        named = {f for _, content in kept for held in content["buckets"].values() for f in held}
        for v, _ in old:
            fs, path = self._at("versions", f"{v:012d}.json")
            fs.delete(path, False)
        gone = 0
        for folder in self._names("data"):
            below = [f"data/{folder}/{b}" for b in self._names("data", folder) if b.startswith(f"{_BUCKET}=")]
            for b in below:
                if b not in named:
                    fs, path = self._at(b)
                    fs.delete(path, True)
                    gone += 1
            if not any(b in named for b in below):
                fs, path = self._at("data", folder)
                fs.delete(path, True)
        return gone
