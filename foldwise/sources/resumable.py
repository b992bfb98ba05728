"""A run over many comparisons that goes on where it was stopped.

Results lie in one folder for each comparison, and a ledger names the comparisons that are done.
A batch of open ones is computed, its folders are replaced, and only then is it entered in the
ledger.  A run stopped in between computes that batch again and replaces the same folders, so
stopping and starting never doubles or loses a row.
"""

from __future__ import annotations

import os
from collections.abc import Callable, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foldwise.operators.keys import join_same
from foldwise.session import materialise
from foldwise.sources.tables import pending, write_table
from foldwise.sources.versioned import BucketTable

BATCH = 16


class ResumableRun:
    """Results and ledger below ``path``, by the columns ``keys`` of a comparison."""

    def __init__(self, spark: SparkSession, path: str, keys: Sequence[str], batch: int = BATCH):
        self.spark, self.keys, self.batch = spark, list(keys), batch
        self.folder = os.path.join(path, "results")
        self.ledger = BucketTable(spark, os.path.join(path, "ledger"), keys, 1)

    def open(self, comparisons: DataFrame, cap: int | None = None) -> DataFrame:
        """Comparisons that the ledger does not name, at most ``cap``, in key order."""
        done = self.ledger.read()
        rows = comparisons.select(*self.keys).distinct()
        if done is None:
            return rows if cap is None else rows.orderBy(*self.keys).limit(cap)
        return pending(rows, done, self.keys, cap)

    def run(self, comparisons: DataFrame, compute: Callable[[DataFrame], DataFrame], cap: int | None = None) -> int:
        """Work off open comparisons in batches; how many were done.

        ``compute`` takes a table of comparisons and returns their rows, with the key columns.  A comparison
        without rows is done too.
        """
        taken = 0
        while cap is None or taken < cap:
            some = materialise(self.open(comparisons, self.batch if cap is None else min(self.batch, cap - taken)))
            n = some.count()
            if not n:
                break
            rows = materialise(compute(some))
            self.write(rows)
            self.commit(some, rows)
            taken += n
        return taken

    def write(self, rows: DataFrame) -> None:
        """Replace the folders of the comparisons in ``rows``."""
        write_table(rows, self.folder, partition_by=self.keys)

    def commit(self, some: DataFrame, rows: DataFrame) -> None:
        """Enter comparisons in the ledger, with how many rows they gave."""
        counts = rows.groupBy(*self.keys).agg(F.count(F.lit(1)).alias("n_rows"))
        self.ledger.upsert(join_same(some, counts, self.keys, "left").fillna(0, ["n_rows"]))

    def results(self, schema: str | None = None) -> DataFrame | None:
        """Rows of the comparisons that are in the ledger; None before the first one."""
        done = self.ledger.read()
        if done is None:
            return None
        reader = self.spark.read.schema(schema) if schema else self.spark.read
        try:
            rows = reader.parquet(self.folder)
        except AnalysisException as error:
            if error.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
                return None
            raise
        return join_same(rows, done.select(*self.keys), self.keys, "left_semi")
