"""Connected components of an edge table, by forests within tasks and alternating star contractions between them."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foldwise.llm.common import materialise
from foldwise.session import discard

MAX_ROUNDS = 60
TASK_EDGES = 500_000  # edges that one task folds


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges of a task as (node, least node that the task's edges reach from it); no edge where they are one."""
    up: dict[int, int] = {}

    def find(i: int) -> int:
        while (above := up[i]) != i:
            up[i] = up[above]
            i = above
        return i

    def flush() -> pa.RecordBatch:
        found = [(i, r) for i in up if (r := find(i)) != i]
        up.clear()
        return pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], pa.int64()) for k in range(2)], names=["a", "b"])

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            up.setdefault(a, a), up.setdefault(b, b)
            a, b = find(a), find(b)
            if a != b:
                up[max(a, b)] = min(a, b)
        if len(up) > TASK_EDGES:
            yield flush()
    yield flush()


def _folded(edges: DataFrame, tasks: int | None = None) -> DataFrame:
    edges = edges.select("a", "b")
    return materialise((edges.coalesce(tasks) if tasks else edges).mapInArrow(_forest, "a long, b long"))


def _both_ways(edges: DataFrame) -> DataFrame:
    return edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))


def _hang(pairs: DataFrame) -> DataFrame:
    """Hang every neighbour ``b`` of ``a`` below the least of ``a`` and its neighbours."""
    least = pairs.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("c"), F.least("a", "m").alias("m"))
    return pairs.join(least, F.col("a") == F.col("c")).select("a", "b", "m")


def _contracted(star: DataFrame) -> DataFrame:
    """One round: every larger neighbour, then every smaller one, hung below the least."""
    large = _hang(_both_ways(star)).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    hung = _hang(large.where("a <> b").distinct())  # here every b is smaller than its a
    small = hung.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(hung.select("a", F.col("m").alias("b")))
    return small.where("a <> b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """``node, root`` for every node that has an edge; the root is the least node of its component.

    ``edges`` has long columns ``a, b``; direction, repetition and loops do not matter.  Each task
    first folds its own edges to a forest, at most one edge a node.  As long as there are more edges
    than one task's share, rounds shorten all paths between tasks, and tasks fold what is left; edges
    that fit one share are done with the fold.  Every step writes its result, so lineage stays
    short.  Large neighbourhoods are only aggregated or joined, never gathered.
    """
    # Written first: the edges may come from a Python step, and a task is to hold one worker at a time.
    given = materialise(edges.where("a <> b").select("a", "b"))
    star = _folded(given)
    discard(given)
    before = None
    for _ in range(MAX_ROUNDS):
        now = star.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        tasks = max(1, math.ceil(now[0] / TASK_EDGES))
        if now == before:
            break
        last = star
        if tasks == 1:
            star = _folded(last, 1)
        else:
            before = now
            star = _folded(_contracted(last), tasks)
        discard(last)
        if tasks == 1:
            break
    else:
        raise RuntimeError(f"components not settled after {MAX_ROUNDS} rounds")
    roots = star.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    return star.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots)
