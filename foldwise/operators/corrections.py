"""Permutation p values, effective number of tests and the choice of correction."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foldwise.functions.special import hypergeometric_upper, let, ln_factorial_sql
from foldwise.operators.enrichment import SAME, bh_adjust
from foldwise.operators.joins import jaccard_matrix
from foldwise.operators.keys import join_same
from foldwise.operators.ordering import ranked
from foldwise.operators.sampling import shuffle_key
from foldwise.session import bounded, materialise


def scattered_sql(x: str, side: str, key: Callable[[int], str], div: str) -> str:
    """A keyed bijection on the numbers below ``side`` squared, as SQL: four Feistel rounds on (x div side, x mod side).

    ``key(j)`` names the j-th of eight integers below 65536; ``div`` is the engine's integer division.
    """
    left, right = f"({x} {div} {side})", f"({x} % {side})"
    for j in range(0, 8, 2):
        left, right = right, f"(({left} + ({right} * {key(j)} + {key(j + 1)}) % 65521) % {side})"
    return f"({left} * {side} + {right})"


def permuted_sides(classes: DataFrame, by: Sequence[str], n_perm: int, seed: int) -> DataFrame:
    """Feature numbers on a side in each permutation: (by, perm, number, down).

    Shuffling fold changes over features is the same as drawing which ``k`` land on
    each side.  A keyed bijection scatters 0, 1, 2, ... over the least square that
    holds all features; of its values the first ``2 k`` that number a feature are the
    draw, so only those are ever made.
    """
    sizes = classes.where("k > 0").groupBy(*by).agg(F.max("n").alias("n"), F.max("k").alias("k"))
    rows = sizes.withColumn("side", F.ceil(F.sqrt("n")).cast("long")).withColumn("perm", F.explode(F.sequence(F.lit(1), F.lit(n_perm))))
    rows = rows.withColumn("_h", shuffle_key(F.col("perm"), F.lit(seed), *[F.col(c) for c in by]))
    rows = rows.withColumns({f"_k{j}": F.conv(F.substring("_h", 4 * j + 1, 4), 16, 10).cast("long") for j in range(8)})
    tasks = 4 * int(classes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.repartition(tasks, *by, "perm")
    at = scattered_sql("x", "side", lambda j: f"_k{j}", "div")
    drawn = F.expr(f"slice(filter(transform(sequence(0L, 2 * k + side * side - n - 1), x -> {at}), y -> y < n), 1, cast(2 * k AS int))")
    rows = rows.select(*by, "perm", "k", F.posexplode(drawn).alias("_at", "number"))
    return rows.select(*by, "perm", "number", (F.col("_at") < F.col("k")).alias("down"))


def _rounds(keys: np.ndarray, side: int) -> list[np.ndarray]:
    """What each round of the keyed bijection adds, for every right half; last round first."""
    right = np.arange(side)
    return [(right * a + b) % 65521 % side for a, b in keys.reshape(4, 2)[::-1].astype(np.int64)]


def _places(left: np.ndarray, right: np.ndarray, rounds: list[np.ndarray], side: int) -> np.ndarray:
    """Where the bijection finds the numbers ``left * side + right``: its inverse."""
    for add in rounds:
        back = np.take(add, left, mode="clip")
        np.subtract(right, back, out=back)
        back += side & (back >> 63)
        left, right = back, left
    return left * side + right


class _Shuffles:
    """All permutations of one comparison: keys, and the last place on the first and on either side."""

    def __init__(self, name: str, n: int, k: int, n_perm: int):
        self.name, self.n, self.k, self.side = name, n, k, math.isqrt(n - 1) + 1
        self.keys = [np.frombuffer(hashlib.md5(f"{perm}:{name}".encode()).digest(), ">u2") for perm in range(1, n_perm + 1)]
        self.last = [self._ends(_rounds(key, self.side)) for key in self.keys]

    def _ends(self, rounds: list[np.ndarray]) -> list[int]:
        """Places of the k-th and 2k-th number below n: those of the numbers from n on are skipped."""
        left, right = np.divmod(np.arange(self.n, self.side**2), self.side)
        skipped = np.sort(_places(left, right, rounds, self.side))
        skipped -= np.arange(len(skipped))
        return [m - 1 + int(np.searchsorted(skipped, m - 1, side="right")) for m in (self.k, 2 * self.k)]

    def hits(self, numbers: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Features on either side of each run of ``numbers`` in each permutation: up * 2^32 + down."""
        left, right = np.divmod(numbers.astype(np.int64), self.side)
        out = np.empty((len(starts), len(self.keys)), np.int64)
        for j, (key, (down, both)) in enumerate(zip(self.keys, self.last)):
            at = _places(left, right, _rounds(key, self.side), self.side)
            first = np.add.reduceat(at <= down, starts, dtype=np.int64)
            out[:, j] = ((np.add.reduceat(at <= both, starts, dtype=np.int64) - first) << 32) + first
        return out


def _outcome_lists(hits: np.ndarray) -> pa.Array:
    """For each row the distinct (_up, _down) but (0, 0), and how often each came."""
    hits = np.sort(hits, axis=1)
    new = np.ones(hits.shape, bool)
    new[:, 1:] = hits[:, 1:] != hits[:, :-1]
    row, at = np.nonzero(new)
    times = np.diff(np.append(row * hits.shape[1] + at, hits.size))
    value = hits[row, at]
    keep = value != 0
    offsets = np.zeros(len(hits) + 1, np.int32)
    np.cumsum(np.bincount(row[keep], minlength=len(hits)), out=offsets[1:])
    cells = [pa.array(v[keep].astype(np.int64)) for v in (value >> 32, value & 0xFFFFFFFF, times)]
    return pa.ListArray.from_arrays(pa.array(offsets), pa.StructArray.from_arrays(cells, ["_up", "_down", "_times"]))


# What a task looks at together: members, and counts of sets by permutations.
HIT_ROWS, HIT_CELLS = 20_000, 4_000_000


def _larger(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at least ``rows``, but for the last."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(b.num_rows for b in held) >= rows:
            yield pa.concat_batches(held)
            held = []
    if held:
        yield pa.concat_batches(held)


def shuffled_hits(classes: DataFrame, members: DataFrame, by: Sequence[str], n_perm: int, seed: int) -> DataFrame:
    """``by, set_id, _outcomes``: the (_up, _down) hits of each set over all permutations, and how many gave each.

    The permutations are those of ``permuted_sides``, which sends places to features.  Here a member asks for its
    place, by the inverse bijection: it is on a side if it stands before the place where that side is
    full.  So a set's members alone tell its hits, in every permutation; no draw is ever shuffled, and the rows that are
    do not grow with the permutations.  A task streams its rows in order of comparison and set, and folds
    each set; a set of any size is added up batch by batch.
    """
    by = list(by)
    spark = classes.sparkSession
    numbered = ranked(classes.select(*by, "feature_id"), by, [F.col("feature_id")], "number").withColumn("number", F.col("number") - 1)
    sizes = classes.where("k > 0").groupBy(*by).agg(F.max("n").alias("n"), F.max("k").alias("k"))
    sizes = sizes.withColumn("_name", F.concat_ws(":", F.lit(str(seed)), *[F.col(c).cast("string") for c in by]))
    rows = join_same(numbered.join(members.select("feature_id", "set_id"), "feature_id"), bounded(sizes), by)
    keys = [*by, "set_id"]
    tasks = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.select(*keys, "number", "n", "k", "_name").repartitionByRange(tasks, *keys).sortWithinPartitions(*keys)
    most = max(HIT_CELLS // n_perm, 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shuffles, held, counts = None, None, None  # the last set so far: its keys and its hits

        def folded(owner: pa.RecordBatch, hits: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([*owner.columns, _outcome_lists(hits)], names=[*keys, "_outcomes"])

        for batch in _larger(batches, HIT_ROWS):
            own = batch.select(keys)
            codes = np.stack([c.dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False) for c in own.columns])
            changed = np.ones(codes.shape, bool)
            changed[:, 1:] = codes[:, 1:] != codes[:, :-1]
            sets = np.nonzero(changed.any(axis=0))[0]
            tests = np.nonzero(changed[:-1].any(axis=0))[0]
            numbers = batch.column("number").to_numpy()
            cuts = np.union1d(tests, sets[::most])
            for a, b in zip(cuts, [*cuts[1:], batch.num_rows]):
                test = (batch.column("_name")[a].as_py(), batch.column("n")[a].as_py(), batch.column("k")[a].as_py())
                if shuffles is None or (shuffles.name, shuffles.n, shuffles.k) != test:
                    shuffles = _Shuffles(*test, n_perm)
                starts = sets[(sets >= a) & (sets < b)]
                hits = shuffles.hits(numbers[a:b], starts - a)
                owners = own.take(pa.array(starts))
                if held is not None and held.to_pylist() == owners.slice(0, 1).to_pylist():
                    hits[0] += counts[0]
                elif held is not None:
                    yield folded(held, counts)
                yield folded(owners.slice(0, len(hits) - 1), hits[:-1])
                held, counts = owners.slice(len(hits) - 1), hits[-1:].copy()
        if held is not None:
            yield folded(held, counts)

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*keys).schema)
    return rows.mapInArrow(run, f"{schema}, _outcomes array<struct<_up: bigint, _down: bigint, _times: bigint>>")


def shuffled_pvalues(classes: DataFrame, members: DataFrame, results: DataFrame, by: Sequence[str], n_perm: int, seed: int = 42) -> DataFrame:
    """Empirical p per (comparison, set): (1 + permutations with p <= observed) / (n_perm + 1).

    A permutation shuffles the fold changes over the features of a comparison, once for all its
    sets.  Each pair of counts of a set is one row however many permutations gave it, and an exact test is worked
    out once for each distinct table.  A set with no hit on either side has p = 1.
    """
    by = list(by)
    observed = results.select(*by, "set_id", F.col("p").alias("_p"), (F.col("a_up") + F.col("a_down") + F.col("c")).alias("_hits"), "n_up", "n_bg")
    rows = materialise(join_same(observed, shuffled_hits(classes, members, by, n_perm, seed), [*by, "set_id"]))
    cells = ["n_up", "n_bg", "_hits", "_up", "_down"]
    rows = rows.select(*[c for c in rows.columns if c != "_outcomes"], F.inline("_outcomes"))
    tables = rows.select(*cells).distinct().withColumn("_c", F.col("_hits") - F.col("_up") - F.col("_down"))
    up = hypergeometric_upper("_up", "n_up - _up", "_c", "n_bg - _c")
    down = hypergeometric_upper("_down", "n_up - _down", "_c", "n_bg - _c")
    tasks = int(classes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    tables = bounded(tables.repartition(tasks).select(*cells, F.least(up, down).alias("_null")))
    beaten = rows.join(tables, cells).groupBy(*by, "set_id").agg(F.sum(F.when(F.col("_null") <= F.col("_p") * (1 + SAME), F.col("_times"))).alias("_n"))
    joined = join_same(results, beaten, [*by, "set_id"], "left")
    count = F.when(F.col("p") * (1 + SAME) >= 1, F.lit(n_perm)).otherwise(F.coalesce("_n", F.lit(0)))
    return joined.withColumn("perm_p", (count + 1) / F.lit(n_perm + 1.0)).drop("_n")


def null_outcomes(tables: DataFrame) -> DataFrame:
    """How likely a random draw of the two sides is at least as extreme as each outcome it may have.

    ``tables`` has distinct (n_up, n_bg, hits): two sides of ``n_up`` features, ``n_bg`` others, and a
    set of ``hits`` features.  Shuffling features over the sides gives a set ``up`` and ``down`` of them by the
    bivariate hypergeometric law.  Returns ``n_up, n_bg, hits, up, down, share``: the chance of an
    outcome whose exact p is not above that of (up, down).  Outcomes farther from the mean than nine
    standard deviations and 25 are left out; by Bernstein's bound all of them together have a chance
    below 1e-15.  A table has at most the square of that range, however many sets share it.
    """
    cells = ["n_up", "n_bg", "hits"]
    total = "(2 * n_up + n_bg)"
    f = ln_factorial_sql
    rows = tables.select(*cells).withColumn("_mean", F.expr(f"hits * n_up / {total}"))
    rows = rows.withColumn("_reach", F.expr(f"25 + 9 * sqrt(_mean * (1 - n_up / {total}) * ({total} - hits) / greatest({total} - 1, 1))"))
    span = F.expr("sequence(cast(greatest(floor(_mean - _reach), 0) AS bigint), cast(least(hits, n_up, ceil(_mean + _reach)) AS bigint))")
    rows = rows.select(*cells, span.alias("_span"), F.expr(f"2 * {f('n_up')} + {f('n_bg')} - {f(total)} + {f('hits')} + {f(f'{total} - hits')}").alias("_whole"))
    rows = rows.select(*cells, "_whole", "_span", F.explode("_span").alias("up")).select(*cells, "_whole", "up", F.explode("_span").alias("down"))
    rows = rows.withColumn("c", F.expr("hits - up - down")).where("c BETWEEN 0 AND n_bg")
    parts = " - ".join(f(x) for x in ("up", "n_up - up", "down", "n_up - down", "c", "n_bg - c"))
    rows = materialise(rows.select(*cells, "up", "down", "c", F.expr(f"exp(_whole - {parts})").alias("_chance")))
    # Both sides have the same range, so the tails of one are those of the other; each is worked out once.
    tails = rows.select("n_up", "n_bg", F.col("up").alias("a"), "c").distinct()
    tails = materialise(tails.repartition(int(tables.sparkSession.conf.get("spark.sql.shuffle.partitions"))).withColumn("_tail", hypergeometric_upper("a", "n_up - a", "c", "n_bg - c")))
    for side in ("up", "down"):
        rows = rows.join(tails.select("n_up", "n_bg", F.col("a").alias(side), "c", F.col("_tail").alias(f"_{side}")), ["n_up", "n_bg", side, "c"])
    rows = rows.withColumn("_p", F.least("_up", "_down"))
    # Equal p up to rounding count as equal: an outcome's place is just above its own p.
    both = F.inline(F.array(
        F.struct(F.col("_p").alias("_at"), F.col("_chance").alias("_add"), F.lit(0).alias("_asks")),
        F.struct((F.col("_p") * (1 + SAME)).alias("_at"), F.lit(0.0).alias("_add"), F.lit(1).alias("_asks"))))
    order = Window.partitionBy(*cells).orderBy("_at", "_asks").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.select(*cells, "up", "down", both).withColumn("share", F.least(F.sum("_add").over(order), F.lit(1.0)))
    return rows.where("_asks = 1").select(*cells, "up", "down", "share")


def _beats(n_from: int, n: int) -> Column:
    """Numbers, from 1 on, of a row's draws below its ``_level``: those after ``n_from`` and up to ``n``.

    Each md5 of the key and a block's number is four draws of eight hexadecimal digits.
    """
    marks = ", ".join(f"CASE WHEN substr(h, {8 * j + 1}, 8) < _level THEN b * 4 + {j + 1} END" for j in range(4))
    blocks = f"transform(sequence({n_from // 4}, {(n + 3) // 4 - 1}), b -> {let('d', f'transform(array(d.h), h -> array({marks}))', h='md5(concat(_key, cast(b AS string)))')})"
    return F.expr(f"filter(flatten(flatten({blocks})), x -> x > {n_from} AND x <= {n})")


def permutation_pvalues(results: DataFrame, by: Sequence[str], n_perm: int, seed: int = 42, stop: int | None = None) -> DataFrame:
    """Empirical p per (comparison, set): (1 + permutations with p <= observed) / (n_perm + 1).

    A permutation changes only how many features of a set lie on either side, so it is drawn for each set
    from the law of these two counts: with the outcomes ordered by their p, a uniform number below the
    chance of the observed or a more extreme one is a permutation that beats the observation.  The
    numbers are keyed by comparison, set, seed and number of the draw, and repeat on every engine and
    retry.  Cost: one md5 for four draws of a set; outcomes are worked out once for each distinct
    (size of the sides, others, features of the set).

    With ``stop``, drawing ends at the stop-th permutation that beats the observation, and p is
    ``stop`` over the draws made, as Besag and Clifford proposed: a set that is clearly not
    enriched needs few draws.  ``n_drawn`` tells how many there were.

    A set with p = 1 is beaten by every permutation.  A missing key or set is a key like any other.
    """
    by = list(by)
    rows = results.withColumn("hits", F.col("a_up") + F.col("a_down") + F.col("c"))
    outcomes = null_outcomes(rows.where("n_up > 0").select("n_up", "n_bg", "hits").distinct())
    found = rows.join(outcomes.withColumnsRenamed({"up": "a_up", "down": "a_down"}), ["n_up", "n_bg", "hits", "a_up", "a_down"], "left")
    certain = F.col("p") * (1 + SAME) >= 1
    level = F.floor(F.coalesce("share", F.lit(0.0)) * F.lit(float(1 << 32))).cast("long")
    found = found.withColumn("_level", F.when(certain | (F.col("share") >= 1), F.lit("g")).otherwise(F.lpad(F.lower(F.hex(level)), 8, "0")))
    parts = [F.lit(str(seed)), *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (*by, "set_id")], F.lit("")]
    found = found.withColumn("_key", F.concat_ws(":", *parts))
    # Few bytes, much work: spread over all tasks.  A row draws for itself, so nothing but the rows is ever moved.
    found = found.repartition(int(results.sparkSession.conf.get("spark.sql.shuffle.partitions")), "_key")
    # Where every permutation beats the observation or none can, nothing is drawn.
    asked = (F.col("_level") != "g") & (F.col("_level") != "00000000")
    if stop is None:
        beaten = F.when(F.col("_level") == "g", F.lit(n_perm)).otherwise(F.when(asked, F.size(_beats(0, n_perm))).otherwise(0))
        found = found.withColumn("perm_p", (beaten + 1) / F.lit(n_perm + 1.0))
    else:
        few = min(n_perm, 10 * stop) // 4 * 4  # enough for most sets; only the others see the rest of their draws
        none = F.array().cast("array<int>")
        certain = F.sequence(F.lit(1), F.lit(n_perm))
        found = found.withColumn("_at", F.when(F.col("_level") == "g", certain).otherwise(F.when(asked, _beats(0, few) if few else none).otherwise(none)))
        more = asked & (F.size("_at") < stop)
        rest = F.concat("_at", _beats(few, n_perm)) if n_perm > few else F.col("_at")
        found = found.withColumn("_at", F.when(more, rest).otherwise(F.col("_at")))
        ended = F.size("_at") >= stop
        found = found.withColumn("n_drawn", F.when(ended, F.get("_at", F.lit(stop - 1))).otherwise(n_perm))
        found = found.withColumn("perm_p", F.when(ended, F.lit(float(stop)) / F.col("n_drawn")).otherwise((F.size("_at") + 1) / F.lit(n_perm + 1.0)))
    found = materialise(found.drop("_key", "_level", *([] if stop is None else ["_at"])))
    return found.select(*results.columns, *([] if stop is None else ["n_drawn"]), "perm_p")


def participation(members: DataFrame) -> float:
    """Effective number of independent sets: n squared over the sum of all squared Jaccard indices.

    n for sets without a common member, 1 for n equal ones; nothing but two sums leaves the cluster.
    """
    n = members.select("set_id").distinct().count()
    square = jaccard_matrix(members).agg(F.sum(F.pow("jaccard", F.lit(2)))).first()[0] or 0.0
    return round(n * n / (n + 2 * square), 6) if n else 0.0


# The eigenvalue step needs all sets in one matrix; above this many sets refuse.
MAX_SETS = 4000


def m_eff(members: DataFrame) -> int:
    """Effective number of independent sets from the eigenvalues of their Jaccard matrix.

    Overlaps are counted on the cluster; only the set-by-set matrix, whose size is
    checked first, is decomposed on the driver.
    """
    sets = members.groupBy("set_id").agg(F.count(F.lit(1)).alias("n"))
    n = sets.count()
    if n > MAX_SETS:
        raise ValueError(f"{n} sets: the eigenvalue step is limited to {MAX_SETS}; group the sets first")
    index = {row[0]: k for k, row in enumerate(sets.select("set_id").orderBy("set_id").collect())}
    matrix = np.eye(n)
    for a, b, j in jaccard_matrix(members).select("set_a", "set_b", "jaccard").collect():
        matrix[index[a], index[b]] = matrix[index[b], index[a]] = j
    values = np.linalg.eigvalsh(matrix)
    values = values[values > 0]
    # Rounded before the ceiling so that n independent sets give n, not n + 1.
    return math.ceil(round(float(np.sqrt(values).sum() ** 2 / values.sum()), 9))


def correct(results: DataFrame, by: Sequence[str], method: str, effective: float | None = None) -> DataFrame:
    """Adjusted p by 'bh', 'permutation' (needs perm_p) or 'meff_bh'; ``bh_p`` is always kept."""
    plain = results.drop("adj_p")
    rows = bh_adjust(plain, by, "p", "bh_p")
    if method == "bh":
        return rows.withColumn("adj_p", F.col("bh_p"))
    if method == "permutation":
        return rows.withColumn("adj_p", F.col("perm_p"))
    if method == "meff_bh":
        rows = bh_adjust(rows, by, "p", "meff_p", m_eff=effective)
        return rows.withColumn("adj_p", F.col("meff_p"))
    raise ValueError(f"unknown correction: {method}")
