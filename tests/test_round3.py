"""Grids by dominance, one-pass bag join, sampling by bound, permutation by law, per-feature fits, tails and heads."""

import io
import itertools
import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from foldwise.functions import special as sp
from foldwise.operators import corrections as co
from foldwise.operators import grids
from foldwise.operators import joins as jo
from foldwise.operators import kernel as kn
from foldwise.operators import models as mo
from foldwise.operators import ordering as od
from foldwise.operators import sampling as sa
from foldwise.operators import stats as st
from foldwise.operators import summaries as su
from foldwise.session import bounded
from foldwise.sources import manifest as ma


def plan(df):
    """The plan before it runs."""
    return df._jdf.queryExecution().executedPlan().toString().rpartition("== Initial Plan ==")[2]


# ---- grids ----------------------------------------------------------------------------------

def random_results(seed, n=300):
    r = random.Random(seed)
    out = []
    for _ in range(n):
        p = r.choice([r.random(), round(r.random(), 1), None if r.random() < 0.1 else 0.5])
        lff = r.choice([r.uniform(-3, 3), float(round(r.uniform(-3, 3))), None if r.random() < 0.1 else 1.0])
        out.append((float(r.choice([1, 2, 3])), r.choice("ab"), r.choice(["m", "l", "x"]), r.choice(["T1", "T2", "T3"]), r.randrange(40), r.choice("+-"), p, lff))
    return out


SCHEMA = "pct double, grp string, timepoint string, condition string, set_id int, direction string, p double, lff double"


def hit(row, cell):
    return row[0] == cell[0] and row[6] is not None and row[7] is not None and row[6] <= cell[1] and abs(row[7]) >= cell[2]


@pytest.mark.parametrize("grid", [
    [(a, b, c) for a in (1.0, 2.0, 9.0) for b in (0.1, 0.5, 0.5, 2.0) for c in (0.0, 1.0, 2.5)],
    [(1.0, 0.3, 0.2), (1.0, 0.5, 1.0), (2.0, 0.05, 0.0), (3.0, 1.0, 0.0), (3.0, 0.0, 0.0)],  # not every combination
    [(1.0, -1.0, 99.0)],
])
def test_grids_equal_brute_force(spark, grid):
    data = random_results(len(grid))
    df = spark.createDataFrame(data, SCHEMA)
    sweep = {(r.pct, r.max_p, r.min_lff): (r.total_hits, r.n_sets, r.n_comparisons) for r in su.threshold_sweep(df, grid, "p").collect()}
    claims = {(r.pct, r.max_p, r.min_lff): r for r in su.core_claims(df, grid, ["T1", "T2", "T3"], "m", "l", "T2", "p").collect()}
    listed = sorted((r.pct, r.max_p, r.min_lff, r.set_id, r.grp, r.timepoint, r.condition, r.direction) for r in grids.hits(df, grid, "p").collect())
    assert set(sweep) == set(claims) == set(grid)
    want = []
    for cell in set(grid):
        rows = [r for r in data if hit(r, cell)]
        want += [(*cell, r[4], r[1], r[2], r[3], r[5]) for r in rows]
        assert sweep[cell] == (len(rows), len({r[4] for r in rows}), len({r[1:4] for r in rows}))
        sets = {s: [r for r in rows if r[4] == s] for s in {r[4] for r in rows}}
        shared = sum({r[3] for r in some if r[2] == "m"} == {"T1", "T2", "T3"} for some in sets.values())
        turned = sum(any(r[2:4] == ("m", "T2") and r[5] == "-" for r in some) and any(r[2:4] == ("l", "T2") and r[5] == "+" for r in some) for some in sets.values())
        mid, late = [r for r in rows if r[2:4] == ("m", "T2")], [r for r in rows if r[2:4] == ("l", "T2")]
        got = claims[cell]
        assert (got.n_shared, got.n_reversed) == (shared, turned)
        assert got.pct_down == (pytest.approx(100 * sum(r[5] == "-" for r in mid) / len(mid)) if mid else None)
        assert got.pct_up == (pytest.approx(100 * sum(r[5] == "+" for r in late) / len(late)) if late else None)
    assert listed == sorted(want)


def test_a_fine_grid_is_a_table(spark):
    """A grid of 100 x 100 x 5 cells: counts by place, keys shuffled once, as many cells as the grid has."""
    data = [(float(a), *row[1:]) for row in random_results(8, 60) for a in range(5)]
    df = spark.createDataFrame(data, SCHEMA).repartition(3)
    cells = spark.range(100).select(F.explode(F.array(*[F.lit(float(k)) for k in range(5)])).alias("pct"), (F.col("id") / 100).alias("max_p"))
    cells = cells.withColumn("min_lff", F.explode(F.array(*[F.lit(k / 33) for k in range(100)])))
    got = su.threshold_sweep(df, cells, "p").toPandas()
    assert len(got) == 50_000
    p, lff = np.array([r[6] if r[6] is not None else 9 for r in data]), np.array([abs(r[7]) if r[7] is not None else -1 for r in data])
    pct, ids = np.array([r[0] for r in data]), np.array([r[4] for r in data])
    for row in got.sample(300, random_state=1).itertuples():
        inside = (pct == row.pct) & (p <= row.max_p) & (lff >= row.min_lff)
        assert row.total_hits == inside.sum() and row.n_sets == len(set(ids[inside]))
    keys = grids.key_counts(grids.placed(df, grids.grid_of(spark, cells), "p"), ["set_id"], {"n_sets": [F.lit(True)]})
    assert len(re.findall(r"Exchange hashpartitioning\(pct#\d+, set_id#\d+", plan(keys))) == 1 and "NestedLoop" not in plan(keys)


def test_empty_results(spark):
    empty = spark.createDataFrame([], SCHEMA)
    got = su.threshold_sweep(empty, [(1.0, 0.5, 0.0)], "p").collect()
    assert [(r.total_hits, r.n_sets, r.n_comparisons) for r in got] == [(0, 0, 0)]
    assert su.core_claims(empty, [(1.0, 0.5, 0.0)], ["T1"], "m", "l", "T2", "p").first().pct_up is None


# ---- bag join -------------------------------------------------------------------------------

def test_bag_pairs(spark):
    r = random.Random(5)
    left = [(r.choice(["a", "b", None]), r.choice([1, 2]), k) for k in range(40)]
    right = [(r.choice(["a", "b", "c", None]), r.choice([1, 2]), 100 - k) for k in range(30)]
    schema = "k string, m int, o int"
    df = jo.bag_pairs(spark.createDataFrame(left, schema), spark.createDataFrame(right, schema), ["k", "m"], ["o"])
    want = set()
    for key in {row[:2] for row in left + right}:
        a, b = sorted(x[2] for x in left if x[:2] == key), sorted(x[2] for x in right if x[:2] == key)
        pairs = itertools.zip_longest(a, b) if key[0] is not None else [*((x, None) for x in a), *((None, x) for x in b)]
        want |= {(*key, *pair) for pair in pairs}
    got = [(x.k, x.m, x.left and x.left.o, x.right and x.right.o) for x in df.collect()]
    assert set(got) == want and len(got) == len(want)
    assert plan(df).count("Exchange") == 2  # for the rank, and one over the ranked rows


# ---- sampling -------------------------------------------------------------------------------

def test_stratified_sample_ranks_few_rows(spark, monkeypatch):
    rows = [(k, "big" if k < 6000 else "small" if k < 6030 else None) for k in range(6100)]
    df = spark.createDataFrame(rows, "feature_id int, s string").repartition(4)
    ranked, seen = sa.ranked, []
    monkeypatch.setattr(sa, "ranked", lambda df, *a, **k: (seen.append(df.count()), ranked(df, *a, **k))[1])
    got = sorted((r.s or "", r.feature_id) for r in sa.stratified_sample(df, "s", 0.05, 20, 7).collect())
    want = []
    for s in ("big", "small", None):
        ids = sorted((__import__("hashlib").md5(f"{k}:7".encode()).hexdigest(), k) for k, x in rows if x == s)
        want += [(s or "", k) for _, k in ids[: max(math.floor(len(ids) * 0.05), 20)]]
    assert got == sorted(want) and seen[0] < 700


def test_stratified_sample_tops_up(spark, monkeypatch):
    """Where too few rows lie below the bound, the stratum is ranked as a whole."""
    df = spark.createDataFrame([(k, k % 2) for k in range(400)], "feature_id int, s int")
    want = sorted(r.feature_id for r in sa.stratified_sample(df, "s", 0.1, 5, 3).collect())
    key = sa.shuffle_key
    monkeypatch.setattr(sa, "shuffle_key", lambda *parts: F.concat(F.lit("ffffffff"), key(*parts)))
    assert sorted(r.feature_id for r in sa.stratified_sample(df, "s", 0.1, 5, 3).collect()) == want


# ---- permutation ----------------------------------------------------------------------------

def tail(a, margin, k, total):
    """P(X >= a) for a draw of k of ``total`` that hold ``margin``."""
    return sum(math.comb(margin, x) * math.comb(total - margin, k - x) for x in range(a, min(margin, k) + 1)) / math.comb(total, k)


def null_p(up, down, hits, k, n_bg):
    """Both one-sided exact tests of a side against the others, the other side left out."""
    return min(tail(up, hits - down, k, k + n_bg), tail(down, hits - up, k, k + n_bg))


@pytest.mark.parametrize("k, n_bg, hits", [(5, 30, 4), (12, 60, 9), (3, 8, 14), (20, 100, 30)])
def test_outcomes_are_exact(spark, k, n_bg, hits):
    got = {(r.up, r.down): r.share for r in co.null_outcomes(spark.createDataFrame([(k, n_bg, hits)], "n_up long, n_bg long, hits long")).collect()}
    total = 2 * k + n_bg
    every = {(u, d): math.comb(k, u) * math.comb(k, d) * math.comb(n_bg, hits - u - d) / math.comb(total, hits)
             for u in range(min(k, hits) + 1) for d in range(min(k, hits) + 1) if 0 <= hits - u - d <= n_bg}
    assert set(got) == set(every)
    p = {x: null_p(*x, hits, k, n_bg) for x in every}
    for x in every:
        assert got[x] == pytest.approx(sum(c for y, c in every.items() if p[y] <= p[x] * (1 + 1e-9)), abs=1e-10)


def test_far_outcomes_of_large_sets_are_left_out(spark):
    rows = co.null_outcomes(spark.createDataFrame([(1500, 27000, 4000)], "n_up long, n_bg long, hits long")).agg(F.count(F.lit(1)), F.max("share"), F.min("up")).first()
    assert rows[0] < 200_000 and rows[1] == pytest.approx(1.0, abs=1e-9) and rows[2] > 0


def test_permutation_agrees_with_shuffling(spark):
    """Shuffles of the sides over features and draws from the law beat the observations equally often."""
    rng = np.random.default_rng(3)
    n, k, perms = 120, 12, 1500
    sets = [rng.choice(n, size, replace=False) for size in (4, 9, 15, 30, 60) for _ in range(3)]
    side = np.zeros(n, dtype=int)
    side[:k], side[k : 2 * k] = 1, 2
    observed = []
    for s, members in enumerate(sets):
        up, down = int((side[members] == 1).sum()), int((side[members] == 2).sum())
        observed.append(("x", s, up, down, len(members) - up - down, k, k, n - 2 * k, null_p(up, down, len(members), k, n - 2 * k)))
    df = spark.createDataFrame(observed, "c string, set_id int, a_up long, a_down long, c_ long, n_up long, n_down long, n_bg long, p double").withColumnRenamed("c_", "cc")
    df = df.withColumnRenamed("c", "comparison").withColumnRenamed("cc", "c")
    got = {r.set_id: r.perm_p for r in co.permutation_pvalues(df, ["comparison"], perms).collect()}
    beaten = np.zeros(len(sets))
    cache = {}
    for _ in range(perms):
        now = rng.permutation(side)
        for s, members in enumerate(sets):
            key = (int((now[members] == 1).sum()), int((now[members] == 2).sum()), len(members))
            if key not in cache:
                cache[key] = null_p(*key, k, n - 2 * k)
            beaten[s] += cache[key] <= observed[s][8] * (1 + 1e-9)
    for s in range(len(sets)):
        share = (beaten[s] + 1) / (perms + 1)
        assert abs(got[s] - share) < 5 * math.sqrt(2 * share * (1 - share) / perms) + 2 / perms
    early = {r.set_id: r for r in co.permutation_pvalues(df, ["comparison"], perms, stop=10).collect()}
    for s, r in early.items():
        assert r.n_drawn <= perms and (r.perm_p == pytest.approx(10 / r.n_drawn) if r.n_drawn < perms else r.perm_p <= 11 / perms)
        assert abs(r.perm_p - got[s]) < 5 * got[s] / math.sqrt(10) + 3 / perms
    assert sum(r.n_drawn for r in early.values()) < perms * len(sets) / 3


def test_permutation_edges(spark):
    rows = [("x", 1, 0, 0, 3, 0, 0, 9, 1.0), ("x", 2, 0, 0, 2, 3, 3, 9, 1.0), (None, 2, 3, 0, 0, 3, 3, 9, 1 / math.comb(12, 3))]
    df = spark.createDataFrame(rows, "grp string, set_id int, a_up long, a_down long, c long, n_up long, n_down long, n_bg long, p double")
    got = {(r.grp, r.set_id): r.perm_p for r in co.permutation_pvalues(df, ["grp"], 99).collect()}
    assert got["x", 1] == got["x", 2] == 1.0 and got[None, 2] < 0.1
    assert co.permutation_pvalues(df.where("false"), ["grp"], 99).count() == 0


# ---- whole percentiles ----------------------------------------------------------------------

def test_any_number_of_ranks_takes_three_scans(spark, monkeypatch):
    monkeypatch.setattr(od, "_BRACKET_VALUES", 2000)
    scans, scan = [], od._scan
    monkeypatch.setattr(od, "_scan", lambda rows: scans.append(1) or scan(rows))
    rng = np.random.default_rng(2)
    values = np.concatenate((rng.lognormal(0, 4, 30_000), -rng.random(5_000), np.zeros(3_000), [1e300, -1e300]))
    df = spark.createDataFrame([(float(v),) for v in values], "v double").repartition(5)
    probs = {str(k): k / 40 for k in range(41)} | {"low": 0.01, "high": 0.99}
    got = od.whole_percentiles(df, "v", probs)
    assert len(scans) <= 3
    assert list(got.values()) == pytest.approx(np.quantile(values, list(probs.values())).tolist(), rel=1e-12)


# ---- Kruskal-Wallis -------------------------------------------------------------------------

@pytest.mark.parametrize("x, df, p", [
    (3.841458820694124, 1, 0.05), (5.991464547107979, 2, 0.05), (7.814727903251179, 3, 0.05), (12.591587243743977, 6, 0.05),
    (6.634896601021213, 1, 0.01), (16.811893829770927, 6, 0.01), (124.34211340400407, 100, 0.05), (2.0, 2, math.exp(-1)), (0.0, 4, 1.0),
    # with an even number of degrees of freedom it is a sum of Poisson terms
    *[(x, df, sum(math.exp(k * math.log(x / 2) - x / 2 - math.lgamma(k + 1)) for k in range(df // 2))) for x, df in ((900.0, 1000), (1100.0, 1000), (40.0, 8), (1e-3, 6))]])
def test_chi_squared_tails(spark, x, df, p):
    got = spark.range(1).select(sp.chi2_upper(f"{x!r}D", str(df)).alias("p")).first().p
    assert got == pytest.approx(p, abs=1e-9)


@pytest.mark.parametrize("n_groups", [1, 2, 3, 4, 7])
def test_kruskal_for_any_number_of_groups(spark, n_groups):
    rng = np.random.default_rng(n_groups)
    data = [(g, float(v)) for g in range(n_groups) for v in np.round(rng.normal(g / 4, 1, 11), 1)]
    r = st.kruskal(spark.createDataFrame([(0, *d) for d in data], "b int, g int, v double"), ["b"], "g", "v").first()
    values = np.array([v for _, v in data])
    rank = np.array([(values < v).sum() + ((values == v).sum() + 1) / 2 for v in values])
    n = len(values)
    groups = np.array([g for g, _ in data])
    h = 12 / (n * (n + 1)) * sum(rank[groups == g].sum() ** 2 / (groups == g).sum() for g in range(n_groups)) - 3 * (n + 1)
    h /= 1 - sum(c**3 - c for c in np.unique(values, return_counts=True)[1]) / (n**3 - n)
    assert r.h == pytest.approx(h, abs=1e-9) and r.n_groups == n_groups
    if n_groups == 1:
        assert r.p is None
    else:  # by integrating the density
        t = np.linspace(0, math.sqrt(h), 200_001)
        f = t ** (n_groups - 2) * np.exp(-t * t / 2) * 2 ** (1 - (n_groups - 1) / 2) / math.gamma((n_groups - 1) / 2)
        assert r.p == pytest.approx(1 - np.sum((f[1:] + f[:-1]) / 2) * (t[1] - t[0]), abs=1e-8)


def test_kruskal_of_equal_values(spark):
    r = st.kruskal(spark.createDataFrame([(0, g, 1.0) for g in (1, 2, 2)], "b int, g int, v double"), ["b"], "g", "v").first()
    assert r.h is None and r.p is None


# ---- per-feature dropout --------------------------------------------------------------------

def test_feature_dropout_slopes(spark):
    rng = np.random.default_rng(6)
    rows, want = [], {}
    for feature in range(20):
        mu = np.exp(rng.normal(0, 1, 24))
        y = np.where(rng.random(24) < 1 / (1 + np.exp(0.2 + 0.9 * np.log(mu))), 0.0, 2.0)
        rows += [(feature, float(a), float(b)) for a, b in zip(y, mu, strict=True)]
        want[feature] = kn.dropout_fit(y[None], mu[None])[0]
    rows += [(100, 0.0, 1.0 + k) for k in range(5)] + [(101, float(k > 2), 1.0 + k) for k in range(6)] + [(102, None, 3.0), (102, 1.0, 0.0), (103, 1.0, None)]
    got = {r.feature_id: r for r in mo.feature_dropout_slopes(spark.createDataFrame(rows, "feature_id int, y double, mu double")).collect()}
    assert set(got) == {*range(20), 100, 101, 102}
    for feature, fit in want.items():
        r = got[feature]
        if not r.separated:
            assert r.converged and (r.gamma0, r.gamma1) == pytest.approx(tuple(fit), rel=1e-5)
    assert got[100].separated and got[101].separated and got[102].separated and sum(r.separated for r in got.values()) <= 6
    assert all(math.isfinite(r.gamma0) and math.isfinite(r.gamma1) for r in got.values())


# ---- heads of files -------------------------------------------------------------------------

class Counted:
    """A store that Spark's workers do not know: reads local bytes and logs how many."""

    log = root = ""

    def __init__(self, uri):
        assert uri.startswith("viewfs://tests/")
        self.path = uri.replace("viewfs://tests", self.root)
        self.file = io.FileIO(self.path)

    def read_at(self, n, offset):
        self.file.seek(offset)
        data = self.file.read(n)
        with open(self.log, "a") as log:
            log.write(f"{self.path} {len(data)}\n")
        return data

    def close(self):
        self.file.close()


def test_heads_read_only_both_ends(spark, tmp_path):
    folder = tmp_path / "files"
    folder.mkdir()
    sizes = {"b.bin": 100, "c.bin": 70_000, "d.bin": 3_000_000}
    for name, n in sizes.items():
        (folder / name).write_bytes(bytes(random.Random(n).randbytes(n)))
    log = str(tmp_path / "log")

    class Store(Counted):
        pass

    Store.log, Store.root = log, str(tmp_path)
    spark._jsc.hadoopConfiguration().set("fs.viewfs.mounttable.tests.link./files", f"file://{folder}")
    heads = {r.path.rsplit("/", 1)[1]: r for r in ma.read_heads(spark, "viewfs://tests/files/*", 1000, opened=Store).collect()}
    read = {}
    for line in open(log):
        path, n = line.split()
        read[path.rsplit("/", 1)[1]] = read.get(path.rsplit("/", 1)[1], 0) + int(n)
    for name, n in sizes.items():
        assert bytes(heads[name].head) == (folder / name).read_bytes()[:1000] and heads[name].size_bytes == n
        assert read.get(name, 0) <= min(n, 1000 + ma.TAIL_BYTES)
    # Without a way to seek there, Spark's reader takes the files as a whole; on the local store they are sought through.
    whole = {r.path.rsplit("/", 1)[1]: bytes(r.head) for r in ma.read_heads(spark, "viewfs://tests/files/*", 1000).collect()}
    plain = {r.path.rsplit("/", 1)[1]: bytes(r.head) for r in ma.read_heads(spark, str(folder / "*"), 1000).collect()}
    assert whole == plain == {k: bytes(v.head) for k, v in heads.items()}


def test_stores_that_cannot_be_opened():
    assert ma.known_store("file:///tmp") and not ma.known_store("nosuch://x/y")


# ---- broadcasts -----------------------------------------------------------------------------

def test_broadcasts_are_measured_by_rows(spark):
    """A table of equal rows is tiny as a file and large in memory."""
    hinted = lambda df: "ResolvedHint" in df._jdf.queryExecution().analyzed().toString()
    assert hinted(bounded(spark.range(100).select(F.lit("x").alias("k"))))
    assert not hinted(bounded(spark.range(2_000_000).select(F.lit("x").alias("k"))))
