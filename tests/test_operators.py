"""Operators on small hand-made frames: ties, gaps, skew and brute-force checks."""

import itertools
from collections import Counter

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from foldwise.operators import corrections as co
from foldwise.operators import diagnostics as di
from foldwise.operators import enrichment as en
from foldwise.operators import joins as jo
from foldwise.operators import ordering as od
from foldwise.operators import reshape as rs
from foldwise.operators import sampling as sa
from foldwise.operators import stats as st
from foldwise.operators import summaries as su
from foldwise.sources import manifest as ma
from foldwise.sources import tables as ta


def rows(df, *order):
    return [tuple(r) for r in (df.orderBy(*order) if order else df).collect()]


@pytest.fixture
def skewed(spark):
    """One group holds most rows, and one value most of that group."""
    rng = np.random.default_rng(0)
    data = [("hot", float(v), k) for k, v in enumerate(np.where(rng.random(500) < 0.4, 0.0, rng.normal(size=500).round(1)))]
    data += [(f"g{k % 7}", float(rng.normal()), 1000 + k) for k in range(60)]
    return spark.createDataFrame(data, "g string, v double, id long")


class TestOrdering:
    def test_ranks(self, skewed):
        order = [F.col("v"), F.col("id")]
        small = rows(od.ranked(skewed, ["g"], order, "r", fits=True), "id")
        assert rows(od.ranked(skewed, ["g"], order, "r", fits=False).select("g", "v", "id", "r"), "id") == small

    def test_ranks_without_groups(self, skewed):
        wide = od.ranked(skewed, [], [F.col("v").desc(), F.col("id")], "r", fits=False).orderBy("r").collect()
        assert [r.r for r in wide] == list(range(1, 561))
        assert [(-r.v, r.id) for r in wide] == sorted((-r.v, r.id) for r in wide)

    @pytest.mark.parametrize("how, reverse", [("sum", False), ("min", True), ("max", False), ("sum", True)])
    def test_running(self, spark, skewed, tiny_groups, how, reverse):
        ranked = od.ranked(skewed, ["g"], [F.col("v"), F.col("id")], "r", fits=True)
        got = [rows(od.running(ranked, ["g"], "r", F.col("id") * 1.0, "x", how, reverse, fits).select("id", "x"), "id") for fits in (True, False)]
        assert got[0] == got[1]

    def test_percentiles(self, skewed):
        probs = {"a": 0.05, "b": 0.5, "c": 0.77}
        got = {r.g: (r.a, r.b, r.c) for r in od.group_percentiles(skewed, ["g"], "v", probs, fits=False).collect()}
        frame = skewed.toPandas()
        for g, part in frame.groupby("g"):
            assert got[g] == pytest.approx(tuple(np.quantile(part["v"], list(probs.values()))))

    def test_average_ranks(self, skewed):
        got = [rows(od.average_ranks(skewed, ["g"], "v", "r", fits).select("id", "r"), "id") for fits in (True, False)]
        assert got[0] == got[1]


def test_step_up_with_effective_tests(spark):
    p = [0.01, 0.02, 0.02, 0.5, 1.0]
    df = spark.createDataFrame([("c", k, v) for k, v in enumerate(p)], "c string, set_id int, p double")
    got = [r.adj_p for r in en.bh_adjust(df, ["c"], "p", m_eff=3).orderBy("set_id").collect()]
    raw = [v * 3 / (k + 1) for k, v in enumerate(p)]
    assert got == pytest.approx([min(1, min(raw[k:])) for k in range(5)])


def test_enrichment_by_hand(spark):
    lfc = spark.createDataFrame([("x", k, float(k)) for k in range(40)], "cmp string, feature_id int, lfc double")
    classes = en.classify_sites(lfc, ["cmp"], 10.0)
    assert sorted(r.feature_id for r in classes.where("class = 'up'").collect()) == [36, 37, 38, 39]
    members = spark.createDataFrame([(f, "s") for f in (0, 1, 37, 38, 39)] + [(5, "none")], "feature_id int, set_id string")
    got = {r.set_id: r for r in en.enrich(classes, members, ["cmp"]).collect()}
    assert (got["s"].a_up, got["s"].a_down, got["s"].c, got["s"].direction) == (3, 2, 0, "+")
    assert got["s"].lff == pytest.approx(np.log2((3.5 / 5) / (0.5 / 33)))
    assert got["none"].p == 1.0


def test_threshold_classes(spark):
    lfc = spark.createDataFrame([("x", k, v) for k, v in enumerate([2.0, 1.0, 0.0, -1.0])], "c string, feature_id int, lfc double")
    assert [r["class"] for r in en.classify_by_threshold(lfc, ["c"], 1.0).orderBy("feature_id").collect()] == ["up", "up", "bg", "down"]


def test_bag_join_pairs_in_order(spark):
    left = spark.createDataFrame([("a", 1), ("a", 2), ("a", 3), ("b", 4)], "k string, o int")
    right = spark.createDataFrame([("a", 9), ("a", 7), ("b", 1), ("c", 2)], "k string, o int")
    pairs, missing, unused = jo.bag_join(left, right, ["k"], ["o"])
    assert rows(pairs.select("k", "o", "right_o"), "k", "o") == [("a", 1, 7), ("a", 2, 9), ("b", 4, 1)]
    assert rows(missing.select("k", "o")) == [("a", 3)] and rows(unused.select("k", "o")) == [("c", 2)]


def test_hot_features_in_set_overlaps(spark, monkeypatch):
    rng = np.random.default_rng(1)
    pairs = {(int(f), int(s)) for f, s in zip(rng.integers(0, 30, 400), rng.integers(0, 25, 400))} | {(99, s) for s in range(25)}
    members = spark.createDataFrame(sorted(pairs), "feature_id int, set_id int")
    sets = {s: {f for f, t in pairs if t == s} for s in range(25)}
    want = {(a, b): len(sets[a] & sets[b]) for a, b in itertools.combinations(range(25), 2) if sets[a] & sets[b]}
    for limit in (200, 3):
        monkeypatch.setattr(jo, "SALT_SETS", limit)
        assert {(r.set_a, r.set_b): r.shared for r in jo.set_overlaps(members).collect()} == want


def test_effective_number_of_sets(spark):
    members = spark.createDataFrame([(1, "a"), (2, "a"), (1, "b"), (2, "b"), (3, "c")], "feature_id int, set_id string")
    assert co.m_eff(members) == 2  # a and b are one set
    apart = spark.createDataFrame([(k, str(k)) for k in range(5)], "feature_id int, set_id string")
    assert co.m_eff(apart) == 5


def test_permutation_sides_have_exact_sizes(spark):
    lfc = spark.createDataFrame([("x", k, float(k)) for k in range(300)], "c string, feature_id int, lfc double")
    sides = co.permuted_sides(en.classify_sites(lfc, ["c"], 5.0), ["c"], 600, 1)
    rows = sides.collect()
    sizes = Counter((r.perm, r.down) for r in rows)
    assert len(sizes) == 1200 and set(sizes.values()) == {15}
    assert len({(r.perm, r.number) for r in rows}) == 600 * 30 and {r.number for r in rows} <= set(range(300))
    # Each feature is drawn about as often, and pairs are not tied to each other.
    often = Counter(r.number for r in rows)
    assert sum((often[k] - 60) ** 2 / 60 for k in range(300)) < 400
    by = {}
    for r in rows:
        by.setdefault(r.perm, set()).add(r.number)
    together = sum(k + 1 in v for v in by.values() for k in v)
    assert together == pytest.approx(600 * 30 * 29 / 299, rel=0.1)


def test_higher_criticism_skips_certain_p(spark):
    df = spark.createDataFrame([("a", k, p) for k, p in enumerate([0.0, 0.01, 0.2, 0.9])] + [("b", k, 1.0) for k in range(3)], "c string, set_id int, p double")
    got = {r.c: r for r in su.higher_criticism(df, ["c"], "p").collect()}
    assert got["a"].hc == pytest.approx(2 * (0.5 - 0.01) / np.sqrt(0.01 * 0.99)) and got["a"].hc_index == 2
    assert got["b"].hc is None and got["b"].hc_index == 1


def test_concentration_of_nothing(spark):
    df = spark.createDataFrame([("a", k, 0.0) for k in range(3)], "c string, set_id int, e double")
    assert su.gini(df, ["c"], "e").first().gini is None
    assert [r.x for r in su.lorenz(df, ["c"], "e").orderBy("point").collect()] == [0.0, 0.5, 1.0]


def test_prefix_match(spark):
    names = {"Foo": "A", "Foo-3": "B", "Bar": "C"}
    df = spark.createDataFrame([("Foo14",), ("Foo-31",), ("Foo-3",), ("Bar",), ("Zed77",), ("9",)], "l string")
    got = rows(df.select("l", rs.match_prefix(F.col("l"), names).alias("m")).select("l", "m.*"))
    assert got == [("Foo14", "A", "Foo", 14, True), ("Foo-31", "B", "Foo-3", 1, True), ("Foo-3", "B", "Foo-3", 0, True), ("Bar", "C", "Bar", 0, True),
                   ("Zed77", "Other", "Zed", 77, False), ("9", "Other", "9", 0, False)]


def test_bad_sample_id_fails(spark):
    df = spark.createDataFrame([("a_b",)], "s string").select(rs.parse_sample_id(F.col("s")).alias("p"))
    with pytest.raises(PySparkException):
        df.collect()


def test_longest_condition_wins_when_parsing(spark):
    df = spark.createDataFrame([("g_t1_C_vs_g_t1_T12_pct2.5",)], "s string")
    got = df.select(rs.parse_comparison(F.col("s"), ["g"], ["t1"], ["T1", "T12"]).alias("k")).select("k.*").first()
    assert tuple(got) == ("g", "t1", "T12", 2.5)


def test_correlation_of_a_constant(spark):
    df = spark.createDataFrame([(float(k), 1.0) for k in range(5)], "x double, y double").withColumn("g", F.lit(1))
    got = st.correlations(df, ["g"], "x", "y").first()
    assert got.pearson is None and got.spearman is None
    assert df.agg(st.safe_corr("x", "y")).first()[0] == 0.0


def test_location_tests(spark):
    d = [0.3, -0.1, 0.5, 0.9, -0.2, 0.7, 0.0]
    got = st.mean_tests(spark.createDataFrame([(v,) for v in d], "d double"), [], "d").first()
    assert got.t == pytest.approx(np.mean(d) / (np.std(d, ddof=1) / np.sqrt(7)))
    assert got.w == 3.0 and got.w_p == pytest.approx(0.15625)


def test_sample_components(spark):
    rng = np.random.default_rng(2)
    table = rng.normal(size=(40, 5))
    names = [f"s{k}" for k in range(5)]
    df = spark.createDataFrame([(f, names[s], float(table[f, s])) for f in range(40) for s in range(5)], "feature_id int, sample_id string, residual double")
    got = di.sample_pca(df, names, "residual", 2).toPandas().pivot(index="sample_id", columns="component", values="score").to_numpy()
    u, s, _ = np.linalg.svd((table - table.mean(axis=1, keepdims=True)).T, full_matrices=False)
    assert np.abs(got) == pytest.approx(np.abs(u[:, :2] * s[:2]), abs=1e-9)


def test_permutation_stays_in_blocks(spark):
    df = spark.createDataFrame([(f"s{k}", k // 4, "abcd"[k % 4]) for k in range(12)], "sample_id string, block int, condition string")
    got = sa.restricted_permutation(df, ["block"], "condition", 3).collect()
    for b in range(3):
        assert sorted(r.condition for r in got if r.block == b) == list("abcd")


def test_pages_are_near_equal(spark):
    got = sa.paginate(spark.range(10), 4, [F.col("id")]).orderBy("id").collect()
    assert [r.page for r in got] == [k + 1 for k, part in enumerate(np.array_split(range(10), 4)) for _ in part]


def test_unique_names(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b"), (3, "a"), (4, "a")], "position int, name string")
    assert rows(ta.unique_names(df, "name", "position"), "position") == [(1, "a"), (2, "b"), (3, "a.1"), (4, "a.2")]


def test_cache_starts_empty(spark, tmp_path):
    path = str(tmp_path / "cache")
    assert ta.read_cache(spark, path) is None
    ta.write_table(ta.upsert_cache(None, spark.createDataFrame([(1, "x")], "k int, v string"), ["k"]), path)
    new = spark.createDataFrame([(1, "y"), (2, "z")], "k int, v string")
    assert rows(ta.upsert_cache(ta.read_cache(spark, path), new, ["k"]), "k") == [(1, "y"), (2, "z")]


def test_partitions_are_replaced_one_by_one(spark, tmp_path):
    path = str(tmp_path / "out")
    ta.write_table(spark.createDataFrame([("a", 1), ("b", 2)], "g string, v int"), path, partition_by=["g"])
    ta.write_table(spark.createDataFrame([("b", 3)], "g string, v int"), path, partition_by=["g"])
    assert rows(spark.read.parquet(path).select("g", "v"), "g") == [("a", 1), ("b", 3)]


def test_manifest_of_real_files(spark, tmp_path):
    folder = tmp_path / "x_cortex"
    folder.mkdir()
    (folder / "total_XIC.sne").write_bytes("Report PG. ab1234567_LD_M6_WT_pool.raw x 99_LD_no.raw ab1234567_LD_M6_WT_pool.raw".encode("utf-16le") + b"\x00\xd8")
    import zipfile

    with zipfile.ZipFile(folder / "plain.sne", "w") as z:
        z.writestr("a", "b")
    got = {r.path.rsplit("/", 1)[1]: r for r in ma.file_manifest(ma.read_heads(spark, str(tmp_path / "*/*.sne"))).collect()}
    first = got["total_XIC.sne"]
    assert first.runs == ["234567_LD_M6_WT_pool.raw"] and first.ages == ["M6"] and first.pooled_runs and first.xic_variant
    assert (first.modality, first.tissue, first.field_terms, first.zip_container) == ("pr", "cortex", ["Report", "PG."], False)
    assert got["plain.sne"].zip_container and got["plain.sne"].run_count == 0


def test_fractions_must_be_positive(spark):
    df = spark.createDataFrame([("s", "a", 0.0), ("s", "b", 0.0)], "sample_id string, grp string, v double")
    with pytest.raises(PySparkException):
        rs.renormalise(df, ["sample_id"], "v").collect()
