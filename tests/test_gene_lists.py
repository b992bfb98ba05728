"""Upstream gene lists of features: no list is gathered, and lists are told apart as multisets."""

from foldwise.operators import normalise as no


def test_no_list_is_written_and_equal_lists_share_a_number(spark, monkeypatch):
    edges = spark.createDataFrame(
        [(1, "a"), (1, "b"), (2, "b"), (2, "a"), (3, "a"), (3, "a"), (3, "b"), (4, None), (None, "c"), (5, "a"), (5, "a")], "feature_id int, gene string")
    expr = spark.createDataFrame([("g", "s", "a", 1.0), ("g", "s", "b", 4.0), ("g", "s", "c", 9.0)], "grp string, sample_id string, gene string, value double")
    seen = []
    monkeypatch.setattr(no, "written", lambda df, keep=no.written: seen.append(df.columns) or keep(df))
    features, values = no.covariate_by_genes(edges, expr, expr.where("gene = 'c'").select("gene"))
    assert seen == [["feature_id", "genes"]]
    r = {row.genes: row.r for row in values.collect()}
    got = {row.feature_id: r.get(row.genes) for row in features.collect()}
    assert got == {1: -6.5, 2: -6.5, 3: -7.0, 4: None, None: 0.0, 5: -8.0}
    number = {row.feature_id: row.genes for row in features.collect()}
    assert number[1] == number[2] and len(set(number.values())) == 5
