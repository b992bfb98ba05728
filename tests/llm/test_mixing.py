import pytest

import corpus_pipeline
from foldwise.llm import mixing
from foldwise.llm.registry import QUERIES
from tests.llm.conftest import CLASHING


def test_raking_meets_all_margins(spark):
    import itertools

    rows = [(s, l, t, float(100 + 37 * i % 211)) for i, (s, l, t) in enumerate(itertools.product("abc", ["en", "de", None], ["x", "y"]))]
    cells = spark.createDataFrame(rows, "source string, lang string, topic string, tokens double")
    table = mixing.raked(mixing.power_targets(cells, power=0.5), rounds=16).collect()
    assert len(table) == len(rows)
    for m in mixing.MARGINS:
        for value in {r[m] for r in table}:
            part = [r for r in table if r[m] == value]
            assert sum(r.fitted for r in part) == pytest.approx(part[0][f"target_{m}"], rel=1e-4)
    assert sum(r.fitted for r in table) == pytest.approx(sum(r[3] for r in rows))


def test_share_taken(spark):
    df = spark.range(4000).selectExpr("id AS doc_id", "concat('text number ', id) AS text", "if(id % 10 < 9, 'big', 'small') AS source", "'en' AS lang")
    found = mixing.weighted(df, power=0.5)
    rows = found.collect()
    big = [r for r in rows if r.source == "big"]
    assert 0 < big[0].weight < 1 and next(r for r in rows if r.source == "small").weight > 1
    assert sum(r.kept for r in big) / len(big) == pytest.approx(big[0].weight, abs=0.03)
    assert all(r.kept for r in rows if r.source == "small")
    taken = {r.doc_id for r in mixing.sampled(df, power=0.5).collect()}
    assert taken == {r.id for r in rows if r.kept}


def test_odd_rows(odd, empty):
    rows = mixing.weighted(odd).collect()
    assert len(rows) == odd.count() and all(r.weight > 0 and r.n_tokens is not None for r in rows)
    out = mixing.sampled(odd)
    assert out.columns == odd.columns and out.count() == sum(r.kept for r in rows)
    assert all([r[c] for c in CLASHING] == list(range(len(CLASHING))) for r in out.collect())
    assert mixing.weighted(empty).count() == 0 and mixing.sampled(empty).count() == 0


def test_tokens_taken_follow_the_targets(spark):
    """At the stage's defaults; a source of one percent beside two of about half is to get 1.47 percent."""
    df = spark.range(20_000).selectExpr(
        "id AS doc_id", "concat('text number ', id) AS text", "CASE WHEN id % 100 = 0 THEN 'rare' WHEN id % 2 = 0 THEN 'a' ELSE 'b' END AS source",
        "if(id % 8 = 3, 'es', 'en') AS lang")
    out = corpus_pipeline.mix(spark, df, "")
    assert out.columns == df.columns
    rows, total = out.collect(), df.count()
    for m in ("source", "lang"):
        shares = {r[0]: r[1] / total for r in df.groupBy(m).count().collect()}
        whole = sum(x**mixing.POWER for x in shares.values())
        for value, share in shares.items():
            assert sum(r[m] == value for r in rows) / len(rows) == pytest.approx(share**mixing.POWER / whole, abs=0.003), value
    once = {r.id for r in mixing.weighted(df).where("kept").collect()}
    assert {r.doc_id for r in rows} == once and len(rows) > len(once)


def test_rounds_until_the_margins_are_met(spark):
    rows = [("a", "en", "x", 1000.0), ("a", "de", "x", 1.0), ("b", "en", "x", 10.0), ("b", "de", "x", 400.0), ("c", "de", "y", 5.0), ("c", "en", "y", 5.0), ("a", "en", "y", 20.0)]
    cells = spark.createDataFrame(rows, "source string, lang string, topic string, tokens double")
    table = mixing.raked(mixing.power_targets(cells, power=0.5)).collect()
    for m in mixing.MARGINS:
        for value in {r[m] for r in table}:
            part = [r for r in table if r[m] == value]
            assert sum(r.fitted for r in part) == pytest.approx(part[0][f"target_{m}"], rel=1e-4)


def test_targets_that_cannot_be_met(spark):
    """Raking ends, and says so."""
    cells = spark.createDataFrame([("a", "en", "x", 900.0), ("b", "de", "x", 100.0)], "source string, lang string, topic string, tokens double")
    cells = cells.selectExpr("*", "tokens AS target_source", "500D AS target_lang", "1000D AS target_topic")
    with pytest.warns(UserWarning, match="cannot meet"):
        assert mixing.raked(cells).count() == 2


def test_query_meets_its_targets(spark):
    """The tokens of all copies that the query gives, by source and language, beside their targets at the default parameters."""
    rows = QUERIES["op8_mixing"](spark, "/root/testdata/sf0.1").collect()
    total, taken = sum(r.n_tokens for r in rows), sum(r.n_tokens * r.copies for r in rows)
    assert all(r.kept == (r.copies > 0) for r in rows) and max(r.copies for r in rows) > 1
    for m in ("lang", "topic"):
        values = {r[m] for r in rows}
        share = {v: sum(r.n_tokens for r in rows if r[m] == v) / total for v in values}
        whole = sum(x**mixing.POWER for x in share.values())
        for v in values:
            got = sum(r.n_tokens * r.copies for r in rows if r[m] == v) / taken
            assert got == pytest.approx(share[v] ** mixing.POWER / whole, abs=0.01), (m, v)
