import numpy as np
import pytest

from foldwise.llm import quality_model, quality_rules
from tests.llm.conftest import CLASHING, prose


def repeated(words):
    """Words inside 3-word windows that occur twice or more."""
    windows = {}
    for k in range(len(words) - 2):
        windows.setdefault(tuple(words[k : k + 3]), []).append(k)
    return len({k + j for at in windows.values() if len(at) > 1 for k in at for j in range(3)})


def test_repeated_words(spark):
    texts = ["", "a", "a b", "a b c", "a a a a", "a b a b a b", "x y z q x y z", "a b c a b c a b c d e f", prose(1, 3000, 2), prose(2, 500) + " " + prose(2, 500), "w " * 5000]
    df = spark.createDataFrame([(k, t.split()) for k, t in enumerate(texts)], "k int, w array<string>")
    got = {r.k: r.n for r in quality_rules.repeated_words(df, "w", "n").select("k", "n").collect()}
    assert got == {k: repeated(t.split()) for k, t in enumerate(texts)}


def test_order_by_rejection_per_cost(spark):
    df = spark.createDataFrame([(prose(k, 80) + (" ###" * 40 if k % 2 else ""),) for k in range(60)], "text string")
    order = [r.name for r in quality_rules.order_by_worth(df, quality_rules.BASE_RULES + quality_rules.MORE_RULES)]
    assert order[0] == "symbols" and sorted(order) == sorted(r.name for r in quality_rules.BASE_RULES + quality_rules.MORE_RULES)
    a = quality_rules.cascade(df, quality_rules.MORE_RULES).where("rejected_by IS NULL").count()
    b = quality_rules.cascade(df, quality_rules.MORE_RULES[::-1]).where("rejected_by IS NULL").count()
    assert a == b == 30


def test_order_counts_what_is_left(spark, monkeypatch):
    """A rule whose rows another one rejects already comes late, and shared work is paid for once."""
    rules = [quality_rules.Rule(n, needs, "false") for n, needs in (("a", ("n_words",)), ("b", ("n_words", "n_symbols")), ("c", ("n_words", "n_bangs")), ("d", ("n_words", "word_chars")))]
    cost = {quality_rules.MEASURES[m]: s for m, s in (("n_words", 1.0), ("n_symbols", 0.5), ("n_bangs", 0.4))}
    left = {(False, True, True, False): 50, (False, True, False, False): 10, (True, False, False, True): 9, (False, False, False, False): 100}
    monkeypatch.setattr(quality_rules, "_costs", lambda *a: cost)
    monkeypatch.setattr(quality_rules, "_rejections", lambda *a: left)
    df = spark.createDataFrame([("x",)], "text string")
    assert [r.name for r in quality_rules.order_by_worth(df, rules)] == ["b", "a", "d", "c"]


def test_columns_named_like_measures(spark):
    """A caller's columns keep their values and do not stand for measures."""
    df = spark.createDataFrame([(1, prose(1, 80), 9999, 7), (2, prose(2, 80) + " ###" * 40, 0, 8)], "doc_id int, text string, n_symbols int, n_words int")
    rows = {r.doc_id: r for r in quality_rules.cascade(df, quality_rules.MORE_RULES).collect()}
    assert rows[1].rejected_by is None and rows[2].rejected_by == "symbols"
    assert (rows[1].n_symbols, rows[1].n_words, rows[2].n_symbols) == (9999, 7, 0)


def test_rules_odd_rows(odd, empty):
    kept = quality_rules.keep_good(odd)
    assert kept.columns == odd.columns
    rows = kept.collect()
    assert sorted((r.doc_id for r in rows), key=repr) == sorted([7, 7, 7, None, None, 8, 9, 10, 11, 12], key=repr)
    assert all([r[c] for c in CLASHING] == list(range(len(CLASHING))) for r in rows)
    assert quality_rules.keep_good(empty).count() == 0
    measured = {r.doc_id: r for r in quality_rules.base_measures(odd.select("doc_id", "text")).collect()}
    assert measured[0].n_words == 0 and measured[0].base_failed and measured[14].n_repeat_words == 150 and measured[13].n_symbols == 360


def labelled(n):
    out = []
    for k in range(n):
        text = prose(1000 + k, 40 + k % 60)
        grade = k % 3
        if grade == 0:
            text += " you utter fool and rotten clown"
        if grade == 1:
            text = text.replace(" ", "%% ")
        out.append((k, text, grade))
    return out


def test_grades_with_long_texts_only(spark):
    """A byte bound leaves out long texts only where there are shorter ones of their grade."""
    rows = [(k, prose(k, 40), 2) for k in range(30)] + [(100 + k, "bad worse worst " * 9000 + str(k), 1) for k in range(4)]
    df = spark.createDataFrame(rows, "doc_id long, text string, grade int")
    model = quality_model.train(df.select("doc_id", "text"), df.select("doc_id", "grade"))
    assert model is not None and model.tails([b"bad worse worst " * 30])[0][1] < model.tails([prose(50, 40).encode()])[0][1]


def test_likelihood_slopes(spark):
    """The fitted weights and thresholds are where the penalised likelihood has no slope, by finite differences."""
    texts = [t.encode() for _, t, _ in labelled(60)]
    grades = [g for _, _, g in labelled(60)]
    decay = 1e-2
    model = quality_model.fit(texts, grades, rounds=6000, step=0.01, decay=decay)
    sets = list(quality_model.features(texts))
    values = [quality_model._values(s) for s in sets]
    # Features that the fit leaves out have no weight.
    used = np.flatnonzero(model.weights)
    y = np.array(grades)
    share = 1 / (3 * np.bincount(y)[y])

    def loss(w, cuts):
        score = np.array([w[s] @ v for s, v in zip(sets, values, strict=True)])
        edges = np.concatenate(([-np.inf], cuts, [np.inf]))
        up, low = 1 / (1 + np.exp(-(edges[y + 1] - score))), 1 / (1 + np.exp(-(edges[y] - score)))
        return -(share * np.log(up - low)).sum() + decay / 2 * (w**2).sum()

    w = model.weights.astype(float)
    here = loss(w, model.cuts)
    for k in used[:: max(1, len(used) // 12)]:
        for step in (0.05, -0.05):
            moved = w.copy()
            moved[k] += step
            assert loss(moved, model.cuts) >= here - 1e-6
    for k in range(2):
        for step in (0.05, -0.05):
            cuts = model.cuts.copy()
            cuts[k] += step
            assert loss(w, cuts) >= here - 1e-6


def test_grades_follow_the_labels(spark):
    data = labelled(420)
    df = spark.createDataFrame(data, "doc_id long, text string, grade int")
    model = quality_model.train(df.where("doc_id < 300").select("doc_id", "text"), df.where("doc_id < 300").select("doc_id", "grade"))
    assert (np.diff(model.cuts) > 0).all()
    got = {r.row.doc_id: r for r in quality_model.graded(df.where("doc_id >= 300").select("doc_id", "text"), model).collect()}
    hit = [round(got[k].expected_grade) == g for k, _, g in data if k >= 300]
    assert np.mean(hit) > 0.95
    assert all(r.tail[0] >= r.tail[1] and r.expected_grade == pytest.approx(sum(r.tail)) for r in got.values())


def test_model_odd_rows(odd, empty, spark):
    model = quality_model.train(spark.createDataFrame([(1, "good text here"), (2, "bad bad"), (3, None)], "doc_id long, text string"), spark.createDataFrame([(1, 2), (2, 0), (2, 1), (None, 1), (3, None)], "doc_id long, grade int"))
    rows = quality_model.graded(odd, model).collect()
    assert len(rows) == odd.count() and all(0 <= r.expected_grade <= 2 for r in rows)
    assert quality_model.graded(empty, model).count() == 0
    assert quality_model.train(empty.select("doc_id", "text"), spark.createDataFrame([], "doc_id long, grade int")) is None
    assert {r.expected_grade for r in quality_model.graded(odd, None).collect()} == {1.0}


def test_held_out_labels(spark):
    """Toxic documents are caught, good ones stay."""
    sf = "/root/testdata/sf0.1"
    documents = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf}/labels.parquet").withColumn("grade", quality_model.grade_of())
    model = quality_model.train(documents, labels.where("doc_id % 3 <> 0"))
    rows = quality_model.graded(documents, model).selectExpr("row.doc_id", f"tail[1] >= {quality_model.KEEP_TAIL} AS kept").join(labels.where("doc_id % 3 = 0"), "doc_id").collect()
    good = [r.kept for r in rows if r.grade == 2]
    rest = [r.kept for r in rows if r.grade < 2]
    assert np.mean(good) > 0.93 and np.mean(rest) < 0.2
