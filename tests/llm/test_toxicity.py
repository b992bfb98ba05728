import random
import zlib

import numpy as np
import pytest

from foldwise.llm import shingles, toxicity
from foldwise.llm.registry import QUERIES
from tests.llm.conftest import odd_documents, prose


def key(word):
    return shingles.word_hashes([word.encode()])[0]


def lexicon(*words, weight=4.0):
    return toxicity.Lexicon(np.concatenate([key(w) for w in words]), np.full(len(words), weight))


def measured(text, lex=None):
    return dict(zip(toxicity.NAMES, toxicity.features([text.encode()], lex or lexicon("idiot", "fool"))[0], strict=True))


def test_features():
    x = measured("You IDIOT, what a fool!! calm words follow here and here and here")
    assert x["hit_density"] == pytest.approx(2 / 13) and x["weight_density"] == pytest.approx(8 / 13)
    assert x["near_share"] == 1.0 and x["second_person"] == pytest.approx(1 / 13)
    assert x["shouted_words"] == pytest.approx(1 / 13) and x["mark_runs"] == pytest.approx(1 / 13) and x["masked"] == 0
    far = measured("you " + "calm " * 9 + "idiot")
    assert far["near_share"] == 0 and far["hit_density"] > 0
    for masked in ("1d1ot", "id10t", "i.d.i.o.t", "id!ot", "i-d-i-o-t"):
        x = measured(f"such an {masked} is this")
        assert x["log_unmasked"] == pytest.approx(np.log(2)), masked
        assert x["masked"] > 0 and x["log_hits"] == 0
    assert measured("nooooo")["elongated"] == 3 and measured("")["log_words"] == 0


def test_beginnings_of_words():
    found = next(toxicity.tokens([b"Stupidity stupid stup"]))
    assert shingles.mix(np.uint64([int.from_bytes(b"stupi", "big") + (5 << 56)]))[0] in found
    stem = toxicity.Lexicon(shingles.mix(np.uint64([int.from_bytes(b"stupi", "big") + (5 << 56)])), np.array([2.0]))
    assert measured("Stupidity stupid stupi stup", stem)["hit_density"] == 0.5  # a beginning is shorter than its word


def test_text_in_pieces(monkeypatch):
    text = prose(5, 3000).replace("a", "A", 40) + " idiot you fool!! " + prose(6, 2000)
    whole = measured(text)
    monkeypatch.setattr(toxicity, "PIECE_BYTES", 1000)
    assert measured(text) == pytest.approx(whole)
    together = toxicity.features([b"", text.encode(), b"idiot", text.encode()], lexicon("idiot", "fool"))
    assert together[1] == pytest.approx(together[3]) and list(together[1]) == pytest.approx(list(whole.values()))


def test_isotonic_is_the_best_ascending_fit():
    r = np.random.default_rng(4)
    x, w = np.round(r.random(60), 1), r.random(60) + 0.1
    y = (r.random(60) < x).astype(float)
    at, share = toxicity.isotonic(x, y, w)
    assert (np.diff(at) >= 0).all() and (np.diff(share) >= 0).all()
    # Greatest lower slopes of the cumulative sums: the same fit by its min-max formula.
    order = np.unique(x)
    mean = lambda a, b: np.average(y[(x >= a) & (x <= b)], weights=w[(x >= a) & (x <= b)])
    want = [max(min(mean(a, b) for b in order if b >= v) for a in order if a <= v) for v in order]
    assert np.interp(order, at, share) == pytest.approx(want)


def test_trees_learn_an_interaction():
    r = np.random.default_rng(1)
    x = r.random((1500, 3))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.3)).astype(float)
    trees = toxicity.boost(x, y, np.ones(len(y)))
    assert np.mean((trees.raw(x) > 0) == y) > 0.97
    flat = toxicity.boost(np.zeros((10, 2)), np.array([1.0] * 3 + [0] * 7), np.ones(10))
    assert 1 / (1 + np.exp(-flat.raw(np.zeros((1, 2)))[0])) == pytest.approx(0.3, abs=0.01)


def held_out_quality(spark, sf_dir):
    toxic = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    rows = QUERIES["op13_toxicity"](spark, sf_dir).collect()
    n = spark.read.parquet(f"{sf_dir}/documents.parquet").count()
    assert len(rows) == n
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in rows)
    held = [(r.predicted, toxic[r.doc_id], r.score) for r in rows if r.held_out and toxic.get(r.doc_id) is not None]
    found = [p for p, t, _ in held if t]
    clean = [p for p, t, _ in held if not t]
    return np.mean(found), np.mean(clean), held


def test_held_out_quality(spark):
    """On tables with some hundred toxic texts to learn from."""
    caught, wrong, held = held_out_quality(spark, "/root/testdata/sf0.1")
    assert caught >= 0.9 and wrong <= 0.02, (caught, wrong)


def test_labels_of_held_out_rows_are_not_read(spark):
    r = random.Random(2)
    rows = [(i, prose(i, 40) + (" you idiot" if i % 3 == 0 else ""), int(i % 3 == 0)) for i in range(300)]
    held = [zlib.crc32(str(i).encode()) % 4 == 2 for i, _, _ in rows]
    flipped = [(i, t, r.randrange(2) if h else y) for (i, t, y), h in zip(rows, held, strict=True)]
    scores = []
    for some in (rows, flipped):
        df = spark.createDataFrame([x for x, h in zip(some, held, strict=True) if not h], "doc_id long, text string, toxic int")
        model = toxicity.train(df.select("doc_id", "text"), df.select("doc_id", "toxic"))
        scores.append(model.scores([t.encode() for _, t, _ in rows]))
    assert (scores[0] == scores[1]).all()
    assert np.mean((scores[0] >= 0.3) == [y for _, _, y in rows]) > 0.95


def test_odd_rows(odd, empty, spark):
    labels = spark.createDataFrame([(0, 0), (3, 1), (5, 1), (7, 0), (8, 0), (9, None), (None, 1), (14, 1), (14, 0)], "doc_id long, toxic int")
    model = toxicity.train(odd, labels)
    got = toxicity.scored(odd, model).collect()
    assert len(got) == len(odd_documents()) and all(0 <= r.score <= 1 for r in got)
    by = {}
    for r in got:
        by.setdefault(r.row.doc_id, []).append(r.score)
    assert by[0] == by[1]  # null as empty
    assert toxicity.scored(empty, model).count() == 0
    assert toxicity.train(odd, labels.where("false")) == 0.0
    assert toxicity.train(odd, labels.where("toxic = 1")) == 1.0
    assert toxicity.train(empty, labels) == 0.0
    assert {r.score for r in toxicity.scored(odd, 1.0).collect()} == {1.0}
