import zlib

import numpy as np

from foldwise.llm import language
from foldwise.llm.registry import QUERIES
from tests.llm.conftest import odd_documents


def test_codewords_are_apart():
    for n in (1, 2, 4, 9, 30):
        code = language.codewords(n)
        assert code.shape[0] == n and set(np.unique(code)) <= {-1, 1}
        if n > 1:
            differ = (code[:, None, :] != code[None]).sum(axis=2) + 99 * np.eye(n)
            assert differ.min() >= code.shape[1] // 4
            assert (np.abs(code.sum(axis=0)) < n).all()


def test_held_out_accuracy(spark, sf_dir):
    truth = {r.doc_id: r for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = QUERIES["op5_language_id"](spark, sf_dir).collect()
    assert sorted(r.doc_id for r in rows) == sorted(truth)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 for r in rows)
    held = [r for r in rows if r.held_out and truth[r.doc_id].lang]
    assert np.mean([r.lang_pred == truth[r.doc_id].lang for r in held]) >= 0.95


def test_odd_rows(odd, empty, spark):
    model = language.train(spark.createDataFrame([("the and of to in that was " * 9, "en"), ("der die und nicht ein das " * 9, "de"), (None, "fr"), ("x", None)], "text string, lang string"))
    assert model.languages == ["de", "en"]
    got = language.identified(odd, model).collect()
    assert len(got) == len(odd_documents())
    by = {}
    for r in got:
        by.setdefault(r.row.doc_id, []).append((r.lang_pred, r.score, r.ambiguous))
    for i in (0, 1, 2, 13, 16):  # null, empty, blank, symbols, pictures
        assert by[i] == [("und", 0.0, False)]
    assert by[3][0][0] in ("de", "en") and len(set(by[7])) == 2
    assert language.identified(empty, model).count() == 0
    assert {r.lang_pred for r in language.identified(odd, language.train(odd.where("false"))).collect()} == {"und"}


def test_model_uses_bits(spark):
    """A flipped bit is put right by the other bits."""
    texts = {"a": "bada gada dada ", "b": "lolo momo nono ", "c": "tiri siri piri ", "d": "zezu kezu vezu "}
    model = language.fit([t.encode() * 5 for t in texts.values() for _ in range(3)], [k for k in texts for _ in range(3)])
    for bit in range(0, len(model.bias), 4):
        model.weights[:, bit] *= -1
        model.bias[bit] *= -1
        assert model.predict([t.encode() for t in texts.values()])[0] == list(texts)
        model.weights[:, bit] *= -1
        model.bias[bit] *= -1
    assert model.predict([b"bada lolo " * 4])[2].dtype == bool


def test_languages_with_long_texts_only(spark):
    """A byte bound leaves out long texts only where there are shorter ones, and no language is without a text."""
    rows = [("the and of to in that was " * 9 + str(k), "en") for k in range(40)] + [("los que para una con por del " * 3000 + str(k), "es") for k in range(3)]
    rows += [("the and " * 9000, "en"), ("der die und nicht ein das", "de")]
    df = spark.createDataFrame(rows, "text string, lang string")
    assert all(len(t) > language.TRAIN_BYTES for t, name in rows if name == "es")
    model = language.train(df)
    assert model.languages == ["de", "en", "es"]
    assert model.predict([b"los que para una con por del", b"der die und nicht ein das"])[0] == ["es", "de"]
    assert language.train(df, train_texts=1).languages == ["de", "en", "es"]
