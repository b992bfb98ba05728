"""The stages, each against plain Python on what its predecessor kept."""

import numpy as np
from tokenizers import Tokenizer

import corpus_pipeline
from foldwise.llm import bpe
from foldwise.llm.common import materialise
from foldwise.llm.registry import ORACLE
from tests.llm.test_ngram_join import brute


def test_stages(spark, sf_dir, db):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "line_dedup", "ngram_jaccard_join", "mixing", "bpe"]
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet")
    kept, docs = {}, documents
    for name, stage in corpus_pipeline.STAGES:
        docs = materialise(stage(spark, docs, sf_dir))
        if name != "bpe":
            assert docs.columns == documents.columns
        kept[name] = {r.doc_id: r for r in docs.collect()}
    good = {r[0] for r in db.execute(f"SELECT doc_id FROM ({ORACLE['op10_quality_rules']}) WHERE kept").fetchall()}
    assert set(kept["quality_rules"]) == good

    seen, want = set(), {}
    for i in sorted(good):  # exact repeats at least go; the rest of the line's work is held against SQL elsewhere
        lines = kept["quality_rules"][i].text.split("\n")
        left = [x for x in lines if len(x.strip().split(" ")) < 5 or x.strip() not in seen]
        seen.update(x.strip() for x in lines)
        want[i] = left
    for i, r in kept["line_dedup"].items():
        mine = r.text.split("\n")
        assert r.n_chars == len(r.text) and len(mine) <= len(want[i]) and [x for x in want[i] if x in mine] == [x for x in mine if x in want[i]]

    ids = sorted(kept["line_dedup"])
    roots, _ = brute([kept["line_dedup"][i].text for i in ids])
    assert set(kept["ngram_jaccard_join"]) == {ids[r] for r in roots}
    assert set(kept["mixing"]) <= set(kept["ngram_jaccard_join"]) and len(kept["mixing"]) > 0.7 * len(kept["ngram_jaccard_join"])

    library = Tokenizer.from_file(bpe.vocabulary_path())
    assert set(kept["bpe"]) == set(kept["mixing"])
    for i, r in kept["bpe"].items():
        ids = library.encode(kept["mixing"][i].text, add_special_tokens=False).ids
        assert np.frombuffer(r.ids, dtype="<u4").tolist() == ids and r.n_tokens == len(ids)


def test_empty_and_run(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").where("false")
    for _, stage in corpus_pipeline.STAGES:
        docs = materialise(stage(spark, docs, sf_dir))
    assert docs.count() == 0
