"""Encoding against the tokenizers library, and round trips."""

import hashlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from foldwise.llm import bpe
from foldwise.llm.registry import QUERIES
from tests.llm.conftest import odd_documents, prose


@pytest.fixture(scope="module")
def both():
    path = bpe.vocabulary_path()
    with open(path, encoding="utf-8") as f:
        return bpe.WordBpe(f.read()), Tokenizer.from_file(path)


def expected(library, text):
    ids = library.encode(text or "", add_special_tokens=False).ids
    return ids, library.decode(ids, skip_special_tokens=False)


@pytest.mark.parametrize("text", [
    "", " ", "a", "Hello WORLD's don't", "<|startoftext|>Hi<|endoftext|><|endoftext|> x", "ΑΣ ΣΑΣ Σ", "İstanbul", "é ﬁ ½ ² Ⅷ ١٢٣", "a\x1cb\x1f c\x85d\xa0e",
    "x" * 3000, "ab" * 700 + " " + "!?" * 400, "😀👍🏽 ok", "'S 'll 'x ''", "1234567890 12,5"])
def test_matches_library(both, text):
    mine, library = both
    ids, decoded = expected(library, text)
    assert np.frombuffer(mine.encode(text), dtype="<u4").tolist() == ids
    assert mine.decode(mine.encode(text)) == decoded


def test_scan_and_heap_agree(both):
    mine, _ = both
    for k in range(50):
        word = prose(k, 12).replace(" ", "").encode()
        parts = [*[mine.inner[b] for b in word[:-1]], mine.last[word[-1]]]
        assert mine._scan(parts[:]) == mine._heap(parts[:])


def test_query(spark, sf_dir, texts, both):
    got = {r.doc_id: r for r in QUERIES["op1_bpe"](spark, sf_dir).collect()}
    assert got.keys() == texts.keys()
    for i, text in texts.items():
        ids, decoded = expected(both[1], text)
        assert got[i].n_tokens == len(ids)
        assert got[i].ids_sha256 == hashlib.sha256(np.array(ids, dtype="<u4").tobytes()).hexdigest()
        assert got[i].decoded_sha256 == hashlib.sha256(decoded.encode()).hexdigest()


def test_odd_rows(odd, empty, both):
    path = bpe.vocabulary_path()
    got = bpe.round_trip(odd, path).collect()
    assert sorted(((r.doc_id, r.decoded) for r in got), key=repr) == sorted(((i, expected(both[1], t)[1]) for i, t in odd_documents()), key=repr)
    assert bpe.round_trip(empty, path).count() == 0
    apart = bpe.decode_documents(bpe.encode_documents(odd, path), path).collect()
    assert sorted((repr(r.ids) + r.decoded for r in apart)) == sorted(repr(r.ids) + r.decoded for r in got)
