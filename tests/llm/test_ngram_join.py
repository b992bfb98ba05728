import re

import numpy as np
import pytest

from foldwise.llm import ngram_join, shingles
from foldwise.llm.components import components
from foldwise.llm.registry import QUERIES
from tests.llm.conftest import CLASHING, odd_documents, prose

LOWER = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})


def shingle_set(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    return frozenset(tuple(words[k : k + 5]) for k in range(len(words) - 4)) if len(words) >= 5 else frozenset([tuple(words)] if words else [])


def brute(texts):
    """Least reachable position of each text, over all pairs that share a shingle."""
    sets = [shingle_set(t) for t in texts]
    up, where = list(range(len(sets))), {}

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, s in enumerate(sets):
        seen = {}
        for x in s:
            for j in where.setdefault(x, []):
                seen[j] = seen.get(j, 0) + 1
            where[x].append(i)
        for j, both in seen.items():
            if 100 * both >= 80 * (len(s) + len(sets[j]) - both):
                a, b = find(i), find(j)
                up[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(sets))], [len(s) for s in sets]


def chain(n):
    """Texts of which each links with the next only, a family around one text, and bystanders."""
    base = prose(50, 400).split()
    out = [" ".join([*(f"w{k}_{j}" for j in range(12 * k)), *base[12 * k :]]) for k in range(n)]
    family = prose(51, 90).split()
    out += [" ".join([*family[: 2 * k], f"edit{k}", *family[2 * k + 1 :]]) for k in range(40)]
    shared = prose(52, 60)
    out += [f"{prose(60 + k, 50 + k)} {shared}" for k in range(30)]
    out += [shared, shared + " end", shared, shared.upper()]
    return out


@pytest.mark.parametrize("block", [2000, 7])
def test_brute_force(spark, block):
    texts = chain(15)
    roots, sizes = brute(texts)
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string").repartition(4)
    got = {r.id: r for r in ngram_join.near_duplicates(df, block_sets=block).collect()}
    assert [got[k].component_id for k in range(len(texts))] == roots
    assert [got[k].n_shingles for k in range(len(texts))] == sizes


def test_query(spark, sf_dir, texts):
    ids = sorted(texts)
    roots, sizes = brute([texts[i] for i in ids])
    got = {r.doc_id: r for r in QUERIES["op6_ngram_jaccard_join"](spark, sf_dir).collect()}
    assert [got[i].component_id for i in ids] == [ids[r] for r in roots]
    assert [got[i].n_shingles for i in ids] == sizes


def test_odd_rows(odd, empty):
    found = sorted(((r.id, r.n_shingles, r.component_id) for r in ngram_join.near_duplicates(odd).collect()), key=repr)
    rows = odd_documents()
    assert len(found) == len(rows)
    by = {}
    for i, n, c in found:
        by.setdefault(i, set()).add((n, c))
    assert by[0] == {(0, 0)} and by[1] == {(0, 1)} and by[3] == by[4] == {(1, 3)} and by[5] == by[6] == {(1, 5)}
    assert {c for _, c in by[9] | by[10]} == {9}
    assert {c for _, c in by[None]} == {None}
    kept = ngram_join.one_of_each(odd)
    assert kept.columns == odd.columns
    left = kept.collect()
    ids = sorted((r.doc_id for r in left), key=repr)
    # One of the two equal rows 7 and its other text; one of the equal rows without id, and the one without text.
    assert ids == sorted([0, 1, 2, 3, 5, 7, 7, None, None, 8, 9, 11, 12, 13, 14, 15, 16, 17], key=repr)
    assert all([r[c] for c in CLASHING] == list(range(len(CLASHING))) for r in left)
    assert ngram_join.near_duplicates(empty).count() == 0 and ngram_join.one_of_each(empty).count() == 0


def test_shingles_tell_texts_apart():
    texts = [t.encode() for t in ("a b c d e f", "a b c d e", "a  b\tc d E", "a b c d", "", " ", "b a c d e")]
    sets = list(shingles.shingle_sets(texts))
    assert [len(s) for s in sets] == [2, 1, 1, 1, 0, 0, 1]
    assert sets[1][0] == sets[2][0] and sets[1][0] in sets[0] and sets[3][0] not in sets[0] and sets[6][0] != sets[1][0]
    whole = list(shingles.shingle_sets([prose(1, 900_000).encode()]))  # longer than a piece
    words = prose(1, 900_000).split()
    assert len(whole[0]) == len({tuple(words[k : k + 5]) for k in range(len(words) - 4)})


def test_components(spark):
    edges = [(k, k + 1) for k in range(60)] + [(100, 200), (200, 300), (300, 100), (7, 7), (400, 400)] + [(500, 501 + k) for k in range(50)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long").repartition(5)).collect()}
    assert got == {**dict.fromkeys(range(61), 0), 100: 100, 200: 100, 300: 100, **dict.fromkeys(range(500, 551), 500)}


@pytest.mark.parametrize("share", [1, 4, 1000])
def test_components_in_rounds(spark, monkeypatch, share):
    """Long chains, stars and cycles, with more edges than one task's share and with fewer."""
    import random

    from foldwise.llm import components as co

    monkeypatch.setattr(co, "TASK_EDGES", share)
    r = random.Random(9)
    edges = [(k, k + 1) for k in range(40)] + [(100, 100 + k) for k in range(1, 20)] + [(200 + k, 200 + (k + 1) % 9) for k in range(9)]
    edges += [(r.randrange(300, 360), r.randrange(300, 360)) for _ in range(40)] + [(-5, 7), (500, 500)]
    up = {}

    def find(i):
        while up.setdefault(i, i) != i:
            i = up[i]
        return i

    for a, b in edges:
        if a != b:
            a, b = find(a), find(b)
            up[max(a, b)] = min(a, b)
    got = {x.node: x.root for x in components(spark.createDataFrame(edges, "a long, b long").repartition(6)).collect()}
    assert got == {i: find(i) for i in list(up)}


def test_a_large_family(spark):
    """Five thousand near copies, each with a word of its own, are one component, in blocks and as one group."""
    words = prose(77, 80).split()
    rows = [(k, " ".join([*words[: k % 70], f"own{k}", *words[k % 70 + 1 :]])) for k in range(5000)] + [(9000 + k, prose(500 + k, 60)) for k in range(20)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = {r.id: r.component_id for r in ngram_join.near_duplicates(df, block_sets=1500).collect()}
    sets = {k: {tuple(t.split()[i : i + 5]) for i in range(76)} for k, t in rows[:300]}
    linked = {k for k in range(300) if any(k != j and 100 * len(sets[k] & sets[j]) >= 80 * len(sets[k] | sets[j]) for j in range(300))}
    assert len(linked) > 200 and {got[k] for k in linked} == {0}
    assert all(got[9000 + k] == 9000 + k for k in range(20))
