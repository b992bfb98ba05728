import random
import re
from collections import Counter, defaultdict

import pyarrow as pa
import pytest

from foldwise.llm import divergence

TERM = re.compile("[A-Za-z\x80-\U0010ffff]+")


def plain(rows, least, top):
    """The same with plain dictionaries: rows are (text, lang, source)."""
    df, counts, groups = defaultdict(Counter), defaultdict(Counter), set()
    for text, lang, source in rows:
        lang, source = lang or "", source or ""
        found = ["".join(c.lower() if "A" <= c <= "Z" else c for c in t) for t in TERM.findall(text or "")]
        df[lang].update(set(found))
        counts[lang, source].update(found)
        groups.add((lang, source))
    out = set()
    for lang in {g[0] for g in groups}:
        kept = sorted(t for t, n in df[lang].items() if n >= least)
        sources = sorted((s for g, s in groups if g == lang), key=str.encode)

        def p(count, kept=kept):
            whole = sum(count[t] for t in kept) + 2 * len(kept)
            return {t: 1 + 10**9 * (count[t] + 2) // whole for t in kept}

        def f(a, b):
            return (a - b) ** 2 // (a + b)

        every = sum((counts[lang, s] for s in sources), Counter())
        q = p(every)
        for s in sources:
            own = p(counts[lang, s])
            parts = {
                "pair": [(sum(f(own[t], p(counts[lang, o])[t]) for t in kept), o) for o in sources if o != s],
                "term": [(f(own[t], q[t]), t) for t in kept if counts[lang, s][t] and own[t] > q[t]],
            }
            for part, values in parts.items():
                for rank, (value, item) in enumerate(sorted(values, key=lambda v: (-v[0], v[1].encode())), 1):
                    if part == "pair" or rank <= top:
                        out.add((lang, s, part, item, value, rank))
    return out


def random_rows(n, seed=3):
    r = random.Random(seed)
    words = ["alpha", "Beta", "gamma", "été", "日本", "x", "delta", "straße", "omega", "Iota"]
    return [(" ".join(r.choices(words, k=r.randrange(0, 30))) + "-end", r.choice(["en", "de", None]), r.choice(["s1", "s2", "ß", None, "s10"])) for _ in range(n)]


def result(spark, rows, **kw):
    df = spark.createDataFrame(rows, "text string, lang string, source string").repartition(4)
    got = [tuple(r) for r in divergence.divergences(df, **kw).collect()]
    assert len(got) == len(set(got))
    return set(got)


@pytest.mark.parametrize("small", [False, True])
def test_brute_force(spark, monkeypatch, small):
    if small:  # spills, batches that cut keys, several groups and strips
        for name, value in {"HELD": 5, "MERGED": 2, "GROUP_ENTRIES": 3, "PAIR_CELLS": 4, "BLOCK_CELLS": 6}.items():
            monkeypatch.setattr(divergence, name, value)
    rows = random_rows(120) + [("lonely words here", "fr", "s1"), ("others there", "fr", "s2"), (None, "fr", "s3")]
    assert result(spark, rows, least=4, top=3) == plain(rows, 4, 3)


def test_counts_beyond_64_bits_of_product():
    """Frequencies of counts whose product with a billion does not fit 64 bits are exact."""
    import numpy as np

    counts = np.array([0, 5, 10**13 + 7, 3 * 10**17])
    whole = int(counts.sum()) + 8
    assert divergence._p(counts, whole).tolist() == [1 + 10**9 * (int(c) + 2) // whole for c in counts]
    sources = ["a", "b"]
    kept = pa.table({"term": ["t", "u"], "sources": [sources, sources], "counts": [[10**13, 7], [5, 2 * 10**12]]})
    profile = pa.table({"source": sources, "n": [10**13 + 5, 2 * 10**12 + 7], "v": [2, 2], "n_strips": [1, 1], "top": [5, 5]})
    out = divergence._emit((pa.scalar("en"), pa.scalar(0)), kept, profile).to_pylist()
    p = [[1 + 10**9 * (c + 2) // (n + 4) for c in row] for row, n in (((10**13, 5), 10**13 + 5), ((7, 2 * 10**12), 2 * 10**12 + 7))]
    want = sum((x - y) ** 2 // (x + y) for x, y in zip(*p, strict=True))
    assert sum(r["value"] for r in out if r["part"] == "pair" and r["source"] == "a") == want


def test_odd_rows(odd, empty):
    rows = [(r.text, r.lang, r.source) for r in odd.select("text", "lang", "source").collect()]
    got = {tuple(r) for r in divergence.divergences(odd, least=2).collect()}
    assert got == plain(rows, 2, 10) and {r[0] for r in got} == {"", "en"}
    assert divergence.divergences(empty).count() == 0
    nothing = {tuple(r) for r in divergence.divergences(odd, least=1000).collect()}
    assert nothing == plain(rows, 1000, 10) and {r[4] for r in nothing} == {0}


def test_long_texts_in_pieces(monkeypatch):
    from foldwise.llm import term_runs

    monkeypatch.setattr(term_runs, "PIECE", 3)
    text = b"ab c " * 300_000
    assert len(text) > 1 << 20
    assert sum(len(p) for p in term_runs.pieces(divergence.TERM, text)) == 600_000
    assert max(len(p) for p in term_runs.pieces(divergence.TERM, text)) <= 3
