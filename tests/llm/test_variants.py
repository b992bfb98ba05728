import random
from collections import Counter, defaultdict

import pytest

from foldwise.llm import variants
from tests.llm.conftest import odd_documents


def near(a, b):
    """Whether two words differ by exactly one inserted, deleted or replaced character."""
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain(counts, times=variants.TIMES):
    """The same by comparing all pairs."""
    words = sorted(counts)
    others = defaultdict(list)
    for i, a in enumerate(words):
        for b in words[i + 1 :]:
            if near(a, b):
                others[a].append(b), others[b].append(a)
    form = {}
    for w in words:
        best = min(others[w], key=lambda x: (-counts[x], x), default=None)
        form[w] = best if best and counts[best] >= times * counts[w] else None

    def root(w):
        while form[w]:
            w = form[w]
        return w

    return {(w, form[w], root(w), counts[w], len(others[w]), counts[form[w]] if form[w] else None) for w in words}


def run(spark, counts, parts=3):
    df = spark.createDataFrame(list(counts.items()), "word string, n long").repartition(parts)
    return [tuple(r) for r in variants.variants(df).collect()]


@pytest.mark.parametrize("letters", ["ab", "aé×", "abcdefg"])
def test_brute_force(spark, letters):
    r = random.Random(len(letters))
    counts = Counter()
    for _ in range(250):
        counts["".join(r.choice(letters) for _ in range(r.randrange(1, 9)))] += r.choice([1, 2, 11, 130, 1500])
    got = run(spark, dict(counts))
    assert len(got) == len(counts) and set(got) == plain(counts)


def test_chain_of_forms(spark):
    counts = {"abcdefg": 2, "abcdefgh": 20, "abcdefgi": 20, "abcdefghi": 200, "abcdefghij": 2000, "abcdefghijk": 20000, "zzzzzzz": 5}
    got = {r[0]: r for r in run(spark, counts)}
    assert got["abcdefg"][1:3] == ("abcdefgh", "abcdefghijk")  # the least of two as frequent, then on to the end
    assert got["abcdefghijk"][1:3] == (None, "abcdefghijk") and got["zzzzzzz"][4] == 0


def test_repeated_letters_count_once(spark):
    got = {r[0]: r for r in run(spark, {"aaaaaaa": 3, "aaaaaaaa": 40})}
    assert got["aaaaaaa"][1:] == ("aaaaaaaa", "aaaaaaaa", 3, 1, 40) and got["aaaaaaaa"][4] == 1


def test_runs_over_batches(spark):
    """A run of equal beginnings is whole even if it is cut between batches."""
    counts = {f"wor{chr(97 + i)}ding": 3 + i for i in range(26)}
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2")
    try:
        assert set(run(spark, counts, 1)) == plain(counts)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_odd_rows(odd, empty):
    counts = {r.word: r.n for r in variants.word_counts(odd).collect()}
    want = Counter()
    for _, text in odd_documents():
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        run = ""
        for c in low + " ":
            if "a" <= c <= "z" or "À" <= c <= "ÿ":
                run += c
                continue
            if len(run) >= 7:
                want[run] += 1
            run = ""
    assert counts == dict(want) and counts["a" * 5000] == 1
    assert variants.variants(variants.word_counts(empty)).count() == 0
    assert variants.word_counts(odd, damage=1).count() > 0  # every run loses a character, null ids too


def test_small_hashes(odd, monkeypatch):
    """Words are the same however often a task sends them."""
    whole = {r.word: r.n for r in variants.word_counts(odd).collect()}
    monkeypatch.setattr(variants, "HELD", 3)
    assert {r.word: r.n for r in variants.word_counts(odd).collect()} == whole
