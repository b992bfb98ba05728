"""Spelling variants: words that differ by one character, found on sorted permuterm rotations.

A word marked with a terminator is written once for each way to rotate it.  A rotation that
ends in the edited character has the rest in front of it, so words that differ by one replaced
character agree in a rotation but for its last character, and a word that lacks the character
has exactly that beginning as a rotation of its own.  So each word gives its whole rotations and,
for each character, the rotation without it; all are sorted, and a run of equal beginnings holds
at most one whole word and one word for each character of the alphabet.  Runs are scanned, and
every word of a run has the others as neighbours.  Where a character is repeated, several
rotations tell of the same lacking one; only that of the first of the repeated characters counts.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foldwise.llm.common import materialise, table, text_of
from foldwise.llm.registry import query
from foldwise.llm.term_runs import pieces

LEAST_CHARS = 7
LEAST_COUNT = 2
TIMES = 10  # a form is at least so many times as frequent
DAMAGE = 31  # of the query: the share of occurrences that lose a character
HELD = 400_000  # words a task holds before it sends them
MARK = "$"


def _runs(least: int) -> re.Pattern:
    return re.compile("[a-zÀ-ÿ]{%d,}" % least)


def _word_counts(least: int, damage: int | None):
    """``word, n`` of a task's documents; with ``damage``, one run in so many loses a character."""
    runs = _runs(least)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for batch in batches:
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()), strict=True):
                found: Counter = Counter()
                for some in pieces(runs, text.as_py().lower().decode()):
                    found.update(some)
                start = zlib.crc32(f"{'' if i is None else i}:".encode())
                for word, n in found.items():
                    if damage:
                        h = zlib.crc32(word.encode(), start)
                        if h % damage == 0:
                            at = h % len(word)
                            word = word[:at] + word[at + 1 :]
                            if len(word) < least:
                                continue
                    counts[word] += n
                if len(counts) >= HELD:
                    yield _sent(counts)
                    counts = Counter()
        yield _sent(counts)

    return run


def _sent(counts: Counter) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], names=["word", "n"])


def word_counts(documents: DataFrame, id_column: str = "doc_id", text: str = "text", least: int = LEAST_CHARS, damage: int | None = None) -> DataFrame:
    """``word, n`` of all runs of at least ``least`` Latin letters, A-Z in lower case."""
    folded = documents.select(F.col(id_column), text_of(text)).mapInArrow(_word_counts(least, damage), "word string, n long")
    return folded.groupBy("word").agg(F.sum("n").alias("n"))


def rotations(words: DataFrame) -> DataFrame:
    """``key, skipped, n``: whole rotations of each marked word, and those that end in a character, without it."""
    at = F.col("at")
    before, behind = F.expr("substring(word, 1, at)"), F.expr("substring(word, at + 1)")
    whole = words.select("word", "n", F.explode(F.sequence(F.lit(0), F.length("word"))).alias("at"))
    whole = whole.select(F.concat(behind, F.lit(MARK), before).alias("key"), F.lit("").alias("skipped"), "n")
    parts = words.select("word", "n", F.explode(F.sequence(F.lit(0), F.length("word") - 1)).alias("at"))
    parts = parts.select(F.concat(F.expr("substring(word, at + 2)"), F.lit(MARK), before).alias("key"), F.expr("substring(word, at + 1, 1)").alias("skipped"), "n")
    return whole.unionByName(parts)


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rotations: for each word of a run of equal keys, how many neighbours it has there and the most frequent one."""
    rest = None
    for batch in batches:
        now = pa.Table.from_batches([batch])
        now = pa.concat_tables([rest, now]) if rest is not None else now
        key = now.column(0).combine_chunks()
        differ = np.flatnonzero(pc.not_equal(key[1:], key[:-1]).to_numpy(zero_copy_only=False)) + 1
        last = int(differ[-1]) if len(differ) else 0
        rest = now.slice(last)  # this run may go on
        if last:
            yield _neighbours(now.slice(0, last), np.concatenate(([0], differ)))
    if rest is not None and rest.num_rows > 1:
        yield _neighbours(rest, np.array([0, rest.num_rows]))


def _neighbours(rows: pa.Table, cuts: np.ndarray) -> pa.RecordBatch:
    word, near, best_n, best = [], [], [], []
    several = np.flatnonzero(np.diff(cuts) > 1)
    starts, ends = cuts[several].tolist(), cuts[several + 1].tolist()
    picked = rows.take(np.concatenate([np.arange(a, b) for a, b in zip(starts, ends, strict=True)])) if starts else rows.slice(0, 0)
    keys, skipped, counts = (picked.column(k).to_pylist() for k in range(3))
    at = 0
    for a, b in zip(starts, ends, strict=True):
        key, size = keys[at], b - a
        behind, before = key.split(MARK)
        # By frequency, the most frequent first, equal ones by word.
        run = sorted((-counts[k], before + skipped[k] + behind, skipped[k]) for k in range(at, at + size))
        whole = next((r for r in run if not r[2]), None)
        parts = [r for r in run if r[2]]
        lacking = [r for r in parts if r[2] != key[-1]] if whole else []  # of repeated characters the first
        for r in parts:
            others = [x for x in parts[:2] if x is not r][:1]
            n = len(parts) - 1
            if whole and r[2] != key[-1]:
                others.append(whole)
                n += 1
            if n:
                top = min(others)
                word.append(r[1]), near.append(n), best_n.append(-top[0]), best.append(top[1])
        if lacking:
            word.append(whole[1]), near.append(len(lacking)), best_n.append(-lacking[0][0]), best.append(lacking[0][1])
        at += size
    return pa.RecordBatch.from_arrays(
        [pa.array(word, pa.string()), pa.array(near, pa.int64()), pa.array(best_n, pa.int64()), pa.array(best, pa.string())],
        names=["word", "near", "best_n", "best"])


def neighbours(words: DataFrame) -> DataFrame:
    """``word, n_near, best_n, best`` for each word that has a neighbour; the best is the most frequent one, of equal ones the least."""
    dealt = rotations(words).repartition("key").sortWithinPartitions("key")
    found = dealt.mapInArrow(_scan, "word string, near long, best_n long, best string")
    top = F.min(F.struct((-F.col("best_n")).alias("back"), "best")).alias("top")
    return found.groupBy("word").agg(F.sum("near").alias("n_near"), top).select("word", "n_near", (-F.col("top.back")).alias("best_n"), F.col("top.best").alias("best"))


def roots(links: DataFrame, most: int, times: int = TIMES) -> DataFrame:
    """``word, root``: the end of each word's chain of forms.

    A form is ``times`` as frequent as its word, so chains are as short as the logarithm of
    the greatest count ``most``; each round doubles the steps that are known.
    """
    steps = max(1, math.ceil(math.log(max(most, 2), times)) + 1)
    found = links.select("word", F.col("form").alias("root"))
    for _ in range(math.ceil(math.log2(steps))):
        found = materialise(found)
        on = found.select(F.col("word").alias("via"), F.col("root").alias("far"))
        found = found.join(on, F.col("root") == F.col("via"), "left").select("word", F.coalesce("far", "root").alias("root"))
    return found


def variants(words: DataFrame, times: int = TIMES) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` for each row of ``word, n``.

    The form of a word is its most frequent neighbour if that has at least ``times`` its count,
    the root where following forms ends.  Defined cases: a word without neighbours has 0 of them and
    no form, and is its own root; of neighbours as frequent the least in code-point order is the
    form; words are taken as unique, without the mark and not null; an empty table gives an empty result.
    """
    words = words.select("word", "n")
    near = materialise(words.join(neighbours(words), "word", "left"))
    enough = F.col("best_n") >= times * F.col("n")
    near = near.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(enough, F.col("best")).alias("form"), F.when(enough, F.col("best_n")).alias("form_n"))
    most = near.agg(F.max("form_n")).first()[0] or 0
    ends = roots(near.where("form IS NOT NULL").select("word", "form"), most, times)
    return near.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


# Words by SQL: the checksum of id and run is worked out bit by bit over its UTF-8 bytes; neighbours are words that agree
# without one character, or where one is the other without a character.
_SQL = f"""
WITH RECURSIVE crc_table AS (
  SELECT list(c ORDER BY b) AS crcs FROM (SELECT b, list_reduce([b::BIGINT, 1, 2, 3, 4, 5, 6, 7, 8], lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c FROM (SELECT unnest(range(256)) AS b))),
runs AS (SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-zÀ-ÿ]+')) AS run FROM documents),
distinct_runs AS (SELECT doc_id, run, count(*) AS k FROM runs WHERE length(run) >= {LEAST_CHARS} GROUP BY ALL),
coded AS (SELECT doc_id, run, k, list_concat([4294967295::BIGINT], flatten(list_transform(string_split(coalesce(doc_id::VARCHAR, '') || ':' || run, ''),
            lambda x: CASE WHEN unicode(x) < 128 THEN [unicode(x)::BIGINT] ELSE [192 + (unicode(x) >> 6)::BIGINT, 128 + (unicode(x) & 63)::BIGINT] END))) AS codes FROM distinct_runs),
summed AS (SELECT doc_id, run, k, xor(list_reduce(codes, lambda c, x: xor(crcs[(xor(c, x) & 255) + 1], c >> 8)), 4294967295) AS h FROM coded, crc_table),
damaged AS (SELECT CASE WHEN h % {DAMAGE} = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, k FROM summed),
words AS (SELECT word, sum(k)::BIGINT AS n FROM damaged WHERE length(word) >= {LEAST_CHARS} GROUP BY word HAVING sum(k) >= {LEAST_COUNT}),
cut AS (SELECT word, n, place, substr(word, 1, place - 1) AS front, substr(word, place + 1) AS behind FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS place FROM words)),
shorter AS (SELECT DISTINCT word, n, front || behind AS other FROM cut),
lacking AS (SELECT s.word, s.n, w.word AS other, w.n AS other_n FROM shorter s JOIN words w ON w.word = s.other),
near AS (
  SELECT a.word, a.n, b.word AS other, b.n AS other_n FROM cut a JOIN cut b USING (place, front, behind) WHERE a.word <> b.word
  UNION ALL SELECT word, n, other, other_n FROM lacking UNION ALL SELECT other, other_n, word, n FROM lacking),
best AS (SELECT word, count(*) AS n_near, max(other_n) AS best_n, arg_min(other, (-other_n, other)) AS best FROM near GROUP BY word),
formed AS (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN best_n >= {TIMES} * w.n THEN best END AS form, CASE WHEN best_n >= {TIMES} * w.n THEN best_n END AS form_n
           FROM words w LEFT JOIN best b ON b.word = w.word),
chain AS (SELECT word, word AS root, 0 AS step FROM formed UNION ALL SELECT c.word, f.form, step + 1 FROM chain c JOIN formed f ON f.word = c.root WHERE f.form IS NOT NULL),
ends AS (SELECT word, arg_max(root, step) AS root FROM chain GROUP BY word)
SELECT word, form, root, n, n_near, form_n FROM formed JOIN ends USING (word)
"""


@query(_SQL)
def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every word of seven letters or more that occurs twice, with its more frequent spelling and the root of that."""
    counts = word_counts(table(spark, sf_dir, "documents").select("doc_id", "text"), damage=DAMAGE)
    return variants(materialise(counts.where(F.col("n") >= LEAST_COUNT)))
