"""How the vocabulary of each source differs from that of the others of its language.

Steps:

1. Every task folds whole documents into hash stripes: term -> (document frequency,
   occurrences by source), one hash for each language.  A hash that has grown to
   ``HELD`` entries is spilled as rows and begun anew.
2. Stripes are merged by (language, term): sorted, then added up a bounded batch at a time.
   However frequent a term is, it comes as one stripe for each spilled hash, so no key is
   much larger than the next ones, and one of any number of stripes needs the memory of a batch.
3. Terms in at least ``least`` documents of a language stay.  Their totals by source give
   every source its smoothed frequencies, in billionths, as exact integers.
4. The merged stripes, cut into groups of bounded size, emit the divergences: for each pair
   of sources the sum over all terms, for each source its terms that are more frequent
   than in the language.  Only terms that a source has are looked at; those that neither
   of a pair has all add the same value.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from foldwise.llm.common import materialise, table, text_of
from foldwise.llm.registry import query
from foldwise.llm.term_runs import pieces
from foldwise.session import bounded

LEAST_DOCUMENTS = 10
TOP_TERMS = 10
HELD = 1_000_000  # entries of a task's hashes before they are spilled, about 100 bytes each
MERGED = 100_000  # stripes that are added up at a time, at least
GROUP_ENTRIES = 1 << 15  # (term, source) counts that one emitting group takes
PAIR_CELLS = 1 << 22  # (source, source) sums that one emitting group holds
BLOCK_CELLS = 1 << 19
BILLION = 1_000_000_000

TERM = re.compile(rb"[a-z\x80-\xff]+")  # in lower-cased UTF-8
_STRIPE = "lang string, term string, df long, sources array<string>, counts array<long>"
_PART = "lang string, source string, part string, item string, value long"


class _Hashes:
    """The stripes of one task: for each language, documents by term and occurrences by source and term."""

    def __init__(self):
        self.df: dict[str, Counter] = {}
        self.by: dict[str, dict[str, Counter]] = {}

    def add(self, lang: str, source: str, text: bytes) -> None:
        seen: set[bytes] = set()
        counts = self.by.setdefault(lang, {}).setdefault(source, Counter())
        for some in pieces(TERM, text.lower()):
            counts.update(some)
            seen.update(some)
        self.df.setdefault(lang, Counter()).update(seen)

    def entries(self) -> int:
        return sum(len(c) for by in self.by.values() for c in by.values())

    def spill(self) -> Iterator[pa.RecordBatch]:
        for lang, df in self.df.items():
            names = list(self.by[lang])
            place = {t: i for i, t in enumerate(df)}
            row = np.concatenate([np.fromiter(map(place.__getitem__, c), np.int64, len(c)) for c in self.by[lang].values()])
            count = np.concatenate([np.fromiter(c.values(), np.int64, len(c)) for c in self.by[lang].values()])
            source = np.repeat(np.arange(len(names)), [len(c) for c in self.by[lang].values()])
            order = np.argsort(row, kind="stable")
            terms = pa.array(list(df), pa.binary()).cast(pa.string())
            whole = _stripes(
                pa.array([lang] * len(df), pa.string()), terms, pa.array(df.values(), pa.int64()), np.bincount(row, minlength=len(df)),
                pa.array(names, pa.string()).take(pa.array(source[order])), pa.array(count[order]))
            yield from whole.to_batches(max_chunksize=20_000)
        self.__init__()


def _stripes(lang: pa.Array, term: pa.Array, df: pa.Array, sizes: np.ndarray, sources: pa.Array, counts: pa.Array) -> pa.Table:
    ends = pa.array(np.concatenate(([0], np.cumsum(sizes))).astype(np.int32))
    columns = [lang, term, df, pa.ListArray.from_arrays(ends, sources), pa.ListArray.from_arrays(ends, counts)]
    return pa.Table.from_arrays(columns, names=["lang", "term", "df", "sources", "counts"])


def _fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hashes, added = _Hashes(), 0
    for batch in batches:
        texts = batch.column(2).cast(pa.binary())
        for lang, source, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), texts, strict=True):
            data = text.as_py()
            hashes.add(lang, source, data)
            added += len(data)
            if added >= 1 << 20:
                added = 0
                if hashes.entries() >= HELD:
                    yield from hashes.spill()
    yield from hashes.spill()


def _key_starts(rows: pa.Table) -> np.ndarray:
    """Rows of a sorted table that begin a new (language, term)."""
    differ = np.zeros(rows.num_rows, dtype=bool)
    differ[0] = True
    for name in ("lang", "term"):
        c = rows.column(name).combine_chunks()
        differ[1:] |= pc.not_equal(c[1:], c[:-1]).to_numpy(zero_copy_only=False)
    return np.flatnonzero(differ)


def _added(rows: pa.Table, starts: np.ndarray) -> pa.Table:
    """The stripes of each key of a sorted table as one."""
    if len(starts) == rows.num_rows:
        return rows
    key = np.repeat(np.arange(len(starts)), np.diff(np.concatenate((starts, [rows.num_rows]))))
    sources, counts = rows.column("sources").combine_chunks(), rows.column("counts").combine_chunks()
    owner = key[np.repeat(np.arange(rows.num_rows), np.diff(sources.offsets.to_numpy()))]
    flat = pa.table({"key": owner, "source": sources.flatten(), "n": counts.flatten()}).group_by(["key", "source"]).aggregate([("n", "sum")])
    flat = flat.sort_by("key")
    df = np.add.reduceat(rows.column("df").to_numpy(), starts)
    first = rows.select(["lang", "term"]).take(pa.array(starts)).combine_chunks()
    sizes = np.bincount(flat.column("key").to_numpy(), minlength=len(starts))
    return _stripes(
        first.column("lang").combine_chunks(), first.column("term").combine_chunks(), pa.array(df), sizes,
        flat.column("source").combine_chunks(), flat.column("n_sum").combine_chunks())


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Stripes sorted by language and term: those of one key added up."""
    held: list[pa.Table] = []
    size = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(pa.Table.from_batches([batch]))
        size += batch.num_rows
        if size >= MERGED:
            rows = pa.concat_tables(held).combine_chunks()
            starts = _key_starts(rows)
            whole = _added(rows, starts)
            # The last key may go on in the next batch.
            yield from whole.slice(0, whole.num_rows - 1).to_batches(max_chunksize=20_000)
            held, size = [whole.slice(whole.num_rows - 1)], 1
    if held:
        rows = pa.concat_tables(held).combine_chunks()
        yield from _added(rows, _key_starts(rows)).to_batches(max_chunksize=20_000)


def stripes(documents: DataFrame, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """``lang, term, df, sources, counts``: each term of each language once, with its occurrences by source."""
    given = documents.select(F.coalesce(F.col(lang), F.lit("")).alias("lang"), F.coalesce(F.col(source), F.lit("")).alias("source"), text_of(text).alias("text"))
    dealt = given.mapInArrow(_fold, _STRIPE).repartition("lang", "term").sortWithinPartitions("lang", "term")
    return dealt.mapInArrow(_merge, _STRIPE)


def _p(count: np.ndarray, whole) -> np.ndarray:
    """1 + floor(10^9 (count + 2) / whole), exact at any size."""
    if len(count) and int(count.max()) > 9 * BILLION:
        return (1 + (BILLION * (count.astype(object) + 2)) // whole).astype(np.int64)
    return 1 + (BILLION * (count + 2)) // whole


def _f(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) ** 2 // (p + q)


def _emit(key, kept: pa.Table, profile: pa.Table) -> pa.Table:
    """What the terms of one group add: sums of pairs whose first source lies in the group's strip, and its best terms."""
    lang, strip = key[0].as_py(), key[1].as_py()
    names, total, terms_of, strips, tops = (profile.column(c).to_pylist() for c in ("source", "n", "v", "n_strips", "top"))
    order = sorted(range(len(names)), key=lambda i: names[i].encode())
    names = [names[i] for i in order]
    n, v, size = np.array(total, dtype=np.int64)[order], terms_of[0], len(names)
    high = -(-size // strips[0])
    own = range(strip * high, min((strip + 1) * high, size))
    sums = np.zeros((len(own), size), dtype=np.int64)  # of terms that the own source has, above their base
    both = np.zeros((len(own), size), dtype=np.int64)  # the part of it where the other source has them too
    base = np.zeros((len(own), size), dtype=np.int64)
    best: list[tuple[str, str, int]] = []
    if v:
        whole = n + 2 * v
        absent = 1 + 2 * BILLION // whole
        base = _f(absent[own.start : own.stop, None], absent[None, :])
        found = kept.column("sources").combine_chunks()
        ends = found.offsets.to_numpy().astype(np.int64)
        place = pc.index_in(found.values, value_set=pa.array(names)).to_numpy()
        counts, term = kept.column("counts").combine_chunks().values.to_numpy(), kept.column("term")
        step = max(1, BLOCK_CELLS // size)
        top: dict[int, list] = {}
        for a in range(0, kept.num_rows, step):
            b = min(a + step, kept.num_rows)
            lo, hi = ends[a], ends[b]
            cells = np.zeros((b - a, size), dtype=np.int64)
            cells[np.repeat(np.arange(b - a), np.diff(ends[a : b + 1])), place[lo:hi]] = counts[lo:hi]
            p = _p(cells, whole) if cells.max(initial=0) <= 9 * BILLION else np.stack([_p(cells[:, j], int(whole[j])) for j in range(size)], axis=1)
            q = _p(cells.sum(axis=1), int(whole.sum()) - 2 * v * (size - 1))
            have = cells > 0
            for j, s in enumerate(own):
                rows = np.flatnonzero(have[:, s])
                if not len(rows):
                    continue
                above = _f(p[rows, s][:, None], p[rows]) - base[j]
                sums[j] += above.sum(axis=0)
                both[j] += (above * have[rows]).sum(axis=0)
                rows = rows[p[rows, s] > q[rows]]
                value = _f(p[rows, s], q[rows])
                if len(rows) > tops[0]:
                    near = np.partition(value, len(rows) - tops[0])[len(rows) - tops[0]]
                    rows, value = rows[value >= near], value[value >= near]  # ties stay for now
                new = [(-x, t.encode(), t) for x, t in zip(value.tolist(), term.take(rows + a).to_pylist(), strict=True)]
                top[s] = sorted(top.get(s, []) + new)[: tops[0]]
        best = [(names[s], t, -x) for s, some in top.items() for x, _, t in some]
    first = sums - both + kept.num_rows * base
    out: list[tuple] = []
    for j, s in enumerate(own):
        out += [(names[s], "pair", names[t], int(first[j, t])) for t in range(size) if t != s]
        out += [(names[t], "pair", names[s], int(sums[j, t])) for t in np.flatnonzero(sums[j]).tolist() if t != s]
    out += [(s, "term", t, x) for s, t, x in best]
    columns = list(zip(*out, strict=True)) or [(), (), (), ()]
    kinds = [pa.string(), pa.string(), pa.string(), pa.int64()]
    made = [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]
    return pa.Table.from_arrays([pa.array([lang] * len(out), pa.string()), *made], names=["lang", "source", "part", "item", "value"])


def divergences(documents: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", least: int = LEAST_DOCUMENTS, top: int = TOP_TERMS) -> DataFrame:
    """``lang, source, part, item, value, rank``: how far each source is from each other one, and by which terms.

    Defined cases: a null text, language or source counts as empty; a source without terms
    has count 0 everywhere; a language without kept terms gives value 0 for every pair and no
    terms; a single source of a language has no pairs; equal values rank by item; repeated rows
    count each time; other columns are ignored; an empty table gives an empty result.
    """
    documents = documents.select(F.col(text).alias("text"), F.col(lang).alias("lang"), F.col(source).alias("source"))
    kept = materialise(stripes(documents).where(F.col("df") >= least).drop("df"))
    groups = documents.select(F.coalesce("lang", F.lit("")).alias("lang"), F.coalesce("source", F.lit("")).alias("source")).distinct()
    totals = kept.select("lang", F.explode(F.arrays_zip("sources", "counts")).alias("e")).groupBy("lang", F.col("e.sources").alias("source")).agg(F.sum("e.counts").alias("n"))
    sources = materialise(groups.join(totals, ["lang", "source"], "left").fillna(0, ["n"]))
    found = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("v"), F.sum(F.size("sources")).alias("entries"))
    sizes = sources.groupBy("lang").agg(F.count(F.lit(1)).alias("size")).join(found, "lang", "left").fillna(0, ["v", "entries"])
    # One strip of sources is the rule; each group takes at least as many counts as it has pairs to tell of.
    strips = F.ceil(F.col("size") * F.col("size") / PAIR_CELLS)
    cuts = F.greatest(F.ceil(F.col("entries") / F.greatest(F.lit(GROUP_ENTRIES), F.col("size") * F.col("size"))), F.lit(1))
    sizes = materialise(sizes.select("lang", "v", strips.alias("n_strips"), cuts.alias("n_cuts"), F.lit(top).alias("top")))
    each = bounded(sizes)
    strip = F.explode(F.sequence(F.lit(0), F.col("n_strips") - 1)).alias("strip")
    dealt = kept.join(each, "lang").select("lang", strip, F.pmod(F.xxhash64("term"), F.col("n_cuts")).alias("cut"), "term", "sources", "counts")
    told = sources.join(each, "lang").select("lang", "source", "n", "v", "n_strips", "top", strip, "n_cuts")
    told = told.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_cuts") - 1)).alias("cut")).drop("n_cuts")
    by = ["lang", "strip", "cut"]
    parts = dealt.groupBy(*by).cogroup(told.groupBy(*by)).applyInArrow(_emit, _PART)
    sums = parts.groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value"))
    order = Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item")
    return sums.withColumn("rank", F.row_number().over(order)).where((F.col("part") == "pair") | (F.col("rank") <= top))


_SQL = """
WITH d AS (SELECT coalesce(text, '') AS text, coalesce(lang, '') AS lang, coalesce(source, '') AS source, row_number() OVER () AS r FROM documents),
t AS (SELECT lang, source, r, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term FROM d),
kept AS (SELECT lang, term FROM t GROUP BY ALL HAVING count(DISTINCT r) >= 10),
g AS (SELECT DISTINCT lang, source FROM d),
v AS (SELECT lang, count(*) AS v FROM kept GROUP BY ALL),
c AS (SELECT lang, source, term, count(*) AS n FROM t JOIN kept USING (lang, term) GROUP BY ALL),
full_c AS (SELECT g.lang, g.source, kept.term, coalesce(c.n, 0)::HUGEINT AS n FROM g JOIN kept USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = kept.term),
p AS (SELECT lang, source, term, n, 1 + (1000000000 * (n + 2)) // (sum(n) OVER (PARTITION BY lang, source) + 2 * v) AS p FROM full_c JOIN v USING (lang)),
l AS (SELECT lang, term, sum(n) AS n FROM full_c GROUP BY ALL),
q AS (SELECT lang, term, 1 + (1000000000 * (n + 2)) // (sum(n) OVER (PARTITION BY lang) + 2 * v) AS q FROM l JOIN v USING (lang)),
pairs AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value
          FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
all_pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(pairs.value, 0) AS value
              FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN pairs ON pairs.lang = a.lang AND pairs.source = a.source AND pairs.item = b.source),
terms AS (SELECT lang, source, 'term' AS part, term AS item, (p - q) * (p - q) // (p + q) AS value FROM p JOIN q USING (lang, term) WHERE n > 0 AND p > q),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM (SELECT * FROM all_pairs UNION ALL SELECT * FROM terms))
SELECT lang, source, part, item, value::BIGINT AS value, rank::INTEGER AS rank FROM ranked WHERE part = 'pair' OR rank <= 10
"""


@query(_SQL)
def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Divergence of every source from each other source of its language, and its ten most overused terms."""
    return divergences(table(spark, sf_dir, "documents").select("text", "lang", "source"))
