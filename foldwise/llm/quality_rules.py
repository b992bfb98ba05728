"""Quality rules as a short-circuit cascade, in DataFrame functions only.

Every rule is measured on a sample: how long it takes and what share of rows it
rejects of those that the rules before it leave.  The cascade then asks the rules by rejection
per cost, highest first.
A row that one rule has rejected reaches the later ones as a null text, so they
do no work for it.  The verdict does not depend on the order; only the name of
the first rule that rejected does.  Rules share measures: one that an earlier rule has
paid for is free for the next.

Defined cases: a null text is an empty text (rejected for too few words); a
repeated row is judged each time; an empty table gives an empty result; all
other columns pass through ``keep_good`` untouched, whatever their names.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foldwise.llm.common import WS_CHARS, materialise, table, text_of, words
from foldwise.llm.registry import query

# Thresholds: shares in percent of words or lines, lengths in characters.
MIN_WORDS = 50
MAX_REPEAT_PCT = 50
MAX_SYMBOL_PCT = 10
MAX_BANG_PCT = 10
MAX_DUP_LINE_PCT = 50
WORD_CHARS = (3, 12)
SAMPLE_ROWS = 2000
TIMED_RUNS = 2
LEAST_SECONDS = 1e-3

_POSITION_BITS = 28
_POSITION_MASK = (1 << _POSITION_BITS) - 1


def _equal_neighbours(c: Column, equal: Callable[[Column, Column], Column], position: Callable[[Column], Column]) -> Column:
    """Positions of the elements of a sorted array that equal the one before or after them."""
    pairs = F.zip_with(c, F.slice(c, 2, F.size(c) + 1), lambda a, b: F.when(equal(a, b), F.array(position(a), position(b))))
    return F.array_distinct(F.flatten(F.array_compact(pairs)))


def repeated_words(df: DataFrame, words_column: str, name: str) -> DataFrame:
    """Add the number of words inside 3-word windows that occur twice or more in the row.

    Windows are 64-bit hashes.  Where some hash is repeated, the hash's upper bits
    and the position are packed into one long and sorted, which leaves the few
    positions worth comparing; those are then compared by the whole hash.
    """
    none = F.array().cast("array<bigint>")
    df = df.withColumn("__h", F.transform(words_column, lambda x: F.xxhash64(x)))
    h = F.col("__h")
    pair = F.zip_with(h, F.slice(h, 2, F.size(h) + 1), lambda a, b: F.xxhash64(a, b))
    triple = F.zip_with(pair, F.slice(h, 3, F.size(h) + 1), lambda a, b: F.xxhash64(a, b))
    df = df.withColumn("__w", F.when(F.size(h) < 3, none).otherwise(F.slice(triple, 1, F.greatest(F.size(h) - 2, F.lit(0)))))
    win = F.col("__w")
    packed = F.transform(win, lambda x, i: x.bitwiseAND(F.lit(~_POSITION_MASK)).bitwiseOR(i.cast("bigint")))
    df = df.withColumn("__s", F.when(F.size(F.array_distinct(win)) < F.size(win), F.sort_array(packed)).otherwise(none))
    near = _equal_neighbours(
        F.col("__s"), lambda a, b: F.shiftright(a.bitwiseXOR(b), _POSITION_BITS) == 0, lambda a: a.bitwiseAND(F.lit(_POSITION_MASK)).cast("int"))
    df = df.withColumn("__p", near)
    df = df.withColumn("__s", F.sort_array(F.transform("__p", lambda i: F.struct(F.get(F.col("__w"), i).alias("h"), i.alias("i")))))
    df = df.withColumn("__p", F.sort_array(_equal_neighbours(F.col("__s"), lambda a, b: a["h"] == b["h"], lambda a: a["i"])))
    p = F.col("__p")
    covered = F.aggregate(
        F.zip_with(p, F.slice(p, 2, F.size(p) + 1), lambda a, b: F.coalesce(F.least(b - a, F.lit(3)), F.lit(3)).cast("bigint")),
        F.lit(0).cast("bigint"), lambda total, x: total + x)
    return df.withColumn(name, covered).drop("__h", "__w", "__s", "__p")


def _left_of(text: Column, kept: str) -> Column:
    """How many characters of a text are in the class ``kept``."""
    return F.length(F.regexp_replace(text, f"[^{kept}]+", "")).cast("bigint")


def _lines(df: DataFrame, text: str) -> DataFrame:
    lines = F.filter(F.split(text_of(text), "\n"), lambda line: F.btrim(line, F.lit(WS_CHARS)) != "")
    df = df.withColumn("__lines", lines).withColumn("n_lines", F.size("__lines").cast("bigint"))
    return df.withColumn("n_dup_lines", F.col("n_lines") - F.size(F.array_distinct("__lines"))).drop("__lines")


def _words(df: DataFrame, text: str) -> DataFrame:
    df = df.withColumn("__words", words(text_of(text)))
    return df.withColumns({"n_words": F.size("__words").cast("bigint"), "word_chars": F.length(F.array_join("__words", "")).cast("bigint")})


# Measure: what adds it (with those that come from the same work) to a frame from a text column.
MEASURES: dict[str, Callable[[DataFrame, str], DataFrame]] = {
    "n_words": _words,
    "word_chars": _words,
    "n_symbols": lambda df, text: df.withColumn("n_symbols", _left_of(text_of(text), "#*$%&|<>")),
    "n_bangs": lambda df, text: df.withColumn("n_bangs", _left_of(text_of(text), "!")),
    "n_lines": _lines,
    "n_dup_lines": _lines,
    "n_repeat_words": lambda df, text: repeated_words(df, "__words", "n_repeat_words"),
}


@dataclass(frozen=True)
class Rule:
    """Rejects a row where ``reject``, an SQL condition over the measures ``needs``, holds."""

    name: str
    needs: tuple[str, ...]
    reject: str


BASE_RULES = [
    Rule("few_words", ("n_words",), f"n_words < {MIN_WORDS}"),
    Rule("repeats", ("n_words", "n_repeat_words"), f"100 * n_repeat_words > {MAX_REPEAT_PCT} * n_words"),
]
MORE_RULES = [
    Rule("symbols", ("n_words", "n_symbols"), f"100 * n_symbols > {MAX_SYMBOL_PCT} * n_words"),
    Rule("exclamations", ("n_words", "n_bangs"), f"100 * n_bangs > {MAX_BANG_PCT} * n_words"),
    Rule("duplicate_lines", ("n_lines", "n_dup_lines"), f"100 * n_dup_lines > {MAX_DUP_LINE_PCT} * n_lines"),
    Rule("word_length", ("n_words", "word_chars"), f"word_chars < {WORD_CHARS[0]} * n_words OR word_chars > {WORD_CHARS[1]} * n_words"),
]


def _with_measures(df: DataFrame, rule: Rule, text: str) -> DataFrame:
    for name in rule.needs:
        if name not in df.columns:
            df = MEASURES[name](df, text)
    return df


def _rejections(sample: DataFrame, rules: Sequence[Rule], present: Sequence[str]) -> dict[tuple[bool, ...], int]:
    """How many rows of the sample each set of rules rejects: at most one row for each set."""
    measured = _with_measures(sample, Rule("all", tuple(dict.fromkeys([*present, *(m for r in rules for m in r.needs)])), "false"), "text")
    flags = [F.coalesce(F.expr(r.reject), F.lit(False)).alias(f"r{k}") for k, r in enumerate(rules)]
    found = measured.select(*flags).groupBy(*[f"r{k}" for k in range(len(rules))]).count().collect() if rules else []
    return {tuple(row[:-1]): row[-1] for row in found}


def _costs(sample: DataFrame, rules: Sequence[Rule], present: Sequence[str]) -> dict[Callable, float]:
    """Seconds on the sample of each piece of work that rules ask for, beyond reading it and what it builds on."""
    timed: dict[tuple[str, ...], float] = {}

    def seconds(names: tuple[str, ...]) -> float:
        if names not in timed:
            frame = _with_measures(sample, Rule("some", names, "false"), "text")
            job = frame.agg(F.sum(F.length("text")), *[F.sum(n) for n in names])
            runs = []
            for _ in range(TIMED_RUNS):
                started = time.perf_counter()
                job.collect()
                runs.append(time.perf_counter() - started)
            timed[names] = min(runs)
        return timed[names]

    out: dict[Callable, float] = {}
    for rule in rules:
        before: tuple[str, ...] = ()
        for name in rule.needs:
            work = MEASURES[name]
            if work not in out and all(MEASURES[p] is not work for p in present):
                out[work] = max(seconds((*before, name)) - seconds(before), LEAST_SECONDS)
            before = (*before, name)
    return out


def order_by_worth(
    df: DataFrame, rules: Sequence[Rule], text: str = "text", present: Sequence[str] = (), sample_rows: int = SAMPLE_ROWS
) -> list[Rule]:
    """The rules by rejection per cost on a sample of about ``sample_rows`` rows, each on what those before it leave.

    A rule's cost is that of the work for its measures that no rule before it has paid for; measures
    named in ``present`` are known before the cascade starts.  The work is timed several times and
    what a job costs without it is taken off.
    """
    share = min(1.0, sample_rows / max(df.count(), 1))
    sample = materialise(df.select(F.col(text).alias("text")).sample(False, share, 17))
    left, cost = _rejections(sample, rules, present), _costs(sample, rules, present)
    order, rest, paid = [], list(range(len(rules))), set()
    while rest:
        price = {k: sum(cost[w] for w in {MEASURES[n] for n in rules[k].needs} if w in cost and w not in paid) + LEAST_SECONDS for k in rest}
        best = max(rest, key=lambda k: (sum(n for flags, n in left.items() if flags[k]) / price[k], -price[k], -k))
        order.append(rules[best])
        rest.remove(best)
        paid |= {MEASURES[n] for n in rules[best].needs}
        left = {flags: n for flags, n in left.items() if not flags[best]}
    return order


def cascade(df: DataFrame, rules: Sequence[Rule], text: str = "text", rejected: Column | None = None, present: Sequence[str] = ()) -> DataFrame:
    """Add the measures asked for and ``rejected_by``: the first rule in the given order that rejects the row, or null.

    ``rejected`` names a reason that is already known; such rows skip every rule.  ``present`` names columns
    that are measures; any other column keeps its value, even if it has the name of one.
    A measure is worked out when the first rule asks for it, and only for rows still alive.
    """
    own = {c: f"__own_{c}" for c in df.columns if c in MEASURES and c not in present}
    df = df.withColumn("__by", (rejected if rejected is not None else F.lit(None)).cast("string")).withColumnsRenamed(own)
    text = own.get(text, text)
    for rule in rules:
        if any(name not in df.columns for name in rule.needs):
            df = _with_measures(df.withColumn("__t", F.when(F.col("__by").isNull(), text_of(text))), rule, "__t").drop("__t")
        df = df.withColumn("__by", F.when(F.col("__by").isNull() & F.expr(rule.reject), F.lit(rule.name)).otherwise(F.col("__by")))
    return df.drop(*own).withColumnsRenamed({v: k for k, v in own.items()}).withColumnRenamed("__by", "rejected_by")


def base_measures(df: DataFrame, text: str = "text") -> DataFrame:
    """Add ``n_words word_chars n_symbols n_lines n_dup_lines n_repeat_words base_failed`` for every row."""
    for name in ("n_words", "n_symbols", "n_lines", "n_repeat_words"):
        df = MEASURES[name](df, text)
    return df.withColumn("base_failed", F.expr(" OR ".join(rule.reject for rule in BASE_RULES)))


@query(r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws,
             list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d),
win AS (SELECT doc_id, i, ws[i] AS a, ws[i + 1] AS b, ws[i + 2] AS c FROM (SELECT doc_id, ws, unnest(generate_series(1, len(ws) - 2)) AS i FROM w)),
rep AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, a, b, c) AS n FROM win) WHERE n > 1),
cov AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM rep) GROUP BY doc_id),
m AS (SELECT w.doc_id, len(ws) AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g')) AS word_chars,
             length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g')) AS n_symbols, length(regexp_replace(text, '[^!]+', '', 'g')) AS n_bangs,
             len(lines) AS n_lines, len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(cov.n, 0) AS n_repeat_words
      FROM w LEFT JOIN cov USING (doc_id)),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND NOT (100 * n_symbols > 10 * n_words OR 100 * n_bangs > 10 * n_words OR 100 * n_dup_lines > 50 * n_lines
                                OR word_chars < 3 * n_words OR word_chars > 12 * n_words) AS kept
FROM b
""")
def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measures and verdict of every document; rules other than the base ones in measured order."""
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    known = ["n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines"]
    rules = order_by_worth(documents, MORE_RULES, present=known)
    judged = cascade(base_measures(documents), rules, rejected=F.when(F.col("base_failed"), F.lit("base")), present=[*known, "n_repeat_words"])
    return judged.select("doc_id", *known[:3], "n_dup_lines", "n_repeat_words", "base_failed", F.col("rejected_by").isNull().alias("kept"))


def keep_good(documents: DataFrame, text: str = "text") -> DataFrame:
    """The rows that no rule rejects, with their own columns only."""
    own = documents.columns
    renamed = documents.select(F.struct(*[F.col(f"`{c}`") for c in own]).alias("__row"), F.col(text).alias("__text"))
    rules = order_by_worth(renamed, [*BASE_RULES, *MORE_RULES], "__text")
    # Written before it is filtered: a filter on the verdict would be pushed into every step of the cascade.
    judged = materialise(cascade(renamed, rules, "__text").select("__row", "rejected_by"))
    return judged.where("rejected_by IS NULL").select("__row.*")
