"""Mixing documents to target weights by iterative proportional fitting, in DataFrame functions only.

Documents fall into cells of source, language and topic.  Each round scales the
tokens of the cells so that the totals by source match their targets, then those by
language, then those by topic; rounds go on until all three do, up to ``RESIDUAL``.  A
cell's weight is its fitted share of tokens over its actual one.  A document is taken with
probability ``min(1, rate * weight)``, decided by a hash of its id and text, so a rerun or a
retried task takes the same documents.  That alone leaves cells of a weight above 1 short;
with ``copies`` a document comes ``rate * weight`` times on average, the whole part of it
always and the rest by the same draw, and the tokens taken follow the targets.

Texts are read once for tokens and topics.  What is fitted is the table of cells: one
row for each combination that occurs.
"""

from __future__ import annotations

import warnings
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from foldwise.llm.common import materialise, table, text_of, words
from foldwise.llm.registry import query

MARGINS = ("source", "lang", "topic")
POWER = 0.9  # a margin's target share is its actual share to this power
ROUNDS = 8
ROUNDS_A_JOB = 4
RESIDUAL = 1e-4  # rounds go on while a margin's total is further from its target than this share of it
RATE = 1.0
SEED = "mix-1"
LONG_CHARS = 5000


def topic_of(text: Column) -> Column:
    """A coarse topic from the text: notices, contacts, tables, long reads or short prose."""
    lower = F.lower(text)
    return (
        F.when(lower.contains("license") | lower.contains("rights reserved"), "notice")
        .when(text.contains("@"), "contact").when(text.contains(" | "), "table")
        .when(F.length(text) >= LONG_CHARS, "long").otherwise("short"))


def _draw(id_column: str, text: str) -> Column:
    """A number in [0, 1) that depends on the row's id and text only."""
    named = F.concat(F.lit(SEED), F.coalesce(F.col(id_column).cast("string"), F.lit("")), F.lit(":"), text_of(text))
    return F.conv(F.substring(F.md5(named), 1, 12), 16, 10).cast("double") / float(1 << 48)


def power_targets(cells: DataFrame, margins: Sequence[str] = MARGINS, power: float = POWER) -> DataFrame:
    """Add ``target_<margin>``: the tokens each margin should have, its actual share raised to ``power`` and rescaled."""
    total = cells.agg(F.sum("tokens")).first()[0] or 0
    for m in margins:
        sums = cells.groupBy(F.col(m).alias("m")).agg(F.pow(F.sum("tokens"), F.lit(power)).alias("p"))
        whole = sums.agg(F.sum("p")).first()[0] or 1.0
        share = sums.select("m", (F.col("p") / F.lit(float(whole)) * F.lit(float(total))).alias(f"target_{m}"))
        cells = cells.join(share, cells[m].eqNullSafe(F.col("m"))).drop("m")
    return cells


def residual(cells: DataFrame, margins: Sequence[str] = MARGINS) -> float:
    """The largest distance of a margin's fitted total from its target, as a share of the target."""
    off = [F.abs(F.sum("fitted").over(Window.partitionBy(m)) / F.nullif(F.col(f"target_{m}"), F.lit(0.0)) - 1).alias(f"off_{m}") for m in margins]
    largest = cells.select(*off).agg(*[F.max(f"off_{m}") for m in margins]).first()
    return max((x for x in largest if x is not None), default=0.0)


def raked(cells: DataFrame, margins: Sequence[str] = MARGINS, rounds: int = ROUNDS) -> DataFrame:
    """Add ``fitted``, the tokens of each cell after raking to its ``target_`` columns, and ``weight``.

    After ``rounds`` rounds, more follow until the residual is within ``RESIDUAL``, or, where the
    cells that occur cannot meet all targets, until it no longer falls; then a warning gives it.
    Cells without tokens keep none.  A margin without a target (null) keeps its tokens.
    """
    fitted = materialise(cells.withColumn("fitted", F.col("tokens").cast("double")))

    def once(fitted: DataFrame) -> DataFrame:
        for m in margins:
            now = F.sum("fitted").over(Window.partitionBy(m))
            factor = F.when(now > 0, F.coalesce(F.col(f"target_{m}") / now, F.lit(1.0))).otherwise(0.0)
            fitted = fitted.withColumn("fitted", F.col("fitted") * factor)
        return fitted

    for k in range(rounds):
        fitted = once(fitted)
        if (k + 1) % ROUNDS_A_JOB == 0:
            fitted = materialise(fitted)
    left, before = residual(fitted, margins), float("inf")
    while RESIDUAL < left < 0.99 * before:
        for _ in range(ROUNDS_A_JOB):
            fitted = once(fitted)
        fitted = materialise(fitted)
        left, before = residual(fitted, margins), left
    if left > RESIDUAL:
        warnings.warn(f"the cells cannot meet all targets: a margin is off by {left:.2%}", stacklevel=2)
    return fitted.withColumn("weight", F.when(F.col("tokens") > 0, F.round(F.col("fitted") / F.col("tokens"), 6)).otherwise(1.0))


def _measured(documents: DataFrame, id_column: str, text: str, topic: Column | None) -> DataFrame:
    t = text_of(text)
    return documents.select(
        F.col(id_column).alias("id"), "source", "lang", (topic if topic is not None else topic_of(t)).alias("topic"),
        F.size(words(t)).cast("long").alias("n_tokens"), _draw(id_column, text).alias("u"))


def _weights(measured: DataFrame, power: float) -> DataFrame:
    cells = materialise(measured.groupBy(*MARGINS).agg(F.sum("n_tokens").alias("tokens")))
    return materialise(raked(power_targets(cells, power=power)).select(*[F.col(m).alias(f"of_{m}") for m in MARGINS], "weight"))


def _of_cell(df: DataFrame, weights: DataFrame) -> DataFrame:
    """Join the cells' weights; they are written, so they are sent to all tasks only if known to be small."""
    same = F.lit(True)
    for m in MARGINS:
        same = same & df[m].eqNullSafe(weights[f"of_{m}"])
    return df.join(weights, same).drop(*[f"of_{m}" for m in MARGINS])


def chosen(rate: float = RATE) -> Column:
    return F.col("u") < F.least(F.lit(1.0), F.lit(rate) * F.col("weight"))


def n_copies(rate: float = RATE) -> Column:
    """How often the mix has a row: ``rate * weight`` on average; at least once just where ``chosen``."""
    often = F.lit(rate) * F.col("weight")
    return (F.floor(often) + (F.col("u") < often - F.floor(often)).cast("int")).cast("int")


def weighted(documents: DataFrame, id_column: str = "doc_id", text: str = "text", topic: Column | None = None, power: float = POWER, rate: float = RATE) -> DataFrame:
    """``id, source, lang, topic, n_tokens, weight, kept, copies`` for every row.

    ``copies`` tells how often the calibrated mix has the row, ``rate * weight`` times on average, so that
    the tokens of all copies follow the targets; ``kept`` tells whether the mix has it at all.

    Defined cases: a null text has no tokens and the topic of an empty one; a null
    source or language is a margin value of its own; equal rows share their draw, so
    they are taken or left together; other columns are ignored; an empty table
    gives an empty result.
    """
    measured = materialise(_measured(documents, id_column, text, topic))
    return _of_cell(measured, _weights(measured, power)).withColumn("kept", chosen(rate)).withColumn("copies", n_copies(rate)).drop("u")


def sampled(documents: DataFrame, id_column: str = "doc_id", text: str = "text", topic: Column | None = None, power: float = POWER, rate: float = RATE, copies: bool = False) -> DataFrame:
    """The rows that the mix takes, with their own columns; with ``copies``, each as often as its weight asks.

    Defined cases: as for ``weighted``; a null text has no tokens, so a cell of such rows only has weight 1 and
    they all stay; copies of a row are equal rows; columns of any name come back as they were; an empty
    table gives an empty result.
    """
    weights = _weights(_measured(documents, id_column, text, topic), power)
    t = text_of(text)
    packed = documents.select(
        F.struct(*[F.col(f"`{c}`") for c in documents.columns]).alias("row"), F.col("source"), F.col("lang"),
        (topic if topic is not None else topic_of(t)).alias("topic"), _draw(id_column, text).alias("u"))
    taken = _of_cell(packed, weights).where(chosen(rate))
    if copies:
        taken = taken.select("row", F.explode(F.sequence(F.lit(1), n_copies(rate))).alias("copy"))
    return taken.select("row.*")


def _sql() -> str:
    steps, last = [], "t0"
    for k in range(ROUNDS):
        for m in MARGINS:
            name = f"r{k}_{m}"
            steps.append(f"{name} AS (SELECT * REPLACE (CASE WHEN sum(fitted) OVER w > 0 THEN fitted * (target_{m} / sum(fitted) OVER w) ELSE 0 END AS fitted) FROM {last} WINDOW w AS (PARTITION BY {m}))")
            last = name
    targets = ", ".join(f"pow(sum(tokens) OVER (PARTITION BY {m}), {POWER}) AS p_{m}" for m in MARGINS)
    wholes = ", ".join(f"(SELECT sum(p) FROM (SELECT pow(sum(tokens), {POWER}) AS p FROM c GROUP BY {m})) AS w_{m}" for m in MARGINS)
    scaled = ", ".join(f"p_{m} / w_{m} * whole AS target_{m}" for m in MARGINS)
    return f"""
WITH d AS (SELECT doc_id, source, lang, coalesce(text, '') AS text FROM documents),
n AS (SELECT doc_id, source, lang, len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')) AS n_tokens,
             CASE WHEN contains(lower(text), 'license') OR contains(lower(text), 'rights reserved') THEN 'notice' WHEN contains(text, '@') THEN 'contact'
                  WHEN contains(text, ' | ') THEN 'table' WHEN length(text) >= {LONG_CHARS} THEN 'long' ELSE 'short' END AS topic,
             ('0x' || substr(md5('{SEED}' || coalesce(doc_id::VARCHAR, '') || ':' || text), 1, 12))::BIGINT::DOUBLE / {float(1 << 48)} AS u FROM d),
c AS (SELECT source, lang, topic, sum(n_tokens)::DOUBLE AS tokens FROM n GROUP BY ALL),
s AS (SELECT *, {targets}, (SELECT sum(tokens) FROM c) AS whole, {wholes} FROM c),
t0 AS (SELECT source, lang, topic, tokens, tokens AS fitted, {scaled} FROM s),
{", ".join(steps)},
w AS (SELECT source, lang, topic, CASE WHEN tokens > 0 THEN round(fitted / tokens, 6) ELSE 1.0 END AS weight FROM {last})
SELECT doc_id, n.source, n.lang, n.topic, n_tokens, weight, u < least(1.0, {RATE} * weight) AS kept,
  (floor({RATE} * weight) + (u < {RATE} * weight - floor({RATE} * weight))::INTEGER)::INTEGER AS copies
FROM n JOIN w ON n.source IS NOT DISTINCT FROM w.source AND n.lang IS NOT DISTINCT FROM w.lang AND n.topic = w.topic
"""


@query(_sql())
def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weight of every document after raking to source, language and topic targets, whether the mix takes it, and how often."""
    found = weighted(table(spark, sf_dir, "documents").select("doc_id", "text", "source", "lang"))
    return found.withColumnRenamed("id", "doc_id").select("doc_id", *MARGINS, "n_tokens", "weight", "kept", "copies")
