"""Line deduplication by a tree of log templates, in DataFrame functions only.

The tree has a fixed depth: lines part by their number of tokens, then by their first
``DEPTH`` tokens with digits generalised.  In each leaf, a token that lines of two
documents have at the same place is constant there; any other is a variable field and
becomes ``<*>``.  Lines of one template are the same line.  A template that recurs
across documents stays in the first document that has it and is dropped from the others.

``deduplicated`` also finds fields whose values recur (``by_share``): a token counts by
the distinct lines of its leaf that have it at its place, and is constant only if at
least ``SHARE_PCT`` percent as many have it as have each of ``CONSTANT_PCT`` percent of
its line's tokens.
Copies of a line are one distinct line, so copied documents make no field constant, and
a line is measured by its own tokens, so other templates of a leaf do not matter.

Lines of fewer than ``MIN_TOKENS`` tokens are never dropped; a template with variable
fields needs ``MIN_CONSTANT`` constant tokens and ``CONSTANT_PCT`` percent of them, so
that short lines that merely begin alike stay apart.

Only leaves that documents share are looked at token by token.  Documents, lines and
templates are only grouped, joined and aggregated; nothing is gathered but the dropped
line numbers of one document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foldwise.llm.common import WS_CHARS, materialise, table, text_of
from foldwise.llm.registry import query
from foldwise.session import bounded

DEPTH = 4
MIN_TOKENS = 5
MIN_CONSTANT = 8
CONSTANT_PCT = 70
SHARE_PCT = 90


def _name(id_column: str, text: str) -> Column:
    """What names a row and orders rows: the id, nulls last, then a hash of the text."""
    return F.struct(F.col(id_column).isNull().alias("absent"), F.col(id_column).alias("id"), F.xxhash64(text_of(text)).alias("key"))


def n_tokens(body: Column) -> Column:
    """How many tokens single spaces part a line into, once white space at its ends is gone."""
    return F.octet_length(body) - F.octet_length(F.replace(body, F.lit(" "), F.lit(""))) + 1


def _lines(documents: DataFrame, id_column: str, text: str) -> DataFrame:
    """``doc, pos, line, leaf, lh`` for every line that may be dropped: trimmed, with its leaf and its hash."""
    lines = documents.select(_name(id_column, text).alias("doc"), F.posexplode(F.split(text_of(text), "\n")).alias("pos", "line"))
    lines = lines.withColumn("line", F.btrim("line", F.lit(WS_CHARS))).withColumn("n", n_tokens(F.col("line"))).where(F.col("n") >= MIN_TOKENS)
    lead = F.regexp_replace(F.substring_index("line", " ", DEPTH), "[0-9]+", "#")
    return lines.select("doc", "pos", "line", F.xxhash64("n", lead).alias("leaf"), F.xxhash64("line").alias("lh"))


def _by_share(placed: DataFrame) -> DataFrame:
    """``lh, kept, shared``: the tokens of each line that are constant by their count of lines, and those that two documents have."""
    found = placed.groupBy("k").agg(F.count("*").alias("lines"), (F.min("low") != F.max("high")).alias("both")).where("lines > 1 OR both")
    tokens = placed.select("k", "lh").join(found, "k", "left")
    tokens = tokens.select("lh", F.struct(F.coalesce("lines", F.lit(1)).alias("lines"), "k", F.coalesce("both", F.lit(False)).alias("both")).alias("t"))
    # Most common tokens first, so that the last of CONSTANT_PCT percent has the count to hold the others against.
    line = tokens.groupBy("lh").agg(F.sort_array(F.collect_list("t"), asc=False).alias("ts"))
    line = line.withColumn("usual", F.get("ts", F.ceil(F.size("ts") * CONSTANT_PCT / 100).cast("int") - 1)["lines"])

    def named(flag) -> Column:
        return F.sort_array(F.transform(F.filter("ts", flag), lambda t: t["k"]))

    return line.select("lh", named(lambda t: 100 * t["lines"] >= SHARE_PCT * F.col("usual")).alias("kept"), named(lambda t: t["both"]).alias("shared"))


def dropped_lines(documents: DataFrame, id_column: str = "doc_id", text: str = "text", by_share: bool = False) -> DataFrame:
    """``doc, pos`` (from 0) of every line whose template an earlier document has.

    ``by_share`` also takes values that recur for fields; without it the SQL of ``op2_line_dedup`` holds.
    """
    lines = _lines(documents, id_column, text)
    found = materialise(lines.drop("line"))
    distinct = materialise(found.groupBy("leaf", "lh").agg(F.min("doc").alias("first"), F.max("doc").alias("last")))
    leaves = distinct.groupBy("leaf").agg(F.min("first").alias("a"), F.max("last").alias("b")).where("a <> b").select("leaf")
    leaves = bounded(materialise(leaves))
    # The text of each distinct line of a shared leaf, with one of its documents at either end.
    texts = lines.select("leaf", "lh", "line").join(leaves, "leaf", "left_semi").groupBy("lh").agg(F.first("line").alias("line"))
    ends = distinct.join(leaves, "leaf", "left_semi")
    known = materialise(texts.join(ends, "lh"))
    low, high = F.least(F.xxhash64("first"), F.xxhash64("last")), F.greatest(F.xxhash64("first"), F.xxhash64("last"))
    placed = known.select("lh", "leaf", low.alias("low"), high.alias("high"), F.posexplode(F.split("line", " ")).alias("at", "token"))
    placed = placed.select("lh", "low", "high", F.xxhash64("leaf", "at", "token").alias("k"))  # a token at its place
    # The constant tokens of a line with their places are its template; what is missing is a variable field.
    if by_share:
        marked = _by_share(placed)
    else:
        constant = placed.groupBy("k").agg(F.min("low").alias("a"), F.max("high").alias("b")).where("a <> b").select("k")
        marked = placed.select("k", "lh").join(constant, "k").groupBy("lh").agg(F.sort_array(F.collect_list("k")).alias("kept"))
    known = known.select("lh", "leaf", "first", "last", F.size(F.split("line", " ")).alias("n")).join(marked, "lh")

    def enough(kept: str) -> Column:
        fields = (F.size(kept) >= MIN_CONSTANT) & (100 * F.size(kept) >= CONSTANT_PCT * F.col("n"))
        return (F.size(kept) == F.col("n")) | fields

    # A line of too few constant tokens is its own template.
    template = F.when(enough("kept"), F.xxhash64("leaf", "kept"))
    if by_share:
        template = template.when(enough("shared"), F.xxhash64("leaf", "shared"))
    template = template.otherwise(F.xxhash64(F.lit("own"), "lh"))
    known = materialise(known.select("lh", "first", "last", template.alias("template")))
    recurring = known.groupBy("template").agg(F.min("first").alias("owner"), F.max("last").alias("z")).where("owner <> z")
    decided = bounded(materialise(known.join(recurring, "template").select("lh", "owner")))
    return found.join(decided, "lh").where("doc <> owner").select("doc", "pos").distinct()


def without_repeats(documents: DataFrame, id_column: str = "doc_id", text: str = "text", by_share: bool = False) -> DataFrame:
    """``row`` (the document as it was), ``n_lines``, ``n_dropped`` and ``text``, what is left of it.

    Defined cases: a null text counts as one empty line and stays null; rows with the
    same id and text are one document, so their lines are kept or dropped alike; a
    null id comes after all others; extra columns stay inside ``row``.
    """
    drops = dropped_lines(documents, id_column, text, by_share).groupBy("doc").agg(F.array_sort(F.collect_list("pos")).alias("drops"))
    drops = materialise(drops.select(F.col("doc.id").alias("__id"), F.col("doc.key").alias("__key"), "drops"))
    packed = documents.select(F.struct(*[F.col(f"`{c}`") for c in documents.columns]).alias("row"), _name(id_column, text).alias("doc"), F.col(text).alias("text"))
    packed = packed.select("row", "text", F.col("doc.id").alias("id"), F.col("doc.key").alias("key"))
    joined = packed.join(drops, (F.col("key") == F.col("__key")) & F.col("id").eqNullSafe(F.col("__id")), "left")
    lines = F.split(F.coalesce("text", F.lit("")), "\n")
    joined = joined.withColumn("lines", F.when(F.col("drops").isNotNull(), lines))
    left = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), "drops")
    kept = F.array_join(F.transform(left, lambda i: F.get("lines", i)), "\n")
    return joined.select(
        "row", F.size(lines).cast("long").alias("n_lines"), F.coalesce(F.size("drops"), F.lit(0)).cast("long").alias("n_dropped"),
        F.when(F.col("drops").isNull(), F.col("text")).otherwise(kept).alias("text"))


def deduplicated(documents: DataFrame, id_column: str = "doc_id", text: str = "text", length: str | None = "n_chars") -> DataFrame:
    """Documents with repeated lines taken out, in their own columns; one left without any word goes.

    ``length``, if there is such a column, becomes the new length of a changed text.

    Defined cases: a text from which nothing is dropped stays as it was, also a null, empty or blank one; rows with the
    same id and text lose the same lines; a null id comes after all others, so it loses its line to any other
    document; extra columns come back as they were; an empty table gives an empty result.
    """
    found = without_repeats(documents, id_column, text, by_share=True)
    changed = F.col("n_dropped") > 0
    found = found.where(~changed | (F.btrim("text", F.lit(WS_CHARS)) != ""))

    def value(c: str) -> Column:
        if c == text:
            return F.col("text").alias(c)
        if c == length:
            return F.when(changed, F.length("text")).otherwise(F.col(f"row.`{c}`")).cast(documents.schema[c].dataType).alias(c)
        return F.col(f"row.`{c}`").alias(c)

    return found.select(*[value(c) for c in documents.columns])


@query(r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l AS (SELECT doc_id, unnest(generate_series(0, len(ls) - 1)) AS pos, trim(unnest(ls), chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS line FROM d),
t AS (SELECT *, string_split(line, ' ') AS ts FROM l),
f AS (SELECT *, len(ts) || ' ' || array_to_string(list_transform(ts[1:4], lambda x: regexp_replace(x, '[0-9]+', '#', 'g')), ' ') AS leaf FROM t WHERE len(ts) >= 5),
u AS (SELECT leaf, line, any_value(ts) AS ts, min(doc_id) AS first, max(doc_id) AS last FROM f GROUP BY leaf, line),
p AS (SELECT leaf, line, first, last, unnest(generate_series(1, len(ts))) AS place, unnest(ts) AS token FROM u),
c AS (SELECT leaf, line, place, token, min(first) OVER w <> max(last) OVER w AS constant FROM p WINDOW w AS (PARTITION BY leaf, place, token)),
m AS (SELECT leaf, line, count(*) AS n, count(*) FILTER (constant) AS k,
             string_agg(CASE WHEN constant THEN token ELSE '<*>' END, ' ' ORDER BY place) AS masked FROM c GROUP BY leaf, line),
k AS (SELECT u.leaf, u.line, u.first, u.last,
             CASE WHEN k = n OR (k >= 8 AND 100 * k >= 70 * n) THEN masked ELSE 'own ' || u.line END AS template FROM u JOIN m USING (leaf, line)),
r AS (SELECT leaf, line, min(first) OVER w AS owner, max(last) OVER w AS z FROM k WINDOW w AS (PARTITION BY leaf, template)),
x AS (SELECT f.doc_id, f.pos FROM f JOIN r USING (leaf, line) WHERE r.owner <> r.z AND f.doc_id <> r.owner),
g AS (SELECT doc_id, list(pos) AS drops FROM x GROUP BY doc_id)
SELECT d.doc_id, len(ls) AS n_lines, coalesce(len(drops), 0) AS n_dropped,
       sha256(CASE WHEN drops IS NULL THEN text ELSE coalesce(array_to_string(list_filter(ls, lambda y, i: NOT list_contains(drops, i - 1)), chr(10)), '') END) AS text_sha256
FROM d LEFT JOIN g USING (doc_id)
""")
def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's number of lines, how many recur from earlier documents, and a digest of the rest."""
    found = without_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select(F.col("row.doc_id").alias("doc_id"), "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"))
