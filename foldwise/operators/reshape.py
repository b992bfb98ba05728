"""Wide/long reshaping, label parsing and pooling."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foldwise.functions.columns import clean
from foldwise.session import bounded

# The 2x2 design (first factor, second factor, interaction).
FACTORIAL = {"C": (0, 0, 0), "T1": (1, 0, 0), "T2": (0, 1, 0), "T12": (1, 1, 1)}


def lookup(mapping: Mapping[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for pair in mapping.items() for x in pair])


def canonicalise(df: DataFrame, column: str, mapping: Mapping[str, str], default: str | None = None) -> DataFrame:
    """Replace codes by canonical names; unknown codes stay, or become ``default``."""
    fallback = F.col(column) if default is None else F.lit(default)
    return df.withColumn(column, F.coalesce(lookup(mapping)[F.col(column)], fallback))


def unpivot_matrix(wide: DataFrame, ids: Sequence[str], pattern: str, names: Sequence[str], value: str = "value") -> DataFrame:
    """Wide matrix to long rows; columns matching ``pattern`` become rows, its groups become ``names``."""
    columns = [c for c in wide.columns if c not in ids and re.fullmatch(pattern, c)]
    long = wide.unpivot(list(ids), columns, "_column", value)
    parts = {n: F.regexp_extract("_column", f"^(?:{pattern})$", k + 1) for k, n in enumerate(names)}
    return long.withColumns({**parts, value: clean(F.col(value))}).drop("_column")


def widen(df: DataFrame, rows: Sequence[str], column: str, values: Sequence[str], agg: Column) -> DataFrame:
    """Long to wide over an explicit list of columns (one aggregation, no extra pass for the values)."""
    return df.groupBy(*rows).pivot(column, list(values)).agg(agg)


def densify(df: DataFrame, keys: Sequence[str], domains: Mapping[str, Sequence], fill: Mapping[str, object]) -> DataFrame:
    """One row per key and combination of the (literal) domain values; gaps take ``fill``."""
    grid = df.select(*keys).distinct()
    for name, values in domains.items():
        grid = grid.withColumn(name, F.explode(F.array(*[F.lit(v) for v in values])))
    full = grid.join(df, [*keys, *domains], "left")
    return full.fillna(dict(fill))


def melt_cells(wide: DataFrame, ids: Sequence[str], values: Sequence[str], masks: Sequence[str], key: str = "column") -> DataFrame:
    """Cells of a wide table as rows, dropping cells whose mask column is not true."""
    cells = F.array(*[
        F.struct(F.lit(v).alias(key), F.col(v).cast("double").alias("value"), F.col(m).alias("_keep")) for v, m in zip(values, masks)
    ])
    return (wide.select(*ids, F.explode(cells).alias("_cell")).where("_cell._keep")
            .select(*ids, F.col(f"_cell.{key}").alias(key), F.col("_cell.value").alias("value")))


def factorial_columns(df: DataFrame, condition: str = "condition", design: Mapping[str, Sequence[int]] = FACTORIAL) -> DataFrame:
    """Indicator columns of the 2x2 design."""
    def indicator(k: int) -> Column:
        return F.when(F.col(condition).isin(*[c for c, v in design.items() if v[k]]), 1.0).otherwise(0.0)
    return df.withColumns({"first": indicator(0), "second": indicator(1), "both": indicator(2)})


def parse_sample_id(column: Column, sep: str = "_") -> Column:
    """struct<gender, timepoint, condition>; anything but three parts is an error."""
    parts = F.split(column, sep)
    bad = F.concat(F.lit("unexpected sample id: "), column)
    return F.when(F.size(parts) == 3, F.struct(
        parts[0].alias("gender"), parts[1].alias("timepoint"), parts[2].alias("condition"),
    )).otherwise(F.raise_error(bad))


def comparison_name(group: Column, timepoint: Column, condition: Column, control: str, pct: float) -> Column:
    """Title of a comparison; '/' is not allowed in a file name and becomes '_'."""
    side = lambda c: F.concat_ws("_", group, timepoint, c)
    title = F.concat(side(F.lit(control)), F.lit("_vs_"), side(condition), F.lit(f"_pct{pct:g}"))
    return F.replace(title, F.lit("/"), F.lit("_"))


def short_label(gender: Column, condition: Column, timepoint: Column, names: Mapping[str, str]) -> Column:
    return F.concat_ws(" ", F.coalesce(lookup(names)[gender], gender), condition, timepoint)


def parse_comparison(column: Column, groups: Sequence[str], timepoints: Sequence[str], conditions: Sequence[str]) -> Column:
    """Keys out of a title.  Alternatives are tried longest first, so 'T12' is not read as 'T1'."""
    def one_of(values: Sequence[str]) -> str:
        return "(" + "|".join(sorted(values, key=lambda v: (-len(v), v))) + ")"
    pattern = f"_vs_{one_of(groups)}_{one_of(timepoints)}_{one_of(conditions)}_pct([0-9.]+)$"
    part = lambda k: F.regexp_extract(column, pattern, k)
    return F.struct(part(1).alias("grp"), part(2).alias("timepoint"), part(3).alias("condition"),
                    part(4).try_cast("double").alias("pct"))


def pool_labels(df: DataFrame, keys: Sequence[str], label: str, mapping: Mapping[str, str], value: str, default: str | None = None) -> DataFrame:
    """Sum ``value`` over labels that share a pooled name."""
    return canonicalise(df, label, mapping, default).groupBy(*keys, label).agg(F.sum(value).alias(value))


def match_prefix(label: Column, mapping: Mapping[str, str], default: str = "Other") -> Column:
    """Split a label into the longest known prefix and a numeric suffix.

    Candidates are the label with 0, 1, 2 ... trailing digits taken off, so the
    lookup is row-local.  An unknown label loses all trailing digits and pools
    under ``default`` with ``known`` false.
    """
    digits = F.length(F.regexp_extract(label, "([0-9]*)$", 1))
    size = F.length(label)
    cuts = F.transform(F.sequence(F.lit(0), digits), lambda d: F.struct(
        lookup(mapping)[F.substring(label, F.lit(1), size - d)].alias("pooled"),
        F.substring(label, F.lit(1), size - d).alias("prefix"),
        F.substring(label, size - d + 1, d).alias("suffix"),
    ))
    hit = F.get(F.filter(cuts, lambda c: c["pooled"].isNotNull()), F.lit(0))
    # The unknown case keeps at least one character before the digits.
    cut = F.least(digits, size - 1)
    prefix = F.substring(label, F.lit(1), size - cut)
    suffix = F.substring(label, size - cut + 1, cut)
    number = lambda text: F.coalesce(F.when(text != "", text).try_cast("long"), F.lit(0).cast("long"))
    return F.when(hit.isNotNull(), F.struct(
        hit["pooled"].alias("pooled"), hit["prefix"].alias("prefix"), number(hit["suffix"]).alias("number"), F.lit(True).alias("known"),
    )).otherwise(F.struct(F.lit(default).alias("pooled"), prefix.alias("prefix"), number(suffix).alias("number"), F.lit(False).alias("known")))


def explode_list(df: DataFrame, keys: Sequence[str], column: str, name: str) -> DataFrame:
    """Distinct items of a list kept as text, such as ``['a', 'b']``."""
    quoted = F.replace(F.col(column), F.lit("'"), F.lit('"'))
    items = F.from_json(quoted, "array<string>")
    return df.select(*keys, F.explode(F.array_distinct(items)).alias(name)).distinct()


def composite_id(core: Column, pattern: str, *extra: Column) -> Column:
    """The pattern's first group joined with further parts."""
    return F.concat_ws("_", F.regexp_extract(core, pattern, 1), *extra)


def label_flag(label: Column, needle: str, yes: str, no: str) -> Column:
    return F.when(F.contains(label, F.lit(needle)), yes).otherwise(no)


def renormalise(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Shares within ``keys``; a total of zero or less is an error."""
    totals = df.groupBy(*keys).agg(F.sum(value).alias("_total"))
    checked = F.when(F.col("_total") > 0, F.col(value) / F.col("_total")).otherwise(
        F.raise_error(F.lit("fractions of a sample do not have a positive total")))
    return df.join(bounded(totals), list(keys)).withColumn(value, checked).drop("_total")


def contributions(predicted: DataFrame, fractions: DataFrame, observed: DataFrame | None = None, tiny: float = 1e-12) -> DataFrame:
    """fraction * predicted per (feature, sample, group); tiny values become 0.

    ``predicted`` has (feature_id, grp, value), ``fractions`` (sample_id, grp, fraction).
    With ``observed`` (feature_id, sample_id, value) cells that were missing stay null.
    The join repeats each prediction once per sample: the result's own size.
    """
    product = F.col("value") * F.col("fraction")
    rows = predicted.join(bounded(fractions), "grp").withColumn("value", F.when(F.abs(product) < tiny, 0.0).otherwise(product)).drop("fraction")
    if observed is None:
        return rows
    seen = observed.where(F.col("value").isNotNull()).select("feature_id", "sample_id", F.lit(True).alias("_seen"))
    return rows.join(seen, ["feature_id", "sample_id"], "left").withColumn("value", F.when(F.col("_seen"), F.col("value"))).drop("_seen")
