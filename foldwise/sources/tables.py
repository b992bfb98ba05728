"""Readers and writers of matrices, result folders, caches, parameters and JSON."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foldwise.operators.joins import latest_per_key
from foldwise.operators.ordering import ranked
from foldwise.session import written
from foldwise.sources.versioned import BUCKETS, BucketTable


def read_matrix(spark: SparkSession, path: str, schema: str, na: str = "NA") -> DataFrame:
    """Comma-separated matrix with a header; ``na`` cells are null."""
    return spark.read.schema(schema).option("header", True).option("nullValue", na).option("nanValue", "NaN").csv(path)


def read_tsv(spark: SparkSession, path: str, schema: str, key: str, na: str = "NA") -> DataFrame:
    """Tab-separated matrix keyed by a column, which must be present in every row."""
    rows = spark.read.schema(schema).option("header", True).option("sep", "\t").option("nullValue", na).csv(path)
    return rows.withColumn(key, F.when(F.col(key).isNotNull(), F.col(key)).otherwise(F.raise_error(F.lit(f"a row has no {key}"))))


def read_columns(spark: SparkSession, path: str, columns: Sequence[str]) -> DataFrame:
    """Only some columns; the scan reads no others."""
    return spark.read.parquet(path).select(*columns)


def scan_results(spark: SparkSession, glob: str, schema: str, pattern: str, names: Sequence[str]) -> DataFrame:
    """One table from per-comparison files; the pattern's groups on the file's path become columns."""
    rows = spark.read.schema(schema).option("header", True).option("nullValue", "NA").csv(glob).withColumn("_path", F.col("_metadata.file_path"))
    return rows.withColumns({n: F.regexp_extract("_path", pattern, k + 1) for k, n in enumerate(names)}).drop("_path")


def write_table(df: DataFrame, path: str, fmt: str = "parquet", partition_by: Sequence[str] = (), mode: str = "overwrite") -> None:
    """Parquet, csv or tsv; with partitions, only those present in ``df`` are replaced."""
    writer = df.write.mode(mode)
    if partition_by:
        writer = writer.partitionBy(*partition_by).option("partitionOverwriteMode", "dynamic")
    if fmt == "parquet":
        writer.parquet(path)
    else:
        writer.option("header", True).option("nullValue", "NA").option("sep", "\t" if fmt == "tsv" else ",").csv(path)


def pending(comparisons: DataFrame, done: DataFrame, keys: Sequence[str], cap: int | None = None) -> DataFrame:
    """Comparisons without stored results; ``cap`` bounds how many a run takes on."""
    rows = comparisons.join(done.select(*keys).distinct(), list(keys), "left_anti")
    return rows if cap is None else rows.orderBy(*keys).limit(cap)


def upsert_cache(cache: DataFrame | None, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Cache rows updated by new ones; a new row wins over an old one with its key."""
    rows = new.withColumn("_new", F.lit(1))
    if cache is not None:
        rows = cache.withColumn("_new", F.lit(0)).unionByName(rows)
    return latest_per_key(rows, keys, F.col("_new")).drop("_new")


def read_cache(spark: SparkSession, path: str) -> DataFrame | None:
    """The cache, or None before its first write; a folder of plain files is a cache too."""
    versions = BucketTable(spark, path, [])
    if versions.manifest() is not None:
        return versions.read()
    try:
        return spark.read.parquet(path)
    except AnalysisException as error:
        if error.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise


def save_cache(spark: SparkSession, path: str, new: DataFrame, keys: Sequence[str], n_buckets: int = BUCKETS) -> DataFrame:
    """Merge ``new`` into the cache at ``path``; only the buckets of its keys are written, and the old cache
    holds until they all are.  The rows of a folder of plain files become the first version."""
    cache = BucketTable(spark, path, keys, n_buckets)
    if cache.manifest() is None:
        new = upsert_cache(read_cache(spark, path), new, keys)
    return cache.upsert(new)


def save_params(params: DataFrame, meta: DataFrame, path: str) -> None:
    """Per-feature parameters and the one-row table of scalars."""
    params.write.mode("overwrite").parquet(f"{path}/features")
    meta.write.mode("overwrite").parquet(f"{path}/meta")


def load_params(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.parquet(f"{path}/features"), spark.read.parquet(f"{path}/meta")


def write_json(df: DataFrame, path: str, compression: str | None = None) -> None:
    df.write.mode("overwrite").json(path, compression=compression)


def read_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path)


def unique_names(names: DataFrame, name: str, position: str) -> DataFrame:
    """Repeated names get .1, .2, ... in order; a name's first occurrence stays."""
    rows = ranked(names, [name], [F.col(position)], "_n")
    return rows.withColumn(name, F.when(F.col("_n") == 1, F.col(name)).otherwise(F.concat_ws(".", F.col(name), (F.col("_n") - 1).cast("string")))).drop("_n")


def read_matrix_market(spark: SparkSession, path: str, rows: DataFrame, columns: DataFrame, transpose: bool = False) -> DataFrame:
    """Sparse coordinate matrix as (row, column, value), labelled by (position, name) tables.

    The size line is the first line after the comments of the file that carries
    the banner.  Positions start at 1.  ``transpose`` swaps the two axes.
    """
    lines = spark.read.text(path).select(F.trim("value").alias("line"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("at"))
    parts = F.split("line", r"\s+")
    parsed = written(lines.where("line <> ''").select(
        "file", "start", "at", F.col("line").startswith("%%MatrixMarket").alias("banner"), F.col("line").startswith("%").alias("note"),
        parts[0].try_cast("long").alias("i"), F.try_element_at(parts, F.lit(2)).try_cast("long").alias("j"), F.try_element_at(parts, F.lit(3)).try_cast("double").alias("value")))
    # The text is read once; the size line is the first plain line of the banner's file.
    first = parsed.where("banner").select("file").join(parsed.where("NOT note AND start = 0"), "file").agg(F.min_by(F.struct("at", "value"), "at").alias("size")).first()["size"]
    entries = parsed.where("NOT note").where(F.col("at") != first["at"])
    found = entries.count()
    if found != int(first["value"]):
        raise ValueError(f"the size line tells of {int(first['value'])} entries; there are {found}")
    cells = entries.select("i", "j", "value")
    if transpose:
        cells = cells.select(F.col("j").alias("i"), F.col("i").alias("j"), "value")
    row_names = unique_names(rows, "name", "position").select(F.col("position").alias("i"), F.col("name").alias("row"))
    column_names = unique_names(columns, "name", "position").select(F.col("position").alias("j"), F.col("name").alias("column"))
    return cells.join(row_names, "i").join(column_names, "j").select("row", "column", "value")


