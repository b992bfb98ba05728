"""Manifest of binary instrument files: what their first bytes reveal."""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow.fs as pa_fs
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# The function's code travels with the job, so executors need not have this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

HEAD_BYTES = 65536  # what the manifest looks at: a parameter of the reader
TAIL_BYTES = 65557
EXCERPT_CHARS = 500
# Run-name pattern, field terms, labels and status texts.
RUN_PATTERN = r"([0-9A-Za-z]{6,}_LD_[0-9A-Za-z_\-]+\.raw)"
FIELD_TERMS = ["Quantity", "Protein", "Gene", "Spectronaut", "Report", "PG.", "FG.", "XIC", "PTM", "Intensity", "LFQ"]
GENOTYPES = r"(?i)\b(WT|WildT|5XFAD|5X)\b"
SEXES = r"(?i)\b(M|male|F|female)\b"
MODALITIES = {"pr": ["total"], "py": ["py"], "AcK": ["ack"]}
TISSUES = {"cortex": ["cortex", "cort_", "ctx_"], "hippocampus": ["hippocampus", "hip_"]}
READY = {True: "blocked_on_export_or_binary_extraction", False: "blocked_on_format_identification"}


def _tail_marks(head: Column, tail: Column) -> dict[str, Column]:
    """Archive markers: a zip ends with its directory record, up to 64 KiB of comment after it; a tar names itself at byte 257."""
    return {
        "zip_container": F.hex(tail).rlike("^(..)*504B0506"),
        "tar_container": F.hex(F.expr("substring(head, 258, 5)")) == "7573746172"}


class Opened:
    """A file of any store that pyarrow knows, read at offsets."""

    def __init__(self, uri: str):
        store, path = pa_fs.FileSystem.from_uri(uri)
        self.file = store.open_input_file(path)

    def size(self) -> int:
        return self.file.size()

    def read_at(self, n: int, offset: int) -> bytes:
        return self.file.read_at(n, offset)

    def close(self) -> None:
        self.file.close()


def known_store(uri: str) -> bool:
    """Whether ``Opened`` can open files like this one."""
    try:
        pa_fs.FileSystem.from_uri(uri)
    except Exception:  # no such store, or its library is not installed
        return False
    return True


def _ranges(head_bytes: int, opened: Callable) -> Callable:
    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            heads, tails = [], []
            for path, size in zip(batch["path"], batch["size_bytes"], strict=True):
                f = opened(path)
                try:
                    head = f.read_at(min(head_bytes, size), 0)
                    start = max(0, size - TAIL_BYTES)
                    # What the head holds of the tail is not read again.
                    tail = head[start:] + f.read_at(size - max(start, len(head)), max(start, len(head))) if size > len(head) else head[start:]
                finally:
                    f.close()
                heads.append(head)
                tails.append(tail)
            yield batch.assign(head=heads, tail=tails)

    return read


def read_heads(spark: SparkSession, glob: str, head_bytes: int = HEAD_BYTES, opened: Callable | None = None) -> DataFrame:
    """Path, size, first ``head_bytes`` bytes and archive markers of each file.

    Files are listed without their content, and of each only the two ends are read, by seeking, on
    whatever store it lies.  ``opened`` takes a path as listed and returns an object with ``read_at(n, offset)``
    and ``close()``; the default opens what pyarrow can.  Files of a store that it cannot open come
    through Spark's reader, which has no way to read a part of a file, as a whole.  Spark lists no empty files.
    """
    listed = spark.read.format("binaryFile").load(glob)
    files = listed.select("path", F.col("length").alias("size_bytes"))
    scheme = F.regexp_extract("path", "^([A-Za-z][A-Za-z0-9+.-]*):", 1)
    if opened is None:
        examples = files.groupBy(scheme.alias("scheme")).agg(F.min("path").alias("path")).collect()  # one row for each store
        seekable = [r["scheme"] for r in examples if known_store(r["path"])]
    here = F.lit(True) if opened is not None else scheme.isin(*seekable) if seekable else F.lit(False)
    ends = files.where(here).mapInPandas(_ranges(head_bytes, opened or Opened), "path string, size_bytes long, head binary, tail binary")
    if opened is None and len(seekable) < len(examples):
        ends = ends.unionByName(listed.where(~here).select(
            "path", F.col("length").alias("size_bytes"), F.expr(f"substring(content, 1, {head_bytes})").alias("head"), F.expr(f"substring(content, -{TAIL_BYTES}, {TAIL_BYTES})").alias("tail")))
    return ends.withColumns(_tail_marks(F.col("head"), F.col("tail"))).drop("tail")


@F.pandas_udf(StringType())
def utf16_text(heads: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """UTF-16LE text without undecodable units or NULs (SQL's decode rejects malformed input)."""
    for batch in heads:
        yield batch.map(lambda b: bytes(b).decode("utf-16le", errors="ignore").replace("\x00", ""))


def normalised_runs(text: Column) -> Column:
    """Distinct run names in order; a prefix with six or more digits becomes its last six."""
    def short(run: Column) -> Column:
        prefix = F.substring_index(run, "_LD_", 1)
        digits = F.regexp_replace(prefix, "[^0-9]", "")
        kept = F.when(F.length(digits) >= 6, F.right(digits, F.lit(6))).otherwise(prefix)
        return F.concat(kept, F.substring(run, F.length(prefix) + 1, F.length(run)))
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(RUN_PATTERN), 1), short))


def _guess(text: Column, rules: dict[str, list[str]]) -> Column:
    out = None
    for label, needles in rules.items():
        hit = F.lit(False)
        for needle in needles:
            hit = hit | F.contains(text, F.lit(needle))
        out = F.when(hit, label) if out is None else out.when(hit, label)
    return out.otherwise("unknown")


def file_manifest(heads: DataFrame, excerpt_chars: int = EXCERPT_CHARS) -> DataFrame:
    """One row per file from (path, size_bytes, head, zip_container, tar_container).

    ``missing`` names what the file lacks: archive, fields, runs, genotypes.
    """
    name = F.lower(F.element_at(F.split("path", "/"), -1))
    place = F.lower(F.concat_ws("/", F.get(F.reverse(F.split("path", "/")), F.lit(1)), F.element_at(F.split("path", "/"), -1)))
    rows = heads.withColumn("text", utf16_text("head")).withColumn("runs", normalised_runs(F.col("text")))
    joined = F.array_join("runs", " ")
    ages = F.transform(F.array_sort(F.array_distinct(F.flatten(F.transform("runs", lambda r: F.regexp_extract_all(r, F.lit(r"_M(\d+)_"), 1))))), lambda a: F.concat(F.lit("M"), a))
    terms = F.filter(F.array(*[F.lit(t) for t in FIELD_TERMS]), lambda t: F.contains(F.col("text"), t))
    genotype = joined.rlike(GENOTYPES)
    lacks = {"archive": ~F.col("zip_container") & ~F.col("tar_container"), "fields": F.size(terms) == 0, "runs": F.size("runs") == 0, "genotypes": ~genotype}
    missing = F.array_compact(F.array(*[F.when(lack, F.lit(name)) for name, lack in lacks.items()]))
    return rows.select(
        "path", "size_bytes", _guess(place, MODALITIES).alias("modality"),
        _guess(F.lower("path"), TISSUES).alias("tissue"),
        F.contains(name, F.lit("xic")).alias("xic_variant"), F.exists("runs", lambda r: F.contains(F.lower(r), F.lit("pool"))).alias("pooled_runs"),
        ages.alias("ages"), F.size("runs").alias("run_count"), "runs", genotype.alias("genotype_labels"), joined.rlike(SEXES).alias("sex_labels"),
        "zip_container", "tar_container", terms.alias("field_terms"), F.left("text", F.lit(excerpt_chars)).alias("excerpt"),
        F.when(F.size("runs") > 0, READY[True]).otherwise(READY[False]).alias("readiness"), missing.alias("missing"))
