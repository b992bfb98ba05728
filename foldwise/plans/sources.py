"""Round trips through the readers and writers, over whole tables."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import functions as F

from foldwise.operators.models import compare_params
from foldwise.plans import inputs as i
from foldwise.plans.models import formula_params
from foldwise.plans.registry import fragment, query
from foldwise.plans.reshape import SAMPLES, fractions, wide_bulk
from foldwise.session import shared_folder
from foldwise.sources import manifest as ma
from foldwise.sources import tables as ta
from foldwise.sources.resumable import ResumableRun
from foldwise.sources.versioned import BucketTable

KEYS = "grp, timepoint, condition"


def scratch(spark) -> str:
    return os.path.join(shared_folder(spark), "files-" + uuid.uuid4().hex)


@query("A1 A6", "SELECT feature_id, " + ", ".join(f"sum(value) FILTER (sample_id = '{s}') AS \"{s}\"" for s in SAMPLES) + " FROM bulk GROUP BY feature_id", "bulk")
def read_matrix(spark, sf):
    path = scratch(spark)
    ta.write_table(wide_bulk(spark, sf), path, "csv")
    return ta.read_matrix(spark, path, "feature_id bigint, " + ", ".join(f"{s} double" for s in SAMPLES))


_GROUP_COLUMNS = ", ".join(f"round(sum(fraction) FILTER (grp = '{g}'), 6) AS \"{g}\"" for g in i.GROUPS)


@query("A2 A6", f"SELECT sample_id, {_GROUP_COLUMNS} FROM fractions GROUP BY sample_id", "fractions")
def read_keyed_matrix(spark, sf):
    path = scratch(spark)
    ta.write_table(fractions(spark, sf).groupBy("sample_id").pivot("grp", i.GROUPS).agg(F.sum("fraction")), path, "tsv")
    return i.rounded(ta.read_tsv(spark, path, "sample_id string, " + ", ".join(f"{g} double" for g in i.GROUPS), "sample_id"), *i.GROUPS)


@query("A3", "SELECT l_partkey, sum(l_quantity) AS total FROM lineitem GROUP BY l_partkey")
def read_columns(spark, sf):
    return ta.read_columns(spark, f"{sf}/lineitem.parquet", ["l_partkey", "l_quantity"]).groupBy("l_partkey").agg(F.sum("l_quantity").alias("total"))


@query("A5 A6 C12", f"SELECT {KEYS}, set_id, direction, round(lff, 6) AS lff, round(p, 6) AS p FROM enriched", "enriched")
def scan_results(spark, sf):
    path = scratch(spark)
    ta.write_table(i.results(spark, sf).select(*i.COMPARISON, "set_id", "direction", "lff", "p"), path, "csv", i.COMPARISON)
    rows = ta.scan_results(spark, f"{path}/*/*/*", "set_id bigint, direction string, lff double, p double", "/grp=([^/]+)/timepoint=([^/]+)/condition=([^/]+)/", i.COMPARISON)
    return i.rounded(rows, "lff", "p")


@query("A7", f"SELECT DISTINCT {KEYS} FROM lfc WHERE ({KEYS}) NOT IN (SELECT ({KEYS}) FROM hits WHERE p <= 0.01)", "lfc hits")
def pending_comparisons(spark, sf):
    grid = i.lfc(spark, sf).select(*i.COMPARISON).distinct()
    return ta.pending(grid, i.results(spark, sf).where("tier = 'significant' AND p <= 0.01"), i.COMPARISON)


@query("A7", f"SELECT * FROM (SELECT DISTINCT {KEYS} FROM lfc WHERE timepoint <> 't2') ORDER BY {KEYS} LIMIT 7", "lfc")
def capped_pending_comparisons(spark, sf):
    """The cap is the operator: a run takes on at most so many new comparisons."""
    grid = i.lfc(spark, sf).select(*i.COMPARISON).distinct()
    return ta.pending(grid, grid.where("timepoint = 't2'"), i.COMPARISON, cap=7)


@query("A8", """SELECT p_partkey AS key, CASE WHEN p_size > 25 THEN upper(p_name) ELSE p_name END AS symbol FROM part WHERE p_partkey % 2 = 0 OR p_size > 25""")
def upserted_cache(spark, sf):
    path = scratch(spark)
    part = i.table(spark, sf, "part")
    older = part.where("p_partkey % 2 = 0").select(F.col("p_partkey").alias("key"), F.col("p_name").alias("symbol"))
    ta.save_cache(spark, path, older, ["key"])
    newer = part.where("p_size > 25").select(F.col("p_partkey").alias("key"), F.upper("p_name").alias("symbol"))
    return ta.save_cache(spark, path, newer, ["key"])


@query("A8", """SELECT 'now' AS state, p_partkey AS key, CASE WHEN p_size > 25 THEN upper(p_name) ELSE p_name END AS symbol FROM part WHERE p_partkey % 2 = 0 OR p_size > 25
UNION ALL SELECT 'before', p_partkey, p_name FROM part WHERE p_partkey % 2 = 0""")
def cache_versions(spark, sf):
    """The cache after an update, and the version before it, which the update has left as it was."""
    part = i.table(spark, sf, "part")
    cache = BucketTable(spark, scratch(spark), ["key"])
    cache.upsert(part.where("p_partkey % 2 = 0").select(F.col("p_partkey").alias("key"), F.col("p_name").alias("symbol")))
    now = cache.upsert(part.where("p_size > 25").select(F.col("p_partkey").alias("key"), F.upper("p_name").alias("symbol")))
    before = cache.read(cache.versions()[0])
    return now.select(F.lit("now").alias("state"), "*").unionByName(before.select(F.lit("before").alias("state"), "*"))


@query("A7", f"""SELECT {KEYS}, set_id, direction, round(lff, 6) AS lff FROM results WHERE tier = 'significant'""", "results")
def resumed_results(spark, sf):
    """Hits of all comparisons by three runs: one takes seven, one is stopped after it has written its batch, one does the rest."""
    grid = i.lfc(spark, sf).select(*i.COMPARISON).distinct()

    def compute(some):
        return i.results(spark, sf).where("tier = 'significant'").join(some, i.COMPARISON, "left_semi").select(*i.COMPARISON, "set_id", "direction", "lff")

    path = scratch(spark)
    ResumableRun(spark, path, i.COMPARISON).run(grid, compute, cap=7)
    stopped = ResumableRun(spark, path, i.COMPARISON)
    stopped.write(compute(stopped.open(grid, 9)))  # ended before it reached its ledger
    rest = ResumableRun(spark, path, i.COMPARISON)
    rest.run(grid, compute)
    return i.rounded(rest.results("set_id bigint, direction string, lff double, grp string, timepoint string, condition string").select(*i.COMPARISON, "set_id", "direction", "lff"), "lff")


_RUN = "lpad(l_orderkey::VARCHAR, 8, '7') || '_LD_M' || l_linenumber || '_' || l_returnflag || CASE WHEN l_suppkey % 5 = 0 THEN '-WT-pool' ELSE '' END || '.raw'"
fragment("files", f"""SELECT '/data/' || CASE l_returnflag WHEN 'A' THEN 'Total_cortex' WHEN 'N' THEN 'pY_hippocampus' ELSE 'other' END || '/' || l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey || '-' || row_number() OVER () || '.sne' AS path,
  l_linenumber, l_quantity, CASE WHEN l_linenumber = 7 THEN [] ELSE [{_RUN}] END AS raw, l_returnflag FROM lineitem""")


def instrument_files(spark, sf):
    """A file per order line, its text naming a run twice."""
    line = i.table(spark, sf, "lineitem")
    pool = F.when(F.col("l_suppkey") % 5 == 0, "-WT-pool").otherwise("")
    run = F.concat(F.lpad(F.col("l_orderkey").cast("string"), 8, "7"), F.lit("_LD_M"), F.col("l_linenumber").cast("string"), F.lit("_"), F.col("l_returnflag"), pool, F.lit(".raw"))
    folder = F.when(F.col("l_returnflag") == "A", "Total_cortex").when(F.col("l_returnflag") == "N", "pY_hippocampus").otherwise("other")
    path = F.concat(F.lit("/data/"), folder, F.lit("/"), F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"), F.lit(".sne"))
    words = F.when(F.col("l_quantity") > 25, "Quantity PG.").otherwise("Protein")
    text = F.when(F.col("l_linenumber") == 7, words).otherwise(F.concat_ws(" | ", words, run, run))
    return line.select(path.alias("path"), F.lit(0).cast("long").alias("size_bytes"), F.encode(text, "UTF-16LE").alias("head"),
                       F.lit(False).alias("zip_container"), F.lit(False).alias("tar_container"))


@query("A9 F11 A12", """SELECT modality, tissue, pooled_runs, run_count, run, genotype_labels, sex_labels, ages, field_terms, readiness, count(*) AS n FROM (
  SELECT CASE l_returnflag WHEN 'A' THEN 'pr' WHEN 'N' THEN 'py' ELSE 'unknown' END AS modality, CASE l_returnflag WHEN 'A' THEN 'cortex' WHEN 'N' THEN 'hippocampus' ELSE 'unknown' END AS tissue,
    len(raw) > 0 AND contains(raw[1], 'pool') AS pooled_runs, len(raw)::INTEGER AS run_count, coalesce(right(split_part(raw[1], '_LD_', 1), 6) || '_LD_' || split_part(raw[1], '_LD_', 2), '') AS run,
    len(raw) > 0 AND contains(raw[1], '-WT-') AS genotype_labels, false AS sex_labels, CASE WHEN len(raw) > 0 AND contains(raw[1], '_LD_M' || l_linenumber || '_') THEN 'M' || l_linenumber ELSE '' END AS ages,
    CASE WHEN l_quantity > 25 THEN 'Quantity,PG.' ELSE 'Protein' END AS field_terms, CASE WHEN len(raw) > 0 THEN 'blocked_on_export_or_binary_extraction' ELSE 'blocked_on_format_identification' END AS readiness
  FROM files) GROUP BY ALL""", "files")
def file_manifest(spark, sf):
    rows = ma.file_manifest(instrument_files(spark, sf))
    path = scratch(spark)
    ta.write_json(rows, path, "gzip")  # a row names its file, run and text: most of it recurs
    back = ta.read_json(spark, path, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields))
    return back.groupBy(
        "modality", "tissue", "pooled_runs", "run_count", F.array_join("runs", ",").alias("run"), "genotype_labels", "sex_labels",
        F.array_join("ages", ",").alias("ages"), F.array_join("field_terms", ",").alias("field_terms"), "readiness").agg(F.count(F.lit(1)).alias("n"))


@query("A10 B15 B16 D8", """SELECT sample_id AS "row", feature_id::VARCHAR AS "column", value FROM bulk""", "bulk")
def read_matrix_market(spark, sf):
    """Sparse counts, cells (features) by genes (samples), read transposed."""
    path = scratch(spark)
    columns = spark.createDataFrame([(k + 1, s) for k, s in enumerate(SAMPLES)], "position long, name string")
    bulk = i.bulk(spark, sf).join(columns.withColumnRenamed("name", "sample_id"), "sample_id")
    n = bulk.agg(F.max("feature_id") + 1).first()[0]
    head = spark.createDataFrame([("%%MatrixMarket matrix coordinate real general\n%\n" + f"{n} {len(SAMPLES)} {bulk.count()}",)], "value string")
    head.write.mode("overwrite").text(path)
    bulk.select(F.concat_ws(" ", F.col("feature_id") + 1, "position", "value").alias("value")).write.mode("append").text(path)
    cells = i.bulk(spark, sf).select((F.col("feature_id") + 1).alias("position"), F.col("feature_id").cast("string").alias("name")).distinct()
    return ta.read_matrix_market(spark, path, columns, cells, transpose=True)


@query("A11", "SELECT feature_id, ((feature_id % 5 - 2) / 4.0)::DOUBLE AS alpha_gen, ((feature_id % 4) / 8.0)::DOUBLE AS rho, (feature_id % 9 <> 0) AS converged, 1.5::DOUBLE AS power FROM means", "means")
def reloaded_params(spark, sf):
    path = scratch(spark)
    ta.save_params(formula_params(spark, sf), spark.createDataFrame([(1.5, 2.0)], "power double, eta double"), path)
    params, meta = ta.load_params(spark, path)
    power = meta.first()["power"]
    return params.select("feature_id", "alpha_gen", "rho", "converged", F.lit(power).alias("power"))


@query("A11 I15", """SELECT 'rho' AS field, round(max(CASE WHEN feature_id % 13 = 0 THEN 0.001 ELSE 0 END), 6)::DOUBLE AS max_abs, max((feature_id % 13 = 0)::INT) = 0 AS passed FROM means
UNION ALL SELECT 'phi', 0.0, true UNION ALL SELECT 'alpha_gen', 0.0, true""", "means")
def reloaded_params_differ(spark, sf):
    """Parameters of which some were changed before they were saved: the comparison has to notice."""
    path = scratch(spark)
    before = formula_params(spark, sf)
    changed = before.withColumn("rho", F.col("rho") + F.when(F.col("feature_id") % 13 == 0, 0.001).otherwise(0.0))
    ta.save_params(changed, spark.createDataFrame([(1.5,)], "power double"), path)
    rows = compare_params(before, ta.load_params(spark, path)[0], ["rho", "phi", "alpha_gen"])
    return i.rounded(rows, "max_abs").select("field", "max_abs", "passed")


@query("A12", f"SELECT {KEYS}, count(*) AS n, round(avg(abs(lff)), 6) AS mean_abs_lff FROM enriched GROUP BY ALL", "enriched")
def json_summaries(spark, sf):
    path = scratch(spark)
    ta.write_json(i.results(spark, sf).select(*i.COMPARISON, "set_id", "lff"), path)
    rows = ta.read_json(spark, path, "grp string, timepoint string, condition string, set_id bigint, lff double")
    return i.rounded(rows.groupBy(*i.COMPARISON).agg(F.count(F.lit(1)).alias("n"), F.avg(F.abs("lff")).alias("mean_abs_lff")), "mean_abs_lff")
