"""Model and data diagnostics: dropout, variance, design, correlation and label checks."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foldwise.functions.special import normal_quantile
from foldwise.operators.normalise import safe_ratio_lfc
from foldwise.operators.ordering import group_percentiles, ranked, sized, whole_percentiles
from foldwise.operators.sampling import sample_rows, top_marker
from foldwise.operators.stats import correlations, linear_fit, safe_corr
from foldwise.session import bounded, materialise, written


def with_scalar(df: DataFrame, one_row: DataFrame) -> DataFrame:
    """Attach the columns of a one-row table to every row."""
    return df.withColumn("_one", F.lit(0)).join(F.broadcast(one_row.withColumn("_one", F.lit(0))), "_one").drop("_one")


def histogram(df: DataFrame, by: Sequence[str], value: str, low: float, high: float, bins: int) -> DataFrame:
    """Counts in equal bins (the last one closed) and the count expected if uniform."""
    width = (high - low) / bins
    inside = df.where((F.col(value) >= low) & (F.col(value) <= high))
    # The edges are compared as numbers, so a value on an edge falls as numpy puts it.
    edges = [float(e) for e in np.linspace(low, high, bins + 1)]
    place = F.floor((F.col(value) - low) / width).cast("int")
    place = F.when(place >= bins, bins - 1).otherwise(place)
    edge = F.array(*[F.lit(e) for e in edges])
    place = F.when(F.col(value) < F.element_at(edge, place + 1), place - 1).when(
        (place < bins - 1) & (F.col(value) >= F.element_at(edge, place + 2)), place + 1).otherwise(place)
    counts = inside.withColumn("bin", place).groupBy(*by, "bin").agg(F.count(F.lit(1)).alias("n"))
    totals = inside.groupBy(*by).agg((F.count(F.lit(1)) / bins).alias("expected"))
    grid = totals.withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
    return grid.join(counts, [*by, "bin"], "left").fillna(0, ["n"]).withColumn("low", F.element_at(edge, F.col("bin") + 1))


def mixed_mean(profiles: DataFrame, fractions: DataFrame) -> DataFrame:
    """Expected value per (feature, sample): sum over groups of fraction * profile.

    Profiles are brought together by feature before each becomes a row a sample: the sums need no further exchange.
    """
    rows = profiles.repartition("feature_id").join(bounded(fractions), "grp")
    return rows.groupBy("feature_id", "sample_id").agg(F.sum(F.col("fraction") * F.col("value")).alias("mu"))


def binned(df: DataFrame, value: str, low: Column, high: Column, bins: int) -> Column:
    """0-based equal-width bin between two edges; values outside go to the end bins."""
    place = F.floor((F.col(value) - low) / ((high - low) / bins)).cast("int")
    return F.greatest(F.least(place, F.lit(bins - 1)), F.lit(0))


def dropout_by_intensity(cells: DataFrame, bins: int = 50, least: int = 50) -> DataFrame:
    """Share of missing cells by log10 expected intensity, between its 1st and 99th percentile."""
    rows = cells.where("mu > 0").withColumn("_x", F.log10("mu"))
    cuts = whole_percentiles(rows, "_x", {"_low": 0.01, "_high": 0.99})
    rows = rows.withColumns({name: F.lit(v).cast("double") for name, v in cuts.items()})
    table = rows.withColumn("bin", binned(rows, "_x", F.col("_low"), F.col("_high"), bins)).groupBy("bin").agg(
        F.avg(F.col("value").isNull().cast("double")).alias("dropout"), F.count(F.lit(1)).alias("n"),
        F.first(F.col("_low")).alias("_low"), F.first(F.col("_high")).alias("_high"))
    width = (F.col("_high") - F.col("_low")) / bins
    return table.where(F.col("n") >= least).select("bin", "n", "dropout", (F.col("_low") + (F.col("bin") + 0.5) * width).alias("centre"))


def mean_variance(m: DataFrame, least: int) -> DataFrame:
    """Mean and variance of the positive values per feature."""
    positive = m.where("value > 0").groupBy("feature_id").agg(F.avg("value").alias("mean"), F.var_samp("value").alias("variance"), F.count(F.lit(1)).alias("n"))
    return positive.where((F.col("n") >= least) & (F.col("mean") > 0) & (F.col("variance") > 0))


def power_law(m: DataFrame, least: int) -> DataFrame:
    """Fit of log variance against log mean: the slope estimates the variance power."""
    logs = mean_variance(m, least).select(F.log10("mean").alias("x"), F.log10("variance").alias("y"))
    return linear_fit(logs, [], "x", "y")


def residual_spread(m: DataFrame, power: float, least: int = 3, bins: int = 24) -> DataFrame:
    """Residual standard deviation by log10 mean, raw and divided by sqrt(mean^power)."""
    means = m.where("value > 0").groupBy("feature_id").agg(F.avg("value").alias("_mu"), F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= least)
    rows = m.where("value > 0").join(means, "feature_id").withColumn("_x", F.log10("_mu")).withColumn("_raw", F.col("value") - F.col("_mu"))
    rows = rows.withColumn("_scaled", F.col("_raw") / F.sqrt(F.pow("_mu", F.lit(power))))
    rows = with_scalar(rows, means.agg(F.min(F.log10("_mu")).alias("_low"), F.max(F.log10("_mu")).alias("_high")))
    table = rows.withColumn("bin", binned(rows, "_x", F.col("_low"), F.col("_high"), bins)).groupBy("bin").agg(
        F.count(F.lit(1)).alias("n"), F.stddev_pop("_raw").alias("sd_raw"), F.stddev_pop("_scaled").alias("sd_scaled"))
    return table.where("n > 10")


def standardised_residuals(cells: DataFrame, power: float, least: int = 10) -> DataFrame:
    """Pearson residuals of positive values under constant and power variance, per-feature scaled."""
    rows = cells.where("value > 0 AND mu > 0").withColumn("_g", F.col("value") - F.col("mu"))
    rows = rows.withColumn("_t", F.col("_g") / F.pow("mu", F.lit(power / 2)))
    scale = rows.groupBy("feature_id").agg(F.stddev("_g").alias("_sg"), F.stddev("_t").alias("_st"), F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= least)
    both = F.array(F.struct(F.lit("constant").alias("family"), F.try_divide("_g", "_sg").alias("residual")),
                   F.struct(F.lit("power").alias("family"), F.try_divide("_t", "_st").alias("residual")))
    return rows.join(scale, "feature_id").select("feature_id", "sample_id", F.explode(both).alias("_r")).select("feature_id", "sample_id", "_r.*").where("residual IS NOT NULL")


def normal_qq(df: DataFrame, value: str, key: str) -> DataFrame:
    """Normal quantile against sample quantile of every row."""
    picked, fits = sized(df.select(key, value), [])
    m = picked.count()
    rows = ranked(picked, [], [F.col(value), F.col(key)], "rank", fits)
    return rows.select("rank", normal_quantile(f"(rank - 0.5D) / {m}").alias("theoretical"), F.col(value).alias("observed"))


def chi2_calibration(m: DataFrame, powers: Sequence[float], least: int = 10) -> DataFrame:
    """Median Pearson chi-squared / (n - 1) per variance power, with each feature's own mean."""
    per = m.where("value > 0").groupBy("feature_id").agg(F.avg("value").alias("_mu"), F.var_samp("value").alias("_var"), F.count(F.lit(1)).alias("_n"))
    per = per.where(F.col("_n") >= least).withColumn("power", F.explode(F.array(*[F.lit(float(p)) for p in powers])))
    # sum((y - mean)^2) / (n - 1) is the sample variance.
    return group_percentiles(per.withColumn("_chi2", F.col("_var") / F.pow("_mu", F.col("power"))), ["power"], "_chi2", {"median_chi2": 0.5})


# Percentile walks and dropout bounds of the three picks.
PICKS = {"high": (0.90, 0.50, -0.01, 0, 0), "medium": (0.50, 0.30, -0.01, 3, 8), "low": (0.10, 0.30, 0.01, 8, None)}


def pick_walk(pick: str) -> list[float]:
    start, stop, step, _, _ = PICKS[pick]
    return [float(p) for p in np.arange(start, stop, step)]


def representative_features(features: DataFrame) -> DataFrame:
    """A high, a medium and a low feature (columns: mean_value, n_missing).

    Walks percentiles of the mean from a start and takes the first feature whose
    dropout count fits; the start itself when none does.
    """
    n = features.count()
    rows = ranked(features, [], [F.col("mean_value"), F.col("feature_id")], "_r").withColumn("_r", F.col("_r") - 1)
    steps = [(pick, k, int(n * p)) for pick in PICKS for k, p in enumerate(pick_walk(pick))]
    wanted = features.sparkSession.createDataFrame(steps, "pick string, _step int, _r long")
    fits = F.lit(False)
    for pick, (_, _, _, low, high) in PICKS.items():
        inside = F.col("n_missing") >= low if high is None else F.col("n_missing").between(low, high)
        fits = fits | ((F.col("pick") == pick) & inside)
    found = rows.join(F.broadcast(wanted), "_r").where(fits | (F.col("_step") == 0))
    order = F.when(fits, F.col("_step")).otherwise(F.lit(1000))
    return found.groupBy("pick").agg(F.min_by(F.struct("feature_id", "mean_value", "n_missing"), order).alias("_f")).select("pick", "_f.*")


# ---- profiles ----------------------------------------------------------------

def profile_means(expr: DataFrame) -> DataFrame:
    return expr.groupBy("grp", "gene").agg(F.avg("value").alias("mean"))


# Genes that one task pairs with as many others.
BLOCK_GENES = 256


def profile_covariance(expr: DataFrame, samples: Sequence[str]) -> DataFrame:
    """Gene-by-gene sample covariance per group (upper triangle with the diagonal).

    Each gene becomes one array over the samples, so the join makes exactly the
    output rows: the matrix is what the caller asked for.
    """
    centred = expr.groupBy("grp", "gene").pivot("sample_id", list(samples)).agg(F.sum("value"))
    values = F.array(*[F.coalesce(F.col(f"`{s}`"), F.lit(0.0)) for s in samples])
    rows = centred.select("grp", "gene", values.alias("_v"))
    mean = F.aggregate("_v", F.lit(0.0), lambda a, v: a + v) / len(samples)
    rows = rows.withColumn("_m", mean).select("grp", "gene", F.expr("transform(_v, v -> v - _m)").alias("_v"))
    # A group has far more pairs than one task should make: genes fall into blocks, as
    # many as the largest group needs, and every two blocks meet once.
    rows = written(rows)
    largest = rows.groupBy("grp").agg(F.count(F.lit(1)).alias("_n")).agg(F.max("_n")).first()[0] or 0
    blocks = -(-largest // BLOCK_GENES) or 1
    rows = rows.withColumn("_b", F.pmod(F.xxhash64("gene"), F.lit(blocks)))
    left = rows.select("grp", "gene", "_v", F.col("_b").alias("_lo"), F.explode(F.sequence(F.col("_b"), F.lit(blocks - 1).cast("long"))).alias("_hi"))
    right = rows.select("grp", F.col("gene").alias("_other"), F.col("_v").alias("_w"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("_b"))).alias("_lo"), F.col("_b").alias("_hi"))
    pairs = left.join(right, ["grp", "_lo", "_hi"]).where("_lo < _hi OR gene <= _other")
    product = F.expr("aggregate(zip_with(_v, _w, (a, b) -> a * b), 0D, (s, v) -> s + v)")
    return pairs.select("grp", F.least("gene", "_other").alias("gene_a"), F.greatest("gene", "_other").alias("gene_b"), (product / (len(samples) - 1)).alias("covariance"))


def condition_lfc(m: DataFrame, control: str) -> DataFrame:
    """log2 ratio of condition means to the control mean, floored, per (feature, group)."""
    means = m.groupBy("feature_id", "grp", "condition").agg(F.avg("value").alias("_m"))
    base = means.where(F.col("condition") == control).select("feature_id", "grp", F.col("_m").alias("_c"))
    others = means.where(F.col("condition") != control).join(base, ["feature_id", "grp"])
    return others.select("feature_id", "grp", "condition", safe_ratio_lfc(F.col("_m"), F.col("_c")).alias("lfc"))


def effect_concordance(lfc: DataFrame, effects: DataFrame) -> DataFrame:
    """Correlation of a fold change with fitted effects (feature_id, grp, condition, beta)."""
    return lfc.join(effects, ["feature_id", "grp", "condition"]).groupBy("grp", "condition").agg(safe_corr("beta", "lfc").alias("pearson"), F.count(F.lit(1)).alias("n"))


def naive_lfc(m: DataFrame, control: str, n_samples: int) -> DataFrame:
    """Difference of condition means from the control mean on features complete in all samples."""
    full = m.groupBy("feature_id").agg(F.count("value").alias("_n")).where(F.col("_n") == n_samples)
    means = m.join(full, "feature_id", "left_semi").groupBy("feature_id", "grp", "condition").agg(F.avg("value").alias("_m"))
    base = means.where(F.col("condition") == control).select("feature_id", "grp", F.col("_m").alias("_c"))
    return means.where(F.col("condition") != control).join(base, ["feature_id", "grp"]).select(
        "feature_id", "grp", "condition", (F.col("_m") - F.col("_c")).alias("difference"))


# ---- PCA, design, collinearity -------------------------------------------------

def gram_sums(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Sums of products of all column pairs, as (i, j, product) with i <= j.

    Each task multiplies its own batches, so only columns-by-columns partial
    sums are shuffled; the columns are those of the design or the samples.
    """
    size = len(columns)
    upper = np.triu_indices(size)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((size, size))
        for batch in batches:
            values = np.nan_to_num(batch.to_numpy(float))
            total += values.T @ values
        yield pd.DataFrame({"i": upper[0], "j": upper[1], "product": total[upper]})

    picked = df.select(*[F.col(f"`{c}`").cast("double") for c in columns])
    return picked.mapInPandas(run, "i int, j int, product double").groupBy("i", "j").agg(F.sum("product").alias("product"))


# Columns whose product matrix the driver decomposes; more are refused before anything is collected.
MAX_GRAM_COLUMNS = 2000


def gram_matrix(df: DataFrame, columns: Sequence[str]) -> np.ndarray:
    """The symmetric matrix of ``gram_sums``; columns-by-columns numbers reach the driver."""
    if len(columns) > MAX_GRAM_COLUMNS:
        raise ValueError(f"{len(columns)} columns: their matrix is decomposed on the driver, which takes {MAX_GRAM_COLUMNS} at most")
    matrix = np.zeros((len(columns), len(columns)))
    for i, j, product in gram_sums(df, columns).collect():
        matrix[i, j] = matrix[j, i] = product
    return matrix


def centred_wide(resid: DataFrame, samples: Sequence[str], value: str) -> DataFrame:
    """Features by samples (gaps 0), centred per feature."""
    wide = resid.groupBy("feature_id").pivot("sample_id", list(samples)).agg(F.sum(value)).fillna(0.0)
    total = sum((F.col(f"`{s}`") for s in samples[1:]), F.col(f"`{samples[0]}`"))
    wide = wide.withColumn("_mean", total / len(samples))
    return wide.select("feature_id", *[(F.col(f"`{s}`") - F.col("_mean")).alias(s) for s in samples])


def sample_gram(resid: DataFrame, samples: Sequence[str], value: str) -> DataFrame:
    """Upper triangle of the sample-by-sample products of the centred table."""
    name = F.array(*[F.lit(s) for s in samples])
    return gram_sums(centred_wide(resid, samples, value), samples).select(
        F.element_at(name, F.col("i") + 1).alias("sample_a"), F.element_at(name, F.col("j") + 1).alias("sample_b"), "product")


def sample_pca(resid: DataFrame, samples: Sequence[str], value: str, k: int = 2) -> DataFrame:
    """Leading principal-component scores of the samples and their variance shares.

    The feature dimension is summed on the cluster; the driver decomposes a
    samples-by-samples matrix.  Signs make each component's largest score positive.
    """
    values, vectors = np.linalg.eigh(gram_matrix(centred_wide(resid, samples, value), samples))
    values, vectors = np.clip(values[::-1], 0, None), vectors[:, ::-1]
    scores = vectors[:, :k] * np.sqrt(values[:k])
    scores = scores * np.where(scores[np.abs(scores).argmax(axis=0), range(k)] < 0, -1, 1)
    share = values / values.sum()
    rows = [(s, c + 1, float(scores[r, c]), float(share[c])) for r, s in enumerate(samples) for c in range(k)]
    return resid.sparkSession.createDataFrame(rows, "sample_id string, component int, score double, variance_share double")


def covariate_vif(r: DataFrame, design: DataFrame, n_rows: int) -> DataFrame:
    """Variance inflation of each feature's covariate against the design.

    ``design`` has one row per (grp, sample_id) with x0, x1, x2; each group has
    its own coefficients, so the fit splits into 3x3 blocks whose inverse is
    written out.  ``n_rows`` counts all design rows; absent covariates are 0.
    """
    ridge = 1e-10
    design = bounded(design)
    gram = design.groupBy("grp").agg(*[(F.sum(F.col(f"x{i}") * F.col(f"x{j}")) + (ridge if i == j else 0.0)).alias(f"g{i}{j}") for i in range(3) for j in range(i, 3)])
    det = "(g00 * (g11 * g22 - g12 * g12) - g01 * (g01 * g22 - g12 * g02) + g02 * (g01 * g12 - g11 * g02))"
    inverse = {
        "i00": f"(g11 * g22 - g12 * g12) / {det}", "i01": f"(g02 * g12 - g01 * g22) / {det}", "i02": f"(g01 * g12 - g02 * g11) / {det}",
        "i11": f"(g00 * g22 - g02 * g02) / {det}", "i12": f"(g02 * g01 - g00 * g12) / {det}", "i22": f"(g00 * g11 - g01 * g01) / {det}"}
    gram = gram.select("grp", *[F.expr(e).alias(n) for n, e in inverse.items()])
    rows = r.join(design, ["grp", "sample_id"])
    blocks = rows.groupBy("feature_id", "grp").agg(*[F.sum(F.col(f"x{i}") * F.col("r")).alias(f"b{i}") for i in range(3)], F.sum("r").alias("_s"), F.sum(F.col("r") ** 2).alias("_q"))
    explained = F.expr("b0 * b0 * i00 + b1 * b1 * i11 + b2 * b2 * i22 + 2 * (b0 * b1 * i01 + b0 * b2 * i02 + b1 * b2 * i12)")
    per = blocks.join(bounded(gram), "grp").groupBy("feature_id").agg(F.sum(explained).alias("_e"), F.sum("_s").alias("_s"), F.sum("_q").alias("_q"))
    total = F.col("_q") - F.col("_s") ** 2 / n_rows
    r2 = F.least(1 - (F.col("_q") - F.col("_e")) / total, F.lit(1 - 1e-10))
    return per.select("feature_id", F.when((F.col("_q") == 0) | (total < 1e-15), 1.0).otherwise(1 / (1 - r2)).alias("vif"))


def vif_report(vif: DataFrame, limit: float = 10.0, share: float = 0.90) -> DataFrame:
    table = group_percentiles(vif, [], "vif", {"median_vif": 0.5}, [F.avg((F.col("vif") < limit).cast("double")).alias("value"), F.max("vif").alias("max_vif")])
    return table.withColumn("name", F.lit("covariate collinearity")).withColumn("passed", F.col("value") >= share)


# Limits of the design checks.
MIN_RANK, MIN_SINGULAR, MAX_CONDITION, MAX_DOF, MIN_RESIDUAL_DOF = 5, 0.01, 5e3, 20, 4
# Singular values come from a matrix of products, which resolves about 1e-8 of the largest.
RESOLVED = 1e-7


def _singular(matrix: np.ndarray) -> np.ndarray:
    return np.sqrt(np.clip(np.linalg.eigvalsh(matrix)[::-1], 0, None))


def _condition(matrix: np.ndarray) -> float:
    norms = np.sqrt(np.diag(matrix))
    norms[norms == 0] = 1.0
    values = _singular(matrix / np.outer(norms, norms))
    values = values[values > RESOLVED * values[0]]
    return float(values[0] / values[-1]) if len(values) else float("inf")


def design_frame(fractions: DataFrame, samples: DataFrame, groups: Sequence[str], estimated: Sequence[str]) -> tuple[DataFrame, list[str], list[str]]:
    """Wide design: one row per sample; also the full and the main-effect column names."""
    wide = fractions.groupBy("sample_id").pivot("grp", list(groups)).agg(F.sum("fraction")).fillna(0.0).join(samples, "sample_id")
    terms = {f"{g}:{t}": F.col(f"`{g}`") * F.col(t) for g in estimated for t in ("first", "second", "both")}
    frame = wide.select("sample_id", *[F.col(f"`{g}`") for g in groups], *[c.alias(n) for n, c in terms.items()], "female", "time2", "time3")
    blocks = ["female", "time2", "time3"]
    return frame, [*terms, *blocks], [*[n for n in terms if not n.endswith(":both")], *blocks]


def design_diagnostics(fractions: DataFrame, samples: DataFrame, groups: Sequence[str], estimated: Sequence[str]) -> DataFrame:
    """Rank, smallest singular value, conditioning and degrees of freedom of the design.

    Only column-by-column product sums leave the cluster.
    """
    frame, full, main = design_frame(fractions, samples, groups, estimated)
    n = frame.count()
    composition = _singular(gram_matrix(frame, groups))
    rank = int((composition > RESOLVED * composition[0]).sum())
    smallest = float(composition[-1])
    gram = gram_matrix(frame, full)
    condition = _condition(gram)
    singular = _singular(gram)
    dof = int((singular > RESOLVED * singular[0]).sum())
    rows = [
        ("composition rank", rank >= MIN_RANK and smallest > MIN_SINGULAR, float(rank), float(MIN_RANK)),
        ("composition smallest singular value", smallest > MIN_SINGULAR, smallest, MIN_SINGULAR),
        ("design conditioning", condition < MAX_CONDITION, condition, MAX_CONDITION),
        ("effective degrees of freedom", dof <= MAX_DOF and n - dof >= MIN_RESIDUAL_DOF, float(dof), float(MAX_DOF)),
    ]
    if condition >= MAX_CONDITION:
        simpler = _condition(gram_matrix(frame, main))
        rows.append(("design conditioning without interaction", simpler < MAX_CONDITION, simpler, MAX_CONDITION))
    return fractions.sparkSession.createDataFrame(rows, "name string, passed boolean, value double, threshold double")


def pairwise_feature_corr(r: DataFrame, samples: Sequence[str], n: int = 2000, seed: int = 42, high: float = 0.7) -> DataFrame:
    """Median |correlation| and share above ``high`` over pairs of ``n`` sampled features, per group.

    Sampling is the operator: a group's matrix is at most n by samples, packed
    as one row per feature, and its correlations are one matrix product in a task.
    """
    picked = sample_rows(r.select("feature_id").distinct(), n, seed)
    wide = r.join(picked, "feature_id", "left_semi").groupBy("grp", "feature_id").pivot("sample_id", list(samples)).agg(F.sum("r")).fillna(0.0)
    packed = wide.select("grp", "feature_id", F.array(*[F.col(f"`{s}`") for s in samples]).alias("v"))

    def one(rows: pd.DataFrame) -> pd.DataFrame:
        values = np.stack(rows["v"].to_numpy())
        values = values[values.std(axis=1) > 0]
        if len(values) < 2:
            return pd.DataFrame({"grp": rows["grp"].iloc[:1], "median_abs": [None], "share_high": [None], "n_pairs": [0]})
        pairs = np.abs(np.corrcoef(values)[np.triu_indices(len(values), 1)])
        return pd.DataFrame({"grp": rows["grp"].iloc[:1], "median_abs": [np.median(pairs)], "share_high": [(pairs > high).mean()], "n_pairs": [len(pairs)]})

    return packed.groupBy("grp").applyInPandas(one, "grp string, median_abs double, share_high double, n_pairs long")


def cross_modality(expr: DataFrame, effects: DataFrame, edges: DataFrame, control: str, least: int = 10, band: float = 0.15) -> DataFrame:
    """Spearman of a gene's expression shift with the mean effect on its features, per (group, condition).

    Both are rounded to twelve decimals, so that equal values tie in the ranks.

    ``effects`` is (feature_id, grp, condition, beta); ``edges`` (feature_id, gene).
    """
    means = expr.groupBy("grp", "gene", "condition").agg(F.avg("value").alias("_m"))
    base = means.where(F.col("condition") == control).select("grp", "gene", F.col("_m").alias("_c"))
    shift = means.where(F.col("condition") != control).join(base, ["grp", "gene"]).where((F.abs("_c") >= 1e-10) | (F.abs("_m") >= 1e-10))
    shift = shift.select("grp", "gene", "condition", F.round(F.col("_m") - F.col("_c"), 12).alias("shift"))
    beta = edges.join(effects, "feature_id").groupBy("grp", "gene", "condition").agg(F.round(F.avg("beta"), 12).alias("beta"))
    table = correlations(shift.join(beta, ["grp", "gene", "condition"]), ["grp", "condition"], "shift", "beta")
    enough = F.col("n") >= least
    rho = F.when(enough, F.col("spearman"))
    label = F.when(~enough, "too few pairs").when(F.col("spearman") > band, "concordant").when(F.col("spearman") < -band, "anti").otherwise("decoupled")
    return table.select("grp", "condition", "n", rho.alias("spearman"), F.when(enough, F.col("spearman_p")).alias("p"), label.alias("label"))


# ---- reports and label checks -----------------------------------------------------

def gate_report(results: DataFrame, expected: Sequence[str]) -> DataFrame:
    """Expected checks with PASS / FAIL / INFO / NOT RUN (``passed`` null is informative)."""
    wanted = results.sparkSession.createDataFrame([(k, n) for k, n in enumerate(expected)], "position int, name string")
    ran = results.select("name", "passed", F.lit(True).alias("_ran"))
    status = F.when(F.col("_ran").isNull(), "NOT RUN").when(F.col("passed").isNull(), "INFO").when(F.col("passed"), "PASS").otherwise("FAIL")
    return wanted.join(ran, "name", "left").select("position", "name", status.alias("status"))


def gate_outcome(results: DataFrame) -> DataFrame:
    """Did all checks pass, and how many block?"""
    return results.agg(F.coalesce(F.bool_and("passed"), F.lit(True)).alias("all_passed"), F.count_if(~F.col("passed")).alias("n_blocking"))


def validate_labels(totals: DataFrame, n_top: int = 12, labels: Mapping[tuple[bool, bool], str] | None = None) -> DataFrame:
    """Sex and condition inferred from marker totals beside the expected labels.

    ``totals`` has sample_id, gender, condition, first, second, female, male.
    """
    rows = top_marker(top_marker(totals, "first", "_a", n_top), "second", "_b", n_top)
    names = labels or {(True, True): "T12", (True, False): "T1", (False, True): "T2", (False, False): "C"}
    a, b = F.col("_a"), F.col("_b")
    inferred = F.when(a & b, names[True, True]).when(a, names[True, False]).when(b, names[False, True]).otherwise(names[False, False])
    rows = rows.withColumn("inferred_gender", F.when(F.col("female") > F.col("male"), "F").otherwise("O")).withColumn("inferred_condition", inferred)
    mismatch = (F.col("inferred_gender") != F.col("gender")) | (F.col("inferred_condition") != F.col("condition"))
    return rows.select("sample_id", "gender", "condition", "inferred_gender", "inferred_condition", mismatch.alias("mismatch"))


BLOCK_SAMPLES = 200


def fingerprint_distance(a: DataFrame, b: DataFrame) -> DataFrame:
    """Squared distance between the standardised group profiles of two sample tables.

    Both are (sample_id, grp, value).  The result is the sample-by-sample cost table of samples with a
    group in common.  A sample is one packed profile, and samples meet block by block, so no group
    gathers all samples and a pair is made once, not once for each of its groups.
    """

    def packed(df: DataFrame, name: str, value: str) -> DataFrame:
        stats = df.groupBy("grp").agg(F.avg("value").alias("_m"), F.stddev_pop("value").alias("_s"))
        z = (F.col("value") - F.col("_m")) / (F.col("_s") + 1e-10)
        rows = df.join(stats, "grp").where(F.col("sample_id").isNotNull()).groupBy(F.col("sample_id").alias(name)).agg(F.sort_array(F.collect_list(F.struct("grp", z.alias("z")))).alias(value))
        return materialise(rows)

    left, right = packed(a, "sample_a", "_x"), packed(b, "sample_b", "_y")
    blocks = [max(1, -(-df.count() // BLOCK_SAMPLES)) for df in (left, right)]
    own = [F.pmod(F.xxhash64(name), F.lit(n)) for name, n in zip(("sample_a", "sample_b"), blocks, strict=True)]
    every = [F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))) for n in blocks]
    left = left.select("*", own[0].alias("_i"), every[1].alias("_j"))
    right = right.select("sample_b", F.map_from_entries("_y").alias("_y"), every[0].alias("_i"), own[1].alias("_j"))
    pairs = left.join(right, ["_i", "_j"]).where(F.exists("_x", lambda x: F.map_contains_key("_y", x["grp"])))
    square = F.aggregate("_x", F.lit(0.0), lambda s, x: s + F.coalesce(F.pow(x["z"] - F.try_element_at(F.col("_y"), x["grp"]), F.lit(2.0)), F.lit(0.0)))
    return pairs.select("sample_a", "sample_b", square.alias("distance"))
