"""Every named query with an oracle must equal it; the others must return rows."""

import pytest

import __spark_entry__ as entry
from tests.compare import canonical, frame_of, type_gaps

QUERIES, ORACLE = entry.queries(), entry.oracle_sql()
# Queries whose plans rank, accumulate or take percentiles of whole groups.
WIDE = [
    "classify_sites", "foreground_gate", "set_enrichment", "significance_tiers", "step_up_correction", "gini", "lorenz_curve", "higher_criticism",
    "qq_points", "ranked_sets", "additivity_stats", "concentration_tests", "ceiling_diagnostic", "size_factors", "intensity_strata", "bag_join",
    "kruskal_by_timepoint", "paginated_parts", "stratified_sample", "dropout_by_intensity", "representative_features", "member_statistics",
    "permutation_pvalues", "covariate_summary", "chi2_calibration", "vif_report", "display_order",
]


def check(name, spark, sf_dir, db):
    df = QUERIES[name](spark, sf_dir)
    assert canonical(frame_of(df)) == canonical(db.execute(ORACLE[name]).fetchdf())
    assert not type_gaps(df, db, ORACLE[name])


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_oracle(name, spark, sf_dir, db):
    check(name, spark, sf_dir, db)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE)))
def test_rows(name, spark, sf_dir):
    assert QUERIES[name](spark, sf_dir).toPandas().shape[0] > 0


class TestGroupsLargerThanATask:
    @pytest.mark.parametrize("name", WIDE)
    def test_oracle(self, name, spark, sf_dir, db, tiny_groups):
        check(name, spark, sf_dir, db)


def test_entry(spark):
    assert entry.entry(spark).count() == 45
