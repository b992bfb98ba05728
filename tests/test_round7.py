"""The validation queries run as many refits as the reference."""

import glob
import inspect

import pytest

from foldwise.operators import models as mo
from foldwise.plans import models as plans
from foldwise.plans import sources


def arguments(monkeypatch, name):
    """What the query ``name`` hands to the operator of that name, defaults included."""
    signature, seen = inspect.signature(getattr(mo, name)), {}

    def spy(*args, **kwargs):
        call = signature.bind(*args, **kwargs)
        call.apply_defaults()
        seen.update(call.arguments)

    monkeypatch.setattr(mo, name, spy)
    for step in ("packed", "fitted", "design", "weights"):
        monkeypatch.setattr(plans, step, lambda spark, sf: None)
    getattr(plans, name)(None, None)
    return seen


@pytest.mark.parametrize("name, n", [("permutation_null", 500), ("perturbation_audit", 200)])
def test_queries_refit_as_often_as_the_reference(monkeypatch, name, n):
    assert arguments(monkeypatch, name)["n"] == n


def test_manifest_is_written_compressed(spark, monkeypatch, tmp_path):
    text = "Quantity PG. | 77712345_LD_M3_A.raw | 77712345_LD_M3_A.raw".encode("utf-16le")
    files = spark.createDataFrame([(f"/data/other/{k}.sne", 0, text, False, False) for k in range(300)], "path string, size_bytes long, head binary, zip_container boolean, tar_container boolean")
    monkeypatch.setattr(sources, "instrument_files", lambda spark, sf: files)
    monkeypatch.setattr(sources, "scratch", lambda spark: str(tmp_path / "manifest"))
    row, = sources.file_manifest(spark, None).collect()
    assert (row.n, row.run_count, row.run, row.ages) == (300, 1, "712345_LD_M3_A.raw", "M3")
    written = glob.glob(str(tmp_path / "manifest" / "part-*"))
    assert written and all(path.endswith(".json.gz") for path in written)
