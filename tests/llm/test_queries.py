"""Every query with SQL equals it; the SQL of all of them reads whole tables."""

import pytest

from foldwise.llm.registry import ORACLE, QUERIES
from tests.compare import canonical, frame_of, type_gaps


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_oracle(name, spark, sf_dir, db):
    df = QUERIES[name](spark, sf_dir)
    assert canonical(frame_of(df)) == canonical(db.execute(ORACLE[name]).fetchdf())
    assert not type_gaps(df, db, ORACLE[name])


def test_names():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))
