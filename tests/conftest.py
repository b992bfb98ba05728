import glob
import os
import sys

import duckdb
import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from foldwise.session import local_session, release  # noqa: E402

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = local_session("tests", folder=str(tmp_path_factory.mktemp("tables")))
    yield session
    release(session)


@pytest.fixture(scope="session")
def sf_dir():
    return SF_DIR


@pytest.fixture(scope="session")
def db():
    connection = duckdb.connect()
    for path in glob.glob(f"{SF_DIR}/*.parquet"):
        connection.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return connection


@pytest.fixture(scope="class")
def tiny_groups(spark):
    """Force the path for groups too large for one task."""
    from foldwise.operators.ordering import GROUP_ROWS

    spark.conf.set(GROUP_ROWS, "7")
    yield
    spark.conf.unset(GROUP_ROWS)
